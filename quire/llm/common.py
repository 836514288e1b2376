"""What the operators of this subpackage share: scratch tables, words, runs of equal keys, components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import spread

#: The characters that separate words, as a Java character class.
WHITE = r"\x20\x09-\x0D"


class Scratch:
    """A folder below spark.checkpoint.dir for tables that cut lineage or are read more than once.

    Executors share that folder, so a lost executor costs no table. Only where the setting is missing (tests on
    one machine) a local folder is set as checkpoint folder.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
        if not base:
            base = tempfile.mkdtemp(prefix="quire-")
            spark.sparkContext.setCheckpointDir(base)
        self.path = f"{base.rstrip('/')}/quire-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as a Parquet table and read it back. Shuffle files that only the writing needed are let go: Spark
        deletes them when the driver collects its garbage, which by itself it may not do for half an hour."""
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(path)
        gc.collect()
        self.spark._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


#: What a Python worker keeps from task to task: at most one large thing. Operators that keep nothing let it go.
_kept: dict = {}


def keep_in_worker(key, make: Callable):
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def forget_in_worker() -> None:
    _kept.clear()


@contextmanager
def without_gc() -> Iterator[None]:
    """No search for cycles while millions of small objects are made that have none."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


@contextmanager
def rows_a_batch(spark: SparkSession, most: int) -> Iterator[None]:
    """Arrow batches of so many rows at most in what is run meanwhile, where rows are wide."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(most, int(before)) if int(before) > 0 else most)
    try:
        yield
    finally:
        spark.conf.set(key, before)


KEYS = {"documents": "doc_id", "pages": "page_id", "embeddings": "vec_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; large ones that come in a few files are dealt to all cores."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows, KEYS[name]) if name in KEYS else rows


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Cut batches that come sorted by keys into tables of one key each. One group is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            c = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= c[1:] != c[:-1]
        first = tuple(batch.column(k)[0].as_py() for k in keys)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if a and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in keys)
    if held:
        yield pa.Table.from_batches(held)


def map_runs(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, tasks: int | None = None) -> DataFrame:
    """Deal df by keys, sort it and give fn each group in turn, in few Arrow batches. Groups must have a bound.

    Where fn takes long for few bytes, a number of tasks keeps Spark from putting small partitions together.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, keys):
            yield from fn(group)

    return (df.repartition(tasks, *keys) if tasks else df.repartition(*keys)).sortWithinPartitions(*keys, *order).mapInArrow(each, schema)


_P1, _P2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of unsigned 64-bit integers."""
    x = (x ^ (x >> _S30)) * _P1
    x = (x ^ (x >> _S27)) * _P2
    return x ^ (x >> _S31)


_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(0, 1 << 64, 256, np.uint64)
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 1 << 16


def _powers(base: int) -> np.ndarray:
    out = np.empty(_STEP, np.uint64)
    x = 1
    for i in range(_STEP):
        out[i] = x
        x = x * base & (1 << 64) - 1
    return out


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of text, A-Z in lower case, without a loop over words.

    A word's hash is a polynomial of random numbers for its bytes, from sums over the text up to its ends, mixed; words
    of over 64 bytes, for which equal values could be made up, are hashed one by one. Texts are taken in stretches.
    """
    if not text:
        return np.zeros(0, np.uint64)
    raw = text.encode("utf-8", "surrogatepass").lower()
    white = _IS_WHITE[np.frombuffer(raw, np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], white, [True])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    out = np.empty(len(starts), np.uint64)
    data = np.frombuffer(raw, np.uint8)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = len(starts) if len(raw) - a <= _STEP else max(i + 1, int(np.searchsorted(ends, a + _STEP, "right")))
        b = min(int(ends[j - 1]), a + _STEP)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_BYTE[data[a:b]] * _UP[: b - a], out=sums[1:])
        s, e = starts[i:j] - a, np.minimum(ends[i:j] - a, b - a)
        out[i:j] = mix((sums[e] - sums[s]) * _DOWN[s] + (e - s).astype(np.uint64))
        i = j
    long = np.flatnonzero(ends - starts > 64)
    for k in long.tolist():
        out[k] = int.from_bytes(blake2b(raw[starts[k] : ends[k]], digest_size=8).digest(), "little")
    return out


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word windows in order; the whole sequence as one if it is shorter; none without words."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + words[i : n - k + 1 + i] + np.uint64(i + 1))
    return out


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, name: str = "cc", hub: int = 1000) -> DataFrame:
    """Connected components of edges (u, v), by alternating large-star and small-star steps.

    Returns (id, component) for every id on an edge, component being the smallest id reachable. Each round writes its
    edges as a table; ids are joined with the minimum of their neighbours only, no list of these is gathered. The minima
    of hubs, of which there are at most 400, are broadcast, so their edges needn't meet in one task.
    """

    def stars(e: DataFrame, large: bool, most: int) -> DataFrame:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        if most:
            hubs = F.broadcast(low.where(F.col("n") >= most).select("u", F.col("m").alias("of_hub")))
            both = both.join(hubs, "u", "left")
            rest = both.where("of_hub is null").select("u", "v").join(low.where(F.col("n") < most).select("u", "m"), "u")
            hung = rest.union(both.where("of_hub is not null").select("u", "v", "of_hub"))
        else:
            hung = both.join(low.select("u", "m"), "u")
        if large:
            return hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        return hung.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.where("u <> m").select("u", F.col("m").alias("v"))).distinct()

    e = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v")
    e, seen, k = scratch.keep(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}0"), None, 0
    while True:
        n, s = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not n or (n, s) == seen:
            break
        seen, k = (n, s), k + 1
        most = max(hub, n // 200) if n >= 20 * hub else 0  # of fewer edges, no hub is worth a join of its own
        e = scratch.keep(stars(stars(e, True, most), False, most), f"{name}{k}")
        scratch.drop(f"{name}{k - 1}")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct()).groupBy("id").agg(F.min("component").alias("component"))
