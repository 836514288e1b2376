"""Language-model scores from a log-frequency Bloom filter.

The filter holds unigrams and bigrams of training texts with their counts in steps of powers of two: a count of q binary
digits is q items (n-gram, 1) to (n-gram, q), so membership is probed for growing q until it fails. Counts are gathered
by shards of the n-grams' hashes; each shard makes its own segment of the filter from its exact counts, so segments are
complete where they are made and every n-gram is in one. The filter grows with the n-grams. One that may be broadcast is;
a larger one is a file in the scratch folder, which tasks map into their memory, or, where that folder isn't a mounted
one, the distinct n-grams of blocks of texts are dealt to the segments.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, forget_in_worker, map_runs, mix, rows_a_batch, table, word_hashes
from .word_bpe import pieces

END = np.uint64(0x0123456789ABCDEF)
FP = np.uint64((1 << 40) - 1)
HASHES = 4
#: Bits of a filter that is broadcast, at most: 128 MB. A larger one is asked where its segments are, with equal answers.
MOST_BITS = 1 << 30
#: Bits from which a filter is mapped from a file, where the scratch folder can be, also if it may be broadcast: 8 MB.
MAPPED_BITS = 1 << 26
#: Characters whose n-grams are asked for at once, about.
PIECE = 1 << 20
#: N-grams of a shard, about, at most. The number of shards follows from those of the texts alone.
SHARD = 1 << 22


def bigram(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + mix(b))


def unigram(a: np.ndarray) -> np.ndarray:
    return mix(a ^ np.uint64(0x5851F42D4C957F2D))


def grams(t: np.ndarray) -> np.ndarray:
    """Unigrams of all tokens, then bigrams."""
    return np.concatenate((unigram(t), bigram(t[:-1], t[1:])))


def digits(counts: np.ndarray) -> np.ndarray:
    """Binary digits of counts."""
    return np.frexp(counts.astype(np.float64))[1]


def least_of(q: np.ndarray) -> np.ndarray:
    """The least counts of so many binary digits."""
    return np.where(q > 0, 2.0 ** (q - 1.0), 0.0)


def positions(item: np.ndarray, level: int, bits: np.ndarray, i: int) -> np.ndarray:
    h = mix(item + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return ((low + np.uint64(i) * high & np.uint64(0xFFFFFFFF)) * bits) >> np.uint64(32)


def segment(items: np.ndarray, counts: np.ndarray, step: int = 1 << 20, bits_an_item: int = 8) -> tuple[bytes, int]:
    """The filter of one shard, with room for all its items, and its bits. So many items are hashed at once."""
    q = digits(counts)
    bits = max(64, -(-int(q.sum()) * bits_an_item // 64) * 64)
    out = np.zeros(bits, np.uint8)
    for level in range(1, int(q.max(initial=0)) + 1):
        own = items[q >= level]
        for a in range(0, len(own), step):
            for i in range(HASHES):
                out[positions(own[a : a + step], level, np.uint64(bits), i)] = 1
    return np.packbits(out, bitorder="little").tobytes(), bits


def probe(data: np.ndarray, item: np.ndarray, first: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Digits of the counts of items whose segments begin at first and have so many bits; 0 where even the first probe fails."""
    out = np.zeros(len(item), np.int8)
    at = np.arange(len(item))
    level = 1
    while len(at) and level < 64:
        for i in range(HASHES):
            p = positions(item[at], level, bits[at], i)
            at = at[data[first[at] + (p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8) & 1 == 1]
        out[at] = level
        level += 1
    return out


@dataclass
class Filter:
    """What is broadcast: segments one after the other, or the file that has them, where each begins (in bytes) and its bits."""

    data: bytes | str
    first: np.ndarray
    bits: np.ndarray
    shift: int  # n-gram hash >> shift is the shard

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        """Digits of the counts of n-grams."""
        shard = (hashes >> np.uint64(self.shift)).astype(np.int64)
        item = (shard.astype(np.uint64) << np.uint64(40)) | (hashes & FP)
        data = np.memmap(self.data, np.uint8, "r") if isinstance(self.data, str) else np.frombuffer(self.data, np.uint8)
        return probe(data, item, self.first[shard], self.bits[shard])


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an end before the first text and after each, and the number of tokens of each text."""
    parts, n = [np.array([END])], []
    for t in texts:
        w = word_hashes(t)
        parts += [w, parts[0]]
        n.append(len(w) + 1)
    return np.concatenate(parts), np.array(n, np.int64)


def tally(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    h, c = np.concatenate(hashes), np.concatenate(counts)
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    return h[starts], np.add.reduceat(c, starts) if len(h) else c


def counted(batches: Iterator[pa.RecordBatch], grams, most: int = 1_500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Counts of the n-grams of training texts, put together within a task up to about `most` at once."""
    h, c, size = [], [], 0
    texts, chars = [], 0

    def add() -> None:
        nonlocal size, chars
        x, n = np.unique(grams(tokens(texts)[0]), return_counts=True)
        h.append(x)
        c.append(n.astype(np.int64))
        size += len(x)
        texts.clear()
        chars = 0

    for batch in batches:
        for t in batch.column(0).to_pylist():
            texts.append(t)
            chars += len(t or "")
            if chars >= 2 * PIECE:
                add()
            if size > most:
                yield tally(h, c)
                h, c, size = [], [], 0
    if texts:
        add()
    if h:
        yield tally(h, c)


def pack_items(items: np.ndarray) -> bytes:
    """40 bits of each hash."""
    return (items & FP).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def wide(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view(np.uint64).ravel()


def by_shard(hashes: np.ndarray, shards: int, shift: int) -> list[int]:
    """Where each shard begins in sorted hashes, and their end."""
    return np.searchsorted(hashes, np.arange(shards, dtype=np.uint64) << np.uint64(shift)).tolist() + [len(hashes)]


def train(texts: DataFrame, scratch: Scratch, bits_an_item: int) -> tuple[DataFrame, DataFrame, int, int, int]:
    """(exact unigram counts, segments of the filter, number of shards, N, V) of one column of texts."""

    def unigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, c in counted(batches, lambda t: t[1:]):
            for a in range(0, len(h), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[a : a + 100_000].view(np.int64)), pa.array(c[a : a + 100_000])], names=["token", "count"])

    def ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each shard: 40 bits of each n-gram's hash, those counted once apart."""
        for h, c in counted(batches, lambda t: grams(t)[1:]):
            cut = by_shard(h, shards, shift)
            rows: tuple[list, list, list, list] = ([], [], [], [])
            for s in range(shards):
                x, n = h[cut[s] : cut[s + 1]] & FP, c[cut[s] : cut[s + 1]]
                if len(x):
                    one = n == 1
                    for r, v in zip(rows, (s, *(pack_items(x[m]) for m in (one, ~one)), n[~one].tobytes()), strict=True):
                        r.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(r, pa.binary()) for r in rows[1:])], names=["shard", "once", "more", "counts"])

    def made(group: pa.Table) -> Iterator[pa.RecordBatch]:
        once, more = [wide(x) for x in group["once"].to_pylist()], [wide(x) for x in group["more"].to_pylist()]
        x, n = tally([*once, *more], [*(np.ones(len(v), np.int64) for v in once), *(np.frombuffer(v, np.int64) for v in group["counts"].to_pylist())])
        s = group["shard"][0].as_py()
        data, bits = segment(x | np.uint64(s << 40), n, bits_an_item=bits_an_item)
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([bits], pa.int64()), pa.array([data], pa.binary())], names=["shard", "bits", "data"])

    with rows_a_batch(texts.sparkSession, 2000):
        counts = scratch.keep(texts.mapInArrow(unigrams, "token long, count long").groupBy("token").agg(F.sum("count").alias("count")), "unigrams")
    total, distinct = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    shards = 1 << (max(16, -(-2 * total // SHARD)) - 1).bit_length()
    shift = 64 - (shards.bit_length() - 1)
    with rows_a_batch(texts.sparkSession, 64):
        segments = scratch.keep(map_runs(texts.mapInArrow(ngrams, "shard int, once binary, more binary, counts binary"), ["shard"], [], made, "shard int, bits long, data binary", shards), "segments")
    return counts, segments, shards, total, distinct


def collected(segments: DataFrame, shards: int) -> Filter:
    """The whole filter, at the driver."""
    parts, bits = [bytes(8)] * shards, np.full(shards, 64, np.uint64)
    for r in segments.toLocalIterator():
        parts[r["shard"]], bits[r["shard"]] = bytes(r["data"]), r["bits"]
    size = np.array([len(p) for p in parts])
    return Filter(b"".join(parts), np.cumsum(size) - size, bits, 64 - (shards.bit_length() - 1))


def folder(scratch: Scratch) -> str | None:
    """The scratch folder as a path, if it is one of a mounted file system."""
    at = scratch.spark._jvm.org.apache.hadoop.fs.Path(scratch.path)
    return at.toUri().getPath() if at.getFileSystem(scratch.spark._jsc.hadoopConfiguration()).getScheme() == "file" else None


def mapped(segments: DataFrame, shards: int, place: str) -> Filter:
    """The whole filter in a file, which is written by the tasks that read its segments, each at its own place; tasks that
    run again write the same. Nothing of it comes to the driver, and processes of a machine share the pages they map."""
    bits, size = np.full(shards, 64, np.uint64), np.full(shards, 8)
    for r in segments.select("shard", "bits").collect():
        bits[r["shard"]], size[r["shard"]] = r["bits"], r["bits"] // 8
    first, path = np.cumsum(size) - size, f"{place}/filter"
    with open(path, "wb") as f:
        f.truncate(int(size.sum()))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with open(path, "r+b") as f:
                for s, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    f.seek(int(first[s]))
                    f.write(raw.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    with rows_a_batch(segments.sparkSession, 16):
        segments.select("shard", "data").mapInArrow(put, "n long").agg(F.sum("n")).first()
    return Filter(path, first, bits, 64 - (shards.bit_length() - 1))


def asked(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams in the order of their hashes, hence by shard, and which of them each one is."""
    return np.unique(h, return_inverse=True)


def with_answers(rows: DataFrame, segments: DataFrame, shards: int, scratch: Scratch) -> DataFrame:
    """rows (id, held_out, text) in blocks, each a row (block, -1, ids, held, texts) and one (block, shard, answers) for each shard.

    The distinct n-grams of a block go to the shards that have their segments; a shard streams its questions past the one
    segment it holds. Blocks are kept, so both sides see the same.
    """
    kind = rows.schema["id"].dataType.simpleString()
    shift = 64 - (shards.bit_length() - 1)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_in_worker()
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, b in pieces(batch.column(2).to_pylist(), PIECE):
                yield pa.RecordBatch.from_arrays([pa.array([key]), *(pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), pa.concat_arrays([c.slice(a, b - a)])) for c in batch.columns)], names=["block", "ids", "held", "texts"])
                key += b - a

    def questions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, texts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = asked(grams(tokens(texts.as_py())[0]))[0]
                cut = by_shard(h, shards, shift)
                some = [s for s in range(shards) if cut[s] < cut[s + 1]]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([block] * len(some), pa.int64()), pa.nulls(len(some), pa.int64()), pa.array([pack_items(h[cut[s] : cut[s + 1]]) for s in some], pa.binary())], names=["shard", "block", "bits", "data"])

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, data, bits = -1, np.zeros(8, np.uint8), 64
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for s, block, b, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                if s != held:
                    held, data, bits = s, np.zeros(8, np.uint8), 64
                if block < 0:
                    data, bits = np.frombuffer(raw.as_py(), np.uint8), b
                    continue
                item = wide(raw.as_py()) | np.uint64(s << 40)
                got = probe(data, item, np.zeros(len(item), np.int64), np.full(len(item), bits, np.uint64))
                for o, v in zip(out, (block, s, got.tobytes()), strict=True):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], names=["block", "shard", "answers"])

    texts = scratch.keep(rows.mapInArrow(blocks, f"block long, ids array<{kind}>, held array<boolean>, texts array<string>"), "blocks")
    sides = segments.select("shard", F.lit(-1).cast("long").alias("block"), "bits", "data").union(texts.select("block", "texts").mapInArrow(questions, "shard int, block long, bits long, data binary"))
    with rows_a_batch(rows.sparkSession, 16):  # blocks are megabytes, and so are some questions
        got = scratch.keep(sides.repartition(shards, "shard").sortWithinPartitions("shard", "block").mapInArrow(answers, "block long, shard int, answers binary"), "answers")
    return texts.select("block", F.lit(-1).alias("shard"), "ids", "held", "texts", F.lit(None).cast("binary").alias("answers")).unionByName(got, allowMissingColumns=True)


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", weight: float = 20.0, most_frequent: int = 1_000_000, most_bits: int = MOST_BITS, bits_an_item: int = 8) -> DataFrame:
    """Each text's exact unigram score and its score by the model, learnt from texts that are not held out.

    The model: P(w | v) = (c(vw) + weight * P(w)) / (c(v) + weight) with P(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)); counts are
    those of the filter, in the numerators the least and in c(v) the greatest of their number of binary digits, so
    probabilities sum to 1 at most where no probe errs. The context of the first word is the end of a text.

    All n-grams are in the filter, which depends on the texts alone, not on their order, files or partitions. Up to most_bits of it are broadcast; a larger one is mapped from a file or asked by shards, with equal scores.
    The unigram score takes the counts of frequent words (at most most_frequent of them, broadcast) at once and those of
    the others by a join. Null texts are empty: one token, the end; very long texts are scored whole. Rows whose held_out is null are held out. Equal rows are
    scored each. Without training rows all counts are 0. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(True)).alias("held_out"), F.col(text_col).alias("text"))
    counts, segments, shards, total, distinct = train(rows.where("not held_out").select("text"), scratch, bits_an_item)
    least = max(1, -(-total // most_frequent))  # at most most_frequent words can have it
    some = counts.where(F.col("count") >= least).toArrow() if total else pa.table({"token": pa.array([], pa.int64()), "count": pa.array([], pa.int64())})
    frequent = some["token"].to_numpy().view(np.uint64)
    order = np.argsort(frequent)
    bits, place = segments.agg(F.coalesce(F.sum("bits"), F.lit(0))).first()[0], folder(scratch)
    if place and bits > min(most_bits, MAPPED_BITS):
        bloom = mapped(segments, shards, place)
    else:
        bloom = collected(segments, shards) if bits <= most_bits else None
    local = bloom is not None
    shared = spark.sparkContext.broadcast((bloom, frequent[order], some["count"].to_numpy()[order]))
    norm = total + 0.1 * (distinct + 1)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"key long, id {kind}, held_out boolean, n_tokens long, known long, logs double, score double, token long, times long"

    def scored(keys: np.ndarray, ids: pa.Array, held: pa.Array, texts: list[str | None], found: Callable[[np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
        """A row for each text, and one for each of its words that isn't frequent. found gives the filter's digits of distinct n-grams."""
        _, frequent, of = shared.value
        names = [x.split()[0] for x in schema.split(", ")]
        (t, n), m = tokens(texts), len(texts)
        doc, word = np.repeat(np.arange(m), n), t[1:]
        at = np.searchsorted(frequent, word)
        at[at == len(frequent)] = 0
        hit = frequent[at] == word if len(frequent) else np.zeros(len(word), bool)
        known = np.bincount(doc[hit], minlength=m)
        logs = np.bincount(doc[hit], np.log10(of[at[hit]] + 0.1), m)
        some, which = asked(grams(t))
        every = found(some)[which]
        w, pair = every[: len(t)], every[len(t) :]
        low, high = least_of(w), 2.0**w - 1
        p = (np.minimum(least_of(pair), high[:-1]) + weight * (low[1:] + 0.1) / norm) / (high[:-1] + weight)
        model = np.bincount(doc, np.log10(p), m)
        none = [pa.nulls(m, pa.int64())] * 2
        yield pa.RecordBatch.from_arrays([pa.array(keys), ids, held, pa.array(n), pa.array(known.astype(np.int64)), pa.array(logs), pa.array(model), *none], names=names)
        rare = np.flatnonzero(~hit)
        if len(rare):
            d, x = doc[rare], word[rare]
            o = np.lexsort((x, d))
            d, x = d[o], x[o]
            starts = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (x[1:] != x[:-1])])
            times = np.diff(np.r_[starts, len(d)])
            for i in range(0, len(starts), 100_000):
                s = starts[i : i + 100_000]
                k = len(s)
                yield pa.RecordBatch.from_arrays([pa.array(keys[d[s]]), pa.nulls(k, ids.type), pa.nulls(k, pa.bool_()), *[pa.nulls(k, pa.int64())] * 2, *[pa.nulls(k, pa.float64())] * 2, pa.array(x[s].view(np.int64)), pa.array(times[i : i + 100_000].astype(np.int64))], names=names)

    def by_broadcast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_in_worker()
        bloom, key = shared.value[0], TaskContext.get().partitionId() << 40
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in pieces(texts, PIECE):
                yield from scored(key + np.arange(b - a), batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), texts[a:b], bloom.counts)
                key += b - a

    def by_answers(group: pa.Table) -> Iterator[pa.RecordBatch]:
        """A block, with the answers of all shards in their order."""
        ids, held, texts = (group[c].chunk(0)[0] for c in ("ids", "held", "texts"))
        got = np.frombuffer(b"".join(group["answers"].to_pylist()[1:]), np.int8)
        yield from scored(group["block"][0].as_py() + np.arange(len(texts)), ids.values, held.values, texts.as_py(), lambda _: got)

    if local:
        judged = rows.mapInArrow(by_broadcast, schema)
    else:
        judged = map_runs(with_answers(rows, segments, shards, scratch), ["block"], ["shard"], by_answers, schema)
    with rows_a_batch(spark, 2000 if local else 8):
        parts = scratch.keep(judged, "parts")
    rare = parts.where("token is not null").select("key", "token", "times").join(counts.where(F.col("count") < least), "token", "left")
    c = F.coalesce("count", F.lit(0))
    rare = rare.groupBy("key").agg(F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("known2"), F.sum(F.col("times") * F.log10(c + 0.1)).alias("logs2"))
    out = parts.where("token is null").drop("token", "times").join(rare, "key", "left")
    base = F.col("logs") + F.coalesce("logs2", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(norm))
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("known2", F.lit(0))).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, learning from those whose id's checksum isn't divisible by 10."""
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    return score(table(spark, sf_dir, "documents"), held_out)


QUERIES = {"op4_lm_scoring": op4_lm_scoring}
ORACLE_SQL: dict[str, str] = {}
