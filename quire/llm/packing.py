"""Lexical retrieval packing: neighbours found by a sharded BM25 inverted index fill the window of each seed document."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, forget_in_worker, mix, rows_a_batch, table
from .word_bpe import WordBpe, pieces

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Bm25:
    """An inverted index of one shard, from the terms and counts of its documents: for each term its documents and what it
    adds to their scores. A document asks with all its terms.

    Lists of terms that more than one document in DENSE has are kept as rows over all documents, which are added whole.
    """

    DENSE = 12

    def __init__(self, found: list[tuple[np.ndarray, np.ndarray]], k1: float = 1.2, b: float = 0.75):
        n = len(found)
        size = np.array([c.sum() for _, c in found], np.float64)
        term = np.concatenate([t for t, _ in found]) if n else np.zeros(0, np.uint16)
        doc = np.repeat(np.arange(n, dtype=np.int32), [len(t) for t, _ in found])
        tf = np.concatenate([c for _, c in found]).astype(np.float32) if n else np.zeros(0, np.float32)
        order = np.argsort(term, kind="stable")
        names, first, df = np.unique(term[order], return_index=True, return_counts=True)
        idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
        self.doc, tf = doc[order], tf[order]
        norm = (k1 * (1 - b + b * size / max(1.0, size.mean() if n else 1.0))).astype(np.float32)
        self.weight = np.repeat(idf, df) * tf * np.float32(k1 + 1) / (tf + norm[self.doc])
        self.first, self.last = first, first + df
        often = np.flatnonzero(df * self.DENSE > max(n, 64))
        self.rows = np.zeros((len(often), n), np.float32)
        for r, t in enumerate(often.tolist()):
            self.rows[r, self.doc[first[t] : first[t] + df[t]]] = self.weight[first[t] : first[t] + df[t]]
        row = np.full(len(names), -1)
        row[often] = np.arange(len(often))
        at = np.searchsorted(names, term)
        at[df[at] == 1] = -1  # a term of one document finds no other
        cut = np.cumsum([0, *(len(t) for t, _ in found)]).tolist()
        self.queries = []
        for a, z in pairwise(cut):
            t = at[a:z]
            t = t[t >= 0]
            dense = row[t]
            self.queries.append((dense[dense >= 0], t[dense < 0]))

    def scores(self, seed: int) -> np.ndarray:
        """Of all documents for the terms of one, always added in the same order."""
        dense, thin = self.queries[seed]
        out = np.zeros(self.rows.shape[1], np.float32)
        for r in dense.tolist():
            out += self.rows[r]
        if len(thin):
            spans = list(zip(self.first[thin].tolist(), self.last[thin].tolist(), strict=True))
            docs = np.concatenate([self.doc[a:z] for a, z in spans])
            out += np.bincount(docs, np.concatenate([self.weight[a:z] for a, z in spans]), len(out)).astype(np.float32)
        return out

    def neighbours(self, seed: int, free: np.ndarray) -> np.ndarray:
        """Free documents that share terms with the seed, the best first, ties to the earlier."""
        return np.fromiter(self.nearest(seed, free), np.int64)

    def nearest(self, seed: int, free: np.ndarray) -> Iterator[int]:
        """The same, one after the other; what is free is looked at once."""
        s = self.scores(seed)
        s[~free] = 0
        left, most = int(np.count_nonzero(s)), 16
        while left > 0:  # a few at a time: windows seldom take many
            if left > most:
                some = np.flatnonzero(s >= np.partition(s, len(s) - most)[len(s) - most])
            else:
                some = np.flatnonzero(s)
            yield from some[np.argsort(-s[some], kind="stable")].tolist()
            s[some] = 0
            left, most = left - len(some), most * 8


def terms(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(ids, return_counts=True)


def terms_of(rows: list[np.ndarray], most: int = 1 << 20) -> list[tuple[np.ndarray, np.ndarray]]:
    """The terms of each of many documents, of which those of about `most` ids are sorted together. Ids have 32 bits at most."""
    ends, out, a = np.cumsum([0, *(len(r) for r in rows)]), [], 0
    while a < len(rows):
        z = min(max(a + 1, int(np.searchsorted(ends, ends[a] + most, "right")) - 1), a + (1 << 16))
        kind, ids = rows[a].dtype, np.concatenate(rows[a:z])
        wide, bits = (np.uint32, 16) if kind.itemsize == 2 else (np.uint64, 32)
        x = np.repeat(np.arange(z - a, dtype=wide) << wide(bits), np.diff(ends[a : z + 1])) | ids.astype(wide)
        x.sort()
        at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1], [True]))) if len(x) else np.zeros(1, np.int64)
        cut = np.searchsorted(at[:-1], ends[a : z + 1] - ends[a]).tolist()
        t, c = (x[at[:-1]] & wide((1 << bits) - 1)).astype(kind), np.diff(at)
        out += [(t[i:j], c[i:j]) for i, j in pairwise(cut)]
        a = z
    return out


def fill(rests: list[np.ndarray], window: int, found: list[tuple[np.ndarray, np.ndarray]] | None = None) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, from, to) over the ids of all rests, each full but the last ones, whose lengths are powers of two.

    found has the terms of the whole documents; without it the rests are whole. A seed's neighbours fill its window in the order of their scores; the last is cut, and its rest is the next seed.
    Where no neighbour is left the next free document follows.
    """
    index, free = Bm25(terms_of(rests) if found is None else found), np.array([len(r) > 0 for r in rests], bool)
    out: list[list[tuple[int, int, int]]] = []
    row: list[tuple[int, int, int]] = []
    room, seed, cut, nxt = window, -1, 0, 0
    while True:
        if seed < 0:  # a window's first document, or the next where neighbours are used up
            while nxt < len(rests) and not free[nxt]:
                nxt += 1
            if nxt == len(rests):
                break
            seed, cut = nxt, 0
            free[seed] = False
        doc, queue = seed, index.nearest(seed, free)
        while True:
            took = min(room, len(rests[doc]) - cut)
            row.append((doc, cut, cut + took))
            room, cut = room - took, cut + took
            if not room:
                out.append(row)
                row, room = [], window
                seed, cut = (doc, cut) if cut < len(rests[doc]) else (-1, 0)
                break
            doc, cut = next(queue, -1), 0
            if doc < 0:
                seed = -1
                break
            free[doc] = False
    while row:  # the last sequence, as powers of two
        n = sum(b - a for _, a, b in row)
        room, head = 1 << (n.bit_length() - 1), []
        while room:
            d, a, b = row[0]
            took = min(room, b - a)
            head.append((d, a, a + took))
            room -= took
            row = row[1:] if took == b - a else [(d, a + took, b), *row[1:]]
        out.append(head)
    return out


def idf_of(partial: DataFrame, dtype: str) -> np.ndarray:
    """Inverse document frequencies of all ids, from rows (terms, counts) that have the frequencies of parts of all documents.

    A row may have as many terms as there are ids, so few are held at once, and added up before they meet.
    """

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for t, c in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
                ids = np.frombuffer(t, dtype)
                if len(ids) and ids[-1] >= len(df):  # ids are sorted
                    df = np.concatenate([df, np.zeros(int(ids[-1]) + 1 - len(df), np.int64)])
                df[ids] += np.frombuffer(c, "<i8")
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["term", "df"])

    spark = partial.sparkSession
    with rows_a_batch(spark, 64):
        rows = partial.coalesce(spark.sparkContext.defaultParallelism)
        got = rows.mapInArrow(added, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(1 + max(got["term"].to_pylist(), default=0))
    df[got["term"].to_numpy()] = got["df"].to_numpy()
    most = df.max() + 1
    return np.log1p((most - df + 0.5) / (df + 0.5))


class Keys:
    """Two terms of a document, drawn so that two documents draw the same in proportion to what they share: the smallest
    of hashed exponentials over weights (tf saturated, times idf)."""

    def __init__(self, vocabulary: int, idf: np.ndarray):
        u = [(mix(np.arange(vocabulary, dtype=np.uint64) + np.uint64(k << 32)) >> np.uint64(11)).astype(np.float64) for k in (1, 2)]
        weight = np.full(vocabulary, idf.max(initial=1.0))
        weight[: min(len(idf), vocabulary)] = idf[:vocabulary]
        self.draws = [-np.log((x + 0.5) / 2.0**53) / np.maximum(weight, 1e-6) for x in u]

    def of(self, terms: np.ndarray, counts: np.ndarray) -> tuple[int, int]:
        over = (counts + 1.2) / counts
        return tuple(int(terms[(d[terms] * over).argmin()]) for d in self.draws)


def pack(docs: DataFrame, path: str, window: int = 2048, end: int = 1, shard: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents in sequences of at most `window` ids, without padding.

    Every full window of a document is a sequence of its own; the rests are packed by retrieval within shards of so many
    documents. Shards are lexical: documents are dealt and sorted by two of their terms (Keys), then by a hash, so those
    that share much tend to lie together and no group of equal ones is in one task. The idf for that is of all
    documents, counted while they are encoded; scores of an index are of all its documents and terms. Sequence ids have the number of the
    partition in the bits from 36 on, and bit 62 for rests. Null texts have the end id only, as empty ones; very long
    texts are encoded whole. Equal rows and rows of equal or null ids are packed one by one. An empty table gives an
    empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("id"))
    rows = rows.withColumn("h", F.xxhash64("id", "text"))
    n = docs.count()

    def crc(x: np.ndarray) -> int:
        return zlib.crc32(x if x.dtype == "<u4" else x.astype("<u4"))

    def batch_of(rows: list[tuple], shape: pa.Schema) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [[]] * len(shape)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, shape, strict=True)], schema=shape)

    piece = pa.schema([(k, pa.int64()) for k in names])
    coded = pa.schema([*piece, *((k, pa.binary()) for k in ("rest", "terms", "counts")), ("h", pa.int64())])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Full windows of each document, and its rest, of longer documents with the terms of all; at last, without a start,
        the terms of the task's documents and in how many of these each one is."""
        bpe, base = WordBpe.load(path), TaskContext.get().partitionId() << 36
        out, count, df = [], 0, np.zeros(bpe.vocabulary, np.int64)
        for batch in batches:
            texts, ids, h = (c.to_pylist() for c in batch.columns)
            for p, q in pieces(texts):
                got = bpe.encode(texts[p:q], end)
                for i, k, x, (t, c) in zip(ids[p:q], h[p:q], got, terms_of(got), strict=True):
                    full = len(x) // window * window
                    for a in range(0, full, window):
                        out.append((i, a, window, crc(x[a : a + window]), len(x), base + count, 0, *[None] * 4))
                        count += 1
                    df[t] += 1
                    if full < len(x):
                        more = (t.tobytes(), c.astype("<u4").tobytes()) if full else (None, None)
                        out.append((i, full, None, None, len(x), None, None, x[full:].tobytes(), *more, k))
                yield batch_of(out, coded)
                out = []
        some = np.flatnonzero(df)
        if len(some):
            yield batch_of([(*[None] * 8, some.astype(bpe.dtype).tobytes(), df[some].astype("<i8").tobytes(), None)], coded)

    def whole(rests: list[np.ndarray], stored: list[tuple[bytes | None, bytes | None]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The terms of whole documents: those stored, else those of the rest."""
        own = iter(terms_of([r for r, (t, _) in zip(rests, stored, strict=True) if t is None]))
        return [next(own) if t is None else (np.frombuffer(t, dtype), np.frombuffer(c, "<u4")) for t, c in stored]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rests with the terms they are dealt by."""
        keys = Keys(WordBpe.load(path).vocabulary, idf)
        for batch in batches:
            rest, t, c = (batch.column(k).to_pylist() for k in (2, 3, 4))
            found = whole([np.frombuffer(r, dtype) for r in rest], list(zip(t, c, strict=True)))
            drawn = np.array([keys.of(*x) for x in found], np.int32).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(drawn[:, 0]), pa.array(drawn[:, 1])], names=[*batch.schema.names, "key1", "key2"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_in_worker()
        base, count = (1 << 62) + (TaskContext.get().partitionId() << 36), 0
        held: list[tuple[int | None, int, np.ndarray]] = []
        stored: list[tuple[bytes | None, bytes | None]] = []

        def close() -> pa.RecordBatch:
            nonlocal count
            out, rests = [], [r for _, _, r in held]
            for seq in fill(rests, window, whole(rests, stored)):
                at = 0
                for d, a, b in seq:
                    i, n, r = held[d]
                    out.append((i, n - len(r) + a, b - a, crc(r[a:b]), n, base + count, at))
                    at += b - a
                count += 1
            held.clear()
            stored.clear()
            return batch_of(out, piece)

        for batch in batches:
            for i, n, rest, t, c in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                held.append((i, n, np.frombuffer(rest, dtype)))
                stored.append((t, c))
                if len(held) == shard:
                    yield close()
        yield close()

    dtype = WordBpe.load(path).dtype
    kept = scratch.keep(rows.mapInArrow(encoded, f"{SCHEMA}, rest binary, terms binary, counts binary, h long"), "encoded")
    idf = idf_of(kept.where("start is null").select("terms", "counts"), dtype)
    parts = max(1, -(-n // (16 * shard)), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // shard)))
    rests = kept.where("rest is not null").select("doc_id", "doc_tokens", "rest", "terms", "counts", "h")
    rests = scratch.keep(rests.mapInArrow(keyed, "doc_id long, doc_tokens long, rest binary, terms binary, counts binary, h long, key1 int, key2 int"), "keyed")
    rests = rests.repartitionByRange(parts, "key1", "key2", "h").sortWithinPartitions("key1", "key2", "h", "doc_id")
    out = kept.where("rest is null and start is not null").select(*names).union(rests.mapInArrow(packed, SCHEMA))
    return out.withColumnRenamed("doc_id", id_col)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids of word_bpe_49k, with id 1 at the end of each document."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op8_packing": op8_packing}
ORACLE_SQL: dict[str, str] = {}
