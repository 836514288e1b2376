"""Token files: ids in the fewest bits that the vocabulary needs, in blocks that can be read one by one.

Layout, little-endian: 4 bytes QTOK, u32 version, u32 bits, u32 ids a block; the blocks, each of ids * bits bits filled
to whole bytes; then u64 offsets of the blocks in the file, i64 document ids, a byte for each document that is 1 where
the id is null, u64 first ids of the documents and one more; last u64 number of blocks, of documents and of ids, and
the place where the offsets begin.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Scratch, table
from .word_bpe import WordBpe, pieces

MAGIC, VERSION = b"QTOK", 1
HEAD, TAIL = struct.Struct("<4sIII"), struct.Struct("<QQQQ")


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids in `bits` bits each, the lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits(((ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first n ids of what pack() made, as unsigned 32-bit integers."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    raw = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (raw.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class Writer:
    """Writes one token file; what is held are one block and the index."""

    def __init__(self, sink, bits: int, block: int = 8192):
        self.sink, self.bits, self.block = sink, bits, block
        self.at = self.n = 0
        self.held: list[np.ndarray] = []
        self.size = 0
        self.offsets, self.ids, self.nulls, self.starts = [], [], [], []
        self._put(HEAD.pack(MAGIC, VERSION, bits, block))

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.starts.append(self.n)
        self.n += len(ids)
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        full = len(ids) if last else len(ids) // self.block * self.block
        for a in range(0, full, self.block):
            self.offsets.append(self.at)
            self._put(pack(ids[a : min(full, a + self.block)], self.bits))
        self.held, self.size = [ids[full:]], len(ids) - full

    def close(self) -> None:
        self._flush(True)
        index = self.at
        for x, kind in ((self.offsets, "<u8"), (self.ids, "<i8"), (self.nulls, "u1"), ([*self.starts, self.n], "<u8")):
            self._put(np.array(x, kind).tobytes())
        self._put(TAIL.pack(len(self.offsets), len(self.ids), self.n, index))
        self.sink.close()


class Reader:
    """Random access to a token file: source has seek and read, size is its length in bytes."""

    def __init__(self, source, size: int):
        self.source = source
        magic, version, self.bits, self.block = HEAD.unpack(self._get(0, HEAD.size))
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token file")
        blocks, docs, self.n, index = TAIL.unpack(self._get(size - TAIL.size, TAIL.size))
        self.end = index
        raw = self._get(index, size - TAIL.size - index)
        cut = np.cumsum([0, 8 * blocks, 8 * docs, docs, 8 * (docs + 1)])
        self.offsets, self.ids, self.nulls, self.starts = (np.frombuffer(raw[a:b], k) for a, b, k in zip(cut[:-1], cut[1:], ("<u8", "<i8", "u1", "<u8"), strict=True))

    def _get(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def read(self, a: int, b: int) -> np.ndarray:
        """Ids a to b of the file; only the blocks that hold them are read."""
        if b <= a:
            return np.zeros(0, np.uint32)
        first, last = a // self.block, (b - 1) // self.block
        ends = [*self.offsets[1:].tolist(), self.end]
        raw = self._get(int(self.offsets[first]), ends[last] - int(self.offsets[first]))
        base, out = int(self.offsets[first]), []
        for k in range(first, last + 1):
            out.append(unpack(raw[int(self.offsets[k]) - base : ends[k] - base], self.bits, min(self.block, self.n - k * self.block)))
        return np.concatenate(out)[a - first * self.block : b - first * self.block]


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme that Spark takes it to have."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def opened(folder: str):
    """The file system of a folder, and the folder there."""
    from pyarrow import fs

    return (fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")) if folder.startswith("file:") else fs.FileSystem.from_uri(folder)


def write_tokens(docs: DataFrame, folder: str, path: str, end: int | None = 1, id_col: str = "doc_id", text_col: str = "text", most_ids: int = 1 << 25) -> DataFrame:
    """Encode every text and write token files in ascending order of ids. Returns the plan of a manifest: a row a file.

    Tasks take ranges of ids and write files of names of their own, so that a task that runs twice leaves a file that
    no manifest names. A file has at most most_ids ids and one document more.
    """

    folder = qualified(docs.sparkSession, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, k, w, name = WordBpe.load(path), TaskContext.get().partitionId(), 0, None, None
        where, base = opened(folder)
        where.create_dir(base, recursive=True)

        def done() -> pa.RecordBatch:
            w.close()
            return pa.RecordBatch.from_pydict({"part": [part], "file": [k], "name": [name], "n_docs": [len(w.ids)], "n_ids": [w.n]}, schema=shape)

        shape = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in pieces(texts):
                for i, x in zip(ids[a:b], bpe.encode(texts[a:b], end), strict=True):
                    if w is None:
                        name = f"tokens-{part:06d}-{k:04d}-{uuid.uuid4().hex}.bin"
                        w = Writer(where.open_output_stream(f"{base}/{name}"), bpe.bits)
                    w.add(i, x)
                    if w.n >= most_ids:
                        yield done()
                        w, k = None, k + 1
        if w is not None:
            yield done()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    return rows.mapInArrow(write, "part int, file int, name string, n_docs long, n_ids long")


def read_tokens(manifest: DataFrame, folder: str, docs_a_task: int = 4096, id_col: str = "doc_id") -> DataFrame:
    """Every document's id, first id among all, number of ids and their checksum, read from the files of a manifest.

    The manifest, of one row a file, is summed up in one task. Tasks read as many documents of a file as docs_a_task.
    """

    folder = qualified(manifest.sparkSession, folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = opened(folder)
        for batch in batches:
            for row in batch.to_pylist():
                at = f"{base}/{row['name']}"
                with where.open_input_file(at) as f:
                    r = Reader(f, f.size())
                    a, b = row["a"], min(row["a"] + docs_a_task, row["n_docs"])
                    out, i = {"id": [], "start": [], "n": [], "crc": []}, a
                    while i < b:  # so many documents at once as have about a million ids
                        j = min(b, max(i + 1, int(np.searchsorted(r.starts, int(r.starts[i]) + (1 << 20)))))
                        ids, s = r.read(int(r.starts[i]), int(r.starts[j])), r.starts[i : j + 1].astype(np.int64)
                        for k in range(j - i):
                            x = ids[s[k] - s[0] : s[k + 1] - s[0]]
                            out["id"].append(None if r.nulls[i + k] else int(r.ids[i + k]))
                            out["start"].append(row["before"] + int(s[k]))
                            out["n"].append(len(x))
                            out["crc"].append(zlib.crc32(x.astype("<u4").tobytes()))
                        i = j
                    yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(k, pa.int64()) for k in out]))

    before = F.sum("n_ids").over(W.orderBy("part", "file").rowsBetween(W.unboundedPreceding, -1))
    rows = manifest.withColumn("before", F.coalesce(before, F.lit(0))).select("name", "n_docs", "before", F.explode(F.expr(f"sequence(0L, n_docs - 1, {docs_a_task}L)")).alias("a"))
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "name", "a").mapInArrow(read, "id long, start long, n long, crc long").select(F.col("id").alias(id_col), "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def token_digests(docs: DataFrame, path: str, folder: str | None = None, end: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the token files of docs and read them back.

    Null texts are empty and have the end id only. Null ids come first. Rows of equal ids lie side by side, ordered by
    a hash of the text, equal rows in any order. Very long texts are encoded whole, and lie in as many blocks as they need.
    An empty table writes no file. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    folder = folder or f"{scratch.path}/files"
    return read_tokens(scratch.keep(write_tokens(docs, folder, path, end, id_col, text_col), "manifest"), folder, id_col=id_col)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, in the 49,408 ids of word_bpe_49k, with id 1 at the end of each."""
    import public_tokenizers

    return token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op2_token_files": op2_token_files}
ORACLE_SQL: dict[str, str] = {}
