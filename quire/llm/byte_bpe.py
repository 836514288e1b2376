"""Byte-level BPE in two tiers: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest."""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_in_worker, table, without_gc
from .word_bpe import gather, pieces

#: Characters of the Unicode property White_Space, as tiktoken's \s has them. Fixed values.
SPACE = r"\t-\r \x85\xa0  -     　"
M64 = (1 << 64) - 1


def _hash(key: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(key)


class PerfectHash:
    """A minimal perfect hash by hash and displace: n keys in n slots, one displacement for each bucket.

    Buckets of several keys get the first displacement that puts their keys into free slots, buckets of one key the
    remaining slots by number. A key that was not given lands in some slot, whose key differs.
    """

    def __init__(self, keys: Sequence[bytes]):
        n = len(keys)
        self.buckets = max(1, n // 3)
        by: list[list[int]] = [[] for _ in range(self.buckets)]
        hashes = [_hash(k) for k in keys]
        for i, h in enumerate(hashes):
            by[(h >> 32) % self.buckets].append(i)
        self.move, self.slots, self.values = [0] * self.buckets, [b""] * n, [-1] * n
        free = [True] * n
        for b in sorted(range(self.buckets), key=lambda b: -len(by[b])):
            own = by[b]
            if len(own) < 2:
                break
            d = 1
            while True:
                at = [self._slot(hashes[i], d, n) for i in own]
                if len(set(at)) == len(at) and all(free[s] for s in at):
                    break
                d += 1
            self.move[b] = d
            for i, s in zip(own, at, strict=True):
                free[s], self.slots[s], self.values[s] = False, keys[i], i
        rest = iter([s for s in range(n) if free[s]])
        for b, own in enumerate(by):
            if len(own) == 1:
                s = next(rest)
                self.move[b], self.slots[s], self.values[s] = -s - 1, keys[own[0]], own[0]

    @staticmethod
    def _slot(h: int, d: int, n: int) -> int:
        x = (h ^ (d * 0x9E3779B97F4A7C15)) & M64
        return ((x * 0xD6E8FEB86659FD93 & M64) >> 32) % n

    def get(self, key: bytes) -> int:
        """The place of key among the keys given, or -1."""
        h = _hash(key)
        d = self.move[(h >> 32) % self.buckets]
        s = -d - 1 if d < 0 else self._slot(h, d, len(self.slots))
        return self.values[s] if self.slots[s] == key else -1


class Vocabulary:
    """Ranks from a tiktoken file; a token's rank is its id."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = sorted(ranks, key=ranks.__getitem__)
        self.ids = [ranks[t] for t in self.tokens]
        if self.ids != list(range(len(self.ids))):
            raise ValueError("ranks must run from 0 without gaps")
        self.hash = PerfectHash(self.tokens)


class Memo(dict):
    """Segment -> ids as bytes, in two generations: what was used since the last turn survives it."""

    def __init__(self, find, most: int = 400_000):
        super().__init__()
        self.find, self.most, self.old = find, most, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        got = self.old.get(key)
        if got is None:
            got = self.find(key)
        self[key] = got
        return got


class ByteBpe:
    """Encodes as tiktoken does: the pattern's matches one by one, each by ranks.

    segmented says of a pattern that no match crosses the place between another character and white space, and that
    letters, then punctuation, are two matches; such texts are encoded by segments. Other patterns are matched as they are.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str, segmented: bool = False):
        import re

        import regex

        self.segmented = segmented

        self.hash, self.tokens = vocabulary.hash, vocabulary.tokens
        self.dtype = np.dtype("<u2" if len(self.tokens) <= 1 << 16 else "<u4")
        self.wide = 16 if len(self.tokens) <= 1 << 16 else 32
        self.match = regex.compile(pattern.replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]").replace(f"[^[{SPACE}]", f"[^{SPACE}")).findall
        self.single = [self.hash.get(bytes([b])) for b in range(256)]
        self.pairs: dict[int, int] = {}
        self.touching = re.compile(f"[{SPACE}] ").search
        self.segments = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall
        self.parts = Memo(self._token)
        self.code = "H" if self.wide == 16 else "I"
        self.plain, self.spaced = Memo(self._segment), Memo(lambda s: self._segment(" " + s))
        size = np.array([len(t) for t in self.tokens])
        self.size, self.first, self.bytes = size, np.cumsum(size) - size, np.frombuffer(b"".join(self.tokens), np.uint8)

    def merge(self, raw: bytes) -> list[int]:
        """Ids of one pre-token that is no token itself: neighbours of the lowest rank merge, the first of equal ones.

        Bytes are a linked list; the heap holds (rank, place of the left one) and drops what is out of date.
        """
        ids = [self.single[b] for b in raw]
        n = len(ids)
        if n == 1:
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        known, learn, wide = self.pairs.get, self._pair, self.wide
        ranks = []  # of the pair that begins at each place, -1 without one
        for a, b in zip(ids, ids[1:]):
            r = known(a << wide | b)
            ranks.append(learn(a, b) if r is None else r)
        heap = [r << 32 | i for i, r in enumerate(ranks) if r >= 0]
        ranks.append(-1)
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            x = pop(heap)
            r, i = x >> 32, x & 0xFFFFFFFF
            if ranks[i] != r:
                continue
            j = after[i]
            k = after[i] = after[j]
            ids[i], ids[j], ranks[j], ranks[i] = r, -1, -1, -1
            if k < n:
                before[k] = i
                b = ids[k]
                s = known(r << wide | b)
                if s is None:
                    s = learn(r, b)
                if s >= 0:
                    ranks[i] = s
                    push(heap, s << 32 | i)
            h = before[i]
            if h >= 0:
                a = ids[h]
                s = known(a << wide | r)
                if s is None:
                    s = learn(a, r)
                ranks[h] = s
                if s >= 0:
                    push(heap, s << 32 | h)
        return [x for x in ids if x >= 0]

    def _pair(self, a: int, b: int) -> int:
        """The rank of two neighbours as one token, or -1; remembered for a bounded number of pairs."""
        if len(self.pairs) > 500_000:
            self.pairs.clear()
        r = self.pairs[a << self.wide | b] = self.hash.get(self.tokens[a] + self.tokens[b])
        return r

    def _token(self, text: str) -> bytes:
        """Ids of one pre-token."""
        raw = text.encode()
        i = self.hash.get(raw)
        return array(self.code, (i,) if i >= 0 else self.merge(raw)).tobytes()

    def _segment(self, text: str) -> bytes:
        core = text.rstrip(".,;:!?")
        if core.isalpha() or core[:1] == " " and core[1:].isalpha():  # letters, then at most one match of punctuation
            return self.parts[core] + (self.parts[text[len(core) :]] if len(core) < len(text) else b"")
        return b"".join([self.parts[t] if len(t) < 256 else self._token(t) for t in self.match(text)])

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """Ids of whole texts. With segments, no match crosses the place between another character and white space, so segments are
        encoded once and remembered; where no white space stands before a blank, blanks are such places."""
        if not self.segmented:
            return [np.frombuffer(b"".join([self.parts[m] if len(m) < 256 else self._token(m) for m in self.match(t or "")]), self.dtype) for t in texts]
        odd = {i: b"".join([self.plain[s] if len(s) < 256 else self._segment(s) for s in self.segments(t)]) for i, t in enumerate(texts) if t and self.touching(t)}
        lists = pc.split_pattern(pa.array(["" if i in odd else t or "" for i, t in enumerate(texts)], pa.string()), " ")
        words = lists.values.dictionary_encode()
        values = [self.spaced[s] if len(s) < 256 else self._segment(" " + s) for s in words.dictionary.to_pylist()]
        at, cut = words.indices.to_numpy(), lists.offsets.to_numpy()
        size = np.fromiter(map(len, values), np.int64, len(values)) // self.dtype.itemsize
        ids, ends = gather(np.frombuffer(b"".join(values), self.dtype), np.cumsum(size) - size, size, at)
        out = []
        for i in range(len(texts)):
            a, b = int(cut[i]), int(cut[i + 1])
            if i in odd:
                out.append(np.frombuffer(odd[i], self.dtype))
            elif a == b:
                out.append(np.zeros(0, self.dtype))
            else:  # the first segment has no blank before it
                first = np.frombuffer(self._segment(lists.values[a].as_py()), self.dtype)
                out.append(np.concatenate((first, ids[ends[a + 1] : ends[b]])))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        ends = np.cumsum(size)
        at = np.arange(int(ends[-1]) if len(ids) else 0) + np.repeat(self.first[ids] - ends + size, size)
        return self.bytes[at].tobytes()


def digests(docs: DataFrame, path: str, pattern: str, segmented: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's number of ids, the digest of its ids, and that of the bytes that they decode to. segmented: see ByteBpe.

    The vocabulary, a file of fixed size, is hashed once and broadcast. Null texts are empty, without ids. Texts of any
    length are encoded whole. Equal rows give equal rows. An empty table gives an empty result. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = keep_in_worker(("byte_bpe", path, pattern, segmented), lambda: ByteBpe(shared.value, pattern, segmented))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in pieces(texts):
                n, x, y = [], [], []
                with without_gc():
                    encoded = bpe.encode_all(texts[a:b])
                for ids in encoded:
                    n.append(len(ids))
                    x.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    y.append(hashlib.sha256(b"".join(bpe.decode(ids[k : k + 1_000_000]) for k in range(0, len(ids), 1_000_000))).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(x), pa.array(y)], names=["id", "n", "x", "y"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(each, f"id {kind}, n long, x string, y string")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_tokens"), F.col("x").alias("ids_sha256"), F.col("y").alias("decoded_sha256"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by byte_bpe_50k.tiktoken, encoded and decoded."""
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, segmented=True)


QUERIES = {"op5_byte_bpe": op5_byte_bpe}
ORACLE_SQL: dict[str, str] = {}
