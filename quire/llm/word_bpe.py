"""Encoding with a tokenizers file whose pre-tokens never span white space, remembered by chunk."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Sequence
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa

from .common import keep_in_worker, without_gc

#: 0 white space, 1 punctuation that may end a word, 2 letters and digits, 3 others.
KIND = np.full(256, 3, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = 0
KIND[np.frombuffer(rb"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~""", np.uint8)] = 1
KIND[np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyz", np.uint8)] = 2
#: Special tokens are found in raw text, also within chunks; texts with this go to the library whole.
MARK = "<|"
#: Letters of ASCII and Latin-1 that a normalizer with the steps below leaves as they are, and punctuation after them: one or two pre-tokens.
BARE = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([!-/:-@\[-`{-~]*)")
STEPS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
)
#: What byte-level vocabularies have for bytes above the blank that Latin-1 doesn't print.
_OTHER = [b for b in range(256) if b < 33 or 127 <= b <= 160 or b == 173]
BYTES = {b: 256 + i for i, b in enumerate(_OTHER) if b > 32}


class Known:
    """Ids of chunks: one array of ids, and where those of each chunk are. At most about `most` chunks are kept: beyond
    that those used longest ago go, half of them."""

    def __init__(self, most: int, dtype: np.dtype):
        self.most, self.turn = most, 0
        self.at: dict[bytes, int] = {}
        self.pool, self.start, self.size, self.used = np.zeros(0, dtype), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, names: list[bytes], ids: np.ndarray, size: np.ndarray) -> None:
        n = len(self.size)
        self.at.update(zip(names, range(n, n + len(names)), strict=True))
        self.start = np.concatenate((self.start, np.cumsum(size) - size + len(self.pool)))
        self.size, self.pool = np.concatenate((self.size, size)), np.concatenate((self.pool, ids))
        self.used = np.concatenate((self.used, np.full(len(names), self.turn)))

    def places(self, names: list[bytes]) -> np.ndarray:
        """Places of chunks, -1 where they aren't known."""
        return np.fromiter(map(self.at.get, names, repeat(-1)), np.int64, len(names))

    def shrink(self) -> None:
        if len(self.size) <= self.most:
            return
        stay = np.sort(np.argsort(-self.used, kind="stable")[: self.most // 2])
        new = np.full(len(self.size), -1)
        new[stay] = np.arange(len(stay))
        self.pool, ends = gather(self.pool, self.start, self.size, stay)
        self.start, self.size, self.used = ends[:-1], self.size[stay], self.used[stay]
        self.at = {name: k for name, i in self.at.items() if (k := int(new[i])) >= 0}


class WordBpe:
    """Ids of texts, as the library gives them for whole texts.

    The normalizer lowers case and replaces white space by blanks, which the pre-tokenizer drops, so a text's ids are those
    of its chunks between ASCII white space, one after the other; of a word with punctuation at its end, those of both.
    Chunks of letters, or of letters and then punctuation, are one or two pre-tokens, each ending with its only token
    that ends a word: many are encoded as one text, which is cut at these tokens; where their number isn't as expected,
    and for other chunks, one by one. In files with the normalizer and pre-tokenizer of STEPS the pre-tokens of chunks
    that fit BARE are known, so the model alone encodes them. Tests compare with the
    library. Ids are kept as 2 bytes where the vocabulary allows, else as 4.
    """

    TAIL = b".,;:!?"

    def __init__(self, path: str, most: int = 900_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        steps = (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)
        self.bare = None
        if None not in steps and tuple(json.loads(x.__getstate__()) for x in steps) == STEPS:
            self.bare = Tokenizer(self.tokenizer.model)
            self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.bits = max(1, (self.vocabulary - 1).bit_length())
        self.dtype = np.dtype("<u2" if self.bits <= 16 else "<u4")
        self.known = Known(most, self.dtype)
        self.ends = np.zeros(self.vocabulary, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")

    @classmethod
    def load(cls, path: str) -> WordBpe:
        """One for each Python worker."""
        return keep_in_worker(path, lambda: cls(path))

    def _raw(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[bytes]) -> None:
        """Keep the ids of chunks that aren't known."""
        ascii, latin, plain, odd = *(([], [], []) for _ in range(3)), []  # chunks, their words as a text, the number of these
        for c in chunks:
            if self.bare and (m := BARE.fullmatch(c)):
                to, word, tail = ascii if c.isascii() else latin, *m.groups()
                text = word + b" " + tail if tail else c
            else:
                to, word, text = plain, c.rstrip(self.TAIL), c
                if not (word.isalpha() or (word and not word.isascii() and word.decode().isalpha())):
                    odd.append(c)
                    continue
            to[0].append(c)
            to[1].append(text)
            to[2].append(1 + (len(word) < len(c)))
        names, ids, sizes = [], [self.known.pool[:0]], [np.zeros(0, np.int64)]
        for model, (some, texts, words) in ((self.bare, ascii), (self.bare, latin), (self.tokenizer, plain)):
            for a in range(0, len(some), 1000):
                z = a + 1000
                text = b" ".join(texts[a:z])
                text = text.decode("latin-1").translate(BYTES) if some is latin[0] else text.decode()
                got = np.array(model.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
                cut, last = np.flatnonzero(self.ends[got]) + 1, np.cumsum(words[a:z]) - 1
                if len(cut) != last[-1] + 1 or cut[-1] != len(got):
                    odd += some[a:z]
                    continue
                names += some[a:z]
                ids.append(got)
                sizes.append(np.diff(cut[last], prepend=0))
        found = self._raw([c.decode() for c in odd]) if odd else []
        names += odd
        ids += found
        sizes.append(np.array([len(x) for x in found], np.int64))
        self.known.add(names, np.concatenate(ids), np.concatenate(sizes))

    def encode(self, texts: Sequence[str | None], end: int | None = None) -> list[np.ndarray]:
        """Ids of each text, null being empty, with the id `end` appended."""
        with without_gc():
            return self._encode(texts, end)

    def _encode(self, texts: Sequence[str | None], end: int | None) -> list[np.ndarray]:
        last, known = np.array([] if end is None else [end], self.dtype), self.known
        odd = {i: self._raw([t])[0] for i, t in enumerate(texts) if t and MARK in t}
        chunks, cut = split([b"" if t is None or i in odd else t.encode() for i, t in enumerate(texts)])
        chunks = chunks.dictionary_encode()
        names = slices(chunks.dictionary)
        known.turn += 1
        at = known.places(names)
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = [names[i] for i in new.tolist()]
            self._learn(fresh)
            at[new] = known.places(fresh)
        known.used[at] = known.turn
        ids, ends = gather(known.pool, known.start, known.size, at[chunks.indices.to_numpy()])
        cut = ends[cut].tolist()
        known.shrink()
        return [np.concatenate((odd[i] if i in odd else ids[cut[i] : cut[i + 1]], last)) for i in range(len(texts))]


def split(texts: Sequence[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Chunks of all texts one after the other, without white space, punctuation at the end of words being chunks too, with
    A-Z in lower case, and which of them begins each text, and their number.

    Punctuation is cut off where a letter or digit of ASCII, or a letter of Latin-1, is before it and white space after it.
    """
    raw = np.frombuffer(b" ".join([*texts, b""]).lower(), np.uint8)
    kind = KIND[raw]
    dark = kind != 0
    edge = dark.copy()
    edge[1:] &= ~dark[:-1]
    tail = np.r_[False, kind == 1, False]
    first, after = np.flatnonzero(tail[1:-1] & ~tail[:-2]), np.flatnonzero(tail[1:-1] & ~tail[2:]) + 1
    fits = (first > 0) & (after < len(raw))
    first, after = first[fits], after[fits]
    first = first[~dark[after]]
    last, lead = raw[first - 1], raw[np.maximum(first - 2, 0)]
    edge[first[(kind[first - 1] == 2) | ((first > 1) & (lead == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7))]] = True
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    start, before = np.flatnonzero(edge), np.zeros(len(raw) + 1, np.int32)
    np.cumsum(dark, out=before[1:])
    at = before[np.r_[start, len(raw)]]
    chunks = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(raw[dark])])
    return chunks, np.searchsorted(start, begin)


def slices(names: pa.BinaryArray) -> list[bytes]:
    """The bytes of each value."""
    if not len(names):
        return []
    _, offsets, data = names.buffers()
    at = np.frombuffer(offsets, np.int32, len(names) + 1, names.offset * 4).tolist()
    raw = data.to_pybytes() if data else b""
    return [raw[a:b] for a, b in pairwise(at)]


def gather(pool: np.ndarray, start: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of pool that begin at start and have some size, one after the other for each of `at`, and where each begins, and all end."""
    n = size[at]
    ends = np.zeros(len(at) + 1, np.int64)
    np.cumsum(n, out=ends[1:])
    kind = np.int32 if max(ends[-1], len(pool)) < 1 << 31 else np.int64  # half the memory to move
    place = np.repeat((start[at] - ends[:-1]).astype(kind), n)
    place += np.arange(ends[-1], dtype=kind)
    return pool[place], ends


def pieces(texts: Sequence[str | None], most: int = 3 << 20):
    """Ranges of texts of about so many characters, to bound what is in memory at once."""
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)
