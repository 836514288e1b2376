"""Each operator against brute force, and on hard tables."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import byte_bpe, lm_scoring, ngram_join, packing, quality, sharding, substring_dedup, token_files, url_filter, voronoi_knn, word_bpe
from quire.llm.common import Scratch, components, runs, word_hashes

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def words(text):
    return (text or "").encode().lower().split()


# Shared parts


def test_word_hashes_tell_words_apart():
    texts = ["The the THE", None, "", "é É é", "a" * 100 + " b " + "A" * 100, " x\x0by\x0cz\r\n", "w " * 70000]
    seen = {}
    for t in texts:
        for w, h in zip(words(t), word_hashes(t).tolist(), strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_runs_span_batches():
    cut = [pa.RecordBatch.from_pydict({"k": ks, "v": list(range(len(ks)))}) for ks in ([1, 1], [1, 2], [2], [], [3, 4, 4])]
    assert [(t["k"][0].as_py(), t.num_rows) for t in runs(iter(cut), ["k"])] == [(1, 3), (2, 2), (3, 1), (4, 2)]


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (7, 7), (8, 9)], "u long, v long")
    assert dict(rows(components(spark, edges, Scratch(spark)), "id", "component")) == {2: 2, 3: 2, 4: 2, 5: 2, 8: 8, 9: 8}


# 1


def brute_components(docs, k, num, den):
    sets = {}
    for d, t in docs:
        w = words(t)
        sets[d] = {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            o = len(sets[a] & sets[b])
            if o and den * o >= num * (len(sets[a]) + len(sets[b]) - o):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def families(seed):
    rng, docs = random.Random(seed), []
    for _ in range(30):
        base = [f"w{rng.randrange(9999)}" for _ in range(rng.choice([1, 3, 5, 8, 20, 60, 200, 400]))]
        for _ in range(rng.choice([1, 2, 5, 25])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 50))):
                w[rng.randrange(len(w))] = f"x{rng.randrange(99999)}"
            w += [f"y{rng.randrange(9999)}" for _ in range(rng.randint(0, len(w) // 10 + 1))] if rng.random() < 0.3 else []
            docs.append((len(docs), " ".join(w)))
    return docs + [(len(docs), None), (len(docs) + 1, "  "), (len(docs) + 2, docs[0][1])]


@pytest.mark.parametrize(("k", "num", "den", "chunk", "frequent"), [(4, 85, 100, 1024, 200_000), (4, 85, 100, 4, 200_000), (5, 80, 100, 3, 0), (5, 80, 100, 1024, 200_000)])
def test_jaccard_components(spark, k, num, den, chunk, frequent):
    docs = families(3)
    got = ngram_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), words=k, num=num, den=den, chunk=chunk, few_chunks=2, most_frequent=frequent)
    assert {d: (n, c) for d, n, c in rows(got, "doc_id", "n_shingles", "component_id")} == brute_components(docs, k, num, den)


def test_rows_of_one_id_are_one_document(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    docs = [(3, a + " x"), (5, b + " y"), (7, a), (7, b), (9, None), (9, b), (9, b), (None, a), (11, "other words are here now")]
    got = rows(ngram_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")), "doc_id", "component_id")
    assert sorted(got, key=str) == sorted([(3, 3), (5, 3), (7, 3), (7, 3), (9, 9), (9, 3), (9, 3), (None, None), (11, 11)], key=str)


def test_components_with_hubs(spark):
    edges = [(10**6 + i, 5) for i in range(2000)] + [(i, i - 1) for i in range(10_100, 10_000, -1)] + [(10**6 + 7, 10_050), (3, 4)] + [(2 * 10**6 + i, 2 * 10**6 + i // 2) for i in range(1, 1500)]
    got = dict(rows(components(spark, spark.createDataFrame(edges, "u long, v long"), Scratch(spark), hub=50), "id", "component"))
    assert {got[k] for k in (5, 10_000, 10_100, 10**6 + 1999)} == {5} and got[4] == 3 and {v for k, v in got.items() if k >= 2 * 10**6} == {2 * 10**6}


def test_divide_skip_finds_all():
    rng = np.random.default_rng(0)
    base = np.unique(rng.integers(0, 2**63, 120).astype(np.uint64))
    sets = [np.unique(np.concatenate((rng.permutation(base)[: 120 - c], rng.integers(0, 2**63, c).astype(np.uint64)))) for c in range(0, 30)]
    links = {(a, b) for a, b, _ in ngram_join.search(list(range(30)), [2] * 30, list(range(30)), sets, 85, 100)}
    want = brute = {i: i for i in range(30)}
    for a in range(30):
        for b in range(a + 1, 30):
            o = len(np.intersect1d(sets[a], sets[b]))
            if 100 * o >= 85 * (len(sets[a]) + len(sets[b]) - o):
                x, y = brute[a], brute[b]
                brute = {k: min(x, y) if v in (x, y) else v for k, v in brute.items()}
    got = {i: i for i in range(30)}
    for a, b in links:
        x, y = got[a], got[b]
        got = {k: min(x, y) if v in (x, y) else v for k, v in got.items()}
    assert got == brute and want


# 2


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 32])
def test_bit_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1000).astype(np.uint32)
    assert (token_files.unpack(token_files.pack(ids, bits), bits, 1000) == ids).all()


def test_token_file_random_access(tmp_path):
    docs = [np.arange(n, dtype=np.uint32) % 1000 for n in (0, 5, 300, 1, 70)]
    w = token_files.Writer(open(tmp_path / "x", "wb"), 10, block=64)
    for i, d in enumerate(docs):
        w.add(None if i == 3 else i, d)
    w.close()
    size = (tmp_path / "x").stat().st_size
    with open(tmp_path / "x", "rb") as f:
        r = token_files.Reader(f, size)
        assert r.n == 376 and r.nulls.tolist() == [0, 0, 0, 1, 0] and size < 376 * 10 / 8 + 300
        for i, d in enumerate(docs):
            assert (r.read(int(r.starts[i]), int(r.starts[i + 1])) == d).all()


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return [np.array([*e.ids, 1], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_word_bpe_is_the_librarys():
    rng = random.Random(2)
    texts = [None, "", "It's 12 don't--stop ÀÉ ﬁ", "<|endoftext|>a <|startoftext|>"] + ["".join(rng.choice(" \n\t\u3000\x1c ab'sÉ1²!?…😀日.,") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    got = word_bpe.WordBpe(P.path("word_bpe_49k.json"), most=50).encode(texts, 1)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(got, library_ids(texts), strict=True))


def test_word_bpe_asks_the_model_alone_for_plain_words(monkeypatch):
    rng, asked = random.Random(3), []
    bpe = word_bpe.WordBpe(P.path("word_bpe_49k.json"))
    texts = [" ".join("".join(rng.choice("abstréñß") for _ in range(rng.randint(1, 9))) + rng.choice(["", "", ".", "$$$", ",***", "'", ".%%%"]) for _ in range(50)) + " don't x's" for _ in range(60)]
    monkeypatch.setattr(bpe, "_raw", lambda t, raw=bpe._raw: asked.extend(t) or raw(t))
    got = bpe.encode(texts, 1)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(got, library_ids(texts), strict=True))
    assert sorted(x for x in asked if re.search(r"\w", x)) == ["don't", "x's"]
    signs = """ \n ab'sté1²ÄÜ÷×\u0301\u0338\u0130\u03a3\x85\xa0\x1c\x7f!"#$%&()*+,-./:;<=>?@[]^_`{|}~"""
    odd = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(bpe.encode(odd, 1), library_ids(odd), strict=True))


def test_punctuation_at_the_end_is_a_chunk_of_its_own():
    chunks, cut = word_bpe.split([b"Word$$$ word", b"", " é,*** é÷ a-b don't ".encode()])
    assert chunks.to_pylist() == [b"word", b"$$$", b"word", "é".encode(), b",***", "é÷".encode(), b"a-b", b"don't"] and cut.tolist() == [0, 3, 3, 8]


def test_token_files(spark, documents):
    docs = sorted(rows(documents, "doc_id", "text"))
    ids, at, want = library_ids([t for _, t in docs]), 0, {}
    for (d, _), x in zip(docs, ids, strict=True):
        want[d] = (at, len(x), zlib.crc32(x.tobytes()))
        at += len(x)
    got = token_files.op2_token_files(spark, SF)
    assert {r[0]: r[1:] for r in rows(got, "doc_id", "start", "n_tokens", "ids_crc32")} == want


# 3


def test_voronoi_knn_is_exact(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 8)).round(2)
    v[50:90] = v[50]
    data = [(i, x.tolist()) for i, x in enumerate(v)] + [(400, None), (401, [1.0, None] * 4), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (404, []), (405, [1.0, 2.0]), (406, [3.0, 1.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = {}
    for q, r, i, s in rows(voronoi_knn.top_k(df, (F.col("vec_id") % 10 == 0) | (F.col("vec_id") == 405), block=64, queries_a_block=8, queries_a_pivot=4), "query_id", "rank", "vec_id", "score"):
        got.setdefault(q, []).append((r, i, s))
    w = np.floor(256 * v).astype(np.int64)
    want = {q: [(r, i, -s) for r, (s, i) in enumerate(sorted((-int(w[q] @ w[i]), i) for i in range(400) if i != q)[:5], 1)] for q in range(0, 400, 10)}
    want[405] = [(1, 406, 256 * 256 * 5)]
    assert {q: sorted(x) for q, x in got.items()} == want


def test_voronoi_knn_without_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert voronoi_knn.top_k(empty, F.lit(True)).collect() == []
    assert voronoi_knn.top_k(spark.createDataFrame([(1, [1.0])], empty.schema), F.lit(False)).collect() == []


# 4


def test_lm_scores(spark, documents):
    got = {r[0]: r[1:] for r in rows(lm_scoring.op4_lm_scoring(spark, SF), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")}
    texts = {d: [*words(t), None] for d, t in rows(documents, "doc_id", "text")}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in texts}
    c = Counter(w for d, t in texts.items() if not held[d] for w in t)
    n, v = sum(c.values()), len(c)
    better = []
    for d, t in texts.items():
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        assert got[d][:4] == (held[d], len(t), sum(c[w] > 0 for w in t), n) and got[d][4] == pytest.approx(base, rel=1e-9)
        better.append(got[d][5] > base)
    assert len(got) == len(texts) and sum(better) > 0.9 * len(better)


def test_lm_scores_are_those_of_exact_counts(spark, documents):
    docs = documents.where("doc_id % 4 = 0").union(documents.where("doc_id % 8 = 0"))
    got = rows(lm_scoring.score(docs, F.col("doc_id") % 12 == 0, bits_an_item=256), "doc_id", "score")
    data = [(d, [*words(t), None]) for d, t in rows(docs, "doc_id", "text")]
    uni, bi = Counter(), Counter()
    for d, t in data:
        if d % 12:
            uni.update(t)
            bi.update(zip([None, *t], t))
    n, v = sum(uni.values()), len(uni)
    low, high = lambda c: 2 ** (c.bit_length() - 1) if c else 0, lambda c: 2 ** c.bit_length() - 1
    norm, off = n + 0.1 * (v + 1), []
    want = {}
    for d, t in data:
        s, t = 0.0, [None, *t]
        for i in range(1, len(t)):
            a, b = t[i - 1], t[i]
            p = (min(low(bi[a, b]), high(uni[a])) + 20 * (low(uni[b]) + 0.1) / norm) / (high(uni[a]) + 20)
            s += math.log10(p)
        want[d] = s
    off = [abs(s - want[d]) / abs(want[d]) for d, s in got]
    assert len(off) == len(data) and sorted(off)[int(0.9 * len(off))] < 1e-9 and max(off) < 0.02


def test_lm_scores_depend_on_texts_alone(spark, documents):
    one = sorted(rows(lm_scoring.score(documents, F.col("doc_id") % 10 == 0), "doc_id", "score"))
    spark.conf.set("spark.sql.shuffle.partitions", 23)
    try:
        other = sorted(rows(lm_scoring.score(documents.repartition(9, "lang"), F.col("doc_id") % 10 == 0), "doc_id", "score"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert [d for d, _ in one] == [d for d, _ in other] and all(a == pytest.approx(b, rel=1e-12) for (_, a), (_, b) in zip(one, other, strict=True))


def test_filter_never_forgets():
    items = np.unique(np.random.default_rng(4).integers(0, 2**64, 5000, np.uint64))
    counts = np.random.default_rng(5).integers(1, 1000, len(items))
    data, bits = lm_scoring.segment(items & lm_scoring.FP, counts, 1 << 30)
    f = lm_scoring.Filter(data, np.array([0]), np.array([bits], np.uint64), 63)
    f.shift = 40  # one shard
    got = f.counts(items & lm_scoring.FP)
    assert (got >= lm_scoring.digits(counts)).all() and (got == lm_scoring.digits(counts)).mean() > 0.9
    assert (f.counts(np.random.default_rng(6).integers(0, 2**40, 5000, np.uint64)) > 0).mean() < 0.05


def test_filter_grows_with_its_items():
    items = np.unique(np.random.default_rng(8).integers(0, 2**40, 5000, np.uint64))
    data, bits = lm_scoring.segment(items, np.ones(len(items), np.int64), 1000)
    f = lm_scoring.Filter(data, np.array([0]), np.array([bits], np.uint64), 40)
    assert (f.counts(items) >= 1).all()


def test_lm_scores_by_segments_are_those_of_a_broadcast(spark, documents, nasty):
    for docs in (documents, nasty):
        one, other = (sorted(rows(lm_scoring.score(docs, F.col("doc_id") % 3 == 0, most_bits=n), "doc_id", "held_out", "n_tokens", "n_known", "score"), key=str) for n in (1 << 40, 0))
        assert one == other and len(one) == docs.count()


# 5


def test_perfect_hash():
    keys = [str(i).encode() for i in range(5000)]
    h = byte_bpe.PerfectHash(keys)
    assert [h.get(k) for k in keys] == list(range(5000)) and sorted(h.values) == list(range(5000)) and h.get(b"x") == -1


def test_byte_bpe_is_tiktokens(spark, documents):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    t = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    b, rng = byte_bpe.ByteBpe(byte_bpe.Vocabulary(P.path("byte_bpe_50k.tiktoken")), P.PATTERN, segmented=True), random.Random(1)
    texts = ["".join(rng.choice(" \n\t\u3000\x1c ab'sé1²!?…😀日") for _ in range(rng.randint(0, 14))) for _ in range(5000)] + ["x" * 3000, " " * 50]
    assert [x.tolist() for x in b.encode_all(texts)] == [t.encode_ordinary(x) for x in texts]
    got = {r[0]: r[1:] for r in rows(byte_bpe.op5_byte_bpe(spark, SF), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")}
    for d, text in rows(documents, "doc_id", "text"):
        ids = np.array(t.encode_ordinary(text or ""), "<u4")
        assert got[d] == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def test_byte_bpe_of_any_pattern():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    for pattern in (r"\w+\s\w+|\s+|.", r"[^!]+|!", P.PATTERN):
        t = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        texts = ["two words, and! more  words here", "a b!c d.", "", "x! y", "the thing. The end, or not"]
        assert [x.tolist() for x in byte_bpe.ByteBpe(byte_bpe.Vocabulary(P.path("byte_bpe_50k.tiktoken")), pattern).encode_all(texts)] == [t.encode_ordinary(x) for x in texts]


# 6


def brute_statistics(t):
    w = WORD.findall(t or "")
    c = Counter(zip(w, w[1:], w[2:]))
    covered, seen, dup = set(), set(), 0
    for i in range(len(w) - 2):
        if c[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_quality(spark, documents, nasty):
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    got = {r[0]: r[1:] for r in rows(quality.op6_quality_rules(spark, SF), *names)}
    for d, t in rows(documents, "doc_id", "text"):
        want = brute_statistics(t)
        assert got[d][:6] == want and not (want[5] and got[d][6])
    none = spark.createDataFrame([], "doc_id long, quality int")
    hard = quality.filter_quality(nasty, none)
    assert set(hard.columns) >= {*nasty.columns, *names[1:]} and hard.select("_t", "_w", "rule").distinct().collect() == [("z", "z", "z")]
    assert sorted(rows(hard, *names[1:7])) == sorted(brute_statistics(t) for (t,) in rows(nasty, "text"))


def test_decision_list_learns():
    rng = random.Random(0)
    data = []
    for _ in range(900):
        x = {f: rng.random() for f in quality.FEATURE_SQL}
        data.append((x, x["symbols"] > 0.7 or x["capitals"] > 0.8 and x["shouts"] > 0.5))
    rules = quality.learn(data[:600])
    wrong = sum(any(all(c.holds(x) for c in r) for r in rules) != y for x, y in data[600:])
    assert rules and wrong < 30


# 7


def test_urls(spark):
    urls = ["http://A.Example.com/en/x?q", "https://www.example.com/en/", "https://b.net/es/1#t", "http://b.net/es", "http://c.org/x/y.html", "com/en/", None, "http://", "x://net/fr/", "http://evilexample.com/en/1"]
    got = rows(url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")).orderBy("page_id"), "host", "path", "rule", "verdict")
    assert [g[:3] for g in got] == [("a.example.com", "/en/x", "example.com/en/"), ("www.example.com", "/en/", "www.example.com/en/"), ("b.net", "/es/1", "net/es/"), ("b.net", "/es", None), ("c.org", "/x/y.html", None), ("", "", None), ("", "", None), ("", "", None), ("net", "/fr/", "net/fr/"), ("evilexample.com", "/en/1", "com/")]
    assert [g[3] for g in got if g[2]] == ["block", "allow", "block", "block", "allow"] and {g[3] for g in got} <= {"allow", "block"}


def brute_url(u):
    host = path = ""
    if u is not None and "://" in u:
        m = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1], re.S)
        host, path = re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    return host, path, best and best.name, best and best.verdict


def test_op7_is_brute_force(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r[0]: r[1:] for r in rows(url_filter.op7_url_filter(spark, SF), "page_id", "host", "path", "rule", "verdict")}
    judged, model = url_filter.judged(pages)
    trees = {r["page_id"]: model.of({f: r[f"f_{f}"] for f in url_filter.FEATURE_SQL}) for r in judged.select("_row.page_id", *(f"f_{f}" for f in url_filter.FEATURE_SQL)).collect()}
    column = dict(rows(judged.select(F.col("_row.page_id").alias("page_id"), model.column().alias("odds")), "page_id", "odds"))
    assert len(got) == pages.count() == len(trees)
    for i, u in rows(pages, "page_id", "url"):
        host, path, rule, verdict = brute_url(u)
        assert trees[i] == pytest.approx(column[i], abs=1e-9)
        assert got[i] == (host, path, rule, verdict or ("block" if trees[i] > math.log(4) else "allow"))


def brute_features(u, shares):
    host, path, _, _ = brute_url(u)
    u = u or ""
    share = Counter(u)
    m = re.search(r"\.([A-Za-z0-9]{1,8})\Z", path)
    query = u.split("#")[0].rpartition("?")[2] if "?" in u else None
    return {
        "length": len(u), "host_length": len(host), "host_labels": host.count("."), "hyphens": host.count("-"), "depth": path.count("/"),
        "digits": sum(c in "0123456789" for c in u) / len(u) if u else 0,
        "parameters": 0 if query is None else 1 + len(re.findall("[&;]", query)),
        "entropy": -sum(n / len(u) * math.log2(n / len(u)) for n in share.values()),
        "suffix_share": shares[m[1].lower() if m else ""],
    }


def test_features_of_urls(spark):
    urls = ["http://a-b.c.org/x/y.html?a=1&b=2#f?x", "https://c.net/1.PHP", None, "", "x://y", "no", "http://c.net/z.php", *(f"http://h{k}.org/f.s{k}" for k in range(40))]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    shares = Counter((m[1].lower() if (m := re.search(r"\.([A-Za-z0-9]{1,8})\Z", brute_url(u)[1])) else "") for u in urls)
    shares = {k: n / len(urls) for k, n in shares.items()}
    parts = url_filter.parts(df)
    for one_in in (1024, 10):  # all suffixes frequent, or most of them rare
        made = url_filter.featured(parts, url_filter.suffix_shares(parts, one_in))
        got = {r["page_id"]: r for r in made.collect()}
        assert len(got) == len(urls)
        for i, u in enumerate(urls):
            for name, want in brute_features(u, shares).items():
                assert got[i][f"f_{name}"] == pytest.approx(want, abs=1e-9), (u, name)


def test_urls_keep_columns_of_any_name(spark):
    names = ["f_length", "_suffix", "_share", "__q_u", "_row", "URL2", "rule", "_n"]
    df = spark.createDataFrame([(1, "http://x.net/es/a", *["z"] * len(names)), (1, None, *["z"] * len(names))], "page_id int, url string, " + ", ".join(f"`{n}` string" for n in names))
    out = url_filter.filter_urls(df)
    assert sorted(out.columns) == sorted([*df.columns, "host", "path", "verdict"]) and {r["f_length"] for r in out.collect()} == {"z"} and {r["rule"] for r in out.collect()} == {"net/es/", None}


def test_trees_on_held_out_urls():
    rng = random.Random(1)
    data = [({f: rng.random() for f in url_filter.FEATURE_SQL}, None) for _ in range(900)]
    data = [(x, (x["digits"] > 0.5) != (x["length"] > 0.6)) for x, _ in data]
    model = url_filter.boost(data[:600])
    assert sum((model.of(x) > 0) != y for x, y in data[600:]) < 30


# 8


def test_packing(spark, documents):
    docs = dict(rows(documents, "doc_id", "text"))
    ids = dict(zip(docs, library_ids(docs.values()), strict=True))
    pieces, places = {}, {}
    for d, start, n, crc, total, seq, at in rows(packing.op8_packing(spark, SF), "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"):
        assert crc == zlib.crc32(ids[d][start : start + n].tobytes()) and total == len(ids[d]) and n > 0
        pieces.setdefault(d, []).append((start, n))
        places.setdefault(seq, []).append((at, n))
    for whole, parts in [(len(ids[d]), p) for d, p in pieces.items()] + [(None, p) for p in places.values()]:
        end = 0
        for start, n in sorted(parts):
            assert start == end
            end += n
        assert end == whole if whole is not None else end <= 2048 and end & (end - 1) == 0
    assert pieces.keys() == docs.keys()


def test_neighbours_come_first():
    same = [np.array([1, 2, 3, 4] * 10), np.array([7, 8, 9] * 10), np.array([1, 2, 3, 5] * 10)]
    assert [d for d, _, _ in packing.fill(same, 80)[0]] == [0, 2]


def test_neighbours_share_any_term_of_whole_documents():
    rare = [np.array([k, k]) for k in range(100, 120)]  # pairs with the seed's more frequent terms
    seed = np.concatenate([*(np.array([k] * 5) for k in range(100, 120)), [7]])
    docs = [seed, np.array([8, 8]), np.array([7, 9]), *rare]
    index = packing.Bm25([packing.terms(d) for d in docs])
    assert set(index.neighbours(0, np.arange(len(docs)) > 0).tolist()) == {2, *range(3, len(docs))}
    rests = [np.array([1]), np.array([2]), np.array([3])]
    whole = [packing.terms(np.array(d)) for d in ([5, 5, 1], [6, 2], [5, 3])]
    assert [d for s in packing.fill(rests, 2, whole) for d, _, _ in s] == [0, 2, 1]


def test_terms_of_many_documents_are_those_of_each():
    rng = np.random.default_rng(5)
    for kind, top in (("<u2", 1 << 16), ("<u4", 1 << 32), ("<i8", 1 << 32)):
        docs = [rng.choice(rng.integers(0, top, 50), n).astype(kind) for n in [0, 0, 7, 1, 300, 0, 5000, 12, 0]]
        for most in (1, 310, 1 << 20):
            for d, (t, c) in zip(docs, packing.terms_of(docs, most), strict=True):
                want = np.unique(d, return_counts=True)
                assert t.tolist() == want[0].tolist() and c.tolist() == want[1].tolist() and t.dtype == d.dtype
    assert packing.terms_of([]) == []


def test_packing_does_not_depend_on_files(spark, documents):
    path = P.path("word_bpe_49k.json")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "offset"]
    one, other = (sorted(rows(packing.pack(d, path), *names)) for d in (documents, documents.repartition(9, "lang")))
    assert one == other


def test_shards_are_lexical():
    rng = np.random.default_rng(3)
    keys = packing.Keys(1000, np.ones(1000))
    docs = [rng.choice(1000, 60, replace=False) for _ in range(300)]
    near = [np.r_[d[:54], rng.choice(1000, 6)] for d in docs]
    same = np.mean([keys.of(*packing.terms(a))[0] == keys.of(*packing.terms(b))[0] for a, b in zip(docs, near, strict=True)])
    apart = np.mean([keys.of(*packing.terms(a))[0] == keys.of(*packing.terms(b))[0] for a, b in zip(docs, near[1:], strict=False)])
    assert same > 0.6 and apart < 0.15


# 9


def brute_shard(key, weights):
    import xxhash

    bids = []
    for s, w in enumerate(weights):
        h = xxhash.xxh64_intdigest(str(key).encode(), 42)
        u = xxhash.xxh64_intdigest(s.to_bytes(4, "little"), h) >> 11
        bids.append((u if len(set(weights)) == 1 else -w / math.log(min((u + 0.5) / 2.0**53, 1 - 2.0**-53)), -s))
    return -max(bids)[1]


@pytest.mark.parametrize("weights", [[1.0] * 24, [1.0, 2.5, 4.0, 0.5]])
def test_shards_are_the_highest_bidders(spark, weights):
    got = rows(sharding.shard(spark.range(500).selectExpr("id doc_id", "'x' text"), weights, None), "doc_id", "shard")
    assert len(got) == 500 and all(s == brute_shard(d, weights) for d, s in got)


def test_op9_is_brute_force(spark, documents):
    got = {r[0]: r[1:] for r in rows(sharding.op9_sharding(spark, SF), "doc_id", "size", "text_crc32", "shard", "grown_shard")}
    want = {d: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), brute_shard(d, [1.0] * 24), brute_shard(d, [1.0] * 25)) for d, t in rows(documents, "doc_id", "text")}
    assert got == want


@pytest.mark.parametrize(("weights", "grown"), [([1.0] * 24, 1.0), ([1.0, 2.0, 3.0], 1.5), ([2.0, 2.0], 5.0)])
def test_sharding(spark, documents, weights, grown):
    got = sharding.shard(documents, weights, grown)
    for d, size, crc, law, s, _, g in rows(got.join(documents.select("doc_id", "text"), "doc_id").select("*"), "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"):
        assert law == "key" and 0 <= s < len(weights) and g in (s, len(weights)) and size >= 8 and crc >= 0 and d is not None
    slots = {}
    for s, k in rows(got, "shard", "slot"):
        slots.setdefault(s, []).append(k)
    assert all(sorted(k) == list(range(len(k))) for k in slots.values())
    text = dict(rows(documents, "doc_id", "text"))
    assert all((z, c) == (len((text[d] or "").encode()) + 8, zlib.crc32((text[d] or "").encode())) for d, z, c in rows(got, "doc_id", "size", "text_crc32"))


def test_shares_follow_weights(spark):
    got = Counter(s for (s,) in rows(sharding.shard(spark.range(20000).selectExpr("id doc_id", "'x' text"), [1.0, 3.0]), "shard"))
    assert 0.72 < got[1] / 20000 < 0.78


# 10


def test_repeats(spark):
    rng = random.Random(7)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, other = text(60), text(45)
    edited = list(passage)
    edited[30] = "changed"
    docs = [text(100) + passage + text(80), text(50) + passage + text(20), text(30) + edited + text(200), text(70) + other, other + text(60), text(300), passage, text(40)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)] + [(50, None), (51, "")], "doc_id long, text string")
    got = {d: (a, b, s, f) for d, a, b, s, f in rows(substring_dedup.repeats(df), "doc_id", "first", "last", "source_id", "source_first")}
    assert got == {1: (50, 109, 0, 100), 2: (30, 89, 0, 100), 6: (0, 59, 0, 100)}
    cut = dict(rows(substring_dedup.without_repeats(df), "doc_id", "text"))
    assert cut[1].split() == docs[1][:50] + docs[1][110:] and cut[6] == "" and cut[0] == " ".join(docs[0]) and cut[50] is None


def test_repeats_cover_exact_windows(spark, documents):
    cover, first, missed, total = {}, {}, 0, 0
    for d, a, b in rows(substring_dedup.op10_substring_dedup(spark, SF), "doc_id", "first", "last"):
        cover.setdefault(d, set()).update(range(a, b + 1))
    for d, t in sorted(rows(documents, "doc_id", "text")):
        w = words(t)
        for i in range(len(w) - 49):
            if first.setdefault(tuple(w[i : i + 50]), d) != d:
                total += 1
                missed += not cover.get(d, set()) >= set(range(i, i + 50))
    assert total > 100 and missed <= 0.02 * total


def test_repeats_of_any_holder(spark):
    """The passage's parts first occur in documents of their own, and documents between have pieces of it only."""
    rng = random.Random(11)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = text(60)
    parts = [text(9) + passage[a : a + 44] + text(31) for a in range(0, 17, 2)]
    docs = [*parts, text(20) + passage + text(9), *parts, text(7) + passage + text(30)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    got = {d: (a, b, s, f) for d, a, b, s, f in rows(substring_dedup.repeats(df), "doc_id", "first", "last", "source_id", "source_first")}
    assert got[2 * len(parts) + 1] == (7, 66, len(parts), 20)


def test_repeats_cover_all_exact_windows(spark, documents):
    one = [(10**6 + i, "x " * n) for i, n in enumerate((49, 50, 51, 300))]
    docs = documents.select("doc_id", "text").union(spark.createDataFrame(one, "doc_id long, text string"))
    cover, first, missed, total = {}, {}, 0, 0
    for d, a, b in rows(substring_dedup.repeats(docs), "doc_id", "first", "last"):
        cover.setdefault(d, set()).update(range(a, b + 1))
    for d, t in sorted(rows(docs, "doc_id", "text")):
        w = words(t)
        for i in range(len(w) - 49):
            if first.setdefault(tuple(w[i : i + 50]), d) != d:
                total += 1
                missed += not cover.get(d, set()) >= set(range(i, i + 50))
    assert total > 100 and missed == 0


def test_rows_of_one_id_lose_their_own_repeats_only(spark):
    rng = random.Random(5)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    p, q, r = text(60), text(100), text(30)
    docs = [(1, p + text(40)), (2, q), (2, r + p), (2, r + p), (3, p + q), (3, None), (None, p)]
    df = spark.createDataFrame([(i, " ".join(t) if t else None) for i, t in docs], "doc_id long, text string")
    got = sorted((d, (t or "").split()) for d, t in rows(substring_dedup.without_repeats(df), "doc_id", "text") if d is not None)
    assert got == sorted([(1, docs[0][1]), (2, q), (2, r), (2, r), (3, []), (3, [])])
    assert len({(d, part) for d, part in rows(substring_dedup.repeats(df), "doc_id", "part")}) == 2


def test_edited_repeats_are_found(spark, documents):
    """Recall of passages of 60 words with some changed, planted behind texts of their own; brute force knows where they are."""
    rng = random.Random(17)
    own = [f"u{k}" for k in range(5000)]
    data, planted = [], {}
    for k in range(60):
        base = [rng.choice(own) + str(rng.randrange(10**5)) for _ in range(60)]
        data.append((2 * k, " ".join(f"a{rng.randrange(10**7)}" for _ in range(40)) + " " + " ".join(base)))
        edited = list(base)
        for i in rng.sample(range(10, 50), k % 2):
            edited[i] = "changed"
        head = rng.randrange(5, 50)
        planted[2 * k + 1] = (head, head + 59)
        data.append((2 * k + 1, " ".join(f"b{rng.randrange(10**7)}" for _ in range(head)) + " " + " ".join(edited) + " tail here"))
    got = {}
    for d, a, b in rows(substring_dedup.repeats(spark.createDataFrame(data, "doc_id long, text string")), "doc_id", "first", "last"):
        got.setdefault(d, set()).update(range(a, b + 1))
    share = [len(got.get(d, set()) & set(range(a, b + 1))) / 60 for d, (a, b) in planted.items()]
    assert sum(share) / len(share) >= 0.9 and not set(got) - set(planted)


def test_frequent_seeds_are_salted(spark):
    rng = random.Random(3)
    line = [f"c{k}" for k in range(70)]
    docs = [(i, " ".join([f"w{rng.randrange(10**6)}" for _ in range(20)] + line + [f"w{rng.randrange(10**6)}" for _ in range(9)])) for i in range(150)]
    got = rows(substring_dedup.repeats(spark.createDataFrame(docs, "doc_id long, text string")), "doc_id", "first", "last")
    assert sorted(got) == [(i, 20, 89) for i in range(1, 150)]


def test_fenwick_chains_follow_both_places():
    chain = substring_dedup.chains([(0, 100, 8), (10, 50, 8), (20, 120, 8), (30, 130, 8), (500, 600, 8)])
    assert [(0, 100, 8), (20, 120, 8), (30, 130, 8)] in chain and [(500, 600, 8)] in chain and [(10, 50, 8)] in chain


# Hard tables


def test_hard_tables(spark, nasty):
    n = nasty.count()
    path = P.path("word_bpe_49k.json")
    assert ngram_join.jaccard_components(nasty).count() == n
    assert dict(rows(ngram_join.jaccard_components(nasty).where("doc_id in (5, 6, 3)"), "doc_id", "component_id")) == {5: 5, 6: 5, 3: 3}
    assert token_files.token_digests(nasty, path).agg(F.count("*"), F.min("start")).first() == (n, 0)
    assert lm_scoring.score(nasty, F.col("doc_id") == 1).where("score < 0 and base_score <= 0").count() == n
    assert byte_bpe.digests(nasty, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == n
    assert packing.pack(nasty, path).agg(F.count_if(F.col("start") == 0)).first()[0] == n
    assert sharding.shard(nasty, [1.0, 1.0]).count() == n
    assert rows(substring_dedup.repeats(nasty), "doc_id", "first", "last") == [(6, 0, 59_999)]
    cut = substring_dedup.without_repeats(nasty)
    assert cut.columns == nasty.columns and cut.count() == n


def test_empty_tables(spark, nasty):
    empty = nasty.where("false")
    path = P.path("word_bpe_49k.json")
    for out in (ngram_join.jaccard_components(empty), token_files.token_digests(empty, path), lm_scoring.score(empty, F.lit(False)), byte_bpe.digests(empty, P.path("byte_bpe_50k.tiktoken"), P.PATTERN), packing.pack(empty, path), sharding.shard(empty, [1.0]), substring_dedup.repeats(empty), substring_dedup.without_repeats(empty), quality.filter_quality(empty.drop("kept", "count"), spark.createDataFrame([], "doc_id long, quality int")), url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string"))):
        assert out.collect() == []


def test_packing_weighs_terms_by_all_documents(spark, monkeypatch):
    """The frequencies that keys are drawn by are those of every document, of however many tasks."""
    import public_tokenizers as P

    path, got = P.path("word_bpe_49k.json"), []
    texts = [f"{'apple ' * (i % 3)}{'pear' if i % 2500 == 7 else 'and'} the {'river ' * 2100 if i == 11 else i % 50}" for i in range(5000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    exact = packing.idf_of
    monkeypatch.setattr(packing, "idf_of", lambda *a: got.append(exact(*a)) or got[-1])
    assert packing.pack(docs, path).agg(F.sum("length")).first()[0] == packing.pack(docs, path).where("start = 0").agg(F.sum("doc_tokens")).first()[0]
    bpe = packing.WordBpe.load(path)
    df = np.zeros(len(got[0]))
    for x in bpe.encode(texts, 1):
        df[np.unique(x)] += 1
    assert df[1] == 5000 and (got[0] == got[1]).all()
    np.testing.assert_allclose(got[0], np.log1p((5001 - df + 0.5) / (df + 0.5)))


def test_lm_scores_by_a_mapped_filter_are_those_of_a_broadcast(spark, documents, nasty, monkeypatch):
    """A filter that is too large for a broadcast is read where it lies; no n-gram is shuffled, unless the folder is remote."""
    def never(*_):
        raise AssertionError("n-grams were dealt to segments")

    def by(most, docs):
        return sorted(rows(lm_scoring.score(docs, F.col("doc_id") % 3 == 0, most_bits=most), "doc_id", "held_out", "n_tokens", "n_known", "score"), key=str)

    for docs in (documents, nasty):
        one, dealt = by(1 << 40, docs), lm_scoring.with_answers
        monkeypatch.setattr(lm_scoring, "with_answers", never)
        assert by(0, docs) == one
        monkeypatch.setattr(lm_scoring, "with_answers", dealt)
    with monkeypatch.context() as m:
        m.setattr(lm_scoring, "folder", lambda _: None)
        assert by(0, documents) == by(1 << 40, documents)
