"""The stages on documents: each against brute force, and on hard tables."""

import unicodedata
import zlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from quire.llm import quality, substring_dedup

from .test_operators import WORD, brute_components, brute_statistics, library_ids, rows, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(name, what went in, what came out) of each stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    folder = tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(folder / name))
        made = spark.read.parquet(str(folder / name))
        out.append((name, docs, made))
        docs = made
    return out


def test_all_but_the_last_keep_the_columns(stages):
    assert [n for n, _, _ in stages] == ["quality", "near_duplicates", "repeated_passages", "packing"]
    assert all(made.columns == docs.columns for _, docs, made in stages[:3])


def brute_features(t):
    n, chars, symbols, dup, repeats, _ = brute_statistics(t)
    t = t or ""
    lines = sum(bool(WORD.search(x)) for x in t.split("\n"))
    capitals, shouts = sum(unicodedata.category(c) == "Lu" for c in t), t.count("!")
    part = lambda a, b: a / b if b else 0.0
    return {"n_words": n, "word_length": part(chars, n), "symbols": part(symbols, n), "dup_lines": part(dup, lines), "repeats": part(repeats, n), "capitals": part(capitals, chars), "shouts": part(shouts, n), "words_per_line": part(n, lines)}


def test_quality_keeps_what_the_rules_keep(spark, stages):
    _, docs, made = stages[0]
    rules = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = sorted(d for d, t in rows(docs, "doc_id", "text") if not brute_statistics(t)[5] and not any(all(c.holds(brute_features(t)) for c in r) for r in rules))
    assert rules and 0 < len(want) < docs.count() and sorted(d for (d,) in rows(made, "doc_id")) == want
    assert sorted(rows(made, *made.columns)) == sorted(r for r in rows(docs, *docs.columns) if r[0] in set(want))


def test_near_duplicates_keep_the_first_of_each_component(stages):
    _, docs, made = stages[1]
    components = brute_components(rows(docs, "doc_id", "text"), 5, 80, 100)
    assert sorted(rows(made, "doc_id", "text")) == sorted((d, t) for d, t in rows(docs, "doc_id", "text") if components[d][1] == d)
    assert made.count() < docs.count()


def test_repeated_passages_are_cut(stages):
    _, docs, made = stages[2]
    spans = {}
    for d, a, b in rows(substring_dedup.repeats(docs), "doc_id", "first", "last"):
        spans.setdefault(d, []).append((a, b))
    before, after, first = dict(rows(docs, "doc_id", "text")), dict(rows(made, "doc_id", "text")), {}
    assert before.keys() == after.keys() and spans
    for d in sorted(before):
        w, gone = WORD.findall(before[d]), {i for a, b in spans.get(d, ()) for i in range(a, b + 1)}
        assert WORD.findall(after[d]) == [x for i, x in enumerate(w) if i not in gone]
        assert gone or after[d] == before[d]
        low = words(before[d])
        for i in range(len(low) - 49):
            if first.setdefault(tuple(low[i : i + 50]), d) != d:
                assert gone >= set(range(i, i + 50))
    assert all(len(t) == n for t, n in rows(made, "text", "n_chars"))


def test_packing_holds_all_ids_once(stages):
    _, docs, made = stages[3]
    texts = dict(rows(docs, "doc_id", "text"))
    ids, starts = dict(zip(texts, library_ids(texts.values()), strict=True)), {}
    for d, start, n, crc, total in rows(made, "doc_id", "start", "length", "ids_crc32", "doc_tokens"):
        assert crc == zlib.crc32(ids[d][start : start + n].tobytes()) and total == len(ids[d])
        starts.setdefault(d, []).append((start, n))
    for d, x in ids.items():
        end = 0
        for start, n in sorted(starts[d]):
            assert start == end
            end += n
        assert end == len(x)


@pytest.mark.parametrize("k", range(4))
def test_stages_on_hard_tables(spark, nasty, k):
    name, stage = corpus_pipeline.STAGES[k]
    long = nasty.where("doc_id = 5").withColumns({"doc_id": F.lit(77).cast("long"), "n_words": F.lit("mine"), "row": F.lit("r")})
    docs = nasty.withColumns({"n_words": F.lit("mine"), "row": F.lit("r")}).union(long)
    got = [r.asDict() for r in stage(spark, docs, SF).collect()]
    if name == "packing":
        assert sum(r["start"] == 0 for r in got) == docs.count()
        return
    before = [r.asDict() for r in docs.collect()]
    assert got and all(list(r) == docs.columns and r["n_words"] == "mine" and r["kept"] == "z" for r in got)
    ids = sorted((r["doc_id"] for r in got), key=str)
    if name == "quality":
        assert ids == sorted((r["doc_id"] for r in before if not brute_statistics(r["text"])[5]), key=str)
    elif name == "near_duplicates":
        assert ids == sorted((r["doc_id"] for r in before if r["doc_id"] not in (6, 77)), key=str)
    else:
        assert ids == sorted((r["doc_id"] for r in before), key=str)
        assert {r["doc_id"]: r["text"] for r in got if r["doc_id"] in (6, 77)} == {6: "", 77: ""}
    assert stage(spark, docs.where("false"), SF).collect() == []


def test_run_is_the_stages(spark, stages):
    assert corpus_pipeline.run(spark, SF).agg(F.sum("length")).first() == stages[3][2].agg(F.sum("length")).first()
