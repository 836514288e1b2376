"""Selection, structure, figures, state, sources and streams."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import arrow_text, cleaners, figures, quality, select, state, structure
from quire.sources import readers
from quire.streaming import watch


def test_page_specifications(spark):
    assert select.parse_pages("3, 1-2,,5-,-1", 6) == [1, 2, 3, 5, 6]
    for bad in ("", "x", "0", "3-2", "-", "1-2-3"):
        with pytest.raises(ValueError):
            select.parse_pages(bad, 6)
    with pytest.raises(select.RangeOutOfBounds):
        select.parse_pages("7", 6)
    assert select.translate_spec("1-2,5-", 10) == "11-12,15-" and select.parse_chapters("1-2", 3) == [1, 2]
    assert select.parse_pages_string("3,1-2,2") == [3, 1, 2, 2] and select.parse_pages_string(None) is None and select.parse_size("1.5K") == 1500
    with pytest.raises(ValueError):
        select.parse_chapters("1-", 3)
    specs = ["3, 1-2", "5-", "-2", "7", "x", "", "2-1"]
    got = spark.createDataFrame([(s,) for s in specs], "s string").select(select.page_list(F.col("s"), F.lit(6)).alias("p")).collect()
    assert [r["p"] for r in got] == [[1, 2, 3], [5, 6], [1, 2], None, None, None, None]


CHAPTERS = [(1, 1, 1, "One", 1), (1, 2, 2, "One a", 3), (1, 3, 3, "deep", 4), (1, 4, 1, "Two", 7), (1, 5, 2, "Two a", 9)]


def test_chapters(spark):
    c = spark.createDataFrame(CHAPTERS, "doc_id long, index int, level int, title string, start_page int")
    totals = spark.createDataFrame([(1, 12)], "doc_id long, total_pages int")
    assert [r["end_page"] for r in select.infer_ranges(c, totals).orderBy("index").collect()] == [7, 7, 7, 13, 13]
    assert [r["parent"] for r in structure.outline_parents(c).orderBy("index").collect()] == [None, 1, 2, None, 4]
    found = lambda spec: select.resolve_chapter(c, spec).first()
    assert found("4")["chapter"]["title"] == "Two" and found("ONE A")["chapter"]["index"] == 2 and found("two")["status"] == "ambiguous" and found("x")["status"] == "not found"
    assert select.first_by_pattern(c, "^two").first()["index"] == 4
    assert '"title":"One"' in structure.outline_json(c).first()["outline"]
    pages = spark.createDataFrame([(1, 1, "\n Chapter 1 x\ny", [18.0] * 3 + [9.0] * 12), (1, 2, "body", [9.0] * 4), (1, 3, "2. Foo", [9.0] * 6)], "doc_id long, page_no int, text string, font_sizes array<double>")
    assert [(r["title"], r["start_page"]) for r in select.detect_chapters(pages).orderBy("index").collect()] == [("Chapter 1 x", 1), ("2. Foo", 3)]
    assert [(r["title"], r["start_page"]) for r in select.detect_chapters_by_font(pages).collect()] == [("C", 1)]
    levels = {(r["page_no"], r["line_no"]): r["level"] for r in cleaners.headings_by_font(pages).collect()}
    assert levels[(1, 1)] == 1 and levels[(2, 0)] == 0


def test_structure(spark):
    text = "---\na: 1\n---\n\n# T\nstart\n## A [x]\nbody\n```\n## no\n```\n### B\n## A [x]\nend"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [(r["level"], r["title"], r["anchor"]) for r in structure.headings(df).orderBy("ord").collect()] == [(2, "A [x]", "a-x"), (3, "B", "b"), (2, "A [x]", "a-x-1")]
    once = structure.inject_toc(df)
    assert once.first()["text"] == structure.inject_toc(once).first()["text"] and "- [A \\[x\\]](#a-x)\n  - [B](#b)" in once.first()["text"]
    parts = structure.sections(df)
    assert [(r["index"], r["title"], r["body"]) for r in parts.orderBy("index").collect()] == [(0, None, "start"), (1, "A [x]", "body\n```\n## no\n```\n### B"), (2, "A [x]", "end")]
    assert structure.sections(df, drop_fences=True).where("index = 1").first()["body"] == "body\n### B"
    assert sorted(r["file"] for r in structure.section_names(parts).collect()) == ["00-intro.md", "01-a-x.md", "02-a-x-2.md"]
    assert structure.index_page(parts).first()["index_text"].endswith("- [Prelude](00-intro.md)")
    fm = {"title": F.lit('a "b"'), "pages": F.lit(3), "none": F.lit(None).cast("string")}
    made = df.withColumn("text", structure.prepend_front_matter(F.col("text"), fm))
    assert made.first()["text"].startswith('---\ntitle: "a \\"b\\""\npages: 3\nnone: null\n---\n\n# T') and made.withColumn("text", structure.prepend_front_matter(F.col("text"), fm)).first()["text"] == made.first()["text"]
    row = df.select(structure.first_h1(F.col("text")).alias("h"), structure.chapter_slug(F.lit(3), F.lit("Chapter 3: Ámbar")).alias("c"), structure.metadata({"b": F.lit(1), "a": F.lit(None).cast("string")}).alias("m"), structure.front_matter(F.col("text")).alias("f")).first()
    assert row["h"] == "T" and row["c"] == "cap-03-ambar" and row["m"] == '{"a":null,"b":1}' and row["f"] == "a: 1"
    study = df.select(structure.study_sections(structure.study_sections(F.col("text"))).alias("t")).first()["t"]
    assert study.endswith("end\n\n## Resumen\n\n## Conceptos clave\n\n## Dudas\n") and study.count("## Dudas") == 1
    assert df.select(structure.study_sections(structure.study_sections(F.col("text")), parity=True).alias("t")).first()["t"].count("## Dudas") == 2
    fields = structure.study_fields({"reading_status": F.lit("read")}, {"started_at": F.lit("x")}, F.lit("now"))
    assert tuple(df.select(*(c.alias(k) for k, c in fields.items())).first()) == ([], "read", "x", "now")
    given = {"tags": F.array(F.lit("b"), F.lit("a"), F.lit("b")), "reading_status": F.lit("in_progress")}
    fields = structure.study_fields(given, {"finished_at": F.lit("y")}, F.lit("now"))
    assert tuple(df.select(*(c.alias(k) for k, c in fields.items())).first()) == (["b", "a"], "in_progress", "now", "y")
    fields = structure.study_fields(given, {"finished_at": F.lit("y")}, F.lit("now"), reset=True)
    assert tuple(df.select(*(c.alias(k) for k, c in fields.items())).first()) == (["b", "a"], "in_progress", None, None)
    assert df.select(structure.study_block(structure.study_fields({}, {}, F.lit("now"))).alias("b")).first()["b"] is None
    with pytest.raises(Exception, match="not a reading status"):
        df.select(structure.study_fields({"reading_status": F.lit("done")}, {}, F.lit("now"))["reading_status"]).collect()
    assert structure.dry_run(df)["columns"][0]["name"] == "doc_id"


def test_figures(spark):
    rows = [(1, 1, 1, 50, 50, "l"), (1, 2, 1, 100, 100, "a"), (1, 3, 2, 100, 100, "logo"), (1, 4, 1, 100, 100, "logo"), (1, 5, 3, 600, 700, "bg")]
    c = spark.createDataFrame([(*r, 0.0, 0.0, 600.0 if r[5] == "bg" else 10.0, 780.0) for r in rows], "doc_id long, seq int, page int, width int, height int, pixel_sha string, x double, y double, w double, h double")
    areas = spark.createDataFrame([(1, p, 612.0, 792.0) for p in (1, 2, 3)], "doc_id long, page int, page_width double, page_height double")
    got = figures.filter_candidates(c, areas, spark.createDataFrame([(1, 2)], "doc_id long, total_pages int"))
    assert {r["seq"]: (r["decision"], r["position"]) for r in got.collect()} == {1: ("too_small", None), 2: ("kept", 1), 3: ("kept", 2), 4: ("logo_repeated", None), 5: ("background", None)}
    pages = spark.createDataFrame([(1, 1, "a\nb\nFigure 1.2 — Box\nc"), (1, 2, "z")], "doc_id long, page_no int, text string")
    lines = pages.select("doc_id", "page_no", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    hit = figures.captions_after(lines.where("page_no = 1 and line_no = 0").select("doc_id", "page_no", "line_no"), lines).first()
    assert (hit["chapter"], hit["figure"], hit["description"]) == (1, 2, "Box")
    figs = spark.createDataFrame([(1, 1, 0.0, "![t](t)", None), (1, 1, 0.5, "![m](m)", "Figure 1.2 — Box"), (1, 9, 1.0, "![e](e)", None)], "doc_id long, page_no int, y_frac double, markup string, caption string")
    out = {r["page_no"]: r["text"] for r in figures.anchor_figures(pages, figs).collect()}
    # One after the other: the figure at half the height is put behind the third of four lines that aren't blank; 0 counts as
    # 1 and comes last, at the top, where it takes the caption that follows.
    assert out[1] == "![t](t)\n\n*Figure 1.2 — Box*\na\nb\n![m](m)\n\nc" and out[2] == "z\n\n![e](e)\n"
    figs = spark.createDataFrame([(1, 1, 0.2, "![m](m)", "Figure 1.2 — Box"), (1, 2, None, "![n](n)", None)], figs.schema)
    out = {r["page_no"]: r["text"] for r in figures.anchor_figures(pages, figs).collect()}
    assert out[1] == "a\n![m](m)\n\n*Figure 1.2 — Box*\nb\nc" and out[2] == "z\n\n![n](n)"
    figs = spark.createDataFrame([(1, 1, 0.2, "![m](m)", None), (1, 1, 1.0, "<!-- o -->", None)], figs.schema)
    assert figures.anchor_figures(pages, figs).where("page_no = 1").first()["text"] == "a\n![m](m)\n\n*Figure 1.2 — Box*\nb\nc\n<!-- o -->\n"
    assert pages.select(figures.append_figures(F.col("text"), F.array(F.lit("![a](a)"))).alias("t")).where("t like 'z%'").first()["t"] == "z\n\n![a](a)\n"
    placed = spark.createDataFrame([(1, 1, 1, 0.9), (1, 1, 2, 0.1), (1, 1, 3, None)], "doc_id long, page int, index int, y_frac double")
    found = spark.createDataFrame([(1, 1, 5, "first"), (1, 1, 9, "second")], "doc_id long, page int, line_no int, raw string")
    assert {r["index"]: r["caption"] for r in figures.captions_by_page(found, placed).collect()} == {2: "first", 1: "second", 3: None}
    assert [r["alt"] for r in figures.describe(spark.createDataFrame([(b"x",), (b"",)], "content binary"), lambda b: f"{1 // len(b)}").collect()] == ["1", None]
    assert spark.range(1).select(figures.figure_name(F.lit(3), F.lit(7))).first()[0] == "fig-03-07.png"


def test_outlines_of_any_depth(spark):
    levels = [1, 5, 12, 11, 12, 3, 2, 2, 14, 1]
    c = spark.createDataFrame([(1, i, n, f"T{i}", 10 * i) for i, n in enumerate(levels, 1)], "doc_id long, index int, level int, title string, start_page int")
    ends = [next((10 * (j + 1) for j in range(i + 1, 10) if levels[j] <= levels[i]), 121) for i in range(10)]
    ranged = select.infer_ranges(c, spark.createDataFrame([(1, 120)], "doc_id long, total_pages int"))
    assert [r["end_page"] for r in ranged.orderBy("index").collect()] == ends
    assert [r["parent"] for r in structure.outline_parents(c).orderBy("index").collect()] == [next((j + 1 for j in range(i - 1, -1, -1) if levels[j] < levels[i]), None) for i in range(10)]
    pages = select.chapter_pages(ranged, spark.createDataFrame([(1, 102)], "doc_id long, total_pages int"), 2).orderBy("index").collect()
    assert pages[1]["pages"] == list(range(22, 62)) and [r["status"] for r in pages][-2:] == ["ok", "out of bounds"] and pages[-1]["pages"] is None
    assert structure.outline_tree(c.where("index < 3")).first()["tree"] == "1. T1 (p. 10)\n        2. T2 (p. 20)"
    assert select.parse_dimensions(" 64x32") == (64, 32) == select.parse_dimensions("64,32")
    with pytest.raises(ValueError):
        select.parse_dimensions("64")


def test_chapters_by_lines_or_by_fonts(spark):
    body, title = [9.0] * 4, [18.0] * 2 + [9.0] * 2
    rows = [(1, 1, "Chapter 1\nx", [9.0] * 11), (1, 2, "Chapter 2\nx", [20.0] * 11), (2, 1, "ABcd", title), (2, 2, "EFgh", title), (2, 3, "body", body), (2, 4, "body", body), (3, 1, "body", body)]
    pages = spark.createDataFrame(rows, "doc_id long, page_no int, text string, font_sizes array<double>")
    assert [tuple(r) for r in select.detect(pages).orderBy("doc_id", "index").collect()] == [(1, 1, "Chapter 1", 1), (1, 2, "Chapter 2", 2), (2, 1, "AB", 1), (2, 2, "EF", 2)]


def test_anchors_are_taken_once(spark):
    df = spark.createDataFrame([(1, "## a\n## a\n## a 1\n### a\n## A!\n")], "doc_id long, text string")
    assert [r["anchor"] for r in structure.headings(df).orderBy("ord").collect()] == ["a", "a-1", "a-1-1", "a-2", "a-3"]


def test_front_matter(spark):
    raw = {"title": "T \"x\": y", "book_slug": "b", "chapter_slug": "c", "pages": [1, 2], "source_file": "f.pdf", "source_sha256": "00", "generated_at": "now", "engine_version": "1", "reader_version": "2", "cleaners_applied": ["lists"], "schema_version": 2}
    df = spark.createDataFrame([(1, "body\n", json.dumps(raw)), (2, "body\n", json.dumps({**raw, "schema_version": 1}))], "doc_id long, text string, meta string")
    made = df.withColumn("text", structure.prepend_front_matter(F.col("text"), structure.front_matter_from_metadata(F.col("meta")))).orderBy("doc_id").collect()
    want = {"title": 'T "x": y', "book": "b", "chapter": "c", "pages": [1, 2], "source_file": "f.pdf", "source_sha256": "00", "converted_at": "now", "engine_version": "1", "reader_version": "2", "cleaners_applied": ["lists"]}
    head = made[0]["text"].split("---\n")[1]
    assert [line.split(": ", 1)[0] for line in head.splitlines()] == list(want) and {k: json.loads(v) for k, v in (line.split(": ", 1) for line in head.splitlines())} == want
    assert "title: null" in made[1]["text"]
    text = "---\ntitle: \"a \\\"b\\\"\"\nbook: 'it''s'\nempty:\nlist:\n- x\n- y\nstudy:\n  tags: [a]\n  n: 3\nplain: some words\n---\n\nbody"
    got = spark.createDataFrame([(text,), ("none",)], "text string").select(structure.parse_front_matter(F.col("text")).alias("m")).collect()
    assert got[0]["m"] == {"title": 'a "b"', "book": "it's", "empty": None, "list": "- x\n- y", "study": "tags: [a]\n  n: 3", "plain": "some words"} and got[1]["m"] is None


def test_trees(spark, tmp_path):
    docs = spark.createDataFrame([(1, "b", "c", "# T\nstart\n## A\nx", "raw", "{}"), (2, "b", "d", "no sections", None, "{}")], "doc_id long, book string, chapter string, text string, raw_text string, metadata string")
    files = structure.tree_files(docs, raw=True, split=True)
    done = structure.write_tree(files, str(tmp_path / "out")).collect()
    got = {str(f.relative_to(tmp_path / "out")): f.read_text() for f in (tmp_path / "out").rglob("*") if f.is_file() and f.suffix != ".crc"}
    assert got == {"b/c/text.md": "# T\nstart\n## A\nx", "b/c/metadata.json": "{}", "b/c/.quire/raw.md": "raw", "b/d/text.md": "no sections", "b/d/metadata.json": "{}", "b/c/sections/00-intro.md": "start\n", "b/c/sections/01-a.md": "## A\n\nx\n", "b/c/sections/index.md": "- [A](01-a.md)\n- [Prelude](00-intro.md)\n", "b/d/sections/00-intro.md": "no sections\n", "b/d/sections/index.md": "- [Prelude](00-intro.md)\n"}
    assert {r["status"] for r in done} == {"ok"} and len(done) == len(got)
    assert {r["status"] for r in structure.write_tree(files, str(tmp_path / "out")).collect()} == {"exists"}
    assert {r["status"] for r in structure.write_tree(files, str(tmp_path / "out"), force=True).collect()} == {"ok"}
    table = structure.rendered_table(spark.createDataFrame([("g", "b", 1), ("g", "a|c", None)], "g string, engine string, words int"), "g", ["engine", "words"]).first()["table"]
    assert table == "| engine | words |\n| --- | --- |\n| a\\|c | - |\n| b | 1 |"
    assert spark.range(1).select(structure.rendered({"words": F.lit(3), "none": F.lit(None)}, 7).alias("r")).first()["r"] == "words  3\nnone   -"


def test_hyphens_by_a_table(spark):
    text = "know-\nledge well-\nknown Well-\nKnown Paris-\nParis pala-\nbra know-\nled-\nge\n```\nknow-\nledge\n```\nco-\nop know-\nledge"
    df = spark.createDataFrame([(1, text), (2, "none here"), (3, None)], "doc_id long, text string")
    words = ["knowledge", "know", "well", "paris"]
    row = {r["doc_id"]: r for r in cleaners.dehyphenated(df, spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    want = arrow_text.dehyphenator(words)(text)
    assert (row[1]["text"], row[1]["hyphen_changes"]) == want and want[1] == 3 and "well-\nknown" in want[0] and "```\nknow-\nledge" in want[0]
    assert (row[2]["text"], row[2]["hyphen_changes"], row[3]["text"]) == ("none here", 0, None)
    counted = spark.createDataFrame([("Ab ab x-\ny aB",), ("ab, x x",)], "text string")
    assert sorted(r["word"] for r in cleaners.corpus_words(counted, 2).collect()) == ["ab", "x"]
    by_table = cleaners.clean(df, cleaners.default_cleaners(), dictionary=spark.createDataFrame([(w,) for w in words], "word string"))
    by_list = cleaners.clean(df, cleaners.default_cleaners(words))
    assert [(r["doc_id"], r["clean_text"], [s["changes"] for s in r["stats"]]) for r in by_table.orderBy("doc_id").collect()] == [(r["doc_id"], r["clean_text"], [s["changes"] for s in r["stats"]]) for r in by_list.orderBy("doc_id").collect()]


def test_a_cleaner_that_fails_on_a_row(spark):
    def odd(t):
        if "bad" in t:
            raise ValueError("no")
        return t.upper(), 1

    df = spark.createDataFrame([(1, "good • x"), (2, "bad"), (3, None)], "doc_id long, text string")
    steps = [cleaners.Cleaner("odd", rewrite=odd), cleaners.native("lists", T.lists, T.list_changes), cleaners.Cleaner("off", rewrite=odd, enabled=False)]
    got = {r["doc_id"]: (r["clean_text"], [(s["name"], s["enabled"], s["changes"], s["error"], s["duration_ms"] is not None) for s in r["stats"]]) for r in cleaners.clean(df, steps, stop_on_error=False).collect()}
    assert got[1] == ("GOOD • X", [("odd", True, 1, None, True), ("lists", True, 0, None, False), ("off", False, 0, None, False)])
    assert got[2] == ("bad", [("odd", True, 0, "ValueError: no", True), ("lists", True, 0, None, False), ("off", False, 0, None, False)])
    assert got[3][0] is None
    with pytest.raises(Exception, match="no"):
        cleaners.clean(df, steps).collect()


def test_code_by_fonts(spark):
    text = "plain\nlet mut x\nfn y()\n\n    one\n    two\nend"
    names = ["Times"] * 6 + ["Courier New"] * 10 + ["Courier New"] * 6 + ["Times"] + ["Times"] * 40
    df = spark.createDataFrame([(1, 1, text, names[: len(text)]), (2, 1, text, None)], "doc_id long, page_no int, text string, font_names array<string>")
    got = {r["doc_id"]: (r["text"], r["code_changes"]) for r in cleaners.code_by_font(df).collect()}
    assert got[1] == ("plain\n```rust\nlet mut x\nfn y()\n```\n\n```\n    one\n    two\n```\nend", 2)
    assert got[2] == ("plain\nlet mut x\nfn y()\n\n```\n    one\n    two\n```\nend", 1)


def test_state(spark):
    assert state.cleaner_snapshot(["b", "a"]) == '{"disabled":[],"enabled":["a","b"],"pipeline":[]}'
    sha = "a" * 64
    mk = lambda *r: spark.createDataFrame(list(r), "sha256 string, registered_at string, last_seen_at string, run_count long, title string")
    got = state.upsert(mk((sha, "1", "1", 2, "old")), mk((sha, "3", "3", 1, "new"), ("short", "1", "1", 1, "x"))).collect()
    assert [tuple(r) for r in got] == [(sha, "1", "3", 3, "new")]
    assert state.merge_config({"a": 1, "b": 2}, {"a": 5}, {"b": -1}, valid={"b": lambda v: v > 0}) == ({"a": 5, "b": 2}, {"a": 1, "b": 0}, ["b: -1 is not valid"])


def test_cache(spark, tmp_path):
    folder, key = str(tmp_path / "cache"), "b" * 64
    entry = lambda k, t: (k, "1", "now", t, None, [("00", "a.png")])
    rows = spark.createDataFrame([entry(key, "text"), entry(key, "text"), entry("c" * 64, None)], state.ENTRY)
    assert state.load_cache(spark, folder).count() == 0
    images = spark.createDataFrame([("00", b"x"), ("00", b"x")], "sha256 string, content binary")
    for _ in range(2):
        state.save_cache(rows, folder, images, env={})
    assert [r["markdown"] for r in state.load_cache(spark, folder, env={}).collect()] == ["text"] and spark.read.parquet(f"{folder}/blobs").count() == 1
    assert state.load_cache(spark, folder, env={state.KILL_SWITCH: "1"}).count() == 0
    state.save_cache(rows, str(tmp_path / "off"), env={state.KILL_SWITCH: "1"})
    assert not (tmp_path / "off").exists()
    todo = spark.createDataFrame([(key,), ("d" * 64,)], "key string")
    assert [r["key"] for r in state.work_list(todo, state.load_cache(spark, folder, env={}), "1").collect()] == ["d" * 64]


def test_registry(spark, tmp_path):
    sha, good = "a" * 64, {"title": "T", "format": "pdf", "pages_total": 3, "toc": [{"level": 1, "title": "One", "page": 1}], "toc_from_outline": True, "source_path": "/x", "registered_at": "1", "last_seen_at": "2", "run_count": 1}
    texts = [json.dumps({sha: good, "b" * 64: {**good, "pages_total": 0}, "c" * 64: {**good, "run_count": True}, "short": good, "d" * 64: {**good, "toc": [{"level": 0, "title": "x", "page": 1}]}}), "not json", None]
    records, dropped = state.registry_from_json(spark.createDataFrame([(t,) for t in texts], "text string"))
    assert [(r["sha256"], r["pages_total"], r["toc"][0]["title"]) for r in records.collect()] == [(sha, 3, "One")]
    assert sorted(r["reason"] for r in dropped.collect()) == ["not a record"] * 4 + ["not an object"]
    for seen in ("2", "3"):
        kept = state.save_registry(spark, str(tmp_path / "registry"), records.withColumn("last_seen_at", F.lit(seen)))
    assert [(r["run_count"], r["registered_at"], r["last_seen_at"]) for r in kept.collect()] == [(2, "1", "3")]


def test_configuration_layers():
    project = 'only = "lists"\nmax_bytes = -1\n[[book]]\nname = "Rust"\npages = "1-3"\n[[book]]\nsha256 = "ab"\npages = "7"\n'
    args = {"defaults": {"only": "", "max_bytes": 9, "pages": "", "seconds": 1}, "global_text": "seconds = 5\nonly = 'x'\n", "project_text": project, "kinds": {"seconds": int, "max_bytes": int}, "valid": {"max_bytes": lambda v: v > 0}}
    values, origin, notes = state.load_config(**args, env={"QUIRE_SECONDS": "7", "QUIRE_MAX_BYTES": "x"}, name="the-rust-book.pdf")
    assert values == {"only": "lists", "max_bytes": 9, "pages": "1-3", "seconds": 7} and origin == {"only": "project", "max_bytes": "default", "pages": "book", "seconds": "env"} and len(notes) == 2
    assert state.load_config(**args, env={}, sha256="ab", name="rust")[0]["pages"] == "7"
    assert state.load_config({"a": 1}, "a = ", env={})[2][0].startswith("not TOML")


def epub() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:c"><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        z.writestr("o/p.opf", '<package xmlns="urn:o"><manifest><item id="n" href="nav.xhtml" properties="nav"/><item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/></manifest><spine><itemref idref="n"/><itemref idref="b"/><itemref idref="a"/></spine></package>')
        z.writestr("o/nav.xhtml", '<html xmlns="urn:h"><a href="a.xhtml#x">First</a></html>')
        z.writestr("o/a.xhtml", "<html><body><h1>A</h1><p>x</p></body></html>")
        z.writestr("o/b.xhtml", "<html><body><p>y</p></body></html>")
    return out.getvalue()


def test_sources(spark, tmp_path):
    html = "<html><head><title>t</title><style>s</style></head><body><nav>n</nav><h2>H &amp; I</h2><p>a\n b</p><ul><li>x<li>y</ul><pre>c\n d</pre><table><tr><td>1</td><td>2</td></tr></table></body></html>"
    assert readers.html_to_markdown(html) == "## H & I\n\na b\n\n- x\n- y\n\n```\nc\n d\n```\n\n| 1 | 2 |\n"
    assert readers.epub_chapters(epub()) == [("b", "y\n"), ("First", "# A\n\nx\n")]
    (tmp_path / "a.html").write_text(html)
    (tmp_path / "b.epub").write_bytes(epub())
    (tmp_path / "c.xyz").write_text("?")
    (tmp_path / "d.docx").write_bytes(b"broken")
    (tmp_path / "e.md").write_text("# x\n")
    (tmp_path / "f.pdf").write_bytes(b"%PDF")
    got = {}
    for r in readers.extract(readers.read_files(spark, str(tmp_path))).collect():
        got.setdefault(r["path"][-6:], []).append((r["page_no"], r["status"].partition(":")[0]))
    assert got == {"a.html": [(1, "ok")], "b.epub": [(1, "ok"), (2, "ok")], "/c.xyz": [(None, "unsupported format; known are docx, epub, html, pdf, pptx, xlsx")], "d.docx": [(None, "conversion failed")], "0/e.md": [(1, "ok")], "/f.pdf": [(None, "conversion failed")]}
    assert readers.extract(readers.from_bytes(spark, epub(), "epub"), pages=[2]).first()["text"].startswith("# A")
    with pytest.raises(ValueError):
        readers.Limits(max_pages=0)


PNG = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (200).to_bytes(4, "big") + (100).to_bytes(4, "big") + b"\x08\x02\0\0\0"
GIF = b"GIF89a" + (80).to_bytes(2, "little") + (90).to_bytes(2, "little") + b"\0\0\0"
JPEG = b"\xff\xd8\xff\xe0\x00\x04\0\0\xff\xc0\x00\x11\x08" + (70).to_bytes(2, "big") + (65).to_bytes(2, "big") + b"\x03" + b"\0" * 12


def office(files: dict) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in files.items():
            z.writestr(name, content)
    return out.getvalue()


REL = '<Relationships xmlns="r"><Relationship Id="r1" Target="../media/a.png"/><Relationship Id="r2" Target="/ppt/media/b.gif"/><Relationship Id="r3" TargetMode="External" Target="http://x/y.png"/></Relationships>'
PIC = '<p:pic><p:blipFill><a:blip r:embed="{}"/></p:blipFill><p:spPr><a:xfrm><a:off x="{}" y="{}"/><a:ext cx="{}" cy="{}"/></a:xfrm></p:spPr></p:pic>'
SLIDE = '<p:sld xmlns:p="p" xmlns:a="a" xmlns:r="r">{}</p:sld>'


def test_figures_of_files(spark, tmp_path):
    assert [readers.image_size(b) for b in (PNG, GIF, JPEG, b"x", b"")] == [(200, 100), (80, 90), (65, 70), None, None]
    slides = {
        "ppt/presentation.xml": '<p:presentation xmlns:p="p"><p:sldSz cx="9144000" cy="6858000"/></p:presentation>',
        "ppt/slides/slide1.xml": SLIDE.format(PIC.format("r1", 0, 12700, 9144000, 6858000) + PIC.format("r2", 127000, 254000, 1270000, 1270000)),
        "ppt/slides/_rels/slide1.xml.rels": REL, "ppt/slides/slide2.xml": SLIDE.format(PIC.format("r2", 0, 0, 12700, 12700) + PIC.format("r3", 0, 0, 1, 1)),
        "ppt/slides/_rels/slide2.xml.rels": REL, "ppt/media/a.png": PNG, "ppt/media/b.gif": GIF,
    }
    document = '<w:document xmlns:w="w" xmlns:a="a" xmlns:r="r"><a:blip r:embed="r1"/><a:blip r:embed="r9"/></w:document>'
    word = {"word/document.xml": document, "word/_rels/document.xml.rels": '<Relationships xmlns="r"><Relationship Id="r1" Target="media/c.jpg"/></Relationships>', "word/media/c.jpg": JPEG}
    book = zipfile.ZipFile(io.BytesIO(epub()))
    book = {n: book.read(n) for n in book.namelist()} | {"o/a.xhtml": "<html><body><img alt='x' src='i/d.png'/><img src='no.png'></body></html>", "o/i/d.png": PNG}
    for name, files in (("a.pptx", slides), ("b.docx", word), ("c.epub", book)):
        (tmp_path / name).write_bytes(office(files))
    files = readers.read_files(spark, str(tmp_path))
    got = sorted((r["path"][-6:], r["seq"], r["page"], r["width"], r["height"], r["x"], r["y"], r["extension"]) for r in readers.image_candidates(files).collect())
    assert got == [("a.pptx", 1, 1, 200, 100, 0.0, 1.0, "png"), ("a.pptx", 2, 1, 80, 90, 10.0, 20.0, "gif"), ("a.pptx", 3, 2, 80, 90, 0.0, 0.0, "gif"), ("b.docx", 1, 1, 65, 70, None, None, "jpg"), ("c.epub", 1, 2, 200, 100, None, None, "png")]
    assert [(r["page_width"], r["page_height"]) for r in readers.page_areas(files).collect()] == [(720.0, 540.0)]
    kept = sorted((r["path"][-6:], r["page"], r["name"]) for r in figures.kept_from_files(files).collect())
    # The first picture covers its slide, the second is on both slides and counts as a logo, of which the first stays.
    assert kept == [("a.pptx", 1, "fig-01-01.gif"), ("b.docx", 1, "fig-01-01.jpg"), ("c.epub", 2, "fig-01-01.png")]
    assert [(r["index"], r["level"], r["title"], r["start_page"]) for r in readers.outlines(files).orderBy("index").collect()] == [(1, 1, "b", 1), (2, 1, "First", 2)]


def test_limits_of_readers(spark, tmp_path):
    (tmp_path / "a.slow").write_text("x")
    (tmp_path / "b.epub").write_bytes(epub())
    files = readers.read_files(spark, str(tmp_path))

    def slow(b):
        import time

        time.sleep(30)

    epubs = files.where("format = 'epub'")
    row = readers.extract(epubs, readers.Limits(seconds=1), more={"epub": slow}).first()
    assert row["status"].startswith("conversion failed: TimeoutError")
    assert {r["warning"] for r in readers.extract(epubs, readers.Limits(warn_pages=1)).collect()} == {"2 pages"}
    assert [r["status"] for r in readers.extract(epubs, pages=[1, 3]).collect()] == ["out of bounds: page 3 of 2"]


def test_watch_waits_for_files_and_tries_again(spark, tmp_path):
    inbox, out, at = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    inbox.mkdir()
    (inbox / "new.md").write_text("half")
    (inbox / "bad.docx").write_bytes(b"broken")
    run = lambda settle: watch.watch(spark, str(inbox), out, at, settle=settle, attempts=2).awaitTermination(60)
    run(3600)
    assert spark.read.parquet(out).count() == 0
    (inbox / "new.md").write_text("whole")
    assert watch.settle_waiting(spark, out, at, attempts=2) == 2  # one has changed, the other has failed once
    assert watch.settle_waiting(spark, out, at, attempts=2) == 0 == watch.settle_waiting(spark, out, at, attempts=2)
    got = sorted((r["path"][-6:], r["text"], r["status"].partition(":")[0]) for r in spark.read.parquet(out).collect())
    assert got == [("d.docx", None, "conversion failed"), ("new.md", "whole", "ok")]


def test_watch_takes_each_file_once(spark, tmp_path):
    inbox, out = tmp_path / "in", tmp_path / "out"
    inbox.mkdir()
    run = lambda: watch.watch(spark, str(inbox), str(out), str(tmp_path / "state"), glob="*.md").awaitTermination(60)
    (inbox / "a.md").write_text("one")
    run()
    (inbox / "b.md").write_text("two")
    (inbox / "c.txt").write_text("no")
    run()
    run()
    assert sorted(r["text"] for r in spark.read.parquet(str(out)).collect()) == ["one", "two"]


def test_quality(spark):
    df = spark.createDataFrame([(1, "raw text here", "## a b\n## c")], "doc_id long, text string, clean_text string")
    s = quality.statistics(df)
    r = s.withColumn("w", quality.warnings(F.lit(3), F.lit("pdf"), F.lit(0), F.lit(0), F.lit(True))).withColumn("d", quality.described(F.col("w"))).first()
    assert (r["words"], r["h2"], r["headings"]) == (3, 2, 2) and r["w"] == ["scanned_pdf", "uniform_headings"] and r["d"][0]["code"] == "scanned_pdf"
    engines = spark.createDataFrame([(1, "a", "ok", 5), (1, "b", "error", 0), (1, "c", "skipped", 0)], "doc_id long, engine string, status string, words int")
    assert quality.compare(engines).first()["exit_code"] == 8
    chars = spark.createDataFrame([(1, "ABCDEF+Foo", 700), (1, "Foo", 700)], "doc_id long, font_name string, font_weight int")
    assert [tuple(x) for x in quality.fonts(chars).collect()] == [(1, "Foo", "Bold")]
    assert T.MARKER


def test_code_by_font_stays_within_rows(spark):
    """Pages of one id and number are judged each by its own fonts, and nothing is shuffled."""
    wide, fixed = "Times", "ABCDEF+Courier"
    texts = [("ab c\n  de\nxyz", [fixed] * 5 + [fixed] * 5 + [wide] * 3), ("ab c\n  de\nxyz", [wide] * 9 + [fixed] * 4), ("é😀\nab", [fixed] * 5), (None, None), ("    a b\n    c", None), ("", []), ("a\nb", [None, None, fixed])]
    rows = [(i, 1, 1, t, n) for i, (t, n) in enumerate(texts)]
    pages = spark.createDataFrame(rows, "k int, doc_id int, page_no int, text string, font_names array<string>").coalesce(1)
    out = cleaners.code_by_font(pages)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["k"]: (r["text"], r["code_changes"]) for r in out.collect()}
    assert len(got) == 7 and got[0] == ("```\nab c\n  de\n```\nxyz", 1) and got[1] == ("ab c\n  de\nxyz", 0) and got[2] == ("```\né😀\nab\n```", 1)
    assert got[3][0] is None and got[5][0] == "" and got[6] == ("a\nb", 0)
