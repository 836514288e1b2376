"""Cleaners by literals, and laws of them."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import arrow_text as A
from quire.operators import cleaners as C


def apply(spark, op, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["o"] for r in df.select("i", op(F.col("t")).alias("o")).orderBy("i").collect()]


def code(c):
    return T.let(T.lines(c), lambda rows: T.code_blocks(rows, T.code_kinds(rows)))


LITERALS = [
    (T.whitespace, "a  \r\nb\n\n\n\nc ﬁn „x‟ “y”\n```\nkeep  \n\n\n\n```\nz  \n", 'a\nb\n\nc fin "x" “y”\n```\nkeep  \n\n\n\n```\nz\n'),
    (T.whitespace, "~~~\na  \n```\nb  \n~~~\nc  ", "~~~\na  \n```\nb  \n~~~\nc"),
    (T.whitespace, "a\n```\nopen  \nrest  ", "a\n```\nopen  \nrest  "),
    (T.kerning, "C H A P T E R   1 1\nC h A\nA B  C", "CHAPTER   11\nC h A\nABC"),
    (T.page_numbers, "12\nx\n— 47 —\n3 | foo\nfoo | 4\n 12  Chapter X\n1. foo\n204 is it\n---", "\nx\n\n\n\n\n1. foo\n204 is it\n---"),
    (T.headings, "Intro\nChapter 2: X\n1.1 Foo\ntext\n\nALL CAPS\n# x\n" + "A" * 201, "Intro\n\n# Chapter 2: X\n## 1.1 Foo\ntext\n\n# ALL CAPS\n# x\n" + "A" * 201),
    (T.single_h1, "# a\n# b\n```\n# c\n```\n# d", "# a\n## b\n```\n# c\n```\n## d"),
    (T.single_h1, "# a\n## b", "# a\n## b"),
    (code, "x\n    def f(self):\n        pass\ny\n    one\n\n\tSELECT a\n\tFROM b", "x\n```python\n    def f(self):\n        pass\n```\ny\n    one\n\n```sql\n\tSELECT a\n\tFROM b\n```"),
    (code, "```\n    a\n    b\n```\n    - x\n    - y", "```\n    a\n    b\n```\n    - x\n    - y"),
    (T.lists, "•  a\n1. x\n\n\n2. y\n\nz", "- a\n1. x\n2. y\n\nz"),
    (T.lists, "1) a\n\ntext • b", "1) a\n\ntext • b"),
    (T.footnote_markers, "foo¹² bar [3]\nx [4] y [5]\n[^1] [^1]", "foo[^1][^2] bar [^3]\nx [4] y [^5]\n[^1]"),
    (T.paragraph_joins, "hello  my\nworld is\nok.\nnext\n- item\nfoo\nBar\nbaz", "hello my world is ok.\n\nnext\n- item\nfoo\nBar baz\n"),
    (T.paragraph_joins, "a b\n\nc:\nd\n# h\ne", "a b\n\nc:\nd\n# h\ne"),
    (T.anchor, " Part  A: é_x! ", "part-a-é_x"),
    (lambda c: C.header_expression(c)[0], "\n".join(f"Head\na{k}\nb{k}\nc{k}\nfoot{'<!-- page 9 -->'.replace('9', str(k + 2)) and ''}\n<!-- page {k + 2} -->" for k in range(3)) + "\nHead\nz\nlast", "a0\nb0\nc0\na1\nb1\nc1\na2\nb2\nc2\nz\nlast"),
]


@pytest.mark.parametrize(("op", "before", "after"), LITERALS, ids=range(len(LITERALS)))
def test_literals(spark, op, before, after):
    assert apply(spark, op, before) == [after]


def test_arrow_literals():
    assert A.dehyphenator(["knowledge"], ["know-ledge"])("know-\nledge well-\nKnown") == ("know-\nledge well-\nKnown", 0)
    assert A.dehyphenator(["knowledge", "pala"])("know-\nledge pala-\nbra x-\ny\n```\nknow-\nledge\n```") == ("knowledge palabra x-\ny\n```\nknow-\nledge\n```", 2)
    assert A.tables("x\n| a | b |\n| cc | d |\ny") == ("x\n| a  | b |\n| --- | --- |\n| cc | d |\ny", 1)
    assert A.tables("| a | b |\n| c |") == (A.UNSTRUCTURED + "\n| a | b |\n| c |\n", 1)
    assert A.tables("| a | b |\n") == ("| a | b |\n", 0)
    assert A.footnote_definitions("body\n1. one\n\n2) two\n1. again\n") == ("body\n\n[^1]: one\n[^2]: two\n", 2)
    assert A.nfc("é ```") [0] == "é ```"
    assert [A.slug(x) for x in ("Ñandú & Co.", "", None, "日本 x", "a" * 59 + " b")] == ["nandu-co", "untitled", "untitled", "日本-x", "a" * 59]


def test_pipeline(spark):
    df = spark.createDataFrame([(1, "know-\nledge  \n12\nfoo² \n1. note\n2. other\n"), (2, None), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in C.clean(df, C.default_cleaners(["knowledge"])).collect()}
    assert got[1]["clean_text"] == "knowledge\n\nfoo[^2]\n\n[^1]: note [^2]: other\n\n" and [s["name"] for s in got[1]["stats"]] == [c.name for c in C.default_cleaners()]
    assert got[2]["clean_text"] is None and all(s["changes"] == 0 for s in got[2]["stats"]) and got[3]["clean_text"] == ""


def test_choice_and_users_cleaners(spark):
    names = lambda cs: [c.name for c in cs]
    assert names(C.choose(C.default_cleaners(), only=["lists", "kerning"])) == ["kerning", "lists"]
    assert "tables" not in names(C.choose(C.default_cleaners(), skip=["tables"]))
    for bad in ({"only": ["a"]}, {"only": ["lists"], "skip": ["lists"]}):
        with pytest.raises(ValueError):
            C.choose(C.default_cleaners(), **bad)
    with pytest.raises(ValueError):
        C.Cleaner("")
    df = spark.createDataFrame([(1, "ab\ncd")], "doc_id long, text string")
    own = [C.make_cleaner("upper", str.upper), C.make_cleaner("lower", F.lower, column=True), C.Cleaner("off", lambda c: (F.lit("x"), F.lit(9)), enabled=False)]
    got = C.clean(df, own).first()
    assert got["clean_text"] == "ab\ncd" and [(s["name"], s["enabled"], s["changes"]) for s in got["stats"]] == [("upper", True, 4), ("lower", True, 4), ("off", False, 0)]
    broken = C.clean_rows(df, [("bad", lambda t: 1 / 0), ("good", lambda t: (t + "!", 1))]).first()
    assert broken["clean_text"] == "ab\ncd!" and broken["stats"][0]["error"].startswith("ZeroDivisionError") and broken["stats"][1]["error"] is None


TEXTS = st.lists(st.text(alphabet="aB1 .:-#|•²\n\t`~\r", max_size=30), min_size=1, max_size=25)


@pytest.mark.parametrize("op", [T.whitespace, T.kerning, T.page_numbers, T.bullets, T.single_h1, T.numbered_lists])
@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=TEXTS)
def test_twice_is_once(spark, op, texts):
    once = apply(spark, op, *texts)
    assert apply(spark, op, *once) == once


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=TEXTS)
def test_segments_make_the_text(spark, texts):
    assert apply(spark, lambda c: F.array_join(F.transform(T.segments(c), lambda s: s["text"]), ""), *texts) == texts


def test_native_cleaners_need_no_python(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    native = [c for c in C.default_cleaners() if not c.rewrite and c.name != "code_blocks"]
    plan = C.clean(df, native)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
