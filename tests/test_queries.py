"""Every query with SQL gives the rows that DuckDB gives."""

import glob
import os

import duckdb
import pytest

from quire.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, tmp_path, name):
    out = QUERIES[name](spark, SF)
    out.write.parquet(str(tmp_path / name))
    mine = f"select * from '{tmp_path / name}/*.parquet'"
    columns = [x[0] for x in db.execute(f"describe {mine}").fetchall()]
    if name not in SQL:
        assert db.execute(f"select count(*) from ({mine})").fetchall()[0][0] > 0
        return
    assert sorted(columns) == sorted(x[0] for x in db.execute(f"describe {SQL[name]}").fetchall())
    s = ", ".join(sorted(columns))
    for a, b in ((mine, SQL[name]), (SQL[name], mine)):
        assert db.execute(f"select {s} from ({a}) except all select {s} from ({b})").fetchall() == []


def test_noise_matters(spark):
    """Doing nothing isn't enough: what is cleaned differs from what was given."""
    from pyspark.sql import functions as F

    from quire.plans import dirt

    for name, noise in (("clean_whitespace", dirt.SPACES), ("clean_kerning", dirt.KERNED), ("clean_page_numbers", dirt.NUMBERED), ("clean_headings", dirt.HEADED), ("clean_paragraph_joins", dirt.WRAPPED)):
        raw = registry.documents(spark, SF, noise)
        assert QUERIES[name](spark, SF).join(raw, "doc_id").where(F.col("text") != F.col("clean_text")).count() > 150


def test_slug_unicode_is_of_whole_texts(spark, tmp_path):
    texts = {1: "- " * 50 + "Straße", 2: None, 3: "日本 " + "!" * 80 + " x", 4: ""}
    spark.createDataFrame([(i, t, "en", "web", 0) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert dict(QUERIES["slug_unicode"](spark, str(tmp_path)).collect()) == {1: "straße", 2: "untitled", 3: "日本-x", 4: "untitled"}


def against_sql(spark, tmp_path, name, table, rows, schema):
    """Rows of a query over one table of these rows, and those of its SQL."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{table}.parquet"))
    c = duckdb.connect()
    c.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    mine = QUERIES[name](spark, str(tmp_path))
    return sorted(map(tuple, mine.collect())), sorted(c.execute(f"select {', '.join(mine.columns)} from ({SQL[name]})").fetchall())


def test_html_pages_with_other_references(spark, tmp_path):
    pages = ['<p>a &quot;b&quot; &copy; &#39; &nbsp;&amp;lt; &lt;i&gt; &amp;quot;</p>', "<h1>x&amp</h1><p>y &am", "<p>plain &amp; simple</p>"]
    got, want = against_sql(spark, tmp_path, "html_pages", "pages", list(enumerate(pages)), "page_id long, html string")
    assert got == want and got[0][1] == "a &quot;b&quot; &copy; &#39; &nbsp;&lt; <i> &quot;\n"
    from quire.sources import readers

    assert readers.html_to_markdown(pages[0]) == "a \"b\" © ' &lt; <i> &quot;\n"


def test_clean_pipeline_text_has_the_cleaners_of_its_sql(spark, tmp_path):
    """A line that is a page number, a table and a list stay; the pipeline of all twelve takes the page number away."""
    texts = ["0997 | a | b\n12\nx  y", "| a | b |\n| 1 | 2 |\n• z", "C H A P T E R   1\n1. a\n\n2. b"]
    rows = [(i, t, "en", "web", 0) for i, t in enumerate(texts)]
    got, want = against_sql(spark, tmp_path, "clean_pipeline_text", "documents", rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert got == want and got[0][1].startswith("0997 | a | b 12")
    whole = {r["doc_id"]: r["clean_text"] for r in QUERIES["clean_pipeline"](spark, str(tmp_path)).collect()}
    assert "0997" not in whole[0] and "| --- |" in whole[1]
