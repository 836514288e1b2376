"""Structure: headings, tables of contents, sections, slugs, front matter, outlines and study fields."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..functions.fixed import CHAPTER_PREFIX, FRONT_FIELDS, READING_STATUSES, STUDY_SECTIONS

TOC_OPEN, TOC_CLOSE = "<!-- toc -->", "<!-- /toc -->"
FRONT = r"(?s)\A(\s*)---\n.*?\n---[ \t]*\n+"


def strip_front_matter(text: Column) -> Column:
    return F.regexp_replace(text, FRONT, "$1")


def front_matter(text: Column) -> Column:
    """The YAML between the marks, null without any."""
    body = F.regexp_extract(text, r"(?s)\A\s*---\n(.*?)\n---[ \t]*\n", 1)
    return F.when(text.rlike(FRONT), body)


def render_front_matter(fields: dict[str, Column]) -> Column:
    """Fields as YAML, in their order; strings are written as JSON strings, which YAML reads."""
    line = lambda k, c: F.concat(F.lit(f"{k}: "), F.coalesce(F.regexp_extract(F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}), r'(?s)\A\{"v":(.*)\}\z', 1), F.lit("null")), F.lit("\n"))
    return F.concat(F.lit("---\n"), *(line(k, c) for k, c in fields.items()), F.lit("---\n\n"))


def prepend_front_matter(text: Column, fields: dict[str, Column]) -> Column:
    """Existing front matter goes first, so that doing it again changes nothing."""
    return F.concat(render_front_matter(fields), F.regexp_replace(strip_front_matter(text), r"\A\n+", ""))


def first_h1(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?m)^# ([^\n]+?)\s*$", 1), F.lit(""))


def build_front_matter(title: Column, book: Column, chapter: Column, pages: Column, source_file: Column, source_sha256: Column, converted_at: Column, engine_version: Column, reader_version: Column, cleaners_applied: Column, study: Column | None = None) -> dict[str, Column]:
    """The ten fields of front matter in their order, and study where that has something to say."""
    given = (title, book, chapter, pages, source_file, source_sha256, converted_at, engine_version, reader_version, cleaners_applied)
    return dict(zip(FRONT_FIELDS, given, strict=True)) | ({"study": study} if study is not None else {})


def front_matter_from_metadata(text: Column) -> dict[str, Column]:
    """The ten fields again from metadata written as JSON; null where it isn't of schema version 2, or a field is missing."""
    keys = {"book": "book_slug", "chapter": "chapter_slug", "converted_at": "generated_at"}
    there = F.get_json_object(text, "$.schema_version") == "2"
    kinds = {"pages": "array<int>", "cleaners_applied": "array<string>"}

    def field(name: str) -> Column:
        raw = F.get_json_object(text, f"$.{keys.get(name, name)}")
        return F.when(there, F.from_json(raw, kinds[name]) if name in kinds else raw)

    return {name: field(name) for name in FRONT_FIELDS}


def parse_front_matter(text: Column) -> Column:
    """Front matter as map<string, string>, null without any: the values of its top level as they are written, those of
    strings without quotation marks, lists and what is indented below a key as the lines they take."""
    body = F.concat(F.lit("\n"), front_matter(text))
    entries = F.regexp_extract_all(body, F.lit(r"(\n[^\s:#][^\n:]*:(?:[ \t][^\n]*)?(?:\n(?:[ \t]|-)[^\n]*)*)"), F.lit(1))

    def entry(e: Column) -> Column:
        key = F.regexp_extract(e, r"\A\n([^\n:]+):", 1)
        value = F.regexp_replace(F.regexp_extract(e, r"(?s)\A\n[^\n:]+:(.*)\z", 1), r"\A\s+|\s+\z", "")
        quoted = value.rlike(r'(?s)\A(?:".*"|\'.*\')\z')
        inner = F.substring(value, F.lit(2), F.char_length(value) - 2)
        plain = F.when(value.startswith("\""), F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")).otherwise(F.replace(inner, F.lit("''"), F.lit("'")))
        return F.struct(key.alias("key"), F.when(quoted, plain).when(value.isin("null", "~", ""), F.lit(None).cast("string")).otherwise(value).alias("value"))

    return F.when(front_matter(text).isNotNull(), F.map_from_entries(F.transform(entries, entry)))


def anchors(titles: Column) -> Column:
    """An anchor for each title: its base, or with -1, -2 and so on the first that no title before has taken."""

    def next_anchor(used: Column, base: Column) -> Column:
        tries = F.transform(F.sequence(F.lit(0), F.size(used)), lambda k: F.when(k == 0, base).otherwise(F.concat(base, F.lit("-"), k.cast("string"))))
        return F.get(F.filter(tries, lambda t: ~F.array_contains(used, t)), F.lit(0))

    return F.aggregate(F.transform(titles, T.anchor), F.array().cast("array<string>"), lambda used, base: T.let(next_anchor(used, base), lambda a: F.concat(used, F.array(a))))


def headings(docs: DataFrame, least: int = 2, most: int = 3, doc: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, ord, level, title, anchor) of headings outside of code; titles with equal anchors get -1, -2 in their order.
    All of it is within the row of a document, nothing is shuffled."""
    outside = F.array_join(F.transform(T.segments(strip_front_matter(F.col(text_col))), lambda s: F.when(s["inside"], F.lit("\n")).otherwise(s["text"])), "")

    def made(lines: Column) -> Column:
        titles = F.transform(lines, lambda x: F.regexp_extract(x, r"\A#+ (.*?)\s*\z", 1))
        levels = F.transform(lines, lambda x: F.char_length(F.regexp_extract(x, r"\A(#+) ", 1)))
        return F.arrays_zip(levels.alias("level"), titles.alias("title"), anchors(titles).alias("anchor"))

    rows = F.transform(F.array(F.filter(F.split(outside, "\n"), lambda x: x.rlike(rf"\A#{{{least},{most}}} \S"))), made)
    found = docs.select(doc, F.posexplode(F.get(rows, F.lit(0))).alias("ord", "h"))
    return found.select(doc, "ord", "h.level", "h.title", "h.anchor")


def toc(headings: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, toc): a list of links between marks."""
    escaped = F.regexp_replace("title", r"([\[\]])", r"\\$1")
    line = F.concat(F.repeat(F.lit("  "), F.col("level") - 2), F.lit("- ["), escaped, F.lit("](#"), F.col("anchor"), F.lit(")"))
    lines = headings.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("l"))
    return lines.select(doc, F.concat(F.lit(f"{TOC_OPEN}\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit(f"\n{TOC_CLOSE}\n")).alias("toc"))


def strip_toc(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?s){TOC_OPEN}.*?{TOC_CLOSE}\n*", "")


def inject_toc(docs: DataFrame, depth: int = 3, doc: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with a table of contents after the first H1, else at the top; an older one goes first."""
    bare = docs.withColumn(text_col, strip_toc(F.col(text_col)))
    made = toc(headings(bare, 2, depth, doc, text_col), doc)
    text, block = F.col(text_col), F.concat("toc", F.lit("\n"))
    h1 = F.regexp_extract(text, r"(?m)^# [^\n]+\s*?\n+", 0)
    at = F.instr(text, h1) + F.char_length(h1)
    put = F.when(F.col("toc").isNull(), text).when(h1 == "", F.concat(block, text)).otherwise(F.concat(F.substring(text, F.lit(1), at - 1), block, F.substring(text, at, F.char_length(text))))
    return bare.join(made, doc, "left").withColumn(text_col, put).drop("toc")


def sections(docs: DataFrame, drop_fences: bool = False, doc: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, index, title, body) of H2 sections; index 0 is what stands before the first. The first H1 goes.

    A section is a running number of H2 lines outside of code. With drop_fences, code doesn't count as part of bodies.
    """
    body = F.regexp_replace(strip_front_matter(F.col(text_col)), r"(?m)(?:(?<![\s\S])|(?<=\n))# [^\n]+?\s*\n+", "\u0000")
    once = F.concat(F.substring_index(body, "\u0000", 1), F.replace(F.substring(body, F.char_length(F.substring_index(body, "\u0000", 1)) + 2, F.char_length(body)), F.lit("\u0000"), F.lit("")))
    text = F.when(body.contains("\u0000"), F.regexp_replace(strip_front_matter(F.col(text_col)), r"(?s)\A((?:(?!\n# |\A# ).)*?\n?)# [^\n]+\n+", "$1")).otherwise(once)
    marked = F.flatten(F.transform(T.segments(text), lambda s: F.transform(F.split(F.regexp_replace(s["text"], r"\n\z", ""), "\n"), lambda x: F.struct(s["inside"].alias("inside"), x.alias("line")))))
    lines = docs.select(doc, F.posexplode(marked).alias("n", "l")).select(doc, "n", "l.*")
    if drop_fences:
        lines = lines.where("not inside")
    h2 = ~F.col("inside") & F.col("line").rlike(r"\A## \S")
    lines = lines.withColumn("index", F.sum(h2.cast("int")).over(W.partitionBy(doc).orderBy("n")))
    agg = lines.groupBy(doc, "index").agg(F.max(F.when(h2, F.regexp_extract("line", r"\A## (.*?)\s*\z", 1))).alias("title"), F.array_sort(F.collect_list(F.when(~h2, F.struct("n", "line")))).alias("b"))
    return agg.select(doc, "index", "title", F.trim(F.array_join(F.transform("b", lambda x: x["line"]), "\n"), F.lit("\n")).alias("body"))


def ascii_slug(title: Column, most: int = 60) -> Column:
    """A slug for Latin letters: marks away by translation. arrow_text.slugs does other scripts."""
    marked, plain = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ", "aaaaaaeeeeiiiiooooouuuuncyy"
    s = F.regexp_replace(F.regexp_replace(F.translate(F.lower(title), marked, plain), r"[^a-z0-9]+", "-"), r"\A-+|-+\z", "")
    return F.when(s == "", F.lit("untitled")).otherwise(F.regexp_replace(F.substring(s, 1, most), r"-+\z", ""))


def section_names(sections: DataFrame, doc: str = "doc_id") -> DataFrame:
    """sections with file: NN-slug.md, NN as wide as the number of sections; equal slugs get -2, -3; 00-intro.md first."""
    total = F.count_if(F.col("index") > 0).over(W.partitionBy(doc))
    slug = ascii_slug(F.col("title"), 50)
    n = F.row_number().over(W.partitionBy(doc, "_slug").orderBy("index"))
    width = F.greatest(F.lit(2), F.char_length(total.cast("string")))
    rows = sections.withColumn("_slug", F.when(slug == "untitled", "section").otherwise(slug)).withColumns({"_n": n, "_w": width})
    name = F.concat(F.lpad(F.col("index").cast("string"), F.col("_w"), F.lit("0")), F.lit("-"), F.col("_slug"), F.when(F.col("_n") > 1, F.concat(F.lit("-"), F.col("_n").cast("string"))).otherwise(""), F.lit(".md"))
    return rows.withColumn("file", F.when(F.col("index") == 0, F.lit("00-intro.md")).otherwise(name)).drop("_slug", "_n", "_w")


def index_page(sections: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, index_text): links to the sections' files, the prelude last."""
    line = F.concat(F.lit("- ["), F.coalesce("title", F.lit("Prelude")), F.lit("]("), F.col("file"), F.lit(")"))
    rows = section_names(sections, doc).groupBy(doc).agg(F.array_sort(F.collect_list(F.struct((F.col("index") == 0).alias("last"), "index", line.alias("line")))).alias("l"))
    return rows.select(doc, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("index_text"))


def range_label(pages: Column) -> Column:
    """full, pages-a-b of contiguous pages, or the first eight numbers."""
    first, last = F.get(pages, F.lit(0)), F.get(pages, F.size(pages) - 1)
    listed = F.concat(F.lit("pages-"), F.array_join(F.transform(F.slice(pages, 1, 8), lambda p: p.cast("string")), "-"), F.when(F.size(pages) > 8, F.lit("-more")).otherwise(""))
    return F.when(pages.isNull() | (F.size(pages) == 0), "full").when(last - first + 1 == F.size(pages), F.concat(F.lit("pages-"), first.cast("string"), F.lit("-"), last.cast("string"))).otherwise(listed)


def chapter_slug(index: Column, title: Column) -> Column:
    bare = F.regexp_replace(title, CHAPTER_PREFIX, "")
    return F.concat(F.lit("cap-"), F.lpad(index.cast("string"), 2, "0"), F.lit("-"), ascii_slug(bare))


def outline_parents(chapters: DataFrame, doc: str = "doc_id") -> DataFrame:
    """chapters with parent: the last earlier entry of a smaller level.

    A document's outline is one array; a fold keeps the last entry of each level that is still open, so levels have no bound.
    """
    entries = chapters.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("index", "level"))).alias("_e"))
    kind = chapters.select("index", "level").schema
    open_as = f"array<struct<index:{kind['index'].dataType.simpleString()},level:{kind['level'].dataType.simpleString()}>>"
    start = F.struct(F.array().cast(open_as).alias("open"), F.array().cast(f"array<struct<index:{kind['index'].dataType.simpleString()},parent:{kind['index'].dataType.simpleString()}>>").alias("out"))

    def step(a: Column, e: Column) -> Column:
        left = F.filter(a["open"], lambda o: o["level"] < e["level"])
        return T.let(left, lambda o: F.struct(F.concat(o, F.array(e)).alias("open"), F.concat(a["out"], F.array(F.struct(e["index"].alias("index"), F.get(o, F.size(o) - 1)["index"].alias("parent")))).alias("out")))

    parents = entries.select(doc, F.explode(F.aggregate("_e", start, step, lambda a: a["out"])).alias("p")).select(doc, "p.index", "p.parent")
    return chapters.join(parents, [doc, "index"]).select(*chapters.columns, "parent")


def outline_json(chapters: DataFrame, doc: str = "doc_id") -> DataFrame:
    entry = F.struct("index", "level", "title", "start_page")
    return chapters.groupBy(doc).agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("outline"))


def metadata(fields: dict[str, Column]) -> Column:
    """Metadata as JSON with sorted keys and nulls written."""
    return F.to_json(F.struct(*(c.alias(k) for k, c in sorted(fields.items()))), {"ignoreNullFields": "false"})


def metadata_from_json(text: Column, schema: str) -> Column:
    """Metadata read again; what doesn't fit is null."""
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})


def study_fields(given: dict[str, Column], existing: dict[str, Column], now: Column, reset: bool = False) -> dict[str, Column]:
    """reading_status, tags, started_at and finished_at: what is given, else what was there, else the default.

    A date is set when the status that goes with it is given and there is none; reset takes both away. A status that isn't
    one fails the query.
    """
    value = lambda fields, k, kind: fields[k].cast(kind) if k in fields else F.lit(None).cast(kind)
    asked = value(given, "reading_status", "string")
    status = F.coalesce(asked, value(existing, "reading_status", "string"), F.lit(READING_STATUSES[0]))
    checked = F.when(status.isin(*READING_STATUSES), status).otherwise(F.raise_error(F.concat(F.lit("not a reading status: "), status)).cast("string"))
    tags = value(given, "tags", "array<string>")
    tags = F.when(F.size(tags) > 0, F.array_distinct(tags)).otherwise(F.coalesce(value(existing, "tags", "array<string>"), F.array().cast("array<string>")))
    none = F.lit(None).cast("string")

    def date(k: str, when: str) -> Column:
        before = value(existing, k, "string")
        return none if reset else F.coalesce(before, F.when(asked == when, now))

    return {"tags": tags, "reading_status": checked, "started_at": date("started_at", "in_progress"), "finished_at": date("finished_at", "read")}


def study_block(fields: dict[str, Column]) -> Column:
    """The fields as a struct for front matter, null where all of them are as they are by default."""
    plain = (F.size(fields["tags"]) == 0) & (fields["reading_status"] == READING_STATUSES[0]) & fields["started_at"].isNull() & fields["finished_at"].isNull()
    return F.when(~plain, F.struct(*(c.alias(k) for k, c in fields.items())))


def study_sections(text: Column, titles: Sequence[str] = STUDY_SECTIONS, parity: bool = False) -> Column:
    """Empty sections for notes at the end; with parity they are added again each time, else only where the last of them is missing."""
    block = "\n\n".join(f"## {t}" for t in titles)
    added = F.concat(F.regexp_replace(text, r"\n+\z", ""), F.lit(f"\n\n{block}\n"))
    return added if parity else F.when(text.rlike(rf"(?m)^## {titles[-1]}\s*$"), text).otherwise(added)


def write_documents(docs: DataFrame, folder: str, mode: str = "error", doc: str = "doc_id", text_col: str = "text") -> None:
    """Texts and metadata as tables below folder; mode error refuses to replace."""
    docs.select(doc, text_col, *[c for c in docs.columns if c not in (doc, text_col)]).write.mode(mode).parquet(f"{folder}/documents")


def tree_files(docs: DataFrame, raw: bool = False, split: bool = False, doc: str = "doc_id", book: str = "book", chapter: str = "chapter", text_col: str = "text", raw_col: str = "raw_text", meta_col: str = "metadata") -> DataFrame:
    """(path, content) of the files of documents (doc, book, chapter, text, metadata): book/chapter/text.md and metadata.json,
    with raw the text before cleaning in .quire/raw.md, with split a file for each H2 section and an index in sections/."""
    base = F.concat(F.col(book), F.lit("/"), F.col(chapter))
    kinds = {"text.md": text_col, "metadata.json": meta_col, **({".quire/raw.md": raw_col} if raw else {})}
    rows = docs.select(F.explode(F.array(*(F.struct(F.concat(base, F.lit(f"/{name}")).alias("path"), F.col(c).alias("content")) for name, c in kinds.items()))).alias("f")).select("f.*")
    if split:
        parts = sections(docs, doc=doc, text_col=text_col)
        where = docs.select(doc, base.alias("_base"))
        own = section_names(parts.where((F.col("index") > 0) | (F.col("body") != "")), doc).join(where, doc)
        body = F.when(F.col("index") == 0, F.concat("body", F.lit("\n"))).otherwise(F.concat(F.lit("## "), F.col("title"), F.lit("\n\n"), F.col("body"), F.lit("\n")))
        index = index_page(parts.where((F.col("index") > 0) | (F.col("body") != "")), doc).join(where, doc)
        rows = rows.union(own.select(F.concat("_base", F.lit("/sections/"), "file"), body)).union(index.select(F.concat("_base", F.lit("/sections/index.md")), F.concat("index_text", F.lit("\n"))))
    return rows.where("content is not null")


def write_tree(files: DataFrame, folder: str, force: bool = False) -> DataFrame:
    """Write files (path, content) below folder, in tasks, each under a name of its own first; a manifest (path, bytes, status).

    What is there stays unless force: its row says exists. Content is a string or binary. The folder is one that pyarrow's
    file systems reach.
    """
    spark = files.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        where, base = (fs.LocalFileSystem(), "/" + root.removeprefix("file:").lstrip("/")) if root.startswith("file:") else fs.FileSystem.from_uri(root)
        for batch in batches:
            size, status = [], []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw, name = content.encode() if isinstance(content, str) else content, f"{base}/{path}"
                if not force and where.get_file_info(name).type != fs.FileType.NotFound:
                    size.append(0)
                    status.append("exists")
                    continue
                part = f"{name}.{uuid.uuid4().hex}.part"
                where.create_dir(name.rpartition("/")[0], recursive=True)
                with where.open_output_stream(part) as f:
                    f.write(raw)
                where.move(part, name)
                size.append(len(raw))
                status.append("ok")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(status)], names=["path", "bytes", "status"])

    return files.select("path", "content").mapInArrow(write, "path string, bytes long, status string")


def outline_tree(chapters: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, tree): an outline as lines, indented by level, with first pages."""
    line = F.concat(F.repeat(F.lit("  "), F.col("level") - 1), F.col("index").cast("string"), F.lit(". "), F.col("title"), F.lit(" (p. "), F.col("start_page").cast("string"), F.lit(")"))
    rows = chapters.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("index", line.alias("line")))).alias("l"))
    return rows.select(doc, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("tree"))


def rendered(columns: dict[str, Column], width: int = 22) -> Column:
    """Names and values as lines of a report, names as wide as `width`; nulls are -."""
    return F.concat_ws("\n", *(F.concat(F.rpad(F.lit(k), width, " "), F.coalesce(c.cast("string"), F.lit("-"))) for k, c in columns.items()))


def rendered_table(rows: DataFrame, by: str, columns: Sequence[str]) -> DataFrame:
    """(by, table): the rows of each group as a Markdown table, sorted by the columns from the first on. For groups of few rows."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("-")) for c in columns)), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + " --- |" * len(columns) + "\n"
    made = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*columns, line.alias("_line")))).alias("l"))
    return made.select(by, F.concat(F.lit(head), F.array_join(F.transform("l", lambda x: x["_line"]), "\n")).alias("table"))


def dry_run(docs: DataFrame) -> dict:
    """What would be computed: schema and plan, without an action."""
    return {"schema_version": 1, "columns": json.loads(docs.schema.json())["fields"], "plan": docs._jdf.queryExecution().optimizedPlan().toString()}
