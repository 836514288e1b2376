"""Selection of pages and chapters: range specifications, chapter ranges, lookup by title, detection without an outline."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..functions.fixed import CHAPTER_PAGE, NUMBERED_PAGE


class RangeOutOfBounds(ValueError):
    """A page or chapter beyond the last."""

    exit_code = 4


class ChapterDetectionFailed(ValueError):
    exit_code = 4


def tokens(spec: str) -> list[str]:
    return [t for t in (p.strip() for p in spec.split(",")) if t]


def parse_pages(spec: str, total: int) -> list[int]:
    """Pages of `N`, `A-B`, `A-`, `-B` and lists of these: sorted, each once."""
    out: set[int] = set()
    for t in tokens(spec):
        m = re.fullmatch(r"(\d*)\s*(-?)\s*(\d*)", t)
        if not m or not (m[1] or m[3]):
            raise ValueError(f"not a page range: {t!r}")
        first = int(m[1]) if m[1] else 1
        last = int(m[3]) if m[3] else (total if m[2] else first)
        if first < 1 or last < first:
            raise ValueError(f"pages must ascend from 1: {t!r}")
        if max(first, last) > total:
            raise RangeOutOfBounds(f"{t!r} is beyond page {total}")
        out.update(range(first, last + 1))
    if not out:
        raise ValueError("no pages given")
    return sorted(out)


def translate_spec(spec: str, offset: int) -> str:
    """Numbers of a specification moved by offset."""
    return spec if not offset else ",".join(re.sub(r"\d+", lambda m: str(int(m[0]) + offset), t) for t in tokens(spec))


def parse_chapters(spec: str, total: int) -> list[int]:
    """Chapters of `N` and `A-B`; open ranges are errors."""
    if total < 1:
        raise ValueError("there is no outline")
    if any(not re.fullmatch(r"\d+(\s*-\s*\d+)?", t) for t in tokens(spec)):
        raise ValueError(f"not a list of chapters: {spec!r}")
    return parse_pages(spec, total)


def parse_pages_string(spec: str | None) -> list[int] | None:
    """As given, neither sorted nor each once; None takes all."""
    if spec is None:
        return None
    if not re.fullmatch(r"\s*\d+\s*(?:-\s*\d+\s*)?(?:\s*,\s*\d+\s*(?:-\s*\d+\s*)?)*\s*", spec):
        raise ValueError(f"not a page range: {spec!r}")
    out: list[int] = []
    for t in tokens(spec):
        a, _, b = t.partition("-")
        out += range(int(a), int(b or a) + 1)
    return out


def parse_size(text: str) -> int:
    """Bytes of a number with K, M or G, powers of 1000."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([kmg]?)b?\s*", text, re.I)
    n = int(float(m[1]) * {"": 1, "k": 10**3, "m": 10**6, "g": 10**9}[m[2].lower()]) if m else 0
    if not 1 <= n <= 2**63 - 1:
        raise ValueError(f"not a size: {text!r}")
    return n


def parse_dimensions(text: str) -> tuple[int, int]:
    """Width and height of WxH or W,H."""
    m = re.fullmatch(r"\s*(\d+)\s*[xX,]\s*(\d+)\s*", text)
    if not m or min(int(m[1]), int(m[2])) < 1:
        raise ValueError(f"not a width and a height: {text!r}")
    return int(m[1]), int(m[2])


def page_list(spec: Column, total: Column) -> Column:
    """parse_pages for a column of specifications; null where one is wrong or beyond the last page."""
    parts = F.filter(F.transform(F.split(spec, ","), lambda t: F.trim(t)), lambda t: t != "")

    def span(t: Column) -> Column:
        first = F.when(t.startswith("-"), F.lit(1)).otherwise(F.expr("1") * F.regexp_extract(t, r"\A(\d+)", 1).try_cast("int"))
        last = F.when(t.endswith("-"), total).otherwise(F.regexp_extract(t, r"(\d+)\z", 1).try_cast("int"))
        good = t.rlike(r"\A(\d+|\d+\s*-\s*\d+|\d+\s*-|-\s*\d+)\z") & (first >= 1) & (last >= first) & (last <= total)
        return F.when(good, F.sequence(first, last))

    spans = F.transform(parts, span)
    return F.when((F.size(parts) > 0) & F.forall(spans, lambda s: s.isNotNull()), F.array_sort(F.array_distinct(F.flatten(spans))))


def select_pages(pages: DataFrame, wanted: DataFrame, doc: str = "doc_id", page: str = "page_no") -> DataFrame:
    """pages of which wanted (doc, pages array) has the number."""
    return pages.join(wanted.select(doc, F.explode("pages").alias(page)).distinct(), [doc, page], "left_semi")


def infer_ranges(chapters: DataFrame, totals: DataFrame, doc: str = "doc_id") -> DataFrame:
    """chapters with end_page, exclusive: where the next chapter of the same or a higher level begins, or after the last page.

    A document's outline is one array, folded from its end: what is kept are the later entries that no later one of a
    smaller or equal level hides. Levels have no bound, and a document's chapters aren't joined with each other.
    """
    entries = chapters.groupBy(doc).agg(F.reverse(F.array_sort(F.collect_list(F.struct("index", "level", "start_page")))).alias("_e"))
    kind = {f.name: f.dataType.simpleString() for f in chapters.schema.fields}
    later = f"array<struct<index:{kind['index']},level:{kind['level']},start_page:{kind['start_page']}>>"
    start = F.struct(F.array().cast(later).alias("later"), F.array().cast(f"array<struct<index:{kind['index']},next:{kind['start_page']}>>").alias("out"))

    def step(a: Column, e: Column) -> Column:
        left = F.filter(a["later"], lambda o: o["level"] <= e["level"])  # the last of them is the next one
        kept = F.filter(a["later"], lambda o: o["level"] < e["level"])
        return F.struct(F.concat(kept, F.array(e)).alias("later"), F.concat(a["out"], F.array(T.let(left, lambda o: F.struct(e["index"].alias("index"), F.get(o, F.size(o) - 1)["start_page"].alias("next"))))).alias("out"))

    nexts = entries.select(doc, F.explode(F.aggregate("_e", start, step, lambda a: a["out"])).alias("n")).select(doc, "n.index", "n.next")
    rows = chapters.join(nexts, [doc, "index"]).join(totals, doc)
    return rows.withColumn("end_page", F.coalesce("next", F.col("total_pages") + 1)).select(*chapters.columns, "end_page")


def chapter_pages(ranged: DataFrame, totals: DataFrame, offset: int = 0, doc: str = "doc_id") -> DataFrame:
    """(doc, index, status, pages): the pages of chapters with ranges, moved by an offset; out of bounds where they begin
    before the first page, or begin or end after the last."""
    rows = ranged.join(totals, doc)
    first, end = F.col("start_page") + offset, F.col("end_page") + offset
    good = (first >= 1) & (first <= F.col("total_pages")) & (end <= F.col("total_pages") + 1) & (end > first)
    return rows.select(doc, "index", F.when(good, "ok").otherwise("out of bounds").alias("status"), F.when(good, F.sequence(first, end - 1)).alias("pages"))


def resolve_chapter(chapters: DataFrame, spec: str, doc: str = "doc_id") -> DataFrame:
    """(doc, status, chapter): the chapter of a number, or the only one whose title holds the text, case ignored."""
    number = spec.strip().isdigit() and int(spec) > 0
    fits = F.col("index") == int(spec) if number else F.contains(F.lower("title"), F.lit(spec.lower()))
    found = chapters.groupBy(doc).agg(F.count_if(fits).alias("n"), F.min(F.when(fits, F.struct("index", "title", "level", "start_page"))).alias("chapter"))
    status = F.when(F.col("n") == 1, "ok").when(F.col("n") == 0, "not found").otherwise("ambiguous")
    return found.select(doc, status.alias("status"), F.when(F.col("n") == 1, F.col("chapter")).alias("chapter"))


def first_by_pattern(chapters: DataFrame, pattern: str, doc: str = "doc_id") -> DataFrame:
    """The first chapter of each document whose title matches, case ignored."""
    return chapters.where(F.col("title").rlike(f"(?i){pattern}")).groupBy(doc).agg(F.min(F.struct("index", "title", "level", "start_page")).alias("c")).select(doc, "c.*")


def detect_chapters(pages: DataFrame, doc: str = "doc_id", page: str = "page_no", text_col: str = "text") -> DataFrame:
    """Pages whose first line, within 200 characters, says Chapter N, Capítulo N or N. Title: (doc, index, title, start_page)."""
    head = F.get(F.filter(F.transform(T.lines(F.substring(text_col, 1, 200)), T.normalize_line), lambda x: x != ""), F.lit(0))
    hit = head.rlike(CHAPTER_PAGE) | head.rlike(NUMBERED_PAGE)
    rows = pages.select(doc, F.col(page).alias("start_page"), head.alias("title")).where(hit)
    return rows.withColumn("index", F.row_number().over(W.partitionBy(doc).orderBy("start_page"))).select(doc, "index", "title", "start_page")


def detect_chapters_by_font(pages: DataFrame, times: float = 1.5, doc: str = "doc_id", page: str = "page_no", text_col: str = "text", sizes: str = "font_sizes") -> DataFrame:
    """Pages whose largest character is times the document's median: the first run of that size is the title."""
    largest = pages.select(doc, page, text_col, sizes, F.array_max(sizes).alias("size"))
    medians = pages.select(doc, F.explode(sizes).alias("s")).groupBy(doc).agg(F.median("s").alias("median"))
    rows = largest.join(medians, doc).where(F.col("size") >= times * F.col("median"))
    first = F.array_position(sizes, F.col("size"))
    after = F.filter(F.transform(sizes, lambda s, i: F.when((i >= first) & (s != F.col("size")), i)), lambda i: i.isNotNull())
    title = T.normalize_line(F.substring(F.col(text_col), first.cast("int"), (F.coalesce(F.get(after, F.lit(0)), F.size(sizes)) - first + 1).cast("int")))
    rows = rows.withColumn("index", F.row_number().over(W.partitionBy(doc).orderBy(page)))
    return rows.select(doc, "index", F.when(title == "", F.concat(F.lit("Chapter "), F.col("index"))).otherwise(title).alias("title"), F.col(page).alias("start_page"))


def detect(pages: DataFrame, least: int = 2, doc: str = "doc_id", **fonts) -> DataFrame:
    """Chapters by the first lines of pages, or by font sizes where fewer than `least` lines say so and font sizes say more.
    Documents in which neither finds any are not in the result."""
    names = [doc, "index", "title", "start_page"]
    lines, sizes = detect_chapters(pages, doc).select(names), detect_chapters_by_font(pages, doc=doc, **fonts).select(names)
    counted = lambda rows, n: rows.groupBy(doc).agg(F.count("*").alias(n))
    both = counted(lines, "n_lines").join(counted(sizes, "n_sizes"), doc, "full").na.fill(0, ["n_lines", "n_sizes"])
    by_font = both.where((F.col("n_lines") < least) & (F.col("n_sizes") > F.col("n_lines"))).select(doc)
    return lines.join(by_font, doc, "left_anti").unionByName(sizes.join(by_font, doc, "left_semi"))


def outline_tuples(outline: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, level, title, page) of an outline's entries."""
    return outline.select(doc, "level", "title", F.col("start_page").alias("page"))


def outline_or_detected(outline: DataFrame, detected: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Detected chapters of documents without an outline, beside the outlines."""
    names = [doc, "index", "title", "start_page"]
    return outline.select(names).unionByName(detected.join(outline.select(doc).distinct(), doc, "left_anti").select(names))
