"""Figures: candidates kept or dropped, captions, anchors and placeholders."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as T
from ..functions.fixed import CAPTION, OMITTED_FIGURE
from ..sources import readers


def pixel_hash(pixels: Column) -> Column:
    return F.sha2(pixels, 256)


def filter_candidates(candidates: DataFrame, areas: DataFrame, totals: DataFrame, least: tuple[int, int] = (64, 64), repeat: float = 0.8, coverage: float = 0.85, doc: str = "doc_id") -> DataFrame:
    """candidates (doc, seq, page, width, height, pixel_sha, x, y, w, h) with decision and, for those kept, position.

    Too small, then background (its box covers the page; unknown boxes pass), then logos: an image on at least
    max(1, int(n_pages * repeat)) distinct pages, of those left, keeps its first. Kept ones are ordered by their image's
    first place, then their own. Images are counted by aggregation, so one that is everywhere is combined first.
    """
    sized = candidates.join(areas, [doc, "page"], "left").join(totals, doc)
    part = F.col("w") * F.col("h") / (F.col("page_width") * F.col("page_height"))
    early = F.when((F.col("width") < least[0]) | (F.col("height") < least[1]), "too_small").when(F.coalesce(part >= coverage, F.lit(False)), "background")
    rows = sized.withColumn("early", early)
    images = rows.where("early is null").groupBy(doc, "pixel_sha").agg(F.countDistinct("page").alias("on_pages"), F.min("seq").alias("first_seq"))
    rows = rows.join(images, [doc, "pixel_sha"], "left")
    logo = (F.col("on_pages") >= F.greatest(F.lit(1), (F.col("total_pages") * repeat).cast("int"))) & (F.col("seq") != F.col("first_seq"))
    rows = rows.withColumn("decision", F.coalesce("early", F.when(logo, "logo_repeated").otherwise("kept")))
    rank = F.row_number().over(W.partitionBy(doc, F.col("decision") == "kept").orderBy("first_seq", "seq"))
    return rows.select(*candidates.columns, "decision", F.when(F.col("decision") == "kept", rank).alias("position"))


def filter_report(decided: DataFrame, doc: str = "doc_id") -> DataFrame:
    return decided.groupBy(doc, "decision").agg(F.count("*").alias("n"))


def figure_name(chapter: Column, index: Column, extension: str = "png") -> Column:
    return F.format_string(f"fig-%02d-%02d.{extension}", chapter, index)


def captions(lines: DataFrame, doc: str = "doc_id", page: str = "page_no", line_no: str = "line_no", line: str = "line") -> DataFrame:
    """(doc, page, line_no, chapter, figure, description) of lines that are captions."""
    text = T.normalize_line(F.col(line))
    part = lambda k: F.regexp_extract(text, CAPTION, k)
    return lines.where(text.rlike(CAPTION)).select(doc, page, line_no, text.alias("raw"), part(2).cast("int").alias("chapter"), part(3).cast("int").alias("figure"), part(5).alias("description"))


def captions_after(starts: DataFrame, lines: DataFrame, window: int = 3, doc: str = "doc_id", page: str = "page_no", line_no: str = "line_no", line: str = "line") -> DataFrame:
    """starts (doc, page, line_no) with the first caption within the next `window` lines that aren't blank.

    Lines and starts of a page are one sorted sequence. A running count numbers the lines that aren't blank; the next
    caption of each place, and its number, come from one window over what follows. No line meets another one.
    """
    full = (T.normalize_line(F.col(line)) != "").cast("int")
    rows = lines.select(doc, page, line_no, line, full.alias("full"), F.lit(0).alias("start")).unionByName(starts.select(doc, page, line_no, F.lit(None).cast("string").alias(line), F.lit(0).alias("full"), F.lit(1).alias("start")))
    order = W.partitionBy(doc, page).orderBy(line_no, "start")
    rows = rows.withColumn("rank", F.sum("full").over(order.rowsBetween(W.unboundedPreceding, 0)))
    text = T.normalize_line(F.col(line))
    part = lambda k: F.regexp_extract(text, CAPTION, k)
    hit = F.when((F.col("full") == 1) & text.rlike(CAPTION), F.struct("rank", part(2).cast("int").alias("chapter"), part(3).cast("int").alias("figure"), part(5).alias("description")))
    following = order.rowsBetween(1, W.unboundedFollowing)
    rows = rows.withColumn("c", F.first(hit, ignorenulls=True).over(following))
    near = rows.where((F.col("start") == 1) & (F.col("c.rank") <= F.col("rank") + window))
    return near.select(doc, page, line_no, "c.chapter", "c.figure", "c.description").distinct()


def captions_by_page(found: DataFrame, figures: DataFrame, doc: str = "doc_id", page: str = "page") -> DataFrame:
    """figures (doc, page, index, y_frac) with the captions found on their pages (doc, page, line_no, raw), in order: the
    first figure from above has the first caption; figures beyond the captions have none."""
    k = F.row_number().over(W.partitionBy(doc, page).orderBy("line_no"))
    j = F.row_number().over(W.partitionBy(doc, page).orderBy(F.coalesce("y_frac", F.lit(1.0)), "index"))
    return figures.withColumn("_k", j).join(found.select(doc, page, k.alias("_k"), F.col("raw").alias("caption")), [doc, page, "_k"], "left").drop("_k")


def y_fraction(y: Column, height: Column) -> Column:
    """Where on its page a figure stands, from 0 to 1; the bottom where that is unknown or 0."""
    part = F.when((height > 0) & (y > 0), y / height)
    return F.least(F.lit(1.0), F.coalesce(part, F.lit(1.0)))


def placeholder(chapter: Column, index: Column) -> Column:
    return F.concat(F.lit(OMITTED_FIGURE), chapter.cast("string"), F.lit("."), index.cast("string"), F.lit(" -->"))


def default_alt(caption: Column) -> Column:
    return F.coalesce(caption, F.lit(""))


def anchor(alt: Column, path: Column) -> Column:
    return F.concat(F.lit("!["), default_alt(alt), F.lit("]("), path, F.lit(")"))


def placeholders(candidates: DataFrame, areas: DataFrame, chapter: Column, doc: str = "doc_id", page: str = "page") -> DataFrame:
    """(doc, page, figure_index, y_frac, markup, caption) of all candidates, none filtered: numbered by page and place in
    the file, at the height of their boxes, at the bottom where that isn't known."""
    rows = candidates.join(areas, [doc, page], "left")
    index = F.row_number().over(W.partitionBy(doc).orderBy(page, "seq"))
    rows = rows.withColumn("figure_index", index)
    height = F.when(F.col("y").isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("y") / F.col("page_height"))))
    return rows.select(doc, page, "figure_index", F.coalesce(height, F.lit(1.0)).alias("y_frac"), placeholder(chapter, F.col("figure_index")).alias("markup"), F.lit(None).cast("string").alias("caption"))


def anchor_figures(pages: DataFrame, figures: DataFrame, window: int = 3, doc: str = "doc_id", page: str = "page_no", text_col: str = "text") -> DataFrame:
    """pages with figures' markup (doc, page, y_frac, markup, caption) put in, each with a blank line after it.

    Figures of a page are put in one after the other, from above (0 and null count as 1): at the top for y_frac 0, at the
    bottom from 1 on, else after the line at that part of the lines that aren't blank by then; where it is null, as the last
    line. With a caption given, a line from there on that reads so moves below its figure in italics; else the first caption
    among the next `window` lines that aren't blank after the line that follows the figure. Figures beyond the last page go
    to its end. All of it is a fold within the row of a page.
    """
    last = pages.groupBy(doc).agg(F.max(page).alias("_last"))
    placed = figures.join(last, doc).withColumn("beyond", F.col(page) > F.col("_last")).withColumn(page, F.least(page, "_last")).drop("_last")
    figure = F.struct(F.col("beyond"), F.coalesce(F.when(F.col("y_frac") != 0, F.col("y_frac").cast("double")), F.lit(1.0)).alias("order"), F.col("y_frac").cast("double").alias("y"), F.col("markup"), F.coalesce("caption", F.lit("")).alias("caption"))
    by_page = placed.groupBy(doc, page).agg(F.array_sort(F.collect_list(figure)).alias("_f"))

    def numbers(rows: Column, keep: Callable[[Column], Column]) -> Column:
        return F.filter(F.transform(rows, lambda x, i: F.when(keep(x), i)), lambda i: i.isNotNull())

    def put(rows: Column, f: Column) -> Column:
        def at_target(full: Column) -> Column:
            n = F.size(full)
            k = F.least((f["y"] * n).cast("int"), n - 1)
            target = F.when(f["y"].isNull(), F.size(rows)).when((f["y"] == 0) | (n == 0), 0).when(f["y"] >= 1, F.size(rows)).otherwise(F.get(full, k) + 1)
            return T.let(target, lambda t: with_caption(t, full))

        def with_caption(target: Column, full: Column) -> Column:
            named = F.filter(full, lambda i: (i >= target) & (T.normalize_line(F.get(rows, i)) == f["caption"]))
            near = F.filter(F.slice(F.filter(full, lambda i: i > target), 1, window), lambda i: T.normalize_line(F.get(rows, i)).rlike(CAPTION))
            there = F.when(f["y"].isNotNull() & f["markup"].startswith("!"), F.get(F.when(f["caption"] != "", named).otherwise(near), F.lit(0)))
            return T.let(F.struct(target.alias("t"), there.alias("c")), written)

        def written(w: Column) -> Column:
            rest = F.filter(F.transform(F.slice(rows, w["t"] + 1, F.size(rows)), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda x: ~F.coalesce(x["i"] + w["t"] == w["c"], F.lit(False)))
            italic = F.when(w["c"].isNotNull(), F.array(F.concat(F.lit("*"), T.normalize_line(F.get(rows, w["c"])), F.lit("*")))).otherwise(F.array().cast("array<string>"))
            last = F.when((F.size(rows) > 0) & (F.element_at(rows, -1) != ""), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
            put_in = F.concat(F.slice(rows, 1, w["t"]), F.array(f["markup"], F.lit("")), italic, F.transform(rest, lambda x: x["x"]))
            return F.when(f["y"].isNull(), F.concat(rows, last, F.array(f["markup"]))).otherwise(put_in)

        return T.let(numbers(rows, lambda x: T.normalize_line(x) != ""), at_target)

    joined = pages.join(by_page, [doc, page], "left")
    own = T.join(F.aggregate(F.filter("_f", lambda f: ~f["beyond"]), T.lines(F.col(text_col)), put))
    joined = joined.withColumn("_text", F.when(F.exists("_f", lambda f: ~f["beyond"]), own).otherwise(F.col(text_col)))
    out = append_figures(F.col("_text"), F.transform(F.filter("_f", lambda f: f["beyond"]), lambda f: f["markup"]))
    return joined.withColumn(text_col, F.when(F.col("_f").isNull(), F.col(text_col)).otherwise(out)).drop("_f", "_text")


def append_figures(text: Column, markups: Column) -> Column:
    """Figures, an array of markup, at the end of a text without pages."""
    return F.when(F.size(markups) > 0, F.concat(F.regexp_replace(text, r"\s+\z", ""), F.lit("\n\n"), F.array_join(markups, "\n"), F.lit("\n"))).otherwise(text)


def describe(figures: DataFrame, provider: Callable[[bytes], str] | None, content: str = "content") -> DataFrame:
    """figures with alt: what a provider says of each image's bytes; null without a provider, or where it fails."""
    if provider is None:
        return figures.withColumn("alt", F.lit(None).cast("string"))

    @F.arrow_udf("string")
    def apply(images: pa.Array) -> pa.Array:
        out = []
        for raw in images.to_pylist():
            try:
                out.append(None if raw is None else provider(raw))
            except Exception:  # a description is an extra, an image without one stays
                out.append(None)
        return pa.array(out, pa.string())

    return figures.withColumn("alt", apply(F.col(content)))


def kept_from_files(files: DataFrame, least: tuple[int, int] = (64, 64), chapter: int = 1) -> DataFrame:
    """(path, seq, page, name, content) of the images in files that filter_candidates keeps, named in their order."""
    found = readers.image_candidates(files).where("status = 'ok'")
    areas = readers.page_areas(files).where("status = 'ok'").select("path", "page_width", "page_height")
    pages = readers.extract(files).groupBy("path").agg(F.greatest(F.lit(1), F.max("page_no")).alias("total_pages"))
    of_page = found.select("path", "page").distinct().join(areas, "path")
    kept = filter_candidates(found.drop("content"), of_page, pages, least, doc="path").where("decision = 'kept'")
    name = F.format_string("fig-%02d-%02d.%s", F.lit(chapter), F.col("position"), F.col("extension"))
    return kept.select("path", "seq", "page", name.alias("name")).join(found.select("path", "seq", "content"), ["path", "seq"])
