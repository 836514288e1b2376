"""Command line: convert, batch, toc, outline, figures, inspect, compare, watch, config, version. Each is a plan over the library."""

from __future__ import annotations

import argparse
import json
import os
import shlex
import subprocess
import sys
import time
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .operators import cleaners, errors, figures, quality, select, state, structure
from .session import local_session
from .sources import readers
from .streaming import watch

DEFAULTS = {"only": "", "skip": "", "pages": "", "chapter": "", "toc": False, "strict": False, "max_bytes": readers.Limits().max_bytes, "seconds": readers.Limits().seconds, "post": ""}
KINDS = {"only": str, "skip": str, "pages": str, "chapter": str, "max_bytes": int, "seconds": int, "post": str}
VALID = {"max_bytes": lambda v: isinstance(v, int) and not isinstance(v, bool) and v > 0, "seconds": lambda v: isinstance(v, int) and not isinstance(v, bool) and v > 0}


def names(text: str) -> list[str]:
    return [t for t in (p.strip() for p in (text or "").split(",")) if t]


def sources(spark: SparkSession, path: str, ext: str = "") -> DataFrame:
    """Files below path; with -, the standard input as one file of the format ext."""
    return readers.from_bytes(spark, sys.stdin.buffer.read(), ext.lstrip(".")) if path == "-" else readers.read_files(spark, path)


def all_chapters(files: DataFrame, text: DataFrame) -> DataFrame:
    """(path, index, title, start_page, level) of files' outlines; files without one are searched for chapters."""
    found = readers.outlines(files).where("status = 'ok'")
    names = ["path", "index", "title", "start_page", "level"]
    return found.select(names).unionByName(select.detect_chapters(text, "path").join(found.select("path").distinct(), "path", "left_anti").withColumn("level", F.lit(1)).select(names))


def each_chapter(files: DataFrame, pages: DataFrame, spec: str, offset: int = 0) -> DataFrame:
    """pages of the chapters that spec names (N, A-B, lists), each as a file of its own, path#chapter-NN; chapters that a file
    lacks, or that are out of bounds, have a row that says so."""
    text = pages.where("status = 'ok'")
    chapters, totals = all_chapters(files, text), text.groupBy("path").agg(F.max("page_no").alias("total_pages"))
    asked = select.parse_chapters(spec, 10**6)
    wanted = text.select("path", "sha256", "format").distinct().withColumn("index", F.explode(F.array(*(F.lit(k) for k in asked))))
    ranged = select.chapter_pages(select.infer_ranges(chapters, totals, "path"), totals, offset, "path")
    wanted = wanted.join(ranged, ["path", "index"], "left").withColumn("name", F.concat("path", F.lit("#chapter-"), F.lpad(F.col("index").cast("string"), 2, "0")))
    one = wanted.where("status = 'ok'").select("path", "name", F.explode("pages").alias("page_no"))
    kept = text.join(one, ["path", "page_no"]).drop("path").withColumnRenamed("name", "path").select(pages.columns)
    none = {"page_no": F.lit(None).cast("int"), "text": F.lit(None).cast("string"), "warning": F.lit(None).cast("string")}
    gone = wanted.where("status is null or status <> 'ok'").drop("path").withColumnRenamed("name", "path").withColumn("status", F.concat(F.lit("out of bounds: chapter "), F.col("index").cast("string")))
    return kept.unionByName(gone.withColumns(none).select(pages.columns)).unionByName(pages.where("status <> 'ok'"))


def chapter_pages(files: DataFrame, pages: DataFrame, spec: str, offset: int = 0) -> DataFrame:
    """pages (as extract() gives them) of one chapter of each file, by its number or a part of its title; files whose chapter
    isn't found, or is out of bounds, have a row that says so. Files without an outline are searched for chapters."""
    text = pages.where("status = 'ok'")
    chapters = all_chapters(files, text)
    totals = text.groupBy("path").agg(F.max("page_no").alias("total_pages"))
    one = select.resolve_chapter(chapters, spec, "path")
    ranged = select.infer_ranges(chapters, totals, "path").join(one.where("status = 'ok'").select("path", F.col("chapter.index").alias("index")), ["path", "index"])
    wanted = select.chapter_pages(ranged, totals, offset, "path")
    kept = select.select_pages(text, wanted.where("status = 'ok'").select("path", "pages"), "path", "page_no")
    why = text.select("path", "sha256", "format").distinct().join(one.select("path", F.col("status").alias("s")), "path", "left").join(wanted.select("path", F.col("status").alias("w")), "path", "left")
    why = why.withColumn("status", F.when(F.col("w") == "ok", "ok").when(F.col("w").isNotNull(), "out of bounds: chapter").otherwise(F.concat(F.lit("out of bounds: chapter "), F.coalesce("s", F.lit("not found")))))
    none = {"page_no": F.lit(None).cast("int"), "text": F.lit(None).cast("string"), "warning": F.lit(None).cast("string")}
    return kept.unionByName(why.where("status <> 'ok'").withColumns(none).select(pages.columns)).unionByName(pages.where("status <> 'ok'"))


def converted(spark: SparkSession, path: str, pages: str = "", only: str = "", skip: str = "", max_bytes: int = readers.Limits().max_bytes, chapter: str = "", offset: int = 0, seconds: int = readers.Limits().seconds, ext: str = "", words: str = "", keep_going: bool = False, files: DataFrame | None = None, chapters: str = "") -> DataFrame:
    """(path, sha256, format, status, pages, warning, text, clean_text, stats) of files: pages are read, joined and cleaned.

    Words broken at the ends of lines are joined by the words of a file, one a line, or by those that the texts have whole
    three times or more.
    """
    if sum(map(bool, (pages, chapter, chapters))) > 1:
        raise ValueError("pages, chapter and chapters exclude each other")
    wanted = select.parse_pages(select.translate_spec(pages, offset), readers.Limits().max_pages) if pages else None
    files = sources(spark, path, ext) if files is None else files
    read = readers.extract(files, readers.Limits(max_bytes=max_bytes, seconds=seconds), pages=wanted)
    if chapter:
        read = chapter_pages(files, read, chapter, offset)
    if chapters:
        read = each_chapter(files, read, chapters, offset)
    joined = read.groupBy("path", "sha256", "format").agg(F.max("status").alias("status"), F.count("page_no").alias("pages"), F.max("warning").alias("warning"), F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("p"))
    texts = joined.withColumn("text", F.array_join(F.transform("p", lambda x: x["text"]), "\n")).drop("p")
    dictionary = spark.read.text(words).select(F.lower(F.trim("value")).alias("word")).where("word <> ''") if words else cleaners.corpus_words(texts)
    return cleaners.clean(texts, cleaners.choose(cleaners.default_cleaners(), names(only), names(skip)), stop_on_error=not keep_going, dictionary=dictionary, doc="path")


def book(path: Column) -> Column:
    return structure.ascii_slug(F.regexp_replace(F.regexp_extract(path, r"([^/]*)\z", 1), r"\.[A-Za-z0-9]+(#chapter-\d+)?\z", ""))


def tree(done: DataFrame, label: Column, now: Column, cleaned_by: Sequence[str], raw: bool = False, split: bool = False) -> DataFrame:
    """(path, content) of the files of a tree: text with front matter, metadata, and what raw and split ask for."""
    title = F.coalesce(structure.first_h1(F.col("clean_text")), book(F.col("path")))
    given = {"title": title, "book": book(F.col("path")), "chapter": label, "pages": F.lit(None).cast("array<int>"), "source_file": F.regexp_extract("path", r"([^/]*)\z", 1), "source_sha256": F.col("sha256"), "converted_at": now, "engine_version": F.lit(__version__), "reader_version": F.lit(__version__), "cleaners_applied": F.array(*(F.lit(c) for c in cleaned_by)).cast("array<string>")}
    meta = {**{k: v for k, v in given.items() if k not in ("book", "chapter", "converted_at")}, "book_slug": given["book"], "chapter_slug": label, "generated_at": now, "schema_version": F.lit(2), "word_count": F.col("words"), "warnings": F.col("warnings")}
    rows = done.where("status = 'ok'").select("path", book(F.col("path")).alias("book"), label.alias("chapter"), structure.prepend_front_matter(F.col("clean_text"), structure.build_front_matter(**given)).alias("text"), F.col("text").alias("raw_text"), structure.metadata(meta).alias("metadata"))
    return structure.tree_files(rows, raw, split, doc="path")


def report(done: DataFrame) -> DataFrame:
    """done with statistics and warnings."""
    stats = quality.statistics(done)
    changes = F.aggregate("stats", F.lit(0), lambda a, s: a + s["changes"])
    return stats.withColumn("warnings", quality.warnings(F.col("pages"), F.col("format"), F.lit(0), changes, F.lit(True)))


def free_path(path: Path, force: bool = False, suffix: bool = False) -> Path:
    """path, or with suffix the first of path-2, path-3 and so on that is free; what is there stays unless force."""
    if force and suffix:
        raise ValueError("force and suffix exclude each other")
    if not path.exists() or force:
        return path
    if not suffix:
        raise FileExistsError(str(path))
    n = 2
    while (at := path.with_name(f"{path.stem}-{n}{path.suffix}")).exists():
        n += 1
    return at


def hook(command: str | None, env: dict[str, str], seconds: int = 60) -> tuple[int, str]:
    """Run a command after the work: its code and the last 20 lines of what it said. It never raises."""
    if not command:
        return 0, ""
    try:
        done = subprocess.run(shlex.split(command), env=env, capture_output=True, text=True, timeout=None if seconds < 0 else seconds)
        return done.returncode, "\n".join((done.stdout + done.stderr).splitlines()[-20:])
    except (OSError, ValueError, subprocess.TimeoutExpired) as e:
        return -1, str(e)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quire")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("convert", "batch", "toc", "outline", "figures", "inspect", "compare", "watch"):
        p = commands.add_parser(name)
        p.add_argument("path", help="a file, a folder, or - with --ext")
        if name in ("convert", "batch", "watch", "figures"):
            p.add_argument("--out", required=True)
            p.add_argument("--force", action="store_true")
        if name in ("convert", "batch"):
            for o in ("dry-run", "toc", "strict", "keep-going", "tree", "raw", "split", "study", "reset-study"):
                p.add_argument(f"--{o}", action="store_true")
            for o in ("only", "skip", "pages", "chapter", "chapters", "ext", "words", "cache", "registry", "reading-status", "config"):
                p.add_argument(f"--{o}", default="")
            p.add_argument("--tag", action="append", default=[])
            p.add_argument("--page-offset", type=int, default=0)
        if name in ("convert", "batch", "watch"):
            p.add_argument("--post", default="", help="a command to run afterwards, with QUIRE_OUT and QUIRE_STATUS")
            p.add_argument("--post-seconds", type=int, default=60)
        if name == "watch":
            p.add_argument("--state", required=True)
            p.add_argument("--glob", default="*")
            p.add_argument("--archive", default=None)
            p.add_argument("--settle", type=float, default=2.0)
            p.add_argument("--poll", type=float, default=0.5)
            p.add_argument("--attempts", type=int, default=3)
            p.add_argument("--once", action="store_true")
        if name == "figures":
            p.add_argument("--least", default="64x64")
    commands.add_parser("version")
    p = commands.add_parser("config")
    p.add_argument("file", nargs="?", help="JSON or TOML of the project")
    p.add_argument("--global-file", default=None)
    p.add_argument("--name", default="")
    p.add_argument("--sha256", default="")
    return top


def configuration(project: str | None, global_file: str | None = None, name: str = "", sha256: str = "") -> tuple[dict, dict, list[str]]:
    """(values, which layer each is from, warnings) of the configuration; a file that is JSON counts as the project's layer."""
    if project and project.endswith(".json"):
        layer = json.loads(Path(project).read_text())
        said, notes = state.env_layer("QUIRE", KINDS)
        values, origin, more = state.merge_config(DEFAULTS, layer, said, valid=VALID)
        return values, {k: ("default", "project", "env")[n] for k, n in origin.items()}, notes + more
    text = lambda f: Path(f).read_text() if f and Path(f).exists() else None
    return state.load_config(DEFAULTS, text(global_file), text(project), KINDS, name=name, sha256=sha256, valid=VALID)


def study(done: DataFrame, use: argparse.Namespace, now: Column) -> DataFrame:
    """done with empty sections for notes and the study fields in front of its text."""
    given = {k: v for k, v in {"tags": F.array(*(F.lit(t) for t in use.tag)) if use.tag else None, "reading_status": F.lit(use.reading_status) if use.reading_status else None}.items() if v is not None}
    block = structure.study_block(structure.study_fields(given, {}, now, use.reset_study))
    text = structure.study_sections(F.col("clean_text"))
    return done.withColumn("clean_text", F.when(block.isNotNull(), structure.prepend_front_matter(text, {"study": block})).otherwise(text))


def convert(use: argparse.Namespace, spark: SparkSession) -> int:
    values, _, notes = configuration(use.config or None)
    for note in notes:
        print(note, file=sys.stderr)
    pick = lambda k: getattr(use, k) or values[k]
    if use.reading_status and use.reading_status not in structure.READING_STATUSES:
        raise ValueError(f"not a reading status: {use.reading_status}")
    files, now = sources(spark, use.path, use.ext), F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    chosen = [c.name for c in cleaners.choose(cleaners.default_cleaners(), names(pick("only")), names(pick("skip")))]
    options = {"pages": pick("pages"), "only": pick("only"), "skip": pick("skip"), "chapter": pick("chapter"), "max_bytes": values["max_bytes"], "seconds": values["seconds"], "offset": use.page_offset, "words": use.words, "keep_going": use.keep_going, "chapters": use.chapters}
    key = state.cache_key(F.col("sha256"), F.lit(f"{options['pages']}|{options['chapter']}|{options['chapters']}|{use.page_offset}|{use.toc}"), F.lit(state.cleaner_snapshot(chosen)), F.lit(__version__))
    cached = None
    if use.cache and use.chapters:
        raise ValueError("a cache keeps files whole or one chapter of them, not chapters")
    if use.cache and not use.dry_run:
        cache = state.load_cache(spark, use.cache)
        keyed = files.withColumn("key", key)
        cached = state.from_cache(keyed.select("path", "sha256", "format", "key"), cache, __version__)
        files = state.work_list(keyed, cache, __version__).drop("key")
    done = report(converted(spark, use.path, files=files, **options))
    if use.dry_run:
        print(json.dumps(structure.dry_run(done)["columns"]))
        return 0
    if use.toc or values["toc"]:
        done = structure.inject_toc(done, doc="path", text_col="clean_text")
    if use.study:
        done = study(done, use, now)
    done = done.withColumn("exit_code", errors.exit_code(F.col("status")))
    if cached is not None:
        hits = cached.select("path", "sha256", "format", F.lit("ok").alias("status"), F.col("markdown").alias("clean_text"), F.lit(0).alias("exit_code"))
        done = done.unionByName(hits, allowMissingColumns=True)
    done.write.mode("overwrite" if use.force else "error").parquet(use.out)
    written = spark.read.parquet(use.out)
    good = written.where("status = 'ok'")
    if use.cache:
        state.save_cache(good.where("stats is not null").select(key.alias("key"), F.lit(__version__).alias("version"), now.alias("created_at"), F.col("clean_text").alias("markdown"), F.lit(None).cast("string").alias("front_matter"), F.lit(None).cast("array<struct<sha256:string,name:string>>").alias("images")), use.cache)
    if use.registry:
        toc = readers.outlines(sources(spark, use.path, use.ext) if use.path != "-" else files).where("status = 'ok'").groupBy("sha256").agg(F.transform(F.array_sort(F.collect_list(F.struct("index", "level", "title", F.col("start_page").alias("page")))), lambda x: F.struct(x["level"].alias("level"), x["title"].alias("title"), x["page"].alias("page"))).alias("toc"))
        seen = good.join(toc, "sha256", "left").select("sha256", book(F.col("path")).alias("title"), "format", F.greatest(F.lit(1), F.coalesce("pages", F.lit(1))).cast("int").alias("pages_total"), F.coalesce("toc", F.array().cast(state.TOC)).alias("toc"), F.col("toc").isNotNull().alias("toc_from_outline"), F.col("path").alias("source_path"), now.alias("registered_at"), now.alias("last_seen_at"), F.lit(1).cast("long").alias("run_count"))
        state.save_registry(spark, use.registry, seen)
    if use.tree:
        label = F.coalesce(F.nullif(F.regexp_extract("path", r"#(chapter-\d+)\z", 1), F.lit("")), F.lit(structure_label(options["pages"], options["chapter"])))
        structure.write_tree(tree(good, label, now, chosen, use.raw, use.split), f"{use.out.rstrip('/')}-tree", use.force).write.mode("overwrite").parquet(f"{use.out.rstrip('/')}-tree-manifest")
    worst, warned = written.agg(F.max("exit_code"), F.max(F.size("warnings"))).first()
    for r in quality.summary(written.select(F.when(F.col("exit_code") == 0, "ok").otherwise("failed").alias("status"))).collect():
        print(f"{r['status']}: {r['n']}", file=sys.stderr)
    code = worst or (errors.STRICT if use.strict and (warned or 0) > 0 else 0)
    after(pick("post"), use.out, code, use.post_seconds)
    return code


def structure_label(pages: str, chapter: str) -> str:
    return f"chapter-{chapter}" if chapter else f"pages-{pages}" if pages else "full"


def after(command: str, out: str, code: int, seconds: int) -> None:
    """Run the command that is to follow; a failure is told, not raised."""
    if command:
        ended, said = hook(command, {**os.environ, "QUIRE_OUT": out, "QUIRE_STATUS": str(code)}, seconds)
        if ended:
            print(f"post command: {ended}\n{said}", file=sys.stderr)


def main(args: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    use = parser().parse_args(args)
    if use.command == "version":
        print(__version__)
        return 0
    if use.command == "config":
        values, origin, notes = configuration(use.file, use.global_file, use.name, use.sha256)
        print(json.dumps({"values": values, "origin": origin, "warnings": notes}, sort_keys=True))
        return 0
    if use.path != "-" and not Path(use.path).exists() and "://" not in use.path:
        print(f"not found: {use.path}", file=sys.stderr)
        return errors.SOURCE_NOT_FOUND
    spark = spark or local_session()
    if use.command in ("convert", "batch"):
        return convert(use, spark)
    if use.command == "watch":
        while True:
            options = {"settle": use.settle, "attempts": use.attempts}
            left = watch.settle_waiting(spark, use.out, use.state, **options)
            watch.watch(spark, use.path, use.out, use.state, use.glob, archive=use.archive, **options).awaitTermination()
            after(use.post, use.out, 0, use.post_seconds)
            if use.once:
                return 0
            time.sleep(max(use.poll, use.settle if left else 0))
    if use.command == "toc":
        found = structure.headings(converted(spark, use.path), 1, 6, "path", "clean_text").orderBy("path", "ord")
        for r in found.toLocalIterator():
            print("  " * (r["level"] - 1) + r["title"])
    elif use.command == "outline":
        for r in structure.outline_tree(readers.outlines(readers.read_files(spark, use.path)).where("status = 'ok'"), "path").orderBy("path").toLocalIterator():
            print(f"{r['path']}\n{r['tree']}")
    elif use.command == "figures":
        kept = figures.kept_from_files(readers.read_files(spark, use.path), select.parse_dimensions(use.least))
        written = structure.write_tree(kept.select(F.concat(book(F.col("path")), F.lit("/"), F.col("name")).alias("path"), "content"), use.out, use.force)
        for r in written.orderBy("path").toLocalIterator():
            print(f"{r['path']} {r['status']}")
    elif use.command == "inspect":
        pages = readers.extract(readers.read_files(spark, use.path)).where("status = 'ok'")
        entries = readers.outlines(readers.read_files(spark, use.path)).where("status = 'ok' and index <= 20").groupBy("path").agg(F.count("*").alias("outline_entries"))
        for line in quality.inspection(pages, doc="path").join(entries, "path", "left").toJSON().toLocalIterator():
            print(line)
    else:
        both = converted(spark, use.path).select("path", F.expr("stack(2, 'raw', text, 'clean', clean_text) as (engine, t)"), "status")
        for line in quality.compare(both.select("path", "engine", F.when(F.col("status") == "ok", "ok").otherwise("error").alias("status"), F.regexp_count("t", F.lit(r"\S+")).alias("words")), "path").toJSON().toLocalIterator():
            print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main())
