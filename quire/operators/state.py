"""Keyed state: cache keys, work lists, and the registry of documents, as tables that are merged."""

from __future__ import annotations

import json
import os
import tomllib
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def cleaner_snapshot(enabled: Sequence[str] = (), disabled: Sequence[str] = (), pipeline: Sequence[str] = ()) -> str:
    """The configuration of cleaners as canonical JSON; the order of names doesn't count."""
    return json.dumps({"enabled": sorted(enabled), "disabled": sorted(disabled), "pipeline": sorted(pipeline)}, sort_keys=True, separators=(",", ":"))


def cache_key(content: Column, pages: Column, snapshot: Column, version: Column) -> Column:
    """The digest of four digests: content, page range, cleaners, version."""
    parts = [F.sha2(F.coalesce(c, F.lit("")).cast("binary"), 256) for c in (content, pages, snapshot, version)]
    return F.sha2(F.concat_ws("|", *parts), 256)


def work_list(keyed: DataFrame, cache: DataFrame, version: str, key: str = "key") -> DataFrame:
    """Rows without an entry of this version in the cache."""
    return keyed.join(cache.where(F.col("version") == version).select(key), key, "left_anti")


def from_cache(keyed: DataFrame, cache: DataFrame, version: str, key: str = "key") -> DataFrame:
    return keyed.join(cache.where(F.col("version") == version).drop("version"), key)


#: While this is set to 1, nothing is taken from a cache or put into one.
KILL_SWITCH = "QUIRE_NO_CACHE"
ENTRY = "key string, version string, created_at string, markdown string, front_matter string, images array<struct<sha256:string,name:string>>"


def cache_is_on(env: Mapping[str, str] | None = None) -> bool:
    return (os.environ if env is None else env).get(KILL_SWITCH, "") not in ("1", "true", "yes")


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one of that schema where there is none yet. Columns that it lacks are null."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def load_cache(spark: SparkSession, folder: str, env: Mapping[str, str] | None = None) -> DataFrame:
    """Entries of a cache: none while the kill switch is on; those without a key of 64 hexadecimal digits or without text don't count."""
    rows = read_table(spark, f"{folder}/entries", ENTRY)
    return rows.where(F.col("key").rlike(r"\A[0-9a-f]{64}\z") & F.col("markdown").isNotNull()) if cache_is_on(env) else rows.where("false")


def save_cache(entries: DataFrame, folder: str, images: DataFrame | None = None, env: Mapping[str, str] | None = None) -> None:
    """Append entries (as ENTRY) that the cache lacks, one for each key and version, and images (sha256, content) that are new."""
    if not cache_is_on(env):
        return
    spark = entries.sparkSession
    names = [x.split()[0] for x in ENTRY.split(", ")]
    known = load_cache(spark, folder, env).select("key", "version")
    entries.select(names).dropDuplicates(["key", "version"]).join(known, ["key", "version"], "left_anti").select(names).write.mode("append").parquet(f"{folder}/entries")
    if images is not None:
        there = read_table(spark, f"{folder}/blobs", "sha256 string, content binary").select("sha256")
        images.select("sha256", "content").dropDuplicates(["sha256"]).join(there, "sha256", "left_anti").select("sha256", "content").write.mode("append").parquet(f"{folder}/blobs")


RECORD = ("title", "format", "pages_total", "toc", "toc_from_outline", "source_path")


def upsert(registry: DataFrame, seen: DataFrame) -> DataFrame:
    """The registry with what was seen: first registration kept, the latest record's fields, runs counted.

    Both have sha256, registered_at, last_seen_at, run_count and fields of a record; keys that aren't 64 hexadecimal
    digits go. One aggregation, so a document that is seen in very many runs is combined before the shuffle.
    """
    fields = [f for f in RECORD if f in registry.columns]
    rows = registry.unionByName(seen).where(F.col("sha256").rlike(r"\A[0-9a-f]{64}\z"))
    agg = rows.groupBy("sha256").agg(F.min("registered_at").alias("registered_at"), F.max("last_seen_at").alias("last_seen_at"), F.sum("run_count").cast("long").alias("run_count"), F.max(F.struct("last_seen_at", *fields)).alias("r"))
    return agg.select("sha256", "registered_at", "last_seen_at", "run_count", *(F.col(f"r.{f}").alias(f) for f in fields))


def save_registry(spark: SparkSession, folder: str, seen: DataFrame) -> DataFrame:
    """The registry in folder with what was seen, written as its next version; the one before stays until the new one is whole."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    last = max((int(s.getPath().getName()[2:]) for s in fs.listStatus(at) if s.getPath().getName().startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))), default=0) if fs.exists(at) else 0
    before = read_table(spark, f"{folder}/v={last}", REGISTRY)
    upsert(before, seen).write.mode("overwrite").parquet(f"{folder}/v={last + 1}")
    return read_table(spark, f"{folder}/v={last + 1}", REGISTRY)


TOC = "array<struct<level:int,title:string,page:int>>"
REGISTRY = f"sha256 string, title string, format string, pages_total int, toc {TOC}, toc_from_outline boolean, source_path string, registered_at string, last_seen_at string, run_count long"
KNOWN_FORMATS = ("pdf", "epub", "docx", "pptx", "xlsx", "other")


def valid_record() -> Column:
    """Whether a row of REGISTRY is one: digest, title, format, counts of 1 or more, and each entry of its outline."""
    toc = F.coalesce("toc", F.array().cast(TOC))
    entries = F.forall(toc, lambda t: (t["level"] >= 1) & (t["page"] >= 1) & F.coalesce(F.trim(t["title"]) != "", F.lit(False)))
    fields = F.col("sha256").rlike(r"\A[0-9a-f]{64}\z") & (F.col("title") != "") & F.col("format").isin(*KNOWN_FORMATS) & (F.col("pages_total") >= 1) & (F.col("run_count") >= 1)
    return F.coalesce(fields & F.col("registered_at").isNotNull() & F.col("last_seen_at").isNotNull() & entries, F.lit(False))


def registry_from_json(texts: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(records, dropped) of registries that are JSON objects of digests and records: what isn't such an object, and
    entries with wrong types or values, are dropped one by one, with the reason."""
    each = texts.select(F.from_json(text_col, "map<string,string>").alias("m"), F.col(text_col).alias("raw"))
    broken = each.where("m is null and raw is not null").select(F.lit(None).cast("string").alias("sha256"), F.lit("not an object").alias("reason"))
    rows = each.select(F.explode("m").alias("sha256", "json"))
    typed = lambda path, kind: F.get_json_object("json", f"$.{path}").try_cast(kind)
    whole = lambda path: F.when(F.get_json_object("json", f"$.{path}").rlike(r"\A\d+\z"), typed(path, "long"))
    record = rows.select("sha256", "json", *(typed(k, "string").alias(k) for k in ("title", "format", "source_path", "registered_at", "last_seen_at")), whole("pages_total").cast("int").alias("pages_total"), whole("run_count").alias("run_count"), typed("toc_from_outline", "boolean").alias("toc_from_outline"), F.from_json(F.get_json_object("json", "$.toc"), TOC).alias("toc"))
    judged = record.withColumn("good", valid_record())
    names = [x.split()[0] for x in REGISTRY.replace(TOC, "x").split(", ")]
    return judged.where("good").select(names), broken.union(judged.where("not good").select("sha256", F.lit("not a record")))


def lookup_toc(docs: DataFrame, registry: DataFrame) -> DataFrame:
    """docs with the table of contents of the registry; an empty one is a miss."""
    known = registry.where(F.size("toc") > 0).select("sha256", "toc")
    return docs.join(known, "sha256", "left")


def layered(*layers: Column) -> Column:
    """The value of the last layer that has one: defaults first."""
    return F.coalesce(*reversed(layers))


def env_layer(prefix: str, kinds: Mapping[str, Callable[[str], Any]], env: Mapping[str, str] | None = None) -> tuple[dict, list[str]]:
    """(values, warnings) of settings that the environment has as PREFIX_NAME, read by their kinds."""
    values, notes = {}, []
    for name, kind in kinds.items():
        raw = (os.environ if env is None else env).get(f"{prefix}_{name.upper()}")
        if raw is not None:
            try:
                values[name] = kind(raw)
            except ValueError as e:
                notes.append(f"{prefix}_{name.upper()}: {e}")
    return values, notes


def toml_layer(text: str | None, section: str | None = None) -> tuple[dict, list[str]]:
    """(values, warnings) of TOML, or of one of its tables; none where it can't be read."""
    if text is None:
        return {}, []
    try:
        table = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        return {}, [f"not TOML: {e}"]
    table = table.get(section, {}) if section else table
    return ({k: v for k, v in table.items() if not isinstance(v, dict) and not (isinstance(v, list) and any(isinstance(x, dict) for x in v))}, []) if isinstance(table, dict) else ({}, [f"{section} is not a table"])


def book_profile(text: str | None, name: str = "", sha256: str = "") -> tuple[dict, list[str]]:
    """The table among [[book]] of TOML whose sha256 is the document's, else the one whose name is in its file name, case ignored."""
    try:
        books = tomllib.loads(text or "").get("book", [])
    except tomllib.TOMLDecodeError as e:
        return {}, [f"not TOML: {e}"]
    books = [b for b in books if isinstance(b, dict)] if isinstance(books, list) else []
    by_hash = [b for b in books if sha256 and b.get("sha256") == sha256]
    by_name = [b for b in books if b.get("name") and str(b["name"]).lower() in name.lower()]
    return ({k: v for k, v in (by_hash or by_name)[0].items() if k not in ("name", "sha256")}, []) if by_hash or by_name else ({}, [])


def load_config(defaults: dict, global_text: str | None = None, project_text: str | None = None, kinds: Mapping[str, Callable[[str], Any]] | None = None, prefix: str = "QUIRE", env: Mapping[str, str] | None = None, name: str = "", sha256: str = "", valid: dict | None = None) -> tuple[dict, dict, list[str]]:
    """(values, which layer each is from, warnings): defaults, the global file, the project's, the environment, the book's profile."""
    layers, notes = [defaults], []
    for layer, said in (toml_layer(global_text), toml_layer(project_text), env_layer(prefix, kinds or {}, env), book_profile(project_text or global_text, name, sha256)):
        layers.append(layer)
        notes += said
    values, origin, more = merge_config(*layers, valid=valid)
    named = ("default", "global", "project", "env", "book")
    return values, {k: named[n] for k, n in origin.items()}, notes + more


def merge_config(*layers: dict, valid: dict | None = None) -> tuple[dict, dict, list[str]]:
    """(values, which layer each is from, warnings) of layers from defaults on; invalid values fall back to lower layers."""
    values, origin, notes = {}, {}, []
    for n, layer in enumerate(layers):
        for k, v in layer.items():
            if valid and k in valid and not valid[k](v):
                notes.append(f"{k}: {v!r} is not valid")
            elif v is not None:
                values[k], origin[k] = v, n
    return values, origin, notes
