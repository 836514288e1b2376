"""Sharding by rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import table


def score(key: Column, shard: int, weight: float, equal: bool) -> Column:
    """What a shard bids for a key: -weight / ln(u), or with equal weights just u, which has the same order."""
    u = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11)
    # The largest u are held below 1, where the logarithm would be 0.
    return u if equal else F.lit(-float(weight)) / F.log(F.least((u.cast("double") + 0.5) / F.lit(2.0**53), F.lit(1.0 - 2.0**-53)))


def rendezvous(key: Column, weights: Sequence[float]) -> tuple[Column, Column]:
    """(best bid, shard): the shard that bids most for the key, the smaller number on equal bids."""
    equal = len(set(weights)) == 1
    bids = F.array_max(F.array(*(F.struct(score(key, s, w, equal).alias("bid"), F.lit(-s).alias("shard")) for s, w in enumerate(weights))))
    return bids["bid"], -bids["shard"]


def shard(docs: DataFrame, weights: Sequence[float], grown: float | None = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's shard, slot and the shard that it would have with one more shard.

    The key (id_col as text; null counts as a key of its own) and the weights decide; more shards take rows only into
    the new ones. Slots run from 0 without gaps in each shard: rows are numbered within (shard, bucket of the key) and
    shifted by the counts of the buckets before, so no task takes a whole shard; the broadcast table has one row for
    each shard and bucket. Null texts count no bytes and have the checksum of the empty text. Equal rows lie in one
    shard in slots of their own; very long texts count whole. An empty table gives an empty result. Columns besides the two
    named are not read.
    """
    if not weights or any(not w > 0 or math.isinf(w) for w in weights):
        raise ValueError("weights must be positive and finite")
    key = F.coalesce(F.col("key").cast("string"), F.lit("null"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("key"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    bid, best = rendezvous(key, weights)
    rows = rows.select("*", bid.alias("bid"), best.cast("int").alias("shard"))
    if grown is None:
        rows = rows.withColumn("grown_shard", F.lit(None).cast("int"))
    elif len({*weights, grown}) == 1:
        rows = rows.withColumn("grown_shard", F.when(score(key, len(weights), grown, True) > F.col("bid"), F.lit(len(weights))).otherwise(F.col("shard")))
    else:
        rows = rows.withColumn("grown_shard", rendezvous(key, [*weights, grown])[1].cast("int"))
    buckets = max(1, min(4096, math.ceil(docs.count() / 200_000)))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(key, "text_crc32"), F.lit(buckets)).cast("int"))
    before = rows.groupBy("shard", "bucket").count().select("shard", "bucket", (F.sum("count").over(W.partitionBy("shard").orderBy("bucket")) - F.col("count")).alias("before"))
    number = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("key", "text_crc32", "size"))
    rows = rows.join(F.broadcast(before), ["shard", "bucket"])
    return rows.select(F.col("key").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + number - 1).cast("long").alias("slot"), "grown_shard")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 24 shards of equal weight, by doc_id."""
    return shard(table(spark, sf_dir, "documents"), [1.0] * 24)


QUERIES = {"op9_sharding": op9_sharding}
ORACLE_SQL: dict[str, str] = {}
