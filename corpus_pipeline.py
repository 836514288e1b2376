"""From raw documents to packed sequences: quality rules, near-duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import Scratch, table
from quire.llm.ngram_join import jaccard_components
from quire.llm.packing import pack
from quire.llm.quality import filter_quality
from quire.llm.substring_dedup import without_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the rules learnt from labels keep; null and empty texts go, equal rows fare alike.

    A row's columns travel as one struct, so none is taken for a statistic. A filter on the verdicts would be pushed below
    the statistics, and evaluate them again for each mention; a column that isn't deterministic keeps it above. Very long
    texts are judged whole. An empty table stays empty.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")
    judged = filter_quality(rows, table(spark, sf_dir, "labels")).select("row", "kept", F.monotonically_increasing_id().alias("n"))
    return judged.where("kept and n >= 0").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents whose five-word shingles agree by 80 % or more, the one with the smallest id.

    Rows with a null id stay, and so do texts that are null or have no words, and all rows of an id that stays. Very long
    texts are compared whole. An empty table stays empty.
    """
    gone = jaccard_components(docs, words=5, num=80, den=100).where(F.col("component_id") < F.col("doc_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words or more that an earlier one has; their numbers of characters follow.

    All rows stay, also those whose whole text is a repeat, which is empty then. Null texts and rows with a null id stay as
    they are; rows of one id lose their own repeats only. Very long texts are searched whole. An empty table stays empty.
    """
    return without_repeats(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids.

    Null and empty texts have the end id only; equal rows are packed one by one; very long texts fill sequences of their
    own. An empty table gives no pieces.
    """
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packing", packing),
]
#: Learned rules, chains and packing are beyond SQL; tests/llm compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between them is in the scratch folder."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
