"""Quality rules: base statistics and a learned decision list, all in native expressions."""

from __future__ import annotations

import bisect
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, table

#: What rules may test. Ratios of a text without words or characters are 0.
FEATURE_SQL = {
    "n_words": "cast(n_words as double)",
    "word_length": "if(n_words = 0, 0d, word_chars / n_words)",
    "symbols": "if(n_words = 0, 0d, n_symbols / n_words)",
    "dup_lines": "if(n_lines = 0, 0d, n_dup_lines / n_lines)",
    "repeats": "if(n_words = 0, 0d, n_repeat_words / n_words)",
    "capitals": "if(word_chars = 0, 0d, n_capitals / word_chars)",
    "shouts": "if(n_words = 0, 0d, n_shouts / n_words)",
    "words_per_line": "if(n_lines = 0, 0d, n_words / n_lines)",
}


#: Columns that filter_quality adds.
NEW = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_shouts", "base_failed", "kept")


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the base statistics of each text added; null texts count as empty.

    Three-word windows are found by hash; where a window repeats, the sorted (hash, place) pairs give the places of
    equal windows, and the words that those cover are counted once each. Everything stays within the row.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    windows = "transform(sequence(0, size(__q_w) - 3), i -> xxhash64(__q_w[i], __q_w[i + 1], __q_w[i + 2]))"
    placed = "array_sort(transform(__q_h, (x, i) -> struct(x as h, i as i)))"
    twice = "filter(transform(__q_s, (x, j) -> if((j > 0 and __q_s[if(j > 0, j - 1, 0)].h = x.h) or (j + 1 < size(__q_s) and __q_s[if(j + 1 < size(__q_s), j + 1, j)].h = x.h), x.i, -1)), p -> p >= 0)"
    covered = "aggregate(array_sort(__q_p), struct(-3 as last, 0 as n), (a, p) -> struct(p as last, a.n + least(3, p - a.last) as n), a -> a.n)"
    return (
        docs.withColumn("__q_t", t)
        .withColumn("__q_w", words("__q_t"))
        .withColumn("__q_l", F.filter(F.split("__q_t", "\n"), lambda x: x.rlike(rf"[^{WHITE}]")))
        .withColumn("__q_h", F.expr(f"if(size(__q_w) < 3, cast(array() as array<bigint>), {windows})"))
        .withColumn("__q_s", F.expr(f"if(size(array_distinct(__q_h)) = size(__q_h), null, {placed})"))
        .withColumn("__q_p", F.expr(twice))
        .withColumns(
            {
                "n_words": F.size("__q_w").cast("long"),
                "word_chars": (F.char_length("__q_t") - F.regexp_count("__q_t", F.lit(rf"[{WHITE}]"))).cast("long"),
                "n_symbols": F.regexp_count("__q_t", F.lit(r"[#*$%&|<>]")).cast("long"),
                "n_lines": F.size("__q_l").cast("long"),
                "n_dup_lines": (F.size("__q_l") - F.size(F.array_distinct("__q_l"))).cast("long"),
                "n_repeat_words": F.coalesce(F.expr(covered), F.lit(0)).cast("long"),
                "n_capitals": F.regexp_count("__q_t", F.lit(r"\p{Lu}")).cast("long"),
                "n_shouts": F.regexp_count("__q_t", F.lit("!")).cast("long"),
            }
        )
        .drop("__q_t", "__q_w", "__q_l", "__q_h", "__q_s", "__q_p")
    )


def words(col: str) -> Column:
    """The words of a text: what white space of ASCII separates."""
    bare = F.btrim(F.col(col), F.lit(" \t\n\x0b\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, rf"[{WHITE}]+"))


def base_failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # value > threshold, else value <= threshold
    threshold: float

    def holds(self, row: dict) -> bool:
        return (row[self.feature] > self.threshold) == self.above

    def column(self) -> Column:
        value = F.expr(FEATURE_SQL[self.feature])
        return value > self.threshold if self.above else value <= self.threshold


Rule = tuple[Condition, ...]


def learn(rows: Sequence[tuple[dict, bool]], precision: float = 0.9, most_rules: int = 12, most_conditions: int = 4, cuts: int = 24) -> list[Rule]:
    """A decision list for the rows to reject, by sequential covering.

    Each rule grows on two thirds of the rows by the condition of the highest FOIL gain, is pruned from its end on the
    other third, and stays only if it is as precise there as asked; what it covers leaves both parts. Thresholds are
    quantiles of the rows to reject and to keep.
    """
    names = list(FEATURE_SQL)
    grow, prune = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if not i % 3]

    def count(part: list, rule: Rule) -> tuple[int, int]:
        hit = [bad for x, bad in part if all(c.holds(x) for c in rule)]
        return sum(hit), len(hit) - sum(hit)

    def candidates(part: list) -> list[Condition]:
        out = []
        for f in names:
            at = set()
            for bad in (False, True):
                v = sorted(x[f] for x, y in part if y == bad)
                at |= {v[len(v) * k // cuts] for k in range(cuts)} if v else set()
            out += [Condition(f, above, t) for t in sorted(at) for above in (True, False)]
        return out

    rules: list[Rule] = []
    while len(rules) < most_rules and sum(y for _, y in grow) >= 3:
        rule: Rule = ()
        part, tried = grow, candidates(grow)
        while len(rule) < most_conditions:
            p0 = sum(y for _, y in part)
            if p0 == len(part):
                break
            before, best, gain = math.log2(p0 / len(part)), None, 1e-9
            for f in names:
                of = sorted((x[f], y) for x, y in part)
                total, n = p0, len(of)
                below = {}
                pos = 0
                for i, (v, y) in enumerate(of):
                    pos += y
                    below[v] = (pos, i + 1)
                keys = sorted(below)
                for c in tried:
                    if c.feature != f:
                        continue
                    k = bisect.bisect_right(keys, c.threshold)
                    p, m = below[keys[k - 1]] if k else (0, 0)
                    if c.above:
                        p, m = total - p, n - m
                    if p and (g := p * (math.log2(p / m) - before)) > gain:
                        best, gain = c, g
            if best is None:
                break
            rule += (best,)
            part = [r for r in part if best.holds(r[0])]
        if not rule:
            break

        def worth(r: Rule) -> float:
            p, n = count(prune, r)
            return (p - n) / (p + n) if p + n else -1.0

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        p, n = count(prune, rule)
        if not p or p / (p + n) < precision:
            break
        rules.append(rule)
        grow = [r for r in grow if not all(c.holds(r[0]) for c in rule)]
        prune = [r for r in prune if not all(c.holds(r[0]) for c in rule)]
    return rules


def verdict(rules: Sequence[Rule]) -> Column:
    """The decision list as one conditional expression: true keeps."""
    out = F.lit(True)
    for rule in reversed(rules):
        hit = rule[0].column()
        for c in rule[1:]:
            hit = hit & c.column()
        out = F.when(hit, F.lit(False)).otherwise(out)
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 4096) -> list[Rule]:
    """Learn from at most `sample` labelled documents, those with the smallest hashes of their ids.

    Labels and ids that are null count as missing. Without both classes there are no rules, and everything is kept.
    """
    some = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), (F.col(label_col) == 0).alias("_bad")).orderBy(F.xxhash64("_id"), "_id", "_bad").limit(sample)
    few = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(some), "_id")
    few = few.orderBy(F.xxhash64("_id"), "_id", F.xxhash64("_text")).limit(sample)
    rows = statistics(few, "_text").select("_id", "_bad", *(F.expr(x).alias(f"f_{n}") for n, x in FEATURE_SQL.items())).orderBy("_id", *(f"f_{n}" for n in FEATURE_SQL)).collect()
    return learn([({f: r[f"f_{f}"] for f in FEATURE_SQL}, r["_bad"]) for r in rows])


def filter_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the statistics, base_failed and kept added.

    Null texts have no words and fail the base rules. Equal rows get equal verdicts. Very long texts are judged whole; their
    words are held as arrays within the row. Statistics, base_failed and kept replace columns of these names, all others
    stay. An empty table gives an empty result; labels without matching documents give no rules.
    """
    rules = fit(docs, labels, id_col, text_col)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text_col).alias("_text"))
    judged = statistics(rows, "_text").withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))
    return judged.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns if c.lower() not in NEW), *NEW)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and verdict of every document."""
    out = filter_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op6_quality_rules": op6_quality_rules}
ORACLE_SQL: dict[str, str] = {}
