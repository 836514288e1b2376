"""URL filters: rules on host and path, and gradient-boosted trees on lexical features for the rest."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str  # allow or block

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self) -> Column:
        host, path = F.col("host"), F.col("path")
        return ((host == self.host) | host.endswith(f".{self.host}")) & path.startswith(self.path)


#: The rules of op7.
RULES = (
    UrlRule("com", "/", "allow"),
    UrlRule("example.com", "/en/", "block"),
    UrlRule("www.example.com", "/en/", "allow"),
    UrlRule("net", "/es/", "block"),
    UrlRule("net", "/fr/", "block"),
)

#: Lexical features of a url; suffix_share is joined from the counts of all file suffixes.
FEATURE_SQL = {
    "length": "cast(char_length(__q_u) as double)",
    "host_length": "cast(char_length(host) as double)",
    "host_labels": "cast(regexp_count(host, '[.]') as double)",
    "hyphens": "cast(regexp_count(host, '-') as double)",
    "depth": "cast(regexp_count(path, '/') as double)",
    "digits": "if(__q_u = '', 0d, regexp_count(__q_u, '[0-9]') / char_length(__q_u))",
    "parameters": "if(locate('?', __q_u) = 0, 0d, 1d + regexp_count(substring_index(substring_index(__q_u, '#', 1), '?', -1), '[&;]'))",
    "entropy": "if(__q_u = '', 0d, aggregate(array_distinct(split(__q_u, '')), 0d, (a, c) -> if(c = '', a, a - ((char_length(__q_u) - char_length(replace(__q_u, c, ''))) / char_length(__q_u)) * log2(greatest(1, char_length(__q_u) - char_length(replace(__q_u, c, ''))) / char_length(__q_u)))))",
    "suffix_share": "coalesce(__q_share, 0d)",
}


def parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """pages with host and path. Null, or without ://, both are empty."""
    rest = F.when(F.locate("://", F.col(url_col)) > 0, F.expr(f"substr(`{url_col}`, locate('://', `{url_col}`) + 3)")).otherwise("")
    return (
        pages.withColumn("__q_rest", F.coalesce(rest, F.lit("")))
        .withColumn("host", F.translate(F.regexp_extract("__q_rest", r"\A([^/?#]*)", 1), UPPER, LOWER))
        .withColumn("path", F.regexp_extract("__q_rest", r"\A[^/?#]*([^?#]*)", 1))
        .drop("__q_rest")
    )


def rule_of(rules: Sequence[UrlRule]) -> tuple[Column, Column]:
    """(name, verdict) of the longest rule that fits, null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        name, verdict = F.when(r.fits(), F.lit(r.name)).otherwise(name), F.when(r.fits(), F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def suffix() -> Column:
    """The file suffix of the path. The host's is what rules test: with it, trees give every url of a host suffix the
    verdict of the rules that happen to name that suffix."""
    return F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]{1,8})\z", 1))


@dataclass
class Tree:
    """A node: a leaf has a value, else feature <= threshold goes left. Missing features do not occur."""

    value: float = 0.0
    feature: str | None = None
    threshold: float = 0.0
    left: Tree | None = None
    right: Tree | None = None

    def column(self) -> Column:
        if self.feature is None:
            return F.lit(self.value)
        return F.when(F.col(f"f_{self.feature}") <= self.threshold, self.left.column()).otherwise(self.right.column())

    def of(self, row: dict) -> float:
        return self.value if self.feature is None else (self.left if row[self.feature] <= self.threshold else self.right).of(row)


@dataclass
class Model:
    """Log odds of block: bias plus the trees."""

    bias: float
    trees: list[Tree]

    def column(self) -> Column:
        out = F.lit(self.bias)
        for t in self.trees:
            out = out + t.column()
        return out

    def of(self, row: dict) -> float:
        return self.bias + sum(t.of(row) for t in self.trees)


def boost(rows: Sequence[tuple[dict, bool]], rounds: int = 24, depth: int = 3, rate: float = 0.3, cuts: int = 16, ridge: float = 1.0, least: int = 8) -> Model:
    """Newton boosting of the logistic loss over binned features. Both classes get equal weight: how many urls rules
    allow or block says nothing about the others."""
    n, pos = len(rows), sum(y for _, y in rows)
    if not n or pos in (0, n):
        return Model(-20.0 if not pos else 20.0, [])
    names = list(FEATURE_SQL)
    edges = {f: sorted({(v := sorted(x[f] for x, _ in rows))[n * k // cuts] for k in range(1, cuts)}) for f in names}
    bins = {f: [sum(e < x[f] for e in edges[f]) for x, _ in rows] for f in names}
    y = [1.0 if b else 0.0 for _, b in rows]
    weight = [n / (2 * pos) if b else n / (2 * (n - pos)) for _, b in rows]
    score = [bias := 0.0] * n
    trees = []

    def grow(at: list[int], g: list[float], h: list[float], left: int) -> Tree:
        sg, sh = sum(g[i] for i in at), sum(h[i] for i in at)
        best, gain = None, 1e-6
        if left and len(at) >= 2 * least:
            for f in names:
                b, m = bins[f], len(edges[f]) + 1
                bg, bh, bn = [0.0] * m, [0.0] * m, [0] * m
                for i in at:
                    k = b[i]
                    bg[k] += g[i]
                    bh[k] += h[i]
                    bn[k] += 1
                lg = lh = ln = 0
                for k in range(m - 1):
                    lg, lh, ln = lg + bg[k], lh + bh[k], ln + bn[k]
                    if least <= ln <= len(at) - least:
                        won = lg * lg / (lh + ridge) + (sg - lg) ** 2 / (sh - lh + ridge) - sg * sg / (sh + ridge)
                        if won > gain:
                            best, gain = (f, k), won
        if best is None:
            return Tree(value=rate * sg / (sh + ridge))
        f, k = best
        return Tree(feature=f, threshold=edges[f][k], left=grow([i for i in at if bins[f][i] <= k], g, h, left - 1), right=grow([i for i in at if bins[f][i] > k], g, h, left - 1))

    for _ in range(rounds):
        p = [1 / (1 + math.exp(-s)) for s in score]
        trees.append(tree := grow(list(range(n)), [w * (a - b) for w, a, b in zip(weight, y, p, strict=True)], [w * b * (1 - b) for w, b in zip(weight, p, strict=True)], depth))
        score = [s + tree.of(x) for s, (x, _) in zip(score, rows, strict=True)]
    return Model(bias, trees)


@dataclass(frozen=True)
class Shares:
    """Shares of file suffixes among all rows, (_suffix, _share): of those that a 1024th of the rows or more have, at most
    1024, and of all others where there are any."""

    frequent: DataFrame
    rare: DataFrame | None


def suffix_shares(pages: DataFrame, one_in: int = 1024) -> Shares:
    """pages has a path."""
    counts = pages.groupBy(suffix().alias("_suffix")).agg(F.count("*").alias("_n"))
    total = pages.count()
    shares = counts.select("_suffix", "_n", (F.col("_n") / F.lit(max(1, total))).alias("_share"))
    rare = shares.where(F.col("_n") * one_in < total).select("_suffix", "_share")
    return Shares(shares.where(F.col("_n") * one_in >= total).select("_suffix", "_share"), None if rare.isEmpty() else rare)


def featured(rows: DataFrame, shares: Shares) -> DataFrame:
    """rows (url, host, path and others) with the features as f_ columns. Frequent suffixes come by a broadcast, the rows of others by a join."""
    rows = rows.withColumn("_suffix", suffix()).join(F.broadcast(shares.frequent), "_suffix", "left")
    if shares.rare is not None:
        rest = rows.where("_share is null").drop("_share").join(shares.rare, "_suffix", "left")
        rows = rows.where("_share is not null").unionByName(rest)
    return rows.withColumn("__q_u", F.coalesce("url", F.lit(""))).withColumnRenamed("_share", "__q_share").select("*", *(F.expr(x).alias(f"f_{n}") for n, x in FEATURE_SQL.items()))


def fit(labelled: DataFrame, shares: Shares, sample: int = 4096) -> Model:
    """Train on at most `sample` distinct labelled urls (url, host, path, _block), those with the smallest hashes."""
    some = labelled.select("url", "host", "path", "_block").distinct().orderBy(F.xxhash64("url"), "url").limit(sample)
    rows = featured(some, shares).orderBy("url").collect()
    return boost([({f: r[f"f_{f}"] for f in FEATURE_SQL}, r["_block"]) for r in rows])


def judged(pages: DataFrame, rules: Sequence[UrlRule] = RULES, url_col: str = "url") -> tuple[DataFrame, Model]:
    """(row, url, host, path, rule, verdict of the rule, features) of pages, and the trees."""
    rows = parts(pages.select(F.struct(*pages.columns).alias("_row"), F.col(url_col).alias("url")))
    name, verdict = rule_of(rules)
    rows = rows.withColumn("rule", name).withColumn("verdict", verdict)
    shares = suffix_shares(rows.select("path"))
    model = fit(rows.where("rule is not null").withColumn("_block", F.col("verdict") == "block"), shares)
    return featured(rows, shares), model


def filter_urls(pages: DataFrame, rules: Sequence[UrlRule] = RULES, url_col: str = "url", odds: float = 4.0) -> DataFrame:
    """pages with host, path, rule and verdict: the longest fitting rule's, else that of trees trained on the urls which rules label, where block needs the odds given.

    Null urls, and those without ://, have an empty host and path, which no rule fits; the trees judge them. Equal urls
    get equal verdicts; very long ones are read whole. Without labelled urls of both kinds the trees say what the one kind
    is, or allow. An empty table gives an empty result. Columns named host, path, rule or verdict are replaced, all others
    stay, whatever their names.
    """
    rows, model = judged(pages, rules, url_col)
    verdict = F.coalesce("verdict", F.when(model.column() > math.log(odds), F.lit("block")).otherwise("allow"))
    new = ("host", "path", "rule", "verdict")
    return rows.withColumn("verdict", verdict).select(*(F.col("_row").getField(c).alias(c) for c in pages.columns if c.lower() not in new), *new)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts for every page's url."""
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op7_url_filter": op7_url_filter}
ORACLE_SQL: dict[str, str] = {}
