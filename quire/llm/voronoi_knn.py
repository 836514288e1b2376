"""Exact top-k by inner product: a Voronoi join.

Vectors go to their nearest pivot. Summaries of the cells (count, radius) give each cell of queries a score that its
queries' k best reach for certain; a vector is sent to the cells of queries where its own bound is not below that, and
each cell is solved locally. By Cauchy-Schwarz, for a query within R of pivot p and a vector v, q.v <= p.v + R |v|.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Scratch, map_runs, table

#: Room for rounding when bounds, which are doubles, are compared.
SLACK = 1e-9


def _read(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, "<i4" if len(raw) == 4 * dim else "<i8").astype(np.float64)


def _nearest(v: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.sqrt(np.maximum(0, (v * v).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * v @ pivots.T))
    at = d.argmin(1)
    return at, np.linalg.norm(v - pivots[at], axis=1)


def best(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, ids, scores) of each query's k best of some vectors, ties to smaller ids. Integer scores are exact: where
    doubles can't hold them, Python's integers are used, kept within the range of a long."""
    exact = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * max(1, vectors.shape[1]) < 2**53
    if not exact:
        queries, vectors = (np.array([[int(x) for x in row] for row in m], object) for m in (queries, vectors))
    for r in range(len(queries)):
        s = vectors @ queries[r]
        if not exact:
            s = np.array([max(-(2**63), min(2**63 - 1, x)) for x in s], np.int64)
        use = np.flatnonzero(ids != own[r])
        s, i = s[use], ids[use]
        if len(s) > k:
            least = np.partition(s, len(s) - k)[len(s) - k]
            keep = s >= least
            s, i = s[keep], i[keep]
        order = np.lexsort((i, -s if exact else ~s))[:k]
        yield r, i[order], s[order].astype(np.int64)


def quantised(vectors: DataFrame, id_col: str, vector_col: str, query: Column, scale: int = 256) -> DataFrame:
    """(id, query, dim, vec) with floor(scale * x), of rows that take part."""
    x = F.transform(F.col("v").cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))).cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.coalesce(query, F.lit(False)).alias("query"), F.col(vector_col).alias("v"))
    rows = rows.where("id is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('Infinity'))").select("id", "query", x.alias("v"))

    def binary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, dims = [], []
            for v in batch.column(2).to_pylist():
                a = np.clip(np.array(v, np.float64), -(2.0**62), 2.0**62)
                raw.append(a.astype("<i4" if np.abs(a).max() < 2**31 else "<i8").tobytes())
                dims.append(len(v))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())], names=["id", "query", "dim", "vec"])

    return rows.mapInArrow(binary, "id long, query boolean, dim int, vec binary")


def top_k(vectors: DataFrame, query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, queries_a_pivot: int = 64, most_pivots: int = 256, block: int = 32768, queries_a_block: int = 1024) -> DataFrame:
    """The k best other vectors of each row that `query` marks, by the inner product of floor(scale * x).

    Null vectors, empty ones, and those with null or non-finite components take no part, nor do rows with a null id.
    Vectors are compared within one dimension. Components beyond 2^62 are held there, and scores are kept within a long.
    Equal query rows count once; rows of a query's id are no candidates of it; other repeated rows are candidates each.
    Fewer than k candidates give fewer rows. An empty table, or no query, gives an empty result. Other columns are not read.

    Pivots are the queries with the smallest hashes of their ids, at most most_pivots. A block holds about `block`
    vectors and queries_a_block queries; larger cells are split by hashes of ids.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = scratch.keep(quantised(vectors, id_col, vector_col, query, scale), "rows")
    sizes = {r["dim"]: (r["n"], r["nq"]) for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if("query").alias("nq")).collect()}
    wanted = max(1, min(most_pivots, sum(q for _, q in sizes.values()) // queries_a_pivot))
    chosen = rows.where("query").orderBy(F.xxhash64("id"), "id").limit(wanted).select("dim", "vec").collect()
    pivots = {d: np.unique(np.stack(v), axis=0) if (v := [_read(r["vec"], d) for r in chosen if r["dim"] == d]) else np.zeros((1, d)) for d in sizes}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            cell, far = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            raw = batch.column(3).to_pylist()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                cell[at], far[at] = _nearest(np.stack([_read(raw[i], d) for i in at]), pivots[d])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=["id", "query", "dim", "vec", "cell", "far"])

    cells = scratch.keep(rows.mapInArrow(assign, "id long, query boolean, dim int, vec binary, cell int, far double"), "cells")
    summary = cells.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.count_if("query").alias("nq"), F.max(F.when(F.col("query"), F.col("far"))).alias("far_q")).collect()
    reach: dict[int, list[tuple[int, float, float, int]]] = {}  # dim -> (cell, radius of its queries, their certain score, blocks of queries)
    for d, p in pivots.items():
        of = [s for s in summary if s["dim"] == d]
        for s in of:
            if s["nq"]:
                a, ra = p[s["cell"]], s["far_q"]
                low = sorted(((float(a @ p[t["cell"]]) - np.linalg.norm(a) * t["far"] - ra * np.linalg.norm(p[t["cell"]]) - ra * t["far"], t["n"]) for t in of), reverse=True)
                need, sure = k + 1, -math.inf  # one more, for the query itself
                for score, n in low:
                    need -= n
                    if need <= 0:
                        sure = score
                        break
                reach.setdefault(d, []).append((s["cell"], ra, sure, math.ceil(s["nq"] / queries_a_block)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row of a vector for each cell of queries that needs it."""
        for batch in batches:
            dims, raw = batch.column(2).to_numpy(), batch.column(3).to_pylist()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                v = np.stack([_read(raw[i], d) for i in at])
                norm = np.linalg.norm(v, axis=1)
                for cell, radius, sure, _ in reach.get(int(d), ()):
                    up = v @ pivots[d][cell] + radius * norm
                    use = at[up + SLACK * (1 + np.abs(up)) >= sure - SLACK * (1 + abs(sure) if math.isfinite(sure) else 0)]
                    if len(use):
                        some = batch.take(pa.array(use))
                        yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array(np.full(len(use), cell, np.int32)), some.column(3)], names=["id", "dim", "cell", "vec"])

    parts = F.create_map(*(F.lit(x) for d, of in reach.items() for c, _, _, n in of for x in (f"{d},{c}", n))) if reach else F.create_map(F.lit(""), F.lit(1))
    salts = F.create_map(*(F.lit(x) for d, (n, _) in sizes.items() for x in (d, math.ceil(n / block)))) if sizes else F.create_map(F.lit(0), F.lit(1))
    cell_parts = F.element_at(parts, F.concat_ws(",", "dim", "cell"))
    data = cells.select("id", "query", "dim", "vec").mapInArrow(send, "id long, dim int, cell int, vec binary")
    data = data.select("dim", "cell", F.explode(F.sequence(F.lit(0), cell_parts - 1)).alias("part"), F.pmod(F.xxhash64("id", "vec"), F.element_at(salts, F.col("dim"))).cast("int").alias("salt"), F.lit(1).alias("role"), "id", "vec")
    asked = cells.where("query").select("id", "dim", "cell", "vec").distinct()
    asked = asked.select("dim", "cell", F.pmod(F.xxhash64("id"), cell_parts).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.element_at(salts, F.col("dim")) - 1)).alias("salt"), F.lit(0).alias("role"), "id", "vec")

    def solve(group: pa.Table) -> Iterator[pa.RecordBatch]:
        role, ids, d = group["role"].to_numpy(), group["id"].to_numpy(), group["dim"][0].as_py()
        m = np.stack([_read(x, d) for x in group["vec"].to_pylist()])
        q, v = role == 0, role == 1
        if not q.any() or not v.any():
            return
        tags = [zlib.crc32(x) for x in group["vec"].filter(pa.array(q)).to_pylist()]
        out = [(ids[q][r], tags[r], i, s) for r, i, s in best(m[q], ids[q], m[v], ids[v], k)]
        n = [len(i) for _, _, i, _ in out]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([x[0] for x in out], n)), pa.array(np.repeat(np.array([x[1] for x in out], np.int64), n)), pa.array(np.concatenate([x[2] for x in out])), pa.array(np.concatenate([x[3] for x in out]))], names=["query_id", "tag", "vec_id", "score"])

    found = map_runs(data.unionByName(asked), ["dim", "cell", "part", "salt"], ["role"], solve, "query_id long, tag long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id", "tag").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of every vector whose id is divisible by 50."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {"op3_voronoi_knn": op3_voronoi_knn}
ORACLE_SQL = {
    "op3_voronoi_knn": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
}
