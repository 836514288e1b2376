"""N-gram Jaccard join by T-occurrence search.

Documents are sets of word shingles. Equal sets are one node. A node of n shingles has its shingles dealt by hash into
slightly more parts than a linked node can differ in, so linked nodes agree in a whole part that isn't empty: nodes
with an equal part form a block, and blocks hold close copies only, whatever passages other documents share. In a
block a first search asks the smallest node (leader) for its links; blocks whose nodes are then not of one component
are searched once more, chunk against chunk, for links between components. Each search is a T-occurrence search over
an inverted index of its chunk: short lists are merged by a heap, long ones probed (DivideSkip). Rows per block are
linear in its size, and no link between components is lost.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, forget_in_worker, map_runs, mix, shingles, table, word_hashes



#: So many signatures in common are enough to tell links from chance.
SHARED = 8


def least_overlap(n: int, m: int, num: int, den: int) -> int:
    """Smallest intersection with intersection / union >= num / den."""
    return -(-num * (n + m) // (num + den))


def most_difference(n: int, num: int, den: int) -> int:
    """Most elements in just one of two linked sets, the smaller having n."""
    m = n * den // num
    return (den - num) * (n + m) // (num + den)


class Parts:
    """The signatures of sets: equal parts that linked sets must share.

    Scheme i is for pairs whose smaller set has at least edge[i] and fewer than edge[i + 1] shingles; a set gives
    signatures for every scheme in which it can be one of a pair. Frequent shingles, any fixed set of them, are left out
    first: what is left of two linked sets differs by no more. Parts of one shingle are left out too. A set that then has
    no more parts than it can differ in gives signatures with frequent shingles and small parts as well, and if these are
    too few, or the set is small, the first shingles of an order with the frequent ones last (prefix filter). Of a linked
    pair, one set has enough parts, or both give the next kind.

    With each kind goes the number of signatures that a linked set shares at least: the parts beyond the difference. Of
    sets that share more than SHARED, only the first signatures in the order of their values are given, as many fewer as
    leave SHARED in common (the prefixes of two sets that share o elements, each without its last o - s, share s).
    """

    def __init__(self, num: int, den: int, frequent: np.ndarray, least: int = 16, step: float = 1.5):
        self.num, self.den, self.least, self.step = num, den, least, step
        self.frequent = frequent
        self.edges = [least]

    def of(self, s: np.ndarray) -> list[tuple[np.ndarray, int]]:
        """Signatures of a set by kind, with the kind's number << 32 | least number shared."""
        n, num, den = len(s), self.num, self.den
        while self.edges[-1] <= n:
            self.edges.append(int(self.edges[-1] * self.step) + 1)
        low = -(-num * n // den)  # the smallest set that can be linked with this
        differ = max(most_difference(n, num, den), (den - num) * 2 * n // (num + den))
        at = np.searchsorted(self.frequent, s)
        at[at == len(self.frequent)] = 0
        common = self.frequent[at] == s if len(self.frequent) else np.zeros(n, bool)
        cold = s[~common] if common.any() else s
        out, prefix = [], low < self.least
        for i in range(len(self.edges) - 1, -1, -1):
            if self.edges[i] > n:
                continue
            if i + 1 < len(self.edges) and self.edges[i + 1] <= low:
                break
            for kind, own, size in ((0, cold, 2), (1, s, 1)):
                sigs = self._parts(own, 2 * i + kind, self.edges[i], size)
                spare = len(sigs) - differ - SHARED
                kept = np.sort(sigs)[: len(sigs) - spare] if spare > 0 else sigs
                out.append((kept, (2 * i + kind + 2) << 32 | max(1, min(SHARED, len(sigs) - differ))))
                if len(sigs) > differ:
                    break
            else:
                prefix = True
        if prefix:
            first = np.concatenate((cold, s[common]))[: n - low + 1]
            out.append((mix(first ^ np.uint64(0xA5A5A5A5A5A5A5A5)), 1 << 32 | 1))
        return out

    def _parts(self, s: np.ndarray, tag: int, edge: int, size: int) -> np.ndarray:
        """Signatures of the parts of s that have at least `size` elements."""
        if not len(s):
            return s
        parts = 3 * most_difference(int(edge * self.step), self.num, self.den) // 2 + 3
        part = ((s >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        sums = np.add.reduceat(mix(s + np.uint64(0x632BE59BD9B4E019)), starts)
        sigs = mix(sums + mix(part[starts] + np.uint64((tag + 1) << 32)))
        return sigs[np.diff(np.concatenate((starts, [len(s)]))) >= size] if size > 1 else sigs


def divide_skip(query: np.ndarray, names: np.ndarray, first: np.ndarray, doc: np.ndarray, sets: list[np.ndarray], num: int, den: int, allowed=None) -> list[tuple[int, int]]:
    """(place, overlap) of each set of an inverted index that is linked with the query.

    names, first, doc: the index's shingles in order, where the list of each begins, and the lists one after another.
    With T the least overlap of any link, the L longest lists are set aside (L as in the DivideSkip paper, below T),
    the others merged by a heap; what occurs T - L times there is probed for in the long ones.
    """
    n = len(query)
    t = -(-num * n // den)
    at = np.searchsorted(names, query)
    at[at == len(names)] = 0
    hit = names[at] == query
    if hit.sum() < t:
        return []
    at, tokens = at[hit], query[hit]
    size = first[at + 1] - first[at]
    order = np.argsort(size, kind="stable")
    longest = int(size[order[-1]])
    aside = min(t - 1, int(t / (0.0085 * log(longest + 1) + 1)))
    short, long = order[: len(order) - aside], np.sort(tokens[order[len(order) - aside :]])
    lists = [doc[first[at[k]] : first[at[k] + 1]] for k in short]
    if allowed is not None:
        lists = [x[allowed[x]] for x in lists]
    merged = heapq.merge(*(x.tolist() for x in lists if len(x)))
    out = []
    for place, same in groupby(merged):
        count = sum(1 for _ in same)
        if count < t - aside:
            continue
        s = sets[place]
        if num * max(n, len(s)) > den * min(n, len(s)):
            continue
        if len(long):
            p = np.searchsorted(s, long)
            p[p == len(s)] = 0
            count += int((s[p] == long).sum())
        if count >= least_overlap(n, len(s), num, den):
            out.append((place, count))
    return out


def search(nodes: list[int], roles: list[int], comps: list[int], sets: list[np.ndarray], num: int, den: int) -> Iterator[tuple[int, int, int]]:
    """Links (node, node, overlap) of a block between sets of role 1 or 2 (queries) and those of role 0 or 2 (index) that join components."""
    index = [i for i, r in enumerate(roles) if r != 1]
    own = [sets[i] for i in index]
    if not own:
        return
    tokens = np.concatenate(own)
    order = np.argsort(tokens, kind="stable")
    doc = np.repeat(np.arange(len(own)), [len(s) for s in own])[order]
    names, first = np.unique(tokens[order], return_index=True)
    first = np.r_[first, len(tokens)]
    comp = np.array(comps)
    inner = np.array(index)
    place = {i: k for k, i in enumerate(index)}
    for i, r in enumerate(roles):
        if r:
            allowed = comp[inner] != comp[i]
            if r == 2:  # each pair within the index is asked for once
                allowed[: place[i] + 1] = False
            if allowed.any():
                for k, o in divide_skip(sets[i], names, first, doc, own, num, den, allowed):
                    j = index[k]
                    if comp[j] != comp[i]:
                        comp[comp == comp[j]] = comp[i]
                        yield nodes[i], nodes[j], o


def jaccard_components(docs: DataFrame, words: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text", chunk: int = 1024, few_chunks: int = 8, most_frequent: int = 200_000) -> DataFrame:
    """Each document's number of distinct shingles and the smallest id of its component of links.

    Two documents link when intersection / union >= num / den. Null texts, empty ones and those of white space have no
    shingles and link with nothing. Rows of one id are one document: what each of them links with is one component. Rows
    with a null id have a null component. Very long texts are sets of all their shingles; a task searches as many sets as
    have about chunk * 4096 shingles. An empty table gives an empty result. Other columns are not read. Shingles are
    compared by 64-bit hashes, whole sets by 128 bits when equal ones are put together.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def digests(s: np.ndarray) -> tuple[int, int]:
        a = np.array([np.add.reduce(mix(s)) + np.uint64(len(s)), np.add.reduce(mix(s ^ np.uint64(0x8BB84B93962EACC9))) + np.uint64(len(s))], np.uint64)
        return tuple(mix(a).view(np.int64).tolist())

    def digest(s: np.ndarray, odd: frozenset) -> int:
        """The first digest, or where different sets have that, the second."""
        one, two = digests(s)
        return two if one in odd else one

    def sets_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for a in range(0, batch.num_rows, 500):
            for t in batch.column(1).slice(a, 500).to_pylist():
                yield np.unique(shingles(word_hashes(t), words))

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a text, and one for each shingle that several of some thousand texts have."""
        forget_in_worker()
        names = ["id", "n", "node", "other", "shingle", "times"]
        held, docs = [], 0

        def frequent() -> pa.RecordBatch:
            x, times = np.unique(np.concatenate(held), return_counts=True)
            many = times >= 3
            x, times = x[many].view(np.int64), times[many].astype(np.int64)
            held.clear()
            return pa.RecordBatch.from_arrays([*[pa.nulls(len(x), pa.int64())] * 4, pa.array(x), pa.array(times)], names=names)

        for batch in batches:
            n, node, other = [], [], []
            for s in sets_of(batch):
                n.append(len(s))
                for out, d in zip((node, other), digests(s) if len(s) else (None, None), strict=True):
                    out.append(d)
                held.append(s)
                docs += 1
                if docs % 2048 == 0:
                    yield frequent()
                    docs = 0
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, pa.int64()) for v in (n, node, other)), *[pa.nulls(len(n), pa.int64())] * 2], names=names)
        if held:
            yield frequent()

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_in_worker()
        frequent, odd = shared.value
        parts = Parts(num, den, frequent)
        names = ["sig", "node", "kind"]
        for batch in batches:
            seen, rows, size = set(), ([], [], []), 0
            for s in sets_of(batch):
                if not len(s) or (node := digest(s, odd)) in seen:
                    continue
                seen.add(node)
                for sigs, kind in parts.of(s):
                    for r, v in zip(rows, (sigs.view(np.int64), np.full(len(sigs), node), np.full(len(sigs), kind)), strict=True):
                        r.append(v)
                    size += len(sigs)
                if size > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(r)) for r in rows], names=names)
                    rows, size = ([], [], []), 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(r)) for r in rows], names=names)

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of signatures that more than one node has; a row is held back to know the next."""
        forget_in_worker()
        held, follows = None, False  # the last row, and whether one of its signature came before it
        names = ["sig", "node", "kind"]
        for batch in batches:
            if not batch.num_rows:
                continue
            sig, node, kind = (batch.column(k).to_numpy() for k in range(3))
            if held is not None:
                sig, node, kind = (np.concatenate(([h], x)) for h, x in zip(held, (sig, node, kind), strict=True))
            keep = np.concatenate(([True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])))
            sig, node, kind = sig[keep], node[keep], kind[keep]
            same = np.concatenate(([follows], sig[1:] == sig[:-1]))  # as the row before
            use = same | np.concatenate((same[1:], [False]))
            held, follows = (sig[-1], node[-1], kind[-1]), bool(same[-1])
            use[-1] = False
            yield pa.RecordBatch.from_arrays([pa.array(x[use]) for x in (sig, node, kind)], names=names)
        if follows:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in held], names=names)

    def shared_enough(rows: DataFrame) -> DataFrame:
        """Rows of nodes that share as many signatures of a kind as any link takes, then with the smallest such node."""
        enough = rows.groupBy("node", "kind").agg(F.count("*").alias("n")).where(F.col("n") >= F.col("kind").bitwiseAND(F.lit((1 << 32) - 1)))
        rows = rows.join(enough.select("node", "kind"), ["node", "kind"])
        led = rows.groupBy("sig").agg(F.count("*").alias("n"), F.min("node").alias("leader")).where("n > 1")
        return rows.select("sig", "node", "kind").join(led.select("sig", "leader"), "sig")

    def linked(group: pa.Table) -> Iterator[pa.RecordBatch]:
        """Links of a group; of a document's rows those are used that have the node's set, each once."""
        odd, asked = shared.value[1], {}
        for node, role, comp, text in zip(*(group[k].to_pylist() for k in ("node", "role", "comp", "text")), strict=True):
            if node not in asked:
                s = np.unique(shingles(word_hashes(text), words))
                if len(s) and digest(s, odd) == node:
                    asked[node] = (role, comp, s)
        if found := list(search(list(asked), [r for r, _, _ in asked.values()], [c for _, c, _ in asked.values()], [s for _, _, s in asked.values()], num, den)):
            u, v, _ = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    both = scratch.keep(rows.mapInArrow(sized, "id long, n long, node long, other long, shingle long, times long"), "rows")
    sized_rows = both.where("n is not null").select("id", "n", "node", "other")
    hot = both.where("shingle is not null").groupBy("shingle").agg(F.sum("times").alias("times")).where(F.col("times") >= max(16, sized_rows.count() // 2000))
    hot = hot.orderBy(F.desc("times"), "shingle").limit(most_frequent).toArrow()["shingle"].to_numpy()
    # Sets whose first digests agree and second ones don't: of 10^10 sets, some three.
    of_node = sized_rows.where("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.min("other").alias("lo"), F.max("other").alias("hi"))
    odd = frozenset(r["node"] for r in of_node.where("lo <> hi").select("node").collect())
    if odd:
        sized_rows = sized_rows.withColumn("node", F.when(F.col("node").isin(list(odd)), F.col("other")).otherwise(F.col("node")))
    sized_rows = sized_rows.drop("other")
    shared = spark.sparkContext.broadcast((np.sort(hot.view(np.uint64)), odd))
    reps = sized_rows.where("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.max("n").alias("n"))
    sigs = rows.select("id", "text").mapInArrow(signed, "sig long, node long, kind long")
    found = scratch.keep(sigs.repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(several, "sig long, node long, kind long"), "found")
    blocks = scratch.keep(shared_enough(scratch.keep(shared_enough(found), "once").drop("leader")).drop("kind"), "blocks")
    scratch.drop("found", "once")

    # Searches get texts, which take half the room of their shingles' hashes.
    need = blocks.select("node").distinct().join(reps, "node").where("id is not null").select("id", "node")
    sets = scratch.keep(rows.join(need, "id").select("node", "text"), "sets")

    # Blocks that hang together are a cluster; one of up to `chunk` nodes is searched as a whole.
    hung = scratch.keep(blocks.where("node <> leader").select("node", "leader").distinct(), "hung")
    clusters = components(spark, hung.select(F.col("node").alias("u"), F.col("leader").alias("v")), scratch, "cluster").select(F.col("id").alias("node"), F.col("component").alias("cluster"))
    # A node counts once for each 4096 shingles, so that no search holds more than about chunk * 4096 of them.
    clusters = clusters.join(reps.select("node", F.ceil(F.col("n") / 4096).alias("wt")), "node")
    sizes = clusters.groupBy("cluster").agg(F.sum("wt").alias("size"))
    clusters = scratch.keep(clusters.join(sizes, "cluster"), "clusters")
    shape = ["a", "b", "c", "node", "comp", "role"]
    whole = clusters.where(F.col("size") <= chunk).select(F.col("cluster").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("c"), "node", F.col("node").alias("comp"), F.lit(2).alias("role"))

    # In a larger one every node first asks the smallest leader among its blocks.
    large = clusters.where(F.col("size") > chunk)
    pairs = hung.join(large, "node").groupBy("node", "wt").agg(F.min("leader").alias("leader"))
    many = pairs.groupBy("leader").agg(F.ceil(F.sum("wt") / chunk).alias("chunks"))
    pairs = scratch.keep(pairs.join(many, "leader").select("leader", "node", F.pmod(F.xxhash64("node"), F.col("chunks")).alias("chunk")), "pairs")
    asked = pairs.select(F.col("leader").alias("a"), F.col("chunk").alias("b"), F.lit(-1).cast("long").alias("c"), "node", F.col("node").alias("comp"), F.lit(0).alias("role"))
    asking = pairs.select("leader", "chunk").distinct().select(F.col("leader").alias("a"), F.col("chunk").alias("b"), F.lit(-1).cast("long").alias("c"), F.col("leader").alias("node"), F.col("leader").alias("comp"), F.lit(1).alias("role"))

    def searched(rows: DataFrame) -> DataFrame:
        return map_runs(rows.select(*shape).join(sets, "node"), ["a", "b", "c"], ["node"], linked, "u long, v long", tasks)

    links = scratch.keep(searched(whole.union(asked).union(asking)), "links")
    comps = scratch.keep(components(spark, links, scratch, "first"), "comps")
    placed = scratch.keep(large.join(comps, F.col("node") == F.col("id"), "left").select("cluster", "size", "node", "wt", F.coalesce("component", "node").alias("comp")), "placed")

    # Then chunks against chunks where several components are left: those of one large component don't meet each other.
    # A cluster of more than a few chunks is searched block by block instead where that takes fewer rows; of blocks with
    # the same nodes, one.
    of_comp = placed.groupBy("cluster", "comp").agg(F.sum("wt").alias("n"))
    tagged = of_comp.groupBy("cluster").agg(F.count("*").alias("comps")).where("comps > 1").join(of_comp, "cluster").select("cluster", "comp", F.when(F.col("n") > chunk, F.col("comp").cast("string")).otherwise("").alias("tag"), "n")
    tagged = scratch.keep(tagged, "tagged")
    spans = tagged.groupBy("cluster", "tag").agg(F.sum("n").alias("size"), F.ceil(F.sum("n") / chunk).alias("chunks"))
    crowded = spans.groupBy("cluster").agg(F.sum("chunks").alias("all")).where(F.col("all") > few_chunks)
    unlinked = placed.join(crowded.select("cluster"), "cluster", "left_semi")
    in_comps = blocks.select("sig", "node").join(unlinked.select("cluster", "node", "wt", "comp"), "node")
    open_blocks = (
        in_comps.groupBy("sig", "cluster")
        .agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum("wt").alias("size"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("nodes"))
        .where("lo <> hi")
        .groupBy("cluster", "size", "nodes")
        .agg(F.min("sig").alias("sig"))
        .select("cluster", "sig", "size", F.ceil(F.col("size") / chunk).alias("chunks"))
    )
    open_blocks = scratch.keep(open_blocks, "open_blocks")
    by_block = open_blocks.groupBy("cluster").agg(F.sum(F.col("size") * F.col("chunks")).alias("block_rows"))
    by_chunk = spans.groupBy("cluster").agg((F.sum("size") * F.sum("chunks")).alias("chunk_rows"))
    way = scratch.keep(by_chunk.join(by_block, "cluster", "left").select("cluster", F.coalesce(F.col("block_rows") < F.col("chunk_rows"), F.lit(False)).alias("blockwise")), "way")
    spans = spans.join(way.where("not blockwise"), "cluster").select("cluster", "tag", "chunks")
    named = spans.select("cluster", "tag", "chunks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("own")).withColumn("name", F.xxhash64("tag", "own"))
    others = named.select("cluster", F.col("tag").alias("tag2"), F.col("name").alias("other"))
    meet = named.join(others, "cluster").where("tag = '' or tag <> tag2").select("cluster", "tag", "own", "name", "other")
    members = placed.join(tagged.select("cluster", "comp", "tag"), ["cluster", "comp"]).join(spans, ["cluster", "tag"]).select("cluster", "tag", "node", "comp", F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")).alias("own"))
    dealt = members.join(meet, ["cluster", "tag", "own"]).select(F.col("cluster").alias("a"), F.least("name", "other").alias("b"), F.greatest("name", "other").alias("c"), "node", "comp", F.when(F.col("name") == F.col("other"), 2).when(F.col("name") < F.col("other"), 1).otherwise(0).alias("role"))

    some = open_blocks.join(way.where("blockwise"), "cluster").select("sig", "chunks")
    blocked = in_comps.select("sig", "node", "comp").join(some, "sig").withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")))
    blocked = blocked.select("sig", "node", "comp", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other"))
    blocked = blocked.select(F.col("sig").alias("a"), F.least("own", "other").alias("b"), F.greatest("own", "other").alias("c"), "node", "comp", F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 1).otherwise(0).alias("role"))
    rest = scratch.keep(searched(dealt.union(blocked)), "rest")
    of_id = sized_rows.where("id is not null and node is not null").groupBy("id").agg(F.min("node").alias("v"), F.max("node").alias("far"))
    same_id = sized_rows.join(of_id.where("v <> far").select("id", "v"), "id").where("node <> v").select(F.col("node").alias("u"), "v")
    comps = components(spark, links.union(rest).union(same_id), scratch, "last")

    named = reps.join(comps.withColumnRenamed("id", "node"), "node").select("node", "id", "component")
    smallest = named.groupBy("component").agg(F.min("id").alias("smallest"))
    of_node = scratch.keep(reps.join(named.select("node", "component"), "node", "left").join(smallest, "component", "left").select("node", F.coalesce("smallest", "id").alias("component_id")), "of_node")
    scratch.drop("blocks", "sets", "hung", "clusters", "pairs", "links", "comps", "placed", "tagged", "open_blocks", "way", "rest")
    out = sized_rows.join(of_node, "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, four-word shingles, 85 %."""
    return jaccard_components(table(spark, sf_dir, "documents"))


QUERIES = {"op1_ngram_join": op1_ngram_join}
ORACLE_SQL = {
    "op1_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b.y, r.root FROM r JOIN b ON b.x = r.id)
SELECT d.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.root) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.id = d.doc_id GROUP BY d.doc_id
"""
}
