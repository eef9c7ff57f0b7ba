"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

Inner product becomes angle by one more component (the room to the greatest norm). Trees are
fitted on a bounded sample: a random direction per level, split at the sample's medians (below
the depth that the sample can fit, at the level's median). Leaves hold about ``leaf_rows`` rows
at any size of the table, so trees get deeper as it grows. Every row goes to one leaf of each tree.

A query walks all trees at once through one priority queue. A branch's priority is how unlikely
it is that a neighbour stands behind it, given how far the query is from the cuts on the way;
all leaves whose likelihood passes a bar are opened. The bar is measured: some queries' true
neighbours, found by one pass over all rows, tell how unlikely a leaf must be allowed to be so
that ``recall`` of the neighbours is met. Queries far from all cuts so open few leaves.

Rows and queries meet at the trees' boughs (some dozens of neighbouring leaves, a bounded number
of rows), once per tree and bough; boughs with many rows or queries, by their own counts, are
dealt to several tasks. Candidates are reranked by the exact inner product in double precision.

Equal vectors are one class in the index: of each class the ids that could be among any
query's ``k`` are kept (the k + 1 smallest), so a vector that a third of all rows share
costs one candidate.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components take
no part, nor do those whose dimension isn't the commonest; a repeated id is a candidate each time
(never its own), as a query it is asked once for each of its vectors;
fewer than k candidates give fewer rows; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, join_measured, read

TREES = 16
LEAF_ROWS = 128
#: Leaves of a tree that one task meets, at most.
BOUGH_LEAVES = 256
RECALL = 0.94
#: Rows on which the trees are fitted, and queries whose true neighbours set the bar.
SAMPLE, MEASURED = 8192, 96
#: Rows and queries of one bough that one task takes at most, about.
ROWS, QUERIES = 65_536, 16_384
#: The logistic curve that is closest to the normal distribution.
LOGISTIC = 1.702


@dataclass
class Forest:
    directions: np.ndarray  # (trees, levels, dimension + 1)
    cuts: list  # of each level: (trees, nodes), or (trees, 1) below the fitted depth
    centre: np.ndarray  # (trees, levels): of the projections
    spread: np.ndarray
    norm: float
    closeness: float = 0.5  # cosine of a query and a neighbour
    bar: float = math.inf

    @property
    def levels(self) -> int:
        return self.directions.shape[1]

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        if query:
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            return np.hstack((x, np.zeros((len(x), 1))))
        x = x / self.norm
        return np.hstack((x, np.sqrt(np.maximum(1 - (x**2).sum(axis=1, keepdims=True), 0))))

    def projected(self, lifted: np.ndarray) -> np.ndarray:
        """(rows, trees, levels)"""
        t, n, d = self.directions.shape
        return (lifted @ self.directions.reshape(-1, d).T).reshape(len(lifted), t, n)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): the leaf of each row in each tree."""
        along = self.projected(self.lift(x, False))
        at = np.zeros(along.shape[:2], np.int64)
        trees = np.arange(at.shape[1])
        for level, cuts in enumerate(self.cuts):
            at = 2 * at + (along[:, :, level] > cuts[trees, at % cuts.shape[1]])
        return at

    def expected(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(queries, trees, levels): where a neighbour's projection is expected; and what one unit off it counts."""
        along = self.projected(self.lift(x, True))
        near = self.closeness
        return self.centre + near * (along - self.centre), LOGISTIC / (self.spread * math.sqrt(1 - near * near))

    def unlikeliness(self, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """(pairs, trees): of the leaves that hold rows[i], for query x[i]."""
        at, (middle, scale) = self.leaves(rows), self.expected(x)
        trees, cost = np.arange(at.shape[1]), np.zeros(at.shape)
        for level, cuts in enumerate(self.cuts):
            node, right = at >> (self.levels - level), (at >> (self.levels - level - 1)) & 1
            z = (middle[:, :, level] - cuts[trees, node % cuts.shape[1]]) * scale[:, level]
            cost += np.logaddexp(0, np.where(right == 1, -z, z))
        return cost

    def search(self, x: np.ndarray):
        """(tree, leaf) pairs of each query whose unlikeliness is within the bar, likeliest first, through one queue over all trees."""
        middle, scale = self.expected(x)
        middle, scale = middle.tolist(), scale.tolist()
        cuts, levels, bar = [c.tolist() for c in self.cuts], self.levels, self.bar
        for own in middle:
            queue, found = [(0.0, t, 0, 0) for t in range(len(own))], []
            while queue:
                cost, tree, level, node = heapq.heappop(queue)
                if level == levels:
                    found.append((tree, node))
                    continue
                cut = cuts[level][tree]
                z = (own[tree][level] - cut[node % len(cut)]) * scale[tree][level]
                right = cost + (math.log1p(math.exp(-z)) if z > -30 else -z)
                left = cost + (math.log1p(math.exp(z)) if z < 30 else z)
                if right <= bar:
                    heapq.heappush(queue, (right, tree, level + 1, 2 * node + 1))
                if left <= bar:
                    heapq.heappush(queue, (left, tree, level + 1, 2 * node))
            yield found


def plant(sample: np.ndarray, norm: float, trees: int, levels: int, seed: int = 11) -> Forest:
    rng = np.random.default_rng(seed)
    directions = rng.standard_normal((trees, levels, sample.shape[1] + 1))
    directions /= np.linalg.norm(directions, axis=2, keepdims=True)
    forest = Forest(directions, [], np.zeros((trees, levels)), np.ones((trees, levels)), norm)
    along = forest.projected(forest.lift(sample, False))
    forest.centre, forest.spread = along.mean(axis=0), np.maximum(along.std(axis=0), 1e-9)
    at = np.zeros((len(sample), trees), np.int64)
    for level in range(levels):
        middle = np.median(along[:, :, level], axis=0)[:, None]
        if len(sample) >> level >= 16:  # enough of the sample is left in a node
            middle = np.repeat(middle, 1 << level, axis=1)
            for t in range(trees):
                order = np.lexsort((along[:, t, level], at[:, t]))
                nodes, first, size = np.unique(at[order, t], return_index=True, return_counts=True)
                middle[t, nodes] = (along[order[first + (size - 1) // 2], t, level] + along[order[first + size // 2], t, level]) / 2
        forest.cuts.append(middle)
        at = 2 * at + (along[:, :, level] > middle[np.arange(trees), at % middle.shape[1]])
    return forest


def matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def true_neighbours(classes: DataFrame, queries: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query number, vector) of each query's k nearest classes but its own: one pass over all classes, k rows a query from each task."""

    def best(batches):
        held = None
        for batch in batches:
            c, x = batch.column(0).to_numpy(), matrix(batch.column(1))
            scores = np.where(c == ids[:, None], -np.inf, queries @ x.T)
            top = np.argpartition(-scores, min(k, len(c)) - 1, axis=1)[:, :k]
            some = np.take_along_axis(scores, top, 1), c[top], x[top]
            if held is not None:
                some = tuple(np.concatenate(p, axis=1) for p in zip(held, some))
                top = np.lexsort((some[1], -some[0]), axis=1)[:, :k]
                some = np.take_along_axis(some[0], top, 1), np.take_along_axis(some[1], top, 1), np.take_along_axis(some[2], top[:, :, None], 1)
            held = some
        if held is not None:
            q = np.repeat(np.arange(len(queries)), held[0].shape[1])
            fine = np.isfinite(held[0].ravel())
            flat = held[2].reshape(-1, held[2].shape[2])[fine]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(q[fine].astype(np.int32)), pa.array(held[0].ravel()[fine]), pa.array(held[1].ravel()[fine]), lists], names=["q", "score", "c", "x"])

    found = classes.select("c", "x").mapInArrow(best, "q int, score double, c bigint, x array<double>")
    near = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c"))
    rows = found.withColumn("near", near).where(F.col("near") <= k).select("q", "x").collect()
    return np.array([r.q for r in rows], np.int64), np.array([r.x for r in rows], float)


def meet(rows: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The k + 1 nearest rows of one bough to each query, among the leaves that it opens."""
    names = ["q", "c", "score"]
    if not rows.num_rows or not queries.num_rows:
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
    rows = rows.sort_by([("leaf", "ascending"), ("c", "ascending")])
    leaf, c, x, y = rows["leaf"].to_numpy(), rows["c"].to_numpy(), matrix(rows["x"]), matrix(queries["x"])
    opened = queries["leaves"].combine_chunks()
    asked, by = opened.flatten().to_numpy(), np.repeat(np.arange(len(y)), opened.value_lengths().to_numpy())
    order = np.argsort(asked, kind="stable")
    asked, by = asked[order], by[order]
    found = [], [], []
    kinds, first = np.unique(leaf, return_index=True)
    for one, lo, hi in zip(kinds, first, [*first[1:], len(leaf)]):
        some = by[np.searchsorted(asked, one) : np.searchsorted(asked, one, "right")]
        for at in range(0, len(some), 1024):
            mine = some[at : at + 1024]
            scores = y[mine] @ x[lo:hi].T
            if hi - lo > k + 1:  # with all that tie with the last one
                least = -np.partition(-scores, k, axis=1)[:, k]
                i, j = np.nonzero(scores >= (least - 1e-12 * np.abs(least))[:, None])
            else:
                i, j = (a.ravel() for a in np.indices(scores.shape))
            for part, values in zip(found, (mine[i], lo + j, scores[i, j])):
                part.append(values)
    if not found[0]:
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
    q, r, score = (np.concatenate(part) for part in found)
    order = np.lexsort((-score, q))
    q, r, score = q[order], r[order], score[order]
    start = np.searchsorted(q, q)
    last = np.minimum(start + k, np.searchsorted(q, q, "right") - 1)
    keep = score >= score[last] - 1e-12 * np.abs(score[last])
    q, r = q[keep], r[keep]
    score = (y[q] * x[r]).sum(axis=1)  # the same sum for a pair wherever it is met
    order = np.lexsort((c[r], -score, q))
    q, r, score = q[order], r[order], score[order]
    near = np.arange(len(q)) - np.searchsorted(q, q) <= k
    return pa.table([queries["q"].to_numpy()[q[near]], c[r[near]], score[near]], names=names)


def nearest(vectors: DataFrame, query: Column, k: int, vec_id: str = "vec_id", vector: str = "embedding", trees: int = TREES, leaf_rows: int = LEAF_ROWS, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found to each row where ``query`` holds; recall: the share of neighbours that the bar is set for, 1 opens all leaves."""
    spark = vectors.sparkSession
    ws = Workspace(spark, "ann-forest")
    kind = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    v = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{vector}`").cast(kind).alias("x"), F.coalesce(query, F.lit(False)).alias("is_query"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("x", lambda c: c != 0)
    v = v.where(F.col("id").isNotNull() & F.col("x").isNotNull() & fine).withColumns({"a": F.xxhash64("x"), "b": F.xxhash64(F.lit("second"), "x")})
    v = ws.save(v, "vectors")
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))
    sizes = v.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"), F.max(norm).alias("norm")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    v = v.where(F.size("x") == sizes[0].d)
    classes = ws.save(v.groupBy("a", "b").agg(F.min("id").alias("c"), F.max("is_query").alias("asked"), F.any_value("x").alias("x")), "classes")
    by_class = Window.partitionBy("a", "b").orderBy("id")
    members = v.select("id", "a", "b").withColumn("place", F.row_number().over(by_class)).where(F.col("place") <= k + 1)
    members = members.join(classes.select("a", "b", "c"), ["a", "b"]).select("c", F.col("id").alias("vec_id"))

    n = classes.count()
    levels = max(0, int(math.log2(max(n / leaf_rows, 1))))
    trees = min(trees, (1 << levels) // 4 if levels > 3 else 1)  # a small table has few leaves to tell apart
    fitted = classes.select("a", "b", "x").orderBy("a", "b").limit(sample).collect()
    planted = plant(np.array([r.x for r in fitted], float), float(sizes[0].norm), trees, levels)
    asked = classes.where("asked").select(F.col("c").alias("q"), "x")
    if levels and recall < 1:
        some = classes.where("asked").select("a", "b", "c", "x").orderBy("a", "b").limit(MEASURED).collect()
        if some:
            x, ids = np.array([r.x for r in some], float), np.array([r.c for r in some], np.int64)
            q, near = true_neighbours(classes, x, ids, k)
            if len(q):
                cosine = (planted.lift(x[q], True) * planted.lift(near, False)).sum(axis=1)
                planted.closeness = float(np.clip(np.median(cosine), 0.05, 0.99))
                planted.bar = float(np.quantile(planted.unlikeliness(x[q], near).min(axis=1), recall, method="higher"))
    forest = spark.sparkContext.broadcast(planted)
    shift = min(levels, int(math.log2(BOUGH_LEAVES)))

    def index(batches, counted=False):
        totals: dict[tuple[int, int], int] = {}
        for batch in batches:
            c, at = batch.column(0), forest.value.leaves(matrix(batch.column(1)))
            for t in range(at.shape[1]):
                if counted:
                    for bough, some in zip(*np.unique(at[:, t] >> shift, return_counts=True)):
                        totals[t, int(bough)] = totals.get((t, int(bough)), 0) + int(some)
                else:
                    tree = pa.array(np.full(len(c), t, np.int32))
                    yield pa.RecordBatch.from_arrays([tree, pa.array(at[:, t] >> shift), pa.array(at[:, t]), c, batch.column(1)], names=["tree", "bough", "leaf", "c", "x"])
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in totals], pa.int32()), pa.array([b for _, b in totals], pa.int64()), pa.array(list(totals.values()), pa.int64())], names=["tree", "bough", "n"])

    def walk(batches):
        for batch in batches:
            rows = [], [], [], []
            for q, found in zip(batch.column(0).to_pylist(), forest.value.search(matrix(batch.column(1)))):
                boughs: dict[tuple[int, int], list[int]] = {}
                for tree, leaf in found:
                    boughs.setdefault((tree, leaf >> shift), []).append(leaf)
                for (tree, bough), leaves in boughs.items():
                    for part, value in zip(rows, (q, tree, bough, leaves)):
                        part.append(value)
            kinds = pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(p, t) for p, t in zip(rows, kinds)], names=["q", "tree", "bough", "leaves"])

    key = ["tree", "bough"]
    visits = ws.save(asked.repartition(max(1, math.ceil(asked.count() / 512))).mapInArrow(walk, "q bigint, tree int, bough bigint, leaves array<bigint>"), "visits")
    counts = classes.select("c", "x").mapInArrow(lambda b: index(b, True), "tree int, bough bigint, n bigint").groupBy(*key).agg(F.sum("n").alias("n"), F.lit(0).cast("long").alias("m"))
    counts = counts.unionByName(visits.groupBy(*key).agg(F.lit(0).cast("long").alias("n"), F.count("*").alias("m"))).groupBy(*key).agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    dealt = counts.select(*key, F.ceil(F.col("n") / ROWS).cast("int").alias("row_parts"), F.ceil(F.col("m") / QUERIES).cast("int").alias("query_parts"))
    hot = ws.save(dealt.where("row_parts > 1 OR query_parts > 1"), "hot")
    n_hot = hot.count()
    rows = classes.select("c", "x").mapInArrow(index, f"tree int, bough bigint, leaf bigint, c bigint, x {kind}")
    asking = visits.join(asked, "q")
    if n_hot:  # rows of a hot bough go to each part of its queries and the other way round
        parts = {p: F.greatest(F.coalesce(p, F.lit(1)), F.lit(1)) for p in ("row_parts", "query_parts")}
        each = lambda p: F.explode(F.sequence(F.lit(0), F.col(p) - 1))
        rows = join_measured(rows, hot, key, "left", n_hot).withColumns(parts).withColumn("query_part", each("query_parts")).withColumn("row_part", F.pmod(F.xxhash64("c"), "row_parts").cast("int"))
        asking = join_measured(asking, hot, key, "left", n_hot).withColumns(parts).withColumn("row_part", each("row_parts")).withColumn("query_part", F.pmod(F.xxhash64("q"), "query_parts").cast("int"))
        key = [*key, "row_part", "query_part"]
    found = rows.select(*key, "leaf", "c", "x").groupBy(*key).cogroup(asking.select(*key, "q", "x", "leaves").groupBy(*key)).applyInArrow(lambda r, q: meet(r, q, k), "q bigint, c bigint, score double")
    # of each query's candidates the k + 1 first can matter: one of them may be the query itself; a pair's score is the same in all trees
    first = lambda *of: F.slice(F.array_sort(F.collect_set(F.struct((F.lit(0.0) - F.col("score")).alias("far"), *of))), 1, k + 1)
    found = found.groupBy("q").agg(first("c").alias("near")).select("q", F.explode("near").alias("near")).select("q", "near.c", (F.lit(0.0) - F.col("near.far")).alias("score"))
    lists = found.join(members, "c").groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct((F.lit(0.0) - F.col("score")).alias("far"), "vec_id"))), 1, k + 1).alias("near"))
    queries = v.where("is_query").select(F.col("id").alias("query_id"), "a", "b").distinct().join(classes.where("asked").select("a", "b", F.col("c").alias("q")), ["a", "b"])
    others = F.slice(F.filter("near", lambda e: e.getField("vec_id") != F.col("query_id")), 1, k)
    out = queries.join(lists, "q").select("query_id", F.posexplode(others).alias("rank", "e"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "e.vec_id", (F.lit(0.0) - F.col("e.far")).alias("score"))


def op1_ann_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)
