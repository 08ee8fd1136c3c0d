"""Approximate nearest neighbours: a hierarchical k-means tree, searched best bin first.

The tree is fitted to a bounded sample; every vector is put in a leaf of it. A
query keeps the nodes that it hasn't opened in a priority queue, opens the one
nearest to it and so meets the leaves one by one. How many leaves a query visits
is calibrated: the number is widened until so many leaves hold the wanted share of the true
neighbours of a bounded set of vectors, found by brute force over all rows.

Equal vectors are collapsed first, to one with its smallest ids, and leaves are cut in
parts of bounded size, so neither copies nor dense regions meet in one task.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions, small, table, written

K = 5
#: Rows that the tree is fitted to, and those that calibrate the search, at most.
FIT_ROWS = 16_000
CALIBRATE_ROWS = 256
RECALL = 0.97
LEAF_ROWS = 256
BRANCHES = 16
#: Vectors of a leaf that one task takes at once.
PART = 2048


@dataclass
class Tree:
    """Unit centroids of nodes; children[i] lists node i's children, none for a leaf; leaf[i] numbers leaves."""

    centroids: np.ndarray
    children: list
    leaf: list

    @property
    def leaves(self) -> int:
        return sum(x >= 0 for x in self.leaf)

    def assign(self, unit: np.ndarray) -> np.ndarray:
        """The leaf of each row: always down to the nearest child."""
        out = np.empty(len(unit), np.int32)
        stack = [(0, np.arange(len(unit)))]
        while stack:
            node, rows = stack.pop()
            if not len(rows):
                continue
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf[node]
                continue
            best = (unit[rows] @ self.centroids[kids].T).argmax(axis=1)
            stack += [(kid, rows[best == j]) for j, kid in enumerate(kids)]
        return out

    def best_first(self, query: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves in the order in which a query meets them."""
        heap, met = [(0.0, 0)], []
        while heap and len(met) < most:
            _, node = heapq.heappop(heap)
            kids = self.children[node]
            if not kids:
                met.append(self.leaf[node])
                continue
            near = self.centroids[kids] @ query
            for kid, value in zip(kids, near.tolist()):
                heapq.heappush(heap, (-value, kid))
        return met


def grow(unit: np.ndarray, leaf_rows: int, branches: int = BRANCHES, seed: int = 11) -> Tree:
    """A tree over the rows of unit, split by spherical k-means until a node has leaf_rows rows or equal ones."""
    rng = np.random.default_rng(seed)
    mean = unit.mean(axis=0) if len(unit) else np.zeros(unit.shape[1])
    centroids, children, leaf, todo, leaves = [mean], [[]], [-1], [(0, np.arange(len(unit)))], 0
    while todo:
        node, rows = todo.pop()
        points = unit[rows]
        k = min(branches, max(2, -(-len(rows) // max(1, leaf_rows))))
        parts: list = []
        if len(rows) > leaf_rows and (points != points[0]).any():
            centres = points[rng.choice(len(rows), k, replace=False)]
            for _ in range(8):
                nearest = (points @ centres.T).argmax(axis=1)
                for j in np.unique(nearest):
                    centre = points[nearest == j].sum(axis=0)
                    norm = np.linalg.norm(centre)
                    if norm > 0:
                        centres[j] = centre / norm
            nearest = (points @ centres.T).argmax(axis=1)
            parts = [(centres[j], rows[nearest == j]) for j in np.unique(nearest)]
        if len(parts) < 2:
            leaf[node] = leaves
            leaves += 1
            continue
        for centre, members in parts:
            children[node].append(len(centroids))
            todo.append((len(centroids), members))
            centroids.append(centre)
            children.append([])
            leaf.append(-1)
    return Tree(np.array(centroids), children, leaf)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _evened(rows: np.ndarray) -> np.ndarray:
    """The rows, each times the power of two that brings its largest component to about 1: squares then stay finite and positive, and no cosine changes."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True, initial=0))[1])


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = _evened(rows)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) with finite components, not all zero, of the most frequent length (of equals the smallest)."""
    rows = vectors.where("vec_id IS NOT NULL").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.size("embedding") > 0)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists("embedding", lambda x: x != 0))
    usual = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("embedding") == (usual.n if usual else 0))


def collapsed(rows: DataFrame, k: int) -> DataFrame:
    """(v1, v2, embedding, ids): each vector once, with its k + 1 smallest ids, each at most k times; two hashes stand for it.

    Whichever id a query leaves out, the k smallest others are there.
    """
    keys = rows.withColumn("v1", F.xxhash64("embedding")).withColumn("v2", F.hash("embedding"))
    ranked = keys.withColumn("r", F.dense_rank().over(W.partitionBy("v1", "v2").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    ranked = ranked.withColumn("again", F.row_number().over(W.partitionBy("v1", "v2", "vec_id").orderBy("vec_id"))).where(F.col("again") <= k)
    return ranked.groupBy("v1", "v2").agg(F.first("embedding").alias("embedding"), F.array_sort(F.collect_list("vec_id")).alias("ids"))


def _own(rows: DataFrame, asked: DataFrame, k: int) -> tuple[int, int]:
    """The most different vectors that stand with one id of a query, and the most of its rows that collapsed() may keep."""
    ids = asked.select(F.col("query_id").alias("vec_id")).distinct()
    each = rows.join(ids, "vec_id", "left_semi").groupBy("vec_id", F.xxhash64("embedding"), F.hash("embedding")).agg(F.least(F.count("*"), F.lit(k)).alias("n"))
    most = each.groupBy("vec_id").agg(F.count("*").alias("vectors"), F.sum("n").alias("rows")).agg(F.max("vectors"), F.max("rows")).first()
    return most[0] or 1, most[1] or 1


def _fit(each: DataFrame, count: int, dim: int, fit_rows: int, leaf_rows: int) -> Tree:
    sample = each.select("v1", "v2", "embedding").orderBy("v2", "v1").limit(fit_rows)
    share = max(8, round(leaf_rows * min(1.0, fit_rows / max(1, count))))

    def fit(batches):
        rows = sorted((a, b, tuple(e)) for x in batches for a, b, e in zip(x["v1"].to_pylist(), x["v2"].to_pylist(), x["embedding"].to_pylist()))
        if rows:
            tree = grow(_unit(np.array([e for _, _, e in rows])), share)
            yield pa.RecordBatch.from_pydict({"c": [tree.centroids.ravel().tolist()], "kids": [tree.children], "leaf": [tree.leaf]}, schema=pa.schema([("c", pa.list_(pa.float64())), ("kids", pa.list_(pa.list_(pa.int32()))), ("leaf", pa.list_(pa.int32()))]))

    found = sample.repartition(1).mapInArrow(fit, "c array<double>, kids array<array<int>>, leaf array<int>").first()
    return Tree(np.array(found.c).reshape(-1, dim), [list(x) for x in found.kids], list(found.leaf))


def _nearest(queries: np.ndarray, points: np.ndarray, k: int):
    """(query, point, score) index arrays of each query's k nearest points, and those as near as the last.

    Matrix products choose; the scores are then computed pair by pair, so that
    a pair's score does not depend on what it was computed with.
    """
    rough = _unit(queries) @ _unit(points).T
    k = min(k, len(points))
    least = -np.partition(-rough, k - 1, axis=1)[:, k - 1] - 1e-9
    q, p = np.nonzero(rough >= least[:, None])
    a, b = _evened(queries)[q], _evened(points)[p]
    return q, p, np.add.reduce(a * b, axis=1) / (np.sqrt(np.add.reduce(a * a, axis=1)) * np.sqrt(np.add.reduce(b * b, axis=1)))


def _calibrated(index: DataFrame, tree: Tree, dim: int, k: int, rows: int, recall: float) -> int:
    """Leaves to visit so that the leaves of true neighbours are among them, for the share ``recall`` of these."""
    chosen = index.select("v1", "v2", "embedding").orderBy(F.xxhash64("v2"), "v1").limit(rows).collect()
    points, sent = np.array([r.embedding for r in chosen]), index.sparkSession.sparkContext.broadcast([(r.v1, r.v2) for r in chosen])
    held = index.sparkSession.sparkContext.broadcast(points)

    def near(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            own = {pair: i for i, pair in enumerate(sent.value)}
            q, p, score = _nearest(held.value, _matrix(batch["embedding"], dim), k + 1)
            pairs = list(zip(batch["v1"].to_pylist(), batch["v2"].to_pylist()))
            other = np.array([own.get(pairs[j]) != i for i, j in zip(q.tolist(), p.tolist())], bool)
            leaf = batch["leaf"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(q[other].astype(np.int32)), pa.array(score[other]), pa.array(leaf[p[other]])], ["q", "score", "leaf"])

    found = index.mapInArrow(near, "q int, score double, leaf int")
    found = found.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "leaf"))).where(F.col("r") <= k).select("q", "leaf").collect()
    if not found:
        return tree.leaves
    order = {}
    for i, x in enumerate(_unit(points)):
        order[i] = {leaf: at for at, leaf in enumerate(tree.best_first(x, tree.leaves))}
    ranks = np.sort([order[r.q][r.leaf] for r in found])
    return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)]) + 1


def search(vectors: DataFrame, is_query, k: int = K, recall: float = RECALL, fit_rows: int = FIT_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row of vectors (vec_id, embedding) that is_query holds for.

    Score: cosine, in double precision; ties go to the smaller vec_id. A row
    with a null id, or with a vector that is null, zero, not finite or of
    another length than most, takes no part. A repeated id is a row of its own,
    but no row with a query's id is its neighbour. Without rows the result is empty.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    each = written(collapsed(rows, k), "vectors")
    count = each.count()
    queries = rows.where(is_query)
    if not count:
        return queries.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    dim = each.select(F.size("embedding").alias("n")).first().n
    tree = spark.sparkContext.broadcast(_fit(each, count, dim, fit_rows, leaf_rows))

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                leaf = tree.value.assign(_unit(_matrix(batch["embedding"], dim)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], [*batch.schema.names, "leaf"])

    id_type = rows.schema["vec_id"].dataType.simpleString()
    index = written(each.mapInArrow(place, f"v1 long, v2 int, embedding array<double>, ids array<{id_type}>, leaf int"), "leaves")
    visits = _calibrated(index, tree.value, dim, k, CALIBRATE_ROWS, recall)

    asked = written(queries.select(F.xxhash64("embedding").alias("v1"), F.hash("embedding").alias("v2"), F.col("vec_id").alias("query_id")), "asked")
    own_vectors, own_rows = _own(rows, asked, k)
    distinct = index.join(asked.select("v1", "v2").distinct(), ["v1", "v2"], "left_semi").select("v1", "v2", "embedding")

    def visit(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = [tree.value.best_first(x, visits) for x in _unit(_matrix(batch["embedding"], dim))]
            at = pa.array(np.repeat(np.arange(len(lists)), [len(x) for x in lists]))
            yield pa.RecordBatch.from_arrays([batch["v1"].take(at), batch["v2"].take(at), batch["embedding"].take(at), pa.array(np.concatenate(lists), pa.int32())], ["v1", "v2", "embedding", "leaf"])

    sizes = written(index.groupBy("leaf").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")), "sizes")
    sizes = small(sizes)
    points = index.join(sizes, "leaf").select("leaf", F.pmod(F.xxhash64("v1", "v2"), F.col("parts")).cast("int").alias("part"), "ids", "embedding")
    visited = distinct.mapInArrow(visit, "v1 long, v2 int, embedding array<double>, leaf int").join(sizes, "leaf")
    visited = visited.select("leaf", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "v1", "v2", "embedding")
    # Points (side 0) come before the queries of their part; queries are then taken in blocks.
    both = points.select("leaf", "part", F.lit(0).alias("side"), F.lit(0).cast("long").alias("v1"), F.lit(0).alias("v2"), "ids", "embedding").union(
        visited.select("leaf", "part", F.lit(1), "v1", "v2", F.lit(None).cast(f"array<{id_type}>"), "embedding")
    )
    both = both.repartition(partitions(spark), "leaf", "part").sortWithinPartitions("leaf", "part", "side")

    def meet(batches):
        """The best of a task for each of its queries, over all leaves and parts that it got."""
        key, ids, vectors_ = None, [], []
        held: list = []
        n = 0

        def best():
            v1, v2, score, first = (np.concatenate(c) for c in list(zip(*held))[:4])
            lists_ = [x for part in held for x in part[4]]
            order = np.lexsort((first, -score, v2, v1))
            new = np.flatnonzero(np.concatenate(([True], (v1[order][1:] != v1[order][:-1]) | (v2[order][1:] != v2[order][:-1]))))
            place = np.arange(len(order)) - np.repeat(new, np.diff(np.append(new, len(order))))
            kept = order[place < k + own_vectors]
            return v1[kept], v2[kept], score[kept], first[kept], [lists_[i] for i in kept.tolist()]

        def told():
            for v1, v2, score, _, lists_ in held:
                yield pa.RecordBatch.from_arrays([pa.array(v1), pa.array(v2), pa.array(score), pa.array(lists_, id_list)], ["v1", "v2", "score", "ids"])

        for batch in batches:
            if not batch.num_rows:
                continue
            id_list = batch.schema.field("ids").type
            leaf, part, side = (batch[c].to_numpy() for c in ("leaf", "part", "side"))
            edge = np.flatnonzero(np.concatenate(([True], (leaf[1:] != leaf[:-1]) | (part[1:] != part[:-1]) | (side[1:] != side[:-1]), [True])))
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                piece = batch.slice(a, b - a)
                if side[a] == 0:
                    if key != (leaf[a], part[a]):
                        key, ids, vectors_ = (leaf[a], part[a]), [], []
                    ids += piece["ids"].to_pylist()
                    vectors_.append(_matrix(piece["embedding"], dim))
                elif key == (leaf[a], part[a]):
                    vectors_ = [np.concatenate(vectors_)] if len(vectors_) > 1 else vectors_
                    firsts = np.array([x[0] for x in ids])
                    for at in range(0, len(piece), 512):
                        block = piece.slice(at, 512)
                        q, p, score = _nearest(_matrix(block["embedding"], dim), vectors_[0], k + own_vectors)
                        held.append((block["v1"].to_numpy()[q], block["v2"].to_numpy()[q], score, firsts[p], [ids[j] for j in p.tolist()]))
                        n += len(q)
                    if n > 1 << 18:
                        held = [best()]
                        n = len(held[0][0])
                        if n > 1 << 17:  # many queries: what they have so far goes on
                            yield from told()
                            held, n = [], 0
        if held:
            held = [best()]
            yield from told()

    best = both.mapInArrow(meet, f"v1 long, v2 int, score double, ids array<{id_type}>")
    best = best.select("v1", "v2", "score", F.explode("ids").alias("vec_id"))
    best = best.withColumn("r", F.row_number().over(W.partitionBy("v1", "v2").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + own_rows)
    lists = best.groupBy("v1", "v2").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near"))
    pairs = asked.join(lists, ["v1", "v2"]).select("query_id", F.filter("near", lambda x: x["vec_id"] != F.col("query_id")).alias("near"))
    return pairs.select("query_id", F.posexplode(F.slice("near", 1, k)).alias("pos", "x")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
