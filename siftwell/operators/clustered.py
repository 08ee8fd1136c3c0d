"""Exact nearest rows from a stored index that is read in part.

Rows are stored by cluster, each cluster with its centre and its radius. Vectors
are compared at length 1, where the cosine distance is half the square of the
straight one, so the triangle inequality holds: no row of a cluster is nearer to a
query than the centre is, less the radius. A query first reads the clusters next to
it until these have k rows; the k-th distance found then tells which clusters can
hold a row as near. The rest isn't compared with it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.vectors import norm
from .blocks import LEAST, MOST, Nearest, by_length, norms
from .knn import MET, QUERY_BLOCK, ROW_BLOCK, sendable

#: Rows that the centres are fitted to, about, and clusters at most. All rows are stored, each with the centre next to it.
SAMPLE, MOST_CLUSTERS = 100_000, 1024
#: What rounding may add to a distance.
SLACK = 1e-6


def _unit(vector: Column) -> Column:
    doubles = vector.cast("array<double>")
    return F.transform(F.array(F.struct(doubles.alias("v"), norm(doubles).alias("n"))), lambda s: F.transform(s["v"], lambda x: x / s["n"]))[0]


def _apart(a: Column, b: Column) -> Column:
    """The straight distance of two vectors."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


@dataclass
class ClusteredIndex:
    """rows: the stored rows with cluster and reach, the distance from its centre; clusters: (cluster, centre, radius, n), at most MOST_CLUSTERS."""

    rows: DataFrame
    clusters: DataFrame

    @staticmethod
    def read(spark: SparkSession, path: str) -> ClusteredIndex:
        return ClusteredIndex(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/clusters"))


def cluster(rows: DataFrame, path: str, tie: str = "id", column: str = "vector", clusters: int | None = None) -> ClusteredIndex:
    """Stores rows by cluster below path. Vectors that are null, zero or not finite have no distance and are left out, as a scan does.

    Vectors have one length. clusters: how many, else about the root of the number of rows. A table without rows gives an index without rows.
    """
    spark = rows.sparkSession
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(column, lambda x: x != 0)
    usable = rows.where(finite)
    count = usable.count()
    k = max(2, min(MOST_CLUSTERS, clusters or round(count**0.5), count))
    work = usable.withColumn("_unit", _unit(F.col(column)))
    if count > 1:
        share = max(1, count // SAMPLE)
        sample = work.where(F.pmod(F.xxhash64(tie), F.lit(share)) == 0) if share > 1 else work
        model = KMeans(k=k, seed=1, maxIter=10, featuresCol="_features", predictionCol="cluster").fit(sample.select(array_to_vector("_unit").alias("_features")))
        centres = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, centre array<double>")
        placed = model.transform(work.withColumn("_features", array_to_vector("_unit"))).drop("_features")
    else:
        centres = spark.createDataFrame([(0, list(r[0])) for r in work.select("_unit").collect()], "cluster int, centre array<double>")  # one row, or none
        placed = work.withColumn("cluster", F.lit(0))
    placed = placed.join(F.broadcast(centres), "cluster").withColumn("reach", _apart(F.col("_unit"), F.col("centre"))).drop("centre", "_unit")
    # A rebalanced write: a cluster with many rows goes to several files, small ones share a task.
    placed.hint("rebalance", "cluster").sortWithinPartitions("cluster", "reach").write.mode("overwrite").partitionBy("cluster").parquet(f"{path}/rows")
    stored = spark.read.schema(placed.schema).parquet(f"{path}/rows")
    about = stored.groupBy("cluster").agg(F.max("reach").alias("radius"), F.count(F.lit(1)).alias("n"))
    about.join(F.broadcast(centres), "cluster").write.mode("overwrite").parquet(f"{path}/clusters")
    return ClusteredIndex(stored, spark.read.parquet(f"{path}/clusters"))


def nearest_to_each_stored(index: ClusteredIndex, queries: DataFrame, k: int, tie: str = "id", column: str = "vector", where: Column | None = None) -> DataFrame:
    """(query_id, rank, tie, distance, scanned) of the k nearest stored rows to each of queries (query_id, query_vector), as nearest_to_each gives them.

    where: a filter of the rows, applied before. scanned: how many stored rows the clusters have that were read for the query.
    Clusters stand together in blocks of about ROW_BLOCK rows, larger ones are dealt to several; a query is sent once to
    a block that holds a cluster it needs, whatever the number of these, and meets their rows as matrices.
    """
    clusters = index.clusters.orderBy("cluster").collect()  # at most MOST_CLUSTERS
    asked = sendable(queries.select("query_id", "query_vector"), "query_vector").where(norm(F.col("query_vector")) > 0)
    rows = sendable((index.rows if where is None else index.rows.where(where)).select(tie, column, "cluster"), column)
    query_id = T.StructField("query_id", asked.schema["query_id"].dataType)
    kinds = T.StructType([query_id, T.StructField(tie, rows.schema[tie].dataType), T.StructField("distance", T.DoubleType()), T.StructField("held", T.LongType())])
    few = asked.count() <= QUERY_BLOCK

    blocks, filled = [], ROW_BLOCK  # (cluster, block, parts): a block of several clusters, or a cluster's first of several blocks
    for c in clusters:
        parts = max(1, -(-c.n // ROW_BLOCK))
        if parts > 1 or filled + c.n > ROW_BLOCK:
            block, filled = (blocks[-1][1] + blocks[-1][2] if blocks else 0), 0
        filled += c.n
        blocks.append((c.cluster, block, parts))
        if parts > 1:
            filled = ROW_BLOCK

    def needed(within: DataFrame | None) -> DataFrame:
        """(query_id, query_vector, bound, block, clusters, held): the blocks that each query needs; the clusters next to it without bounds."""
        given = asked.withColumn("bound", F.lit(float("inf"))) if within is None else asked.join(within, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        return given.mapInArrow(_needed(clusters, blocks, k, within is None), T.StructType([query_id, asked.schema["query_vector"], *T.StructType.fromDDL("bound double, block int, clusters array<int>, held long")]))

    def best(pairs: DataFrame) -> DataFrame:
        """(query_id, tie, distance, held) for each block: its k best rows for a query, and a row without tie that tells how many were met."""
        stored = rows
        if few:  # the folders of other clusters aren't read
            stored = rows.where(F.col("cluster").isin([r[0] for r in pairs.select(F.explode("clusters")).distinct().collect()]))
        placed = F.broadcast(rows.sparkSession.createDataFrame(blocks, "cluster int, _block int, _parts int"))
        stored = stored.join(placed, "cluster").select(F.col(tie).alias("_tie"), F.col(column).alias("_vector"), "cluster", (F.col("_block") + F.pmod(F.xxhash64(tie), F.col("_parts"))).cast("int").alias("block"))
        return stored.groupBy("block").cogroup(pairs.groupBy("block")).applyInArrow(_met(k, to_arrow_schema(kinds)), kinds)

    near = best(needed(None)).where("held IS NULL").groupBy("query_id").agg(F.get(F.array_sort(F.collect_list("distance")), F.lit(k - 1)).alias("d"))
    bounds = near.select("query_id", F.when(F.col("d").isNotNull(), F.sqrt(F.greatest(2 * F.col("d"), F.lit(0.0))) + SLACK).otherwise(float("inf")).alias("bound"))
    of_query = W.partitionBy("query_id")
    found = best(needed(bounds)).withColumn("scanned", F.sum("held").over(of_query))
    ranked = found.withColumn("rank", F.row_number().over(of_query.orderBy(F.col("held").isNotNull(), "distance", tie))).where(F.col("held").isNull() & (F.col("rank") <= k))
    return ranked.select("query_id", "rank", tie, "distance", "scanned")


def _needed(clusters: list, blocks: list[tuple[int, int, int]], k: int, nearest_only: bool):
    """A task's part of what tells the blocks that queries need: those with the clusters next to them until these have k rows, or with any that a bound doesn't exclude."""
    centres, radius = np.array([c.centre for c in clusters]), np.array([c.radius for c in clusters])
    n, names = np.array([c.n for c in clusters], dtype=np.int64), np.array([c.cluster for c in clusters])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {c: [] for c in ("at", "block", "clusters", "held")}
            bound = batch.column(2).to_numpy(zero_copy_only=False)
            for places, matrix in by_length(batch.column(1)) if len(clusters) else ():
                if matrix.shape[1] != centres.shape[1]:
                    continue
                for s in range(0, len(places), 1024):
                    at, some = places[s : s + 1024], matrix[s : s + 1024]
                    length = norms(some)
                    plain = (length >= LEAST) & (length <= MOST)
                    unit = some / np.where(plain, length, 1)[:, None]
                    with np.errstate(all="ignore"):
                        squares = (unit * unit).sum(1)[:, None] - 2 * unit @ centres.T + (centres * centres).sum(1)
                    gap = np.sqrt(np.maximum(squares, 0))
                    gap[~plain] = np.nan  # no bound holds: they need every cluster
                    if nearest_only:
                        order = np.argsort(gap, axis=1, kind="stable")
                        before = np.cumsum(n[order], axis=1) - n[order]
                        wanted = np.zeros(gap.shape, bool)
                        np.put_along_axis(wanted, order, before < k, axis=1)
                    else:
                        wanted = ~(gap - radius - SLACK > bound[at][:, None])
                    for i, mine in zip(at, wanted):
                        by_block: dict[tuple[int, int], list[int]] = {}
                        for c in np.flatnonzero(mine):
                            by_block.setdefault(blocks[c][1:], []).append(int(c))
                        for (block, parts), of in by_block.items():
                            for part in range(parts):
                                out["at"].append(i), out["block"].append(block + part), out["clusters"].append(names[of])
                                out["held"].append(int(n[of].sum()) if part == 0 else 0)
            at = pa.array(out["at"], pa.int64())
            columns = [c.take(at) for c in batch.columns] + [pa.array(out["block"], pa.int32()), pa.array(out["clusters"], pa.list_(pa.int32())), pa.array(out["held"], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "query_vector", "bound", "block", "clusters", "held"])

    return run


def _met(k: int, shape: pa.Schema):
    """A block's rows and the queries that need it: its k best for each, as ``best`` gives them."""

    def run(stored: pa.Table, asked: pa.Table) -> pa.Table:
        tables = []
        of_row = stored["cluster"].to_numpy()
        order = np.argsort(of_row, kind="stable")
        names, starts = np.unique(of_row[order], return_index=True)
        ends = dict(zip(names.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(order)])))
        for s in range(0, len(asked), QUERY_BLOCK):
            some = asked.slice(s, QUERY_BLOCK).combine_chunks()
            # A bound is a straight distance at length 1.
            nearest = Nearest(some["query_id"], some["query_vector"], k, some["bound"].to_numpy() ** 2 / 2)
            lists = some["clusters"].combine_chunks()
            lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
            whose, wanted = pc.list_parent_indices(lists).to_numpy(), lists.flatten().to_numpy()
            for c in np.unique(wanted):
                at, end = ends.get(int(c), (0, 0))
                for a in range(at, end, MET):
                    mine = stored.take(pa.array(order[a : min(end, a + MET)])).combine_chunks()
                    nearest.meet(mine["_tie"], mine["_vector"], whose[wanted == c])
            found = nearest.found()
            if found is not None:
                tables.append(pa.Table.from_arrays([x.cast(f.type) for x, f in zip(found, shape)] + [pa.nulls(len(found[0]), pa.int64())], schema=shape))
            tables.append(pa.Table.from_arrays([some["query_id"].cast(shape[0].type), pa.nulls(len(some), shape[1].type), pa.nulls(len(some), pa.float64()), some["held"].cast(pa.int64())], schema=shape))
        return pa.concat_tables(tables) if tables else shape.empty_table()

    return run


def nearest_stored(index: ClusteredIndex, vector: Sequence[float], k: int, tie: str = "id", column: str = "vector", where: Column | None = None) -> DataFrame:
    """The same for one vector: (rank, tie, distance, scanned)."""
    one = index.rows.sparkSession.createDataFrame([(0, [float(x) for x in vector])], "query_id int, query_vector array<double>")
    return nearest_to_each_stored(index, one, k, tie, column, where).drop("query_id").orderBy("rank")
