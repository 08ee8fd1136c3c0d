"""Nearest rows to one vector, or to each of a set of vectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.vectors import similarity_to
from .blocks import Nearest

#: Queries that are sent to the rows, or that stand in one block; rows of a block, and rows of it that are met at once.
QUERY_BLOCK, ROW_BLOCK, MET = 4096, 16_384, 8192


def nearest(rows: DataFrame, vector: Sequence[float], k: int, tie: str = "id", column: str = "vector") -> DataFrame:
    """The k rows with the smallest cosine distance, nearest first, with the column distance; ties by ``tie``.

    Filter rows first: the filter then reaches the scan. Zero vectors have no distance and are left out.
    """
    found = rows.withColumn("distance", 1 - similarity_to(column, vector))
    # Filtered after the limit: before it, the filter would repeat the whole distance below every projection.
    return found.orderBy(F.asc_nulls_last("distance"), tie).limit(k).where("distance IS NOT NULL")


def sendable(rows: DataFrame, column: str) -> DataFrame:
    """Vectors as arrays of floats or doubles. None is filtered here: that would repeat what makes them below every projection."""
    kind = rows.schema[column].dataType
    return rows if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType)) else rows.withColumn(column, F.col(column).cast("array<double>"))


def nearest_to_each(rows: DataFrame, queries: DataFrame, k: int, tie: str = "id", column: str = "vector") -> DataFrame:
    """(query_id, rank, tie, distance) of the k nearest rows to each of queries (query_id, query_vector).

    A stated set of queries meets all rows, as matrices. Up to QUERY_BLOCK queries are sent to the rows, which stay
    where they are; more meet in a grid of blocks of about QUERY_BLOCK queries and ROW_BLOCK rows, whatever the number
    of either: a row is sent once for so many queries that it is compared with. Each task keeps its k best a query.
    """
    asked, held = sendable(queries.select("query_id", "query_vector"), "query_vector"), sendable(rows.select(tie, column), column)
    kinds = T.StructType([T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField(tie, held.schema[tie].dataType), T.StructField("distance", T.DoubleType())])

    def table(nearest: Nearest, schema: pa.Schema) -> pa.Table:
        found = nearest.found()
        return schema.empty_table() if found is None else pa.Table.from_arrays([c.cast(f.type) for c, f in zip(found, schema)], schema=schema)

    count = asked.count()
    shape = to_arrow_schema(kinds)
    if count <= QUERY_BLOCK:
        sent = asked.toArrow()

        def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nearest = Nearest(sent["query_id"], sent["query_vector"], k)
            for batch in batches:
                nearest.meet(batch.column(0), batch.column(1))
            yield from table(nearest, shape).to_batches()

        met = held.mapInArrow(of_task, kinds)
    else:
        asked_in, held_in = -(-count // QUERY_BLOCK), max(1, -(-held.count() // ROW_BLOCK))
        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        blocks = asked.select("query_id", "query_vector", F.pmod(F.xxhash64("query_id"), F.lit(asked_in)).cast("int").alias("_q"), each(held_in).alias("_r"))
        spread = held.select(F.col(tie).alias("_tie"), F.col(column).alias("_vector"), each(asked_in).alias("_q"), F.pmod(F.xxhash64(tie), F.lit(held_in)).cast("int").alias("_r"))

        def of_block(part: pa.Table, whose: pa.Table) -> pa.Table:
            nearest = Nearest(whose["query_id"], whose["query_vector"], k)
            for at in range(0, len(part), MET):
                some = part.slice(at, MET).combine_chunks()
                nearest.meet(some["_tie"], some["_vector"])
            return table(nearest, shape)

        met = spread.groupBy("_q", "_r").cogroup(blocks.groupBy("_q", "_r")).applyInArrow(of_block, kinds)
    ranked = met.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("distance", tie))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", tie, "distance")
