"""Snapshot changes: what was added, modified or deleted, and merging it into an index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def detect_changes(current: DataFrame, stored: DataFrame) -> DataFrame:
    """(filePath, status) from current (filePath, fileHash) and stored (filePath, fileHash).

    A file without a stored hash, or with an empty one, is added. A current file
    with a null hash couldn't be read: it is ignored, and not deleted either.
    """
    a = current.select("filePath", F.col("fileHash").alias("now"), F.lit(True).alias("is_current"))
    b = stored.select("filePath", F.col("fileHash").alias("old"), F.lit(True).alias("is_stored"))
    status = (
        F.when(F.col("is_current").isNull(), "deleted")
        .when(F.col("now").isNull(), None)
        .when(F.coalesce("old", F.lit("")) == "", "added")
        .when(F.col("now") != F.col("old"), "modified")
    )
    return a.join(b, "filePath", "full_outer").select("filePath", status.alias("status")).where("status IS NOT NULL")


def change_counts(changes: DataFrame) -> DataFrame:
    """(status, n)."""
    return changes.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def delete_paths(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """rows whose filePath isn't among paths (filePath)."""
    return rows.join(paths.select("filePath"), "filePath", "left_anti").select(rows.columns)


def newest_of(log: DataFrame, key: str, order: str) -> DataFrame:
    """Of a log's rows the one of each key with the largest ``order``; ties by the other columns, so that equal logs give equal rows."""
    rest = [c for c in log.columns if c not in (key, order)]
    newest = log.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("_row"))
    return newest.select(key, "_row.*").select(log.columns)


def merged(stored: DataFrame, changes: DataFrame, fresh: DataFrame) -> DataFrame:
    """The next version of a table: without the rows of modified and deleted files, with the fresh ones."""
    gone = changes.where(F.col("status").isin("modified", "deleted"))
    return delete_paths(stored, gone).unionByName(fresh)


def reused_vectors(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """fresh (filePath, id, summary, ..) with the stored vector where path, id and summary are the same, else null."""
    old = stored.select("filePath", "id", F.sha2("summary", 256).alias("_s"), "vector").dropDuplicates(["filePath", "id", "_s"])
    return fresh.drop("vector").withColumn("_s", F.sha2("summary", 256)).join(old, ["filePath", "id", "_s"], "left").drop("_s")


def file_rollup(chunks: DataFrame, *more: Column) -> DataFrame:
    """(filePath, language, fileHash, chunkCount, symbolCount, indexedAt) and more aggregates: a row for each file of chunks."""
    return chunks.groupBy("filePath").agg(
        F.first("language").alias("language"),
        F.first("fileHash").alias("fileHash"),
        F.count(F.lit(1)).cast("int").alias("chunkCount"),
        F.count_if(F.col("symbolName") != "").cast("int").alias("symbolCount"),
        F.max("indexedAt").alias("indexedAt"),
        *more,
    )
