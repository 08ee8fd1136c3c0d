"""A chunk table that follows a stream of files: an addition to the pull-based update."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import sha256
from ..operators.chunking import line_chunks


def latest_files(batch: DataFrame) -> DataFrame:
    """The newest row of each filePath in a batch (filePath, language, content, ts); of equally new ones the last by content, however often a batch runs."""
    newest = F.row_number().over(W.partitionBy("filePath").orderBy(F.desc("ts"), F.desc("content"), "language"))
    return batch.withColumn("_n", newest).where("_n = 1").drop("_n")


def follow(files: DataFrame, apply: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, max_lines: int = 100, overlap: int = 10):
    """Starts a query over the stream files; for each batch apply(paths, chunks, batch number) gets what to
    delete and what to add. Batch numbers make a repeated call recognisable, so that apply can be idempotent."""

    def merge(batch: DataFrame, number: int) -> None:
        newest = latest_files(batch).persist()
        chunks = line_chunks(newest.withColumn("fileHash", sha256(F.col("content"))).drop("ts"), max_lines, overlap)
        apply(newest.select("filePath"), chunks, number)
        newest.unpersist()

    return files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
