"""Follows a table of files and keeps their chunks: new Parquet files of the table are read once.

The table is read as a stream of its Parquet files up to those that are there,
and the stream's checkpoint is the high-water mark. A batch writes the chunks of
its files to <output>/chunks, partitioned by batch and language, and then a row for
each file to <output>/files, partitioned by batch. A batch that runs again replaces
its own partitions, so a run that was cut short, or is repeated, gives the same
rows. What is written grows with what is new, not with what is there.

A file that comes again, changed, has rows in more than one batch; ``current`` gives
those of the newest. A batch counts once its rows in <output>/files are there.

    python -m jobs.index_files INPUT OUTPUT CHECKPOINT [--config FILE]
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.text import sha256
from siftwell.operators.changes import newest_of
from siftwell.streaming.follow import follow

from .common import config_of, read_if_there, session

CHUNKS = "id string, filePath string, startLine int, endLine int, contentHash string, summary string, fileHash string, batch long, language string"
FILES = "filePath string, fileHash string, chunkCount long, language string, batch long"

log = logging.getLogger("jobs.index_files")


def files_of(rows: DataFrame, config: dict) -> DataFrame:
    """(filePath, language, content) of the table's rows; a null language is "unknown", as an empty one, and a null content is empty."""
    path = F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in config["path_columns"]))
    language = F.coalesce(F.when(F.trim(config["language_column"]) != "", F.col(config["language_column"])), F.lit("unknown"))
    return rows.select(F.concat(path, F.lit(config["extension"])).alias("filePath"), language.alias("language"), F.coalesce(config["content_column"], F.lit("")).alias("content"))


def _as_pattern(path: str) -> str:
    """The path as a pattern that only it matches: a stream reads a folder, but one file only by a pattern."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, input_path: str, output_path: str, checkpoint_path: str, config: dict | None = None) -> dict:
    """Takes in what is new in the table at input_path; how many rows were read and written, and by which batches."""
    config = config or config_of("index_files")
    schema = spark.read.parquet(input_path).schema
    stream = spark.readStream.schema(schema)
    if config["max_files_per_batch"]:
        stream = stream.option("maxFilesPerTrigger", config["max_files_per_batch"])
    rows = stream.parquet(_as_pattern(input_path))
    files = files_of(rows, config).withColumn("ts", rows.metadataColumn("_metadata")["file_modification_time"])
    written = []

    def save(_paths: DataFrame, chunks: DataFrame, number: int) -> None:
        made = chunks.withColumn("contentHash", sha256(F.col("content"))).withColumn("batch", F.lit(number).cast("long"))
        made.select(*_names(CHUNKS)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "language").parquet(f"{output_path}/chunks")
        kept = spark.read.schema(CHUNKS).parquet(f"{output_path}/chunks").where(F.col("batch") == number)
        each = kept.groupBy("filePath", "fileHash", "language", "batch").agg(F.count(F.lit(1)).alias("chunkCount"))
        each.select(*_names(FILES)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{output_path}/files")
        written.append(number)

    query = follow(files, save, checkpoint_path, config["max_lines"], config["overlap"])
    query.awaitTermination()
    read = sum(p["numInputRows"] for p in query.recentProgress)
    new = read_if_there(spark, f"{output_path}/chunks", CHUNKS).where(F.col("batch").isin(written)) if written else None
    by_language = {r.language: r.n for r in new.groupBy("language").agg(F.count(F.lit(1)).alias("n")).collect()} if new is not None else {}
    log.info("read %d rows of %s in %d batches", read, input_path, len(written))
    log.info("wrote %d chunks to %s: %s", sum(by_language.values()), output_path, ", ".join(f"{k} {n}" for k, n in sorted(by_language.items())) or "nothing new")
    return {"rows_read": read, "batches": written, "chunks_written": sum(by_language.values()), "by_language": by_language}


def current(spark: SparkSession, output_path: str) -> DataFrame:
    """The chunks of the newest version of each file."""
    files = newest_of(read_if_there(spark, f"{output_path}/files", FILES), "filePath", "batch").select("filePath", "batch")
    return read_if_there(spark, f"{output_path}/chunks", CHUNKS).join(files, ["filePath", "batch"], "left_semi").select(*_names(CHUNKS))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("input", "output", "checkpoint"):
        parser.add_argument(name)
    parser.add_argument("--config")
    given = parser.parse_args()
    spark = session("index_files")
    try:
        run(spark, given.input, given.output, given.checkpoint, config_of("index_files", given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
