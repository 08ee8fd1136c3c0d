"""Searches a table of files for every row of a table of queries: the hybrid search, many queries at once.

Files are cut into chunks; each query gets the chunks that are best by vector and
BM25 together, as a single search would give. The hits are written to <output>,
partitioned by the language of their files, and replace those of an earlier run.

    python -m jobs.search_batch FILES QUERIES OUTPUT [--config FILE]
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.vectors import hash_embedding
from siftwell.operators.chunking import line_chunks
from siftwell.operators.search import search_code_of_each

from .common import config_of, session
from .index_files import files_of

HITS = "query_id long, rank int, filePath string, startLine int, endLine int, score double, language string"

log = logging.getLogger("jobs.search_batch")


def run(spark: SparkSession, files_path: str, queries_path: str, output_path: str, config: dict | None = None) -> dict:
    """Writes the hits of all queries; how many queries, hits and languages there were."""
    config = config or config_of("search_batch")
    files = files_of(spark.read.parquet(files_path), config)
    chunks = line_chunks(files, config["max_lines"], config["overlap"]).withColumn("vector", hash_embedding(F.col("summary")))
    asked = spark.read.parquet(queries_path).select(F.col(config["query_column"]).cast("long").alias("query_id"), F.coalesce(config["query_text_column"], F.lit("")).alias("query")).dropDuplicates(["query_id"])
    asked = asked.withColumn("query_vector", hash_embedding(F.col("query")))
    candidates = []

    def held(found: DataFrame) -> DataFrame:
        candidates.append(found.persist())
        return candidates[-1]

    hits = search_code_of_each(chunks, asked, config["limit"], held)
    hits.select(*(c.split()[0] for c in HITS.split(", "))).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("language").parquet(output_path)
    for found in candidates:
        found.unpersist()
    kept = spark.read.schema(HITS).parquet(output_path)
    found = kept.groupBy("language").agg(F.count(F.lit(1)).alias("n")).collect()
    by_language = {r.language: r.n for r in found}
    n = asked.count()
    log.info("read %d queries of %s and the files of %s", n, queries_path, files_path)
    log.info("wrote %d hits to %s: %s", sum(by_language.values()), output_path, ", ".join(f"{k} {v}" for k, v in sorted(by_language.items())))
    return {"queries": n, "hits_written": sum(by_language.values()), "by_language": by_language}


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("files", "queries", "output"):
        parser.add_argument(name)
    parser.add_argument("--config")
    given = parser.parse_args()
    spark = session("search_batch")
    try:
        run(spark, given.files, given.queries, given.output, config_of("search_batch", given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
