"""What the jobs share: configuration, logs, the session of a command line."""

from __future__ import annotations

import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def config_of(name: str, path: str | None = None) -> dict:
    """The job's defaults, from the file beside it, with what the file at ``path`` sets; an unknown setting is an error."""
    found = json.loads((Path(__file__).parent / f"{name}.json").read_text(encoding="utf-8"))
    if path:
        own = json.loads(Path(path).read_text(encoding="utf-8"))
        unknown = sorted(set(own) - set(found))
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(unknown)}; known are {', '.join(sorted(found))}")
        found |= own
    return found


def session(name: str) -> SparkSession:
    """For command lines only: a session with the cluster's own settings."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return SparkSession.builder.appName(name).getOrCreate()


def read_if_there(spark: SparkSession, path: str, schema) -> DataFrame:
    """A Parquet table, or one without rows if nothing has been written to the path yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)
