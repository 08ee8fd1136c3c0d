"""Substring search by a posting index of trigrams.

Every text has a posting for each different run of three characters, those at its end
filled up, so a literal of one or two characters is the beginning of some run.
The postings of a literal's runs are intersected, and the candidates compared with
the literal itself, so what is found is exactly what a scan would find. Postings
are written in order of run: the files and row groups of other runs aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fills up the runs at the end of a text; a text may hold it too, which at most makes it a candidate.
END = "\0"
#: Rows whose runs are held at once.
ROWS = 256
#: Runs of a literal that are looked up: as many more hardly leave out what these don't.
MOST_RUNS = 12
#: Files up to which the candidates' names are a filter of the scan.
NAMED_FILES = 200


def runs_of(text: Column) -> Column:
    """The different runs of three characters of a text; null for a null one."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    at = lambda all_, i: F.coalesce(F.get(all_, i), F.lit(END))
    # An array of one element names the characters, which would else be split again for each run.
    return F.transform(F.array(chars), lambda all_: F.array_distinct(F.transform(all_, lambda c, i: F.concat(c, at(all_, i + 1), at(all_, i + 2)))))[0]


def postings(rows: DataFrame, text: str = "content", *keys: str) -> DataFrame:
    """(run, keys) for each different run of each row's text. The runs of a batch of rows are numbers, found by one sort a text."""
    made = rows.select(F.col(text).alias("_text"), *keys).mapInArrow(_with_runs, T.StructType([T.StructField("run", T.ArrayType(T.StringType())), *rows.select(*keys).schema.fields]))
    return made.select(F.explode("run").alias("run"), *keys)


def _with_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            part = batch.slice(at, ROWS)
            lists = [None if t is None else _runs(t) for t in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(pa.string())), *part.columns[1:]], ["run", *part.schema.names[1:]])


def _runs(text: str) -> list[str]:
    chars = np.frombuffer((text + END * 2).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    found = np.unique(chars[:-2] << 42 | chars[1:-1] << 21 | chars[2:])
    three = np.stack([found >> 42, found >> 21 & 0x1FFFFF, found & 0x1FFFFF], axis=1).astype(np.uint32)
    whole = three.tobytes().decode("utf-32-le")
    return [whole[i : i + 3] for i in range(0, len(whole), 3)]


def in_order(found: DataFrame, *keys: str) -> DataFrame:
    """Postings as they should be written: by run, and a frequent run's in as many tasks as its number asks for."""
    return found.repartitionByRange("run", *keys).sortWithinPartitions("run", *keys)


def candidates(index: DataFrame, literal: str, *keys: str) -> DataFrame:
    """(keys) of the rows that may contain the literal, which isn't empty: those that have all its runs."""
    if len(literal) < 3:
        return index.where(F.startswith(F.col("run"), F.lit(literal))).select(*keys).distinct()
    runs = list(dict.fromkeys(literal[i : i + 3] for i in range(len(literal) - 2)))
    if len(runs) > MOST_RUNS:
        runs = [runs[i * (len(runs) - 1) // (MOST_RUNS - 1)] for i in range(MOST_RUNS)]
    if len(runs) == 1:
        return index.where(F.col("run") == runs[0]).select(*keys).distinct()
    met = index.where(F.col("run").isin(runs)).groupBy(*keys).agg(F.count_distinct("run").alias("_n"))
    return met.where(F.col("_n") == len(runs)).select(*keys)


def containing(rows: DataFrame, index: DataFrame, literal: str, text: str = "content", path: str = "filePath", key: str = "startLine") -> DataFrame:
    """The rows whose text contains the literal; ``index`` has the postings (run, path, key) of texts, path and key telling rows apart.

    Few candidates are named in a filter of the scan by their paths; many are joined.
    """
    holds = F.contains(F.col(text), F.lit(literal))
    if not literal:
        return rows.where(holds)
    found = candidates(index, literal, path, key)
    few = found.select(path).distinct().limit(NAMED_FILES + 1).collect()
    if len(few) <= NAMED_FILES:
        return rows.where(F.col(path).isin([r[0] for r in few])).where(holds)
    return rows.join(found, [path, key], "left_semi").where(holds)
