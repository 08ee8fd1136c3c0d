"""What the operators share: tables, shared scratch space, chunks of Arrow batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows up to which a table of a few narrow columns may be broadcast.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    A folder of this machine is set only where the session names none and runs
    on this machine alone, as in tests on local[*].
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if found:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(found)
        return found.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("on a cluster set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir().rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended: its owner clears the shared folder
        pass


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/siftwell-{what}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count of its rows proves it small, else as it is.

    Call it on written tables of a few narrow columns: the count is then read
    from Parquet footers.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def byte_chunks(column: pa.Array, most: int = 1 << 18):
    """(first row, offsets, bytes) for runs of rows of at most ``most`` bytes, one row at least.

    A null counts as an empty text.
    """
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        yield at, ends[at : to + 1] - ends[at], data[ends[at] : ends[to]]
        at = to


def narrow_batches(batches, most: int = 4 << 20):
    """The same rows in batches of about ``most`` bytes, so that long texts don't pile up in one worker."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * most / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def with_hash(docs: DataFrame) -> DataFrame:
    """(doc_id, th, text): a hash of the text tells rows with one doc_id apart."""
    return docs.select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("th"), "text")


def unused(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of df has, in whatever letter case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def to_arrow(kind: T.DataType) -> pa.DataType:
    """The Arrow type that Spark sends a column of this type as."""
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def packed(rows: DataFrame, *columns: str) -> DataFrame:
    """(doc_id, th, blob): the integers in columns of a document's rows, 8 bytes each, in no order.

    For rows whose number a document's length bounds.
    """
    entry = F.concat(*(F.lpad(F.hex(F.col(c).cast("long")), 16, "0") for c in columns))
    return rows.groupBy("doc_id", "th").agg(F.unhex(F.array_join(F.collect_list(entry), "")).alias("blob"))


def unpacked(blob: bytes, width: int) -> np.ndarray:
    return np.frombuffer(blob, ">i8").astype(np.int64).reshape(-1, width)


#: Bytes of lists up to which they may be broadcast to the documents.
LIST_BYTES = 64 << 20


def listed(docs: DataFrame, lists: DataFrame, how: str = "inner", broadcast_bytes: int = 0) -> DataFrame:
    """(doc_id, th, text, blob): documents with their list: a join by key, or a broadcast of lists of at most broadcast_bytes."""
    lists = lists.withColumnRenamed("doc_id", "_id").withColumnRenamed("th", "_th")
    if broadcast_bytes and (lists.agg(F.sum(F.length("blob") + 64)).first()[0] or 0) <= broadcast_bytes:
        lists = F.broadcast(lists)
    docs = with_hash(docs)
    return docs.join(lists, docs["doc_id"].eqNullSafe(F.col("_id")) & (docs["th"] == F.col("_th")), how).select("doc_id", "th", "text", "blob")
