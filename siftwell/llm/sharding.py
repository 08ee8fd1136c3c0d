"""Sharding by size-tiered compaction, with a versioned manifest.

Arrivals are appended as small immutable files, one for each task that has rows,
without a shuffle. Compaction takes files of one size tier (a power of two below
the target), packs them into groups of about the target size and writes each
group as one file; files of other sizes aren't touched. Append and compaction
each end by committing a manifest under the next version number with a rename
that fails if the version is there: readers see all of a version or none of it,
and of two writers one has to start again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions, scratch, small, table, unused

#: Bytes of a compacted file; a file of half of that counts as full.
TARGET_BYTES = 32 << 20
#: Files that a round of compaction merges, about, and what that may be raised to.
FILES, MOST_FILES = 20_000, 100_000
MANIFEST = "path string, bytes long, n_rows long"


class ShardStore:
    """Files and manifests below one folder that the driver and all executors share.

    Two writers are kept apart by a rename that fails where the target is there: HDFS does that in one
    step. On file systems that look first and rename then (local folders, object stores) let one writer commit at a time.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def version(self) -> int:
        """The newest committed version; 0 if there is none."""
        folder = self._path(f"{self.root}/commits")
        if not self._fs.exists(folder):
            return 0
        names = (f.getPath().getName() for f in self._fs.listStatus(folder))
        return max((int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()), default=0)

    def _commit_of(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/commits/v{version:08d}"))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> DataFrame:
        """(path, bytes, n_rows) of the files of a version; without commits no rows."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/{self._commit_of(version)['manifest']}")

    def schema(self, version: int) -> T.StructType:
        """The columns of the rows of a version."""
        return T.StructType.fromJson(self._commit_of(version)["schema"])

    def commit(self, files: DataFrame, after: int, what: str, schema: T.StructType) -> int:
        """Makes files the manifest of version after + 1; fails if another writer was first."""
        name = f"manifests/{uuid.uuid4().hex}"
        files.select("path", "bytes", "n_rows").write.parquet(f"{self.root}/{name}")
        said = self._path(f"{self.root}/staging/{uuid.uuid4().hex}")
        stream = self._fs.create(said, False)
        stream.write(bytearray(json.dumps({"version": after + 1, "operation": what, "manifest": name, "schema": schema.jsonValue()}).encode()))
        stream.close()
        self._fs.mkdirs(self._path(f"{self.root}/commits"))
        to = self._path(f"{self.root}/commits/v{after + 1:08d}")
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.valueOf("NONE")
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(self._fs.makeQualified(said), self._fs.makeQualified(to), options)
        return after + 1

    def _written(self, folder: str) -> DataFrame:
        """(path, bytes, n_rows) of the files below folder, from their footers."""
        found = self.spark.read.parquet(f"{self.root}/{folder}")
        about = found.metadataColumn("_metadata")
        files = found.select(about["file_path"].alias("path"), about["file_size"].alias("bytes")).groupBy("path", "bytes").agg(F.count("*").alias("n_rows"))
        return files.withColumn("path", F.expr(f"substring(path, instr(path, '/{folder}') + 1)"))

    def append(self, docs: DataFrame) -> int:
        """Adds docs as new files and commits them; the new version. Later batches must have the columns of the first."""
        before, folder = self.version(), f"data/{uuid.uuid4().hex}"
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema])
        if before and self.schema(before) != schema:
            raise ValueError("the batch has other columns than the store")
        docs.write.option("compression", "zstd").parquet(f"{self.root}/{folder}")
        return self.commit(self.manifest(before).unionByName(self._written(folder)), before, "append", schema)

    def plan(self, target: int = TARGET_BYTES, version: int | None = None) -> DataFrame:
        """(path, bytes, n_rows, shard_group) of the files to merge: two or more of a tier to a group."""
        tier = F.floor(F.log2(F.lit(float(target)) / F.greatest("bytes", F.lit(1))))
        runs = self.manifest(version).where(F.col("bytes") * 2 <= target).withColumn("tier", tier)
        before = F.sum("bytes").over(W.partitionBy("tier").orderBy(F.desc("bytes"), "path").rowsBetween(W.unboundedPreceding, -1))
        packed = runs.withColumn("k", F.floor(F.coalesce(before, F.lit(0)) / target)).withColumn("n", F.count("*").over(W.partitionBy("tier", "k")))
        return packed.where("n > 1").select("path", "bytes", "n_rows", F.concat_ws("-", F.col("tier").cast("int"), "k").alias("shard_group"))

    def compact(self, target: int = TARGET_BYTES, files: int = FILES) -> int:
        """Merges until no tier has two small files to merge; the newest version.

        A round merges whole groups of at most ``files`` files, or one group, and commits: so many names are
        in the driver at once. Every round leaves fewer files, so the rounds end.
        """
        version = self.version()
        if not version:
            return 0
        schema = self.schema(version)
        while True:
            most = min(files, MOST_FILES)
            listed = self.plan(target, version).orderBy("shard_group", "path").limit(most + 1).collect()
            if not listed:
                break
            if len(listed) > most:  # the last group may go on
                whole = [r for r in listed if r.shard_group != listed[-1].shard_group]
                listed = whole if whole else listed[:most]
            chosen = self.spark.createDataFrame(listed, f"{MANIFEST}, shard_group string")
            paths = [r.path for r in listed]
            folder = f"data/{uuid.uuid4().hex}"
            rows = self.spark.read.schema(schema).parquet(*(f"{self.root}/{p}" for p in paths))
            where = rows.metadataColumn("_metadata")["file_path"]
            name, path = unused(rows, "shard_group", "path_of_file")
            rows = rows.select("*", F.regexp_extract(where, "/(data/[^/]+/.*)$", 1).alias(path))
            group = F.broadcast(chosen.select(F.col("path").alias(path), F.col("shard_group").alias(name)))  # at most MOST_FILES rows
            n = max(1, min(len({r.shard_group for r in listed}), 4 * partitions(self.spark)))
            merged = rows.join(group, path).drop(path).repartition(n, name).sortWithinPartitions(name)
            merged.write.option("compression", "zstd").partitionBy(name).parquet(f"{self.root}/{folder}")
            kept = self.manifest(version).join(F.broadcast(chosen.select("path")), "path", "left_anti")
            version = self.commit(kept.unionByName(self._written(folder)), version, "compact", schema)
        return version

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with their file's path as shard (in place of a column of that name)."""
        version = self.version() if version is None else version
        if not version:
            raise ValueError("nothing has been appended")
        paths, schema = [r.path for r in self.manifest(version).select("path").collect()], self.schema(version)
        if not paths:
            return self.spark.createDataFrame([], schema).drop("shard").withColumn("shard", F.lit(""))
        rows = self.spark.read.schema(schema).parquet(*(f"{self.root}/{p}" for p in paths))
        where = rows.metadataColumn("_metadata")["file_path"]
        return rows.drop("shard").select("*", F.regexp_extract(where, "/(data/[^/]+/.*)$", 1).alias("shard"))

    def vacuum(self, keep: int = 2) -> None:
        """Deletes data files that none of the newest ``keep`` versions lists."""
        newest = self.version()
        live = {r.path for v in range(max(1, newest - keep + 1), newest + 1) for r in self.manifest(v).select("path").collect()}
        files = self._fs.listFiles(self._path(f"{self.root}/data"), True)
        gone = []
        while files.hasNext():
            path = files.next().getPath()
            name = path.toString()
            if name.endswith(".parquet") and name[name.index("/data/") + 1 :] not in live:
                gone.append(path)
        for path in gone:
            self._fs.delete(path, False)


def sharded(docs: DataFrame, root: str, target: int = TARGET_BYTES) -> DataFrame:
    """(doc_id, shard, shard_rows, shard_bytes, version) for each row of docs, after append and compaction in root.

    All columns of docs, of any name, are in the files. Nulls, repeated rows and long texts are
    written as they are; a table without rows gives no shards and no rows.
    """
    store = ShardStore(docs.sparkSession, root)
    store.append(docs)
    version = store.compact(target)
    listed = store.manifest(version).select(F.col("path").alias("shard"), F.col("n_rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"))
    return store.read(version).select("doc_id", "shard").join(small(listed), "shard").select("doc_id", "shard", "shard_rows", "shard_bytes", F.lit(version).alias("version"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"), scratch(spark, "shards"))


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each row of docs is in the newest version of a new store of shards; see sharded for odd rows and columns."""
    return sharded(docs, scratch(spark, "shards"))
