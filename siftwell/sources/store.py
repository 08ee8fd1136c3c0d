"""The index: two Parquet tables and their metadata, published together by commit.

A commit is a small file that names a version's folder and the batches of it that
count. A full index is a new version of one batch; an update adds a batch with the
rows of the files that changed, and the paths whose rows in earlier batches no longer
count. So an update writes what is new and no more, and a reader leaves out the
dead rows as it reads; a version with many of them is written anew (``compact``).

Commits are numbered, and a number can be taken once: of two writers that began
from the same commit the later one gets a ConflictError and has changed nothing. A
failed or killed run leaves the last commit as it was, and readers never see half of one.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.trigrams import containing, in_order, postings
from .folders import Folder

CHUNKS = "id string, vector array<float>, filePath string, startLine int, endLine int, content string, symbolName string, symbolType string, language string, parentSymbol string, summary string, fileHash string, indexedAt timestamp"
FILES = "filePath string, vector array<float>, language string, fileHash string, chunkCount int, symbolCount int, indexedAt timestamp"
RUNS = "run string, filePath string, startLine int"
VERSION = "0.1.0"
#: Dead paths up to which they are sent to all tasks that read, and batches up to which a version isn't written anew.
SENT_PATHS, MOST_BATCHES = 200_000, 32


def normalize_project(path: str) -> str:
    return os.path.normpath(os.path.abspath(path)).replace("\\", "/")


def project_key(path: str) -> str:
    """16 hexadecimal digits for a project."""
    return hashlib.sha256(normalize_project(path).encode()).hexdigest()[:16]


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


class IncompleteIndexError(RuntimeError):
    pass


class ConflictError(RuntimeError):
    """Another writer has committed since this one began; nothing has been changed."""


@dataclass
class Snapshot:
    """What a commit says: its number, the version's folder, the batches that count and how many dead paths these name."""

    store: IndexStore
    number: int
    version: str
    batches: list[str]
    dead: int
    metadata: dict

    def _rows(self, name: str, schema: str) -> DataFrame:
        base = f"{self.store.root}/{self.version}/{name}"
        if not self.batches or not self.store.folder.exists(f"{self.version}/{name}/batch={self.batches[0]}"):
            raise IncompleteIndexError(f"The index is incomplete: it has no {name} table. Run 'reindex'.")
        return self.store.spark.read.schema(f"{schema}, batch string").option("basePath", base).parquet(*(f"{base}/batch={b}" for b in self.batches))

    def _live(self, name: str, schema: str) -> DataFrame:
        rows = self._rows(name, schema)
        if self.dead:
            base = f"{self.store.root}/{self.version}/dead"
            dead = self.store.spark.read.schema("filePath string, batch string").option("basePath", base).parquet(*(f"{base}/batch={b}" for b in self.batches[1:]))
            dead = dead.groupBy(F.col("filePath").alias("_path")).agg(F.max("batch").alias("_until"))
            dead = F.broadcast(dead) if self.dead <= SENT_PATHS else dead
            rows = rows.join(dead, (F.col("filePath") == F.col("_path")) & (F.col("batch") < F.col("_until")), "left_anti")
        return rows.select(*names(schema))

    @cached_property
    def chunks(self) -> DataFrame:
        return self._live("chunks", CHUNKS)

    @cached_property
    def files(self) -> DataFrame:
        return self._live("files", FILES)

    def containing(self, literal: str) -> DataFrame:
        """The chunks whose content contains the literal: by the index of runs if the version has one, else by a scan."""
        if not self.store.folder.exists(f"{self.version}/runs/batch={self.batches[0]}"):
            return self.chunks.where(F.contains("content", F.lit(literal)))
        base = f"{self.store.root}/{self.version}/runs"
        # Postings of dead rows lead to nothing, or to newer rows that are compared like any other.
        index = self.store.spark.read.schema(RUNS).option("basePath", base).parquet(*(f"{base}/batch={b}" for b in self.batches))
        return containing(self.chunks, index, literal)


class IndexStore:
    """One project's index below ``home``, a folder of any file system that driver and executors share.

    with_runs: new versions have an index of the runs of three characters in contents beside the chunks, and
    updates go on with what a version has.
    """

    def __init__(self, spark: SparkSession, home: str, project: str, with_runs: bool = False) -> None:
        self.spark, self.with_runs = spark, with_runs
        self.root = f"{home.rstrip('/')}/projects/{project_key(project)}"
        self.folder = Folder(spark, self.root)
        #: For writers of one machine; those of different ones are kept apart by the numbers of commits.
        self.lock_path = f"{os.path.expanduser('~/.siftwell') if '://' in home else home}/projects/{project_key(project)}/index.lock"

    def _numbers(self) -> list[int]:
        return sorted(int(n.split(".")[0]) for n in self.folder.names("commits") if n.endswith(".json"))

    def snapshot(self) -> Snapshot | None:
        """The newest commit that can be read; None if there is none."""
        return next(self._commits(), None)

    def _commits(self):
        """The commits that can be read, the newest first."""
        for number in reversed(self._numbers()):
            try:
                found = json.loads(self.folder.read(f"commits/{number:08d}.json"))
                yield Snapshot(self, number, found["version"], found["batches"], found["dead"], found["metadata"])
            except (ValueError, KeyError):
                continue

    def metadata(self) -> dict | None:
        """What was saved with the newest commit."""
        found = self.snapshot()
        return found and found.metadata

    def _newest(self, name: str) -> Snapshot:
        found = self.snapshot()
        if found is None:
            raise IncompleteIndexError(f"The index is incomplete: it has no {name} table. Run 'reindex'.")
        return found

    def chunks(self) -> DataFrame:
        return self._newest("chunks").chunks

    def files(self) -> DataFrame:
        return self._newest("files").files

    def _write(self, version: str, batch: str, chunks: DataFrame, files_of, with_runs: bool) -> DataFrame:
        """The chunks of a batch as written, and beside them files_of these. In order of path, so that a file's rows stand together."""
        base = f"{self.root}/{version}"
        ordered = chunks.select(*names(CHUNKS)).sortWithinPartitions("language", "filePath", "startLine")
        ordered.write.partitionBy("language").parquet(f"{base}/chunks/batch={batch}")
        kept = self.spark.read.schema(CHUNKS).parquet(f"{base}/chunks/batch={batch}")
        files_of(kept).select(*names(FILES)).write.parquet(f"{base}/files/batch={batch}")
        if with_runs:
            in_order(postings(kept, "content", "filePath", "startLine"), "filePath").write.parquet(f"{base}/runs/batch={batch}")
        return kept

    def stage(self, chunks: DataFrame, files_of) -> Snapshot:
        """Writes a version that isn't published yet: chunks by language, and files_of(chunks as written)."""
        before, version, batch = self._numbers(), uuid.uuid4().hex, "000000"
        self._write(version, batch, chunks, files_of, self.with_runs)
        return Snapshot(self, before[-1] if before else 0, version, [batch], 0, {})

    def stage_change(self, base: Snapshot, chunks: DataFrame, files_of, dead: DataFrame) -> Snapshot:
        """Writes a batch on top of base: the chunks of changed files, and the paths whose earlier rows are dead (filePath)."""
        batch = f"{int(base.batches[-1].split('-')[0]) + 1:06d}-{uuid.uuid4().hex[:8]}"
        self._write(base.version, batch, chunks, files_of, self.folder.exists(f"{base.version}/runs"))
        path = f"{self.root}/{base.version}/dead/batch={batch}"
        dead.select("filePath").distinct().write.parquet(path)
        count = self.spark.read.schema("filePath string").parquet(path).count()
        return Snapshot(self, base.number, base.version, [*base.batches, batch], base.dead + count, {})

    def publish(self, staged: Snapshot, metadata: dict) -> None:
        """Commits what has been staged, and removes versions that the last two commits don't name."""
        said = {"version": staged.version, "batches": staged.batches, "dead": staged.dead, "metadata": metadata}
        if not self.folder.create(f"commits/{staged.number + 1:08d}.json", json.dumps(said, indent=2)):
            self.discard(staged)
            raise ConflictError("another writer has changed the index meanwhile")
        commits = list(self._commits())
        for old in commits[2:]:
            self.folder.delete(f"commits/{old.number:08d}.json")
        kept = {c.version for c in commits[:2]}
        for name in self.folder.names():
            if name not in kept | {"commits", "staging"} and self.folder.exists(f"{name}/chunks"):
                self.folder.delete(name)

    def discard(self, staged: Snapshot) -> None:
        """Removes what has been staged but not published: a version, or the newest batch of one."""
        if len(staged.batches) == 1:
            self.folder.delete(staged.version)
        else:
            for name in ("chunks", "files", "dead", "runs"):
                self.folder.delete(f"{staged.version}/{name}/batch={staged.batches[-1]}")

    def compact(self) -> bool:
        """Writes a version with many batches, or with dead rows for a quarter of its files, anew without these."""
        found = self.snapshot()
        if found is None or len(found.batches) <= MOST_BATCHES and found.dead * 4 <= max(100, found.metadata.get("totalFiles", 0)):
            return False
        self.publish(self.stage(found.chunks, lambda _: found.files), found.metadata)
        return True

    def drop(self) -> None:
        self.folder.delete()
