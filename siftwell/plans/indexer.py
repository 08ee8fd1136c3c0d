"""Building an index and keeping it current."""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import mean_vector
from ..operators.changes import detect_changes, file_rollup, reused_vectors
from ..operators.chunking import symbol_chunks
from ..sources.files import read_files, scan_files
from ..sources.store import FILES, VERSION, ConflictError, IndexStore, Snapshot, names, normalize_project
from .config import Config
from .embedding import Provider, embedded

log = logging.getLogger(__name__)

#: Modified files up to which their names are a filter of the scan for their old rows, and runs of an update that meets other writers.
NAMED_FILES, ATTEMPTS = 200, 3


@dataclass
class IndexResult:
    files_indexed: int = 0
    files_added: int = 0
    files_modified: int = 0
    files_deleted: int = 0
    chunks_created: int = 0
    symbols_found: int = 0
    skipped: list[tuple[str, str]] = field(default_factory=list)
    seconds: float = 0.0
    provider: str = ""


def file_table(chunks: DataFrame) -> DataFrame:
    """The files table of chunks: counts, and the mean of a file's vectors."""
    return file_rollup(chunks, mean_vector(F.col("vector")).cast("array<float>").alias("vector")).select(*names(FILES))


def stage_index(store: IndexStore, chunks: DataFrame, provider: Provider, batch: int = 50, known: DataFrame | None = None) -> Snapshot:
    """A whole index of chunks (without vectors), written but not published. known: (text, vector) that needn't be embedded again."""
    rows = embedded(chunks, provider, batch=batch, known=known).withColumn("indexedAt", F.current_timestamp())
    return store.stage(rows, file_table)


def stage_update(store: IndexStore, base: Snapshot, changes: DataFrame, chunks: DataFrame, provider: Provider, batch: int = 50, modified: list[str] | None = None) -> Snapshot:
    """What changes (filePath, status) make of base, written but not published: ``chunks`` are those of added and modified files.

    Modified files keep the vectors of chunks whose id and summary are the same. Rows of files that didn't change
    are neither read, but for hashes, nor written. modified: the names of modified files, if they are few.
    """
    old = base.chunks.select("filePath", "id", "summary", "vector")
    if modified is not None and len(modified) <= NAMED_FILES:
        old = old.where(F.col("filePath").isin(modified))  # reaches the scan, whose files are in order of path
    else:
        old = old.join(changes.where(F.col("status") == "modified").select("filePath"), "filePath", "left_semi")
    known = reused_vectors(chunks, old)
    missing = embedded(known.where("vector IS NULL").drop("vector"), provider, batch=batch)
    fresh = known.where("vector IS NOT NULL").unionByName(missing).withColumn("indexedAt", F.current_timestamp())
    # A stored file without a hash comes as added, so what is dead is told by what is stored.
    dead = changes.select("filePath").join(base.files.select("filePath"), "filePath", "left_semi")
    return store.stage_change(base, fresh, file_table, dead)


def totals(files: DataFrame) -> dict:
    found = files.agg(F.count(F.lit(1)).alias("f"), F.sum("chunkCount").alias("c"), F.sum("symbolCount").alias("s")).first()
    return {"totalFiles": found.f, "totalChunks": found.c or 0, "totalSymbols": found.s or 0}


class Indexer:
    def __init__(self, spark: SparkSession, project: str, store: IndexStore, provider: Provider, config: Config) -> None:
        self.spark, self.project, self.store, self.provider, self.config = spark, normalize_project(project), store, provider, config
        self._held: list[DataFrame] = []

    def _chunks(self, paths: list[str]) -> tuple[DataFrame, list[tuple[str, str]]]:
        """The chunks of files, cached until released, and the files that can't be read or chunked with the reasons.

        A file that can't be read goes through the chunker with its error, so files are read once.
        """
        made = symbol_chunks(read_files(self.spark, self.project, paths), self.config.max_chunk_lines, self.config.overlap_lines).persist()
        self._held.append(made)
        skipped = made.where("error IS NOT NULL").select("filePath", "error").collect()
        return made.where("error IS NULL").drop("error"), [(r.filePath, r.error) for r in skipped]

    def _release(self) -> None:
        while self._held:
            self._held.pop().unpersist()

    def _metadata(self, files: DataFrame, before: dict | None, overrides: dict | None) -> dict:
        now = datetime.now(timezone.utc).isoformat()
        base = before or {"projectPath": self.project, "embeddingProvider": self.provider.name, "embeddingModel": self.provider.model, "dimensions": self.provider.dimensions, "createdAt": now, "version": VERSION, "initOverrides": overrides}
        return {**base, **totals(files), "lastIndexedAt": now}

    def _same_model(self, meta: dict) -> bool:
        return (meta.get("embeddingProvider"), meta.get("embeddingModel"), meta.get("dimensions")) == (self.provider.name, self.provider.model, self.provider.dimensions)

    def full_index(self, overrides: dict | None = None) -> IndexResult:
        """A new index of all files. It replaces the old one only when all of it is written.

        Texts that the old one has vectors of, made by the same model, aren't embedded again: the index is its own
        cache, and what a new index doesn't use goes with the old one.
        """
        return self._attempted(lambda: self._full_index(overrides), "Indexing aborted, the existing index was not changed")

    def incremental_update(self) -> IndexResult:
        """The index brought up to date with the files. Chunks whose id and summary are unchanged keep their vectors."""
        return self._attempted(self._incremental_update, "Update aborted, the index was not changed")

    def _attempted(self, run, failed: str) -> IndexResult:
        """The result of run, begun again from the newest commit where another writer came first."""
        for attempt in range(ATTEMPTS):
            try:
                return run()
            except ConflictError as error:
                if attempt == ATTEMPTS - 1:
                    raise RuntimeError(f"{failed}: {error}") from error
            finally:
                self._release()
        raise AssertionError

    def _staged(self, write, began_at: int, failed: str) -> Snapshot:
        try:
            return write()
        except Exception as error:
            now = self.store.snapshot()
            if (now.number if now else 0) > began_at:  # another writer may have removed what this one was reading
                raise ConflictError(str(error)) from error
            raise RuntimeError(f"{failed}: {error}") from error

    def _full_index(self, overrides: dict | None) -> IndexResult:
        began, before = time.monotonic(), self.store.snapshot()
        chunks, skipped = self._chunks(scan_files(self.project, self.config.files))

        def write() -> Snapshot:
            size = self.config.embedding.batch_size
            if before and self._same_model(before.metadata):
                try:
                    return stage_index(self.store, chunks, self.provider, size, before.chunks.select(F.col("summary").alias("text"), "vector"))
                except Exception as error:  # an index that can't be read is what a new one is made for
                    log.warning("vectors of the index before aren't used: %s", str(error).split("\n")[0])
            return stage_index(self.store, chunks, self.provider, size)

        staged = self._staged(write, before.number if before else 0, "Indexing aborted, the existing index was not changed")
        meta = self._metadata(staged.files, None, overrides)
        self.store.publish(staged, meta)
        return IndexResult(meta["totalFiles"], 0, 0, 0, meta["totalChunks"], meta["totalSymbols"], skipped, time.monotonic() - began, self.provider.name)

    def _incremental_update(self) -> IndexResult:
        began = time.monotonic()
        paths = scan_files(self.project, self.config.files)
        base = self.store.snapshot()
        current = read_files(self.spark, self.project, paths, with_content=False).select("filePath", "fileHash")
        changes = detect_changes(current, (base.files if base else self.store.files()).select("filePath", "fileHash")).persist()
        self._held.append(changes)
        found = [(r.filePath, r.status) for r in changes.collect()]  # names of changed files of one tree
        if not found:
            return IndexResult(seconds=time.monotonic() - began)
        of = lambda status: [p for p, s in found if s == status]
        chunks, skipped = self._chunks(of("added") + of("modified"))
        write = lambda: stage_update(self.store, base, changes, chunks, self.provider, self.config.embedding.batch_size, of("modified"))
        staged = self._staged(write, base.number, "Update aborted, the index was not changed")
        created = chunks.count()
        self.store.publish(staged, self._metadata(staged.files, base.metadata, None))
        try:
            self.store.compact()
        except ConflictError:  # the writer that came first will do it
            pass
        return IndexResult(0, len(of("added")), len(of("modified")), len(of("deleted")), created, 0, skipped, time.monotonic() - began, self.provider.name)
