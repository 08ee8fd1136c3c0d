"""The seven tools: init, search_code, search_files, search_symbols, index_status, reindex, index_update."""

from __future__ import annotations

import os
import threading
import time
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from ..functions.languages import SYMBOL_TYPES
from ..operators.search import search_code, search_files, search_symbols
from ..sources.store import IndexStore, Snapshot, normalize_project
from . import format as text
from .config import Config, load_config, with_overrides
from .embedding import QueryCache, create_provider
from .indexer import Indexer, IndexResult
from .locks import WriteQueue

#: Seconds for which an unused project stays open.
KEPT_OPEN = 600.0


class NoIndexError(LookupError):
    def __init__(self, project: str) -> None:
        super().__init__(f"No index found for: {project}\nRun 'init' to create the vector index.")


class _Open:
    """A project that is being searched: its provider, its tables and when it was last used."""

    def __init__(self, config: Config, cache: QueryCache, index: Snapshot) -> None:
        self.config, self.cache, self.index, self.chunks, self.files, self.used = config, cache, index, index.chunks, index.files, time.monotonic()


class Tools:
    """The tools of one session. home: where indexes are kept; provider: makes a provider from settings; with_runs: whether new indexes find substrings without a scan."""

    def __init__(self, spark: SparkSession, home: str | None = None, provider=create_provider, with_runs: bool = False) -> None:
        self.spark, self.home, self._provider, self._with_runs = spark, home or os.path.expanduser("~/.siftwell"), provider, with_runs
        self._queue, self._guard, self._open = WriteQueue(), threading.RLock(), {}

    def _store(self, project: str) -> IndexStore:
        return IndexStore(self.spark, self.home, project, self._with_runs)

    def _context(self, project: str) -> _Open:
        with self._guard:  # one caller opens a project, others wait for it
            now = time.monotonic()
            for key in [k for k, c in self._open.items() if now - c.used > KEPT_OPEN]:
                del self._open[key]
            if project not in self._open:
                index = self._store(project).snapshot()
                if index is None:
                    raise NoIndexError(project)
                meta = index.metadata
                config = load_config(project)
                config.embedding.provider, config.embedding.model = meta["embeddingProvider"], meta["embeddingModel"]
                self._open[project] = _Open(config, QueryCache(self._provider(config.embedding)), index)
            self._open[project].used = now
            return self._open[project]

    def _forget(self, project: str) -> None:
        with self._guard:
            self._open.pop(project, None)

    @staticmethod
    def _limit(limit: int | None, context: _Open) -> int:
        if limit is not None and not 1 <= limit <= 50:
            raise ValueError("limit must be from 1 to 50")
        return limit or context.config.default_limit

    def _search(self, project_path: str, limit: int | None, run, show) -> str:
        project = normalize_project(project_path)
        self._queue.wait(project)
        try:
            context = self._context(project)
        except NoIndexError as error:
            return str(error)
        return show(r.asDict() for r in run(context, self._limit(limit, context)).collect())

    def search_code(self, project_path: str, query: str, limit: int | None = None, language: str | None = None, file_pattern: str | None = None) -> str:
        run = lambda c, n: search_code(c.chunks, query, c.cache.embed([query])[0], n, language, file_pattern)
        return self._search(project_path, limit, run, text.code_results)

    def search_files(self, project_path: str, query: str, limit: int | None = None) -> str:
        return self._search(project_path, limit, lambda c, n: search_files(c.files, query, c.cache.embed([query])[0], n), text.file_results)

    def search_symbols(self, project_path: str, query: str, symbol_types: list[str] | None = None, limit: int | None = None) -> str:
        if any(t not in SYMBOL_TYPES for t in symbol_types or ()):
            raise ValueError(f"symbol types are {', '.join(SYMBOL_TYPES)}")
        run = lambda c, n: search_symbols(c.chunks, query, c.cache.embed([query])[0], n, symbol_types, c.index.containing)
        return self._search(project_path, limit, run, text.symbol_results)

    def _write(self, project: str, run):
        self._forget(project)
        try:
            with self._queue.write(project, self._store(project).lock_path):
                return run()
        finally:
            self._forget(project)  # a search that began before may have opened the old tables

    def _indexer(self, project: str, config: Config) -> Indexer:
        return Indexer(self.spark, project, self._store(project), self._provider(config.embedding), config)

    @staticmethod
    def _summary(first: str, made: IndexResult, dimensions: int) -> str:
        lines = [first, "", f"Provider: {made.provider} ({dimensions}d)", f"Files indexed: {made.files_indexed}", f"Chunks created: {made.chunks_created}"]
        return "\n".join([*lines, f"Symbols found: {made.symbols_found}", f"Duration: {made.seconds:.1f}s", *text.skipped_files(made.skipped)])

    def init(self, project_path: str, embedding_provider: str | None = None, embedding_model: str | None = None, include_patterns: list[str] | None = None, exclude_patterns: list[str] | None = None) -> str:
        project = normalize_project(project_path)
        told = {"embeddingProvider": embedding_provider, "embeddingModel": embedding_model, "includePatterns": include_patterns, "excludePatterns": exclude_patterns}

        def run() -> str:
            indexer = self._indexer(project, with_overrides(load_config(project), told))
            return self._summary(f"Index initialized successfully for: {project}", indexer.full_index(told), indexer.provider.dimensions)

        return self._write(project, run)

    def reindex(self, project_path: str) -> str:
        project = normalize_project(project_path)

        def run() -> str:
            told = (self._store(project).metadata() or {}).get("initOverrides")
            indexer = self._indexer(project, with_overrides(load_config(project), told))
            return self._summary(f"Reindex complete for: {project}", indexer.full_index(told), indexer.provider.dimensions)

        return self._write(project, run)

    def index_update(self, project_path: str) -> str:
        project = normalize_project(project_path)

        def run() -> str:
            meta = self._store(project).metadata()
            if not meta:
                return "No index found. Run 'init' first to create the vector index."
            config = with_overrides(load_config(project), meta.get("initOverrides"))
            config.embedding.provider, config.embedding.model = meta["embeddingProvider"], meta["embeddingModel"]
            made = self._indexer(project, config).incremental_update()
            if not (made.files_added or made.files_modified or made.files_deleted):
                return "Index is up to date. No changes detected."
            lines = [f"Incremental update complete for: {project}", "", f"Files added:    {made.files_added}", f"Files modified: {made.files_modified}", f"Files deleted:  {made.files_deleted}"]
            return "\n".join([*lines, f"Chunks created: {made.chunks_created}", f"Duration: {made.seconds:.1f}s", *text.skipped_files(made.skipped)])

        return self._write(project, run)

    def index_status(self, project_path: str) -> str:
        """What the metadata says; nothing is created for a project without an index."""
        project = normalize_project(project_path)
        meta = self._store(project).metadata()
        if not meta:
            return str(NoIndexError(project))
        last, made = (datetime.fromisoformat(meta[k]) for k in ("lastIndexedAt", "createdAt"))
        minutes = int((datetime.now(timezone.utc) - last).total_seconds() // 60)
        lines = [f"Index Status for: {meta['projectPath']}", "", f"Files indexed:    {meta['totalFiles']}", f"Chunks stored:    {meta['totalChunks']}", f"Symbols found:    {meta['totalSymbols']}", ""]
        lines += [f"Embedding:        {meta['embeddingProvider']} / {meta['embeddingModel']}", f"Dimensions:       {meta['dimensions']}", f"Version:          {meta['version']}", ""]
        return "\n".join([*lines, f"Created:          {made:%Y-%m-%d %H:%M:%S}", f"Last indexed:     {last:%Y-%m-%d %H:%M:%S} ({text.age(minutes)})"])
