import errno
import json
import os
import socket
import subprocess
import sys
import threading
import time
import urllib.error
from http.client import RemoteDisconnected

import pytest
from pyspark.sql import functions as F

from siftwell.operators.changes import detect_changes, merged, reused_vectors
from siftwell.plans.config import Config, load_config, parse_config, with_overrides
from siftwell.plans.embedding import HashProvider, QueryCache, ServiceError, create_provider, embedded, is_transient, with_retry
from siftwell.plans.locks import IndexLockedError, WriteQueue, file_lock
from siftwell.plans.tools import Tools
from siftwell.sources.files import FileRules, matches, scan_files
from siftwell.sources.store import IncompleteIndexError, IndexStore


def write(root, files):
    for name, content in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())


def lines(n):
    return "\n".join(f"line {i}" for i in range(1, n + 1))


@pytest.mark.parametrize("git", [False, True])
def test_scan(tmp_path, git):
    names = ["src/größe.ts", "src/a.py", "node_modules/x/i.js", "pkg/node_modules/y.js", "dist/o.js", "package-lock.json", "lib/a.min.js", "README", "src/_private.py", ".hidden/x.py"]
    write(tmp_path, {n: "x" for n in names} | {"src/empty.py": "", "src/big.py": "x" * 200})
    if git:
        subprocess.run(["git", "init", "-q"], cwd=tmp_path, check=True)
    rules = FileRules(max_file_size=100)
    assert sorted(scan_files(str(tmp_path), rules)) == ["src/_private.py", "src/a.py", "src/größe.ts"]
    rules.include, rules.extra_exclude = ["src/**"], ["**/a.*"]
    assert sorted(scan_files(str(tmp_path), rules)) == ["src/_private.py", "src/größe.ts"]


def test_globs():
    rules = FileRules(include=["src/*.{ts,js}", "docs/**/[a-c]?.md"], exclude=["**/skip/**"])
    assert [matches(p, rules) for p in ("src/a.ts", "src/b.js", "src/x/a.ts", "docs/ab.md", "docs/x/y/cd.md", "docs/zz.md", "docs/skip/ab.md", "src/.a.ts")] == [True, True, False, True, True, False, False, False]


def test_changes(spark):
    current = spark.createDataFrame([("a", "1"), ("b", "2x"), ("c", "3"), ("e", None)], "filePath string, fileHash string")
    stored = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "4"), ("e", "5"), ("c", "")], "filePath string, fileHash string")
    changes = detect_changes(current, stored)
    assert {(r.filePath, r.status) for r in changes.collect()} == {("b", "modified"), ("c", "added"), ("d", "deleted")}
    fresh = current.where("filePath IN ('b')")
    assert {(r.filePath, r.fileHash) for r in merged(stored, changes, fresh).collect()} == {("a", "1"), ("b", "2x"), ("e", "5"), ("c", "")}


def test_vectors_are_reused_by_id_and_summary(spark):
    old = spark.createDataFrame([("f", "1", "s1", [1.0]), ("f", "2", "s2", [2.0])], "filePath string, id string, summary string, vector array<double>")
    fresh = spark.createDataFrame([("f", "1", "s1"), ("f", "2", "other"), ("g", "1", "s1")], "filePath string, id string, summary string")
    assert {(r.filePath, r.id): r.vector for r in reused_vectors(fresh, old).collect()} == {("f", "1"): [1.0], ("f", "2"): None, ("g", "1"): None}


def test_config(tmp_path):
    assert load_config(str(tmp_path)) == Config()
    load_config(str(tmp_path)).files.exclude.append("x")
    assert load_config(str(tmp_path)) == Config()
    write(tmp_path, {".siftwell.json": json.dumps({"chunking": {"maxChunkLines": 5}})})
    assert load_config(str(tmp_path)) == Config()
    config = with_overrides(parse_config({"files": {"exclude": ["a"]}, "search": {"defaultLimit": 7}}), {"includePatterns": ["i"], "excludePatterns": ["b"], "embeddingProvider": "hash"})
    assert (config.files.include, config.files.exclude, config.default_limit, config.embedding.provider) == (["i"], ["a", "b"], 7, "hash")
    plain = Config()
    assert with_overrides(plain, None) == plain and with_overrides(plain, {"excludePatterns": ["z"]}).files.exclude != plain.files.exclude


class Failing(HashProvider):
    name = "failing"

    def embed(self, texts):
        raise RuntimeError("provider is down")


class Wrapped(HashProvider):
    """Not a HashProvider for embedded(): goes through Arrow batches."""


def test_tools(spark, tmp_path):
    project, home = tmp_path / "p", str(tmp_path / "home")
    write(project, {f"src/mod{i}.ts": f"export function mod{i}() {{\n  return {i};\n}}\n\nclass Mod{i}Service {{\n  run() {{ return {i}; }}\n}}\n" for i in range(4)})
    write(project, {".siftwell.json": json.dumps({"chunking": {"maxChunkLines": 10, "overlapLines": 0}}), "a.md": lines(25), "b.md": lines(5)})
    tools, path = Tools(spark, home, lambda s: HashProvider(16)), str(project)
    assert tools.search_code(path, "x").startswith("No index found") and tools.index_status(path).startswith("No index found")
    assert not os.path.exists(home)
    assert tools.index_update(path).startswith("No index found")
    assert "Files indexed: 5" in tools.init(path, exclude_patterns=["**/mod3.ts", "**/nothing"])
    assert "1. **src/mod1.ts**" in tools.search_files(path, "mod1")
    assert tools.search_symbols(path, "Mod2Service", limit=3).split("\n")[2].startswith('--- class "Mod2Service"')
    assert "up to date" in tools.index_update(path)
    store = IndexStore(spark, home, path)
    before = {r.id: list(r.vector) for r in store.chunks().collect()}
    write(project, {"a.md": lines(24) + "\nchanged", "new.py": "def hello():\n    return 1\n"})
    os.remove(project / "b.md")
    said = tools.index_update(path)
    assert all(x in said for x in ("Files added:    1", "Files modified: 1", "Files deleted:  1"))
    after = store.chunks().where("filePath = 'a.md'").orderBy("startLine").collect()
    assert [r.startLine for r in after] == [1, 11, 21] and after[-1].content.endswith("changed")
    assert list(after[0].vector) == before[after[0].id] and all(v == v for r in after for v in r.vector)
    meta = store.metadata()
    assert meta["totalFiles"] == store.files().count() == 5 and meta["totalChunks"] == store.chunks().count()
    assert meta["totalSymbols"] == store.chunks().where("symbolName <> ''").count()
    assert "hello" in tools.search_symbols(path, "hello", ["function"], 1)
    broken = Tools(spark, home, lambda s: Failing(16))
    with_new = store.metadata()
    write(project, {"c.md": lines(3)})
    import siftwell.plans.embedding as embedding

    real, embedding.hash_embedding = embedding.hash_embedding, None
    try:
        with pytest.raises(RuntimeError, match="the existing index was not changed"):
            broken.reindex(path)
        with pytest.raises(RuntimeError, match="the index was not changed"):
            broken.index_update(path)
    finally:
        embedding.hash_embedding = real
    assert store.metadata() == with_new and store.chunks().count() == meta["totalChunks"]
    assert "Files indexed: 6" in tools.reindex(path) and "Files indexed:    6" in tools.index_status(path)
    with pytest.raises(ValueError):
        tools.search_code(path, "x", 51)
    store.drop()
    with pytest.raises(IncompleteIndexError):
        store.chunks()


def test_provider_in_batches(spark):
    class Counting:
        name, model, dimensions = "c", "c", 2

        def embed(self, texts):
            return [[float(len(t)), 1.0] for t in texts]

    rows = spark.createDataFrame([("1", "ab"), ("2", "ab"), ("3", "abc")], "id string, summary string")
    assert {r.id: list(r.vector) for r in embedded(rows, Counting()).collect()} == {"1": [2.0, 1.0], "2": [2.0, 1.0], "3": [3.0, 1.0]}


def test_cache_and_retry():
    cache = QueryCache(HashProvider(4), 2)
    assert cache.stats()["hitRate"] == "N/A"
    for t in ("a", "b", "a", "c", "b"):
        cache.embed([t])
    assert (cache.hits, cache.misses, cache.stats()["size"]) == (1, 4, 2)
    waits, calls = [], []

    def call():
        calls.append(1)
        raise ServiceError(503, "Busy")

    with pytest.raises(RuntimeError):
        with_retry(call, sleep=waits.append)
    assert waits == [1.0, 2.0, 4.0] and len(calls) == 4
    passing = [TimeoutError(), ConnectionResetError(), ServiceError(429, ""), ServiceError(500, ""), urllib.error.URLError(ConnectionRefusedError()), urllib.error.URLError(socket.gaierror()), RemoteDisconnected(), OSError(errno.ENETUNREACH, "")]
    lasting = [ServiceError(401, "timeout"), ServiceError(404, ""), ServiceError(501, ""), RuntimeError("503"), urllib.error.URLError("no such scheme"), ValueError(), OSError(errno.ENOENT, "")]
    assert all(map(is_transient, passing)) and not any(map(is_transient, lasting))
    with pytest.raises(ValueError, match="API key"):
        create_provider(parse_config({"embedding": {"provider": "openai"}}).embedding)


def test_file_lock(tmp_path):
    path = str(tmp_path / "deep" / "writer")
    with file_lock(path):
        with pytest.raises(IndexLockedError, match=f"process {os.getpid()} on "), file_lock(path):
            pass
    open(path, "w").write("left over, but locked by nobody")
    with file_lock(path):
        pass
    code = "import sys, time; sys.path.insert(0, sys.argv[2])\nfrom siftwell.plans.locks import file_lock\nwith file_lock(sys.argv[1]):\n    print('held', flush=True)\n    time.sleep(60)"
    other = subprocess.Popen([sys.executable, "-c", code, path, os.path.dirname(os.path.dirname(os.path.abspath(__file__)))], stdout=subprocess.PIPE)
    assert other.stdout.readline() == b"held\n"
    with pytest.raises(IndexLockedError, match=f"process {other.pid} on "), file_lock(path):
        pass
    other.kill()
    other.wait()
    with file_lock(path):  # a killed writer leaves no lock
        pass


def test_writers_take_turns(tmp_path):
    queue, seen, lock = WriteQueue(), [], str(tmp_path / "l")

    def run(n):
        with queue.write("p", lock):
            seen.append(n)
            time.sleep(0.05)
            seen.append(n)

    threads = []
    for n in range(4):
        threads.append(threading.Thread(target=run, args=(n,)))
        threads[-1].start()
        time.sleep(0.01)
    queue.wait("p")
    assert seen == [0, 0, 1, 1, 2, 2, 3, 3]
    with pytest.raises(ZeroDivisionError), queue.write("p", lock):
        1 / 0
    queue.wait("p")


def test_stream(spark, tmp_path):
    from siftwell.streaming.follow import follow

    spark.createDataFrame([("a.md", "markdown", lines(3), 1), ("a.md", "markdown", lines(2), 2)], "filePath string, language string, content string, ts long").write.parquet(str(tmp_path / "in"))
    files = spark.readStream.schema("filePath string, language string, content string, ts long").parquet(str(tmp_path / "in"))
    got = []
    query = follow(files, lambda paths, chunks, n: got.append((paths.count(), [r.endLine for r in chunks.collect()])), str(tmp_path / "cp"))
    query.awaitTermination(60)
    assert got == [(1, [2])]
