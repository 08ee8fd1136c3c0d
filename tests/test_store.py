"""The index store: what updates write, writers that meet, dead rows and their removal."""

import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from siftwell.functions.text import sha256
from siftwell.operators.changes import detect_changes
from siftwell.operators.chunking import line_chunks
from siftwell.plans import indexer as indexer_module
from siftwell.plans.config import parse_config
from siftwell.plans.embedding import HashProvider, embedded
from siftwell.plans.indexer import Indexer, stage_index, stage_update, totals
from siftwell.sources import store as store_module
from siftwell.sources.store import ConflictError, IndexStore

PROVIDER = HashProvider(8)


def files_of(spark, rows):
    df = spark.createDataFrame([(p, "text", c) for p, c in rows.items()], "filePath string, language string, content string")
    return df.withColumn("fileHash", sha256(F.col("content")))


def full(store, files):
    staged = stage_index(store, line_chunks(files, 10, 0), PROVIDER)
    store.publish(staged, totals(staged.files))


def staged_update(store, base, files, **how):
    changes = detect_changes(files.select("filePath", "fileHash"), base.files.select("filePath", "fileHash"))
    touched = files.join(changes.where("status <> 'deleted'").select("filePath"), "filePath", "left_semi")
    return stage_update(store, base, changes, line_chunks(touched, 10, 0), PROVIDER, **how)


def update(store, files, **how):
    staged = staged_update(store, store.snapshot(), files, **how)
    store.publish(staged, totals(staged.files))


def stored(store):
    """(path, first line, content) of the chunks that count, and the counts of the files table."""
    chunks = sorted((r.filePath, r.startLine, r.content) for r in store.chunks().collect())
    files = {r.filePath: r.chunkCount for r in store.files().collect()}
    return chunks, files


def want(rows):
    chunks = sorted((p, k * 10 + 1, "\n".join(c.split("\n")[k * 10 : k * 10 + 10])) for p, c in rows.items() for k in range(max(1, -(-len(c.split("\n")) // 10))))
    return chunks, {p: max(1, -(-len(c.split("\n")) // 10)) for p, c in rows.items()}


def data_files(store):
    return {p: p.stat().st_size for p in Path(store.root).rglob("*.parquet")}


def test_an_update_writes_what_changed(spark, tmp_path):
    rows = {f"src/f{i:04}.txt": f"file {i}\n" + "some line of text\n" * 25 for i in range(600)}
    store = IndexStore(spark, str(tmp_path), "/p")
    full(store, files_of(spark, rows))
    before = data_files(store)
    rows["src/f0007.txt"] += "one more\n"
    del rows["src/f0009.txt"]
    rows["src/new.txt"] = "new"
    for modified in (["src/f0007.txt"], None):  # named in the filter of the scan, or joined
        base = store.snapshot()
        staged = staged_update(store, base, files_of(spark, rows), modified=modified)
        if modified:
            store.discard(staged)
            assert data_files(store) == before
    store.publish(staged, totals(staged.files))
    after = data_files(store)
    assert {p: after.get(p) for p in before} == before
    assert sum(after.values()) - sum(before.values()) < 0.25 * sum(before.values())
    assert stored(store) == want(rows)
    assert store.metadata() == {"totalFiles": 600, "totalChunks": sum(want(rows)[1].values()), "totalSymbols": 0}
    kept = {(r.id, r.summary): r.indexedAt for r in base.chunks.collect()}
    again = {(r.id, r.summary): r.indexedAt for r in store.chunks().collect() if r.filePath not in ("src/f0007.txt", "src/new.txt")}
    assert all(kept[k] == at for k, at in again.items())


def test_files_change_again_and_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "MOST_BATCHES", 4)
    store = IndexStore(spark, str(tmp_path), "/p")
    rows = {f"f{i}": f"v0 {i}" for i in range(8)}
    full(store, files_of(spark, rows))
    versions = {store.snapshot().version}
    for step in range(1, 6):
        rows[f"f{step % 3}"] = f"v{step}\n" * 12
        rows.pop(f"f{step + 2}", None)
        if step == 4:
            rows["f3"] = "back again"  # deleted in the first step
        update(store, files_of(spark, rows))
        assert stored(store) == want(rows)
        store.compact()
        versions.add(store.snapshot().version)
        assert stored(store) == want(rows)
    assert len(versions) == 2 and len(store.snapshot().batches) <= 4
    kept = [p.name for p in Path(store.root).iterdir() if (p / "chunks").is_dir()]
    assert store.snapshot().version in kept and len(kept) <= 2
    update(store, files_of(spark, {}))
    assert stored(store) == ([], {}) and store.metadata()["totalFiles"] == 0


def test_readers_keep_what_they_opened(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path), "/p")
    full(store, files_of(spark, {"a": "1", "b": "2"}))
    opened = store.chunks()
    update(store, files_of(spark, {"a": "1 changed"}))
    assert sorted(r.content for r in opened.collect()) == ["1", "2"]
    assert [r.content for r in store.chunks().collect()] == ["1 changed"]


def test_of_two_writers_one_begins_again(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path), "/p")
    full(store, files_of(spark, {"a": "1", "b": "2"}))
    base = store.snapshot()
    one = staged_update(store, base, files_of(spark, {"a": "1", "b": "2", "c": "3"}))
    other = staged_update(store, base, files_of(spark, {"a": "1 changed", "b": "2"}))
    store.publish(one, {})
    with pytest.raises(ConflictError):
        store.publish(other, {})
    assert stored(store) == want({"a": "1", "b": "2", "c": "3"})
    update(store, files_of(spark, {"a": "1 changed", "b": "2", "c": "3"}))
    assert stored(store) == want({"a": "1 changed", "b": "2", "c": "3"})


def test_updates_at_once_lose_nothing(spark, tmp_path, monkeypatch):
    """Two indexers of one project without a lock between them: each finds the other's commit and begins again."""
    project = tmp_path / "p"
    project.mkdir()
    (project / "a.md").write_text("a")
    config = parse_config({"files": {"gitOnly": False}})
    store = IndexStore(spark, str(tmp_path / "home"), str(project))
    make = lambda: Indexer(spark, str(project), store, PROVIDER, config)
    make().full_index()
    for n in "bcd":
        (project / f"{n}.md").write_text(n)
    meet, real, runs = threading.Barrier(2), indexer_module.stage_update, []

    def together(*given, **how):
        runs.append(1)
        staged = real(*given, **how)
        if len(runs) <= 2:
            meet.wait(120)
        return staged

    monkeypatch.setattr(indexer_module, "stage_update", together)
    said = []
    threads = [threading.Thread(target=lambda: said.append(make().incremental_update())) for _ in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(r.files_added for r in said) == [0, 3]  # the second attempt of one finds all done
    assert sorted(r.filePath for r in store.files().collect()) == ["a.md", "b.md", "c.md", "d.md"] and store.metadata()["totalFiles"] == 4


def test_what_is_left_of_a_killed_run_counts_for_nothing(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path), "/p")
    full(store, files_of(spark, {"a": "1"}))
    staged_update(store, store.snapshot(), files_of(spark, {"a": "2"}))
    stage_index(store, line_chunks(files_of(spark, {"z": "9"})), PROVIDER)
    (Path(store.root) / "commits" / "00000009.json").write_text("{ half")
    assert stored(store) == want({"a": "1"})
    assert [r.content for r in spark.read.parquet(f"{store.root}/{store.snapshot().version}/chunks/batch=000000").collect()] == ["1"]


def test_null_texts_are_embedded_as_empty_ones(spark):
    class Lengths:
        name, model, dimensions = "c", "c", 1

        def embed(self, texts):
            return [[float(len(t))] for t in texts]

    rows = spark.createDataFrame([("1", "ab"), ("2", None), ("3", "")], "id string, summary string")
    assert {r.id: list(r.vector) for r in embedded(rows, Lengths()).collect()} == {"1": [2.0], "2": [0.0], "3": [0.0]}


def test_substrings_by_the_index_of_runs(spark, tmp_path):
    import random

    r = random.Random(4)
    alphabet = "ab%_ '\\é日😀\n"
    rows = {f"f{i:03}": "".join(r.choice(alphabet) for _ in range(r.randrange(40))) for i in range(300)} | {"e": "", "n": "ab\0cd"}
    store = IndexStore(spark, str(tmp_path), "/p", with_runs=True)
    full(store, files_of(spark, rows))
    rows["f000"], rows["new"] = "completely %different 😀", "😀😀😀 a_b"
    del rows["f001"]
    update(store, files_of(spark, rows))
    snapshot = store.snapshot()
    literals = ["", "a", "é", "😀", "%", "'", "\\", "ab", "a\n", "日😀", "\0c", "aba", "%_ ", "a_b", "😀😀😀", "different", "completely %different 😀", "nothing like it, however long it may be"]
    literals += ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 6))) for _ in range(12)]
    for literal in literals:
        got = sorted((x.filePath, x.startLine) for x in snapshot.containing(literal).collect())
        assert got == sorted((p, a) for p, a, c in want(rows)[0] if literal in c), repr(literal)


def test_runs_are_found_in_batches(spark):
    """As the expression finds them: ends, repeats, characters of four bytes, the filling character itself, empty and null texts."""
    from siftwell.operators.trigrams import postings, runs_of

    texts = ["", "a", "ab", "aaaa", "é日😀😀é日😀", "ab\0cd\0", None, "one line\nand another\n"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = postings(rows, "text", "id")
    assert sorted(found.collect()) == sorted(rows.select(F.explode(runs_of(F.col("text"))).alias("run"), "id").collect())
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()


def test_the_index_of_runs_leaves_most_rows_unread(spark, tmp_path):
    from siftwell.operators.trigrams import candidates, postings

    rows = {f"src/f{i:04}.txt": f"file {i}\n" + "some line of text\n" * 5 for i in range(400)}
    chunks = line_chunks(files_of(spark, rows)).persist()
    index = postings(chunks, "content", "filePath", "startLine").persist()
    assert {r.filePath for r in candidates(index, "file 77\n", "filePath", "startLine").collect()} == {"src/f0077.txt"}
    assert candidates(index, "zz", "filePath", "startLine").isEmpty() and candidates(index, "e 1", "filePath", "startLine").count() == 111
    monkey = IndexStore(spark, str(tmp_path), "/p", with_runs=True)
    full(monkey, files_of(spark, rows))
    plan = monkey.snapshot().containing("file 77\n")._jdf.queryExecution().executedPlan().toString()
    assert "In(filePath" in plan or "EqualTo(filePath,src/f0077.txt)" in plan
    chunks.unpersist(), index.unpersist()


def test_a_new_index_embeds_only_new_texts(spark, tmp_path):
    class Counted:
        name, model, dimensions = "counted", "m1", 2

        def __init__(self, texts):
            self.texts = texts

        def embed(self, texts):
            self.texts.add(len(texts))
            return [[float(len(t)), 1.0] for t in texts]

    project = tmp_path / "p"
    project.mkdir()
    for n in "abc":
        (project / f"{n}.md").write_text(f"text of {n}")
    config = parse_config({"files": {"gitOnly": False}})
    store = IndexStore(spark, str(tmp_path / "home"), str(project))

    def index(model="m1"):
        provider = Counted(spark.sparkContext.accumulator(0))
        provider.model = model
        Indexer(spark, str(project), store, provider, config).full_index()
        assert all(list(r.vector) == [float(len(r.summary)), 1.0] for r in store.chunks().collect())
        return provider.texts.value

    assert index() == 3
    (project / "a.md").write_text("other text of a")
    (project / "d.md").write_text("text of d")
    assert index() == 2 and index() == 0
    assert index("m2") == 4
    for file in Path(store.root).rglob("chunks/**/*.parquet"):
        file.write_bytes(b"no longer a table")
    assert index("m2") == 4 and store.metadata()["totalFiles"] == 4
