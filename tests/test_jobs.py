"""The jobs over growing copies of tables."""

import json
import logging
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import index_files, search_batch
from jobs.common import config_of
from siftwell.functions.vectors import embed_text
from siftwell.operators.search import search_code, search_code_of_each

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def add(spark, path, rows):
    spark.createDataFrame([(*r, "s", 1) for r in rows], DOCS).coalesce(1).write.mode("append").parquet(path)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def files_in(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_index_takes_only_what_is_new(spark, tmp_path, caplog):
    docs, out, mark = (str(tmp_path / n) for n in ("docs.parquet", "out", "mark"))
    run = lambda: index_files.run(spark, docs, out, mark)
    long = "\n".join(f"line {i}" for i in range(150))
    add(spark, docs, [(1, "one\ntwo", "en"), (2, long, "fr"), (3, None, None), (4, "", "")])
    with caplog.at_level(logging.INFO, "jobs.index_files"):
        first = run()
    assert first["rows_read"] == 4 and first["by_language"] == {"en": 1, "fr": 2, "unknown": 2} and first["batches"] == [0]
    assert "read 4 rows" in caplog.text and "wrote 5 chunks" in caplog.text
    before, old = files_in(out), rows_of(index_files.current(spark, out))
    again = run()
    assert again["rows_read"] == 0 and again["batches"] == [] and files_in(out) == before

    add(spark, docs, [(2, "short now", "de"), (5, "five", "en")])
    second = run()
    assert second["rows_read"] == 2 and second["chunks_written"] == 2
    after = files_in(out)
    assert {p: after.get(p) for p in before} == before  # nothing that was there has been written again
    now = rows_of(index_files.current(spark, out))
    assert [r for r in now if r[1] not in ("s/2.txt", "s/5.txt")] == [r for r in old if r[1] != "s/2.txt"]
    assert [(r.filePath, r.language, r.endLine) for r in index_files.current(spark, out).where("batch = 1").orderBy("filePath").collect()] == [("s/2.txt", "de", 1), ("s/5.txt", "en", 1)]


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    """The checkpoint as it was before a batch was committed: the batch runs again over the same files."""
    docs, out, mark = (str(tmp_path / n) for n in ("docs.parquet", "out", "mark"))
    add(spark, docs, [(i, f"text {i}", "en") for i in range(5)])
    index_files.run(spark, docs, out, mark)
    add(spark, docs, [(i, f"text {i}", "fr") for i in range(5, 9)])
    index_files.run(spark, docs, out, mark)
    want = rows_of(spark.read.schema(index_files.CHUNKS).parquet(f"{out}/chunks"))
    for name in ("1", ".1.crc"):
        (tmp_path / "mark" / "commits" / name).unlink()
    found = index_files.run(spark, docs, out, mark)
    assert found["batches"] == [1] and rows_of(spark.read.schema(index_files.CHUNKS).parquet(f"{out}/chunks")) == want
    assert index_files.current(spark, out).count() == 9


def test_files_in_several_batches(spark, tmp_path):
    docs, out, mark = (str(tmp_path / n) for n in ("docs.parquet", "out", "mark"))
    for i in range(3):
        add(spark, docs, [(i, f"text {i}", "en"), (9, f"version {i}", "en")])
    found = index_files.run(spark, docs, out, mark, config_of("index_files") | {"max_files_per_batch": 1})
    assert found["batches"] == [0, 1, 2] and found["rows_read"] == 6
    assert index_files.current(spark, out).count() == 4


def test_an_empty_table(spark, tmp_path):
    docs, out, mark = (str(tmp_path / n) for n in ("docs.parquet", "out", "mark"))
    add(spark, docs, [])
    assert index_files.run(spark, docs, out, mark)["rows_read"] == 0
    assert index_files.current(spark, out).collect() == []


def test_search_for_many_is_that_for_each(spark):
    words = "red green blue small large price cart stock list of the and".split()
    text = lambda i, n: " ".join(words[(i * 7 + k * k) % len(words)] for k in range(n))
    fields = "id string, vector array<double>, filePath string, startLine int, endLine int, content string, symbolName string, symbolType string, language string"
    chunks = spark.createDataFrame([(f"c{i:03}", embed_text(text(i, 3)), f"src/{i}.py", 1, 9, text(i, 5 + i % 9), "", "", "python") for i in range(80)], fields).persist()
    asked = ["red cart", "price", "the price of the cart", "?!", "nothing here says"]
    queries = spark.createDataFrame([(i, q, embed_text(q)) for i, q in enumerate(asked)], "query_id long, query string, query_vector array<double>")
    found = {}
    for r in search_code_of_each(chunks, queries, 6).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.filePath, round(r.score, 9)))
    for i, q in enumerate(asked):
        assert found.get(i, []) == [(r.filePath, round(r.score, 9)) for r in search_code(chunks, q, embed_text(q), 6).collect()]
    chunks.unpersist()


def test_search_replaces_what_an_earlier_run_wrote(spark, tmp_path):
    docs, asked, out = (str(tmp_path / n) for n in ("docs.parquet", "asked.parquet", "out"))
    add(spark, docs, [(1, "a red cart", "en"), (2, "ein roter Wagen", "de"), (3, None, None)])
    spark.createDataFrame([(7, "red cart"), (8, None)], "item_id long, text string").write.parquet(asked)
    first = search_batch.run(spark, docs, asked, out)
    rows = rows_of(spark.read.schema(search_batch.HITS).parquet(out))
    assert first["queries"] == 2 and first["hits_written"] == len(rows) and (7, 1) in {r[:2] for r in rows}
    assert search_batch.run(spark, docs, asked, out) == first and rows_of(spark.read.schema(search_batch.HITS).parquet(out)) == rows
    spark.createDataFrame([(9, "Wagen")], "item_id long, text string").write.mode("overwrite").parquet(asked)
    search_batch.run(spark, docs, asked, out)
    assert {r.query_id for r in spark.read.parquet(out).collect()} == {9}


def test_configuration_and_command_line(spark, tmp_path, monkeypatch):
    own = tmp_path / "own.json"
    own.write_text(json.dumps({"max_lines": 20}))
    assert config_of("index_files", str(own))["max_lines"] == 20
    own.write_text(json.dumps({"max_line": 20}))
    with pytest.raises(ValueError, match="max_line"):
        config_of("index_files", str(own))
    docs = str(tmp_path / "docs.parquet")
    add(spark, docs, [(1, "text", "en")])
    stopped = []
    for module, paths in ((index_files, [docs, str(tmp_path / "out"), str(tmp_path / "mark")]), (search_batch, [docs, docs, str(tmp_path / "hits")])):
        own.write_text(json.dumps({"query_column": "doc_id"} if module is search_batch else {}))
        monkeypatch.setattr(module, "session", lambda name: type("Session", (), {"__getattr__": lambda _, n: getattr(spark, n), "stop": lambda _: stopped.append(1)})())
        monkeypatch.setattr(sys, "argv", ["job", *paths, "--config", str(own)])
        module.main()
    assert len(stopped) == 2 and spark.read.parquet(str(tmp_path / "hits")).select(F.max("query_id")).first()[0] == 1
