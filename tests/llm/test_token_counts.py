import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.llm.token_counts import Counter, CountTree, count_trees, current_trees, edit_saved, edit_trees, edited_counts, revision, save_trees, with_edits

PIECES = ["'", "l", "ll", " ", "  ", "\n", "a", "é", "1", "22", "!", " the", "'re", "\t \n", "x" * 30, "日本"]


@pytest.fixture(scope="module")
def counter():
    return Counter()


def test_edits_equal_a_full_recount(counter):
    r = random.Random(5)
    for _ in range(60):
        tree = CountTree("".join(r.choice(PIECES) for _ in range(r.randrange(900))), counter)
        for _ in range(15):
            tree.edit(r.randrange(-3, len(tree.text) + 5), r.choice([0, 1, 3, 30, 600]), "".join(r.choice(PIECES) for _ in range(r.randrange(r.choice([3, 12, 900])))))
            lengths, counts = counter.measure(tree.text)
            assert np.array_equal(lengths, np.concatenate([b[0] for b in tree.blocks]))
            assert tree.tokens == counts.sum() == len(counter.encoding.encode_ordinary(tree.text)) and tree.pretokens == len(lengths)


def test_an_edit_touches_few_pretokens(counter):
    tree = CountTree("word " * 5000, counter)
    assert tree.edit(12_000, 4, "other") < 10


def test_rows(spark, make_docs, counter):
    docs = make_docs(["Hello world, it's me", "", None, "x" * 300_000 + " end", (0, "Hello world, it's me")])
    rows = edited_counts(docs.withColumn("_edits", revision(F.col("text"), F.col("lang"), F.col("source")))).collect()
    assert len(rows) == 5
    for r in rows:
        text = {0: "Hello world, it's me", 3: "x" * 300_000 + " end"}.get(r.doc_id, "")
        assert r.n_tokens == len(counter.encoding.encode_ordinary(text)) and r.n_chars == len(text) and r.n_edits == 3
    edits = spark.createDataFrame([(0, 2, 5, 0, "!!"), (0, 1, 0, 5, "Bye"), (9, 1, 0, 0, "x")], "doc_id long, seq int, at int, remove int, insert string")
    joined = {r.n_edits: r for r in edited_counts(with_edits(docs.where("doc_id = 0").limit(1), edits)).collect()}
    assert joined[2].n_tokens_after == len(counter.encoding.encode_ordinary("Bye w!!orld, it's me"))
    assert edited_counts(with_edits(docs, edits).limit(0)).collect() == []


def test_stored_trees_encode_only_what_edits_touch(spark, make_docs, counter, tmp_path):
    r = random.Random(8)
    texts = {i: " ".join(r.choice(["word", "it's", "42", "naïve", "..."]) for _ in range(3000)) for i in range(3)} | {3: "", 4: None}
    docs = make_docs(list(texts.items())).selectExpr("*", "'x' AS version", "1 AS _edits", "2 AS lengths")
    count_trees(docs).write.parquet(str(tmp_path / "v0"))
    now = {i: t or "" for i, t in texts.items()}
    for version in (1, 2):
        batch = [(i, k, r.randrange(len(now[i]) + 1), r.randrange(30), "new text") for i in (0, 1, 3) for k in range(2)] + [(99, 0, 0, 0, "x")]
        for i, _, at, remove, insert in batch[:-1]:
            now[i] = now[i][:at] + insert + now[i][at + remove :]
        edits = spark.createDataFrame(batch, "doc_id long, seq int, at int, remove int, insert string")
        edit_trees(spark.read.parquet(str(tmp_path / f"v{version - 1}")).drop("n_edits", "n_encoded"), edits).write.parquet(str(tmp_path / f"v{version}"))
        rows = {x.doc_id: x for x in spark.read.parquet(str(tmp_path / f"v{version}")).collect()}
        assert len(rows) == 5
        for i, x in rows.items():
            lengths, counts = counter.measure(now[i])
            assert x.text == now[i] and x.lengths == lengths.tobytes() and x.counts == counts.tobytes()
            assert (x.n_tokens, x.n_pretokens, x.n_chars) == (counts.sum(), len(lengths), len(now[i]))
            edited = i in (0, 1, 3)
            assert x.version == (version if edited else 0) and x.n_edits == 2 * edited and x.n_encoded <= 60 * edited
    assert edit_trees(spark.read.parquet(str(tmp_path / "v0")).limit(0), edits).collect() == []


def test_batches_of_edits_write_the_trees_they_change(spark, make_docs, counter, tmp_path):
    r = random.Random(9)
    texts = {i: " ".join(r.choice(["word", "it's", "42", "naïve", "..."]) for _ in range(r.randrange(700))) for i in range(30)}
    save_trees(make_docs([*texts.items(), (3, texts[3])]), str(tmp_path))
    now = dict(texts)
    for batch in (1, 2, 3):
        changes = [(i, k, r.randrange(len(now[i]) + 1), r.randrange(40), r.choice(["", " more", "x" * 200])) for i in r.sample(range(30), 4) + [3] for k in range(2)]
        changes = list({c[:2]: c for c in changes}.values())
        for i, _, at, remove, insert in sorted(changes):
            now[i] = now[i][:at] + insert + now[i][at + remove :]
        edits = spark.createDataFrame(changes, "doc_id long, seq int, at int, remove int, insert string")
        for _ in range(2):  # a batch that runs again replaces itself
            edit_saved(spark, str(tmp_path), batch, edits)
        own = spark.read.parquet(f"{tmp_path}/batch={batch}").collect()
        assert len(own) == len({c[0] for c in changes}) + 1 and all(x.n_encoded < 2 * (x.n_edits * 60) for x in own)
        rows = current_trees(spark, str(tmp_path), batch).collect()
        assert sorted(x.doc_id for x in rows) == sorted([*texts, 3])
        for x in rows:
            lengths, counts = counter.measure(now[x.doc_id])
            assert x.text == now[x.doc_id] and x.lengths == lengths.tobytes() and x.n_tokens == counts.sum()
            assert x.sums == np.array(CountTree(x.text, counter).sums, np.int64).tobytes()


def test_columns_of_any_name(spark, make_docs):
    docs = make_docs(["a b", "c"]).selectExpr("*", "'kept' AS _doc", "1 AS id", "2 AS edits")
    edits = spark.createDataFrame([(0, 1, 0, 1, "xy")], "doc_id long, seq int, at int, remove int, insert string")
    out = with_edits(docs, edits)
    assert out.columns == [*docs.columns, "_edits"] and {x._doc for x in out.collect()} == {"kept"}
    assert {x.n_edits for x in edited_counts(out).collect()} == {0, 1}
