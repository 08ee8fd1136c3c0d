import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from siftwell.llm.quality import SIZE, Features, class_counts, fit, quality_stage, score


def texts(n, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefgh", k=r.randrange(2, 9)))
    rows = []
    for i in range(n):
        good = r.random() < 0.8
        body = [word() for _ in range(r.randrange(20, 120))]
        if not good:
            kind = r.randrange(3)
            body = [w.upper() + "!!" for w in body] if kind == 0 else [w + "%%%" for w in body] if kind == 1 else [body[0]] * 60
        rows.append((i, " ".join(body), int(good)))
    return rows


def test_features():
    f = Features()
    one, none, two, same = f.texts(pa.array(["One two two", None, "zwei Wörter", "One two two"]))
    assert len(none) == 0 and np.array_equal(one, same) and len(set(one) & set(two)) < 3
    parts = [list(x) for x in Features().texts(pa.array(["x" * 10, "abc " * 400_000, "", "x" * 10]))]
    assert parts[0] == parts[3] and parts[2] == [] and 0 < len(parts[1]) < 20


def test_counts_are_of_all_rows(spark):
    rows = spark.createDataFrame([(1, "abc"), (0, "abc"), (1, "abc abc"), (1, None)], "quality int, text string").repartition(3)
    negative, positive = class_counts(rows)
    f = next(Features().texts(pa.array(["abc"])))
    assert (positive[f] == 2).any() and (negative[f] == 1).all() and positive.sum() > 0 and len(positive) == SIZE


def test_held_out_accuracy(spark, make_docs, tmp_path):
    rows = texts(900, 1)
    docs = make_docs([(i, t) for i, t, _ in rows] + [(5000, None), (5001, ""), (None, "abc")])
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(None, 1, 0), (5000, None, 0)], "doc_id long, quality int, toxic int")
    scored = {r.doc_id: r.quality_score for r in score(docs, fit(docs, labels)).collect()}
    held = [(scored[i] >= 0.5) == bool(q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(scored) == 903 and all(0 <= s <= 1 for s in scored.values()) and np.mean(held) > 0.97
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    kept = quality_stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert np.mean([(i in ids) == bool(q) for i, _, q in rows]) > 0.97


def test_without_labels_of_both_classes(spark, make_docs):
    docs = make_docs(["a b", "c d", None]).withColumnRenamed("n_chars", "quality_score")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.quality_score for r in score(docs, fit(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, quality int")
    assert {r.quality_score > 0.5 for r in score(docs, fit(docs, one)).collect()} == {True}
    assert score(docs.limit(0), fit(docs, one)).collect() == []


def test_an_id_on_many_rows_fills_no_task(spark, make_docs):
    rows = texts(200, 2)
    docs = make_docs([(i, t) for i, t, _ in rows] + [(0, f"again {k}") for k in range(500)])
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    scores = [r.quality_score for r in score(docs, fit(docs, labels, fit_rows=30)).collect()]
    assert len(scores) == 700 and all(0 <= s <= 1 for s in scores)


def test_ids_that_are_text(spark, make_docs):
    rows = texts(400, 3)
    docs = make_docs([(i, t) for i, t, _ in rows]).withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    labels = spark.createDataFrame([(f"d{i}", q) for i, _, q in rows], "doc_id string, quality int")
    scored = {r.doc_id: r.quality_score for r in score(docs, fit(docs, labels)).collect()}
    assert np.mean([(scored[f"d{i}"] >= 0.5) == bool(q) for i, _, q in rows if zlib.crc32(f"d{i}".encode()) % 3 == 1]) > 0.95
