"""The clustered index against full scans."""

import os
import random

import pytest
from pyspark.sql import functions as F

from siftwell.operators import clustered
from siftwell.operators.clustered import ClusteredIndex, cluster, nearest_stored, nearest_to_each_stored
from siftwell.operators.knn import nearest, nearest_to_each

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.id, round(r.distance, 9)))
    return {q: sorted(v) for q, v in out.items()}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_every_row_of_embeddings(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    cluster(rows, str(tmp_path))
    index = ClusteredIndex.read(spark, str(tmp_path))
    asked = rows.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    assert found(nearest_to_each_stored(index, asked, 4)) == found(nearest_to_each(rows, asked, 4))


def test_clustered_rows_are_read_in_part(spark, tmp_path):
    r = random.Random(2)
    centres = [[r.gauss(0, 1) for _ in range(12)] for _ in range(30)]
    rows = [(i, [x + r.gauss(0, 0.03) for x in centres[i % 30]], i % 5) for i in range(3000)]
    rows += [(4000 + i, rows[3][1], 0) for i in range(600)] + [(5000, None, 0), (5001, [0.0] * 12, 0), (5002, [float("nan")] * 12, 0)]
    table = spark.createDataFrame(rows, "id long, vector array<double>, kind int").repartition(5)
    index = cluster(table, str(tmp_path), clusters=40)
    usable = table.where("id < 5000")
    asked = usable.where("id % 97 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    got = nearest_to_each_stored(index, asked, 7).persist()
    assert found(got) == found(nearest_to_each(usable, asked, 7))
    assert got.agg(F.avg("scanned")).first()[0] < 0.3 * 3600
    only = F.col("kind") == 2
    assert found(nearest_to_each_stored(index, asked, 7, where=only)) == found(nearest_to_each(usable.where(only), asked, 7))
    one = nearest_stored(index, [2 * x for x in centres[4]], 5)
    assert [x.id for x in one.collect()] == [x.id for x in nearest(usable, centres[4], 5).collect()]
    got.unpersist()


def test_clusters_meet_queries_in_blocks(spark, tmp_path, monkeypatch):
    """Small blocks, clusters larger than one, many copies, a NaN query: as a scan, and no pair of query and row is a row."""
    r = random.Random(5)
    rows = [(i, [r.gauss(i % 3, 1) for _ in range(6)]) for i in range(300)] + [(1000 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(150)]
    table = spark.createDataFrame(rows, "id long, vector array<double>")
    index = cluster(table, str(tmp_path), clusters=7)
    asked = table.where("id % 3 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector")).unionAll(spark.createDataFrame([(-1, [float("nan")] * 6), (-2, [0.0] * 6)], "query_id long, query_vector array<double>"))
    want = repr(sorted(found(nearest_to_each(table, asked, 4)).items()))  # NaN isn't equal to itself, its text is
    monkeypatch.setattr(clustered, "ROW_BLOCK", 40), monkeypatch.setattr(clustered, "QUERY_BLOCK", 30)
    got = nearest_to_each_stored(index, asked, 4)
    assert repr(sorted(found(got).items())) == want
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()


def test_few_rows(spark, tmp_path):
    table = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vector array<double>")
    index = cluster(table, str(tmp_path / "two"))
    assert [(r["rank"], r.id, r.scanned) for r in nearest_stored(index, [0.0, 3.0], 5).collect()] == [(1, 2, 2), (2, 1, 2)]
    assert nearest_stored(index, [0.0, 3.0], 5, where=F.col("id") > 9).collect() == []
    assert nearest_stored(index, [0.0, 0.0], 5).collect() == []
    single = cluster(table.limit(1), str(tmp_path / "one"))
    assert [r.id for r in nearest_stored(single, [0.0, 3.0], 5).collect()] == [1]
    empty = cluster(table.limit(0), str(tmp_path / "none"))
    assert nearest_stored(empty, [0.0, 3.0], 5).collect() == []
