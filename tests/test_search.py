import math

import pytest

from siftwell.functions.vectors import embed_text
from siftwell.operators import knn
from siftwell.operators.bm25 import bm25_of_all, with_bm25
from siftwell.operators.knn import nearest, nearest_to_each
from siftwell.operators.search import search_code, search_files, search_symbols
from siftwell.plans import format as text

FIELDS = "id string, vector array<double>, filePath string, startLine int, endLine int, content string, symbolName string, symbolType string, language string"


def chunk(id_, path, name="", kind="", content="x", vector=None, language="typescript"):
    return (id_, vector or [1.0] + [0.0] * 15, path, 1, 3, content, name, kind, language)


@pytest.fixture(scope="module")
def shop(spark):
    rows = [
        chunk("o1", "orders/cart.py", "price", "function", "def price(items): ...", language="python"),
        chunk("o2", "orders/stock.py", "PriceList", "class", "class PriceList: ...", language="python"),
        chunk("t1", "tools/money.py", "price_tag", "function", "def price_tag(item): ...", language="python"),
        chunk("t2", "tools/money.py", "", "", "the price is shown", language="python"),
    ]
    return spark.createDataFrame(rows, FIELDS)


def test_scores_follow_the_cosine(spark):
    at = {"near": 0.8, "far": 0.28, "across": 0.0, "against": -0.6}
    rows = [chunk(n, f"{n}.go", vector=[c, math.sqrt(1 - c * c)] + [0.0] * 14) for n, c in at.items()]
    found = {r.filePath: r.score for r in search_code(spark.createDataFrame(rows, FIELDS), "nothing says this", [2.0] + [0.0] * 15).collect()}
    assert found == {"near.go": pytest.approx(0.7 * 0.8), "far.go": pytest.approx(0.7 * 0.28)}


def test_filters(shop):
    v = [1.0] + [0.0] * 15
    assert {r.filePath for r in search_code(shop, "price", v, 10, None, "orders/*").collect()} == {"orders/cart.py", "orders/stock.py"}
    assert [r.symbolName for r in search_symbols(shop, "price", v, 10, ["class"]).collect()] == ["PriceList"]
    assert search_symbols(shop, "price", v, 10, ["%%"]).count() == search_symbols(shop, "price", v, 10).count()
    assert search_code(shop, "price", v, 10, "rust").collect() == []
    with pytest.raises(ValueError, match="Unknown language"):
        search_code(shop, "price", v, 10, "python\" OR true --")


def test_symbols_by_name(shop):
    v = [1.0] + [0.0] * 15
    rows = search_symbols(shop, "price", v, 10).collect()
    assert [r.symbolName for r in rows][0] == "price" and {r.symbolName for r in rows} >= {"price", "PriceList", "price_tag"}
    assert rows[0].score > max(r.score for r in rows[1:])
    assert search_symbols(shop, "x') --", v, 10).count() == 3


def test_content_fallback(spark):
    rows = spark.createDataFrame([chunk("1", "a.go", content="emit sendMail now"), chunk("2", "b.go", "other", "function", vector=[0.0, 1.0] + [0.0] * 14)], FIELDS)
    best = search_symbols(rows, "sendMail", [0.0, 0.0, 1.0] + [0.0] * 13, 5).first()
    assert (best.symbolName, best.symbolType, best.filePath) == ("sendMail", "unknown", "a.go")


def test_file_search(spark):
    rows = spark.createDataFrame([("orders/cart.py", embed_text("a", 16), "python", 4, 1), ("tools/x.py", embed_text("b", 16), "python", 1, 0)], "filePath string, vector array<double>, language string, chunkCount int, symbolCount int")
    assert search_files(rows, "cart", embed_text("q", 16)).first().filePath == "orders/cart.py"


def test_bm25_counts_repeated_terms_twice(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("alpha beta",), ("beta gamma gamma",), ("",)], "t string")
    once, twice = ({r.t: r.bm25 for r in with_bm25(rows, q, F.col("t")).collect()} for q in ("gamma", "gamma gamma"))
    idf, tf = math.log((3 - 1 + 0.5) / 1.5 + 1), 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / (5 / 3)))
    assert once["beta gamma gamma"] == pytest.approx(idf * tf) and twice["beta gamma gamma"] == pytest.approx(2 * idf * tf)
    assert {r.t: r.bm25 for r in bm25_of_all(rows, "gamma gamma", F.col("t"), "t").collect()} == pytest.approx(twice)
    assert {r.bm25_share for r in with_bm25(rows, "zzz", F.col("t")).collect()} == {0.0}
    assert with_bm25(rows.limit(0), "x y", F.col("t")).collect() == []


def test_nearest(spark, monkeypatch):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "id int, vector array<double>")
    assert [r.id for r in nearest(rows, [1.0, 0.1], 10).collect()] == [1, 2, 3]
    queries = spark.createDataFrame([(7, [0.0, 2.0]), (8, [3.0, 0.0])], "query_id int, query_vector array<double>")
    want = {(r.query_id, r["rank"], r.id) for r in nearest_to_each(rows, queries, 1).collect()}
    assert want == {(7, 1, 3), (8, 1, 1)}
    monkeypatch.setattr(knn, "QUERY_BLOCK", 1)
    assert {(r.query_id, r["rank"], r.id) for r in nearest_to_each(rows, queries, 1).collect()} == want
    plan = nearest_to_each(rows, queries, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan


def test_nearest_to_each_on_odd_vectors(spark, monkeypatch):
    """Copies, ties, nulls, NaN, infinite, vast, tiny and zero vectors of several lengths: what the expression gives, without a row for each pair."""
    import random

    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    from siftwell.functions.vectors import similarity

    r = random.Random(6)
    vectors = [[r.choice((-1.0, 0.0, 0.5, 2.0)) for _ in range(r.choice((3, 3, 3, 2)))] for _ in range(150)] + [[1.0, 2.0, 3.0]] * 30 + [[2.0, 4.0, 6.0]] * 3
    vectors += [None, [], [0.0, 0.0, 0.0], [1.0, None, 1.0], [float("nan"), 1.0, 1.0], [float("inf"), 1.0, 1.0], [1e200, 1e200, 0.0], [1e-200, 0.0, 0.0], [-0.0, 1.0, 0.0], [0.1, 0.2, 0.3]]
    rows = spark.createDataFrame([(f"é{i:03}", v) for i, v in enumerate(vectors)], "id string, vector array<double>").repartition(3)
    queries = rows.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    met = rows.crossJoin(queries).withColumn("distance", 1 - similarity(F.col("vector"), F.col("query_vector"))).where("distance IS NOT NULL")
    met = met.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id")))
    text = lambda df: sorted((x.query_id, x["rank"], x.id, repr(x.distance)) for x in df.select("query_id", "rank", "id", "distance").collect())
    for k in (1, 4, 500):
        want = text(met.where(F.col("rank") <= k))
        found = nearest_to_each(rows, queries, k)
        assert text(found) == want
        assert "NestedLoopJoin" not in found._jdf.queryExecution().executedPlan().toString()
        with monkeypatch.context() as m:
            m.setattr(knn, "QUERY_BLOCK", 50), m.setattr(knn, "ROW_BLOCK", 40), m.setattr(knn, "MET", 15)
            assert text(nearest_to_each(rows, queries, k)) == want
    floats = rows.select("id", F.col("vector").cast("array<float>").alias("vector"))
    own = queries.select("query_id", F.col("query_vector").cast("array<float>").alias("query_vector"))
    met = floats.crossJoin(own).withColumn("distance", 1 - similarity(F.col("vector"), F.col("query_vector"))).where("distance IS NOT NULL")
    want = text(met.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("distance", "id"))).where("rank <= 3"))
    assert text(nearest_to_each(floats, own, 3)) == want
    assert nearest_to_each(rows, queries.limit(0), 3).collect() == [] and nearest_to_each(rows.limit(0), queries, 3).collect() == []


def test_texts():
    row = {"filePath": "orders/cart.py", "startLine": 12, "endLine": 13, "content": "def price(items):\n    return 0", "symbolName": "price", "symbolType": "function", "language": "python", "score": 0.98765}
    assert text.code_results([]) == "No matching code found."
    shown = text.code_results([row])
    assert shown.split("\n")[:6] == ["Found 1 result(s):", "", "--- Result 1 (score: 0.988) ---", "File: orders/cart.py:12-13", "Symbol: function price", "Language: python"]
    assert "```python\ndef price(items):\n    return 0\n```" in shown
    assert "Symbol:" not in text.code_results([row | {"symbolName": ""}])
    files = text.file_results([{"filePath": "orders/cart.py", "language": "python", "chunkCount": 9, "symbolCount": 4, "score": 0.25}])
    assert files.startswith("Found 1 file(s):") and "1. **orders/cart.py** (score: 0.250)" in files and "Language: python | Chunks: 9 | Symbols: 4" in files
    symbols = text.symbol_results([row | {"content": "\n".join(f"row {i}" for i in range(1, 20)), "score": 2}])
    assert "row 5\n  // ..." in symbols and "row 6" not in symbols and "(score: 2.000)" in symbols
    assert text.skipped_files([]) == [] and "and 2 more" in text.skipped_files([(str(i), "bad") for i in range(12)])[-1]
    assert [text.age(m) for m in (7, 130, 3000)] == ["7m ago", "2h ago", "2d ago"]
