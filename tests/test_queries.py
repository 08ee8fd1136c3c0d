"""Every engine query against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from pyspark.sql import functions as F

from siftwell.functions.vectors import embed_text
from siftwell.operators.search import search_code
from siftwell.plans import index_queries, job_queries, queries
from siftwell.plans.queries import SYMBOL_NAME, SYMBOL_NOWHERE, SYMBOL_PART, _parts

QUERIES = queries.QUERIES | index_queries.QUERIES | job_queries.QUERIES
ORACLE_SQL = queries.ORACLE_SQL | index_queries.ORACLE_SQL | job_queries.ORACLE_SQL
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted((tuple(None if x != x else x for x in r) for r in df[columns].itertuples(index=False)), key=repr)
    assert rows(got) == rows(want)


def test_symbol_searches_reach_every_way(spark):
    """Exact names, parts of names and contents: the queries' words find some of each."""
    parts = _parts(spark, SF)
    assert parts.where(F.col("symbolName") == SYMBOL_NAME).count() > 1
    assert parts.where(F.contains("symbolName", F.lit(SYMBOL_PART)) & (F.col("symbolType") == "class")).count() > 1
    nowhere = F.contains("symbolName", F.lit(SYMBOL_NOWHERE))
    assert parts.where(nowhere).isEmpty() and parts.where(F.contains("content", F.lit(SYMBOL_NOWHERE))).count() > 1
    best = {name: QUERIES[name](spark, SF).first() for name in ("hybrid_search_symbols", "hybrid_search_symbols_partial", "hybrid_search_symbols_content")}
    assert best["hybrid_search_symbols"].symbolName == SYMBOL_NAME and best["hybrid_search_symbols"].score > 0.5
    assert SYMBOL_PART in best["hybrid_search_symbols_partial"].symbolName and best["hybrid_search_symbols_partial"].symbolType == "class"
    assert best["hybrid_search_symbols_content"].score > 0.3


def test_filters_reach_the_scan(spark, tmp_path):
    """Of a stored table; in the query the language is made of another column, so its filter stands right above the scan."""
    _parts(spark, SF).write.parquet(str(tmp_path / "chunks"))
    stored = search_code(spark.read.parquet(str(tmp_path / "chunks")), "red", embed_text("red"), 5, "python")
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(language), EqualTo(language,python)]" in plan and "TakeOrderedAndProject" in plan
    plan = QUERIES["hybrid_search_code"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().rstrip().split("\n")
    assert "Relation" in plan[-1] and "Filter" in plan[-2] and "lang" in plan[-2]
