import math

import duckdb
import pytest

from siftwell.llm.mixing import _ORACLE, exponent, mixed, mixing_stage, plan, token_rows


def uneven():
    rows, n = [], 0
    for source, count in (("big", 400), ("mid", 60), ("small", 12), (None, 9)):
        for _ in range(count):
            rows.append((n, " ".join(["w"] * (n % 7 + 1)), source))
            n += 1
    return rows


def test_exponent(spark):
    shares = [0.7, 0.2, 0.1]
    a = exponent(spark.createDataFrame([(s,) for s in shares], "share double"), 0.9, 100.0).first().a
    w = [s**a for s in shares]
    w = [x / sum(w) for x in w]
    assert -sum(x * math.log(x) for x in w) == pytest.approx(0.9 * math.log(3), abs=1e-6)
    limited = exponent(spark.createDataFrame([(s,) for s in shares], "share double"), 0.999, 2.0).first().a
    assert (0.7 / 0.1) ** (1 - limited) == pytest.approx(2.0, abs=1e-6)


@pytest.mark.parametrize("entropy", [0.5, 0.9, 0.999])
def test_sql_says_the_same(make_docs, entropy):
    docs = make_docs(uneven())
    documents = docs.toPandas()  # noqa: F841
    got = mixed(docs, entropy).collect()
    want = duckdb.sql(_ORACLE.replace(">= 0.9 *", f">= {entropy} *")).fetchall()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert {r.doc_id for r in got} == set(range(481))


def test_budgets_follow_the_weights(make_docs):
    docs = make_docs(uneven())
    a = {r.source: r for r in plan(token_rows(docs), 0.9).collect()}
    tokens = {}
    for r in mixed(docs, 0.9).collect():
        tokens[r.source] = tokens.get(r.source, 0) + r.n_tokens
    weight = {s: r.share**r.a for s, r in a.items()}
    for s in tokens:
        assert tokens[s] / tokens["big"] == pytest.approx(weight[s] / weight["big"], rel=0.12)
    assert a["big"].whole == 1 and a["small"].whole >= 2


def test_odd_rows(spark, make_docs):
    docs = make_docs([(1, None, "a"), (2, "", "a"), (3, "x y", "b"), (None, "z", None), (3, "x y", "b")])
    assert sorted((str(r.doc_id), r.epoch) for r in mixed(docs).where("epoch = 0").collect()) == [("1", 0), ("2", 0), ("3", 0), ("3", 0), ("None", 0)]
    assert mixed(docs.limit(0)).collect() == []
    out = mixing_stage(spark, docs, "")
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {1, 2, 3, None}


def test_stage_keeps_columns_of_any_name(spark, make_docs):
    docs = make_docs(uneven())
    want = sorted(r.doc_id for r in mixing_stage(spark, docs, "").collect())
    for names in (("n_tokens", "h"), ("_source", "_epoch"), ("row", "_cut")):
        more = docs.selectExpr("*", f"-doc_id AS `{names[0]}`", f"'kept' AS `{names[1]}`")
        out = mixing_stage(spark, more, "")
        assert out.columns == more.columns
        found = out.collect()
        assert sorted(r.doc_id for r in found) == want
        assert all(r[names[0]] == -r.doc_id and r[names[1]] == "kept" for r in found)
