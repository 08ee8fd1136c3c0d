import pytest
from pyspark.sql import functions as F

from siftwell.functions.languages import LANGUAGE_IDS, language_of, with_language
from siftwell.functions.text import escape_like, glob_to_like, is_identifier_query, matches_glob, query_tokens, sanitize_language, sanitize_symbol_type, tokens, without_controls
from siftwell.functions.vectors import embed_text, hash_embedding, mean_vectors, similarity_to


@pytest.mark.parametrize(
    ("pattern", "like"),
    [("docs/**/*.md", "docs/%.md"), ("docs/**/**/x", "docs/%x"), ("lib*/**", "lib%/%"), ("v?/_x", "v_/\\_x"), ("5%", "5\\%"), ("win\\dir\\f.c", "win/dir/f.c"), ("***", "%"), ("t\x01a\x1fb", "tab"), ("d'or", "d'or"), ("", "")],
)
def test_glob_to_like(pattern, like):
    assert glob_to_like(pattern) == like


def test_glob_filter(spark):
    rows = spark.createDataFrame([(p,) for p in ["docs/a.md", "docs/x/y/b.md", "docs/n_1.md", "docs/n-1.md", "art/d'or.md"]], "filePath string")
    hits = lambda p: {r[0] for r in rows.where(matches_glob(F.col("filePath"), p)).collect()}
    assert hits("docs/**/*.md") == {"docs/a.md", "docs/x/y/b.md", "docs/n_1.md", "docs/n-1.md"}
    assert hits("docs/n_1.md") == {"docs/n_1.md"} and hits("docs/n?1.md") == {"docs/n_1.md", "docs/n-1.md"}
    assert hits("art/d'or.md") == {"art/d'or.md"}
    assert hits("%' OR true --") == set()


def test_sanitizers():
    assert sanitize_language(" Python ") == "python" and sanitize_language("c++") is None
    assert sanitize_symbol_type(" Class ") == "class" and sanitize_symbol_type("a;b") is None
    assert without_controls("a\x01b\\'c") == "ab\\'c"
    assert escape_like("50%_\\") == "50\\%\\_\\\\"


@pytest.mark.parametrize(("query", "named"), [("price", True), ("shop._till.x9", True), ("\tOrder ", True), ("open order", False), ("9till", False), (" ", False), ("till/order", False), ("till()", False)])
def test_is_identifier_query(query, named):
    assert is_identifier_query(query) is named


def test_tokens(spark):
    row = spark.sql("SELECT 'Foo_bar, a BC--12 \u00e9x' AS t").select(tokens(F.col("t")).alias("t")).first()
    assert row.t == ["foo_bar", "bc", "12"] == query_tokens("Foo_bar, a BC--12 \u00e9x")


def test_languages(spark):
    assert len(LANGUAGE_IDS) == 31
    paths = {"a/b.d.ts": "typescript", "Dockerfile": "dockerfile", "x/Makefile": "makefile", "A.PY": "python", ".gitignore": None, "README": None, "m.hxx": "cpp"}
    assert {p: (language_of(p) or (None,))[0] for p in paths} == paths
    rows = with_language(spark.createDataFrame([(p,) for p in paths], "filePath string")).collect()
    assert {r.filePath: r.language for r in rows} == paths


def test_embedding_is_the_same_in_both_places(spark):
    for n in (16, 32, 48, 64, 100):
        row = spark.sql("SELECT 'hello' AS t").select(hash_embedding(F.col("t"), n).alias("v")).first()
        assert row.v == pytest.approx(embed_text("hello", n)) and len(row.v) == n


def test_similarity_and_mean(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 3.0]), ("b", [0.0, 0.0])], "k string, vector array<double>")
    found = {tuple(r.vector): r.s for r in rows.withColumn("s", similarity_to("vector", [1.0, 1.0])).collect()}
    assert found[(1.0, 0.0)] == pytest.approx(0.5**0.5) and found[(0.0, 0.0)] is None
    assert {r.k: r.vector for r in mean_vectors(rows, "k").collect()} == {"a": [0.5, 1.5], "b": [0.0, 0.0]}
