"""The engine's queries over the driver's tables, and the same in DuckDB's SQL.

A row of documents is a file: its path is made of source and doc_id, its
language is lang. Each query runs over whole tables; limits are those of the
searches themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.languages import BY_EXTENSION, BY_NAME, with_language
from ..functions.text import is_identifier, matches_glob, sha256, tokens
from ..functions.vectors import embed_text, hash_embedding, mean_vector, mean_vectors, similarity
from ..operators.bm25 import bm25_of_all
from ..operators.changes import change_counts, delete_paths, detect_changes, file_rollup, merged, reused_vectors
from ..operators.chunking import gap_chunks, line_chunks, symbol_chunks
from ..operators.knn import nearest, nearest_to_each
from ..operators.search import search_code, search_files, search_symbols

QUERY = "the heation of anand"
WORD = "thand"
TERMS = ("the", "of", "and", "heation")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _files(spark: SparkSession, sf_dir: str, language: Column | None = None) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select(path.alias("filePath"), (F.col("lang") if language is None else language).alias("language"), F.col("text").alias("content"))


def _chunks(spark: SparkSession, sf_dir: str, language: Column | None = None) -> DataFrame:
    files = _files(spark, sf_dir, language).withColumn("fileHash", sha256(F.col("content"))).withColumn("indexedAt", F.lit("2024-01-01").cast("timestamp"))
    return line_chunks(files)


def _embedded(spark: SparkSession, sf_dir: str, language: Column | None = None) -> DataFrame:
    return _chunks(spark, sf_dir, language).withColumn("vector", hash_embedding(F.col("summary")))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of part as symbols: the name's first word, its kind, its whole name as content."""
    part = _table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    return part.select(
        sha256(key.cast("string")).alias("id"),
        F.concat(F.lit("part/"), F.lower(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_")), F.lit("/"), key.cast("string"), F.lit(".txt")).alias("filePath"),
        F.lit(1).alias("startLine"),
        F.lit(1).alias("endLine"),
        F.when(key % 5 == 0, "").otherwise(F.regexp_replace("p_name", "[^A-Za-z0-9]+", "_")).alias("symbolName"),
        F.when(key % 3 == 0, "class").otherwise("function").alias("symbolType"),
        F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("content"),
        F.lit("text").alias("language"),
        hash_embedding(F.concat_ws(" ", "p_name", "p_type")).alias("vector"),
    )


def knn_cosine_topk(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    found = nearest(rows, embed_text(QUERY), 10, "vec_id")
    return found.select("vec_id", F.round("distance", 6).alias("distance"))


def batched_knn(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    queries = rows.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query_vector"))
    return nearest_to_each(rows, queries, 3, "vec_id").select("query_id", "rank", "vec_id", F.round("distance", 6).alias("distance"))


def pair_similarity(spark, sf_dir):
    rows = _table(spark, sf_dir, "embeddings")
    last = F.transform(F.sequence(F.lit(1), F.size("embedding")), lambda i: F.element_at("embedding", -i))
    return rows.select("vec_id", F.round(F.greatest(F.lit(0.0), similarity(F.col("embedding"), last)), 6).alias("score"))


def mean_vector_by_group(spark, sf_dir):
    rows = mean_vectors(_table(spark, sf_dir, "embeddings").select("label", F.col("embedding").alias("vector")), "label")
    return rows.select("label", F.posexplode("vector").alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("x"))


def hash_embeddings(spark, sf_dir):
    files = _files(spark, sf_dir).select("filePath", hash_embedding(F.col("content"), 48).alias("v"))
    return files.select("filePath", F.posexplode("v").alias("pos", "x")).select("filePath", "pos", F.round("x", 6).alias("x"))


def content_hash(spark, sf_dir):
    return _files(spark, sf_dir).select("filePath", sha256(F.col("content")).alias("fileHash"))


def tokenize(spark, sf_dir):
    return _files(spark, sf_dir).select("filePath", F.explode(tokens(F.col("content"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def language_lookup(spark, sf_dir):
    endings = F.array(*(F.lit(x) for x in ["main.py", "A.TS", "x.d.ts", "Dockerfile", "Makefile", "b.scss", ".gitignore", "README", "c.weird", "m.hpp"]))
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("src/"), F.get(endings, (F.col("doc_id") % 10).cast("int"))).alias("filePath"))
    return with_language(docs).groupBy("filePath", "language", "grammar").agg(F.count(F.lit(1)).alias("n"))


def identifier_queries(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    text = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), F.split("p_name", " ")[0], F.lit(" "))).otherwise(F.col("p_name"))
    return part.select("p_partkey", is_identifier(text).alias("named"))


def glob_filter(spark, sf_dir):
    files = _files(spark, sf_dir)
    hit = {"star": "src1/*", "deep": "**/1*.txt", "one": "src?/*5.txt", "plain": "src_/%", "star_twice": "src1*/**/*.txt"}
    found = None
    for name, pattern in hit.items():
        part = files.where(matches_glob(F.col("filePath"), pattern)).select(F.lit(name).alias("pattern"), "filePath")
        found = part if found is None else found.union(part)
    return found


def contains_literal(spark, sf_dir):
    files = _files(spark, sf_dir)
    return files.where(F.contains("content", F.lit("%%%")) | F.contains("content", F.lit("_")) | F.contains("content", F.lit("'"))).select("filePath")


def symbol_type_filter(spark, sf_dir):
    return _parts(spark, sf_dir).where(F.col("symbolType").isin("class") & (F.col("symbolName") != "")).select("filePath", "symbolName")


def line_count(spark, sf_dir):
    return _files(spark, sf_dir).select("filePath", F.size(F.split("content", "\n", -1)).alias("n"))


def line_windows(spark, sf_dir):
    files = _files(spark, sf_dir)
    return line_chunks(files, 20, 5).select("filePath", "startLine", "endLine")


def line_chunk_rows(spark, sf_dir):
    return _chunks(spark, sf_dir).select("id", "filePath", "startLine", "endLine", sha256(F.col("content")).alias("content_hash"), "summary", "language")


def file_rollups(spark, sf_dir):
    return file_rollup(_parts(spark, sf_dir).withColumn("filePath", F.substring_index("filePath", "/", 2)).withColumn("fileHash", F.lit("h")).withColumn("indexedAt", F.lit("2024-01-01").cast("timestamp"))).select("filePath", "language", "chunkCount", "symbolCount")


def index_status_counts(spark, sf_dir):
    return _parts(spark, sf_dir).agg(F.count_distinct("filePath").alias("totalFiles"), F.count(F.lit(1)).alias("totalChunks"), F.count_if(F.col("symbolName") != "").alias("totalSymbols"))


def bm25_scores(spark, sf_dir):
    return bm25_of_all(_files(spark, sf_dir), " ".join(TERMS), F.col("content"), "filePath").select("filePath", F.round("bm25", 6).alias("bm25"))


def hybrid_search_code(spark, sf_dir):
    """search_code over chunks whose vectors are made on the way: English texts count as markdown, and that filter reaches the scan."""
    language = F.when(F.col("lang") == "en", "markdown").otherwise("other")
    found = search_code(_embedded(spark, sf_dir, language), QUERY, embed_text(QUERY), 10, "Markdown")
    return found.select("filePath", "startLine", "endLine", "symbolName", "language", F.round("score", 6).alias("score"))


def hybrid_search_code_pattern(spark, sf_dir):
    found = search_code(_embedded(spark, sf_dir), WORD, embed_text(WORD), 10, None, "src1*/*")
    return found.select("filePath", "startLine", "endLine", F.round("score", 6).alias("score"))


def hybrid_search_files(spark, sf_dir):
    files = file_rollup(_embedded(spark, sf_dir), mean_vector(F.col("vector")).alias("vector"))
    found = search_files(files, "src1 txt files", embed_text("src1 txt files"), 10)
    return found.select("filePath", "language", "chunkCount", "symbolCount", F.round("score", 6).alias("score"))


def _symbols(spark, sf_dir, query, types=None):
    found = search_symbols(_parts(spark, sf_dir), query, embed_text(query), 10, types)
    return found.select("filePath", "symbolName", "symbolType", F.round("score", 6).alias("score"))


SYMBOL_NAME, SYMBOL_PART, SYMBOL_NOWHERE, SYMBOL_WORDS = "red_gear", "_widget", "Brand", "large polished part"


def hybrid_search_symbols(spark, sf_dir):
    return _symbols(spark, sf_dir, SYMBOL_NAME)


def hybrid_search_symbols_partial(spark, sf_dir):
    return _symbols(spark, sf_dir, SYMBOL_PART, ["class", "no such type!"])


def hybrid_search_symbols_content(spark, sf_dir):
    return _symbols(spark, sf_dir, SYMBOL_NOWHERE)


def hybrid_search_symbols_words(spark, sf_dir):
    return _symbols(spark, sf_dir, SYMBOL_WORDS)


def _snapshots(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    stored = docs.where(F.col("doc_id") % 13 != 0).select(path.alias("filePath"), sha256(F.col("text")).alias("fileHash"))
    now = F.when(F.col("doc_id") % 17 == 0, None).otherwise(sha256(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))))
    current = docs.where(F.col("doc_id") % 11 != 0).select(path.alias("filePath"), now.alias("fileHash"))
    return current, stored


def detected_changes(spark, sf_dir):
    return detect_changes(*_snapshots(spark, sf_dir))


def changes_by_status(spark, sf_dir):
    return change_counts(detect_changes(*_snapshots(spark, sf_dir)))


def incremental_merge(spark, sf_dir):
    current, stored = _snapshots(spark, sf_dir)
    changes = detect_changes(current, stored)
    fresh = current.join(changes.where(F.col("status").isin("added", "modified")), "filePath", "left_semi")
    return merged(stored, changes, fresh)


def deleted_paths(spark, sf_dir):
    current, stored = _snapshots(spark, sf_dir)
    return delete_paths(stored, current)


def vector_reuse(spark, sf_dir):
    files = _files(spark, sf_dir)
    old = line_chunks(files, 20, 5).select("filePath", "id", "summary").withColumn("vector", hash_embedding(F.col("summary")))
    edited = files.withColumn("content", F.when(F.length("filePath") % 3 == 0, F.concat(F.lit("new first line\n"), "content")).when(F.length("filePath") % 3 == 1, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    fresh = line_chunks(edited, 20, 5).select("filePath", "id", "summary")
    found = reused_vectors(fresh, old)
    return found.groupBy("filePath").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("vector").isNotNull()).alias("reused"))


#: Heads of source files by turns: extension, language, mark of a comment, text. The chunks and the named ones in them are in the query's SQL.
HEADS = (
    ("py", "python", "# ", "import os\n\nclass A:\n    def f(self):\n        pass\n\n"),
    ("py", "python", "# ", "import os\n\ndef f(a):\n    return (a\n\nclass A:\n    def g(self):\n        pass\n\n"),
    ("ts", "typescript", "// ", "import x from 'y';\n\nclass A {\n  f() { return 1; }\n}\n\n"),
    ("java", "java", "// ", "record R(int x) {\n  int m() { return x; }\n}\n\nclass A {\n  void g() { }\n}\n\n"),
)


def source_text(spark, sf_dir):
    """symbol_chunks over documents as source files: a head with symbols, one with an error too, and the text in comments below it."""
    files = _files(spark, sf_dir).withColumn("turn", F.pmod(F.regexp_extract("filePath", r"/(\d+)\.txt\z", 1).cast("long"), F.lit(len(HEADS))).cast("int"))
    of = lambda k: F.get(F.array(*(F.lit(h[k]) for h in HEADS)), F.col("turn"))
    content = F.concat(of(3), of(2), F.replace("content", F.lit("\n"), F.concat(F.lit("\n"), of(2))))
    files = files.select(F.concat(F.regexp_replace("filePath", r"txt\z", ""), of(0)).alias("filePath"), of(1).alias("language"), content.alias("content"), F.lit("h").alias("fileHash"))
    return symbol_chunks(files).groupBy("filePath").agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("symbolName") != "").alias("symbols"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def gap_chunk_rows(spark, sf_dir):
    """The chunks of what two kinds of intervals leave of each document: some overlap, some end with the text."""
    files = _files(spark, sf_dir)
    n = files.select("filePath", F.size(F.split("content", "\n", -1)).alias("n"))
    every = lambda step, first, more: n.select("filePath", "n", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / step).cast("int"))).alias("k")).select("filePath", (F.col("k") * step + first).alias("startLine"), F.least(F.col("n"), F.col("k") * step + first + more).alias("endLine"), "n").where("startLine <= n")
    covered = every(37, 9, F.col("k") % 3 * 2).unionByName(every(41, 5, F.lit(6)))
    return gap_chunks(files, covered, 20, 5).select("id", "filePath", "startLine", "endLine", sha256(F.col("content")).alias("content_hash"), "summary", "language")


QUERIES = {
    f.__name__: f
    for f in (
        hybrid_search_code, hybrid_search_code_pattern, hybrid_search_files, hybrid_search_symbols, hybrid_search_symbols_partial, hybrid_search_symbols_content, hybrid_search_symbols_words,
        knn_cosine_topk, batched_knn, pair_similarity, mean_vector_by_group, hash_embeddings, content_hash, tokenize, language_lookup, identifier_queries, glob_filter, contains_literal,
        symbol_type_filter, line_count, line_windows, line_chunk_rows, file_rollups, index_status_counts, bm25_scores, detected_changes, changes_by_status, incremental_merge, deleted_paths, vector_reuse, source_text, gap_chunk_rows,
    )
}


# ---------------------------------------------------------------- the same in SQL

_FILES = "files AS (SELECT source || '/' || doc_id || '.txt' AS filePath, lang AS language, text AS content FROM documents)"
_MARKED = "files AS (SELECT source || '/' || doc_id || '.txt' AS filePath, CASE WHEN lang = 'en' THEN 'markdown' ELSE 'other' END AS language, text AS content FROM documents)"


def _sql_embed(text: str, n: int = 64) -> str:
    raw = f"list_transform(range(0, {n}), lambda i: CAST(CAST('0x' || substr(sha256({text}), CAST((i % 32) * 2 + 1 AS INT), 2) AS INT) AS DOUBLE) / 128 - 1)"
    return raw


def _sql_vector(text: str) -> str:
    return "[" + ", ".join(f"CAST({v!r} AS DOUBLE)" for v in embed_text(text)) + "]"


def _sql_chunks(size: int = 100, overlap: int = 10, files: str = "files") -> str:
    step = size - overlap
    return f"""cut AS (SELECT *, string_split(content, chr(10)) AS l FROM {files}),
starts AS (SELECT *, CAST(unnest(generate_series(0, greatest(0, CAST(ceil((len(l) - {size}) / {step}.0) AS BIGINT)))) * {step} + 1 AS INT) AS startLine FROM cut),
ranges AS (SELECT *, CAST(least(startLine + {size - 1}, len(l)) AS INT) AS endLine FROM starts),
chunks AS (SELECT filePath, language, startLine, endLine, sha256(filePath || ':' || startLine || ':' || endLine) AS id, array_to_string(l[startLine:endLine], chr(10)) AS content,
  language || ' code in ' || filePath || ' (lines ' || startLine || '-' || endLine || '): ' || substr(array_to_string(list_filter(l[startLine:endLine], lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g') <> '')[1:5], ' '), 1, 200) AS summary,
  '' AS symbolName FROM ranges)"""


def _sql_rank(candidates: str, query: str, text: str, named: bool, tie: str, limit: int = 10, boost: str = "0") -> str:
    """CTEs from candidates (with distance, similarity) to best (with score)."""
    import re

    terms = [t for t in re.split("[^a-z0-9_]+", query.lower()) if len(t) > 1]
    a, b = (0.3, 0.7) if named else (0.7, 0.3)
    tf = lambda t: f"len(list_filter(t, lambda x: x = '{t}'))"
    cols = "".join(f", {tf(t)} AS tf{i}" for i, t in enumerate(terms))
    stat = "".join(f", count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    score = " + ".join(f"CASE WHEN tf{i} > 0 THEN ln((n - df{i} + 0.5) / (df{i} + 0.5) + 1) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / mean)) ELSE 0 END" for i in range(len(terms))) or "0"
    return f"""toks AS (SELECT *, list_filter(string_split_regex(lower({text}), '[^a-z0-9_]+'), lambda x: len(x) > 1) AS t FROM {candidates}),
tfs AS (SELECT *, len(t) AS dl{cols} FROM toks),
stat AS (SELECT count(*) AS n, avg(dl) AS mean{stat} FROM tfs),
scored AS (SELECT *, {score} AS bm FROM tfs, stat),
top AS (SELECT greatest(max(bm), 0.001) AS most FROM scored),
fused AS (SELECT *, {a} * similarity + {b} * bm / most + {boost} AS score FROM scored, top),
best AS (SELECT * FROM fused WHERE score >= 0.05 ORDER BY score DESC, {tie} LIMIT {limit})"""


def _sql_near(rows: str, query: str, k: int, tie: str, where: str = "true") -> str:
    v = _sql_vector(query)
    return f"""near AS (SELECT *, greatest(0, 1 - distance) AS similarity FROM (SELECT *, 1 - list_cosine_similarity(vector, {v}) AS distance FROM {rows} WHERE {where}) ORDER BY distance, {tie} LIMIT {k})"""


_PARTS = f"""parts AS (SELECT sha256(CAST(p_partkey AS VARCHAR)) AS id, 'part/' || lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g')) || '/' || p_partkey || '.txt' AS filePath, 1 AS startLine,
  CASE WHEN p_partkey % 5 = 0 THEN '' ELSE regexp_replace(p_name, '[^A-Za-z0-9]+', '_', 'g') END AS symbolName, CASE WHEN p_partkey % 3 = 0 THEN 'class' ELSE 'function' END AS symbolType,
  p_name || ' ' || p_type || ' ' || p_brand AS content, 'text' AS language, {_sql_embed("p_name || ' ' || p_type")} AS vector FROM part)"""


def _sql_symbols(query: str, named: bool, type_: str = "") -> str:
    rows = f"rows_ AS (SELECT * FROM parts{f''' WHERE symbolType = '{type_}' ''' if type_ else ''})"
    near = _sql_near("rows_", query, 30, "id", "true" if named else "symbolName <> ''")
    text = "symbolName || ' ' || symbolType || ' ' || content"
    fields = "id, filePath, startLine, symbolName, symbolType, content"
    ways = f"SELECT {fields}, similarity, distance, 3 AS way, 0.0 AS boost, {text} AS txt FROM near"
    if named:
        order = "ORDER BY filePath, startLine, id LIMIT 10"
        like = query.replace("_", "\\_")
        ways = f"""SELECT * FROM exact_ UNION ALL SELECT * FROM like_ UNION ALL
  SELECT * FROM (SELECT id, filePath, startLine, CASE WHEN symbolName = '' THEN '{query}' ELSE symbolName END AS symbolName, symbolType, content, 0.5 AS similarity, 0.0 AS distance, 2 AS way, 0.3 AS boost, '{query} ' || content AS txt
   FROM rows_ WHERE content LIKE '%{like}%' ESCAPE '\\' AND (SELECT count(*) FROM exact_) + (SELECT count(*) FROM like_) = 0 {order}) UNION ALL {ways}"""
        named_ctes = f"""exact_ AS (SELECT {fields}, 0.5 AS similarity, 0.0 AS distance, 0 AS way, 0.5 AS boost, {text} AS txt FROM rows_ WHERE symbolName = '{query}' {order}),
like_ AS (SELECT {fields}, 0.5 AS similarity, 0.0 AS distance, 1 AS way, 0.25 AS boost, {text} AS txt FROM rows_ WHERE symbolName LIKE '%{like}%' ESCAPE '\\' AND symbolName <> '{query}' {order}),
"""
    else:
        named_ctes = ""
    return f"""WITH {_PARTS}, {rows}, {near}, {named_ctes}ways AS ({ways}),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY way) AS turn FROM ways) WHERE turn = 1),
{_sql_rank("one", query, "txt", named, "way, distance, filePath, startLine, id", boost="boost")}
SELECT filePath, symbolName, symbolType, round(score, 6) AS score FROM best"""


_SNAPSHOTS = """stored AS (SELECT source || '/' || doc_id || '.txt' AS filePath, sha256(text) AS fileHash FROM documents WHERE doc_id % 13 <> 0),
current_ AS (SELECT source || '/' || doc_id || '.txt' AS filePath, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) END AS fileHash FROM documents WHERE doc_id % 11 <> 0),
changes AS (SELECT * FROM (SELECT coalesce(c.filePath, s.filePath) AS filePath, CASE WHEN c.filePath IS NULL THEN 'deleted' WHEN c.fileHash IS NULL THEN NULL WHEN s.fileHash IS NULL THEN 'added' WHEN c.fileHash <> s.fileHash THEN 'modified' END AS status
  FROM current_ c FULL OUTER JOIN stored s ON c.filePath = s.filePath) WHERE status IS NOT NULL)"""

_EMBEDDED = f"embedded AS (SELECT *, {_sql_embed('summary')} AS vector FROM chunks)"
_LOOKUP = ", ".join(f"('{k}', '{v[0]}', {'NULL' if v[1] is None else repr(v[1])})" for k, v in {**BY_EXTENSION, **BY_NAME}.items())

ORACLE_SQL = {
    "knn_cosine_topk": f"SELECT vec_id, round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_sql_vector(QUERY)}), 6) AS distance FROM embeddings ORDER BY 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_sql_vector(QUERY)}), vec_id LIMIT 10",
    "batched_knn": """SELECT query_id, CAST(rank AS INT) AS rank, vec_id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM
  (SELECT q.vec_id AS query_id, e.vec_id, 1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS distance FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)) WHERE rank <= 3""",
    "pair_similarity": "SELECT vec_id, round(greatest(0, list_cosine_similarity(CAST(embedding AS DOUBLE[]), list_reverse(CAST(embedding AS DOUBLE[])))), 6) AS score FROM embeddings",
    "mean_vector_by_group": "SELECT label, CAST(pos - 1 AS INT) AS pos, round(avg(x), 6) AS x FROM (SELECT label, unnest(generate_series(1, len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY label, pos",
    "hash_embeddings": f"WITH {_FILES}, e AS (SELECT filePath, {_sql_embed('content', 48)} AS v FROM files), n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS s FROM e) SELECT filePath, CAST(pos - 1 AS INT) AS pos, round(x / s, 6) AS x FROM (SELECT filePath, s, unnest(generate_series(1, 48)) AS pos, unnest(v) AS x FROM n)",
    "content_hash": f"WITH {_FILES} SELECT filePath, sha256(content) AS fileHash FROM files",
    "tokenize": f"WITH {_FILES}, t AS (SELECT unnest(list_filter(string_split_regex(lower(content), '[^a-z0-9_]+'), lambda x: len(x) > 1)) AS token FROM files) SELECT token, count(*) AS n FROM t GROUP BY token",
    "language_lookup": f"""WITH m(key, language, grammar) AS (VALUES {_LOOKUP}), f AS (SELECT 'src/' || ['main.py', 'A.TS', 'x.d.ts', 'Dockerfile', 'Makefile', 'b.scss', '.gitignore', 'README', 'c.weird', 'm.hpp'][doc_id % 10 + 1] AS filePath FROM documents),
g AS (SELECT filePath, CASE WHEN split_part(filePath, '/', 2) IN ('Dockerfile', 'Makefile') THEN split_part(filePath, '/', 2) ELSE lower(regexp_extract(filePath, '(\\.[^.]*)$', 1)) END AS key FROM f)
SELECT filePath, language, grammar, count(*) AS n FROM g LEFT JOIN m ON g.key = m.key GROUP BY ALL""",
    "identifier_queries": "SELECT p_partkey, regexp_matches(regexp_replace(CASE WHEN p_partkey % 2 = 0 THEN ' ' || split_part(p_name, ' ', 1) || ' ' ELSE p_name END, '^\\s+|\\s+$', '', 'g'), '^[a-zA-Z_][a-zA-Z0-9_.]*$') AS named FROM part",
    "glob_filter": f"""WITH {_FILES}, p(pattern, l) AS (VALUES ('star', 'src1/%'), ('deep', '%1%.txt'), ('one', 'src_/%5.txt'), ('plain', 'src\\_/\\%'), ('star_twice', 'src1%/%.txt'))
SELECT pattern, filePath FROM files, p WHERE filePath LIKE l ESCAPE '\\'""",
    "contains_literal": f"WITH {_FILES} SELECT filePath FROM files WHERE contains(content, '%%%') OR contains(content, '_') OR contains(content, chr(39))",
    "symbol_type_filter": f"WITH {_PARTS} SELECT filePath, symbolName FROM parts WHERE symbolType IN ('class') AND symbolName <> ''",
    "line_count": f"WITH {_FILES} SELECT filePath, CAST(len(string_split(content, chr(10))) AS INT) AS n FROM files",
    "line_windows": f"WITH {_FILES}, {_sql_chunks(20, 5)} SELECT filePath, startLine, endLine FROM chunks",
    "line_chunk_rows": f"WITH {_FILES}, {_sql_chunks()} SELECT id, filePath, startLine, endLine, sha256(content) AS content_hash, summary, language FROM chunks",
    "file_rollups": f"WITH {_PARTS} SELECT 'part/' || split_part(filePath, '/', 2) AS filePath, 'text' AS language, CAST(count(*) AS INT) AS chunkCount, CAST(count(*) FILTER (symbolName <> '') AS INT) AS symbolCount FROM parts GROUP BY 1",
    "index_status_counts": f"WITH {_PARTS} SELECT count(DISTINCT filePath) AS totalFiles, count(*) AS totalChunks, count(*) FILTER (symbolName <> '') AS totalSymbols FROM parts",
    "bm25_scores": f"WITH {_FILES}, all_ AS (SELECT *, 0.0 AS distance, 0.0 AS similarity FROM files), {_sql_rank('all_', ' '.join(TERMS), 'content', False, 'filePath')} SELECT filePath, round(bm, 6) AS bm25 FROM scored",
    "hybrid_search_code": f"WITH {_MARKED}, {_sql_chunks()}, {_EMBEDDED}, {_sql_near('embedded', QUERY, 30, 'id', chr(39).join(('language = ', 'markdown', '')))}, {_sql_rank('near', QUERY, chr(39).join(('content || ', ' ', ' || symbolName || ', ' ', ' || filePath')), False, 'distance, id')} SELECT filePath, startLine, endLine, symbolName, language, round(score, 6) AS score FROM best",
    "hybrid_search_code_pattern": f"WITH {_FILES}, {_sql_chunks()}, {_EMBEDDED}, {_sql_near('embedded', WORD, 30, 'id', chr(39).join(('filePath LIKE ', 'src1%/%', '')))}, {_sql_rank('near', WORD, chr(39).join(('content || ', ' ', ' || symbolName || ', ' ', ' || filePath')), True, 'distance, id')} SELECT filePath, startLine, endLine, round(score, 6) AS score FROM best",
    "hybrid_search_files": f"""WITH {_FILES}, {_sql_chunks()}, {_EMBEDDED}, unit AS (SELECT *, list_transform(vector, lambda x: x / sqrt(list_sum(list_transform(vector, lambda y: y * y)))) AS u FROM embedded),
vals AS (SELECT filePath, unnest(generate_series(1, 64)) AS pos, unnest(u) AS x FROM unit), means AS (SELECT filePath, list(m ORDER BY pos) AS vector FROM (SELECT filePath, pos, avg(x) AS m FROM vals GROUP BY filePath, pos) GROUP BY filePath),
rolled AS (SELECT filePath, first(language) AS language, CAST(count(*) AS INT) AS chunkCount, 0 AS symbolCount FROM chunks GROUP BY filePath), f AS (SELECT r.*, m.vector FROM rolled r JOIN means m ON r.filePath = m.filePath),
{_sql_near('f', 'src1 txt files', 30, 'filePath')}, {_sql_rank('near', 'src1 txt files', 'filePath', False, 'distance, filePath')} SELECT filePath, language, chunkCount, symbolCount, round(score, 6) AS score FROM best""",
    "hybrid_search_symbols": _sql_symbols(SYMBOL_NAME, True),
    "hybrid_search_symbols_partial": _sql_symbols(SYMBOL_PART, True, "class"),
    "hybrid_search_symbols_content": _sql_symbols(SYMBOL_NOWHERE, True),
    "hybrid_search_symbols_words": _sql_symbols(SYMBOL_WORDS, False),
    "detected_changes": f"WITH {_SNAPSHOTS} SELECT filePath, status FROM changes",
    "changes_by_status": f"WITH {_SNAPSHOTS} SELECT status, count(*) AS n FROM changes GROUP BY status",
    "incremental_merge": f"WITH {_SNAPSHOTS} SELECT filePath, fileHash FROM stored WHERE filePath NOT IN (SELECT filePath FROM changes WHERE status <> 'added') UNION ALL SELECT filePath, fileHash FROM current_ WHERE filePath IN (SELECT filePath FROM changes WHERE status <> 'deleted')",
    "vector_reuse": f"""WITH {_FILES}, edited AS (SELECT filePath, language, CASE WHEN length(filePath) % 3 = 0 THEN 'new first line' || chr(10) || content WHEN length(filePath) % 3 = 1 THEN content || '!' ELSE content END AS content FROM files),
old AS (WITH {_sql_chunks(20, 5)} SELECT * FROM chunks), new AS (WITH {_sql_chunks(20, 5, "edited")} SELECT * FROM chunks)
SELECT n.filePath, count(*) AS chunks, count(*) FILTER (o.id IS NOT NULL) AS reused FROM new n LEFT JOIN old o ON n.filePath = o.filePath AND n.id = o.id AND n.summary = o.summary GROUP BY n.filePath""",
    # What is left of each head, and the comments up to the end in windows of 100 lines that share 10.
    "source_text": f"""WITH {_FILES}, t AS (SELECT *, CAST(regexp_extract(filePath, '/([0-9]+)\\.txt$', 1) AS BIGINT) % 4 AS turn FROM files)
SELECT regexp_replace(filePath, 'txt$', CASE turn WHEN 2 THEN 'ts' WHEN 3 THEN 'java' ELSE 'py' END) AS filePath,
  CASE turn WHEN 1 THEN 5 WHEN 3 THEN 6 ELSE 4 END + CAST(ceil(greatest(0, len(string_split(content, chr(10))) - 100) / 90.0) AS BIGINT) AS chunks, CAST(CASE turn WHEN 0 THEN 2 WHEN 2 THEN 2 ELSE 3 END AS BIGINT) AS symbols, CAST(0 AS BIGINT) AS errors FROM t""",
    # Line by line: which no interval holds, their runs, and of each run the lines from the first to the last that isn't blank.
    "gap_chunk_rows": f"""WITH {_FILES}, cut AS (SELECT *, string_split(content, chr(10)) AS l FROM files),
covered AS (SELECT filePath, a, b FROM (SELECT filePath, len(l) AS n, k * 37 + 9 AS a, least(len(l), k * 37 + 9 + k % 3 * 2) AS b FROM (SELECT *, unnest(generate_series(0, len(l) // 37)) AS k FROM cut)) WHERE a <= n
  UNION ALL SELECT filePath, a, b FROM (SELECT filePath, len(l) AS n, k * 41 + 5 AS a, least(len(l), k * 41 + 11) AS b FROM (SELECT *, unnest(generate_series(0, len(l) // 41)) AS k FROM cut)) WHERE a <= n),
lines AS (SELECT filePath, unnest(generate_series(1, len(l))) AS i, unnest(l) AS x FROM cut),
free AS (SELECT * FROM lines f WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.filePath = f.filePath AND f.i BETWEEN c.a AND c.b)),
runs AS (SELECT *, i - row_number() OVER (PARTITION BY filePath ORDER BY i) AS run FROM free),
kept AS (SELECT filePath, min(i) AS a, max(i) AS b FROM runs WHERE regexp_replace(x, '^\\s+|\\s+$', '', 'g') <> '' GROUP BY filePath, run),
starts AS (SELECT *, CAST(unnest(generate_series(0, greatest(0, CAST(ceil((b - a + 1 - 20) / 15.0) AS BIGINT)))) * 15 + a AS INT) AS startLine FROM kept),
ranges AS (SELECT s.filePath, language, startLine, CAST(least(startLine + 19, b) AS INT) AS endLine, l[startLine:least(startLine + 19, b)] AS part FROM starts s JOIN cut c ON s.filePath = c.filePath)
SELECT sha256(filePath || ':' || startLine || ':' || endLine) AS id, filePath, startLine, endLine, sha256(array_to_string(part, chr(10))) AS content_hash, language,
  language || ' code in ' || filePath || ' (lines ' || startLine || '-' || endLine || '): ' || substr(array_to_string(list_filter(part, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g') <> '')[1:5], ' '), 1, 200) AS summary FROM ranges""",
    "deleted_paths": f"WITH {_SNAPSHOTS} SELECT filePath, fileHash FROM stored WHERE filePath NOT IN (SELECT filePath FROM current_)",
}
