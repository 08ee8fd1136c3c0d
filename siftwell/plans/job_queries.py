"""The jobs as queries: each runs twice into one new folder and gives what stands there then."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import index_files, search_batch

from ..sources.shared import shared_dir
from .queries import _sql_chunks, _sql_embed


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_index_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that following documents gives; the second run finds nothing new."""
    base = _folder(spark, "job1")
    for _ in range(2):
        index_files.run(spark, f"{sf_dir}/documents.parquet", f"{base}/out", f"{base}/checkpoint")
    return spark.read.schema(index_files.CHUNKS).parquet(f"{base}/out/chunks")


def job2_search_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of every benchmark text in documents; the second run replaces those of the first by the same."""
    base = _folder(spark, "job2")
    for _ in range(2):
        search_batch.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", f"{base}/out")
    return spark.read.schema(search_batch.HITS).parquet(f"{base}/out").withColumn("score", F.round("score", 6))


QUERIES = {f.__name__: f for f in (job1_index_files, job2_search_batch)}

_NAMED = "files AS (SELECT coalesce(source, '') || '/' || coalesce(CAST(doc_id AS VARCHAR), '') || '.txt' AS filePath, coalesce(CASE WHEN trim(lang) <> '' THEN lang END, 'unknown') AS language, coalesce(text, '') AS content FROM documents)"

ORACLE_SQL = {
    "job1_index_files": f"""WITH {_NAMED}, {_sql_chunks()}, hashes AS (SELECT filePath, sha256(content) AS fileHash FROM files)
SELECT c.id, c.filePath, c.startLine, c.endLine, sha256(c.content) AS contentHash, c.summary, h.fileHash, CAST(0 AS BIGINT) AS batch, c.language FROM chunks c JOIN hashes h ON c.filePath = h.filePath""",
    "job2_search_batch": f"""WITH {_NAMED}, {_sql_chunks()}, vectors AS (SELECT *, {_sql_embed('summary')} AS vector FROM chunks),
asked AS (SELECT item_id AS query_id, coalesce(text, '') AS query, {_sql_embed("coalesce(text, '')")} AS query_vector FROM benchmark),
met AS (SELECT a.query_id, a.query, v.*, 1 - list_cosine_similarity(v.vector, a.query_vector) AS distance FROM vectors v, asked a),
near AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) <= 30),
words AS (SELECT *, list_filter(string_split_regex(lower(content || ' ' || symbolName || ' ' || filePath), '[^a-z0-9_]+'), lambda x: len(x) > 1) AS t,
  list_filter(string_split_regex(lower(query), '[^a-z0-9_]+'), lambda x: len(x) > 1) AS q FROM near),
lengths AS (SELECT *, len(t) AS dl, count(*) OVER (PARTITION BY query_id) AS n, avg(len(t)) OVER (PARTITION BY query_id) AS mean FROM words),
terms AS (SELECT query_id, id, dl, n, mean, t, unnest(q) AS term, unnest(generate_series(1, len(q))) AS place FROM lengths),
tfs AS (SELECT *, len(list_filter(t, lambda x: x = term)) AS tf FROM terms),
dfs AS (SELECT *, count(*) FILTER (tf > 0) OVER (PARTITION BY query_id, place) AS df FROM tfs),
bm AS (SELECT query_id, id, sum(CASE WHEN tf > 0 THEN ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)) ELSE 0 END) AS bm FROM dfs GROUP BY query_id, id),
shares AS (SELECT w.*, coalesce(b.bm, 0) / greatest(max(coalesce(b.bm, 0)) OVER (PARTITION BY w.query_id), 0.001) AS share,
  CASE WHEN regexp_matches(regexp_replace(query, '^\\s+|\\s+$', '', 'g'), '^[a-zA-Z_][a-zA-Z0-9_.]*$') THEN 0.7 ELSE 0.3 END AS of_words FROM words w LEFT JOIN bm b ON w.query_id = b.query_id AND w.id = b.id),
scored AS (SELECT *, (1 - of_words) * greatest(0, 1 - distance) + of_words * share AS score FROM shares),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, distance, id) AS INT) AS rank FROM scored WHERE score >= 0.05)
SELECT query_id, rank, filePath, startLine, endLine, round(score, 6) AS score, language FROM ranked WHERE rank <= 10""",
}
