"""The life of an index as queries: documents indexed, changed, updated, searched and counted through the store."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sha256
from ..functions.vectors import embed_text
from ..operators.changes import detect_changes
from ..operators.chunking import line_chunks
from ..operators.clustered import cluster, nearest_to_each_stored
from ..operators.search import search_code, search_files
from ..sources.shared import shared_dir
from ..sources.store import IndexStore
from .embedding import HashProvider
from .indexer import stage_index, stage_update, totals
from .queries import ORACLE_SQL as ENGINE_SQL
from .queries import QUERY, _files, _sql_chunks, _sql_rank, _sql_vector, _table


def _before_and_now(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """documents as files of an earlier day, and of today: some are new, some are gone, some have a line more, some can't be read."""
    files = _files(spark, sf_dir).withColumn("fileHash", sha256(F.col("content")))
    number = F.regexp_extract("filePath", r"/(\d+)\.txt\z", 1).cast("long")
    changed = F.when(number % 7 == 0, F.concat("content", F.lit("\nchanged since"))).otherwise(F.col("content"))
    now = files.where(number % 11 != 0).withColumn("content", F.when(number % 17 != 0, changed)).withColumn("fileHash", sha256(F.col("content")))
    return files.where(number % 13 != 0), now


def updated_index(spark: SparkSession, sf_dir: str, with_runs: bool = False) -> tuple[IndexStore, DataFrame]:
    """A store with the index of the earlier day, brought up to today; and the changes."""
    before, now = _before_and_now(spark, sf_dir)
    store, provider = IndexStore(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", "documents", with_runs), HashProvider()
    staged = stage_index(store, line_chunks(before), provider)
    store.publish(staged, totals(staged.files))
    base = store.snapshot()
    changes = detect_changes(now.select("filePath", "fileHash"), base.files.select("filePath", "fileHash"))
    touched = now.join(changes.where("status <> 'deleted'").select("filePath"), "filePath", "left_semi")
    staged = stage_update(store, base, changes, line_chunks(touched), provider)
    store.publish(staged, totals(staged.files))
    return store, changes


def index_after_update(spark, sf_dir):
    store, _ = updated_index(spark, sf_dir)
    return store.chunks().select("id", "filePath", "startLine", "endLine", sha256(F.col("content")).alias("content_hash"), "summary", "language", "fileHash")


def index_status_after_update(spark, sf_dir):
    store, changes = updated_index(spark, sf_dir)
    meta = store.metadata()
    counted = spark.createDataFrame([(k, meta[k]) for k in ("totalFiles", "totalChunks", "totalSymbols")], "name string, n long")
    return counted.unionByName(changes.groupBy(F.col("status").alias("name")).agg(F.count(F.lit(1)).alias("n")))


def search_code_after_update(spark, sf_dir):
    store, _ = updated_index(spark, sf_dir)
    found = search_code(store.chunks(), QUERY, embed_text(QUERY), 10)
    return found.select("filePath", "startLine", "endLine", "language", F.round("score", 5).alias("score"))


def search_files_after_update(spark, sf_dir):
    store, _ = updated_index(spark, sf_dir)
    found = search_files(store.files(), "src1 txt files", embed_text("src1 txt files"), 10)
    return found.select("filePath", "language", "chunkCount", "symbolCount", F.round("score", 5).alias("score"))


#: Literals of several lengths, with and without special characters, in many chunks and in none.
LITERALS = ("%", "é", "qu", "'", "%%%", "heation", "changed since", "the heation of anand", "nowhere at all")


def contents_by_trigrams(spark, sf_dir):
    """The chunks that contain each of some literals, found through the index of runs after an update."""
    store, _ = updated_index(spark, sf_dir, with_runs=True)
    snapshot, found = store.snapshot(), None
    for literal in LITERALS:
        rows = snapshot.containing(literal).select(F.lit(literal).alias("literal"), "filePath", "startLine")
        found = rows if found is None else found.union(rows)
    return found


def knn_in_stored_clusters(spark, sf_dir):
    """batched_knn from an index that is stored by cluster and read in part."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    index = cluster(rows, f"{shared_dir(spark)}/clusters-{uuid.uuid4().hex}", "vec_id")
    asked = rows.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query_vector"))
    return nearest_to_each_stored(index, asked, 3, "vec_id").select("query_id", "rank", "vec_id", F.round("distance", 6).alias("distance"))


QUERIES = {f.__name__: f for f in (contents_by_trigrams, knn_in_stored_clusters, index_after_update, index_status_after_update, search_code_after_update, search_files_after_update)}

_DAY = "source || '/' || doc_id || '.txt' AS filePath, lang AS language"
_NOW = f"""files AS (SELECT {_DAY}, CASE WHEN doc_id % 17 <> 0 AND doc_id % 7 = 0 THEN text || chr(10) || 'changed since' ELSE text END AS content
  FROM documents WHERE doc_id % 11 <> 0 AND NOT (doc_id % 17 = 0 AND doc_id % 13 = 0))"""
_FLOATS = """raw AS (SELECT *, list_transform(range(0, 64), lambda i: CAST(CAST('0x' || substr(sha256(summary), CAST((i % 32) * 2 + 1 AS INT), 2) AS INT) AS DOUBLE) / 128 - 1) AS v FROM chunks),
stored AS (SELECT * EXCLUDE v, CAST(CAST(list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS FLOAT[]) AS DOUBLE[]) AS vector FROM raw)"""


def _near(rows: str, query: str, tie: str) -> str:
    return f"near AS (SELECT *, greatest(0, 1 - distance) AS similarity FROM (SELECT *, 1 - list_cosine_similarity(vector, {_sql_vector(query)}) AS distance FROM {rows}) ORDER BY distance, {tie} LIMIT 30)"


_LITERALS = ", ".join("('" + x.replace("'", "''") + "')" for x in LITERALS)
ORACLE_SQL = {
    "knn_in_stored_clusters": ENGINE_SQL["batched_knn"],
    "contents_by_trigrams": f"WITH {_NOW}, {_sql_chunks()}, l(literal) AS (VALUES {_LITERALS}) SELECT literal, filePath, startLine FROM chunks, l WHERE contains(content, literal)",
    "index_after_update": f"""WITH {_NOW}, {_sql_chunks()}, hashes AS (SELECT filePath, sha256(content) AS fileHash FROM files)
SELECT id, c.filePath, startLine, endLine, sha256(content) AS content_hash, summary, language, fileHash FROM chunks c JOIN hashes h ON c.filePath = h.filePath""",
    "index_status_after_update": f"""WITH {_NOW}, {_sql_chunks()}
SELECT 'totalFiles' AS name, count(*) AS n FROM files UNION ALL SELECT 'totalChunks', count(*) FROM chunks UNION ALL SELECT 'totalSymbols', 0
UNION ALL SELECT 'added', n FROM (SELECT count(*) AS n FROM documents WHERE doc_id % 13 = 0 AND doc_id % 11 <> 0 AND doc_id % 17 <> 0) WHERE n > 0
UNION ALL SELECT 'modified', n FROM (SELECT count(*) AS n FROM documents WHERE doc_id % 13 <> 0 AND doc_id % 11 <> 0 AND doc_id % 17 <> 0 AND doc_id % 7 = 0) WHERE n > 0
UNION ALL SELECT 'deleted', n FROM (SELECT count(*) AS n FROM documents WHERE doc_id % 13 <> 0 AND doc_id % 11 = 0) WHERE n > 0""",
    "search_code_after_update": f"WITH {_NOW}, {_sql_chunks()}, {_FLOATS}, {_near('stored', QUERY, 'id')}, {_sql_rank('near', QUERY, chr(39).join(('content || ', ' ', ' || symbolName || ', ' ', ' || filePath')), False, 'distance, id')} SELECT filePath, startLine, endLine, language, round(score, 5) AS score FROM best",
    "search_files_after_update": f"""WITH {_NOW}, {_sql_chunks()}, {_FLOATS},
vals AS (SELECT filePath, unnest(generate_series(1, 64)) AS pos, unnest(vector) AS x FROM stored), means AS (SELECT filePath, list(CAST(m AS FLOAT)::DOUBLE ORDER BY pos) AS vector FROM (SELECT filePath, pos, avg(x) AS m FROM vals GROUP BY filePath, pos) GROUP BY filePath),
rolled AS (SELECT filePath, first(language) AS language, CAST(count(*) AS INT) AS chunkCount, 0 AS symbolCount FROM chunks GROUP BY filePath), f AS (SELECT r.*, m.vector FROM rolled r JOIN means m ON r.filePath = m.filePath),
{_near('f', 'src1 txt files', 'filePath')}, {_sql_rank('near', 'src1 txt files', 'filePath', False, 'distance, filePath')} SELECT filePath, language, chunkCount, symbolCount, round(score, 5) AS score FROM best""",
}
