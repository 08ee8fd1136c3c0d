"""The three hybrid searches: content, files and symbols."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.languages import LANGUAGE_IDS
from ..functions.text import is_identifier, is_identifier_query, matches_glob, sanitize_language, sanitize_symbol_type, without_controls
from .bm25 import bm25_of_each, with_bm25
from .knn import nearest, nearest_to_each

#: Results below this score are noise; so many times the limit are fetched to be ranked anew.
LEAST_SCORE = 0.05
OVERFETCH = 3
#: Queries up to which the candidates are sent to all contents.
SENT_QUERIES = 1000


def _weights(query: str) -> tuple[float, float]:
    """Of vector similarity and of BM25: names are matched by words, sentences by meaning."""
    return (0.3, 0.7) if is_identifier_query(query) else (0.7, 0.3)


def _fused(candidates: DataFrame, query: str, text, boost=None) -> DataFrame:
    """candidates (with similarity) with their score."""
    of_vector, of_words = _weights(query)
    scored = with_bm25(candidates, query, text)
    score = F.lit(of_vector) * F.col("similarity") + F.lit(of_words) * F.col("bm25_share")
    return scored.withColumn("score", score + boost if boost is not None else score).where(F.col("score") >= LEAST_SCORE)


def _similar(rows: DataFrame, vector: Sequence[float], k: int, tie: str) -> DataFrame:
    return nearest(rows, vector, k, tie).withColumn("similarity", F.greatest(F.lit(0.0), 1 - F.col("distance")))


def search_code(chunks: DataFrame, query: str, vector: Sequence[float], limit: int = 10, language: str | None = None, file_pattern: str | None = None) -> DataFrame:
    """(filePath, startLine, endLine, content, symbolName, symbolType, language, score), best first.

    The filters apply before the nearest 3 * limit chunks are taken; these are
    ranked by similarity and BM25 together. An unknown language is an error.
    Ties keep the order of distance and id.
    """
    if language:
        known = sanitize_language(language)
        if not known:
            raise ValueError(f'Unknown language "{language}". Valid values: {", ".join(LANGUAGE_IDS)}')
        chunks = chunks.where(F.col("language") == known)
    if file_pattern:
        chunks = chunks.where(matches_glob(F.col("filePath"), file_pattern))
    found = _fused(_similar(chunks, vector, limit * OVERFETCH, "id"), query, F.concat_ws(" ", "content", F.coalesce("symbolName", F.lit("")), "filePath"))
    best = found.orderBy(F.desc("score"), "distance", "id").limit(limit)
    return best.select("filePath", "startLine", "endLine", "content", "symbolName", "symbolType", "language", "score")


def search_code_of_each(chunks: DataFrame, queries: DataFrame, limit: int = 10, held: Callable[[DataFrame], DataFrame] = lambda found: found) -> DataFrame:
    """(query_id, rank, filePath, startLine, endLine, content, symbolName, symbolType, language, score): search_code for each of queries (query_id, query, query_vector).

    Ids of chunks and of queries are distinct. All queries meet the chunks in one pass; contents are looked up for the candidates alone.
    held: keeps the candidates, at most limit * OVERFETCH a query, as persist() does, so that they aren't made again for each use.
    """
    near = nearest_to_each(chunks, queries, limit * OVERFETCH, "id").drop("rank").join(queries.select("query_id", "query"), "query_id")
    contents = chunks.select("id", "filePath", "startLine", "endLine", "content", "symbolName", "symbolType", "language")
    if queries.count() <= SENT_QUERIES:  # few candidates go to the contents, which stay where they are
        near = F.broadcast(near)
    found = held(contents.join(near, "id"))
    found = bm25_of_each(found, F.concat_ws(" ", "content", F.coalesce("symbolName", F.lit("")), "filePath"), F.col("query"), "query_id", "id")
    of_words = F.when(is_identifier(F.col("query")), 0.7).otherwise(0.3)
    found = found.withColumn("score", (1 - of_words) * F.greatest(F.lit(0.0), 1 - F.col("distance")) + of_words * F.col("bm25_share")).where(F.col("score") >= LEAST_SCORE)
    found = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "distance", "id"))).where(F.col("rank") <= limit)
    return found.select("query_id", "rank", "filePath", "startLine", "endLine", "content", "symbolName", "symbolType", "language", "score")


def search_files(files: DataFrame, query: str, vector: Sequence[float], limit: int = 10) -> DataFrame:
    """(filePath, language, chunkCount, symbolCount, score), best first: mean vectors, and BM25 over paths."""
    found = _fused(_similar(files, vector, limit * OVERFETCH, "filePath"), query, F.col("filePath"))
    best = found.orderBy(F.desc("score"), "distance", "filePath").limit(limit)
    return best.select("filePath", "language", "chunkCount", "symbolCount", "score")


_ORDER = ("filePath", "startLine", "id")


def search_symbols(chunks: DataFrame, query: str, vector: Sequence[float], limit: int = 10, symbol_types: Sequence[str] | None = None, containing: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """(filePath, startLine, endLine, symbolName, symbolType, content, language, score), best first.

    A name is looked for as a symbol's whole name, then as part of one, and, if
    neither finds any, in the contents; the nearest chunks come in addition. A
    chunk counts once, for the first way that found it. Matches of each way are
    taken in order of path, line and id. Symbol types that aren't words are
    ignored; if none is left, nothing is filtered. containing: gives the chunks whose content
    contains a literal, where an index knows them; else they are scanned.
    """
    types = [t for t in (sanitize_symbol_type(x) for x in symbol_types or ()) if t]
    of_types = lambda found: found.where(F.col("symbolType").isin(types)) if types else found
    chunks = of_types(chunks)
    fields = ["id", "filePath", "startLine", "endLine", "symbolName", "symbolType", "content", "language"]
    rows = chunks.select(*fields, "vector")
    own_text = F.concat_ws(" ", "symbolName", "symbolType", "content")

    def way(found: DataFrame, rank: int, boost: float, text=own_text, near=None) -> DataFrame:
        near = F.lit(0.5) if near is None else near
        distance = F.col("distance") if "distance" in found.columns else F.lit(0.0)
        return found.select(*fields, near.alias("similarity"), distance.alias("distance"), F.lit(rank).alias("way"), F.lit(boost).alias("boost"), text.alias("text"))

    named = is_identifier_query(query)
    near = _similar(rows if named else rows.where(F.col("symbolName") != ""), vector, limit * OVERFETCH, "id")
    ways = way(near, 3, 0.0, near=F.col("similarity"))
    if named:
        name = without_controls(query)
        exact = way(rows.where(F.col("symbolName") == name).orderBy(*_ORDER).limit(limit), 0, 0.5)
        partial = way(rows.where(F.contains("symbolName", F.lit(name)) & (F.col("symbolName") != name)).orderBy(*_ORDER).limit(limit), 1, 0.25)
        by_name = exact.union(partial)
        # Whether a name was found is one row, so the fall-back needs no second job.
        none = F.broadcast(by_name.agg((F.count(F.lit(1)) == 0).alias("_none")))
        inside = of_types(containing(name)).select(*fields, "vector") if containing else rows.where(F.contains("content", F.lit(name)))
        inside = inside.orderBy(*_ORDER).limit(limit).crossJoin(none).where("_none").drop("_none")
        filled = inside.withColumn("symbolName", F.when(F.col("symbolName") == "", query).otherwise(F.col("symbolName"))).withColumn("symbolType", F.when(F.col("symbolType") == "", "unknown").otherwise(F.col("symbolType")))
        ways = by_name.union(way(filled, 2, 0.3, F.concat_ws(" ", F.lit(query), "content"))).union(ways)
    first = ways.withColumn("_turn", F.row_number().over(W.partitionBy("id").orderBy("way"))).where("_turn = 1")
    found = _fused(first, query, F.col("text"), F.col("boost"))
    best = found.orderBy(F.desc("score"), "way", "distance", *_ORDER).limit(limit)
    return best.select("filePath", "startLine", "endLine", "symbolName", "symbolType", "content", "language", "score")
