"""Benchmark decontamination by a positional inverted index, in DataFrame operations only.

The index holds the postings of the test terms that matter: for every window of
a test item its rarest term in the corpus. A posting is (term, document,
position) together with the terms at the offsets -12 to 12, so that the lists of
a window's other terms, adjusted by their offsets, are intersected where the
rarest term's posting stands, without another shuffle of postings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, small, table, written

WINDOW = 13
#: Share of a window's different terms that stand near each other in a proximity match.
NEAR = 0.8
#: Words of a document that are looked at together.
PIECE = 512
#: Fixed values of the contract: what parts words, once A-Z count as letters.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_ORACLE = r"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), i AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), j AS (
    SELECT item_id, w, least(13, len(w)) AS l FROM i WHERE len(w) > 0
), k AS (
    SELECT DISTINCT item_id, l, array_to_string(w[p:p + l - 1], ' ') AS phrase
    FROM (SELECT item_id, w, l, unnest(generate_series(1, len(w) - l + 1)) AS p FROM j)
), g AS (
    SELECT rid, l, p, array_to_string(w[p:p + l - 1], ' ') AS phrase
    FROM (SELECT rid, w, l, unnest(generate_series(1, len(w) - l + 1)) AS p FROM d, (SELECT DISTINCT l FROM j) WHERE len(w) >= l)
), m AS (
    SELECT rid, item_id, p, g.l FROM g JOIN k ON g.phrase = k.phrase AND g.l = k.l
), h AS (
    SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(generate_series(p, p + l - 1)) AS q FROM m) GROUP BY rid
), s AS (
    SELECT rid, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS t FROM m) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON d.rid = h.rid LEFT JOIN s ON d.rid = s.rid
"""
ORACLE_SQL = {"op4_benchmark_decontamination": _ORACLE}


def parts(text: Column) -> Column:
    """The words of a text in their own letter case; the first and the last may be empty strings."""
    return F.split(F.coalesce(text, F.lit("")), SEPARATORS)


def n_parts(words: Column) -> Column:
    """How many of parts() are words."""
    n = F.size(words)
    return (n - (F.get(words, F.lit(0)) == "").cast("int") - ((n > 1) & (F.get(words, n - 1) == "")).cast("int")).cast("long")


def lowered(word: Column) -> Column:
    """A-Z in lower case, other letters as they are; lower() suffices for ASCII words and is faster."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, h, words): doc_id and a hash of the text tell rows apart, but for repeated rows, which match alike."""
    return docs.select("doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h"), parts(F.col("text")).alias("words"))


def _places(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, item, size, at, term, n): every term of each item as a row of its own, written, with its number in all docs or null."""
    each = items.select("item_id", F.transform(F.filter(parts(F.col("text")), lambda w: w != ""), lowered).alias("words")).where(F.size("words") > 0).distinct()
    each = written(each.withColumn("item", F.xxhash64("item_id", "words")).withColumn("size", F.size("words")), "items")
    terms = small(written(each.select(F.explode("words").alias("term")).distinct(), "terms"))
    found = docs.select(F.explode(parts(F.col("text"))).alias("word")).select(lowered(F.col("word")).alias("term"))
    counts = written(found.join(terms, "term").groupBy("term").agg(F.count("*").alias("n")), "counts")
    return each.select("item_id", "item", "size", F.posexplode("words").alias("at", "term")).join(small(counts), "term", "left")


def test_windows(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(term, item_id, n, around): the rarest term of each window of each item, and the item's terms around it.

    n is the length of the item's windows. Terms are counted over all docs;
    windows with a term that no document has are left out, as they can't match.
    Every term of an item is a row of its own, and windows roll over these rows,
    so an item may be as long as a document.
    """
    places = _places(docs, items)
    in_order = W.partitionBy("item").orderBy("at")
    near = F.array(*(F.lag("term", -d).over(in_order) if d < 0 else F.lead("term", d).over(in_order) for d in range(1 - window, window)))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("count"), "at")).over(in_order.rowsBetween(0, window - 1))
    n = F.least(F.col("size"), F.lit(window)).cast("int")
    rolled = written(places.select("item_id", "item", "size", "at", "term", n.alias("n"), near.alias("around"), rarest.alias("rarest")), "rolled")
    led = rolled.where("at <= size - n AND rarest.count > 0").select("item", F.col("rarest.at").alias("at")).distinct()
    return written(rolled.join(led, ["item", "at"], "left_semi").select("term", "item_id", "n", "around").distinct(), "windows")


def proximity_windows(docs: DataFrame, items: DataFrame, least: float = NEAR, window: int = WINDOW) -> DataFrame:
    """(term, item_id, terms): for each window of each item its different terms, a row for each of the rarest of these that leads.

    What has the share ``least`` of a window's m terms lacks m - need of them at most, so it has one of the
    m - need + 1 rarest: each of these leads the window, but for those that no document has.
    """
    in_window = W.partitionBy("item").orderBy("at").rowsBetween(0, window - 1)
    ranked = F.array_sort(F.collect_set(F.struct(F.coalesce("n", F.lit(0)).alias("count"), "term")).over(in_window))
    n = F.least(F.col("size"), F.lit(window))
    rolled = _places(docs, items).withColumn("ranked", ranked).where(F.col("at") <= F.col("size") - n)
    m = F.size("ranked")
    leading = F.slice("ranked", F.lit(1), (m - F.ceil(m * F.lit(least) - 1e-9) + 1).cast("int"))
    led = rolled.select("item_id", F.transform("ranked", lambda x: x["term"]).alias("terms"), F.explode(leading).alias("lead"))
    return written(led.where("lead.count > 0").select(F.col("lead.term").alias("term"), "item_id", "terms").distinct(), "near-windows")


def postings(docs: DataFrame, terms: DataFrame, window: int = WINDOW) -> DataFrame:
    """(term, doc_id, h, at, around): the index of docs (doc_id, text) for terms (term).

    A document's words are taken piece by piece, as the rows of an exploded array each hold what stands beside it.
    Where the terms are few enough to be broadcast, the terms around a posting are looked up after the join.
    Where they are shuffled, no row may carry its piece along: each has the terms around it from the start.
    """
    side = window - 1
    start = lambda k: F.greatest(k * PIECE - side, F.lit(0))
    numbers = F.sequence(F.lit(0), F.greatest(F.ceil(F.size("words") / PIECE).cast("int") - 1, F.lit(0)))
    pieces = F.transform(numbers, lambda k: F.slice("words", start(k) + 1, PIECE + 2 * side))
    pieces = keyed(docs).select("doc_id", "h", F.posexplode(pieces).alias("k", "words"))
    around = lambda i: F.transform(F.sequence(i - side, i + side), lambda p: lowered(F.get("words", p)))
    own = lambda rows: rows.withColumn("at", start(F.col("k")) + F.col("i")).where((F.col("at") >= F.col("k") * PIECE) & (F.col("at") < (F.col("k") + 1) * PIECE))
    if terms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        each = own(pieces.select("doc_id", "h", "k", "words", F.posexplode("words").alias("i", "word"))).withColumn("term", lowered(F.col("word")))
        return each.join(F.broadcast(terms), "term").select("term", "doc_id", "h", "at", around(F.col("i")).alias("around"))
    each = own(pieces.select("doc_id", "h", "k", F.inline(F.transform("words", lambda w, i: F.struct(i.alias("i"), lowered(w).alias("term"), around(i).alias("around"))))))
    return each.join(terms, "term").select("term", "doc_id", "h", "at", "around")


def _agreeing(window: int) -> Column:
    """A string with 1 where a posting's term is the item's term at the same offset, else 0."""
    return F.array_join(F.zip_with("around", "wanted", lambda a, b: F.when(b.isNotNull() & a.eqNullSafe(b), "1").otherwise("0")), "")


def phrase_matches(index: DataFrame, windows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, h, item_id, first, last): runs of positions that windows of the item match exactly."""
    wanted = windows.withColumnRenamed("around", "wanted")
    met = index.join(wanted, "term").withColumn("same", _agreeing(window))
    left = F.length(F.regexp_extract(F.substring("same", 1, window - 1), "1*$", 0))
    right = F.length(F.regexp_extract(F.substring("same", window + 1, window - 1), "^1*", 0))
    return met.withColumn("left", left).withColumn("right", right).where("left + right + 1 >= n").select("doc_id", "h", "item_id", (F.col("at") - F.col("left")).alias("first"), (F.col("at") + F.col("right")).alias("last"))


def proximity_matches(index: DataFrame, windows: DataFrame, least: float = NEAR) -> DataFrame:
    """(doc_id, h, item_id, at, share): places of leading terms of proximity_windows with at least the share ``least`` of
    a window's different terms within 12 words on either side, in whatever order; the largest share of the item's windows.

    Every stretch of 13 words that holds such a share of a window holds a leading term, and so is found. The index must
    have the postings of the windows' terms.
    """
    share = F.size(F.array_intersect("terms", F.array_compact("around"))) / F.size("terms")
    met = index.join(windows, "term").select("doc_id", "h", "item_id", "at", share.alias("share")).where(F.col("share") >= least - 1e-9)
    return met.groupBy("doc_id", "h", "item_id", "at").agg(F.max("share").alias("share"))


def near_contamination(docs: DataFrame, items: DataFrame, least: float = NEAR, window: int = WINDOW) -> DataFrame:
    """proximity_matches of all docs (doc_id, text) and items (item_id, text).

    Null and empty texts match nothing, repeated rows and items once, an item with a null id like any other; tables
    without rows give none, and other columns aren't looked at.
    """
    windows = proximity_windows(docs, items, least, window)
    index = written(postings(docs, windows.select("term").distinct(), window), "near-postings")
    return proximity_matches(index, windows, least)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, h, n_words, n_hit, n_items, items_sha256, contaminated) for each row of docs (doc_id, text).

    Null and empty texts have no words. Repeated items count once; an item with
    a null id can hit words but isn't counted or listed. Rows that repeat a
    doc_id are judged each by its own text. Empty tables give no rows, or no hits.
    Other columns of either table, of any name, aren't looked at. A text or an item may be of any length.
    """
    windows = test_windows(docs, items, window)
    index = written(postings(docs, windows.select("term").distinct(), window), "postings")
    matches = written(phrase_matches(index, windows, window), "matches")
    hits = matches.select("doc_id", "h", F.explode(F.sequence("first", "last")).alias("at")).distinct().groupBy("doc_id", "h").agg(F.count("*").alias("n_hit"))
    listed = matches.where("item_id IS NOT NULL").select("doc_id", "h", F.col("item_id").cast("string").alias("t")).distinct().groupBy("doc_id", "h").agg(F.array_sort(F.collect_list("t")).alias("ids"))
    found = written(hits.join(listed, hits["doc_id"].eqNullSafe(listed["doc_id"]) & (hits["h"] == listed["h"]), "left").select(hits["doc_id"].alias("id"), hits["h"].alias("hash"), "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256")), "hits")
    rows = keyed(docs).select("doc_id", "h", n_parts(F.col("words")).alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.join(found, rows["doc_id"].eqNullSafe(found["id"]) & (rows["h"] == found["hash"]), "left").select(
        "doc_id",
        "h",
        "n_words",
        n_hit.alias("n_hit"),
        F.greatest(F.coalesce("n_items", F.lit(0)), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("h")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the contaminated ones; each row is judged by its own text, rows with a null text or id too.

    All columns, of any name, and repeated rows stay as they are; an empty table, or an empty benchmark, changes nothing.
    """
    judged = contamination(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    bad = small(written(judged.where("contaminated").select(F.col("doc_id").alias("id"), "h").distinct(), "contaminated"))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["id"]) & (F.coalesce(F.xxhash64(docs["text"]), F.lit(0)) == bad["h"]), "left_anti")
