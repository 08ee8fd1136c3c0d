"""Mixing sources to target weights by temperature, in DataFrame operations only.

A source's weight is its share of the tokens to a power a between 0 and 1,
normalised. a is bisected so that the entropy of the weights reaches its target,
but not below the a at which the rarest source would be repeated more often than
the limit. The weights become token budgets: the source that is weighted down
most is passed once, so no document is dropped, and every other source so often
that the budgets stand in proportion to the weights.

A budget is realised as passes (epochs) over the source's 256 blocks. Each pass
has its own order of blocks, and of the last, partial pass only as many blocks
are taken as the rest of the budget needs; the block on the border is cut by
sub-blocks and then by documents. Sums of at most 256 blocks a source find the
border, so a source of any size is never sorted or gathered as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import table, small, written

#: Target entropy as a share of that of equal weights, and the most passes over a source.
ENTROPY = 0.9
REPEATS = 4.0
STEPS = 50

_ORACLE = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\v\f\r]+')) AS BIGINT) AS n_tokens, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h
    FROM documents
), t AS (
    SELECT coalesce(source, '') AS s, source, sum(n_tokens) AS tokens FROM d GROUP BY source HAVING sum(n_tokens) > 0
), p AS (
    SELECT list(tokens / total ORDER BY tokens) AS ps, max(tokens / total) AS most, min(tokens / total) AS least FROM t, (SELECT sum(tokens) AS total FROM t)
), b AS (
    SELECT 0 AS i, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi
    UNION ALL
    SELECT i + 1, CASE WHEN fit THEN m ELSE lo END, CASE WHEN fit THEN hi ELSE m END
    FROM (
        SELECT i, lo, hi, m, ln(z) - m * y / z >= 0.9 * ln(len(ps)) AS fit
        FROM (
            SELECT i, lo, hi, (lo + hi) / 2 AS m, ps, most, least, list_sum(list_transform(ps, lambda p: pow(p, (lo + hi) / 2))) AS z, list_sum(list_transform(ps, lambda p: pow(p, (lo + hi) / 2) * ln(p))) AS y
            FROM b, p WHERE i < 50
        )
    )
), c AS (
    SELECT 0 AS i, CAST(0 AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS hi
    UNION ALL
    SELECT i + 1, CASE WHEN pow(most / least, 1 - (lo + hi) / 2) > 4 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN pow(most / least, 1 - (lo + hi) / 2) > 4 THEN hi ELSE (lo + hi) / 2 END
    FROM c, p WHERE i < 50
), a AS (
    SELECT round(greatest((SELECT lo FROM b WHERE i = 50), (SELECT hi FROM c WHERE i = 50)), 9) AS a
), e AS (
    SELECT t.source, tokens, CAST(floor(tokens * pow(most / (tokens / (SELECT sum(tokens) FROM t)), 1 - a) + 0.5) AS BIGINT) AS budget FROM t, p, a
), f AS (
    SELECT source, CAST(budget // tokens AS BIGINT) AS whole, CAST(budget % tokens AS BIGINT) AS rest FROM e
), g AS (
    SELECT d.*, coalesce(whole, 1) AS whole, coalesce(rest, 0) AS rest, CAST('0x' || substr(h, 1, 2) AS INT) AS block, CAST('0x' || substr(h, 3, 2) AS INT) AS sub
    FROM d LEFT JOIN f ON d.source IS NOT DISTINCT FROM f.source
), k AS (
    SELECT *, coalesce(sum(n_tokens) OVER (
        PARTITION BY source ORDER BY md5(concat_ws('|', coalesce(source, ''), whole, block)), md5(concat_ws('|', coalesce(source, ''), whole, block, sub)), h, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING
    ), 0) < rest AS more
    FROM g
)
SELECT doc_id, source, n_tokens, CAST(epoch AS INT) AS epoch, block, substr(md5(concat_ws('|', coalesce(source, ''), epoch, block)), 1, 16) AS block_key
FROM (SELECT *, unnest(generate_series(0, whole - 1 + CASE WHEN more THEN 1 ELSE 0 END)) AS epoch FROM k)
"""
ORACLE_SQL = {"op5_mixing_sources": _ORACLE}


def n_tokens(text: Column) -> Column:
    """Words between white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def doc_hash(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))


def _byte(h: Column, k: int) -> Column:
    """Byte k of a hash in hexadecimal digits."""
    digit = lambda at: F.instr(F.lit("0123456789abcdef"), F.substring(h, at, 1)) - 1
    return digit(2 * k + 1) * 16 + digit(2 * k + 2)


def order_key(*parts: Column) -> Column:
    """What orders the blocks of a source in a pass."""
    source, *rest = parts
    return F.md5(F.concat_ws("|", F.coalesce(source, F.lit("")), *(x.cast("string") for x in rest)))


def exponent(shares: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS) -> DataFrame:
    """One row (a, most) from shares (share): the exponent, and the largest share.

    ``entropy`` is a share of the entropy of equal weights. The bisection runs
    inside one expression over the array of shares, a number for each source.
    """
    array = shares.agg(F.sort_array(F.collect_list("share")).alias("ps"))
    z = "aggregate(ps, 0D, (s, p) -> s + pow(p, (x.lo + x.hi) / 2))"
    y = "aggregate(ps, 0D, (s, p) -> s + pow(p, (x.lo + x.hi) / 2) * ln(p))"
    halve = lambda test: f"aggregate(sequence(1, {STEPS}), named_struct('lo', 0D, 'hi', 1D), (x, i) -> if({test}, named_struct('lo', (x.lo + x.hi) / 2, 'hi', x.hi), named_struct('lo', x.lo, 'hi', (x.lo + x.hi) / 2)))"
    flat = halve(f"ln({z}) - (x.lo + x.hi) / 2 * {y} / {z} >= {entropy!r}D * ln(size(ps))")
    often = halve(f"pow(array_max(ps) / array_min(ps), 1 - (x.lo + x.hi) / 2) > {repeats!r}D")
    return array.where("size(ps) > 0").select(F.expr(f"round(greatest({flat}.lo, {often}.hi), 9)").alias("a"), F.array_max("ps").alias("most"))


def plan(rows: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS) -> DataFrame:
    """One row for each source of rows (doc_id, source, n_tokens, h) that has tokens.

    whole passes, what blocks (taken) and sub-blocks (subs) the last pass takes
    wholly (1), in part (2) or not (0), and the border document (cut).
    """
    blocks = written(rows.groupBy("source", _byte(F.col("h"), 0).alias("block")).agg(F.sum("n_tokens").alias("n")), "blocks")
    tokens = blocks.groupBy("source").agg(F.sum("n").alias("tokens")).where("tokens > 0")
    total = tokens.agg(F.sum("tokens").alias("total"))
    shares = tokens.join(F.broadcast(total)).withColumn("share", F.col("tokens") / F.col("total"))
    budget = F.floor(F.col("tokens") * F.pow(F.col("most") / F.col("share"), 1 - F.col("a")) + 0.5)
    budgets = shares.join(F.broadcast(exponent(shares, entropy, repeats))).withColumn("budget", budget)
    budgets = written(budgets.select("source", F.expr("cast(budget div tokens as long)").alias("whole"), F.expr("cast(budget % tokens as long)").alias("rest"), F.col("share"), "a"), "budgets")

    def border(sums: DataFrame, key: str, rest: str, *order: str) -> DataFrame:
        """sums with their state in the last pass (0, 1, 2) and what is still to fill where they begin."""
        before = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("ordered").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        left = F.col(rest) - before
        state = F.when(left <= 0, 0).when(left >= F.col("n"), 1).otherwise(2)
        return sums.withColumn("ordered", order_key(*(F.col(x) for x in ("source", "whole", *order)))).withColumn("left", left).withColumn("state", state)

    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    only = small(budgets)
    level1 = written(border(blocks.join(only, same(blocks, only)).select(blocks["*"], "whole", "rest"), "block", "rest", "block"), "level1")
    cut1 = small(written(level1.where("state = 2").select(F.col("source").alias("s1"), "whole", "block", F.col("left").alias("rest")), "cut1"))
    inside = rows.join(cut1, rows["source"].eqNullSafe(F.col("s1")) & (_byte(rows["h"], 0) == F.col("block"))).select(rows["*"], "whole", "block", "rest")
    inside = written(inside.withColumn("sub", _byte(F.col("h"), 1)), "inside")
    subs = inside.groupBy("source", "whole", "block", "rest", "sub").agg(F.sum("n_tokens").alias("n"))
    level2 = written(border(subs, "sub", "rest", "block", "sub"), "level2")
    cut2 = small(written(level2.where("state = 2").select(F.col("source").alias("s2"), F.col("sub").alias("sub2"), F.col("left").alias("rest2")), "cut2"))
    last = inside.join(cut2, inside["source"].eqNullSafe(F.col("s2")) & (F.col("sub") == F.col("sub2")))
    at = F.coalesce(F.sum("n_tokens").over(W.partitionBy("source").orderBy("h", "doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = last.withColumn("before", at).where("before < rest2").groupBy("source").agg(F.max(F.struct("h", "doc_id", "n_tokens")).alias("cut"))

    states = lambda level, key: F.map_from_entries(F.collect_list(F.struct(key, "state"))).alias("states")
    one = level1.where("state > 0").groupBy(F.col("source").alias("s1")).agg(states(level1, "block")).withColumnRenamed("states", "taken")
    two = level2.where("state > 0").groupBy(F.col("source").alias("s2")).agg(states(level2, "sub")).withColumnRenamed("states", "subs")
    out = budgets.join(one, F.col("source").eqNullSafe(F.col("s1")), "left").join(two, F.col("source").eqNullSafe(F.col("s2")), "left")
    cut = cut.withColumnRenamed("source", "s3")
    return written(out.join(cut, F.col("source").eqNullSafe(F.col("s3")), "left").select("source", "whole", "taken", "subs", "cut", "share", "a"), "mixture")


def passes(rows: DataFrame, mixture: DataFrame) -> DataFrame:
    """rows (any columns, with doc_id, source, n_tokens, h), once for each pass they are in, with the pass as _epoch.

    Sources without tokens are passed once.
    """
    m = small(mixture.select(F.col("source").alias("_source"), F.col("whole").alias("_whole"), F.col("taken").alias("_taken"), F.col("subs").alias("_subs"), F.col("cut").alias("_cut")), 50_000)
    state = F.coalesce(F.try_element_at("_taken", _byte(F.col("h"), 0)), F.lit(0))
    sub = F.coalesce(F.try_element_at("_subs", _byte(F.col("h"), 1)), F.lit(0))
    within = (sub == 1) | ((sub == 2) & F.coalesce(F.struct("h", "doc_id", "n_tokens") <= F.col("_cut"), F.lit(False)))
    more = F.when(state == 2, within).otherwise(state == 1).cast("int")
    last = F.coalesce(F.col("_whole"), F.lit(1)) - 1 + more
    return rows.join(m, rows["source"].eqNullSafe(m["_source"]), "left").withColumn("_epoch", F.explode(F.sequence(F.lit(0), last.cast("int")))).drop("_source", "_whole", "_taken", "_subs", "_cut")


def token_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", n_tokens(F.col("text")).alias("n_tokens"), doc_hash(F.col("doc_id")).alias("h"))


def mixed(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS) -> DataFrame:
    """(doc_id, source, n_tokens, epoch, block, block_key) for each pass that a row of docs is in.

    In a pass, blocks follow each other by block_key. Nulls: a null source is a
    source of its own, a null id hashes as an empty string, a null text has no
    tokens. Rows that repeat a doc_id count each; where the border falls among
    rows alike in doc_id and tokens, all or none of them are in the last pass.
    """
    rows = written(token_rows(docs), "tokens")
    block = _byte(F.col("h"), 0).alias("block")
    key = F.substring(order_key(F.col("source"), F.col("_epoch"), _byte(F.col("h"), 0)), 1, 16).alias("block_key")
    return passes(rows, plan(rows, entropy, repeats)).select("doc_id", "source", "n_tokens", F.col("_epoch").alias("epoch"), block, key)


def op5_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs, each row as often as its source's budget asks for; at least once.

    A row travels as one column, so columns of any name stand beside the work columns.
    Nulls, repeated rows and sources without tokens are treated as in mixed; an empty table stays empty.
    """
    mixture = plan(written(token_rows(docs), "tokens"))
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "source", n_tokens(F.col("text")).alias("n_tokens"), doc_hash(F.col("doc_id")).alias("h"))
    return passes(rows, mixture).select("row.*")
