"""Source divergence audit by sort-based streaming.

Map tasks cut texts into terms and send, for each chunk of documents, one row a
(lang, term, source) with its number of documents and occurrences. The rows are
dealt by (lang, term) and sorted by language, term, source and document; one scan
over runs of equal keys gives document frequencies and counts, and passes on the
terms that enough documents of the language have. The kept runs are then read a
bucket of terms at a time beside the totals of their sources, and give partial
sums of each pair of sources and the best terms of each source, which are added up.

A chunk sends one row a source for a term, however frequent the term is in it, so
no (lang, term) has more rows than there are chunks and sources. All arithmetic is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_chunks, small, table, written

LEAST_DOCUMENTS, SCALE, TOP = 10, 1_000_000_000, 10
#: Bytes of text that are counted together before rows are sent, and bytes of a text from which its rows are sent in parts.
CHUNK = 16 << 20
#: Kept runs of a bucket of terms and sources of a tile, about.
BUCKET, TILE = 100_000, 128
RUNS = "lang string, term string, source string, document long, df long, n long"


def _terms(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes, and whether each belongs to a term: a letter of A-Z, a-z, or of a character beyond ASCII."""
    upper = (data >= 65) & (data <= 90)
    data = np.where(upper, data + 32, data).astype(np.uint8)
    return data, ((data >= 97) & (data <= 122)) | (data >= 128)


def _chunk_runs(groups: np.ndarray, ends: np.ndarray, data: np.ndarray, first_document: int) -> tuple | None:
    """(group, term, document, df, n) of the runs in documents with bytes data[ends[i]:ends[i + 1]] of group groups[i]."""
    data, inside = _terms(data)
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # A term ends with its document; the next one's goes on in the same bytes.
    cut = ends[1:-1][(ends[1:-1] > 0) & (ends[1:-1] < len(data))]
    cut = np.unique(cut[inside[cut] & inside[cut - 1]]) if len(cut) else cut
    if len(cut):
        start, end = np.sort(np.append(start, cut)), np.sort(np.append(end, cut))
    if not len(start):
        return None
    lengths = end - start
    offsets, letters = np.append(0, np.cumsum(lengths)), data[inside]
    words = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    codes = words.indices.to_numpy().astype(np.int64)
    document = np.searchsorted(ends, start, side="right") - 1
    group = groups[document]
    # Sorted by group, term and document: runs of equal numbers.
    n_terms, n_docs = len(words.dictionary), len(ends) - 1
    by_document = np.sort((group * n_terms + codes) * n_docs + document)
    new = np.append(True, by_document[1:] != by_document[:-1])
    in_doc = by_document[new]
    occurrences = np.diff(np.append(np.flatnonzero(new), len(by_document)))
    key = in_doc // n_docs
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    df = np.diff(np.append(first, len(key)))
    n = np.add.reduceat(occurrences, first)
    return key[first] // n_terms, words.dictionary.take(pa.array(key[first] % n_terms)), first_document + in_doc[first] % n_docs, df, n


def term_runs(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(lang, term, source, document, df, n): for each chunk of documents its runs; document is the first one's number.

    A text longer than a chunk comes in parts under one number, so that equal numbers are one document.
    """
    names = [c.split()[0] for c in RUNS.split(", ")]

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40  # documents of a task have numbers of their own
        for batch in batches:
            lang, source = (c.dictionary_encode() for c in (batch.column(1), batch.column(2)))
            n_sources = max(1, len(source.dictionary))
            groups = lang.indices.to_numpy().astype(np.int64) * n_sources + source.indices.to_numpy()
            for at, ends, data in byte_chunks(batch.column(0), chunk):
                n = len(ends) - 1
                for part_ends, part in [(ends, data)] if n > 1 else _parts(data, chunk):
                    found = _chunk_runs(groups[at : at + n], part_ends, part, number)
                    if found is not None:
                        group, term, document, df, count = found
                        columns = [lang.dictionary.take(pa.array(group // n_sources)), term.cast(pa.string()), source.dictionary.take(pa.array(group % n_sources)), *(pa.array(x.astype(np.int64)) for x in (document, df, count))]
                        for i in range(0, len(term), 50_000):
                            yield pa.RecordBatch.from_arrays([c.slice(i, 50_000) for c in columns], names)
                number += n

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(empty("text"), empty("lang"), empty("source")).mapInArrow(run, RUNS)


def _parts(data: np.ndarray, chunk: int):
    """Of one document, parts of about ``chunk`` bytes that end where a term does, or inside a term that is longer than a chunk is."""
    at = 0
    while at < len(data) or not at:
        to = min(len(data), at + chunk)
        while to < len(data) and (_terms(data[to - 1 : to + 1])[1]).all():
            to += 1
        yield np.array([0, to - at]), data[at:to]
        at = max(to, 1)


def kept_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS, chunk: int = CHUNK) -> DataFrame:
    """(lang, term, source, n, n_lang, leads): occurrences of the terms that at least ``least`` documents of their language have.

    leads marks one row of each term. The scan keeps no more than the sources of one term.
    """
    out = "lang string, term string, source string, n long, n_lang long, leads boolean"
    runs = term_runs(docs, chunk).repartition("lang", "term").withColumn("_h", F.xxhash64("lang", "term"))
    # The hash comes first so that most comparisons of the sort are of one number.
    runs = runs.sortWithinPartitions("_h", "lang", "term", "source", "document").drop("_h")
    names = [c.split()[0] for c in out.split(", ")]

    def differs(column: pa.Array) -> np.ndarray:
        return pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)

    def scan(batches):
        held = None

        def reduced(rows: pa.RecordBatch, whole: bool):
            """Finished terms of sorted rows as output, and the rows of the last one added up if more may follow."""
            lang, term, source = (rows.column(i) for i in range(3))
            document, df, n = (rows.column(i).to_numpy() for i in range(3, 6))
            new_term = np.append(True, differs(lang) | differs(term))
            new_run = new_term | np.append(True, differs(source))
            again = np.append(False, (document[1:] == document[:-1]) & ~new_run[1:])  # a part of the same document
            at, last = np.flatnonzero(new_run), np.append(np.flatnonzero(new_run)[1:], len(n)) - 1
            df, n = np.add.reduceat(np.where(again, df - 1, df), at), np.add.reduceat(n, at)
            runs = pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in (lang, term, source)), pa.array(document[last]), pa.array(df), pa.array(n)], rows.schema.names)
            terms = np.flatnonzero(new_term[at])
            until = len(at) if whole else int(terms[-1])
            rest = runs.slice(until)
            terms = terms[terms < until]
            if not len(terms):
                return None, rest
            sizes = np.diff(np.append(terms, until))
            enough = np.repeat(np.add.reduceat(df[:until], terms) >= least, sizes)
            leads = np.zeros(until, bool)
            leads[terms] = True
            total = np.repeat(np.add.reduceat(n[:until], terms), sizes)
            done = runs.slice(0, until)
            columns = [*(done.column(i) for i in range(3)), pa.array(n[:until]), pa.array(total), pa.array(leads)]
            return pa.RecordBatch.from_arrays(columns, names).filter(pa.array(enough)), rest

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None or not held.num_rows else pa.Table.from_batches([held.cast(batch.schema), batch]).combine_chunks().to_batches()[0]
            done, held = reduced(rows, False)
            if done is not None and done.num_rows:
                yield done
        if held is not None and held.num_rows:
            done, _ = reduced(held, True)
            if done is not None and done.num_rows:
                yield done

    return runs.mapInArrow(scan, out)


def _scaled(count: np.ndarray, total: np.ndarray, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), by long division in thousands so that nothing overflows."""
    over = total + 2 * terms
    whole, rest = np.divmod(count + 2, over)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, over)
        whole = whole * 1000 + digit
    return 1 + whole


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


PARTS = "lang string, source string, part string, item string, value long"


def _pair_sums(a: tuple, b: tuple, counts_a: list, counts_b: list, terms: int) -> np.ndarray:
    """For sources a and b, each (totals, ..), the sum over the given terms of f less f of two zero counts.

    counts: (term, source, count) arrays. Only terms that one of the two sources has are looked at.
    """
    zero_a, zero_b = (_scaled(np.zeros(len(x), np.int64), x, terms) for x in (a, b))
    base = _apart(zero_a[:, None], zero_b[None, :])
    out = np.zeros(base.shape, np.int64)
    term_a, at_a, n_a = counts_a
    term_b, at_b, n_b = counts_b
    step = max(1, (1 << 21) // max(1, len(a) + len(b)))
    order_a, order_b = np.argsort(term_a, kind="stable"), np.argsort(term_b, kind="stable")
    term_a, at_a, n_a, term_b, at_b, n_b = term_a[order_a], at_a[order_a], n_a[order_a], term_b[order_b], at_b[order_b], n_b[order_b]
    most = 1 + max(term_a[-1] if len(term_a) else -1, term_b[-1] if len(term_b) else -1)
    for low in range(0, most, step):
        high = min(most, low + step)
        p, q = np.tile(zero_a, (high - low, 1)), np.tile(zero_b, (high - low, 1))
        i, j = np.searchsorted(term_a, [low, high])
        p[term_a[i:j] - low, at_a[i:j]] = _scaled(n_a[i:j], a[at_a[i:j]], terms)
        has = np.zeros((high - low, len(a)), bool)
        has[term_a[i:j] - low, at_a[i:j]] = True
        k, m = np.searchsorted(term_b, [low, high])
        q[term_b[k:m] - low, at_b[k:m]] = _scaled(n_b[k:m], b[at_b[k:m]], terms)
        for s in range(len(a)):
            rows = np.flatnonzero(has[:, s])
            out[s] += (_apart(p[rows, s][:, None], q[rows]) - base[s]).sum(axis=0)
        by_source = np.argsort(at_b[k:m], kind="stable") + k
        cuts = np.searchsorted(at_b[by_source], np.arange(len(b) + 1))
        for s in range(len(b)):
            rows = term_b[by_source[cuts[s] : cuts[s + 1]]] - low
            out[:, s] += np.where(has[rows], 0, _apart(p[rows], q[rows, s][:, None]) - base[:, s]).sum(axis=0)
    return out


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP, bucket: int = BUCKET, tile: int = TILE, chunk: int = CHUNK) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs (text, lang, source, ..): how far sources of a language are apart, and by which terms.

    A null text, lang or source is an empty one; rows count each for itself, repeated ones too. A
    language without kept terms has pairs of value 0 and no terms; a source alone in its language has no
    pairs. Other columns aren't looked at, and a table without rows gives none.

    Sources come in tiles and terms in buckets, so a task holds a bucket's rows of two tiles, whatever the number of sources.
    """
    spark = docs.sparkSession
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    kept = written(kept_terms(docs, least, chunk), "terms")
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("rows"), F.count_if("leads").alias("led"))
    groups = docs.select(empty("lang"), empty("source")).distinct().join(totals, ["lang", "source"], "left").na.fill(0, ["total", "rows", "led"])
    groups = written(groups, "groups")
    langs = groups.groupBy("lang").agg(F.sum("total").alias("total_lang"), F.sum("led").alias("terms"), F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("sources"))
    tiles = F.ceil(F.col("sources") / tile).cast("int").alias("tiles")
    langs = small(written(langs.select("lang", "total_lang", "terms", tiles, F.greatest(F.lit(1), F.ceil(F.col("rows") / bucket)).cast("int").alias("buckets")), "langs"))

    mine = F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")
    tile_of: Column = F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda other: F.struct(F.least("tile", other).alias("a"), F.greatest("tile", other).alias("b"))))
    runs = kept.join(langs, "lang").withColumn("tile", mine).withColumn("_t", tile_of)
    runs = runs.select("lang", "_t.a", "_t.b", F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int").alias("bucket"), "tile", "term", "source", "n", "n_lang")
    # Every bucket gets the sources of its two tiles, and what holds for their language.
    sides = groups.select("lang", "source", "total").join(langs, "lang").withColumn("tile", mine).withColumn("_t", tile_of)
    sides = sides.select("lang", "_t.a", "_t.b", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"), "tile", "source", "total", "total_lang", "terms")

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        lang, a, b, number = (k.as_py() for k in key)
        terms, total_lang = right["terms"][0].as_py(), right["total_lang"][0].as_py()
        sides = []
        for t in dict.fromkeys((a, b)):
            side = right.filter(pc.equal(right["tile"], t)).sort_by("source")
            rows = left.filter(pc.equal(left["tile"], t))
            sides.append((side["source"].combine_chunks(), side["total"].to_numpy(), rows))
        found: list = []  # sources, parts, items, values
        if terms:
            words = pa.chunked_array([c for _, _, rows in sides for c in rows["term"].chunks] or [pa.array([], pa.string())], pa.string()).combine_chunks().unique()
            counts = [(pc.index_in(rows["term"], words).to_numpy().astype(np.int64), pc.index_in(rows["source"], names).to_numpy().astype(np.int64), rows["n"].to_numpy()) for names, _, rows in sides]
        first, second = sides[0], sides[-1]
        if len(first[0]) and len(second[0]):
            values = np.zeros((len(first[0]), len(second[0])), np.int64)
            if terms:
                values += _pair_sums(first[1], second[1], counts[0], counts[-1], terms)
                if number == 0:  # what two zero counts give, for all kept terms
                    zero = [_scaled(np.zeros(len(s[1]), np.int64), s[1], terms) for s in (first, second)]
                    values += terms * _apart(zero[0][:, None], zero[1][None, :])
            x, y = (i.ravel() for i in np.indices(values.shape))
            if a == b:
                x, y = x[x != y], y[x != y]
            flat = values[x, y]
            found.append((first[0].take(pa.array(x)), "pair", second[0].take(pa.array(y)), flat))
            if a != b:
                found.append((second[0].take(pa.array(y)), "pair", first[0].take(pa.array(x)), flat))
        if a == b and terms and len(counts[0][0]):
            names, total, rows = first
            _, at, n = counts[0]
            p = _scaled(n, total[at], terms)
            q = _scaled(rows["n_lang"].to_numpy(), np.full(len(n), total_lang), terms)
            best = pa.table({"source": rows["source"], "item": rows["term"], "value": _apart(p, q)}).filter(pa.array(p > q)).sort_by([("source", "ascending"), ("value", "descending"), ("item", "ascending")])
            if len(best):
                source = best["source"].combine_chunks()
                begin = np.flatnonzero(np.append(True, pc.not_equal(source.slice(1), source.slice(0, len(source) - 1)).to_numpy(zero_copy_only=False)))
                place = np.arange(len(source)) - np.repeat(begin, np.diff(np.append(begin, len(source))))
                best = best.filter(pa.array(place < top))
                found.append((best["source"].combine_chunks(), "term", best["item"].combine_chunks(), best["value"].to_numpy()))
        columns = {"lang": [], "source": [], "part": [], "item": [], "value": []}
        for source, part, item, value in found:
            for name, c in zip(columns, (pa.array([lang] * len(source), pa.string()), source, pa.array([part] * len(source), pa.string()), item, pa.array(value, pa.int64()))):
                columns[name].append(c)
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
        return pa.table({name: pa.chunked_array([x.cast(kind) for x in parts], kind) for (name, parts), kind in zip(columns.items(), kinds)})

    keys = ["lang", "a", "b", "bucket"]
    partial = runs.groupBy(*keys).cogroup(sides.groupBy(*keys)).applyInArrow(run, PARTS)
    summed = partial.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return summed.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE_SQL = {
    "op12_source_divergence": rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
w AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= {LEAST_DOCUMENTS}),
c AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
t AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY lang, source),
l AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY lang, term),
lt AS (SELECT lang, sum(n)::HUGEINT AS total FROM l GROUP BY lang),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * v.v) AS p
      FROM g JOIN kept k ON g.lang = k.lang JOIN v ON v.lang = g.lang LEFT JOIN t ON t.lang = g.lang AND t.source = g.source
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT l.lang, l.term, 1 + ({SCALE}::HUGEINT * (l.n + 2)) // (lt.total + 2 * v.v) AS q FROM l JOIN lt ON lt.lang = l.lang JOIN v ON v.lang = l.lang),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (((p.p - q.q) * (p.p - q.q)) // (p.p + q.q))::BIGINT AS value
      FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
parts AS (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM parts QUALIFY part = 'pair' OR rank <= {TOP}
"""
}
