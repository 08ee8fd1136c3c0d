"""SimHash near-dedup: fingerprints of word shingles, joined by traversing binary tries in pairs.

Fingerprints that differ in at most E bits agree wholly in ``exact`` of
E + ``exact`` blocks of bits. Each choice of blocks orders the bits anew, with
the chosen blocks on top: one trie per choice, whose first levels allow no
difference. The nodes below those levels are dealt to tasks, and in each a trie
is joined with itself: pairs of nodes go down together, the differing bits add
up, and a pair ends where they exceed E.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import narrow_batches, partitions, small, table, with_hash, written
from .components import components

ERRORS = 4
SHINGLE = 4
SEED = 42
#: Fingerprints of a top node that one task joins; larger nodes are joined part by part.
PART = 512


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits, as a signed integer; without words 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))
    stops = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    sums, step = np.zeros(64, np.int64), 1 << 14
    hashes = [digest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), stops)]
    for at in range(0, n, step):
        bits = np.unpackbits(np.array(hashes[at : at + step], dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        sums += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * sums > n).view(">i8")[0])


def fingerprints(docs: DataFrame, **how) -> DataFrame:
    """docs with fp in place of text, its last column; a null text has no words."""
    keys = docs.columns[:-1]

    def run(batches):
        for batch in narrow_batches(batches):
            texts = batch.column(len(keys)).cast(pa.large_binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array([fingerprint(t or b"", **how) for t in texts], pa.int64())], [*keys, "fp"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields[: len(keys)], T.StructField("fp", T.LongType())]))


def trie_pairs(keys: np.ndarray, groups: np.ndarray, sides: np.ndarray, depth: int, errors: int, block: int = 1 << 19):
    """Index pairs of keys within ``errors`` differing bits, in each group.

    keys (unsigned, distinct within a group and side) must be sorted by group,
    side and key. A group with side 0 alone is joined with itself, one with
    sides 0 and 1 only across. All keys of a group share their first ``depth`` bits.
    """
    if not len(keys):
        return
    edge = np.flatnonzero(np.concatenate(([True], (groups[1:] != groups[:-1]) | (sides[1:] != sides[:-1]), [True])))
    lo, hi = edge[:-1], edge[1:]
    own, side = groups[lo], sides[lo]
    cross = np.flatnonzero((own[1:] == own[:-1]) & (side[1:] == 1)) if len(lo) > 1 else np.zeros(0, np.int64)
    alone = np.setdiff1d(np.flatnonzero(side == 0), cross)
    first = np.concatenate((alone, cross))
    second = np.concatenate((alone, cross + 1))
    stack = [(lo[first], hi[first], lo[second], hi[second], np.zeros(len(first), np.int64), depth)]

    def halves(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
        """Where the second child begins in the node [a, b)."""
        left, right, bit = a.copy(), b.copy(), np.uint64(63 - level)
        while True:
            open_ = left < right
            if not open_.any():
                return left
            mid = (left + right) >> 1
            one = (keys[np.minimum(mid, len(keys) - 1)] >> bit & np.uint64(1)).astype(bool)
            right = np.where(open_ & one, mid, right)
            left = np.where(open_ & ~one, mid + 1, left)

    while stack:
        a, b, c, d, used, level = stack.pop()
        same = a == c
        pairs = np.where(same, (b - a) * (b - a - 1) // 2, (b - a) * (d - c))
        live = pairs > 0
        ready = live & ((pairs <= 24) | (level == 64))
        if ready.any():  # small nodes: their keys are compared directly
            ra, rc, rn, rs = a[ready], c[ready], (d - c)[ready], same[ready]
            size = (b - a)[ready] * rn
            for at in range(0, len(ra), block >> 4):
                cut = slice(at, at + (block >> 4))
                which = np.repeat(np.arange(len(ra))[cut], size[cut])
                begin = np.cumsum(size[cut]) - size[cut]
                within = np.arange(len(which)) - np.repeat(begin, size[cut])
                i, j = ra[which] + within // rn[which], rc[which] + within % rn[which]
                keep = ~rs[which] | (i < j)
                i, j = i[keep], j[keep]
                close = np.bitwise_count(keys[i] ^ keys[j]) <= errors
                if close.any():
                    yield i[close], j[close]
        live &= ~ready
        if not live.any():
            continue
        a, b, c, d, used, same = a[live], b[live], c[live], d[live], used[live], same[live]
        m, n = halves(a, b, level), halves(c, d, level)
        more = used < errors
        apart = more & ~same
        nxt = [
            np.concatenate((a, m, a[more], m[apart])),
            np.concatenate((m, b, m[more], b[apart])),
            np.concatenate((c, n, n[more], c[apart])),
            np.concatenate((n, d, d[more], n[apart])),
            np.concatenate((used, used, used[more] + 1, used[apart] + 1)),
        ]
        keep = (nxt[0] < nxt[1]) & (nxt[2] < nxt[3])
        nxt = [x[keep] for x in nxt]
        for at in range(0, len(nxt[0]), block):
            stack.append((*(x[at : at + block] for x in nxt), level + 1))


class _Forest:
    """Union-find over positions; keeps the pairs that join two trees."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        up = self.up
        while True:
            a, b = up[i], up[j]
            apart = a != b
            if not apart.any():
                return
            i, j = i[apart], j[apart]
            a, b = a[apart], b[apart]
            np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
            while (up != up[up]).any():
                up[:] = up[up]


def exact_blocks(count: int, errors: int = ERRORS, part: int = PART) -> int:
    """How many blocks to put on top, so that nodes of ``count`` evenly spread fingerprints have about ``part`` at most.

    With one there are 5 tries with tops of 12 or 13 bits, with two 15 and 20 bits, with three 35 and 27 bits.
    """
    exact = 1
    while exact < 4 and count > part << (64 * exact // (errors + exact)):
        exact += 1
    return exact


def links(fps: DataFrame, errors: int = ERRORS, exact: int = 1, part: int = PART) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (fp), enough to join all within ``errors`` bits.

    A task passes on a star for each component it finds, no more edges than
    fingerprints, so a group of close copies never yields its pairs.
    ``exact`` is the number of agreeing blocks on top of a trie, see exact_blocks; results don't depend on it.
    Nodes of more than ``part`` fingerprints are cut in parts by hash and every
    pair of parts is a task's share: none is dropped.
    """
    spark = fps.sparkSession
    blocks = errors + exact
    cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
    choices = list(combinations(range(blocks), exact))

    def arranged(keys: np.ndarray, chosen) -> tuple[np.ndarray, int]:
        """The bits with the chosen blocks on top, and the number of top bits."""
        out = np.zeros_like(keys)
        for k in (*chosen, *(x for x in range(blocks) if x not in chosen)):
            width = cuts[k + 1] - cuts[k]
            out = out << np.uint64(width) | (keys >> np.uint64(64 - cuts[k + 1]) & np.uint64((1 << width) - 1))
        return out, sum(cuts[k + 1] - cuts[k] for k in chosen)

    def deal(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for t, chosen in enumerate(choices):
                out, top = arranged(keys, chosen)
                node = (out >> np.uint64(64 - top)).astype(np.int64) * len(choices) + t
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(out.view(np.int64)), pa.array(node)], ["fp", "key", "node"])

    dealt = fps.select("fp").mapInArrow(deal, "fp long, key long, node long")
    sizes = dealt.groupBy("node").count().where(F.col("count") > 1)
    sizes = small(written(sizes.select("node", F.ceil(F.col("count") / part).cast("int").alias("parts")), "nodes"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    shares = (
        dealt.join(sizes, "node")
        .select("fp", "key", "node", own.alias("own"), other)
        .select("fp", "key", "node", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    )
    shares = shares.repartition(partitions(spark), "node", "p", "q").sortWithinPartitions("node", "p", "q", "side", "key")
    tops = [arranged(np.zeros(1, np.uint64), c)[1] for c in choices]

    def join(batches):
        def settled(rows: pa.Table):
            column = lambda c: rows[c].to_numpy()
            fp, key, node, p, q, side = (column(c) for c in ("fp", "key", "node", "p", "q", "side"))
            key = key.view(np.uint64)
            new = (node[1:] != node[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])
            group = np.concatenate(([0], np.cumsum(new)))
            order = np.lexsort((key, side, group))
            fp, key, group, side = fp[order], key[order], group[order], side[order]
            forest = _Forest(len(fp))
            for i, j in trie_pairs(key, group, side, min(tops), errors):
                forest.add(i, j)
            moved = np.flatnonzero(forest.up != np.arange(len(fp)))
            return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[forest.up[moved]])], ["a", "b"])

        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n >= 1 << 18:
                rows = pa.Table.from_batches(held)
                node, p, q = (rows[c].to_numpy() for c in ("node", "p", "q"))
                last = np.flatnonzero((node != node[-1]) | (p != p[-1]) | (q != q[-1]))
                whole = int(last[-1]) + 1 if len(last) else 0
                if whole:
                    yield settled(rows.slice(0, whole))
                    held, n = rows.slice(whole).to_batches(), rows.num_rows - whole
        if held:
            yield settled(pa.Table.from_batches(held))

    return shares.mapInArrow(join, "a long, b long")


def near_components(docs: DataFrame, errors: int = ERRORS, **how) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs (doc_id, text).

    component_id is the smallest doc_id that links of at most ``errors`` bits
    reach. Rows with a null text or no words share the fingerprint 0 and link
    like others. Repeated rows come back as often as they stand there; a null
    doc_id never is a component_id unless all ids of its component are null.
    """
    return _rooted(docs.select("doc_id", "text"), errors, **how).select("doc_id", "fp", "component_id")


def _rooted(docs: DataFrame, errors: int = ERRORS, **how) -> DataFrame:
    """docs with fp, root and component_id in place of text, its last column; root tells components apart."""
    prints = written(fingerprints(docs, **how), "fingerprints")
    firsts = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "prints")
    roots = components(links(firsts, errors, exact_blocks(firsts.count(), errors)))
    joined = firsts.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    named = joined.join(small(written(least, "components")), "root", "left").select("fp", "root", F.coalesce("component_id", "first").alias("component_id"))
    return prints.join(named, "fp").select(*prints.columns, "root", "component_id")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, **how) -> DataFrame:
    """One row of docs for each component: one whose doc_id is the component's smallest.

    A doc_id may stand with several texts: each row is judged by its own text, and of
    the first id's texts in one component the one with the smallest hash stays.
    Rows with a null doc_id stay: nothing tells which of them is first.
    """
    found = written(_rooted(with_hash(docs), **how).drop("fp"), "components")
    firsts = found.where("doc_id = component_id")
    several = firsts.groupBy("root").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"), F.min("th").alias("th")).where("n > 1")
    several = written(several.select("root", "doc_id", "th"), "several")
    others = firsts.join(small(several.select("root", F.col("th").alias("least"))), "root").where("th <> least")
    later = written(found.where("doc_id <> component_id").select("doc_id", "th").union(others.select("doc_id", "th")).distinct(), "later")

    def among(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = small(keys.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")))
        return rows.join(keys, (rows["doc_id"] == keys["_id"]) & (F.coalesce(F.xxhash64(rows["text"]), F.lit(0)) == keys["_th"]), how)

    kept = among(docs, later, "left_anti")
    if several.isEmpty():
        return kept
    again = among(kept, several, "left_semi").select(F.struct("*").alias("row"), "doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("th"))
    return among(kept, several, "left_anti").union(again.dropDuplicates(["doc_id", "th"]).select("row.*"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id; see first_of_each for nulls and repeated ids.

    Texts that are null or have no words are copies of each other. All columns, of any name, stay; an empty table stays empty.
    """
    return first_of_each(docs)
