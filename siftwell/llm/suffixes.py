"""Suffix-array dedup: bytes covered by a string of 200 bytes that also starts elsewhere.

A sparse suffix array is enough. Of the positions in a string of 200 bytes, the
one whose next 32 bytes hash lowest (the last of equals) is its anchor; equal
strings have equal anchors at equal offsets. So only suffixes at anchors are
sorted, about one in 85.

1. Anchors whose 32 bytes occur once are dropped (duplicate detection by
   fingerprints before sorting, as in distributed prefix doubling). Anchors
   whose whole surroundings occur again are repeated as they stand; one stands
   for all of them from here on.
2. Tasks sort the suffixes at the other anchors, and send them as front-coded
   runs: each with the length of the prefix it shares with the one before, and
   the rest.
3. Each receiver merges its runs by a loser tree that keeps the common prefix
   of every loser with its winner and compares only what lies beyond it. The
   merged order comes with its array of common prefixes: suffixes that share
   200 - o bytes to the right, and o to the left, are equal strings at offset o.

A fingerprint with very many different surroundings is not sorted in one task:
the strings around its anchors are counted by their hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, LIST_BYTES, byte_chunks, listed, narrow_batches, packed, partitions, small, table, to_arrow, unpacked, with_hash, written
from .quality import _powers

LENGTH = 200
GRAM = 32
#: Anchors with one fingerprint that are merged in one task.
GROUP = 4096
#: Copies of one surrounding that one task may look up.
COPIES = 1 << 12
PIECE = 1 << 23
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Anchors:
    """The anchors of texts, each with the run of string starts that it is the anchor of."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM) -> None:
        self.length, self.gram = length, gram
        self.up, self.down = _powers(1 << 21)

    def of(self, ends: np.ndarray, data: np.ndarray):
        """(row, first start, anchor - first start, number of starts, fingerprint) arrays for texts laid end to end."""
        found = []
        for a in range(0, max(1, len(data) - self.length + 1), PIECE):
            piece = data[a : a + PIECE + self.length - 1]
            found.append(self._piece(ends, piece, a))
        return [np.concatenate(x) for x in zip(*found)]

    def _piece(self, ends: np.ndarray, data: np.ndarray, at: int):
        n, k, width = len(data), self.gram, self.length - self.gram + 1
        starts = n - self.length + 1
        if starts <= 0:
            return [np.zeros(0, np.int64)] * 5
        if n >= len(self.up):
            self.up, self.down = _powers(2 * n)
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n])))
            prints = (sums[k:] - sums[:-k]) * self.down[: n - k + 1]
            prints ^= prints >> np.uint64(31)
            prints *= _MIX
            prints ^= prints >> np.uint64(29)
        grams = len(prints)
        keys = prints & ~np.uint64((1 << 24) - 1) | (np.uint64((1 << 24) - 1) - np.arange(grams, dtype=np.uint64))
        padded = np.full(-(-grams // width) * width, np.iinfo(np.uint64).max)
        padded[:grams] = keys
        blocks = padded.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts])
        anchor = (np.uint64((1 << 24) - 1) - (least & np.uint64((1 << 24) - 1))).astype(np.int64)
        places = np.arange(at, at + starts)
        row = np.searchsorted(ends, places, side="right") - 1
        valid = places + self.length <= ends[np.minimum(row + 1, len(ends) - 1)]
        new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]))) | ~valid
        runs = np.flatnonzero(new & valid)
        border = np.append(np.flatnonzero(new | ~valid), starts)
        count = border[np.searchsorted(border, runs, side="right")] - runs
        r = row[runs]
        return r, places[runs] - ends[r], anchor[runs] - runs, count, prints[anchor[runs]].view(np.int64)


def _id_field(docs: DataFrame) -> T.StructField:
    return T.StructField("doc_id", docs.schema["doc_id"].dataType)


def anchors(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, th, lo, off, n, h, f): f is a hash of all strings of the run."""

    def run(batches):
        found = Anchors(length, gram)
        digest = xxhash.xxh3_64_intdigest
        for batch in narrow_batches(batches):
            ids, hashes = batch.column(0), batch.column(1)
            for at, ends, data in byte_chunks(batch.column(2)):
                row, lo, off, n, h = found.of(ends, data)
                if not len(row):
                    continue
                view = memoryview(data)
                a = (ends[row] + lo).tolist()
                b = (ends[row] + lo + n + (length - 1)).tolist()
                f = np.array([digest(view[x:y], s) for x, y, s in zip(a, b, (off * 1024 + n).tolist())], np.uint64).view(np.int64)
                rows = pa.array(row + at)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(rows), hashes.take(rows), pa.array(lo.astype(np.int32)), pa.array(off.astype(np.int16)), pa.array(n.astype(np.int16)), pa.array(h), pa.array(f)],
                    ["doc_id", "th", "lo", "off", "n", "h", "f"],
                )

    schema = T.StructType([_id_field(docs), *T.StructType.fromDDL("th long, lo int, off short, n short, h long, f long")])
    return with_hash(docs).mapInArrow(run, schema)


def common_prefix(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of a and b, which share their first ``at`` bytes."""
    n = min(len(a), len(b))
    while at < n:
        step = min(64, n - at)
        x, y = a[at : at + step], b[at : at + step]
        if x != y:
            differ = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
            return at + step - (differ.bit_length() + 7) // 8
        at += step
    return n


def front_coded(keys: list[bytes]) -> tuple[list[int], bytes]:
    """Shared lengths of sorted keys, and the rests laid end to end."""
    shared, rests, last = [], [], b""
    for key in keys:
        n = common_prefix(last, key, 0)
        shared.append(n)
        rests.append(key[n:])
        last = key
    return shared, b"".join(rests)


def merge_runs(runs: list):
    """Merges iterators of (key, common prefix with the run's last key, item) by a loser tree.

    Yields (key, common prefix with the last key, item). A node keeps the loser
    of a match and how much it shares with the winner. The next key from a run
    is known to share so much with the last winner; the one that shares more
    with it is the smaller, and only on equality are keys compared, beyond what
    they share.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads: list = [next(r, None) for r in runs] + [None] * (k - len(runs))
    tree: list = [None] * k
    shared = [0] * k

    def play(x: int, lx: int, node: int) -> tuple[int, int]:
        """The match of run x, sharing lx with the last winner, against the loser at node."""
        y = tree[node]
        hx, hy, ly = heads[x], heads[y], shared[node]
        if hy is None:
            return x, lx
        if hx is None or ly > lx:
            tree[node], shared[node] = x, lx
            return y, ly
        if lx > ly:
            return x, lx
        n = common_prefix(hx[0], hy[0], lx)
        if hx[0][n:] <= hy[0][n:]:
            shared[node] = n
            return x, lx
        tree[node], shared[node] = x, n
        return y, ly

    def build(node: int) -> tuple[int, int]:
        if node >= k:
            return node - k, 0
        (x, lx), (y, ly) = build(2 * node), build(2 * node + 1)
        tree[node], shared[node] = y, ly
        return play(x, lx, node)

    x, lx = build(1)
    while heads[x] is not None:
        key, _, item = heads[x]
        yield key, lx, item
        heads[x] = following = next(runs[x], None)
        lx = following[1] if following is not None else 0
        node = (x + k) // 2
        while node:
            x, lx = play(x, lx, node)
            node //= 2


def equal_strings(keys_shared: np.ndarray, lefts: list[bytes], off: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """Which strings occur twice: a row for each suffix in sorted order, a column for each offset.

    keys_shared: bytes shared with the suffix before; lefts: what precedes the anchor, reversed.
    """
    count, widest = len(lefts), int(off.max()) + 1
    order = np.array(sorted(range(count), key=lefts.__getitem__))
    sizes = np.array([len(x) for x in lefts])
    table_ = np.zeros((count, widest), np.uint8)
    for i, x in enumerate(lefts):
        table_[i, : len(x)] = np.frombuffer(x, np.uint8)
    differs = table_[order[1:]] != table_[order[:-1]]
    reach = np.where(differs.any(axis=1), differs.argmax(axis=1), widest) if count > 1 else np.zeros(0, int)
    shared_left = np.concatenate(([-1], np.minimum(reach, np.minimum(sizes[order[1:]], sizes[order[:-1]]))))
    found = np.zeros((count, widest), bool)
    for o in range(widest):
        rows = np.flatnonzero((off >= o) & (off - n < o))
        if len(rows) < 2:
            continue
        right = np.cumsum(keys_shared < length - o)
        left = np.empty(count, np.int64)
        left[order] = np.cumsum(shared_left < o)
        key = right[rows] * (count + 1) + left[rows]
        by = np.argsort(key, kind="stable")
        same = key[by[1:]] == key[by[:-1]]
        twice = np.concatenate((same, [False])) | np.concatenate(([False], same))
        found[rows[by[twice]], o] = True
    return found


def _start_runs(found: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs of starts q - o for which found[row, o]."""
    padded = np.zeros((len(found), found.shape[1] + 2), np.int8)
    padded[:, 1:-1] = found
    change = np.diff(padded, axis=1)
    row, a = np.nonzero(change == 1)
    _, b = np.nonzero(change == -1)
    return row, q[row] - (b - 1), q[row] - a


def repeated_starts(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(doc_id, th, a, b): runs a..b of string starts that are repeated."""
    spark = docs.sparkSession
    parts = partitions(spark)
    known = written(anchors(docs, length, gram), "anchors")
    # Written on its own: the join then has exchanges of its own, which Spark can split where a fingerprint is hot.
    again = written(known.groupBy("h").count().where("count > 1").select("h"), "prints")
    met = written(known.join(again, "h"), "met")
    one = F.min(F.struct("doc_id", "th", "lo", "off", "n")).alias("one")
    kinds = written(met.groupBy("h", "f").agg(F.count("*").alias("copies"), one), "kinds")
    # Surroundings with very many copies are few, and are found by a broadcast; the others by a join.
    often = max(COPIES, met.count() // BROADCAST_ROWS)
    frequent = F.broadcast(kinds.where(F.col("copies") > often).select("h", "f"))  # at most BROADCAST_ROWS rows
    whole = small(written(kinds.where(F.col("copies").between(2, often)).select("h", "f"), "whole"))
    copied = met.join(frequent, ["h", "f"], "left_semi").union(met.join(frequent, ["h", "f"], "left_anti").join(whole, ["h", "f"], "left_semi"))
    copied = copied.select("doc_id", "th", F.col("lo").alias("a"), (F.col("lo") + F.col("n") - 1).alias("b"))

    mixed = kinds.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1")
    chosen = written(kinds.join(mixed, "h").select("one.*", "h", (F.col("kinds") > group).alias("hot")), "chosen")

    id_type = _id_field(docs)
    id_arrow = to_arrow(id_type.dataType)
    run_schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("ids", T.ArrayType(id_type.dataType)), T.StructField("numbers", T.BinaryType()), T.StructField("rests", T.BinaryType()), T.StructField("lefts", T.BinaryType())])

    def send(batches):
        """Sorted runs of suffixes, cut where the receivers' ranges of fingerprints end."""
        held: list = []
        held_bytes = 0

        def runs():
            held.sort(key=lambda e: e[0])
            part = [(int.from_bytes(e[0][:8], "big") * parts) >> 64 for e in held]
            at = 0
            while at < len(held):
                to = at
                while to < len(held) and part[to] == part[at]:
                    to += 1
                piece = held[at:to]
                shared, rests = front_coded([e[0] for e in piece])
                numbers = np.array([[s, len(e[0]), len(e[1]), *e[3]] for s, e in zip(shared, piece)], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part[at]], pa.int32()), pa.array([[e[2] for e in piece]], pa.list_(id_arrow)), pa.array([numbers.tobytes()], pa.binary()), pa.array([rests], pa.binary()), pa.array([b"".join(e[1] for e in piece)], pa.binary())],
                    run_schema.names,
                )
                at = to

        for batch in narrow_batches(batches):
            texts = batch.column(2).cast(pa.large_binary())
            for i, (id_, th, blob) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist())):
                text = texts[i].as_py() or b""
                for lo, off, n, h in unpacked(blob, 4).tolist():
                    q = lo + off
                    key = (h & (1 << 64) - 1).to_bytes(8, "big") + text[q : lo + n - 1 + length]
                    held.append((key, text[lo:q][::-1], id_, (th, lo, off, n)))
                    held_bytes += len(key) + off + 200
            if held_bytes > 24 << 20:
                yield from runs()
                held, held_bytes = [], 0
        yield from runs()

    found_schema = T.StructType([id_type, *T.StructType.fromDDL("th long, a int, b int")])

    def receive(batches):
        by_part: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                by_part.setdefault(row["part"], []).append(row)

        def decoded(row):
            numbers = np.frombuffer(row["numbers"], np.int64).reshape(-1, 7).tolist()
            rests, lefts, last, r, l = row["rests"], row["lefts"], b"", 0, 0
            for id_, (shared, size, left, *item) in zip(row["ids"], numbers):
                last = last[:shared] + rests[r : r + size - shared]
                r += size - shared
                yield last, shared, (id_, lefts[l : l + left], item)
                l += left

        for rows in by_part.values():
            ids, lefts, items, shared, last = [], [], [], [], None
            for key, common, (id_, left, item) in merge_runs([decoded(r) for r in rows]):
                if len(ids) >= 1 << 15 and key[:8] != last:  # no string spans two fingerprints
                    yield from judged(ids, lefts, items, shared)
                    ids, lefts, items, shared = [], [], [], []
                ids.append(id_)
                lefts.append(left)
                items.append(item)
                shared.append(max(0, common - 8))
                last = key[:8]
            yield from judged(ids, lefts, items, shared)

    def judged(ids, lefts, items, shared):
        if not ids:
            return
        th, lo, off, n = np.array(items, np.int64).T
        found = equal_strings(np.array(shared), lefts, off, n, length)
        row, a, b = _start_runs(found, lo + off)
        yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in row.tolist()], id_arrow), pa.array(th[row]), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], found_schema.names)

    lists = written(packed(chosen.where("NOT hot"), "lo", "off", "n", "h"), "lists")
    sent = listed(docs, lists, broadcast_bytes=LIST_BYTES).mapInArrow(send, run_schema)
    merged = sent.repartitionById(parts, F.col("part")).mapInArrow(receive, found_schema)
    out = copied.union(merged)

    hot = written(packed(chosen.where("hot"), "lo", "off", "n", "h"), "hot")
    if hot.isEmpty():
        return out

    def spell(batches):
        for batch in narrow_batches(batches):
            texts = batch.column(2).cast(pa.large_binary())
            for i, blob in enumerate(batch.column(3).to_pylist()):
                text = texts[i].as_py() or b""
                starts = np.concatenate([np.arange(lo, lo + n) for lo, _, n, _ in unpacked(blob, 4).tolist()])
                prints = np.array([xxhash.xxh3_128_intdigest(text[s : s + length]).to_bytes(16, "big") for s in starts.tolist()])
                rows = pa.array(np.full(len(starts), i))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(starts.astype(np.int32)), pa.array([bytes(p).ljust(16, b"\0") for p in prints], pa.binary())], ["doc_id", "th", "a", "w"])

    spelled = written(listed(docs, hot).mapInArrow(spell, T.StructType([id_type, *T.StructType.fromDDL("th long, a int, w binary")])), "spelled")
    twice = spelled.groupBy("w").count().where("count > 1").select("w")
    return out.union(spelled.join(twice, "w", "left_semi").select("doc_id", "th", "a", F.col("a").alias("b")))


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept, spans) for each row of docs (doc_id, text).

    kept: the bytes that stay; spans: [begin, end) pairs of what goes. A null
    text is empty. Texts shorter than ``length`` stay whole. Equal rows are
    copies of each other, whatever their doc_id. Other columns, of any name, aren't
    looked at; a table without rows gives none.
    """
    runs = written(repeated_starts(docs, length, gram, group), "repeated")
    lists = written(packed(runs, "a", "b"), "spans")
    id_type = _id_field(docs)
    schema = T.StructType([id_type, *T.StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept binary, spans array<long>")])

    def cut(batches):
        for batch in narrow_batches(batches):
            texts, out = batch.column(2).cast(pa.large_binary()), []
            for i, blob in enumerate(batch.column(3).to_pylist()):
                text = texts[i].as_py() or b""
                spans, kept, last = [], [], 0
                if blob:
                    runs_ = unpacked(blob, 2)
                    for a, b in runs_[np.argsort(runs_[:, 0], kind="stable")].tolist():
                        if spans and a <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], b + length)
                        else:
                            spans.append([a, b + length])
                for a, b in spans:
                    kept.append(text[last:a])
                    last = b
                kept.append(text[last:])
                out.append((len(text), sum(b - a for a, b in spans), len(spans), b"".join(kept), [x for s in spans for x in s]))
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds))], schema.names)

    return listed(docs, lists, "left").mapInArrow(cut, schema)


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
