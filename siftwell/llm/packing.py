"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Documents of one length can stand for each other, so a packing is a number of
bins for each pattern, a pattern being the lengths in a bin with how many there
are of each. A chromosome is such a table; it is as small for all documents of a
cluster as for a few, since there are only ``room`` lengths. Its genes are whole
bins. Crossover injects well-filled bins of one parent, leaves of the other's bins
those whose documents are still free, and puts what the removed bins displace by
best fit. Islands evolve in tasks of their own and hand their elites to the next
island between epochs.

The documents themselves are tokenised once, counted by length, and dealt to the
places of the best packing by their rank among those of their length. A rank is
the place within the task that made the piece and the number of such pieces in
the tasks before, so that no length, however frequent, comes together in one task.
"""

from __future__ import annotations

import json
import random
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import ByteBPE
from .common import narrow_batches, table, to_arrow, written

#: A vocabulary file of the tokenizers library, found under this path by every executor.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
ROOM, END = 2048, 0
ISLANDS, POPULATION, GENERATIONS, EPOCHS, ELITES = 6, 6, 12, 3, 2
#: Share of bins, the fullest first, that count as well filled.
WELL_FILLED = 0.7

_LOADED: dict[str, ByteBPE] = {}


# Packings: {pattern: bins}, a pattern being a sorted tuple of (length, copies).


def filled(pattern: tuple) -> int:
    return sum(length * copies for length, copies in pattern)


def _with(pattern: tuple, length: int, copies: int) -> tuple:
    for i, (other, n) in enumerate(pattern):
        if other == length:
            return (*pattern[:i], (length, n + copies), *pattern[i + 1 :])
    return tuple(sorted((*pattern, (length, copies))))


def best_fit(items: dict, packing: dict, room: int, order: list | None = None) -> dict:
    """packing with items ({length: number}) put one after the other into the fullest bin that takes them, longest first or in ``order``.

    Equal items go together: after one is put into a bin with a place for another, this bin is the fullest that takes the next.
    """
    out: dict = {}
    by_gap: dict = {}
    for pattern, bins in packing.items():
        by_gap.setdefault(room - filled(pattern), []).append((pattern, bins))
    gaps = sorted(by_gap)

    def put(gap: int, pattern: tuple, bins: int) -> None:
        if not gap:
            out[pattern] = out.get(pattern, 0) + bins
        elif gap in by_gap:
            by_gap[gap].append((pattern, bins))
        else:
            by_gap[gap] = [(pattern, bins)]
            insort(gaps, gap)

    for length in sorted(items, reverse=True) if order is None else order:
        n = items[length]
        while n:
            i = bisect_left(gaps, length)
            if i < len(gaps) and gaps[i]:
                gap = gaps[i]
                pattern, bins = by_gap[gap].pop()
                if not by_gap[gap]:
                    del by_gap[gap], gaps[i]
            else:
                gap, pattern, bins = room, (), n  # as many new bins as are needed
            copies = min(gap // length, n)
            used = min(bins, n // copies)
            n -= used * copies
            put(gap - copies * length, _with(pattern, length, copies), used)
            if pattern and bins > used:
                put(gap, pattern, bins - used)
    for kept in by_gap.values():
        for pattern, bins in kept:
            out[pattern] = out.get(pattern, 0) + bins
    return out


def fitness(packing: dict, room: int) -> tuple:
    """Fewer bins first, then more in the full ones; larger is better."""
    return -sum(packing.values()), sum(bins * filled(p) ** 2 for p, bins in packing.items())


def least_bins(counts: dict, room: int) -> int:
    """No packing has fewer bins: by all tokens, and by the items of over half a bin."""
    return max(-(-sum(length * n for length, n in counts.items()) // room), sum(n for length, n in counts.items() if 2 * length > room))


def crossover(one: dict, other: dict, counts: dict, room: int, rng: random.Random) -> dict:
    """A child of ``one`` with whole well-filled bins of ``other``."""
    fullest = sorted(other, key=filled, reverse=True)
    enough, seen = WELL_FILLED * sum(other.values()), 0
    child: dict = {}
    for pattern in fullest:
        if seen >= enough:
            break
        seen += other[pattern]
        if rng.random() < 0.5:
            child[pattern] = other[pattern]
    left = dict(counts)
    for pattern, bins in child.items():
        for length, copies in pattern:
            left[length] -= copies * bins
    # Bins of the first parent stay as far as all their documents are free; what else was in them is displaced.
    for pattern in sorted(one, key=filled, reverse=True):
        bins = min(one[pattern], *(left[length] // copies for length, copies in pattern))
        if bins:
            child[pattern] = child.get(pattern, 0) + bins
            for length, copies in pattern:
                left[length] -= copies * bins
    return best_fit({length: n for length, n in left.items() if n}, child, room)


def mutated(packing: dict, room: int, rng: random.Random) -> dict:
    """The packing with its emptiest bins and some others dissolved and packed again in a slightly other order."""
    gaps = sorted(packing, key=filled)
    gone, kept = {}, {}
    worst = set(gaps[: max(1, len(gaps) // 20)])
    for pattern, bins in packing.items():
        if pattern in worst or filled(pattern) < room and rng.random() < 0.2 or rng.random() < 0.03:
            for length, copies in pattern:
                gone[length] = gone.get(length, 0) + copies * bins
        else:
            kept[pattern] = bins
    spread = rng.choice((0.0, 0.02, 0.1))
    order = sorted(gone, key=lambda length: -length * (1 + spread * rng.random()))
    return best_fit(gone, kept, room, order)


def evolved(packings: list, counts: dict, room: int, seed: str, population: int = POPULATION, generations: int = GENERATIONS) -> list:
    """The population of an island after some generations, the best first; ``packings`` are its first members."""
    rng = random.Random(seed)
    least = least_bins(counts, room)
    while len(packings) < population:
        spread = 0.3 * rng.random() if packings else 0.0
        order = sorted(counts, key=lambda length: -length * (1 + spread * rng.random()))
        packings.append(best_fit(counts, {}, room, order))
    rank = lambda p: fitness(p, room)
    packings = sorted(packings, key=rank, reverse=True)[:population]
    for _ in range(generations):
        if -rank(packings[0])[0] == least:
            break
        children = []
        for _ in range(population):
            one, other = (min(rng.sample(range(len(packings)), min(2, len(packings)))) for _ in range(2))
            child = crossover(packings[one], packings[other], counts, room, rng) if one != other else packings[one]
            children.append(mutated(child, room, rng) if one == other or rng.random() < 0.5 else child)
        packings = sorted([*packings, *children], key=rank, reverse=True)[:population]
    return packings


def _said(packing: dict) -> str:
    return json.dumps([[list(map(list, p)), bins] for p, bins in sorted(packing.items())])


def _heard(said: str) -> dict:
    return {tuple((length, copies) for length, copies in p): bins for p, bins in json.loads(said)}


def _epoch(counts: dict, room: int, seed: str, population: int, generations: int):
    """What an island does with its rows (island, place, bins, packing) in an epoch."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        island = int(key[0])
        first = [_heard(s) for s in rows.sort_values(["bins", "place", "packing"])["packing"] if s]
        found = evolved(first, counts, room, f"{seed}/{island}", population, generations)
        return pd.DataFrame({"island": island, "place": range(len(found)), "bins": [sum(p.values()) for p in found], "packing": [_said(p) for p in found]})

    return run


def best_packing(spark: SparkSession, counts: dict, room: int = ROOM, islands: int = ISLANDS, epochs: int = EPOCHS, population: int = POPULATION, generations: int = GENERATIONS, seed: int = 7) -> dict:
    """The best packing of {length: number} that the islands found.

    Every island is a task; between epochs its population is a row for each member in a table, and the
    elites of an island stand there once more for the next one. A task that is lost begins its epoch again with the same seed.
    """
    if not counts:
        return {}
    state = "island int, place int, bins long, packing string"
    least = least_bins(counts, room)
    members = spark.createDataFrame([(i, 0, 0, "") for i in range(islands)], state)
    for epoch in range(epochs):
        evolve = _epoch(counts, room, f"{seed}/{epoch}", population, generations)
        members = written(members.repartition(islands, "island").groupBy("island").applyInPandas(evolve, state), "islands")
        if members.agg(F.min("bins")).first()[0] == least:
            break
        elites = members.where(F.col("place") < ELITES).withColumn("island", (F.col("island") + 1) % islands)
        members, kept = members.unionByName(elites), members
    else:
        members = kept
    best = members.orderBy("bins", "island", "place").select("packing").first()
    return _heard(best[0])


def _ids_of(texts: list, path: str):
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path].ids(texts)


def pieces(docs: DataFrame, room: int = ROOM, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, nth) and, if asked for, ids: the pieces of each document's tokens and its end.

    Only documents of more than ``room`` tokens are cut, so that all pieces but the first are full.
    task and nth: which task made the piece, as how many-th of its length. Write the table before it is used twice.
    """
    kind = docs.schema["doc_id"].dataType
    fields = [T.StructField("doc_id", kind), T.StructField("piece", T.IntegerType(), False), *(T.StructField(n, T.LongType(), False) for n in ("start", "length", "ids_crc32", "task", "nth"))]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType(), False), False))
    names, id_type = [f.name for f in fields], to_arrow(kind)

    def run(batches):
        task, seen = TaskContext.get().partitionId(), [0] * (room + 1)
        for batch in narrow_batches(batches, 8 << 20):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            of, cut, start, size, crc, nth, kept = [], [], [], [], [], [], []
            for i, ids in _ids_of(texts, vocabulary):
                n = len(ids) + 1
                all_ids = np.empty(n, "<u4")
                all_ids[:-1], all_ids[-1] = ids, END
                at, to, k = 0, n % room or room if n > room else n, 0
                while at < n:
                    of.append(i), cut.append(k), start.append(at), size.append(to - at)
                    crc.append(zlib.crc32(all_ids[at:to]))
                    nth.append(seen[to - at])
                    seen[to - at] += 1
                    if with_ids:
                        kept.append(all_ids[at:to].astype(np.int64))
                    at, to, k = to, to + room, k + 1
            columns = [batch.column(0).take(pa.array(of, pa.int64())).cast(id_type), pa.array(cut, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, size, crc, [task] * len(of), nth))]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(kept, pa.list_(pa.int64()))] if with_ids else [])], names)

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType(fields))


def _places(packing: dict) -> tuple[np.ndarray, ...]:
    """For lookup by length and rank: the first rank of each run of places, its copies a bin, its first bin, and where in the bin it begins."""
    keys, copies, first, begin = [], [], [], []
    ranks: dict = {}
    bins = 0
    for pattern, n in sorted(packing.items()):
        at = 0
        for length, k in pattern:
            keys.append((length << 44) + ranks.get(length, 0))
            copies.append(k), first.append(bins), begin.append(at)
            ranks[length] = ranks.get(length, 0) + k * n
            at += length * k
        bins += n
    order = np.argsort(np.array(keys, np.int64))
    return tuple(np.array(x, np.int64)[order] for x in (keys, copies, first, begin))


def packed(docs: DataFrame, room: int = ROOM, vocabulary: str = VOCABULARY, with_ids: bool = False, **evolution) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of docs (doc_id, text, ..), and ids if asked for.

    A null or empty text is its end alone, one token. Rows are packed each for itself, repeated ones
    too; doc_id may be null and of any type. Other columns aren't looked at. A table without rows gives none.
    """
    spark = docs.sparkSession
    made = written(pieces(docs, room, vocabulary, with_ids), "pieces")
    by_task = made.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    by_task = written(by_task.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))), "lengths")
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most room of them
    keys, copies, first, begin = _places(best_packing(spark, counts, room, **evolution))

    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    ranked = made.join(by_task.drop("n"), ["length", "task"]).select(*kept, (F.col("before") + F.col("nth")).alias("sequence_id"))
    names = [*kept, "sequence_id", "offset"]
    schema = T.StructType([*ranked.schema.fields, T.StructField("offset", T.LongType())])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(names.index(c)).to_numpy() for c in ("length", "sequence_id"))
            at = np.searchsorted(keys, (length << 44) + rank, side="right") - 1
            within = (length << 44) + rank - keys[at]
            sequence, place = first[at] + within // copies[at], begin[at] + within % copies[at] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(place)], names)

    return ranked.mapInArrow(run, schema)


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token ids of each sequence of ``packed(.., with_ids=True)``, which no sequence has more of than the room."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return placed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
