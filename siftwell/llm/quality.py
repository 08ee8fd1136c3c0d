"""Quality classifier: naive Bayes support vectors (Wang and Manning, 2012).

Indicators of hashed n-grams are scaled by the log ratio of their class counts,
and a linear hinge-loss model is fitted to them by dual coordinate descent
(Hsieh et al., 2008). The n-grams: bytes in threes, words in ones and twos, and
word shapes in threes (letter case, marks that follow, same as the word before).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_chunks, narrow_batches, small, table, written

BITS = 18
SIZE = 1 << BITS
#: Most labelled texts of a class that the hinge-loss model is fitted to; the
#: class counts behind the ratios are taken from all labelled texts.
FIT_ROWS = 4000
SLOTS = 16

_P = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        up, down = np.full(n, _P, np.uint64), np.full(n, inverse, np.uint64)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _class_table() -> np.ndarray:
    """Per byte: 0 space, 1 lower, 2 upper, 3 digit, 4 mark, 5 beyond ASCII."""
    kinds = np.full(256, 4, np.uint8)
    kinds[128:] = 5
    for chars, kind in ((b" \t\n\v\f\r", 0), (bytes(range(97, 123)), 1), (bytes(range(65, 91)), 2), (b"0123456789", 3)):
        kinds[list(chars)] = kind
    return kinds


_KINDS = _class_table()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Features:
    """Hashed n-gram indicators of whole texts."""

    def __init__(self) -> None:
        self.up, self.down = _powers(1 << 21)
        self.seen = np.zeros(SIZE, bool)

    def texts(self, column: pa.Array):
        """A sorted array of feature numbers for each row."""
        for _, ends, data in byte_chunks(column):
            yield from self._chunk(ends, data)

    def _chunk(self, ends: np.ndarray, data: np.ndarray):
        n = len(data)
        if n >= len(self.up):
            self.up, self.down = _powers(2 * n)
        with np.errstate(over="ignore"):
            wide = data.astype(np.uint32)
            threes = (((wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int32) if n > 2 else np.zeros(0, np.int32)
            kinds = _KINDS[data]
            solid = np.concatenate(([0], (kinds != 0).astype(np.int8), [0]))
            cut = np.zeros(n + 1, bool)
            cut[ends] = True  # a word ends where its text ends
            starts = np.flatnonzero((solid[1:] == 1) & ((solid[:-1] == 0) | cut))
            stops = np.flatnonzero((solid[:-1] == 1) & ((solid[1:] == 0) | cut))
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * self.up[:n])))
            words = (sums[stops] - sums[starts]) * self.down[starts]
            words ^= words >> np.uint64(29)
            words *= _MIX
            same = np.concatenate(([False], words[1:] == words[:-1])) if len(words) else np.zeros(0, bool)
            counts = [np.concatenate(([0], np.cumsum(kinds == k)))[[starts, stops]] for k in (2, 3, 4)] if len(words) else []
            upper, digit, mark = (np.minimum(c[1] - c[0], 3) for c in counts) if len(words) else (np.zeros(0, int),) * 3
            long = stops - starts
            shape = (np.where(upper == 0, 0, np.where(upper * 2 > long, 3, np.minimum(upper, 2))) * 64 + (digit > 0) * 32 + mark * 4 + same * 2 + (long > 12)).astype(np.uint64)
            ones = ((words * _MIX) >> np.uint64(64 - BITS)).astype(np.int32)
            twos = (((words[:-1] * _P + words[1:]) * _MIX) >> np.uint64(64 - BITS)).astype(np.int32) if len(words) > 1 else np.zeros(0, np.int32)
            shapes = (((shape[:-2] << np.uint64(32) | shape[1:-1] << np.uint64(16) | shape[2:]) * _MIX) >> np.uint64(64 - BITS)).astype(np.int32) if len(words) > 2 else np.zeros(0, np.int32)
        at = np.searchsorted(starts, ends)
        seen = self.seen
        for i in range(len(ends) - 1):
            b, e, w, x = ends[i], ends[i + 1], at[i], at[i + 1]
            seen[threes[b : max(b, e - 2)]] = True
            seen[ones[w:x]] = True
            seen[twos[w : max(w, x - 1)]] = True
            seen[shapes[w : max(w, x - 2)]] = True
            found = np.flatnonzero(seen)
            seen[found] = False
            yield found


@dataclass
class Model:
    """Weights of the scaled indicators, and the logistic curve from margins to scores."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, texts, features: Features) -> np.ndarray:
        w = self.weights
        return np.array([w[f].sum(dtype=np.float64) / max(1.0, len(f)) ** 0.5 + self.bias for f in features.texts(texts)])

    def scores(self, texts, features: Features) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(texts, features) + self.shift, -30, 30)))


def class_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """In how many texts of class 0 and of class 1 each feature is, over all rows (quality, text).

    Each task adds up its own rows and passes on what it counted, compressed, in
    SLOTS parts, so the driver and each adding task hold a fixed amount.
    """

    def count(batches):
        features, sums = Features(), np.zeros((2, SIZE), np.int64)
        for batch in narrow_batches(batches):
            for y, f in zip(batch["quality"].to_pylist(), features.texts(batch["text"])):
                sums[y, f] += 1
        parts = sums.reshape(2, SLOTS, -1)
        slots = [s for s in range(SLOTS) if parts[:, s].any()]
        yield pa.RecordBatch.from_pydict({"slot": slots, "sums": [zstandard.compress(parts[:, s].tobytes(), 1) for s in slots]}, schema=pa.schema([("slot", pa.int32()), ("sums", pa.binary())]))

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, blob in zip(batch["slot"].to_pylist(), batch["sums"].to_pylist()):
                part = np.frombuffer(zstandard.decompress(blob), np.int64)
                total[s] = total[s] + part if s in total else part
        yield pa.RecordBatch.from_pydict({"slot": list(total), "sums": [v.tobytes() for v in total.values()]}, schema=pa.schema([("slot", pa.int32()), ("sums", pa.binary())]))

    parts = rows.mapInArrow(count, "slot int, sums binary").repartition(SLOTS, "slot").mapInArrow(add, "slot int, sums binary").collect()
    whole = np.zeros((2, SLOTS, SIZE // SLOTS), np.int64)
    for slot, sums in parts:
        whole[:, slot] += np.frombuffer(bytes(sums), np.int64).reshape(2, -1)
    whole = whole.reshape(2, SIZE)
    return whole[0], whole[1]


def descend(x: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: np.ndarray, epochs: int = 20, seed: int = 7) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L2-regularised hinge loss; x: feature numbers, y: -1 or 1.

    A value is ratio[f] / sqrt(number of features), and 1 for the bias. The
    weights returned are of the plain indicators: the ratios are folded in.
    """
    values = [ratio[f] / max(1.0, len(f)) ** 0.5 for f in x]
    norms = np.array([float(v @ v) + 1 for v in values])
    w, bias, alpha, rng = np.zeros(len(ratio)), 0.0, np.zeros(len(x)), np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(x)):
            gradient = y[i] * (w[x[i]] @ values[i] + bias) - 1
            step = min(max(alpha[i] - gradient / norms[i], 0.0), cost[i]) - alpha[i]
            if step:
                alpha[i] += step
                w[x[i]] += step * y[i] * values[i]
                bias += step * y[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w * ratio, bias


def _curve(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve by Newton steps with a slight ridge."""
    a, b = 1.0, 0.0
    design = np.stack([margin, np.ones_like(margin)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ np.array([a, b]), -30, 30)))
        gradient = design.T @ (weight * (p - y)) + np.array([1e-2 * (a - 1), 1e-3 * b])
        hessian = (design * (weight * p * (1 - p) + 1e-9)[:, None]).T @ design + np.diag([1e-2, 1e-3])
        step = np.linalg.solve(hessian, gradient)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-3), float(b)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, smoothing: float = 1.0) -> Model:
    """A model from the labelled texts of docs (doc_id, text) that aren't held out.

    Labels other than 0 and 1, null ids and null labels are left out; a null
    text is an empty one; repeated rows count as often as they stand there.
    With one class or none, every score is the (smoothed) share of label 1.
    Ratios come from all labelled rows; the hinge-loss model is fitted to at
    most ``fit_rows`` rows of each class, those with the smallest hash of their id
    (where an id stands on several rows, on fewer ids: the first by id and features).
    N-grams that stand once in all labelled rows tell nothing and have the ratio of none.
    Ids may be of any type; those that aren't integers are known by a hash of their text.
    """
    integral = isinstance(docs.schema["doc_id"].dataType, T.IntegralType)
    number = F.col("doc_id").cast("long") if integral else F.xxhash64(F.col("doc_id").cast("string"))
    remainder = F.crc32(F.col("doc_id").cast("string")) % 3
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).where(remainder != 1).select("doc_id", F.col("quality").cast("int").alias("quality"))
    known = small(written(known, "labels"))
    rows = docs.select("doc_id", "text").where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).join(known, "doc_id").select("doc_id", "quality", "text")
    negative, positive = class_counts(rows.select("quality", "text"))
    totals = {q: n for q, n in known.groupBy("quality").count().collect()}
    prior = (totals.get(1, 0) + 1) / (sum(totals.values()) + 2)
    constant = Model(np.zeros(SIZE), 0.0, 1.0, float(np.log(prior / (1 - prior))))
    if len(totals) < 2:
        return constant
    p, q = positive + smoothing, negative + smoothing
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    ratio[(positive + negative) < 2] = 0.0

    order = F.xxhash64(F.col("doc_id"))
    chosen = None
    for label in (0, 1):
        part = known.where(F.col("quality") == label).select("doc_id", "quality").distinct().orderBy(order, "doc_id").limit(fit_rows)
        chosen = part if chosen is None else chosen.union(part)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(number.alias("doc_id"), "quality", "text")

    def bounded(rows) -> list:
        """The first fit_rows rows of each class in order, never holding many more."""
        held: dict = {0: [], 1: []}
        for row in rows:
            own = held[row[1]]
            own.append(row)
            if len(own) >= 2 * fit_rows:
                held[row[1]] = sorted(own)[:fit_rows]
        return sorted(row for own in held.values() for row in sorted(own)[:fit_rows])

    def indicate(batches):
        features = Features()
        found = bounded((i, y, f.astype(np.int32).tobytes()) for batch in narrow_batches(batches) for i, y, f in zip(batch["doc_id"].to_pylist(), batch["quality"].to_pylist(), features.texts(batch["text"])))
        for at in range(0, len(found), 256):
            ids, labels_, blobs = zip(*found[at : at + 256])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels_, pa.int32()), pa.array(blobs, pa.binary())], ["doc_id", "quality", "f"])

    def train(batches):
        rows = bounded((i, y, f) for b in batches for i, y, f in zip(b["doc_id"].to_pylist(), b["quality"].to_pylist(), b["f"].to_pylist()))
        x = [np.frombuffer(f, np.int32) for _, _, f in rows]
        y = np.array([t for _, t, _ in rows])
        if len(set(y.tolist())) < 2:
            return
        part = np.array([i * 2654435761 % 5 for i, _, _ in rows])
        share = np.array([(y == t).sum() for t in (0, 1)])
        cost = np.where(y == 1, 1.0, min(10.0, share[1] / share[0])) if share[1] >= share[0] else np.where(y == 1, min(10.0, share[0] / share[1]), 1.0)
        signs = np.where(y == 1, 1.0, -1.0)
        margins = np.zeros(len(y))
        folds = 2 if len(y) >= 20 else 1
        for fold in range(folds):
            inside = np.flatnonzero((part % folds) != fold) if folds > 1 else np.arange(len(y))
            if len(set(y[inside].tolist())) < 2:
                inside = np.arange(len(y))
            w, bias = descend([x[i] for i in inside], signs[inside], ratio, cost[inside], 10)
            for i in np.flatnonzero((part % folds) == fold) if folds > 1 else np.arange(len(y)):
                margins[i] = w[x[i]].sum() / max(1.0, len(x[i])) ** 0.5 + bias
        weight = np.where(y == 1, prior / share[1], (1 - prior) / share[0]) * len(y)
        slope, shift = _curve(margins, y, weight)
        w, bias = descend(x, signs, ratio, cost)
        yield pa.RecordBatch.from_pydict({"w": [w.astype(np.float32).tobytes()], "rest": [[bias, slope, shift]]}, schema=pa.schema([("w", pa.binary()), ("rest", pa.list_(pa.float64()))]))

    found = sample.mapInArrow(indicate, "doc_id long, quality int, f binary").repartition(1).mapInArrow(train, "w binary, rest array<double>").collect()
    if not found:
        return constant
    return Model(np.frombuffer(bytes(found[0].w), np.float32), *found[0].rest)


def score(docs: DataFrame, model: Model, reject_below: float | None = None) -> DataFrame:
    """docs with a column quality_score; with reject_below only rows that reach it, without that column.

    All columns pass through; a column quality_score that was there before is
    replaced. A null text scores as an empty one.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    keep = reject_below is not None
    if not keep:
        docs = docs.drop("quality_score")
    names = docs.columns
    schema = docs.schema if keep else T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType())])

    def run(batches):
        features = Features()
        for batch in narrow_batches(batches):
            scores = sent.value.scores(batch.column(names.index("text")), features)
            if keep:
                yield batch.filter(pa.array(scores >= reject_below))
            else:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*names, "quality_score"])

    return docs.mapInArrow(run, schema)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the rows that the classifier, fitted to labels, rejects.

    Rows are judged by their text alone, a null text as an empty one; see fit for labels. All columns, of any
    name, and repeated rows stay as they are; an empty table stays empty.
    """
    return score(docs, fit(docs, table(spark, sf_dir, "labels")), reject_below=0.5)
