import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.llm.neighbours import grow, search

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, asked):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v) and len(v) == 8]
    out = {}
    for i, v in ok:
        if i % asked == 0:
            near = sorted((-float((v * w).sum() / np.sqrt((v * v).sum()) / np.sqrt((w * w).sum())), j) for j, w in ok if j != i)
            out[i] = [(j, -s) for s, j in near[:k]]
    return out


def test_tree_puts_every_row_in_a_leaf():
    points = np.random.default_rng(1).normal(size=(2000, 8))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    tree = grow(points, 50)
    assert set(tree.assign(points)) <= set(range(tree.leaves)) and tree.leaves > 20
    assert sorted(tree.best_first(points[0], 10**6)) == list(range(tree.leaves))
    assert grow(np.repeat(points[:1], 300, axis=0), 50).leaves == 1


def test_recall_and_scores(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(20, 8))
    rows = [(i, (centres[i % 20] + 0.3 * r.normal(size=8)).astype(np.float32).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[7][1]) for i in range(300)]
    rows += [(3000, None), (3050, [0.0] * 8), (3100, [float("nan")] + [1.0] * 7), (3150, [None] + [1.0] * 7), (3200, [1.0] * 5), (None, [1.0] * 8)]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    got = {}
    for x in search(table, F.col("vec_id") % 50 == 0, leaf_rows=64).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    want = brute(rows, 5, 50)
    assert got.keys() == want.keys() and all(len(v) == 5 for v in got.values())
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    assert got[2050] == want[2050]  # copies: the smallest ids
    for q in want:
        known = dict(want[q])
        assert all(abs(s - known[j]) < 1e-12 for j, s in got[q] if j in known)


def test_few_rows(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0], 0), (50, [0.0, 1.0], 0), (7, [1.0, 1.0], 0)], SCHEMA)
    rows = search(table, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in rows] == [(0, 1, 7), (0, 2, 50), (50, 1, 7), (50, 2, 0)]
    assert search(table.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_repeated_query_id(spark):
    a = [1.0, 0.0, 0.0]
    turned = [[0.0, 1.0, i / 100] for i in range(8)]
    rows = [(50, a)] * 8 + [(i, a) for i in (51, 52, 53)] + [(54, a)] * 7 + [(100, v) for v in turned] + [(101 + i, [0.0, 1.0, -0.2 - i / 100]) for i in range(6)]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    found = {}
    for x in search(table, F.col("vec_id") % 50 == 0).collect():
        found.setdefault(x.query_id, []).append((x["rank"], x.vec_id))
    assert sorted(found[50]) == sorted([(1, 51), (2, 52), (3, 53), (4, 54), (5, 54)] * 8)
    assert sorted(found[100]) == sorted([(i + 1, 101 + i) for i in range(5)] * 8)


def test_vectors_whose_squares_overflow_or_vanish(spark):
    """Cosines don't depend on lengths, however large or small."""
    near = [([3.0, 4.0], 1.0), ([4.0, 3.0], 0.96), ([-4.0, 3.0], 0.0), ([-3.0, -4.0], -1.0)]
    rows = [(50, [3e200, 4e200]), (100, [3e-200, 4e-200])]
    for k, scale in enumerate((1e250, 1e-250, 1.0, 5e-324)):
        rows += [(51 + 10 * k + i, [x * scale for x in v]) for i, (v, _) in enumerate(near)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = search(table, F.col("vec_id") % 50 == 0, 17).collect()
    cosine = lambda v: (3 * v[0] + 4 * v[1]) / (5 * math.hypot(*v))
    known = {i: cosine([x / max(map(abs, v)) for x in v]) for i, v in rows}
    assert len(found) == 34 and all(r.score == pytest.approx(known[r.vec_id], abs=1e-14) for r in found)
    assert all(r.score > 1 - 1e-14 for r in found if r["rank"] <= 4) and all(r.score < -0.9 for r in found if r["rank"] > 14)
