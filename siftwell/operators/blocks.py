"""The k nearest rows to each query of one block, by matrix products; what they leave over is compared exactly.

A product of matrices tells which rows may be among a query's k best: those within its rounding of the k-th. Only
these get the distance itself, whose sums go through the components in order, as ``vectors.similarity`` has them,
so distances and ties are those of the expression, to the last bit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Numbers in a product of matrices, pairs that are compared exactly at once, and pairs that wait to be ranked.
PRODUCT, PAIRS, WAITING = 1 << 22, 1 << 16, 1 << 18
#: Norms whose vectors can be scaled to length 1 without loss; others are compared exactly with everything.
LEAST, MOST = 1e-100, 1e100


def by_length(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) for each length of vectors of an Arrow list column; null and empty vectors and those with a null component are left out."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    flat, starts = column.flatten(), np.concatenate([[0], np.cumsum(lengths)])[:-1]
    whole = np.ones(len(lengths), bool)
    if flat.null_count:
        whole[pc.list_parent_indices(column).to_numpy()[flat.is_null().to_numpy(zero_copy_only=False)]] = False
    values, out = flat.to_numpy(zero_copy_only=False), []
    for n in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero((lengths == n) & whole)
        part = values.reshape(-1, n) if len(at) == len(lengths) else values[starts[at][:, None] + np.arange(n)]
        out.append((at, part.astype(np.float64)))
    return out


def norms(matrix: np.ndarray) -> np.ndarray:
    total = np.zeros(len(matrix))
    with np.errstate(all="ignore"):
        for i in range(matrix.shape[1]):
            total = total + matrix[:, i] * matrix[:, i]
        return np.sqrt(total)


class Nearest:
    """The k best rows, so far, of each of some queries. ids and vectors: Arrow columns; within: what is known to bound the k-th distance of each."""

    def __init__(self, ids, vectors, k: int, within: np.ndarray | None = None) -> None:
        self.ids, self.k = ids, k
        self.queries = [(at, matrix, norms(matrix)) for at, matrix in by_length(vectors)]
        self.least = np.full(len(ids), -np.inf) if within is None else np.where(np.isnan(within), -np.inf, 1 - within)
        self.best, self.waiting, self.pairs = None, [], 0

    def meet(self, ties, vectors, only: np.ndarray | None = None) -> None:
        """Rows with their ties and vectors (Arrow columns) meet all queries, or those at the places ``only``."""
        for at, matrix in by_length(vectors):
            for asked, wanted, wanted_norms in self.queries:
                if wanted.shape[1] != matrix.shape[1]:
                    continue
                if only is not None:
                    mine = np.flatnonzero(np.isin(asked, only))
                    asked, wanted, wanted_norms = asked[mine], wanted[mine], wanted_norms[mine]
                if len(asked):
                    self._meet(ties, at, matrix, asked, wanted, wanted_norms)

    def _meet(self, ties, at, rows, asked, wanted, wanted_norms) -> None:
        # In order of ties; of equal vectors no more than k can be among the best of any query.
        own = ties.take(pa.array(at))
        order = pc.sort_indices(own, null_placement="at_start").to_numpy()
        at, rows = at[order], np.ascontiguousarray(rows[order])
        _, same = np.unique(rows.view(np.dtype((np.void, rows.itemsize * rows.shape[1]))).ravel(), return_inverse=True)
        together = np.argsort(same, kind="stable")
        first = np.searchsorted(same[together], same[together])
        kept = np.sort(together[np.arange(len(together)) - first < self.k])
        at, rows = at[kept], rows[kept]
        lengths = norms(rows)
        plain_rows, plain_queries = ((n >= LEAST) & (n <= MOST) for n in (lengths, wanted_norms))
        odd_rows, odd_queries = np.flatnonzero(~plain_rows & (lengths != 0)), np.flatnonzero(~plain_queries)
        r, q = np.flatnonzero(plain_rows), np.flatnonzero(plain_queries)
        everywhere = np.arange(len(asked))

        def exact(i: np.ndarray, j: np.ndarray) -> None:
            """Pairs of row i and query j get their distances."""
            for s in range(0, len(i), PAIRS):
                a, b = i[s : s + PAIRS], j[s : s + PAIRS]
                left, right = np.ascontiguousarray(rows[a].T), np.ascontiguousarray(wanted[b].T)
                dot = np.zeros(len(a))
                with np.errstate(all="ignore"):
                    for x, y in zip(left, right):
                        dot = dot + x * y
                    below = lengths[a] * wanted_norms[b]
                    distance = 1 - dot / below
                self._wait(ties, asked[b], at[a], distance, below != 0)

        if len(r) and len(q):
            slack = 16 * (rows.shape[1] + 8) * np.finfo(np.float64).eps
            unit, wanted_unit = rows[r] / lengths[r][:, None], (wanted[q] / wanted_norms[q][:, None]).T
            step = max(self.k, PRODUCT // len(q), 1)
            for s in range(0, len(r), step):
                near = unit[s : s + step] @ wanted_unit
                if len(near) >= self.k and np.isneginf(self.least[asked[q]]).any():
                    kth = np.partition(near, len(near) - self.k, axis=0)[len(near) - self.k]
                    self.least[asked[q]] = np.maximum(self.least[asked[q]], kth - slack)
                i, j = np.nonzero(near >= self.least[asked[q]] - slack)
                exact(r[s + i], q[j])
        for i in odd_rows:
            exact(np.full(len(asked), i), everywhere)
        for j in odd_queries:
            others = np.setdiff1d(np.arange(len(rows)), odd_rows)
            exact(others, np.full(len(others), j))

    def _wait(self, ties, asked, at, distance, defined) -> None:
        asked, at, distance = asked[defined], at[defined], distance[defined]
        self.waiting.append(pa.table({"q": pa.array(asked, pa.int64()), "tie": ties.take(pa.array(at, pa.int64())), "distance": pa.array(distance, pa.float64(), from_pandas=False)}))
        self.pairs += len(asked)
        if self.pairs > WAITING:
            self._rank()

    def _rank(self) -> None:
        if not self.waiting:
            return
        all_ = pa.concat_tables([t for t in (self.best, *self.waiting) if t is not None])
        all_ = all_.append_column("known", pc.is_valid(all_["tie"]).cast(pa.int8()))
        all_ = all_.take(pc.sort_indices(all_, sort_keys=[(c, "ascending") for c in ("q", "distance", "known", "tie")])).drop_columns("known")
        q = all_["q"].to_numpy()
        place = np.arange(len(q)) - np.searchsorted(q, q)
        self.best, self.waiting, self.pairs = all_.filter(pa.array(place < self.k)), [], 0
        full = place == self.k - 1
        known = 1 - all_["distance"].to_numpy()[full]
        usable = ~np.isnan(known)
        at = q[full][usable]
        self.least[at] = np.maximum(self.least[at], known[usable])

    def found(self) -> tuple[pa.ChunkedArray, pa.ChunkedArray, pa.ChunkedArray] | None:
        """(query ids, ties, distances) of the best rows; None if there are none."""
        self._rank()
        if self.best is None:
            return None
        return self.ids.take(self.best["q"]), self.best["tie"], self.best["distance"]
