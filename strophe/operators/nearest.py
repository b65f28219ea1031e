"""The best of the vectors that a task reads, for all queries at once: matrix products pick, sums in one order decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Rows of vectors, and scores, that are in memory at once.
ROWS, SCORES = 4096, 1 << 22
#: Entries from here on could overflow a product; null, NaN and infinity aren't below it either.
HUGE = 1e150


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length, without nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def least_first(ids: pa.Array) -> np.ndarray:
    """Whole numbers for sorting, nulls first."""
    return ids.cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


def _least_copies(x: np.ndarray, kind: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows without those that ``k`` rows of equal vector and kind and no greater id come before: copies cost no more than ``k`` each."""
    whole = np.ascontiguousarray(np.column_stack([x + 0.0, kind])).view(f"V{8 * (x.shape[1] + 1)}").ravel()
    same = np.unique(whole, return_inverse=True)[1]
    order = np.lexsort((ids, same))
    return np.sort(order[_places(same[order]) < k])


def _places(groups: np.ndarray) -> np.ndarray:
    """The place from 0 of each row in its run of equal ``groups``."""
    head = np.ones(len(groups), bool)
    head[1:] = groups[1:] != groups[:-1]
    return np.arange(len(groups)) - np.flatnonzero(head)[np.cumsum(head) - 1]


class Best:
    """The ``k`` best rows so far of each query, by inner product, ties by id.

    Products of matrices differ in the last bits from place to place, so they only tell which rows may be among the best; those are
    summed entry by entry, as ``functions.vectors.dot`` does, and ranked by that. ``allowed`` and ``preferred`` are tables of (kind of query, kind of vector):
    which pairs count, and which get ``boost``. Scores up to ``least`` don't count.
    """

    def __init__(self, queries: np.ndarray, kinds: np.ndarray, k: int, allowed: np.ndarray | None = None, preferred: np.ndarray | None = None, boost: float = 0.0, least: float | None = None):
        self.queries, self.kinds, self.k, self.allowed, self.preferred, self.boost, self.least = queries, kinds, k, allowed, preferred, boost, least
        self.norms = np.sqrt((queries**2).sum(1))
        self.bar = np.full(len(queries), -np.inf if least is None else least)
        self.query, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.rows: pa.Table | None = None

    def add(self, x: np.ndarray, kind: np.ndarray, ids: np.ndarray, rows: pa.Table, asked: np.ndarray | None = None) -> None:
        """Score vectors for all queries, or those ``asked``; ``rows`` are what is told of them."""
        asked = np.arange(len(self.queries)) if asked is None else asked
        for at in range(0, len(x), ROWS):
            part = slice(at, at + ROWS)
            keep = _least_copies(x[part], kind[part], ids[part], self.k) + at
            self._block(x[keep], kind[keep], ids[keep], rows.take(pa.array(keep)), asked)

    def _block(self, x: np.ndarray, kind: np.ndarray, ids: np.ndarray, rows: pa.Table, asked: np.ndarray) -> None:
        found = []
        long = float(np.sqrt((x**2).sum(1)).max(initial=0.0))
        step = max(1, SCORES // max(1, len(x)))
        for a in range(0, len(asked), step):
            q = asked[a : a + step]
            s = self.queries[q] @ x.T
            if self.preferred is not None:
                s += self.boost * np.take(self.preferred[self.kinds[q]], kind, axis=1)
            if self.allowed is not None:
                s[~np.take(self.allowed[self.kinds[q]], kind, axis=1)] = -np.inf
            slack = 4 * (x.shape[1] + 4) * np.finfo(float).eps * (self.norms[q] * long + abs(self.boost)) + 1e-300
            if len(x) > self.k:  # what k rows here reach, the best must reach too
                new = np.flatnonzero(~np.isfinite(self.bar[q]) | (s.max(1) > self.bar[q] + 8 * slack))
                if len(new) > len(q) // 8:
                    self.bar[q[new]] = np.maximum(self.bar[q[new]], np.partition(s[new], len(x) - self.k, axis=1)[:, len(x) - self.k] - slack[new])
            i, j = np.nonzero((s >= (self.bar[q] - slack)[:, None]) & (s > -np.inf))
            del s
            found.append((q[i], j, self._scores(q[i], x, kind, j)))
        query, j, score = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if self.least is not None:
            query, j, score = (c[score > self.least] for c in (query, j, score))
        if not len(query) and self.rows is not None:
            return
        self._keep(query, score, ids[j], rows.take(pa.array(j)))

    def _scores(self, query: np.ndarray, x: np.ndarray, kind: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(query))
        for a in range(0, len(query), 1 << 16):
            part = slice(a, a + (1 << 16))
            products = (self.queries[query[part]] * x[j[part]]).T.copy()
            for row in products:
                out[part] += row
        if self.preferred is not None:
            out += np.where(self.preferred[self.kinds[query], kind[j]], self.boost, 0.0)
        return out

    def _keep(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, rows: pa.Table) -> None:
        query, score, ids = np.concatenate([self.query, query]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        rows = rows if self.rows is None else pa.concat_tables([self.rows, rows])
        order = np.lexsort((ids, -score, query))
        place = _places(query[order])
        full = order[place == self.k - 1]
        self.bar[query[full]] = np.maximum(self.bar[query[full]], score[full])
        order = order[place < self.k]
        self.query, self.score, self.id = query[order], score[order], ids[order]
        self.rows = rows.take(pa.array(order)).combine_chunks()

    def found(self, queries: pa.Table) -> Iterator[pa.RecordBatch]:
        """The rows of the vectors, of ``queries``, and the score."""
        if self.rows is not None and len(self.query):
            told = queries.take(pa.array(self.query))
            out = pa.table([*self.rows.columns, *told.columns, pa.array(self.score)], [*self.rows.column_names, *told.column_names, "score"])
            yield from out.to_batches(max_chunksize=50_000)
