"""Operator 11: embedding whitening by blockwise TSQR and one-sided Jacobi rotations.

Vectors are put on a grid, x = floor(scale * c), and the fit list holds each distinct x once. One pass sums it exactly; a second one
centres each block of rows, (n * x - S) / n, and replaces it, stacked under what it has so far, by the R of its QR factors. The R of all
tasks are merged a few at a time until one is left, d x d whatever the rows. Rotations of pairs of columns make the columns of that R
orthogonal: the rotations multiplied up are the components, the columns' lengths the standard deviations times the root of n, neither of them
ever squared. A third pass measures how far the covariance of what comes out is from the identity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stash import discard, stash

SCALE = 256
COMPONENTS = 4
#: R factors that one task merges; rows of one block.
FAN = 16
ROWS = 4096
_LONG = 2**63


def grid(vector: Column, scale: int = SCALE) -> Column:
    """The vector's entries as whole numbers; null where the vector is null or has a null, infinite or NaN entry."""
    fine = F.forall(vector, lambda c: F.coalesce((F.abs(c) < float("inf")) & ~F.isnan(c), F.lit(False)))
    return F.when(fine, F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long")))


def _rows(column) -> np.ndarray:
    """An Arrow list column of equal lengths as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _offsets(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: 64-bit where that can't overflow, Python integers elsewhere."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if n * most + max(map(abs, sums), default=0) < _LONG:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (_offsets(x, n, sums) / n).astype(np.float64)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums over dimensions of (n * x - S)^2, exact; null where a long can't hold one."""
    off = _offsets(x, n, sums)
    if off.dtype == np.int64:
        most = max(abs(int(off.max(initial=0))), abs(int(off.min(initial=0))))
        if most * most * max(1, off.shape[1]) < _LONG:
            return (off * off).sum(1).tolist()
    return [d if d < _LONG else None for d in (sum(int(v) * int(v) for v in row) for row in off)]


def _stack(r: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(np.vstack([r, rows]), mode="r")


def _factors(n: int, sums: list[int]):
    """Each task's R of the centred rows, with a number to merge by."""

    def run(batches):
        r = np.zeros((0, len(sums)))
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                r = _stack(r, _centred(_rows(batch["x"].slice(at, ROWS)), n, sums))
        if len(r):
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([r.ravel().tolist()])], ["no", "r"])

    return run


def _merge(d: int):
    def run(rows):
        r = np.zeros((0, d))
        rows = rows.sort_values("no")
        for flat in rows["r"]:
            r = _stack(r, np.asarray(flat, np.float64).reshape(-1, d))
        return rows[["no"]].head(1).floordiv(FAN).assign(r=[r.ravel().tolist()])

    return run


def tsqr(x: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """The R of the centred rows of ``x`` (x array<long>), merged ``FAN`` at a time: only the last one, d x d, comes to the driver."""
    d = len(sums)
    level = stash(x.mapInArrow(_factors(n, sums), "no long, r array<double>"), "factors")
    tasks = level.agg(F.coalesce(F.max("no"), F.lit(-1))).first()[0] + 1
    while tasks > 1:
        before, level = level, stash(level.groupBy(F.floor(F.col("no") / FAN).alias("k")).applyInPandas(_merge(d), "no long, r array<double>"), "factors")
        discard(before)
        tasks = -(-tasks // FAN)
    row = level.first()
    discard(level)
    return np.asarray(row.r).reshape(-1, d) if row else np.zeros((0, d))


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(lengths falling, components as columns): rotations orthogonalise pairs of columns of ``r``, in rounds of pairs without common columns."""
    d = r.shape[1]
    a, v = np.vstack([r, np.zeros((1, d))]), np.eye(d)
    a, v = np.asfortranarray(a), np.asfortranarray(v)
    ring = list(range(d + d % 2))
    for _ in range(sweeps):
        turned = 0
        for _ in range(len(ring) - 1):
            half = len(ring) // 2
            pairs = [(p, q) for p, q in zip(ring[:half], reversed(ring[half:]), strict=True) if max(p, q) < d]
            ring = [ring[0], ring[-1], *ring[1:-1]]
            if not pairs:
                continue
            p, q = np.array(pairs).T
            x, y = a[:, p], a[:, q]
            alpha, beta, gamma = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            on = np.abs(gamma) > 1e-15 * np.sqrt(alpha * beta)
            turned += int(on.sum())
            p, q, alpha, beta, gamma = p[on], q[on], alpha[on], beta[on], gamma[on]
            zeta = (beta - alpha) / (2 * gamma)
            t = np.where(zeta >= 0, 1, -1) / (np.abs(zeta) + np.hypot(1, zeta))
            c = 1 / np.hypot(1, t)
            s = c * t
            for m in (a, v):
                x, y = m[:, p].copy(), m[:, q].copy()
                m[:, p], m[:, q] = c * x - s * y, s * x + c * y
        if not turned:
            break
    lengths = np.sqrt((a * a).sum(0))
    order = np.argsort(-lengths, kind="stable")
    return lengths[order], v[:, order] / np.sqrt((v[:, order] ** 2).sum(0))


def _whitened(x: np.ndarray, n: int, sums: list[int], way: np.ndarray) -> np.ndarray:
    return _centred(x, n, sums) @ way


def _moments(n: int, sums: list[int], way: np.ndarray):
    """Each task's sums and sums of products of what comes out, flat."""

    def run(batches):
        k = way.shape[1]
        total = np.zeros(k + k * k)
        for batch in batches:
            z = _whitened(_rows(batch["x"]), n, sums, way)
            total += np.concatenate([z.sum(0), (z.T @ z).ravel()])
        yield pa.record_batch([pa.array([total.tolist()], pa.list_(pa.float64()))], ["m"])

    return run


def _sums(batches):
    """Each task's exact sums by dimension, as decimals."""
    n, total = 0, None
    for batch in batches:
        x = _rows(batch["x"])
        n += len(x)
        if len(x):
            most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
            s = x.sum(0).tolist() if most * len(x) < _LONG else x.astype(object).sum(0).tolist()
            total = s if total is None else [a + b for a, b in zip(total, s, strict=True)]
    if n:
        yield pa.record_batch([pa.array([n], pa.int64()), pa.array([[str(t) for t in total]], pa.list_(pa.string()))], ["n", "s"])


class Whitening:
    """What a fit keeps: rows n, sums S, components (columns) and standard deviations, shares of the variance, and the identity's error."""

    def __init__(self, n: int, sums: list[int], lengths: np.ndarray, vectors: np.ndarray, components: int):
        self.n, self.sums = n, sums
        k = min(components, len(lengths))
        self.deviations = lengths[:k] / np.sqrt(n) if n else lengths[:k]
        fine = lengths[:k] > (lengths[0] if len(lengths) else 0.0) * 1e-12
        self.rank = int(fine.sum())
        self.components = vectors[:, :k]
        total = float((lengths**2).sum())
        self.explained = [float(x * x / total) if total > 0 else 0.0 for x in lengths[:k]]
        self.way = self.components[:, : self.rank] / self.deviations[: self.rank] if self.rank else np.zeros((len(sums), 0))
        self.error: float | None = None


def fit(x: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct rows of ``x`` (x array<long>, all of one length); None without rows or dimensions."""
    distinct = stash(x.select("x").distinct(), "fit")
    sums = distinct.mapInArrow(_sums, "n long, s array<string>")
    sums = sums.select("n", F.posexplode("s").alias("i", "s")).groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    if not sums:
        discard(distinct)
        return None
    n, s = sums[0].n, [int(r.s) for r in sums]
    w = Whitening(n, s, *jacobi(tsqr(distinct, n, s)), components)
    k = w.rank
    if k:
        m = distinct.mapInArrow(_moments(n, s, w.way), "m array<double>").select(F.posexplode("m").alias("i", "m")).groupBy("i").agg(F.sum("m").alias("m"))
        m = np.array([r.m for r in m.orderBy("i").collect()]) / n
        w.error = float(np.abs(m[k:].reshape(k, k) - np.outer(m[:k], m[:k]) - np.eye(k)).max())
    discard(distinct)
    return w


_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _apply(w: Whitening):
    k = len(w.explained)

    def run(batches):
        for batch in batches:
            x = _rows(batch["x"])
            rows = len(x)
            z = np.full((rows, k), np.nan)
            z[:, : w.rank] = _whitened(x, w.n, w.sums, w.way) if rows else 0
            each = np.repeat(np.arange(rows), k)
            deviation = pa.array(_deviations(x, w.n, w.sums), pa.int64())
            yield pa.record_batch(
                [
                    batch["vec_id"].take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, w.n)),
                    deviation.take(pa.array(each)),
                    pa.array(z.ravel(), mask=np.isnan(z.ravel())),
                    pa.array(np.tile(w.explained, rows)),
                    pa.array([w.error] * (rows * k), pa.float64()),
                ],
                [p.split(" ")[0] for p in _OUT.split(", ")],
            )

    return run


def whiten(embeddings: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each fine vector and component.

    Vectors that are null or hold null, NaN or infinite entries are left out; so are those without the commonest length (of equally common
    ones the greater), which no component of that space fits. Repeated rows and null ids each give rows; repeated vectors count once in the fit.
    A component without variance (fewer distinct vectors or free dimensions than components) has null ``whitened`` and 0 ``explained``; so have
    all where only one distinct vector is left, ``identity_error`` then is null. ``deviation`` is null where a long can't hold it. No rows
    or no dimensions: no rows. Other columns are ignored. Vectors are shuffled once, to find distinct ones; the driver sees R and sums.
    """
    rows = embeddings.select(F.col(id).cast("long").alias("vec_id"), grid(F.col(vector), scale).alias("x")).where("x is not null")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if not lengths or not lengths.d:
        return rows.sparkSession.createDataFrame([], _OUT)
    rows = rows.where(F.size("x") == lengths.d)
    return rows.mapInArrow(_apply(fit(rows, components)), _OUT)
