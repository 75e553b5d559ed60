"""Whitening of embeddings by incremental eigendecomposition.

Each partition keeps the mean of its vectors and the eigenvalues and eigenvectors of their centred scatter. A block of
vectors enters as centred rank-one updates, the first of which moves the mean; every update solves the secular equation
for all eigenvalues at once, after deflation. Spectra of partitions are merged in the same way, group by group: one's
eigenpairs, and the step between the means, are rank-one updates of the other's. The merged basis is then refined: one
more pass projects all vectors on it, and the small projected covariance is diagonalised (Rayleigh-Ritz).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: Entries are floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Rows of a block; spectra that one task merges.
BLOCK, FAN_IN = 4096, 16
#: Components whose eigenvalue is at most this share of the largest have no scale, and are left out.
RANK = 1e-12
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


# --- rank-one updates ------------------------------------------------------------------------------------------------


def secular_roots(poles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(weights / (poles - x)) = 0, as a pole's number and the distance from it.

    poles: ascending, distinct; weights: positive. The j-th root lies between poles j and j + 1, the last one at most the
    sum of weights above the last pole. Each is kept relative to its nearer pole, so that differences from poles stay
    exact; steps interpolate both sides' sums by simple poles (as in the middle-way method) and fall back on bisection.
    """
    n = len(poles)
    gap = np.r_[np.diff(poles), weights.sum()]
    away = poles[:, None] - poles[None, :]
    middle = 1 + (weights[:, None] / (away - gap / 2)).sum(0)
    near = np.arange(n) + ((middle < 0) & (np.arange(n) < n - 1))
    upper = near > np.arange(n)
    base = away[:, near]  # poles less the nearer one, for each root
    low, high = np.where(upper, -gap / 2, 0.0), np.where(upper, 0.0, gap / 2)
    high[-1] = gap[-1]
    low[-1] = 0.0
    x = (low + high) / 2
    left = np.arange(n)[:, None] <= np.arange(n)[None, :]
    d1 = np.where(upper, -gap, 0.0)
    d2 = d1 + gap
    for _ in range(80):
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            delta = base - x
            t = weights[:, None] / delta
            f = 1 + t.sum(0)
            slope = t / delta
            psi, phi = (slope * left).sum(0), (slope * ~left).sum(0)
            low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
            a, b = d1 - x, d2 - x
            c = f - a * psi - b * phi
            p, q = (a + b) * f - a * b * (psi + phi), a * b * f
            root = np.sqrt(np.maximum(p * p - 4 * q * c, 0))
            step = np.where(p <= 0, (p - root) / (2 * c), 2 * q / (p + root))
            step[-1] = a[-1] + a[-1] ** 2 * psi[-1] / (f[-1] - a[-1] * psi[-1])  # one pole only
            new = x + step
            new = np.where((new > low) & (new < high), new, (low + high) / 2)
        done = (np.abs(new - x) <= 4e-16 * np.abs(new)) | (new == low) | (new == high) | (f == 0)
        x = np.where(f == 0, x, new)
        if done.all():
            break
    return near, x


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eigenvalues (ascending) and eigenvectors of vectors diag(values) vectors' + v v'.

    Deflated are directions that v hardly touches, and of equal eigenvalues all but one: those are turned so that v has one
    component among them.
    """
    z = vectors.T @ v
    norm = float(z @ z)
    scale = max(float(values[-1]), norm)
    if norm <= 1e-32 * scale or not norm:
        return values, vectors
    values, vectors = values.copy(), vectors.copy()
    tiny = 8 * np.finfo(float).eps * scale
    for i in range(len(values) - 1):
        if values[i + 1] - values[i] <= tiny and z[i] != 0:
            r = math.hypot(z[i], z[i + 1])
            c, s = z[i + 1] / r, z[i] / r
            z[i], z[i + 1] = 0.0, r
            vectors[:, [i, i + 1]] = np.stack([c * vectors[:, i] - s * vectors[:, i + 1], s * vectors[:, i] + c * vectors[:, i + 1]], 1)
    live = np.flatnonzero(np.abs(z) * math.sqrt(norm) > tiny)
    if not len(live):
        return values, vectors
    poles, w = values[live], z[live] ** 2
    near, x = secular_roots(poles, w)
    # delta[i, j]: pole i less root j. Weights that have these roots exactly (Gu and Eisenstat 1994) keep vectors orthogonal.
    delta = poles[:, None] - poles[near][None, :] - x[None, :]
    delta = np.where(delta == 0, np.finfo(float).tiny, delta)
    apart = poles[:, None] - poles[None, :]
    np.fill_diagonal(apart, 1.0)
    exact = np.copysign(np.exp((np.log(np.abs(delta)).sum(1) - np.log(np.abs(apart)).sum(1)) / 2), z[live])
    turned = exact[:, None] / delta
    turned /= np.linalg.norm(turned, axis=0)
    vectors[:, live] = vectors[:, live] @ turned
    values[live] = poles[near] + x
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


class Spectrum:
    """n vectors by their mean and the eigenpairs of their centred scatter."""

    def __init__(self, n: int, mean: np.ndarray, values: np.ndarray, vectors: np.ndarray):
        self.n, self.mean, self.values, self.vectors = n, mean, values, vectors

    @classmethod
    def nothing(cls, d: int) -> Spectrum:
        return cls(0, np.zeros(d), np.zeros(d), np.eye(d))

    def _add(self, n: int, mean: np.ndarray, terms: np.ndarray) -> None:
        """n more vectors with this mean, whose centred scatter is terms' terms."""
        between = (mean - self.mean) * math.sqrt(self.n * n / (self.n + n))
        for v in (between, *terms):
            self.values, self.vectors = rank_one(self.values, self.vectors, v)
        self.values = np.maximum(self.values, 0)
        self.mean = self.mean + (mean - self.mean) * (n / (self.n + n))
        self.n += n

    def add_rows(self, rows: np.ndarray) -> None:
        """A block. Of more than d rows the triangular factor's d rows have the same scatter, so they stand for the block."""
        mean = rows.mean(0)
        centred = rows - mean
        self._add(len(rows), mean, np.linalg.qr(centred, mode="r") if len(rows) > rows.shape[1] else centred)

    def add_spectrum(self, other: Spectrum) -> None:
        if other.n:
            some = other.values > 0
            self._add(other.n, other.mean, (other.vectors[:, some] * np.sqrt(other.values[some])).T)


# --- passes over the vectors -----------------------------------------------------------------------------------------


def usable(batch: pa.RecordBatch, d: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a batch (vec_id, embedding) and their floor(SCALE * c), by length (only length d, if that is given)."""
    column = batch.column(1)
    size = np.asarray(column.value_lengths().fill_null(-1))
    for length in np.unique(size):
        if length < 1 or (d is not None and length != d):
            continue
        at = np.flatnonzero(size == length)
        c = column.take(pa.array(at)).flatten().cast(pa.float64()).fill_null(math.nan).to_numpy(zero_copy_only=False).reshape(-1, length)
        ok = (np.abs(c) < 2.0**46).all(1)
        if ok.any():
            yield at[ok], np.floor(SCALE * c[ok])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, u in usable(batch):
            x = u.astype(np.int64) + SHIFT
            whole = [(int(h) << 26) + int(l) for h, l in zip((x >> 26).sum(0), (x & ((1 << 26) - 1)).sum(0))]
            total = pa.array([len(x), *whole], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]] * len(total), pa.int32()), pa.array(range(len(total)), pa.int32()), total], names=["size", "place", "total"])


def fit_list(vectors: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors, and the exact sum of x for each entry; vectors of the commonest length (of equal ones the longest)."""
    sums = vectors.mapInArrow(_sums, "size int, place int, total decimal(38,0)").groupBy("size", "place").agg(F.sum("total").alias("total"))
    best = sums.where("place = 0").orderBy(F.desc("total"), F.desc("size")).first()
    if best is None:
        return 0, []
    rows = sums.where((F.col("size") == best["size"]) & (F.col("place") > 0)).collect()
    return int(best["total"]), [int(r.total) for r in sorted(rows, key=lambda r: r.place)]


STATE = "part long, n long, mean array<double>, eigenvalues array<double>, eigenvectors array<double>"


def _spectra(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = Spectrum.nothing(d)
        for batch in batches:
            for _, u in usable(batch, d):
                for k in range(0, len(u), BLOCK):
                    own.add_rows(u[k : k + BLOCK])
        if own.n:
            yield pa.RecordBatch.from_pandas(_as_rows(TaskContext.get().partitionId(), own), preserve_index=False)

    return run


def _as_rows(part: int, s: Spectrum) -> pd.DataFrame:
    return pd.DataFrame({"part": [part], "n": [s.n], "mean": [s.mean], "eigenvalues": [s.values], "eigenvectors": [s.vectors.ravel()]})


def _of_row(r) -> Spectrum:
    d = len(r.mean)
    return Spectrum(int(r.n), np.array(r.mean), np.array(r.eigenvalues), np.array(r.eigenvectors).reshape(d, d))


def _merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    rows = [_of_row(r) for r in group.sort_values("part").itertuples()]
    for other in rows[1:]:
        rows[0].add_spectrum(other)
    return _as_rows(key[0], rows[0])


def spectrum(vectors: DataFrame, d: int) -> Spectrum:
    """The merged spectrum of all vectors: partitions' own, then FAN_IN at a time until one is left."""
    states = vectors.mapInArrow(_spectra(d), STATE)
    left = vectors.rdd.getNumPartitions()
    while left > 1:
        states = states.groupBy(F.floor(F.col("part") / FAN_IN).alias("group")).applyInPandas(_merge, STATE)
        left = -(-left // FAN_IN)
    return _of_row(states.first())


def _grams(d: int, mean: np.ndarray, basis: np.ndarray):
    """Sums of y and of y y' over a task's rows, where y = basis' (x - mean)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = basis.shape[1]
        total, outer = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for _, u in usable(batch, d):
                y = (u - mean) @ basis
                total += y.sum(0)
                outer += y.T @ y
        values = np.r_[total, outer.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], names=["place", "value"])

    return run


def projected_covariance(vectors: DataFrame, n: int, mean: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The covariance (divisor n) of all vectors on a basis; partial sums meet in one aggregation of k + k * k rows."""
    k = basis.shape[1]
    rows = vectors.mapInArrow(_grams(len(mean), mean, basis), "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect()
    found = np.zeros(k + k * k)
    for r in rows:
        found[r.place] = r.value
    off = found[:k] / n
    c = found[k:].reshape(k, k) / n - np.outer(off, off)
    return (c + c.T) / 2


def _whitened(d: int, n: int, sums: list[int], mean: np.ndarray, basis: np.ndarray):
    total = np.array(sums, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, u in usable(batch, d):
                x = u.astype(np.int64) + SHIFT
                most = max(abs(n * int(x.max()) - min(sums)), abs(n * int(x.min()) - max(sums)))
                if d * most * most < 1 << 63 and n * int(np.abs(x).max()) < 1 << 63:
                    deviation = ((n * x - total.astype(np.int64)) ** 2).sum(1).tolist()
                else:  # exact beyond 64 bits; null where a long can't hold it
                    deviation = [v if v < 1 << 63 else None for v in ((n * x.astype(object) - total) ** 2).sum(1)]
                y = (u - mean) @ basis
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1]), pa.int32()), pa.array(y.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(deviation, pa.int64()), lists], names=["vec_id", "deviation", "y"])

    return run


def whiten(table: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row for each vector and component: the columns of RESULT.

    Null vectors, and those with null, not finite or too large entries (2^46 and more, whose x no double holds exactly), are
    left out; so are empty ones and those of another length than most (of equally common lengths the longest stays). Null
    ids stay. Repeated rows count each. Components without variance (RANK) have no rows, so one vector, or copies of one,
    give none; nor do no vectors. Other columns are not read.
    """
    spark = table.sparkSession
    vectors = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    n, sums = fit_list(vectors)
    d = len(sums)
    empty = spark.createDataFrame([], RESULT)
    if not n:
        return empty
    mean = np.array([(s - n * SHIFT) / n for s in sums])  # Python's division of integers is rounded once
    basis = np.linalg.qr(spectrum(vectors, d).vectors)[0]
    inner, turn = np.linalg.eigh(projected_covariance(vectors, n, mean, basis))
    order = np.argsort(-inner, kind="stable")
    values, basis = inner[order], (basis @ turn)[:, order]
    trace = float(values.sum())
    kept = int((values[:components] > max(values[0], 0) * RANK).sum()) if trace > 0 else 0
    if not kept:
        return empty
    scaled = basis[:, :kept] / np.sqrt(values[:kept])
    error = float(np.abs(projected_covariance(vectors, n, mean, scaled) - np.eye(kept)).max())
    out = vectors.mapInArrow(_whitened(d, n, sums, mean, scaled), "vec_id long, deviation long, y array<double>")
    share = F.array(*(F.lit(float(v / trace)) for v in values[:kept]))
    rows = out.select("vec_id", "deviation", F.posexplode("y").alias("place", "whitened"))
    return rows.select("vec_id", (F.col("place") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("place")).alias("explained"), F.lit(error).alias("identity_error"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings on their first components."""
    return whiten(read(spark, sf_dir, "embeddings"))
