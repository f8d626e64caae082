"""Whitening of embeddings by an incremental eigendecomposition.

The fit list is each distinct vector of whole components once. Its scatter matrix is never formed by summing products over
the corpus first: every task takes its rows one by one and keeps (count, mean, eigenvectors, eigenvalues) of the scatter so
far. A row x changes it by one centred rank-one update, n / (n + 1) * (x - mean)(x - mean)^T. In the eigenbasis that is a
diagonal matrix plus rho * z z^T, whose eigenvalues are the roots of the secular equation 1 + rho * sum(z_i^2 / (d_i - t)) = 0,
one between each two neighbours of d. Components with a negligible z_i, and all but one of equal d_i after a rotation, are deflated:
they stay as they are. The eigenvectors come from z recomputed out of the roots found, which keeps them orthogonal.

Spectra of two tasks are combined by successive rank-one updates too: one with each eigenvector of the other, scaled by its
eigenvalue, and one with the difference of the means. A tree of groups of `FAN` spectra does that, so no task holds more.

Last comes a distributed Rayleigh-Ritz step: all rows are projected on the basis found, the small matrix of the projections'
covariance is summed up over the tasks, and its eigenvectors turn the basis to double precision. One more pass
over the fit list measures how far the whitened covariance is from the identity.

Only numbers and matrices of the vector length pass the driver. Equal rows meet in Spark's aggregate, which counts them before the
shuffle, so a vector that a third of all rows hold is no hot key.

Defined results: a vector that is null, empty, or holds a null, NaN or infinite component takes no part. Shorter vectors are
filled up with zeros before they are scaled. Repeated rows, and rows with a null id, each get their results; equal vectors count once in the
fit. Components without spread (eigenvalue not above RANK_TOLERANCE of the largest) cannot be whitened and are
left out, so a table of one distinct vector, and an empty table, give an empty result. A deviation beyond 64 bits is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .vectors import bounds, floored, lists, matrix, usable

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Spectra that one task combines, and rows of the fit list that one task takes, about.
FAN, TASK_ROWS = 8, 4_096
RANK_TOLERANCE = 1e-12
#: Rows whose projections a task holds at a time.
STRIPE = 8_192
_EPS = np.finfo(float).eps
_STEPS = 70


def secular_roots(d: np.ndarray, z2: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum(z2 / (d - t)) for ascending distinct d: (index of the nearest d, distance from it).

    The root above d[i] is counted from the end of its interval that lies nearer, so that its distance has full relative
    precision. All roots are sought at once: each step solves a model with the two poles beside the root, and halves
    the bracket where the model leads out of it.
    """
    k = len(d)
    at = np.arange(k)
    gap = np.append(d[1:], d[-1] + rho * z2.sum()) - d
    middle = (d[None, :] - d[:, None]) - (gap / 2)[:, None]
    # a positive value in the middle: the root lies in the lower half
    lower = 1 + rho * (z2 / middle).sum(axis=1) >= 0
    lower[-1] = True
    origin = np.where(lower, at, np.minimum(at + 1, k - 1))
    apart = d[None, :] - d[origin][:, None]
    lo = np.where(lower, 0.0, -gap / 2)
    hi = np.where(lower, np.where(at == k - 1, gap, gap / 2), 0.0)
    mu = (lo + hi) / 2
    left = np.tri(k, dtype=bool)
    after = np.minimum(at + 1, k - 1)
    with np.errstate(all="ignore"):
        for _ in range(_STEPS):
            away = apart - mu[:, None]
            share = z2 / away
            value = 1 + rho * share.sum(axis=1)
            open_roots = np.abs(value) > 16 * _EPS * (1 + rho * np.abs(share).sum(axis=1))
            if not open_roots.any():
                break
            share /= away
            slope = rho * share.sum(axis=1)
            slope_left = rho * np.where(left, share, 0.0).sum(axis=1)
            up = value < 0
            lo, hi = np.where(up, mu, lo), np.where(up, hi, mu)
            one, two = away[at, at], away[at, after]
            a = (one + two) * value - one * two * slope
            b = one * two * value
            c = value - one * slope_left - two * (slope - slope_left)
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            step[-1] = one[-1] + one[-1] ** 2 * slope[-1] / (value[-1] - one[-1] * slope[-1])
            new = mu + step
            new = np.where((new > lo) & (new < hi), new, (lo + hi) / 2)
            still = np.abs(new - mu) > 4 * _EPS * np.abs(new)
            mu = np.where(open_roots, new, mu)
            if not (still & open_roots).any():
                break
    least = np.maximum(gap, np.abs(d).max() * _EPS) * _EPS**2 + np.finfo(float).tiny
    return origin, np.where(lower, np.maximum(mu, least), np.minimum(mu, -least))


class Spectrum:
    """Count, mean and eigendecomposition of the scatter matrix of the rows seen so far."""

    def __init__(self, width: int):
        self.n, self.mean = 0, np.zeros(width)
        self.values, self.basis = np.zeros(width), np.eye(width)

    def add(self, row: np.ndarray) -> None:
        """One more row."""
        away = row - self.mean
        if self.n:
            self.update(away, self.n / (self.n + 1))
        self.n += 1
        self.mean = self.mean + away / self.n

    def merge(self, other: Spectrum) -> None:
        """All rows of another spectrum: a rank-one update for each of its eigenvectors and one for the means."""
        if not other.n:
            return
        both = self.n + other.n
        away = other.mean - self.mean
        if self.n:
            for value, vector in zip(other.values, other.basis.T, strict=True):
                if value > 0:
                    self.update(vector, value)
            self.update(away, self.n * other.n / both)
        else:
            self.values, self.basis = other.values.copy(), other.basis.copy()
        self.mean = self.mean + away * (other.n / both)
        self.n = both

    def update(self, vector: np.ndarray, rho: float) -> None:
        """The scatter plus rho * vector vector^T."""
        length = float(np.linalg.norm(vector))
        if rho <= 0 or length == 0:
            return
        rho, z = rho * length * length, self.basis.T @ (vector / length)
        d, basis = self.values, self.basis
        tolerance = 8 * _EPS * max(float(np.abs(d).max()), rho)
        live = np.flatnonzero(rho * np.abs(z) > tolerance)
        if not len(live):
            return
        # of values that are equal but for rounding, a rotation leaves one with a z
        close = d[live[1:]] - d[live[:-1]] <= tolerance
        if close.any():
            basis, z, d = basis.copy(), z.copy(), d.copy()
            for a, b in zip(live[:-1][close], live[1:][close], strict=True):
                r = np.hypot(z[a], z[b])
                c, s = z[b] / r, z[a] / r
                basis[:, [a, b]] = basis[:, [a, b]] @ np.array([[c, s], [-s, c]])
                z[a], z[b] = 0.0, r
                d[a], d[b] = c * c * d[a] + s * s * d[b], s * s * d[a] + c * c * d[b]
            live = np.flatnonzero(rho * np.abs(z) > tolerance)
        p, q = d[live], z[live]
        if len(live) == 1:
            values = d.copy()
            values[live] = p + rho * q * q
        else:
            origin, mu = secular_roots(p, q * q, rho)
            # p_j - root_i, exact in the distance from the root's origin
            apart = (p[None, :] - p[origin][:, None]) - mu[:, None]
            below = p[:, None] - p[None, :]
            # z recomputed so that these roots are exact: products over the other values
            ratio = -apart / np.where(below == 0, 1.0, below).T
            np.fill_diagonal(ratio, 1.0)
            squares = np.abs(np.prod(np.abs(ratio), axis=0) * np.diagonal(apart)) / rho
            exact = np.sqrt(squares) * np.sign(q)
            turn = exact[None, :] / apart
            turn /= np.linalg.norm(turn, axis=1, keepdims=True)
            basis, values = basis.copy(), d.copy()
            basis[:, live] = basis[:, live] @ turn.T
            values[live] = p[origin] + mu
        order = np.argsort(values, kind="stable")
        self.values, self.basis = values[order], basis[:, order]


def _pack(spectra: list[Spectrum]) -> dict[str, pa.Array]:
    width = len(spectra[0].mean) if spectra else 0
    flat = lambda rows: lists(np.array(rows).reshape(len(spectra), -1))
    if not width:
        return {"rows": pa.array([], pa.int64()), **{c: pa.array([], pa.list_(pa.float64())) for c in ("mean", "values", "basis")}}
    return {
        "rows": pa.array([s.n for s in spectra], pa.int64()), "mean": flat([s.mean for s in spectra]),
        "values": flat([s.values for s in spectra]), "basis": flat([s.basis for s in spectra]),
    }


_SPECTRUM = "node long, rows long, mean array<double>, values array<double>, basis array<double>"


def _unpack(n, mean, values, basis) -> Spectrum:
    out = Spectrum(len(mean))
    out.n, out.mean, out.values, out.basis = n, np.array(mean), np.array(values), np.array(basis).reshape(len(mean), -1)
    return out


def _of_task(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        spectrum = Spectrum(width)
        for batch in batches:
            for row in matrix(batch["x"], width).astype(np.float64) - SHIFT:
                spectrum.add(row)
        if spectrum.n:
            yield pa.RecordBatch.from_pydict({"node": pa.array([TaskContext.get().partitionId()], pa.int64()), **_pack([spectrum])})

    return run


def _combined(t: pa.Table) -> pa.Table:
    t = t.sort_by("node")
    columns = [t[c].to_pylist() for c in ("rows", "mean", "values", "basis")]
    total = None
    for own in zip(*columns, strict=True):
        if total is None:
            total = _unpack(*own)
        else:
            total.merge(_unpack(*own))
    return pa.table({"node": pa.array([t["node"][0].as_py() // FAN], pa.int64()), **_pack([total])})


def incremental_spectrum(fit: DataFrame, width: int) -> Spectrum:
    """The spectrum of all rows `x`, less SHIFT: one for each task, combined in a tree."""
    each = stored(fit.mapInArrow(_of_task(width), _SPECTRUM), "spectra")
    left = each.agg(F.max("node")).first()[0]
    while left:
        each = stored(each.groupBy(F.floor(F.col("node") / FAN).alias("__up")).applyInArrow(_combined, _SPECTRUM), "spectra")
        left //= FAN
    return _unpack(*each.select("rows", "mean", "values", "basis").first())


def _away(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exact."""
    if n * (int(np.abs(x).max(initial=0)) + 1) + int(np.abs(sums).max()) < 2**62:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums.astype(object)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return _away(x, n, sums).astype(np.float64) / n


def _moments(width: int, n: int, sums: np.ndarray, basis: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sum of y y^T over a task's rows, y the centred row in the basis."""
        total = np.zeros((basis.shape[1], basis.shape[1]))
        for batch in batches:
            for i in range(0, len(batch), STRIPE):
                y = _centred(matrix(batch["x"].slice(i, STRIPE), width), n, sums) @ basis
                total += y.T @ y
        yield pa.RecordBatch.from_pydict({"row": pa.array(range(len(total)), pa.int32()), "m": lists(total)})

    return run


def covariance_in(fit: DataFrame, width: int, n: int, sums: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Covariance of the fit list's rows projected on `basis`, added up over the tasks."""
    size = basis.shape[1]
    parts = fit.mapInArrow(_moments(width, n, sums, basis), "row int, m array<double>")
    rows = parts.groupBy("row").agg(F.array(*[F.sum(F.col("m")[i]) for i in range(size)]).alias("m")).collect()
    out = np.zeros((size, size))
    for r in rows:
        out[r.row] = r.m
    return (out + out.T) / (2 * n)


def _projected(width: int, n: int, sums: np.ndarray, axes: np.ndarray, explained: np.ndarray, error: float):
    k = axes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), STRIPE):
                rows = batch.slice(i, STRIPE)
                away = _away(matrix(rows["x"], width), n, sums)
                if away.dtype != object and int(np.abs(away).max(initial=0)) ** 2 * width >= 2**63:
                    away = away.astype(object)
                squares = (away * away).sum(axis=1)
                squares = [int(s) if s < 2**63 else None for s in squares] if away.dtype == object else squares
                w = (away.astype(np.float64) / n) @ axes
                repeated = pa.array(np.repeat(np.arange(len(rows)), k))
                yield pa.RecordBatch.from_pydict({
                    "vec_id": rows["vec_id"].take(repeated), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                    "n": pa.array(np.full(len(rows) * k, n)), "deviation": pa.array(squares, pa.int64()).take(repeated),
                    "whitened": pa.array(w.reshape(-1)), "explained": pa.array(np.tile(explained, len(rows))),
                    "identity_error": pa.array(np.full(len(rows) * k, error)),
                })

    return run


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Per usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)[id_column]
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    each = vectors.select(F.col(id_column).alias("vec_id"), F.col(column).alias("c")).filter(usable("c"))
    count, width = bounds(each, "c")
    if not count:
        return spark.createDataFrame([], schema)
    filled = F.concat(floored("c", SCALE), F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("c")))
    whole = stored(each.select("vec_id", F.transform(filled, lambda c: c + F.lit(SHIFT)).alias("x")), "vectors")
    tasks = -(-count // TASK_ROWS)
    fit = stored(whole.select("x").distinct().repartition(tasks, "x"), "fit")
    at = fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).collect()
    n, sums = at[0].n, np.zeros(width, object)
    for r in at:
        sums[r.i] = int(r.s)
    spectrum = incremental_spectrum(fit.repartition(tasks, "x"), width)
    # Rayleigh-Ritz on the whole basis, the largest values first
    basis = np.linalg.qr(spectrum.basis[:, ::-1])[0]
    values, turn = np.linalg.eigh(covariance_in(fit, width, n, sums, basis))
    values, axes = values[::-1], (basis @ turn)[:, ::-1]
    trace = float(values.sum())
    k = int((values > max(values[0], 0.0) * RANK_TOLERANCE).sum()) if values[0] > 0 else 0
    k = min(k, components)
    if not k:
        return spark.createDataFrame([], schema)
    scaled = axes[:, :k] / np.sqrt(values[:k])
    error = float(np.abs(covariance_in(fit, width, n, sums, scaled) - np.eye(k)).max())
    return whole.mapInArrow(_projected(width, n, sums, scaled, values[:k] / trace, error), schema)
