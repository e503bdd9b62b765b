"""Whitening of embeddings on their leading principal components, found by Chebyshev-filtered subspace iteration.

Every entry c becomes the whole number x = floor(64 c) + 1,000,000. The distinct x-vectors are the fit list, written once; all statistics are
sums over it, made by Spark in partial sums per task: the sums S per dimension exactly in whole numbers, then products VQ with
V = (1/n) sum of (x - S/n)(x - S/n)', centred before anything is multiplied. The block Q has ``components`` + ``guard`` columns. A
Chebyshev polynomial by its three-term recurrence, one distributed product a degree, damps the spectrum below the block's smallest
Ritz value; QR and Rayleigh-Ritz follow, until each wanted pair's residual certifies it (``TOLERANCE`` of the largest eigenvalue). Only
d x block matrices and d sums ever reach the driver, which do not grow with the rows. Where the block spans the whole space, one product is enough.

Defined cases: a vector that is null, empty, or holds a null or non-finite entry takes no part, nor one with an entry of 2^24 or
more in size; vectors of another length than the commonest (ties: the longer) take no part; a null vec_id is kept; repeated rows
share one place in the fit list and are all returned; components without variance (under 1e-13 of the largest) have no rows, so
fewer than two distinct vectors give none; eigenvalues that are equal leave their vectors free up to rotation; a deviation beyond a long is
null; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

C = F.col
COMPONENTS, GUARD, DEGREE, ROUNDS, TOLERANCE = 16, 32, 8, 40, 2e-14
SCALE, SHIFT, LARGEST = 64, 1_000_000, 2.0**24
#: The filter may enlarge the largest wanted direction so much over the smallest before columns are made orthogonal again.
SPREAD = 1e6
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def usable(rows: DataFrame, column: str = "embedding") -> tuple[DataFrame, int]:
    """(rows with a vector that takes part, as double entries, their dimension)."""
    v = C(column).cast("array<double>")
    good = rows.select("vec_id", v.alias("v")).where(C("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False))))
    sizes = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("k")).orderBy(F.desc("k"), F.desc("d")).limit(1).collect()
    d = sizes[0].d if sizes else 0
    return good.where(F.size("v") == d), d


def _whole(column, d: int) -> np.ndarray:
    """x - SHIFT of a batch, as a matrix of long."""
    return np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)).astype(np.int64)


def _coded(d: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            x = _whole(batch.column(0), d).astype("<i4")
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary())], ["x"])

    return run


def _matrix(column, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, d).astype(np.int64)


def _table(columns: list, names: list[str]):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


@dataclass
class Fit:
    """The fit list and what its sums say."""

    rows: DataFrame  # x, d whole numbers of four bytes
    d: int
    n: int = 0
    sums: list[int] | None = None  # of x - SHIFT
    passes: int = 0

    def count(self) -> None:
        d = self.d

        def run(batches: Iterator) -> Iterator:
            n, total = 0, np.zeros(d, np.int64)
            for batch in batches:
                x = _matrix(batch.column(0), d)
                n, total = n + len(x), total + x.sum(0)
            if n:
                yield _table([np.arange(d), np.full(d, n), total], ["i", "n", "s"])

        found = self.rows.mapInArrow(run, "i long, n long, s long").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
        self.n = found[0].n if found else 0
        self.sums = [r.s for r in sorted(found, key=lambda r: r.i)]

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean of x - SHIFT as a whole number and the rest, so that differences lose no digits."""
        whole = [s // self.n for s in self.sums]
        return np.array(whole, np.int64), np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole)])

    def product(self, q: np.ndarray, scale: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(VQ, variance of each dimension); with ``scale`` the covariance of the projections times scale instead of VQ."""
        d, n, (whole, rest) = self.d, self.n, self.centre()
        k = q.shape[1]
        names = [f"c{j}" for j in range(k)]

        def run(batches: Iterator) -> Iterator:
            total, squares, any_row = np.zeros((d if scale is None else k, k)), np.zeros(d), False
            for batch in batches:
                y = (_matrix(batch.column(0), d) - whole) - rest
                z = y @ q
                total += y.T @ z if scale is None else (z * scale).T @ (z * scale)
                squares += (y * y).sum(0)
                any_row = any_row or len(y) > 0
            if any_row:
                yield _table([np.arange(len(total)), squares[: len(total)], *(np.ascontiguousarray(total[:, j]) for j in range(k))], ["i", "ss", *names])

        sums = self.rows.mapInArrow(run, "i long, ss double, " + ", ".join(f"{c} double" for c in names)).groupBy("i").agg(*(F.sum(c).alias(c) for c in ("ss", *names))).collect()
        self.passes += 1
        sums.sort(key=lambda r: r.i)
        return np.array([[r[c] for c in names] for r in sums]) / n, np.array([r.ss for r in sums]) / n


def fit_list(rows: DataFrame, d: int) -> Fit:
    """Distinct x-vectors, repeated ones merged before they travel."""
    fit = Fit(materialize(rows.select("v").mapInArrow(_coded(d), "x binary").distinct(), "fit-list"), d)
    fit.count()
    return fit


def rayleigh_ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(Ritz values falling, their vectors, V times the vectors)."""
    h = q.T @ vq
    e, u = np.linalg.eigh((h + h.T) / 2)
    u = u[:, ::-1]
    return e[::-1], q @ u, vq @ u


def filter_degree(e: np.ndarray, wanted: int, bound: float, most: int) -> int:
    """The highest degree that keeps the filter's growth over the wanted values within ``SPREAD``."""
    x = 2 * e[[0, wanted - 1]] / bound - 1
    if x[1] <= 1:
        return 2
    apart = np.arccosh(x[0]) - np.arccosh(x[1])
    return int(np.clip(np.log(SPREAD) / apart if apart > 0 else most, 2, most))


@dataclass
class Spectrum:
    values: np.ndarray
    vectors: np.ndarray
    residual: float
    trace: float


def leading(fit: Fit, components: int = COMPONENTS, guard: int = GUARD, degree: int = DEGREE, rounds: int = ROUNDS, tolerance: float = TOLERANCE, seed: int = 13) -> Spectrum:
    """The leading eigenpairs of V. Stops when every wanted residual is within ``tolerance`` of the largest value, or no longer falls."""
    d = fit.d
    block = min(d, components + guard)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, block)))[0] if block < d else np.eye(d)
    vq, variances = fit.product(q)
    trace, best = float(variances.sum()), None
    for _ in range(rounds):
        e, q, vq = rayleigh_ritz(q, vq)
        wanted = int(min(components, (e > 1e-13 * max(e[0], 0)).sum()))
        residual = float(np.linalg.norm(vq[:, :wanted] - q[:, :wanted] * e[:wanted], axis=0).max() / e[0]) if wanted else 0.0
        if best is None or residual < best.residual:
            stalled = best is not None and residual > 0.5 * best.residual
            best = Spectrum(e[:wanted], q[:, :wanted], residual, trace)
        else:
            stalled = True
        if block == d or not wanted or residual <= tolerance or stalled and residual <= 1e3 * tolerance:
            break
        bound = max(float(e[-1]), 1e-13 * float(e[0]))
        # scaled recurrence on [0, bound]: y1 = (V/c - 1) q, y_{k+1} = 2 (V/c - 1) y_k - y_{k-1}
        half = bound / 2
        before, now = q, vq / half - q
        for _ in range(filter_degree(e, wanted, bound, degree) - 1):
            before, now = now, 2 * (fit.product(now)[0] / half - now) - before
            size = np.linalg.norm(now, axis=0)
            before, now = before / size, now / size
        q = np.linalg.qr(now)[0]
        vq = fit.product(q)[0]
    return best


def whiten(rows: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> DataFrame:
    """rows (vec_id, ``column``) -> a row per vector that takes part and component: ``OUT``."""
    spark = rows.sparkSession
    good, d = usable(rows, column)
    if not d:
        return spark.createDataFrame([], OUT)
    fit = fit_list(good, d)
    found = leading(fit, components)
    k = len(found.values)
    if not k:
        return spark.createDataFrame([], OUT)
    scale = 1 / np.sqrt(found.values)
    error = float(np.abs(fit.product(found.vectors, scale)[0] - np.eye(k)).max())
    n, sums, (whole, rest) = fit.n, np.array(fit.sums, np.int64), fit.centre()
    vectors, explained = found.vectors, found.values / found.trace

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            x = _whole(batch.column("v"), d)
            w = (((x - whole) - rest) @ vectors) * scale
            apart = n * x - sums
            fits = (apart.astype(float) ** 2).sum(1) < 9e18
            deviation = np.where(fits, (np.where(fits[:, None], apart, 0) ** 2).sum(1), 0)
            m = len(x)
            ids = batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k)))
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), pa.array(np.repeat(deviation, k), mask=np.repeat(~fits, k)),
                pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
            ], [x.split()[0] for x in OUT.split(", ")])

    return good.select(C("vec_id").cast("long").alias("vec_id"), "v").mapInArrow(run, OUT)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
