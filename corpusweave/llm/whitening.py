"""Embedding whitening: leading components by Chebyshev-filtered subspace iteration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - makes pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusweave.llm.common import written
from corpusweave.llm.topk import finite

COMPONENTS = 8
# columns of the iterated block: the wanted ones and a margin that widens the gap
COLUMNS = 32
DEGREE = 8
ROUNDS = 60
SEED = 17
SCALE = 1024
SHIFT = 100_000
# integers of components end here, so that sums of a batch stay long
MOST = 1 << 40
SLICE = 2048
# residual of a certified component, and the smallest eigenvalue taken for one, against the largest
CERTIFIED = 2e-13
RANK = 1e-12


@dataclass
class Fit:
    """Count and exact sums of the integer vectors, trace of the covariance, components as
    columns with their eigenvalues, and the passes over the vectors that they took."""

    n: int
    sums: list[int]
    trace: float
    components: np.ndarray
    eigenvalues: np.ndarray
    passes: int
    residual: float


def _integers(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _scaled(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S without rounding: as long where that holds it, else as Python's integers."""
    most = max(int(np.abs(x).max(initial=0)) * n, max((abs(s) for s in sums.tolist()), default=0))
    return x * n - sums.astype(np.int64) if most < 2**62 else x.astype(object) * n - sums


def _summed(rows: DataFrame, job, width: int) -> np.ndarray:
    """Sum over all rows of what ``job(x)`` gives for a slice of integer rows: each task adds up
    its own, Spark adds the tasks entry by entry; only the sum comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                got = job(_integers(batch.column(0).slice(at, SLICE), width)).ravel()
                total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["at", "value"]
            )

    parts = rows.select("x").mapInArrow(run, "at int, value double")
    sums = parts.groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(sums.num_rows)
    out[sums.column("at").to_numpy()] = sums.column("value").to_numpy()
    return out


def exact_sums(rows: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of rows and the sum of each dimension, exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                x = _integers(batch.column(0).slice(at, SLICE), width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(-1, width)), pa.array(np.concatenate(([len(x)], x.sum(axis=0))))],
                    ["at", "value"],
                )

    parts = rows.select("x").mapInArrow(run, "at long, value long")
    found = parts.groupBy("at").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    sums = {r.at: int(r.value) for r in found.collect()}
    return sums.get(-1, 0), [sums.get(i, 0) for i in range(width)]


def fit(rows: DataFrame, width: int, components: int = COMPONENTS) -> Fit:
    """Leading eigenpairs of the covariance of ``rows(x)``, a written table of integer vectors.

    A random block of 32 columns is iterated.  A pass over the vectors gives
    V Q = (1/n) sum of (x - S/n) ((x - S/n) Q), centred before it is multiplied.
    QR and Rayleigh-Ritz give estimates and residuals; then a Chebyshev
    polynomial of degree 8 over the interval of the unwanted eigenvalues, by its
    three-term recurrence over such passes, damps them and lifts the others.  It
    ends when the wanted residuals are certified: within 2e-13 of the largest
    eigenvalue, or no longer falling within rounding (1e-11).
    """
    n, sums = exact_sums(rows, width)
    known = np.array(sums, object)
    passes = 0

    def centred(x: np.ndarray) -> np.ndarray:
        return (_scaled(x, n, known) / n).astype(np.float64)

    def applied(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def product(x: np.ndarray) -> np.ndarray:
            c = centred(x)
            return c.T @ (c @ q)

        return _summed(rows, product, width).reshape(q.shape) / n

    if not n or not width:
        return Fit(n, sums, 0.0, np.zeros((width, 0)), np.zeros(0), 0, 0.0)
    trace = float(_summed(rows, lambda x: np.array([(centred(x) ** 2).sum()]), width)[0]) / n
    columns = min(width, max(COLUMNS, 2 * components))
    q = np.linalg.qr(np.random.default_rng(SEED).standard_normal((width, columns)))[0]
    vq = applied(q)
    last = np.inf
    for _ in range(ROUNDS):
        # Rayleigh-Ritz in the block
        small = q.T @ vq
        theta, u = np.linalg.eigh((small + small.T) / 2)
        theta, u = theta[::-1], u[:, ::-1]
        q, vq = q @ u, vq @ u
        top = max(theta[0], 0.0)
        wanted = np.flatnonzero(theta[:components] > RANK * top)
        errors = np.linalg.norm(vq - q * theta, axis=0)
        residual = float(errors[wanted].max(initial=0.0)) / top if top > 0 else 0.0
        if residual <= CERTIFIED or (residual <= 1e-11 and residual > last / 2) or columns == width:
            break
        last = residual
        high = theta[-1]
        if high <= RANK * top:  # the block holds the whole range of the covariance
            q = np.linalg.qr(vq / np.maximum(np.linalg.norm(vq, axis=0), np.finfo(float).tiny))[0]
        else:
            # the unwanted part; a covariance has no eigenvalue below 0
            low = max(0.0, high - 2 * float(np.linalg.norm(vq - q * theta, 2)))
            half, mid = (high - low) / 2, (high + low) / 2
            first = sigma = half / (top - mid)
            before, now = q, (vq - mid * q) * (sigma / half)
            for _ in range(DEGREE - 1):
                following = 1 / (2 / first - sigma)
                step = (applied(now) - mid * now) * (2 * following / half)
                before, now, sigma = now, step - sigma * following * before, following
            q = np.linalg.qr(now / np.linalg.norm(now, axis=0))[0]
        vq = applied(q)
    else:
        raise ArithmeticError(f"components not certified: residual {residual:.1e}")
    return Fit(n, sums, trace, q[:, wanted], theta[wanted], passes, residual)


def whitened(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """Vectors projected on the leading components of their covariance, at unit variance.

    An entry c counts as the integer floor(1024 c) + 100000, c as double (at most
    2**40 either way).  The fit is on all vectors; the components are those of
    :func:`fit`, a column of any sign.  A last pass measures the whitened
    covariance against the identity.

    Returns a row per vector and component up to ``components``: ``vec_id,
    component`` (from 1, by falling eigenvalue), ``n, deviation`` (sum of
    (n x - S)**2, exact; null where a long can't hold it), ``whitened, explained``
    (eigenvalue by trace), ``identity_error``.  Vectors that are null or hold null or
    non-finite entries, and vectors of another length than the most frequent
    one (of equally frequent ones the longer), take no part.  A covariance of
    lower rank has fewer components: those with no variance (within 1e-12 of
    the largest) are left out, so one vector, or equal ones, give no row.  Rows
    that repeat an id, or a vector, are rows like others; a null id stays.  Other
    columns are not looked at, whatever their names.
    """
    entry = lambda c: F.greatest(
        F.least(F.floor(c.cast("double") * SCALE).cast("long"), F.lit(MOST)), F.lit(-MOST)
    ) + F.lit(SHIFT).cast("long")
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    rows = rows.where(finite(F.col("vector"))).select("vec_id", F.transform("vector", entry).alias("x"))
    rows = written(rows)
    common = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    width = common.width if common else 0
    rows = rows.where(F.size("x") == width)
    found = fit(rows, width, components)
    n, sums, basis = found.n, np.array(found.sums, object), found.components / np.sqrt(found.eigenvalues)
    k = basis.shape[1]

    def projected(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        scaled = _scaled(x, n, sums)
        return scaled, (scaled / n).astype(np.float64) @ basis

    def moments(x: np.ndarray) -> np.ndarray:
        w = np.column_stack((projected(x)[1], np.ones(len(x))))
        return w.T @ w

    error = 0.0
    if k:
        seen = _summed(rows, moments, width).reshape(k + 1, k + 1) / n
        mean = seen[k, :k]
        error = float(np.abs(seen[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())
    explained = found.eigenvalues / found.trace if k else np.zeros(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows if k else 0, SLICE):
                part = batch.slice(at, SLICE)
                scaled, w = projected(_integers(part.column(1), width))
                rough = (scaled.astype(np.float64) ** 2).sum(axis=1)
                whole = scaled if (rough < 2.0**62).all() else scaled.astype(object)
                deviation = (whole * whole).sum(axis=1)
                held = [int(d) if d < 2**63 else None for d in deviation.tolist()]
                rows_of = np.repeat(np.arange(len(w)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(rows_of)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(w))),
                        pa.array(np.full(len(rows_of), n)),
                        pa.array(held, pa.int64()).take(pa.array(rows_of)),
                        pa.array(w.ravel()),
                        pa.array(np.tile(explained, len(w))),
                        pa.array(np.full(len(rows_of), error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(
        run,
        "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double",
    )
