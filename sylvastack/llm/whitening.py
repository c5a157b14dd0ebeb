"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

Vectors are taken as whole numbers x = floor(1024 c) + 100000. Sums and scatter are sums of whole numbers, so they are exact
and do not depend on how rows are dealt out or on tasks that ran twice: a first pass gives n and S, a second one the
scatter about the whole number nearest to the mean, and what is left of the centring is taken off exactly. The factor R of
the scatter (scatter = R' R) is rotated from the right until its columns are orthogonal; then they are eigenvectors, and
their lengths the square roots of the eigenvalues.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024.0, 100_000
#: Entries beyond count as this number: sums of products of so large ones still fit a decimal of 38 digits.
LARGEST = float(1 << 53)
#: Components that are returned at most.
COMPONENTS = 8
#: Rows that a task handles at once.
ROWS = 4_096


@dataclass
class Spectrum:
    """Eigenvalues of the covariance by falling size, unit eigenvectors as columns, trace, n, the sums S and the whole number nearest to S / n."""

    values: np.ndarray
    vectors: np.ndarray
    trace: float
    n: int
    sums: list[int]
    centre: np.ndarray


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(factor, order): ``a[order][:, order]`` = factor @ factor.T with a lower trapezoidal factor, largest remaining diagonal first; as many columns as the rank."""
    a = a.copy()
    d = len(a)
    order, factor = np.arange(d), np.zeros((d, d))
    least = d * np.finfo(float).eps * max(a.diagonal().max(initial=0.0), 0.0)
    for k in range(d):
        p = k + int(np.argmax(a.diagonal()[k:]))
        if a[p, p] <= least:
            return factor[:, :k], order
        for x in (a, factor):
            x[[k, p]] = x[[p, k]]
        a[:, [k, p]] = a[:, [p, k]]
        order[[k, p]] = order[[p, k]]
        factor[k, k] = np.sqrt(a[k, k])
        factor[k + 1 :, k] = a[k + 1 :, k] / factor[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return factor, order


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The factor's columns, rotated in pairs until each two of them are orthogonal to machine precision.

    A sweep meets every pair once, in rounds of pairs that share no column, so a round is a few array operations.
    """
    g = factor.T.copy()
    r = len(g)
    players = list(range(r + r % 2))  # an odd one sits out a round
    small = len(factor) * np.finfo(float).eps
    for _ in range(sweeps):
        turned = False
        for _ in range(len(players) - 1 if r > 1 else 0):
            half = len(players) // 2
            pairs = [(a, b) for a, b in zip(players[:half], reversed(players[half:])) if a < r and b < r]
            players = [players[0], players[-1], *players[1:-1]]
            i, j = (np.array(x) for x in zip(*pairs))
            x, y = g[i], g[j]
            xx, yy, xy = (x * x).sum(axis=1), (y * y).sum(axis=1), (x * y).sum(axis=1)
            off = np.abs(xy) > small * np.sqrt(xx * yy)
            if not off.any():
                continue
            turned = True
            i, j, x, y = i[off], j[off], x[off], y[off]
            zeta = (yy[off] - xx[off]) / (2 * xy[off])
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            s = c * t
            g[i], g[j] = c[:, None] * x - s[:, None] * y, s[:, None] * x + c[:, None] * y
        if not turned:
            return g.T
    raise RuntimeError("the rotations did not settle")


def spectrum(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of a symmetric matrix without negative eigenvalues: the positive ones by falling size. The largest entry of each vector is positive."""
    factor, order = pivoted_cholesky(scatter)
    if not factor.size:
        return np.zeros(0), np.zeros((len(scatter), 0))
    g = one_sided_jacobi(factor)
    lengths = np.sqrt((g * g).sum(axis=0))
    by = np.argsort(-lengths, kind="stable")
    vectors = np.empty_like(g[:, by])
    vectors[order] = g[:, by] / lengths[by]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return lengths[by] ** 2, vectors * signs


def whole_numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows, x): the rows whose vector is neither null nor empty and holds finite numbers only, and those as a matrix of whole numbers."""
    sizes = np.diff(column.offsets.to_numpy())
    sizes[column.is_null().to_numpy(zero_copy_only=False)] = 0
    rows = np.flatnonzero(sizes)
    if len(np.unique(sizes[rows])) > 1:
        raise ValueError("vectors of different sizes")
    x = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), int(sizes[rows].max(initial=0)))
    finite = np.isfinite(x).all(axis=1)
    return rows[finite], np.clip(np.floor(SCALE * x[finite]) + SHIFT, -LARGEST, LARGEST).astype(np.int64)


def exact_products(y: np.ndarray) -> np.ndarray:
    """y' y in whole numbers: by doubles where no sum can leave their 53 bits, else by numbers of any length."""
    most = int(np.abs(y).max(initial=0))
    if most * most * max(1, len(y)) < 1 << 53:
        return (y.astype(np.float64).T @ y.astype(np.float64)).astype(np.int64)
    return y.astype(object).T @ y.astype(object)


def fit(vectors: DataFrame, vector_col: str = "embedding") -> Spectrum | None:
    """The spectrum of the covariance of all vectors that take part; None if none does.

    Two passes; a task returns its sums only, d + 1 and then d (d + 1) / 2 whole numbers for vectors of d entries, and
    those totals are all that reaches the driver.
    """
    rows = vectors.select(F.col(vector_col).alias("v"))
    total = "i int, j int, s decimal(38,0)"

    def table(i, j, s) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([int(x) for x in s], pa.decimal128(38, 0))], ["i", "j", "s"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                x = whole_numbers(batch.column(0).slice(lo, ROWS))[1]
                if len(x):
                    yield x

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, 0
        for x in blocks(batches):
            n, s = n + len(x), s + x.sum(axis=0, dtype=object)
        if n:
            yield table([-1, *range(len(s))], [len(s)] * (len(s) + 1), [n, *s])  # j has the size

    of = {(r.i, r.j): int(r.s) for r in rows.mapInArrow(sums, total).groupBy("i", "j").agg(F.sum("s").alias("s")).collect()}
    if not of:
        return None
    if len({j for _, j in of}) > 1:
        raise ValueError("vectors of different sizes")
    d = next(j for _, j in of)
    n, s = of[-1, d], [of[i, d] for i in range(d)]
    centre = np.array([(2 * x + n) // (2 * n) for x in s], np.int64)
    at = np.triu_indices(d)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for x in blocks(batches):
            one = exact_products(x - centre)[at].astype(object)
            held = one if held is None else held + one
        if held is not None:
            yield table(*at, held)

    scatter, rest = np.zeros((d, d)), [x - n * int(c) for x, c in zip(s, centre)]
    for r in rows.mapInArrow(products, total).groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        scatter[r.i, r.j] = scatter[r.j, r.i] = float(Fraction(n * int(r.s) - rest[r.i] * rest[r.j], n * n))  # the covariance, rounded once
    values, columns = spectrum(scatter)
    return Spectrum(values, columns, float(scatter.trace()), n, s, centre)


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): for each vector its first ``components`` whitened coordinates.

    Vectors that are null or empty, or hold null or non-finite numbers, take no part; all others count as often as they
    stand there, whatever their id, null ids included. deviation, decimal(38,0): the exact sum over dimensions of
    (n x - S)^2; null if it has more digits. Only components with a positive eigenvalue are returned: equal vectors, or a
    single one, give no row, as does an empty table. Entries whose x is beyond 2^53 count as 2^53. Vectors of different
    sizes are refused. Equal eigenvalues keep the order of the factor's columns. Other columns are not read. The
    identity_error is taken from the whitened rows themselves, in a pass of its own, and is one number for all rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    kind = rows.schema["id"].dataType.simpleString()
    model = fit(vectors, vector_col)
    out = f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    k = min(components, len(model.values)) if model else 0
    if not k:
        return spark.createDataFrame([], out)
    turn = model.vectors[:, :k] / np.sqrt(model.values[:k])
    n, centre = model.n, model.centre
    rest = np.array([x - n * int(c) for x, c in zip(model.sums, centre)], object)  # S - n centre, within n / 2
    mean = np.array([float(Fraction(int(x), n)) for x in rest])

    def coordinates(x: np.ndarray) -> np.ndarray:
        return ((x - centre) - mean) @ turn

    def deviations(x: np.ndarray) -> list[int | None]:
        y = x - centre
        most = int(np.abs(y).max(initial=0))
        kind_ = np.int64 if (n * (most + 1)) ** 2 * y.shape[1] < 1 << 63 else object
        z = y.astype(kind_) * n - rest.astype(kind_)
        return [v if v < 10**38 else None for v in map(int, (z * z).sum(axis=1))]

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                x = whole_numbers(batch.column(0).slice(lo, ROWS))[1]
                if len(x):
                    w = coordinates(x)
                    total += np.vstack([w.sum(axis=0), w.T @ w])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k + 1), k)), pa.array(np.tile(np.arange(k), k + 1)), pa.array(total.ravel())], ["i", "j", "s"])

    held = np.zeros((k + 1, k))
    for r in rows.select("v").mapInArrow(moments, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        held[r.i, r.j] = r.s
    error = float(np.abs(held[1:] / n - np.outer(held[0] / n, held[0] / n) - np.eye(k)).max())

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                at, x = whole_numbers(part["v"])
                if not len(at):
                    continue
                each = np.repeat(np.arange(len(at)), k)
                deviation = pa.array(deviations(x), pa.decimal128(38, 0)).take(pa.array(each))
                component = pa.array(np.tile(np.arange(1, k + 1), len(at)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part["id"].take(pa.array(at[each])), component, deviation, pa.array(coordinates(x).ravel())], ["id", "component", "deviation", "whitened"])

    found = rows.mapInArrow(placed, f"id {kind}, component int, deviation decimal(38,0), whitened double")
    share = F.element_at(F.array(*(F.lit(float(v / model.trace)) for v in model.values[:k])), F.col("component"))
    return found.select("id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))
