"""Whitening of embeddings with a polarisation covariance.

Every entry c becomes the integer x = floor(1024 c) + 100000. All sums over rows
are exact integers: values are centred at each dimension's mean, rounded to an
integer, and squares are aggregated for every dimension and for the sum of every
pair of dimensions. With the mean's rounding taken out exactly, their differences

    2 cov(i, j) = var(x_i + x_j) - var(x_i) - var(x_j)

recover all cross-covariances, which are assembled for ``eigh``. A task emits
one row per pair of dimensions, whatever its number of vectors.

Vectors of another length are another fit list, whitened apart.

Defined results: rows whose vector is null or holds null or non-finite entries
are dropped; an entry whose integer leaves the range of 60 bits is held at its
end; a null vec_id and repeated rows are kept; a vector without entries has no
components. A component without variance (relative to the largest, 1e-12) has a
null ``whitened`` and is left out of ``identity_error``; ``explained`` is null if
nothing varies. ``deviation`` is null where the exact sum, which is always in
``deviation_exact``, does not fit a long. Extra columns are ignored, an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm.common import cut, table

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
#: Eigenvalues below this part of the largest are no variance.
FLAT = 1e-12
_EDGE = float(1 << 60)
#: Rows squared at once, and the size up to which their sums stay in 64 bits.
_ROWS = 1024
_SMALL = 1 << 25
#: Exact sums travel as limbs of this many bits.
_LIMB, _LIMBS = 40, 5
_LIMB_COLS = ", ".join(f"l{k} long" for k in range(_LIMBS))


def _vectors(b: pa.RecordBatch, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, integers) of the batch's usable vectors, by vector length."""
    col = b.column(k)
    ends = np.cumsum(np.concatenate(([0], np.nan_to_num(col.value_lengths().to_numpy(zero_copy_only=False)))))
    ends = ends.astype(np.int64)
    flat = col.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null entries become NaN
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    size = np.diff(ends)
    good = (bad[ends[1:]] == bad[ends[:-1]]) & ~col.is_null().to_numpy(zero_copy_only=False) & (size > 0)
    for d in np.unique(size[good]).tolist():
        rows = np.flatnonzero(good & (size == d))
        x = np.floor(values[ends[rows][:, None] + np.arange(d)] * SCALE) + SHIFT
        yield rows, np.clip(x, -_EDGE, _EDGE).astype(np.int64)


def _limbs(v: int) -> list[int]:
    """Signed limbs: their sums stay in a long over a million tasks."""
    sign, v = (-1, -v) if v < 0 else (1, v)
    return [sign * (v >> _LIMB * k & (1 << _LIMB) - 1) for k in range(_LIMBS)]


def _total(row) -> int:
    return sum(int(row[f"l{k}"]) << _LIMB * k for k in range(_LIMBS))


def _exact_sums(a: np.ndarray) -> list[int]:
    """Column sums as Python integers."""
    high = a >> 31  # both halves of a block sum without overflow
    return [(int(h) << 31) + int(lo) for h, lo in zip(high.sum(axis=0), (a - (high << 31)).sum(axis=0))]


def _square_sums(y: np.ndarray) -> list[int]:
    """Column sums of y*y, exact."""
    if not len(y) or int(np.abs(y).max()) <= _SMALL:  # 2**50 a square, 1024 rows
        return (y * y).sum(axis=0).tolist()
    o = y.astype(object)
    return [int(v) for v in (o * o).sum(axis=0)]


def _summed(df: DataFrame, *keys: str) -> DataFrame:
    return cut(df.groupBy(*keys).agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(_LIMBS)]))


def dimension_sums(vectors: DataFrame) -> DataFrame:
    """d (vector length), i, exact sum over the rows; i = -1 holds their number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[int]] = {}
        for b in batches:
            for rows, x in _vectors(b, 0):
                have = sums.setdefault(x.shape[1], [0] * (x.shape[1] + 1))
                for i, s in enumerate(_exact_sums(x)):
                    have[i] += s
                have[-1] += len(rows)
        out = [(d, i if i < d else -1, *_limbs(v)) for d, s in sums.items() for i, v in enumerate(s)]
        yield _rows(out, ["d", "i"])
    return _summed(vectors.mapInArrow(run, f"d int, i int, {_LIMB_COLS}"), "d", "i")


def _rows(out: list[tuple], keys: list[str]) -> pa.RecordBatch:
    cols = list(zip(*out)) or [()] * (len(keys) + _LIMBS)
    return pa.RecordBatch.from_arrays(
        [*[pa.array(c, pa.int32()) for c in cols[:len(keys)]], *[pa.array(c, pa.int64()) for c in cols[len(keys):]]],
        names=[*keys, *[f"l{k}" for k in range(_LIMBS)]])


def pair_squares(vectors: DataFrame, centre: dict[int, np.ndarray]) -> DataFrame:
    """d, i, j, exact sum over the rows of (u_i + u_j)**2, and of u_i**2 for
    i = j, where u is x less the integer ``centre``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[list[int]]] = {}
        for b in batches:
            for _, x in _vectors(b, 0):
                d = x.shape[1]
                have = sums.setdefault(d, [[0] * (d - i) for i in range(d)])
                u = x - centre[d]
                for lo in range(0, len(u), _ROWS):
                    part = u[lo:lo + _ROWS]
                    for i in range(d):
                        pair = part[:, i:] + part[:, i:i + 1]
                        pair[:, 0] = part[:, i]
                        mine = have[i]
                        for j, s in enumerate(_square_sums(pair)):
                            mine[j] += s
        yield _rows([(d, i, i + j, *_limbs(v)) for d, s in sums.items() for i, m in enumerate(s)
                     for j, v in enumerate(m)], ["d", "i", "j"])
    return _summed(vectors.mapInArrow(run, f"d int, i int, j int, {_LIMB_COLS}"), "d", "i", "j")


def covariance(n: int, delta: list[int], squares: dict[tuple[int, int], int]) -> np.ndarray:
    """The covariance matrix from the squares. ``delta`` is n times the centre
    less the sum of each dimension: n u + delta is n x less the sum."""
    d = len(delta)

    def var(i: int, j: int) -> int:  # sum over the rows of (n x - S)**2, or of that of the pair's sum
        shift = delta[i] + (delta[j] if j != i else 0)
        return n * n * squares[i, j] - n * shift * shift

    own = [var(i, i) for i in range(d)]
    v = np.zeros((d, d))
    for i in range(d):
        v[i, i] = own[i] / n ** 3
        for j in range(i + 1, d):
            v[i, j] = v[j, i] = (var(i, j) - own[i] - own[j]) / (2 * n ** 3)
    return v


class Fit:
    """Mean, directions and shares of one fit list."""

    def __init__(self, n: int, sums: list[int], centre: np.ndarray, squares: dict[tuple[int, int], int], top: int):
        self.n, self.sums, self.centre = n, sums, centre
        self.delta = [n * int(m) - s for m, s in zip(centre, sums)]
        v = covariance(n, self.delta, squares)
        e, w = np.linalg.eigh(v)
        e, w = e[::-1][:top], w[:, ::-1][:, :top]
        trace = float(np.trace(v))
        self.varies = e > FLAT * max(float(e[0]), 0.0) if trace > 0 else np.zeros(len(e), dtype=bool)
        self.directions = w / np.sqrt(np.where(self.varies, e, 1.0))
        self.explained = [float(x) / trace if trace > 0 else None for x in np.maximum(e, 0)]

    def whiten(self, x: np.ndarray) -> np.ndarray:
        centred = (x - self.centre) + np.array([k / self.n for k in self.delta])
        return centred @ self.directions

    def deviation(self, x: np.ndarray) -> list[int]:
        u = x - self.centre
        largest = self.n * (int(np.abs(u).max(initial=0)) + 1)  # |n u + delta| stays under it
        if largest ** 2 * x.shape[1] < 1 << 63:
            y = u * self.n + np.array(self.delta, dtype=np.int64)
            return (y * y).sum(axis=1).tolist()
        y = u.astype(object) * self.n + np.array(self.delta, dtype=object)
        return [int(v) for v in (y * y).sum(axis=1)]


def fit_lists(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """A fit per vector length, from two passes over the vectors."""
    found: dict[int, dict[int, int]] = {}
    for r in dimension_sums(vectors).collect():  # one row per dimension
        found.setdefault(r["d"], {})[r["i"]] = _total(r)
    count = {d: s[-1] for d, s in found.items()}
    sums = {d: [s[i] for i in range(d)] for d, s in found.items()}
    centre = {d: np.array([(2 * s + count[d]) // (2 * count[d]) for s in sums[d]], dtype=np.int64) for d in sums}
    squares: dict[int, dict[tuple[int, int], int]] = {d: {} for d in sums}
    if sums:
        for r in pair_squares(vectors, centre).toLocalIterator():  # one row per pair of dimensions
            squares[r["d"]][r["i"], r["j"]] = _total(r)
    return {d: Fit(count[d], sums[d], centre[d], squares[d], components) for d in sums}


def identity_errors(vectors: DataFrame, fits: dict[int, Fit]) -> dict[int, float | None]:
    """Largest entry of the whitened values' covariance less the identity,
    over the components that vary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products: dict[int, np.ndarray] = {}
        for b in batches:
            for _, x in _vectors(b, 0):
                fit = fits[x.shape[1]]
                w = fit.whiten(x)[:, fit.varies]
                w = np.concatenate((w, np.ones((len(w), 1))), axis=1)  # the last column sums the values
                products[x.shape[1]] = products.get(x.shape[1], 0) + w.T @ w
        out = [(d, i, j, float(v)) for d, p in products.items() for (i, j), v in np.ndenumerate(p)]
        cols = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int32()) for c in cols[:3]], pa.array(cols[3], pa.float64())],
                                         names=["d", "i", "j", "v"])
    summed = vectors.mapInArrow(run, "d int, i int, j int, v double").groupBy("d", "i", "j").agg(F.sum("v").alias("v"))
    found: dict[int, dict] = {}
    for r in summed.collect():  # at most 81 rows per vector length
        found.setdefault(r["d"], {})[r["i"], r["j"]] = r["v"]
    out: dict[int, float | None] = {}
    for d, fit in fits.items():
        k = int(fit.varies.sum())
        if not k:
            out[d] = None
            continue
        p = np.array([[found[d][i, j] for j in range(k + 1)] for i in range(k + 1)]) / fit.n
        out[d] = float(np.abs(p[:k, :k] - np.outer(p[:k, k], p[:k, k]) - np.eye(k)).max())
    return out


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error,
    deviation_exact: a row for every kept row of ``df`` and component."""
    vectors = df.select(df[vector_col].alias("vector"))
    fits = fit_lists(vectors, components)
    errors = identity_errors(vectors, fits) if fits else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, x in _vectors(b, 1):
                fit = fits[x.shape[1]]
                k = fit.directions.shape[1]
                w = fit.whiten(x)
                flat = np.tile(~fit.varies, len(rows))
                deviation = fit.deviation(x)
                short = [v if v < 1 << 63 else None for v in deviation]
                many = np.repeat(np.arange(len(rows)), k)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows)).take(pa.array(many)),
                     pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                     pa.array(np.full(len(many), fit.n)), pa.array(short, pa.int64()).take(pa.array(many)),
                     pa.array(w.ravel(), mask=flat), pa.array(fit.explained * len(rows), pa.float64()),
                     pa.array([errors[x.shape[1]]] * len(many), pa.float64()),
                     pa.array([str(v) for v in deviation]).take(pa.array(many))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error",
                           "deviation_exact"])
    return df.select(df[id_col].cast("long").alias("vec_id"), df[vector_col].alias("vector")).mapInArrow(
        run, "vec_id long, component int, n long, deviation long, whitened double, explained double, "
             "identity_error double, deviation_exact string")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
