"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi.

Every entry c becomes the long x = floor(1024 * c) + 100000.  The covariance of x over all
usable vectors is factored as P L L' P' by Cholesky with diagonal pivoting, and the columns of the
triangular factor L are rotated until they are orthogonal (one-sided Jacobi).  The squared column
norms are then the eigenvalues of the covariance and the normalised columns its eigenvectors; no
product of L with itself is formed again, so small eigenvalues keep their relative accuracy.

The scatter is exact.  z = x - floor(mean) is a long, and the remaining shift r / n (r the
remainder of the sum) is taken off in whole numbers: n^2 V = n * sum(z z') - r r'.  So sums don't
depend on the order of rows or on retries, and nothing cancels that wasn't centred first.  The
factorisation runs in numpy's long double, so that one far outlier doesn't drown the rest.

Scale: two narrow passes for sums and scatter; a task gives d (d + 1) / 2 numbers per
Arrow batch, added up by Spark.  The driver holds one d x d matrix (d: the dimension of the
vectors, not their number).  Whitened rows are written once; their own mean and
covariance are aggregated from the written table.

Defined results: vectors that are null, hold null or non-finite entries, or entries of 2^52 and
more (no exact long) take no part; neither do vectors of another length than most of the usable
ones (ties: the longer; length 0 counts as unusable).  Null ids stay null, repeated rows and
equal ids stay rows of their own and count each.  Components without variance (beyond the rank of
the factor) give no row, so a single vector gives none.  ``deviation`` is null where it
doesn't fit a long.  An empty table gives no rows.  Other columns are not read, so their names
can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

SCALE, SHIFT = 1024, 100_000
LIMIT = float(1 << 52)
COMPONENTS = 8
_EXACT = 1 << 53
_SWEEPS = 60


@dataclass
class Whitening:
    """``components``: unit rows; ``mean_floor`` + ``rest`` / ``n`` is the mean."""

    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def floor(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        return np.array([s % self.n for s in self.sums], np.int64)


# --- factorisation -------------------------------------------------------------------

def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, L), in long double: v[order][:, order] = L L' with falling pivots; L has as many columns as the rank."""
    d = len(v)
    a, order = v.astype(np.longdouble), np.arange(d)
    low = np.zeros_like(a)
    least = 8 * d * np.finfo(v.dtype).eps * a.diagonal()  # what is left below this share of a variance is rounding
    rank = 0
    for k in range(d):
        left = a.diagonal()[k:]
        p = k + int(np.argmax(np.where(left > least[order[k:]], left, 0.0)))
        if not a[p, p] > least[order[p]]:
            break
        swap = [p, k]
        a[[k, p]], order[[k, p]], low[[k, p]] = a[swap], order[swap], low[swap]
        a[:, [k, p]] = a[:, swap]
        low[k, k] = np.sqrt(a[k, k])
        low[k + 1:, k] = a[k + 1:, k] / low[k, k]
        a[k + 1:, k + 1:] -= np.outer(low[k + 1:, k], low[k + 1:, k])
        rank = k + 1
    return order, low[:, :rank]


def one_sided_jacobi(low: np.ndarray) -> np.ndarray:
    """The columns of ``low`` rotated in pairs until all are orthogonal.  A round rotates disjoint
    pairs together (round-robin order), so each is a few array operations."""
    u = np.array(low, order="F")
    m = u.shape[1]
    if m < 2:
        return u
    players = list(range(m)) + ([-1] if m % 2 else [])
    half = len(players) // 2
    for _ in range(_SWEEPS):
        worst = 0.0
        for _ in range(len(players) - 1):
            pairs = [(a, b) for a, b in zip(players[:half], reversed(players[half:]), strict=True) if a >= 0 and b >= 0]
            i, j = np.array(pairs).T
            x, y = u[:, i], u[:, j]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            size = np.sqrt(xx * yy)
            off = np.divide(np.abs(xy), size, out=np.zeros_like(size), where=size > 0)
            worst = max(worst, float(off.max(initial=0.0)))
            turn = off > 0
            zeta = np.divide(yy - xx, 2 * xy, out=np.zeros_like(xy), where=turn)
            t = np.where(turn, np.copysign(1, zeta) / (np.abs(zeta) + np.hypot(1, zeta)), 0)
            c = 1 / np.hypot(1, t)
            s = c * t
            u[:, i], u[:, j] = c * x - s * y, s * x + c * y
            players = [players[0], players[-1], *players[1:-1]]
        if worst <= 4 * np.finfo(u.dtype).eps:
            break
    return u


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as rows) of a covariance, by falling eigenvalue; as many as its rank."""
    order, low = pivoted_cholesky(v)
    u = one_sided_jacobi(low)
    norms = np.sqrt((u * u).sum(0))
    fall = np.argsort(-norms, kind="stable")
    rows = np.empty_like(u)
    rows[order] = u
    return (norms[fall] ** 2).astype(float), (rows / norms)[:, fall].T.astype(float)


# --- passes over the vectors ------------------------------------------------------------

def _longs(column: pa.Array, d: int) -> np.ndarray:
    """x of every vector of an Arrow list column without nulls, one row each."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
    return np.floor(SCALE * values).astype(np.int64) + SHIFT


def usable(vectors: Column) -> Column:
    """No null vector, entry, non-finite entry (NaN is above every number here) or entry beyond an exact long."""
    each = F.forall(vectors, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(LIMIT)))
    return F.coalesce(vectors.isNotNull() & (F.size(vectors) > 0) & each, F.lit(False))


def _sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _longs(b.column(0), d)
                total = [Decimal(int(s)) for s in (x.sum(0) if np.abs(x).max() < _EXACT // len(x) else x.astype(object).sum(0))]
                yield pa.RecordBatch.from_pydict({"i": pa.array(range(d), pa.int32()), "s": pa.array(total, pa.decimal128(38, 0)),
                                                  "n": pa.array([len(x)] * d, pa.int64())})

    found = rows.select("v").mapInArrow(run, "i int, s decimal(38,0), n long").groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    found = sorted(found.collect())  # d rows
    return (found[0].n, [int(r.s) for r in found]) if found else (0, [])


def _scatter(rows: DataFrame, d: int, floor: np.ndarray) -> list[list[int]]:
    """The exact sum of z z' over all rows, z = x - floor: the upper triangle by rows."""
    upper = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            z = _longs(b.column(0), d) - floor
            if float(np.abs(z).max()) ** 2 * len(z) < _EXACT:  # then every product and sum is a whole double
                f = z.astype(np.float64)
                products = (f.T @ f)[upper].astype(np.int64).tolist()
            else:
                o = z.astype(object)
                products = o.T.dot(o)[upper].tolist()
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(products)), pa.int32()),
                                              "s": pa.array([Decimal(int(p)) for p in products], pa.decimal128(38, 0))})

    found = rows.select("v").mapInArrow(run, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s"))
    flat = {r.i: int(r.s) for r in found.collect()}  # d (d + 1) / 2 numbers
    out = [[0] * d for _ in range(d)]
    for k, (i, j) in enumerate(zip(*(x.tolist() for x in upper), strict=True)):
        out[i][j] = out[j][i] = flat[k]
    return out


def common_length(rows: DataFrame) -> int:
    """The length of most vectors (``v``); ties: the longer; 0 of an empty table."""
    top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return top.d if top else 0


def _long_double(x: int) -> np.longdouble:
    high = float(x)
    return np.longdouble(high) + np.longdouble(float(x - int(high)))


def fit(rows: DataFrame, d: int) -> Whitening | None:
    """The whitening of the vectors ``v``, all of length ``d``; None without any."""
    n, sums = _sums(rows, d)
    if not n:
        return None
    z = _scatter(rows, d, np.array([s // n for s in sums], np.int64))
    r = [s % n for s in sums]
    # Whole numbers up to the one division.
    v = np.array([[_long_double(n * z[i][j] - r[i] * r[j]) / _long_double(n * n) for j in range(d)] for i in range(d)])
    values, vectors = eigen(v)
    return Whitening(n, sums, values, vectors, float(v.trace()))


def _whitened(rows: DataFrame, w: Whitening, k: int) -> DataFrame:
    """Rows (id, deviation, w: array of the first k whitened values)."""
    d, n, floor, rest = len(w.sums), w.n, w.floor, w.rest
    project = (w.components[:k] / np.sqrt(w.eigenvalues[:k, None])).T
    top = (1 << 63) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = _longs(b.column(1), d) - floor
            if b.num_rows and (float(np.abs(z).max()) * n + n) ** 2 * d < float(1 << 62):
                deviation = ((n * z - rest) ** 2).sum(1).tolist()
            else:
                exact = ((n * z.astype(object) - rest.astype(object)) ** 2).sum(1) if b.num_rows else []
                deviation = [int(e) if e <= top else None for e in exact]
            values = (z - rest / n) @ project
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(z) + 1) * k, k), pa.int32()), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(deviation, pa.int64()), lists], ["id", "deviation", "w"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "v").mapInArrow(run, f"id {kind}, deviation long, w array<double>")


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows (id, component, n, deviation, whitened, explained, identity_error): every usable vector
    centred and projected on up to ``components`` leading components, each of unit variance."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).filter(usable(F.col("v")))
    d = common_length(rows)
    rows = rows.filter(F.size("v") == d)
    w = fit(rows, d) if d else None
    k = min(components, len(w.eigenvalues)) if w else 0
    kind = vectors.schema[id_col].dataType.simpleString()
    if not k:
        return spark.createDataFrame([], f"{id_col} {kind}, component int, n long, deviation long, whitened double, "
                                         "explained double, identity_error double")
    done = stage(_whitened(rows, w, k), "whitened")
    value = [F.col("w")[i] for i in range(k)]
    mean = done.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(value)]).first()
    centred = [c - F.lit(mean[i]) for i, c in enumerate(value)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    cov = done.agg(*[F.avg(centred[i] * centred[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(cov[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    explained = F.array(*[F.lit(float(e / w.trace)) for e in w.eigenvalues[:k]])
    each = done.select("id", "deviation", F.posexplode("w").alias("i", "whitened"))
    return each.select(F.col("id").alias(id_col), (F.col("i") + 1).cast("int").alias("component"), F.lit(w.n).cast("long").alias("n"),
                       "deviation", "whitened", explained[F.col("i")].alias("explained"), F.lit(float(error)).alias("identity_error"))
