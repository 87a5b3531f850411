"""Exact profiles of numeric columns: moments and linearly interpolated quantiles.

Values are reduced to counts per distinct value in one scan, and quantiles are picked from
running sums of the counts, so no task holds all distinct values of a column.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prefix import running_sums
from .sequence import null_safe_join

QUARTILES = [0.25, 0.5, 0.75]
#: Rows looked at, about, to guess between which values a quantile lies; the guess decides the work, never a result.
GUESS_ROWS = 400_000
#: Rows of one lot of values that a task sorts at a time.
LOT_ROWS = 100_000


def value_table(df: DataFrame, columns: list[str], by: str | None = None) -> DataFrame:
    """Rows (g: struct(by, column), value, n, total_n, cum_n): one per distinct non-null value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]))
    key = F.col(by) if by else F.lit(0)
    counts = df.select(key.alias("by"), pairs.alias("p")).filter("p.value is not null").groupBy(
        F.struct("by", F.col("p.column").alias("column")).alias("g"), F.col("p.value").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return running_sums(counts, "value", ["n"], group="g", totals=True)


def profile_of(table: DataFrame, qs: list[float]) -> DataFrame:
    """Per group of a value table: n, mean, std (sample), std_pop, min, max and the quantiles q."""
    v, n, total, cum = (F.col(c) for c in ("value", "n", "total_n", "cum_n"))
    means = table.groupBy("g").agg((F.sum(n * v) / F.sum(n)).alias("mean"))
    rows = null_safe_join(table, means, ["g"])

    def at(rank):
        """The value of a rank (from 0) in ascending order."""
        return F.min(F.when(cum > rank, v))

    ranks = [(total - 1) * F.lit(q) for q in qs]
    ends = [x for i, r in enumerate(ranks) for x in (at(F.floor(r)).alias(f"lo{i}"), at(F.ceil(r)).alias(f"hi{i}"))]
    out = rows.groupBy("g").agg(F.max(total).alias("n"), F.max("mean").alias("mean"), F.sum(n * (v - F.col("mean")) ** 2).alias("m2"),
                                F.min(v).alias("min"), F.max(v).alias("max"), *ends)
    part = [(F.col("n") - 1) * F.lit(q) - F.floor((F.col("n") - 1) * F.lit(q)) for q in qs]
    q = F.array(*[F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * p for i, p in enumerate(part)])
    return out.select("g.by", "g.column", "n", "mean", F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).alias("std"),
                      F.sqrt(F.col("m2") / F.col("n")).alias("std_pop"), "min", "max", q.alias("q"))


def profile(df: DataFrame, columns: list[str], qs: list[float] = QUARTILES, by: str | None = None) -> DataFrame:
    """Rows (by, column, n, mean, std, std_pop, min, max, q).  Without ``by`` every column has a row, one
    without values with n = 0."""
    out = profile_of(value_table(df, columns, by), qs)
    if by:
        return out
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    return names.join(out.drop("by"), "column", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def lots(batches, rows: int = LOT_ROWS):
    """Arrow batches joined to tables of about ``rows`` rows."""
    import pyarrow as pa
    held, many = [], 0
    for b in batches:
        held.append(b)
        many += b.num_rows
        if many >= rows:
            yield pa.Table.from_batches(held)
            held, many = [], 0
    if many:
        yield pa.Table.from_batches(held)


def _brackets(df: DataFrame, columns: list[str], qs: list[float]) -> list[list[tuple[float, float]]]:
    """Per column, disjoint ascending ranges of values in which its quantiles are likely to lie, from about
    ``GUESS_ROWS`` rows."""
    rows = df.count()
    every = max(1, rows // GUESS_ROWS)
    few = df.filter(F.monotonically_increasing_id() % every == 0)
    picked = max(min(rows, GUESS_ROWS), 1)
    near = [5 * math.sqrt(q * (1 - q) / picked) + 2e-4 + 2 / picked for q in qs]
    ends = [min(max(p, 0.0), 1.0) for q, d in zip(qs, near) for p in (q - d, q + d)]
    got = few.agg(*[F.percentile_approx(F.col(c).cast("double"), ends, 10_000).alias(c) for c in columns]).first()
    out = []
    for v in got:
        merged: list[tuple[float, float]] = []
        for lo, hi in sorted((lo, hi) for lo, hi in zip((v or [])[::2], (v or [])[1::2]) if lo <= hi < math.inf and lo > -math.inf):
            if merged and lo <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(hi, merged[-1][1]))
            else:
                merged.append((lo, hi))
        out.append(merged)
    return out


def exact_quantiles(df: DataFrame, columns: list[str], qs: list[float]) -> dict[str, list[float] | None]:
    """Linearly interpolated quantiles, those of :func:`profile`, without a row for every distinct value.

    Values between the ranges of :func:`_brackets` only count; those inside are reduced to counts per distinct value.
    Columns with a quantile outside its range get theirs from :func:`profile`."""
    brackets = _brackets(df, columns, qs)

    def counts(batches):
        import numpy as np
        import pyarrow as pa
        for t in lots(batches):
            out = []
            for i, ranges in enumerate(brackets):
                x = t.column(i).drop_null().to_numpy() + 0.0  # -0.0 counts as 0.0
                lo, hi = (np.array([r[k] for r in ranges], "float64") for k in (0, 1))
                at = np.searchsorted(lo, x, side="right")  # ranges that begin at or before x
                inside = x <= np.concatenate([[-np.inf], hi])[at]
                if not len(lo):
                    inside[:] = False
                u, n = np.unique(x[inside], return_counts=True)
                between = np.bincount(at[~inside], minlength=len(lo) + 1)
                # A gap stands as the first number after the range before it; any value of the gap is as large at least.
                gaps = np.concatenate([[np.nextafter(lo[0], -np.inf) if len(lo) else 0.0], np.nextafter(hi, np.inf)])
                full = between > 0
                out.append((np.full(len(u) + full.sum(), i, "int32"), np.concatenate([u, gaps[full]]),
                            np.arange(len(u) + full.sum()) < len(u), np.concatenate([n, between[full]])))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)) for a in zip(*out)], ["i", "value", "known", "n"])

    values = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    table = values.mapInArrow(counts, "i int, value double, known boolean, n long").groupBy("i", "value", "known").agg(F.sum("n").alias("n"))
    table = running_sums(table, "value", ["n"], group="i", totals=True)

    def at(rank):
        return F.min(F.when(F.col("cum_n") > rank, F.struct("value", "known")))

    ranks = [(F.col("total_n") - 1) * F.lit(q) for q in qs]
    ends = table.groupBy("i").agg(F.max("total_n").alias("n"), *[x for k, r in enumerate(ranks)
                                  for x in (at(F.floor(r)).alias(f"lo{k}"), at(F.ceil(r)).alias(f"hi{k}"))])
    found: dict[str, list[float] | None] = {}
    for r in ends.collect():  # one row a column
        pairs = [(r[f"lo{k}"], r[f"hi{k}"]) for k in range(len(qs))]
        if all(lo["known"] and hi["known"] for lo, hi in pairs):
            rest = [(r["n"] - 1) * q - math.floor((r["n"] - 1) * q) for q in qs]
            found[columns[r["i"]]] = [lo["value"] + (hi["value"] - lo["value"]) * p for (lo, hi), p in zip(pairs, rest)]
    missed = [c for c in columns if c not in found]
    return found | ({r["column"]: r["q"] for r in profile(df, missed, qs).collect()} if missed else {})
