"""Skew-safe ordered frames: exact row positions inside a key, with hot keys split.

A ``Window.partitionBy(machine)`` keeps each machine in one task, so a machine
holding a third of all rows would become a third of the job in one task.  The
plan here splits such hot keys into contiguous sub-ranges of the order column:

1. An exact count per key finds the keys above ``chunk_rows``; quantiles of the whole order
   tuple (so that equal times are split by the columns after it) give the boundaries of
   their sub-ranges.  They come from rows picked by a hash of the tuple, ``PICKS`` a
   sub-range: boundaries decide the split alone, never a result.  Keys that are not hot keep a
   single sub-range (0).
2. Keys and boundaries are a written table that is joined (null-safe: rows without a key
   are a key of their own), so the assignment is the same in every retry and no key
   becomes a literal of the plan.
3. ``row_number`` inside (key, _sub) plus an exclusive prefix sum of the
   sub-range counts (a small table: one row per key and sub-range) gives the
   exact position ``_rn`` inside the key.
4. Rows in the last ``halo`` positions before a later sub-range's start are
   copied into that sub-range with ``_halo = true``, so any row frame reaching
   at most ``halo`` rows back is exact inside (key, _sub).

Cumulative features carry across sub-ranges through per-(key, _sub) summaries
(:func:`carry`).  With no hot key the plan is one shuffle on the key, as a
plain window would be, into as many tasks as the rows need.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

DEFAULT_CHUNK_ROWS = 2_000_000
#: Rows of a task, about: a task sorts its rows several times over, so its memory follows their number, whatever the
#: size of the table.
TASK_ROWS = 250_000
#: Rows of a hot key that are looked at for each of its sub-ranges.
PICKS = 64
#: A split table up to this many boundaries is broadcast; a larger one is joined by a shuffle.
BROADCAST_BOUNDS = 1_000_000


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` with NULL equal to NULL; the right side's keys are dropped."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"_r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])


def plan_splits(df: DataFrame, key: str, order: list[str] | str, chunk_rows: int) -> DataFrame | None:
    """The split table (key, _bounds) of the keys above ``chunk_rows``: ascending first tuples of the
    order columns of their sub-ranges.  None when no key is hot."""
    return plan_tasks(df, key, order, chunk_rows)[0]


def plan_tasks(df: DataFrame, key: str, order: list[str] | str, chunk_rows: int) -> tuple[DataFrame | None, int]:
    """The split table, if any, and the number of tasks for the rows, from one count per key."""
    order = [order] if isinstance(order, str) else order
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    top = sizes.agg(F.sum("_n").alias("rows"), F.max("_n").alias("most"), F.count_if(F.col("_n") > chunk_rows).alias("keys")).first()
    tasks = max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-(top["rows"] or 0) // TASK_ROWS))
    if not top["keys"]:
        return None, tasks
    hot = sizes.filter(F.col("_n") > chunk_rows)
    parts = int(math.ceil(top["most"] / chunk_rows))
    every = max(1, chunk_rows // PICKS)
    picked = df.select(key, F.struct(*order).alias("_v")).filter(F.pmod(F.xxhash64(*order), F.lit(every)) == 0)
    picked = null_safe_join(picked, hot.select(key), [key], "left_semi")
    # About ``PICKS`` tuples for each sub-range of the key; each sub-range takes as many.
    many = max(1, chunk_rows // every)
    taken = F.filter(F.array_sort(F.array_agg("_v")), lambda v, i: (i > 0) & (i % many == 0))
    bounds = picked.groupBy(key).agg(F.array_distinct(taken).alias("_bounds")).filter(F.size("_bounds") > 0)
    path = scratch_path(df.sparkSession, f"splits/{uuid.uuid4().hex}")
    bounds.write.parquet(path)
    table = df.sparkSession.read.schema(bounds.schema).parquet(path)
    return (F.broadcast(table) if top["keys"] * parts <= BROADCAST_BOUNDS else table), tasks


@dataclass
class Ordered:
    """A DataFrame with ``_sub``, ``_rn`` and ``_halo`` (split: ``_hot`` too) plus its window spec."""
    df: DataFrame
    key: str
    order: list[str]
    halo: int
    split: bool

    @property
    def w(self):
        return Window.partitionBy(self.key, "_sub").orderBy("_rn")

    def frame(self, lo, hi):
        return self.w.rowsBetween(lo, hi)

    def body(self, df: DataFrame | None = None) -> DataFrame:
        """Drop halo copies and helper columns."""
        d = self.df if df is None else df
        return d.filter(~F.col("_halo"))


def ordered(df: DataFrame, key: str, order: list[str], halo: int = 0,
            chunk_rows: int = DEFAULT_CHUNK_ROWS) -> Ordered:
    """Attach exact positions inside ``key`` (1-based ``_rn``) and halo copies."""
    splits, tasks = plan_tasks(df, key, order, chunk_rows)
    order_cols = [F.col(c).asc_nulls_first() for c in order]
    if splits is None:
        w = Window.partitionBy(key).orderBy(*order_cols)
        out = df.repartition(tasks, key).withColumn("_sub", F.lit(0)).withColumn("_rn", F.row_number().over(w)) \
            .withColumn("_halo", F.lit(False))
        return Ordered(out, key, order, halo, False)

    here = F.struct(*order)
    reached = F.size(F.filter("_bounds", lambda b: b <= here))
    d = null_safe_join(df, splits, [key], "left")
    d = d.withColumn("_sub", F.when(F.col("_bounds").isNull(), 0).otherwise(reached).cast("int"))
    d = d.withColumn("_hot", F.col("_bounds").isNotNull()).drop("_bounds").repartition(tasks, key, "_sub")
    wl = Window.partitionBy(key, "_sub").orderBy(*order_cols)
    d = d.withColumn("_lrn", F.row_number().over(wl))
    counts = d.groupBy(key, "_sub").agg(F.count(F.lit(1)).alias("_n"))
    wk = Window.partitionBy(key).orderBy("_sub")
    offs = counts.withColumn("_off", F.coalesce(F.sum("_n").over(wk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # Starts of all sub-ranges of the key (bounded: one entry per sub-range).
    starts = offs.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(
        (F.col("_off") + 1).alias("s"), F.col("_sub").alias("j")))).alias("_starts"))
    offs = null_safe_join(offs, starts, [key])
    d = null_safe_join(d, offs.select(key, "_sub", "_off", "_starts"), [key, "_sub"])
    d = d.withColumn("_rn", F.col("_off") + F.col("_lrn"))
    rn = F.col("_rn")
    targets = F.transform(F.filter("_starts", lambda s: (s["s"] > rn) & (s["s"] <= rn + halo)),
                          lambda s: F.struct(s["j"].alias("j"), F.lit(True).alias("h")))
    own = F.array(F.struct(F.col("_sub").alias("j"), F.lit(False).alias("h")))
    d = d.withColumn("_t", F.explode(F.concat(own, targets) if halo > 0 else own))
    d = d.withColumn("_sub", F.col("_t.j")).withColumn("_halo", F.col("_t.h")) \
        .drop("_t", "_lrn", "_off", "_starts").repartition(tasks, key, "_sub")
    return Ordered(d, key, order, halo, True)


def carry(o: Ordered, df: DataFrame, specs: dict) -> DataFrame:
    """Join per-(key, _sub) carries computed over the non-halo rows.

    ``specs``: name -> (summary aggregate Column, kind, output default) where kind is
    ``sum_before`` (sum of earlier sub-ranges), ``last_before`` (last non-null of
    earlier sub-ranges), ``first_after`` (first non-null of later sub-ranges),
    ``min_after`` (min of later sub-ranges) or ``key`` (over the whole key).
    Without splits the carries are constants (no earlier/later sub-range) except
    ``key`` aggregates, which are computed per key.
    """
    if not specs:
        return df
    if not o.split:
        # One sub-range per key: nothing before or after it; key aggregates are
        # windows on the partitioning the features already use (no extra shuffle).
        whole = Window.partitionBy(o.key, "_sub")
        cols = []
        for n, (a, kind, default) in specs.items():
            if kind == "key":
                c = a.over(whole)
            elif kind == "sum_before":
                c = F.lit(default)
            else:
                c = F.lit(None)
            cols.append(c.alias(f"_c_{n}"))
        return df.select("*", *cols)
    base = o.body(df)
    summ = base.groupBy(o.key, "_sub").agg(*[a.alias(f"_s_{n}") for n, (a, _, _) in specs.items()])
    wk = Window.partitionBy(o.key).orderBy("_sub")
    before = wk.rowsBetween(Window.unboundedPreceding, -1)
    after = wk.rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy(o.key)
    cols = []
    for n, (_, kind, default) in specs.items():
        s = F.col(f"_s_{n}")
        if kind == "sum_before":
            c = F.coalesce(F.sum(s).over(before), F.lit(default))
        elif kind == "last_before":
            c = F.last(s, ignorenulls=True).over(before)
        elif kind == "first_after":
            c = F.first(s, ignorenulls=True).over(after)
        elif kind == "min_after":
            c = F.min(s).over(after)
        elif kind == "key":
            c = F.max(s).over(whole) if default == "max" else F.min(s).over(whole)
        else:
            raise ValueError(kind)
        cols.append(c.alias(f"_c_{n}"))
    summ = summ.select(o.key, "_sub", *cols)
    return null_safe_join(df, summ, [o.key, "_sub"], "left")
