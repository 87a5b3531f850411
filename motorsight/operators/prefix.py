"""Running sums over a global (or per-group) value order without an
unpartitioned window (SURVEY 4.3 primitive 2).

1. The input is already reduced to one row per distinct (group, value).  It is dealt by
   range of (group, value) and written with its partition number, so what follows reads the
   written table and the input is computed once.
2. Totals per (group, partition) - a table of at most one row per partition and
   group - get their exclusive running offset.
3. A window partitioned by (group, partition), ordered by value, adds the local running
   sum; offset + local = global running sum.

Spark sizes the range partitions, so no task holds a whole group at any size.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .sequence import null_safe_join


def running_sums(df: DataFrame, value: str, sums: list[str], *, group: str | None = None,
                 descending: bool = False, inclusive: bool = True, totals: bool = False) -> DataFrame:
    """Add ``cum_<s>`` for every column in ``sums``: the sum over rows whose value
    comes before (and, if ``inclusive``, equal to) this row's value in the order; with
    ``totals`` also ``total_<s>``, the sum over the group.

    ``df`` must hold one row per distinct (group, value).
    """
    spark = df.sparkSession
    g = group or "_g"
    d = df if group else df.withColumn("_g", F.lit(0))
    order = F.col(value).desc() if descending else F.col(value).asc()
    path = scratch_path(spark, f"running-sums/{uuid.uuid4().hex}")
    d = d.repartitionByRange(F.col(g).asc(), order).withColumn("_part", F.spark_partition_id())
    d.write.parquet(path)
    d = spark.read.schema(d.schema).parquet(path)
    per = d.groupBy(g, "_part").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    before = Window.partitionBy(g).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = [F.sum(f"_t_{s}").over(Window.partitionBy(g)).alias(f"total_{s}") for s in sums] if totals else []
    per = per.select(g, "_part", *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums], *whole)
    frame = Window.partitionBy(g, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    d = null_safe_join(d, per, [g, "_part"])
    return d.select(*df.columns, *([f"total_{s}" for s in sums] if totals else []),
                    *[(F.col(f"_o_{s}") + F.coalesce(F.sum(s).over(frame), F.lit(0))).alias(f"cum_{s}") for s in sums])
