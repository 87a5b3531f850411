"""Attribution for linear scorers (A30, M15) and permutation importance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import round6


def linear_attribution_ranking(df: DataFrame, coefs: dict) -> DataFrame:
    """Mean |w * (x - mean(x))| per feature, ranked (one aggregate, long form).

    For a linear model this is the exact per-row attribution averaged."""
    means = df.agg(*[F.avg(c).alias(c) for c in coefs]).first().asDict()
    wide = df.agg(*[F.avg(F.abs(F.lit(float(w)) * (F.col(c) - F.lit(means[c])))).alias(c)
                    for c, w in coefs.items()])
    long = wide.unpivot([], list(coefs), "feature", "mean_abs_attribution")
    # A window over one row per feature: bounded by the feature list.
    return long.select("feature", round6(F.col("mean_abs_attribution")).alias("mean_abs_attribution"),
                       F.row_number().over(Window.orderBy(F.desc("mean_abs_attribution"))).alias("rank"))


def root_causes(df: DataFrame, coefs: dict, means: dict, k: int = 5) -> DataFrame:
    """Top-k {feature, value, importance} per row for a linear model,
    importance = |w * (x - mean)|; a per-row array sort, no shuffle."""
    items = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"),
                               F.abs(F.lit(float(w)) * (F.col(c) - F.lit(float(means[c])))).alias("importance"))
                      for c, w in coefs.items()])
    ranked = F.array_sort(items, lambda a, b: F.when(a["importance"] > b["importance"], -1)
                          .when(a["importance"] < b["importance"], 1).otherwise(0))
    return df.withColumn("root_causes", F.slice(ranked, 1, k))


def global_importance_causes(df: DataFrame, importance: dict, k: int = 5) -> DataFrame:
    """M15 fallback for tree models: the same top-k global features for every row."""
    top = sorted(importance.items(), key=lambda kv: -kv[1])[:k]
    arr = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value"),
                             F.lit(float(v)).alias("importance")) for f, v in top])
    return df.withColumn("root_causes", arr)
