"""Classification metrics on (label, score) tables: A13-A19, A27-A29, M17.

All sums are single-pass aggregates (partial aggregation map-side).  Curve
metrics first reduce to one row per distinct score, then use the bucketed
running-sum primitive, so no window runs over the whole table in one task.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.numeric import bucket_index
from ..session import scratch_path
from .prefix import running_sums


def _div(a: Column, b: Column) -> Column:
    """Zero division -> 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion_counts(df: DataFrame, label: str = "label", pred: str = "pred",
                     by: list[str] = ()) -> DataFrame:
    """TP, FP, FN, TN in one aggregate (optionally per group)."""
    y, p = F.col(label), F.col(pred)
    aggs = [F.sum(F.when((y == 1) & (p == 1), 1).otherwise(0)).cast("long").alias("tp"),
            F.sum(F.when((y == 0) & (p == 1), 1).otherwise(0)).cast("long").alias("fp"),
            F.sum(F.when((y == 1) & (p == 0), 1).otherwise(0)).cast("long").alias("fn"),
            F.sum(F.when((y == 0) & (p == 0), 1).otherwise(0)).cast("long").alias("tn")]
    return df.groupBy(*by).agg(*aggs)


def confusion_matrix(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """Four cells (actual, predicted, count); empty cells are 0."""
    c = confusion_counts(df, label, pred)
    return c.select(F.explode(F.array(
        F.struct(F.lit(0).alias("actual"), F.lit(0).alias("predicted"), F.col("tn").alias("n")),
        F.struct(F.lit(0).alias("actual"), F.lit(1).alias("predicted"), F.col("fp").alias("n")),
        F.struct(F.lit(1).alias("actual"), F.lit(0).alias("predicted"), F.col("fn").alias("n")),
        F.struct(F.lit(1).alias("actual"), F.lit(1).alias("predicted"), F.col("tp").alias("n")),
    )).alias("c")).select("c.*")


def metric_columns(beta: float = fv.FBETA_BETA) -> dict[str, Column]:
    """A14 expressions over tp/fp/fn/tn columns."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    prec = _div(tp, tp + fp)
    rec = _div(tp, tp + fn)
    spec = _div(tn, tn + fp)
    b2 = beta * beta
    return {
        "accuracy": _div(tp + tn, tp + tn + fp + fn),
        "precision": prec,
        "recall": rec,
        "f1": _div(2 * prec * rec, prec + rec),
        "f_beta": _div((1 + b2) * prec * rec, F.lit(b2) * prec + rec),
        "balanced_accuracy": (rec + spec) / 2,
    }


def classification_metrics(df: DataFrame, label="label", pred="pred", by: list[str] = (),
                           beta: float = fv.FBETA_BETA) -> DataFrame:
    return metrics_of(confusion_counts(df, label, pred, by), by, beta)


def metrics_of(counts: DataFrame, by: list[str] = (), beta: float = fv.FBETA_BETA) -> DataFrame:
    """:func:`classification_metrics` from the counts tp, fp, fn, tn."""
    m = metric_columns(beta)
    return counts.select(*by, "tp", "fp", "fn", "tn", *[v.alias(k) for k, v in m.items()])


def score_counts(df: DataFrame, label="label", score="score", by: list[str] = ()) -> DataFrame:
    """One row per distinct (group, score) with positive and negative counts."""
    y = F.col(label)
    return df.groupBy(*by, score).agg(F.sum(F.when(y == 1, 1).otherwise(0)).cast("long").alias("pos"),
                                      F.sum(F.when(y == 1, 0).otherwise(1)).cast("long").alias("neg"))


def auc_by_group(df: DataFrame, group: str, label="label", score="score") -> DataFrame:
    """A15 for many score columns in long form: ROC-AUC with ties (half a pair each) of every ``group``, in one pass."""
    cum = running_sums(score_counts(df, label, score, [group]), score, ["neg"], group=group, inclusive=False)
    won = F.sum(F.col("pos") * (F.col("cum_neg") + F.col("neg") / 2))
    return cum.groupBy(group).agg(_div(won, (F.sum("pos") * F.sum("neg")).cast("double")).alias("roc_auc"))


def curve_points(df: DataFrame, label="label", score="score") -> DataFrame:
    """A16/A17 points per distinct threshold (descending): cumulative TP/FP,
    TPR, FPR, precision, recall, and the previous point's precision/recall."""
    return points_of(score_counts(df, label, score), score)


def points_of(sc: DataFrame, score="score") -> DataFrame:
    """:func:`curve_points` from the counts per distinct score."""
    cum = running_sums(sc, score, ["pos", "neg"], descending=True, totals=True)
    P, N = F.col("total_pos").cast("double"), F.col("total_neg").cast("double")
    tp, fp = F.col("cum_pos").cast("double"), F.col("cum_neg").cast("double")
    tp0, fp0 = tp - F.col("pos"), fp - F.col("neg")
    return cum.select(
        F.col(score).alias("threshold"), "pos", "neg", F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
        _div(tp, P).alias("tpr"), _div(fp, N).alias("fpr"),
        _div(tp, tp + fp).alias("precision"), _div(tp, P).alias("recall"),
        F.when(tp0 + fp0 == 0, F.lit(1.0)).otherwise(tp0 / (tp0 + fp0)).alias("prev_precision"),
        _div(tp0, P).alias("prev_recall"),
        P.alias("P"), N.alias("N"))


def auc_summary(df: DataFrame, label="label", score="score") -> DataFrame:
    """A15, A17, A18 in one row: ROC-AUC with ties (rank sum), trapezoid PR-AUC,
    average precision (step sum).  All scores equal -> ROC-AUC 0.5."""
    return summary_of(curve_points(df, label, score))


def summary_of(pts: DataFrame) -> DataFrame:
    """:func:`auc_summary` from the points of the curve."""
    tp0 = F.col("tp") - F.col("pos")          # positives strictly above this score
    return pts.agg(
        _div(F.sum(F.col("neg") * (tp0 + F.col("pos") / 2.0)), F.first("P") * F.first("N")).alias("roc_auc"),
        F.sum((F.col("recall") - F.col("prev_recall")) * (F.col("precision") + F.col("prev_precision")) / 2.0)
        .alias("pr_auc"),
        F.sum((F.col("recall") - F.col("prev_recall")) * F.col("precision")).alias("average_precision"))


def evaluation(df: DataFrame, label="label", score="score", threshold: float = 0.5, beta: float = fv.FBETA_BETA) -> DataFrame:
    """A14 at ``threshold`` and A15, A17, A18 in one row, from one reading of ``df``: scoring its rows is the main work."""
    y, s = F.col(label), F.col(score)
    sides = F.when(y == 1, "1").when(y == 0, "0").otherwise("other")
    path = scratch_path(df.sparkSession, f"scores/{uuid.uuid4().hex}")
    df.groupBy(s.alias("score"), sides.alias("side")).agg(F.count(F.lit(1)).alias("n")).write.parquet(path)
    counts = df.sparkSession.read.schema("score double, side string, n long").parquet(path)

    def cell(side: str, positive: bool) -> Column:
        at_least = F.col("score") >= threshold
        return F.coalesce(F.sum(F.when((F.col("side") == side) & (at_least if positive else ~at_least), F.col("n"))), F.lit(0))

    c = counts.agg(cell("1", True).alias("tp"), cell("0", True).alias("fp"), cell("1", False).alias("fn"), cell("0", False).alias("tn"))
    m = c.select("tp", "fp", "fn", "tn", *[v.alias(k) for k, v in metric_columns(beta).items()])
    sums = counts.groupBy("score").agg(*[F.sum(F.when(w, F.col("n")).otherwise(0)).alias(k)
                                         for k, w in (("pos", F.col("side") == "1"), ("neg", F.col("side") != "1"))])
    return m.crossJoin(summary_of(points_of(sums, "score")))  # one row each


def threshold_grid(kind: str = "fine") -> list[float]:
    """A27 thresholds as exact decimals: 31 steps 0.20+0.02i, or 11 steps 0.30+0.05i."""
    if kind == "fine":
        return [round(0.20 + 0.02 * i, 2) for i in range(31)]
    return [round(0.30 + 0.05 * i, 2) for i in range(11)]


def threshold_sweep(spark: SparkSession, df: DataFrame, label="label", score="score",
                    grid: list[float] | None = None, beta: float = fv.FBETA_BETA) -> DataFrame:
    """Precision, recall, F1, F-beta for each threshold of a fixed grid.

    Each row is counted once into the bucket k of the highest threshold it
    reaches (one aggregate, at most len(grid)+1 groups).  Suffix sums over that
    table of len(grid)+1 rows give the counts at every threshold; no cross join.
    """
    from pyspark.sql import Window

    grid = grid or threshold_grid()
    s = F.col(score)
    idx = bucket_index(s, sorted(grid), strict=False)     # thresholds reached: t <= s
    y = F.col(label)
    b = df.groupBy(idx.alias("k")).agg(F.sum(F.when(y == 1, 1).otherwise(0)).cast("long").alias("pos"),
                                       F.sum(F.when(y == 1, 0).otherwise(1)).cast("long").alias("neg"))
    keys = spark.createDataFrame([(i, float(grid[i - 1]) if i else None) for i in range(len(grid) + 1)],
                                 "k int, threshold double")
    full = keys.join(F.broadcast(b), "k", "left").fillna(0, ["pos", "neg"])
    # A window over len(grid)+1 rows: bounded by the grid, not by the data.
    suffix = Window.orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    c = full.select("k", "threshold", F.sum("pos").over(suffix).alias("tp"), F.sum("neg").over(suffix).alias("fp"),
                    F.sum("pos").over(whole).alias("P")).filter(F.col("k") >= 1)
    tp, fp = F.col("tp").cast("double"), F.col("fp").cast("double")
    fn = F.col("P").cast("double") - tp
    prec, rec = _div(tp, tp + fp), _div(tp, tp + fn)
    b2 = beta * beta
    return c.select("threshold", prec.alias("precision"), rec.alias("recall"),
                    _div(2 * prec * rec, prec + rec).alias("f1"),
                    _div((1 + b2) * prec * rec, F.lit(b2) * prec + rec).alias("f_beta"))


def best_threshold(sweep: DataFrame, metric: str = "f_beta") -> DataFrame:
    """The first (smallest) threshold reaching the maximum score."""
    return sweep.agg(F.max_by("threshold", F.struct(F.col(metric), -F.col("threshold"))).alias("threshold"),
                     F.max(metric).alias("score"))


def quality_gates(spark: SparkSession, metrics_long: DataFrame) -> DataFrame:
    """Long metrics (metric, value) against every gate set -> pass table.

    The gate table is a literal of a dozen rows (broadcast size bounded)."""
    gates = spark.createDataFrame([(g, m, float(v)) for g, d in fv.QUALITY_GATES.items() for m, v in d.items()],
                                  "gate_set string, metric string, minimum double")
    j = metrics_long.join(F.broadcast(gates), "metric")
    return j.select("gate_set", "metric", "value", "minimum", (F.col("value") >= F.col("minimum")).alias("passed"))
