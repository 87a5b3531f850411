"""Statistics: A1-A12 (profiles, fitted parameters, outlier filters),
A20-A21 (KS drift), A22-A26 and M21 (per-machine trend window, fleet days).

Fit steps are single aggregates whose one-row result becomes literals of
the apply step (a projection or filter); they never cross-join.  Quantiles are exact
and come from counts per distinct value (:mod:`quantiles`).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import rules as R
from .prefix import running_sums
from .quantiles import QUARTILES, exact_quantiles, lots, profile, profile_of, value_table
from .sequence import null_safe_join
from .temporal import row_index


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """A3: NULL or NaN count per column, one pass, long form."""
    def miss(c):
        x = F.col(c)
        dt = df.schema[c].dataType.typeName()
        cond = x.isNull() | F.isnan(x) if dt in ("double", "float") else x.isNull()
        return F.count_if(cond).alias(c)
    wide = df.agg(*[miss(c) for c in columns])
    return wide.unpivot([], columns, "column", "missing")


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """A4: count, mean, sample std, min, quartiles (linear), max; long form."""
    return profile(df, columns).select(
        "column", F.col("n").alias("count"), "mean", "std", "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"),
        F.col("q")[2].alias("p75"), "max")


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """A5: Pearson correlation of every ordered pair, one aggregate, long form."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs])
    both = [(a, b, f"{a}|{b}") for a, b in pairs] + [(b, a, f"{a}|{b}") for a, b in pairs if a != b]
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{c}`").alias("corr")) for a, b, c in both])).alias("p")).select("p.*")


def box_stats(df: DataFrame, value: str, by: str) -> DataFrame:
    """Quartiles, IQR and whiskers (furthest points within 1.5 IQR) per class."""
    table = value_table(df, [value], by)
    q = profile_of(table, QUARTILES).select(
        "by", "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    lo = F.col("q1") - F.lit(1.5) * F.col("iqr")
    hi = F.col("q3") + F.lit(1.5) * F.col("iqr")
    x, n = F.col("value"), F.col("n")
    rows = null_safe_join(table.select(F.col("g.by").alias("by"), "value", "n"),
                          q.select("by", lo.alias("lo"), hi.alias("hi")), ["by"])
    wh = rows.groupBy("by").agg(F.min(F.when(x >= F.col("lo"), x)).alias("whisker_low"),
                                F.max(F.when(x <= F.col("hi"), x)).alias("whisker_high"),
                                F.sum(F.when((x < F.col("lo")) | (x > F.col("hi")), n).otherwise(0)).alias("outliers"))
    return null_safe_join(q, wh, ["by"]).withColumnRenamed("by", by)


def histogram(df: DataFrame, value: str, by: str, width: float, origin: float | None = None) -> DataFrame:
    """Fixed-width bins from the minimum, counts per class and bin."""
    x = F.col(value)
    if origin is None:
        origin = float(df.agg(F.min(x)).first()[0])
    b = F.floor((x - F.lit(origin)) / F.lit(float(width))).cast("long")
    return df.groupBy(by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n")) \
        .withColumn("bin_start", F.lit(origin) + F.col("bin") * F.lit(float(width)))


def fit_params_table(df: DataFrame, columns: list[str]) -> DataFrame:
    """A9 as a long-form table: one row per column of fitted statistics."""
    return profile(df, columns).select("column", "mean", "std_pop", "min", "max", F.col("q")[0].alias("q1"),
                                       F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))


def fit_params(df: DataFrame, columns: list[str]) -> dict:
    """Mean, sample and population std, min, max, median, q1, q3 per column.

    Returns {column: {stat: value}} (one row per column reaches the driver)."""
    out = {}
    for r in profile(df, columns).collect():
        q = r["q"] or [None] * 3
        out[r["column"]] = {k: r[k] for k in ("mean", "std", "std_pop", "min", "max")} | {"q1": q[0], "median": q[1], "q3": q[2]}
    return out


def impute(df: DataFrame, params: dict, strategy: str = "mean") -> DataFrame:
    """A10 apply side: NULL/NaN -> fitted mean or median."""
    key = "median" if strategy == "median" else "mean"
    exprs = []
    for c in df.columns:
        if c in params:
            x = F.col(c)
            exprs.append(F.when(x.isNull() | F.isnan(x), F.lit(params[c][key])).otherwise(x).alias(c))
        else:
            exprs.append(F.col(c))
    return df.select(*exprs)


def iqr_bounds(df: DataFrame, columns: list[str], k: float = 1.5) -> dict:
    out = {}
    for r in profile(df, columns, [0.25, 0.75]).collect():
        q1, q3 = r["q"] or (math.nan, math.nan)
        out[r["column"]] = (q1 - k * (q3 - q1), q3 + k * (q3 - q1))
    return out


def iqr_filter(df: DataFrame, columns: list[str], k: float = 1.5, sequential: bool = False) -> DataFrame:
    """Keep rows inside [q1 - k IQR, q3 + k IQR] (NULL rows drop).

    Default: all bounds from one scan, one filter.  ``sequential``: the
    pandas behaviour, one column at a time on the already-shrunk set (one
    small profile per column)."""
    cur = df
    if not sequential:
        bounds = iqr_bounds(df, columns, k)
        cond = F.lit(True)
        for c in columns:
            cond = cond & F.col(c).between(*bounds[c])
        return df.filter(cond)
    for c in columns:
        cur = cur.filter(F.col(c).between(*iqr_bounds(cur, [c], k)[c]))
    return cur


def zscore_filter(df: DataFrame, columns: list[str], limit: float = 3.0) -> DataFrame:
    """Keep rows with |x - mean| / std_pop < limit for every column (NULL rows drop)."""
    r = df.agg(*[F.avg(c).alias(f"{c}|m") for c in columns],
               *[F.stddev_pop(c).alias(f"{c}|s") for c in columns]).first()
    cond = F.lit(True)
    for c in columns:
        m, s = r[f"{c}|m"], r[f"{c}|s"]
        z = F.abs(F.col(c) - F.lit(m)) / F.lit(s if s else 1.0)
        cond = cond & (z < F.lit(limit))
    return df.filter(cond)


# --- drift ---------------------------------------------------------------------------
def ks_pvalue(lam: Column, terms: int = 10) -> Column:
    """Asymptotic Kolmogorov survival function Q(lam), in [0, 1].

    lam >= 1: 2 sum (-1)^(k-1) exp(-2 k^2 lam^2); lam < 1: the equivalent theta
    form 1 - sqrt(2 pi)/lam sum exp(-(2k-1)^2 pi^2 / (8 lam^2)).  Both converge
    in a few terms on their side of 1."""
    big = None
    for k in range(1, terms + 1):
        t = F.lit(2.0 * (-1) ** (k - 1)) * F.exp(F.lit(-2.0 * k * k) * lam * lam)
        big = t if big is None else big + t
    small = None
    for k in range(1, terms + 1):
        t = F.exp(F.lit(-((2 * k - 1) ** 2) * math.pi ** 2 / 8.0) / (lam * lam))
        small = t if small is None else small + t
    small = F.lit(1.0) - F.lit(math.sqrt(2 * math.pi)) / lam * small
    p = F.when(lam >= 1, big).otherwise(small)
    return F.when(lam <= 0, F.lit(1.0)).otherwise(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)))


def ks_drift(ref: DataFrame, live: DataFrame, features: list[str]) -> DataFrame:
    """A20/A21 per feature: KS statistic D, asymptotic p-value, drift flag.

    Values are reduced to counts per distinct (feature, value, side); running
    sums per feature come from the range-dealt primitive (no feature sits whole in
    one task).  Under 30 live rows -> status 'insufficient_data'."""
    def long(d, side):
        return d.select(F.explode(F.array(*[
            F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]))
            .alias("p")).select("p.*", F.lit(side).alias("side")).filter(F.col("value").isNotNull())
    both = long(ref, 0).unionByName(long(live, 1))
    counts = both.groupBy("feature", "value").agg(
        F.count_if(F.col("side") == 0).alias("c0"), F.count_if(F.col("side") == 1).alias("c1"))
    cum = running_sums(counts, "value", ["c0", "c1"], group="feature", totals=True) \
        .withColumnsRenamed({"total_c0": "n0", "total_c1": "n1"})
    gap = F.abs(F.col("cum_c0") / F.col("n0") - F.col("cum_c1") / F.col("n1"))
    d = cum.groupBy("feature").agg(F.max(gap).alias("ks_stat"), F.first("n0").alias("n_ref"),
                                   F.first("n1").alias("n_live"))
    en = F.sqrt(F.col("n_ref") * F.col("n_live") / (F.col("n_ref") + F.col("n_live")))
    p = ks_pvalue(F.col("ks_stat") * en)
    enough = F.col("n_live") >= fv.DRIFT_MIN_LIVE_ROWS
    return d.select("feature", "ks_stat", "n_ref", "n_live",
                    F.when(enough, p).alias("p_value"),
                    F.when(~enough, F.lit("insufficient_data"))
                     .when(p < fv.DRIFT_P_LIMIT, F.lit("drift")).otherwise(F.lit("ok")).alias("status"))


def drift_verdict(ks: DataFrame) -> DataFrame:
    """>= 3 drifting features CRITICAL, > 0 WARNING, else OK."""
    k = F.count_if(F.col("status") == "drift")
    return ks.agg(k.alias("drifting"),
                  F.when(k >= fv.DRIFT_CRITICAL_COUNT, F.lit("CRITICAL"))
                   .when(k > 0, F.lit("WARNING")).otherwise(F.lit("OK")).alias("verdict"))


# --- distinct counts from sketches (A8) ----------------------------------------------
SKETCH_LG_K = 12
#: One standard error of a merged sketch of 2^SKETCH_LG_K registers.
SKETCH_ERROR = 1.04 / math.sqrt(1 << SKETCH_LG_K)


def daily_sketches(df: DataFrame, ts: str, measures: dict[str, str]) -> DataFrame:
    """Rows (day, one sketch per measure): distinct values of a column that day, in at most 2^SKETCH_LG_K registers."""
    return df.groupBy(F.to_date(ts).alias("day")).agg(*[
        F.hll_sketch_agg(F.col(c).cast("long"), SKETCH_LG_K).alias(m) for m, c in measures.items()])


def rolled_up(sketches: DataFrame, measures) -> DataFrame:
    """A8 over all days of a sketch table, without the raw rows: (measure, estimate)."""
    names = list(measures)
    one = sketches.agg(*[F.hll_sketch_estimate(F.hll_union_agg(m)).alias(m) for m in names])
    return one.unpivot([], names, "measure", "estimate")


# --- per-machine trend window (A22-A25, M21) ------------------------------------------
DAILY_ENTRIES = 14


def seven_day_window(scored: DataFrame, key: str, order: list[str], pct: str = "pct",
                     risk: str = "risk_level", **ordered_kw) -> DataFrame:
    """M21 over every machine: trend slope of the probability (percent) over row
    index, days until 60 %, daily maximum risk, latest risk.

    ``scored`` holds one row per reading with ``pct`` (0 and NORMAL for
    readings that failed validation, as the reference does, D12).  The row
    index is the skew-safe one; trend, latest risk and the daily maxima are partial aggregates
    of one grouping (bucket = max(1, n // 7), so there are at most DAILY_ENTRIES of them).
    Readings without a machine are a machine of their own."""
    idx = row_index(scored.select(key, *order, pct, risk), key, order, with_count=True, **ordered_kw)
    x = (F.col("rn") - 1).cast("double")
    y = F.col(pct)
    bucket = F.greatest(F.lit(1), F.floor(F.col("n") / 7)).cast("long")
    idx = idx.withColumn("_b", F.floor((F.col("rn") - 1) / bucket)).withColumn("_rank", R.risk_rank_fr(F.col(risk)))
    agg = idx.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("_m"), F.regr_intercept(y, x).alias("_b"),
        F.max_by(y, F.col("rn")).alias("_last"), F.max_by(F.col(risk), F.col("rn")).alias("summary_risk"),
        *[F.max(F.when(F.col("_b") == i, F.col("_rank"))).alias(f"_d{i}") for i in range(DAILY_ENTRIES)])
    daily = F.array_join(F.array(*[F.when(F.col(f"_d{i}").isNotNull(), R.risk_from_rank_fr(F.col(f"_d{i}")))
                                   for i in range(DAILY_ENTRIES)]), ",")  # entries that the machine hasn't are left out
    n = F.col("n")
    slope = F.when(n >= 2, F.coalesce(F.col("_m"), F.lit(0.0))).otherwise(F.lit(0.0))
    intercept = F.when(n >= 2, F.col("_b")).otherwise(F.col("_last"))
    rpd = F.when(n >= 7, F.greatest(F.lit(1.0), F.bround(n / 7.0, 0))).otherwise(F.lit(1.0))
    rows_to = (F.lit(fv.URGENT_PCT) - (intercept + slope * (n - 1))) / slope
    days = F.when(slope > 0, F.bround(F.greatest(F.lit(0.0), rows_to / rpd), 1))
    return agg.select(key, "n", F.bround(slope, 4).alias("trend_slope_pct"), days.alias("days_to_failure"),
                      "summary_risk", daily.alias("daily_risk"))


def fleet_by_day(scored: DataFrame, key: str, ts: str, p: str = "p", label: str = "label") -> DataFrame:
    """Per day, machines at risk (p >= .6), critical (p >= .8), all, failing, ratio."""
    day = F.to_date(F.col(ts)).alias("day")
    d = scored.select(day, F.col(key).alias("_k"), F.col(p).alias("_p"), F.col(label).alias("_y"))
    per = d.groupBy("day", "_k").agg(F.max("_p").alias("_p"), F.max("_y").alias("_y"))
    return per.groupBy("day").agg(
        F.count_if(F.col("_p") >= 0.6).alias("machines_at_risk"),
        F.count_if(F.col("_p") >= 0.8).alias("critical_count"),
        F.count(F.lit(1)).alias("machines"),
        F.count_if(F.col("_y") == 1).alias("failing_machines")) \
        .withColumn("failing_ratio", F.col("failing_machines") / F.col("machines"))


def bin_counts(df: DataFrame, features: list[str], edges: list[list[float]], label: str) -> DataFrame:
    """Rows (feature, bin, y, n): readings with ``bin`` of the feature's ascending ``edges`` below the value, by label.
    Missing values lie in bin 0, NaN above every edge."""
    def counts(batches):
        import numpy as np
        import pyarrow as pa
        for t in lots(batches):
            labels = t.column(0).combine_chunks().dictionary_encode("encode")
            y, k = labels.indices.to_numpy(), max(len(labels.dictionary), 1)
            out = []
            for i, e in enumerate(edges):
                x = t.column(i + 1).combine_chunks()
                b = np.searchsorted(np.array(e, "float64"), x.fill_null(-np.inf).to_numpy(), side="left")
                n = np.bincount(b * k + y, minlength=1)
                at = np.flatnonzero(n)
                out.append((np.full(len(at), i, "int32"), (at // k).astype("int32"), at % k, n[at]))
            i, b, at, n = (np.concatenate(a) for a in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(b), labels.dictionary.take(pa.array(at)), pa.array(n)], ["i", "bin", "y", "n"])

    rows = df.select(F.col(label).alias("y"), *[F.col(f).cast("double").alias(f"c{i}") for i, f in enumerate(features)])
    schema = f"i int, bin int, y {df.schema[label].dataType.simpleString()}, n long"
    names = F.array(*map(F.lit, features))
    return rows.mapInArrow(counts, schema).groupBy("i", "bin", "y").agg(F.sum("n").alias("n")) \
        .select(F.get(names, F.col("i")).alias("feature"), "bin", "y", "n")


def binned_mutual_information(df: DataFrame, features: list[str], label: str, bins: int = 10,
                              top: int | None = None) -> DataFrame:
    """Mutual information of each feature (quantile bins) with the label, in nats.

    ``top`` keeps the best features (50 in the reference's selection; ties by name).
    Quantile edges are exact; counts per (feature, bin, label) come from one pass that counts inside the tasks.
    The reference's nearest-neighbour estimator is not reproduced; this is a plug-in estimate on equal-frequency bins."""
    edges = exact_quantiles(df, features, [i / bins for i in range(1, bins)])
    c = bin_counts(df, features, [sorted(set(edges[f] or [])) for f in features], label)
    w_f = Window.partitionBy("feature")
    c = c.withColumn("n_all", F.sum("n").over(w_f)) \
        .withColumn("nb", F.sum("n").over(Window.partitionBy("feature", "bin"))) \
        .withColumn("ny", F.sum("n").over(Window.partitionBy("feature", "y")))
    term = (F.col("n") / F.col("n_all")) * F.log((F.col("n") * F.col("n_all")) / (F.col("nb") * F.col("ny")))
    out = c.groupBy("feature").agg(F.sum(term).alias("mutual_info"))
    return out if top is None else out.orderBy(F.desc("mutual_info"), "feature").limit(top)

