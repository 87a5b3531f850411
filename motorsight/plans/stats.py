"""Statistics and model-quality queries (A1-A31, M13, M17, M21) with oracle SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import rules as R
from ..functions.numeric import round6, round_half_away
from ..operators import metrics as MT
from ..operators import stats as ST
from ..sources.tables import SENSOR_ORDER, Tables
from ..operators.preprocess import numeric_columns
from .registry import register
from .rowwise import fleet_scored
from .sql_views import FLEET_PROB, RISK_FR, SENSOR, TELEMETRY, with_views

SENSORS = ["air_k", "proc_k", "rpm", "torque", "wear"]
THRESHOLD = fv.PRODUCTION_THRESHOLD
FLEET = f"fleet AS (SELECT *, {FLEET_PROB} AS p FROM sensor)"
PRED = f"pr AS (SELECT label, CAST(p >= {THRESHOLD}e0 AS INTEGER) AS pred, p FROM fleet)"


def r6(c):
    return round6(c)


def _fleet(spark, sf_dir) -> DataFrame:
    f = fleet_scored(Tables(spark, sf_dir))
    return f.withColumn("pred", R.binary_decision("p", THRESHOLD))


def _sql_div(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) = 0 THEN 0e0 ELSE ({a}) / ({b}) END)"


# --- A1, A2, A3, A4 ---------------------------------------------------------------------
@register("class_distribution", with_views(SENSOR) + "SELECT label, count(*) AS n FROM sensor GROUP BY label",
          ids=("A1",))
def class_distribution_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per failure label."""
    return Tables(spark, sf_dir).sensor.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


RATE_SQL = with_views(SENSOR) + """
, b AS (SELECT *, torque*rpm*1.0471975511965977e-1 AS pw FROM sensor)
SELECT round(avg(label), 6) AS failure_rate,
  CAST(sum(CASE WHEN (proc_k - air_k) < 8.6e0 AND rpm < 1380e0 THEN 1 ELSE 0 END) AS BIGINT) AS hdf_events,
  CAST(sum(CASE WHEN pw < 3500e0 OR pw > 9000e0 THEN 1 ELSE 0 END) AS BIGINT) AS pwf_events,
  CAST(sum(CASE WHEN wear*torque > CASE mtype WHEN 'L' THEN 11000e0 WHEN 'M' THEN 12000e0 ELSE 13000e0 END THEN 1 ELSE 0 END) AS BIGINT) AS osf_events,
  CAST(sum(CASE WHEN wear BETWEEN 200e0 AND 240e0 THEN 1 ELSE 0 END) AS BIGINT) AS twf_events
FROM b
"""


@register("failure_rate", RATE_SQL, ids=("A2",))
def failure_rate_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failure rate and per-mode event counts in one aggregate."""
    s = Tables(spark, sf_dir).sensor
    fl = R.spec_failure_flags()
    return s.agg(r6(F.avg("label")).alias("failure_rate"),
                 *[F.sum(fl[m]).cast("long").alias(f"{m.lower()}_events") for m in ["HDF", "PWF", "OSF", "TWF"]])


GAPPY_SQL = """gappy AS (SELECT user_id AS machine_id, ts, event_id,
  CASE WHEN event_type <> 'view' THEN value END AS x, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS aux
  FROM events)"""


def _gappy(t: Tables) -> DataFrame:
    ev = t.events
    return ev.select(F.col("user_id").alias("machine_id"), "ts", "event_id",
                     F.when(F.col("event_type") != "view", F.col("value")).alias("x"),
                     F.get_json_object("props", "$.k").cast("int").alias("aux"))


MISSING_SQL = with_views(GAPPY_SQL) + """
SELECT 'x' AS "column", count(*) FILTER (WHERE x IS NULL OR isnan(x)) AS missing FROM gappy
UNION ALL SELECT 'aux', count(*) FILTER (WHERE aux IS NULL) FROM gappy
"""


@register("missing_counts", MISSING_SQL, ids=("A3",))
def missing_counts_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NULL/NaN count per column, one pass."""
    return ST.missing_counts(_gappy(Tables(spark, sf_dir)), ["x", "aux"])


DESCRIBE_SQL = with_views(SENSOR) + " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
  round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
  round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max FROM sensor""" for c in SENSORS)


@register("describe", DESCRIBE_SQL, ids=("A4",))
def describe_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """count, mean, sample std, min, quartiles, max per sensor."""
    d = ST.describe(Tables(spark, sf_dir).sensor, SENSORS)
    return d.select("column", "count", *[r6(F.col(c)).alias(c)
                                         for c in ["mean", "std", "min", "p25", "p50", "p75", "max"]])


CORR_COLS = SENSORS + ["label"]
CORR_SQL = with_views(SENSOR) + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM sensor"
    for a in CORR_COLS for b in CORR_COLS)


@register("correlation_matrix", CORR_SQL, ids=("A5",))
def correlation_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson correlation of every sensor pair and the label, long form."""
    c = ST.correlation_matrix(Tables(spark, sf_dir).sensor, CORR_COLS)
    return c.select("a", "b", r6(F.col("corr")).alias("corr"))


BOX_SQL = with_views(SENSOR) + """
, q AS (SELECT label, count(torque) AS n, quantile_cont(torque, 0.25) AS q1, quantile_cont(torque, 0.5) AS median,
               quantile_cont(torque, 0.75) AS q3 FROM sensor GROUP BY label)
, b AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5e0*(q3 - q1) AS lo, q3 + 1.5e0*(q3 - q1) AS hi FROM q)
SELECT b.label, b.n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(iqr, 6) AS iqr,
  round(min(CASE WHEN torque >= lo THEN torque END), 6) AS whisker_low,
  round(max(CASE WHEN torque <= hi THEN torque END), 6) AS whisker_high,
  count(*) FILTER (WHERE torque < lo OR torque > hi) AS outliers
FROM b JOIN sensor s ON s.label = b.label GROUP BY b.label, b.n, q1, median, q3, iqr
"""


@register("box_stats", BOX_SQL, ids=("A6",))
def box_stats_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles, IQR, whiskers and outlier count of torque per class."""
    b = ST.box_stats(Tables(spark, sf_dir).sensor, "torque", "label")
    return b.select("label", "n", *[r6(F.col(c)).alias(c) for c in
                                    ["q1", "median", "q3", "iqr", "whisker_low", "whisker_high"]], "outliers")


HIST_SQL = with_views(SENSOR) + """
, m AS (SELECT min(torque) AS lo FROM sensor)
SELECT label, CAST(floor((torque - lo) / 5e0) AS BIGINT) AS bin, count(*) AS n,
       round(lo + CAST(floor((torque - lo) / 5e0) AS BIGINT) * 5e0, 6) AS bin_start
FROM sensor, m GROUP BY ALL
"""


@register("histogram", HIST_SQL, ids=("A7",))
def histogram_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Torque histogram per class, bin width 5 from the minimum."""
    h = ST.histogram(Tables(spark, sf_dir).sensor, "torque", "label", 5.0)
    return h.select("label", "bin", "n", r6(F.col("bin_start")).alias("bin_start"))


DISTINCT_SQL = with_views(SENSOR) + """
SELECT count(DISTINCT l_partkey) AS products, count(DISTINCT mtype) AS types,
       count(DISTINCT machine_id) AS machines,
       count(DISTINCT CASE WHEN label = 1 THEN machine_id END) AS failing_machines
FROM sensor
"""


@register("distinct_counts", DISTINCT_SQL, ids=("A8",))
def distinct_counts_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct products, types, machines and failing machines."""
    s = Tables(spark, sf_dir).sensor
    return s.agg(F.countDistinct("l_partkey").alias("products"), F.countDistinct("mtype").alias("types"),
                 F.countDistinct("machine_id").alias("machines"),
                 F.countDistinct(F.when(F.col("label") == 1, F.col("machine_id"))).alias("failing_machines"))


PARAMS_SQL = with_views(SENSOR) + " UNION ALL ".join(f"""
SELECT '{c}' AS "column", round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std_pop, round(min({c}), 6) AS min,
  round(max({c}), 6) AS max, round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.5), 6) AS median,
  round(quantile_cont({c}, 0.75), 6) AS q3 FROM sensor WHERE l_linestatus = 'F'""" for c in SENSORS)


@register("fitted_params", PARAMS_SQL, ids=("A9", "A10"))
def fitted_params_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted training statistics per sensor on the reference ('F') rows."""
    s = Tables(spark, sf_dir).sensor.filter(F.col("l_linestatus") == "F")
    p = ST.fit_params_table(s, SENSORS)
    return p.select("column", *[r6(F.col(c)).alias(c) for c in ["mean", "std_pop", "min", "max", "q1", "median", "q3"]])


IMPUTE_SQL = with_views(GAPPY_SQL) + """
, m AS (SELECT avg(x) AS mu, quantile_cont(x, 0.5) AS med FROM gappy)
SELECT event_id, round(coalesce(x, mu), 6) AS x_mean, round(coalesce(x, med), 6) AS x_median FROM gappy, m
"""


@register("impute", IMPUTE_SQL, ids=("A10", "P14"))
def impute_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and median imputation of a gappy reading (fit, then apply)."""
    g = _gappy(Tables(spark, sf_dir))
    columns = numeric_columns(g.select("event_id", "x"), drop=["event_id"])
    params = ST.fit_params(g, columns)
    both = g.select("event_id", *[F.col(c).alias(f"{c}_{k}") for c in columns for k in ("mean", "median")])
    for k in ("mean", "median"):
        both = ST.impute(both, {f"{c}_{k}": params[c] for c in columns}, k)
    return both.select("event_id", *[r6(F.col(c)).alias(c) for c in both.columns[1:]])


IQR_COLS = ["torque", "wear", "rpm"]


def _iqr_sql(sequential: bool) -> str:
    if not sequential:
        b = ", ".join(f"quantile_cont({c}, 0.25) AS {c}_q1, quantile_cont({c}, 0.75) AS {c}_q3" for c in IQR_COLS)
        cond = " AND ".join(f"{c} BETWEEN {c}_q1 - 1.5e0*({c}_q3 - {c}_q1) AND {c}_q3 + 1.5e0*({c}_q3 - {c}_q1)"
                            for c in IQR_COLS)
        return with_views(SENSOR) + f""", b AS (SELECT {b} FROM sensor)
SELECT machine_id, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM sensor, b WHERE {cond}"""
    ctes, prev = [], "sensor"
    for i, c in enumerate(IQR_COLS):
        ctes.append(f"""b{i} AS (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {prev}),
s{i} AS (SELECT {prev}.* FROM {prev}, b{i} WHERE {c} BETWEEN q1 - 1.5e0*(q3 - q1) AND q3 + 1.5e0*(q3 - q1))""")
        prev = f"s{i}"
    return with_views(SENSOR) + ", " + ",\n".join(ctes) + \
        f"\nSELECT machine_id, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM {prev}"


KEYS = ["machine_id", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]


@register("iqr_filter", _iqr_sql(False), ids=("A11",))
def iqr_filter_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IQR outlier filter (k = 1.5), all bounds from one aggregate."""
    return ST.iqr_filter(Tables(spark, sf_dir).sensor, IQR_COLS).select(*KEYS)


@register("iqr_filter_sequential", _iqr_sql(True), ids=("A11",))
def iqr_filter_seq_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IQR outlier filter applied column by column on the shrinking set."""
    return ST.iqr_filter(Tables(spark, sf_dir).sensor, IQR_COLS, sequential=True).select(*KEYS)


ZSCORE_SQL = with_views(TELEMETRY) + """
, m AS (SELECT avg(x) AS mu, stddev_pop(x) AS sd, avg(aux) AS mu2, stddev_pop(aux) AS sd2 FROM telemetry)
SELECT event_id FROM telemetry, m WHERE abs(x - mu) / sd < 1.5e0 AND abs(aux - mu2) / sd2 < 1.5e0
"""


@register("zscore_filter", ZSCORE_SQL, ids=("A12",))
def zscore_filter_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z-score filter with population std at the configured limit 1.5."""
    t = Tables(spark, sf_dir).telemetry
    return ST.zscore_filter(t, ["x", "aux"], limit=1.5).select("event_id")


# --- A13-A19 ----------------------------------------------------------------------------
CM_SQL = with_views(SENSOR, FLEET, PRED) + """
, c AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(actual, predicted))
SELECT c.actual, c.predicted, count(pr.label) AS n
FROM c LEFT JOIN pr ON pr.label = c.actual AND pr.pred = c.predicted GROUP BY ALL
"""


@register("confusion_matrix", CM_SQL, ids=("A13",))
def confusion_matrix_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion matrix at the production threshold, empty cells as 0."""
    return MT.confusion_matrix(_fleet(spark, sf_dir), "label", "pred")


def _metrics_sql_select(beta: float = fv.FBETA_BETA) -> str:
    b2 = beta * beta
    prec, rec = _sql_div("tp", "tp + fp"), _sql_div("tp", "tp + fn")
    return f"""tp, fp, fn, tn,
  round({_sql_div('tp + tn', 'tp + tn + fp + fn')}, 6) AS accuracy,
  round({prec}, 6) AS precision, round({rec}, 6) AS recall,
  round({_sql_div(f'2e0 * {prec} * {rec}', f'{prec} + {rec}')}, 6) AS f1,
  round({_sql_div(f'{1 + b2!r}e0 * {prec} * {rec}', f'{b2!r}e0 * {prec} + {rec}')}, 6) AS f_beta,
  round(({rec} + {_sql_div('tn', 'tn + fp')}) / 2, 6) AS balanced_accuracy"""


COUNTS = """CAST(sum(CASE WHEN label = 1 AND pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
  CAST(sum(CASE WHEN label = 0 AND pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN label = 1 AND pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
  CAST(sum(CASE WHEN label = 0 AND pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn"""

METRICS_SQL = with_views(SENSOR, FLEET, PRED) + f"""
, c AS (SELECT {COUNTS} FROM pr)
SELECT {_metrics_sql_select()} FROM c
"""


def _round_metrics(df: DataFrame) -> DataFrame:
    return df.select(*[r6(F.col(c)).alias(c) if c not in ("tp", "fp", "fn", "tn") and not c.startswith("model")
                       else F.col(c) for c in df.columns])


@register("classification_metrics", METRICS_SQL, ids=("A14",))
def classification_metrics_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, precision, recall, F1, F-beta(1.5), balanced accuracy; 0 on zero division."""
    return _round_metrics(MT.classification_metrics(_fleet(spark, sf_dir)))


CURVE_CTES = """
, sc AS (SELECT p AS threshold, CAST(sum(label) AS BIGINT) AS pos, CAST(count(*) - sum(label) AS BIGINT) AS neg
         FROM fleet GROUP BY p)
, tot AS (SELECT sum(pos) AS P, sum(neg) AS N FROM sc)
, cum AS (SELECT *, sum(pos) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS tp,
                    sum(neg) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS fp FROM sc)
, pts AS (SELECT cum.*, P, N, tp - pos AS tp0, fp - neg AS fp0 FROM cum, tot)
"""

AUC_SQL = with_views(SENSOR, FLEET) + CURVE_CTES + """
SELECT round(sum(neg * (tp0 + pos / 2e0)) / (max(P) * max(N)), 6) AS roc_auc,
  round(sum((tp / P - tp0 / P) * (tp / (tp + fp) + CASE WHEN tp0 + fp0 = 0 THEN 1e0 ELSE tp0 / (tp0 + fp0) END) / 2e0), 6) AS pr_auc,
  round(sum((tp / P - tp0 / P) * (tp / (tp + fp))), 6) AS average_precision
FROM pts
"""


@register("roc_auc", AUC_SQL, ids=("A15", "A17", "A18"))
def roc_auc_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROC-AUC with ties, trapezoid PR-AUC and average precision of the fleet score."""
    a = MT.auc_summary(_fleet(spark, sf_dir), "label", "p")
    return a.select(*[r6(F.col(c)).alias(c) for c in a.columns])


CURVE_SQL = with_views(SENSOR, FLEET) + CURVE_CTES + """
SELECT round(threshold, 6) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(tp / P, 6) AS tpr, round(fp / N, 6) AS fpr,
       round(tp / (tp + fp), 6) AS precision, round(tp / P, 6) AS recall
FROM pts
"""


@register("roc_pr_curve", CURVE_SQL, ids=("A16", "A17"))
def roc_pr_curve_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROC and PR curve points at every distinct score."""
    p = MT.curve_points(_fleet(spark, sf_dir), "label", "p")
    return p.select(r6(F.col("threshold")).alias("threshold"), "tp", "fp",
                    *[r6(F.col(c)).alias(c) for c in ["tpr", "fpr", "precision", "recall"]])


REPORT_SQL = with_views(SENSOR, FLEET, PRED) + f"""
, c AS (SELECT {COUNTS} FROM pr)
, k AS (SELECT '1' AS class, {_sql_div('tp', 'tp + fp')} AS precision, {_sql_div('tp', 'tp + fn')} AS recall,
               tp + fn AS support FROM c
        UNION ALL
        SELECT '0', {_sql_div('tn', 'tn + fn')}, {_sql_div('tn', 'tn + fp')}, tn + fp FROM c)
, f AS (SELECT *, {_sql_div('2e0 * precision * recall', 'precision + recall')} AS f1 FROM k)
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM f
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
       CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
       round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
       CAST(sum(support) AS BIGINT) FROM f
"""


@register("classification_report", REPORT_SQL, ids=("A19",))
def classification_report_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-class precision, recall, F1, support with macro and weighted averages."""
    c = MT.confusion_counts(_fleet(spark, sf_dir), "label", "pred")
    d = MT._div
    k = c.select(F.explode(F.array(
        F.struct(F.lit("1").alias("class"), d(F.col("tp").cast("double"), F.col("tp") + F.col("fp")).alias("precision"),
                 d(F.col("tp").cast("double"), F.col("tp") + F.col("fn")).alias("recall"),
                 (F.col("tp") + F.col("fn")).alias("support")),
        F.struct(F.lit("0").alias("class"), d(F.col("tn").cast("double"), F.col("tn") + F.col("fn")).alias("precision"),
                 d(F.col("tn").cast("double"), F.col("tn") + F.col("fp")).alias("recall"),
                 (F.col("tn") + F.col("fp")).alias("support")))).alias("k")).select("k.*")
    f = k.withColumn("f1", d(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    macro = f.agg(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"),
                  F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.sum("support").alias("support"))
    wsum = F.sum("support")
    weighted = f.agg(F.lit("weighted avg").alias("class"),
                     (F.sum(F.col("precision") * F.col("support")) / wsum).alias("precision"),
                     (F.sum(F.col("recall") * F.col("support")) / wsum).alias("recall"),
                     (F.sum(F.col("f1") * F.col("support")) / wsum).alias("f1"), wsum.alias("support"))
    out = f.select("class", "precision", "recall", "f1", "support").unionByName(macro).unionByName(weighted)
    return out.select("class", *[r6(F.col(c)).alias(c) for c in ["precision", "recall", "f1"]],
                      F.col("support").cast("long").alias("support"))


# --- drift (A20, A21, A31) ------------------------------------------------------------------
DRIFT_FEATURES = SENSORS + ["torque_plus2"]


def _drift_sides(t: Tables):
    s = t.sensor
    ref = s.filter(F.col("l_linestatus") == "F").withColumn("torque_plus2", F.col("torque"))
    live = s.filter(F.col("l_linestatus") != "F").withColumn("torque_plus2", F.col("torque") + 2.0)
    return ref, live


def _ks_sql() -> str:
    longs = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, CAST({'torque' if f == 'torque_plus2' else f} AS DOUBLE)"
        f"{' + CASE WHEN l_linestatus <> ' + chr(39) + 'F' + chr(39) + ' THEN 2e0 ELSE 0e0 END' if f == 'torque_plus2' else ''}"
        f" AS value, CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END AS side FROM sensor" for f in DRIFT_FEATURES)
    big = " + ".join(f"{2.0 * (-1) ** (k - 1)!r}e0 * exp({-2.0 * k * k!r}e0 * lam * lam)" for k in range(1, 11))
    small = " + ".join(f"exp({-((2 * k - 1) ** 2) * math.pi ** 2 / 8.0!r} / (lam * lam))" for k in range(1, 11))
    series = f"CASE WHEN lam >= 1 THEN {big} ELSE 1e0 - {math.sqrt(2 * math.pi)!r} / lam * ({small}) END"
    return with_views(SENSOR) + f"""
, lg AS ({longs})
, cnt AS (SELECT feature, value, count(*) FILTER (WHERE side = 0) AS c0, count(*) FILTER (WHERE side = 1) AS c1
          FROM lg WHERE value IS NOT NULL GROUP BY feature, value)
, tot AS (SELECT feature, sum(c0) AS n0, sum(c1) AS n1 FROM cnt GROUP BY feature)
, cum AS (SELECT cnt.feature, value,
            sum(c0) OVER (PARTITION BY cnt.feature ORDER BY value ROWS UNBOUNDED PRECEDING) AS k0,
            sum(c1) OVER (PARTITION BY cnt.feature ORDER BY value ROWS UNBOUNDED PRECEDING) AS k1 FROM cnt)
, d AS (SELECT cum.feature, max(abs(k0 / n0 - k1 / n1)) AS ks_stat, max(n0) AS n_ref, max(n1) AS n_live
        FROM cum JOIN tot ON cum.feature = tot.feature GROUP BY cum.feature)
, l AS (SELECT *, ks_stat * sqrt(n_ref * n_live / (n_ref + n_live)) AS lam FROM d)
, pv AS (SELECT *, CASE WHEN lam <= 0 THEN 1e0 ELSE least(greatest({series}, 0e0), 1e0) END AS p FROM l)
, ks AS (SELECT feature, ks_stat, CAST(n_ref AS BIGINT) AS n_ref, CAST(n_live AS BIGINT) AS n_live,
        CASE WHEN n_live >= 30 THEN p END AS p_value,
        CASE WHEN n_live < 30 THEN 'insufficient_data' WHEN p < 5e-2 THEN 'drift' ELSE 'ok' END AS status FROM pv)
"""


KS_SQL = _ks_sql() + "SELECT feature, round(ks_stat, 6) AS ks_stat, n_ref, n_live, round(p_value, 6) AS p_value, status FROM ks"


def _ks(spark, sf_dir) -> DataFrame:
    ref, live = _drift_sides(Tables(spark, sf_dir))
    return ST.ks_drift(ref, live, DRIFT_FEATURES)


@register("ks_drift", KS_SQL, ids=("A20", "J10"))
def ks_drift_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sample KS statistic and asymptotic p-value per feature ('F' rows vs the rest,
    plus a torque copy shifted by +2 on the live side that must drift)."""
    k = _ks(spark, sf_dir)
    return k.select("feature", r6(F.col("ks_stat")).alias("ks_stat"), F.col("n_ref").cast("long").alias("n_ref"),
                    F.col("n_live").cast("long").alias("n_live"), r6(F.col("p_value")).alias("p_value"), "status")


VERDICT_SQL = _ks_sql() + """
SELECT count(*) FILTER (WHERE status = 'drift') AS drifting,
  CASE WHEN count(*) FILTER (WHERE status = 'drift') >= 3 THEN 'CRITICAL'
       WHEN count(*) FILTER (WHERE status = 'drift') > 0 THEN 'WARNING' ELSE 'OK' END AS verdict
FROM ks
"""


@register("drift_verdict", VERDICT_SQL, ids=("A21",))
def drift_verdict_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift verdict from the per-feature KS tests."""
    return ST.drift_verdict(_ks(spark, sf_dir))


RETRAIN_SQL = _ks_sql() + f"""
, v AS (SELECT CASE WHEN count(*) FILTER (WHERE status = 'drift') >= 3 THEN 'CRITICAL'
                    WHEN count(*) FILTER (WHERE status = 'drift') > 0 THEN 'WARNING' ELSE 'OK' END AS verdict FROM ks)
, {FLEET}, {PRED.replace('SELECT label,', 'SELECT l_linestatus, label,')}
, c AS (SELECT l_linestatus = 'F' AS is_ref, {COUNTS} FROM pr GROUP BY 1)
, m AS (SELECT is_ref, tp + fn + fp + tn AS rows_n,
          {_sql_div(f"2e0 * {_sql_div('tp', 'tp + fp')} * {_sql_div('tp', 'tp + fn')}", f"{_sql_div('tp', 'tp + fp')} + {_sql_div('tp', 'tp + fn')}")} AS f1 FROM c)
SELECT round(r.f1, 6) AS f1_reference, round(l.f1, 6) AS f1_live, CAST(l.rows_n AS BIGINT) AS new_rows, verdict,
       (l.rows_n >= 100 AND r.f1 - l.f1 >= 5e-2) OR verdict = 'CRITICAL' AS retrain
FROM m r, m l, v WHERE r.is_ref AND NOT l.is_ref
"""


@register("retrain_decision", RETRAIN_SQL, ids=("A31",))
def retrain_decision_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrain when >= 100 new labelled rows lost >= 0.05 F1, or drift is CRITICAL."""
    f = _fleet(spark, sf_dir).withColumn("is_ref", F.col("l_linestatus") == "F")
    m = MT.classification_metrics(f, by=["is_ref"]).select(
        "is_ref", (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("rows_n"), "f1")
    v = ST.drift_verdict(_ks(spark, sf_dir)).select("verdict")
    # Two small aggregates brought to one row by a union and one aggregate (no cross join).
    long = m.select(F.when(F.col("is_ref"), "ref").otherwise("live").alias("side"), "f1", "rows_n",
                    F.lit(None).cast("string").alias("verdict")) \
        .unionByName(v.select(F.lit("drift").alias("side"), F.lit(None).cast("double").alias("f1"),
                              F.lit(None).cast("long").alias("rows_n"), "verdict"))
    one = long.agg(F.max(F.when(F.col("side") == "ref", F.col("f1"))).alias("f1_reference"),
                   F.max(F.when(F.col("side") == "live", F.col("f1"))).alias("f1_live"),
                   F.max(F.when(F.col("side") == "live", F.col("rows_n"))).alias("new_rows"),
                   F.max("verdict").alias("verdict"))
    return one.select(r6(F.col("f1_reference")).alias("f1_reference"), r6(F.col("f1_live")).alias("f1_live"),
                      F.col("new_rows").cast("long").alias("new_rows"), "verdict",
                      (((F.col("new_rows") >= fv.RETRAIN_MIN_NEW_LABELS)
                        & ((F.col("f1_reference") - F.col("f1_live")) >= fv.RETRAIN_F1_DROP))
                       | (F.col("verdict") == "CRITICAL")).alias("retrain"))


# --- A22-A26, M21 -------------------------------------------------------------------------------
def scored_pct_raw(spark, sf_dir) -> DataFrame:
    """Scored readings, those of every 40th part with a broken torque sensor (invalid)."""
    class _T:
        sensor = Tables(spark, sf_dir).sensor.withColumn(
            "torque", F.when(F.col("l_partkey") % 40 == 0, 500.0).otherwise(F.col("torque")))
    return fleet_scored(_T()).withColumn("pct", round_half_away(F.col("p") * 100, 2))


def _scored_pct(spark, sf_dir) -> DataFrame:
    from ..operators.scoring import invalid_as_normal
    return invalid_as_normal(scored_pct_raw(spark, sf_dir))


SEVEN_SQL = with_views(SENSOR, FLEET) + f"""
, sc AS (SELECT machine_id, ts, l_orderkey, l_linenumber, l_partkey, l_extendedprice,
           CASE WHEN l_partkey % 40 = 0 THEN 0e0 ELSE round(p * 100, 2) END AS pct,
           CASE WHEN l_partkey % 40 = 0 THEN 'NORMAL' ELSE {RISK_FR.format(p='p')} END AS risk FROM fleet)
, ix AS (SELECT *, row_number() OVER (PARTITION BY machine_id ORDER BY ts, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS rn,
                count(*) OVER (PARTITION BY machine_id) AS n FROM sc)
, rk AS (SELECT *, CASE risk WHEN 'NORMAL' THEN 0 WHEN 'SURVEILLER' THEN 1 WHEN 'ATTENTION' THEN 2
                              WHEN 'URGENT' THEN 3 WHEN 'CRITIQUE' THEN 4 ELSE 0 END AS rank,
                (rn - 1) // greatest(1, n // 7) AS b FROM ix)
, daily AS (SELECT machine_id, b, max(rank) AS rank FROM rk GROUP BY machine_id, b)
, dl AS (SELECT machine_id, string_agg(CASE rank WHEN 0 THEN 'NORMAL' WHEN 1 THEN 'SURVEILLER' WHEN 2 THEN 'ATTENTION'
                 WHEN 3 THEN 'URGENT' ELSE 'CRITIQUE' END, ',' ORDER BY b) AS daily_risk FROM daily GROUP BY machine_id)
, ag AS (SELECT machine_id, count(*) AS n, regr_slope(pct, CAST(rn - 1 AS DOUBLE)) AS m,
                regr_intercept(pct, CAST(rn - 1 AS DOUBLE)) AS b0, arg_max(pct, rn) AS last,
                arg_max(risk, rn) AS summary_risk FROM rk GROUP BY machine_id)
, s AS (SELECT *, CASE WHEN n >= 2 THEN coalesce(m, 0e0) ELSE 0e0 END AS slope,
               CASE WHEN n >= 2 THEN b0 ELSE last END AS icp,
               CASE WHEN n >= 7 THEN greatest(1e0, round_even(n / 7e0, 0)) ELSE 1e0 END AS rpd FROM ag)
SELECT s.machine_id, n, round_even(slope, 4) AS trend_slope_pct,
  CASE WHEN slope > 0 THEN round_even(greatest(0e0, ((60e0 - (icp + slope * (n - 1))) / slope) / rpd), 1) END AS days_to_failure,
  summary_risk, daily_risk
FROM s JOIN dl ON s.machine_id = dl.machine_id
"""


@register("seven_day_window", SEVEN_SQL, ids=("A22", "A23", "A24", "A25", "M21", "W18"))
def seven_day_window_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per machine: probability trend slope, days until 60 %, daily max risk, latest risk."""
    sc = _scored_pct(spark, sf_dir)
    return ST.seven_day_window(sc, "machine_id", SENSOR_ORDER, "pct", "risk_level")


FLEETDAY_SQL = with_views(SENSOR, FLEET) + """
, per AS (SELECT CAST(ts AS DATE) AS day, machine_id, max(p) AS p, max(label) AS y FROM fleet GROUP BY ALL)
SELECT day, count(*) FILTER (WHERE p >= 6e-1) AS machines_at_risk, count(*) FILTER (WHERE p >= 8e-1) AS critical_count,
       count(*) AS machines, count(*) FILTER (WHERE y = 1) AS failing_machines,
       round(count(*) FILTER (WHERE y = 1) / count(*), 6) AS failing_ratio
FROM per GROUP BY day
"""


@register("fleet_by_day", FLEETDAY_SQL, ids=("A26",))
def fleet_by_day_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day: machines at risk, critical, all, failing, failing ratio."""
    d = ST.fleet_by_day(fleet_scored(Tables(spark, sf_dir)), "machine_id", "ts")
    return d.select("day", "machines_at_risk", "critical_count", "machines", "failing_machines",
                    r6(F.col("failing_ratio")).alias("failing_ratio"))


# --- A27-A30 -----------------------------------------------------------------------------------------
GRID = MT.threshold_grid("fine")
GRID_VALUES = ", ".join(f"({t!r}e0)" for t in GRID)
SWEEP_CTES = f"""
, th AS (SELECT * FROM (VALUES {GRID_VALUES}) v(threshold))
, c AS (SELECT threshold, sum(CASE WHEN p >= threshold AND label = 1 THEN 1 ELSE 0 END) AS tp,
               sum(CASE WHEN p >= threshold AND label = 0 THEN 1 ELSE 0 END) AS fp, sum(label) AS P
        FROM th, fleet GROUP BY threshold)
, m AS (SELECT threshold, {_sql_div('tp', 'tp + fp')} AS precision, {_sql_div('tp', 'P')} AS recall FROM c)
, sw AS (SELECT *, {_sql_div('2e0 * precision * recall', 'precision + recall')} AS f1,
                {_sql_div('3.25e0 * precision * recall', '2.25e0 * precision + recall')} AS f_beta FROM m)
"""
SWEEP_SQL = with_views(SENSOR, FLEET) + SWEEP_CTES + """
SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       round(f_beta, 6) AS f_beta FROM sw
"""


@register("threshold_sweep", SWEEP_SQL, ids=("A27",))
def threshold_sweep_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall, F1, F-beta at thresholds 0.20, 0.22, ..., 0.80."""
    s = MT.threshold_sweep(spark, _fleet(spark, sf_dir), "label", "p")
    return s.select("threshold", *[r6(F.col(c)).alias(c) for c in ["precision", "recall", "f1", "f_beta"]])


BEST_SQL = with_views(SENSOR, FLEET) + SWEEP_CTES + """
SELECT threshold, round(f_beta, 6) AS score FROM sw ORDER BY f_beta DESC, threshold ASC LIMIT 1
"""


@register("best_threshold", BEST_SQL, ids=("A28",))
def best_threshold_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold with the best F-beta(1.5); the smallest wins ties."""
    s = MT.threshold_sweep(spark, _fleet(spark, sf_dir), "label", "p")
    b = MT.best_threshold(s, "f_beta")
    return b.select("threshold", r6(F.col("score")).alias("score"))


GATES_VALUES = ", ".join(f"('{g}', '{m}', {v!r}e0)" for g, d in fv.QUALITY_GATES.items() for m, v in d.items())
GATES_SQL = with_views(SENSOR, FLEET, PRED) + f"""
, c AS (SELECT {COUNTS} FROM pr)
, mt AS (SELECT {_sql_div('tp', 'tp + fp')} AS precision, {_sql_div('tp', 'tp + fn')} AS recall FROM c)
, m2 AS (SELECT precision, recall, {_sql_div('2e0 * precision * recall', 'precision + recall')} AS f1 FROM mt)
{CURVE_CTES}
, auc AS (SELECT sum(neg * (tp0 + pos / 2e0)) / (max(P) * max(N)) AS roc_auc FROM pts)
, lg AS (SELECT 'precision' AS metric, precision AS value FROM m2 UNION ALL SELECT 'recall', recall FROM m2
         UNION ALL SELECT 'f1', f1 FROM m2 UNION ALL SELECT 'roc_auc', roc_auc FROM auc)
, g AS (SELECT * FROM (VALUES {GATES_VALUES}) v(gate_set, metric, minimum))
SELECT g.gate_set, g.metric, round(value, 6) AS value, minimum, value >= minimum AS passed
FROM lg JOIN g ON lg.metric = g.metric
"""


@register("quality_gates", GATES_SQL, ids=("A29",))
def quality_gates_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test metrics against the four gate sets -> pass table."""
    f = _fleet(spark, sf_dir)
    m = MT.classification_metrics(f).select("precision", "recall", "f1") \
        .unpivot([], ["precision", "recall", "f1"], "metric", "value")
    auc = MT.auc_summary(f, "label", "p").select(F.lit("roc_auc").alias("metric"), F.col("roc_auc").alias("value"))
    g = MT.quality_gates(spark, m.unionByName(auc))
    return g.select("gate_set", "metric", r6(F.col("value")).alias("value"), "minimum", "passed")


ATTR_SQL = with_views(SENSOR) + """
, b AS (SELECT torque*rpm*1.0471975511965977e-1 AS Power_W, wear*torque AS Wear_Torque, wear FROM sensor)
, mu AS (SELECT avg(Power_W) AS m1, avg(Wear_Torque) AS m2, avg(wear) AS m3 FROM b)
, a AS (SELECT 'Power_W' AS feature, avg(abs(2e-4 * (Power_W - m1))) AS v FROM b, mu
        UNION ALL SELECT 'Wear_Torque', avg(abs(3.5e-4 * (Wear_Torque - m2))) FROM b, mu
        UNION ALL SELECT 'wear', avg(abs(1e-2 * (wear - m3))) FROM b, mu)
SELECT feature, round(v, 6) AS mean_abs_attribution, CAST(row_number() OVER (ORDER BY v DESC) AS INTEGER) AS rank FROM a
"""


@register("attribution_ranking", ATTR_SQL, ids=("A30", "M15", "M14"))
def attribution_ranking_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean |coef * (x - mean)| per feature of the linear fleet model, ranked."""
    from ..models.explain import linear_attribution_ranking
    f = fleet_scored(Tables(spark, sf_dir))
    return linear_attribution_ranking(f, R.FLEET_COEFS)


MI_FEATURES = ["air_k", "proc_k", "rpm", "torque", "wear"]


def _mi_sql() -> str:
    parts = []
    for c in MI_FEATURES:
        parts.append(f"""SELECT '{c}' AS feature, label AS y,
  len(list_filter((SELECT list_distinct(quantile_cont({c}, [{', '.join(str(i / 10) for i in range(1, 10))}])) FROM sensor), lambda t: t < {c})) AS bin
  FROM sensor""")
    return with_views(SENSOR) + f"""
, lg AS ({' UNION ALL '.join(parts)})
, c AS (SELECT feature, bin, y, count(*) AS n FROM lg GROUP BY ALL)
, w AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS NN, sum(n) OVER (PARTITION BY feature, bin) AS nb,
               sum(n) OVER (PARTITION BY feature, y) AS ny FROM c)
SELECT feature, round(sum((n / NN) * ln((n * NN) / (nb * ny))), 6) AS mutual_info FROM w GROUP BY feature
"""


@register("mutual_information", _mi_sql(), ids=("M13",))
def mutual_information_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binned mutual information of each sensor with the failure label (10 quantile bins)."""
    m = ST.binned_mutual_information(Tables(spark, sf_dir).sensor, MI_FEATURES, "label", bins=10)
    return m.select("feature", r6(F.col("mutual_info")).alias("mutual_info"))
