"""Sampling and model queries.

M1-M3 are exact (md5 draws are reproducible in DuckDB).  Model queries
return one small metrics table each and are checked by tests with quality
floors (rows-only at the driver)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import physics as ph
from ..functions.numeric import round6, round_half_away
from ..models import isolation as ISO
from ..models import train as TR
from ..operators import sampling as SP
from ..session import scratch_path
from ..sources.tables import Tables
from .registry import register
from .sql_views import FLEET_PROB, SENSOR, with_views

SPLIT_KEYS = ["machine_id", "l_orderkey", "l_linenumber", "l_partkey"]


def _u_sql(keys: list[str], seed) -> str:
    ks = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in keys) + f" || '|{seed}'"
    return f"(CAST(('0x' || substr(md5({ks}), 1, 8)) AS BIGINT) / 4294967296e0)"


SPLIT_SQL = with_views(SENSOR) + f"""
SELECT label, CASE WHEN u < 7e-1 THEN 'train' WHEN u < 8e-1 THEN 'val' ELSE 'test' END AS split, count(*) AS n
FROM (SELECT label, {_u_sql(SPLIT_KEYS + ['label'], 42)} AS u FROM sensor) GROUP BY ALL
"""


def _split(spark, sf_dir) -> DataFrame:
    s = Tables(spark, sf_dir).sensor
    return SP.stratified_split(s, SPLIT_KEYS, "label", seed=42)


@register("stratified_split", SPLIT_SQL, ids=("M1", "D6"))
def stratified_split_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """70/10/20 split drawn from md5(key|label|seed) inside each class; rows per class and split."""
    return _split(spark, sf_dir).groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


OVER_SQL = with_views(SENSOR) + f"""
, c AS (SELECT label, count(*) AS n FROM sensor GROUP BY label)
, r AS (SELECT (SELECT max(n) FROM c) * 1e0 / (SELECT min(n) FROM c) AS ratio)
, m AS (SELECT s.label, CASE WHEN s.label = (SELECT label FROM c ORDER BY n DESC LIMIT 1) THEN 1
          ELSE CAST(floor(ratio) AS INTEGER) + CAST({_u_sql(SPLIT_KEYS, 7)} < ratio - floor(ratio) AS INTEGER) END AS reps
        FROM sensor s, r)
SELECT label, CAST(sum(reps) AS BIGINT) AS n FROM m GROUP BY label
"""


@register("oversample", OVER_SQL, ids=("M2",))
def oversample_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random oversampling of the minority class to about the majority size (keyed draws)."""
    s = Tables(spark, sf_dir).sensor
    return SP.oversample(s, SPLIT_KEYS, "label").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


UNDER_SQL = with_views(SENSOR) + f"""
, c AS (SELECT label, count(*) AS n FROM sensor GROUP BY label)
, k AS (SELECT s.label FROM sensor s JOIN c ON s.label = c.label
        WHERE c.n = (SELECT min(n) FROM c) OR {_u_sql(SPLIT_KEYS, 7)} < (SELECT min(n) FROM c) * 1e0 / c.n)
SELECT label, count(*) AS n FROM k GROUP BY label
"""


@register("undersample", UNDER_SQL, ids=("M3",))
def undersample_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Random undersampling of the majority class to about the minority size."""
    s = Tables(spark, sf_dir).sensor
    return SP.undersample(s, SPLIT_KEYS, "label").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


# --- models (checked by tests with quality floors) ---------------------------------------
#: Rows of a file of the training table.
FILE_ROWS = 250_000


def training_frame(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    """Split sensor readings with the 36 physics features (rpm mean fitted on train), written once:
    folds, trials and metrics all read the same table.  Features repeat values, so the table is far smaller than the work
    on it; it is dealt over enough files that every core reads some."""
    d = _split(spark, sf_dir)
    files = max(spark.sparkContext.defaultParallelism, -(-d.count() // FILE_ROWS))
    # Mean and class counts come from the table as it is read; only the rows that are written are dealt.
    rpm_mean = float(d.filter(F.col("split") == "train").agg(F.avg("rpm")).first()[0])
    d = TR.with_class_weights(d).repartition(files, *SPLIT_KEYS).withColumn(
        "type_enc", F.when(F.col("mtype") == "L", 0).when(F.col("mtype") == "M", 1).otherwise(2))
    keep = SPLIT_KEYS + ["label", "split"]
    feats = ph.physics_features(d, rpm_mean, keep=[*keep, "weight"]).select(*keep, *ph.FEATURE_COLUMNS, "weight")
    path = scratch_path(spark, f"models/features-{uuid.uuid4().hex}")
    feats.write.parquet(path)
    return spark.read.parquet(path), list(ph.FEATURE_COLUMNS)


def _metrics_row(spark, name: str, ev: dict) -> DataFrame:
    keys = ["roc_auc", "pr_auc", "average_precision", "precision", "recall", "f1"]
    return spark.createDataFrame([(name, *[float(ev[k]) for k in keys])],
                                 "model string, " + ", ".join(f"{k} double" for k in keys)) \
        .select("model", *[round6(F.col(k)).alias(k) for k in keys])


def _fit_eval(spark, sf_dir, kind: str, params=None, features=None, validation=False):
    df, feats = training_frame(spark, sf_dir)
    feats = features or feats
    if validation:
        tr = df.filter(F.col("split") != "test").withColumn("is_val", F.col("split") == "val")
        m = TR.train(tr, feats, kind, params, validation="is_val")
    else:
        m = TR.train(df.filter(F.col("split") == "train"), feats, kind, params)
    ev = TR.evaluate(TR.score(m, df.filter(F.col("split") == "test")), threshold=0.5)
    return m, ev, df, feats


@register("logistic_model", None, ids=("M6",))
def logistic_model_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced logistic regression on the 36 features; test-split quality."""
    _, ev, _, _ = _fit_eval(spark, sf_dir, "logistic")
    return _metrics_row(spark, "logistic", ev)


@register("forest_model", None, ids=("M7",))
def forest_model_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced random forest on the physics features; test-split quality."""
    _, ev, _, _ = _fit_eval(spark, sf_dir, "forest", {"numTrees": 100, "maxDepth": 8, "minInstancesPerNode": 2})
    return _metrics_row(spark, "forest", ev)


@register("gbt_model", None, ids=("M8",))
def gbt_model_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient-boosted trees (up to 200 rounds), positive weight, early stop on the validation split."""
    _, ev, _, _ = _fit_eval(spark, sf_dir, "gbt", {"maxIter": 200, "maxDepth": 5}, validation=True)
    return _metrics_row(spark, "gbt", ev)


@register("grid_search", None, ids=("M9",))
def grid_search_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5-fold F1 of the whole grid of balanced logistic models (6 strengths, l1 and l2), best first."""
    df, feats = training_frame(spark, sf_dir)
    res = TR.grid_search(df, feats, "logistic", TR.logistic_grid(df.count(), 30), keys=SPLIT_KEYS)
    return spark.createDataFrame([(str(r["params"]), float(r["f1_mean"]), float(r["f1_std"])) for r in res],
                                 "params string, f1_mean double, f1_std double")


@register("cv_f1", None, ids=("M11",))
def cv_f1_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5-fold F1 (mean, std) of the balanced logistic model, folds from md5 of the key."""
    df, feats = training_frame(spark, sf_dir)
    r = TR.kfold_f1(df, feats, "logistic", {"maxIter": 50}, k=5, keys=SPLIT_KEYS)
    return spark.createDataFrame([(float(r["f1_mean"]), float(r["f1_std"]))], "f1_mean double, f1_std double")


@register("random_search", None, ids=("M10",))
def random_search_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded random search over boosted trees and forests; F1 at 0.40 on validation.

    The function's 200 trials a learner, boosted ones with up to 200 rounds (README: time of a trial)."""
    df, feats = training_frame(spark, sf_dir)
    tr, val = df.filter(F.col("split") == "train"), df.filter(F.col("split") == "val")
    spaces = {"gbt": {"maxDepth": (3, 6), "stepSize": (0.05, 0.3), "maxIter": [200]},
              "forest": {"maxDepth": (4, 9), "numTrees": [50, 100], "minInstancesPerNode": (1, 4)}}
    rows = [(kind, str(r["params"]), float(r["score"]), float(r["roc_auc"]))
            for kind, space in spaces.items() for r in TR.random_search(tr, val, feats, kind, space)]
    return spark.createDataFrame(rows, "learner string, params string, f1_at_040 double, roc_auc double")


@register("calibration", None, ids=("M12",))
def calibration_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isotonic calibration: 5 folds' classifiers, each through its own map, averaged; quality of calibrated scores."""
    df, feats = training_frame(spark, sf_dir)
    pairs = TR.calibrate_folds(df.filter(F.col("split") == "train"), feats, "logistic", {"maxIter": 50}, k=5, keys=SPLIT_KEYS)
    cal = TR.calibrated_probability(pairs, df.filter(F.col("split") == "test"), "score")
    return _metrics_row(spark, "calibrated_logistic", TR.evaluate(cal))


ISO_SQL = with_views(SENSOR) + f"""
, s AS (SELECT round({FLEET_PROB}, 2) AS score, label FROM sensor)
, g AS (SELECT score, count(*) AS n, sum(label) AS pos, row_number() OVER (ORDER BY score) AS i FROM s GROUP BY score)
, c AS (SELECT *, sum(n) OVER (ORDER BY i) AS cn, sum(pos) OVER (ORDER BY i) AS cp FROM g)
, lowest AS (SELECT j.i AS j, k.i AS k, (k.cp - j.cp + j.pos) * 1e0 / (k.cn - j.cn + j.n) AS mean FROM c j JOIN c k ON k.i >= j.i)
, m AS (SELECT c.i, l.j, min(l.mean) AS least FROM c JOIN lowest l ON l.j <= c.i AND l.k >= c.i GROUP BY c.i, l.j)
SELECT c.score, c.n, CAST(c.pos AS BIGINT) AS pos, round(max(m.least), 6) AS calibrated
FROM c JOIN m ON m.i = c.i GROUP BY c.score, c.n, c.pos
"""


@register("isotonic_fit", ISO_SQL, ids=("M12",))
def isotonic_fit_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The isotonic map of the fleet score (two decimals) on the label: rows, failures and fitted value by score."""
    from ..models.isotonic import isotonic_map
    from .rowwise import fleet_scored
    s = fleet_scored(Tables(spark, sf_dir)).select(round_half_away(F.col("p"), 2).alias("score"), "label")
    by = s.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos"))
    return by.withColumn("calibrated", round6(isotonic_map(s).apply("score")))


@register("feature_importance", None, ids=("M14", "L4"))
def feature_importance_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-15 random-forest feature importances."""
    m, _, _, feats = _fit_eval(spark, sf_dir, "forest", {"numTrees": 100, "maxDepth": 6})
    return TR.feature_importance(m, feats, spark).orderBy(F.desc("importance")).limit(15)


@register("permutation_importance", None, ids=("M16",))
def permutation_importance_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drop in test ROC-AUC when one of the 36 features is permuted (keyed permutation), all in one scoring pass."""
    m, _, df, feats = _fit_eval(spark, sf_dir, "logistic")
    return TR.permutation_importance(lambda d: TR.score(m, d), df.filter(F.col("split") == "test"), feats, SPLIT_KEYS)


#: A fixed linear score of the raw sensors, for the importance that SQL can follow.
LINEAR = {"air_k": -0.05, "proc_k": 0.07, "rpm": -0.004, "torque": 0.09, "wear": 0.02}
PERM_KEYS = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in SPLIT_KEYS)


def _linear_sql(permuted: str) -> str:
    terms = [f"{w!r}e0 * {'_p_' + c if c == permuted else c}" for c, w in LINEAR.items()]
    return f"SELECT '{permuted}' AS feature, label, 0e0 + {' + '.join(terms)} AS score FROM p"


PERM_SQL = with_views(SENSOR) + f"""
, d AS (SELECT *, md5({PERM_KEYS} || '|11') AS draw,
          CAST(greatest(1, ceil(ln(greatest((SELECT count(*) FROM sensor) / 10000e0, 1e0)) / ln(16e0))) AS INTEGER) AS digits FROM sensor)
, o AS (SELECT *, substr(draw, 1, digits) AS bucket FROM d)
, p AS (SELECT *, {', '.join(f"CASE WHEN row_number() OVER w > 1 THEN lag({c}) OVER w ELSE last_value({c}) OVER z END AS _p_{c}" for c in LINEAR)}
        FROM o WINDOW w AS (PARTITION BY bucket ORDER BY draw, {', '.join(SPLIT_KEYS)}),
                      z AS (PARTITION BY bucket ORDER BY draw, {', '.join(SPLIT_KEYS)} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
, l AS ({' UNION ALL '.join(_linear_sql(c) for c in ["", *LINEAR])})
, rk AS (SELECT feature, label, rank() OVER (PARTITION BY feature ORDER BY score) + (count(*) OVER (PARTITION BY feature, score) - 1) / 2e0 AS r FROM l)
, a AS (SELECT feature, (sum(r) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2e0) / (sum(label) * (count(*) - sum(label))) AS auc
        FROM rk GROUP BY feature)
SELECT feature, round((SELECT auc FROM a WHERE feature = '') - auc, 6) AS auc_drop FROM a WHERE feature <> ''
"""


@register("permutation_linear", PERM_SQL, ids=("M16",))
def permutation_linear_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drop in ROC-AUC of a fixed linear score of the raw sensors when one of them is permuted."""
    from ..functions import rules as R
    s = Tables(spark, sf_dir).sensor
    out = TR.permutation_importance(lambda d: d.withColumn("score", R.linear_logit(LINEAR, 0.0)), s, list(LINEAR), SPLIT_KEYS)
    return out.select("feature", round6(F.col("auc_drop")).alias("auc_drop"))


@register("isolation_forest", None, ids=("M5", "P18"))
def isolation_forest_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isolation forest (200 trees, 256 rows each) on the 36 scaled features of the train split, exact offset at
    contamination 0.05, and every reading routed by status (validation error / sensor anomaly / scored)."""
    from ..functions import rules as R
    from ..operators.scoring import prediction_records
    df, feats = training_frame(spark, sf_dir)
    guarded, offset = ISO.anomaly_guard(df.filter(F.col("split") == "train"), df, feats, SPLIT_KEYS, 0.05)
    s = guarded.withColumns({n: F.col(f) for n, f in ph.FEATURE_NAME.items()} | {"ts": F.lit(None).cast("timestamp")})
    p = R.sigmoid(R.linear_logit(R.FLEET_COEFS, R.FLEET_INTERCEPT))
    rec = prediction_records(s, p, anomaly_score=F.col("anomaly_score"), keep=["anomaly_score"])
    return rec.groupBy("status").agg(F.count(F.lit(1)).alias("rows"),
                                     F.count_if(F.col("anomaly_score") < 0).alias("outliers"),
                                     F.lit(offset).alias("offset"))


@register("outlier_filter", None, ids=("M5",))
def outlier_filter_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isolation forest over the 36 features as a preprocessing filter (contamination 0.1): rows kept per class."""
    s, feats = training_frame(spark, sf_dir)
    kept = ISO.outlier_filter(s, feats, SPLIT_KEYS).groupBy("label").agg(F.count(F.lit(1)).alias("kept"))
    return s.groupBy("label").agg(F.count(F.lit(1)).alias("rows")).join(kept, "label", "left").fillna(0, ["kept"])


@register("model_registry", None, ids=("M19",))
def model_registry_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Save a model with its config under the shared checkpoint folder, load it, rescore."""
    m, ev, df, feats = _fit_eval(spark, sf_dir, "logistic", {"maxIter": 30})
    path = scratch_path(spark, f"models/{uuid.uuid4().hex}")
    rpm = df.filter(F.col("split") == "train").agg(F.avg("Rotational_speed__rpm")).first()[0]
    config = {"threshold": fv.PRODUCTION_THRESHOLD, "features": feats, "model_name": "logistic", "rpm_mean": float(rpm)}
    for _ in range(2):
        TR.save_model(m, path, config)
    m2, cfg = TR.load_model(path)
    ev2 = TR.evaluate(TR.score(m2, df.filter(F.col("split") == "test")), threshold=0.5)
    return spark.createDataFrame([(cfg["model_name"], int(cfg["version"]), float(cfg["rpm_mean"]), float(ev["roc_auc"]), float(ev2["roc_auc"]))],
                                 "model string, version int, rpm_mean double, roc_auc_before double, roc_auc_after double")


@register("gated_training", None, ids=("M18", "A29"))
def gated_training_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train the ensemble, choose the F-beta threshold on validation, test against the gate; retry once.

    The function's 200 boosting rounds, and 300 trials a boosted model on the retry (README: time of a trial)."""
    df, feats = training_frame(spark, sf_dir)
    r = TR.train_with_gates(df.filter(F.col("split") == "train"), df.filter(F.col("split") == "val"),
                            df.filter(F.col("split") == "test"), feats)
    return spark.createDataFrame([(a["kind"], float(a["beta"]), float(a["threshold"]), float(a["metrics"]["f1"]),
                                   float(a["metrics"]["roc_auc"]), bool(a["passed"])) for a in r["attempts"]],
                                 "model string, beta double, threshold double, f1 double, roc_auc double, passed boolean")


SMOTE_SQL = with_views(SENSOR) + f"""
, t AS (SELECT * FROM (SELECT *, {_u_sql(SPLIT_KEYS + ['label'], 42)} AS u FROM sensor) WHERE u < 7e-1)
, c AS (SELECT label, count(*) AS n FROM t GROUP BY label)
, r AS (SELECT label, ((SELECT max(n) FROM c) - n) * 1e0 / n AS ratio FROM c WHERE n < (SELECT max(n) FROM c))
SELECT label, 0 AS synthetic, n FROM c
UNION ALL
SELECT t.label, 1, CAST(sum(floor(ratio) + CAST({_u_sql(SPLIT_KEYS, 42)} < ratio - floor(ratio) AS INTEGER)) AS BIGINT)
FROM t JOIN r ON t.label = r.label GROUP BY t.label HAVING sum(floor(ratio) + CAST({_u_sql(SPLIT_KEYS, 42)} < ratio - floor(ratio) AS INTEGER)) > 0
"""


@register("smote_counts", SMOTE_SQL, ids=("M4",))
def smote_counts_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SMOTE on the training split over all 36 features: rows per class, original and synthetic."""
    from ..models.smote import smote
    df, feats = training_frame(spark, sf_dir)
    out = smote(df.filter(F.col("split") == "train"), feats, "label", SPLIT_KEYS)
    return out.groupBy("label", "synthetic").agg(F.count(F.lit(1)).alias("n"))
