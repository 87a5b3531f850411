"""Model training, search, calibration and registry on Spark ML (M6-M12, M14,
M16, M18, M19).

Training data stays one DataFrame with a ``split`` column; class weights come
from one small aggregate; every metric is computed with the exact metric
operators of :mod:`motorsight.operators.metrics` (not the 1000-bin evaluator).
"""

from __future__ import annotations

import functools
import itertools
import json
import math
import random
import uuid
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..operators import metrics as MT
from ..operators.sampling import fold_column, key_string
from ..session import scratch_path
from . import isotonic as ISO
from . import logistic as LG

#: Fits that the driver keeps running beside each other; each is a Spark job of its own.
PARALLEL_FITS = 4
#: Bytes that the tables of such fits may take together: each keeps its own copy of its rows while it runs, and copies
#: that don't fit into memory are written to disk and read again in every iteration.
FIT_BYTES = 4 << 30


def side_by_side(rows: int, features: int, parallelism: int = PARALLEL_FITS) -> int:
    """How many fits of ``rows`` rows run beside each other: up to ``parallelism``, one where their copies are large."""
    return max(1, min(parallelism, FIT_BYTES // max(8 * rows * (features + 2), 1)))


def in_parallel(function, items, parallelism: int = PARALLEL_FITS) -> list:
    """``function`` of every item, in their order, ``parallelism`` Spark jobs at a time."""
    bound = inheritable_thread_target(SparkSession.getActiveSession())(function)  # job groups and local properties go along
    with ThreadPoolExecutor(parallelism) as pool:
        return list(pool.map(bound, items))


def with_class_weights(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """M6: balanced weights n / (2 n_c), from one aggregate (one row per class)."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    n = sum(counts.values())
    k = len(counts)
    w = F.lit(1.0)
    for c, nc in counts.items():
        w = F.when(F.col(label) == c, F.lit(n / (k * nc))).otherwise(w)
    return df.withColumn(out, w)


def assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")


def positive_probability(pred: DataFrame, out: str = "score") -> DataFrame:
    return pred.withColumn(out, vector_to_array("probability")[1])


def evaluate(pred: DataFrame, label: str = "label", score: str = "score",
             threshold: float = 0.5, beta: float = fv.FBETA_BETA) -> dict:
    """A14 + A15/A17/A18 of a scored table, as a dict of floats."""
    return {k: float(v) for k, v in MT.evaluation(pred, label, score, threshold, beta).first().asDict().items()}


def make_estimator(kind: str, params: dict | None = None, weight: str | None = "weight",
                   validation: str | None = None):
    p = dict(params or {})
    if kind == "logistic":
        est = LogisticRegression(featuresCol="features", labelCol="label", maxIter=p.pop("maxIter", 100), **p)
    elif kind == "forest":
        est = RandomForestClassifier(featuresCol="features", labelCol="label", seed=42,
                                     numTrees=p.pop("numTrees", 100), **p)
    elif kind == "gbt":
        est = GBTClassifier(featuresCol="features", labelCol="label", seed=42, maxIter=p.pop("maxIter", 200), **p)
        if validation:
            est.setValidationIndicatorCol(validation)
    else:
        raise ValueError(kind)
    if weight:
        est.setWeightCol(weight)
    return est


def train(df: DataFrame, features: list[str], kind: str, params: dict | None = None,
          weight: str | None = "weight", validation: str | None = None) -> PipelineModel:
    """M6/M7/M8: assemble + one learner, fitted on the rows given."""
    if joint(kind, [params or {}]):
        [fitted] = LG.fit_all(LG.Rows(df, features, weight=weight), [LG.Fit(params or {})])
        return logistic_pipeline(df.sparkSession, features, fitted)
    return Pipeline(stages=[assembler(features), make_estimator(kind, params, weight, validation)]).fit(df)


def joint(kind: str, maps: list[dict]) -> bool:
    """Whether the fits of these parameters share their passes over the rows."""
    return kind == "logistic" and all(set(m) <= LG.PARAMETERS for m in maps)


def logistic_pipeline(spark: SparkSession, features: list[str], fitted: tuple) -> PipelineModel:
    return PipelineModel([assembler(features), LG.as_model(spark, *fitted)])


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    return positive_probability(model.transform(df))


def cross_validate(df: DataFrame, features: list[str], kind: str, maps: list[dict], k: int = 5,
                   keys: list[str] = ("row_id",), parallelism: int = PARALLEL_FITS) -> list[dict]:
    """F1 of the positive class (mean, population std over the folds) of every parameter map, on the same
    folds from md5 of the key, up to ``parallelism`` fits at a time."""
    found = _fold_f1s(df, features, kind, maps, k, keys, parallelism)
    return [{"params": m, "f1_mean": _mean(f1s), "f1_std": _std(f1s)} for m, f1s in zip(maps, found)]


def _mean(values: list[float]) -> float:
    return sum(values) / len(values)


def _std(values: list[float]) -> float:
    return (sum((x - _mean(values)) ** 2 for x in values) / len(values)) ** 0.5


def _fold_f1s(df: DataFrame, features: list[str], kind: str, maps: list[dict], k: int, keys: list[str], parallelism: int) -> list[list[float]]:
    """F1 on every fold for every parameter map.  Logistic models share every pass over the rows.  For other learners folds
    are read from the table again, never cached: a learner keeps its own copy of its rows, the only one while it runs."""
    if joint(kind, maps):
        rows = LG.Rows(fold_column(df, list(keys), k), features, fold="fold")
        fits = [LG.Fit(m, i) for m in maps for i in range(k)]
        found = LG.confusions(rows, fits, LG.fit_all(rows, fits))
        counts = df.sparkSession.createDataFrame([(i, *map(int, c)) for i, c in enumerate(found)], "fit int, tp long, fp long, fn long, tn long")
        f1s = [r["f1"] for r in sorted(MT.metrics_of(counts, ["fit"]).collect(), key=lambda r: r["fit"])]
        return [f1s[a:a + k] for a in range(0, len(f1s), k)]
    f = assembler(features).transform(fold_column(df, list(keys), k)).select("features", "label", "weight", "fold")

    def one(pair: tuple[dict, int]) -> float:
        m = make_estimator(kind, pair[0]).fit(f.filter(F.col("fold") != pair[1]))
        pred = m.transform(f.filter(F.col("fold") == pair[1])).withColumn("pred", F.col("prediction").cast("int"))
        return float(MT.classification_metrics(pred, "label", "pred").first()["f1"])

    f1s = in_parallel(one, [(m, i) for m in maps for i in range(k)], side_by_side(df.count(), len(features), parallelism))
    return [f1s[a:a + k] for a in range(0, len(f1s), k)]


def kfold_f1(df: DataFrame, features: list[str], kind: str, params: dict | None = None, k: int = 5,
             keys: list[str] = ("row_id",)) -> dict:
    """K-fold F1 (mean, std) of one parameter map, the folds beside each other."""
    f1s = _fold_f1s(df, features, kind, [params or {}], k, keys, PARALLEL_FITS)[0]
    return {"f1_mean": _mean(f1s), "f1_std": _std(f1s), "folds": f1s}


#: The logistic grid: inverse strengths and penalties (elasticNetParam 1 is l1, 0 is l2).
LOGISTIC_C, LOGISTIC_PENALTY = [0.001, 0.01, 0.1, 1, 10, 100], [1.0, 0.0]
#: The forest grid; unlimited depth is Spark's limit of 30, and only leaf sizes bound a split.
FOREST_GRID = {"numTrees": [100, 200, 300], "maxDepth": [10, 20, 30], "minInstancesPerNode": [1, 2, 4]}


def logistic_grid(rows: int, max_iter: int = 100) -> dict[str, list]:
    """C weighs the summed loss, regParam the penalty beside the mean loss: regParam = 1 / (C * rows)."""
    return {"regParam": [1.0 / (c * max(rows, 1)) for c in LOGISTIC_C], "elasticNetParam": LOGISTIC_PENALTY, "maxIter": [max_iter]}


def grid_maps(grid: dict[str, list]) -> list[dict]:
    return [dict(zip(grid, values)) for values in itertools.product(*grid.values())]


def grid_search(df: DataFrame, features: list[str], kind: str, grid: dict[str, list], k: int = 5,
                keys: list[str] = ("row_id",), parallelism: int = PARALLEL_FITS) -> list[dict]:
    """M9: k-fold F1 of every combination of ``grid`` on the same folds, best first (ties in grid order)."""
    return sorted(cross_validate(df, features, kind, grid_maps(grid), k, keys, parallelism), key=lambda r: -r["f1_mean"])


def sample_space(space: dict, n: int, seed: int = 42) -> list[dict]:
    """N parameter maps drawn from a seeded space (lists = choices, tuples = int/float ranges)."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        p = {}
        for k, v in space.items():
            if isinstance(v, list):
                p[k] = rng.choice(v)
            elif isinstance(v[0], int):
                p[k] = rng.randint(v[0], v[1])
            else:
                p[k] = rng.uniform(v[0], v[1])
        out.append(p)
    return out


def random_search(train_df: DataFrame, val_df: DataFrame, features: list[str], kind: str, space: dict,
                  n_trials: int = 200, threshold: float = 0.40, beta: float = 1.0, seed: int = 42,
                  parallelism: int = PARALLEL_FITS) -> list[dict]:
    """Train every sampled map on train, F-beta at the threshold on validation; ``parallelism`` trials at a
    time.  Boosted trees stop early once the validation rows no longer improve.  A map that is drawn again gives the
    same model (the learners' seed is fixed), so it is fitted once."""
    early = kind == "gbt"
    rows = train_df.withColumn("is_val", F.lit(False)).unionByName(val_df.withColumn("is_val", F.lit(True))) if early else train_df

    def trial(p: dict) -> dict:
        m = train(rows, features, kind, p, validation="is_val" if early else None)
        ev = evaluate(score(m, val_df), threshold=threshold, beta=beta)
        return {"params": p, "score": ev["f_beta"], "roc_auc": ev["roc_auc"], "rounds": m.stages[-1].getNumTrees if early else None}

    together = side_by_side(rows.count(), len(features), parallelism)
    maps = [tuple(p.items()) for p in sample_space(space, n_trials, seed)]
    distinct = list(dict.fromkeys(maps))
    found = dict(zip(distinct, in_parallel(lambda m: trial(dict(m)), distinct, together), strict=True))
    return sorted((found[m] for m in maps), key=lambda r: -r["score"])


def calibrate_folds(df: DataFrame, features: list[str], kind: str, params: dict | None = None, k: int = 5,
                    keys: list[str] = ("row_id",), parallelism: int = PARALLEL_FITS) -> list[tuple[PipelineModel, ISO.StepMap]]:
    """Per fold a classifier fitted on the other folds and the isotonic map of its scores on this one."""
    f = fold_column(df, list(keys), k)
    if joint(kind, [params or {}]):
        fits = [LG.Fit(params or {}, i) for i in range(k)]
        models = [logistic_pipeline(df.sparkSession, features, c) for c in LG.fit_all(LG.Rows(f, features, fold="fold"), fits)]

    def one(i: int):
        m = models[i] if joint(kind, [params or {}]) else train(f.filter(F.col("fold") != i), features, kind, params)
        return m, ISO.isotonic_map(score(m, f.filter(F.col("fold") == i)), "score", "label")

    return in_parallel(one, range(k), side_by_side(df.count(), len(features), parallelism))


def calibrated_probability(pairs: list[tuple[PipelineModel, ISO.StepMap]], df: DataFrame, out: str = "calibrated") -> DataFrame:
    """``df`` with the mean of the folds' calibrated probabilities, each classifier through its own map."""
    d = df
    for i, (m, step) in enumerate(pairs):
        d = score(m, d).drop("features", "rawPrediction", "probability", "prediction")
        d = d.withColumn(f"_cal{i}", step.apply("score")).drop("score")
    mean = functools.reduce(lambda a, b: a + b, [F.col(f"_cal{i}") for i in range(len(pairs))]) / len(pairs)
    return d.withColumn(out, mean).drop(*[f"_cal{i}" for i in range(len(pairs))])


def feature_importance(model: PipelineModel, features: list[str], spark: SparkSession) -> DataFrame:
    """Tree importances or absolute coefficients as a (feature, importance) table."""
    est = model.stages[-1]
    if hasattr(est, "featureImportances"):
        vals = est.featureImportances.toArray().tolist()
    else:
        vals = [abs(x) for x in est.coefficients.toArray().tolist()]
    return spark.createDataFrame(list(zip(features, [float(v) for v in vals])), "feature string, importance double")


def permuted(df: DataFrame, features: list[str], keys: list[str], seed: int = 11, bucket_rows: int = 10_000) -> DataFrame:
    """``df`` with ``_p_<c>`` for every feature: its value in the row before, in md5(key|seed) order inside
    buckets of the md5 (the first row of a bucket takes the last one's).  Every value moves to
    exactly one row of its bucket; buckets are random, so they stand for the whole table."""
    digits = max(1, math.ceil(math.log(max(df.count() / bucket_rows, 1), 16)))
    draw = F.md5(key_string(keys, seed))
    w = Window.partitionBy("_bucket").orderBy("_draw", *keys)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = df.withColumn("_draw", draw).withColumn("_bucket", F.substring("_draw", 1, digits))
    return d.select("*", *[F.when(F.row_number().over(w) > 1, F.lag(c).over(w)).otherwise(F.last(c).over(whole)).alias(f"_p_{c}")
                           for c in features]).drop("_draw", "_bucket")


def permuted_long(df: DataFrame, features: list[str], keys: list[str], label: str = "label", seed: int = 11,
                  bucket_rows: int = 10_000) -> DataFrame:
    """Every row once as it is (feature '') and once for each feature, with that feature's value permuted; so one
    scoring pass serves all features.  The permuted columns are written once."""
    path = scratch_path(df.sparkSession, f"models/permuted-{uuid.uuid4().hex}")
    permuted(df.select(*dict.fromkeys([*keys, *features, label])), features, keys, seed, bucket_rows).write.parquet(path)
    d = df.sparkSession.read.parquet(path).withColumn("feature", F.explode(F.array(F.lit(""), *map(F.lit, features))))
    return d.select("feature", label, *[F.when(F.col("feature") == c, F.col(f"_p_{c}")).otherwise(F.col(c)).alias(c) for c in features])


def permutation_importance(scorer, df: DataFrame, features: list[str], keys: list[str], label: str = "label",
                           seed: int = 11, bucket_rows: int = 10_000) -> DataFrame:
    """Rows (feature, auc_drop): the fall in ROC-AUC when one column is permuted, for all features in one pass.
    ``scorer`` adds the column ``score`` to a table of the features."""
    scored = scorer(permuted_long(df, features, keys, label, seed, bucket_rows)).select("feature", label, "score")
    auc = MT.auc_by_group(scored, "feature", label).collect()  # one row a feature
    base = next((r["roc_auc"] for r in auc if r["feature"] == ""), 0.0)
    rows = sorted(((r["feature"], float(base - r["roc_auc"])) for r in auc if r["feature"]), key=lambda t: (-t[1], t[0]))
    return df.sparkSession.createDataFrame(rows, "feature string, auc_drop double")


def _version_folders(spark: SparkSession, base: str):
    """The file system of ``base`` and its version folders, finished or only claimed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
    return fs, {int(p.getName()[1:]): p for p in names if p.getName()[:1] == "v" and p.getName()[1:].isdigit()}


def versions(spark: SparkSession, base: str) -> list[int]:
    """The saved versions under ``base``, ascending; a version counts once its config is written."""
    fs, found = _version_folders(spark, base)
    return sorted(n for n, p in found.items() if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "config/_SUCCESS")))


def claim_version(spark: SparkSession, base: str) -> int:
    """Take the next free version number: its folder's claim is created exclusively, so of two writers one goes on
    to the next number.  (HDFS creates a file exclusively, a local disk a folder.)"""
    jvm = spark._jvm
    fs, found = _version_folders(spark, base)
    version = max(found, default=0) + 1
    while True:
        claim = jvm.org.apache.hadoop.fs.Path(f"{base}/v{version:06d}/_claim")
        fs.mkdirs(claim.getParent())
        try:
            if fs.getUri().getScheme() == "file":
                jvm.java.nio.file.Files.createDirectory(jvm.java.io.File(claim.toUri().getPath()).toPath(), _no_attributes(spark))
            else:
                fs.create(claim, False).close()
            return version
        except Py4JJavaError as e:
            if "AlreadyExists" not in e.java_exception.getClass().getName():
                raise
            version += 1


def _no_attributes(spark: SparkSession):
    return spark.sparkContext._gateway.new_array(spark._jvm.java.nio.file.attribute.FileAttribute, 0)


def save_model(model: PipelineModel, base: str, config: dict) -> int:
    """Save as the next version under ``base``: the Spark ML model, then a JSON config
    (threshold, rpm mean, feature list).  Returns the version."""
    spark = SparkSession.getActiveSession()
    version = claim_version(spark, base)
    path = f"{base}/v{version:06d}"
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(config | {"version": version}),)], "config string").coalesce(1) \
        .write.mode("overwrite").text(f"{path}/config")
    return version


def load_model(base: str, version: int | None = None) -> tuple[PipelineModel, dict]:
    """A saved version, by default the latest."""
    spark = SparkSession.getActiveSession()
    version = version or max(versions(spark, base))
    path = f"{base}/v{version:06d}"
    cfg = json.loads(spark.read.text(f"{path}/config").first()[0])
    return PipelineModel.load(f"{path}/model"), cfg


def ensemble_score(models: list[PipelineModel], weights: list[float], df: DataFrame) -> DataFrame:
    """weighted mean of the models' probabilities as ``score``."""
    out, total = df, sum(weights)
    for i, m in enumerate(models):
        out = score(m, out).drop("features", "rawPrediction", "probability", "prediction").withColumnRenamed("score", f"_s{i}")
    mean = functools.reduce(lambda a, b: a + b, [F.col(f"_s{i}") * F.lit(w / total) for i, w in enumerate(weights)])
    return out.withColumn("score", mean).drop(*[f"_s{i}" for i in range(len(models))])


#: The space of boosted-tree parameters searched on a retry.
RETRY_SPACE = {"maxDepth": (3, 7), "stepSize": (0.05, 0.3)}


def train_with_gates(train_df: DataFrame, val_df: DataFrame, test_df: DataFrame, features: list[str],
                     gates: dict | None = None, rounds: int = 200, trials: int = 300, seed: int = 42) -> dict:
    """An ensemble of a forest and two boosted models (weights 1:2:2), its F-beta threshold
    chosen on validation, tested against the gates.  On failure both boosted models are
    searched anew (``trials`` each, F2 at 0.35) and weighted 1:3:2."""
    gates = gates or fv.QUALITY_GATES["final"]
    spark = SparkSession.getActiveSession()
    boosted = [{"maxDepth": 5, "maxIter": rounds}, {"maxDepth": 4, "stepSize": 0.2, "maxIter": rounds}]
    attempts = []
    for beta, weights in ((fv.FBETA_BETA, (1.0, 2.0, 2.0)), (fv.FBETA_BETA_RETRY, (1.0, 3.0, 2.0))):
        if attempts:
            space = RETRY_SPACE | {"maxIter": [rounds]}
            boosted = [random_search(train_df, val_df, features, "gbt", space, trials, 0.35, 2.0, seed + i)[0]["params"] for i in range(2)]
        learners = [("forest", None), *[("gbt", p) for p in boosted]]
        models = in_parallel(lambda kp: train(train_df, features, *kp), learners, side_by_side(train_df.count(), len(features)))
        sweep = MT.threshold_sweep(spark, ensemble_score(models, weights, val_df), "label", "score", beta=beta)
        thr = MT.best_threshold(sweep).first()["threshold"]
        ev = evaluate(ensemble_score(models, weights, test_df), threshold=thr)
        passed = all(ev.get(k, 0.0) >= v for k, v in gates.items())
        attempts.append({"kind": "ensemble " + ":".join(f"{w:g}" for w in weights), "beta": beta, "threshold": thr, "metrics": ev, "passed": passed})
        if passed:
            break
    return {"attempts": attempts, "passed": attempts[-1]["passed"]}
