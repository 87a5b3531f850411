"""What keeps a query's time in proportion to its rows: work done once a row, passes over the table."""

import pandas as pd
from pyspark.sql import functions as F

from motorsight.functions.numeric import bucket_index
from motorsight.models import train as TR
from motorsight.operators import metrics as MT
from motorsight.operators import quantiles as Q
from motorsight.operators import scoring as SC
from motorsight.operators import stats as ST
from motorsight.operators.prefix import running_sums
from motorsight.streaming import streams as SS


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_prediction_records_work_out_each_value_once(spark):
    """Warnings, modes and probability are columns of their own, not an expression in every field (F16)."""
    df = spark.createDataFrame([(1, None, 300.0, 310.0, 1500.0, 40.0, 10.0)], "machine_id long, ts timestamp, air_k double, proc_k double, rpm double, torque double, wear double")
    rec = SC.records_to_json(SC.prediction_records(df.repartition(1), 1.0 / (1.0 + F.exp(-F.col("wear") / F.col("rpm")))))
    plan = _plan(rec)
    assert plan.count("EXP(") == 1 and plan.count("lambdafunction(") == 2


def test_quantiles_and_bins_without_a_row_for_every_value(spark, monkeypatch):
    """Quantiles from narrow ranges, and bins counted inside the tasks, are those of the full counts."""
    monkeypatch.setattr(Q, "GUESS_ROWS", 20_000)
    df = spark.range(40_000).select(
        F.when(F.col("id") % 11 > 0, F.sin("id") * 1e3).alias("a"), (F.col("id") % 7).cast("double").alias("b"),
        F.lit(None).cast("double").alias("c"), F.when(F.col("id") % 2 == 0, float("nan")).otherwise(F.cos("id")).alias("d"),
        F.when(F.col("id") % 5 > 0, F.col("id") % 3).alias("y"))
    names, qs = ["a", "b", "c", "d"], [i / 10 for i in range(1, 10)]
    want = {r["column"]: r["q"] for r in Q.profile(df, names, qs).collect()}
    written = []
    monkeypatch.setattr(Q, "running_sums", lambda t, *a, **kw: written.append(t.count()) or running_sums(t, *a, **kw))
    got = Q.exact_quantiles(df, names, qs)
    assert all(str(got[c]) == str(want[c]) for c in names)
    assert written[0] < 28_000  # all distinct values: 56,000
    edges = [sorted(set(e for e in want[c] or [] if e == e)) for c in names]
    counts = {(r.feature, r.bin, r.y): r.n for r in ST.bin_counts(df, names, edges, "y").collect()}
    plain = {}
    for c, e in zip(names, edges):
        for r in df.groupBy((bucket_index(F.col(c), e) if e else F.lit(0)).alias("bin"), "y").count().collect():
            plain[c, r["bin"], r["y"]] = r["count"]
    assert counts == plain


def test_ema_state_takes_one_entry_for_the_rows_of_a_call():
    """A call's readings wait as one entry of the list state, and few state calls are made a machine."""
    class State:
        calls, held = 0, None

        def __getattr__(self, name):
            def call(*a):
                State.calls += 1
                if name == "appendValue":
                    self.held = [*(self.held or []), a[0]]
                elif name == "appendList":
                    self.held = [*(self.held or []), *a[0]]
                elif name == "put":
                    self.held = a[0]
                elif name == "clear":
                    self.held = None
                return (iter(self.held or []) if name == "get" else self.held is not None) if self.listed else self.held
            return call

    class Handle:
        def getListState(self, *a):
            self.waiting = State()
            self.waiting.listed = True
            return self.waiting

        def getValueState(self, *a):
            s = State()
            s.listed = False
            s.update = lambda v: setattr(s, "held", v)
            return s

        def registerTimer(self, at):
            State.calls += 1

    class Timer:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    handle, ema = Handle(), SS.EventTimeEma(3, 10**12)
    ema.init(handle)
    x = pd.Series([float(i * 7 % 5) if i % 4 else None for i in range(90)])
    ts = pd.to_datetime(pd.Series(range(90)), unit="s")
    list(ema.handleInputRows((1,), iter([pd.DataFrame({"event_id": range(90), "ts": ts, "x": x}).sample(frac=1, random_state=1)]), Timer(0)))
    assert len(handle.waiting.held) == 1
    first = list(ema.handleExpiredTimer((1,), Timer(50_000), None))
    rest = list(ema.handleExpiredTimer((1,), Timer(10**8), None))
    got = pd.concat(first + rest)
    assert len(first[0]) == 50 and got["event_id"].tolist() == list(range(90))
    want = x.ewm(span=3, adjust=False).mean()
    assert (got["ema"].reset_index(drop=True) - want).abs().max() < 1e-12 and State.calls <= 10


def test_evaluation_scores_the_rows_once(spark):
    """All metrics come from one pass over the scored rows, and are those of the separate operators."""
    scored = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(i):
        scored.add(1)
        return i * 37 % 101 / 100.0

    df = spark.range(1000).select(F.when(F.col("id") % 17 > 0, (F.col("id") % 3 == 0).cast("int")).alias("label"), score("id").alias("score"))
    got = TR.evaluate(df, threshold=0.4, beta=2.0)
    assert scored.value == 1000
    m = MT.classification_metrics(df.withColumn("pred", (F.col("score") >= 0.4).cast("int")), beta=2.0).first().asDict()
    want = m | MT.auc_summary(df).first().asDict()
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_searches_run_every_trial(spark, monkeypatch):
    """The query hands on the function's 200 trials a learner; a map drawn twice is fitted once and listed twice."""
    from motorsight.plans import ml_plans
    fitted = []

    def train(rows, features, kind, params, validation=None):
        fitted.append((kind, tuple(params.items())))
        return type("Fitted", (), {"stages": [type("Trees", (), {"getNumTrees": 1})]})()

    frame = spark.createDataFrame([(1, "train"), (0, "val")], "label int, split string")
    monkeypatch.setattr(ml_plans, "training_frame", lambda *a: (frame, ["x"]))
    monkeypatch.setattr(TR, "train", train)
    monkeypatch.setattr(TR, "score", lambda m, df: df)
    monkeypatch.setattr(TR, "evaluate", lambda *a, **kw: {"f_beta": 0.5, "roc_auc": 0.5})
    rows = ml_plans.random_search_q(spark, "").collect()
    assert [sum(r.learner == kind for r in rows) for kind in ("gbt", "forest")] == [200, 200]
    assert len(set(fitted)) == len(fitted) < 400 and len({(r.learner, r.params) for r in rows}) == len(fitted)


def test_gated_training_runs_all_rounds_and_trials(spark, monkeypatch):
    """The query trains 200 boosting rounds, and its retry searches 300 trials for each boosted model."""
    from motorsight.plans import ml_plans
    fitted, searched = [], []

    def search(tr, val, feats, kind, space, n_trials=200, *a, **kw):
        searched.append((n_trials, space["maxIter"]))
        return [{"params": {"maxIter": space["maxIter"][0]}}]

    frame = spark.createDataFrame([(i % 2, s) for i in range(4) for s in ("train", "val", "test")], "label int, split string")
    monkeypatch.setattr(ml_plans, "training_frame", lambda *a: (frame, ["x"]))
    monkeypatch.setattr(TR, "train", lambda rows, feats, kind, params: fitted.append((kind, (params or {}).get("maxIter"))))
    monkeypatch.setattr(TR, "random_search", search)
    monkeypatch.setattr(TR, "ensemble_score", lambda models, weights, df: df.withColumn("score", F.lit(0.5)))
    got = ml_plans.gated_training_q(spark, "").collect()
    assert len(got) == 2 and not any(r.passed for r in got)
    assert sorted(fitted, key=str) == sorted([("forest", None), ("gbt", 200), ("gbt", 200)] * 2, key=str)
    assert searched == [(300, [200])] * 2


def test_logistic_fits_share_their_passes_and_equal_sparks(spark, monkeypatch):
    """Folds and grid points are fitted in passes over the rows that serve them all, with the coefficients of Spark's
    learner: without a penalty, with l2 and with l1 (F2)."""
    from motorsight.models import logistic as LG
    from motorsight.operators.sampling import fold_column
    df = spark.range(4000).select(
        "id", *[(F.sin(F.col("id") * (i + 1.7)) * 10.0 ** i).alias(f"x{i}") for i in range(4)], F.lit(3.0).alias("x4"),
        (F.sin(F.col("id") * 1.7) + F.sin(F.col("id") * 2.7) + 0.8 * F.sin(F.col("id") * 9.1) > 0.4).cast("int").alias("label"),
        F.when(F.col("id") % 3 == 0, 2.0).otherwise(0.5).alias("weight"))
    feats, passes, losses = [f"x{i}" for i in range(5)], [], LG.losses
    monkeypatch.setattr(LG, "losses", lambda rows, fits, *a: passes.append(len(fits)) or losses(rows, fits, *a))
    f = fold_column(df, ["id"], 3)
    maps = [{"maxIter": 25}, {"maxIter": 12, "regParam": 0.03}, {"maxIter": 12, "regParam": 0.03, "elasticNetParam": 1.0}]
    fits = [LG.Fit(m, i) for m in maps for i in (0, 1, 2, None)]
    got = LG.fit_all(LG.Rows(f, feats, fold="fold"), fits)
    assert passes[0] == len(fits) and len(passes) <= 40
    for fit, (coef, intercept) in zip(fits, got):
        d = f if fit.fold is None else f.filter(F.col("fold") != fit.fold)
        want = TR.make_estimator("logistic", fit.params).fit(TR.assembler(feats).transform(d))
        assert max(abs(coef - want.coefficients.toArray())) < 1e-7 and abs(intercept - want.intercept) < 1e-6
    del passes[:]
    f1s = TR.cross_validate(df, feats, "logistic", maps, 3, ["id"])
    assert passes[0] == 9 and len(passes) <= 40
    m = TR.make_estimator("logistic", maps[2]).fit(TR.assembler(feats).transform(f.filter("fold <> 0")))
    pred = m.transform(TR.assembler(feats).transform(f.filter("fold = 0"))).withColumn("pred", F.col("prediction").cast("int"))
    one = TR.kfold_f1(df, feats, "logistic", maps[2], 3, ["id"])
    assert abs(one["folds"][0] - MT.classification_metrics(pred).first()["f1"]) < 1e-12 and one["f1_mean"] == f1s[2]["f1_mean"]
