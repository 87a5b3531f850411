"""Sampling draws (exact, keyed), model quality floors, calibration, registry, isolation forest."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from motorsight.models import isolation as ISO
from motorsight.models import train as TR
from motorsight.operators import sampling as SP
from motorsight.plans.ml_plans import SPLIT_KEYS, training_frame
from motorsight.sources.tables import Tables


def test_split_is_keyed_and_partition_free(spark):
    s = Tables(spark, SF_SMALL).sensor
    a = SP.stratified_split(s, SPLIT_KEYS, "label").groupBy("split").count().collect()
    b = SP.stratified_split(s.repartition(7), SPLIT_KEYS, "label").groupBy("split").count().collect()
    assert sorted(a) == sorted(b)
    share = {r[0]: r[1] for r in a}
    n = sum(share.values())
    assert abs(share["train"] / n - 0.7) < 0.03 and abs(share["test"] / n - 0.2) < 0.03


def test_resampling_balances(spark):
    s = Tables(spark, SF_SMALL).sensor
    over = {r[0]: r[1] for r in SP.oversample(s, SPLIT_KEYS, "label").groupBy("label").count().collect()}
    assert abs(over[0] / over[1] - 1) < 0.1
    under = {r[0]: r[1] for r in SP.undersample(s, SPLIT_KEYS, "label").groupBy("label").count().collect()}
    assert abs(under[0] / under[1] - 1) < 0.2


def test_gbt_quality_floor_and_registry(spark, tmp_path):
    df, feats = training_frame(spark, SF_SMALL)
    tr, te = df.filter(F.col("split") != "test"), df.filter(F.col("split") == "test")
    m = TR.train(tr.withColumn("is_val", F.col("split") == "val"), feats, "gbt", {"maxIter": 15, "maxDepth": 5},
                 validation="is_val")
    ev = TR.evaluate(TR.score(m, te))
    assert ev["roc_auc"] >= 0.95
    base = str(tmp_path / "m")
    assert TR.versions(spark, base) == []
    assert [TR.save_model(m, base, {"threshold": t, "rpm_mean": 1.5}) for t in (0.5, 0.42)] == [1, 2]
    m2, cfg = TR.load_model(base)
    assert cfg == {"threshold": 0.42, "rpm_mean": 1.5, "version": 2} and TR.load_model(base, 1)[1]["threshold"] == 0.5
    assert TR.evaluate(TR.score(m2, te))["roc_auc"] == ev["roc_auc"]


def _pav(scores, labels):
    """Pool adjacent violators, one block after the other."""
    import itertools
    pairs = sorted(zip(scores, labels))
    blocks = []
    for x, g in itertools.groupby(pairs, key=lambda p: p[0]):
        ys = [y for _, y in g]
        blocks.append([sum(ys), len(ys), [x]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, xs = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + xs]
    return {x: s / n for s, n, xs in blocks for x in xs}


def test_isotonic_equals_pool_adjacent_violators(spark, monkeypatch):
    """Hulls of ranges, merged, give the blocks of the plain algorithm, monotone, for any number of ranges."""
    import random
    from motorsight.models import isotonic
    rnd = random.Random(4)
    xs = [round(rnd.random(), 3) for _ in range(3000)]
    ys = [int(rnd.random() < x * x) for x in xs]
    df = spark.createDataFrame(list(zip(xs, ys)), "score double, label int")
    want = _pav(xs, ys)
    for points, fan in ((1 << 16, 16), (40, 3), (7, 2)):
        monkeypatch.setattr(isotonic, "PART_POINTS", points)
        monkeypatch.setattr(isotonic, "FAN_IN", fan)
        step = isotonic.isotonic_map(df)
        got = {r.score: r.v for r in df.select("score", step.apply("score").alias("v")).distinct().collect()}
        assert set(got) == set(want) and max(abs(got[x] - want[x]) for x in want) < 1e-12
        values = [got[x] for x in sorted(got)]
        assert all(b >= a for a, b in zip(values, values[1:])) and 0 <= values[0] and values[-1] <= 1
    blocks = isotonic.isotonic_blocks(df).collect()
    assert sum(b.n for b in blocks) == 3000 and all(b.lo <= b.hi for b in blocks)
    outside = spark.createDataFrame([(-1.0,), (2.0,)], "score double").select(step.apply("score").alias("v")).collect()
    assert [r.v for r in outside] == [values[0], values[-1]]
    one = spark.createDataFrame([(0.5, 1)], "score double, label int")
    assert isotonic.isotonic_map(one).values.tolist() == [1.0]


def test_calibration_uses_each_folds_own_classifier(spark):
    df, feats = training_frame(spark, SF_SMALL)
    df = df.dropDuplicates(SPLIT_KEYS).cache()
    tr = df.filter(F.col("split") == "train")
    pairs = TR.calibrate_folds(tr, feats[:6], "logistic", {"maxIter": 30}, k=3, keys=SPLIT_KEYS)
    assert len({str(m.stages[-1].coefficients) for m, _ in pairs}) == 3
    out = TR.calibrated_probability(pairs, df)
    each = [step.apply("score") for _, step in pairs]
    byhand = [TR.score(m, df).select(*SPLIT_KEYS, c.alias(f"c{i}")) for i, ((m, _), c) in enumerate(zip(pairs, each))]
    both = out.select(*SPLIT_KEYS, "calibrated")
    for b in byhand:
        both = both.join(b, SPLIT_KEYS)
    worst = both.select(F.max(F.abs(F.col("calibrated") - (F.col("c0") + F.col("c1") + F.col("c2")) / 3))).first()[0]
    assert worst < 1e-12 and out.columns == [*df.columns, "calibrated"]


def test_two_writers_get_two_versions(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor
    base = str(tmp_path / "registry")
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda _: TR.claim_version(spark, base), range(24)))
    assert sorted(got) == list(range(1, 25))
    assert TR.versions(spark, base) == []  # claimed, not written


def test_importance_in_one_pass_equals_feature_by_feature(spark):
    df, feats = training_frame(spark, SF_SMALL)
    feats = feats[:5]
    m = TR.train(df.filter(F.col("split") == "train"), feats, "logistic", {"maxIter": 20})
    test = df.filter(F.col("split") == "test")
    got = {r.feature: r.auc_drop for r in TR.permutation_importance(lambda d: TR.score(m, d), test, feats, SPLIT_KEYS).collect()}
    d = TR.permuted(test, feats, SPLIT_KEYS).cache()
    base = TR.evaluate(TR.score(m, d))["roc_auc"]
    for c in feats:
        assert abs(got[c] - (base - TR.evaluate(TR.score(m, d.drop(c).withColumnRenamed(f"_p_{c}", c)))["roc_auc"])) < 1e-9
    assert set(got) == set(feats)


def test_cross_validation_folds_beside_each_other(spark):
    df, feats = training_frame(spark, SF_SMALL)
    one = TR.kfold_f1(df, feats[:5], "logistic", {"maxIter": 10, "regParam": 0.01}, k=3, keys=SPLIT_KEYS)
    cv = TR.cross_validate(df, feats[:5], "logistic", [{"maxIter": 10, "regParam": 0.01}], k=3, keys=SPLIT_KEYS)[0]
    assert abs(one["f1_mean"] - cv["f1_mean"]) < 1e-6 and abs(one["f1_std"] - cv["f1_std"]) < 1e-6
    assert len(TR.grid_maps(TR.logistic_grid(1000))) == 12 and len(TR.grid_maps(TR.FOREST_GRID)) == 27


def test_large_fits_run_alone_and_folds_are_not_cached(spark, monkeypatch):
    assert TR.side_by_side(1000, 36) == TR.PARALLEL_FITS and TR.side_by_side(36_000_000, 36) == 1
    assert 1 < TR.side_by_side(3_600_000, 36) <= TR.PARALLEL_FITS
    df, feats = training_frame(spark, SF_SMALL)
    cached = []
    monkeypatch.setattr(type(df), "cache", lambda self: cached.append(self) or self)
    got = TR.cross_validate(df, feats[:3], "logistic", [{"maxIter": 3}, {"maxIter": 6}], k=2, keys=SPLIT_KEYS)
    assert [r["params"]["maxIter"] for r in got] == [3, 6] and not cached


def test_anomaly_guard_is_fitted_on_the_train_split_alone(spark):
    df, feats = training_frame(spark, SF_SMALL)
    tr = df.filter(F.col("split") == "train")
    a, offset = ISO.anomaly_guard(tr, df, feats, SPLIT_KEYS, 0.05, trees=30)
    changed = df.withColumns({c: F.when(F.col("split") == "test", F.col(c) * 50).otherwise(F.col(c)) for c in feats})
    b, same = ISO.anomaly_guard(changed.filter(F.col("split") == "train"), changed, feats, SPLIT_KEYS, 0.05, trees=30)
    assert offset == same and a.columns == [*df.columns, "anomaly_raw", "anomaly_score"]
    share = a.filter("split = 'train' and anomaly_score < 0").count() / tr.count()
    assert abs(share - 0.05) < 0.002  # the exact quantile
    flagged = [d.filter("split = 'test' and anomaly_score < 0").count() for d in (a, b)]
    assert flagged[1] > 2 * flagged[0]


def test_isolation_forest_share(spark):
    s = Tables(spark, SF_SMALL).sensor
    raw = ["air_k", "proc_k", "rpm", "torque", "wear"]
    forest = ISO.fit(s, raw, SPLIT_KEYS, trees=30)
    assert forest.count() == 30
    d, _ = ISO.decision(ISO.score(s, forest, raw), 0.05)
    share = d.filter(F.col("anomaly_score") < 0).count() / d.count()
    assert 0.02 < share < 0.08


def test_path_lengths_equal_a_plain_walk():
    import numpy as np
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4)).round(1)
    x[7, 2] = np.nan
    grown = np.nan_to_num(x)
    forest = [ISO._grow(grown[rng.choice(300, 64, replace=False)], rng, 6) for _ in range(9)] + [ISO._grow(grown[:1], rng, 6)]

    def walk(row, tree):
        f, th, lf, rt, sz = tree
        node = depth = 0
        while f[node] >= 0:
            node, depth = (lf if row[f[node]] < th[node] else rt)[node], depth + 1
        return depth + ISO.c_factor(sz[node])

    want = [sum(walk(r, t) for t in forest) / len(forest) for r in x]
    assert np.allclose(ISO._path_lengths(x, ISO._heaps(forest)), want, rtol=1e-12, atol=0)


def test_training_table_is_dealt_over_all_cores(spark):
    df, _ = training_frame(spark, SF_SMALL)
    assert df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert df.count() == Tables(spark, SF_SMALL).lineitem.count()


def _brute(pts, k=5):
    import numpy as np
    d = np.sqrt(((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    return [sorted(range(len(pts)), key=lambda j: (d[i, j], j))[:k] for i in range(len(pts))]


def _neighbours(spark, pts):
    from motorsight.models.smote import nearest_points
    names = [f"f{i}" for i in range(pts.shape[1])]
    df = spark.createDataFrame([(int(i), *map(float, p)) for i, p in enumerate(pts)], "pid long, " + ", ".join(f"{c} double" for c in names))
    got = {}
    for r in nearest_points(df, names, k=5).collect():
        got.setdefault(r.pid, []).append((r["rank"], r.nid))
    return [[n for _, n in sorted(got[i])] for i in range(len(pts))]


def test_neighbours_in_one_leaf_are_exact(spark):
    import numpy as np
    pts = np.random.default_rng(3).normal(size=(400, 3)).round(3)
    pts[:50, 0] *= 5          # uneven density
    assert _neighbours(spark, pts) == _brute(pts)


def _recall(spark, pts):
    got = _neighbours(spark, pts)
    want = []
    for a in range(0, len(pts), 500):
        d = ((pts[a: a + 500, None, :] - pts[None, :, :]) ** 2).sum(-1) if len(pts) <= 4000 else \
            (pts[a: a + 500] ** 2).sum(1)[:, None] + (pts ** 2).sum(1)[None, :] - 2 * pts[a: a + 500] @ pts.T
        d[range(len(d)), range(a, a + len(d))] = float("inf")
        want += d.argsort(axis=1)[:, :5].tolist()
    assert all(len(g) == 5 for g in got)
    return sum(len(set(g) & set(w)) for g, w in zip(got, want)) / (5 * len(pts))


def test_neighbours_over_many_leaves_and_36_features(spark, monkeypatch):
    """Recall against brute force, on points of latent dimension 4 and on independent ones; leaves of 128."""
    import numpy as np
    from motorsight.models import smote
    monkeypatch.setattr(smote, "LEAF_ROWS", 128)
    rng = np.random.default_rng(5)
    latent = rng.normal(size=(2000, 4)) @ rng.normal(size=(4, 36)) + 0.05 * rng.normal(size=(2000, 36))
    assert _recall(spark, latent) >= 0.95
    assert _recall(spark, rng.normal(size=(2000, 36))) >= 0.95


def test_leaves_are_bounded_at_any_size(spark, monkeypatch):
    """A sample too small to place the cuts leaves large leaves, which slabs cut on."""
    import numpy as np
    from motorsight.models import smote
    seen = []
    monkeypatch.setattr(smote, "LEAF_ROWS", 100)
    monkeypatch.setattr(smote, "SAMPLE_ROWS", 40)
    pts = np.random.default_rng(8).normal(size=(900, 3))
    names = ["a", "b", "c"]
    df = spark.createDataFrame([(int(i), *map(float, p)) for i, p in enumerate(pts)], "pid long, a double, b double, c double")
    rng = np.random.default_rng(1)
    tree = smote.grow_tree(pts[:40], 1, rng)
    edges = smote._leaf_edges(df, [tree], 1, np.ones(3), names, 99, 100).groupBy("pid").count().collect()
    seen = [r["count"] for r in edges]
    assert len(seen) == 900 and max(seen) <= 99 and sum(s == 99 for s in seen) >= 600


def test_smote_counts_at_every_ratio(spark):
    from motorsight.models.smote import smote
    rows = [(i, float(i % 50), float(i % 7), 0 if i < 600 else 1 if i < 1000 else 2) for i in range(1100)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, label int")
    c = {(r.label, r.synthetic): r["count"] for r in smote(df, ["a", "b"]).groupBy("label", "synthetic").count().collect()}
    assert c[(0, 0)] == 600 and (0, 1) not in c
    assert c[(1, 0)] == 400 and abs(c[(1, 1)] - 200) < 40     # ratio 0.5
    assert c[(2, 0)] == 100 and c[(2, 1)] == 500              # ratio 5


def test_smote_balances_and_stays_inside(spark):
    from motorsight.models.smote import smote
    s = Tables(spark, SF_SMALL).sensor.select(*SPLIT_KEYS, "label", "wear", "torque", "rpm")
    out = smote(s, ["wear", "torque", "rpm"], "label", SPLIT_KEYS)
    c = {(r.label, r.synthetic): r["count"] for r in out.groupBy("label", "synthetic").count().collect()}
    assert abs((c[(1, 0)] + c[(1, 1)]) / c[(0, 0)] - 1) < 0.05
    mino = s.filter("label = 1").agg(*[F.min(x).alias(f"lo_{x}") for x in ["wear", "torque", "rpm"]],
                                     *[F.max(x).alias(f"hi_{x}") for x in ["wear", "torque", "rpm"]]).first()
    syn = out.filter("synthetic = 1")
    for x in ["wear", "torque", "rpm"]:
        r = syn.agg(F.min(x), F.max(x)).first()
        assert r[0] >= mino[f"lo_{x}"] - 1e-9 and r[1] <= mino[f"hi_{x}"] + 1e-9


def test_permuted_moves_every_value_once(spark):
    df = spark.range(500).selectExpr("id as row_id", "id * 2 as a", "pmod(id, 3) as b")
    d = TR.permuted(df, ["a", "b"], ["row_id"], bucket_rows=40)
    rows = d.collect()
    assert sorted(r._p_a for r in rows) == sorted(r.a for r in rows) and sum(r._p_a == r.a for r in rows) < 20


def test_outlier_filter_and_grid(spark):
    s = Tables(spark, SF_SMALL).sensor
    kept = ISO.outlier_filter(s, ["rpm", "torque"], SPLIT_KEYS, trees=40)
    assert kept.columns == s.columns and 0.85 < kept.count() / s.count() < 0.95
    df, feats = training_frame(spark, SF_SMALL)
    res = TR.grid_search(df, feats[:5], "logistic", {"regParam": [0.0, 0.5], "maxIter": [10]}, k=2, keys=SPLIT_KEYS)
    assert len(res) == 2 and res[0]["f1_mean"] >= res[1]["f1_mean"] and {r["params"]["regParam"] for r in res} == {0.0, 0.5}


def test_smote_groups_searched_together(spark):
    """Groups of many sizes in one call give what a call for each gives, and a round takes few calls."""
    import numpy as np
    import pandas as pd

    from motorsight.models import smote as SM

    rng = np.random.default_rng(3)
    sizes = [1, 2, 3, 40, 7, 300, 1, 21, 22, 64]
    starts = np.r_[0, np.cumsum(sizes)]
    v = rng.integers(0, 9, (starts[-1], 4)) + np.array([0.0, 1e5, 0, 0])
    pid = rng.permutation(starts[-1])
    bound = np.where(rng.random(starts[-1]) < 0.5, np.inf, rng.uniform(0, 6, starts[-1]))
    want = pd.concat([SM.nearest_in(v[a:b], pid[a:b], 5, bound[a:b]) for a, b in zip(starts, starts[1:])])
    got = SM.nearest_in_groups(v, pid, starts, 5, bound)
    by = ["pid", "dist", "nid"]
    assert len(want) > 1000
    pd.testing.assert_frame_equal(got.sort_values(by, ignore_index=True), want.sort_values(by, ignore_index=True), check_dtype=False)


def test_smote_groups_searched_slice_by_slice(spark, monkeypatch):
    """Slices of the groups give the same neighbours, and the shuffle files of a write go when it ends."""
    import time
    import numpy as np
    from motorsight.models import smote
    monkeypatch.setattr(smote, "LEAF_ROWS", 100)
    pts = np.random.default_rng(5).normal(size=(400, 4))
    plain, written, write = _neighbours(spark, pts), [], smote._written
    monkeypatch.setattr(smote, "_written", lambda df: written.append(1) or write(df))
    monkeypatch.setattr(smote, "SLICE_BYTES", 400_000)
    assert _neighbours(spark, pts) == plain and len(written) >= 8
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    before = disk.getAllFiles().size()
    write(spark.range(1000).repartition(5, "id"))
    for _ in range(50):
        if (grown := disk.getAllFiles().size() - before) > 0:
            time.sleep(0.1)
    assert grown <= 0 and spark.conf.get(smote.CLEANUP) == "false"
