"""Ordered features: goldens, edge rows and split (hot-key) invariance."""

import math

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from conftest import SF_SMALL, rows
from motorsight.operators import sequence as S
from motorsight.operators import temporal as T
from motorsight.sources.tables import SENSOR_ORDER, TELEMETRY_ORDER, Tables


def _series(spark, values, key=1, fail=None):
    schema = StructType([StructField("m", LongType()), StructField("t", LongType()),
                         StructField("x", DoubleType()), StructField("f", IntegerType())])
    data = [(key, i + 1, v, (fail[i] if fail else 0)) for i, v in enumerate(values)]
    return spark.createDataFrame(data, schema)


def test_cycles_to_failure_golden(spark):
    # failures at rows 3 and 7 of 10
    fail = [0, 0, 1, 0, 0, 0, 1, 0, 0, 0]
    df = _series(spark, [float(i) for i in range(10)], fail=fail)
    out = T.ordered_features(df, "m", ["t"], [], groups=(), failure_col="f").orderBy("t")
    got = [(r.cycles_to_failure, r.cycles_to_last_failure) for r in out.collect()]
    assert [g[0] for g in got] == [2, 1, 0, 3, 2, 1, 0, 0, 0, 0]
    assert [g[1] for g in got] == [6, 5, 4, 3, 2, 1, 0, 0, 0, 0]
    flags = [r.failure_within_3d for r in out.collect()]
    assert flags == [1, 1, 0, 1, 1, 1, 0, 0, 0, 0]


def test_fill_and_edge_rows(spark):
    df = _series(spark, [None, 1.0, None, 3.0, None])
    out = T.ordered_features(df, "m", ["t"], [], groups=(), fill_columns=["x"]).orderBy("t")
    assert [r.x_filled for r in out.collect()] == [1.0, 1.0, 1.0, 3.0, 3.0]
    allnull = _series(spark, [None, None])
    out = T.ordered_features(allnull, "m", ["t"], [], groups=(), fill_columns=["x"])
    assert [r.x_filled for r in out.collect()] == [None, None]


def test_one_and_two_rows(spark):
    one = _series(spark, [5.0])
    r = T.ordered_features(one, "m", ["t"], ["x"], groups=("rolling", "trend")).first()
    assert r.x_rolling_std_3 is None and r.x_trend_7 == 0.0 and r.x_rate_of_change == 0.0
    zero = _series(spark, [0.0, 2.0, 2.0])
    out = T.ordered_features(zero, "m", ["t"], ["x"], groups=("trend",)).orderBy("t").collect()
    assert [o.x_rate_of_change for o in out] == [0.0, 0.0, 0.0]   # 2/0 -> 0
    assert out[1].x_trend_7 == 2.0 and out[2].x_trend_7 == 1.0


def test_ema_matches_recursion_on_long_machine(spark):
    vals = [math.sin(i / 7.0) * 10 + (i % 13) for i in range(2000)]
    df = _series(spark, vals)
    out = T.ordered_features(df, "m", ["t"], ["x"], groups=("ema",)).orderBy("t").collect()
    for span in (3, 7, 14, 30):
        a = 2.0 / (span + 1)
        y = None
        for i, v in enumerate(vals):
            y = v if y is None else y * (1 - a) + v * a
            assert abs(out[i][f"x_ema_{span}"] - y) < 1e-9


def rounded(df, feats, *keys):
    return rows(df.select(*keys, *[F.round(F.col(c), 6).alias(c) for c in feats]))


def test_hot_key_split_equals_plain(spark):
    """Forcing sub-ranges (tiny chunk) must give exactly the unsplit result."""
    s = Tables(spark, SF_SMALL).sensor.select("machine_id", *SENSOR_ORDER, "torque", "wear", "label")
    kw = dict(failure_col="label", fill_columns=["wear"])
    plain = T.ordered_features(s, "machine_id", SENSOR_ORDER, ["torque"], **kw)
    assert S.plan_splits(s, "machine_id", "ts", 150) is not None, "tiny chunks must split machines"
    assert S.plan_splits(s, "machine_id", "ts", 10**6) is None
    split = T.ordered_features(s, "machine_id", SENSOR_ORDER, ["torque"], chunk_rows=150, **kw)
    feats = [c for c in plain.columns if c not in s.columns]
    assert rounded(plain, feats, *SENSOR_ORDER, "machine_id") == rounded(split, feats, *SENSOR_ORDER, "machine_id")


def test_split_keeps_null_keys_null_times_and_long_gaps(spark):
    """NULL machines and times, and gaps longer than any frame, on both plans."""
    values = []
    for m, n in ((1, 700), (None, 500), (2, 5), (None, 4)):
        for i in range(n):
            x = None if 160 < i < 460 or i % 9 == 0 else float((i * 37) % 101)
            values.append((m, None if i < 3 else i, len(values), x, int(i % 97 == 0)))
    df = spark.createDataFrame(values, "m long, t long, id long, x double, f int")
    kw = dict(failure_col="f", fill_columns=["x"], ffill_columns=["f"])
    plain = T.ordered_features(df, "m", ["t", "id"], ["x"], **kw)
    split = T.ordered_features(df, "m", ["t", "id"], ["x"], chunk_rows=60, **kw)
    feats = [c for c in plain.columns if c not in df.columns]
    key = F.coalesce("m", F.lit(-1)).alias("m")
    a, b = rounded(plain, feats, key, "id"), rounded(split, feats, key, "id")
    as_text = lambda r: [str(x) for x in r]  # noqa: E731  rows with None sort by their text
    assert len(a) == len(values) and a == b
    assert sum(r[2 + feats.index("x_ema_3")] is not None for r in a) > 900
    n1 = T.row_index(df, "m", ["t", "id"], with_count=True)
    n2 = T.row_index(df, "m", ["t", "id"], chunk_rows=60, with_count=True)
    assert sorted(map(as_text, rows(n1.select("id", "rn", "n")))) == sorted(map(as_text, rows(n2.select("id", "rn", "n"))))


def test_split_plan_holds_no_key(spark):
    df = spark.range(4000).selectExpr("pmod(id, 40) + 987650 as m", "id as t", "cast(id as double) as x")
    out = T.ordered_features(df, "m", ["t"], ["x"], groups=("rolling", "ema"), chunk_rows=30)
    assert "9876" not in out._jdf.queryExecution().optimizedPlan().toString().replace("987650", "")


def test_row_index_split(spark):
    tel = Tables(spark, SF_SMALL).telemetry
    a = T.row_index(tel, "machine_id", TELEMETRY_ORDER, chunk_rows=20, with_count=True)
    b = T.row_index(tel, "machine_id", TELEMETRY_ORDER, with_count=True)
    assert rows(a, "event_id", "rn", "n") == rows(b, "event_id", "rn", "n")


def test_machine_with_a_third_of_all_rows(spark):
    """A third of the readings moved to one machine: split plan == plain window."""
    from conftest import SF_MID
    s = Tables(spark, SF_MID).sensor.select("machine_id", *SENSOR_ORDER, "torque", "wear", "label")
    hot = s.withColumn("machine_id", F.when(F.col("machine_id") % 3 == 0, F.lit(0)).otherwise(F.col("machine_id")))
    assert hot.filter("machine_id = 0").count() > hot.count() / 4
    table = S.plan_splits(hot, "machine_id", "ts", 5_000).collect()
    assert [r.machine_id for r in table] == [0] and len(table[0]["_bounds"]) >= 3  # only the hot machine is split
    kw = dict(groups=("rolling", "lag", "degradation", "ema"), failure_col="label", fill_columns=["wear"])
    a = T.ordered_features(hot, "machine_id", SENSOR_ORDER, ["torque"], chunk_rows=5_000, **kw)
    b = T.ordered_features(hot, "machine_id", SENSOR_ORDER, ["torque"], **kw)
    feats = [c for c in a.columns if c not in hot.columns]
    assert rounded(a, feats, "machine_id", *SENSOR_ORDER) == rounded(b, feats, "machine_id", *SENSOR_ORDER)


def test_ema_gaps_longer_than_the_reach(spark):
    """Sparse readings and gaps beyond the longest composed run, plain and split, equal pandas."""
    import pandas as pd

    reach = T.ema_reach(30)
    assert 552 < reach < 4096 and T.ema_reach(3) <= 64
    xs = [float(i * 37 % 101) for i in range(300)] + [None] * (reach + 500) + [5.0, None, 7.0] \
        + [float(i) if i % 10 == 0 else None for i in range(2000)] + [None] * 700 + [1.0, 2.0]
    df = _series(spark, xs)
    want = {n: pd.Series(xs).ewm(span=n, adjust=False).mean() for n in (3, 7, 14, 30)}
    for chunk in (10**6, 900):
        got = T.ordered_features(df, "m", ["t"], ["x"], groups=("ema",), chunk_rows=chunk).orderBy("t").toPandas()
        for n, w in want.items():
            assert abs(got[f"x_ema_{n}"] - w).max() < 1e-9, (chunk, n)
    empty = T.ordered_features(_series(spark, [None, None]), "m", ["t"], ["x"], groups=("ema",)).toPandas()
    assert empty["x_ema_3"].isna().all()


def test_ema_runs_in_the_jvm_with_one_exchange(spark):
    s = Tables(spark, SF_SMALL).sensor.select("machine_id", *SENSOR_ORDER, "torque", "wear", "label")
    out = T.ordered_features(s, "machine_id", SENSOR_ORDER, ["torque", "wear"], failure_col="label")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "Python" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_one_timestamp_for_all_rows_of_a_hot_key(spark):
    """Rows that share their time are split by the columns after it, and equal the plain windows."""
    values = [(1, 5, i, float(i * 7 % 31), int(i % 50 == 0)) for i in range(900)] + [(2, i, i, float(i), 0) for i in range(40)]
    df = spark.createDataFrame(values, "m long, t long, id long, x double, f int").repartition(4)
    table = S.plan_splits(df, "m", ["t", "id"], 300).collect()
    assert [r.m for r in table] == [1] and 2 <= len(table[0]["_bounds"]) <= 4
    o = S.ordered(df, "m", ["t", "id"], 0, 300)
    sizes = [r["count"] for r in o.df.filter("m = 1").groupBy("_sub").count().collect()]
    assert len(sizes) >= 3 and max(sizes) < 600 and sum(sizes) == 900
    kw = dict(failure_col="f", fill_columns=["x"])
    plain = T.ordered_features(df, "m", ["t", "id"], ["x"], **kw)
    split = T.ordered_features(df, "m", ["t", "id"], ["x"], chunk_rows=300, **kw)
    feats = [c for c in plain.columns if c not in df.columns]
    assert rounded(plain, feats, "m", "id") == rounded(split, feats, "m", "id")


def test_tasks_follow_the_rows(spark, monkeypatch):
    """Many small machines go to as many tasks as the rows need, whatever the shuffle setting; plain and split."""
    monkeypatch.setattr(S, "TASK_ROWS", 100)
    df = spark.range(5000).selectExpr("if(id < 600, 1000, id div 10) as m", "id as t", "cast(id % 7 as double) as x")
    for chunk in (10**6, 200):
        o = S.ordered(df, "m", ["t"], 5, chunk)
        assert o.df.rdd.getNumPartitions() == 50
        sizes = [r["count"] for r in o.df.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < (900 if chunk > 200 else 500)


def test_steps_copy_short_rows(spark):
    """A row is copied field by field at each window step: few steps, and arrays instead of hundreds of fields."""
    from motorsight.plans.ordered import PIPE_COLS

    s = Tables(spark, SF_SMALL).sensor.select("machine_id", *SENSOR_ORDER, *PIPE_COLS)
    todo, widths = [T.ordered_features(s, "machine_id", SENSOR_ORDER, PIPE_COLS)._jdf.queryExecution().optimizedPlan()], []
    while todo:
        node = todo.pop()
        if node.nodeName() == "Window":
            widths.append(node.output().size())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert len(widths) <= 14 and max(widths) <= 100, widths


def test_features_of_gappy_columns_over_many_blocks(spark):
    """Several columns with gaps, longer than several EMA blocks, plain and split, equal pandas and least squares."""
    import numpy as np
    import pandas as pd

    n = 4 * T.ema_block([3])
    cols = {"x": [1e6 + math.sin(i) if i % 5 not in (1, 2) else None for i in range(n)],
            "z": [7.1 if i % 3 else None for i in range(n)],
            "q": [None] * 40 + [float(i * i % 17) for i in range(n - 40)]}
    df = spark.createDataFrame([(1, i, *(cols[c][i] for c in cols)) for i in range(n)], "m long, t long, x double, z double, q double")
    for chunk in (10**6, 500):
        got = T.ordered_features(df, "m", ["t"], list(cols), chunk_rows=chunk).orderBy("t").toPandas()
        for c, v in cols.items():
            s = pd.Series(v, dtype=float)
            for k in (3, 7, 14, 30):
                roll = s.rolling(k, min_periods=1)
                for name, want, tol in (("ema", s.ewm(span=k, adjust=False).mean(), 1e-8), ("rolling_mean", roll.mean(), 1e-8),
                                        ("rolling_min", roll.min(), 0), ("rolling_max", roll.max(), 0)):
                    have = got[f"{c}_{name}_{k}"]
                    assert (have.isna() == want.isna()).all() and ((have - want).abs().fillna(0) <= tol).all(), (chunk, c, name, k)
                for i in (*range(60), *range(60, n, 97)):
                    w = [a for a in v[max(0, i - k + 1):i + 1] if a is not None]
                    have = got[f"{c}_rolling_std_{k}"][i]
                    assert math.isnan(have) if len(w) < 2 else abs(have - np.std(w, ddof=1)) < 1e-8, (chunk, c, k, i)
            for i in (*range(60), *range(60, n, 97)):
                w = [(j, v[j]) for j in range(max(0, i - 6), i + 1) if v[j] is not None]
                want = 0.0
                if len(w) > 1:
                    t, y = (np.array(a) - np.mean(a) for a in zip(*w))
                    want = (t * y).sum() / (t * t).sum()
                assert abs(got[f"{c}_trend_7"][i] - want) < 1e-8, (chunk, c, i)
