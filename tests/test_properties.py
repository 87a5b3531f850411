"""Properties: partitioning invariance of the distributed primitives, bucket index vs bisect,
rounding vs DuckDB's rule."""

import bisect
import random

import duckdb
from pyspark.sql import functions as F

from conftest import SF_SMALL, rows
from motorsight.functions.numeric import bucket_index, round6
from motorsight.operators import metrics as MT
from motorsight.operators import stats as ST
from motorsight.operators import temporal as T
from motorsight.plans.rowwise import fleet_scored
from motorsight.sources.tables import SENSOR_ORDER, Tables


def test_shuffle_invariance(spark):
    t = Tables(spark, SF_SMALL)
    f = fleet_scored(t)
    a = MT.auc_summary(f.repartition(1), "label", "p").first()
    b = MT.auc_summary(f.repartition(16), "label", "p").first()
    assert all(abs(a[c] - b[c]) < 1e-12 for c in a.asDict())
    s = t.sensor.select("machine_id", *SENSOR_ORDER, "torque", "label")
    def feats(df):
        o = T.ordered_features(df, "machine_id", SENSOR_ORDER, ["torque"], groups=("rolling", "lag"),
                               failure_col="label")
        return rows(o.select(*SENSOR_ORDER, F.round("torque_rolling_mean_7", 9), "torque_lag_3",
                             "cycles_to_failure"))
    assert feats(s.repartition(1)) == feats(s.repartition(13))
    ref = s.filter("label = 0")
    live = s.filter("label = 1")
    k1 = rows(ST.ks_drift(ref.repartition(1), live.repartition(1), ["torque"]).select("ks_stat"))
    k2 = rows(ST.ks_drift(ref.repartition(9), live.repartition(7), ["torque"]).select("ks_stat"))
    assert k1 == k2


def test_bucket_index_random(spark):
    rnd = random.Random(5)
    for trial in range(5):
        bounds = sorted({round(rnd.uniform(-100, 100), 1) for _ in range(rnd.randint(1, 70))})
        vals = [round(rnd.uniform(-120, 120), 1) for _ in range(60)] + bounds
        df = spark.createDataFrame([(v,) for v in vals], "v double")
        got = df.select("v", bucket_index(F.col("v"), bounds).alias("s"),
                        bucket_index(F.col("v"), bounds, strict=False).alias("ns")).collect()
        for r in got:
            assert r.s == bisect.bisect_left(bounds, r.v)
            assert r.ns == bisect.bisect_right(bounds, r.v)


def test_round6_matches_duckdb(spark):
    rnd = random.Random(11)
    vals = [rnd.uniform(-1e6, 1e6) for _ in range(300)] + [rnd.uniform(-1, 1) for _ in range(300)] + \
        [0.0, -0.0, 1.0000005, 2.5e-7, -2.5e-7, 123456.7890125]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "v double").select(round6(F.col("v"))).collect()]
    con = duckdb.connect()
    want = [r[0] for r in con.execute("SELECT round(v, 6) FROM (SELECT unnest(?) AS v)", [vals]).fetchall()]
    assert got == want
