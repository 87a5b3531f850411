"""Golden rows (rule fields) and edge rows from FIXTURES.md sections C and D."""

import os

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from motorsight.functions import physics as ph
from motorsight.functions import rules as R
from motorsight.functions import text as TX
from motorsight.operators import metrics as MT
from motorsight.operators import report as RP
from motorsight.operators import scoring as SC
from motorsight.operators import stats as ST

GOLD = [
    # name, tags (C, hours) or canonical (K, minutes), rpm, torque, dT, power, modes
    ("MEE1-M01", dict(AmbientTemp=35.0, MotorTemp=58.5, RunHours=3.8), 1360, 65, 23.5, 9257.2, ["TWF", "OSF"]),
    ("SCHNDR-P3", dict(air_k=302.0, proc_k=315.0, wear=95.0), 2750, 72, 13.0, 20734.5, ["PWF"]),
    ("MEE1-M05", dict(AmbientTemp=28.0, MotorTemp=38.5, RunHours=1.2), 1502, 38.5, 10.5, 6055.6, ["—"]),
    ("MEE1-M03", dict(AmbientTemp=31.0, MotorTemp=44.0, RunHours=2.9), 1420, 52, 13.0, 7732.5, ["—"]),
    ("NORMAL", dict(AmbientTemp=25.0, MotorTemp=37.0, wear=50.0), 1500, 35, 12.0, 5497.8, ["—"]),
    ("HDF", dict(AmbientTemp=35.0, MotorTemp=41.5, wear=120.0), 1350, 42, 6.5, 5937.6, ["HDF"]),
    ("OSF", dict(AmbientTemp=30.0, MotorTemp=40.0, wear=215.0), 1480, 72, 10.0, 11158.9, ["TWF", "PWF", "OSF"]),
    ("M_C_203", dict(air_k=302.5, proc_k=318.0, wear=215.0), 1380, 68, 15.5, 9826.9, ["TWF", "PWF", "OSF"]),
]
TAGS = ["AmbientTemp", "MotorTemp", "RunHours", "air_k", "proc_k", "wear"]


def _gold_df(spark):
    schema = StructType([StructField("machine_id", StringType())] +
                        [StructField(c, DoubleType()) for c in TAGS + ["Speed_RPM", "Torque_Nm"]])
    rows = [tuple([n] + [float(d[c]) if c in d else None for c in TAGS] + [float(rpm), float(tq)])
            for n, d, rpm, tq, *_ in GOLD]
    return spark.createDataFrame(rows, schema)


def test_golden_rule_fields(spark):
    df = ph.convert_tags(_gold_df(spark))
    out = df.select("machine_id", (F.col("proc_k") - F.col("air_k")).alias("dt"),
                    R.power_w("torque", "rpm").alias("p"), R.likely_failure_modes().alias("modes")).collect()
    got = {r.machine_id: r for r in out}
    for name, _, _, _, dt, power, modes in GOLD:
        r = got[name]
        assert round(r.dt, 2) == dt, name
        assert round(r.p, 1) == power, name
        assert list(r.modes) == modes, name


def test_golden_bands_and_confidence(spark):
    pcts = [99.27, 84.53, 0.05, 0.57]
    df = spark.createDataFrame([(p / 100.0,) for p in pcts], "p double")
    out = df.select(R.risk_level_fr("p").alias("r"), R.confidence("p").alias("c")).collect()
    assert [o.r for o in out] == ["CRITIQUE", "CRITIQUE", "NORMAL", "NORMAL"]
    for o, want in zip(out, [0.9855, 0.6906, 0.9989, 0.9885]):
        assert abs(o.c - want) <= 1e-4 + 1e-9   # the stored percent was rounded after


def test_band_boundaries_inclusive(spark):
    df = spark.createDataFrame([(x,) for x in (0.2, 0.4, 0.6, 0.8)], "p double")
    out = [r[0] for r in df.select(R.risk_level_fr("p")).collect()]
    assert out == ["SURVEILLER", "ATTENTION", "URGENT", "CRITIQUE"]
    assert [r[0] for r in df.select(R.risk_level_en4("p")).collect()] == ["LOW", "MEDIUM", "HIGH", "CRITICAL"]


def test_seven_day_buckets(spark):
    rows = []
    for i in range(20):
        rows.append(("M", i, float(i) * 3.0, "NORMAL" if i < 10 else "URGENT"))
    df = spark.createDataFrame(rows, "machine_id string, t int, pct double, risk_level string")
    out = ST.seven_day_window(df, "machine_id", ["t"], "pct", "risk_level").first()
    assert len(out.daily_risk.split(",")) == 10           # bucket = 20 // 7 = 2
    assert out.trend_slope_pct == 3.0
    # rows_per_day = round(20 / 7) = 3; (60 - 57) / 3 = 1 row -> 1/3 day
    assert out.days_to_failure == round(1 / 3, 1)
    one = spark.createDataFrame([("M", 0, 70.0, "URGENT")], df.schema)
    o = ST.seven_day_window(one, "machine_id", ["t"], "pct", "risk_level").first()
    assert o.trend_slope_pct == 0.0 and o.days_to_failure is None
    fall = spark.createDataFrame([("M", i, 50.0 - i, "NORMAL") for i in range(10)], df.schema)
    assert ST.seven_day_window(fall, "machine_id", ["t"], "pct", "risk_level").first().days_to_failure is None
    above = spark.createDataFrame([("M", i, 61.0 + i, "URGENT") for i in range(10)], df.schema)
    assert ST.seven_day_window(above, "machine_id", ["t"], "pct", "risk_level").first().days_to_failure == 0.0


def test_seven_day_window_keeps_readings_without_a_machine(spark):
    rows = [(m, i, float(i), "URGENT" if i > 6 else "NORMAL") for m in ("A", None) for i in range(10)]
    df = spark.createDataFrame(rows, "machine_id string, t int, pct double, risk_level string")
    for chunk in (10**6, 4):
        out = {r.machine_id: r for r in ST.seven_day_window(df, "machine_id", ["t"], "pct", "risk_level", chunk_rows=chunk).collect()}
        assert set(out) == {"A", None} and out[None].n == 10
        assert out[None].daily_risk == out["A"].daily_risk == ",".join(["NORMAL"] * 7 + ["URGENT"] * 3)


def test_report_matches_stored_text(spark):
    path = os.path.join(os.path.dirname(__file__), "golden", "report_m01.txt")
    want = open(path, encoding="utf-8").read().split("\n")
    snap = "struct<air_temp_K:double,motor_temp_K:double,temp_diff_K:double,rpm:double,torque_Nm:double,wear_min:double,power_W:double>"
    df = spark.createDataFrame(
        [("MEE1-M01", "2026-05-04 01:49:58", 99.27, "CRITIQUE", "🔴", "1–3 jours", ["TWF", "OSF"], 0.9855,
          (308.1, 331.6, 23.5, 1360.0, 65.0, 228.0, 9257.2))],
        f"machine_id string, ts string, failure_probability_pct double, risk_level string, risk_icon string, "
        f"time_to_failure_estimate string, likely_failure_modes array<string>, confidence double, sensor_snapshot {snap}")
    df = df.withColumn("ts", F.to_timestamp("ts"))
    got = df.select(RP.diagnostic_report_lines(df).alias("l")).first().l
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == w


def test_prediction_records_status(spark):
    df = spark.createDataFrame([("a", 300.0, 310.0, 1500.0, 40.0, 10.0), ("b", 300.0, 310.0, 3000.1, 40.0, 10.0)],
                               "machine_id string, air_k double, proc_k double, rpm double, torque double, wear double")
    df = df.withColumn("ts", F.current_timestamp())
    out = {r.machine_id: r for r in SC.prediction_records(df, F.lit(0.5)).collect()}
    assert out["a"].status == "OK" and out["a"].risk_level == "ATTENTION"
    assert out["b"].status == "INPUT_VALIDATION_ERROR" and out["b"].failure_probability_pct is None


def test_validation_edge_rows(spark):
    schema = "air_k double, proc_k double, rpm double, torque double, wear double"
    rows = [(300.0, 310.0, 1500.0, None, 10.0), (300.0, 310.0, 3000.1, 40.0, 10.0),
            (300.0, 310.0, 1500.0, 40.0, float("nan")), (270.0, 310.0, 3000.0, 40.0, 10.0)]
    out = [r[0] for r in spark.createDataFrame(rows, schema).select(R.validation_warnings()).collect()]
    assert out[0] == ["Missing sensor: Torque [Nm]"]
    assert out[1] == ["Out of range: Rotational speed [rpm]=3000.1  (expected 100.0–3000.0)"]
    assert out[2] == ["Out of range: Tool wear [min]=nan  (expected 0.0–300.0)"]
    assert out[3] == []


def test_entry_ranges(spark):
    df = spark.createDataFrame([(201.0,), (195.0,), (100.0,)], "t double")
    st, _ = R.entry_check("temperature", F.col("t"))
    assert [r[0] for r in df.select(st).collect()] == ["invalid", "near_limit", "ok"]


def test_text_numbers(spark):
    ocr = spark.createDataFrame([("Temperature: 78.5 °C",), ("12 34",), ("-3,5",), ("n/a",)], "t string")
    assert [r[0] for r in ocr.select(TX.ocr_number("t")).collect()] == [78.5, 1234.0, -3.5, None]
    sp = spark.createDataFrame([("75", "ar"), ("٧٥", "ar"), ("خمسة وسبعين", "ar"), ("quatre-vingt", "fr"),
                                ("twenty five", "en")], "t string, lang string")
    assert [r[0] for r in sp.select(TX.speech_number("t", "lang")).collect()] == [75.0, 75.0, 5.0, 80.0, 20.0]


def test_shifts(spark):
    df = spark.createDataFrame([(h,) for h in (5, 6, 13, 14, 21, 22)], "h int") \
        .select(F.make_timestamp(F.lit(2024), F.lit(1), F.lit(1), F.col("h"), F.lit(0), F.lit(0)).alias("ts"))
    assert [r[0] for r in df.select(TX.work_shift("ts")).collect()] == \
        ["night", "morning", "morning", "afternoon", "afternoon", "night"]


def test_metric_edges(spark):
    none = spark.createDataFrame([(1, 0), (0, 0)], "label int, pred int")
    m = MT.classification_metrics(none).first()
    assert m.precision == 0.0 and m.f1 == 0.0
    eq = spark.createDataFrame([(1, 0.3), (0, 0.3), (1, 0.3), (0, 0.3)], "label int, score double")
    assert MT.auc_summary(eq).first().roc_auc == 0.5
    sweep = spark.createDataFrame([(0.2, 0.5), (0.3, 0.5), (0.4, 0.1)], "threshold double, f_beta double")
    assert MT.best_threshold(sweep).first().threshold == 0.2


def test_drift_insufficient(spark):
    ref = spark.createDataFrame([(float(i),) for i in range(100)], "x double")
    live = spark.createDataFrame([(float(i),) for i in range(29)], "x double")
    assert ST.ks_drift(ref, live, ["x"]).first().status == "insufficient_data"
    shifted = spark.createDataFrame([(float(i) + 60,) for i in range(100)], "x double")
    r = ST.ks_drift(ref, shifted, ["x"]).first()
    assert r.status == "drift" and abs(r.ks_stat - 0.6) < 1e-12
