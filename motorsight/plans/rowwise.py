"""Row-wise queries: projections only, no shuffle except the final small
aggregate of the flagship.  (SURVEY 7.2 steps 1-2.)"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import physics as ph
from ..functions import rules as R
from ..functions import text as TX
from ..sources.tables import Tables, SENSOR_ORDER
from ..functions.numeric import round6
from .registry import register
from .sql_views import FLEET_PROB, RISK_FR, SENSOR, TELEMETRY, with_views

KEYS = ["machine_id"] + SENSOR_ORDER[1:]   # machine + unique tie-break columns


def r6(c):
    return round6(c)


def fleet_scored(t: Tables) -> DataFrame:
    """Sensor view -> F1/F2 -> linear score (M20) -> French band."""
    s = t.sensor
    power = ph.physics_exprs(s, 0.0)["Power_W"]
    scored = s.select(*s.columns, power.alias("Power_W"),
                      (F.col("wear") * F.col("torque")).alias("Wear_Torque"))
    p = R.sigmoid(R.linear_logit(R.FLEET_COEFS, R.FLEET_INTERCEPT))
    return scored.withColumn("p", p).withColumn("risk_level", R.risk_level_fr("p"))


FLEET_RISK_SQL = with_views(SENSOR) + f"""
, prob AS (SELECT mtype, torque*rpm*1.0471975511965977e-1 AS power_w, {FLEET_PROB} AS p FROM sensor)
SELECT mtype, {RISK_FR.format(p='p')} AS risk_level, count(*) AS n,
       round(avg(p), 6) AS mean_prob, round(max(power_w), 6) AS max_power
FROM prob GROUP BY ALL
"""


@register("fleet_risk", FLEET_RISK_SQL, ids=("F1", "F2", "M20", "F14", "A1"))
def fleet_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: count, mean probability and max power per type and risk band."""
    f = fleet_scored(Tables(spark, sf_dir))
    return f.groupBy("mtype", "risk_level").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("p")).alias("mean_prob"),
        r6(F.max("Power_W")).alias("max_power"))


def _rpm_mean(t: Tables) -> float:
    # A9 fit: one small aggregate job; the value becomes a literal.
    return float(t.sensor.agg(F.avg("rpm")).first()[0])


PHYS_SQL = with_views(SENSOR) + """
, m AS (SELECT avg(rpm) AS rpm_mean FROM sensor)
, b AS (SELECT s.*, torque*rpm*1.0471975511965977e-1 AS pw, proc_k - air_k AS dt, wear*torque AS wt,
               rpm_mean FROM sensor s, m)
SELECT machine_id, l_orderkey, l_linenumber, l_partkey, l_extendedprice,
  round(air_k,6) AS Air_temperature__K, round(proc_k,6) AS Process_temperature__K,
  round(rpm,6) AS Rotational_speed__rpm, round(torque,6) AS Torque__Nm, round(wear,6) AS Tool_wear__min,
  round(CAST(CASE mtype WHEN 'L' THEN 0 WHEN 'M' THEN 1 ELSE 2 END AS DOUBLE),6) AS Type_enc,
  round(pw,6) AS Power_W, round(dt,6) AS Temp_Diff_K, round(wt,6) AS Wear_Torque,
  round(torque/greatest(rpm,1e0),6) AS Mechanical_Stress, round(proc_k/greatest(air_k,1e0),6) AS Thermal_Ratio,
  round(abs(rpm - rpm_mean),6) AS Speed_Deviation,
  CAST(dt < 8.6e0 AND rpm < 1380e0 AS DOUBLE) AS HDF_signal, CAST(wear >= 200e0 AS DOUBLE) AS TWF_signal,
  CAST(wt > 13000e0 AS DOUBLE) AS OSF_signal, CAST(pw < 3500e0 AS DOUBLE) AS PWF_low,
  CAST(pw > 9500e0 AS DOUBLE) AS PWF_high,
  round(ln(1+greatest(rpm,0e0)),6) AS log_Rotational_speed__rpm, round(sqrt(greatest(rpm,0e0)),6) AS sqrt_Rotational_speed__rpm,
  round(ln(1+greatest(torque,0e0)),6) AS log_Torque__Nm, round(sqrt(greatest(torque,0e0)),6) AS sqrt_Torque__Nm,
  round(ln(1+greatest(wear,0e0)),6) AS log_Tool_wear__min, round(sqrt(greatest(wear,0e0)),6) AS sqrt_Tool_wear__min,
  round(ln(1+greatest(pw,0e0)),6) AS log_Power_W, round(sqrt(greatest(pw,0e0)),6) AS sqrt_Power_W,
  round(ln(1+greatest(wt,0e0)),6) AS log_Wear_Torque, round(sqrt(greatest(wt,0e0)),6) AS sqrt_Wear_Torque,
  round(rpm*proc_k,6) AS RPM_x_Temp, round(torque*dt,6) AS Torque_x_TempDiff, round(wear*pw,6) AS Wear_x_Power,
  round(wear*(torque*torque),6) AS Wear_x_Torque_sq, round(torque*torque,6) AS Torque_sq,
  round(rpm*rpm,6) AS RPM_sq, round(dt*dt,6) AS TempDiff_sq, round(rpm*wear,6) AS RPM_x_Wear,
  round(proc_k*wear,6) AS Temp_x_Wear
FROM b
"""


@register("physics_features", PHYS_SQL, ids=("F1", "F2", "F3", "F4", "F5", "F6", "F7", "F8", "F9", "A9"))
def physics_features_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 36-column feature vector for every reading (rpm mean fitted on the table)."""
    t = Tables(spark, sf_dir)
    s = t.sensor.withColumn("type_enc", F.when(F.col("mtype") == "L", 0)
                            .when(F.col("mtype") == "M", 1).otherwise(2))
    out = ph.physics_features(s, _rpm_mean(t), keep=KEYS)
    return out.select(*KEYS, *[r6(F.col(c)).alias(c) for c in ph.FEATURE_COLUMNS])


MODES_SQL = with_views(SENSOR) + """
, b AS (SELECT *, torque*rpm*1.0471975511965977e-1 AS pw FROM sensor)
, m AS (SELECT machine_id, l_orderkey, l_linenumber, l_partkey, l_extendedprice,
   concat_ws(',', CASE WHEN wear >= 180e0 THEN 'TWF' END,
                  CASE WHEN (proc_k - air_k) < 8.6e0 AND rpm < 1380e0 THEN 'HDF' END,
                  CASE WHEN pw < 3500e0 OR pw > 9500e0 THEN 'PWF' END,
                  CASE WHEN wear*torque > 12000e0 THEN 'OSF' END) AS modes0 FROM b)
SELECT machine_id, l_orderkey, l_linenumber, l_partkey, l_extendedprice,
       CASE WHEN modes0 = '' THEN '—' ELSE modes0 END AS modes
FROM m
"""


@register("failure_modes", MODES_SQL, ids=("F12",))
def failure_modes_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likely failure modes of every reading, in rule order, '—' when none."""
    s = Tables(spark, sf_dir).sensor
    return s.select(*KEYS, F.array_join(R.likely_failure_modes(), ",").alias("modes"))


SPEC_SQL = with_views(SENSOR) + """
, b AS (SELECT *, torque*rpm*1.0471975511965977e-1 AS pw FROM sensor)
, f AS (SELECT mtype,
   CAST((proc_k - air_k) < 8.6e0 AND rpm < 1380e0 AS INTEGER) AS HDF,
   CAST(pw < 3500e0 OR pw > 9000e0 AS INTEGER) AS PWF,
   CAST(wear*torque > CASE mtype WHEN 'L' THEN 11000e0 WHEN 'M' THEN 12000e0 ELSE 13000e0 END AS INTEGER) AS OSF,
   CAST(wear BETWEEN 200e0 AND 240e0 AS INTEGER) AS TWF FROM b)
SELECT mtype, count(*) AS n, CAST(sum(HDF) AS BIGINT) AS hdf, CAST(sum(PWF) AS BIGINT) AS pwf,
       CAST(sum(OSF) AS BIGINT) AS osf, CAST(sum(TWF) AS BIGINT) AS twf,
       CAST(sum(greatest(HDF, PWF, OSF, TWF)) AS BIGINT) AS machine_failure
FROM f GROUP BY mtype
"""


@register("spec_failure", SPEC_SQL, ids=("F13", "A2"))
def spec_failure_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataset failure definition per reading, counted per product type."""
    s = Tables(spark, sf_dir).sensor
    fl = R.spec_failure_flags()
    return s.select("mtype", *[v.alias(k) for k, v in fl.items()]).groupBy("mtype").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(k).cast("long").alias(k.lower()) for k in ["HDF", "PWF", "OSF", "TWF"]],
        F.sum("machine_failure").cast("long").alias("machine_failure"))


SCALES_SQL = with_views(SENSOR) + f"""
, p AS (SELECT machine_id, l_orderkey, l_linenumber, l_partkey, l_extendedprice, {FLEET_PROB} AS p FROM sensor)
, q AS (SELECT *, CASE WHEN p >= 8e-1 THEN 'CRITICAL' WHEN p >= 6e-1 THEN 'HIGH'
                        WHEN p >= 4e-1 THEN 'MEDIUM' ELSE 'LOW' END AS risk_en4,
               round(p*100, 2) AS pct FROM p)
SELECT machine_id, l_orderkey, l_linenumber, l_partkey, l_extendedprice,
  round(p, 6) AS p,
  {RISK_FR.format(p='p')} AS risk_fr,
  CASE WHEN p >= 8e-1 THEN 'Arrêt immédiat machine — STOP NOW' WHEN p >= 6e-1 THEN 'Maintenance urgente dans 24h'
       WHEN p >= 4e-1 THEN 'Planifier maintenance dans 3-5 jours' WHEN p >= 2e-1 THEN 'Surveiller — prochaine inspection planif'
       ELSE 'Fonctionnement normal' END AS action_fr,
  CASE WHEN p >= 8e-1 THEN '🔴' WHEN p >= 6e-1 THEN '🟠' WHEN p >= 4e-1 THEN '🟡' WHEN p >= 2e-1 THEN '🔵' ELSE '🟢' END AS icon_fr,
  risk_en4,
  CASE WHEN p >= 8e-1 THEN 'CRITICAL' WHEN p >= 6e-1 THEN 'HIGH' WHEN p >= 4e-1 THEN 'MEDIUM'
       WHEN p >= 2e-1 THEN 'LOW' ELSE 'NORMAL' END AS risk_en5,
  CASE WHEN p*100 >= 80e0 THEN 1 WHEN p*100 >= 60e0 THEN 3 WHEN p*100 >= 40e0 THEN 5 ELSE 7 END AS days_4,
  CASE WHEN p >= 8e-1 THEN 1 WHEN p >= 6e-1 THEN 3 WHEN p >= 4e-1 THEN 5 WHEN p >= 2e-1 THEN 7 WHEN p >= 0e0 THEN 14 ELSE 30 END AS days_5,
  CASE risk_en4 WHEN 'CRITICAL' THEN 'CRITIQUE' WHEN 'HIGH' THEN 'URGENT' WHEN 'MEDIUM' THEN 'ATTENTION'
       WHEN 'LOW' THEN 'SURVEILLER' ELSE 'NORMAL' END AS risk_normalized,
  round(abs(p - 5e-1)/5e-1, 6) AS confidence,
  CAST(p >= 4.2e-1 AS INTEGER) AS decision,
  CASE WHEN p >= 8e-1 THEN '🔴' WHEN p >= 5e-1 THEN '🟡' ELSE '🟢' END AS alert_icon
FROM q
"""


@register("risk_scales", SCALES_SQL, ids=("F14", "F15", "F16", "F17", "F18", "F19", "F21"))
def risk_scales_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every risk scale, step and icon for every scored reading."""
    f = fleet_scored(Tables(spark, sf_dir))
    p = F.col("p")
    en4 = R.risk_level_en4(p)
    return f.select(
        *KEYS, r6(p).alias("p"), R.risk_level_fr(p).alias("risk_fr"),
        R.risk_action_fr(p).alias("action_fr"), R.risk_icon_fr(p).alias("icon_fr"),
        en4.alias("risk_en4"), R.risk_level_en5(p).alias("risk_en5"),
        R.days_to_failure_4(p * 100).alias("days_4"), R.days_to_failure_5(p).alias("days_5"),
        R.normalize_risk(en4).alias("risk_normalized"),
        r6(R.confidence(p)).alias("confidence"),
        R.binary_decision(p, fv.PRODUCTION_THRESHOLD).alias("decision"),
        R.alert_icon(p).alias("alert_icon"))


def _scada_view(t: Tables) -> DataFrame:
    """Sensor readings as SCADA tags (degrees C, run hours); derived from the sensor view."""
    s = t.sensor
    return s.select(*KEYS, "mtype",
                    (F.col("air_k") - 273.15).alias("AmbientTemp"),
                    (F.col("proc_k") - 273.15).alias("MotorTemp"),
                    F.col("rpm").alias("Speed_RPM"), F.col("torque").alias("Torque_Nm"),
                    (F.col("wear") / 60.0).alias("RunHours"),
                    F.lit(None).cast("double").alias("proc_k"))


TAGS_SQL = with_views(SENSOR) + """
, sc AS (SELECT machine_id, l_orderkey, l_linenumber, l_partkey, l_extendedprice,
           air_k - 273.15e0 AS AmbientTemp, proc_k - 273.15e0 AS MotorTemp, rpm AS Speed_RPM,
           torque AS Torque_Nm, wear / 60e0 AS RunHours FROM sensor)
, cv AS (SELECT *, AmbientTemp + 273.15e0 AS a, MotorTemp + 273.15e0 AS pk, Speed_RPM AS r,
           Torque_Nm AS tq, RunHours*60e0 AS w FROM sc)
SELECT machine_id, l_orderkey, l_linenumber, l_partkey, l_extendedprice,
  round(a, 6) AS air_k, round(pk, 6) AS proc_k, round(r, 6) AS rpm, round(tq, 6) AS torque,
  round(w, 6) AS wear, 1 AS type_enc,
  round(tq*r*1.0471975511965977e-1, 6) AS power_w,
  len(concat_ws('|', CASE WHEN NOT (a BETWEEN 270e0 AND 380e0) THEN 'x' END,
                     CASE WHEN NOT (pk BETWEEN 270e0 AND 420e0) THEN 'x' END,
                     CASE WHEN NOT (r BETWEEN 100e0 AND 3000e0) THEN 'x' END,
                     CASE WHEN NOT (tq BETWEEN 0e0 AND 200e0) THEN 'x' END,
                     CASE WHEN NOT (w BETWEEN 0e0 AND 300e0) THEN 'x' END)) > 0 AS skip_prediction
FROM cv
"""


@register("tag_conversion", TAGS_SQL, ids=("P3", "P5", "P6", "F28"))
def tag_conversion_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCADA tags -> canonical sensors, serving defaults, validation skip flag."""
    t = Tables(spark, sf_dir)
    conv = ph.convert_tags(_scada_view(t))
    conv = ph.apply_defaults(conv, fv.PRODUCTION_RPM_MEAN)
    warn = R.validation_warnings()
    return conv.select(
        *KEYS, *[r6(F.col(c)).alias(c) for c in ph.SENSORS], "type_enc",
        r6(R.power_w("torque", "rpm")).alias("power_w"),
        (F.size(warn) > 0).alias("skip_prediction"))


ENTRY_SQL = with_views(TELEMETRY) + """
SELECT machine_id, event_id,
  CASE WHEN x < 0e0 OR x > 200e0 THEN 'invalid'
       WHEN x < 20e0 OR x > 180e0 THEN 'near_limit' ELSE 'ok' END AS temperature_status,
  CASE WHEN x < 0e0 OR x > 50e0 THEN 'invalid'
       WHEN x < 5e0 OR x > 45e0 THEN 'near_limit' ELSE 'ok' END AS pressure_status,
  x BETWEEN 10e0 AND 40e0 AS in_range,
  CASE WHEN (aux / 100e0) < 7e-1 THEN 'Please verify' END AS confidence_flag
FROM telemetry
"""


@register("entry_checks", ENTRY_SQL, ids=("P7", "P9", "P12"))
def entry_checks_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual-entry range checks, inclusive range predicate and low-confidence flag."""
    tel = Tables(spark, sf_dir).telemetry
    ts_, _ = R.entry_check("temperature", F.col("x"))
    ps_, _ = R.entry_check("pressure", F.col("x"))
    return tel.select(
        "machine_id", "event_id", ts_.alias("temperature_status"), ps_.alias("pressure_status"),
        F.col("x").between(10.0, 40.0).alias("in_range"),
        F.when((F.col("aux") / 100.0) < fv.LOW_CONFIDENCE, F.lit("Please verify")).alias("confidence_flag"))


MOTOR_NAMES = list(fv.MOTOR_TYPE_MAP) + ["inconnu"]

MOTOR_SQL = """
SELECT p_partkey,
  CASE upper(list_extract(['""" + "','".join(MOTOR_NAMES) + """'], CAST(p_partkey % 16 AS INTEGER) + 1))
""" + "\n".join(f"    WHEN '{k}' THEN {v}" for k, v in fv.MOTOR_TYPE_MAP.items()) + """
    ELSE 1 END AS motor_class
FROM part
"""


@register("motor_class", MOTOR_SQL, ids=("P15", "J1"))
def motor_class_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Machine type name (cycled over the known names and one unknown) -> class code."""
    p = Tables(spark, sf_dir).part
    names = F.array(*[F.lit(n) for n in MOTOR_NAMES])
    mt = F.element_at(names, (F.col("p_partkey") % 16).cast("int") + 1)
    return p.select("p_partkey", R.motor_class(mt).alias("motor_class"))


TIME_SQL = """
SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour,
  CASE WHEN hour(ts) >= 6 AND hour(ts) < 14 THEN 'morning'
       WHEN hour(ts) >= 14 AND hour(ts) < 22 THEN 'afternoon' ELSE 'night' END AS shift,
  CAST(hour(ts) BETWEEN 8 AND 18 AS INTEGER) AS is_working_hours,
  strftime(ts, '%H:%M') AS hhmm, strftime(ts, '%d/%m/%Y') AS ddmmyyyy,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso,
  CASE WHEN value IS NULL OR floor(value) = 0 THEN NULL
       WHEN value < 24 THEN printf('~%dh', CAST(floor(value) AS BIGINT))
       ELSE printf('~%d jours', CAST(floor(value) AS BIGINT) // 24) END AS remaining_text
FROM events
"""


@register("time_parts", TIME_SQL, ids=("F25", "F26", "F27", "F29"))
def time_parts_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shift, working-hours flag, time formats and remaining-time text."""
    ev = Tables(spark, sf_dir).events
    hrs = F.floor("value").cast("long")
    return ev.select(
        "event_id", F.hour("ts").alias("hour"), TX.work_shift("ts").alias("shift"),
        TX.working_hours_flag("ts").alias("is_working_hours"),
        F.date_format("ts", "HH:mm").alias("hhmm"), F.date_format("ts", "dd/MM/yyyy").alias("ddmmyyyy"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"),
        TX.remaining_time_text(hrs, "fr", compact=True).alias("remaining_text"))
