"""Joins: knowledge lookups (J1-J3), keyed reunion (J4), registry joins (J5, J6),
time-range labelling (J7), as-of (J8), interval assembly (J9), schedule (J11).

Dimension tables built from fixed values (a handful of rows) are broadcast;
data-sized dimensions are left to the planner, whose runtime size check
(AQE) decides between broadcast and a shuffled join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .sequence import ordered
from .temporal import ordered_features


def knowledge_table(spark: SparkSession) -> DataFrame:
    """J2 dimension: mode -> name, cause, five actions, vendor hints (5 rows)."""
    rows = [(m, d["nom"], d["cause"], d["actions"], d["siemens_param"], d["schneider_param"])
            for m, d in fv.FAILURE_DETAILS.items()]
    return spark.createDataFrame(rows, "mode string, name string, cause string, actions array<string>, "
                                       "siemens string, schneider string")


def risk_table(spark: SparkSession) -> DataFrame:
    """J3 dimension: French level -> description, schedule lines, time-to-failure text (5 rows)."""
    rows = [(lv, fv.RISK_DESCRIPTIONS[lv], fv.MAINTENANCE_SCHEDULES[lv], fv.TTF_TEXT_FR[lv])
            for lv in fv.RISK_ORDER_FR]
    return spark.createDataFrame(rows, "risk_level string, description string, schedule array<string>, ttf string")


def recommendation_table(spark: SparkSession) -> DataFrame:
    """J3 dimension (English): level -> maintenance recommendation (4 rows)."""
    return spark.createDataFrame(list(fv.RECOMMENDATIONS_EN.items()), "risk_en string, recommendation string")


def explode_modes(df: DataFrame, modes: str = "modes") -> DataFrame:
    """One row per (reading, mode) with the mode's knowledge; '—' rows drop."""
    spark = df.sparkSession
    e = df.select("*", F.posexplode(F.col(modes)).alias("mode_pos", "mode")).filter(F.col("mode") != fv.NO_MODE)
    return e.join(F.broadcast(knowledge_table(spark)), "mode", "left")


def with_risk_info(df: DataFrame, risk: str = "risk_level") -> DataFrame:
    """Description, schedule and time-to-failure text by French risk level."""
    spark = df.sparkSession
    rt = risk_table(spark).withColumnRenamed("risk_level", "_rk")
    return df.join(F.broadcast(rt), F.col(risk) == F.col("_rk"), "left").drop("_rk")


def reunite(features: DataFrame, target: DataFrame, key: list[str]) -> DataFrame:
    """Features and target joined on an explicit row key (never by position)."""
    return features.join(target, key, "inner")


def registry_gaps(readings: DataFrame, machines: DataFrame, key: str = "machine_id") -> dict[str, DataFrame]:
    """Readings of unregistered machines, machines without readings, registered readings."""
    return {
        "unregistered_readings": readings.join(machines, key, "left_anti"),
        "silent_machines": machines.join(readings.select(key), key, "left_anti"),
        "registered_readings": readings.join(machines.select(key), key, "left_semi"),
    }


def label_by_alarms(readings: DataFrame, alarms: DataFrame, *, key: str, ts: str, alarm_ts: str,
                    horizon_hours: float, reading_id: str, alarm_id: str | None = None, **ordered_kw) -> DataFrame:
    """label = 1 when the machine has an alarm in [ts, ts + h] (another event).

    Readings and alarms are put in one ordered frame per machine, latest first, and each reading
    takes the next alarm at or after it, so there is no join on time and no join back: repeated
    reading ids stay as they are.  A reading that is itself the only alarm of its time
    (``alarm_id``) takes the alarm after that."""
    def us(c):
        return F.unix_micros(F.col(c).cast("timestamp"))

    own = F.col(alarm_id) if alarm_id else F.lit(None)
    # Per machine and time, the least and largest alarm id tell whether any is another event.
    al = alarms.filter(F.col(alarm_ts).isNotNull()).groupBy(F.col(key).alias("_k"), us(alarm_ts).alias("_at")).agg(
        F.min(own.cast("string")).alias("_lo"), F.max(own.cast("string")).alias("_hi")).withColumn("_t", -F.col("_at"))
    o = ordered(al, "_k", ["_t"], 1, **ordered_kw)
    al = o.body(o.df.withColumn("_after", F.lag("_at", 1).over(o.w)))
    rd = readings.select(F.col(key).alias("_k"), (-us(ts)).alias("_t"), F.lit(1).alias("_side"),
                         F.col(reading_id).cast("string").alias("_id"), F.struct(*readings.columns).alias("_row"))
    al = al.select("_k", "_t", F.lit(0).alias("_side"), F.lit(None).cast("string").alias("_id"),
                   F.lit(None).cast(rd.schema["_row"].dataType).alias("_row"),
                   F.struct(F.col("_at").alias("at"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.col("_after").alias("after")).alias("_a"))
    frame = al.unionByName(rd.withColumn("_a", F.lit(None).cast(al.schema["_a"].dataType)))
    out = ordered_features(frame, "_k", ["_t", "_side", "_id"], [], groups=(), ffill_columns=["_a"], **ordered_kw)
    n = F.col("_a_ffill")
    itself = F.coalesce((n["lo"] == F.col("_id")) & (n["hi"] == F.col("_id")), F.lit(False))
    at = F.when(itself, n["after"]).otherwise(n["at"])
    hit = F.col("_k").isNotNull() & (at <= -F.col("_t") + F.lit(int(horizon_hours * 3600 * 1_000_000)))
    return out.filter(F.col("_side") == 1).select("_row.*", F.coalesce(hit, F.lit(False)).cast("int").alias("label"))


def asof_last_reading(readings: DataFrame, alarms: DataFrame, *, key: str, ts: str, value: str,
                      reading_id: str, alarm_id: str, **ordered_kw) -> DataFrame:
    """For every alarm, the last reading at or before it (same machine).

    Union of both sides ordered by (ts, side, id) with readings first on ties,
    then a forward fill of the reading struct over the skew-safe ordered frame:
    no theta join."""
    rd = readings.select(F.col(key), F.col(ts).alias("_ts"), F.lit(0).alias("_side"),
                         F.col(reading_id).alias("_id"),
                         F.struct(F.col(reading_id).alias("reading_id"), F.col(ts).alias("reading_ts"),
                                  F.col(value).alias("reading_value")).alias("_r"))
    al = alarms.select(F.col(key), F.col(ts).alias("_ts"), F.lit(1).alias("_side"),
                       F.col(alarm_id).alias("_id"), F.lit(None).cast(rd.schema["_r"].dataType).alias("_r"))
    u = rd.unionByName(al)
    f = ordered_features(u, key, ["_ts", "_side", "_id"], [], groups=(), ffill_columns=["_r"], **ordered_kw)
    return f.filter(F.col("_side") == 1).select(
        F.col(key), F.col("_id").alias(alarm_id), F.col("_ts").alias("alarm_ts"), "_r_ffill.*")


def plant_assembly(telemetry: DataFrame, machines: DataFrame, errors: DataFrame, maintenance: DataFrame,
                   *, key: str, ts: str, value: str) -> DataFrame:
    """Telemetry per (machine, day) with its registry row and the day's error,
    maintenance and failure counts; every side is aggregated to (machine, day)
    before the joins, so each join sees one row per key."""
    day = F.to_date(F.col(ts))
    t = telemetry.groupBy(key, day.alias("day")).agg(F.count(F.lit(1)).alias("readings"),
                                                     F.avg(value).alias("mean_value"),
                                                     F.max("failure").alias("failed"))
    e = errors.groupBy(key, day.alias("day")).agg(F.count(F.lit(1)).alias("errors"))
    m = maintenance.groupBy(key, day.alias("day")).agg(F.count(F.lit(1)).alias("maintenance"))
    out = t.join(e, [key, "day"], "left").join(m, [key, "day"], "left").join(machines, key, "left")
    return out.fillna(0, ["errors", "maintenance"])


def schedule_status(readings: DataFrame, machines: DataFrame, *, key: str, ts: str, now: str,
                    frequency_min: int = fv.READING_FREQUENCY_MIN) -> DataFrame:
    """Last reading per machine vs the expected frequency at a literal 'now':
    'never', 'overdue' (elapsed > frequency), 'due_soon' (> 90 %), else 'ok'."""
    last = readings.groupBy(key).agg(F.max(ts).alias("last_reading"))
    j = machines.join(last, key, "left")
    now_us = F.unix_micros(F.lit(now).cast("timestamp"))
    elapsed = (now_us - F.unix_micros(F.col("last_reading").cast("timestamp"))) / F.lit(60_000_000.0)
    status = (F.when(F.col("last_reading").isNull(), F.lit("never"))
              .when(elapsed > frequency_min, F.lit("overdue"))
              .when(elapsed > 0.9 * frequency_min, F.lit("due_soon")).otherwise(F.lit("ok")))
    return j.select(key, "last_reading", elapsed.alias("elapsed_min"), status.alias("status"))
