"""Streaming queries (T1-T8): each drains a file stream over the given table with
``availableNow`` into a Parquet sink and returns the sink as a batch table.
Windowed queries end with a flush row, so the oracle SQL is the batch result over all windows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import round6
from ..session import scratch_path
from ..sources.tables import Tables, sensor_view
from ..streaming import streams as ST
from .registry import register
from .rowwise import KEYS
from .sql_views import FLEET_PROB, RISK_FR, SENSOR, with_views

RANK_SQL = """CASE WHEN p >= 8e-1 THEN 4 WHEN p >= 6e-1 THEN 3 WHEN p >= 4e-1 THEN 2 WHEN p >= 2e-1 THEN 1 ELSE 0 END"""
SCORED_SQL = f"""s AS (SELECT user_id AS machine_id, ts, event_id, event_type, value AS x, p, {RANK_SQL} AS rank
  FROM (SELECT *, least(value / 100e0, 1e0) AS p FROM events))"""


def _events(spark, sf_dir):
    return ST.telemetry_scores(ST.events_stream(spark, sf_dir.rstrip('/')))


def _flushed(spark, sf_dir) -> tuple[DataFrame, ST.Flush]:
    """Scored events together with the flush row's stream."""
    flush = ST.Flush(spark, sf_dir)
    return ST.telemetry_scores(ST.events_stream(spark, sf_dir).union(flush.stream())), flush


def _read(spark, path) -> DataFrame:
    return spark.read.parquet(path)


def _ntz(c):
    return F.col(c).cast("timestamp_ntz").alias(c)


SCORING_SQL = f"""WITH sensor AS (SELECT l_suppkey AS machine_id, l_orderkey, l_linenumber, l_partkey, l_extendedprice,
   20e0 + l_quantity*8e-1 AS torque, CAST(1200 + (l_suppkey*37 + l_partkey*11) % 700 AS DOUBLE) AS rpm,
   CAST((l_partkey*7 + l_orderkey) % 241 AS DOUBLE) AS wear FROM lineitem),
f AS (SELECT *, {FLEET_PROB} AS p FROM sensor)
SELECT {', '.join(KEYS)}, round(p, 6) AS p, {RISK_FR.format(p='p')} AS risk_level FROM f
"""


@register("stream_scoring", SCORING_SQL, ids=("T1",))
def stream_scoring_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stateless stream scoring: the batch scoring expression on a lineitem file stream."""
    from .rowwise import fleet_scored

    class _T:
        sensor = sensor_view(ST.lineitem_stream(spark, sf_dir.rstrip('/')))
    sc = fleet_scored(_T()).select(*KEYS, round6(F.col("p")).alias("p"), "risk_level")
    return _read(spark, ST.run_available_now(sc, "scoring"))


#: The linear scorer of the whole stream, on standard-scaled features.
SCADA_COEFS = {"Power_W": 0.6, "Wear_Torque": 1.1, "Tool_wear__min": 0.4}
SCADA_INTERCEPT = -1.5
SCADA_MODEL = "fleet"


def scada_readings(sensor: DataFrame) -> DataFrame:
    """Tagged readings with faults: a sensor 500 degrees high on line 7, no speed on every 97th
    part, five times the torque on every 101st order.  Such rows must be rejected, not scored."""
    torque = F.when(F.col("l_orderkey") % 101 == 0, F.col("torque") * 5.0).otherwise(F.col("torque"))
    return sensor.select(*KEYS, F.lit(SCADA_MODEL).alias("model"),
                         (F.col("air_k") - 273.15 + F.when(F.col("l_linenumber") == 7, 500.0).otherwise(0.0)).alias("AmbientTemp"),
                         (F.col("proc_k") - 273.15).alias("MotorTemp"),
                         F.when(F.col("l_partkey") % 97 != 0, F.col("rpm")).alias("Speed_RPM"),
                         torque.alias("Torque_Nm"), (F.col("wear") / 60.0).alias("RunHours"))


SCADA_SQL = with_views(SENSOR) + f"""
, fit AS (SELECT avg(pw) AS m1, stddev_pop(pw) AS s1, avg(wear*torque) AS m2, stddev_pop(wear*torque) AS s2,
                 avg(wear) AS m3, stddev_pop(wear) AS s3
          FROM (SELECT *, torque*rpm*1.0471975511965977e-1 AS pw FROM sensor))
, sc AS (SELECT machine_id, l_orderkey, l_linenumber, l_partkey, l_extendedprice,
           (air_k - 273.15e0 + CASE WHEN l_linenumber = 7 THEN 500e0 ELSE 0e0 END) + 273.15e0 AS a,
           (proc_k - 273.15e0) + 273.15e0 AS pk, CASE WHEN l_partkey % 97 <> 0 THEN rpm END AS r,
           CASE WHEN l_orderkey % 101 = 0 THEN torque*5e0 ELSE torque END AS tq, (wear / 60e0)*60e0 AS w FROM sensor)
, ck AS (SELECT *, CAST(coalesce(NOT (a BETWEEN 270e0 AND 380e0), true) AS INTEGER) + CAST(coalesce(NOT (pk BETWEEN 270e0 AND 420e0), true) AS INTEGER)
           + CAST(coalesce(NOT (r BETWEEN 100e0 AND 3000e0), true) AS INTEGER) + CAST(coalesce(NOT (tq BETWEEN 0e0 AND 200e0), true) AS INTEGER)
           + CAST(coalesce(NOT (w BETWEEN 0e0 AND 300e0), true) AS INTEGER) AS n_warnings FROM sc)
, st AS (SELECT ck.*, (tq*r*1.0471975511965977e-1 - m1) / s1 AS z1, (w*tq - m2) / s2 AS z2, (w - m3) / s3 AS z3 FROM ck, fit)
, pr AS (SELECT *, 1e0/(1e0+exp(-(-1.5e0 + 6e-1*z1 + 1.1e0*z2 + 4e-1*z3))) AS p FROM st)
SELECT {', '.join(KEYS)}, CASE WHEN n_warnings = 0 THEN 'OK' ELSE 'INPUT_VALIDATION_ERROR' END AS status, n_warnings,
  CASE WHEN n_warnings = 0 THEN round(z1, 6) END AS power_std, CASE WHEN n_warnings = 0 THEN round(z2, 6) END AS wear_torque_std,
  CASE WHEN n_warnings = 0 THEN round(z3, 6) END AS wear_std, CASE WHEN n_warnings = 0 THEN round(p, 6) END AS p,
  CASE WHEN n_warnings = 0 THEN {RISK_FR.format(p='p')} END AS risk_level FROM pr
"""


@register("stream_scada_scoring", SCADA_SQL, ids=("T1", "P3", "P6", "F11", "P18", "A9"))
def stream_scada_scoring_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole stream scoring: tags, validation, features, scaling with the fitted table, score, band; valid and
    rejected readings go to two sinks and are read back together."""
    fitted = ST.fitted_parameters(Tables(spark, sf_dir).sensor, list(SCADA_COEFS), SCADA_MODEL)
    path = scratch_path(spark, f"streams/parameters-{uuid.uuid4().hex}")
    fitted.write.parquet(path)
    parameters = spark.read.schema(fitted.schema).parquet(path)
    readings = scada_readings(sensor_view(ST.lineitem_stream(spark, sf_dir.rstrip('/'))))
    scored = ST.score_readings(readings, parameters, SCADA_COEFS, SCADA_INTERCEPT, KEYS)
    good, bad = ST.run_two_sinks(scored, "scada")
    both = spark.read.parquet(good).withColumn("n_warnings", F.lit(0)).unionByName(
        spark.read.parquet(bad).withColumn("n_warnings", F.size("warnings")).drop("warnings"))
    names = dict(zip(SCADA_COEFS, ("power_std", "wear_torque_std", "wear_std")))
    return both.select(*KEYS, "status", "n_warnings", *[round6(F.col(f"{c}_std")).alias(n) for c, n in names.items()],
                       round6(F.col("p")).alias("p"), "risk_level")


DAILY_SQL = f"""WITH {SCORED_SQL}
SELECT machine_id, date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end,
       max(rank) AS max_rank, round(avg(p), 6) AS mean_p, count(*) AS n
FROM s GROUP BY machine_id, date_trunc('day', ts)
"""


@register("stream_daily_risk", DAILY_SQL, ids=("T2",))
def stream_daily_risk_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily tumbling window per machine: max risk rank, mean probability (watermark 1 h)."""
    events, flush = _flushed(spark, sf_dir)
    out = _read(spark, ST.run_available_now(ST.daily_risk(events), "daily", flush=flush))
    return out.select("machine_id", _ntz("window_start"), _ntz("window_end"), "max_rank",
                      round6(F.col("mean_p")).alias("mean_p"), "n")


SLIDING_SQL = f"""WITH {SCORED_SQL},
w AS (SELECT machine_id, x, date_trunc('day', ts) - to_days(CAST(k AS INTEGER)) AS window_start
      FROM s, (SELECT unnest(range(0, 7)) AS k))
SELECT machine_id, window_start, window_start + INTERVAL 7 DAY AS window_end,
       round(avg(x), 6) AS mean_x, round(min(x), 6) AS min_x, round(max(x), 6) AS max_x
FROM w GROUP BY machine_id, window_start
"""


@register("stream_sliding_stats", SLIDING_SQL, ids=("T3",))
def stream_sliding_stats_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """7-day windows sliding by 1 day per machine: mean / min / max."""
    events, flush = _flushed(spark, sf_dir)
    out = _read(spark, ST.run_available_now(ST.sliding_stats(events), "sliding", flush=flush))
    return out.select("machine_id", _ntz("window_start"), _ntz("window_end"),
                      *[round6(F.col(c)).alias(c) for c in ["mean_x", "min_x", "max_x"]])


SESSION_SQL = f"""WITH {SCORED_SQL},
f AS (SELECT machine_id, ts FROM s WHERE event_type = 'error'),
g AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY machine_id ORDER BY ts) IS NULL
                       OR ts >= lag(ts) OVER (PARTITION BY machine_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new
      FROM f),
h AS (SELECT *, sum(new) OVER (PARTITION BY machine_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT machine_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS faults
FROM h GROUP BY machine_id, sid
"""


@register("stream_fault_sessions", SESSION_SQL, ids=("T4",))
def stream_fault_sessions_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of fault events per machine (gap 6 h), closed by the watermark."""
    events, flush = _flushed(spark, sf_dir)
    out = _read(spark, ST.run_available_now(ST.fault_sessions(events), "sessions", flush=flush))
    return out.select("machine_id", _ntz("session_start"), _ntz("session_end"), "faults")


EMA_SQL = f"""WITH {SCORED_SQL}
SELECT machine_id, event_id, round(list_reduce(list(x) OVER (PARTITION BY machine_id ORDER BY ts, event_id
  ROWS BETWEEN 54 PRECEDING AND CURRENT ROW), lambda y, v: y*5e-1 + v*5e-1) + 1e-9, 6) AS ema FROM s
"""


@register("stream_ema", EMA_SQL, ids=("T5",))
def stream_ema_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stateful EMA (span 3) per machine by event time; the flush row closes the last readings."""
    events, flush = _flushed(spark, sf_dir)
    out = _read(spark, ST.run_available_now(ST.stateful_ema(events, 3), "ema", flush=flush))
    return out.select("machine_id", "event_id", round6(F.col("ema") + F.lit(1e-9)).alias("ema"))


DEDUP_SQL = f"""WITH {SCORED_SQL}
SELECT DISTINCT machine_id, rank, CAST(ts AS DATE) AS day FROM s WHERE p >= 8e-1
"""


@register("stream_alert_dedup", DEDUP_SQL, ids=("T6",))
def stream_alert_dedup_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One alert per machine, risk level and day (dedup state bounded by the watermark)."""
    return _read(spark, ST.run_available_now(ST.dedup_alerts(_events(spark, sf_dir)), "dedup"))


JOIN_SQL = """
SELECT a.user_id AS machine_id, a.event_id AS alarm_id, r.event_id AS reading_id
FROM events a JOIN events r ON a.user_id = r.user_id AND r.ts >= a.ts - INTERVAL 1 HOUR AND r.ts <= a.ts
WHERE a.event_type = 'error' AND r.event_type <> 'error'
"""


@register("stream_alarm_context", JOIN_SQL, ids=("T7", "J7"))
def stream_alarm_context_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream-stream interval join: each alarm with its machine's readings of the hour before."""
    ev = _events(spark, sf_dir)
    out = ST.alarm_context(ev.filter(F.col("event_type") != "error"), ev.filter(F.col("event_type") == "error"))
    return _read(spark, ST.run_available_now(out, "alarm_context"))


SINK_SQL = """SELECT CAST(ts AS DATE) AS reading_date, count(*) AS n, round(sum(value), 6) AS total
FROM events GROUP BY ALL"""


@register("stream_readings_sink", SINK_SQL, ids=("T8", "S12"))
def stream_readings_sink_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append sink of readings partitioned by day (checkpointed), read back per day."""
    ev = ST.events_stream(spark, sf_dir.rstrip('/'))
    back = _read(spark, ST.append_readings(ev))
    return back.groupBy("reading_date").agg(F.count(F.lit(1)).alias("n"), round6(F.sum("value")).alias("total"))
