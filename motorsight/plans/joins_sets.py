"""Joins, set operations, sorts and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import rules as R
from ..functions.numeric import round6
from ..operators import joins as J
from ..operators import metrics as MT
from ..sources.tables import Tables
from .registry import register
from .rowwise import KEYS, fleet_scored
from .sql_views import FLEET_PROB, SENSOR, with_views

MODES_SQL_EXPR = """concat_ws(',', CASE WHEN wear >= 180e0 THEN 'TWF' END,
   CASE WHEN (proc_k - air_k) < 8.6e0 AND rpm < 1380e0 THEN 'HDF' END,
   CASE WHEN torque*rpm*1.0471975511965977e-1 < 3500e0 OR torque*rpm*1.0471975511965977e-1 > 9500e0 THEN 'PWF' END,
   CASE WHEN wear*torque > 12000e0 THEN 'OSF' END)"""


def _kb_values() -> str:
    def q(s):
        return "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({q(m)}, {q(d['nom'])}, {q(d['siemens_param'])}, {len(d['actions'])})"
                     for m, d in fv.FAILURE_DETAILS.items())


KB_SQL = with_views(SENSOR) + f"""
, m AS (SELECT machine_id, l_orderkey, l_linenumber, l_partkey, l_extendedprice, {MODES_SQL_EXPR} AS ms FROM sensor)
, e AS (SELECT m.*, unnest(generate_series(1, len(string_split(ms, ',')))) AS pos FROM m WHERE ms <> '')
, e2 AS (SELECT *, string_split(ms, ',')[pos] AS mode FROM e)
, kb AS (SELECT * FROM (VALUES {_kb_values()}) v(mode, name, siemens, n_actions))
SELECT e2.mode, count(*) AS n, max(name) AS name, max(siemens) AS siemens, max(n_actions) AS n_actions
FROM e2 LEFT JOIN kb ON e2.mode = kb.mode GROUP BY e2.mode
"""


@register("mode_knowledge", KB_SQL, ids=("J2",))
def mode_knowledge_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings exploded by likely failure mode, joined to the mode knowledge table."""
    s = Tables(spark, sf_dir).sensor.select(*KEYS, R.likely_failure_modes().alias("modes"))
    e = J.explode_modes(s)
    return e.groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.max("name").alias("name"),
                                 F.max("siemens").alias("siemens"), F.max(F.size("actions")).alias("n_actions"))


def _risk_values() -> str:
    def q(s):
        return "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({q(lv)}, {q(fv.RISK_DESCRIPTIONS[lv])}, {len(fv.MAINTENANCE_SCHEDULES[lv])}, {q(fv.TTF_TEXT_FR[lv])})"
                     for lv in fv.RISK_ORDER_FR)


RISKINFO_SQL = with_views(SENSOR) + f"""
, f AS (SELECT {FLEET_PROB} AS p FROM sensor)
, r AS (SELECT CASE WHEN p >= 8e-1 THEN 'CRITIQUE' WHEN p >= 6e-1 THEN 'URGENT' WHEN p >= 4e-1 THEN 'ATTENTION'
                    WHEN p >= 2e-1 THEN 'SURVEILLER' ELSE 'NORMAL' END AS risk_level FROM f)
, t AS (SELECT * FROM (VALUES {_risk_values()}) v(risk_level, description, schedule_lines, ttf))
SELECT r.risk_level, count(*) AS n, max(description) AS description, max(schedule_lines) AS schedule_lines,
       max(ttf) AS ttf
FROM r LEFT JOIN t ON r.risk_level = t.risk_level GROUP BY r.risk_level
"""


@register("risk_knowledge", RISKINFO_SQL, ids=("J3", "R2"))
def risk_knowledge_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored readings joined to the risk description / schedule / time-to-failure table."""
    f = fleet_scored(Tables(spark, sf_dir)).select("risk_level")
    j = J.with_risk_info(f)
    return j.groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"), F.max("description").alias("description"),
                                       F.max(F.size("schedule")).alias("schedule_lines"), F.max("ttf").alias("ttf"))


REUNITE_SQL = with_views(SENSOR) + """
SELECT label, count(*) AS n, round(sum(torque), 6) AS torque_sum FROM sensor GROUP BY label
"""


@register("reunite_target", REUNITE_SQL, ids=("J4", "P1", "P2"))
def reunite_target_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and target split apart, then joined back on the explicit row key."""
    s = Tables(spark, sf_dir).sensor
    feats = s.drop("label", "mtype")          # P1: drop id / leak columns
    target = s.select(*KEYS, F.col("label").cast("int").alias("label"))   # P2
    j = J.reunite(feats, target, KEYS)
    return j.groupBy("label").agg(F.count(F.lit(1)).alias("n"), round6(F.sum("torque")).alias("torque_sum"))


REGISTRY_SQL = with_views(SENSOR) + """
, mach AS (SELECT s_suppkey AS machine_id, n_name AS location, s_acctbal > 0 AS active
           FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey)
SELECT location, active, count(*) AS readings, count(DISTINCT sensor.machine_id) AS machines
FROM sensor LEFT JOIN mach ON sensor.machine_id = mach.machine_id GROUP BY ALL
"""


@register("readings_registry", REGISTRY_SQL, ids=("J5", "P11"))
def readings_registry_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with the machine registry (location, active), counted per location."""
    t = Tables(spark, sf_dir)
    j = t.sensor.join(t.machine, "machine_id", "left")
    return j.groupBy("location", "active").agg(F.count(F.lit(1)).alias("readings"),
                                               F.countDistinct("machine_id").alias("machines"))


GAPS_SQL = """
WITH mach AS (SELECT c_custkey AS machine_id FROM customer WHERE c_acctbal > 0),
rd AS (SELECT user_id AS machine_id, event_id FROM events)
SELECT 'unregistered_readings' AS kind, count(*) AS n FROM rd WHERE machine_id NOT IN (SELECT machine_id FROM mach)
UNION ALL SELECT 'silent_machines', count(*) FROM mach WHERE machine_id NOT IN (SELECT machine_id FROM rd)
UNION ALL SELECT 'registered_readings', count(*) FROM rd WHERE machine_id IN (SELECT machine_id FROM mach)
"""


@register("registry_gaps", GAPS_SQL, ids=("J6",))
def registry_gaps_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anti and semi joins: unregistered readings, silent machines, registered readings."""
    t = Tables(spark, sf_dir)
    mach = t.customer.filter(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("machine_id"))
    rd = t.events.select(F.col("user_id").alias("machine_id"), "event_id")
    g = J.registry_gaps(rd, mach)
    out = None
    for k, d in g.items():
        part = d.agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


ALARM_LABEL_SQL = """
WITH al AS (SELECT user_id AS machine_id, ts AS ats, event_id AS aid FROM events
            WHERE event_type IN ('error', 'signup', 'purchase'))
SELECT e.event_id, CASE WHEN EXISTS (SELECT 1 FROM al WHERE al.machine_id = e.user_id AND al.aid <> e.event_id
         AND al.ats >= e.ts AND al.ats <= e.ts + INTERVAL 24 HOUR) THEN 1 ELSE 0 END AS label
FROM events e
"""


@register("alarm_labels", ALARM_LABEL_SQL, ids=("J7", "P8"))
def alarm_labels_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reading is positive when its machine raises a fault alarm within the next 24 h."""
    t = Tables(spark, sf_dir)
    # The alarm text keeps whole seconds; the view also carries the exact event time.
    al = t.alarm.filter(F.col("CLASS").isin(fv.ALARM_FAULT_CLASSES)).select(
        F.col("Instance").cast("long").alias("machine_id"), F.col("event_ts").alias("ats"), "event_id")
    rd = t.events.select(F.col("user_id").alias("machine_id"), "ts", "event_id")
    lab = J.label_by_alarms(rd, al, key="machine_id", ts="ts", alarm_ts="ats", horizon_hours=24,
                            reading_id="event_id", alarm_id="event_id")
    return lab.select("event_id", F.col("label").cast("int").alias("label"))


ASOF_SQL = """
WITH rd AS (SELECT user_id AS machine_id, ts, event_id, value FROM events WHERE event_type NOT IN ('error')),
al AS (SELECT user_id AS machine_id, ts, event_id FROM events WHERE event_type = 'error')
SELECT al.machine_id, al.event_id, al.ts AS alarm_ts,
  (SELECT arg_max(rd.event_id, (rd.ts, rd.event_id)) FROM rd WHERE rd.machine_id = al.machine_id AND rd.ts <= al.ts) AS reading_id,
  (SELECT max(rd.ts) FROM rd WHERE rd.machine_id = al.machine_id AND rd.ts <= al.ts) AS reading_ts,
  (SELECT arg_max(rd.value, (rd.ts, rd.event_id)) FROM rd WHERE rd.machine_id = al.machine_id AND rd.ts <= al.ts) AS reading_value
FROM al
"""


@register("asof_last_reading", ASOF_SQL, ids=("J8",))
def asof_last_reading_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every error alarm, the last non-error reading at or before it."""
    ev = Tables(spark, sf_dir).events
    rd = ev.filter(F.col("event_type") != "error").select(F.col("user_id").alias("machine_id"), "ts",
                                                          "event_id", "value")
    al = ev.filter(F.col("event_type") == "error").select(F.col("user_id").alias("machine_id"), "ts", "event_id")
    return J.asof_last_reading(rd, al, key="machine_id", ts="ts", value="value", reading_id="event_id",
                               alarm_id="event_id")


PLANT_SQL = """
WITH t AS (SELECT user_id AS machine_id, CAST(ts AS DATE) AS day, count(*) AS readings, avg(value) AS mean_value,
                  max(CAST(event_type = 'error' AS INTEGER)) AS failed FROM events GROUP BY ALL),
e AS (SELECT user_id AS machine_id, CAST(ts AS DATE) AS day, count(*) AS errors FROM events
      WHERE event_type = 'error' GROUP BY ALL),
m AS (SELECT user_id AS machine_id, CAST(ts AS DATE) AS day, count(*) AS maintenance FROM events
      WHERE event_type = 'purchase' GROUP BY ALL)
SELECT t.machine_id, t.day, readings, round(mean_value, 6) AS mean_value, failed,
       coalesce(errors, 0) AS errors, coalesce(maintenance, 0) AS maintenance, c_mktsegment AS model
FROM t LEFT JOIN e ON t.machine_id = e.machine_id AND t.day = e.day
       LEFT JOIN m ON t.machine_id = m.machine_id AND t.day = m.day
       LEFT JOIN customer ON t.machine_id = c_custkey
"""


@register("plant_assembly", PLANT_SQL, ids=("J9",))
def plant_assembly_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry, registry, errors, maintenance and failures per machine and day."""
    t = Tables(spark, sf_dir)
    tel = t.telemetry
    ev = t.events.select(F.col("user_id").alias("machine_id"), "ts", "event_type")
    mach = t.customer.select(F.col("c_custkey").alias("machine_id"), F.col("c_mktsegment").alias("model"))
    out = J.plant_assembly(tel, mach, ev.filter(F.col("event_type") == "error"),
                           ev.filter(F.col("event_type") == "purchase"), key="machine_id", ts="ts", value="x")
    return out.select("machine_id", "day", "readings", round6(F.col("mean_value")).alias("mean_value"),
                      "failed", "errors", "maintenance", "model")


SCHED_SQL = """
WITH last AS (SELECT user_id AS machine_id, max(ts) AS last_reading FROM events GROUP BY user_id),
j AS (SELECT c_custkey AS machine_id, last_reading,
             (epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(last_reading)) / 60000000e0 AS el
      FROM customer LEFT JOIN last ON c_custkey = machine_id)
SELECT machine_id, last_reading, round(el, 6) AS elapsed_min,
  CASE WHEN last_reading IS NULL THEN 'never' WHEN el > 480 THEN 'overdue' WHEN el > 432e0 THEN 'due_soon' ELSE 'ok' END AS status
FROM j
"""


@register("schedule_status", SCHED_SQL, ids=("J11",))
def schedule_status_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected reading schedule (480 min) vs the last reading, at a literal 'now'."""
    t = Tables(spark, sf_dir)
    rd = t.events.select(F.col("user_id").alias("machine_id"), "ts")
    mach = t.customer.select(F.col("c_custkey").alias("machine_id"))
    s = J.schedule_status(rd, mach, key="machine_id", ts="ts", now="2024-01-31 00:00:00")
    return s.select("machine_id", "last_reading", round6(F.col("elapsed_min")).alias("elapsed_min"), "status")


UNION_SQL = """
SELECT event_type, count(*) AS n, count(aux) AS with_aux FROM (
  SELECT event_type, NULL AS aux FROM events WHERE event_type = 'error'
  UNION ALL SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) FROM events WHERE event_type <> 'error')
GROUP BY event_type
"""


@register("union_frames", UNION_SQL, ids=("U1",))
def union_frames_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-kind frames with different columns brought together by name."""
    ev = Tables(spark, sf_dir).events
    a = ev.filter(F.col("event_type") == "error").select("event_type")
    b = ev.filter(F.col("event_type") != "error").select(
        "event_type", F.get_json_object("props", "$.k").cast("int").alias("aux"))
    u = a.unionByName(b, allowMissingColumns=True)
    return u.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("aux").alias("with_aux"))


WIDE_LONG_SQL = with_views(SENSOR) + """
SELECT reading_type, count(*) AS n, round(sum(value), 6) AS total FROM (
  SELECT 'temperature' AS reading_type, proc_k - 273.15e0 AS value FROM sensor
  UNION ALL SELECT 'speed', rpm FROM sensor
  UNION ALL SELECT 'power', torque*rpm*1.0471975511965977e-1 / 1000e0 FROM sensor
  UNION ALL SELECT event_type, value FROM events)
GROUP BY reading_type
"""


@register("wide_to_long", WIDE_LONG_SQL, ids=("U2",))
def wide_to_long_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide readings unpivoted and unioned with long readings into one long table."""
    t = Tables(spark, sf_dir)
    s = t.sensor
    wide = s.select((F.col("proc_k") - 273.15).alias("temperature"), F.col("rpm").alias("speed"),
                    (R.power_w("torque", "rpm") / 1000.0).alias("power"))
    long1 = wide.unpivot([], ["temperature", "speed", "power"], "reading_type", "value")
    long2 = t.events.select(F.col("event_type").alias("reading_type"), "value")
    u = long1.unionByName(long2)
    return u.groupBy("reading_type").agg(F.count(F.lit(1)).alias("n"), round6(F.sum("value")).alias("total"))


MODELS_SQL = with_views(SENSOR) + f"""
, sc AS (SELECT label, {FLEET_PROB} AS p_lin,
           1e0/(1e0+exp(-(-6e0 + 3e-4*(wear*torque) + 1e-2*wear))) AS p_wear,
           CASE WHEN {MODES_SQL_EXPR} <> '' THEN 1e0 ELSE 0e0 END AS p_rule FROM sensor)
, lg AS (SELECT 'linear' AS model, label, p_lin AS p FROM sc UNION ALL SELECT 'wear_only', label, p_wear FROM sc
         UNION ALL SELECT 'rules', label, p_rule FROM sc)
, c AS (SELECT model, sum(CASE WHEN label = 1 AND p >= 4.2e-1 THEN 1 ELSE 0 END) AS tp,
               sum(CASE WHEN label = 0 AND p >= 4.2e-1 THEN 1 ELSE 0 END) AS fp,
               sum(CASE WHEN label = 1 AND p < 4.2e-1 THEN 1 ELSE 0 END) AS fn FROM lg GROUP BY model)
, m AS (SELECT model, CASE WHEN tp + fp = 0 THEN 0e0 ELSE tp / (tp + fp) END AS precision,
               CASE WHEN tp + fn = 0 THEN 0e0 ELSE tp / (tp + fn) END AS recall FROM c)
SELECT model, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(CASE WHEN precision + recall = 0 THEN 0e0 ELSE 2e0 * precision * recall / (precision + recall) END, 6) AS f1,
  CAST(row_number() OVER (ORDER BY CASE WHEN precision + recall = 0 THEN 0e0 ELSE 2e0 * precision * recall / (precision + recall) END DESC) AS INTEGER) AS f1_rank
FROM m
"""


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long score table (model, label, p) of three scorers over every reading."""
    f = fleet_scored(Tables(spark, sf_dir))
    p_wear = R.sigmoid(R.linear_logit({"Wear_Torque": 3e-4, "wear": 1e-2}, -6.0))
    p_rule = F.when(F.size(R.likely_failure_modes(empty_marker=False)) > 0, 1.0).otherwise(0.0)
    return f.select("label", F.explode(F.array(
        F.struct(F.lit("linear").alias("model"), F.col("p").alias("p")),
        F.struct(F.lit("wear_only").alias("model"), p_wear.alias("p")),
        F.struct(F.lit("rules").alias("model"), p_rule.alias("p")))).alias("s")).select("s.model", "label", "s.p")


@register("model_comparison", MODELS_SQL, ids=("M17", "L1", "L6"))
def model_comparison_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluate a set of scorers on one long score table; ranked by F1."""
    from pyspark.sql import Window
    sc = model_scores(spark, sf_dir).withColumn("pred", R.binary_decision("p", fv.PRODUCTION_THRESHOLD))
    m = MT.classification_metrics(sc, by=["model"])
    # One row per model: the ranking window is bounded by the model list.
    return m.select("model", round6(F.col("precision")).alias("precision"), round6(F.col("recall")).alias("recall"),
                    round6(F.col("f1")).alias("f1"),
                    F.row_number().over(Window.orderBy(F.desc("f1"))).cast("int").alias("f1_rank"))


ALARM_SORT_SQL = """
SELECT CASE event_type WHEN 'error' THEN 'ALMTD' WHEN 'signup' THEN 'CRASD' ELSE 'CRPRD' END AS "CLASS",
       CAST(user_id AS VARCHAR) AS "Instance", date_trunc('second', ts) AS "DateTime", 1 AS Failure_Label, event_id
FROM events WHERE event_type IN ('error', 'signup', 'purchase')
"""


@register("alarm_faults_sorted", ALARM_SORT_SQL, ids=("S5", "P8", "P10", "L2"))
def alarm_faults_sorted_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fault classes only, label 1, time parsed (bad -> NULL), sorted by time, NULLs last."""
    from ..sources.readers import fault_labels
    al = Tables(spark, sf_dir).alarm
    return fault_labels(al).select("CLASS", "Instance", "DateTime", "Failure_Label", "event_id")


NEWEST_SQL = """
SELECT event_id, user_id AS machine_id, ts, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 10
"""


@register("newest_readings", NEWEST_SQL, ids=("L3", "S8"))
def newest_readings_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 newest readings (a top-k: sort + limit becomes TakeOrderedAndProject)."""
    ev = Tables(spark, sf_dir).events
    return ev.select("event_id", F.col("user_id").alias("machine_id"), "ts", "value") \
        .orderBy(F.desc("ts"), F.desc("event_id")).limit(10)


TOPK_SQL = with_views(SENSOR) + """
SELECT feature, round(abs_corr, 6) AS abs_corr FROM (
  SELECT 'air_k' AS feature, abs(corr(air_k, label)) AS abs_corr FROM sensor
  UNION ALL SELECT 'proc_k', abs(corr(proc_k, label)) FROM sensor
  UNION ALL SELECT 'rpm', abs(corr(rpm, label)) FROM sensor
  UNION ALL SELECT 'torque', abs(corr(torque, label)) FROM sensor
  UNION ALL SELECT 'wear', abs(corr(wear, label)) FROM sensor)
ORDER BY abs_corr DESC LIMIT 3
"""


@register("top_features", TOPK_SQL, ids=("L4",))
def top_features_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-3 sensors by absolute correlation with the failure label."""
    s = Tables(spark, sf_dir).sensor
    feats = ["air_k", "proc_k", "rpm", "torque", "wear"]
    wide = s.agg(*[F.abs(F.corr(c, "label")).alias(c) for c in feats])
    long = wide.unpivot([], feats, "feature", "abs_corr")
    return long.orderBy(F.desc("abs_corr")).limit(3).select("feature", round6(F.col("abs_corr")).alias("abs_corr"))


SAMPLE_SQL = """
SELECT event_id, user_id AS machine_id, value FROM events
ORDER BY md5(CAST(event_id AS VARCHAR) || '|42') LIMIT 500
"""


@register("seeded_sample", SAMPLE_SQL, ids=("L5",))
def seeded_sample_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reproducible sample of at most 500 readings: order by md5(key|seed), limit."""
    from ..operators.sampling import seeded_sample
    ev = Tables(spark, sf_dir).events
    return seeded_sample(ev, ["event_id"], 500, seed=42).select("event_id", F.col("user_id").alias("machine_id"),
                                                                 "value")
