"""Text parsing, reports and the remaining row-wise operators
(F10, F11, F20, F22-F24, F28, M22, P4, P13, P16-P18, R1-R7, S13)."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import physics as ph
from ..functions import rules as R
from ..functions import text as TX
from ..functions.numeric import round6
from ..operators import report as RP
from ..operators import scoring as SC
from ..operators import stats as ST
from ..sources import readers as RD
from ..sources.tables import TABLES, Tables
from .registry import register
from .rowwise import KEYS, fleet_scored
from .sql_views import FLEET_PROB, RISK_FR, SENSOR, with_views

RISK_FR_SQL = RISK_FR.format(p='p')

def _q(s: str) -> str:
    return s.replace("'", "''")


AR_DIGITS = fv.ARABIC_INDIC_DIGITS + fv.EASTERN_ARABIC_INDIC_DIGITS
ASCII_DIGITS = "0123456789" * 2

OCR_SQL = f"""
SELECT doc_id, TRY_CAST(NULLIF(regexp_extract(replace(replace(trim(translate(text, '{AR_DIGITS}', '{ASCII_DIGITS}')), ' ', ''), ',', '.'),
       '[-+]?\\d*\\.?\\d+', 0), '') AS DOUBLE) AS value
FROM documents
"""


@register("ocr_numbers", OCR_SQL, ids=("F22",))
def ocr_numbers_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First number of every whole document after OCR clean-up (spaces out, comma -> dot)."""
    d = Tables(spark, sf_dir).documents
    return d.select("doc_id", TX.ocr_number("text").alias("value"))


def _words_sql(words: dict) -> str:
    return "MAP {" + ", ".join(f"'{k}': {float(v)!r}e0" for k, v in words.items()) + "}"


WS = TX.SPLIT_WS
SPEECH_SQL = f"""
WITH d AS (SELECT doc_id, lang, translate(text, '{AR_DIGITS}', '{ASCII_DIGITS}') AS t FROM documents),
w AS (SELECT doc_id, lang, t,
  list_filter(string_split_regex(trim(t), '{WS}'), lambda x: x <> '') AS toks,
  list_filter(string_split_regex(lower(trim(t)), '{WS}'), lambda x: x <> '') AS ltoks FROM d)
SELECT doc_id, coalesce(TRY_CAST(NULLIF(regexp_extract(t, '\\d+\\.?\\d*', 0), '') AS DOUBLE),
  CASE WHEN lower(lang) LIKE 'ar%' THEN {_words_sql(fv.NUMBER_WORDS_AR)}[list_filter(toks, lambda x: x IN ({', '.join(repr(k) for k in fv.NUMBER_WORDS_AR)}))[1]]
       WHEN lower(lang) LIKE 'fr%' THEN {_words_sql(fv.NUMBER_WORDS_FR)}[list_filter(ltoks, lambda x: x IN ({', '.join(repr(k) for k in fv.NUMBER_WORDS_FR)}))[1]]
       ELSE {_words_sql(fv.NUMBER_WORDS_EN)}[list_filter(ltoks, lambda x: x IN ({', '.join(repr(k) for k in fv.NUMBER_WORDS_EN)}))[1]] END) AS value
FROM w
"""


@register("speech_numbers", SPEECH_SQL, ids=("F23",))
def speech_numbers_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number from each whole document read as a transcript in its language."""
    d = Tables(spark, sf_dir).documents
    return d.select("doc_id", TX.speech_number("text", "lang").alias("value"))


DETECT_SQL = f"""
WITH det AS (SELECT source, doc_id,
  TRY_CAST(NULLIF(regexp_extract(replace(replace(trim(translate(text, '{AR_DIGITS}', '{ASCII_DIGITS}')), ' ', ''), ',', '.'),
       '[-+]?\\d*\\.?\\d+', 0), '') AS DOUBLE) AS value,
  1e0 - (n_chars % 1000) / 1000e0 AS confidence FROM documents)
, ok AS (SELECT * FROM det WHERE value IS NOT NULL AND confidence > 0)
SELECT source, arg_max(value, (confidence, -doc_id)) AS value, max(confidence) AS confidence,
       CASE WHEN max(confidence) < 7e-1 THEN 'Please verify' END AS warning
FROM ok GROUP BY source
"""


@register("best_detection", DETECT_SQL, ids=("F24", "P12"))
def best_detection_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source ('image'), the detected number with the highest confidence; first on ties."""
    d = Tables(spark, sf_dir).documents
    det = d.select("source", "doc_id", TX.ocr_number("text").alias("value"),
                   (F.lit(1.0) - (F.col("n_chars") % 1000) / 1000.0).alias("confidence"))
    return TX.best_detection(det, "source", "value", "confidence", "doc_id")


def _prediction_records(t: Tables) -> DataFrame:
    f = fleet_scored(t)
    return SC.prediction_records(f, F.col("p"), keep=KEYS[1:])


@register("diagnostic_report", None, ids=("R1", "M20", "F28", "P18"))
def diagnostic_report_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """French diagnostic report lines of each machine's latest prediction (key, line_no, line).

    Checked line by line against a stored report of the reference in the unit tests."""
    f = fleet_scored(Tables(spark, sf_dir))
    order = F.struct(*[F.col(c) for c in ["ts", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]])
    last = f.groupBy("machine_id").agg(F.max_by(F.struct(*[c for c in f.columns if c != "machine_id"]), order)
                                       .alias("r")).select("machine_id", "r.*")
    pred = SC.prediction_records(last, F.col("p"))
    lines = RP.diagnostic_report_lines(pred, stamp="timestamp")
    return RP.explode_lines(pred, lines, ["machine_id"])


SCHED_SQL = with_views(SENSOR) + f"""
, r AS (SELECT CASE WHEN p >= 8e-1 THEN 'CRITIQUE' WHEN p >= 6e-1 THEN 'URGENT' WHEN p >= 4e-1 THEN 'ATTENTION'
                    WHEN p >= 2e-1 THEN 'SURVEILLER' ELSE 'NORMAL' END AS risk_level
        FROM (SELECT {FLEET_PROB} AS p FROM sensor))
, s AS (SELECT * FROM (VALUES {', '.join(f"('{lv}', {i + 1}, '{_q(line)}')" for lv, lines in fv.MAINTENANCE_SCHEDULES.items() for i, line in enumerate(lines))}) v(risk_level, line_no, line))
SELECT r.risk_level, s.line_no, s.line, count(*) AS readings FROM r JOIN s ON r.risk_level = s.risk_level GROUP BY ALL
"""


@register("maintenance_schedule", SCHED_SQL, ids=("R2",))
def maintenance_schedule_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schedule lines by risk level, with the number of readings that receive them."""
    f = fleet_scored(Tables(spark, sf_dir)).select("risk_level")
    e = f.select("risk_level", F.posexplode(RP.schedule_lines(f)).alias("line_no", "line"))
    return e.groupBy("risk_level", (F.col("line_no") + 1).alias("line_no"), "line") \
        .agg(F.count(F.lit(1)).alias("readings"))


REPORT_FILES_SQL = with_views(SENSOR) + f"""
, r AS (SELECT machine_id, arg_max(CASE WHEN p >= 8e-1 THEN 'CRITIQUE' WHEN p >= 6e-1 THEN 'URGENT' WHEN p >= 4e-1 THEN 'ATTENTION'
                    WHEN p >= 2e-1 THEN 'SURVEILLER' ELSE 'NORMAL' END, (ts, l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS risk_level
        FROM (SELECT *, {FLEET_PROB} AS p FROM sensor) GROUP BY machine_id)
, s AS (SELECT * FROM (VALUES {', '.join(f"('{lv}', {i + 1}, '{_q(line)}')" for lv, lines in fv.MAINTENANCE_SCHEDULES.items() for i, line in enumerate(lines))}) v(risk_level, line_no, line))
SELECT machine_id, count(*) AS lines, string_agg(line, '|' ORDER BY line_no) AS text FROM r JOIN s ON r.risk_level = s.risk_level GROUP BY machine_id
"""


@register("text_report_files", REPORT_FILES_SQL, ids=("S11", "R2"))
def text_report_files_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maintenance schedule of each machine's latest risk written as text files, one folder per
    machine, and read back."""
    import uuid

    from ..session import scratch_path
    from ..sources import readers as RD
    f = fleet_scored(Tables(spark, sf_dir))
    order = F.struct(*[F.col(c) for c in ["ts", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]])
    last = f.groupBy("machine_id").agg(F.max_by("risk_level", order).alias("risk_level"))
    path = scratch_path(spark, f"reports/{uuid.uuid4().hex}")
    RD.write_text_reports(last.select("machine_id", F.posexplode(RP.schedule_lines(last)).alias("line_no", "line")), path)
    # A report is one file, read whole: its lines stay in order.
    back = spark.read.text(path, wholetext=True).withColumn("value", F.rtrim("value", F.lit("\n")))
    lines = F.split("value", "\n")
    return back.select(F.col("machine_id").cast("long").alias("machine_id"), F.size(lines).cast("long").alias("lines"),
                       F.array_join(lines, "|").alias("text"))


def _alert_sql() -> str:
    def msg(lang):
        return f"""concat(chr(10), CASE WHEN p >= 8e-1 THEN '🔴' WHEN p >= 5e-1 THEN '🟡' ELSE '🟢' END,
  ' {fv.ALERT_TITLE[lang]}', chr(10), chr(10), '{fv.ALERT_MACHINE[lang]}', CAST(machine_id AS VARCHAR), chr(10),
  '{fv.ALERT_FAILURE[lang]}', modes, chr(10), '{fv.ALERT_PROB[lang]}', CAST(CAST(round_even(p * 100, 0) AS BIGINT) AS VARCHAR), '%', chr(10),
  '{fv.ALERT_REMAIN[lang]}', CAST(hours // 24 AS VARCHAR), '{fv.ALERT_DAYS[lang]}', chr(10),
  chr(10), '📅 ', strftime(ts, '%Y-%m-%d %H:%M'), chr(10), chr(10), '{fv.ALERT_CLOSING[lang]}')"""
    return with_views(SENSOR) + f"""
, f AS (SELECT *, {FLEET_PROB} AS p FROM sensor)
, g AS (SELECT *, CASE WHEN p >= 8e-1 THEN 24 WHEN p >= 6e-1 THEN 72 ELSE 120 END AS hours,
   concat_ws(',', CASE WHEN wear >= 180e0 THEN 'TWF' END,
     CASE WHEN (proc_k - air_k) < 8.6e0 AND rpm < 1380e0 THEN 'HDF' END,
     CASE WHEN torque*rpm*1.0471975511965977e-1 < 3500e0 OR torque*rpm*1.0471975511965977e-1 > 9500e0 THEN 'PWF' END,
     CASE WHEN wear*torque > 12000e0 THEN 'OSF' END) AS m0 FROM f WHERE p >= 6e-1)
, h AS (SELECT *, CASE WHEN m0 = '' THEN '—' ELSE m0 END AS modes FROM g)
SELECT {', '.join(KEYS)}, {msg('fr')} AS message_fr, {msg('ar')} AS message_ar FROM h
"""


@register("alert_messages", _alert_sql(), ids=("R3", "F21", "F29"))
def alert_messages_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """French and Arabic alert texts for every URGENT-or-worse reading."""
    f = fleet_scored(Tables(spark, sf_dir)).filter(F.col("p") >= 0.6)
    hours = R.days_to_failure_4(F.col("p") * 100) * 24
    modes = F.array_join(R.likely_failure_modes(), ",")
    return f.select(*KEYS, *[TX.alert_message("machine_id", modes, F.col("p"), hours, "ts", lang).alias(f"message_{lang}")
                             for lang in ("fr", "ar")])


SUMMARY_SQL = with_views(SENSOR) + f"""
, f AS (SELECT *, {FLEET_PROB} AS p FROM sensor)
, per AS (SELECT CAST(ts AS DATE) AS day, machine_id, max(p) AS p FROM f GROUP BY ALL)
, d AS (SELECT day, count(*) FILTER (WHERE p >= 6e-1) AS at_risk, count(*) FILTER (WHERE p >= 8e-1) AS critical FROM per GROUP BY day)
SELECT day, concat(chr(10), '{fv.SUMMARY_TITLE['fr']}', chr(10), chr(10), '📅 ', strftime(day, '%Y-%m-%d'), chr(10), chr(10),
  '{fv.SUMMARY_CRITICAL['fr']}', CAST(critical AS VARCHAR), chr(10), '{fv.SUMMARY_AT_RISK['fr']}', CAST(at_risk AS VARCHAR),
  chr(10), chr(10), '{fv.SUMMARY_CLOSING['fr']}', chr(10)) AS message_fr
FROM d
"""


@register("daily_summary", SUMMARY_SQL, ids=("R4", "A26"))
def daily_summary_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily summary message: critical alerts and machines at risk per day."""
    d = ST.fleet_by_day(fleet_scored(Tables(spark, sf_dir)), "machine_id", "ts")
    return d.select("day", TX.daily_summary_message("day", "machines_at_risk", "critical_count", "fr")
                    .alias("message_fr"))


FLEET_SUMMARY_SQL = with_views(SENSOR) + f"""
, f AS (SELECT *, {FLEET_PROB} AS p FROM sensor)
, last AS (SELECT machine_id, arg_max(p, (ts, l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS p,
                  arg_max(wear, (ts, l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS wear,
                  arg_max(air_k, (ts, l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS air_k,
                  arg_max(proc_k, (ts, l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS proc_k,
                  arg_max(rpm, (ts, l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS rpm,
                  arg_max(torque, (ts, l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS torque FROM f GROUP BY machine_id)
, r AS (SELECT *, CASE WHEN p >= 8e-1 THEN 'CRITIQUE' WHEN p >= 6e-1 THEN 'URGENT' WHEN p >= 4e-1 THEN 'ATTENTION'
                    WHEN p >= 2e-1 THEN 'SURVEILLER' ELSE 'NORMAL' END AS risk,
   concat_ws(', ', CASE WHEN wear >= 180e0 THEN 'TWF' END,
     CASE WHEN (proc_k - air_k) < 8.6e0 AND rpm < 1380e0 THEN 'HDF' END,
     CASE WHEN torque*rpm*1.0471975511965977e-1 < 3500e0 OR torque*rpm*1.0471975511965977e-1 > 9500e0 THEN 'PWF' END,
     CASE WHEN wear*torque > 12000e0 THEN 'OSF' END) AS m0 FROM last)
SELECT machine_id AS "Machine", round(p * 100, 2) AS "Probabilité (%)", risk AS "Risque",
  CASE risk WHEN 'CRITIQUE' THEN '1–3 jours' WHEN 'URGENT' THEN '3–7 jours' WHEN 'ATTENTION' THEN '7–14 jours'
            WHEN 'SURVEILLER' THEN '14–30 jours' ELSE '> 30 jours' END AS "Délai",
  CASE WHEN m0 = '' THEN '—' ELSE m0 END AS "Modes"
FROM r
"""


@register("fleet_summary", FLEET_SUMMARY_SQL, ids=("R5", "W20", "A25"))
def fleet_summary_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest prediction per machine as the fleet table with dashboard column names."""
    t = Tables(spark, sf_dir)
    f = fleet_scored(t)
    order = F.struct(*[F.col(c) for c in ["ts", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]])
    last = f.groupBy("machine_id").agg(*[F.max_by(c, order).alias(c) for c in
                                         ["p", "wear", "air_k", "proc_k", "rpm", "torque", "ts"]])
    pred = SC.prediction_records(last, F.col("p"))
    return RP.fleet_summary(pred)


REC_SQL = with_views(SENSOR) + f"""
, r AS (SELECT CASE WHEN p >= 8e-1 THEN 'CRITICAL' WHEN p >= 6e-1 THEN 'HIGH' WHEN p >= 4e-1 THEN 'MEDIUM' ELSE 'LOW' END AS risk_en
        FROM (SELECT {FLEET_PROB} AS p FROM sensor))
, t AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {len(v.splitlines())}, '{v.splitlines()[0]}')" for k, v in fv.RECOMMENDATIONS_EN.items())}) v(risk_en, n_lines, head))
SELECT r.risk_en, count(*) AS readings, max(n_lines) AS n_lines, max(head) AS head FROM r JOIN t ON r.risk_en = t.risk_en GROUP BY r.risk_en
"""


@register("recommendations_en", REC_SQL, ids=("R6", "F15"))
def recommendations_en_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English recommendation per 4-level risk, counted over all readings."""
    f = fleet_scored(Tables(spark, sf_dir)).select(R.risk_level_en4("p").alias("risk_en"))
    rec = RP.recommendation_en(F.col("risk_en"))
    return f.select("risk_en", rec.alias("rec")).groupBy("risk_en").agg(
        F.count(F.lit(1)).alias("readings"), F.max(F.size(F.split("rec", "\n"))).alias("n_lines"),
        F.max(F.element_at(F.split("rec", "\n"), 1)).alias("head"))


MEANS_SQL_COLS = ["Power_W", "Wear_Torque", "wear"]
SUMMARY_FIELDS_SQL = with_views(SENSOR) + """
, b AS (SELECT *, torque*rpm*1.0471975511965977e-1 AS Power_W, wear*torque AS Wear_Torque FROM sensor)
, mu AS (SELECT avg(Power_W) AS m1, avg(Wear_Torque) AS m2, avg(wear) AS m3 FROM b)
, last AS (SELECT machine_id, arg_max(Power_W, (ts, l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS Power_W,
             arg_max(Wear_Torque, (ts, l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS Wear_Torque,
             arg_max(wear, (ts, l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS wear,
             arg_max(torque, (ts, l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS torque,
             arg_max(rpm, (ts, l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS rpm FROM b GROUP BY machine_id)
, imp AS (SELECT last.*, abs(2e-4 * (Power_W - m1)) AS i1, abs(3.5e-4 * (Wear_Torque - m2)) AS i2, abs(1e-2 * (wear - m3)) AS i3 FROM last, mu)
SELECT machine_id, round(torque, 6) AS last_torque, round(rpm, 6) AS last_rpm, round(wear, 6) AS last_wear,
  CASE WHEN i1 >= i2 AND i1 >= i3 THEN 'Power_W' WHEN i2 >= i3 THEN 'Wear_Torque' ELSE 'wear' END AS top_cause,
  round(greatest(i1, i2, i3), 6) AS top_importance,
  (SELECT string_agg(f, ',' ORDER BY i DESC, o)
   FROM (VALUES ('Power_W', i1, 1), ('Wear_Torque', i2, 2), ('wear', i3, 3)) v(f, i, o)) AS causes
FROM imp
"""


@register("prediction_summary", SUMMARY_FIELDS_SQL, ids=("R7", "M15", "W19"))
def prediction_summary_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per machine: last sensor values, the top root cause and all (at most five) causes of the latest reading."""
    from ..models.explain import root_causes
    f = fleet_scored(Tables(spark, sf_dir))
    means = f.agg(*[F.avg(c).alias(c) for c in R.FLEET_COEFS]).first().asDict()
    order = F.struct(*[F.col(c) for c in ["ts", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]])
    last = f.groupBy("machine_id").agg(*[F.max_by(c, order).alias(c) for c in ["Power_W", "Wear_Torque", "wear",
                                                                             "torque", "rpm"]])
    rc = root_causes(last, R.FLEET_COEFS, means, k=5)
    top = F.element_at("root_causes", 1)
    return rc.select("machine_id", round6(F.col("torque")).alias("last_torque"), round6(F.col("rpm")).alias("last_rpm"),
                     round6(F.col("wear")).alias("last_wear"), top["feature"].alias("top_cause"),
                     round6(top["importance"]).alias("top_importance"),
                     F.array_join("root_causes.feature", ",").alias("causes"))


PAIR_BASE = ph.FEATURE_COLUMNS[:10]


#: The base features over the sensor view, in DuckDB SQL.
PAIR_SQL = {
    "Air_temperature__K": "air_k", "Process_temperature__K": "proc_k", "Rotational_speed__rpm": "rpm",
    "Torque__Nm": "torque", "Tool_wear__min": "wear",
    "Type_enc": "CAST(CASE mtype WHEN 'L' THEN 0 WHEN 'M' THEN 1 ELSE 2 END AS DOUBLE)",
    "Power_W": "(torque*rpm*1.0471975511965977e-1)", "Temp_Diff_K": "(proc_k - air_k)",
    "Wear_Torque": "(wear*torque)", "Mechanical_Stress": "(torque / greatest(rpm, 1e0))"}


def _pairs_sql() -> str:
    sel = [f"round({PAIR_SQL[a]} * {PAIR_SQL[b]}, 6) AS \"{a}_x_{b}\"" for a, b in combinations(PAIR_BASE, 2)]
    return with_views(SENSOR) + f"SELECT {', '.join(KEYS)}, {', '.join(sel)} FROM sensor"


@register("interactions", _pairs_sql(), ids=("F10",))
def interactions_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairwise products of the first 10 feature columns (45 pairs), one projection."""
    s = Tables(spark, sf_dir).sensor.withColumn("type_enc", F.when(F.col("mtype") == "L", 0)
                                                 .when(F.col("mtype") == "M", 1).otherwise(2))
    feats = ph.physics_features(s, 0.0, keep=KEYS).select(*KEYS, *PAIR_BASE)
    from ..operators.preprocess import interactions
    out = interactions(feats, PAIR_BASE)
    return out.select(*KEYS, *[round6(F.col(c)).alias(c) for c in out.columns if "_x_" in c])


SCALE_COLS = ["air_k", "proc_k", "rpm", "torque", "wear"]


def _scaling_sql() -> str:
    stats = ", ".join(f"avg({c}) AS {c}_mu, stddev_pop({c}) AS {c}_sd, min({c}) AS {c}_lo, max({c}) AS {c}_hi, "
                      f"quantile_cont({c}, 0.5) AS {c}_med, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS {c}_iqr"
                      for c in SCALE_COLS)
    sel = []
    for c in SCALE_COLS:
        sel += [f"round(({c} - {c}_mu) / CASE WHEN {c}_sd = 0 THEN 1e0 ELSE {c}_sd END, 6) AS {c}_std",
                f"round(({c} - {c}_lo) / CASE WHEN {c}_hi - {c}_lo = 0 THEN 1e0 ELSE {c}_hi - {c}_lo END, 6) AS {c}_minmax",
                f"round(({c} - {c}_med) / CASE WHEN {c}_iqr = 0 THEN 1e0 ELSE {c}_iqr END, 6) AS {c}_robust"]
    return with_views(SENSOR) + f""", p AS (SELECT {stats} FROM sensor WHERE l_linestatus = 'F')
SELECT {', '.join(KEYS)}, {', '.join(sel)} FROM sensor, p"""


@register("scaling", _scaling_sql(), ids=("F11", "A9", "D9"))
def scaling_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard (population std), min-max and robust scaling fitted on 'F' rows, applied to all;
    a zero scale becomes 1."""
    from ..operators.preprocess import fit_scalers, apply_scalers
    s = Tables(spark, sf_dir).sensor
    params = fit_scalers(s.filter(F.col("l_linestatus") == "F"), SCALE_COLS)
    out = apply_scalers(s, params, SCALE_COLS)
    return out.select(*KEYS, *[round6(F.col(f"{c}_{k}")).alias(f"{c}_{k}")
                               for c in SCALE_COLS for k in ("std", "minmax", "robust")])


ENSEMBLE_SQL = with_views(SENSOR) + f"""
, sc AS (SELECT machine_id, l_orderkey, l_linenumber, l_partkey, l_extendedprice, {FLEET_PROB} AS p_lin,
           1e0/(1e0+exp(-(-6e0 + 3e-4*(wear*torque) + 1e-2*wear))) AS p_wear,
           CASE WHEN concat_ws(',', CASE WHEN wear >= 180e0 THEN 'TWF' END,
             CASE WHEN (proc_k - air_k) < 8.6e0 AND rpm < 1380e0 THEN 'HDF' END,
             CASE WHEN torque*rpm*1.0471975511965977e-1 < 3500e0 OR torque*rpm*1.0471975511965977e-1 > 9500e0 THEN 'PWF' END,
             CASE WHEN wear*torque > 12000e0 THEN 'OSF' END) <> '' THEN 1e0 ELSE 0e0 END AS p_rule FROM sensor)
SELECT machine_id, l_orderkey, l_linenumber, l_partkey, l_extendedprice,
  round((1e0 * p_rule + 2e0 * p_lin + 2e0 * p_wear) / 5e0, 6) AS p_ensemble,
  round((1e0 * p_rule + 3e0 * p_lin + 2e0 * p_wear) / 6e0, 6) AS p_ensemble_retry,
  CASE WHEN p_rule = 1e0 THEN 100e0 ELSE 0e0 END AS p_label_only
FROM sc
"""


@register("ensemble_scores", ENSEMBLE_SQL, ids=("F20", "M22"))
def ensemble_scores_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted mean of three scorers (1:2:2 and retry 1:3:2); label-only model as 0/100."""
    f = fleet_scored(Tables(spark, sf_dir))
    p_wear = R.sigmoid(R.linear_logit({"Wear_Torque": 3e-4, "wear": 1e-2}, -6.0))
    p_rule = F.when(F.size(R.likely_failure_modes(empty_marker=False)) > 0, 1.0).otherwise(0.0)
    probs = {"rf": p_rule, "xgb": F.col("p"), "lgb": p_wear}
    return f.select(*KEYS,
                    round6(R.weighted_mean(probs, fv.ENSEMBLE_WEIGHTS)).alias("p_ensemble"),
                    round6(R.weighted_mean(probs, fv.ENSEMBLE_WEIGHTS_RETRY)).alias("p_ensemble_retry"),
                    R.prediction_label_probability(p_rule.cast("int")).alias("p_label_only"))


AI4I_LABELS = {"air_k": "Air temperature [K]", "proc_k": "Process temperature [K]", "rpm": "Rotational speed [rpm]",
               "torque": "Torque [Nm]", "wear": "Tool wear [min]"}
SANITIZE_SQL = with_views(SENSOR) + "SELECT " + ", ".join(
    [f"{k}" for k in KEYS] + [f"{c} AS {ph.sanitize_name(lbl)}" for c, lbl in AI4I_LABELS.items()]) + \
    ", CASE mtype WHEN 'H' THEN 0 WHEN 'L' THEN 1 ELSE 2 END AS Type_alpha" + \
    ", CAST(mtype = 'L' AS INTEGER) AS Type_L, CAST(mtype = 'M' AS INTEGER) AS Type_M FROM sensor"


@register("encode_and_sanitize", SANITIZE_SQL, ids=("P4", "P16", "P17"))
def encode_and_sanitize_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AI4I column labels sanitised, alphabetical label code, one-hot with the first level dropped."""
    from ..operators.preprocess import alphabetical_codes, one_hot_drop_first
    s = Tables(spark, sf_dir).sensor
    raw = s.select(*KEYS, "mtype", *[F.col(c).alias(lbl) for c, lbl in AI4I_LABELS.items()])
    clean = ph.sanitize_columns(raw)
    coded = alphabetical_codes(clean, "mtype", "Type_alpha")
    onehot = one_hot_drop_first(coded, "mtype", "Type")
    return onehot.drop("mtype")


ADMIT_SQL = """
SELECT event_id, CASE WHEN user_id IS NULL THEN 'missing machine' WHEN value IS NULL THEN 'missing value'
  WHEN value = 0 THEN 'zero value' END AS reason,
  user_id IS NOT NULL AND value IS NOT NULL AND value <> 0 AS admissible
FROM events
"""


@register("reading_admissibility", ADMIT_SQL, ids=("P13", "P11"))
def reading_admissibility_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual-reading admissibility: machine id present, value present and not 0."""
    from ..operators.preprocess import admissibility
    ev = Tables(spark, sf_dir).events
    return admissibility(ev, "user_id", "value").select("event_id", "reason", "admissible")


def _profile_sql() -> str:
    parts = []
    for t in TABLES:
        parts.append(f"SELECT '{t}' AS \"table\", count(*) AS rows, "
                     f"CAST((SELECT count(*) FROM (DESCRIBE {t})) AS INTEGER) AS columns, "
                     f"(SELECT count(*) > 0 FROM (DESCRIBE {t}) WHERE lower(column_name) IN ('failure', 'target', 'label')) AS has_target FROM {t}")
    return " UNION ALL ".join(parts)


@register("dataset_profile", _profile_sql(), ids=("S13", "S3"))
def dataset_profile_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, columns and has-target for every input table, as one union."""
    t = Tables(spark, sf_dir)
    return RD.profile({name: getattr(t, name) for name in TABLES})


API_SQL = with_views(SENSOR) + f"""
, f AS (SELECT *, {FLEET_PROB} AS p FROM sensor)
SELECT {RISK_FR_SQL} AS risk_level, count(*) AS n, round(avg(round(p * 100, 2) / 100), 6) AS mean_prob,
       CAST(sum(CASE WHEN p >= 4.2e-1 THEN 1 ELSE 0 END) AS BIGINT) AS positives FROM f GROUP BY ALL
"""


@register("api_records", API_SQL, ids=("F28", "P5", "M20"))
def api_records_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API-style records (open sensor map as JSON) -> canonical sensors -> aligned features ->
    nested prediction records as JSON -> parsed back and counted per risk level."""
    from pyspark.sql.types import MapType, StringType, DoubleType as D
    s = Tables(spark, sf_dir).sensor
    as_map = s.select("machine_id", "ts", F.to_json(F.create_map(
        F.lit("AmbientTemp"), F.col("air_k") - 273.15, F.lit("MotorTemp"), F.col("proc_k") - 273.15,
        F.lit("Speed_RPM"), F.col("rpm"), F.lit("Torque_Nm"), F.col("torque"),
        F.lit("Tool wear [min]"), F.col("wear"))).alias("sensors_json"))
    parsed = as_map.withColumn("sensors", F.from_json("sensors_json", MapType(StringType(), D())))
    canon = ph.sensors_from_map(parsed, "sensors", keep=["machine_id", "ts"])
    canon = ph.apply_defaults(canon, fv.PRODUCTION_RPM_MEAN)
    feats = ph.align_features(ph.physics_features(canon, fv.PRODUCTION_RPM_MEAN, keep=["machine_id", "ts"] + ph.SENSORS),
                              ph.FEATURE_COLUMNS, keep=["machine_id", "ts"] + ph.SENSORS)
    p = R.sigmoid(R.linear_logit({"Power_W": 2e-4, "Wear_Torque": 3.5e-4, "Tool_wear__min": 1e-2}, R.FLEET_INTERCEPT))
    rec = SC.records_to_json(SC.prediction_records(feats, p))
    back = rec.select(F.from_json("json", "risk_level string, failure_probability_pct double, "
                                          "binary_prediction int").alias("r")).select("r.*")
    return back.groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"),
                                          round6(F.avg(F.col("failure_probability_pct") / 100)).alias("mean_prob"),
                                          F.sum("binary_prediction").cast("long").alias("positives"))
