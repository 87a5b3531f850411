"""Reports for every prediction and what routes them: R1, S11, P18, A8 (sketches), D3, D12, M13 (selection), M15 (trees)."""

from __future__ import annotations

import uuid
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import physics as ph
from ..functions import rules as R
from ..functions.numeric import round6, round_half_away
from ..models.explain import global_importance_causes
from ..operators import report as RP
from ..operators import scoring as SC
from ..operators import stats as ST
from ..operators.preprocess import interactions
from ..session import scratch_path
from ..sources import readers as RD
from ..sources.tables import SENSOR_ORDER, Tables
from .registry import register
from .rowwise import KEYS, MOTOR_NAMES, fleet_scored
from .sql_views import FLEET_PROB, RISK_FR, SENSOR, with_views
from .stats import SEVEN_SQL, scored_pct_raw
from .streaming_plans import scada_readings
from .text_reports import PAIR_BASE, PAIR_SQL

FLEET = f"fleet AS (SELECT *, {FLEET_PROB} AS p FROM sensor)"


# --- R1 / S11: the report as SQL --------------------------------------------------------
def _t(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _tenths(x: str) -> str:
    """One decimal, half away from zero on the shortest decimal form, as the JVM's formatter does."""
    return f"CAST(CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 18)), 1) AS DECIMAL(20, 1)) AS VARCHAR)"


def _case(of: str, table: dict[str, str], otherwise: str = "''") -> str:
    return f"CASE {of} " + " ".join(f"WHEN {_t(k)} THEN {v}" for k, v in table.items()) + f" ELSE {otherwise} END"


def report_sql(source: str, keys: str) -> str:
    """DuckDB: (keys, lines VARCHAR[]) of R1 for the rows of ``source`` (canonical sensors, ts, machine_id, p)."""
    t, nl = fv.REPORT_TEXTS, "chr(10)"
    icons = {lv: _t(icon) for _, lv, _, icon in fv.RISK_LEVELS_FR} | {"NORMAL": _t("🟢")}

    def line(*parts: str) -> str:
        return f"[concat({', '.join(parts)})]"

    def fixed(*texts: str) -> str:
        return "[" + ", ".join(map(_t, texts)) + "]"

    blocks = {}
    for mode, d in fv.FAILURE_DETAILS.items():
        blocks[mode] = fixed("", t["mode"] + d["nom"], t["cause"] + d["cause"], "", t["actions"], *["      " + a for a in d["actions"]], "",
                             fv.REPORT_VENDOR["SIEMENS"] + d["siemens_param"])
    sched = {k: fixed(*["  " + x for x in v]) for k, v in fv.MAINTENANCE_SCHEDULES.items()}
    rule, sub = fv.REPORT_RULE, fv.REPORT_SUBRULE
    parts = [
        fixed(rule, t["title"], t["system"], t["maker"].format("SIEMENS"), rule),
        line(_t(t["machine"]), "CAST(machine_id AS VARCHAR)"), line(_t(t["stamp"]), "strftime(ts, '%d/%m/%Y  %H:%M:%S')"),
        fixed(t["model"] + fv.REPORT_MODEL_NAME, "", sub, t["result"], sub),
        line(_t(t["probability"]), _tenths("round(p * 100, 2)"), _t(" %")), line(_t(t["risk"]), _case("risk", icons), _t(" "), "risk"),
        line(_t(t["delay"]), _case("risk", {k: _t(v) for k, v in fv.TTF_TEXT_FR.items()}, _t("—"))),
        line(_t(t["confidence"]), _tenths("round(abs(p - 5e-1) / 5e-1, 4) * 100"), _t(" %")), fixed(""),
        line(_t(t["meaning"]), _case("risk", {k: _t(v) for k, v in fv.RISK_DESCRIPTIONS.items()})),
        fixed("", sub, t["sensors"], sub),
        *[line(_t(t[k]), f"CAST({c} AS VARCHAR)", _t(" K  ("), _tenths(f"{c} - 273.15e0"), _t(" °C)")) for k, c in (("air", "a"), ("motor", "m"))],
        *[line(_t(t[k]), f"CAST(round({c}, 1) AS VARCHAR)", _t(unit)) for k, c, unit in (
            ("rpm", "rpm", " tr/min"), ("torque", "torque", " Nm"), ("wear", "wear", " min"), ("power", "pw", " W"))],
        line(_t(t["difference"]), _tenths("m - a"), _t(" K  "), f"CASE WHEN m - a < {fv.FEATURE_HDF_DT!r}e0 THEN {_t(t['low'])} ELSE 'OK' END"),
        fixed("", sub, t["modes"], sub),
        f"CASE WHEN NOT (twf OR hdf OR pwf OR osf) THEN {fixed(*fv.REPORT_NO_MODE)} ELSE list_concat("
        + ", ".join(f"CASE WHEN {m.lower()} THEN {blocks[m]} ELSE [] END" for m in ("TWF", "HDF", "PWF", "OSF")) + ") END",
        fixed("", sub, t["planning"], sub), _case("risk", sched, fixed("  " + fv.SCHEDULE_FALLBACK)),
        fixed("", rule, *fv.REPORT_CLOSING, rule)]
    return f"""
, rp AS (SELECT *, round(air_k, 1) AS a, round(proc_k, 1) AS m, torque*rpm*1.0471975511965977e-1 AS pw, {RISK_FR.format(p='p')} AS risk,
    wear >= {fv.DIAG_TWF_WEAR!r}e0 AS twf, (proc_k - air_k) < {fv.DIAG_HDF_DT!r}e0 AND rpm < {fv.DIAG_HDF_RPM!r}e0 AS hdf,
    torque*rpm*1.0471975511965977e-1 < {fv.DIAG_PWF_LOW!r}e0 OR torque*rpm*1.0471975511965977e-1 > {fv.DIAG_PWF_HIGH!r}e0 AS pwf,
    wear*torque > {fv.DIAG_OSF_WT!r}e0 AS osf FROM {source})
, ln AS (SELECT {keys}, list_concat({', '.join(parts)}) AS lines FROM rp)
, tx AS (SELECT {keys}, len(lines) AS n_lines, array_to_string(lines, {nl}) AS report FROM ln)"""


ALL_REPORTS_SQL = with_views(SENSOR, FLEET) + report_sql("fleet", ", ".join(KEYS)) + f"""
SELECT {', '.join(KEYS)}, CAST(n_lines AS INTEGER) AS n_lines, md5(report) AS report_md5 FROM tx"""


@register("prediction_reports", ALL_REPORTS_SQL, ids=("R1", "R2", "J2", "J3", "F28"))
def prediction_reports_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1 for every prediction: number of lines and digest of the whole report text."""
    pred = SC.prediction_records(fleet_scored(Tables(spark, sf_dir)), F.col("p"), keep=KEYS[1:])
    out = RP.report_texts(pred, KEYS, stamp="timestamp")
    return out.select(*KEYS, "n_lines", F.md5("report").alias("report_md5"))


DAILY_FILES_SQL = with_views(SENSOR, FLEET) + f"""
, worst AS (SELECT *, row_number() OVER (PARTITION BY machine_id, ts ORDER BY p DESC, {', '.join(KEYS[1:])}) AS n FROM fleet WHERE p >= 8e-1)
, one AS (SELECT * FROM worst WHERE n = 1)""" + report_sql("one", "machine_id, CAST(ts AS DATE) AS day").replace(
    "SELECT machine_id, CAST(ts AS DATE) AS day, len", "SELECT machine_id, day, len") + """
SELECT machine_id, day, CAST(n_lines AS INTEGER) AS n_lines, md5(report) AS report_md5 FROM tx"""


@register("daily_report_files", DAILY_FILES_SQL, ids=("S11", "R1"))
def daily_report_files_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A machine's report of each day with a critical prediction (its worst), a text file for each machine and
    day; read back whole."""
    f = fleet_scored(Tables(spark, sf_dir)).filter("risk_level = 'CRITIQUE'").withColumn("day", F.to_date("ts"))
    first = F.row_number().over(Window.partitionBy("machine_id", "ts").orderBy(F.desc("p"), *KEYS[1:]))
    worst = f.withColumn("_n", first).filter("_n = 1")
    pred = SC.prediction_records(worst, F.col("p"), keep=["day"])
    path = scratch_path(spark, f"reports/{uuid.uuid4().hex}")
    RD.write_report_files(RP.report_texts(pred, ["machine_id", "day"], stamp="timestamp"), path, ["machine_id", "day"])
    back = RD.read_report_files(spark, path, {"machine_id": "long", "day": "date"})
    return back.select("machine_id", "day", F.size(F.split("report", "\n")).alias("n_lines"), F.md5("report").alias("report_md5"))


# --- P18 -----------------------------------------------------------------------------------
ROUTING_SQL = with_views(SENSOR) + f"""
, sc AS (SELECT machine_id, (air_k - 273.15e0 + CASE WHEN l_linenumber = 7 THEN 500e0 ELSE 0e0 END) + 273.15e0 AS a,
           (proc_k - 273.15e0) + 273.15e0 AS pk, CASE WHEN l_partkey % 97 <> 0 THEN rpm END AS r,
           CASE WHEN l_orderkey % 101 = 0 THEN torque*5e0 ELSE torque END AS tq, (wear / 60e0)*60e0 AS w FROM sensor)
, st AS (SELECT *, a BETWEEN 270e0 AND 380e0 AND pk BETWEEN 270e0 AND 420e0 AND r BETWEEN 100e0 AND 3000e0
           AND tq BETWEEN 0e0 AND 200e0 AND w BETWEEN 0e0 AND 300e0 AS valid FROM sc)
, ro AS (SELECT *, CASE WHEN NOT coalesce(valid, false) THEN 'INPUT_VALIDATION_ERROR' WHEN 1e-1 - w / 500e0 < -3e-1 THEN 'SENSOR_ANOMALY' ELSE 'OK' END AS status,
           1e0/(1e0+exp(-(-7e0 + 2e-4*(tq*r*1.0471975511965977e-1) + 3.5e-4*(w*tq) + 1e-2*w))) AS p FROM st)
SELECT status, CASE WHEN status = 'OK' THEN {RISK_FR.format(p='p')} END AS risk_level, count(*) AS n,
  count(*) FILTER (WHERE status <> 'OK') AS skipped, CAST(sum(CASE WHEN status = 'OK' THEN CAST(p >= {fv.PRODUCTION_THRESHOLD!r}e0 AS INTEGER) END) AS BIGINT) AS positive
FROM ro GROUP BY ALL"""


@register("prediction_routing", ROUTING_SQL, ids=("P18", "P3", "P6", "M20"))
def prediction_routing_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with faults routed by status (validation error, sensor anomaly by a wear-based score, scored),
    with their bands and decisions."""
    tagged = scada_readings(Tables(spark, sf_dir).sensor)
    canonical = ph.convert_tags(tagged).withColumn("ts", F.lit(None).cast("timestamp"))
    canonical = canonical.withColumns({"Power_W": R.power_w("torque", "rpm"), "Wear_Torque": F.col("wear") * F.col("torque")})
    p = R.sigmoid(R.linear_logit(R.FLEET_COEFS, R.FLEET_INTERCEPT))
    rec = SC.prediction_records(canonical, p, anomaly_score=F.lit(0.1) - F.col("wear") / 500.0)
    return rec.groupBy("status", "risk_level").agg(F.count(F.lit(1)).alias("n"), F.count_if("skip_prediction").alias("skipped"),
                                                  F.sum("binary_prediction").alias("positive"))


# --- A8 ---------------------------------------------------------------------------------------
SKETCH_SQL = with_views(SENSOR) + """
SELECT 'products' AS measure, count(DISTINCT l_partkey) AS exact, true AS within FROM sensor
UNION ALL SELECT 'machines', count(DISTINCT machine_id), true FROM sensor
UNION ALL SELECT 'orders', count(DISTINCT l_orderkey), true FROM sensor
UNION ALL SELECT 'failing_machines', count(DISTINCT CASE WHEN label = 1 THEN machine_id END), true FROM sensor"""


@register("distinct_sketches", SKETCH_SQL, ids=("A8",))
def distinct_sketches_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct counts rolled up from one sketch a day, beside the exact ones: within four standard errors."""
    s = Tables(spark, sf_dir).sensor.withColumn("failing", F.when(F.col("label") == 1, F.col("machine_id")))
    measures = {"products": "l_partkey", "machines": "machine_id", "orders": "l_orderkey", "failing_machines": "failing"}
    path = scratch_path(spark, f"sketches/{uuid.uuid4().hex}")
    ST.daily_sketches(s, "ts", measures).write.parquet(path)
    rolled = ST.rolled_up(spark.read.parquet(path), measures)
    exact = s.agg(*[F.countDistinct(c).alias(m) for m, c in measures.items()]).unpivot([], list(measures), "measure", "exact")
    both = exact.join(rolled, "measure")
    error = F.abs(F.col("estimate") - F.col("exact")) / F.greatest(F.col("exact"), F.lit(1))
    return both.select("measure", "exact", (error <= 4 * ST.SKETCH_ERROR).alias("within"))


# --- D3 / D12 -----------------------------------------------------------------------------------
CODE_SQL = """
, g AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey % 5 AS INTEGER) END AS given,
  CASE upper(list_extract(['""" + "','".join(MOTOR_NAMES) + """'], CAST(p_partkey % 16 AS INTEGER) + 1))
""" + "\n".join(f"    WHEN '{k}' THEN {v}" for k, v in fv.MOTOR_TYPE_MAP.items()) + """
    ELSE 1 END AS by_type FROM part)
SELECT p_partkey, coalesce(given, by_type) AS given_wins, by_type AS type_wins FROM g
"""


@register("motor_code", "WITH one AS (SELECT 1)" + CODE_SQL, ids=("D3", "P15"))
def motor_code_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class code of a machine with and without a given code: the given one wins, or the machine type overwrites it."""
    p = Tables(spark, sf_dir).part
    given = F.when(F.col("p_partkey") % 3 == 0, (F.col("p_partkey") % 5).cast("int"))
    kind = F.element_at(F.array(*[F.lit(n) for n in MOTOR_NAMES]), (F.col("p_partkey") % 16).cast("int") + 1)
    return p.select("p_partkey", R.motor_code(given, kind).alias("given_wins"), R.motor_code(given, kind, given_wins=False).alias("type_wins"))


VALID_SQL = SEVEN_SQL.replace("FROM fleet)", "FROM fleet WHERE l_partkey % 40 <> 0)", 1)


@register("seven_day_window_valid", VALID_SQL, ids=("D12", "M21", "A22", "A23", "A24", "A25"))
def seven_day_window_valid_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven-day window over valid readings alone: invalid ones are left out instead of counting as 0 %."""
    sc = SC.invalid_as_normal(scored_pct_raw(spark, sf_dir), skip_invalid=True)
    return ST.seven_day_window(sc, "machine_id", SENSOR_ORDER, "pct", "risk_level")


# --- M13: the best 50 of 55 -----------------------------------------------------------------------
PAIRS = [f"{a}_x_{b}" for a, b in combinations(PAIR_BASE, 2)]


def _selection_sql() -> str:
    exprs = PAIR_SQL | {f"{a}_x_{b}": f"({PAIR_SQL[a]} * {PAIR_SQL[b]})" for a, b in combinations(PAIR_BASE, 2)}
    wide = ", ".join(f"round(CAST({e} AS DOUBLE), 6) AS {n}" for n, e in exprs.items())
    tenths = ", ".join(str(i / 10) for i in range(1, 10))
    edges = ", ".join(f"list_distinct(quantile_cont({n}, [{tenths}])) AS {n}" for n in exprs)
    parts = " UNION ALL ".join(f"SELECT '{n}' AS feature, label AS y, len(list_filter(e.{n}, lambda t: t < w.{n})) AS bin FROM wide w, edges e" for n in exprs)
    return with_views(SENSOR) + f"""
, wide AS (SELECT label, {wide} FROM sensor)
, edges AS (SELECT {edges} FROM wide)
, lg AS ({parts})
, c AS (SELECT feature, bin, y, count(*) AS n FROM lg GROUP BY ALL)
, v AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS nn, sum(n) OVER (PARTITION BY feature, bin) AS nb,
               sum(n) OVER (PARTITION BY feature, y) AS ny FROM c)
, mi AS (SELECT feature, sum((n / nn) * ln((n * nn) / (nb * ny))) AS mutual_info FROM v GROUP BY feature)
SELECT feature, round(mutual_info, 6) AS mutual_info FROM mi ORDER BY mutual_info DESC, feature LIMIT 50"""


@register("selected_features", _selection_sql(), ids=("M13", "F10"))
def selected_features_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 features of most mutual information with the label, of ten base features and their 45 products."""
    s = Tables(spark, sf_dir).sensor.withColumn("type_enc", F.when(F.col("mtype") == "L", 0).when(F.col("mtype") == "M", 1).otherwise(2))
    wide = interactions(ph.physics_features(s, 0.0, keep=["label"]).select("label", *PAIR_BASE), PAIR_BASE)
    # To six decimals: bins then don't hang on the last bit of a quotient.
    wide = wide.select("label", *[round6(F.col(c)).alias(c) for c in [*PAIR_BASE, *PAIRS]])
    m = ST.binned_mutual_information(wide, [*PAIR_BASE, *PAIRS], "label", bins=10, top=50)
    return m.select("feature", round6(F.col("mutual_info")).alias("mutual_info"))


# --- M15: the tree fallback ---------------------------------------------------------------------------
#: Stands for a tree model's importances, so that SQL can follow the choice and the values.
IMPORTANCE = {"torque": 0.31, "wear": 0.24, "rpm": 0.19, "proc_k": 0.11, "air_k": 0.09, "Power_W": 0.06}

TREE_SQL = with_views(SENSOR) + f"""
SELECT {', '.join(KEYS)}, 5 AS n_causes, 'torque,wear,rpm,proc_k,air_k' AS causes, round(torque, 6) AS first_value, round(air_k, 6) AS last_value,
  31e-2 AS first_importance FROM sensor"""


@register("tree_root_causes", TREE_SQL, ids=("M15", "W19"))
def tree_root_causes_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root causes for models without attribution: the five features of most global importance, with the row's values."""
    s = fleet_scored(Tables(spark, sf_dir))
    out = global_importance_causes(s, IMPORTANCE)
    causes = F.col("root_causes")
    return out.select(*KEYS, F.size(causes).alias("n_causes"), F.array_join(causes["feature"], ",").alias("causes"),
                      round6(causes[0]["value"]).alias("first_value"), round6(causes[4]["value"]).alias("last_value"),
                      round_half_away(causes[0]["importance"], 2).alias("first_importance"))
