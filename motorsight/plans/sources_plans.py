"""File sources and sinks (S1, S2, S4, S5, S6, S9, S10): each query writes a
table derived from the given data into the shared scratch folder with a sink,
reads it back with the matching source (explicit schema) and aggregates it.
The oracle computes the same aggregate on the original table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.numeric import round6
from ..session import scratch_path
from ..sources import readers as RD
from ..sources.tables import Tables
from .registry import register
from .rowwise import KEYS
from .sql_views import RISK_FR, SENSOR, with_views

RISK_FR_SQL = RISK_FR.format(p='p')


def _scratch(spark, name: str) -> str:
    return scratch_path(spark, f"io/{name}-{uuid.uuid4().hex}")


CSV_SQL = with_views(SENSOR) + """
SELECT mtype, count(*) AS n, round(sum(torque), 6) AS torque_sum, round(sum(air_k), 6) AS air_sum,
       CAST(sum(label) AS BIGINT) AS failures
FROM sensor GROUP BY mtype
"""


@register("csv_roundtrip", CSV_SQL, ids=("S1", "S9", "S3"))
def csv_roundtrip_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensor table -> CSV with header, partitioned by type -> CSV scan with schema."""
    s = Tables(spark, sf_dir).sensor.select(*KEYS, "mtype", "air_k", "torque", "label")
    path = _scratch(spark, "csv")
    RD.write_table(s, path, "csv", partition_by=["mtype"])
    schema = "machine_id bigint, l_orderkey bigint, l_linenumber int, l_partkey bigint, l_extendedprice double, " \
             "air_k double, torque double, label int, mtype string"
    from pyspark.sql.types import _parse_datatype_string
    back = RD.read_table(spark, path, _parse_datatype_string(schema), "csv")
    return back.groupBy("mtype").agg(F.count(F.lit(1)).alias("n"), round6(F.sum("torque")).alias("torque_sum"),
                                     round6(F.sum("air_k")).alias("air_sum"),
                                     F.sum("label").cast("long").alias("failures"))


RTF_SQL = """
SELECT l_suppkey AS unit_id, count(*) AS cycles, round(sum(l_quantity), 6) AS s1, round(sum(l_discount), 6) AS s2,
       round(max(l_tax), 6) AS s21
FROM lineitem GROUP BY l_suppkey
"""


@register("run_to_failure_scan", RTF_SQL, ids=("S2", "D1"))
def run_to_failure_scan_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headerless blank-separated text with two trailing blanks per line -> 26 named columns."""
    li = Tables(spark, sf_dir).lineitem
    sensors = [F.col("l_quantity"), F.col("l_discount")] + [F.lit(0.0)] * 18 + [F.col("l_tax")]
    line = F.concat_ws(" ", F.col("l_suppkey").cast("string"), F.col("l_linenumber").cast("string"),
                       *[F.lit("1.0")] * 3, *[c.cast("string") for c in sensors])
    path = _scratch(spark, "rtf")
    li.select(F.concat(line, F.lit("  ")).alias("value")).write.mode("overwrite").text(path)
    back = RD.read_run_to_failure(spark, path)
    return back.groupBy("unit_id").agg(F.count(F.lit(1)).alias("cycles"),
                                       round6(F.sum("sensor_1")).alias("s1"), round6(F.sum("sensor_2")).alias("s2"),
                                       round6(F.max("sensor_21")).alias("s21")) \
        .withColumn("unit_id", F.col("unit_id").cast("long"))


ALARM_SQL = """
SELECT CASE event_type WHEN 'error' THEN 'ALMTD' WHEN 'signup' THEN 'CRASD' WHEN 'purchase' THEN 'CRPRD' ELSE 'INFO' END
       AS "CLASS", count(*) AS n, count(*) FILTER (WHERE event_type IN ('error', 'signup', 'purchase')) AS labelled
FROM events GROUP BY ALL
"""


@register("alarm_log_scan", ALARM_SQL, ids=("S5", "P10", "D18"))
def alarm_log_scan_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alarm logs written with ';' and with ',' are both read (separator from the header);
    counts per class from the ';' file, checked equal to the ',' file."""
    al = Tables(spark, sf_dir).alarm.select("DateTime", "Instance", "CLASS", "TxtCame")
    semi, comma = _scratch(spark, "alarm_semi"), _scratch(spark, "alarm_comma")
    al.write.mode("overwrite").option("header", True).option("sep", ";").csv(semi)
    al.write.mode("overwrite").option("header", True).option("sep", ",").csv(comma)
    a = RD.read_alarm_log(spark, semi)
    b = RD.read_alarm_log(spark, comma)
    labelled = RD.fault_labels(a)
    ca = a.groupBy("CLASS").agg(F.count(F.lit(1)).alias("n"))
    cb = b.groupBy("CLASS").agg(F.count(F.lit(1)).alias("n_comma"))
    cl = labelled.groupBy("CLASS").agg(F.count(F.lit(1)).alias("labelled"))
    out = ca.join(cb, "CLASS").join(cl, "CLASS", "left").fillna(0, ["labelled"])
    return out.filter(F.col("n") == F.col("n_comma")).select("CLASS", "n", "labelled")


JSON_SQL = """
SELECT CAST(ts AS DATE) AS reading_date, event_type AS reading_type, count(*) AS n, round(sum(value), 6) AS total
FROM events GROUP BY ALL
"""


@register("json_readings_scan", JSON_SQL, ids=("S6", "S10", "U2"))
def json_readings_scan_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long readings -> JSON sink partitioned by day -> JSON scan with the readings schema."""
    ev = Tables(spark, sf_dir).events
    rows = ev.select(F.col("user_id").cast("string").alias("machine_id"), F.col("event_type").alias("reading_type"),
                     "value", F.lit("unit").alias("unit"), F.lit(None).cast("string").alias("notes"),
                     F.lit("manual").alias("entry_method"), F.lit(1.0).alias("confidence"),
                     F.lit("fr").alias("language"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
                     F.lit(False).alias("synced"), F.to_date("ts").alias("day"))
    path = _scratch(spark, "json")
    RD.write_table(rows, path, "json", partition_by=["day"])
    back = RD.read_json_readings(spark, path, multi_line=False)
    back = back.withColumn("reading_date", F.to_date(F.substring("timestamp", 1, 10)))
    return back.groupBy("reading_date", "reading_type").agg(F.count(F.lit(1)).alias("n"),
                                                            round6(F.sum("value")).alias("total"))


BRONZE_SQL = """SELECT count(*) AS n, round(sum(o_totalprice), 6) AS total FROM orders"""


@register("bronze_cache", BRONZE_SQL, ids=("S4",))
def bronze_cache_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw CSV -> bronze Parquet copy written once; the second read uses the copy."""
    o = Tables(spark, sf_dir).orders
    raw = _scratch(spark, "raw_orders")
    o.write.mode("overwrite").option("header", True).csv(raw)
    bronze = _scratch(spark, "bronze_orders")
    RD.cached_source(spark, raw, bronze, schemas.INPUT["orders"])          # writes the copy
    second = RD.cached_source(spark, raw + "_missing", bronze, schemas.INPUT["orders"])  # raw gone: copy serves
    return second.agg(F.count(F.lit(1)).alias("n"), round6(F.sum("o_totalprice")).alias("total"))


SCADA_SQL = with_views(SENSOR) + f"""
, sc AS (SELECT machine_id, (air_k - 273.15e0) + 273.15e0 AS a, (proc_k - 273.15e0) + 273.15e0 AS pk,
                rpm, torque, (wear / 60e0) * 60e0 AS w FROM sensor)
, p AS (SELECT 1e0/(1e0+exp(-(-7e0 + 2e-4*(torque*rpm*1.0471975511965977e-1) + 3.5e-4*(w*torque) + 1e-2*w))) AS p FROM sc)
SELECT {RISK_FR_SQL} AS risk_level, count(*) AS n, round(avg(p), 6) AS mean_prob FROM p GROUP BY ALL
"""


@register("scada_export_scoring", SCADA_SQL, ids=("S7", "P3", "M20"))
def scada_export_scoring_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCADA CSV export (degrees C, run hours) -> schema scan -> tag conversion -> scores."""
    from ..functions import physics as ph
    from ..functions import rules as R
    s = Tables(spark, sf_dir).sensor
    scada = s.select(F.col("machine_id").cast("string").alias("machine_id"),
                     (F.col("air_k") - 273.15).alias("AmbientTemp"), (F.col("proc_k") - 273.15).alias("MotorTemp"),
                     F.col("rpm").alias("Speed_RPM"), F.col("torque").alias("Torque_Nm"),
                     (F.col("wear") / 60.0).alias("RunHours"), F.lit(False).alias("FaultBit"),
                     F.col("ts").cast("timestamp").alias("timestamp"))
    path = _scratch(spark, "scada")
    RD.write_table(scada, path, "csv")
    back = RD.read_table(spark, path, schemas.SCADA, "csv")
    conv = ph.convert_tags(back)
    wt = F.col("wear") * F.col("torque")
    p = R.sigmoid(F.lit(R.FLEET_INTERCEPT) + F.lit(2e-4) * R.power_w("torque", "rpm") + F.lit(3.5e-4) * wt
                  + F.lit(1e-2) * F.col("wear"))
    sc = conv.select(p.alias("p"))
    return sc.groupBy(R.risk_level_fr("p").alias("risk_level")).agg(F.count(F.lit(1)).alias("n"),
                                                                    round6(F.avg("p")).alias("mean_prob"))


SUBSET_SQL = with_views(SENSOR) + """
, mach AS (SELECT s_suppkey AS machine_id FROM supplier JOIN nation ON s_nationkey = n_nationkey
           WHERE n_name IN ('NATION_6', 'NATION_9', 'NATION_11'))
SELECT machine_id, count(*) AS failure_points, min(ts) AS first_failure
FROM sensor WHERE label = 1 AND machine_id IN (SELECT machine_id FROM mach) GROUP BY machine_id
"""


@register("machine_subset_failures", SUBSET_SQL, ids=("P19",))
def machine_subset_failures_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failure-point rows of a machine subset (machines located in three countries)."""
    t = Tables(spark, sf_dir)
    mach = t.machine.filter(F.col("location").isin("NATION_6", "NATION_9", "NATION_11")).select("machine_id")
    fails = t.sensor.filter(F.col("label") == 1).join(mach, "machine_id", "left_semi")
    return fails.groupBy("machine_id").agg(F.count(F.lit(1)).alias("failure_points"),
                                           F.min("ts").alias("first_failure"))
