"""Lazy access to the input tables and the fixture views derived from them.

Every view is a projection over one scan: Catalyst prunes the columns a query
does not use and pushes its filters into the Parquet reader.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..fixed_values import TWO_PI_OVER_60

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]

# Total order inside one machine of the sensor view (unique at every scale).
SENSOR_ORDER = ["ts", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
TELEMETRY_ORDER = ["ts", "event_id"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = schemas.INPUT.get(name)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def power_w(torque: Column, rpm: Column) -> Column:
    return torque * rpm * F.lit(TWO_PI_OVER_60)


def sensor_view(lineitem: DataFrame) -> DataFrame:
    """Process snapshots per machine (FIXTURES A1) with the spec failure label."""
    l = lineitem
    mtype = (F.when(F.col("l_returnflag") == "R", F.lit("H"))
             .when(F.col("l_returnflag") == "A", F.lit("M"))
             .otherwise(F.lit("L")))
    air = F.lit(295.0) + F.lit(100.0) * F.col("l_discount")
    proc = F.lit(295.0) + F.lit(100.0) * F.col("l_discount") + F.lit(7.55) + F.lit(50.0) * F.col("l_tax")
    rpm = (F.lit(1200) + (F.col("l_suppkey") * 37 + F.col("l_partkey") * 11) % 700).cast("double")
    torque = F.lit(20.0) + F.col("l_quantity") * F.lit(0.8)
    wear = ((F.col("l_partkey") * 7 + F.col("l_orderkey")) % 241).cast("double")
    base = l.select(
        F.col("l_suppkey").alias("machine_id"),
        F.col("l_shipdate").alias("ts"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_linestatus",
        mtype.alias("mtype"),
        air.alias("air_k"), proc.alias("proc_k"), rpm.alias("rpm"),
        torque.alias("torque"), wear.alias("wear"),
    )
    p = power_w(F.col("torque"), F.col("rpm"))
    osf_limit = (F.when(F.col("mtype") == "L", F.lit(11000.0))
                 .when(F.col("mtype") == "M", F.lit(12000.0))
                 .otherwise(F.lit(13000.0)))
    label = (((F.col("proc_k") - F.col("air_k")) < F.lit(8.6)) & (F.col("rpm") < F.lit(1380.0))) \
        | (p < F.lit(3000.0)) | (p > F.lit(11000.0)) \
        | (F.col("wear") >= F.lit(232.0)) \
        | ((F.col("wear") * F.col("torque")) > osf_limit)
    return base.withColumn("label", label.cast("int"))


def telemetry_view(events: DataFrame) -> DataFrame:
    """Time series per machine (FIXTURES A2)."""
    return events.select(
        F.col("user_id").alias("machine_id"),
        F.col("ts"),
        F.col("event_id"),
        F.col("value").alias("x"),
        (F.col("event_type") == "error").cast("int").alias("failure"),
        F.get_json_object("props", "$.k").cast("int").alias("aux"),
    )


def alarm_view(events: DataFrame) -> DataFrame:
    """Alarm log rows (FIXTURES A3): CLASS from the event type, time as text."""
    cls = (F.when(F.col("event_type") == "error", F.lit("ALMTD"))
           .when(F.col("event_type") == "signup", F.lit("CRASD"))
           .when(F.col("event_type") == "purchase", F.lit("CRPRD"))
           .otherwise(F.lit("INFO")))
    return events.select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("DateTime"),
        F.col("user_id").cast("string").alias("Instance"),
        cls.alias("CLASS"),
        F.col("event_type").alias("TxtCame"),
        F.col("event_id"),
        F.col("ts").alias("event_ts"),
    )


def machine_view(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    """Machine registry (FIXTURES A3): one row per supplier; nation is a 25-row dimension."""
    return supplier.join(F.broadcast(nation.select("n_nationkey", "n_name")),
                         supplier.s_nationkey == nation.n_nationkey, "left") \
        .select(F.col("s_suppkey").alias("machine_id"),
                F.col("n_name").alias("location"),
                (F.col("s_acctbal") > 0).alias("active"))


class Tables:
    """Named lazy tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return read_table(self.spark, self.sf_dir, name)
        raise AttributeError(name)

    @cached_property
    def sensor(self) -> DataFrame:
        return sensor_view(self.lineitem)

    @cached_property
    def telemetry(self) -> DataFrame:
        return telemetry_view(self.events)

    @cached_property
    def alarm(self) -> DataFrame:
        return alarm_view(self.events)

    @cached_property
    def machine(self) -> DataFrame:
        return machine_view(self.supplier, self.nation)
