"""Explicit schemas: input tables, file sources and nested outputs.

Nothing on the query path infers a schema.
"""

from pyspark.sql.types import (ArrayType, BooleanType, DoubleType, FloatType, IntegerType,
                               LongType, StringType, StructField, StructType, TimestampNTZType,
                               TimestampType)


def _s(*fields):
    return StructType([StructField(n, t, True) for n, t in fields])


INPUT = {
    "region": _s(("r_regionkey", IntegerType()), ("r_name", StringType())),
    "nation": _s(("n_nationkey", IntegerType()), ("n_name", StringType()),
                 ("n_regionkey", IntegerType())),
    "customer": _s(("c_custkey", LongType()), ("c_name", StringType()),
                   ("c_nationkey", IntegerType()), ("c_acctbal", DoubleType()),
                   ("c_mktsegment", StringType())),
    "supplier": _s(("s_suppkey", LongType()), ("s_name", StringType()),
                   ("s_nationkey", IntegerType()), ("s_acctbal", DoubleType())),
    "part": _s(("p_partkey", LongType()), ("p_name", StringType()), ("p_brand", StringType()),
               ("p_type", StringType()), ("p_size", IntegerType()),
               ("p_retailprice", DoubleType())),
    "orders": _s(("o_orderkey", LongType()), ("o_custkey", LongType()),
                 ("o_orderstatus", StringType()), ("o_totalprice", DoubleType()),
                 ("o_orderdate", TimestampNTZType()), ("o_orderpriority", StringType())),
    "lineitem": _s(("l_orderkey", LongType()), ("l_partkey", LongType()),
                   ("l_suppkey", LongType()), ("l_linenumber", IntegerType()),
                   ("l_quantity", DoubleType()), ("l_extendedprice", DoubleType()),
                   ("l_discount", DoubleType()), ("l_tax", DoubleType()),
                   ("l_returnflag", StringType()), ("l_linestatus", StringType()),
                   ("l_shipdate", TimestampNTZType())),
    "events": _s(("event_id", LongType()), ("ts", TimestampNTZType()), ("user_id", LongType()),
                 ("event_type", StringType()), ("value", DoubleType()), ("props", StringType())),
    "documents": _s(("doc_id", LongType()), ("text", StringType()), ("lang", StringType()),
                    ("source", StringType()), ("n_chars", LongType())),
    "embeddings": _s(("vec_id", LongType()), ("embedding", ArrayType(FloatType())),
                     ("label", IntegerType())),
    "pages": _s(("page_id", LongType()), ("url", StringType()), ("html", StringType())),
    "benchmark": _s(("item_id", LongType()), ("text", StringType())),
    "labels": _s(("doc_id", LongType()), ("quality", IntegerType()), ("toxic", IntegerType())),
    "conversations": _s(("conv_id", LongType()), ("turn", LongType()), ("role", StringType()),
                        ("text", StringType())),
}

# Process snapshot table (AI4I layout) as written in CSV exports
AI4I = _s(("UDI", IntegerType()), ("Product ID", StringType()), ("Type", StringType()),
          ("Air temperature [K]", DoubleType()), ("Process temperature [K]", DoubleType()),
          ("Rotational speed [rpm]", IntegerType()), ("Torque [Nm]", DoubleType()),
          ("Tool wear [min]", IntegerType()), ("Machine failure", IntegerType()),
          ("TWF", IntegerType()), ("HDF", IntegerType()), ("PWF", IntegerType()),
          ("OSF", IntegerType()), ("RNF", IntegerType()))

# Run-to-failure series: unit, cycle, 3 settings, 21 sensors
RUN_TO_FAILURE = _s(("unit_id", IntegerType()), ("time_cycles", IntegerType()),
                    *[(f"op_setting_{i}", DoubleType()) for i in range(1, 4)],
                    *[(f"sensor_{i}", DoubleType()) for i in range(1, 22)])

# SCADA tag record
SCADA = _s(("machine_id", StringType()), ("AmbientTemp", DoubleType()), ("MotorTemp", DoubleType()),
           ("Speed_RPM", DoubleType()), ("Torque_Nm", DoubleType()), ("RunHours", DoubleType()),
           ("FaultBit", BooleanType()), ("timestamp", TimestampType()))

ALARM = _s(("DateTime", StringType()), ("Instance", StringType()), ("CLASS", StringType()),
           ("TxtCame", StringType()))

READINGS_LONG = _s(("machine_id", StringType()), ("reading_type", StringType()),
                   ("value", DoubleType()), ("unit", StringType()), ("notes", StringType()),
                   ("entry_method", StringType()), ("confidence", DoubleType()),
                   ("language", StringType()), ("timestamp", StringType()),
                   ("synced", BooleanType()))

READINGS_WIDE = _s(("id", LongType()), ("timestamp", StringType()), ("shift", StringType()),
                   ("machine_id", StringType()), ("temperature", DoubleType()),
                   ("pressure", DoubleType()), ("vibration", DoubleType()), ("speed", DoubleType()),
                   ("power", DoubleType()), ("current", DoubleType()), ("notes", StringType()),
                   ("operator", StringType()), ("synced", IntegerType()))

SNAPSHOT = _s(("air_temp_K", DoubleType()), ("motor_temp_K", DoubleType()),
              ("temp_diff_K", DoubleType()), ("rpm", DoubleType()), ("torque_Nm", DoubleType()),
              ("wear_min", DoubleType()), ("power_W", DoubleType()))
