"""The fixture views in DuckDB SQL, for the oracle queries.

Decimals are written as doubles (``2e-1``) so both engines use the same type
and the same order of operations as the Spark expressions.
"""

SENSOR = """sensor AS (
  SELECT machine_id, ts, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_linestatus,
         mtype, air_k, proc_k, rpm, torque, wear,
         CAST(((proc_k - air_k) < 8.6e0 AND rpm < 1380e0)
              OR (torque*rpm*1.0471975511965977e-1) < 3000e0
              OR (torque*rpm*1.0471975511965977e-1) > 11000e0
              OR wear >= 232e0
              OR (wear*torque) > (CASE mtype WHEN 'L' THEN 11000e0 WHEN 'M' THEN 12000e0 ELSE 13000e0 END)
              AS INTEGER) AS label
  FROM (
    SELECT l_suppkey AS machine_id, l_shipdate AS ts, l_orderkey, l_linenumber, l_partkey,
           l_extendedprice, l_linestatus,
           CASE WHEN l_returnflag = 'R' THEN 'H' WHEN l_returnflag = 'A' THEN 'M' ELSE 'L' END AS mtype,
           295e0 + 100e0*l_discount AS air_k,
           295e0 + 100e0*l_discount + 7.55e0 + 50e0*l_tax AS proc_k,
           CAST(1200 + (l_suppkey*37 + l_partkey*11) % 700 AS DOUBLE) AS rpm,
           20e0 + l_quantity*8e-1 AS torque,
           CAST((l_partkey*7 + l_orderkey) % 241 AS DOUBLE) AS wear
    FROM lineitem) s0
)"""

TELEMETRY = """telemetry AS (
  SELECT user_id AS machine_id, ts, event_id, value AS x,
         CAST(event_type = 'error' AS INTEGER) AS failure,
         TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS aux
  FROM events
)"""

# Physics features over the sensor view, parameter {rpm_mean} (F1-F8).
PHYS_SELECT = """
  torque*rpm*1.0471975511965977e-1 AS Power_W,
  proc_k - air_k AS Temp_Diff_K,
  wear*torque AS Wear_Torque,
  torque / greatest(rpm, 1e0) AS Mechanical_Stress,
  proc_k / greatest(air_k, 1e0) AS Thermal_Ratio
"""

RISK_FR = """CASE WHEN {p} >= 8e-1 THEN 'CRITIQUE' WHEN {p} >= 6e-1 THEN 'URGENT'
     WHEN {p} >= 4e-1 THEN 'ATTENTION' WHEN {p} >= 2e-1 THEN 'SURVEILLER' ELSE 'NORMAL' END"""

FLEET_PROB = ("1e0/(1e0+exp(-(-7e0 + 2e-4*(torque*rpm*1.0471975511965977e-1) "
              "+ 3.5e-4*(wear*torque) + 1e-2*wear)))")


def with_views(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
