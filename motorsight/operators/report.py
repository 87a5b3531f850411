"""Report tables (R1-R7): text lines built from column expressions.

A report is an ``array<string>`` per prediction made with ``concat`` of line
arrays (the knowledge tables are literal maps, a few rows each), then
``posexplode`` to (key, line_no, line) rows.  No Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.rules import normalize_risk


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lit_map(d: dict) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(v))])


def _arr_map(d: dict) -> Column:
    return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])


def _num_text(c: Column) -> Column:
    """Python str() of a float for the report snapshot values (e.g. 308.1, 1360.0)."""
    return F.when(c.isNull(), F.lit("N/A")).otherwise(c.cast("double").cast("string"))


def _k_to_c(c: Column) -> Column:
    return F.when(c.isNull(), F.lit("N/A")).otherwise(F.format_string("%.1f", c - F.lit(273.15)))


def diagnostic_report_lines(pred: DataFrame, *, machine="machine_id", stamp="ts", prob_pct="failure_probability_pct",
                            risk="risk_level", icon="risk_icon", ttf="time_to_failure_estimate",
                            modes="likely_failure_modes", conf="confidence", snapshot="sensor_snapshot",
                            manufacturer: str = "Siemens") -> Column:
    """The French diagnostic report of one prediction as an array of lines."""
    manuf = manufacturer.upper()
    sep, sub, t = fv.REPORT_RULE, fv.REPORT_SUBRULE, fv.REPORT_TEXTS
    rk = normalize_risk(_c(risk))
    snap = F.col(snapshot)
    air, mot = snap["air_temp_K"], snap["motor_temp_K"]
    names = _lit_map({k: d["nom"] for k, d in fv.FAILURE_DETAILS.items()})
    causes = _lit_map({k: d["cause"] for k, d in fv.FAILURE_DETAILS.items()})
    actions = _arr_map({k: d["actions"] for k, d in fv.FAILURE_DETAILS.items()})
    vendor_key = "siemens_param" if manuf == "SIEMENS" else "schneider_param"
    vendor = _lit_map({k: d[vendor_key] for k, d in fv.FAILURE_DETAILS.items()})
    vendor_label = fv.REPORT_VENDOR.get(manuf)
    active = F.filter(F.coalesce(_c(modes), F.array().cast("array<string>")), lambda m: m != fv.NO_MODE)

    def mode_block(m):
        acts = F.transform(F.coalesce(F.element_at(actions, m), F.array().cast("array<string>")),
                           lambda a: F.concat(F.lit("      "), a))
        head = F.array(F.lit(""), F.concat(F.lit(t["mode"]), F.coalesce(F.element_at(names, m), m)),
                       F.concat(F.lit(t["cause"]), F.coalesce(F.element_at(causes, m), F.lit("N/A"))),
                       F.lit(""), F.lit(t["actions"]))
        tail = F.array(F.lit(""), F.concat(F.lit(vendor_label), F.coalesce(F.element_at(vendor, m), F.lit("—")))) \
            if vendor_label else F.array(F.lit(""))
        return F.concat(head, acts, tail)

    mode_lines = F.when(F.size(active) == 0, F.array(*[F.lit(x) for x in fv.REPORT_NO_MODE])) \
        .otherwise(F.flatten(F.transform(active, mode_block)))
    tdiff = mot - air
    dt_line = F.when(air.isNotNull() & mot.isNotNull() & (air != 0) & (mot != 0), F.array(F.concat(
        F.lit(t["difference"]), F.format_string("%.1f", tdiff), F.lit(" K  "),
        F.when(tdiff < fv.FEATURE_HDF_DT, F.lit(t["low"])).otherwise(F.lit("OK"))))) \
        .otherwise(F.array().cast("array<string>"))
    sched = F.coalesce(F.element_at(_arr_map(fv.MAINTENANCE_SCHEDULES), rk),
                       F.array(F.lit(fv.SCHEDULE_FALLBACK)))
    def percent(c):
        return F.concat(F.format_string("%.1f", c), F.lit(" %"))
    return F.concat(
        F.array(F.lit(sep), F.lit(t["title"]), F.lit(t["system"]), F.lit(t["maker"].format(manuf)), F.lit(sep),
                F.concat(F.lit(t["machine"]), _c(machine).cast("string")),
                F.concat(F.lit(t["stamp"]), F.date_format(_c(stamp), "dd/MM/yyyy  HH:mm:ss")),
                F.lit(t["model"] + fv.REPORT_MODEL_NAME), F.lit(""),
                F.lit(sub), F.lit(t["result"]), F.lit(sub),
                F.concat(F.lit(t["probability"]), percent(_c(prob_pct))),
                F.concat(F.lit(t["risk"]), _c(icon), F.lit(" "), rk),
                F.concat(F.lit(t["delay"]), _c(ttf)),
                F.concat(F.lit(t["confidence"]), percent(_c(conf) * 100)),
                F.lit(""),
                F.concat(F.lit(t["meaning"]), F.coalesce(F.element_at(_lit_map(fv.RISK_DESCRIPTIONS), rk), F.lit(""))),
                F.lit(""), F.lit(sub), F.lit(t["sensors"]), F.lit(sub),
                F.concat(F.lit(t["air"]), _num_text(air), F.lit(" K  ("), _k_to_c(air), F.lit(" °C)")),
                F.concat(F.lit(t["motor"]), _num_text(mot), F.lit(" K  ("), _k_to_c(mot), F.lit(" °C)")),
                F.concat(F.lit(t["rpm"]), _num_text(snap["rpm"]), F.lit(" tr/min")),
                F.concat(F.lit(t["torque"]), _num_text(snap["torque_Nm"]), F.lit(" Nm")),
                F.concat(F.lit(t["wear"]), _num_text(snap["wear_min"]), F.lit(" min")),
                F.concat(F.lit(t["power"]), _num_text(snap["power_W"]), F.lit(" W"))),
        dt_line,
        F.array(F.lit(""), F.lit(sub), F.lit(t["modes"]), F.lit(sub)),
        mode_lines,
        F.array(F.lit(""), F.lit(sub), F.lit(t["planning"]), F.lit(sub)),
        F.transform(sched, lambda s: F.concat(F.lit("  "), s)),
        F.array(F.lit(""), F.lit(sep), *[F.lit(x) for x in fv.REPORT_CLOSING], F.lit(sep)))


def report_texts(pred: DataFrame, keys: list[str], **names) -> DataFrame:
    """R1 for every prediction: (keys..., n_lines, report), the whole report as one text."""
    lines = diagnostic_report_lines(pred, **names)
    return pred.select(*keys, lines.alias("_lines")).select(
        *keys, F.size("_lines").alias("n_lines"), F.array_join("_lines", "\n").alias("report"))


def explode_lines(df: DataFrame, lines: Column, keys: list[str]) -> DataFrame:
    """(keys..., line_no, line) rows from an array of lines (line_no from 1)."""
    return df.select(*keys, F.posexplode(lines).alias("line_no", "line")) \
        .withColumn("line_no", F.col("line_no") + 1)


def schedule_lines(df: DataFrame, risk: str = "risk_level") -> Column:
    """R2: maintenance schedule lines of a French risk level."""
    return F.coalesce(F.element_at(_arr_map(fv.MAINTENANCE_SCHEDULES), normalize_risk(_c(risk))),
                      F.array(F.lit(fv.SCHEDULE_FALLBACK)))


def recommendation_en(risk_en) -> Column:
    """English maintenance recommendation by level, with the fallback text."""
    return F.coalesce(F.element_at(_lit_map(fv.RECOMMENDATIONS_EN), _c(risk_en)),
                      F.lit(fv.RECOMMENDATION_FALLBACK))


# Dashboard column names (old prediction keys -> fleet table headers)
FLEET_SUMMARY_NAMES = {
    "machine_id": "Machine",
    "failure_probability_pct": "Probabilité (%)",
    "risk_level": "Risque",
    "time_to_failure_estimate": "Délai",
    "likely_failure_modes": "Modes",
}


def fleet_summary(pred: DataFrame, names: dict | None = None) -> DataFrame:
    """One row per prediction with modes joined and dashboard column names."""
    names = names or FLEET_SUMMARY_NAMES
    cols = []
    for old, new in names.items():
        c = F.col(old)
        if old == "likely_failure_modes":
            c = F.array_join(c, ", ")
        cols.append(c.alias(new))
    return pred.select(*cols)
