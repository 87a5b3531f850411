"""Row-wise physics features (F1-F9), tag conversion (P3), defaults (P5) and
column-name sanitising (P4).

All features are plain column expressions built into ONE ``select`` so that
Catalyst collapses them into a single projection inside whole-stage codegen.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv

SENSORS = ["air_k", "proc_k", "rpm", "torque", "wear"]

# Canonical sensor column -> model feature name (sanitised label)
FEATURE_NAME = {
    "air_k": "Air_temperature__K",
    "proc_k": "Process_temperature__K",
    "rpm": "Rotational_speed__rpm",
    "torque": "Torque__Nm",
    "wear": "Tool_wear__min",
    "type_enc": "Type_enc",
}

FEATURE_COLUMNS = fv.FEATURE_COLUMNS

INF = float("inf")


def finite_or_zero(c: Column) -> Column:
    """NaN, +-inf and NULL become 0."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(INF)), F.lit(0.0)).otherwise(F.coalesce(c, F.lit(0.0)))


def _sensor(df: DataFrame, name: str) -> Column:
    # An absent sensor column counts as 0.
    return F.col(name).cast("double") if name in df.columns else F.lit(0.0)


def physics_exprs(df: DataFrame, rpm_mean: float) -> dict[str, Column]:
    """F1-F8 as named expressions over canonical sensor columns."""
    at, pt, rpm, tor, tw = (_sensor(df, s) for s in SENSORS)
    power = tor * rpm * F.lit(fv.TWO_PI_OVER_60)
    dt = pt - at
    wt = tw * tor
    e: dict[str, Column] = {
        "Air_temperature__K": at,
        "Process_temperature__K": pt,
        "Rotational_speed__rpm": rpm,
        "Torque__Nm": tor,
        "Tool_wear__min": tw,
        "Type_enc": _sensor(df, "type_enc"),
        "Power_W": power,
        "Temp_Diff_K": dt,
        "Wear_Torque": wt,
        "Mechanical_Stress": tor / F.greatest(rpm, F.lit(1.0)),
        "Thermal_Ratio": pt / F.greatest(at, F.lit(1.0)),
        "Speed_Deviation": F.abs(rpm - F.lit(float(rpm_mean))),
        "HDF_signal": ((dt < F.lit(fv.FEATURE_HDF_DT)) & (rpm < F.lit(fv.FEATURE_HDF_RPM))).cast("double"),
        "TWF_signal": (tw >= F.lit(fv.FEATURE_TWF_WEAR)).cast("double"),
        "OSF_signal": (wt > F.lit(fv.FEATURE_OSF_WT)).cast("double"),
        "PWF_low": (power < F.lit(fv.FEATURE_PWF_LOW)).cast("double"),
        "PWF_high": (power > F.lit(fv.FEATURE_PWF_HIGH)).cast("double"),
    }
    for name, c in [("Rotational_speed__rpm", rpm), ("Torque__Nm", tor), ("Tool_wear__min", tw),
                    ("Power_W", power), ("Wear_Torque", wt)]:
        safe = F.greatest(c, F.lit(0.0))
        e["log_" + name] = F.log1p(safe)
        e["sqrt_" + name] = F.sqrt(safe)
    e.update({
        "RPM_x_Temp": rpm * pt,
        "Torque_x_TempDiff": tor * dt,
        "Wear_x_Power": tw * power,
        "Wear_x_Torque_sq": tw * (tor * tor),
        "Torque_sq": tor * tor,
        "RPM_sq": rpm * rpm,
        "TempDiff_sq": dt * dt,
        "RPM_x_Wear": rpm * tw,
        "Temp_x_Wear": pt * tw,
    })
    return e


def physics_features(df: DataFrame, rpm_mean: float, keep: list[str] | None = None) -> DataFrame:
    """Add the 36-column feature vector (F1-F9) in model order, in one projection."""
    e = physics_exprs(df, rpm_mean)
    keep = [c for c in (keep if keep is not None else df.columns) if c not in e]
    return df.select(*keep, *[finite_or_zero(e[n]).alias(n) for n in FEATURE_COLUMNS])


def convert_tags(df: DataFrame) -> DataFrame:
    """SCADA tags -> canonical sensors (C -> K, hours -> minutes).

    A tag value wins over a canonical one already present; tags are dropped.
    """
    rules = [
        ("AmbientTemp", "air_k", lambda c: c + F.lit(273.15)),
        ("MotorTemp", "proc_k", lambda c: c + F.lit(273.15)),
        ("Speed_RPM", "rpm", lambda c: c),
        ("Torque_Nm", "torque", lambda c: c),
        ("RunHours", "wear", lambda c: c * F.lit(60.0)),
    ]
    out = df
    for tag, canon, conv in rules:
        if tag not in out.columns:
            continue
        converted = conv(F.col(tag).cast("double"))
        if canon in out.columns:
            converted = F.coalesce(converted, F.col(canon).cast("double"))
        out = out.withColumn(canon, converted)
    return out.drop(*[t for t, _, _ in rules])


def apply_defaults(df: DataFrame, rpm_mean: float, defaults: dict | None = None) -> DataFrame:
    """P5: fill absent or NULL sensors with serving defaults (rpm -> training mean)."""
    d = dict(defaults or fv.SCORING_DEFAULTS)
    d.setdefault("rpm", float(rpm_mean))
    exprs = []
    for c in df.columns:
        if c in d:
            exprs.append(F.coalesce(F.col(c), F.lit(d[c])).alias(c))
        else:
            exprs.append(F.col(c))
    for c, v in d.items():
        if c not in df.columns:
            exprs.append(F.lit(v).alias(c))
    return df.select(*exprs)


def align_features(df: DataFrame, feature_cols: list[str], keep: list[str] = ()) -> DataFrame:
    """P5: select the model's feature list in order; absent features become 0.0."""
    return df.select(*keep, *[(F.col(c).cast("double") if c in df.columns else F.lit(0.0)).alias(c)
                              for c in feature_cols])


def sanitize_name(name: str, variant: str = "train") -> str:
    """``[`` ``]`` and space -> ``_``, ``<`` -> ``lt``, strip ``_``.

    The ``test`` variant removes brackets and replaces spaces only.
    """
    if variant == "test":
        return name.replace("[", "").replace("]", "").replace(" ", "_")
    return name.replace("[", "_").replace("]", "_").replace(" ", "_").replace("<", "lt").strip("_")


def sanitize_columns(df: DataFrame, variant: str = "train") -> DataFrame:
    return df.toDF(*[sanitize_name(c, variant) for c in df.columns])


_AI4I_TO_CANON = {
    "Air temperature [K]": "air_k",
    "Process temperature [K]": "proc_k",
    "Rotational speed [rpm]": "rpm",
    "Torque [Nm]": "torque",
    "Tool wear [min]": "wear",
}


def canonical_from_ai4i(df: DataFrame) -> DataFrame:
    """Rename AI4I sensor labels to the canonical sensor names."""
    return df.select(*[F.col(f"`{c}`").alias(_AI4I_TO_CANON.get(c, re.sub(r"\s+", "_", c)))
                       for c in df.columns])


def sensors_from_map(df: DataFrame, map_col: str, keep: list[str] = ()) -> DataFrame:
    """F28 (input side): an open sensor map (API record) -> canonical sensor columns.

    ``try_element_at`` returns NULL for absent keys; tag keys win over labels (P3)."""
    m = F.col(map_col)
    cols = []
    for canon, keys in fv.SENSOR_MAP_KEYS.items():
        vals = [(F.try_element_at(m, F.lit(k)) * F.lit(mul) + F.lit(add)) for k, add, mul in keys]
        cols.append(F.coalesce(*vals).alias(canon))
    return df.select(*keep, *cols)
