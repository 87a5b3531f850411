"""Rule functions as column expressions: failure modes (F12, F13), risk scales
(F14-F18), confidence and decision (F19), ensemble mean (F20), alert icon (F21),
input validation (P6, P7), motor class (P15) and the linear scorer (M20, M22).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def power_w(torque, rpm) -> Column:
    return _c(torque) * _c(rpm) * F.lit(fv.TWO_PI_OVER_60)


# --- F12 / F13 ----------------------------------------------------------------
def likely_failure_modes(air="air_k", proc="proc_k", rpm="rpm", torque="torque", wear="wear",
                         empty_marker: bool = True) -> Column:
    """diagnostic modes in order TWF, HDF, PWF, OSF; empty -> ["—"]."""
    at, pt, n, tor, tw = map(_c, (air, proc, rpm, torque, wear))
    p = power_w(tor, n)
    arr = F.array(
        F.when(tw >= F.lit(fv.DIAG_TWF_WEAR), F.lit("TWF")),
        F.when(((pt - at) < F.lit(fv.DIAG_HDF_DT)) & (n < F.lit(fv.DIAG_HDF_RPM)), F.lit("HDF")),
        F.when((p < F.lit(fv.DIAG_PWF_LOW)) | (p > F.lit(fv.DIAG_PWF_HIGH)), F.lit("PWF")),
        F.when((tw * tor) > F.lit(fv.DIAG_OSF_WT), F.lit("OSF")),
    )
    modes = F.filter(arr, lambda m: m.isNotNull())
    if not empty_marker:
        return modes
    return F.when(F.size(modes) == 0, F.array(F.lit(fv.NO_MODE))).otherwise(modes)


def spec_failure_flags(air="air_k", proc="proc_k", rpm="rpm", torque="torque", wear="wear",
                       mtype="mtype") -> dict[str, Column]:
    """the dataset's failure definition; returns int flags and their OR."""
    at, pt, n, tor, tw, t = map(_c, (air, proc, rpm, torque, wear, mtype))
    p = power_w(tor, n)
    osf_lim = (F.when(t == "L", F.lit(fv.SPEC_OSF_BY_TYPE["L"]))
               .when(t == "M", F.lit(fv.SPEC_OSF_BY_TYPE["M"]))
               .otherwise(F.lit(fv.SPEC_OSF_BY_TYPE["H"])))
    flags = {
        "HDF": ((pt - at) < F.lit(fv.SPEC_HDF_DT)) & (n < F.lit(fv.SPEC_HDF_RPM)),
        "PWF": (p < F.lit(fv.SPEC_PWF_LOW)) | (p > F.lit(fv.SPEC_PWF_HIGH)),
        "OSF": (tw * tor) > osf_lim,
        "TWF": tw.between(F.lit(fv.SPEC_TWF_WEAR_LOW), F.lit(fv.SPEC_TWF_WEAR_HIGH)),
    }
    out = {k: F.coalesce(v, F.lit(False)).cast("int") for k, v in flags.items()}
    out["machine_failure"] = F.greatest(*out.values())
    return out


# --- risk scales ---------------------------------------------------------------
def _band(p: Column, levels, otherwise) -> Column:
    expr = None
    for lo, val in levels:
        cond = p >= F.lit(lo)
        expr = F.when(cond, F.lit(val)) if expr is None else expr.when(cond, F.lit(val))
    return expr.otherwise(F.lit(otherwise))


def risk_level_fr(p) -> Column:
    """CRITIQUE/URGENT/ATTENTION/SURVEILLER/NORMAL, inclusive lower bounds."""
    return _band(_c(p), [(lo, lv) for lo, lv, _, _ in fv.RISK_LEVELS_FR], "NORMAL")


def risk_action_fr(p) -> Column:
    return _band(_c(p), [(lo, a) for lo, _, a, _ in fv.RISK_LEVELS_FR], "Fonctionnement normal")


def risk_icon_fr(p) -> Column:
    return _band(_c(p), [(lo, i) for lo, _, _, i in fv.RISK_LEVELS_FR], "🟢")


def risk_rank_fr(level) -> Column:
    """Position of a French level in NORMAL < ... < CRITIQUE; unknown -> 0."""
    lv = _c(level)
    expr = F.lit(0)
    for i, name in enumerate(fv.RISK_ORDER_FR):
        expr = F.when(lv == name, F.lit(i)).otherwise(expr)
    return expr


def risk_from_rank_fr(rank) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in fv.RISK_ORDER_FR]), _c(rank) + 1)


def ttf_text_fr(level) -> Column:
    lv = _c(level)
    expr = F.lit("—")
    for k, v in reversed(list(fv.TTF_TEXT_FR.items())):
        expr = F.when(lv == k, F.lit(v)).otherwise(expr)
    return expr


def risk_level_en4(p) -> Column:
    """CRITICAL/HIGH/MEDIUM/LOW at .8/.6/.4 (p as a fraction)."""
    return _band(_c(p), fv.RISK_LEVELS_EN4, fv.RISK_EN4_ELSE)


def risk_level_en5(p) -> Column:
    """F16: five English levels including NORMAL."""
    return _band(_c(p), [(lo, lv) for lo, lv, _ in fv.RISK_LEVELS_EN5], "NORMAL")


def risk_action_en5(p) -> Column:
    return _band(_c(p), [(lo, a) for lo, _, a in fv.RISK_LEVELS_EN5], "OK")


def days_to_failure_4(pct) -> Column:
    """F17 (library): 1/3/5 days at 80/60/40 %, else 7 (pct in percent)."""
    return _band(_c(pct), fv.DAYS_STEPS_4, fv.DAYS_STEPS_4_ELSE)


def days_to_failure_5(p) -> Column:
    """F17 (five steps): 1/3/5/7/14 at .8/.6/.4/.2/0 (p as a fraction)."""
    return _band(_c(p), fv.DAYS_STEPS_5, fv.DAYS_STEPS_5_ELSE)


def normalize_risk(level) -> Column:
    """English or French risk key -> French level, default NORMAL."""
    lv = _c(level)
    expr = F.lit("NORMAL")
    for k, v in reversed(list(fv.RISK_NORMALIZE.items())):
        expr = F.when(lv == k, F.lit(v)).otherwise(expr)
    return expr


def confidence(p) -> Column:
    """|p - 0.5| / 0.5."""
    return F.abs(_c(p) - F.lit(0.5)) / F.lit(0.5)


def binary_decision(p, threshold: float) -> Column:
    return (_c(p) >= F.lit(float(threshold))).cast("int")


def weighted_mean(probs: dict, weights: dict) -> Column:
    """sum(w * p) / sum(w) over named model probabilities."""
    total = float(sum(weights[k] for k in probs))
    num = None
    for k, col in probs.items():
        term = F.lit(float(weights[k])) * _c(col)
        num = term if num is None else num + term
    return num / F.lit(total)


def alert_icon(p) -> Column:
    """alert icon at .8 / .5."""
    return _band(_c(p), fv.ALERT_ICONS, fv.ALERT_ICON_ELSE)


# --- validation ----------------------------------------------------------------
def validation_warnings(bounds=None) -> Column:
    """List of warnings over the five physical bounds (inclusive); empty if valid.

    NaN is out of range (it is never between two numbers)."""
    bounds = bounds or fv.SENSOR_BOUNDS
    items = []
    for col, label, lo, hi in bounds:
        c = F.col(col).cast("double")
        shown = F.when(F.isnan(c), F.lit("nan")).otherwise(F.format_string("%.1f", c))
        items.append(
            F.when(c.isNull(), F.lit(f"Missing sensor: {label}"))
             .when(~c.between(F.lit(lo), F.lit(hi)),
                   F.concat(F.lit(f"Out of range: {label}="), shown,
                            F.lit(f"  (expected {lo}–{hi})"))))
    return F.filter(F.array(*items), lambda w: w.isNotNull())


def entry_check(sensor: str, value, ranges=None) -> tuple[Column, Column]:
    """(status, message) for one manual-entry sensor.

    status: 'invalid' outside the range, 'near_limit' within 10 % of a limit,
    'ok' otherwise, 'unchecked' for sensors without a range."""
    ranges = {s: (lo, hi) for s, lo, hi in (ranges or fv.ENTRY_VALUE_RANGES)}
    v = _c(value)
    if sensor not in ranges:
        return F.lit("unchecked"), F.lit(None).cast("string")
    lo, hi = ranges[sensor]
    margin = (hi - lo) * fv.NEAR_LIMIT_FRACTION
    status = (F.when(v.isNull(), F.lit(None))
              .when((v < F.lit(lo)) | (v > F.lit(hi)), F.lit("invalid"))
              .when((v < F.lit(lo + margin)) | (v > F.lit(hi - margin)), F.lit("near_limit"))
              .otherwise(F.lit("ok")))
    shown = v.cast("string")
    msg = (F.when(status == "invalid", F.concat(F.lit(f"warning: {sensor} = "), shown))
           .when(status == "near_limit", F.concat(F.lit(f"⚠️ {sensor}: "), shown, F.lit(" (near limit)"))))
    return status, msg


def motor_class(motor_type) -> Column:
    """Upper-cased machine type -> class code, default 1."""
    t = F.upper(_c(motor_type))
    expr = F.lit(fv.MOTOR_TYPE_DEFAULT)
    for k, v in reversed(list(fv.MOTOR_TYPE_MAP.items())):
        expr = F.when(t == k, F.lit(v)).otherwise(expr)
    return expr


def motor_code(given, motor_type, given_wins: bool = True) -> Column:
    """D3: the class code of a reading: a given code wins and the machine type is the
    fallback; with ``given_wins=False`` the machine type overwrites it (parity)."""
    by_type = motor_class(motor_type)
    return F.coalesce(_c(given).cast("int"), by_type) if given_wins else by_type


# --- scoring -------------------------------------------------------------------
def linear_logit(coefs: dict, intercept: float) -> Column:
    z = F.lit(float(intercept))
    for name, w in coefs.items():
        z = z + F.lit(float(w)) * _c(name)
    return z


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def prediction_label_probability(prediction) -> Column:
    """Models without probabilities -> 100 when the prediction is 1 else 0."""
    return F.when(_c(prediction) == 1, F.lit(100.0)).otherwise(F.lit(0.0))


# Flagship linear scorer over the sensor view (coefficients fixed for the fixtures)
FLEET_COEFS = {"Power_W": 2e-4, "Wear_Torque": 3.5e-4, "wear": 1e-2}
FLEET_INTERCEPT = -7.0
