"""Batch scoring into prediction records (M20, P18, F28) as ONE projection.

The reference scores one reading per call and returns early on invalid input;
here every reading gets a ``status`` column instead (no early exit), and the
nested record is built with ``struct`` / arrays.  The probability comes from
any column expression (a linear scorer, an ensemble mean, or a model's
probability column after ``transform``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import rules as R
from ..functions.numeric import round_half_away


def _round(c: Column, d: int) -> Column:
    return round_half_away(c, d)


def validation_status() -> tuple[Column, Column]:
    """The list of warnings, and INPUT_VALIDATION_ERROR or OK."""
    warn = R.validation_warnings()
    return warn, F.when(F.size(warn) > 0, F.lit("INPUT_VALIDATION_ERROR")).otherwise(F.lit("OK"))


def prediction_records(df: DataFrame, p: Column, *, machine="machine_id", stamp="ts",
                       motor_type: Column | None = None, model_name: str = "Ensemble",
                       threshold: float = fv.PRODUCTION_THRESHOLD, anomaly_score: Column | None = None,
                       keep: list[str] = ()) -> DataFrame:
    """Readings with canonical sensors (air_k, proc_k, rpm, torque, wear) ->
    prediction records.  Invalid readings (P6) get status INPUT_VALIDATION_ERROR
    and no probability; an anomaly score below -0.3 gives SENSOR_ANOMALY."""
    # Probability, warnings and modes are columns first: as expressions they would be worked out again for every field.
    df = df.withColumns({"_p": p, "_warn": R.validation_warnings(), "_modes": R.likely_failure_modes(empty_marker=False)})
    p, warn, modes = F.col("_p"), F.col("_warn"), F.col("_modes")
    power = R.power_w("torque", "rpm")
    status = F.when(F.size(warn) > 0, F.lit("INPUT_VALIDATION_ERROR"))
    if anomaly_score is not None:
        status = status.when(anomaly_score < fv.ANOMALY_SCORE_LIMIT, F.lit("SENSOR_ANOMALY"))
    status = status.otherwise(F.lit("OK"))
    df = df.withColumns({"_status": status, "_level": R.risk_level_fr(p)})
    status, level, ok = F.col("_status"), F.col("_level"), F.col("_status") == "OK"
    snapshot = F.struct(
        _round(F.col("air_k"), 1).alias("air_temp_K"), _round(F.col("proc_k"), 1).alias("motor_temp_K"),
        _round(F.col("proc_k") - F.col("air_k"), 2).alias("temp_diff_K"), _round(F.col("rpm"), 1).alias("rpm"),
        _round(F.col("torque"), 1).alias("torque_Nm"), _round(F.col("wear"), 1).alias("wear_min"),
        _round(power, 1).alias("power_W"))
    return df.select(
        *keep,
        F.col(machine).alias("machine_id"),
        (motor_type if motor_type is not None else F.lit(None).cast("string")).alias("motor_type"),
        F.lit(model_name).alias("model_name"),
        F.col(stamp).alias("timestamp"),
        status.alias("status"),
        (~ok).alias("skip_prediction"),
        warn.alias("validation_warnings"),
        F.when(ok, _round(p * 100, 2)).alias("failure_probability_pct"),
        F.when(ok, R.binary_decision(p, threshold)).alias("binary_prediction"),
        F.when(ok, level).alias("risk_level"),
        F.when(ok, R.risk_icon_fr(p)).alias("risk_icon"),
        F.when(ok, R.risk_action_fr(p)).otherwise(F.lit("Vérifier les capteurs — valeurs hors limites physiques."))
        .alias("action"),
        F.when(ok, F.when(F.size(modes) == 0, F.array(F.lit(fv.NO_MODE))).otherwise(modes)).alias("likely_failure_modes"),
        F.when(ok, _round(R.confidence(p), 4)).alias("confidence"),
        F.lit(float(threshold)).alias("threshold_used"),
        F.when(ok, R.ttf_text_fr(level)).alias("time_to_failure_estimate"),
        snapshot.alias("sensor_snapshot"))


def invalid_as_normal(df: DataFrame, pct: str = "pct", risk: str = "risk_level", skip_invalid: bool = False) -> DataFrame:
    """Readings that fail validation (P6) count as 0 % and NORMAL, or are left out."""
    valid = F.size(R.validation_warnings()) == 0
    if skip_invalid:
        return df.filter(valid)
    return df.withColumns({pct: F.when(valid, F.col(pct)).otherwise(0.0), risk: F.when(valid, F.col(risk)).otherwise("NORMAL")})


def records_to_json(pred: DataFrame, keep: list[str] = ()) -> DataFrame:
    """the nested record as JSON text (arrays and structs kept)."""
    cols = [c for c in pred.columns if c not in keep]
    return pred.select(*keep, F.to_json(F.struct(*cols)).alias("json"))
