"""Preprocessing operators: interactions (F10), scalers (F11), encodings
(P16, P17), admissibility (P13).

Scalers follow the reference's rules, not Spark ML's (D9): population std,
a zero scale becomes 1, robust = (x - median) / IQR.  Fit returns a small
dict of literals; apply is one projection, usable on streams.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .prefix import running_sums
from .quantiles import profile


def interactions(df: DataFrame, columns: list[str], limit: int = 10) -> DataFrame:
    """products of every pair of the first ``limit`` columns (45 for 10)."""
    base = columns[:limit]
    return df.select("*", *[(F.col(a) * F.col(b)).alias(f"{a}_x_{b}") for a, b in combinations(base, 2)])


def fit_scalers(df: DataFrame, columns: list[str]) -> dict:
    """Fit standard, min-max and robust parameters in one profile."""
    out = {}
    for r in profile(df, columns).collect():
        q1, med, q3 = r["q"]
        out[r["column"]] = {"mu": r["mean"], "sd": r["std_pop"], "lo": r["min"], "hi": r["max"], "med": med, "iqr": q3 - q1}
    return out


def _nz(v: float) -> float:
    return 1.0 if not v else float(v)


def apply_scalers(df: DataFrame, params: dict, columns: list[str]) -> DataFrame:
    """Add <c>_std, <c>_minmax, <c>_robust (scale 0 -> 1)."""
    exprs = []
    for c in columns:
        p = params[c]
        x = F.col(c)
        exprs += [((x - F.lit(p["mu"])) / F.lit(_nz(p["sd"]))).alias(f"{c}_std"),
                  ((x - F.lit(p["lo"])) / F.lit(_nz(p["hi"] - p["lo"]))).alias(f"{c}_minmax"),
                  ((x - F.lit(p["med"])) / F.lit(_nz(p["iqr"]))).alias(f"{c}_robust")]
    return df.select("*", *exprs)


def numeric_columns(df: DataFrame, drop: list[str] = ()) -> list[str]:
    """The columns of a numeric type, in order, without those of ``drop``."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in drop]


def alphabetical_codes(df: DataFrame, col: str, out: str) -> DataFrame:
    """code = position of the level in alphabetical order, for any number of levels.

    Ranks come from running sums over the distinct levels, joined back on the level."""
    levels = df.select(F.col(col).alias("_level")).filter("_level is not null").distinct().withColumn("_one", F.lit(1))
    codes = running_sums(levels, "_level", ["_one"], inclusive=False).select("_level", F.col("cum__one").cast("int").alias(out))
    return df.join(codes, F.col(col) == F.col("_level"), "left").drop("_level")


def one_hot_drop_first(df: DataFrame, col: str, prefix: str, max_levels: int = 1000) -> DataFrame:
    """One 0/1 column per level except the first alphabetical one; refuses to make more
    than ``max_levels`` columns."""
    levels = [r[0] for r in df.select(col).distinct().limit(max_levels + 1).collect()]
    if len(levels) > max_levels:
        raise ValueError(f"{col}: more than {max_levels} levels")
    levels = sorted(v for v in levels if v is not None)
    return df.select("*", *[(F.col(col) == F.lit(v)).cast("int").alias(f"{prefix}_{v}") for v in levels[1:]])


def admissibility(df: DataFrame, machine: str, value: str) -> DataFrame:
    """A reading is admissible with a machine id and a non-null, non-zero value."""
    reason = (F.when(F.col(machine).isNull(), F.lit("missing machine"))
              .when(F.col(value).isNull(), F.lit("missing value"))
              .when(F.col(value) == 0, F.lit("zero value")))
    return df.withColumn("reason", reason).withColumn("admissible", reason.isNull())
