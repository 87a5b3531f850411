"""Numeric helpers as primitive-math column expressions.

Spark's ``round`` on doubles goes through BigDecimal per value, which costs
more than the features themselves.  ``round_half_away`` stays in generated
code: ``sign(x) * trunc(|x| * 10^d + 0.5) / 10^d``, the rule DuckDB and C's
``round`` apply, so both engines agree on the result.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_away(c: Column, digits: int = 6) -> Column:
    scale = float(10 ** digits)
    a = F.abs(c) * F.lit(scale)
    # Beyond 1e15 a double has no digit left at 10^-digits to round.
    r = F.signum(c) * (a + F.lit(0.5)).cast("long").cast("double") / F.lit(scale)
    return F.when(a < F.lit(1e15), r).otherwise(c)


def round6(c: Column) -> Column:
    return round_half_away(c, 6)


def bucket_index(v: Column, bounds: list, strict: bool = True) -> Column:
    """Number of sorted ``bounds`` below ``v`` (``b < v``; ``b <= v`` if not strict),
    as a balanced CASE tree: log2(len(bounds)) comparisons per row, all in
    generated code (a higher-order ``filter`` over a literal array is evaluated
    element by element outside codegen)."""
    bounds = list(bounds)

    def below(b):
        return (F.lit(b) < v) if strict else (F.lit(b) <= v)

    def tree(lo: int, hi: int) -> Column:
        # answer in [lo, hi]: count of bounds[0:k] below v
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi + 1) // 2          # is bounds[mid - 1] below v?
        return F.when(below(bounds[mid - 1]), tree(mid, hi)).otherwise(tree(lo, mid - 1))

    return tree(0, len(bounds))
