"""Sampling and splitting by keyed hashing (M1-M3, L5, M11 folds).

Every random draw is a function of the row key and a seed through md5, so
results do not depend on partitioning, task retries or executor loss (no
``rand()``).  u = first 8 hex digits of md5(key | seed) / 2^32, in [0, 1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_string(keys: list[str], seed) -> Column:
    return F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))


def uniform(keys: list[str], seed) -> Column:
    """Deterministic U[0,1) per row from md5(key|seed)."""
    h = F.substring(F.md5(key_string(keys, seed)), 1, 8)
    return F.conv(h, 16, 10).cast("double") / F.lit(4294967296.0)


def seeded_sample(df: DataFrame, keys: list[str], n: int, seed=42) -> DataFrame:
    """At most n rows, reproducible: order by md5(key|seed), limit n (a top-k)."""
    return df.orderBy(F.md5(key_string(keys, seed))).limit(n)


def stratified_split(df: DataFrame, keys: list[str], label: str, seed=42,
                     fractions=(0.7, 0.1, 0.2)) -> DataFrame:
    """M1: 'train' / 'val' / 'test' from u; drawn independently within each class,
    so class proportions hold in expectation (sizes approximate)."""
    u = uniform(keys + [label], seed)
    a, b = fractions[0], fractions[0] + fractions[1]
    return df.withColumn("split", F.when(u < a, "train").when(u < b, "val").otherwise("test"))


def fold_column(df: DataFrame, keys: list[str], k: int, seed=42) -> DataFrame:
    """Fold id 0..k-1 from u."""
    return df.withColumn("fold", F.floor(uniform(keys, seed) * k).cast("int"))


def class_counts(df: DataFrame, label: str) -> dict:
    return {r[0]: r[1] for r in df.groupBy(label).count().collect()}


def oversample(df: DataFrame, keys: list[str], label: str, seed=7) -> DataFrame:
    """M2: every minority row repeated floor(r) + (u < frac(r)) times, r = majority/minority.

    Counts come from one small aggregate (one row per class)."""
    c = class_counts(df, label)
    maj = max(c, key=c.get)
    out = df.filter(F.col(label) == maj)
    for cls, n in c.items():
        if cls == maj or n == 0:
            continue
        r = c[maj] / n
        whole, frac = int(r), r - int(r)
        reps = F.lit(whole) + (uniform(keys, seed) < F.lit(frac)).cast("int")
        part = df.filter(F.col(label) == cls).withColumn("_rep", F.explode(F.sequence(F.lit(1), reps)))
        out = out.unionByName(part.drop("_rep"))
    return out


def undersample(df: DataFrame, keys: list[str], label: str, seed=7) -> DataFrame:
    """M3: majority rows kept with probability minority/majority."""
    c = class_counts(df, label)
    mino = min(c, key=c.get)
    cond = F.lit(False)
    for cls, n in c.items():
        keep = F.lit(True) if cls == mino else (uniform(keys, seed) < F.lit(c[mino] / n))
        cond = cond | ((F.col(label) == cls) & keep)
    return df.filter(cond)
