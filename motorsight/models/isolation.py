"""Isolation forest (M5): trees grown per group with ``applyInPandas``, rows
scored by a pandas function against the broadcast forest.

Sub-sampling: every row is dealt to ``k = ceil(psi * trees / n)`` trees by a
keyed hash, and each tree keeps at most ``psi`` (256) of its rows in md5 order,
so a tree's group is bounded by construction.  Growth uses numpy on at most
psi rows; the forest (trees x at most 2*psi nodes) is small and broadcast.
Score follows the usual definition: s = 2^(-E[h(x)] / c(psi)); the decision
value is -s - offset, offset = the contamination quantile of -s.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, DoubleType, IntegerType, LongType, StructField,
                               StructType)

from ..operators.quantiles import profile
from ..operators.sampling import key_string
from ..session import scratch_path

#: Rows that are led through all trees together.
BLOCK_ROWS = 4096

NODE_SCHEMA = StructType([
    StructField("tree", IntegerType()), StructField("feature", ArrayType(IntegerType())),
    StructField("threshold", ArrayType(DoubleType())), StructField("left", ArrayType(IntegerType())),
    StructField("right", ArrayType(IntegerType())), StructField("size", ArrayType(LongType())),
])


def c_factor(n: float) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.Generator, max_depth: int):
    feat, thr, left, right, size = [], [], [], [], []

    def node(idx, depth):
        me = len(feat)
        feat.append(-1), thr.append(0.0), left.append(-1), right.append(-1), size.append(len(idx))
        if depth >= max_depth or len(idx) <= 1:
            return me
        pts = x[idx]
        lo, hi = pts.min(axis=0), pts.max(axis=0)
        cand = np.nonzero(hi > lo)[0]
        if len(cand) == 0:
            return me
        f = int(rng.choice(cand))
        t = float(rng.uniform(lo[f], hi[f]))
        feat[me], thr[me] = f, t
        mask = pts[:, f] < t
        left[me] = node(idx[mask], depth + 1)
        right[me] = node(idx[~mask], depth + 1)
        return me

    node(np.arange(len(x)), 0)
    return feat, thr, left, right, size


def fit(df: DataFrame, features: list[str], keys: list[str], trees: int = 200, psi: int = 256,
        seed: int = 42) -> DataFrame:
    """Grow the forest; returns one row per tree (node arrays)."""
    n = df.count()
    psi = min(psi, n)
    k = max(1, math.ceil(psi * trees / max(n, 1)))
    ks = key_string(keys, seed)
    dealt = df.select(*features, ks.alias("_k"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_j"))
    dealt = dealt.withColumn("tree", F.pmod(F.xxhash64("_k", "_j"), F.lit(trees)).cast("int")) \
        .withColumn("_o", F.md5(F.concat_ws("|", "_k", "_j")))
    # A row stays with probability 3 psi / (rows per tree), so that no tree's group grows with n
    # (the chance that fewer than psi survive is negligible for psi = 256).
    rate = 3.0 * psi / max(n * k / trees, 1.0)
    u = F.conv(F.substring("_o", 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    dealt = dealt.filter(u < F.lit(rate))
    w = Window.partitionBy("tree").orderBy("_o")
    sample = dealt.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= psi)
    depth = int(math.ceil(math.log2(max(psi, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        x = pdf[features].to_numpy(dtype="float64")
        f, th, lf, rt, sz = _grow(x, np.random.default_rng(seed * 100003 + t), depth)
        return pd.DataFrame({"tree": [t], "feature": [f], "threshold": [th], "left": [lf], "right": [rt],
                             "size": [sz]})

    return sample.groupBy("tree").applyInPandas(grow, NODE_SCHEMA)


def _heaps(forest: list) -> list:
    """Every tree as a full binary tree in heap order: (feature, threshold) of the inner nodes, path length of the last
    level.  A leaf above that level passes rows on to its right, and all below it has its path length."""
    out = []
    for f, th, lf, rt, sz in forest:
        at, leaves = [(0, 0, 0)], []  # (node, depth, place in its level)
        for node, depth, place in at:
            if f[node] < 0:
                leaves.append((depth, place, depth + c_factor(sz[node])))
            else:
                at += [(lf[node], depth + 1, 2 * place), (rt[node], depth + 1, 2 * place + 1)]
        levels = at[-1][1]
        feature, threshold, length = np.zeros((1 << levels) - 1, np.int64), np.full((1 << levels) - 1, -np.inf), np.zeros(1 << levels)
        for node, depth, place in at:
            if f[node] >= 0:
                feature[(1 << depth) - 1 + place], threshold[(1 << depth) - 1 + place] = f[node], th[node]
        for depth, place, h in leaves:
            below = levels - depth
            length[place << below:(place + 1) << below] = h
        out.append((levels, feature, threshold, length))
    return out


def _path_lengths(x: np.ndarray, heaps: list) -> np.ndarray:
    """Mean path length of every row, in blocks of rows that stay in a core's cache."""
    total = np.zeros(len(x))
    for a in range(0, len(x), BLOCK_ROWS):
        block = x[a:a + BLOCK_ROWS]
        n, sums = len(block), total[a:a + BLOCK_ROWS]
        flat, row = np.ascontiguousarray(block.T).ravel(), np.arange(n)
        for levels, feature, threshold, length in heaps:
            start, node = feature * n, np.zeros(n, np.int64)
            for _ in range(levels):
                left = flat.take(start.take(node) + row) < threshold.take(node)
                node = 2 * node + 2 - left
            sums += length.take(node - (len(length) - 1))
    return total / len(heaps)


def score(df: DataFrame, forest_df: DataFrame, features: list[str], psi: int = 256) -> DataFrame:
    """Add ``anomaly_raw`` = -s (higher = more normal, as sklearn's score_samples)."""
    forest = [(r["feature"], r["threshold"], r["left"], r["right"], r["size"]) for r in forest_df.collect()]
    n_sub = max(min(psi, max(s[0] for *_, s in forest)), 2)
    cn = c_factor(n_sub)
    bc = df.sparkSession.sparkContext.broadcast(_heaps(forest))

    @F.pandas_udf("double")
    def raw(*cols: pd.Series) -> pd.Series:  # only the features go to Python
        h = _path_lengths(np.stack([c.to_numpy("float64") for c in cols], axis=1), bc.value)
        return pd.Series(-np.power(2.0, -h / cn))

    return df.withColumn("anomaly_raw", raw(*features))


def decision(scored: DataFrame, contamination: float = 0.05, offset: float | None = None) -> tuple[DataFrame, float]:
    """Decision value = anomaly_raw - offset; without a given one, the offset is the exact contamination quantile of
    anomaly_raw.  Scores are written once; quantile and decisions read the written table."""
    path = scratch_path(scored.sparkSession, f"isolation/{uuid.uuid4().hex}")
    scored.write.parquet(path)
    scored = scored.sparkSession.read.schema(scored.schema).parquet(path)
    if offset is None:
        offset = float(profile(scored, ["anomaly_raw"], [contamination]).first()["q"][0] or 0.0)
    return scored.withColumn("anomaly_score", F.col("anomaly_raw") - F.lit(offset)), offset


def anomaly_guard(train: DataFrame, rows: DataFrame, features: list[str], keys: list[str], contamination: float = 0.05,
                  trees: int = 200) -> tuple[DataFrame, float]:
    """M5: ``rows`` with ``anomaly_score``, from a forest and an offset fitted on ``train`` alone, both on features
    scaled by the mean and population deviation of ``train``."""
    ends = train.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(features)]).first()

    def scaled(d: DataFrame) -> DataFrame:
        return d.withColumns({f"_z{i}": (F.col(c) - F.lit(ends[f"m{i}"] or 0.0)) / F.lit(ends[f"s{i}"] or 1.0) for i, c in enumerate(features)})

    names = [f"_z{i}" for i in range(len(features))]
    z = scaled(train)
    forest = fit(z, names, keys, trees=trees)
    _, offset = decision(score(z, forest, names).select("anomaly_raw"), contamination)
    out, _ = decision(score(scaled(rows), forest, names).drop(*names), offset=offset)
    return out, offset


def outlier_filter(df: DataFrame, features: list[str], keys: list[str], contamination: float = 0.1,
                   trees: int = 200) -> DataFrame:
    """M5 as a preprocessing filter: keep rows with a decision value >= 0."""
    forest = fit(df, features, keys, trees=trees)
    d, _ = decision(score(df, forest, features), contamination)
    return d.filter(F.col("anomaly_score") >= 0).drop("anomaly_raw", "anomaly_score")
