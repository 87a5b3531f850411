"""SMOTE (M4): synthetic minority rows on segments to nearest minority neighbours.

Neighbours without an all-pairs join, for any number of features:

1. Feature vectors are deduplicated first (a vector repeated many times is one
   point), so a hot group of identical rows never meets itself.
2. ``TREES`` median-split trees with random directions are grown on a bounded sample (in
   hash order).  Leaves that are larger than ``LEAF_ROWS`` (the sample places only so many cuts) are cut
   on in slabs along one more direction, so a task compares at most ``LEAF_ROWS`` points, in blocks, at any
   size.  One leaf is the exact answer.
3. Over many leaves, rounds refine the neighbour graph: the points around each pivot (its
   neighbours and those it is a neighbour of) are compared with each other, since a neighbour's
   neighbour is likely one too.  ``GRAPH`` neighbours a point are kept meanwhile.  A pivot that very many points
   have as neighbour is dealt into groups of about ``GROUP_ROWS``.  Groups are searched slice by slice, so that
   the shuffle of a slice stays about ``SLICE_BYTES``.  Rounds end when one changes less than the share
   ``SETTLED`` of the answer.
4. Each minority row then yields floor(r) or floor(r)+1 synthetic rows
   (r = (majority - minority) / minority), neighbour and gap drawn from md5.

Measured recall of the 5 nearest against brute force: see ``tests/test_ml.py`` and the README.
"""

from __future__ import annotations

import functools
import math
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sampling import uniform
from ..session import scratch_path

TREES = 4
LEAF_ROWS = 1024
SAMPLE_ROWS = 65_536
ROUNDS = 10
SETTLED = 0.01
GRAPH = 20
GROUP_ROWS = 256
#: Rows of a lot, about: the groups around many pivots are searched in one call.
LOT_ROWS = 20_000
#: Bytes of group members that are shuffled at once; more are searched slice by slice.
SLICE_BYTES = 2 << 30
_BLOCK = 256
_CELLS = 1 << 21
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_EDGES = "pid long, nid long, dist double"


def grow_tree(sample: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Directions and medians of a full median-split tree, nodes in heap order; one more direction is for slabs."""
    nodes = (1 << depth) - 1
    directions = rng.normal(size=(nodes + 1, sample.shape[1]))
    cuts, members = np.zeros(nodes), {0: np.arange(len(sample))}
    for i in range(nodes):
        own = members.pop(i)
        v = sample[own] @ directions[i]
        cuts[i] = np.median(v) if len(v) else 0.0
        members[2 * i + 1], members[2 * i + 2] = own[v <= cuts[i]], own[v > cuts[i]]
    return directions, cuts


def leaf_of(tree: tuple[np.ndarray, np.ndarray], x: np.ndarray, depth: int) -> np.ndarray:
    directions, cuts = tree
    at = np.zeros(len(x), np.int64)
    for _ in range(depth):
        at = 2 * at + 1 + ((x * directions[at]).sum(axis=1) > cuts[at])
    return at


def nearest_in(v: np.ndarray, pid: np.ndarray, k: int, bound: np.ndarray | None = None) -> pd.DataFrame:
    """The k nearest others of every row of ``v`` (pid, nid, dist), ties to the smaller id; with ``bound`` only
    those nearer than a row's bound."""
    m, found = min(k, len(v) - 1), []
    centre = v - v.mean(axis=0) if len(v) else v
    square = (centre * centre).sum(axis=1)
    for a in range(0, len(v) if m > 0 else 0, _BLOCK):
        own = np.arange(a, min(a + _BLOCK, len(v)))
        rough = np.maximum(square[own, None] + square[None, :] - 2 * centre[own] @ centre.T, 0)
        rough[own - a, own] = np.inf
        # The product rounds; what may be among the m nearest is measured by differences below.
        edge = np.partition(rough, m - 1, axis=1)[:, m - 1, None]
        if bound is not None:
            edge = np.minimum(edge, bound[own, None] ** 2)
        slack = 1e-12 * (square[own, None] + square.max())
        row, col = np.nonzero(rough <= edge + slack)
        dist = np.sqrt(((v[own[row]] - v[col]) ** 2).sum(axis=1))
        if bound is not None:
            near = dist < bound[own[row]]
            row, col, dist = row[near], col[near], dist[near]
        order = np.lexsort((pid[col], dist, row))
        row, col, dist = row[order], col[order], dist[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < m
        found.append(pd.DataFrame({"pid": pid[own[row[keep]]], "nid": pid[col[keep]], "dist": dist[keep]}))
    return pd.concat(found) if found else pd.DataFrame({"pid": [], "nid": [], "dist": []}).astype({"pid": "int64", "nid": "int64", "dist": "float64"})


def nearest_in_groups(v: np.ndarray, pid: np.ndarray, starts: np.ndarray, k: int, bound: np.ndarray) -> pd.DataFrame:
    """:func:`nearest_in` of every group of rows, group g from ``starts[g]`` up to ``starts[g + 1]``; groups of about
    equal size are compared together."""
    sizes, found, a = np.diff(starts), [], 0
    order = np.argsort(sizes, kind="stable")
    while a < len(order):
        b = a + 1
        while b < len(order) and (b + 1 - a) * sizes[order[b]] ** 2 <= _CELLS:
            b += 1
        first, size, m = starts[order[a:b]][:, None], sizes[order[a:b]][:, None], int(sizes[order[b - 1]])
        a, most = b, min(k, m - 1)
        if most < 1:
            continue
        real = np.arange(m) < size
        at = np.where(real, first + np.arange(m), first)
        centre = v[at] * real[:, :, None]
        centre = (centre - centre.sum(axis=1, keepdims=True) / size[:, :, None]) * real[:, :, None]
        square = (centre * centre).sum(axis=2)
        rough = np.maximum(square[:, :, None] + square[:, None, :] - 2 * centre @ centre.transpose(0, 2, 1), 0)
        rough[~np.broadcast_to(real[:, None, :], rough.shape)] = np.inf
        rough[:, np.arange(m), np.arange(m)] = np.inf
        edge = np.minimum(np.partition(rough, most - 1, axis=2)[:, :, most - 1, None], bound[at][:, :, None] ** 2)
        slack = 1e-12 * (square[:, :, None] + square.max(axis=1)[:, None, None])
        group, row, col = np.nonzero((rough <= edge + slack) & np.isfinite(rough) & real[:, :, None])
        own, other = at[group, row], at[group, col]
        dist = np.sqrt(((v[own] - v[other]) ** 2).sum(axis=1))
        near = dist < bound[own]
        own, other, dist = own[near], other[near], dist[near]
        placed = np.lexsort((pid[other], dist, own))
        own, other, dist = own[placed], other[placed], dist[placed]
        keep = np.arange(len(own)) - np.searchsorted(own, own) < most
        found.append(pd.DataFrame({"pid": pid[own[keep]], "nid": pid[other[keep]], "dist": dist[keep]}))
    return pd.concat(found) if found else pd.DataFrame({"pid": [], "nid": [], "dist": []}).astype({"pid": "int64", "nid": "int64", "dist": "float64"})


def _best(edges: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("pid").orderBy("dist", "nid"))
    return edges.dropDuplicates(["pid", "nid"]).withColumn("rank", rank).filter(F.col("rank") <= k)


def _leaf_edges(points: DataFrame, trees: list, depth: int, scale: np.ndarray, features: list[str], k: int, leaf_rows: int) -> DataFrame:
    shared = points.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("array<struct<leaf:long,along:double>>")
    def leaves(*cols: pd.Series) -> pd.Series:
        v = np.stack([c.to_numpy(float) for c in cols], axis=1) / scale
        at = [list(zip(leaf_of(t, v, depth).tolist(), (v @ t[0][-1]).tolist(), strict=True)) for t in shared.value]
        return pd.Series([[{"leaf": a, "along": b} for a, b in row] for row in zip(*at, strict=True)])

    placed = points.select("pid", *features, F.posexplode(leaves(*features)).alias("tree", "at"))
    place = F.row_number().over(Window.partitionBy("tree", "at.leaf").orderBy("at.along", "pid"))
    slab = F.floor((place - 1) / leaf_rows)
    placed = placed.select("pid", *features, "tree", F.col("at.leaf").alias("leaf"), slab.alias("slab"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        return nearest_in(pdf[features].to_numpy(float), pdf["pid"].to_numpy(), k)

    return placed.groupBy("tree", "leaf", "slab").applyInPandas(search, _EDGES)


def _refined(points: DataFrame, edges: DataFrame, features: list[str], k: int, n: int) -> DataFrame:
    """Edges found around the pivots of ``edges`` (pid, nid, dist, rank), nearer than the ``k``-th that a point has."""
    bound = edges.groupBy("pid").agg(F.when(F.count("*") >= k, F.max("dist")).alias("bound"))
    known = points.join(bound, "pid", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    around = edges.select(F.col("pid").alias("pivot"), F.col("nid").alias("pid")).union(
        edges.select(F.col("nid").alias("pivot"), "pid")).union(points.select(F.col("pid").alias("pivot"), "pid")).distinct()
    sizes = around.groupBy("pivot").agg(F.ceil(F.count("*") / GROUP_ROWS).alias("groups"))
    dealt = around.join(sizes, "pivot").select("pivot", F.pmod(F.xxhash64("pivot", "pid"), "groups").alias("group"), "pid")
    # A point is a member of up to 2k + 1 groups with all its features, so the members are far more than the points.
    slices = -(-(2 * k + 1) * n * 8 * (len(features) + 4) // SLICE_BYTES)
    if slices > 1:
        dealt, known = _written(dealt), _written(known)
    # A call for each pivot would cost far more than its comparisons: lots of whole groups, as many as the rows need.
    lots = -(-(2 * k + 1) * n // (LOT_ROWS * slices))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pivot", "group"], kind="stable")
        pivot, group = pdf["pivot"].to_numpy(), pdf["group"].to_numpy()
        ends = np.nonzero((pivot[1:] != pivot[:-1]) | (group[1:] != group[:-1]))[0] + 1
        return nearest_in_groups(pdf[features].to_numpy(float), pdf["pid"].to_numpy(), np.r_[0, ends, len(pdf)], k, pdf["bound"].to_numpy(float))

    def found(own: DataFrame) -> DataFrame:
        members = own.join(known, "pid").select("pivot", "group", "pid", "bound", *features)
        return members.withColumn("lot", F.pmod(F.xxhash64("pivot", "group"), F.lit(lots))).groupBy("lot").applyInPandas(search, _EDGES)

    if slices == 1:
        return found(dealt)
    part = F.pmod(F.xxhash64("pivot", "group", F.lit(1)), F.lit(slices))
    best = [_written(_best(found(dealt.filter(part == i)), k).drop("rank")) for i in range(slices)]
    return functools.reduce(DataFrame.union, best)


def nearest_points(points: DataFrame, features: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """k nearest other points of every point of ``points`` (pid, features): (pid, nid, dist, rank)."""
    n = points.count()
    sample = points.orderBy(F.xxhash64("pid"), "pid").limit(SAMPLE_ROWS).select(*features).toArrow()
    x = np.array([np.asarray(sample.column(f), float) for f in features]).T.reshape(-1, len(features))
    scale = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0) if len(x) else np.ones(len(features))
    # As deep as the sample has a few rows to place each cut; slabs do the rest.
    depth = max(0, min(math.ceil(math.log2(max(n, 1) / LEAF_ROWS)), int(math.log2(max(len(x) / 16, 1)))))
    rng = np.random.default_rng(seed)
    one = n <= LEAF_ROWS
    trees = [grow_tree(x / scale, depth, rng) for _ in range(1 if one else TREES)]
    keep = k if one else max(k, GRAPH)
    edges = _best(_leaf_edges(points, trees, depth, scale, features, keep, LEAF_ROWS), keep)
    if one:
        return edges
    edges = _written(edges)
    for _ in range(ROUNDS):
        after = _written(_best(edges.drop("rank").union(_refined(points, edges, features, keep, n)), keep))
        answer = F.col("rank") <= k
        new = after.filter(answer).join(edges.filter(answer), ["pid", "nid"], "left_anti").count()
        edges = after
        if new < SETTLED * k * n:
            break
    return edges.filter(F.col("rank") <= k)


def _written(df: DataFrame) -> DataFrame:
    """``df`` as a written table.  Nothing reads the shuffles of the write again, so their files go when it ends, not
    whenever the driver happens to collect its garbage: rounds would pile them up."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, f"smote/{uuid.uuid4().hex}")
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def smote(df: DataFrame, features: list[str], label: str = "label", keys: list[str] = ("row_id",),
          k: int = 5, seed: int = 42) -> DataFrame:
    """Original rows plus synthetic rows of every smaller class (``synthetic`` = 1), so that all
    classes have about the size of the largest."""
    # Written once: classes, neighbours and synthetic rows all read the same features.
    df = _written(df.select(*dict.fromkeys([*keys, *features, label])))
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}  # a row per class
    most = max(counts.values(), default=0)
    out = df.select(*features, label).withColumn("synthetic", F.lit(0))
    for cls in sorted((c for c, n in counts.items() if n < most and c is not None), key=str):
        out = out.unionByName(_synthetic(df.filter(F.col(label) == cls), features, label, cls, keys, k, seed,
                                         (most - counts[cls]) / counts[cls]))
    return out


def _synthetic(minority: DataFrame, features: list[str], label: str, cls, keys: list[str], k: int, seed: int,
               ratio: float) -> DataFrame:
    # A written table, not a checkpoint: that would keep pid = hash(features) as a constraint, which the
    # optimizer multiplies for every feature renamed below.
    distinct = _written(minority.select(*features).distinct().withColumn("pid", F.xxhash64(*features)))
    nn = nearest_points(distinct, features, k, seed)
    nvec = distinct.select(F.col("pid").alias("nid"), *[F.col(f).alias(f"n_{f}") for f in features])
    nb = nn.join(nvec, "nid").groupBy("pid").agg(
        F.array_sort(F.collect_list(F.struct("rank", *[f"n_{f}" for f in features]))).alias("nbrs"))
    rows = minority.withColumn("pid", F.xxhash64(*features)).join(nb, "pid", "left")
    whole, frac = int(ratio), ratio - int(ratio)
    reps = F.lit(whole) + (uniform(list(keys), seed) < F.lit(frac)).cast("int")
    syn = rows.filter(F.size("nbrs") > 0).withColumn("_reps", reps).filter(F.col("_reps") > 0) \
        .withColumn("_j", F.explode(F.sequence(F.lit(1), F.col("_reps"))))
    kj = F.concat_ws("|", *[F.col(c).cast("string") for c in keys], F.col("_j").cast("string"))
    u_pick = F.conv(F.substring(F.md5(F.concat(kj, F.lit("|pick"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    u_gap = F.conv(F.substring(F.md5(F.concat(kj, F.lit("|gap"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    nbr = F.element_at("nbrs", (F.floor(u_pick * F.size("nbrs")) + 1).cast("int"))
    return syn.select(*[(F.col(f) + u_gap * (nbr[f"n_{f}"] - F.col(f))).alias(f) for f in features],
                      F.lit(cls).cast(minority.schema[label].dataType).alias(label), F.lit(1).alias("synthetic"))
