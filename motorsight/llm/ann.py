"""Approximate nearest neighbours by learned partitions.

Fitting, on a bounded sample (``SAMPLE_ROWS`` vectors, in order of a hash): the graph of each
vector's nearest neighbours is cut into balanced parts by moving vectors to the part of most
of their neighbours while that part has room, and a small network (one hidden layer) learns
to tell a vector's part, with its neighbours' parts as soft targets (Dong et al.,
"Learning Space Partitions for Nearest Neighbor Search").  The number of parts that a query
looks into is the least that finds ``TARGET_RECALL`` of true neighbours among sample
vectors kept out of the training.

Two levels: the number of parts grows with the square root of the number of vectors.  Beyond ``MOST_PARTS``
every part is divided by a network of its own, fitted the same way in a task on at most ``PART_SAMPLE``
of its vectors, so no fit sees more than a bounded sample and a query's work grows with that square root.

Indexing: the networks give every vector its part.  Searching: a query goes to its most probable
parts (and within each to its most probable divisions), and to further ones until they hold enough
vectors; exact cosines rerank what is there.

Scale: parts are searched in blocks of ``BLOCK_ROWS`` vectors against blocks of
``BLOCK_QUERIES`` queries, one matrix product a group, so a part that grew large or
that many queries ask for spreads over tasks.  Equal vectors are stored once with their
least ids, as many as one answer can name, so copies are no hot key.  A group gives out a few rows a
query, never pairs.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take
no part, nor do rows without an id or of a length other than the most common one (the longer
of equally common ones); rows of one id are one candidate (the nearest of its vectors), and rows repeated whole
are one; an empty table gives no rows.  Only the id and vector columns are read, so other columns can't clash.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

SAMPLE_ROWS = 16_384
MOST_PARTS = 256
PART_SAMPLE = 4_096
VALIDATION_ROWS = 1_024
TARGET_RECALL = 0.97
GRAPH_NEIGHBOURS = 10
HIDDEN = 128
EPOCHS = 15
SLACK = 1.1
BLOCK_ROWS = 8_192
BLOCK_QUERIES = 4_096
QUERIES_AT_ONCE = 512


# --- fitting ---------------------------------------------------------------------------------

def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def nearest(queries: np.ndarray, rows: np.ndarray, k: int, skip_self: bool) -> np.ndarray:
    """Indices of the k rows of largest product with each query, in blocks."""
    out = np.empty((len(queries), k), np.int64)
    for a in range(0, len(queries), QUERIES_AT_ONCE):
        s = queries[a: a + QUERIES_AT_ONCE] @ rows.T
        if skip_self:
            s[np.arange(len(s)), a + np.arange(len(s))] = -np.inf
        out[a: a + len(s)] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, x: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """A part for each vertex of a neighbour graph: seeded by nearest centres, then moved toward
    most neighbours, never beyond SLACK times the mean size of a part."""
    n, room = len(x), math.ceil(SLACK * len(x) / parts)
    centres = x[rng.choice(n, parts, replace=False)]
    part = np.zeros(n, np.int64)
    for _ in range(4):
        order = np.argsort(-(x @ centres.T), axis=1)
        size = np.zeros(parts, np.int64)
        for v in rng.permutation(n):
            free = order[v][size[order[v]] < room]
            part[v] = free[0]
            size[free[0]] += 1
        total = np.zeros_like(centres)
        np.add.at(total, part, x)
        centres = total / np.maximum(np.sqrt((total * total).sum(axis=1, keepdims=True)), 1e-12)
    for _ in range(rounds):
        moved = 0
        for v in rng.permutation(n):
            votes = np.bincount(part[graph[v]], minlength=parts)
            best = int(np.argmax(np.where(size < room, votes, -1)))
            if votes[best] > votes[part[v]]:
                size[part[v]] -= 1
                size[best] += 1
                part[v] = best
                moved += 1
        if moved < n // 200:
            break
    return part


@dataclass
class Router:
    """The network, and how many parts a query looks into."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    @property
    def parts(self) -> int:
        return self.w2.shape[1]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def train(x: np.ndarray, target: np.ndarray, rng: np.random.Generator) -> Router:
    """Cross-entropy to soft targets, by Adam on small batches."""
    d, parts = x.shape[1], target.shape[1]
    p = [rng.normal(0, math.sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN),
         rng.normal(0, math.sqrt(1 / HIDDEN), (HIDDEN, parts)), np.zeros(parts)]
    m, v, t = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 128):
            rows = order[a: a + 128]
            h = np.maximum(x[rows] @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            z -= z.max(axis=1, keepdims=True)
            e = np.exp(z)
            g = (e / e.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
            gh = (g @ p[2].T) * (h > 0)
            grads, t = (x[rows].T @ gh, gh.sum(axis=0), h.T @ g, g.sum(axis=0)), t + 1
            for i, grad in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad * grad
                p[i] = p[i] - 3e-3 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Router(*p)


def fit(sample: np.ndarray, parts: int, k: int, seed: int = 17) -> Router:
    """A router over ``parts`` parts, fitted on distinct vectors."""
    rng, x = np.random.default_rng(seed), unit(sample.astype(np.float64))
    d = x.shape[1]
    if parts < 2 or len(x) < 8 * parts:
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    held = min(VALIDATION_ROWS, len(x) // 8)
    known, asked = x[held:], x[:held]
    graph = nearest(known, known, min(GRAPH_NEIGHBOURS, len(known) - 1), True)
    part = balanced_parts(graph, known, parts, rng)
    target = np.zeros((len(known), parts))
    target[np.arange(len(known)), part] = 0.5
    np.add.at(target, (np.repeat(np.arange(len(known)), graph.shape[1]), part[graph].ravel()), 0.5 / graph.shape[1])
    router = train(known, target, rng)
    own = router.logits(known).argmax(axis=1)
    ranks = np.argsort(np.argsort(-router.logits(asked), axis=1), axis=1)
    true = nearest(asked, known, min(k, len(known)), False)
    need = np.take_along_axis(ranks, own[true], axis=1).ravel()
    router.probes = int(np.quantile(need, TARGET_RECALL, method="higher")) + 1
    return router


# --- index and search ----------------------------------------------------------------------------

def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows (vec_id, v) that take part."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).filter(~odd).filter(norm > 0)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.filter(F.size("v") == (sizes.d if sizes else 0))


def _divisions(placed: DataFrame, divisions: int, k: int) -> dict[int, Router]:
    """A router for each part over ``divisions`` divisions, fitted in a task on at most PART_SAMPLE of its vectors."""
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.xxhash64("v"), "v"))
    some = placed.select("part", "v").withColumn("place", place).filter(F.col("place") <= PART_SAMPLE)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        router = fit(_stack(pdf["v"]), divisions, k)
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "router": [pickle.dumps(router)]})

    found = some.select("part", "v").groupBy("part").applyInPandas(run, "part int, router binary")
    return {r["part"]: pickle.loads(r["router"]) for r in found.collect()}  # at most MOST_PARTS, of a fixed size


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy())


def search(vectors: DataFrame, k: int, is_query, id_col: str = "vec_id", vector_col: str = "embedding",
           parts: int | None = None) -> DataFrame:
    """The ``k`` nearest other rows of each row for which ``is_query`` (a column over ``vec_id``) holds:
    (query_id, rank, vec_id, score)."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    # Repeated rows go first, so that a vector's window holds k + 1 rows of each task at most.
    ranked = rows.distinct().withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("place") <= k + 1)
    distinct = stage(ranked.groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")), "vectors")
    n = distinct.count()
    queries = rows.filter(is_query).distinct()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    parts = parts or max(1, 2 ** round(math.log2(max(math.sqrt(n) / 2, 1))))
    first = min(parts, MOST_PARTS)
    sample = distinct.orderBy(F.xxhash64("v"), "v").limit(SAMPLE_ROWS).select("v").toArrow()
    sample = np.asarray(sample.column("v").combine_chunks().flatten()).reshape(sample.num_rows, -1)
    shared = spark.sparkContext.broadcast(fit(sample, first, k))

    @F.pandas_udf("int")
    def part_of(v: pd.Series) -> pd.Series:
        return pd.Series(shared.value.logits(unit(_stack(v))).argmax(axis=1).astype(np.int32))

    placed = distinct.withColumn("part", part_of("v"))
    if parts > first:
        placed = stage(placed, "placed")
        inner = spark.sparkContext.broadcast(_divisions(placed, min(parts // first, MOST_PARTS), k))
    else:
        inner = spark.sparkContext.broadcast({})

    @F.pandas_udf("int")
    def division_of(v: pd.Series, part: pd.Series) -> pd.Series:
        out = np.zeros(len(v), np.int32)
        for p, at in part.groupby(part).indices.items():
            if p in inner.value:
                out[at] = inner.value[p].logits(unit(_stack(v.iloc[at]))).argmax(axis=1)
        return pd.Series(out)

    division = division_of("v", "part") if parts > first else F.lit(0)
    indexed = stage(placed.withColumn("division", division), "index")
    sizes = stage(indexed.groupBy("part", "division").agg(F.count("*").alias("held")), "sizes")  # a row per part and division
    found = {(r["part"], r["division"]): r["held"] for r in sizes.collect()}
    held = np.array([sum(found.get((p, d), 0) for d in range(MOST_PARTS if inner.value else 1)) for p in range(shared.value.parts)])

    @F.pandas_udf("array<struct<part:int,division:int>>")
    def parts_of(v: pd.Series) -> pd.Series:
        x, r = unit(_stack(v)), shared.value
        order = np.argsort(-r.logits(x), axis=1, kind="stable")
        enough = np.cumsum(held[order], axis=1) >= k + 1  # one of them is the query itself
        last = np.where(enough.any(axis=1), enough.argmax(axis=1) + 1, r.parts)
        wanted = [o[: max(r.probes, m)].tolist() for o, m in zip(order, last, strict=True)]
        out = [[] for _ in wanted]
        for p in sorted({p for ps in wanted for p in ps}):
            at = [i for i, ps in enumerate(wanted) if p in ps]
            own = inner.value.get(p)
            near = np.argsort(-own.logits(x[at]), axis=1, kind="stable") if own else np.zeros((len(at), 1), np.int64)
            inside = np.cumsum(np.array([found.get((p, d), 0) for d in range(own.parts if own else 1)])[near], axis=1)
            for i, ds, have in zip(at, near, inside, strict=True):
                full = int(np.searchsorted(have, min(k + 1, have[-1]))) + 1
                out[i] += [{"part": p, "division": int(d)} for d in ds[: max(own.probes if own else 1, full)]]
        return pd.Series(out)

    routed = queries.select("vec_id", "v", F.explode(parts_of("v")).alias("at")).select("vec_id", "v", "at.part", "at.division")
    routed = stage(routed, "routed")
    asked = routed.groupBy("part", "division").agg(F.count("*").alias("asked"))
    groups = sizes.join(asked, ["part", "division"]).select(
        "part", "division", F.ceil(F.col("held") / BLOCK_ROWS).cast("int").alias("blocks"),
        F.ceil(F.col("asked") / BLOCK_QUERIES).cast("int").alias("turns"))
    groups = stage(groups, "groups")
    least = F.element_at("ids", 1)
    left = indexed.join(groups, ["part", "division"]).withColumn("block", F.pmod(F.xxhash64(least), F.col("blocks")).cast("int")).withColumn(
        "turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    right = routed.join(groups, ["part", "division"]).withColumn("turn", F.pmod(F.xxhash64("vec_id", "v"), F.col("turns")).cast("int")).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def rerank(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        if len(rows) and len(asked):
            x, q = _stack(rows["v"]), _stack(asked["v"])
            ids, qids = rows["ids"].to_numpy(), asked["vec_id"].to_numpy()
            xn, qn = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
            m = min(k + 1, len(x))
            for a in range(0, len(q), QUERIES_AT_ONCE):
                near = (q[a: a + QUERIES_AT_ONCE] / qn[a: a + QUERIES_AT_ONCE, None]) @ (x / xn[:, None]).T
                edge = -np.partition(-near, m - 1, axis=1)[:, m - 1]
                for i, (row, low) in enumerate(zip(near, edge, strict=True), a):
                    # All that rounding might put among the first, measured one by one.
                    c = np.flatnonzero(row >= low - 1e-9)
                    score = (x[c] * q[i]).sum(axis=1) / (xn[c] * qn[i])
                    order = sorted(range(len(c)), key=lambda j: (-score[j], ids[c[j]][0]))[: k + 1]
                    found += [(qids[i], int(y), score[j]) for j in order for y in ids[c[j]] if y != qids[i]]
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    group = ["part", "division", "block", "turn"]
    pairs = left.select(*group, "v", "ids").groupBy(*group).cogroup(right.select(*group, "v", "vec_id").groupBy(*group)).applyInPandas(
        rerank, "query_id long, vec_id long, score double")
    pairs = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
