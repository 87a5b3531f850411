"""Mixing sources to target weights by Poisson replication.

Every source has a target share of the mix.  Its mean repetition rate is

    rate = epochs x share x (size of all) / (size of the source),

size being characters, or any long column.  A document's number of copies is the inverse of
the Poisson distribution with that mean at a uniform number made from a hash of (seed, id), so it
is the same in every run.  Copies are exploded and dealt out by a hash of (seed, id, copy) over
all partitions, in hash order within each.

Rates above ``STEP`` are cut into equal parts that are inverted one by one and added (a sum
of Poisson counts is a Poisson count); so a table of at most ``TABLE`` probabilities per
source is enough at any rate.

Scale: one narrow aggregation per source, and the shuffle that the mix asks for, after the
copies are made.  Rates meet documents by a broadcast join while there are at most
``BROADCAST_SOURCES`` sources, by a shuffle join beyond.  The global shuffle is on a hash of id
and copy, so a hot source or a document copied often spreads evenly.

Defined results: sources without a given weight have the weight ``default``; a null source is a
source of its own, named by ``None`` in the weights; a weight of 0 drops a source; null texts have
size 0; a source of size 0 keeps one copy of each row (its rate is undefined); a null id
is hashed as the text "null"; rows repeated under one id get the same number of copies
each; texts count by their whole length, whatever it is; an empty table gives no rows.  Where an input column
has the name of a result column (``copy``, ``shuffle_key``) or of a helper, the new one gets underscores
in front.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

STEP = 16.0
#: Poisson probabilities of more than this many copies at mean STEP are below 2**-53.
TABLE = 96
BROADCAST_SOURCES = 100_000


def hash_long(*parts: Column) -> Column:
    """52 bits of an md5 over the parts, as a long."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def uniform(*parts: Column) -> Column:
    return hash_long(*parts) / F.lit(float(1 << 52))


def poisson_table(mean: Column) -> Column:
    """P(count <= k) for k from 0 to TABLE - 1."""
    first = F.exp(-mean)
    zero = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all"))

    def step(t, k):
        p = t["p"] * mean / k
        c = t["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.concat(t["all"], F.array(c)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TABLE - 1)), zero, step)["all"]


def rates(docs: DataFrame, weights: dict[str | None, float], default: float = 1.0, epochs: float = 1.0,
          source_col: str = "source", size: Column | None = None, text_col: str = "text") -> DataFrame:
    """Rows (source, size, rate), one per source."""
    size = F.coalesce(F.length(text_col) if size is None else size, F.lit(0)).cast("long")
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(size).alias("size"))
    weight = F.lit(float(default))
    for name, w in weights.items():  # as many as the caller names
        weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    sizes = sizes.withColumn("weight", weight)
    total = sizes.agg(F.sum("size").alias("s"), F.sum("weight").alias("w")).first()
    if not total.s:
        return sizes.select("source", "size", F.lit(1.0).alias("rate"))
    rate = F.when(F.col("size") > 0, F.lit(float(epochs) * total.s / (total.w or 1.0)) * F.col("weight") / F.col("size")).otherwise(1.0)
    return sizes.select("source", "size", rate.alias("rate"))


def mix(docs: DataFrame, weights: dict[str | None, float], seed: int, default: float = 1.0, epochs: float = 1.0,
        id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", size: Column | None = None,
        copy_col: str = "copy", key_col: str = "shuffle_key") -> DataFrame:
    """The mixed ``docs``, shuffled, with ``copy`` (from 0) and ``shuffle_key``, under free names."""
    copy_col, key_col = free_name(docs, copy_col), free_name(docs, key_col)
    table = rates(docs, weights, default, epochs, source_col, size, text_col)
    source, steps, chances, n = (free_name(docs, x) for x in ("mix_source", "mix_steps", "mix_chances", "mix_n"))
    table = table.withColumn(steps, F.greatest(F.ceil(F.col("rate") / STEP), F.lit(1)).cast("int"))
    table = table.select(F.col("source").alias(source), steps, F.when(
        F.col("size") > 0, poisson_table(F.col("rate") / F.col(steps))).alias(chances))
    if table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    rows = docs.join(table, F.col(source_col).eqNullSafe(F.col(source)))

    def draw(i: Column) -> Column:
        u = uniform(F.lit(seed), F.col(id_col), i)
        return F.size(F.filter(F.col(chances), lambda c: c <= u))

    count = F.aggregate(F.sequence(F.lit(1), F.col(steps)), F.lit(0), lambda t, i: t + draw(i))
    rows = rows.withColumn(n, F.when(F.col(chances).isNull(), 1).otherwise(count)).filter(F.col(n) > 0)
    rows = rows.select(*docs.columns, F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(copy_col))
    rows = rows.withColumn(key_col, hash_long(F.lit(f"{seed}s"), F.col(id_col), F.col(copy_col)))
    return rows.repartition(key_col).sortWithinPartitions(key_col, id_col, copy_col)


def draw_plainly(seed: int, key, rate: float) -> int:
    """The number of copies of one document, step by step (for checks)."""
    import math

    steps = max(math.ceil(rate / STEP), 1)
    total = 0
    for i in range(1, steps + 1):
        name = f"{seed}|{'null' if key is None else key}|{i}"
        u = int(hashlib.md5(name.encode()).hexdigest()[:13], 16) / 2**52
        p = c = math.exp(-rate / steps)
        k = 0
        while c <= u and k < TABLE - 1:
            k += 1
            p *= rate / steps / k
            c += p
        total += k if c > u else TABLE
    return total
