"""Connected components of a large link table, by alternating large and small stars.

Each round every node hands the least node that it knows to its neighbours (Kiveris et
al., "Connected Components in MapReduce and Beyond").  Links shrink to one star per
component in a few rounds; each round is written to the shared folder, so lineage stays
short.  Joins run on the node: a node with very many links is a skewed join key, which
adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_folder, new_folder, stage


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of ``links`` (a, b: long) but the roots themselves;
    a root is its component's least node.  Links to oneself, repeated and null ones are harmless."""
    spark = links.sparkSession
    path = new_folder(spark, "links")
    links = stage(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
                  "links", path)
    mark = _mark(links)
    while mark[0]:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = new_folder(spark, "links")
        links = stage(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links", after)
        drop_folder(spark, path)
        path, before, mark = after, mark, _mark(links)
        if mark == before:
            break
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
