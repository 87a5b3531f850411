"""The training-data pipeline over ``documents``: toxicity, line dedup, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows of the one before; all but the
last return the columns of ``documents``.  ``run`` writes each stage's result as Parquet in the
shared folder and reads it back for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorsight.llm import linededup, mixing, packing, queries, simhash, toxicity
from motorsight.llm.common import free_name, stage, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the character models don't predict toxic."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of three-line windows; n_chars follows a changed text."""
    removed = free_name(docs, "removed")
    out = linededup.dedup_lines(docs, removed_col=removed)
    n = F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", n).select(*docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs, queries.SIMHASH_SHINGLE, queries.SIMHASH_RADIUS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their source's target weight, shuffled."""
    copy, key = free_name(docs, "copy"), free_name(docs, "shuffle_key")
    return mixing.mix(docs, queries.MIX_WEIGHTS, queries.MIX_SEED, copy_col=copy, key_col=key).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents placed in sequences."""
    pieces = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), "byte", queries.BYTE_END_ID,
                                  queries.SEQUENCE_TOKENS)
    return packing.pack(pieces, queries.SEQUENCE_TOKENS)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash", simhash_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can't express the toxicity models; tests hold the stages against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
