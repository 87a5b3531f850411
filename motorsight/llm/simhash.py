"""SimHash near-duplicates by covering locality-sensitive hashing.

A document's fingerprint has 64 bits, each the majority of that bit over the XXH64
hashes of its word shingles.  Fingerprints within ``radius`` differing bits are linked.

Covering masks (Pagh, "CoveringLSH"): every bit position gets a non-zero vector of
radius + 1 bits; for every non-zero v, mask v keeps the positions whose vector has an odd
product with v.  The vectors of ``radius`` differing positions span at most ``radius``
dimensions, so some v is orthogonal to all of them and its mask keeps none of these
positions: each pair within the radius has equal masked fingerprints in some table.  No
pair is missed, and pairs are confirmed by counting differing bits.

Scale: only distinct fingerprints are compared, so copies cost nothing.  Rows are dealt by
(table, masked bits) and read in sorted runs.  A run of up to ``RUN_ROWS`` distinct
fingerprints is searched in its task, which gives out one link per fingerprint that joins
a group, never all pairs.  A longer run is not kept: its rows go to a further round, dealt
by the same bits and one of radius + 1 blocks of the open bits (of which a linked pair has
one in common).  After ``ROUNDS`` rounds so few bits are open that a run is bounded by them.
Components are found by ``graph.components`` over links between fingerprints.

Defined results: null and empty texts, and texts without a word, have fingerprint 0 and
link like any other; repeated rows and equal doc_ids stay rows of their own; a component of
rows without any doc_id has id null; very long texts are read whole, their shingles counted in blocks; an
empty table gives no rows.  Helper columns get free names, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, stage
from .graph import components

BITS = 64
SEED = 42
RUN_ROWS = 4096
ROUNDS = 3


# --- fingerprints --------------------------------------------------------------------

def simhash(text: str | None, shingle: int) -> int:
    """Unsigned fingerprint: A-Z lower-cased, words between ASCII white space, all shingles counted."""
    words = (text or "").encode().lower().split()  # on bytes both act on ASCII alone
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        grams = [joined]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        grams = [joined[a:b] for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist(), strict=True)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, len(grams)).astype("<u8")
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(grams), 1 << 16):
        bits = np.unpackbits(hashes[k: k + (1 << 16)].view(np.uint8), bitorder="little").reshape(-1, BITS)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(grams), bitorder="little").view("<u8")[0])


def fingerprint(text: Column | str, shingle: int) -> Column:
    """The fingerprint as a long (its bits, read as signed)."""
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t, shingle) for t in texts], np.uint64).view(np.int64))

    return of(text)


# --- links -----------------------------------------------------------------------------

def _product(a: int, b: int) -> int:
    return (a & b).bit_count() & 1


def covering_masks(radius: int) -> list[int]:
    """One mask for each non-zero v of radius + 1 bits."""
    full = (1 << (radius + 1)) - 1
    vectors = [i % full + 1 for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if _product(vectors[i], v)) for v in range(1, full + 1)]


def narrower(masks: list[int], radius: int) -> list[int]:
    """For each mask, radius + 1 masks that also keep one block of its open positions."""
    out = []
    for mask in masks:
        free = [i for i in range(BITS) if not mask >> i & 1]
        out += [mask | sum(1 << i for i in free[b:: radius + 1]) for b in range(radius + 1)]
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def run_links(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (first member, other member) that join the groups within ``radius`` of a run of
    distinct fingerprints; a search from each group's first member, no pair table."""
    heads, tails = [], []
    rest = values
    while len(rest) > 1:
        head, rest = rest[0], rest[1:]
        queue = [head]
        while queue and len(rest):
            near = np.bitwise_count(rest ^ queue.pop()) <= radius
            if near.any():
                found, rest = rest[near], rest[~near]
                queue += list(found)
                heads.append(np.full(len(found), head))
                tails.append(found)
    empty = np.zeros(0, np.uint64)
    return (np.concatenate(heads), np.concatenate(tails)) if heads else (empty, empty)


def _search(radius: int, keep_long: bool):
    """Arrow function over rows (tab, key, fp) sorted so: links (a, b, long=false), and for runs over
    RUN_ROWS, unless ``keep_long``, their rows (a=table, b=fp, long=true)."""
    def out(a, b, flag):
        return pa.RecordBatch.from_pydict({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64)),
                                           "again": pa.array(np.full(len(a), flag))})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept, size, spilled = None, [], 0, False

        def close():
            if size > 1 and not spilled:
                a, b = run_links(np.concatenate(kept), radius)
                if len(a):
                    yield out(a, b, False)

        for batch in batches:
            tab, key, fp = (np.asarray(c) for c in batch.columns)
            fp = fp.view(np.uint64)
            if not len(fp):
                continue
            cuts = np.flatnonzero((tab[1:] != tab[:-1]) | (key[1:] != key[:-1])) + 1
            bounds = np.concatenate(([0], cuts, [len(fp)]))
            sizes = np.diff(bounds)
            # Runs inside the batch with one row need no look; the first and last may go on elsewhere.
            look = np.flatnonzero(sizes > 1)
            for r in sorted({0, len(sizes) - 1, *look.tolist()}):
                a, b = int(bounds[r]), int(bounds[r + 1])
                at = (int(tab[a]), int(key[a]))
                if at != last:
                    yield from close()
                    last, kept, size, spilled = at, [], 0, False
                size += b - a
                if spilled:
                    yield out(np.full(b - a, at[0], np.int64), fp[a:b], True)
                    continue
                kept.append(fp[a:b])
                if size > RUN_ROWS and not keep_long:
                    rows = np.concatenate(kept)
                    yield out(np.full(len(rows), at[0], np.int64), rows, True)
                    kept, spilled = [], True
        yield from close()

    return search


def links(fps: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column ``fp``) that join everything within
    ``radius`` differing bits."""
    masks = covering_masks(radius)
    rows = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(t).cast("long").alias("tab"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key"))
        for t, m in enumerate(masks)])).alias("t")).select("t.tab", "t.key", "fp")
    found = None
    for level in range(ROUNDS):
        dealt = rows.repartition("tab", "key").sortWithinPartitions("tab", "key", "fp")
        done = stage(dealt.mapInArrow(_search(radius, level == ROUNDS - 1), "a long, b long, again boolean"), "bits")
        part = done.filter("not again").select("a", "b")
        found = part if found is None else found.union(part)
        again = done.filter("again")
        if level == ROUNDS - 1 or again.isEmpty():
            break
        # Row (table, fp) goes to the blocks below its table's mask.
        masks, k = narrower(masks, radius), radius + 1
        table = F.array(*[F.lit(_signed(m)) for m in masks])
        rows = again.select("b", F.explode(F.sequence(F.col("a") * k, F.col("a") * k + k - 1)).alias("tab"))
        rows = rows.select("tab", F.col("b").bitwiseAND(F.get(table, F.col("tab").cast("int"))).alias("key"), F.col("b").alias("fp"))
    return found


def fingerprint_groups(fps: DataFrame, radius: int) -> DataFrame:
    """Rows (fp, root): the component of each distinct fingerprint in column ``fp``."""
    distinct = fps.select("fp").distinct()
    roots = components(links(distinct, radius))
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


# --- documents ---------------------------------------------------------------------------

def near_duplicates(docs: DataFrame, shingle: int, radius: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id with ``fingerprint`` (16 hex digits) and ``component_id``, the least id linked to it."""
    each = stage(docs.select(F.col(id_col).alias("doc_id"), fingerprint(text_col, shingle).alias("fp")), "fingerprints")
    least = each.groupBy("fp").agg(F.min("doc_id").alias("least"))
    groups = stage(fingerprint_groups(least, radius), "groups")
    ids = groups.join(least, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = groups.join(ids, "root").select("fp", "component_id")
    return each.join(by_fp, "fp").select(
        F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int, radius: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one row left of each component: that with the least id (null ids last)."""
    fp, rid = free_name(docs, "fp"), free_name(docs, "rid")
    rows = stage(docs.withColumn(fp, fingerprint(text_col, shingle)).withColumn(rid, F.monotonically_increasing_id()), "rows")
    small = rows.select(F.col(fp).alias("fp"), F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"),
                                                        F.col(rid).alias("rid")).alias("key"))
    least = small.groupBy("fp").agg(F.min("key").alias("key"))
    groups = stage(fingerprint_groups(least, radius), "groups")
    winners = groups.join(least, "fp").groupBy("root").agg(F.min("key").alias("key")).select(F.col("key.rid").alias(rid))
    return rows.join(winners, rid, "left_semi").select(*docs.columns)
