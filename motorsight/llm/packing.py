"""Best-fit packing of tokenized documents into sequences of a fixed capacity.

Large-item matching: pieces above one third of the capacity go at most two to a
sequence, matched greedily (the longest with the longest partner that still fits);
smaller pieces, longest first, go where the remaining gap fits best.

Pieces of one length are interchangeable, so the plan is made on the histogram of
lengths (at most ``capacity`` rows at any input size) and moves whole runs of equal
sequences at a time.  Every piece then looks its place up by (length, rank among
pieces of that length).

Scale: tokenizing needs no shuffle.  Ranks come from counts per (length, chunk), where a
chunk is a run of row numbers, so a length that holds a third of all rows spreads over
many tasks; only narrow rows are shuffled.  The plan is bounded: a step either uses up a
length or shrinks the gap of a whole run below the current length, so there are at most
about 3 x capacity runs of sequences and, per run, as many steps as distinct lengths
that add up to one gap (under 2 x sqrt(capacity)).  It is broadcast as arrays.

Defined results: null and empty text is an empty document (one id, the end id); repeated rows
and equal doc_ids are packed row by row; very long texts are tokenized whole and only their ids cut; an
empty table gives no sequences.  All columns of ``pieces`` go along in a struct, so none can clash with a helper;
one named ``sequence_id`` or ``offset`` raises an error, since its result would be hidden.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage
from .tokens import WordEncoder, slices

#: Rows of one length and chunk that one window group holds, at most.
CHUNK_ROWS = 1 << 16


def token_pieces(docs: DataFrame, tokenizer: str, mode: str, end_id: int, capacity: int,
                 id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and its end id,
    cut into pieces of ``capacity`` where longer; the first piece takes the remainder."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = WordEncoder(tokenizer, mode), end_id.to_bytes(4, "little")
        for batch in batches:
            for part in slices(batch, 1):
                ids = encoder.encode(part.column(1))
                blob, stop = ids.flat.astype("<u4").tobytes(), (4 * np.cumsum(ids.size)).tolist()
                doc, piece, start, length, blobs = [], [], [], [], []
                for key, first, last in zip(part.column(0).to_pylist(), [0, *stop], stop):
                    x = blob[first:last] + end
                    n = len(x) // 4
                    a, b, i = 0, n % capacity or min(n, capacity), 0
                    while a < n:
                        doc.append(key), piece.append(i), start.append(a), length.append(b - a)
                        blobs.append(x[4 * a: 4 * b])
                        a, b, i = b, b + capacity, i + 1
                out = {"doc_id": pa.array(doc, pa.int64()), "piece": pa.array(piece, pa.int32()),
                       "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()),
                       "ids_crc32": pa.array([zlib.crc32(x) for x in blobs], pa.int64())}
                yield pa.RecordBatch.from_pydict(out | ({"ids": pa.array(blobs, pa.binary())} if with_ids else {}))

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return rows.mapInArrow(cut, schema)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Steps (length, first rank, rows, rows per sequence, first sequence, offset) for pieces
    counted by length.  The rank-r row of a step goes to sequence first + (r - first rank) // per,
    at offset + (r - first rank) % per * length."""
    left = {n: c for n, c in counts.items() if c}
    taken = dict.fromkeys(left, 0)
    steps: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, number of sequences)
    made = 0

    def put(length: int, rows: int, per: int, sequence: int, offset: int) -> None:
        steps.append((length, taken[length], rows, per, sequence, offset))
        taken[length] += rows
        left[length] -= rows
        if not left[length]:
            del left[length]

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while n in left:
            partner = next((m for m in large if m <= min(n, capacity - n) and m in left and (m < n or left[n] > 1)), None)
            k = left[n] if partner is None else left[n] // 2 if partner == n else min(left[n], left[partner])
            put(n, k, 1, made, 0)
            if partner is not None:
                put(partner, k, 1, made, n)
            gaps.setdefault(capacity - n - (partner or 0), []).append((made, k))
            made += k
    for n in sorted(left, reverse=True):
        while n in left:
            gap = min((g for g in gaps if g >= n), default=None)
            if gap is None:
                gap, per = capacity, capacity // n
                first, many = made, -(-left[n] // per)
                made += many
            else:
                per = gap // n
                first, many = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
            full = min(many, left[n] // per)
            if full:
                put(n, full * per, per, first, capacity - gap)
                gaps.setdefault(gap - per * n, []).append((first, full))
            if full < many:  # the last rows of this length share one sequence, the rest of the run stays
                rest = left.get(n, 0)
                if rest:
                    put(n, rest, rest, first + full, capacity - gap)
                    gaps.setdefault(gap - rest * n, []).append((first + full, 1))
                    full += 1
                if full < many:
                    gaps.setdefault(gap, []).append((first + full, many - full))
    return steps


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Give each row of ``pieces`` (with a long column ``length`` from 1 to ``capacity``) its
    ``sequence_id`` and ``offset``; all other columns stay as they are.

    ``pieces`` is written to the shared folder first, with row numbers, so that ranks
    and plan are made on the same rows whatever is lost later.
    """
    spark = pieces.sparkSession
    names = pieces.columns
    if {"sequence_id", "offset"} & {n.lower() for n in names}:
        raise ValueError("the pieces have a column named sequence_id or offset already")
    rows = stage(pieces.select(F.struct(*names).alias("row"), F.col("length"),
                               F.monotonically_increasing_id().alias("rid")), "pieces")
    counts = {int(n): int(c) for n, c in rows.groupBy("length").count().collect()}  # at most ``capacity`` rows
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError("a piece has no length from 1 to the capacity")
    steps = plan(counts, capacity)
    array = np.array(steps or [(0, 0, 0, 1, 0, 0)], np.int64)
    array = array[np.lexsort((array[:, 1], array[:, 0]))]
    # (length, rank) in one ordered number: as many bits for ranks as the most common length needs.
    bits = max(counts.values(), default=0).bit_length()
    if capacity.bit_length() + bits > 63:
        raise ValueError("lengths and ranks don't fit one long")
    shared = spark.sparkContext.broadcast(array)

    # Row numbers are (task << 33) + place, so a chunk of them never mixes tasks.
    chunks = rows.withColumn("chunk", F.shiftright("rid", CHUNK_ROWS.bit_length() - 1))
    per_chunk = chunks.groupBy("length", "chunk").count()
    before = per_chunk.select("length", "chunk", (F.sum("count").over(
        Window.partitionBy("length").orderBy("chunk")) - F.col("count")).alias("before"))
    ranked = chunks.withColumn("place", F.row_number().over(Window.partitionBy("length", "chunk").orderBy("rid")))
    ranked = ranked.join(before, ["length", "chunk"]).select(
        "row", "length", (F.col("before") + F.col("place") - 1).cast("long").alias("rank"))

    @F.pandas_udf("sequence_id long, offset long")
    def look_up(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        p = shared.value
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = np.searchsorted((p[:, 0] << bits) + p[:, 1], (n << bits) + r, "right") - 1
        step, i = p[at], r - p[at, 1]
        return pd.DataFrame({"sequence_id": step[:, 4] + i // step[:, 3], "offset": step[:, 5] + i % step[:, 3] * n})

    look_up = look_up.asNondeterministic()  # evaluated once a row, not once per field read from it
    placed = ranked.withColumn("at", look_up("length", "rank"))
    return placed.select("row.*", "at.sequence_id", "at.offset")


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, ids (little-endian u32) and the pieces in them.
    ``placed`` has the pieces' ``ids``; a group holds at most ``capacity`` ids."""
    each = F.struct("offset", "ids", "doc_id", "piece", "length")
    packed = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(each)).alias("parts"))
    joined = F.aggregate(F.col("parts.ids"), F.lit(b""), lambda a, x: F.concat(a, x))
    return packed.select("sequence_id", joined.alias("ids"),
                         F.transform("parts", lambda x: x.dropFields("ids")).alias("pieces"))
