"""Token ids as length-delimited binary records, with a separate offset index.

``write_records`` encodes documents and writes them in ascending ``doc_id`` order into
TFRecord-framed files::

    u64 length | u32 masked CRC-32C of the length | payload | u32 masked CRC-32C of the payload

A payload is one byte of id width (2 or 4), one byte that is 1 for a null ``doc_id``,
the ``doc_id`` (i64) and the ids, all little-endian.  The index is a Parquet table with
one row per record: file, offset and length of the frame, and the record's place in
the whole sequence of ids.  ``read_records`` reads any rows of the index, in any order,
and checks lengths and checksums.

Scale: one range shuffle of the texts by (doc_id, hash of the text), so that even one
doc_id on a third of all rows spreads over tasks; the place of each record comes from
counts per file (one row a file).  Recovery: a task writes a file of its own name and
hands its name on in index rows, which Spark commits; files of lost or repeated
attempts are in no index row and are never read.

Defined results: null text is empty (only the end id); null doc_ids come first; equal
doc_ids keep one record each, ordered by text; very long texts are encoded and framed whole (a frame
holds one document's ids, so they must fit in memory); an empty table gives an index without rows.  Only the id
and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop_folder, stage
from .tokens import WordEncoder, slices

INDEX_SCHEMA = "part long, file string, seq long, offset long, length long, doc_id long, local_start long, n_tokens long"
READ_AT_ONCE = 4 << 20
_BLOCK = 512
_MASK_DELTA = 0xA282EAD8


# --- CRC-32C over many byte strings at once ---------------------------------------

@lru_cache
def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0x82F63B78), t >> 1)
    return t


def _apply(op: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A linear map of CRC states, held as one table per byte of the state."""
    return op[0][v & 255] ^ op[1][(v >> 8) & 255] ^ op[2][(v >> 16) & 255] ^ op[3][v >> 24]


@lru_cache
def _zeros(power: int) -> np.ndarray:
    """The map of a state over 2**power zero bytes."""
    if power == 0:
        v = (np.arange(256, dtype=np.uint32)[None, :] << np.array([0, 8, 16, 24], np.uint32)[:, None])
        return _byte_table()[v & 255] ^ (v >> 8)
    half = _zeros(power - 1)
    return np.stack([_apply(half, row) for row in half])


def crc32c(parts: list[bytes]) -> np.ndarray:
    """CRC-32C of each byte string."""
    if not parts:
        return np.zeros(0, np.uint32)
    n = np.array([len(p) for p in parts], np.int64)
    blocks = np.maximum(1, -(-n // _BLOCK))
    # Zeros before a message do not change its checksum when the state starts at 0.
    padded = b"".join(x for p, k in zip(parts, blocks.tolist(), strict=True) for x in (bytes(k * _BLOCK - len(p)), p))
    columns = np.ascontiguousarray(np.frombuffer(padded, np.uint8).reshape(-1, _BLOCK).T)
    table, row = _byte_table(), np.zeros(int(blocks.sum()), np.uint32)
    for column in columns:
        row = table[(row ^ column) & 255] ^ (row >> 8)
    first = np.cumsum(blocks) - blocks
    order = np.argsort(-blocks, kind="stable")
    state, over = np.zeros(len(parts), np.uint32), _zeros(_BLOCK.bit_length() - 1)
    left = np.sort(-blocks)
    for i in range(int(blocks.max())):
        live = order[: np.searchsorted(left, -i, "left")]  # those with more than i blocks
        state[live] = _apply(over, state[live]) ^ row[first[live] + i]
    start = np.full(len(parts), 0xFFFFFFFF, np.uint32)
    for power in range(int(n.max()).bit_length()):
        on = (n >> power) & 1 == 1
        start[on] = _apply(_zeros(power), start[on])
    return state ^ start ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    """The rotated and shifted form in which a checksum is stored."""
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(_MASK_DELTA)


def frames(payloads: list[bytes]) -> list[bytes]:
    lengths = [len(p).to_bytes(8, "little") for p in payloads]
    heads, tails = masked(crc32c(lengths)).astype("<u4"), masked(crc32c(payloads)).astype("<u4")
    return [n + h.tobytes() + p + t.tobytes() for n, h, p, t in zip(lengths, heads, payloads, tails, strict=True)]


def unframe(blob: bytes, where: str) -> bytes:
    """The payload between a frame's lengths; checksums are checked by the caller, many at once."""
    n = int.from_bytes(blob[:8], "little")
    if len(blob) != n + 16:
        raise ValueError(f"{where}: the frame says {n} bytes and holds {len(blob) - 16}")
    return blob[12:-4]


def _verify(blobs: list[bytes], payloads: list[bytes], where: str) -> None:
    for parts, said in (([b[:8] for b in blobs], [b[8:12] for b in blobs]), (payloads, [b[-4:] for b in blobs])):
        if (masked(crc32c(parts)) != np.frombuffer(b"".join(said), "<u4")).any():
            raise ValueError(f"{where}: a checksum does not match")


# --- writing and reading ------------------------------------------------------------

def write_records(docs: DataFrame, folder: str, tokenizer: str, mode: str, end_id: int, width: int = 2,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write one record per row of ``docs`` under ``folder``; return its index, with
    ``start``: the number of ids in all records before it."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out, at, start, seq = WordEncoder(tokenizer, mode), None, 0, 0, 0
        end = end_id.to_bytes(width, "little")
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.tfrecord"
        try:
            for batch in batches:
                for piece in slices(batch, 1):
                    keys = piece.column(0).to_pylist()
                    ids = encoder.encode(piece.column(1))
                    blob = memoryview(ids.flat.astype(f"<u{width}").tobytes())
                    stop = (np.cumsum(ids.size) * width).tolist()
                    heads = [bytes((width, key is None)) + (key or 0).to_bytes(8, "little", signed=True) for key in keys]
                    found = frames([b"".join((h, blob[a:b], end)) for h, a, b in zip(heads, [0, *stop], stop)])
                    if out is None:
                        store, base = fs.FileSystem.from_uri(folder)
                        store.create_dir(f"{base}/data", recursive=True)
                        out = store.open_output_stream(f"{base}/data/{name}")
                    out.write(b"".join(found))
                    size = np.array([len(f) for f in found], np.int64)
                    count = ids.size + 1
                    rows = len(keys)
                    yield pa.RecordBatch.from_pydict({
                        "part": pa.array([part] * rows, pa.int64()), "file": pa.array([name] * rows),
                        "seq": pa.array(np.arange(seq, seq + rows)),
                        "offset": pa.array(at + np.cumsum(size) - size), "length": pa.array(size),
                        "doc_id": pa.array(keys, pa.int64()),
                        "local_start": pa.array(start + np.cumsum(count) - count), "n_tokens": pa.array(count)})
                    at, start, seq = at + int(size.sum()), start + int(count.sum()), seq + rows
        finally:
            if out is not None:
                out.close()

    local = stage(rows.mapInArrow(write, INDEX_SCHEMA), "records", f"{folder}/local")
    totals = local.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row a file: small beside the data at any size.
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    index = local.join(before, "part").withColumn("start", F.col("base") + F.col("local_start")).drop("base", "local_start")
    index = stage(index, "records", f"{folder}/index")
    drop_folder(spark, f"{folder}/local")
    return index


def open_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Rows of an index with their ids: doc_id, start, n_tokens, ids (little-endian u32 bytes).

    Takes the whole index or any part of it, such as a shuffled sample; neighbouring
    frames are read together, at most ``READ_AT_ONCE`` bytes at a time.
    """
    rows = index.select("file", "offset", "length", "doc_id", "start", "n_tokens")
    rows = rows.repartition("file", F.floor(F.col("offset") / F.lit(64 << 20))).sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        name, source = None, None
        try:
            for batch in batches:
                file, offset, length, key, start, count = (c.to_pylist() for c in batch.columns)
                i = 0
                while i < len(file):
                    j, size = i, 0
                    while j < len(file) and file[j] == file[i] and offset[j] == offset[i] + size and (j == i or size + length[j] <= READ_AT_ONCE):
                        size += length[j]
                        j += 1
                    if file[i] != name:
                        if source is not None:
                            source.close()
                        name = file[i]
                        source = store.open_input_file(f"{base}/data/{name}")
                    blob = source.read_at(size, offset[i])
                    blobs = [blob[offset[k] - offset[i]: offset[k] - offset[i] + length[k]] for k in range(i, j)]
                    payloads = [unframe(b, name) for b in blobs]
                    _verify(blobs, payloads, name)
                    ids = [np.frombuffer(p, f"<u{p[0]}", offset=10).astype("<u4").tobytes() for p in payloads]
                    found = [None if p[1] else int.from_bytes(p[2:10], "little", signed=True) for p in payloads]
                    if found != key[i:j] or [len(x) // 4 for x in ids] != count[i:j]:
                        raise ValueError(f"{name}: the index does not fit the records")
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(found, pa.int64()), "start": pa.array(start[i:j], pa.int64()),
                        "n_tokens": pa.array(count[i:j], pa.int64()), "ids": pa.array(ids, pa.binary())})
                    i = j
        finally:
            if source is not None:
                source.close()

    return rows.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
