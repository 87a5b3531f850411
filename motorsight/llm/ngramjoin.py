"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

A document's row of the matrix is its set of distinct word n-grams.  Two documents are linked when
100 * overlap >= percent * union, so their overlap must reach ``percent * (a + b) / (100 + percent)``
of their sizes a and b.  Entries of the product that can't reach that bound are discarded as early
as possible, all by bounds that lose no link:

1. Rows.  Equal sets are one row of the matrix, so copies cost nothing.
2. Columns.  Of a row with a grams only the a - ceil(percent * a / 100) + 1 rarest can be the
   first common gram of a link (prefix filter).  The documents that share such a gram, and have another of a
   size within the percentage there, are one block of the matrix; blocks of the same documents are worked once.
3. Folded product.  In a block each row is folded to counts by leading bits of the gram, about one count
   for four grams.  The sum of the lesser counts of two rows is at least their overlap; rows without a
   partner that reaches the bound leave.
4. Sparse product.  The rows left meet with their whole sets: row by row, counts are accumulated over
   the columns that the row has, pairs below the bound are discarded, and a row that is
   already joined to all others of the block is not multiplied again.

The first round multiplies each row in its largest block; the second all blocks that still hold
more than one component.  Links go to ``graph.components`` after each, so a large group of near
copies is mostly joined when its many blocks are looked at.

Scale: blocks are dealt by Spark and cut to chunks of at most ``CHUNK_GRAMS`` grams (one row at least), in
order of size; the first round multiplies a chunk with the next one, the second all pairs of chunks
whose sizes allow a link and that are not of one component.  So a task holds two chunks at any group size.
Rows go through the folded product in runs of ``RUN_ROWS`` rows and ``RUN_BINS`` counts; longer runs skip that
filter, which changes the work alone.  The order of rarity comes from a count sketch over all documents (one
counter for about 4 grams, at most ``SKETCH_MOST``); it too changes the work alone.  Prefixes are shuffled
once, 28 bytes a gram, and singles dropped as they are read.  Whole sets are shuffled only for the
rows that the folded product leaves (and those that share a bit of ``NEEDED_BITS`` with one).  Nothing but the
sketch, these bits and one total reaches the driver.

Grams are compared by 64-bit hashes; a wrong overlap needs two different grams of the compared
pair with equal hashes (about a * b / 2^64).  Sets are identified by 128 bits.

Defined results: null and empty texts and texts without a word have no grams, are linked with nothing, and
keep their own id.  Fewer words than ``shingle`` make one gram of all of them.  Repeated
rows and equal ids stay rows of their own; a component without any id has id null; very long texts are
read whole; an empty table gives no rows.  Only the id and text columns are read, so
other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage
from .graph import components

BINS_LEAST, BINS_MOST = 64, 1 << 16
RUN_ROWS = 2048
RUN_BINS = 1 << 24
NEEDED_BITS = 1 << 26
CHUNK_GRAMS = 1 << 20
SKETCH_MOST = 1 << 24
_SKETCH_PART = 1 << 16
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


# --- rows of the matrix -----------------------------------------------------------------

def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _ODD[1]
    x = (x ^ (x >> np.uint64(27))) * _ODD[2]
    return x ^ (x >> np.uint64(31))


def grams(text: str | None, shingle: int) -> np.ndarray:
    """Sorted hashes of the distinct word n-grams: A-Z lower-cased, words between ASCII white space."""
    words = (text or "").encode().lower().split()  # on bytes both act on ASCII alone
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(len(words), shingle)
    out = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):  # order matters: each word is mixed into what stands before it
        out = _mix(out * _ODD[0] + each[k: len(words) - size + 1 + k])
    return np.unique(out)


def bins(n: int) -> int:
    """How many counts a row of n grams is folded to."""
    return min(BINS_MOST, max(BINS_LEAST, 1 << (n // 4).bit_length()))


def folded(g: np.ndarray) -> np.ndarray:
    size = bins(len(g))
    return np.bincount((g >> np.uint64(65 - size.bit_length())).astype(np.int64), minlength=size).astype("<u4")


def _rows(docs: DataFrame, shingle: int) -> DataFrame:
    """Rows (doc_id, text, n, mark, fold): size, identity and folded counts of each document's set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = (grams(t.as_py(), shingle) for t in b.column(1))
            made = [(len(g), xxhash.xxh3_128_digest(g.tobytes()), folded(g).tobytes()) for g in sets]
            n, mark, fold = zip(*made, strict=True) if made else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(mark, pa.binary()),
                                              pa.array(fold, pa.binary())], ["doc_id", "text", "n", "mark", "fold"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, text string, n long, mark binary, fold binary")


def _sketch(rows: DataFrame, shingle: int, slots: int) -> np.ndarray:
    """How common the grams of each slot (hash modulo ``slots``) are: a byte that rises with the number of
    documents, over all documents, that have one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, press = np.zeros(slots, np.uint32), zstandard.ZstdCompressor(level=1)
        for b in batches:
            for t in b.column(0):
                np.add.at(counts, (grams(t.as_py(), shingle) & np.uint64(slots - 1)).astype(np.int64), 1)
        for k in range(0, slots, _SKETCH_PART):
            part = counts[k: k + _SKETCH_PART]
            if part.any():
                yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int64()), "part": pa.array([press.compress(part)], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total, press = None, None, zstandard.ZstdDecompressor()

        def close():
            if last is not None:
                small = np.minimum(total, 127)
                steep = 8 * np.log2(np.maximum(total, 128) / 128)
                rank = (small + np.minimum(steep, 128)).astype(np.uint8)
                yield pa.RecordBatch.from_pydict({"k": pa.array([last], pa.int64()), "part": pa.array([rank.tobytes()], pa.binary())})

        for b in batches:
            for k, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts = np.frombuffer(press.decompress(part), np.uint32)
                if k != last:
                    yield from close()
                    last, total = k, np.zeros(len(counts), np.int64)
                total += counts
        yield from close()

    kind = "k long, part binary"
    parts = rows.select("text").mapInArrow(run, kind).repartition("k").sortWithinPartitions("k").mapInArrow(add, kind)
    out = np.zeros(slots, np.uint8)
    for k, part in parts.collect():  # ``slots`` bytes
        out[k: k + len(part)] = np.frombuffer(part, np.uint8)
    return out


def prefix_size(n: int, percent: int) -> int:
    """How many of a row's rarest grams can be the first that it has in common with a linked row."""
    return n + (-percent * n) // 100 + 1 if n else 0


def _postings(rows: DataFrame, shingle: int, percent: int, common: np.ndarray) -> DataFrame:
    """Rows (gram, n, mark): the prefix of every row; rows that a batch repeats are given once."""
    shared = rows.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in batches:
            found, sizes, marks = [np.zeros(0, np.uint64)], [], []
            texts = dict(zip(b.column(1).to_pylist(), b.column(0), strict=True))
            for mark, t in texts.items():
                g = grams(t.as_py(), shingle)
                p = prefix_size(len(g), percent)
                found.append(g[np.lexsort((g, table[(g & np.uint64(len(table) - 1)).astype(np.int64)]))[:p]])
                sizes += [len(g)] * p
                marks += [mark] * p
            yield pa.RecordBatch.from_pydict({"gram": pa.array(np.concatenate(found).view(np.int64)), "n": pa.array(sizes, pa.int32()),
                                              "mark": pa.array(marks, pa.binary())})

    return rows.select("text", "mark").mapInArrow(run, "gram long, n int, mark binary")


def _shared_grams(postings: DataFrame, percent: int) -> DataFrame:
    """Rows (gram, n, mark), each once, that have another row of their gram of a size that allows a link.
    By rising size that is the row before or after, so one row is held back at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, joined = None, False  # the last row, and whether it goes with the one before
        for b in batches:
            if not b.num_rows:
                continue
            b = pa.Table.from_batches([held, b] if held is not None else [b]).combine_chunks().to_batches()[0]
            gram, n = b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64)
            mark = np.array(b.column(2).to_pylist(), object)
            same = gram[1:] == gram[:-1]
            new = np.concatenate(([True], ~(same & (mark[1:] == mark[:-1]))))
            b, gram, n = b.filter(pa.array(new)), gram[new], n[new]
            link = np.concatenate(([joined], (gram[1:] == gram[:-1]) & (percent * n[1:] <= 100 * n[:-1])))
            keep = link | np.append(link[1:], False)
            yield b.slice(0, b.num_rows - 1).filter(pa.array(keep[:-1]))
            held, joined = b.slice(b.num_rows - 1), bool(link[-1])
        if held is not None and joined:
            yield held

    dealt = postings.repartition("gram").sortWithinPartitions("gram", "n", "mark")
    return dealt.mapInArrow(run, "gram long, n int, mark binary")


# --- folded product ------------------------------------------------------------------------

def _reaches(overlap: np.ndarray, a, b, percent: int) -> np.ndarray:
    return (100 + percent) * overlap >= percent * (a + b)


def has_partner(n: np.ndarray, fold: list[np.ndarray], comp: np.ndarray, percent: int) -> np.ndarray:
    """Rows of a block, by rising n, that the folded counts allow a link with a row of another component."""
    out = np.zeros(len(n), bool)
    last = np.searchsorted(n, 100 * n // percent, "right")  # larger rows can't hold enough of this one
    width = np.array([len(f) for f in fold])
    for size in np.unique(width).tolist():
        first, end = int(np.searchsorted(width, size)), int(np.searchsorted(width, size, "right"))
        stop = int(last[end - 1])  # rows up to here, larger ones folded on, meet rows of this width
        m = np.array([f.reshape(size, -1).sum(1) for f in fold[first: stop]], np.int64)
        for i in range(first, end):
            j = np.arange(i + 1, last[i])
            if out[i] and out[j].all():
                continue
            j = j[comp[j] != comp[i]]
            if len(j):
                near = j[_reaches(np.minimum(m[j - first], m[i - first]).sum(1), n[j], n[i], percent)]
                if len(near):
                    out[i] = out[near] = True
    return out


def _coarse(blocks: DataFrame, percent: int) -> DataFrame:
    """Rows (block, id, n, fold, comp) whose fold allows a partner of another component in the block."""
    names = ["block", "id", "n", "fold", "comp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, size, last, long = [], 0, 0, None, False

        def close():
            if rows > 1 and not long:
                t = pa.Table.from_batches(held).combine_chunks()
                n, comp = t.column("n").to_numpy(), t.column("comp").to_numpy()
                fold = [np.frombuffer(f, "<u4") for f in t.column("fold").to_pylist()]
                keep = has_partner(n, fold, comp, percent)
                if keep.any():
                    yield from t.filter(pa.array(keep)).to_batches()

        for b in batches:
            if not b.num_rows:
                continue
            block = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if block[i] != last:
                    yield from close()
                    held, rows, size, last, long = [], 0, 0, block[i], False
                held.append(b.slice(i, j - i))
                rows += j - i
                size += pc.sum(pc.binary_length(held[-1].column("fold"))).as_py() // 4
                if long or rows > RUN_ROWS or size > RUN_BINS:  # whole and unfiltered, in bounded memory
                    yield from held
                    held, long = [], True
        yield from close()

    dealt = blocks.select(*names).repartition("block").sortWithinPartitions("block", "n", "id")
    return dealt.mapInArrow(run, "block long, id long, n long, fold binary, comp long")


# --- sparse product ---------------------------------------------------------------------------

def product_links(sets: list[np.ndarray], comp: list[int], percent: int) -> list[tuple[int, int]]:
    """Pairs of rows that join all linked rows of different components; a tree, not all pairs."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    size = np.array([len(s) for s in sets], np.int64)
    row = np.repeat(np.arange(len(sets)), size)
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    by_column = np.argsort(column, kind="stable")
    start = np.concatenate(([0], np.cumsum(np.bincount(column))))
    row_start = np.concatenate(([0], np.cumsum(size)))
    holders = row[by_column]  # rows of each column, ascending
    out = []
    left = len({*comp})
    for i in range(len(sets)):
        if left < 2:
            break
        mine = column[row_start[i]: row_start[i + 1]]
        lo, n = start[mine], start[mine + 1] - start[mine]
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        overlap = np.bincount(holders[at], minlength=len(sets))
        near = np.flatnonzero(_reaches(overlap, size, size[i], percent) & (overlap > 0))
        for j in near[near > i].tolist():
            a, b = root(comp[i]), root(comp[j])
            if a != b:
                parent[b] = a
                left -= 1
                out.append((i, j))
    return out


def _multiply(blocks: DataFrame, sets: DataFrame, percent: int, neighbours_only: bool, chunk_grams: int) -> DataFrame:
    """Links (a, b) found in ``blocks`` (block, id, n, comp), with the whole ``sets`` (id, grams)."""
    order = Window.partitionBy("block").orderBy("n", "id")
    upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = blocks.select("block", "id", "n", "comp", F.floor(F.coalesce(upto, F.lit(0)) / chunk_grams).cast("int").alias("chunk"))
    rows = stage(rows, "chunks")
    chunks = rows.groupBy("block", "chunk").agg(F.min("n").alias("least"), F.max("n").alias("most"),
                                                F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    number = F.row_number().over(Window.partitionBy("block").orderBy("chunk"))
    total = F.count("*").over(Window.partitionBy("block"))
    chunks = stage(chunks.withColumn("number", number).withColumn("total", total), "chunk-sizes")
    a, b = chunks.alias("a"), chunks.alias("b")
    meet = (F.col("a.block") == F.col("b.block")) & (F.col("a.number") <= F.col("b.number"))
    meet &= F.col("a.most") * 100 >= F.col("b.least") * percent
    meet &= F.least("a.c0", "b.c0") != F.greatest("a.c1", "b.c1")
    if neighbours_only:
        meet &= F.col("b.number") - F.col("a.number") <= F.when(F.col("a.total") > 1, 1).otherwise(0)
    pairs = a.join(b, meet).select("a.block", F.struct(F.col("a.chunk").alias("i"), F.col("b.chunk").alias("j")).alias("tile"))
    tiles = pairs.select("block", "tile", F.explode(F.array_distinct(F.array("tile.i", "tile.j"))).alias("chunk"))
    dealt = rows.join(tiles, ["block", "chunk"]).join(sets, "id")
    dealt = dealt.select("block", F.col("tile.i").alias("i"), F.col("tile.j").alias("j"), "n", "id", "comp", "grams")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, comps, held = None, [], [], []

        def close():
            if len(ids) > 1:
                found = product_links(held, comps, percent)
                if found:
                    yield pa.RecordBatch.from_pydict({"a": pa.array([ids[i] for i, _ in found], pa.int64()),
                                                      "b": pa.array([ids[j] for _, j in found], pa.int64())})

        for batch in batches:
            for key, x, c, g in zip(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True), batch.column(4).to_pylist(),
                                    batch.column(5).to_pylist(), batch.column(6).to_pylist(), strict=True):
                if key != last:
                    yield from close()
                    last, ids, comps, held = key, [], [], []
                ids.append(x)
                comps.append(c)
                held.append(np.frombuffer(g, "<u8"))
        yield from close()

    dealt = dealt.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j", "n", "id")
    return dealt.mapInArrow(run, "a long, b long")


# --- the join -------------------------------------------------------------------------------------

def _needed_sets(rows: DataFrame, blocks: DataFrame, shingle: int) -> DataFrame:
    """Rows (id, grams): the sets of all ids in ``blocks``, and of a few others: those that share a bit of a map."""
    slot = F.pmod(F.xxhash64("id"), F.lit(NEEDED_BITS))
    words = blocks.select("id").distinct().groupBy((slot / 64).cast("int").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {NEEDED_BITS}) % 64 as int))")).alias("bits"))
    bitmap = np.zeros(NEEDED_BITS // 64, np.uint64)
    found = words.toArrow()  # at most NEEDED_BITS / 64 rows
    bitmap[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in batches:
            at = b.column(2).to_numpy()
            hit = (table[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1) > 0
            b = b.filter(pa.array(hit))
            sets = [grams(t.as_py(), shingle).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["id", "grams"])

    ids = rows.select(F.col("rid").alias("id"), "text").withColumn("slot", slot)
    return ids.mapInArrow(pack, "id long, grams binary")


def _distinct_blocks(blocks: DataFrame) -> DataFrame:
    """One block of those with the same documents, and none of a single document."""
    same = blocks.groupBy("block").agg(F.count("*").alias("size"), F.bit_xor(F.xxhash64("id")).alias("x"),
                                       F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")).filter("size > 1")
    kept = same.groupBy("size", "x", "y").agg(F.min("block").alias("block")).select("block", "size")
    return blocks.join(kept, "block")


def jaccard_groups(docs: DataFrame, shingle: int, percent: int, id_col: str = "doc_id", text_col: str = "text",
                   chunk_grams: int = CHUNK_GRAMS) -> DataFrame:
    """Every row's id with ``n_shingles`` and ``component_id``, the least id reachable by links."""
    spark = docs.sparkSession
    rows = stage(_rows(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), shingle)
                 .withColumn("rid", F.monotonically_increasing_id()), "rows")
    filled = rows.filter("n > 0")
    one = stage(filled.groupBy("mark").agg(F.min("rid").alias("id"), F.min("doc_id").alias("least"), F.first("n").alias("n"),
                                           F.first("fold").alias("fold")), "sets")
    total = filled.agg(F.sum("n")).first()[0] or 0
    slots = min(SKETCH_MOST, max(_SKETCH_PART, 1 << (total // 4).bit_length()))
    shared = stage(_shared_grams(_postings(filled, shingle, percent, _sketch(filled, shingle, slots)), percent), "shared")
    blocks = shared.join(one, "mark").select(F.col("gram").alias("block"), "id")
    blocks = _distinct_blocks(stage(blocks, "blocks")).select("block", "id").join(
        one.select("id", "n", "fold", F.col("id").alias("comp")), "id")
    blocks = stage(_coarse(blocks, percent), "near")

    sets = stage(_needed_sets(rows, blocks, shingle), "grams")
    sizes = blocks.groupBy("block").agg(F.count("*").alias("size"))
    largest = blocks.join(sizes, "block").groupBy("id").agg(F.max(F.struct("size", "block"))["block"].alias("block"))
    first = _distinct_blocks(blocks.select("block", "id", "n", "comp").join(largest, ["id", "block"]))
    found = stage(_multiply(first, sets, percent, True, chunk_grams), "links")
    joined = blocks.drop("comp").join(components(found), F.col("id") == F.col("node"), "left").select(
        "block", "id", "n", "fold", F.coalesce("root", "id").alias("comp"))
    mixed = joined.groupBy("block").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 <> c1").select("block")
    second = _distinct_blocks(stage(_coarse(joined.join(mixed, "block"), percent), "mixed"))
    found = stage(found.union(_multiply(second, sets, percent, False, chunk_grams)), "all-links")

    roots = one.join(components(found), F.col("id") == F.col("node"), "left").select("mark", "least", F.coalesce("root", "id").alias("root"))
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    by_mark = roots.join(least, "root").select("mark", "component_id")
    known = rows.select("doc_id", "n", "mark").join(by_mark, "mark", "left")
    return known.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"),
                        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
