"""Trie of conversation prefixes, from sorted conversations and their common-prefix lengths.

Conversations are sequences of turns; each turn is known by a 128-bit digest of its role and text.
Sorted by these sequences, the conversations that start with one prefix stand together.  L[r] is
the number of first turns that row r has in common with row r - 1.  A prefix of depth d that row r
starts with reaches from r to both sides as long as L stays at d or more, so with a sparse table of
range minima over L a binary search finds each end.  Every candidate (the common prefix of two
neighbours, and each whole conversation) is searched on its own; there is no stack and no order among
them.  Candidates with the same ends and depth are one node; the nodes between it and the next
candidate above have the same members and are spelled out from it.

Scale: the order is a range partitioning by (sequence, id), so copies of one conversation spread
over many tasks.  Sorted rows are cut into blocks of about ``BLOCK_TURNS`` turns; a task holds one block
and its sparse table.  L of the first row of each block comes from the rows at the edges of
blocks (one row per block).  A prefix that reaches over a block's edge is searched inside each block it
reaches; its pieces, at most two per depth and block, are added up by a grouping on the prefix's digest.
All other nodes are complete in their block.  Sums over subtrees are sums over members' rows, where a
node counts at its first row, so pieces add up too.

Defined results: null roles and texts are empty; turns of one number are ordered by role, then by the
first ``HEAD`` characters of the text, then by digest; rows without conv_id take no part; repeated
rows are turns of their own; a conversation may be empty and is then a member of the root alone; an
empty table gives no rows.  Texts are digested whole, whatever their length; a conversation's
digests (16 bytes and a length a turn) must fit in a row.  Other columns are not read, so their
names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.temporal import row_index
from .common import stage

BLOCK_TURNS = 1 << 18
WIDTH = 16
#: Characters of a text that order turns of one number and role; its digest decides beyond them.
HEAD = 64
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
NODE = ("kind int, path binary, above binary, conv_id long, depth long, parent long, n_convs long, n_children long, "
        "n_leaves long, saved long, ends string")


# --- conversations ---------------------------------------------------------------------------

def turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
          text_col: str = "text") -> DataFrame:
    """Rows (conv_id, pos from 1, digest, chars): the turns of each conversation in order."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.substring(F.sha2(F.concat_ws("|", F.octet_length(role).cast("string"), role, text), 256), 1, 2 * WIDTH))
    rows = conversations.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"),
        F.substring(text, 1, HEAD).alias("head"), digest.alias("digest"), F.length(text).alias("chars"))
    rows = row_index(rows, "conv_id", ["turn", "role", "head", "digest"])  # a conversation above its row limit is split
    return rows.select("conv_id", F.col("rn").cast("long").alias("pos"), "digest", "chars")


def rebuilt(conversations: DataFrame, base_every: int = 100, most: int = 6, **columns: str) -> DataFrame:
    """Rows (conv_id, pos, digest, chars) of rebuilt conversations, and one with pos null for each
    conversation: the first h turns of the base conversation, then the own turns after the first h."""
    rows = stage(turns(conversations, **columns), "turns")
    ids = rows.select("conv_id").distinct()
    h = F.crc32(F.col("conv_id").cast("string")) % most
    ids = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % base_every).alias("base"), h.alias("h"))
    heads = rows.filter(F.col("pos") < most).select(F.col("conv_id").alias("base"), "pos", "digest", "chars")
    borrowed = ids.join(heads, "base").filter("pos <= h").select("conv_id", "pos", "digest", "chars")
    # Own turns keep their numbers: what stands before them only has to come first, not without gaps.
    own = rows.withColumn("h", h).filter("pos > h").select("conv_id", "pos", "digest", "chars")
    none = F.lit(None)
    return borrowed.union(own).union(ids.select("conv_id", none.cast("long"), none.cast("binary"), none.cast("int")))


def sequences(turn_rows: DataFrame) -> DataFrame:
    """Rows (conv_id, seq, chars): each conversation's digests, one after the other, and text lengths as u32."""
    each = F.struct("pos", "digest", "chars")
    packed = turn_rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), each))).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(1)
            first, t = at.offsets.to_numpy(), at.values
            seq = [b"".join(t.field("digest")[i:j].to_pylist()) for i, j in zip(first[:-1], first[1:], strict=True)]
            size = t.field("chars").to_numpy(zero_copy_only=False).astype("<u4")
            chars = [size[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(seq, pa.binary()), pa.array(chars, pa.binary())],
                                             ["conv_id", "seq", "chars"])

    return packed.mapInArrow(run, "conv_id long, seq binary, chars binary")


# --- sorted blocks ------------------------------------------------------------------------------

def common(a: bytes, b: bytes) -> int:
    """Number of first turns that two sequences share."""
    n = min(len(a), len(b)) // WIDTH
    if a[: n * WIDTH] == b[: n * WIDTH]:
        return n
    low, high = 0, n - 1  # the first ``low`` turns are equal, the first ``high + 1`` are not
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * WIDTH: mid * WIDTH] == b[low * WIDTH: mid * WIDTH]:
            low = mid
        else:
            high = mid - 1
    return low


def _sorted(seqs: DataFrame, block_turns: int) -> DataFrame:
    """All sequences in order, with their block (part, block) and place in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, place, size = TaskContext.get().partitionId(), 0, 0, 0
        for b in batches:
            blocks, places = [], []
            for n in b.column(1):
                blocks.append(block)
                places.append(place)
                place, size = place + 1, size + 1 + len(n.as_py()) // WIDTH
                if size >= block_turns:
                    block, place, size = block + 1, 0, 0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(blocks), pa.int32()), pa.array(blocks, pa.int32()),
                                              pa.array(places, pa.int64())], ["conv_id", "seq", "chars", "part", "block", "place"])

    order = ["seq", "conv_id"]
    dealt = seqs.repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(run, "conv_id long, seq binary, chars binary, part int, block int, place long")


def _edges(rows: DataFrame) -> DataFrame:
    """Rows (part, block, before, after): turns in common with the row before and the row after the block; -1 without one."""
    ends = rows.groupBy("part", "block").agg(F.min_by("seq", "place").alias("first"), F.max_by("seq", "place").alias("last"))
    order = Window.orderBy("part", "block")  # one row a block
    ends = ends.withColumn("above", F.lag("last").over(order)).withColumn("below", F.lead("first").over(order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part, block, first, last, above, below = (c.to_pylist() for c in b.columns)
            before = [-1 if x is None else common(x, y) for x, y in zip(above, first, strict=True)]
            after = [-1 if x is None else common(x, y) for x, y in zip(below, last, strict=True)]
            yield pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "block": pa.array(block, pa.int32()),
                                              "before": pa.array(before, pa.int64()), "after": pa.array(after, pa.int64())})

    return ends.mapInArrow(run, "part int, block int, before long, after long")


class RangeMinimum:
    """Sparse table: ``rows[k][i]`` is the least of values i to i + 2^k - 1."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while 2 << (len(self.rows) - 1) <= len(values):
            half, top = 1 << (len(self.rows) - 1), self.rows[-1]
            self.rows.append(np.minimum(top[:-half], top[half:]))

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least of values a to b (inclusive), for each pair."""
        level = np.frexp((b - a + 1).astype(float))[1] - 1
        out = np.empty(len(a), self.rows[0].dtype)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.rows[k][a[at]], self.rows[k][b[at] - (1 << int(k)) + 1])
        return out

    def reach(self, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row ``at``, the first and last row to which L stays at ``depth`` or more (L[r] stands
        between rows r - 1 and r); a binary search to each side, by halving steps."""
        left, right, last = at.copy(), at.copy(), len(self.rows[0]) - 1
        for k in range(len(self.rows) - 1, -1, -1):
            step, row = 1 << k, self.rows[k]
            to = left - step
            ok = to >= 0
            ok[ok] = row[to[ok] + 1] >= depth[ok]
            left[ok] -= step
            to = right + step
            ok = to <= last
            ok[ok] = row[right[ok] + 1] >= depth[ok]
            right[ok] += step
        return left, right


def _paths(seq: bytes, depth: int) -> list[bytes]:
    """Digests of the prefixes of depth 0 to ``depth``."""
    h, out = hashlib.blake2b(digest_size=WIDTH), []
    for d in range(depth + 1):
        out.append(h.digest())
        h.update(seq[d * WIDTH: (d + 1) * WIDTH])
    return out


def _sha(ids: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, np.sort(ids).tolist())).encode()).hexdigest()


def block_nodes(conv: np.ndarray, seqs: list[bytes], chars: list[bytes], before: int, after: int) -> Iterator[dict]:
    """Columns of NODE for one block of sorted rows: complete nodes (kind 0), pieces of prefixes that
    reach over an edge (1; the root always) and, for these, members that end there (2)."""
    m = len(seqs)
    size = np.array([len(s) // WIDTH for s in seqs], np.int64)
    lcp = np.array([-1, *(common(a, b) for a, b in zip(seqs[:-1], seqs[1:], strict=True))], np.int64)
    table, ids = RangeMinimum(lcp), RangeMinimum(conv)
    true = lcp.copy()  # with the neighbours outside
    true[0] = before
    # chars[upto[r] + d]: text lengths of row r's first d turns.
    upto = np.cumsum(size + 1) - (size + 1)
    flat = np.zeros(int((size + 1).sum()), np.int64)
    if size.any():
        flat[np.repeat(upto + 1, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)] = np.frombuffer(b"".join(chars), "<u4")
    flat = np.cumsum(flat)
    flat -= np.repeat(flat[upto], size + 1)
    total = flat[upto + size]
    fresh = total - flat[upto + np.minimum(np.maximum(true, 0), size)]  # text of the nodes that row r is the first of
    leaf = np.append(lcp[1:], after) < size
    run = [np.concatenate(([0], np.cumsum(x))) for x in (total, fresh, leaf)]

    def sums(l: np.ndarray, u: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, ...]:
        """Members, leaves and saved tokens of the piece of rows l to u of a prefix of depth d."""
        n, above = u - l + 1, flat[upto[l] + np.maximum(d - 1, 0)]
        whole, new, leaves = (r[u + 1] - r[l] for r in run)
        first = np.where(true[l] < d, total[l] - above, fresh[l])
        return n, leaves, whole - n * above - (new - fresh[l] + first)

    # Candidates: what neighbours share, and whole conversations.
    every = np.arange(m)
    at, depth = np.concatenate((every[1:], every)), np.concatenate((lcp[1:], size))
    left, right = table.reach(at, depth)
    last_true = np.append(true[1:], after)  # L of the row after
    key = left * (int(depth.max(initial=0)) + 1) + depth
    _, index, which = np.unique(key, return_index=True, return_inverse=True)
    l, u, d = left[index], right[index], depth[index]
    # A child starts where L is this depth and the row goes on; the first row's child is counted apart.
    opens = np.zeros(len(index), np.int64)
    np.add.at(opens, which[: m - 1], size[1:] > lcp[1:])
    children = opens + (size[l] > d)
    ended = which[m - 1:]  # the node at which each row ends
    crossing = (d == 0) | ((l == 0) & (d <= before)) | ((u == m - 1) & (d <= after))

    # --- complete nodes, with the chain above each
    c = np.flatnonzero(~crossing)
    if len(c):
        l_, u_, d_ = l[c], u[c], d[c]
        top = np.maximum(np.maximum(true[l_], last_true[u_]), 0)  # depth of the next branch above
        pl, pu = table.reach(l_, top)
        outside = (top == 0) | ((pl == 0) & (top <= before)) | ((pu == m - 1) & (top <= after))
        n, leaves, saved = sums(l_, u_, d_)
        least, parent = ids.least(l_, u_), ids.least(pl, pu)
        above = np.array([None] * len(c), object)
        for i in np.flatnonzero(outside).tolist():
            above[i] = _paths(seqs[l_[i]], int(top[i]))[-1]
        order = np.argsort(ended, kind="stable")
        bounds = np.searchsorted(ended[order], c), np.searchsorted(ended[order], c, "right")
        shas = [_sha(conv[order[i:j]]) if j > i else EMPTY_SHA for i, j in zip(*(x.tolist() for x in bounds), strict=True)]
        long = d_ - top  # nodes in the chain, the candidate included
        i = np.repeat(np.arange(len(c)), long)
        below = np.arange(len(i)) - np.repeat(np.cumsum(long) - long, long)  # 0 at the candidate
        depth_ = d_[i] - below
        between = flat[upto[l_[i]] + d_[i] - 1] - flat[upto[l_[i]] + depth_ - 1]  # text of the chain from here to the candidate
        highest = below == long[i] - 1
        yield {
            "kind": np.zeros(len(i), np.int32), "path": [None] * len(i),
            "above": np.where(highest, above[i], None).tolist(), "conv_id": least[i], "depth": depth_,
            "parent": np.where(highest, parent[i], least[i]), "n_convs": n[i],
            "n_children": np.where(below == 0, children[c][i], 1), "n_leaves": leaves[i],
            "saved": saved[i] + (n[i] - 1) * between,
            "ends": np.where(below == 0, np.array(shas, object)[i], EMPTY_SHA).tolist()}

    # --- pieces of prefixes over the edges, one by one, down both edge rows
    shared = int(table.least(np.array([1]), np.array([m - 1]))[0]) if m > 1 else int(size[0])
    down = [(0, x) for x in range(max(before, 0) + 1)]
    down += [(m - 1, x) for x in range(min(shared, max(before, 0)) + 1, after + 1)]
    at, depth = np.array([r for r, _ in down]), np.array([x for _, x in down], np.int64)
    left, right = table.reach(at, depth)
    n, leaves, saved = sums(left, right, depth)
    kids = np.array([int(((true[a: b + 1] <= x) & (size[a: b + 1] > x)).sum())
                     for a, b, x in zip(left.tolist(), right.tolist(), depth.tolist(), strict=True)], np.int64)
    paths = {r: _paths(seqs[r], int(depth[at == r].max())) for r in {r for r, _ in down}}
    path = [paths[r][x] for r, x in down]
    up = [paths[r][x - 1] if x else None for r, x in down]
    k = len(down)
    yield {"kind": np.ones(k, np.int32), "path": path, "above": up, "conv_id": ids.least(left, right), "depth": depth,
           "parent": [None] * k, "n_convs": n, "n_children": kids, "n_leaves": leaves, "saved": saved, "ends": [None] * k}
    name = dict(zip(zip(left.tolist(), depth.tolist(), strict=True), path, strict=True))
    ends = [(name[a, x], int(conv[r])) for r, a, x in zip(range(m), l[ended].tolist(), d[ended].tolist(), strict=True) if (a, x) in name]
    if ends:
        k, zero = len(ends), np.zeros(len(ends), np.int64)
        yield {"kind": np.full(k, 2, np.int32), "path": [p for p, _ in ends], "above": [None] * k, "conv_id": [x for _, x in ends],
               "depth": zero, "parent": [None] * k, "n_convs": zero, "n_children": zero, "n_leaves": zero, "saved": zero,
               "ends": [None] * k}


def _nodes(rows: DataFrame, edges: dict[tuple[int, int], tuple[int, int]]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(edges)
    fields = [("kind", pa.int32()), ("path", pa.binary()), ("above", pa.binary()), *((c, pa.int64()) for c in (
        "conv_id", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved")), ("ends", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, ([], [], [])

        def close():
            if held[0]:
                for out in block_nodes(np.array(held[0], np.int64), held[1], held[2], *shared.value[last]):
                    yield pa.RecordBatch.from_pydict({n: pa.array(out[n], t) for n, t in fields})

        for b in batches:
            part, block = b.column("part").to_pylist(), b.column("block").to_pylist()
            cols = [b.column(c).to_pylist() for c in ("conv_id", "seq", "chars")]
            for at, *row in zip(zip(part, block, strict=True), *cols, strict=True):
                if at != last:
                    yield from close()
                    last, held = at, ([], [], [])
                for to, x in zip(held, row, strict=True):
                    to.append(x)
        yield from close()

    dealt = rows.repartition("part", "block").sortWithinPartitions("part", "block", "place")
    return dealt.mapInArrow(run, NODE)


def _end_digests(members: DataFrame) -> DataFrame:
    """Rows (path, ends): SHA-256 of the ids that end at each prefix, ascending; streamed, so no list is held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, h = None, None
        for b in batches:
            path, ids = b.column(0).to_pylist(), b.column(1).to_pylist()
            done = []
            for p, x in zip(path, ids, strict=True):
                if p != last:
                    if h:
                        done.append((last, h.hexdigest()))
                    last, h = p, hashlib.sha256(str(x).encode())
                else:
                    h.update(f",{x}".encode())
            if done:
                yield pa.RecordBatch.from_pydict({"path": pa.array([p for p, _ in done], pa.binary()), "ends": pa.array([e for _, e in done])})
        if h:
            yield pa.RecordBatch.from_pydict({"path": pa.array([last], pa.binary()), "ends": pa.array([h.hexdigest()])})

    dealt = members.repartition("path").sortWithinPartitions("path", "conv_id")
    return dealt.mapInArrow(run, "path binary, ends string")


def trie(seqs: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per node of the trie of ``seqs`` (conv_id, seq, chars), as ``prefix_trie`` states."""
    rows = stage(_sorted(seqs, block_turns), "sorted")
    edges = {(r.part, r.block): (r.before, r.after) for r in _edges(rows).collect()}  # one pair of numbers a block
    found = stage(_nodes(rows, edges), "nodes")
    pieces = found.filter("kind = 1").groupBy("path", "depth").agg(
        F.first("above").alias("above"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")])
    ends = _end_digests(found.filter("kind = 2").select("path", "conv_id"))
    whole = stage(pieces.join(ends, "path", "left"), "pieces")
    names = whole.select(F.col("path").alias("above"), F.col("conv_id").alias("above_id"))
    counts = ["n_convs", "n_children", "n_leaves", "saved"]
    rest = found.filter("kind = 0")
    out = rest.filter("above is null").select("conv_id", "depth", "parent", *counts, "ends")
    for part in (rest.filter("above is not null"), whole):
        out = out.union(part.join(names, "above", "left").select("conv_id", "depth", F.col("above_id").alias("parent"), *counts,
                                                                 F.coalesce("ends", F.lit(EMPTY_SHA))))
    return out.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
                      F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, block_turns: int = BLOCK_TURNS, **columns: str) -> DataFrame:
    """The trie of the rebuilt conversations: per node the least member, depth, the parent's least
    member, counts of members, children and childless nodes below, text saved by sharing, and a digest of the ids that end there."""
    return trie(sequences(rebuilt(conversations, **columns)), block_turns)
