"""Toxicity by class-conditional Kneser-Ney models over characters.

Two character models of order ``ORDER``, one of toxic and one of ordinary text, give every
character a probability after the four before it.  Orders above ``SHARED`` have counts
per class: the highest order counts occurrences, lower ones count continuations (how many
different characters stand before a gram), each discounted and interpolated with the next
lower order.  Orders up to ``SHARED`` are counted over both classes together, so a rare
expression falls back on the same counts in both models and speaks for neither.
A text's value is the log-likelihood ratio of the two models per character,

    x = sum(log P_toxic - log P_ordinary) / (characters + PRIOR_CHARS)

and its score is a logistic function of x, fitted on labelled rows kept out of the counts of its x.

Labels come only from rows that ``held_out`` leaves, and the model that scores counts all of them
at every size.  The logistic function (two numbers) is fitted before, on at most
``CALIBRATION_ROWS`` rows of one eighth of them, in order of a hash of the id, with a model that counts
the other seven eighths.

Scale: the texts of labelled rows are shuffled once, to meet their labels, and those of the
eighth are written; grams are counted in each task before the shuffle.  A gram is kept as its exact
code points, 21 bits each in two longs, so its context and suffix are shifts of them, in any
script.  The smoothed model is a written table in the shared folder, a file for each order and
bucket of about ``BUCKET_ROWS`` grams.  A task that scores reads the buckets that its distinct
grams fall in, and holds at most ``HELD_BYTES`` of them at a time.  So nothing of the model passes
the driver or is broadcast, the model has all grams at any size, and scoring needs no shuffle.
(The shared folder must be one that pyarrow's file systems read: local, HDFS, S3, GCS.)

Defined results: null and empty texts have x = 0; documents with a null id train nothing and
are not held out; several labels of one id count as the largest; documents repeated under
one id are all counted; without usable labels the logistic function is ``DEFAULT_FIT``; very long texts
are read whole, cut where a batch ends only for lookups; an empty table gives no rows.  Only the id, text and
label columns are read, and helper columns get free names, so other columns can't clash.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, new_folder, stage

ORDER = 5
SHARED = 2
CHAR_BITS = 21
#: A character that no order knows is one of so many.
ALPHABET = 4096
PRIOR_CHARS = 300
CALIBRATION_ROWS = 20_000
#: Slope and middle of the logistic function when there is nothing to fit it on.
DEFAULT_FIT = (300.0, 0.02)
THRESHOLD = 0.7
BATCH_CHARS = 1 << 20
BUCKET_ROWS = 1 << 20
HELD_BYTES = 256 << 20
#: Code points up to 0xA0, white space and controls as a space.
_FOLD = np.array([32 if x <= 32 or x in (0x85, 0xA0) else x for x in range(0xA1)], np.uint64)
_POWER = np.uint64(0xD6E8FEB86659FD93)
_PRIME = 1_000_003
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX_NEXT = np.uint64(0xC2B2AE3D27D4EB4F)


# --- characters and grams ---------------------------------------------------------------

def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of lower-cased texts, a space around each and for white space, and where each ends."""
    low = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    points = np.where(points <= 0xA0, _FOLD[np.minimum(points, 0xA0)], points)
    return points, np.cumsum(np.fromiter(map(len, low), np.int64, len(low)))


def grams(c: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit name of the ORDER-gram at each character, to find equal ones within a batch, and which of
    them lie within one text."""
    n = max(len(c) - ORDER + 1, 0)
    name = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(ORDER):
            name = (name ^ (name >> np.uint64(31))) * _POWER + c[i: i + n]
    inside = np.ones(n, bool)
    for k in range(1, ORDER):
        at = ends - k
        inside[at[(at >= 0) & (at < n)]] = False
    return name, inside


def exact(c: np.ndarray, at: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The last ``order`` characters of the ORDER-grams at ``at``: up to two in ``hi``, the last three in ``lo``."""
    hi, lo = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    for i in range(ORDER - order, ORDER):
        x = c[at + i]
        if i < ORDER - 3:
            hi = (hi << np.uint64(CHAR_BITS)) | x
        else:
            lo = (lo << np.uint64(CHAR_BITS)) | x
    return hi, lo


def context_of(hi, lo):
    """(hi, lo) of a gram without its last character; for numpy arrays."""
    one = np.uint64((1 << CHAR_BITS) - 1)
    return hi >> np.uint64(CHAR_BITS), ((hi & one) << np.uint64(2 * CHAR_BITS)) | (lo >> np.uint64(CHAR_BITS))


def key_of(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = (hi ^ (lo >> np.uint64(33))) * _MIX + lo * _POWER
        return key ^ (key >> np.uint64(32))


def slots(key: np.ndarray, bits: int, depth: int) -> np.ndarray:
    """The slot of each gram in the table at ``depth``, one of 2**bits."""
    with np.errstate(over="ignore"):
        mixed = key * _MIX
        for _ in range(depth):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX_NEXT
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def hash_tables(key: np.ndarray, pairs: np.ndarray) -> list[np.ndarray]:
    """Tables of rows (gram + 1, pair of floats) that hold every gram: those whose slot is taken go on to
    the next table, sized by their number.  A slot of 0 is empty."""
    value = np.ascontiguousarray(pairs, np.float32).view(np.uint64).ravel()
    out = []
    while len(key):
        bits = max(1, (len(key) - 1).bit_length())
        at = slots(key, bits, len(out))
        owner = np.empty(1 << bits, np.int64)
        owner[at] = np.arange(len(key))
        stays = owner[at] == np.arange(len(key))
        table = np.zeros((1 << bits, 2), np.uint64)
        table[at[stays], 0] = key[stays] + np.uint64(1)
        table[at[stays], 1] = value[stays]
        out.append(table)
        key, value = key[~stays], value[~stays]
    return out


def look_up(default: float, tables: list[np.ndarray], key: np.ndarray) -> np.ndarray:
    """The pair of each gram, ``default`` twice for those that no table holds."""
    found = np.full((len(key), 2), default, np.float32)
    out, rest, wanted = found.view(np.uint64).ravel(), None, key + np.uint64(1)
    for depth, table in enumerate(tables):
        row = np.take(table, slots(wanted - np.uint64(1), len(table).bit_length() - 1, depth), axis=0)
        hit = row[:, 0] == wanted
        at = np.flatnonzero(hit)
        out[at if rest is None else rest[at]] = row[at, 1]
        on = np.flatnonzero(~hit & (row[:, 0] != 0))
        if not len(on):
            break
        rest, wanted = on if rest is None else rest[on], wanted[on]
    return found


def _cut(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BATCH_CHARS characters."""
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 2
        if size >= BATCH_CHARS:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


# --- counts and the model -----------------------------------------------------------------

def count_grams(labelled: DataFrame) -> DataFrame:
    """Rows (hi, lo, c0, c1): how often each ORDER-gram occurs in texts of label 0 and 1;
    ``labelled`` has the columns label (int) and text."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = np.asarray(batch.column(0)).astype(np.uint64)
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _cut(texts):
                c, ends = codes(texts[a:b])
                name, inside = grams(c, ends)
                if not len(name):
                    continue
                own = np.repeat(label[a:b], np.diff(ends, prepend=0))[: len(name)]
                where = np.flatnonzero(inside)
                _, first, n = np.unique(((name << np.uint64(1)) | own)[where], return_index=True, return_counts=True)
                at = where[first]
                hi, lo = exact(c, at)
                toxic = own[at].astype(bool)
                yield pa.RecordBatch.from_pydict({
                    "hi": pa.array(hi.astype(np.int64)), "lo": pa.array(lo.astype(np.int64)),
                    "c0": pa.array(np.where(toxic, 0, n)), "c1": pa.array(np.where(toxic, n, 0))})

    each = labelled.select(F.col("label").cast("int"), "text").mapInArrow(count, "hi long, lo long, c0 long, c1 long")
    return each.groupBy("hi", "lo").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def _without_last() -> tuple[Column, Column]:
    hi, lo, one = F.col("hi"), F.col("lo"), F.lit((1 << CHAR_BITS) - 1)
    return F.shiftright(hi, CHAR_BITS), F.shiftleft(hi.bitwiseAND(one), 2 * CHAR_BITS).bitwiseOR(F.shiftright(lo, CHAR_BITS))


def _last(order: int) -> tuple[Column, Column]:
    """(hi, lo) of the last ``order`` characters."""
    high, low = max(0, order - 3), min(3, order)
    return (F.col("hi").bitwiseAND(F.lit((1 << (CHAR_BITS * high)) - 1)), F.col("lo").bitwiseAND(F.lit((1 << (CHAR_BITS * low)) - 1)))


def model_rows(top: DataFrame) -> DataFrame:
    """The smoothed model as rows (tab, hi, lo, v0, v1): tab 2j holds the discounted probabilities of
    order j, tab 2j + 1 the weights that contexts of order j give to the next lower order."""
    parts, rows = [], top
    for order in range(ORDER, 0, -1):
        if order < ORDER:
            pick = ("c0", "c1") if order > SHARED else ("n", "n")
            rows = rows.select("hi", "lo", *[F.col(c).alias(f"c{k}") for k, c in enumerate(pick)])
        ones = [F.sum(F.when(F.col(c) == k, 1).otherwise(0)) for c in ("c0", "c1") for k in (1, 2)]
        a0, b0, a1, b1 = (float(x or 0) for x in rows.agg(*ones).first())
        cut = [min(0.95, max(0.05, a / (a + 2 * b))) if a else 0.5 for a, b in ((a0, b0), (a1, b1))]
        chi, clo = _without_last()
        total = rows.groupBy(chi.alias("chi"), clo.alias("clo")).agg(
            *[F.sum(c).cast("double").alias(f"total{k}") for k, c in enumerate(("c0", "c1"))],
            *[F.sum((F.col(c) > 0).cast("int")).alias(f"types{k}") for k, c in enumerate(("c0", "c1"))])
        share = [F.when(F.col(f"total{k}") > 0, F.greatest(F.col(f"c{k}") - cut[k], F.lit(0.0)) / F.col(f"total{k}")).otherwise(0.0)
                 for k in (0, 1)]
        weight = [F.when(F.col(f"total{k}") > 0, F.col(f"types{k}") * cut[k] / F.col(f"total{k}")).otherwise(1.0) for k in (0, 1)]
        parts.append(rows.withColumn("chi", chi).withColumn("clo", clo).join(total, ["chi", "clo"]).select(
            F.lit(2 * order).alias("tab"), "hi", "lo", share[0].alias("v0"), share[1].alias("v1")))
        parts.append(total.select(F.lit(2 * order + 1).alias("tab"), F.col("chi").alias("hi"), F.col("clo").alias("lo"),
                                  weight[0].alias("v0"), weight[1].alias("v1")))
        if order > 1:  # continuations: how many different characters stand before the suffix
            shi, slo = _last(order - 1)
            rows = stage(rows.groupBy(shi.alias("hi"), slo.alias("lo")).agg(
                F.sum((F.col("c0") > 0).cast("int")).alias("c0"), F.sum((F.col("c1") > 0).cast("int")).alias("c1"),
                F.count("*").alias("n")), "grams")

    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    return every.select("tab", "hi", "lo", F.col("v0").cast("float").alias("v0"), F.col("v1").cast("float").alias("v1"))


def write_model(top: DataFrame) -> Store:
    """Write the model of the counted grams (hi, lo, c0, c1) to the shared folder, by order and bucket."""
    path = new_folder(top.sparkSession, "model")
    buckets = max(1, -(-top.count() // BUCKET_ROWS))
    place = (F.col("lo") % _PRIME + F.col("hi") % _PRIME) % buckets
    model_rows(top).withColumn("bucket", place.cast("int")).repartition("tab", "bucket") \
        .write.partitionBy("tab", "bucket").parquet(path)
    return Store(path, buckets)


class Store:
    """Reads the written model, in any task: the pairs of grams of one table, bucket by bucket."""

    def __init__(self, path: str, buckets: int):
        self.path, self.buckets = path, buckets
        self.held: OrderedDict[tuple[int, int], list[np.ndarray]] = OrderedDict()

    def __reduce__(self):
        return _open_store, (self.path, self.buckets)  # a worker keeps one, with what it holds

    def tables(self, tab: int, bucket: int) -> list[np.ndarray]:
        if (tab, bucket) in self.held:
            self.held.move_to_end((tab, bucket))
            return self.held[tab, bucket]
        files, root = pafs.FileSystem.from_uri(self.path)
        folder = f"{root}/tab={tab}/bucket={bucket}"
        made = []
        if files.get_file_info(folder).type != pafs.FileType.NotFound:
            found = pq.read_table(folder, columns=["hi", "lo", "v0", "v1"], filesystem=files, partitioning=None)
            hi, lo, v0, v1 = (found.column(c).to_numpy() for c in ("hi", "lo", "v0", "v1"))
            made = hash_tables(key_of(hi.view(np.uint64), lo.view(np.uint64)), np.stack([v0, v1], axis=1))
        self.held[tab, bucket] = made
        while len(self.held) > 1 and sum(t.nbytes for one in self.held.values() for t in one) > HELD_BYTES:
            self.held.popitem(last=False)
        return made

    def pairs(self, tab: int, default: float, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The pair of each gram, ``default`` twice for those that the table doesn't hold."""
        key = key_of(hi, lo)
        if self.buckets == 1:
            return look_up(default, self.tables(tab, 0), key)
        out = np.full((len(key), 2), default, np.float32)
        place = (lo % np.uint64(_PRIME) + hi % np.uint64(_PRIME)) % np.uint64(self.buckets)
        order = np.argsort(place, kind="stable")
        cuts = np.searchsorted(place[order], np.arange(self.buckets + 1, dtype=np.uint64))
        for b, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if j > i:
                out[order[i:j]] = look_up(default, self.tables(tab, b), key[order[i:j]])
        return out


_STORES: dict[tuple[str, int], Store] = {}


def _open_store(path: str, buckets: int) -> Store:
    if (path, buckets) not in _STORES:
        _STORES.clear()  # of an earlier model
        _STORES[path, buckets] = Store(path, buckets)
    return _STORES[path, buckets]


def ratios(model: Store, texts: list[str]) -> np.ndarray:
    """x of each text."""
    out = np.zeros(len(texts))
    for a, b in _cut(texts):
        c, ends = codes(texts[a:b])
        name, inside = grams(c, ends)
        if not len(name):
            continue
        _, at, place = np.unique(name, return_index=True, return_inverse=True)
        p = np.full((len(at), 2), 1.0 / ALPHABET, np.float32)
        for order in range(1, ORDER + 1):
            hi, lo = exact(c, at, order)
            p *= model.pairs(2 * order + 1, 1.0, *context_of(hi, lo))
            p += model.pairs(2 * order, 0.0, hi, lo)
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.log(p[:, 1] / p[:, 0])[place]
        step[~inside | ~np.isfinite(step)] = 0
        total = np.concatenate(([0.0], np.cumsum(step, dtype=np.float64)))
        starts = ends - np.diff(ends, prepend=0)
        size = ends - starts
        out[a:b] = (total[np.minimum(ends, len(name))] - total[np.minimum(starts, len(name))]) / (
            np.maximum(size - ORDER + 1, 0) + PRIOR_CHARS)
    return out


# --- the logistic function --------------------------------------------------------------------

def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and middle of the logistic function that fits labels y to x (Platt's targets, Newton steps)."""
    pos, neg = int(y.sum()), int((1 - y).sum())
    if not pos or not neg:
        return DEFAULT_FIT
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = x.std() or 1.0
    z = np.stack([x / scale, np.ones(len(x))], axis=1)
    w, ridge = np.zeros(2), np.diag([1e-3, 1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - target) + ridge @ w
        h = (z * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ z + ridge
        d = np.linalg.solve(h, g)
        w -= d * min(1.0, 2.0 / np.abs(d).max())
        if np.abs(d).max() < 1e-9:
            break
    if w[0] <= 0:  # the value says nothing, or the opposite: too few rows to go by
        return DEFAULT_FIT
    return float(w[0] / scale), float(-w[1] * scale / w[0])


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


@dataclass
class Model:
    """The written gram model, and slope and middle of the logistic function."""

    store: Store
    slope: float
    middle: float

    def value(self, text: Column | str) -> Column:
        """x of a text column."""
        store = self.store

        @F.pandas_udf("double")
        def of(texts: pd.Series) -> pd.Series:
            return pd.Series(ratios(store, [t or "" for t in texts]))

        return of(text)

    def score(self, x: Column | str) -> Column:
        x = F.col(x) if isinstance(x, str) else x
        return F.lit(1.0) / (1 + F.exp(-F.lit(self.slope) * (x - F.lit(self.middle))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max(label_col).alias("label"))
    aside = F.floor(F.crc32(F.col("id").cast("string")) / 3) % 8 == 0
    known = known.filter(~held_out("id"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(~held_out("id"))
    known = known.hint("merge")  # neither side is bounded, so neither is broadcast at any size
    counted = stage(count_grams(known.filter(~aside).join(texts.filter(~aside), "id").select("label", "text")), "grams")
    rest = stage(known.filter(aside).join(texts.filter(aside), "id").select("id", "label", "text"), "aside")
    sample = known.filter(aside).orderBy(F.xxhash64("id"), "id").limit(CALIBRATION_ROWS).select("id").hint("merge")
    first = Model(write_model(counted), *DEFAULT_FIT)
    # A repeated id brings all its rows, so the bound holds once more after the join.
    rows = sample.join(rest, "id").select("id", "label", first.value("text").alias("x")) \
        .orderBy(F.xxhash64("id"), "id", "x").limit(CALIBRATION_ROWS).collect()
    fitted = fit(np.array([r.x for r in rows]), np.array([r.label for r in rows], float)) if rows else DEFAULT_FIT
    every = counted.unionByName(count_grams(rest)).groupBy("hi", "lo").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    return Model(write_model(stage(every, "grams")), *fitted)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Rows (doc_id, held_out, x, score, predicted), one for each row of ``docs``."""
    model = train(docs, labels, id_col, text_col, label_col)
    out = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), model.value(text_col).alias("x"))
    out = out.withColumn("score", model.score("x"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``docs`` without the rows predicted toxic."""
    model = train(docs, labels, id_col, text_col, label_col)
    x = free_name(docs, "x")
    return docs.withColumn(x, model.value(text_col)).filter(model.score(x) < THRESHOLD).select(*docs.columns)
