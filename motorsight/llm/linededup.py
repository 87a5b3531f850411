"""Line de-duplication by overlapping three-line windows.

Every three consecutive non-blank lines of a document are a window (lines compared
without blanks, tabs and carriage returns at their ends).  Of windows with equal lines,
in order of (doc_id, place), the first occurrence stays; all later ones are removed:
their covered spans of lines are merged, and what lies between the spans is kept.
A removed line has an equal line earlier, so the earliest occurrence of every line stays.

Scale: windows are written as narrow rows (two 64-bit hashes, document, first and last
line).  First occurrences come from an aggregation with map-side combine, so a passage that
a third of all documents share is reduced before the shuffle; the join that finds later
occurrences is on the window hash, whose hot values adaptive execution splits.  The texts
are shuffled once, on the document.

Defined results: null texts stay null; texts of fewer than three non-blank lines have no
window and stay; a text all of whose lines go becomes empty, its row stays; null doc_ids come
after all others; rows with equal doc_id and text are one document and are treated alike;
very long texts are split whole (their lines must fit in a row); an empty table gives no rows.  Helper columns
and the removed count get free names: underscores in front where an input column has the name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, stage

BLANKS = " \t\r"


def windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (h1, h2, no_id, id, th, a, b): window hash, document, first and last line (from 0)."""
    lines = F.transform(F.split(F.col(text_col), "\n"), lambda x, i: F.struct(i.alias("at"), F.btrim(x, F.lit(BLANKS)).alias("line")))
    lines = F.filter(lines, lambda x: x["line"] != "")
    rows = docs.filter(F.col(text_col).isNotNull()).select(
        F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), lines.alias("lines"))
    three = F.arrays_zip(F.col("lines").alias("x"), F.slice("lines", 2, F.size("lines")).alias("y"),
                         F.slice("lines", 3, F.size("lines")).alias("z"))
    rows = rows.filter(F.size("lines") >= 3).select("no_id", "id", "th", F.explode(three).alias("w")).filter("w.z is not null")
    return rows.select(
        F.xxhash64("w.x.line", "w.y.line", "w.z.line").alias("h1"),
        F.xxhash64(F.lit(3), "w.z.line", "w.y.line", "w.x.line").alias("h2"),
        "no_id", "id", "th", F.col("w.x.at").alias("a"), F.col("w.z.at").alias("b"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (no_id, id, th, spans): for each document with later occurrences, the merged spans of lines
    that they cover, as an ordered array of (a, b)."""
    found = stage(windows(docs, id_col, text_col), "windows")
    place = F.struct("no_id", "id", "th", "a")
    first = found.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1")
    later = found.join(first.select("h1", "h2", "first"), ["h1", "h2"]).filter(~place.eqNullSafe(F.col("first")))
    # Rows of equal doc_id and text bring the same windows again.
    later = later.select("no_id", "id", "th", "a", "b").distinct()
    doc = ["no_id", "id", "th"]
    before = Window.partitionBy(*doc).orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    island = Window.partitionBy(*doc).orderBy("a").rowsBetween(Window.unboundedPreceding, 0)
    marked = later.withColumn("reach", F.max("b").over(before))
    marked = marked.withColumn("island", F.sum(F.when(F.col("a") > F.col("reach") + 1, 1).otherwise(0)).over(island))
    spans = marked.groupBy(*doc, "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return spans.groupBy(*doc).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("spans"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed_col: str | None = None) -> DataFrame:
    """``docs`` with later occurrences cut out of ``text_col``; ``removed_col``, if named, gets the
    number of removed lines."""
    removed_col = removed_col and free_name(docs, removed_col)
    th, cut_id, cut_th, spans = (free_name(docs, n) for n in ("th", "cut_id", "cut_th", "spans"))
    cuts = repeated_spans(docs, id_col, text_col).select(
        F.col("id").alias(cut_id), F.col("th").alias(cut_th), F.col("spans").alias(spans))
    rows = docs.withColumn(th, F.xxhash64(text_col))
    rows = rows.join(cuts, F.col(id_col).eqNullSafe(F.col(cut_id)) & (F.col(th) == F.col(cut_th)), "left")
    lines = F.split(F.col(text_col), "\n")
    s, n = F.col(spans), F.size(lines)
    between = F.transform(s, lambda x, i: F.slice(
        lines, F.when(i == 0, 1).otherwise(F.get(s, i - 1)["b"] + 2),
        x["a"] - F.when(i == 0, 0).otherwise(F.get(s, i - 1)["b"] + 1)))
    end = F.element_at(s, -1)["b"] + 2
    after = F.slice(lines, end, F.greatest(n - end + 1, F.lit(0)))
    kept = F.array_join(F.concat(F.flatten(between), after), "\n")
    out = rows.withColumn(text_col, F.when(s.isNull(), F.col(text_col)).otherwise(kept))
    if removed_col:
        gone = F.aggregate(s, F.lit(0).cast("long"), lambda t, x: t + x["b"] - x["a"] + 1)
        out = out.withColumn(removed_col, F.when(s.isNull(), F.lit(0).cast("long")).otherwise(gone))
    return out.select(*docs.columns, *([removed_col] if removed_col else []))
