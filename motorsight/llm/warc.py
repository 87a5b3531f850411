"""Content-addressed WARC archive.

``write_archive`` makes a WARC 1.1 record of each page and stores it in two tables:
``payloads`` holds every distinct payload once, under its SHA-256 digest, and ``headers``
holds the exact WARC and HTTP headers of each record with the digest of its payload.
Among records with equal payloads that with the least page id is a response; the others
are revisits of it (profile identical-payload-digest), whose blocks end with their HTTP head.
``records`` and ``originals`` join headers and payloads again: the former to the records as
archived, the latter with the full payload for every page.  Each payload is hashed again when it
is read, and a payload that does not fit its digest ends the read with an error.

Scale: first records come from an aggregation of narrow rows (digest and page id) with
map-side combine, so one payload under a third of all pages is no hot key there; payloads are
combined per task before their one shuffle.  The joins on the digest are plain
shuffle joins, whose hot digests adaptive execution splits.

Defined results: a null html is an empty payload; payloads shorter than ``least_bytes`` are never
revisited; null page ids come after all others, among equal page ids the least url is
first (null last), and of rows repeated whole one is first; control characters and
spaces in a url are percent-encoded in its header, a null url is ``urn:page:<id>``; payloads of any length
are stored whole; an empty table gives an empty archive.  Only the id, url and html columns are read, so other
columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_END = b"\r\n\r\n"
#: Records of one repeated row that are numbered in one task.
REPEATS = 1 << 16
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGITS32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def sha1_base32(payload: Column) -> Column:
    """SHA-1 in base 32: 40 hex digits, five (20 bits) to four letters."""
    h = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(h, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), _DIGITS32, _BASE32)


def _line(name: str, value: Column | str) -> Column:
    value = F.lit(value) if isinstance(value, str) else value
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _optional(name: str, value: Column) -> Column:
    return F.when(value.isNull(), "").otherwise(_line(name, value))


def _uuid(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _uri(url: Column, page_id: Column) -> Column:
    """The url without characters that end a header line."""
    out = url
    for c in (" ", "\r", "\n", "\t", "\x00"):
        out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return F.coalesce(out, F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none"))))


def write_archive(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z",
                  id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write one record per row of ``pages`` into the tables ``headers`` and ``payloads`` under ``folder``."""
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    stage(rows.groupBy("digest").agg(F.any_value("payload").alias("payload")), "payloads", f"{folder}/payloads")

    narrow = rows.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("bytes"),
                         sha1_base32(F.col("payload")).alias("sha1"))
    key = F.struct(F.col("page_id").isNull().alias("a"), F.col("page_id").alias("page_id"),
                   F.col("url").isNull().alias("b"), F.col("url").alias("url"))
    first = narrow.filter(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min(key).alias("first"))
    # Rows repeated whole are told apart by their number.
    each = narrow.groupBy("page_id", "url", "digest", "bytes", "sha1").agg(F.count("*").alias("n"))
    # A row repeated very often is numbered in runs of REPEATS, which are dealt to many tasks.
    each = each.join(first, "digest", "left")
    each = each.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / REPEATS))))
    each = each.repartition("digest", "page_id", "url", "run")
    each = each.withColumn("i", F.explode(F.sequence(F.col("run") * REPEATS + 1, F.least(F.col("n"), (F.col("run") + 1) * REPEATS))))
    revisit = F.coalesce(~((F.col("i") == 1) & key.eqNullSafe(F.col("first"))) & F.col("first").isNotNull(), F.lit(False))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), _line("Content-Type", "text/html; charset=utf-8"),
                    _line("Content-Length", F.col("bytes").cast("string")), F.lit("\r\n"))
    length = F.length(head) + F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("bytes"))
    first_id, first_url = F.col("first.page_id"), F.col("first.url")
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        _line("WARC-Record-ID", _uuid(F.col("page_id"), F.col("url"), F.col("digest"), F.col("i"))),
        _line("WARC-Date", date),
        _line("WARC-Target-URI", _uri(F.col("url"), F.col("page_id"))),
        _optional("Page-ID", F.col("page_id").cast("string")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(F.col("revisit"), F.concat(
            _line("WARC-Profile", PROFILE),
            _line("WARC-Refers-To", _uuid(first_id, first_url, F.col("digest"), F.lit(1))),
            _line("WARC-Refers-To-Target-URI", _uri(first_url, first_id)),
            _line("WARC-Refers-To-Date", date),
            _optional("Refers-To-Page-ID", first_id.cast("string")))).otherwise(""),
        _line("Content-Type", "application/http; msgtype=response"),
        _line("Content-Length", length.cast("string")),
        F.lit("\r\n"), head)
    out = each.withColumn("revisit", revisit).select(
        F.encode(header, "UTF-8").alias("header"), "digest", F.col("bytes").alias("payload_bytes"), "revisit")
    stage(out, "headers", f"{folder}/headers")


def _joined(spark: SparkSession, folder: str) -> DataFrame:
    payloads = spark.read.parquet(f"{folder}/payloads")
    sound = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("payload does not fit its digest "), F.col("digest"))).cast("binary"))
    headers = spark.read.parquet(f"{folder}/headers")
    # A left join, so that a header without its payload is found and not dropped.
    rows = headers.join(payloads.select("digest", sound.alias("payload")), "digest", "left")
    whole = F.when(F.col("payload").isNotNull(), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("no payload for digest "), F.col("digest"))).cast("binary"))
    return rows.withColumn("payload", whole)


def records(spark: SparkSession, folder: str) -> DataFrame:
    """The records as archived: column ``record``, from ``WARC/1.1`` to the closing empty lines."""
    block = F.when(F.col("revisit"), F.lit(b"")).otherwise(F.col("payload"))
    return _joined(spark, folder).select(F.concat("header", block, F.lit(RECORD_END)).alias("record"))


def field(header: Column, name: str) -> Column:
    """The value of a named field in the WARC header (null if it has none)."""
    head = F.substring_index(header.cast("string"), "\r\n\r\n", 1)
    found = F.regexp_extract(head, f"(?m)^{name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def originals(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's record with its full payload: (header, payload, record_type, page_id, refers_to)."""
    head = F.col("header")
    return _joined(spark, folder).select(
        "header", "payload", field(head, "WARC-Type").alias("record_type"),
        field(head, "Page-ID").cast("long").alias("page_id"), field(head, "Refers-To-Page-ID").cast("long").alias("refers_to"),
        field(head, "WARC-Payload-Digest").alias("said_digest"))
