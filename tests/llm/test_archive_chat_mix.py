"""WARC archive (op1), mixing (op3) and chat formatting (op8)."""

import base64
import hashlib
import random
import re
from collections import Counter

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from motorsight.llm import chat, mixing, queries, warc
from motorsight.llm.common import new_folder

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "conversations")


@pytest.mark.parametrize("name", ["op1_warc", "op3_mixing", "op8_chat", "op9_line_dedup"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.SQL[name]})").fetchall()
    assert Counter(tuple(r) for r in df.select(*cols).collect()) == Counter(want)


# --- WARC ---------------------------------------------------------------------------------------

PAGES = [(5, "http://a/x", "<p>é</p>"), (2, "http://b/ y\r\nEvil: 1", "<p>é</p>"), (2, "http://b/ y\r\nEvil: 1", "<p>é</p>"),
         (None, "u", "<p>é</p>"), (7, None, None), (1, "z", ""), (9, "big", "w\r\n\r\nWARC/1.1\r\n" * 3000), (9, "big2", "other")]


def archive(spark, rows=PAGES, **more):
    folder = new_folder(spark, "t")
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    warc.write_archive(df, folder, **more)
    return folder


def parse_warc(record):
    """A plain reader of one record: fields, HTTP head, payload."""
    head, rest = bytes(record).split(b"\r\n\r\n", 1)
    lines = head.decode().split("\r\n")
    assert lines[0] == "WARC/1.1" and rest.endswith(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[:-4]
    assert int(fields["Content-Length"]) == len(block)
    http, payload = block.split(b"\r\n\r\n", 1)
    return fields, http, payload


def test_records_are_sound_warc(spark):
    folder = archive(spark)
    got = [parse_warc(r.record) for r in warc.records(spark, folder).collect()]
    assert len(got) == len(PAGES) and len({f["WARC-Record-ID"] for f, _, _ in got}) == len(PAGES)
    by_id = {f["WARC-Record-ID"]: (f, p) for f, _, p in got}
    kinds = Counter(f["WARC-Type"] for f, _, _ in got)
    assert kinds == {"response": 4, "revisit": 4}
    for f, http, payload in got:
        if f["WARC-Type"] == "revisit":
            source, body = by_id[f["WARC-Refers-To"]]
            assert payload == b"" and source["WARC-Type"] == "response"
            assert source["WARC-Payload-Digest"] == f["WARC-Payload-Digest"]
        else:
            digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            assert f["WARC-Payload-Digest"] == f"sha1:{digest}"
        assert "Evil" not in f and re.fullmatch("[^ \r\n]+", f["WARC-Target-URI"])
    assert spark.read.parquet(f"{folder}/payloads").count() == 4


def test_originals_and_first_records(spark):
    rows = warc.originals(spark, archive(spark)).collect()
    assert Counter((r.page_id, bytes(r.payload).decode()) for r in rows) == Counter((p, h or "") for p, _, h in PAGES)
    kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in rows)
    assert kinds == Counter([(2, "response", None), (2, "revisit", 2), (5, "revisit", 2), (None, "revisit", 2),
                             (1, "response", None), (7, "revisit", 1), (9, "response", None), (9, "response", None)])
    small = warc.originals(spark, archive(spark, least_bytes=1)).filter("page_id in (1, 7)").collect()
    assert [r.record_type for r in small] == ["response"] * 2
    assert warc.originals(spark, archive(spark, [])).count() == 0


def test_damaged_and_missing_payloads_are_found(spark):
    folder = archive(spark)
    payloads = spark.read.parquet(f"{folder}/payloads")
    bad = new_folder(spark, "t")
    spark.read.parquet(f"{folder}/headers").write.parquet(f"{bad}/headers")
    payloads.withColumn("payload", F.concat("payload", F.lit(b"!"))).write.parquet(f"{bad}/payloads")
    with pytest.raises(Exception, match="does not fit its digest"):
        warc.originals(spark, bad).collect()
    gone = new_folder(spark, "t")
    spark.read.parquet(f"{folder}/headers").write.parquet(f"{gone}/headers")
    payloads.limit(1).write.parquet(f"{gone}/payloads")
    with pytest.raises(Exception, match="no payload"):
        warc.originals(spark, gone).collect()


# --- mixing ---------------------------------------------------------------------------------------

def test_copies_equal_plain_draws_and_meet_the_weights(spark):
    rnd = random.Random(2)
    rows = [(i, "x" * rnd.randint(1, 200), rnd.choice(["a", "a", "a", "b", None])) for i in range(3000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, mix_n int")
    weights = {"a": 1.0, "b": 2.0, None: 100.0}
    table = {r.source: r.rate for r in mixing.rates(df, weights).collect()}
    out = mixing.mix(df, weights, 7)
    assert out.columns == [*df.columns, "copy", "shuffle_key"]
    got = Counter(r.doc_id for r in out.collect())
    assert max(table.values()) < 16 * 6
    assert got == Counter({i: n for i, _, s in rows if (n := mixing.draw_plainly(7, i, table[s]))})
    size = Counter()
    for i, t, s in rows:
        size[s] += len(t) * got[i]
    total = sum(len(t) for _, t, _ in rows)
    for s, w in weights.items():
        assert size[s] == pytest.approx(total * w / 103, rel=0.25)


def test_large_rates_and_edges(spark, monkeypatch):
    rows = [(1, "ab", "few"), (None, None, "none"), (3, "c" * 1000, "much"), (3, "c" * 1000, "much")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)  # the way without a broadcast
    table = {r.source: r.rate for r in mixing.rates(df, {"few": 1.0, "much": 0.0, "none": 0.0}).collect()}
    assert table["few"] == pytest.approx(1001) and table["none"] == 1.0
    got = Counter(r.doc_id for r in mixing.mix(df, {"few": 1.0, "much": 0.0, "none": 0.0}, 1).collect())
    assert got == {1: mixing.draw_plainly(1, 1, table["few"]), None: 1}
    assert abs(got[1] - 1001) < 160
    assert mixing.mix(df.limit(0), {}, 1).count() == 0


def test_order_is_a_shuffle_by_key(spark):
    df = spark.range(500).selectExpr("id as doc_id", "'t' as text", "'s' as source")
    parts = mixing.mix(df, {}, 3).rdd.glom().collect()
    assert all([r.shuffle_key for r in p] == sorted(r.shuffle_key for r in p) for p in parts)
    first = [r.doc_id for p in parts for r in p]
    assert first != sorted(first)


# --- chat -----------------------------------------------------------------------------------------

HARD = st.text(alphabet="\\#<>/:\nlhctu rn</turn>é中", max_size=30)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a:\n#", "system"]), HARD), min_size=1, max_size=6))
def test_texts_come_back(spark, turns):
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    rows = chat.examples(df).select("*", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(
        F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("loss")).collect()
    full = next(r for r in rows if r.complete)
    assert [(t.role, t.text) for t in full.turns] == turns
    replies = [i for i, (r, _) in enumerate(turns) if r == "assistant"]
    assert sorted(r.target for r in rows if r.target is not None) == replies
    for r in rows:
        if r.target is None:
            assert r.loss == "" and r.loss_chars == 0
        else:
            assert [(t.role, t.text) for t in r.turns] == turns[: r.target + 1] and r.loss == turns[r.target][1]
        assert "<" not in r.formatted.replace("</turn>\n", "") and r.formatted.count("</turn>") == len(r.turns)


def test_chat_runs_without_python(spark):
    plan = queries.op8_chat(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_chat_edge_rows(spark):
    rows = [(1, 0, None, None), (1, None, "user", "first"), (1, 0, "assistant", ""), (1, 0, "assistant", ""), (None, 3, "user", "lone"),
            (None, 3, "user", "lone"), (2, 0, "user", "x" * 100000), (2, 1, "assistant", "y")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, target int")
    out = chat.examples(df).select("*", F.size(chat.parse(F.col("formatted"))).alias("n")).collect()
    assert sorted((r.conv_id or 0, r.n, r.target is not None, r.complete) for r in out) == [
        (0, 1, False, True), (0, 1, False, True), (1, 3, True, False), (1, 4, True, True), (2, 2, True, True)]
    assert chat.examples(df.limit(0)).count() == 0


def test_mix_with_clashing_columns(spark):
    rows = [(i, "src0" if i % 2 else "b", "some text", 7, "k", 1.5) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, copy int, shuffle_key string, mix_n double")
    out = mixing.mix(df, {"src0": 3.0}, 5)
    assert out.columns == [*df.columns, "_copy", "_shuffle_key"]
    plain = mixing.mix(df.drop("copy", "shuffle_key", "mix_n"), {"src0": 3.0}, 5)
    assert Counter(r.doc_id for r in out.collect()) == Counter(r.doc_id for r in plain.collect())
    assert all(r["copy"] == 7 and r.shuffle_key == "k" and r.mix_n == 1.5 for r in out.collect())


def test_a_row_repeated_very_often_is_numbered_in_runs(spark, monkeypatch):
    monkeypatch.setattr(warc, "REPEATS", 3)
    rows = [(1, "u", "same")] * 20 + [(2, "u", "same"), (3, "v", "other")]
    folder = archive(spark, rows)
    got = [parse_warc(r.record)[0] for r in warc.records(spark, folder).collect()]
    assert len(got) == 22 and len({f["WARC-Record-ID"] for f in got}) == 22
    assert Counter(f["WARC-Type"] for f in got) == {"response": 2, "revisit": 20}
    assert Counter(r.page_id for r in warc.originals(spark, folder).collect()) == {1: 20, 2: 1, 3: 1}
