"""Streams equal batch on closed windows; a late row is dropped; state carries across batches."""

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from conftest import SF_SMALL
from motorsight.session import scratch_path
from motorsight.streaming import streams as ST


def _three_files(spark):
    """Events of sf0.001 in three files by time, then one late row in a fourth file."""
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    folder = scratch_path(spark, f"test-stream-{uuid.uuid4().hex}")
    q = ev.approxQuantile("event_id", [1 / 3, 2 / 3], 0.0)
    parts = [ev.filter(F.col("event_id") < q[0]), ev.filter((F.col("event_id") >= q[0]) & (F.col("event_id") < q[1])),
             ev.filter(F.col("event_id") >= q[1])]
    for i, p in enumerate(parts):
        p.coalesce(1).write.mode("overwrite").parquet(f"{folder}/part{i}")
    late = ev.orderBy("ts").limit(1).withColumn("event_id", F.lit(10**9)).withColumn("value", F.lit(99.0))
    late.coalesce(1).write.mode("overwrite").parquet(f"{folder}/part3")
    return ev, folder


def test_daily_windows_equal_batch_and_late_row_dropped(spark):
    ev, folder = _three_files(spark)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True) \
        .parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))
    out = spark.read.parquet(ST.run_available_now(ST.daily_risk(ST.telemetry_scores(stream)), "t_daily"))
    batch_scored = ST.telemetry_scores(ev.withColumn("ts", F.col("ts").cast("timestamp")))
    wm = batch_scored.agg(F.max("ts")).first()[0]
    batch = batch_scored.groupBy("machine_id", F.window("ts", "1 day")).agg(
        F.max("rank").alias("max_rank"), F.avg("p").alias("mean_p"), F.count(F.lit(1)).alias("n")) \
        .select("machine_id", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                "max_rank", "mean_p", "n")
    import datetime
    closed = batch.filter(F.col("window_end") <= F.lit(wm - datetime.timedelta(hours=1)))
    def rows(df):
        return sorted((r.machine_id, r.window_start, r.max_rank, round(r.mean_p, 9), r.n) for r in df.collect())
    assert rows(out) == rows(closed)        # the late row (id 1e9) changed no window


FAR = 2_000_000_000


def _ema_of_files(spark, files, **more):
    """The stream's EMA of readings (machine, id, x, epoch second), a file for each micro-batch, and a last
    file far after them that moves the watermark past all."""
    folder = scratch_path(spark, f"test-stream-{uuid.uuid4().hex}")
    kind = "machine_id long, event_id long, x double, at long"
    for rows in [*files, [(-1, -1, None, FAR)]]:  # file streams take the oldest file first
        spark.createDataFrame(rows, kind).withColumn("ts", F.timestamp_seconds("at")).drop("at").coalesce(1) \
            .write.mode("append").parquet(f"{folder}/t.parquet")
    stream = ST.table_stream(spark, f"{folder}/t.parquet", spark.read.parquet(f"{folder}/t.parquet").schema, max_files=1)
    out = spark.read.parquet(ST.run_available_now(ST.stateful_ema(stream, 3, **more), "t_ema"))
    return out.filter("machine_id >= 0").toPandas().sort_values(["machine_id", "ts", "event_id"])


def test_ema_of_rows_out_of_order_across_batches(spark):
    """Readings up to the delay late, in other micro-batches than their neighbours, give W5 of the whole series."""
    rnd = np.random.default_rng(7)
    rows = [(m, i, None if i % 11 == 3 else float(rnd.integers(0, 50)), 1_700_000_000 + 300 * i + m) for m in (1, 2, 3) for i in range(120)]
    late = sorted(rows, key=lambda r: r[3] + rnd.integers(0, 3000))  # shifted by up to 50 minutes
    files = [late[k: k + 60] for k in range(0, len(late), 60)]
    assert any(min(r[3] for r in b) < max(r[3] for r in a) for a, b in zip(files, files[1:]))
    got = _ema_of_files(spark, files, delay="1 hour")
    assert len(got) == len(rows)
    for m in (1, 2, 3):
        want = pd.Series([r[2] for r in rows if r[0] == m], dtype="float64").ewm(span=3, adjust=False).mean()
        assert np.allclose(got[got.machine_id == m]["ema"], want, equal_nan=True)


def test_ema_drops_rows_later_than_the_delay(spark):
    first = [(1, i, float(i), 1_700_000_000 + 3600 * i) for i in range(10)]
    got = _ema_of_files(spark, [first, [(1, 99, 1e6, 1_700_000_000)], [(1, 10, 10.0, 1_700_036_000)]], delay="1 hour")
    assert got["event_id"].tolist() == list(range(11))
    assert np.allclose(got["ema"], pd.Series([*map(float, range(11))]).ewm(span=3, adjust=False).mean())


def test_ema_state_expires(spark):
    """A machine that is idle for longer than its limit starts anew; one that isn't goes on."""
    at = [1_700_000_000 + 86_400 * d for d in range(10)]
    files = [[(1, 0, 100.0, at[0]), (2, 0, 100.0, at[0])], [(2, 1, 0.0, at[3]), (3, 0, 1.0, at[3])], [(3, 1, 1.0, at[6])],
             [(1, 1, 0.0, at[9]), (2, 2, 0.0, at[9]), (3, 2, 1.0, at[9])]]
    kept, gone = _ema_of_files(spark, files), _ema_of_files(spark, files, idle_days=4)
    assert kept[kept.machine_id == 1]["ema"].tolist() == [100.0, 50.0] and gone[gone.machine_id == 1]["ema"].tolist() == [100.0, 0.0]
    assert kept[kept.machine_id == 2]["ema"].tolist() == [100.0, 50.0, 25.0] and gone[gone.machine_id == 2]["ema"].tolist() == [100.0, 50.0, 0.0]


def test_alarm_context_spreads_a_hot_machine(spark):
    """A machine with a third of the rows: its join state lies in several partitions, and no pair is lost or doubled."""
    rows = [(7 if i % 3 == 0 else 1000 + i, i, "error" if i % 10 == 0 else "view", 1_700_000_000 + 97 * i) for i in range(1500)]
    df = spark.createDataFrame(rows, "machine_id long, event_id long, event_type string, at long") \
        .withColumn("ts", F.timestamp_seconds("at")).drop("at")
    folder = scratch_path(spark, f"test-stream-{uuid.uuid4().hex}")
    df.coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(df.schema).parquet(folder)
    out = ST.alarm_context(stream.filter("event_type <> 'error'"), stream.filter("event_type = 'error'"))
    got = spark.read.parquet(ST.run_available_now(out.withColumn("part", F.spark_partition_id()), "t_hot")).toPandas()
    want = {(m, a, r) for m, a, k, t in rows if k == "error" for m2, r, k2, t2 in rows if m2 == m and k2 != "error" and t - 3600 <= t2 <= t}
    pairs = [*got[["machine_id", "alarm_id", "reading_id"]].itertuples(index=False, name=None)]
    assert len(pairs) == len(want) and set(pairs) == want and len(want) > 300
    assert got[got.machine_id == 7]["part"].nunique() >= 4


def test_rejected_readings_go_to_their_own_sink(spark):
    from motorsight.plans.streaming_plans import stream_scada_scoring_q

    out = stream_scada_scoring_q(spark, SF_SMALL)
    counts = {r.status: (r.n, r.least, r.scored) for r in out.groupBy("status").agg(
        F.count("*").alias("n"), F.min("n_warnings").alias("least"), F.count("p").alias("scored")).collect()}
    assert set(counts) == {"OK", "INPUT_VALIDATION_ERROR"}
    assert counts["OK"][1:] == (0, counts["OK"][0]) and counts["INPUT_VALIDATION_ERROR"][1:] == (1, 0)
    assert sum(c[0] for c in counts.values()) == spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").count()


def test_a_folder_of_part_files_streams_whole(spark):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    folder = scratch_path(spark, f"test-stream-{uuid.uuid4().hex}")
    ev.repartition(5).write.parquet(f"{folder}/events.parquet")
    for path in (folder, SF_SMALL):
        out = spark.read.parquet(ST.append_readings(ST.events_stream(spark, path, max_files=2)))
        assert out.count() == ev.count()


def test_flush_closes_every_window(spark):
    flush = ST.Flush(spark, SF_SMALL)
    scored = ST.telemetry_scores(ST.events_stream(spark, SF_SMALL).union(flush.stream()))
    out = spark.read.parquet(ST.run_available_now(ST.daily_risk(scored), "t_flush", flush=flush))
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    assert out.count() == ev.select("user_id", F.to_date("ts")).distinct().count()
    assert out.agg(F.sum("n")).first()[0] == ev.count()


def test_ema_passes_over_missing_readings(spark):
    xs = [None, 4.0, None, None, 1.0, 3.0, None]
    files = [[(1, i, x, 1_700_000_000 + i) for i, x in enumerate(xs) if (i >= 4) == bool(part)] for part in range(2)]  # the state goes on from file to file
    got = _ema_of_files(spark, files)["ema"].tolist()
    want = pd.Series(xs).ewm(span=3, adjust=False).mean()
    assert [None if y != y else round(y, 12) for y in got] == [None if w != w else round(w, 12) for w in want]


def test_stateful_ema_in_time_order_across_arrow_chunks(spark):
    """One machine's micro-batch of many Arrow chunks, in no order, gives the EMA of its rows by time."""
    n = 500
    readings = [(7, i, float(i * 31 % 17) if i % 5 else None, 1_700_000_000 + 60 * i) for i in ((i * 197) % n for i in range(n))]
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        got = _ema_of_files(spark, [readings])
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    x = pd.Series([r[2] for r in sorted(readings, key=lambda r: r[1])], dtype="float64")
    assert got["event_id"].tolist() == list(range(n)) and (got["machine_id"] == 7).all()
    assert got["ts"].is_monotonic_increasing
    assert np.allclose(got["ema"], x.ewm(span=3, adjust=False).mean(), equal_nan=True)
