"""Structured Streaming operators (T1-T8), each the batch operator on ``readStream``.

* Sources are file streams with explicit schemas; Parquet NTZ timestamps are cast
  to ``timestamp`` (session time zone UTC) because watermarks need it.
* Windowed aggregates run in append mode with a watermark: late rows are
  dropped, and a window is emitted once the watermark passes its end.
* Checkpoints and sinks live under the shared checkpoint folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import schemas
from ..functions import physics as ph
from ..functions import rules as R
from ..operators.scoring import validation_status
from ..session import scratch_path


def table_stream(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """File stream over the table at ``path``: one Parquet file, or a folder of part files.

    The path goes in as a pattern that only it matches, since a file stream takes a plain
    path for a folder."""
    folder, name = path.rstrip("/").rsplit("/", 1)
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(f"{folder}/{{{name}}}")


def events_stream(spark: SparkSession, sf_dir: str, max_files: int | None = None) -> DataFrame:
    """File stream of event rows, ts as TIMESTAMP (watermarks refuse TIMESTAMP_NTZ)."""
    return table_stream(spark, f"{sf_dir.rstrip('/')}/events.parquet", schemas.INPUT["events"], max_files) \
        .withColumn("ts", F.col("ts").cast("timestamp"))


def lineitem_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_stream(spark, f"{sf_dir.rstrip('/')}/lineitem.parquet", schemas.INPUT["lineitem"])


class Flush:
    """A row far after the last event, streamed once the source is drained, so that the watermark
    passes the last windows and they are emitted.  Its own window never closes."""

    def __init__(self, spark: SparkSession, sf_dir: str, after_days: int = 30):
        self.spark, self.path = spark, f"{sf_dir.rstrip('/')}/events.parquet"
        self.after, self.folder = after_days, scratch_path(spark, f"streams/flush-{uuid.uuid4().hex}")
        spark.createDataFrame([], schemas.INPUT["events"]).write.parquet(self.folder)

    def stream(self) -> DataFrame:
        return table_stream(self.spark, self.folder, schemas.INPUT["events"]).withColumn("ts", F.col("ts").cast("timestamp"))

    def send(self) -> None:
        last = self.spark.read.schema(schemas.INPUT["events"]).parquet(self.path).agg(F.max("ts").alias("ts"))
        values = {"ts": (F.col("ts").cast("timestamp") + F.expr(f"INTERVAL {self.after} DAYS")), "event_type": F.lit("error")}
        last.filter("ts is not null").select(*[
            values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.INPUT["events"].fields]) \
            .write.mode("append").parquet(self.folder)


def telemetry_scores(ev: DataFrame) -> DataFrame:
    """Reading -> probability (x / 100 capped at 1) and French risk rank; batch or stream."""
    p = F.least(F.col("value") / 100.0, F.lit(1.0))
    return ev.select(F.col("user_id").alias("machine_id"), "ts", "event_id", "event_type",
                     F.col("value").alias("x"), p.alias("p"), R.risk_rank_fr(R.risk_level_fr(p)).alias("rank"))


# --- T1: scoring against the fitted parameters ----------------------------------------
def fitted_parameters(train: DataFrame, columns: list[str], model: str) -> DataFrame:
    """A9 as a table for stream-static joins: one row (model, rpm_mean, scale: feature -> {mu, sd}).

    ``train`` holds canonical sensors; ``columns`` are names of the physics features.  A zero deviation is 1."""
    rpm_mean = train.agg(F.avg("rpm")).first()[0]
    f = ph.physics_features(train, rpm_mean, keep=[])
    sd = {c: F.stddev_pop(c) for c in columns}
    entries = [F.struct(F.lit(c), F.struct(F.avg(c).alias("mu"), F.when(sd[c] == 0, 1.0).otherwise(sd[c]).alias("sd"))) for c in columns]
    return f.agg(F.map_from_entries(F.array(*entries)).alias("scale")).select(
        F.lit(model).alias("model"), F.lit(float(rpm_mean)).alias("rpm_mean"), "scale")


def score_readings(tagged: DataFrame, parameters: DataFrame, coefficients: dict[str, float], intercept: float,
                   keep: list[str]) -> DataFrame:
    """Tag conversion (P3), validation (P6), physics features (F1-F9), standard scaling with the fitted
    parameters (F11), linear score and band (F14), for batch or stream.  ``tagged`` has a column ``model`` that
    names its row of ``parameters``; invalid readings keep their warnings and get no score."""
    canonical = ph.convert_tags(tagged)
    warnings, status = validation_status()
    checked = canonical.select(*keep, "model", *ph.SENSORS, warnings.alias("warnings"), status.alias("status"))
    joined = checked.join(parameters, "model")
    e = ph.physics_exprs(joined, 0.0)
    e["Speed_Deviation"] = F.abs(F.col("rpm").cast("double") - F.col("rpm_mean"))
    scale = {c: F.col("scale")[c] for c in coefficients}
    scaled = {c: (ph.finite_or_zero(e[c]) - scale[c]["mu"]) / scale[c]["sd"] for c in coefficients}
    ok = F.col("status") == "OK"
    out = joined.select(*keep, "status", "warnings", *[F.when(ok, v).alias(f"{c}_std") for c, v in scaled.items()])
    p = R.sigmoid(R.linear_logit({f"{c}_std": w for c, w in coefficients.items()}, intercept))
    return out.withColumn("p", F.when(ok, p)).withColumn("risk_level", F.when(ok, R.risk_level_fr("p")))


def run_two_sinks(scored: DataFrame, name: str) -> tuple[str, str]:
    """Drain a stream of ``score_readings`` rows into two Parquet tables, scored and rejected; return their paths.
    A micro-batch overwrites its own folder, so one that is repeated after a failure counts once."""
    base = scratch_path(scored.sparkSession, f"streams/{name}-{uuid.uuid4().hex}")

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.filter("status = 'OK'").drop("warnings").write.mode("overwrite").parquet(f"{base}/scored/batch={number}")
        batch.filter("status <> 'OK'").write.mode("overwrite").parquet(f"{base}/rejected/batch={number}")
        batch.unpersist()

    scored.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/_checkpoint") \
        .trigger(availableNow=True).start().awaitTermination()
    return f"{base}/scored", f"{base}/rejected"


# --- T2 / T3 / T4: windows with a watermark ------------------------------------------
def daily_risk(scored: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Per machine and day, max risk rank and mean probability."""
    return (scored.withWatermark("ts", delay)
            .groupBy("machine_id", F.window("ts", "1 day"))
            .agg(F.max("rank").alias("max_rank"), F.avg("p").alias("mean_p"), F.count(F.lit(1)).alias("n"))
            .select("machine_id", F.col("window.start").alias("window_start"),
                    F.col("window.end").alias("window_end"), "max_rank", "mean_p", "n"))


def sliding_stats(scored: DataFrame, delay: str = "1 hour") -> DataFrame:
    """7-day windows sliding by 1 day: mean / min / max of the reading."""
    return (scored.withWatermark("ts", delay)
            .groupBy("machine_id", F.window("ts", "7 days", "1 day"))
            .agg(F.avg("x").alias("mean_x"), F.min("x").alias("min_x"), F.max("x").alias("max_x"))
            .select("machine_id", F.col("window.start").alias("window_start"),
                    F.col("window.end").alias("window_end"), "mean_x", "min_x", "max_x"))


def fault_sessions(scored: DataFrame, gap: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """T4: sessions of consecutive fault events per machine (gap-based)."""
    faults = scored.filter(F.col("event_type") == "error")
    return (faults.withWatermark("ts", delay)
            .groupBy("machine_id", F.session_window("ts", gap))
            .agg(F.count(F.lit(1)).alias("faults"))
            .select("machine_id", F.col("session_window.start").alias("session_start"),
                    F.col("session_window.end").alias("session_end"), "faults"))


# --- T5: stateful EMA ---------------------------------------------------------------------
class EventTimeEma(StatefulProcessor):
    """EMA of one machine's readings in (ts, event_id) order, whichever micro-batches they come in.

    Readings wait in list state, one entry for the rows of a call, until the watermark has passed them; then no
    earlier one can come, and they are taken in order.  Value state holds the last value, its weight and its time.  A missing reading
    repeats the last value and lets its weight decay, as pandas ``ewm(adjust=False)`` does.  After a gap of more
    than ``idle_ms`` between readings a machine starts anew, so its state can go when the watermark has passed that."""

    def __init__(self, span: int, idle_ms: int):
        self.alpha, self.idle_ms = 2.0 / (span + 1), idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.last = handle.getValueState("last", "y double, weight double, at long")

    @staticmethod
    def _rows(pdf: pd.DataFrame) -> np.ndarray:
        """The readings as an array of records; a missing reading is NaN, a missing id is marked."""
        ids, out = pdf["event_id"], np.empty(len(pdf), "i8,i8,f8,?")
        missing = ids.isna().to_numpy()
        out["f0"] = pdf["ts"].to_numpy().astype("datetime64[us]").astype("i8")
        out["f1"] = (ids.astype("Int64").fillna(0) if missing.any() else ids).to_numpy("i8")
        out["f2"], out["f3"] = pdf["x"].to_numpy("f8"), missing
        return out

    def _ready(self, key, waiting: np.ndarray, watermark: int, last: tuple | None) -> tuple[pd.DataFrame, tuple | None]:
        """Take the rows that the watermark has passed, and put the others back.  Returns the former and the new value state."""
        passed = waiting["f0"] // 1000 < watermark
        done, rest = waiting[passed], waiting[~passed]
        done = done[np.lexsort((done["f1"], done["f3"], done["f0"]))]
        if len(done):
            if len(rest):
                self.waiting.put([(rest.tobytes(),)])
            else:
                self.waiting.clear()
        y, weight, at = last or (None, None, None)
        out, keep, alpha = [], 1.0 - self.alpha, self.alpha
        for x, now in zip(done["f2"].tolist(), (done["f0"] // 1000).tolist(), strict=True):
            if y is not None and now - at > self.idle_ms:
                y = None
            elif y is not None:
                weight *= keep
            at = now
            if x == x:
                y = x if y is None else (weight * y + alpha * x) / (weight + alpha)
                weight = 1.0
            out.append(y)
        if len(done) and y is not None:
            last = (float(y), float(weight), at)
            self.last.update(last)
            self.handle.registerTimer(at + self.idle_ms)
        ids = pd.arrays.IntegerArray(done["f1"].copy(), done["f3"].copy())
        machine = pd.array([key[0]], dtype="Int64").repeat(len(done))
        return pd.DataFrame({"machine_id": machine, "event_id": ids, "ts": done["f0"].astype("datetime64[us]"),
                             "ema": np.array(out, "f8")}), last

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        for pdf in rows:
            new = self._rows(pdf)
            new = new[new["f0"] // 1000 >= watermark]  # later rows than the watermark allows are dropped
            if len(new):
                self.waiting.appendValue((new.tobytes(),))
                self.handle.registerTimer(int(new["f0"].max()) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        held = [np.frombuffer(r[0], "i8,i8,f8,?") for r in self.waiting.get()]
        last = self.last.get()
        if held:
            out, last = self._ready(key, np.concatenate(held), watermark, last)
            if len(out):
                yield out
        if last is not None and last[2] + self.idle_ms < watermark:
            self.last.clear()  # whatever comes now comes after the gap

    def close(self) -> None:
        pass


def stateful_ema(scored: DataFrame, span: int = 3, delay: str = "1 hour", idle_days: float = 3650) -> DataFrame:
    """T5: EMA per machine by event time, across micro-batches and out-of-order rows (up to ``delay`` late)."""
    rows = scored.select("machine_id", "event_id", "ts", "x").withWatermark("ts", delay)
    return rows.groupBy("machine_id").transformWithStateInPandas(
        EventTimeEma(span, int(idle_days * 86_400_000)), "machine_id long, event_id long, ts timestamp, ema double", "Append", "EventTime")


# --- T6 / T7 ------------------------------------------------------------------------------------
def dedup_alerts(scored: DataFrame, delay: str = "2 days") -> DataFrame:
    """One alert per machine, risk level and day; state expires with the watermark
    (delay >= 1 day so the state outlives its day)."""
    alerts = scored.filter(F.col("p") >= 0.8).withColumn("day", F.to_date("ts"))
    return alerts.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["machine_id", "rank", "day"]) \
        .select("machine_id", "rank", "day")


def alarm_context(readings: DataFrame, alarms: DataFrame, before: str = "1 hour",
                  delay: str = "2 hours") -> DataFrame:
    """Each alarm with the readings of its machine in the hour before (inclusive),
    as a watermarked stream-stream interval join.

    Rows meet by machine and time bucket of the length of ``before``; an alarm looks into its own bucket and the
    one before, a reading lies in one.  So the state and the work of a hot machine spread over partitions."""
    length = F.unix_micros(F.expr(f"timestamp_seconds(0) + INTERVAL {before}"))
    r_bucket, a_bucket = (F.floor(F.unix_micros(c) / length) for c in ("r_ts", "a_ts"))
    r = readings.select(F.col("machine_id").alias("r_machine"), F.col("ts").alias("r_ts"),
                        F.col("event_id").alias("reading_id")).withWatermark("r_ts", delay).withColumn("r_bucket", r_bucket)
    a = alarms.select(F.col("machine_id").alias("a_machine"), F.col("ts").alias("a_ts"),
                      F.col("event_id").alias("alarm_id")).withWatermark("a_ts", delay)
    a = a.withColumn("a_bucket", F.explode(F.array(a_bucket, a_bucket - 1)))
    cond = (F.col("r_machine") == F.col("a_machine")) & (F.col("r_bucket") == F.col("a_bucket")) & \
        (F.col("r_ts") >= F.col("a_ts") - F.expr(f"INTERVAL {before}")) & (F.col("r_ts") <= F.col("a_ts"))
    return a.join(r, cond, "inner").select(F.col("a_machine").alias("machine_id"), "alarm_id", "reading_id")


# --- running ------------------------------------------------------------------------------------------
def run_available_now(df: DataFrame, name: str, mode: str = "append", partition_by: list[str] = (),
                      flush: Flush | None = None) -> str:
    """Run a streaming plan until its source is drained into a Parquet sink; return the sink path.

    With ``flush`` (whose stream is part of ``df``) the same query then runs once more
    over the flush row."""
    base = scratch_path(df.sparkSession, f"streams/{name}-{uuid.uuid4().hex}")
    w = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/_checkpoint") \
        .option("path", f"{base}/out").trigger(availableNow=True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.start().awaitTermination()
    if flush is not None:
        flush.send()
        w.start().awaitTermination()
    return f"{base}/out"


def append_readings(ev: DataFrame, name: str = "readings") -> str:
    """Append sink of readings partitioned by day, with a checkpoint."""
    return run_available_now(ev.withColumn("reading_date", F.to_date("ts")), name, "append", ["reading_date"])
