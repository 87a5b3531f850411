"""File sources and sinks (S1-S13) with explicit schemas.

Readers never infer schemas on the query path; malformed lines are dropped by
the CSV reader itself (``DROPMALFORMED``); bad numbers become NULL through
``try_cast``.  Sinks partition by the columns later queries filter on, so
partition pruning applies on read.
"""

from __future__ import annotations

import itertools
import os
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import fixed_values as fv
from .. import schemas

#: Tasks for each core that write or read report files, and files that are handed on at once.
FILE_TASKS, READ_FILES = 4, 256


def read_table(spark: SparkSession, path: str, schema: StructType, fmt: str = "csv",
               header: bool = True, sep: str = ",") -> DataFrame:
    """CSV (header) or Parquet scan with an explicit schema."""
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(path)
    return (spark.read.schema(schema).option("header", header).option("sep", sep)
            .option("mode", "DROPMALFORMED").csv(path))


def read_run_to_failure(spark: SparkSession, path: str) -> DataFrame:
    """Headerless, space-separated run-to-failure text, 26 named columns.

    Lines are trimmed and split on runs of blanks (trailing blanks would
    otherwise add empty fields and shift every name, D1)."""
    names = [f.name for f in schemas.RUN_TO_FAILURE.fields]
    parts = F.split(F.trim(F.col("value")), r"\s+")
    cols = [F.element_at(parts, i + 1).try_cast(f.dataType).alias(f.name)
            for i, f in enumerate(schemas.RUN_TO_FAILURE.fields)]
    raw = spark.read.text(path).filter(F.trim(F.col("value")) != "")
    return raw.select(*cols).select(*names)


def read_tables(spark: SparkSession, paths: dict[str, str], schema_of: dict[str, StructType],
                fmt: str = "csv") -> dict[str, DataFrame]:
    """S3: directory of tables -> named lazy readers."""
    return {name: read_table(spark, p, schema_of[name], fmt) for name, p in paths.items()}


def cached_source(spark: SparkSession, raw_path: str, bronze_path: str, schema: StructType,
                  fmt: str = "csv") -> DataFrame:
    """Read the bronze Parquet copy if present, else read raw and write it once.

    The bronze folder lives in shared storage (checkpoint dir on a cluster)."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(bronze_path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(bronze_path + "/_SUCCESS")):
        return spark.read.schema(schema).parquet(bronze_path)
    raw = read_table(spark, raw_path, schema, fmt)
    raw.write.mode("overwrite").parquet(bronze_path)
    return spark.read.schema(schema).parquet(bronze_path)


def header_line(spark: SparkSession, path: str) -> str:
    """The first line of a file that has one (all files of an export share their header).

    Only the start of a file counts, and the scan ends at the first line found."""
    first = spark.read.text(path).filter(F.input_file_block_start() == 0).limit(1).collect()
    return first[0]["value"] if first else ""


def detect_separator(line: str, candidates=(";", ",")) -> str:
    """Separator of a header line: the candidate that it holds most often."""
    counts = {c: line.count(c) for c in candidates}
    return max(counts, key=counts.get) if any(counts.values()) else candidates[0]


class MissingColumns(ValueError):
    pass


def require_columns(df: DataFrame, required) -> DataFrame:
    """P10: refuse a table without the required columns before any job runs."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise MissingColumns(f"missing required columns: {missing}")
    return df


def read_alarm_log(spark: SparkSession, path: str) -> DataFrame:
    """Alarm export; ';' or ',' detected from the header (D18), bad lines dropped,
    required columns checked."""
    line = header_line(spark, path)
    sep = detect_separator(line)
    names = [n.strip() for n in line.split(sep)]
    missing = [c for c in fv.ALARM_REQUIRED_COLUMNS if c not in names]
    if missing:
        raise MissingColumns(f"missing required columns: {missing}")
    return read_table(spark, path, schemas.ALARM, "csv", True, sep)


def fault_labels(alarms: DataFrame) -> DataFrame:
    """P8 + L2: fault classes only, label 1, time parsed (bad -> NULL), sorted by
    time with unparsed rows last."""
    require_columns(alarms, fv.ALARM_REQUIRED_COLUMNS)
    f = alarms.filter(F.col("CLASS").isin(fv.ALARM_FAULT_CLASSES))
    parsed = F.try_to_timestamp(F.col("DateTime"), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    return f.withColumn("DateTime", parsed).withColumn("Failure_Label", F.lit(1)) \
        .orderBy(F.col("DateTime").asc_nulls_last())


def read_json_readings(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Reading files with an explicit schema: JSON arrays (one file per day, as
    the entry app writes them; each file is one task) or JSON lines (splittable)."""
    return spark.read.schema(schemas.READINGS_LONG).option("multiLine", multi_line).json(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] = (),
                mode: str = "overwrite") -> None:
    """Table sink; CSV with header, JSON or Parquet, optionally partitioned."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)


def write_text_reports(lines: DataFrame, path: str, key: str = "machine_id") -> None:
    """Report lines (key, line_no, line) as text, one folder per key.

    Lines are ordered inside each file by sorting within partitions."""
    (lines.repartition(key).sortWithinPartitions(key, "line_no").select(key, "line")
     .write.mode("overwrite").partitionBy(key).text(path))


def write_report_files(reports: DataFrame, path: str, keys: list[str], text: str = "report") -> None:
    """One text file for each combination of ``keys``, which is a row of ``reports``, under a folder for each key.

    On a mounted folder the tasks create the files: Hadoop's local file system starts a ``chmod`` process for every
    file and every checksum, which takes far longer than the file itself.  A retried task
    writes the same files again, each put in place whole.  Other stores take Spark's own writer; the folders are
    the same."""
    spark = reports.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    dealt = reports.select(*keys, text).repartition(FILE_TASKS * spark.sparkContext.defaultParallelism, *keys)
    if fs.getUri().getScheme() != "file":
        dealt.write.mode("overwrite").partitionBy(*keys).text(path)
        return
    fs.delete(folder, True)
    root = folder.toUri().getPath()

    def folder_name(key: str, value: str | None) -> str:
        """As Spark names the folder of a partition."""
        escaped = re.sub(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""", lambda m: f"%{ord(m[0]):02X}", value or "")
        return f"{key}={escaped or '__HIVE_DEFAULT_PARTITION__'}"

    def put(batches):
        for batch in batches:
            for *values, report in zip(*(c.to_pylist() for c in batch.columns)):
                here = os.path.join(root, *map(folder_name, keys, values))
                os.makedirs(here, exist_ok=True)
                part = os.path.join(here, f"_{uuid.uuid4().hex}")
                with open(part, "w", encoding="utf-8", newline="") as f:
                    f.write((report or "") + "\n")
                os.replace(part, os.path.join(here, "report.txt"))
            yield pa.RecordBatch.from_pydict({"files": pa.array([batch.num_rows], pa.int64())})

    os.makedirs(root, exist_ok=True)
    dealt.select(*[F.col(k).cast("string") for k in keys], text).mapInArrow(put, "files long").agg(F.sum("files")).collect()  # one row


def read_report_files(spark: SparkSession, path: str, keys: dict[str, str]) -> DataFrame:
    """Rows (keys..., report) of :func:`write_report_files`, each file whole; ``keys`` names the types.

    On a mounted folder the tasks list the files, each those under its share of the first key's folders: Spark's reader
    keeps an entry for every file and folder on the driver, and a report is a file.  Other stores take Spark's reader."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() != "file":
        schema = ", ".join(["value string", *(f"{k} {kind}" for k, kind in keys.items())])
        back = spark.read.schema(schema).text(path, wholetext=True)
        return back.select(*keys, F.rtrim("value", F.lit("\n")).alias("report"))
    root, tasks = folder.toUri().getPath(), FILE_TASKS * spark.sparkContext.defaultParallelism

    def value(name: str) -> str | None:
        text = name.partition("=")[2]
        return None if text == "__HIVE_DEFAULT_PARTITION__" else re.sub("%([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), text)

    def files(here: str, depth: int, values: tuple):
        for e in os.scandir(here):
            if depth and e.is_dir():
                yield from files(e.path, depth - 1, (*values, value(e.name)))
            elif not depth and not e.name.startswith(("_", ".")):
                with open(e.path, encoding="utf-8", newline="") as f:
                    yield *values, f.read()

    def read(batches):
        mine = {i for b in batches for i in b.column(0).to_pylist()}
        own = [e for e in os.scandir(root) if e.is_dir() and zlib.crc32(os.fsencode(e.name)) % tasks in mine]
        rows = (row for e in own for row in files(e.path, len(keys) - 1, (value(e.name),)))
        while some := list(itertools.islice(rows, READ_FILES)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*some)], names=[*keys, "value"])

    back = spark.range(0, tasks, 1, tasks).mapInArrow(read, ", ".join(f"{k} string" for k in [*keys, "value"]))
    return back.select(*[F.col(k).cast(kind).alias(k) for k, kind in keys.items()], F.rtrim("value", F.lit("\n")).alias("report"))


def profile(tables: dict[str, DataFrame], targets=("failure", "target", "label"),
            case_fold: bool = True) -> DataFrame:
    """Rows, columns and has-target per table, as one union (one count job per table
    runs inside the union plan)."""
    parts = []
    for name, df in tables.items():
        cols = df.columns
        has = any((c.lower() if case_fold else c) in targets for c in cols)
        parts.append(df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"),
                            F.lit(len(cols)).alias("columns"), F.lit(has).alias("has_target")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

