"""File sources: JSON arrays, run-to-failure text with trailing blanks, alarm logs with either separator."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from motorsight.sources import readers as RD


def test_json_array_files(spark, tmp_path):
    rows = [{"machine_id": "M1", "reading_type": "temperature", "value": 71.5, "unit": "C", "notes": None,
             "entry_method": "voice", "confidence": 0.9, "language": "fr", "timestamp": "2024-01-01T08:00:00",
             "synced": False}] * 3
    (tmp_path / "readings_2024-01-01.json").write_text(json.dumps(rows))
    df = RD.read_json_readings(spark, str(tmp_path))
    assert df.count() == 3 and df.agg(F.sum("value")).first()[0] == 214.5


def test_run_to_failure_trailing_blanks(spark, tmp_path):
    line = " ".join(["1", "7", "0.1", "0.2", "100.0"] + [str(float(i)) for i in range(1, 22)]) + "  "
    (tmp_path / "train.txt").write_text(line + "\n" + line.replace("1 7", "1 8", 1) + "\n")
    df = RD.read_run_to_failure(spark, str(tmp_path))
    r = df.orderBy("time_cycles").first()
    assert len(df.columns) == 26 and r.unit_id == 1 and r.time_cycles == 7 and r.sensor_21 == 21.0


@pytest.mark.parametrize("sep", [";", ","])
def test_alarm_log_either_separator(spark, tmp_path, sep):
    lines = [sep.join(["DateTime", "Instance", "CLASS", "TxtCame"]),
             sep.join(["2024-01-01 10:00:00", "M1", "ALMTD", "overheat"]),
             sep.join(["not a date", "M2", "CRASD", "crash"]),
             sep.join(["2024-01-01 09:00:00", "M3", "INFO", "note"])]
    (tmp_path / "alarms.csv").write_text("\n".join(lines) + "\n")
    df = RD.read_alarm_log(spark, str(tmp_path / "alarms.csv"))
    labels = RD.fault_labels(df).collect()
    assert [r.Instance for r in labels] == ["M1", "M2"]          # NULL time sorted last
    assert labels[1].DateTime is None and all(r.Failure_Label == 1 for r in labels)


def test_report_files_without_a_process_a_file(spark, tmp_path):
    rows = [(m, day, f"début {m}\nfin {day}") for m in ("M 1/a", "é=2%", None) for day in ("2024-01-01", "2024-01-02")]
    RD.write_report_files(spark.createDataFrame(rows, "machine_id string, day string, report string"), str(tmp_path / "r"), ["machine_id", "day"])
    files = [p for p in (tmp_path / "r").rglob("*") if p.is_file()]
    assert len(files) == len(rows)  # no checksum files, each of which costs a process on a local disk
    assert {p.parent.parent.name for p in files} == {"machine_id=M 1%2Fa", "machine_id=é%3D2%25", "machine_id=__HIVE_DEFAULT_PARTITION__"}
    back = RD.read_report_files(spark, str(tmp_path / "r"), {"machine_id": "string", "day": "string"})
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)


def test_report_files_are_listed_by_the_tasks(spark, tmp_path):
    """The driver keeps no entry for a report file: they are listed and read in tasks, with typed keys."""
    rows = [(m, datetime.date(2024, 1, 1 + d), f"r {m} {d}\nfin") for m in (7, 123, None) for d in range(20)]
    RD.write_report_files(spark.createDataFrame(rows, "machine_id long, day date, report string"), str(tmp_path / "r"), ["machine_id", "day"])
    back = RD.read_report_files(spark, str(tmp_path / "r"), {"machine_id": "long", "day": "date"})
    assert back.inputFiles() == [] and sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    assert back.schema.simpleString() == "struct<machine_id:bigint,day:date,report:string>"


def test_alarm_log_missing_columns(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("DateTime;Instance\n2024-01-01 10:00:00;M1\n")
    with pytest.raises(RD.MissingColumns):
        RD.read_alarm_log(spark, str(tmp_path / "bad.csv"))
