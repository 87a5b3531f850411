"""Alert and summary message texts; text report sink (one folder per machine, lines in order)."""

import os

from pyspark.sql import functions as F

from motorsight.functions import text as TX
from motorsight.sources import readers as RD


def test_alert_message_fr_and_ar(spark):
    df = spark.createDataFrame([("MEE1-M01", "TWF", 0.85, 30, "2026-05-04 01:49:58")],
                               "m string, f string, p double, h int, ts string").withColumn("ts", F.to_timestamp("ts"))
    fr, ar = df.select(TX.alert_message("m", "f", "p", "h", "ts", "fr"),
                       TX.alert_message("m", "f", "p", "h", "ts", "ar")).first()
    assert fr == ("\n🔴 *Alerte Maintenance Urgente*\n\n🔧 Machine: MEE1-M01\n⚠️ Type de panne prévue: TWF\n"
                  "📊 Probabilité: 85%\n⏰ Temps restant: ~1 jours\n\n📅 2026-05-04 01:49\n\n✅ Action immédiate requise")
    assert ar.startswith("\n🔴 *تحذير صيانة عاجلة*\n\n🔧 الآلة: MEE1-M01\n")
    assert "⏰ الوقت المتبقي: ~1 يوم\n" in ar
    short = df.withColumn("h", F.lit(5)).withColumn("p", F.lit(0.6))
    msg = short.select(TX.alert_message("m", "f", "p", "h", "ts", "fr")).first()[0]
    assert msg.startswith("\n🟡 ") and "⏰ Temps restant: ~5h\n" in msg
    none = short.withColumn("h", F.lit(None).cast("int")).select(TX.alert_message("m", "f", "p", "h", "ts", "fr"))
    assert "Temps restant" not in none.first()[0]


def test_daily_summary(spark):
    df = spark.createDataFrame([("2026-05-04", 3, 1)], "d string, r int, c int").withColumn("d", F.to_date("d"))
    msg = df.select(TX.daily_summary_message("d", "r", "c", "fr")).first()[0]
    assert msg == ("\n📊 *Résumé Quotidien - Maintenance Prédictive*\n\n📅 2026-05-04\n\n🔴 Alertes critiques: 1\n"
                   "⚠️ Machines à risque: 3\n\n✅ Consultez le système pour plus de détails\n")


def test_text_report_sink(spark, tmp_path):
    lines = spark.createDataFrame([("A", 2, "second"), ("A", 1, "first"), ("B", 1, "only")],
                                  "machine_id string, line_no int, line string")
    RD.write_text_reports(lines, str(tmp_path / "reports"))
    a_dir = tmp_path / "reports" / "machine_id=A"
    text = "".join(open(a_dir / f).read() for f in sorted(os.listdir(a_dir)) if f.startswith("part"))
    assert text.split("\n")[:2] == ["first", "second"]
