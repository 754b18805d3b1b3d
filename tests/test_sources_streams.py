"""Ingestion and streams on small fixtures."""

import datetime as dt

from tamis.sources import readers
from tamis.streaming import streams


def test_manifest(spark, tmp_path):
    (tmp_path / "eml" / "spam").mkdir(parents=True)
    (tmp_path / "eml" / "spam" / "1").write_bytes(b"Subject: hi\nContent-Type: text/plain\n\nbody one\n")
    (tmp_path / "box").write_bytes(b"From a\nSubject: a\n\nfirst\n\nFrom b\nSubject: b\n\nsecond\n")
    (tmp_path / "c.csv").write_text('text,label\n"x, y",1\n,0\n')
    cols = readers.REQUIRED
    rows = [("e", str(tmp_path / "eml"), "eml_dir", "c", "1", "", "", "m", ""), ("b", str(tmp_path / "box"), "mbox", "c", "1", "", "ham", "m", ""), ("c", str(tmp_path / "c.csv"), "csv", "c", "1", "text", "label", "m", "")]
    out, report = readers.load_manifest(spark, spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols)))
    got = sorted((r.asset_id, r.text, r.label) for r in out.collect())
    assert got == [("b", "a\nfirst", "ham"), ("b", "b\nsecond", "ham"), ("c", "x, y", "1"), ("e", "hi\nbody one", "spam")]
    assert sum(r.n for r in report.collect()) == 4


def test_streams(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(t, "A  b", 0.9), (t, "a b", 0.2), (t + dt.timedelta(hours=2), "c", 0.8)], "ts timestamp, text string, score double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, text string, score double").parquet(str(tmp_path / "in"))
    for k, (df, n) in enumerate(((streams.without_copies(stream), 2), (streams.alerts_per_hour(stream), 2))):
        q = df.writeStream.outputMode("append" if k == 0 else "complete").format("memory").queryName(f"s{k}").option("checkpointLocation", str(tmp_path / f"ck{k}")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        assert spark.table(f"s{k}").count() == n
