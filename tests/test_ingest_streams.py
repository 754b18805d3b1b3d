"""Annotated manifests, file fingerprints, sketches, caches kept from streams, flow sessions with gap statistics."""

import datetime as dt
import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from tamis.functions import network
from tamis.operators import fingerprints, sketches
from tamis.sources import readers, sinks
from tamis.streaming import sessions, streams

HEAD = "asset_id,path,format,source_corpus,source_version,text_field,label_field,mapping,license_note,id_field,timestamp_field,group_field,label_from_path,encoding\n"


def corpus(folder):
    (folder / "raw" / "eml" / "spam").mkdir(parents=True)
    (folder / "raw" / "eml" / "easy_ham" / "deep").mkdir(parents=True)
    (folder / "raw" / "eml" / "spam" / "1").write_bytes(b"Subject: hi\nDate: Mon, 01 Jan 2024 10:00:00 +0100\nContent-Type: text/html\n\n<b>body</b> one\n")
    (folder / "raw" / "eml" / "easy_ham" / "deep" / "2").write_bytes(b"Subject: yo\nContent-Type: text/plain; charset=utf-8\n\n\xc3\xa9t\xc3\xa9\n")
    (folder / "raw" / "box").write_bytes(b"From a\nSubject: a\n\nfirst\n\nFrom b\n\n\nFrom c\xff\nSubject: c\n\nthird\n")
    (folder / "raw" / "t.csv").write_text('Email Text,Email Type,when,camp\n"x, ""y""\nz",Safe Email,2024-02-03 04:05:06,c1\n,Phishing  email,soon,\n')
    (folder / "raw" / "j.jsonl").write_text("".join(json.dumps({"text": f"t{k}", "label": k % 2, "source_id": f"own{k}"}) + "\n" for k in range(3)))
    rows = ["e,raw/eml/,eml_dir,sa,1,,label,spamassassin,n1,,,,,", "b,raw/box,mbox,naz,1,,phishing,nazario_phishing,n2,,,,,", "z,raw/t.csv,csv,zf,2,Email Text,Email Type,zefang_liu,n3,,when,camp,,", 'j,raw/j.jsonl,jsonl,gen,3,text,label,"{""1"": [""phishing"", ""proxy""], ""0"": [""ham"", ""unknown""]}",n4,,,,,']
    (folder / "m.csv").write_text(HEAD + "\n".join(rows) + "\n")
    return str(folder / "m.csv")


def test_annotated_manifest(spark, tmp_path):
    rows, report = readers.load_annotated(spark, corpus(tmp_path))
    got = {r.source_id: r for r in rows.collect()}
    assert set(got) == {"spam/1", "easy_ham/deep/2", "box:0", "box:2", "zf:0", "zf:1", "own0", "own1", "own2"}
    one = got["spam/1"]
    assert (one.text, one.subtype, one.mapping_confidence, one.source_label) == ("hi\n body  one\n", "bulk_spam", "proxy", "spam") and one.timestamp == dt.datetime(2024, 1, 1, 9)
    assert got["easy_ham/deep/2"].text == "yo\nété\n" and got["easy_ham/deep/2"].subtype == "ham"
    assert got["box:2"].text.strip() == "c\n\nthird".replace("\n\n", "\n") and got["box:0"].label_binary == 1 and got["box:0"].mapping_rule == "nazario_phishing"
    assert got["zf:0"].text == 'x, "y"\nz' and got["zf:0"].timestamp == dt.datetime(2024, 2, 3, 4, 5, 6) and (got["zf:0"].group_method, got["zf:0"].campaign_or_template_group) == ("provided", "c1")
    assert (got["zf:1"].text, got["zf:1"].subtype, got["zf:1"].timestamp, got["zf:1"].group_method) == ("", "phishing", None, "template-prefix-v1")
    assert got["own1"].subtype == "phishing" and got["own0"].mapping_rule.startswith("inline:")
    r = {x.asset_id: x for x in report.collect()}
    assert r["e"].rows == 2 and r["e"].subtype_counts == {"ham": 1, "bulk_spam": 1} and r["j"].confidence_counts == {"proxy": 1, "unknown": 2} and r["z"].license_note == "n3" and len(r["b"].manifest_fingerprint) == 16


def test_manifest_names_all_that_is_missing(spark, tmp_path):
    m = tmp_path / "m.csv"
    m.write_text(HEAD + "a,no/one,csv,c,1,t,l,enron_ham,n,,,,,\nb,no/two,mbox,c,1,,x,enron_ham,n,,,,,\n")
    with pytest.raises(FileNotFoundError) as e:
        readers.load_annotated(spark, str(m))
    assert "no/one" in str(e.value) and "no/two" in str(e.value)
    with pytest.raises(FileNotFoundError):
        readers.load_annotated(spark, str(tmp_path / "none.csv"))
    m.write_text("asset_id,path\na,b\n")
    with pytest.raises(ValueError, match="license_note"):
        readers.load_annotated(spark, str(m))
    (tmp_path / "x.csv").write_text("t,l\nhello,strange\n")
    m.write_text(HEAD + "a,x.csv,csv,c,1,t,l,spamassassin,n,,,,,\n")
    with pytest.raises(Exception, match="strange"):
        readers.load_annotated(spark, str(m))[0].collect()


def test_file_fingerprints_do_not_depend_on_splits(spark, tmp_path):
    data = b"\n".join(os.urandom(random.Random(k).randint(0, 200)).replace(b"\n", b"") for k in range(3000))
    for name, content in (("a", data), ("b", data), ("c", data[:1000] + bytes([data[1000] ^ 1]) + data[1001:]), ("d", data + b"\n"), ("e f", b"x")):
        (tmp_path / name).write_bytes(content)
    got = []
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for split in ("128m", "7000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        got.append({r.file.rsplit("/", 1)[1]: (r.bytes, r.blocks, r.fingerprint) for r in fingerprints.file_fingerprints(spark, str(tmp_path), block=20_000).collect()})
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    one = got[0]
    assert got[0] == got[1] and len(one) == 5 and one["a"] == one["b"] and one["a"][1] == -(-len(data) // 20_000)
    assert len({one[k][2] for k in ("a", "c", "d")}) == 3 and one["d"][0] == one["a"][0] + 1
    assert {r.fingerprint for r in fingerprints.file_fingerprints(spark, str(tmp_path / "a"), block=1000).collect()} != {one["a"][2]}


def test_sketches_merge_within_their_error(spark, tmp_path):
    rows = spark.range(60_000).select((F.col("id") % 7).alias("day"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("model"), (F.col("id") % 9_000).alias("flow"), F.when(F.col("id") % 11 != 0, F.sqrt("id")).alias("ms"))
    sketches.sketched(rows, ["day", "model"], "flow", "ms").write.parquet(str(tmp_path / "s"))
    for by in (["model"], []):
        for r in sketches.merged(spark.read.parquet(str(tmp_path / "s")), by, {"p50": 0.5, "p95": 0.95}).collect():
            mine = rows.where(F.col("model") == r.model) if by else rows
            n, valued, exact = mine.agg(F.count("*"), F.count("ms"), F.count_distinct("flow")).first()
            assert (r.n, r.valued) == (n, valued) and abs(r.distinct_keys - exact) <= sketches.DISTINCT_ERROR * exact
            for q, v in ((0.5, r.p50), (0.95, r.p95)):
                assert abs(mine.where(F.col("ms") <= v).count() / valued - q) <= sketches.RANK_ERROR
    assert sketches.merged(sketches.sketched(rows.where("ms IS NULL"), [], "flow", "ms"), [], {"p50": 0.5}).first().p50 is None


def test_cache_from_a_stream_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "cache")
    b = lambda *rows: spark.createDataFrame(rows, "key string, pred int, conf double, seen int")
    state = lambda: sorted(map(tuple, spark.read.parquet(path).select("key", "pred", "conf").collect()))
    assert sinks.upsert_batch(b(("k1", 0, 0.6, 1), ("k1", 1, 0.7, 2), ("k2", 0, 0.9, 1), (None, 1, 1.0, 1)), 0, path, order="seen")
    assert state() == [("k1", 1, 0.7), ("k2", 0, 0.9)]
    assert not sinks.upsert_batch(b(("k2", 1, 0.1, 9)), 0, path) and state() == [("k1", 1, 0.7), ("k2", 0, 0.9)]
    assert sinks.upsert_batch(b(("k3", 1, 0.2, 1)), 0, path, stream="other") and not sinks.upsert_batch(b(("k3", 0, 0.3, 1)), 0, path)
    assert sinks.upsert_batch(b(("k3", 1, 0.2, 1)), 1, path, stream="other") and sinks.applied_batches(spark, path) == {"main": 0, "other": 1}
    assert sinks.upsert_batch(b(("k2", 1, 0.8, 3)), 1, path) and state() == [("k1", 1, 0.7), ("k2", 1, 0.8), ("k3", 1, 0.2)] and sinks.applied_batches(spark, path) == {"main": 1, "other": 1}


def test_a_writer_that_dies_between_the_renames(spark, tmp_path):
    path = str(tmp_path / "cache")
    b = lambda *rows: spark.createDataFrame(rows, "key string, pred int, conf double")
    state = lambda: sorted(map(tuple, spark.read.parquet(path).collect()))
    sinks.upsert_batch(b(("k1", 0, 0.6)), 0, path)
    # died after the new table was written and the old one moved away
    b(("k1", 1, 0.9)).write.parquet(f"{path}.new-aa")
    open(f"{path}.new-aa/_batch-main-1", "w").close()
    os.rename(path, f"{path}.old-aa")
    assert sinks.readable(spark, path) .endswith(".old-aa")
    assert not sinks.upsert_batch(b(("k1", 0, 0.1)), 1, path)  # batch 1 is in already
    assert state() == [("k1", 1, 0.9)] and os.listdir(tmp_path) == ["cache"]
    # died while the new table was being written
    os.mkdir(f"{path}.new-bb")
    assert sinks.upsert_batch(b(("k2", 1, 0.5)), 2, path) and state() == [("k1", 1, 0.9), ("k2", 1, 0.5)] and os.listdir(tmp_path) == ["cache"]
    # the old table moved away, the new one is not whole
    os.mkdir(f"{path}.new-cc")
    os.rename(path, f"{path}.old-cc")
    sinks.recovered(spark, path)
    assert state() == [("k1", 1, 0.9), ("k2", 1, 0.5)] and sinks.applied_batches(spark, path) == {"main": 2}


def test_routing_sees_the_cache_as_it_stands(spark, tmp_path):
    path, ins = str(tmp_path / "cache"), str(tmp_path / "in")
    rows = lambda *r: spark.createDataFrame(r, "key string, score double")
    out = []
    stream = lambda: streams.routed_with_cache(spark.readStream.schema("key string, score double").parquet(ins), path, lambda df, n: out.append((n, sorted((r.key, r.final) for r in df.collect()))), str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(60)
    sinks.upsert_batch(spark.createDataFrame([("a", 1, 0.9)], "key string, pred int, conf double"), 0, path)
    rows(("a", 0.5), ("b", 0.9)).write.parquet(ins)
    stream()
    spark.createDataFrame([("b", 0, 0.8)], "key string, pred int, conf double").write.parquet(str(tmp_path / "preds"))
    made = streams.cached_predictions(spark.readStream.schema("key string, pred int, conf double").parquet(str(tmp_path / "preds")), path, str(tmp_path / "ck2"))
    made.trigger(availableNow=True).start().awaitTermination(60)
    rows(("a", 0.6), ("b", 0.6)).write.mode("append").parquet(ins)
    stream()
    assert out[0][1] == [("a", 0.9), ("b", 0.9)] and out[1][1] == [("a", 0.9), ("b", pytest.approx(0.2))]


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def test_stream_sessions_equal_the_flow_table(spark, tmp_path, rocks):
    rng, t0 = random.Random(8), dt.datetime(2024, 1, 1)
    packets = []
    for k in range(400):
        at = t0 + dt.timedelta(seconds=rng.uniform(0, 900) + (7200 if k % 3 == 0 else 0))
        packets.append((f"10.0.0.{k % 4}", k % 2, at.replace(microsecond=rng.randrange(1_000_000)), rng.randint(40, 1500), 64 + k % 3, int(k % 50 == 0), k % 2, 0, 1))
    packets.sort(key=lambda p: p[2])
    schema = "src_ip string, src_port int, ts timestamp, pkt_len bigint, ttl bigint, label int, tcp_flag_syn int, tcp_flag_ack int, tcp_flag_fin int"
    ins = str(tmp_path / "in")
    for k in range(0, 400, 50):  # within a file in any order; files overlap by a little
        part = packets[k : k + 50]
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(ins)
    spark.createDataFrame([("10.0.0.0", 0, t0, 1, 1, 1, 1, 1, 1)], schema).coalesce(1).write.mode("append").parquet(ins)  # late: dropped
    spark.createDataFrame([("end", 0, t0 + dt.timedelta(days=2), 1, 1, 0, 0, 0, 0)], schema).coalesce(1).write.mode("append").parquet(ins)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(ins)
    out = sessions.flow_sessions(stream, ["src_ip", "src_port"], gap_seconds=3000, late="30 minutes")
    q = out.writeStream.outputMode("append").format("memory").queryName("flow_sessions_test").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    columns = ["src_ip", "src_port", "start_us", "pkt_count", "total_bytes", "max_pkt_len", "duration_us", "mean_pkt_len", "mean_iat_ms", "std_iat_ms", "mean_ttl", "label", "syn_count", "ack_count", "fin_count"]
    got = sorted(map(tuple, spark.table("flow_sessions_test").select(columns).collect()))
    rows = spark.createDataFrame(packets, schema).withColumn("time_us", F.unix_micros("ts")).withColumn("session", (F.col("ts") >= F.lit(t0 + dt.timedelta(hours=2))).cast("int")).withColumns({f"tcp_flag_{f}": F.lit(0) for f in ("rst", "psh")})
    want = sorted(map(tuple, network.flows(rows, ["src_ip", "src_port", "session"]).select(columns).collect()))
    close = lambda a, b: all(x == y or (isinstance(x, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)) for x, y in zip(a, b))
    assert len(want) == 8 and len(got) == 8 and all(close(a, b) for a, b in zip(got, want))


def test_stream_static_routing_and_plain_sessions(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    ins = str(tmp_path / "in")
    spark.createDataFrame([("a", t, 10, 0), ("a", t + dt.timedelta(minutes=5), 20, 1), ("a", t + dt.timedelta(hours=3), 5, 0)], "key string, ts timestamp, pkt_len bigint, label int").write.parquet(ins)
    stream = spark.readStream.schema("key string, ts timestamp, pkt_len bigint, label int").parquet(ins)
    q = streams.flow_sessions(stream, ["key"]).writeStream.outputMode("complete").format("memory").queryName("plain_sessions").option("checkpointLocation", str(tmp_path / "a")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.pkt_count, r.total_bytes, r.label) for r in spark.table("plain_sessions").collect()) == [(1, 5, 0), (2, 30, 1)]
    scores = spark.createDataFrame([("a", 0.1)], "key string, p1 double")
    q = streams.routed(stream.withColumn("score", F.when(F.col("label") == 1, 0.95).otherwise(0.5)), scores).writeStream.format("memory").queryName("plain_routed").option("checkpointLocation", str(tmp_path / "b")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.final for r in spark.table("plain_routed").collect()) == [0.1, 0.1, 0.95]
