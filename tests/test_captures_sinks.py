"""Capture readers, sinks, splits and run plans on small fixtures."""

import pytest
from pyspark.sql import functions as F

from tamis.functions import replies
from tamis.operators import splits
from tamis.sources import captures, readers, sinks


def test_cic_flows(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" Flow ID, Flow Duration, Label\nx,5,BENIGN\ny,5, BENIGN \nz,Infinity,DDoS\n")
    (tmp_path / "b.csv").write_text("Flow Duration , Rate,Label\noops,2.5,PortScan\n")
    got = sorted(((r["Flow Duration"], r["Rate"], r["label"]) for r in captures.cic_flows(spark, f"{tmp_path}/*.csv").collect()), key=repr)
    assert got == sorted([(5.0, None, 0), (None, None, 1), (None, 2.5, 1)], key=repr)
    with pytest.raises(FileNotFoundError):
        captures.cic_flows(spark, f"{tmp_path}/*.none")


@pytest.mark.parametrize("form", ["header", "bare", "index", "label"])
def test_statistics_table(spark, tmp_path, form):
    rows = [(0.5, 1e-7), (0.5, 1e-7), (2.0, 3.0)]
    lines = {"header": ["kitsune_f0,kitsune_f1"] + [f"{a},{b}" for a, b in rows], "bare": [f"{a},{b}" for a, b in rows],
             "index": [f"{i},{a},{b}" for i, (a, b) in enumerate(rows)], "label": [f"{a},{b},{y}" for (a, b), y in zip(rows, (0, 1, 1))]}[form]
    (tmp_path / "f.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "l.csv").write_text("0\n1\n1\n0\n")
    t = captures.statistics_table(spark, f"{tmp_path}/f.csv", None if form == "label" else f"{tmp_path}/l.csv", width=2)
    assert sorted(tuple(r) for r in t.select("kitsune_f0", "kitsune_f1", "label").collect()) == [(0.5, 1e-7, 0), (0.5, 1e-7, 1), (2.0, 3.0, 1)]
    if form == "bare":
        with pytest.raises(FileNotFoundError):
            captures.statistics_table(spark, f"{tmp_path}/f.csv", None, width=2)


def test_rows_are_numbered_by_file_and_place(spark, tmp_path):
    spark.range(0, 5000).coalesce(1).write.csv(f"{tmp_path}/t")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        scan = spark.read.schema("v bigint").csv(f"{tmp_path}/t")
        assert scan.rdd.getNumPartitions() > 3
        n = captures.numbered(scan)
        assert n.count() == 5000 and n.where("v <> row_no").count() == 0
        odd = captures.numbered(scan, where=F.col("v") % 2 == 1)
        assert odd.count() == 2500 and odd.where("v <> 2 * row_no + 1").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_packet_tables(spark, tmp_path):
    rows = [("TCP", "a", "b", 1, 2, i * 1000, 10, 64 + i, i) for i in range(3)]
    p = spark.createDataFrame(rows, "protocol string, src_ip string, dst_ip string, src_port bigint, dst_port bigint, time_us bigint, pkt_len bigint, ttl int, n int")
    p = p.withColumns({f"tcp_flag_{f}": F.lit(int(f == "syn")) for f in ("syn", "ack", "fin", "rst", "psh", "urg")})
    p.coalesce(1).write.parquet(f"{tmp_path}/p")
    (tmp_path / "l.csv").write_text("i,x\n0,0\n1,1.0\n")  # a header and one label less
    got = captures.packet_table(spark, f"{tmp_path}/p", f"{tmp_path}/l.csv").orderBy("n").collect()
    assert [(r.n, r.label, r.flow_id) for r in got] == [(0, 0, "a_b_1_2_6"), (1, 1, "a_b_1_2_6")]
    f = captures.load(spark, "packet_flows", f"{tmp_path}/p", f"{tmp_path}/l.csv").first()
    assert (f.pkt_count, f.mean_ttl, f.syn_count, f.label, f.mean_iat_ms) == (2, 64.5, 2, 1, 1.0)
    with pytest.raises(ValueError):
        captures.load(spark, "nothing")


def test_netflow_scenarios(spark, tmp_path):
    head = ",".join(captures.NETFLOW_COLUMNS)
    line = "2011/08/10 09:46:5{s}.000001,1.5,TCP,147.32.1.1,0x10,  ->,8.8.8.8,{port},CON,0,,4,{b},10,{label}"
    for n in (1, 9):
        (tmp_path / str(n)).mkdir()
    (tmp_path / "1" / "c.binetflow").write_text("\n".join([head, line.format(s=9, port="80", b=40, label="flow=From-Botnet-1"), line.format(s=3, port="", b=0, label="flow=Background")]) + "\n")
    (tmp_path / "9" / "c.binetflow").write_text("\n".join([head, line.format(s=1, port="53", b=8, label="flow=From-Normal")]) + "\n")
    rows = captures.netflow_scenarios(spark, str(tmp_path), [1, 9]).collect()
    assert [(r.scenario, r.botnet, r.sport, r.dport, r.label, r.label_kind, r.host, r.bytes_per_pkt, r.src_byte_ratio, r.dtos) for r in rows] == [
        (1, "Neris", 16, -1, 0, "background", "147.32.1.1", 0.0, None, None), (1, "Neris", 16, 80, 1, "botnet", "147.32.1.1", 10.0, 0.25, None), (9, "Neris", 16, 53, 0, "normal", "147.32.1.1", 2.0, 1.25, None)]
    assert {r.scenario: r.bad_ports for r in captures.bad_ports(captures.netflow_scenarios(spark, str(tmp_path), [1, 9])).collect()} == {1: 1, 9: 0}
    assert captures.netflow_scenarios(spark, str(tmp_path), [1, 9], background="drop").count() == 2
    assert captures.netflow_scenarios(spark, str(tmp_path), [1], sample_per_scenario=1).count() == 1
    with pytest.raises(FileNotFoundError, match=r"\[2, 3\]"):
        captures.netflow_scenarios(spark, str(tmp_path), [1, 2, 3])
    (tmp_path / "2").mkdir()
    (tmp_path / "2" / "c.binetflow").write_text("\n".join([head, line.format(s="x", port="1", b=1, label="Normal")]) + "\n")
    with pytest.raises(Exception, match="does not parse"):
        captures.netflow_scenarios(spark, str(tmp_path), [2]).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "key string, v int")
    sinks.plot_table(df, f"{tmp_path}/plot")
    assert spark.read.csv(f"{tmp_path}/plot", header=True).count() == 2
    assert spark.read.json(sinks.run_documents(df.select(F.struct("key", "v").alias("run")), f"{tmp_path}/run", ".x")).where("run.v = 2").count() == 1
    made = []
    for settings in ({"a": 1}, {"a": 1}, {"a": 2}):
        sinks.cached(spark, f"{tmp_path}/cache", settings, lambda: made.append(1) or df)
    assert len(made) == 2
    assert sinks.with_predictions(spark, f"{tmp_path}/p", df).count() == 2
    again = sinks.with_predictions(spark, f"{tmp_path}/p", spark.createDataFrame([("b", 9), ("c", 3)], "key string, v int"))
    assert sorted((r.key, r.v) for r in again.collect()) == [("a", 1), ("b", 9), ("c", 3)]
    assert sorted(x.name for x in tmp_path.iterdir()) == ["cache", "p", "plot", "run.x"]


def test_result_archive(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"rows": {"trees | raw": {"aucpr": 0.5, "rocauc": 0.6, "coverage_test": 1.0, "representative_test": true}, "llm | raw": {"aucpr": 0.1}}}')
    a = readers.result_archive(spark, f"{tmp_path}/a.json")
    assert {r["config"]: r["aucpr"] for r in a.collect()} == {"trees | raw": 0.5, "llm | raw": 0.1}
    assert [(r.family, r.aucpr) for r in sinks.of_families(a, ["trees"], ["aucpr"]).collect()] == [("trees", 0.5)]


def test_identity_matches_for_rows_and_settings(spark):
    row = {"seed": 7, "regime": "external", "bundle": None, "name": 'a "b"'}
    df = spark.createDataFrame([(7, "external", None, 'a "b"')], "seed int, regime string, bundle string, name string")
    assert df.select(replies.run_identity({c: F.col(c) for c in df.columns})).first()[0] == replies.identity(row)


def test_replies_that_do_not_parse(spark):
    texts = {'{"prediction": "x", "confidence": "high"}': (0, 0.5), '{"prediction": 1, "confidence": {"a": 1}} attack': None, "{broken} Malicious": (1, 0.6), "": (0, 0.5), None: (0, 0.5)}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: (r.p, r.c) for r in df.select("t", *[v.alias(k[0]) for k, v in replies.parse_reply(F.col("t")).items()]).collect()}
    for t, want in texts.items():
        assert want is None or got[t] == want, t


def test_ranks_of_a_class_are_gapless_whatever_the_ranges(spark):
    df = spark.range(5000).withColumn("c", F.when(F.col("id") % 3 > 0, F.lit("big")))
    r = splits.ranked(df, ["c"], "id", "s").collect()
    for c in ("big", None):
        mine = [x for x in r if x.c == c]
        assert sorted(x["rank"] for x in mine) == list(range(1, len(mine) + 1)) and {x.class_size for x in mine} == {len(mine)}


def test_folds_and_policies(spark):
    df = spark.range(11).withColumns({"t": F.col("id") * 10, "g": F.col("id") % 4, "label": F.col("id") % 2})
    folds = {r.id: r.fold for r in splits.contiguous_folds(df, "t", "id", 3, 25).collect()}
    assert [folds[i] for i in range(11)] == [0] * 4 + [1] * 4 + [2] * 3
    assert splits.split(df, "scenario", "id", group="g", held=[1]).where("(part = 'test') <> (g = 1)").count() == 0
    assert splits.split(df, "temporal", "id", time="t").where("part = 'test'").count() == 3  # exactly int(11 * 0.8) = 8 train
    assert splits.split(df, "random", "id", 0.4).where("part = 'test'").count() == 4
    with pytest.raises(ValueError):
        splits.split(df, "group", "id")
    t = splits.thinned(df, 5, "id").collect()
    assert len(t) == 5 and {r.exposure for r in t} == {5 / 11}
    assert splits.thinned(df.limit(0), 5, "id").count() == 0
