"""Every analytics query against its SQL oracle."""

import glob
import math
import os

import duckdb
import pytest

from tamis.plans import registry


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, str):
        return x
    return round(float(x), 9)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = df.select(*cols).toPandas()
    if name not in registry.ORACLE:
        assert len(got)
        return
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = con.sql(registry.ORACLE[name]).df()
    assert sorted(want.columns) == cols
    key = lambda rows: sorted(repr([cell(x) for x in r]) for r in rows)
    assert key(got.itertuples(index=False)) == key(want[cols].itertuples(index=False))


def test_group_folds_do_not_leak(spark, sf):
    rows = registry.QUERIES["split_group_folds"](spark, sf)
    assert rows.groupBy("template_group").agg({"fold": "min"}).join(rows.groupBy("template_group").agg({"fold": "max"}), "template_group").where("`min(fold)` <> `max(fold)`").count() == 0


def test_overlap_report_sees_every_row_and_kind(spark):
    from tamis.operators import splits

    rows = [("train", "h1", "g1", "src7"), ("test", "h1", "g1", "src7"), ("cal", "h2", "g1", None), ("train", "h3", "g2", "src0"), ("train", "h3", "g2", "src0")]
    report = lambda r: {(x.part_a, x.part_b): (x.hash_overlap, x.group_overlap, x.clean) for x in splits.overlap_report(spark.createDataFrame(r, "part string, content_hash string, template_group string, source string"), ["train", "cal", "test"], {"hash_overlap": "content_hash", "group_overlap": "template_group"}).collect()}
    assert report(rows) == {("test", "train"): (1, 1, False), ("cal", "train"): (0, 1, False), ("cal", "test"): (0, 1, False)}
    assert set(report(rows[2:]).values()) == {(0, 0, True)}
    assert len(registry.QUERIES["partition_overlap_report"](spark, "/root/testdata/sf0.001").collect()) == 3


def test_ports_and_labels(spark):
    from pyspark.sql import functions as F

    from tamis.functions import network

    rows = spark.createDataFrame([("80",), ("0x50",), ("",), (None,), ("x",)], "p string").select(network.port(F.col("p")).alias("p"))
    assert [r.p for r in rows.collect()] == [80, 80, -1, -1, -1]
    rows = spark.createDataFrame([("From-Botnet-Normal",), ("to-normal",)], "l string").select(network.label_kind(F.col("l")).alias("k"))
    assert [r.k for r in rows.collect()] == ["Botnet", "Normal"]


def test_ranges_hold_piled_up_scores_and_null_groups(spark):
    from pyspark.sql import functions as F

    from tamis.operators import metrics

    rows = [(None if k % 3 == 0 else "a", 0.999 + (k % 500) / 1e6 if k % 100 else k / 1e4, int(k % 7 == 0)) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, score double, label int")
    got = {(r.g, r.score): (r.p, r.n, r.cp, r.cn, r.tp, r.tn) for r in metrics.prefix_counts(df, ["g"]).collect()}
    for g in (None, "a"):
        mine = [(s, y) for h, s, y in rows if h == g]
        for s in sorted({s for s, _ in mine})[::50]:
            at, above = [y for t, y in mine if t == s], [y for t, y in mine if t >= s]
            assert got[(g, s)] == (sum(at), len(at), sum(above), len(above), sum(y for _, y in mine), len(mine))
    d = df.groupBy("g", "score").agg(F.count("*").alias("n"))
    sizes = [r["count"] for r in metrics.in_ranges(d, ["g"], "score").groupBy("g", "_r").count().collect()]
    assert max(sizes) <= 40  # of about 500 distinct scores a group
