"""A test for each finding of round 3 that was right."""

import collections
import datetime
import math
import re
import statistics

import duckdb
import numpy as np
from pyspark.sql import functions as F

from tamis.functions import email
from tamis.operators import metrics, predictability, sweeps
from tamis.plans import registry


def test_deviation_of_equal_gaps_is_that_of_the_sql(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(k, start + datetime.timedelta(microseconds=k * 5506028305), 7, "click", 1.5, '{"k": 3}') for k in range(19)]
    rows += [(100 + k, start + datetime.timedelta(microseconds=k * k * 977_000_003), 8, "view", 2.5, '{"k": 4}') for k in range(9)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = registry.QUERIES["flow_serialize"](spark, str(tmp_path)).select("src_ip", "sentence", "pairs").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(f"select src_ip, sentence, pairs from ({registry.ORACLE['flow_serialize']})").fetchall())


def test_no_task_gets_a_whole_column_for_its_median(spark):
    """The plan of a quantile: the rows of a column are never dealt by the column's name, and one range of them is put in order."""
    rows = spark.range(4000).selectExpr("cast(id * id % 3989 as double) as a", "if(id % 3 = 0, null, cast(id % 7 as double)) as b", "cast(null as double) as none")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # tables too large to be broadcast by themselves
    try:
        q = metrics.quantiles(rows, ["a", "b", "none"], 0.5)
        plan = q._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 2
    want = {c: statistics.median(r[c] for r in rows.collect() if r[c] is not None) for c in ("a", "b")}
    assert {r["name"]: r["value"] for r in q.collect()} == want
    by = metrics.quantiles(rows.selectExpr("cast(a % 2 as int) as g", "a"), ["a"], 0.9, by=["g"])
    assert {r.g: round(r.value, 6) for r in by.collect()} == {g: round(float(np.quantile([r.a for r in rows.collect() if r.a % 2 == g], 0.9)), 6) for g in (0, 1)}


def test_a_words_character_runs_are_made_once(spark):
    """Counts of the whole vocabulary are those of grams() text by text, and no run of a repeated word is cut out again."""
    texts = ["Ab cde ab  fghijkl", "ab ab cde", None, "", "cde x", "\u0130x abcd"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for kind in ("word", "char"):
        each = [predictability.grams(t, kind) for t in texts]
        want = {g: (sum(g in e for e in each), sum(e[g] for e in each)) for e in each for g in e}
        assert {r.gram: (r.documents, r.times) for r in predictability.vocabulary(df, kind, least=1).collect()} == want
    predictability.in_word.cache_clear()
    predictability.grams("ab cde", "char")
    predictability.grams("cde ab", "char")
    assert predictability.in_word.cache_info().misses == 2


def test_features_count_words_and_characters_in_one_pass(spark):
    """characters are not cut out one by one, words are not cut out for their number, and odd texts count as before."""
    f = email.features(F.col("text"))
    texts = ["", None, "a1b2c a1b 1a1a a@@b$c AB1", "ÀÉß ǅ ٣ \U0001f642\U0001f642 x y", "A" * 20, "-" + "A" * 19 + " " + "b" * 19, "onclickonerror javascript:onload oonclick", "a\x0bb\x0cc\rd\te \x1cf"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string").select("k", *[v.alias(n) for n, v in f.items()])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "(?s)." not in plan and "array_distinct" not in plan and plan.count("ArrowEvalPython") == 1
    got = [df.where(F.col("k") == k).first() for k in range(len(texts))]
    for t, r in zip(texts, got):
        t = t or ""
        words, n = re.findall(r"[^ \t\n\x0b\f\r]+", t), collections.Counter(t)
        assert (r.text_length, r.word_count) == (len(t), len(words)) and r.vocab_richness == (len({w.lower() for w in words}) / len(words) if words else 0)
        assert r.avg_word_length == (sum(map(len, words)) / len(words) if words else 0)
        assert abs(r.char_entropy - sum(c / len(t) * math.log2(len(t) / c) for c in n.values())) < 1e-9 if t else r.char_entropy == 0
    assert [r.leetspeak_count for r in got] == [len(re.findall("[a-zA-Z]+[@$!0-9]+[a-zA-Z]+", t or "")) for t in texts]
    assert [r.has_base64 for r in got] == [0, 0, 0, 0, 1, 0, 0, 0] and [r.js_event_handler_count for r in got] == [0, 0, 0, 0, 0, 0, 5, 0]
    assert got[3].uppercase_ratio == 2 / 6 and got[3].numeric_ratio == 1 / 14


def test_medians_of_all_folds_come_from_passes_that_shuffle_no_column(spark, tmp_path):
    """exact quantiles by condition, on ties, nulls, NaN, infinities and a column without numbers; few rows are shuffled."""
    rows = spark.range(6000).selectExpr("id % 3 as fold", "cast(id * id % 5987 as double) as a", "if(id % 2 = 0, 5.0, cast(id % 11 as double)) as b", "case id % 4 when 0 then null when 1 then double('NaN') when 2 then double('-Infinity') else id / 7 end as c", "cast(null as double) as none")
    rows = sweeps.kept(rows)
    held = rows.collect()
    for q in (0.0, 0.5, 0.9, 1.0):
        got = metrics.quantile_by_condition(rows, ["a", "b", "c", "none"], q, {str(k): F.col("fold") != k for k in range(3)} | {"never": F.lit(False)})
        assert got["never"] == {}
        for k in range(3):
            finite = {c: [r[c] for r in held if r.fold != k and r[c] is not None and math.isfinite(r[c])] for c in ("a", "b", "c")}
            assert {c: round(v, 9) for c, v in got[str(k)].items()} == {c: round(float(np.quantile(v, q)), 9) for c, v in finite.items()}
    assert rows.inputFiles() and all("kept-" in f for f in rows.inputFiles())  # a Parquet table, read by column
