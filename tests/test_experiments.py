"""Bootstraps, policies, rankings, bundles, predictability and sweeps against brute force on small fixtures."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tamis.operators import curves, learn, predictability, prevalence, report, sources, splits, sweeps
from tamis.plans import registry, views


def average_precision(scores, labels, weights):
    total, cp, cn, out = sum(w * y for y, w in zip(labels, weights)), 0, 0, 0.0
    for s in sorted(set(scores), reverse=True):
        p = sum(w * y for x, y, w in zip(scores, labels, weights) if x == s)
        cp, cn = cp + p, cn + sum(w for x, w in zip(scores, weights) if x == s)
        out += cp / cn * p if cn else 0
    return out / total if total else None


def test_replicate_weights_are_those_of_the_expression(spark):
    names = ["a", "b:c", "", None]
    df = spark.createDataFrame([(g, r) for g in names for r in range(40)], "g string, rep int").withColumn("w", prevalence.poisson_weight(F.col("g"), F.col("rep"), "7"))
    for g in names:
        want = [r.w for r in df.where(F.col("g").eqNullSafe(F.lit(g))).orderBy("rep").collect()]
        assert curves.replicate_weights(g, 40, "7").tolist() == [1, *want]


@pytest.mark.parametrize("parts", [2, 64])
def test_aucpr_bootstrap_equals_brute_force(spark, parts):
    rng = random.Random(3)
    rows = [(rng.choice(["g0"] * 6 + ["g1", "g2", None]), int(rng.random() < 0.3), round(rng.random(), 1), rng.random() if k % 9 else None) for k in range(300)]
    df = spark.createDataFrame(rows, "g string, label int, a double, b double")
    each = {(r.which, r.rep): r.aucpr for r in curves.replicated_aucpr(df, "g", ["a", "b"], 30, parts=parts).collect()}
    have = [r for r in rows if r[3] is not None]
    for rep in range(-1, 30):
        w = [float(curves.replicate_weights(r[0], 30, "42")[rep + 1]) for r in have]
        for k, name in ((2, "a"), (3, "b")):
            want = average_precision([r[k] for r in have], [r[1] for r in have], w)
            assert each.get((name, rep)) == (None if want is None else pytest.approx(want)), (name, rep, want)
    out = {r.measure: r for r in curves.aucpr_bootstrap(df, "g", "a", "b", 30, parts=parts).collect()}
    d = [each["a", r] - each["b", r] for r in range(30) if ("a", r) in each]
    assert out["a - b"].replicates == len(d) and out["a - b"].lo == pytest.approx(np.percentile(d, 2.5), abs=1e-6)
    assert curves.aucpr_bootstrap(df.where("label = 0"), "g", "a", "b", 5).collect() == [] and curves.aucpr_bootstrap(df.limit(0), "g", "a", "b", 5).collect() == []


def test_policies_say_why_there_is_none(spark):
    df = spark.createDataFrame([(1, "phishing", 0.9), (0, "ham", 0.1), (0, "ham", 0.8), (1, "phishing", None)], "label int, subtype string, score double")
    got = {r.policy: (r.threshold, r.reason) for r in report.threshold_policies(df).collect()}
    assert got == {"fixed": (0.5, None), "recall": (0.9, None), "precision": (None, "a weighted subtype is absent"), "conservative_precision": (None, "a weighted subtype is absent")}
    got = {r.policy: (r.threshold, r.reason, r.n_cal, r.candidates) for r in report.threshold_policies(df, spam_share=0.0).collect()}
    assert got["precision"] == (0.9, None, 3, 3) and got["conservative_precision"][1] == "no score meets the target"
    assert {r.policy for r in report.threshold_policies(df.limit(0)).where("attainable").collect()} == {"fixed"}


def test_ranking_eligibility(spark):
    rows = [("t", "best-but-few", 0.9, True, 0.5, None, None), ("t", "partial", 0.8, False, None, None, None), ("t", "old-name", 0.8, None, None, 0.95, None), ("t", "tie-b", 0.7, True, None, 0.9, None), ("t", "tie-a", 0.7, None, None, None, None), ("t", "third", 0.6, True, 1.0, 0.1, None), ("t", "none", None, True, 1.0, None, None), ("u", "x", 0.9, True, 1.0, None, "one class"), ("v", "y", None, True, 1.0, None, None)]
    df = spark.createDataFrame(rows, "task string, config string, aucpr double, representative_test boolean, coverage_test double, coverage double, note string")
    top = lambda **o: sorted((r.task, r.rank, r.config, r.status) for r in report.top_configurations(df, **o).collect())
    assert top() == [("t", 1, "old-name", "ranked"), ("t", 2, "tie-a", "ranked"), ("u", 0, None, "degenerate"), ("v", 0, None, "unranked")]
    assert top(excluded=("old",))[:2] == [("t", 1, "tie-a", "ranked"), ("t", 2, "tie-b", "ranked")]


def test_temporal_split_takes_exactly_the_first(spark):
    df = spark.createDataFrame([(k, t, k % 2) for k, t in enumerate([5, 5, 5, 5, 5, 5, 5, 1, 9, 5, None])], "id int, t bigint, label int")
    got = {r.id: r.part for r in splits.temporal_split(df, "t", "id", 0.8, width=2).collect()}
    assert got == {7: "train", **{k: "train" for k in range(7)}, 9: "test", 8: "test"}
    r = splits.temporal_report(splits.temporal_split(df, "t", "id", 0.8, width=2), "t").first()
    assert (r.n_train, r.n_test, r.cutoff_time, r.test_time_min, r.in_order) == (8, 2, 5, 5, True)


def test_bundles_equal_brute_force(spark):
    rng = random.Random(1)
    kinds = ["phishing", "ham", "bulk_spam", "scam_fraud", "unknown_nonphishing"]
    rows = []
    for k in range(14):
        main = kinds[k % 5]
        rows += [(f"{'abc'[k % 3]}-{k}", main if rng.random() < (0.97 if k % 4 else 0.5) else rng.choice(kinds)) for _ in range(rng.choice([3, 20, 30]))]
    rows += [("a-all", "phishing")] * 9 + [("a-all", "ham")] + [(None, "ham")] * 4
    df = spark.createDataFrame(rows, "source_corpus string, subtype string")
    roles = sources.source_roles(df)
    by = {r.source: r for r in roles.collect()}
    for s, r in by.items():
        mine = [t for c, t in rows if c == s]
        share = {k: sum(t in names for t in mine) / len(mine) for k, names in sources.ROLES.items()}
        assert r.role == next((k for k, v in share.items() if v >= 0.9), "mixed") and r.n == len(mine)
    assert by["a-all"].role == "phishing"
    want = set()
    fit = lambda role: [s for s, r in by.items() if r.role == role and r.n >= 5]
    for d, e, f in itertools.product(fit("phishing"), fit("ham"), fit("spam_like")):
        left = {s: r for s, r in by.items() if s not in (d, e, f)}
        if {"phishing", "ham", "spam_like"} <= {r.role for r in left.values()}:
            families = {s[0] for s in left}
            want.add((d, e, f, *("family-disjoint" if s[0] not in families else "within-family-partition" for s in (d, e, f))))
    got = {(r.phishing_source, r.ham_source, r.spam_scam_source, r.phishing_tier, r.ham_tier, r.spam_scam_tier) for r in sources.external_bundles(roles, F.substring("source", 1, 1), 5).collect()}
    assert want and got == want
    one = roles.where("source <> 'a-all' OR role <> 'phishing'")
    only = [s for s, r in by.items() if r.role == "phishing" and s != "a-all"][:1]
    assert sources.external_bundles(one.where((F.col("role") != "phishing") | F.col("source").isin(only)), F.col("source"), 1).count() == 0  # removal would use the role up


def test_grams():
    assert predictability.grams("A b-cd, cd", "word") == {"cd": 2, "cd cd": 1}
    assert predictability.grams("ab ab c", "char") == {" ab": 2, "ab ": 2, " ab ": 2, " c ": 1}
    assert predictability.grams("abcd", "char") == {" ab": 1, "abc": 1, "bcd": 1, "cd ": 1, " abc": 1, "abcd": 1, "bcd ": 1, " abcd": 1, "abcd ": 1}
    assert not predictability.grams(None, "word") and not predictability.grams(" ", "char")


def test_source_predictability(spark, monkeypatch):
    monkeypatch.setattr(predictability, "HELD", 20)  # counts leave a task many times
    rng = random.Random(2)
    words = {s: [f"{s}word{k}" for k in range(6)] for s in ("x", "y", "z")}
    rows = [(s, "train" if k % 3 else "test", " ".join(rng.choice(words[s]) for _ in range(8)) + " shared words here") for s in words for k in range(30)]
    rows += [("only", "train", "never tested")] * 3 + [(None, "test", "no source"), ("x", "test", None)]
    df = spark.createDataFrame(rows, "source string, part string, text string")
    v = {r.gram: (r.documents, r.times) for r in predictability.vocabulary(df, "word").collect()}
    assert v["shared words"] == (90, 90) and "no source" not in v and "never tested" in v
    assert [r.gram for r in predictability.vocabulary(df, "word", most=2).orderBy("gram").collect()] == ["shared", "here"] or len(predictability.vocabulary(df, "word", most=2).collect()) == 2
    x = predictability.vectors(df.where("source = 'x'"), predictability.vocabulary(df, "char"), 90, "char").select("v").collect()
    assert all(abs(r.v.norm(2) - 1) < 1e-9 or not r.v.numNonzeros() for r in x)
    out = {r.source: r for r in predictability.source_predictability(df, "word").collect()}
    assert set(out) == {"x", "y", "z"} and out["y"].recall == 1.0 and out["x"].support == 11 and out["x"].right >= 10
    assert predictability.source_predictability(df.where("source = 'x'"), "word").collect() == []


def numbers(spark, n=240, seed=5):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        y = int(rng.random() < 0.4)
        rows.append((k, y, "train" if k % 4 else "test", k % 3, y + rng.gauss(0, 0.7), rng.gauss(0, 1) if k % 5 else None, ("phishing" if y else rng.choice(["ham", "ham", "bulk_spam"]))))
    return spark.createDataFrame(rows, "id int, label int, part string, fold int, a double, b double, subtype string")


def test_one_featurisation_for_all_conditions(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        made.add(1)
        return x

    df = numbers(spark)
    stored = sweeps.matrix(df.withColumn("a", counted.asNondeterministic()("a")), ["a", "b"], ["id", "label", "part", "subtype"], F.col("part") == "train")
    out = sweeps.condition_scores(stored, {"all": F.lit(True), "few": F.col("id") < 100, "none": F.col("label") == 1}, learn.logistic())
    rows = sweeps.evaluated(out.where("part = 'test'"), ["all", "few", "none"], []).collect()
    assert made.value == 240 and {r.name for r in rows} == {"all", "few"} and all(r.rocauc > 0.7 and r.n == 60 for r in rows)


def test_stack_sweep(spark):
    df = numbers(spark)
    base = sweeps.base_scores(df, "id", {"m": (["a"], learn.logistic()), "k": (["a", "b"], learn.logistic())}, 3)
    assert base.groupBy("model").count().select("count").distinct().first()[0] == 240
    reply = df.where("id % 10 < 7").select("id", F.lit("reply").alias("model"), (F.col("label") * 0.2 + 0.4).alias("p1"))
    rare = df.where("id < 40").select("id", F.lit("rare").alias("model"), F.lit(0.5).alias("p1"))
    wide = sweeps.side_by_side(df.select("id", "label", "part"), base.unionByName(reply).unionByName(rare), "id", ["m", "k", "reply", "rare"])
    out = {(r.combination, r.stage2): r for r in sweeps.stack_sweep(wide, {"m+k": ["m", "k"], "m+reply": ["m", "reply"], "rare": ["m", "rare"]}, {"linear": learn.logistic(), "trees": learn.boosted_trees(5, 2)}).collect()}
    assert len(out) == 6 and out["m+k", "linear"].coverage_test == 1.0 and out["rare", "trees"].aucpr is None and out["rare", "linear"].n_evaluated == 10
    part = df.where("part = 'test' AND id % 10 < 7").count()
    assert out["m+reply", "trees"].n_evaluated == part and out["m+reply", "linear"].coverage_test == round(part / 60, 6)
    assert out["m+reply", "linear"].aucpr == 1.0 and out["m+k", "linear"].rocauc > 0.7


def test_learning_curve_holds_smaller_sets(spark):
    df = numbers(spark)
    train = splits.ranked(df.where("part = 'train'"), [], "id", "42").drop("class_size")
    stored = sweeps.matrix(train.unionByName(df.where("part = 'test'").withColumn("rank", F.lit(None).cast("long"))), ["a", "b"], ["label", "part", "rank"], F.col("part") == "train")
    got = {r["size"]: r for r in sweeps.learning_curve(stored, [1, 50, 999], learn.logistic()).collect()}
    assert [got[s].n_train for s in (1, 50, 999)] == [1, 50, 180] and got[1].aucpr is None and got[999].n == 60 and got[999].rocauc > 0.7


def test_building_a_plan_runs_no_job_over_the_rows(spark, sf):
    tracker, scan = spark.sparkContext.statusTracker(), views.read(spark, sf, "documents")
    spark.sparkContext.setJobGroup("plan", "plan")
    try:
        views.spread(scan)
        assert list(tracker.getJobIdsForGroup("plan")) == []
        registry.annotated(spark, sf)
        assert len(tracker.getJobIdsForGroup("plan")) <= 2  # the two files' schemas
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_two_queries_of_one_name_are_refused():
    with pytest.raises(ValueError):
        registry.query()(registry.QUERIES["packet_flows"])


def test_texts_stay_out_of_the_join_with_labels(spark, sf):
    plan = registry.annotated(spark, sf).select("doc_id", "content_hash", "label")._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join")]
    assert "text" not in above and "norm" not in above
