"""The stages of the pipeline against brute force, and the whole pipeline on the smallest tables."""

import re
from collections import Counter

import pytest

import corpus_pipeline
from tamis.llm import exact_dedup, quality
from tamis.llm.common import scratch

SCHEMA = "doc_id bigint, text string, source string, n_chars bigint, sha string, set_key int, features int, kept boolean"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, len(t or ""), "c", k, 2, True) for k, (i, t, s) in enumerate(rows)], SCHEMA)


def test_exact_copies_go(spark):
    rows = [(5, "a b", "x"), (3, "a  b", "y"), (5, "a\tb", "x"), (3, "a b", "y"), (None, "a b", None), (7, None, "x"), (8, "", "x"), (9, "c", "x"), (9, "d", "x"), (None, "e", "x"), (None, "e", "z")]
    got = exact_dedup.drop_copies(frame(spark, rows))
    assert got.columns == frame(spark, []).columns
    kept = [(r.doc_id, re.sub(r"\s+", " ", r.text or "")) for r in got.collect()]
    assert sorted(map(repr, kept)) == sorted(map(repr, [(3, "a b"), (7, ""), (9, "c"), (9, "d"), (None, "e")]))
    assert exact_dedup.drop_copies(frame(spark, [])).count() == 0


def test_quality_keeps_what_it_scores_high(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    wide = docs.selectExpr("*", "1 as features", "2 as _features", "'x' as score")
    kept = quality.keep_good(wide, labels)
    assert kept.columns == wide.columns
    want = {r.doc_id for r in quality.scored(docs, labels).collect() if r.predicted == 1}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    assert quality.keep_good(wide.limit(0), labels).count() == 0


def test_word_hashes_tell_anagrams_apart():
    names = dict(zip(quality.FEATURES, quality.features("abc cab bca acb")))
    assert names["distinct_words"] == 1 and names["repeats_next"] == 0
    assert dict(zip(quality.FEATURES, quality.features("abc abc abc abc")))["distinct_words"] == 0.25


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, sf), "test")
        out.append(docs)
    return out


def test_each_stage_does_its_work(spark, sf, stages):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good, once, apart, mixed, packed = ([r.asDict() for r in s.collect()] for s in stages)
    assert all(s.columns == docs.columns for s in stages[:-1])
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    first = {}
    for r in good:
        first[norm(r["text"])] = min(r["doc_id"], first.get(norm(r["text"]), r["doc_id"]))
    assert sorted(r["doc_id"] for r in once) == sorted(first.values())

    def shingles(t):
        w = [x for x in norm(t).lower().split(" ") if x]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {r["doc_id"]: shingles(r["text"]) for r in once}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert sorted(r["doc_id"] for r in apart) == sorted({find(i) for i in sets})
    texts, drawn = {r["doc_id"]: r["text"] for r in apart}, Counter(r["doc_id"] for r in mixed)
    assert set(drawn) <= set(texts) and max(drawn.values()) <= 2
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    assert all(r["text"] == texts[r["doc_id"]] or words(r["text"]) == words(texts[r["doc_id"]])[: len(words(r["text"]))] for r in mixed)
    total = sum(len(words(r["text"])) for r in apart)
    assert abs(sum(len(words(r["text"])) for r in mixed) - 1.5 * total) < 25
    assert Counter(p["doc_id"] for p in packed if p["start"] == 0) == drawn
    assert sum(p["length"] for p in packed) == sum(p["doc_tokens"] for p in packed if p["start"] == 0)


def test_run_returns_the_last_stage_and_leaves_no_scratch(spark, sf, stages):
    before = len(scratch)
    out = corpus_pipeline.run(spark, sf)
    assert sorted(map(repr, out.select("doc_id", "start", "ids_crc32").collect())) == sorted(map(repr, stages[-1].select("doc_id", "start", "ids_crc32").collect()))
    assert len(scratch) == before + 1
