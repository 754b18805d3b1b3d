"""Prefix doubling against brute force: periodic texts, strings around the threshold, ranges that cut runs, odd rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tamis.llm import repeats


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    make = lambda n: "".join(rng.choice("abcde é\n") for _ in range(n))
    texts = [None, "", "a" * 900, "ab" * 400, "a" * 399, make(900)]
    for size in (398, 400, 401, 463, 464):
        passage = make(size)
        texts += [make(rng.randint(0, 90)) + passage + make(rng.randint(0, 300)) for _ in range(2)]
    long = make(700)
    texts += [long[:500] + make(50) + long[100:] + make(20) + long[200:640]] + [make(60) + long + make(k) for k in range(12)]
    out = [(i, t, "x", k) for k, (i, t) in enumerate(enumerate(texts))]
    return [*out, (3, texts[3], "y", 7), (None, texts[5], None, None), (None, make(500), "z", 1)]


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + 400] for b in raw for p in range(len(b) - 399))
    for b in raw:
        mask = np.zeros(len(b), bool)
        for p in range(len(b) - 399):
            if seen[b[p : p + 400]] > 1:
                mask[p : p + 400] = True
        left = np.frombuffer(b, np.uint8)[~mask].tobytes()
        yield len(b), int(mask.sum()), int((np.diff(np.r_[0, mask.astype(np.int8)]) == 1).sum()), hashlib.sha256(left).hexdigest()


@pytest.mark.parametrize("range_rows", [40, 500_000])
def test_prefix_doubling_equals_brute_force(spark, rows, range_rows, monkeypatch):
    monkeypatch.setattr(repeats, "RANGE_ROWS", range_rows)  # small ranges cut runs of equal pairs
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, tid string, rank int").repartition(5)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(docs).collect())
    assert got == Counter((r[0], *want) for r, want in zip(rows, brute([r[1] for r in rows])))


def test_ranks_name_equal_pairs_alike_and_unique_ones_go(spark, monkeypatch):
    monkeypatch.setattr(repeats, "RANGE_ROWS", 50)
    rng = random.Random(2)
    pairs = [(False, rng.choice([1, 2, rng.randint(3, 300)]), rng.choice([0, 1]), k, 0, k, 0) for k in range(1200)]
    df = spark.createDataFrame(pairs + pairs[:50], "is_last boolean, r1 bigint, r2 bigint, tid bigint, idx bigint, code bigint, tail bigint")
    got = repeats.ranked(df, len(pairs)).collect()
    found = {r.tid: r.rank for r in got}
    count = Counter(p[1:3] for p in pairs)
    shared = {p[3] for p in pairs if count[p[1:3]] > 1}
    assert len(found) == len(got) and shared <= set(found) and len(set(found) - shared) <= 2 * 24  # two rows of each of 24 ranges stay unjudged
    names = {p[1:3]: found[p[3]] for p in pairs if p[3] in found}
    assert all(found[p[3]] == names[p[1:3]] for p in pairs if p[3] in found) and len(set(names.values())) == len(names)


@pytest.mark.parametrize("last", [False, True])
def test_the_rows_of_a_frequent_name_are_split(spark, monkeypatch, last):
    """One name holds three quarters of the rows: Spark must be able to deal them to several tasks in the joins on key and hull."""
    settings = {"autoBroadcastJoinThreshold": "-1", "shuffle.partitions": "8", "adaptive.coalescePartitions.enabled": "false", "adaptive.advisoryPartitionSizeInBytes": "4k", "adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "adaptive.skewJoin.skewedPartitionFactor": "1.5", "files.maxPartitionBytes": "64k", "files.openCostInBytes": "1k"}
    before = {f"spark.sql.{k}": spark.conf.get(f"spark.sql.{k}") for k in settings}
    plans, real = [], repeats.stored

    def stored(df, name):
        if name in ("marks", "repeats", "names"):
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0])
        return real(df, name)

    monkeypatch.setattr(repeats, "stored", stored)
    keys = spark.range(0, 40000, 1, 16).selectExpr("if(id % 4 = 0, id div 8, -1L) key", "if(id % 4 = 0, id div 8, -1L) hull", "id tid", "id * 7 a", "0L d")
    try:
        for k, v in settings.items():
            spark.conf.set(f"spark.sql.{k}", v)
        got = repeats.resolved(keys, last=last).agg({"*": "count", "tid": "max"}).first()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert tuple(got) == (40000, 39999)
    assert sum("SortMergeJoin(skew=true)" in p for p in plans) >= (1 if last else 2)
