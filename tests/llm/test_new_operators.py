"""Hard negatives, line dedup and turn repair against brute force and SQL."""

import hashlib
import math
import random
import re
import zlib
from functools import lru_cache

import duckdb
import numpy as np
import pytest

from tamis.llm import hard_negatives, line_dedup, registry, turn_repair

# -- hard negatives -----------------------------------------------------------------------------------------------------


def brute_negatives(rows):
    rows = sorted({(i, lab, tuple(v)) for i, v, lab in rows if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v)})
    q = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows]
    out = []
    for at, (a, la, va) in enumerate(q):
        if a % 100:
            continue
        s = sorted((-sum(x * y for x, y in zip(va, v)), i, la == lab) for k, (i, lab, v) in enumerate(q) if k != at and len(v) == len(va))
        for p, pid, _ in [x for x in s if x[2]][:5]:
            hits = [(n, nid) for n, nid, same in s if not same and 80 * -p <= 100 * -n <= 100 * -p][:5]
            out += [(a, pid, r + 1, nid, -p, -n) for r, (n, nid) in enumerate(hits)]
    return sorted(out)


def vectors(n=500, d=24, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, d)) * 0.3
    rows = [(k, (base[k % 12] + rng.normal(size=d) * 0.1).astype(np.float32).astype(float).tolist(), int(k * 7 % 5)) for k in range(n)]
    rows += [(n + k, rows[k * 3][1], 2) for k in range(40)]  # ties
    rows += [rows[100], rows[100], rows[7]]  # repeated rows
    rows += [(None, rows[0][1], 1), (9001, None, 1), (9002, [], 1), (9003, [1.0, None], 1), (9004, [math.nan] * d, 1), (9005, [math.inf] * d, 2), (9006, rows[1][1], None), (9100, [0.0] * d, 0)]
    rows += [(k, [0.5, -0.25, float(k % 9) / 10], k % 2) for k in range(20_000, 20_030)]  # another dimension
    return rows


@pytest.mark.parametrize("block", [64, 4096])
def test_hard_negatives_equal_brute_force(spark, block):
    rows = vectors()
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id bigint, embedding array<double>, label int, key int")
    got = sorted(map(tuple, hard_negatives.mined(df, block_rows=block).collect()))
    want = brute_negatives(rows)
    assert len(want) > 60 and got == want


def test_hard_negatives_odd_input(spark):
    schema = "vec_id bigint, embedding array<double>, label int"
    assert hard_negatives.mined(spark.createDataFrame([], schema)).collect() == []
    big = [(0, [1e30, 1e30], 1), (1, [1e30, 0.5], 1), (2, [9e29, 1e30], 2), (3, [-1e30, 0.0], 2)]
    df = spark.createDataFrame(big, schema)
    assert [tuple(r)[:4] for r in hard_negatives.mined(df).collect()] == [(0, 1, 1, 2)]  # scores beyond 64 bits are cut, so they tie


def test_bounds_hold_and_tighten():
    rng = np.random.default_rng(3)
    q = np.floor(256 * rng.normal(size=(60, 37)) * rng.uniform(0.01, 2, size=(60, 1)))
    side, exact, width = hard_negatives.Side(q), q @ q.T, []
    for mean, dev in side.levels:
        assert (mean @ mean.T - dev @ dev.T <= exact + 1e-6).all() and (mean @ mean.T + dev @ dev.T >= exact - 1e-6).all()
        width.append((dev @ dev.T).mean())
    assert width[0] > width[1] > width[2]
    i, j, s = hard_negatives.scored(side, side, np.ones((60, 60), bool), lambda low, high, left, i: high > 1e5)
    assert {(a, b, int(c)) for a, b, c in zip(i, j, s) if c > 1e5} == {(a, b, int(exact[a, b])) for a, b in zip(*np.nonzero(exact > 1e5))}


# -- line dedup ---------------------------------------------------------------------------------------------------------


def brute_lines(rows):
    space = " \t\n\x0b\x0c\r"
    low = str.maketrans({c: chr(ord(c) + 32) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    key = lambda line: line.strip(space).translate(low)
    docs = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            docs.setdefault(key(line), set()).add(-(2**63) if d is None else d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        me = -(2**63) if d is None else d
        left = [x for x in lines if not (len(key(x)) >= 20 and len(docs[key(x)]) >= 3 and max(docs[key(x)]) != me)]
        out.append((d, len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest(), "\n".join(left)))
    return sorted(out, key=repr)


def pages(seed=2):
    rng = random.Random(seed)
    shared = [f"  Shared line number {k} of the site\t" for k in range(12)] + ["zwanzig Zeichen äöü ßß", "neunzehn Zeichen ä ö", "EXACTLY twenty chars", "only nineteen chars"]
    rows = []
    for d in range(300):
        lines = [rng.choice(shared) if rng.random() < 0.5 else f"own {d} {rng.random()} and more" for _ in range(rng.randint(0, 9))]
        if d % 3 == 0:
            lines.append("A line that a third of all documents hold")
        rows.append((d, "\n".join(x.upper() if rng.random() < 0.2 else x for x in lines)))
    rows += [(None, "A line that a third of all documents hold\nx"), (301, None), (302, ""), (303, "\n\n"), (5, "Shared line number 1 of the site\nb"), rows[6], rows[6], (304, "A line that a third of all documents hold\n" * 400)]
    rows += [(400 + k, "Twice only, this line is\nsolo") for k in range(2)] + [(410, "long " * 40_000 + "\n" + "Shared line number 3 of the site")]
    return rows


@pytest.mark.parametrize("size", [60, 400_000])
def test_line_dedup_equals_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(line_dedup, "RANGE_ROWS", size)  # so small that keys lie in many ranges
    rows = pages()
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id bigint, text string, keep string, t int")
    got = sorted(map(tuple, line_dedup.deduplicated(df, with_text=True).collect()), key=repr)
    want = brute_lines(rows)
    assert sum(x[2] for x in want) > 300 and got == want


def test_line_dedup_of_nothing(spark):
    assert line_dedup.deduplicated(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_bitmaps():
    packed = line_dedup.write_bitmap(np.array([4, 1]))
    assert line_dedup.read_bitmap(packed, 5).tolist() == [True, False, True, True, False]
    assert line_dedup.read_bitmap(packed, 12)[5:].all() and line_dedup.read_bitmap(None, 2).all()


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_line_dedup"])
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = registry.QUERIES[name](spark, sf)
    want = con.sql(registry.ORACLE[name]).df()[df.columns]
    assert len(want) and sorted(map(tuple, df.toPandas().itertuples(index=False))) == sorted(map(tuple, want.itertuples(index=False)))


# -- turn repair --------------------------------------------------------------------------------------------------------


def brute_repair(rows):
    """(cost, audit, repaired rows) by trying all edits, cheapest and then ASCII-least; rows: (initial, fault)."""
    nxt = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(None)
    def best(i, state, inserts):
        found = [(0, "")] if i == len(rows) and state in ("", "a") else []
        if i < len(rows):
            c, fault = rows[i]
            x = best(i + 1, state, 0)
            found.append((x[0] + 2, "D" + x[1]))
            if fault not in (1, 2):
                for op, to, price in (("K", c, 0), ("R", "u", 1), ("R", "a", 1)):
                    if (state, to) in nxt:
                        x = best(i + 1, nxt[state, to], 0)
                        found.append((x[0] + price + (5 if fault == 3 else 0), op + x[1]))
        if inserts < 3:  # three in a row cost more than any need
            for to in "ua":
                if (state, to) in nxt:
                    x = best(i, nxt[state, to], inserts + 1)
                    found.append((x[0] + 5, "I" + x[1]))
        return min(found, default=(10**9, ""))

    return best(0, "", 0)


@pytest.mark.parametrize("long", [10**9, -1])
def test_alignment_equals_brute_force(long):
    rng = random.Random(4)
    for k in range(1500):
        rows = [(rng.choice("uuuaaast"), rng.choice([0, 0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 11))]
        got = turn_repair.repair([c for c, _ in rows], np.array([f for _, f in rows], np.int64), long)
        assert got == brute_repair(tuple(rows)), rows


def test_whole_and_folded_tables_agree():
    rng = random.Random(9)
    for n in (200, 333):
        initials = ["s"] + [("ua"[k % 2] if rng.random() < 0.8 else rng.choice("uast")) for k in range(n)]
        faults = np.array([rng.choice([0] * 8 + [1, 2, 3]) for _ in initials])
        assert turn_repair.repair(initials, faults) == turn_repair.repair(initials, faults, long=1)
    user, assistant, system = turn_repair.costs(["u", "a"] * 20_000, np.zeros(40_000, np.int64))
    assert turn_repair.folded(user, assistant, system) == (0, "K" * 40_000)


def brute_conversations(rows):
    """Damage, checks, edits and the repaired text of each conversation, one turn at a time."""
    out, text = [], lambda x: " " if x is None else str(x)
    for conv in sorted({r[0] for r in rows}, key=lambda c: (c is not None, c or 0)):
        turns = []
        for c, t, role, said in rows:
            if c != conv:
                continue
            role, said, kind = text(role), text(said), zlib.crc32(f"{text(c)}:{text(t)}".encode()) % 20
            said = "" if kind == 1 else re.sub("[.!?]", "", said) if kind == 2 else said
            role = "user" if kind == 4 else role
            turns += [(t, role, said)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(f"{len(x[1])}:{x[1]}{x[2]}".encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, said in turns:
            core = said.strip(" \t\n\x0b\x0c\r")
            faults.append(1 if not core else 2 if (role, said) in seen else 3 if core[-1] not in ".!?" else 0)
            seen.add((role, said))
        numbers = {t for t, _, _ in turns if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        first = [role[:1] for _, role, _ in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
        cost, audit = brute_repair(tuple(zip(first, faults)))
        left, at = [], 0
        for op in audit:
            role = "assistant" if left and left[-1][:1] == "u" else "user"
            if op == "I":
                left.append(f"{role}:")
                continue
            if op != "D":
                left.append(f"{turns[at][1] if op == 'K' else role}:{turns[at][2]}")
            at += 1
        assert re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in left))
        out.append((conv, gaps, *(faults.count(k) for k in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return sorted(out, key=repr)


def talks(seed=6):
    rng = random.Random(seed)
    rows = []
    for conv in range(150):
        for turn in range(rng.randint(1, 12)):
            role = rng.choice(["user", "assistant", "system", "tool", None, ""]) if rng.random() < 0.15 else ("user", "assistant")[turn % 2]
            said = rng.choice([f"Line {rng.randrange(3)}.", f"No end {rng.random()}", "Is it? \n", None, " \t", f"Fine {rng.random()}!"])
            rows.append((conv, None if rng.random() < 0.05 else turn * rng.choice([1, 1, 1, 3]), role, said))
    rows += [(None, 0, "user", "Hello."), (None, 1, "assistant", "Hi."), (2**53 + 1, 1, "user", "x."), (2**53 + 1, 2, "assistant", "y."), (2**53 + 2, None, "user", "z.")]
    gone = next(k for k in range(5000, 9999) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    return [*rows, *rows[:5], (gone, 0, "user", "Hello."), (7777, 0, "user", "word " * 50_000)]


def test_turn_repair_equals_brute_force(spark):
    rows = talks()
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, front int, seal string")
    got = sorted(map(tuple, turn_repair.repaired(turn_repair.damaged(df)).collect()), key=repr)
    want = brute_conversations(rows)
    assert got == want
    assert {"D", "K", "R"} <= set("".join(r[7] for r in want))
    assert turn_repair.repaired(turn_repair.damaged(df.limit(0))).collect() == []


def test_turn_repair_of_the_given_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, registry.QUERIES["op13_turn_repair"](spark, sf).collect()), key=repr) == brute_conversations(rows)


# -- secret scan on planted findings ------------------------------------------------------------------------------------


def test_forest_learns_the_planting_and_not_the_rule(spark, sf):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.sql import functions as F

    from tamis.llm import findings, secrets

    made = findings.planted_findings(spark)
    assert made.count() == made.select("doc_id").distinct().count() == findings.FINDINGS and made.exceptAll(findings.planted_findings(spark)).count() == 0
    words = secrets.dictionary(spark.read.parquet(f"{sf}/documents.parquet"))
    found = secrets.by_rule(secrets.features(secrets.labelled_candidates(spark), words))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = secrets.train(found.where(~held))
    test = VectorAssembler(inputCols=secrets.FEATURES, outputCol="v").transform(found.where(held))
    n = {(r.label, r.prediction): r["count"] for r in model.transform(test).groupBy("label", "prediction").count().collect()}
    tp, fp, fn = n.get((1.0, 1.0), 0), n.get((0.0, 1.0), 0), n.get((1.0, 0.0), 0)
    assert tp + fn > 400 and tp / (tp + fp) > 0.95 and tp / (tp + fn) > 0.95
    rule = {(r.label, r.rule_label): r["count"] for r in test.groupBy("label", "rule_label").count().collect()}
    assert rule.get((1.0, None), 0) + rule.get((1.0, 0.0), 0) > 0.2 * (tp + fn)  # what the rule alone would miss


def test_scan_of_repeated_rows_and_clashing_columns(spark):
    from tamis.llm import secrets

    rows = [(1, "token = 9f8a7b6c5d4e3f2a1b0c9d8e7f6a5b4c3d2e1f0a", "x", 1, "a"), (1, "token = 9f8a7b6c5d4e3f2a1b0c9d8e7f6a5b4c3d2e1f0a", "x", 1, "a"), (None, "path /usr/report/storage/v2/index", None, 2, "b"), (2, "word " * 60_000 + "token=9f8a7b6c5d4e3f2a1b0c9d8e7f6a5b4c3d2e1f0a", None, 3, "c")]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id bigint, text string, source string, label int, word string")).collect()
    assert sorted((r.doc_id or -1, r.is_secret) for r in got if r.length == 40) == [(1, True), (1, True), (2, True)] and not any(r.is_secret for r in got if r.doc_id is None)


def test_license_base_equals_brute_force(spark, sf):
    from tamis.llm import licenses

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(-1, None), (-2, ""), (-3, "CC BY"), (-3, "CC BY"), (None, "xcc by, cc  by\tCC-BY general public license; All Rights\nreserved"), (-4, "word " * 60_000 + "all rights reserved"), (-5, "cc K by Kİ cc by")]
    got = licenses.scan(spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id bigint, text string, w string, n_words int"))
    got = sorted((tuple(r)[:6] for r in got.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()), key=repr)
    want = []
    for d, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        want.append((d, len(words), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at}))))
    assert got == sorted(want, key=repr) and licenses.scan(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
