"""The n-gram join against brute force, with blocks so small that every path runs."""

import random
import re

import numpy as np

from tamis.llm import ngram_join

SCHEMA = "doc_id bigint, text string, component_id string, key int"


def shingles(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "")) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """(n_shingles, component number) of each row; component_id is the smallest id of the component."""
    s = [shingles(t) for _, t in rows]
    root = list(range(len(s)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]):
                root[find(i)] = find(j)
    return [len(x) for x in s], [find(i) for i in range(len(s))]


def corpus(seed=5):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(900)]
    make = lambda n: [rng.choice(words) for _ in range(n)]

    def edited(w, edits):
        w = list(w)
        for _ in range(edits):
            k = rng.randrange(len(w))
            kind = rng.randrange(3)
            w[k : k + 1] = [] if kind == 0 and len(w) > 1 else [rng.choice(words)] if kind == 1 else [w[k], rng.choice(words)]
        return w

    texts = []
    for n in (1, 2, 4, 5, 6, 7, 8, 9, 10, 12, 16, 25, 40, 70, 120, 300):  # near copies around the limit, of all sizes
        base = make(n)
        texts += [base, *(edited(base, rng.randint(0, max(1, n // 25))) for _ in range(9))]
    walk = make(150)  # a chain: neighbours link, ends do not
    for _ in range(30):
        walk = edited(walk, 3)
        texts.append(walk)
    passage = make(60)  # a passage that most of some texts consist of, without a link
    texts += [make(20) + passage + make(20) for _ in range(40)]
    texts = [" ".join(t) for t in texts] + [None, "", " \t\n", "one", "ONE", "word " * 700]
    rng.shuffle(texts)
    return texts


def test_groups_equal_brute_force(spark, monkeypatch):
    for name, value in (("LIST_BLOCK", 4), ("BLOCK", 3), ("SLOT", 40), ("TEXT_SLOT", 30)):
        monkeypatch.setattr(ngram_join, name, value)
    rng = random.Random(8)
    # some ids are null, some stand on several texts
    rows = [(None if rng.random() < 0.15 else k if rng.random() < 0.9 else k // 2, t) for k, t in enumerate(corpus())]
    rows += rows[:5]
    sizes, comp = brute(rows)
    least = {}
    for (i, _), c in zip(rows, comp):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = sorted((repr(i), n, repr(least.get(c, i))) for (i, _), n, c in zip(rows, sizes, comp))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA).repartition(5)
    got = sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in ngram_join.near_groups(df).collect())
    assert got == want
    kept = ngram_join.one_of_each(df).collect()
    assert [f for f in kept[0].__fields__] == ["doc_id", "text", "component_id", "key"]
    number = {}
    for (i, t), n, c in zip(rows, sizes, comp):
        number.setdefault((i, t), set()).add(c if n else ("none", i, t))
    seen = [c for r in kept for c in number[(r.doc_id, r.text)] if not isinstance(c, tuple)]
    assert sorted(seen) == sorted({c for c, n in zip(comp, sizes) if n})  # one of each component
    assert sum(1 for r in kept if not shingles(r.text)) == sum(1 for n in sizes if not n)  # all word-less rows


def test_linking_sets_share_a_signature():
    rng = np.random.default_rng(3)
    for n in [*range(2, 60), 100, 333, 1000, 4000]:
        for _ in range(12):
            x = rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)
            m = int(rng.integers(n, n * 4 // 3 + 1))
            least = -(-3 * (n + m) // 7)
            if least > n:
                continue
            y = np.r_[x[:least], rng.integers(0, 1 << 63, m - least).astype(np.uint64) * np.uint64(2)]
            assert ngram_join.linked(np.sort(x), np.sort(y))
            sig, of = ngram_join.signatures([np.sort(x), np.sort(y)])
            assert set(sig[of == 0].tolist()) & set(sig[of == 1].tolist()), (n, m)


def test_no_words_and_no_rows(spark):
    assert ngram_join.near_groups(spark.createDataFrame([], SCHEMA)).collect() == []
    only = spark.createDataFrame([(7, None, "x", 1), (None, "", "y", 2)], SCHEMA)
    assert sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in ngram_join.near_groups(only).collect()) == [("7", 0, "7"), ("None", 0, "None")]
    assert ngram_join.one_of_each(only).count() == 2
