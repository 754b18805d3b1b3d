"""Hard-negative mining with segment summaries: means and deviations of vector segments bound scores before exact ones are taken."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import dropped, partitions_for, stored, table

#: Segments of a vector at each level of the summary, coarse to fine (fewer where a vector is shorter).
LEVELS = (1, 4, 16)
#: Rows of a stored block, anchors that meet a block at once.
BLOCK_ROWS = 4_096
ANCHORS = 128
#: Share of pairs that may be left for them to be scored one by one instead of as a product of what is left.
SPARSE = 0.05
#: Summaries are stored in single precision: bounds give way by this share of the vectors' lengths.
ROUNDING = 1e-6
POSITIVES, NEGATIVES = 5, 5
#: A negative's score lies between LOW / 100 of the positive's and the positive's.
LOW = 80
_LONG = (-(2.0**63), 2.0**63)


def cuts(d: int, segments: int) -> np.ndarray:
    """Where the segments of a vector of d components begin; none is empty."""
    return np.unique(np.arange(segments) * d // segments)


def summary(q: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each segment of each row, both times the root of its length: the product of two rows' means is
    then the part of the inner product that means give, and the product of their deviations the most that the rest can add
    or take away (Cauchy-Schwarz on what is left without the means)."""
    at = cuts(q.shape[1], segments)
    length = np.diff([*at, q.shape[1]])
    total = np.add.reduceat(q, at, axis=1)
    square = np.add.reduceat(q * q, at, axis=1)
    return total / np.sqrt(length), np.sqrt(np.maximum(square - total * total / length, 0.0))


class Side:
    """Vectors as whole numbers, the summaries of each level, and their lengths."""

    def __init__(self, q: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]] | None = None) -> None:
        self.q = q
        self.levels = levels if levels is not None else [summary(q, s) for s in LEVELS]
        mean, deviation = self.levels[0]
        self.length = np.sqrt((mean.astype(np.float64) ** 2 + deviation.astype(np.float64) ** 2).sum(1))

    def take(self, rows: np.ndarray) -> Side:
        return Side(self.q[rows], [(m[rows], s[rows]) for m, s in self.levels])


def scored(a: Side, b: Side, allowed: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, exact score) of the allowed pairs that no level rules out. keep(low, high, left, i) gives the pairs of rows i of a
    that may still matter, from bounds of their scores. Rows without a pair left are taken out before each finer level."""
    i, j, left = np.arange(len(a.q)), np.arange(len(b.q)), allowed
    for (mean_a, dev_a), (mean_b, dev_b) in zip(a.levels, b.levels):
        some_i, some_j = left.any(1), left.any(0)
        i, j, left = i[some_i], j[some_j], left[np.ix_(some_i, some_j)]
        if not left.size:
            break
        mid, off = mean_a[i] @ mean_b[j].T, dev_a[i] @ dev_b[j].T
        off = off + ROUNDING * (a.length[i][:, None] * b.length[j][None, :] + 1)
        left = left & keep(np.clip(mid - off, *_LONG), np.clip(mid + off, *_LONG), left, i)
    x, y = np.nonzero(left)
    if len(x) < SPARSE * left.size or not left.size:
        return i[x], j[y], exact(a.q[i[x]], b.q[j[y]], True)
    return i[x], j[y], exact(a.q[i], b.q[j], False)[x, y]


def exact(a: np.ndarray, b: np.ndarray, paired: bool) -> np.ndarray:
    """Inner products as whole numbers, of row pairs or of all rows of a with all of b: in double precision where no sum can
    reach 2**53, else in Python's numbers, cut to 64 bits."""
    if a.shape[1] * max(np.abs(a).max(initial=0), 1) * max(np.abs(b).max(initial=0), 1) < 2**53:
        return (np.einsum("ij,ij->i", a, b) if paired else a @ b.T).astype(np.int64)
    whole = lambda x: [[int(v) for v in row] for row in x]
    one = lambda x, y: max(-(2**63), min(2**63 - 1, sum(p * q for p, q in zip(x, y))))
    if paired:
        return np.array([one(x, y) for x, y in zip(whole(a), whole(b))], np.int64)
    right = whole(b)
    return np.array([[one(x, y) for y in right] for x in whole(a)], np.int64).reshape(len(a), len(b))


def _by_anchor(i: np.ndarray, j: np.ndarray, score: np.ndarray, ids: np.ndarray):
    """(anchor, rows, scores) for each anchor that has any, highest score first, ties by id."""
    order = np.lexsort((ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    at = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else []
    for a, b in zip(at, [*at[1:], len(i)]):
        yield int(i[a]), j[a:b], score[a:b]


def positives_in(a: Side, anchors: pd.DataFrame, b: Side, rows: pd.DataFrame, first: int) -> list[tuple]:
    """The first rows of an anchor's label in this block. A pair stays while its upper bound reaches the lower bounds of the
    anchor's `first` best so far."""
    out = []
    for label in sorted(set(anchors["label"]) & set(rows["label"])):
        mine, theirs = np.flatnonzero(anchors["label"] == label), np.flatnonzero(rows["label"] == label)
        ids, keys = rows["id"].to_numpy()[theirs], rows["key"].to_numpy()[theirs]
        names, own = anchors["id"].to_numpy()[mine], anchors["key"].to_numpy()[mine]
        other = ~((names[:, None] == ids[None, :]) & (own[:, None] == keys[None, :]))

        def keep(low, high, left, i):
            if left.shape[1] <= first:
                return True
            return high >= -np.partition(np.where(left, -low, np.inf), first - 1, axis=1)[:, first - 1 : first]

        for k, j, score in _by_anchor(*scored(a.take(mine), b.take(theirs), other, keep), ids):
            out += [(names[k], own[k], ids[r], keys[r], s) for r, s in zip(j[:first].tolist(), score[:first].tolist())]
    return out


def negatives_in(a: Side, anchors: pd.DataFrame, b: Side, rows: pd.DataFrame, first: int, low_percent: int) -> list[tuple]:
    """For each anchor and positive score the first rows of other labels in the window below it. A pair stays while its bounds
    reach the anchor's windows."""
    labels = anchors["label"].to_numpy()[:, None] != rows["label"].to_numpy()[None, :]
    goals = [np.unique(np.asarray(x, np.int64))[::-1] for x in anchors["goals"]]
    floor = [[-(-low_percent * int(g) // 100) for g in x] for x in goals]
    least, most = np.array([x[-1] for x in floor], float), np.array([x[0] for x in goals], float)
    ids, keys = rows["id"].to_numpy(), rows["key"].to_numpy()
    out = []
    keep = lambda low, high, left, i: (high >= least[i][:, None]) & (low <= most[i][:, None])
    for k, j, score in _by_anchor(*scored(a, b, labels, keep), ids):
        for goal, bottom in zip(goals[k].tolist(), floor[k]):
            at = int(np.searchsorted(-score, -goal))
            take = slice(at, at + first)
            out += [(anchors["id"].iloc[k], anchors["key"].iloc[k], goal, ids[r], keys[r], s) for r, s in zip(j[take].tolist(), score[take].tolist()) if s >= bottom]
    return out


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of at most `size` rows of one d (dimension) and part, numbered by no: ids, keys, labels, goals, and as bytes the
    vectors, as whole numbers of 16 bits where they fit, and the summaries of each level."""

    def block(part, d, at, no):
        q = np.floor(256 * np.array([np.asarray(v, np.float64) for v in part["v"]]).reshape(len(part), -1))
        kind = "<i2" if np.abs(q).max(initial=0) < 2**15 else "<f8"
        levels = [z.astype("<f4" if kind == "<i2" else "<f8").tobytes() for s in LEVELS for z in summary(q, s)]
        goals = [np.asarray(g, np.int64).tolist() for g in part["goals"]] if "goals" in part else None
        return pd.DataFrame({"d": [d], "part": [at], "no": [no], "ids": [part["vec_id"].tolist()], "keys": [part["key"].tolist()], "labels": [part["label"].tolist()], "goals": [goals], "kind": [kind], "q": [q.astype(kind).tobytes()], "levels": [levels]})

    def pack(batches):
        held, name, no = [], None, 0
        for pdf in batches:
            names = list(zip(pdf["d"].tolist(), pdf["part"].tolist()))
            at = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1]), len(names)]
            for a, b in zip(at, at[1:]):
                if a == b:
                    continue
                if name != names[a]:
                    if held:
                        yield block(pd.concat(held), *name, no)
                    held, name, no = [], names[a], 0
                while a < b:
                    held.append(pdf.iloc[a : min(b, a + size - sum(map(len, held)))])
                    a += len(held[-1])
                    if sum(map(len, held)) == size:
                        yield block(pd.concat(held), *name, no)
                        held, no = [], no + 1
        if held:
            yield block(pd.concat(held), *name, no)

    ordered = rows.repartition("d", "part").sortWithinPartitions("d", "part", "vec_id", "key")
    return ordered.mapInPandas(pack, "d bigint, part bigint, no bigint, ids array<bigint>, keys array<bigint>, labels array<string>, goals array<array<bigint>>, kind string, q binary, levels array<binary>")


def _opened(row) -> tuple[Side, pd.DataFrame]:
    n = len(row["ids"])
    levels = [np.frombuffer(z, "<f4" if row["kind"] == "<i2" else "<f8").reshape(n, -1).astype(np.float64) for z in row["levels"]]
    frame = pd.DataFrame({"id": np.asarray(row["ids"], np.int64), "key": np.asarray(row["keys"], np.int64), "label": np.asarray(row["labels"], object)})
    if row["goals"] is not None:
        frame["goals"] = list(row["goals"])
    return Side(np.frombuffer(row["q"], row["kind"]).reshape(n, -1).astype(np.float64), list(zip(levels[::2], levels[1::2]))), frame


def _met(blocks: DataFrame, anchors: DataFrame, compare, names: list[str]) -> DataFrame:
    """compare(anchors, block) for each chunk of anchors and each block of their dimension. Blocks are shipped once; chunks,
    a hundredth of the rows or so, go to each block and pass it one after another, so a task holds one block and a batch of chunks."""
    each = blocks.select(F.col("d").alias("_d"), "part", "no")
    chunks = anchors.withColumnsRenamed({"part": "_p", "no": "_n"}).join(each, F.col("d") == F.col("_d")).drop("_d", "_p", "_n")
    both = blocks.withColumn("chunk", F.lit(0)).unionByName(chunks.withColumn("chunk", F.lit(1)))

    def run(batches):
        block = None
        for pdf in batches:
            for row in pdf.to_dict("records"):
                if not row["chunk"]:
                    block = _opened(row)
                elif found := compare(*_opened(row), *block):
                    yield pd.DataFrame(found, columns=names)

    n = partitions_for(blocks.sparkSession, blocks.count(), 1)
    return both.repartition(n, "d", "part", "no").sortWithinPartitions("d", "part", "no", "chunk").mapInPandas(run, ", ".join(f"{c} bigint" for c in names))


def mined(vectors: DataFrame, anchor=None, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for vectors(vec_id, embedding, label).

    Components become floor(256 * x); scores are whole inner products of rows of one dimension. Rows with a null vec_id, label or
    vector, an empty vector, or a null, NaN or infinite component take no part. Rows alike in id, label and vector are one row; others that
    share an id are rows of their own (ties then go by a hash of the row). anchor: a condition on vec_id (by default divisible
    by 100). An anchor's positives are its first rows of the same label, its negatives for a positive the first rows of other
    labels that score between low / 100 of it and it; higher scores first, ties by smaller id. An anchor without positives, and
    a positive without negatives, give no rows; a negative positive score has an empty window. An empty table gives no rows.

    Every row is in a block of one hash part; blocks store the summaries of three levels. No task holds more than a block, a
    chunk of anchors and their pairs; each block's best are cut to the first few before the last ranking.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").alias("v"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND size(v) > 0").where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    rows = rows.withColumns({"key": F.xxhash64("vec_id", "label", "v"), "d": F.size("v").cast("bigint")}).dropDuplicates(["vec_id", "label", "key"])
    rows = stored(rows, "vectors")
    is_anchor = F.col("vec_id") % 100 == 0 if anchor is None else anchor
    count = rows.agg(F.count("*").alias("n"), F.count_if(is_anchor).alias("a")).first()
    part = lambda n, size: F.pmod(F.col("key"), F.lit(max(1, math.ceil(n / size))))
    best = lambda df, by, score, name: df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(score), name, f"{name}_key")))

    blocks = stored(_packed(rows.withColumn("part", part(count["n"], block_rows)), 2 * block_rows), "blocks")
    asked = rows.where(is_anchor).withColumn("part", part(count["a"], ANCHORS))
    first = stored(_packed(asked, ANCHORS), "anchors")
    names = ["anchor_id", "anchor_key", "positive_id", "positive_id_key", "positive_score"]
    liked = _met(blocks, first, lambda a, fa, b, fb: positives_in(a, fa, b, fb, positives), names)
    liked = stored(best(liked, ["anchor_id", "anchor_key"], "positive_score", "positive_id").where(F.col("rank") <= positives).drop("rank"), "positives")

    goals = liked.groupBy("anchor_id", "anchor_key").agg(F.collect_set("positive_score").alias("goals"))
    second = stored(_packed(asked.join(goals.withColumnsRenamed({"anchor_id": "vec_id", "anchor_key": "key"}), ["vec_id", "key"]), ANCHORS), "anchors-with-goals")
    names = ["anchor_id", "anchor_key", "positive_score", "negative_id", "negative_id_key", "negative_score"]
    near = _met(blocks, second, lambda a, fa, b, fb: negatives_in(a, fa, b, fb, negatives, low), names)
    near = stored(best(near, ["anchor_id", "anchor_key", "positive_score"], "negative_score", "negative_id").where(F.col("rank") <= negatives), "negatives")
    out = liked.join(near, ["anchor_id", "anchor_key", "positive_score"])
    out = stored(out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"), "mined")
    dropped(rows, blocks, first, liked, second, near)
    return out


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(e.select("vec_id", "embedding", shifted.alias("label")))


ORACLE = {
    "op11_hard_negatives": """WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
 WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, e.vec_id AS other, a.label = e.label AS same, CAST(list_dot_product(a.v, e.v) AS BIGINT) AS score FROM e AS a JOIN e ON a.vec_id <> e.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS INT) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) <= 5"""
}
