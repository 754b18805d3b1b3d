"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree over blocks of documents."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NOT_SPACE, partitions_for, stored, table, text_or_empty

WEIGHTS = (3.0, 1.0, 2.0)
BUDGET = 1.5
MOST_EPOCHS = 2.0
#: Documents of a block on average, and the fan-out of the search for the block in which a source's share ends.
BLOCK_DOCS = 16
FAN = 1024
#: Words of a shard on average, fewest shards, and rows of an output partition on average.
SHARD_WORDS = 50_000_000
LEAST_SHARDS = 8
PARTITION_ROWS = 20_000


def word_count(column: str = "text"):
    return F.regexp_count(text_or_empty(column), F.lit(NOT_SPACE)).cast("bigint")


def targets(sizes: list[int], weights=WEIGHTS, budget: float = BUDGET, most: float = MOST_EPOCHS) -> list[float]:
    """Words to take of each source: weights repeat over the sources, together budget times all words; a source stops
    at most times its own words and what it leaves goes to the others by weight, until none is above."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    left, out, open_ = budget * sum(sizes), [0.0] * len(sizes), list(range(len(sizes)))
    while open_:
        share = left / sum(w[i] for i in open_)
        full = [i for i in open_ if w[i] * share > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = w[i] * share
            break
        for i in full:
            out[i] = most * sizes[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


class SplittingTree:
    """Quotas of blocks of each source, split among shards by multivariate-hypergeometric draws.

    A node splits its blocks between its two halves of shards by one draw whose generator is seeded by (seed, node), so
    every task that walks the tree makes the same draws, and the leaves partition the quotas exactly. Nodes are kept.
    """

    def __init__(self, quota: np.ndarray, shards: int, seed: int) -> None:
        self.shards, self.seed, self.nodes = shards, seed, {(0, shards): (np.zeros(len(quota), np.int64), quota.astype(np.int64))}

    def halves(self, low: int, high: int) -> tuple[int, np.ndarray]:
        """Where the node's shards part, and at which draw of each source."""
        mid, (first, q) = (low + high) // 2, self.nodes[(low, high)]
        if (low, mid) not in self.nodes:
            total = int(q.sum())
            rng = np.random.Generator(np.random.PCG64([self.seed, low, high]))
            left = rng.multivariate_hypergeometric(q, total * (mid - low) // (high - low), method="marginals") if total else q * 0
            self.nodes[(low, mid)], self.nodes[(mid, high)] = (first, left), (first + left, q - left)
        return mid, self.nodes[(mid, high)][0]

    def quota(self, shard: int) -> tuple[np.ndarray, np.ndarray]:
        """(first draw, draws) of each source for one shard."""
        low, high = 0, self.shards
        while high - low > 1:
            mid, _ = self.halves(low, high)
            low, high = (low, mid) if shard < mid else (mid, high)
        return self.nodes[(low, high)]

    def shard_of(self, source: np.ndarray, draw: np.ndarray) -> np.ndarray:
        """The shard of each draw of each source, all together level by level."""
        out = np.zeros(len(draw), np.int64)
        open_ = [(0, self.shards, np.arange(len(draw)))]
        while open_:
            low, high, rows = open_.pop()
            if high - low == 1 or not len(rows):
                out[rows] = low
                continue
            mid, first = self.halves(low, high)
            right = draw[rows] >= first[source[rows]]
            open_ += [(low, mid, rows[~right]), (mid, high, rows[right])]
        return out


def source_stats(sized: DataFrame) -> list[tuple]:
    """One tuple a source, in code-point order with null last: (source, number, words, target, whole epochs, words of
    the last epoch, blocks, documents). Sources are configuration, so their table (one row each) is taken to the driver."""
    rows = sized.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("docs")).collect()
    rows.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8", "surrogatepass")))
    stats = []
    for k, (r, t) in enumerate(zip(rows, targets([r["n"] for r in rows]))):
        whole = int(t // r["n"]) if r["n"] else 0
        extra = 0 if whole >= MOST_EPOCHS else round(t - whole * r["n"])
        stats.append((r["source"], k, int(r["n"]), float(t), whole, int(extra), max(1, math.ceil(r["docs"] / BLOCK_DOCS)), r["docs"]))
    return stats


def placed(rows: DataFrame, info: DataFrame, seed: int) -> DataFrame:
    """rows(source, row_key, ...) with their source's numbers and the place of their block in the source's permuted order."""
    b = F.col("blocks")
    # a multiplier coprime to the number of blocks makes block -> place a permutation
    coprime = F.when(b <= 2, 1).when(b % 2 == 1, b - 2).when(b % 4 == 0, F.expr("blocks div 2 + 1")).otherwise(F.expr("blocks div 2 + 2"))
    block = F.pmod(F.xxhash64("row_key", F.lit(seed)), b)
    out = rows.join(F.broadcast(info.withColumnRenamed("source", "_source")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    return out.withColumn("place", F.pmod(block * coprime + seed, b))


def find_cuts(sized: DataFrame, stats: list[tuple]) -> list[tuple]:
    """For each source the block in which its extra words end: (source_no, whole blocks before it, words of it to take).

    A radix search over the permuted block numbers: each level sums the words of FAN ranges inside the range found so
    far, so a level gives at most sources x FAN rows, whatever the input.
    """
    low = {s[1]: 0 for s in stats}
    width = {s[1]: FAN ** max(1, math.ceil(math.log(max(s[6], 2), FAN) - 1e-9)) for s in stats}
    left = {s[1]: s[5] for s in stats}
    spark = sized.sparkSession
    while any(w > 1 for w in width.values()):
        step = {k: max(1, w // FAN) for k, w in width.items()}
        at = spark.createDataFrame([(k, low[k], low[k] + width[k], step[k]) for k in low], "source_no int, lo bigint, hi bigint, step bigint")
        part = sized.join(F.broadcast(at), "source_no").where("place >= lo AND place < hi").groupBy("source_no", F.expr("(place - lo) div step").alias("r")).agg(F.sum("size").alias("n"))
        found: dict[int, list] = {}
        for row in part.collect():
            found.setdefault(row["source_no"], []).append((row["r"], row["n"]))
        for k in low:
            r = 0
            for r, n in sorted(found.get(k, [])):
                if n >= left[k]:
                    break
                left[k] -= n
            low[k], width[k] = low[k] + r * step[k], step[k]
    return [(s[1], low[s[1]], left[s[1]]) for s in stats]


def mix(docs: DataFrame, sized: DataFrame | None = None, seed: int = 11, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, list[tuple]]:
    """The drawn rows, and source_stats(): row_ (a struct of all columns of docs), text (if docs has it), size, source_size,
    target, epoch, words, shard, place_in_shard.

    A source's documents form blocks in a hashed order, an affine permutation orders the blocks, and its target takes
    whole epochs plus a prefix of that order; in the block where the prefix ends, documents are taken one by one and the
    last is cut, so that targets are met to the word. The splitting tree partitions the drawn blocks over the shards;
    inside a shard rows are ordered by a hash. words <= size; a document is drawn at most twice.
    Null texts have size 0; a null source is a source of its own; equal rows are drawn alike (a cut that falls on equal
    rows is shared among them); an empty table gives no rows. Order comes from hashes of doc_id and text only, so reruns
    agree. Columns of docs may have any names. sized: sizes_of(docs), where the caller has it (docs may then be the same).
    """
    spark = docs.sparkSession
    own = docs is sized
    sized = sizes_of(docs) if sized is None else sized
    stats = source_stats(sized)
    info = spark.createDataFrame([s[:7] for s in stats], "source string, source_no int, source_size bigint, target double, epochs int, extra bigint, blocks bigint")
    where = placed(sized.select("source", "row_key", "size"), info, seed)
    cuts = find_cuts(where, stats)
    info = info.join(F.broadcast(spark.createDataFrame(cuts, "source_no int, cut bigint, cut_words bigint")), "source_no")
    # the block of a source in which its share ends: about BLOCK_DOCS documents a source
    order = W.partitionBy("source_no").orderBy("hash", "row_key")
    edge = placed(sized.select("source", "row_key", "size"), info, seed).where("place = cut").groupBy("source_no", "row_key", "cut_words").agg(F.first("size").alias("one"), F.count("*").alias("copies"))
    edge = edge.withColumn("hash", F.xxhash64("row_key", F.lit(seed + 1))).withColumn("before", F.coalesce(F.sum(F.col("one") * F.col("copies")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    edge = edge.select(F.col("row_key").alias("_key"), F.greatest(F.lit(0), F.least(F.col("one"), F.expr("(cut_words - before) div copies"))).cast("bigint").alias("_part"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_")
    if own:
        rows = sized.select(row, "source", "row_key", "size")
    else:
        rows = docs.select(row, F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"), row_key().alias("row_key"), word_count().alias("size"))
    drawn = placed(rows, info, seed).join(F.broadcast(edge), (F.col("row_key") == F.col("_key")) & (F.col("place") == F.col("cut")), "left")
    part = F.when(F.col("place") < F.col("cut"), F.col("size")).otherwise(F.coalesce(F.col("_part"), F.lit(0)))
    draws = F.filter(
        F.array(*[F.struct(F.lit(e).alias("epoch"), F.when(F.col("epochs") > e, F.col("size")).when(F.col("epochs") == e, part).otherwise(0).alias("words"), ((F.col("epochs") > e) | ((F.col("epochs") == e) & ((F.col("place") < F.col("cut")) | (F.col("_part") > 0)))).alias("is_drawn")) for e in (0, 1)]),
        lambda d: F.coalesce(d["is_drawn"], F.lit(False)),
    )
    rows = drawn.withColumn("_d", F.explode(draws)).withColumn("epoch", F.col("_d.epoch")).withColumn("words", F.col("_d.words"))
    quota = np.array([s[4] * s[6] + c[1] + (1 if c[2] > 0 else 0) for s, c in zip(stats, cuts)] or [0], np.int64)
    shards = max(LEAST_SHARDS, math.ceil(sum(s[3] for s in stats) / shard_words))
    trees: list[SplittingTree] = []

    @F.pandas_udf("bigint")
    def shard_of(source: pd.Series, draw: pd.Series) -> pd.Series:
        if not trees:
            trees.append(SplittingTree(quota, shards, seed))
        return pd.Series(trees[0].shard_of(source.to_numpy(np.int64), draw.to_numpy(np.int64)))

    rows = rows.withColumn("shard", shard_of("source_no", F.col("epoch") * F.col("blocks") + F.col("place")))
    rows = rows.withColumn("place_in_shard", F.xxhash64("row_key", "epoch", "shard", F.lit(seed)))
    return rows.select("row_", *([] if own else ["text"]), "size", "source_size", "target", "epoch", "words", "shard", "place_in_shard"), stats


def row_key():
    return F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))


def sizes_of(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, row_key and a row number, stored: what planning a mix reads instead of the texts."""
    return stored(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"), row_key().alias("row_key"), F.monotonically_increasing_id().alias("row_no")), "sizes")


def taken_words(docs: DataFrame, seed: int = 11, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row for each row of docs: doc_id, size, source_size, target, taken (words drawn, repeats counted), draws, shard."""
    sized = sizes_of(docs)
    drawn, stats = mix(sized, sized, seed, shard_words)
    drawn = drawn.select("row_.row_no", "words", "shard").groupBy("row_no").agg(F.sum("words").alias("taken"), F.count("*").alias("draws"), F.min("shard").alias("first_shard"))
    info = docs.sparkSession.createDataFrame([(s[0], s[2], s[3]) for s in stats], "_source string, source_size bigint, target double")
    out = sized.join(F.broadcast(info), F.col("source").eqNullSafe(F.col("_source"))).join(drawn, "row_no", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce("draws", F.lit(0)).alias("draws"), "first_shard")


def mixed_documents(docs: DataFrame, seed: int = 11, shard_words: int = SHARD_WORDS, with_shard: bool = False) -> DataFrame:
    """The mix as documents, with docs' columns: a row for each draw, texts that are cut end after their last taken word
    (white space runs of a cut text become one space; n_chars follows the text). The rows are brought together by shard:
    shards lie in order, one after the other, and inside a shard rows are in hashed order. with_shard adds _shard."""
    drawn, stats = mix(docs, None, seed, shard_words)
    cut = F.array_join(F.slice(F.regexp_extract_all(text_or_empty(), F.lit(NOT_SPACE), F.lit(0)), F.lit(1), F.col("words").cast("int")), " ")
    whole = F.col("words") >= F.col("size")
    columns = []
    for c in docs.columns:
        value = F.col("row_").getField(c)
        if c == "text":
            value = F.when(whole, value.cast("string")).otherwise(cut)
        elif c == "n_chars":
            value = F.when(whole, value).otherwise(F.length(cut)).cast(docs.schema[c].dataType)
        columns.append(value.alias(c))
    out = drawn.select(*columns, F.col("shard").alias("_shard"), F.col("place_in_shard").alias("_place"))
    n = partitions_for(docs.sparkSession, 2 * sum(s[7] for s in stats), PARTITION_ROWS)
    out = out.repartitionByRange(n, "_shard", "_place").sortWithinPartitions("_shard", "_place")
    return out.select(*docs.columns, *(["_shard"] if with_shard else []))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(table(spark, sf_dir, "documents"))


ORACLE = {}
