"""Near duplicates among embeddings: spherical k-means cells, blocked cosine products, one representative per group."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, join_groups, stored, table

COSINE = 0.98
#: Vectors that the cells are fitted on (smallest hashes), vectors of a cell on average, most cells, rows of a block.
SAMPLE = 20_000
CELL_ROWS = 1_000
MOST_CELLS = 2_048
BLOCK_ROWS = 2_048


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """k unit centres of the unit rows of x by cosine; empty cells keep their centre. Fixed seed."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        cell = (x @ centres.T).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, cell, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(size > 1e-12, total / np.maximum(size, 1e-12), centres)
    return centres


def unit(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def linkable(name: str = "embedding"):
    """Not null, not empty, all components finite, not all zero."""
    v = F.col(name)
    return v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False)) & F.exists(v, lambda x: x != 0)


def near_groups(vectors: DataFrame, cosine: float = COSINE, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each row of vectors(vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Rows are compared only with rows of the same label (not null) and the same dimension. Exact copies are counted first
    and stand as one vector with its number of rows. Cells come from spherical k-means on a bounded sample; every vector
    has a home cell and visits each cell whose border lies within the distance that the cosine allows, so no pair is
    missed: for unit x with home c, a vector within chord d of x can lie in cell c' only if (c - c').x <= d |c - c'|.
    A cell's rows form blocks of bounded size; a task multiplies two blocks and returns a count for each row and links of
    a spanning forest, never the pairs. Null, zero and non-finite vectors, and those without a label, have no links.
    Repeated rows count as copies of each other; a null vec_id has a null component. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    every = stored(vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v")), "vectors")
    total = every.count()
    alone = every.where(~(linkable("v") & F.col("label").isNotNull()))
    # -0.0 equals 0.0; one key for each distinct vector of a label
    keyed = every.where(linkable("v") & F.col("label").isNotNull()).withColumn("key", F.sha2(F.concat_ws("|", "label", F.transform("v", lambda x: (x + F.lit(0.0)).cast("string"))), 256))
    groups = stored(keyed.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("v").alias("v")), "distinct")
    n = groups.count()
    none = alone.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not n:
        return none
    # number the distinct vectors by their smallest id; ids may repeat over different vectors, so the key decides ties
    sample = groups.select("v", F.size("v").alias("d")).orderBy(F.xxhash64("key"), "key").limit(SAMPLE).toPandas()
    chord = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-9
    centres: dict[int, np.ndarray] = {}
    for d, part in sample.groupby("d"):
        x = unit(part["v"])
        centres[int(d)] = spherical_kmeans(x, int(min(MOST_CELLS, max(1, n * len(part) / len(sample) / cell_rows), len(x))))
    gaps = {d: np.linalg.norm(c[:, None, :] - c[None, :, :], axis=2) if len(c) <= 512 else None for d, c in centres.items()}

    def assign(batches):
        for pdf in batches:
            out = []
            for key, label, v in zip(pdf["key"], pdf["label"], pdf["v"]):
                c = centres.get(len(v))
                if c is None or len(c) == 1:
                    out.append((key, f"{len(v)}:0:{label}", True))
                    continue
                x = np.asarray(v, np.float64)
                x = x / np.linalg.norm(x)
                s = c @ x
                home = int(s.argmax())
                gap = gaps[len(v)][home] if gaps[len(v)] is not None else np.linalg.norm(c - c[home], axis=1)
                for k in np.flatnonzero(s[home] - s <= chord * gap + 1e-9):
                    out.append((key, f"{len(v)}:{k}:{label}", bool(k == home)))
            yield pd.DataFrame(out, columns=["key", "cell", "home"])

    cells = stored(groups.select("key", "label", "v").mapInPandas(assign, "key string, cell string, home boolean"), "cells")
    sizes = cells.groupBy("cell").agg(F.count("*").alias("rows"), F.count_if("home").alias("homes"))
    # blocks: homes of a cell on one side, all its rows on the other
    sizes = sizes.select("cell", F.ceil(F.col("homes") / block_rows).alias("hb"), F.ceil(F.col("rows") / block_rows).alias("qb"), "rows")
    placed = join_groups(cells, sizes, "cell", "rows", max(1, n)).where("hb > 0")
    own = F.pmod(F.xxhash64("key"), F.greatest("hb", F.lit(1)))
    ask = F.pmod(F.xxhash64("key", F.lit(9)), F.col("qb"))
    as_home = placed.where("home").select("key", "cell", own.alias("h"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("qb") - 1)).alias("q"), F.lit(True).alias("base"))
    as_query = placed.select("key", "cell", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("hb") - 1)).alias("h"), ask.alias("q"), F.lit(False).alias("base"))
    rows = as_home.unionByName(as_query).join(groups.select("key", "v", "copies"), "key")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        base, query = pdf[pdf["base"]], pdf[~pdf["base"]]
        if not len(base) or not len(query):
            return pd.DataFrame({"key": [], "links": [], "other": []})
        a, b = unit(query["v"]), unit(base["v"])
        keys, names, weight = query["key"].to_numpy(), base["key"].to_numpy(), base["copies"].to_numpy(np.int64)
        index = {k: i for i, k in enumerate(names)}
        links, first = np.zeros(len(a), np.int64), [None] * len(a)
        root = np.arange(len(b))

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for at in range(0, len(a), 256):
            near = a[at : at + 256] @ b.T >= cosine
            for r in np.flatnonzero(near.any(1)):
                hits = np.flatnonzero(near[r])
                k = at + r
                me = index.get(keys[k])
                links[k] = weight[hits].sum() - (weight[me] if me is not None and near[r, me] else 0)
                to = find(int(hits[0]))
                for h in hits[1:]:
                    root[find(int(h))] = to
                if me is not None:
                    root[find(me)] = to
                first[k] = names[hits[0]] if names[hits[0]] != keys[k] else (names[hits[1]] if len(hits) > 1 else None)
        forest = [(names[i], 0, names[find(i)]) for i in range(len(b)) if find(i) != i]
        return pd.DataFrame([*((k, n_, o) for k, n_, o in zip(keys, links, first) if n_), *forest], columns=["key", "links", "other"])

    found = stored(rows.groupBy("cell", "h", "q").applyInPandas(compare, "key string, links bigint, other string"), "links")
    counts = found.groupBy("key").agg(F.sum("links").alias("links"))
    linked = stored(groups.join(counts, "key", "left").select("key", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links")), "counted")
    edges = found.where("other IS NOT NULL AND key <> other").select("key", "other").distinct()
    comps = components(edges, "key", "other")
    # the smallest id of each component of keys
    named = linked.join(comps.withColumnRenamed("id", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    info = named.join(least, "component").select("key", "links", "copies", "component_id")
    out = join_groups(keyed.select("vec_id", "key"), info, "key", "copies", max(1, total))
    out = out.select("vec_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return out.unionByName(none)


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "embeddings"))


ORACLE = {}
