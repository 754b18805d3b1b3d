"""Helpers that the training-data operators share: stored tables, skew-safe joins, components, rolling hashes."""

from __future__ import annotations

import gc
import math
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: space, tab, newline, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir. Only where that is unset and the driver runs all tasks itself (tests) is one made here."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = found.get() if found.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        found = tempfile.mkdtemp(prefix="spark-tamis-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


#: Rows of the batches that go to Python while a table is stored: texts may be long, and several workers share an executor.
ARROW_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
ARROW_ROWS = 2_000
#: Tables that stored() wrote and dropped() has not removed.
scratch: list[DataFrame] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back. A lost executor costs a reread only."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tamis-{name}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(ARROW_BATCH)
    spark.conf.set(ARROW_BATCH, str(min(int(before), ARROW_ROWS) if int(before) > 0 else ARROW_ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(ARROW_BATCH, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._tamis_path = path
    scratch.append(out)
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove stored tables that no later read needs, and let Spark's cleaner drop the shuffle files of finished jobs."""
    for df in tables:
        path = getattr(df, "_tamis_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
            scratch[:] = [t for t in scratch if t is not df]
    tidy(tables[0].sparkSession if tables else None)


def tidy(spark: SparkSession | None) -> None:
    """Shuffle files live until the driver collects its garbage; ask for that between large steps."""
    gc.collect()
    if spark is not None:
        spark.sparkContext._jvm.System.gc()


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name.lower() in (c.lower() for c in df.columns):
        name = f"_{name}"
    return name


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key is hot when it holds over one HOT_SHARE-th of the rows, so at most HOT_SHARE keys are hot and their table can be broadcast.
HOT_SHARE = 2000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left join of rows with their groups (one row per key; size = rows of that key), safe when one key holds most rows.

    Keys with more than total / HOT_SHARE rows are at most HOT_SHARE many, whatever the data: they are broadcast. The
    rows of all other keys are joined by shuffle; the hot rows go through it under keys of their own, spread evenly.
    """
    hot_min = max(1, total // HOT_SHARE)
    others = [c for c in groups.columns if c != key]
    hot = groups.where(F.col(size) > hot_min).select(F.col(key).alias("_hk"), F.struct(*others).alias("_hot"))
    cold = groups.where(F.col(size) <= hot_min).select(F.col(key).alias("_ck"), F.struct(*others).alias("_cold"))
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left")
    kind = groups.schema[key].dataType.simpleString()
    if kind == "string":
        away = F.concat(F.lit("hot:"), F.uuid())
        out = out.withColumn("_jk", F.when(F.col("_hk").isNull(), F.col(key)).otherwise(away))
        out = out.join(cold, F.col("_jk") == F.col("_ck"), "left")
    else:
        spread = F.when(F.col("_hk").isNull(), F.lit(0)).otherwise(F.xxhash64(*[F.col(c) for c in rows.columns if c != key]) % 4096)
        out = out.withColumn("_jk", F.when(F.col("_hk").isNull(), F.col(key))).withColumn("_js", spread)
        cold = cold.withColumn("_cs", F.lit(0).cast("bigint"))
        out = out.join(cold, (F.col("_js") == F.col("_cs")) & (F.col("_jk") == F.col("_ck")), "left")
    return out.select(*rows.columns, *[F.coalesce(F.col(f"_hot.{c}"), F.col(f"_cold.{c}")).alias(c) for c in others])


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list: (id, component), component = smallest id reachable, only ids with an edge.

    Large-star and small-star rounds (Kiveris et al. 2014): every id points at the smallest neighbour until nothing
    moves. Each round is a grouped minimum (combined before its shuffle) and an equi-join; lineage is cut by a stored table.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = stored(e, "edges")
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        new = stored(small, "edges")
        now = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        dropped(e)
        e = new
        if now == mark:
            break
        mark = now
    ids = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ids.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


# -- rolling hashes over bytes, 64 bit, in numpy ------------------------------------------------------------------------

_MUL = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_MUL), -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that equal values stay equal and others spread over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: One 64-bit value for each byte.
BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the multiplier and of its inverse modulo 2**64."""
    if len(_powers[0]) <= n:
        size = 1 << max(12, int(n).bit_length())
        for k, base in enumerate((_MUL, _INV)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][: n + 1], _powers[1][: n + 1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i], scaled by the inverse power i, the hash of data[i:j] (see span_hash)."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Equal byte spans of equal length have equal hashes wherever they stand."""
    _, down = powers(len(prefix))
    return mix64((prefix[end] - prefix[start]) * down[start])


def bytes_of(value) -> bytes:
    return b"" if value is None else value if isinstance(value, bytes) else str(value).encode("utf-8", "surrogatepass")


def partitions_for(spark: SparkSession, n_rows: float, per_partition: float) -> int:
    """Partitions so that each holds about per_partition rows, at least the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_rows / per_partition), 1)
