"""Fingerprints of large files as a tree of block hashes, read in ranges by many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Version of the fingerprint: the tree's shape is part of it.
VERSION = "tree-1"
BLOCK_BYTES, FAN_OUT = 1 << 20, 1024


def placed(rows: DataFrame, size: Column, by_file: bool = True) -> DataFrame:
    """rows of a file scan with file, at (sum of size over the rows of the file before) and row (their number), or over all files
    in order of their names: rows are summed by input range first, so a task orders one range. rows must come straight from the scan."""
    r = rows.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_from")).withColumns({"_id": F.monotonically_increasing_id(), "_size": size})
    ranges = r.groupBy("file", "_from").agg(F.sum("_size").alias("_bytes"), F.count("*").alias("_rows"))
    before = W.partitionBy(*(["file"] if by_file else [])).orderBy("file", "_from").rowsBetween(W.unboundedPreceding, -1)  # a row a range
    ranges = ranges.select("file", "_from", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_before{c}") for c in ("_bytes", "_rows")])
    inside = W.partitionBy("file", "_from").orderBy("_id").rowsBetween(W.unboundedPreceding, -1)
    r = r.withColumns({"_in": F.coalesce(F.sum("_size").over(inside), F.lit(0)), "_nth": F.coalesce(F.count("*").over(inside), F.lit(0))})
    r = r.join(ranges, ["file", "_from"])
    return r.withColumns({"at": F.col("_in") + F.col("_before_bytes"), "row": F.col("_nth") + F.col("_before_rows")}).drop("_from", "_id", "_size", "_in", "_nth", "_before_bytes", "_before_rows")


def file_fingerprints(spark: SparkSession, path: str, block: int = BLOCK_BYTES) -> DataFrame:
    """file, bytes, blocks, fingerprint for each file under path: leaves are SHA-256 over the lines that begin in one block of the file,
    inner nodes over up to FAN_OUT nodes below, up to one root; the root is hashed with the version, the block size and the
    file's bytes. Lines are taken as bytes, so any content counts; a file's fingerprint does not depend on how Spark splits it.
    A task holds the lines of a block, and one line at least: this is for files with line ends. Empty files have no row."""
    sizes = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), F.col("length").alias("bytes"))
    line = F.col("value").cast("binary")
    lines = placed(spark.read.option("lineSep", "\n").text(path), F.length(line).cast("bigint") + 1)
    joined = lambda of, order: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(of).alias("h")))), lambda s: s["h"]), "")
    node = F.floor(F.col("at") / block)
    leaf = F.concat(F.min("row").cast("string"), F.lit(":"), joined("h", "row"))
    level = lines.select("file", node.alias("node"), "row", F.concat(F.hex(line), F.lit("|")).alias("h")).groupBy("file", "node").agg(F.sha2(leaf, 256).alias("h"))
    blocks = level.groupBy("file").agg(F.count("*").alias("blocks"))
    most = sizes.agg(F.max("bytes")).first()[0] or 0
    reach = block
    while reach <= most:
        reach *= FAN_OUT
        level = level.groupBy("file", F.floor(F.col("node") / FAN_OUT).alias("node")).agg(F.sha2(joined("h", "node"), 256).alias("h"))
    root = level.groupBy("file").agg(F.sha2(joined("h", "node"), 256).alias("h")).join(blocks, "file")
    name = F.concat_ws(":", F.lit(VERSION), F.lit(block).cast("string"), F.col("bytes").cast("string"), "h")
    return root.join(sizes, "file").select("file", "bytes", "blocks", F.substring(F.sha2(name, 256), 1, 16).alias("fingerprint"))
