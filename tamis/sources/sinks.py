"""Where results go: run documents, plot tables, tables cached by fingerprint, prediction caches replaced whole."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions import replies


def _system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def run_documents(rows: DataFrame, path: str, suffix: str = "") -> str:
    """JSON documents of a run (nested columns stay nested) under path + suffix; gives the path."""
    rows.write.mode("overwrite").json(path + suffix)
    return path + suffix


def plot_table(rows: DataFrame, path: str) -> None:
    """A tidy CSV with a header for each part."""
    rows.write.mode("overwrite").csv(path, header=True)


def cached(spark: SparkSession, folder: str, settings: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """The table made under these settings: read if it was written whole before, else made and written.

    Its folder carries the digest of the settings, so a changed input or parameter makes a table of its own; a table whose
    writing was cut off has no _SUCCESS file and is made again."""
    path = f"{folder}/{replies.identity(settings)}"
    fs, done = _system(spark, f"{path}/_SUCCESS")
    if not fs.exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def recovered(spark: SparkSession, path: str) -> None:
    """Put right what a writer that died inside replaced() has left: if the table is gone, the whole new one goes in its place (its
    _SUCCESS file is there), else the old one goes back; what lies beside a table that is there is removed."""
    fs, here = _system(spark, path)
    found = lambda kind: sorted((s.getPath() for s in fs.globStatus(_system(spark, f"{path}.{kind}-*")[1]) or []), key=lambda p: p.getName())
    new, old = found("new"), found("old")
    if not fs.exists(here):
        whole = [p for p in new if fs.exists(_system(spark, f"{p.toString()}/_SUCCESS")[1])]
        source = (whole if old else []) or old
        if source and not fs.rename(source[-1], here):
            raise OSError(f"cannot move {source[-1].toString()}")
    for p in [*new, *old]:
        if fs.exists(p):
            fs.delete(p, True)


def readable(spark: SparkSession, path: str) -> str:
    """Where a reader finds the table: path, or the old table beside it while a writer is between its two renames."""
    fs, here = _system(spark, path)
    if fs.exists(here):
        return path
    old = sorted(s.getPath().toString() for s in fs.globStatus(_system(spark, f"{path}.old-*")[1]) or [])
    return old[-1] if old else path


def replaced(rows: DataFrame, path: str, notes: Iterable[str] = ()) -> None:
    """Write beside path, then put in its place by two renames, so that no reader sees half a table; rows may be read from
    path itself. If the second rename fails, the old table goes back; if the writer dies between the two, recovered() ends it.
    notes: empty files of these names (with a leading _) go with the new table."""
    spark = rows.sparkSession
    new, old = f"{path}.new-{uuid.uuid4().hex[:12]}", f"{path}.old-{uuid.uuid4().hex[:12]}"
    rows.write.parquet(new)
    fs, here = _system(spark, path)
    new_path, old_path = _system(spark, new)[1], _system(spark, old)[1]
    for note in notes:
        fs.create(_system(spark, f"{new}/_{note}")[1]).close()
    had = fs.exists(here)
    if had and not fs.rename(here, old_path):
        raise OSError(f"cannot move {path}")
    if not fs.rename(new_path, here):
        if had:
            fs.rename(old_path, here)
        raise OSError(f"cannot move {new}")
    if had:
        fs.delete(old_path, True)


def with_predictions(spark: SparkSession, path: str, new: DataFrame, key: str = "key", notes: Iterable[str] = ()) -> DataFrame:
    """Add predictions to the cache at path (new ones win over stored ones of the same key) and read it back. A cache that a writer
    left between two renames is put right first."""
    recovered(spark, path)
    fs, here = _system(spark, path)
    rows = new
    if fs.exists(here):
        old = spark.read.parquet(path)
        rows = new.unionByName(old.join(new.select(key), key, "left_anti"))
    replaced(rows, path, notes)
    return spark.read.parquet(path)


def applied_batches(spark: SparkSession, path: str) -> dict[str, int]:
    """The last batch of each stream that the cache at path holds."""
    fs, _ = _system(spark, path)
    marks = [s.getPath().getName().rsplit("-", 2) for s in fs.globStatus(_system(spark, f"{path}/_batch-*")[1]) or []]
    return {stream: int(number) for _, stream, number in marks}


def upsert_batch(batch: DataFrame, batch_id: int, path: str, key: str = "key", order: str | None = None, stream: str = "main") -> bool:
    """For foreachBatch: the batch's predictions into the cache at path, once. The batch's number moves in with its rows by the
    same rename, so a batch that is played again after a failure, at whatever point, changes nothing. Streams are told apart by
    name (without "-"), and write one after another. Of several rows of a key the one with the greatest `order` (then the greatest row) wins; rows
    without a key are left out. Gives whether the batch was new."""
    spark = batch.sparkSession
    recovered(spark, path)
    marks = applied_batches(spark, path)
    if batch_id <= marks.get(stream, -1):
        return False
    others = [c for c in batch.columns if c != key]
    first = F.struct(*([F.col(order)] if order else []), *[F.col(c) for c in sorted(others)])
    one = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*others), first).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in others])
    with_predictions(spark, path, one.select(*batch.columns), key, [f"batch-{s}-{n}" for s, n in (marks | {stream: batch_id}).items()])
    return True


def of_families(archive: DataFrame, families: list[str], metrics: list[str], config: str = "config") -> DataFrame:
    """Rows of a result archive whose configuration is of one of the model families (what stands before " | "), with the metrics asked for."""
    return archive.where(family(F.col(config)).isin(families)).select("file", config, family(F.col(config)).alias("family"), *metrics)


def family(config: Column) -> Column:
    return F.split(config, r" \| ")[0]
