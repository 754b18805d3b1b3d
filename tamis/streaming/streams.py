"""The row-level operators over streams: own extensions, watermarked."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.functions import email, replies
from tamis.sources import sinks


def flow_sessions(packets: DataFrame, key: list[str], gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Packets (ts, pkt_len, label, key) to flows that end after a gap."""
    return packets.withWatermark("ts", late).groupBy(*key, F.session_window("ts", gap)).agg(F.count("*").alias("pkt_count"), F.sum("pkt_len").alias("total_bytes"), F.max("label").alias("label"))


def routed(stream: DataFrame, scores: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Stream-static join with the score table; the gate's score stays where it is sure."""
    j = stream.join(scores, "key", "left")
    far = replies.routed(F.col("score"), F.lit(threshold))
    return j.withColumn("final", F.when(far, F.col("p1")).otherwise(F.col("score")))


def alerts_per_hour(stream: DataFrame, threshold: float = 0.5, late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).where(F.col("score") >= threshold).groupBy(F.window("ts", "1 hour")).agg(F.count("*").alias("alerts"))


def without_copies(messages: DataFrame, late: str = "1 day") -> DataFrame:
    """The first message of each content hash within the watermark."""
    hashed = messages.withColumn("content_hash", email.content_hash(email.normalize_text(F.col("text"))))
    return hashed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["content_hash"])


def cached_predictions(predictions: DataFrame, path: str, checkpoint: str, key: str = "key", order: str | None = None):
    """A writer that keeps the prediction cache at path up to date from a stream of predictions; start() it. Batches that are
    played again change nothing (sinks.upsert_batch); the checkpoint folder stands for the stream's name."""
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    return predictions.writeStream.foreachBatch(lambda batch, number: sinks.upsert_batch(batch, number, path, key, order, name) and None).option("checkpointLocation", checkpoint)


def routed_with_cache(stream: DataFrame, path: str, write, checkpoint: str, threshold: float = 0.7):
    """A writer that routes each batch against the cache as it stands when the batch begins: the static side of a plain
    stream-static join keeps the files that it listed when the query started. write(rows, batch number) takes the result."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        cache = spark.read.parquet(sinks.readable(spark, path))
        scores = cache.select("key", replies.positive_probability(F.col("pred"), F.col("conf")).alias("p1"))
        write(routed(batch, scores, threshold), number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
