"""The analytics tables as views over the given ones: e-mails, packets, netflow, predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions import network, replies

MODEL, PROMPT = "small-model", "Classify this message: {text}"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan dealt to all cores where it has few splits (of a small file one split may hold all rows); a large one stays as it is.

    scan is what read() gives: the number of its splits comes from the files alone, without a job. Never a join or a grouping,
    whose partitions are known only by running it."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(2 * cores) if scan.rdd.getNumPartitions() < 4 * cores else scan


def labelled(documents: DataFrame, labels: DataFrame, *more: str) -> DataFrame:
    """documents with their labels as subtypes; score is a fixed expression with many ties. more: further columns to keep."""
    d = documents.join(labels, "doc_id", "left")
    subtype = F.when((F.col("toxic") == 1) & (F.col("quality") == 1), "phishing").when(F.col("toxic") == 1, "scam_fraud").when(F.col("quality") == 0, "bulk_spam").when(F.col("quality") == 1, "ham").otherwise("unknown_nonphishing")
    d = d.withColumn("subtype", subtype).withColumn("label", (F.col("subtype") == "phishing").cast("int"))
    return d.withColumn("score", F.round(F.expr("((doc_id * 7919) % 83 + 15 * label) / 100.0"), 2).cast("double")).select("doc_id", "text", "lang", "source", "subtype", "label", "score", *more)


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("bigint")
    number = F.when(kind.isin("click", "view"), 6).when(kind == "purchase", 17).when(kind == "signup", 1).otherwise(0)
    bits = F.when(kind == "click", 2).when(kind == "view", 16).otherwise(0)
    out = e.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("time_us"), F.concat(F.lit("10.0."), F.col("user_id").cast("string")).alias("src_ip"), F.concat(F.lit("192.168."), (k % 5).cast("string")).alias("dst_ip"), (F.col("user_id") % 7 + 1024).alias("src_port"), F.element_at(F.array(*[F.lit(p).cast("bigint") for p in (80, 443, 22, 5999)]), (k % 4 + 1).cast("int")).alias("dst_port"), number.cast("bigint").alias("protocol_int"), F.floor("value").cast("bigint").alias("pkt_len"), (k >= 90).cast("int").alias("label"), bits.alias("bits"), F.when(k % 3 == 0, 128).otherwise(64).alias("ttl"))
    return out.withColumns(network.flag_bits(F.col("bits"))).withColumn("protocol", network.protocol_name(F.col("protocol_int").cast("int")))


def netflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return li.select(
        "l_orderkey", "l_linenumber", F.substring("o_orderpriority", 1, 1).cast("int").alias("scenario"), F.concat(F.lit("147.32."), F.col("l_suppkey").cast("string")).alias("host"), F.col("l_shipdate").alias("start_time"),
        F.when(F.col("l_linestatus") == "O", "tcp").otherwise("udp").alias("proto"), F.when(F.col("l_returnflag") == "A", "  ->").when(F.col("l_returnflag") == "N", " <->").otherwise("<-").alias("dir"),
        F.when(F.col("l_linenumber") == 1, F.concat(F.lit("0x"), F.lower(F.hex(F.col("l_partkey") % 65536)))).when(F.col("l_linenumber") == 2, "").otherwise((F.col("l_partkey") % 65536).cast("string")).alias("sport_raw"), F.lit("80").alias("dport_raw"),
        F.col("l_quantity").cast("bigint").alias("tot_pkts"), F.floor("l_extendedprice").cast("bigint").alias("tot_bytes"), F.floor(F.col("l_extendedprice") / 3).cast("bigint").alias("src_bytes"),
        F.when(F.col("l_returnflag") == "R", "flow=From-Botnet-V1").when(F.col("l_returnflag") == "A", "flow=From-Normal-V2").otherwise("flow=Background").alias("label_raw"), (F.col("l_returnflag") == "R").cast("int").alias("label"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction cache derived from the texts' hashes; one slice of the hashes has no entry."""
    d = read(spark, sf_dir, "documents").select(replies.cache_key(F.col("text"), MODEL, PROMPT).alias("key")).distinct()
    h = lambda at: F.conv(F.substring("key", at, 2), 16, 10).cast("int")
    return d.where(h(1) >= 32).select("key", (h(3) % 2).alias("pred"), (F.lit(0.5) + (h(5) % 50) / 100).alias("conf"))


#: The same views for the SQL oracles.
EMAILS = """emails AS (SELECT *, round(((doc_id * 7919) % 83 + 15 * label) / 100.0, 2) AS score FROM (SELECT *, CAST(subtype = 'phishing' AS INT) AS label FROM (
 SELECT doc_id, text, lang, source, CASE WHEN toxic = 1 AND quality = 1 THEN 'phishing' WHEN toxic = 1 THEN 'scam_fraud' WHEN quality = 0 THEN 'bulk_spam' WHEN quality = 1 THEN 'ham' ELSE 'unknown_nonphishing' END AS subtype
 FROM documents LEFT JOIN labels USING (doc_id))))"""
PACKETS = """p0 AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
packets AS (SELECT event_id, epoch_us(ts) AS time_us, '10.0.' || user_id AS src_ip, '192.168.' || (k % 5) AS dst_ip, user_id % 7 + 1024 AS src_port, CASE k % 4 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 22 ELSE 5999 END AS dst_port,
 CASE WHEN event_type IN ('click', 'view') THEN 6 WHEN event_type = 'purchase' THEN 17 WHEN event_type = 'signup' THEN 1 ELSE 0 END AS protocol_int, CASE WHEN event_type IN ('click', 'view') THEN 'TCP' WHEN event_type = 'purchase' THEN 'UDP' WHEN event_type = 'signup' THEN 'ICMP' ELSE 'OTHER' END AS protocol,
 CAST(floor(value) AS BIGINT) AS pkt_len, CAST(k >= 90 AS INT) AS label, CAST(event_type = 'click' AS INT) AS syn, CAST(event_type = 'view' AS INT) AS ack, CASE WHEN k % 3 = 0 THEN 128 ELSE 64 END AS ttl FROM p0)"""
PREDICTIONS = """keyed AS (SELECT doc_id, substr(sha256(coalesce(text, '')), 1, 16) || ':small-model:' || substr(sha256('Classify this message: {text}'), 1, 8) AS key FROM documents),
k1 AS (SELECT DISTINCT key, CAST('0x' || substr(key, 1, 2) AS INT) AS a, CAST('0x' || substr(key, 3, 2) AS INT) AS b, CAST('0x' || substr(key, 5, 2) AS INT) AS c FROM keyed),
predictions AS (SELECT key, b % 2 AS pred, 0.5 + (c % 50) / 100.0 AS conf FROM k1 WHERE a >= 32)"""
