"""Traffic captures from files: labelled flow tables, statistics tables, packet tables, netflow by scenario."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tamis.functions import network

#: Columns that identify a flow and are no features.
METADATA = ["Flow ID", "Source IP", "Destination IP", "Src IP", "Dst IP", "Timestamp"]
#: Columns of a netflow file.
NETFLOW_COLUMNS = ["StartTime", "Dur", "Proto", "SrcAddr", "Sport", "Dir", "DstAddr", "Dport", "State", "sTos", "dTos", "TotPkts", "TotBytes", "SrcBytes", "Label"]
STATISTICS = 115


def files(spark: SparkSession, *patterns: str) -> list[str]:
    """Paths of the first pattern that matches any file, sorted."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for pattern in patterns:
        path = jvm.org.apache.hadoop.fs.Path(pattern)
        found = path.getFileSystem(conf).globStatus(path)
        if found:
            return sorted(s.getPath().toString() for s in found)
    return []


def numbered(scan: DataFrame, name: str = "row_no", where: Column | None = None) -> DataFrame:
    """A file scan with the number of each row from 0, by path and place in the file.

    Rows of a file block keep their order, so only blocks are numbered one after the other: a row of a window for each
    block of a file. where: rows that do not hold it are taken out before numbering."""
    scan = scan if where is None else scan.where(where)
    m = scan.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    blocks = m.groupBy("_path", "_start").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy("_path", "_start").rowsBetween(W.unboundedPreceding, -1))
    blocks = blocks.select("_path", "_start", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    return m.join(blocks, ["_path", "_start"]).withColumn(name, F.col("_at") - F.col("_first") + F.col("_before")).drop("_path", "_start", "_at", "_first", "_before")


def positional(left: DataFrame, right: DataFrame, name: str = "row_no") -> DataFrame:
    """Rows of two numbered tables side by side; what the longer has more is left out."""
    return left.join(right, name)


def finite(c: Column) -> Column:
    """A number; text that is none, NaN and infinite values are null."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def cic_flows(spark: SparkSession, pattern: str) -> DataFrame:
    """All CSV files of a pattern as one table of numbers with label 0 (BENIGN) or 1; repeated rows and metadata columns go.

    Each file has its own header (one file a day); names and labels are trimmed; a missing label counts as 1."""
    paths = files(spark, pattern)
    if not paths:
        raise FileNotFoundError(pattern)
    parts = []
    for path in paths:
        df = spark.read.csv(path, header=True)
        parts.append(df.toDF(*[c.strip() for c in df.columns]))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    label = F.coalesce((F.trim(F.col("`Label`")) != "BENIGN").cast("int"), F.lit(1)).alias("label")
    return rows.select(*[finite(F.col(f"`{c}`")).alias(c) for c in rows.columns if c != "Label" and c not in METADATA], label).dropDuplicates()


def statistics_table(spark: SparkSession, features: str, labels: str | None = None, width: int = STATISTICS) -> DataFrame:
    """A table of unnamed statistics (columns kitsune_f0, ...) with its label; repeated rows go.

    A first row of numbers means that there is no header. With one column more than width, the first is left out if it
    counts the rows from 0; else the last is the label. Without a label column, labels (the first column of a file without header) are
    joined by row number."""
    paths = files(spark, features)
    if not paths:
        raise FileNotFoundError(features)
    scan = spark.read.csv(paths[0], header=False)
    first = scan.select(F.forall(F.array(*scan.columns), lambda x: x.try_cast("double").isNotNull()).alias("numbers")).first()
    if first is None or not first["numbers"]:
        scan = spark.read.csv(paths[0], header=True)
        rows = numbered(scan)
    else:
        rows = numbered(scan)
        names, columns = [f"kitsune_f{i}" for i in range(width)], scan.columns
        if len(columns) == width + 1:
            counts = rows.agg(F.bool_and(F.coalesce(F.col(columns[0]).try_cast("double") == F.col("row_no"), F.lit(False))).alias("c")).first()["c"]
            columns, names = (columns[1:], names) if counts else (columns, [*names, "label"])
        elif len(columns) != width:
            names = [f"f{i}" for i in range(len(columns))]
        rows = rows.select("row_no", *[F.col(c).alias(n) for c, n in zip(columns, names)])
    if "label" not in rows.columns:
        where = files(spark, labels) if labels else []
        if not where:
            raise FileNotFoundError(f"no label column in {paths[0]} and no label file {labels}")
        marks = spark.read.csv(where[0], header=False)
        rows = positional(rows, numbered(marks).select("row_no", F.col(marks.columns[0]).alias("label")))
    return rows.select(*[finite(F.col(f"`{c}`")).alias(c) for c in rows.columns if c not in ("row_no", "label")], F.col("label").cast("double").cast("int").alias("label")).dropDuplicates()


def packet_table(spark: SparkSession, packets: str, labels: str) -> DataFrame:
    """A Parquet table of decoded packets with labels by position (the last column of a CSV; rows that hold no number there,
    such as a header, are left out before counting), protocol number and flow_id. The longer of the two is cut."""
    scan = spark.read.parquet(packets)
    marks = spark.read.csv(labels, header=False)
    value = F.col(marks.columns[-1]).try_cast("double")
    marks = numbered(marks, where=value.isNotNull() & ~F.isnan(value)).select("row_no", F.rint(value).cast("int").alias("label"))
    rows = positional(numbered(scan.drop("label")), marks)
    number = F.when(F.col("protocol") == "TCP", 6).when(F.col("protocol") == "UDP", 17).when(F.col("protocol") == "ICMP", 1).otherwise(0)
    rows = rows.withColumn("protocol_int", number.cast("bigint"))
    return rows.withColumn("flow_id", network.flow_id(*network.KEY))


def packet_flow_table(spark: SparkSession, packets: str, labels: str) -> DataFrame:
    """The packets of packet_table as flows."""
    return network.flows(packet_table(spark, packets, labels), order=["row_no"])


def netflow_scenarios(spark: SparkSession, root: str, scenarios: list[int], background: str = "benign", sample_per_scenario: int | None = None, seed: int = 42, internal: str = "147.32.", ordered: bool = True) -> DataFrame:
    """Netflow files root/<scenario>/*.binetflow as one table, by scenario and time (ties in the order of the file).

    background: benign keeps background rows with label 0, drop leaves them out. A label of no known kind and a start
    time that does not parse raise; a port that does not parse is -1 (see bad_ports). sample_per_scenario rows of each
    scenario are drawn by hash of the row's number."""
    if background not in ("benign", "drop"):
        raise ValueError("background must be benign or drop")
    found = {s: files(spark, f"{root}/{s}/*.binetflow") for s in scenarios}
    missing = [s for s, paths in found.items() if not paths]
    if missing:
        raise FileNotFoundError(f"no netflow files under {root} for scenarios {missing}")
    parts = []
    for s, paths in found.items():
        rows = numbered(spark.read.csv(paths[0], header=True)).select(*NETFLOW_COLUMNS, "row_no", F.lit(s).alias("scenario"))
        if sample_per_scenario:
            rows = rows.orderBy(F.sha2(F.concat(F.lit(f"{seed + s}:"), F.col("row_no").cast("string")), 256)).limit(sample_per_scenario)
        parts.append(rows)
    rows = reduce(DataFrame.unionByName, parts)
    time = F.try_to_timestamp("StartTime", F.lit("yyyy/MM/dd HH:mm:ss.SSSSSS"))
    time = F.coalesce(time, F.raise_error(F.concat(F.lit("start time does not parse: "), F.coalesce("StartTime", F.lit("null")))).cast("timestamp"))
    kind = F.lower(network.label_kind(F.coalesce("Label", F.lit("null"))))
    number = lambda c: F.col(c).try_cast("double")
    rows = rows.select(
        "scenario", "row_no", (F.unix_micros(time) / 1e6).alias("start_time"), number("Dur").alias("dur"), F.lower("Proto").alias("proto"), F.col("SrcAddr").alias("src_ip"), F.col("DstAddr").alias("dst_ip"),
        network.port(F.col("Sport")).alias("sport"), network.port(F.col("Dport")).alias("dport"), F.trim("Dir").alias("dir"), F.col("State").alias("state"), number("sTos").alias("stos"), number("dTos").alias("dtos"),
        number("TotPkts").alias("tot_pkts"), number("TotBytes").alias("tot_bytes"), number("SrcBytes").alias("src_bytes"), kind.alias("label_kind"))
    if background == "drop":
        rows = rows.where("label_kind <> 'background'")
    rows = network.derived(rows).withColumns({"label": (F.col("label_kind") == "botnet").cast("int"), "host": network.internal_host(F.col("src_ip"), F.col("dst_ip"), internal), "botnet": network.botnet_family(F.col("scenario"))})
    rows = rows.withColumn("flow_id", network.flow_id("src_ip", "dst_ip", "sport", "dport", "proto_int"))
    return rows.orderBy("scenario", "start_time", "row_no") if ordered else rows


def bad_ports(rows: DataFrame) -> DataFrame:
    """Ports that did not parse, by scenario."""
    return rows.groupBy("scenario").agg((F.count_if(F.col("sport") < 0) + F.count_if(F.col("dport") < 0)).alias("bad_ports"))


def mail_table(spark: SparkSession, path: str, text: str = "text", label: str = "label", classes: dict[str, int] | None = None) -> DataFrame:
    """text and label (0 or 1) of a CSV or Parquet table: columns renamed, label names mapped, null and repeated texts dropped.

    Of equal texts with different labels the smallest label stays."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"') if ".csv" in path else spark.read.parquet(path)
    value = F.col(f"`{label}`")
    y = F.coalesce(*[F.when(value == k, v) for k, v in classes.items()]) if classes else value.cast("int")
    return rows.select(F.col(f"`{text}`").alias("text"), y.alias("label")).where("text IS NOT NULL").groupBy("text").agg(F.min("label").alias("label"))


#: Loaders by kind of data set.
LOADERS: dict[str, Callable[..., DataFrame]] = {"mail": mail_table, "cic": cic_flows, "statistics": statistics_table, "packets": packet_table, "packet_flows": packet_flow_table, "netflow": netflow_scenarios}


def load(spark: SparkSession, kind: str, *args, view: str | None = None, **options) -> DataFrame:
    """A data set by kind, as a temporary view if asked; an unknown kind raises with the known ones."""
    if kind not in LOADERS:
        raise ValueError(f"unknown kind {kind!r}; known: {sorted(LOADERS)}")
    rows = LOADERS[kind](spark, *args, **options)
    if view:
        rows.createOrReplaceTempView(view)
    return rows
