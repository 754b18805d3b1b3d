"""Corpus ingestion by manifest: CSV, Parquet, JSON lines, folders of messages and mbox files into one e-mail table."""

from __future__ import annotations

import email as mail
import re
from email import policy
from email.utils import parsedate_to_datetime
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions import email as columns
from tamis.operators.fingerprints import placed

REQUIRED = ["asset_id", "path", "format", "source_corpus", "source_version", "text_field", "label_field", "mapping", "license_note"]


def _body(raw: bytes) -> str:
    """Subject and first plain part of a message."""
    m = mail.message_from_bytes(raw, policy=policy.compat32)
    part = next((p for p in m.walk() if p.get_content_type() == "text/plain"), None)
    data = part.get_payload(decode=True) if part is not None else b""
    return f"{m.get('Subject') or ''}\n{(data or b'').decode('latin-1')}".strip()


def _decoded(df: DataFrame) -> DataFrame:
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"text": [_body(bytes(b)) for b in pdf["raw"]], "label": pdf["label"]})

    return df.mapInPandas(run, "text string, label string")


def message_folder(spark: SparkSession, path: str, label: str | None = None) -> DataFrame:
    """One file a message; the label is the file's folder unless given."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    folder = F.element_at(F.split("path", "/"), -2)
    return _decoded(files.select(F.col("content").alias("raw"), (F.lit(label) if label else folder).alias("label")))


def mbox(spark: SparkSession, path: str, label: str) -> DataFrame:
    """Messages of an mbox file, split at lines that begin with From; Latin-1."""
    rows = spark.read.option("lineSep", "\nFrom ").text(path)
    raw = F.regexp_replace(F.decode(F.col("value").cast("binary"), "ISO-8859-1"), r"^(From )?[^\n]*\n", "")
    return _decoded(rows.select(F.encode(raw, "ISO-8859-1").alias("raw"), F.lit(label).alias("label")))


def load_manifest(spark: SparkSession, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, report by asset) of all assets of a manifest (one row an asset, so it is read on the driver)."""
    missing = [c for c in REQUIRED if c not in manifest.columns]
    if missing:
        raise ValueError(f"manifest lacks {missing}")
    parts = []
    for a in manifest.collect():
        if a["format"] == "eml_dir":
            df = message_folder(spark, a["path"], a["label_field"] or None)
        elif a["format"] == "mbox":
            df = mbox(spark, a["path"], a["label_field"])
        else:
            read = {"csv": lambda p: spark.read.csv(p, header=True, multiLine=True, escape='"'), "parquet": spark.read.parquet, "jsonl": spark.read.json}[a["format"]]
            df = read(a["path"]).select(F.col(a["text_field"]).cast("string").alias("text"), F.col(a["label_field"]).cast("string").alias("label"))
        parts.append(df.where("text IS NOT NULL").select("text", "label", *[F.lit(a[c]).alias(c) for c in ("asset_id", "source_corpus", "source_version", "mapping")]))
    rows = reduce(DataFrame.unionByName, parts)
    return rows, rows.groupBy("asset_id", "label").agg(F.count("*").alias("n"))


OPTIONAL = ["id_field", "timestamp_field", "group_field", "label_from_path", "encoding"]
_TAG = re.compile(r"<[^>]+>")


def _message(raw: bytes, encoding: str) -> tuple[str, str | None]:
    """(subject, newline, body; date in ISO form or None): the first plain part, else the first HTML part without its tags."""
    m = mail.message_from_bytes(raw, policy=policy.compat32)
    parts = list(m.walk()) if m.is_multipart() else [m]
    plain = next((p for p in parts if p.get_content_type() == "text/plain"), None)
    part = plain or next((p for p in parts if p.get_content_type() == "text/html"), None)
    data = (part.get_payload(decode=True) if part is not None else None) or b""
    try:
        body = data.decode(part.get_content_charset() or encoding if part is not None else encoding, "replace")
    except LookupError:
        body = data.decode(encoding, "replace")
    body = body if part is plain else _TAG.sub(" ", body)
    try:
        date = parsedate_to_datetime(str(m["Date"])).isoformat()
    except (TypeError, ValueError):
        date = None
    return f"{m.get('Subject') or ''}\n{body}", date


def _opened_messages(raw: DataFrame, encoding: str) -> DataFrame:
    """raw, label, source_id to text, label, source_id, timestamp (as written)."""

    def run(batches):
        for pdf in batches:
            found = [_message(bytes(b), encoding) for b in pdf["raw"]]
            yield pd.DataFrame({"text": [t for t, _ in found], "label": pdf["label"], "source_id": pdf["source_id"], "timestamp": [d for _, d in found]})

    return raw.mapInPandas(run, "text string, label string, source_id string, timestamp string")


def _asset(spark: SparkSession, a: dict, path: str) -> DataFrame:
    """text, label, source_id, timestamp, group (null where the manifest names no field) of one asset."""
    constant = a["label_field"] if a["label_field"] not in ("", "label") else None
    kind, encoding, none = a["format"].lower(), a.get("encoding") or "latin-1", F.lit(None).cast("string")
    if kind == "eml_dir":
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        root = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
        below = F.expr(f"substring(path, {len(root) + 2})")
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).withColumn("source_id", below)
        first = F.when(F.contains("source_id", F.lit("/")) & F.lit(a.get("label_from_path", "").lower() != "false"), F.substring_index("source_id", "/", 1)).otherwise("")
        raw = files.select(F.col("content").alias("raw"), (F.lit(constant) if constant else first).alias("label"), "source_id")
        return _opened_messages(raw, encoding).withColumn("group", none)
    if kind == "mbox":
        rows = placed(spark.read.option("lineSep", "\nFrom ").text(path), F.lit(1))
        data = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
        body = F.when((F.col("row") > 0) | data.startswith("From "), F.regexp_replace(data, r"^[^\n]*\n?", "")).otherwise(data)
        name = F.concat(F.element_at(F.split("file", "/"), -1), F.lit(":"), F.col("row").cast("string"))
        raw = rows.select(F.encode(body, "ISO-8859-1").alias("raw"), F.lit(a["label_field"]).alias("label"), name.alias("source_id"), body.alias("_b")).where(F.col("_b").rlike(r"\S")).drop("_b")
        return _opened_messages(raw, encoding).withColumn("group", none)
    read = {"csv": lambda: spark.read.csv(path, header=True, multiLine=True, escape='"'), "parquet": lambda: spark.read.parquet(path), "jsonl": lambda: spark.read.json(path)}
    if kind not in read:
        raise ValueError(f"asset {a['asset_id']}: unknown format {kind!r}")
    df = read[kind]()
    text = lambda c: F.col(f"`{c}`").cast("string")
    field = lambda option, usual: a.get(option) if a.get(option) in df.columns else usual if usual in df.columns else None
    own, time, group = field("id_field", "source_id"), field("timestamp_field", "timestamp"), field("group_field", "")
    rows = df.select(text(a["text_field"]).alias("text"), text(a["label_field"]).alias("label"), (text(own) if own else none).alias("_own"), (text(time) if time else none).alias("timestamp"), (text(group) if group else none).alias("group"))
    if own:
        return rows.withColumnRenamed("_own", "source_id")
    rows = placed(rows, F.lit(1), by_file=False)
    return rows.select("text", "label", F.concat(F.lit(f"{a['source_corpus']}:"), F.col("row").cast("string")).alias("source_id"), "timestamp", "group")


def annotated(raw: DataFrame, corpus: str, version: str, mapping: str) -> DataFrame:
    """The e-mail table with every field of the taxonomy, from text, label, source_id, timestamp, group of one corpus. Labels that the
    mapping does not cover raise; null texts are empty; times that cannot be read are null; rows without a group of
    their own take the template's."""
    rule, rules = columns.mapping_rule(mapping)
    text = F.coalesce("text", F.lit(""))
    r = raw.withColumn("_norm", columns.normalize_text(text)).withColumn("_m", columns.mapped(F.coalesce("label", F.lit("")), rules))
    provided = F.col("group").isNotNull()
    return r.select(
        text.alias("text"), (F.col("_m.subtype") == "phishing").cast("int").alias("label_binary"), F.col("_m.subtype").alias("subtype"), F.coalesce("label", F.lit("")).alias("source_label"), F.lit(corpus).alias("source_corpus"), F.lit(version).alias("source_version"), "source_id",
        columns.content_hash(F.col("_norm")).alias("content_hash"), F.lit(rule).alias("mapping_rule"), F.col("_m.confidence").alias("mapping_confidence"), F.lit(columns.POLICY_VERSION).alias("annotation_policy_version"),
        F.when(provided, F.col("group")).otherwise(columns.template_key(F.col("_norm"))).alias("campaign_or_template_group"), F.try_to_timestamp("timestamp").alias("timestamp"), F.when(provided, "provided").otherwise("template-prefix-v1").alias("group_method"))


def load_annotated(spark: SparkSession, manifest: str) -> tuple[DataFrame, DataFrame]:
    """(rows, report) of a manifest file (CSV; one row an asset, so it is read on the driver). Paths are relative to its folder.

    All missing files are named in one error, as are missing columns; nothing is fetched or left out. rows: see annotated(), with
    asset_id. report: a row for each asset, also one without rows: rows, mapping_rule, counts by subtype and by confidence,
    license_note, the manifest's fingerprint and the policy version."""
    fs = lambda p: p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    at = lambda p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
    if not fs(at(manifest)).exists(at(manifest)):
        raise FileNotFoundError(f"manifest not found: {manifest}")
    table = spark.read.csv(manifest, header=True, multiLine=True, escape='"').fillna("")
    lacking = [c for c in REQUIRED if c not in table.columns]
    if lacking:
        raise ValueError(f"manifest lacks {lacking}")
    assets = [r.asDict() for r in table.collect()]
    base = manifest.rsplit("/", 1)[0] if "/" in manifest else "."
    paths = [a["path"] if a["path"].startswith("/") or "://" in a["path"] else f"{base}/{a['path'].rstrip('/')}" for a in assets]
    missing = [p for p in paths if not fs(at(p)).exists(at(p))]
    if missing:
        raise FileNotFoundError("expected data files not found (none is fetched):\n  " + "\n  ".join(missing))
    raw = spark.read.format("binaryFile").load(manifest).select(F.substring(F.sha2("content", 256), 1, 16)).first()[0]
    rows = reduce(DataFrame.unionByName, [annotated(_asset(spark, a, p), a["source_corpus"], a["source_version"], a["mapping"]).withColumn("asset_id", F.lit(a["asset_id"])) for a, p in zip(assets, paths)])
    counts = lambda c, names: F.map_filter(F.create_map(*[x for n in names for x in (F.lit(n), F.count_if(F.col(c) == n))]), lambda _, n: n > 0)
    found = rows.groupBy("asset_id").agg(F.count("*").alias("rows"), counts("subtype", columns.SUBTYPES).alias("subtype_counts"), counts("mapping_confidence", columns.CONFIDENCES).alias("confidence_counts"))
    head = spark.createDataFrame([(a["asset_id"], a["source_corpus"], a["format"].lower(), columns.mapping_rule(a["mapping"])[0], a["license_note"], raw, columns.POLICY_VERSION) for a in assets], "asset_id string, source_corpus string, format string, mapping_rule string, license_note string, manifest_fingerprint string, annotation_policy_version string")
    return rows, head.join(found, "asset_id", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))


def result_archive(spark: SparkSession, path: str) -> DataFrame:
    """Result documents flattened: one row for each configuration of each file."""
    df = spark.read.option("multiLine", "true").schema("rows map<string, struct<aucpr:double, rocauc:double, coverage_test:double, representative_test:boolean>>").json(path)
    return df.select(F.input_file_name().alias("file"), F.explode("rows").alias("config", "r")).select("file", "config", "r.*")
