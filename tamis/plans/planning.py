"""Registered queries: further splits, run plans and identities, feature tables, label sentences, gate sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.functions import network, replies
from tamis.operators import metrics, splits
from tamis.sources import captures, sinks

from . import views
from .registry import FLOWS, NETFLOW, PORT_SQL, flow_table, netflow_rows, query
from .views import EMAILS, PACKETS, PREDICTIONS

U_SQL = lambda key: f"CAST('0x' || substr(sha256({key}), 1, 8) AS BIGINT)::DOUBLE / 4294967295"


@query(f"""WITH u AS (SELECT doc_id, {U_SQL("'42:' || doc_id")} AS u FROM documents) SELECT doc_id, CASE WHEN u < 0.6 THEN 'train' WHEN u < 0.8 THEN 'cal' ELSE 'test' END AS part FROM u""")
def split_random_rows(spark, sf_dir):
    """The reference that leaks: three parts by row, whatever the template group."""
    return splits.row_parts(views.read(spark, sf_dir, "documents"), {"train": 3.0, "cal": 1.0, "test": 1.0}, "doc_id").select("doc_id", "part")


@query(f"""WITH {EMAILS}, r AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY sha256('42:' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM emails),
o AS (SELECT *, r <= round(n * 0.2::DOUBLE) AS test FROM r), i AS (SELECT doc_id, row_number() OVER (PARTITION BY label ORDER BY sha256('42/validation:' || doc_id), doc_id) AS r2, count(*) OVER (PARTITION BY label) AS n2 FROM o WHERE NOT test)
SELECT doc_id, CASE WHEN test THEN 'test' WHEN r2 <= round(n2 * 0.15::DOUBLE) THEN 'validation' ELSE 'train' END AS part FROM o LEFT JOIN i USING (doc_id)""")
def split_nested(spark, sf_dir):
    return splits.nested_split(views.emails(spark, sf_dir), ["label"], "doc_id", 0.2, 0.15).select("doc_id", "part")


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('42:' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM documents) SELECT doc_id, least(150, n) / n AS exposure FROM r WHERE r <= 150""")
def thinned_subset(spark, sf_dir):
    """A uniform subset for the expensive model, with the share of all rows that it stands for."""
    return splits.thinned(views.read(spark, sf_dir, "documents"), 150, "doc_id").select("doc_id", "exposure")


@query(f"""WITH {PACKETS}, r AS (SELECT event_id, row_number() OVER (ORDER BY time_us, event_id) - 1 AS r, (count(*) OVER ()) // 7 AS q, (count(*) OVER ()) % 7 AS m FROM packets)
SELECT event_id, CASE WHEN r < m * (q + 1) THEN r // (q + 1) ELSE m + (r - m * (q + 1)) // greatest(q, 1) END AS fold FROM r""")
def split_contiguous_folds(spark, sf_dir):
    return splits.contiguous_folds(views.packets(spark, sf_dir), "time_us", "event_id", 7, 3_600_000_000).select("event_id", "fold")


@query(f"""WITH {PACKETS}, u AS (SELECT *, {U_SQL("'42:' || src_ip")} AS u FROM packets) SELECT CASE WHEN u < 0.2 THEN 'test' ELSE 'train' END AS part, count(*) AS n, count(DISTINCT src_ip) AS hosts, sum(label)::BIGINT AS positives FROM u GROUP BY 1""")
def split_hosts(spark, sf_dir):
    s = splits.split(views.packets(spark, sf_dir), "host", "event_id", 0.2, group="src_ip")
    return s.groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("src_ip").alias("hosts"), F.sum("label").alias("positives"))


@query(f"""WITH {EMAILS} SELECT DISTINCT subtype FROM emails WHERE subtype IN ('ham', 'bulk_spam', 'scam_fraud') UNION SELECT 'phishing'""")
def mixture_subtypes(spark, sf_dir):
    return splits.required_subtypes(views.emails(spark, sf_dir), [0.0, 0.5])


PLAN = """plan AS (SELECT source, lang, n, bundle, rank, condition, CASE substr(h, 1, 1) WHEN '0' THEN 'controlled-random' WHEN '1' THEN 'controlled-random' WHEN '2' THEN 'controlled' WHEN '3' THEN 'controlled' WHEN '4' THEN 'controlled' WHEN '5' THEN 'controlled' ELSE 'external' END AS regime, CASE WHEN lang = 'en' THEN 'raw' ELSE 'stripped' END AS variant
 FROM (SELECT source, lang, count(*) AS n, sha256(concat_ws(':', source, lang)) AS h, source AS bundle, CAST('0x' || substr(sha256(concat_ws(':', source, lang)), 2, 1) AS INT) % 3 AS rank FROM documents GROUP BY source, lang), (SELECT unnest(['A', 'B', 'C']) AS condition))"""


def run_plan(spark, sf_dir):
    """Planned runs for each source and language of the documents under three conditions."""
    d = views.read(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    h = F.sha2(F.concat_ws(":", "source", "lang"), 256)
    first = F.substring(h, 1, 1)
    regime = F.when(first.isin("0", "1"), "controlled-random").when(first.isin("2", "3", "4", "5"), "controlled").otherwise("external")
    rank = F.conv(F.substring(h, 2, 1), 16, 10).cast("int") % 3
    return d.select("source", "lang", "n", F.col("source").alias("bundle"), rank.alias("rank"), regime.alias("regime"), F.when(F.col("lang") == "en", "raw").otherwise("stripped").alias("variant"), F.explode(F.array(*map(F.lit, "ABC"))).alias("condition"))


@query(f"""WITH {PLAN} SELECT source, lang, condition, regime <> 'controlled-random' AS in_full,
 regime = 'controlled' OR (regime = 'external' AND rank = 0) AS in_staged,
 (regime = 'controlled' OR (regime = 'external' AND rank = 0)) AND variant = 'raw' AND condition IN ('A', 'B') AS in_minimal,
 regime = 'controlled' OR (regime = 'external' AND rank = 0) AS full_first,
 regime = 'controlled' OR (regime = 'external' AND coalesce(bundle = 'src1', FALSE)) AS staged_named,
 regime = 'controlled' AS controlled_only FROM plan""")
def compute_scope(spark, sf_dir):
    """Which planned runs each scope lets through."""
    gate = lambda **k: replies.in_scope(*[F.col(c) for c in ("regime", "variant", "condition", "bundle", "rank")], **k)
    return run_plan(spark, sf_dir).select("source", "lang", "condition", gate().alias("in_full"), gate(scope="staged").alias("in_staged"), gate(scope="minimal").alias("in_minimal"), gate(bundles="first").alias("full_first"), gate(scope="staged", bundles="src1").alias("staged_named"), gate(controlled_only=True).alias("controlled_only"))


@query(f"""WITH {PLAN} SELECT source, lang, condition, substr(sha256('{{"bundle": ' || CASE WHEN bundle IS NULL THEN 'null' ELSE '"' || bundle || '"' END || ', "condition": "' || condition || '", "regime": "' || regime || '", "seed": 42, "train_rows": ' || n || ', "variant": "' || variant || '"}}'), 1, 12) AS identity FROM plan""")
def run_identities(spark, sf_dir):
    fields = {c: F.col(c) for c in ("regime", "bundle", "variant", "condition")} | {"seed": F.lit(42), "train_rows": F.col("n")}
    return run_plan(spark, sf_dir).select("source", "lang", "condition", replies.run_identity(fields).alias("identity"))


MODELS = ["claude-sonnet", "gemini-pro", "jev-1.13.0", "convaiinnovations/laya", "mistral", "my-claude"]


@query("""WITH m AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'claude-sonnet' WHEN 1 THEN 'gemini-pro' WHEN 2 THEN 'jev-1.13.0' WHEN 3 THEN 'convaiinnovations/laya' WHEN 4 THEN 'mistral' ELSE 'my-claude' END AS model, lang FROM documents)
SELECT model, lang, count(*) AS n, CASE model WHEN 'claude-sonnet' THEN 'claude' WHEN 'gemini-pro' THEN 'gemini' WHEN 'jev-1.13.0' THEN 'jev' WHEN 'convaiinnovations/laya' THEN 'laya' ELSE 'ollama' END AS backend,
 CASE WHEN lang = 'en' THEN CASE WHEN model LIKE 'jev%' OR model LIKE 'convai%' THEN 'Is it phishing?' ELSE 'Classify: {text}' END END AS prompt FROM m GROUP BY 1, 2""")
def model_backends(spark, sf_dir):
    """Calls by model, with the backend and the prompt that answer them."""
    model = F.element_at(F.array(*map(F.lit, MODELS)), (F.col("doc_id") % len(MODELS) + 1).cast("int"))
    m = views.read(spark, sf_dir, "documents").select(model.alias("model"), "lang").groupBy("model", "lang").agg(F.count("*").alias("n"))
    return m.select("model", "lang", "n", replies.backend(F.col("model")).alias("backend"), replies.prompt(F.col("model"), F.col("lang"), {"en": "Is it phishing?"}, {"en": "Classify: {text}"}).alias("prompt"))


@query(f"""SELECT l_orderkey, l_linenumber, 'A flow on destination port ' || {PORT_SQL('(l_partkey % 1000)')} || ', lasting ' || l_suppkey || '.00 ms, with ' || l_quantity::BIGINT || ' forward packets (' || floor(l_extendedprice)::BIGINT || ' bytes) and ' || l_linenumber || ' backward packets (0 bytes). Mean inter-arrival ' || l_quantity::BIGINT || '.0 us (std 0.0 us); mean packet size ' || (l_orderkey % 1500) || ' bytes. TCP flags observed: SYN=1, ACK=' || l_linenumber || ', FIN=0, RST=0.' AS sentence FROM lineitem""")
def cic_sentences(spark, sf_dir):
    """Lineitems as rows of a labelled flow table, without some of its columns, in words."""
    c = F.col
    rows = views.read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (c("l_partkey") % 1000).alias("Destination Port"), (c("l_suppkey") * 1000).alias("Flow Duration"), c("l_quantity").alias("Total Fwd Packets"), c("l_linenumber").alias("Total Backward Packets"),
        F.floor("l_extendedprice").alias("Total Length of Fwd Packets"), c("l_quantity").alias("Flow IAT Mean"), F.lit(1).alias("SYN Flag Count"), c("l_linenumber").alias("ACK Flag Count"), (c("l_orderkey") % 1500).alias("Packet Length Mean"))
    return rows.select("l_orderkey", "l_linenumber", network.cic_sentence(rows.columns).alias("sentence"))


@query(f"""WITH {FLOWS} SELECT protocol_int, src_port, dst_port, pkt_count, total_bytes, round(mean_pkt_len, 4) AS mean_pkt_len, max_pkt_len, round(duration_ms, 3) AS duration_ms, round(mean_iat_ms, 1) AS mean_iat_ms, round(std_iat_ms, 0) AS std_iat_ms, syn_count, ack_count,
 0::BIGINT AS fin_count, 0::BIGINT AS rst_count, 0::BIGINT AS psh_count, round(mean_ttl, 4) AS mean_ttl FROM flows""")
def flow_features(spark, sf_dir):
    """The sixteen columns of a flow that a model sees."""
    digits = {"mean_pkt_len": 4, "duration_ms": 3, "mean_iat_ms": 1, "std_iat_ms": 0, "mean_ttl": 4}
    return flow_table(spark, sf_dir).select(*[F.round(c, digits[c]).alias(c) if c in digits else c for c in network.FLOW_COLUMNS])


@query(f"""WITH {PACKETS} SELECT event_id, protocol_int, src_port, dst_port, pkt_len, ttl, syn AS tcp_flag_syn, ack AS tcp_flag_ack, 0 AS tcp_flag_fin, 0 AS tcp_flag_rst, 0 AS tcp_flag_psh, 0 AS tcp_flag_urg,
 round(coalesce(time_us - lag(time_us) OVER (PARTITION BY dst_ip ORDER BY time_us, event_id), 0) / 1000, 3) AS interarrival_ms FROM packets""")
def packet_features(spark, sf_dir):
    """The twelve columns of a packet that a model sees."""
    p = network.interarrival(views.packets(spark, sf_dir), ["dst_ip"], ["time_us", "event_id"])
    return p.withColumn("interarrival_ms", F.round(F.col("interarrival_us") / 1000, 3)).select("event_id", *network.PACKET_COLUMNS)


@query(f"""WITH {NETFLOW} SELECT l_orderkey, l_linenumber, proto_int, CAST(dir = '->' AS INT) AS dir_fwd, CAST(dir = '<-' AS INT) AS dir_bwd, CAST(dir = '<->' AS INT) AS dir_bi, 0.5::DOUBLE AS dur, sport, 80 AS dport, NULL::DOUBLE AS stos, NULL::DOUBLE AS dtos, tot_pkts, tot_bytes, src_bytes, round(tot_bytes / nullif(tot_pkts, 0), 4) AS bytes_per_pkt, round(src_bytes / nullif(tot_bytes, 0), 6) AS src_byte_ratio FROM netflow""")
def netflow_features(spark, sf_dir):
    """The fourteen columns of a netflow row that a model sees."""
    n = netflow_rows(spark, sf_dir).withColumns({"dur": F.lit(0.5), "stos": F.lit(None).cast("double"), "dtos": F.lit(None).cast("double")})
    digits = {"bytes_per_pkt": 4, "src_byte_ratio": 6}
    return n.select("l_orderkey", "l_linenumber", *[F.round(c, digits[c]).alias(c) if c in digits else c for c in network.NETFLOW_COLUMNS])


@query(f"""WITH {NETFLOW} SELECT CASE scenario WHEN 1 THEN 'Neris' WHEN 2 THEN 'Neris' WHEN 3 THEN 'Rbot' WHEN 4 THEN 'Rbot' WHEN 5 THEN 'Virut' END AS botnet, count(*) AS flows, sum(label)::BIGINT AS positives, count(*) FILTER (sport < 0) AS bad_ports FROM netflow GROUP BY 1""")
def scenario_botnets(spark, sf_dir):
    """Flows by botnet family of their scenario, with the ports that did not parse."""
    n = netflow_rows(spark, sf_dir).withColumn("botnet", network.botnet_family(F.col("scenario")))
    return n.groupBy("botnet").agg(F.count("*").alias("flows"), F.sum("label").alias("positives"), (F.count_if(F.col("sport") < 0) + F.count_if(F.col("dport") < 0)).alias("bad_ports"))


@query(f"""WITH {PACKETS} SELECT CASE WHEN starts_with(dst_ip, '192.168.') AND NOT starts_with(src_ip, '192.168.') THEN dst_ip ELSE src_ip END AS host, count(*) AS packets FROM packets GROUP BY 1""")
def internal_hosts(spark, sf_dir):
    p = views.packets(spark, sf_dir).withColumn("host", network.internal_host(F.col("src_ip"), F.col("dst_ip"), "192.168."))
    return p.groupBy("host").agg(F.count("*").alias("packets"))


@query("""SELECT sha256(text) AS text_hash, coalesce(min(CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 0 END), -1) AS label FROM documents WHERE text IS NOT NULL GROUP BY text""")
def mail_load(spark, sf_dir):
    """The documents as a labelled mail table: texts once each, two classes by name, others have -1 here."""
    m = captures.load(spark, "mail", f"{sf_dir}/documents.parquet", label="lang", classes={"en": 1, "de": 0})
    return m.select(F.sha2("text", 256).alias("text_hash"), F.coalesce("label", F.lit(-1)).alias("label"))


@query("""WITH a AS (SELECT doc_id, row_number() OVER () - 1 AS row_no FROM documents), b AS (SELECT quality, row_number() OVER () - 1 AS row_no FROM labels) SELECT row_no, doc_id, quality FROM a JOIN b USING (row_no)""")
def positional_labels(spark, sf_dir):
    """Documents with the labels that stand in the same places of their file."""
    d, y = views.read(spark, sf_dir, "documents"), views.read(spark, sf_dir, "labels")
    return captures.positional(captures.numbered(d), captures.numbered(y).select("row_no", "quality")).select("row_no", "doc_id", "quality")


@query(f"""WITH {EMAILS}, a AS (SELECT source || '.json' AS file, CASE lang WHEN 'en' THEN 'trees' WHEN 'de' THEN 'linear' ELSE 'other' END || ' | ' || subtype AS config, round(avg(score), 9) AS mean_score FROM emails GROUP BY source, lang, subtype)
SELECT file, config, split_part(config, ' | ', 1) AS family, max(mean_score) AS mean_score FROM a WHERE split_part(config, ' | ', 1) IN ('trees', 'linear') GROUP BY 1, 2, 3""")
def archive_families(spark, sf_dir):
    """Of a result archive (one row for each file and configuration), those of two model families."""
    e = views.emails(spark, sf_dir)
    model = F.when(F.col("lang") == "en", "trees").when(F.col("lang") == "de", "linear").otherwise("other")
    a = e.groupBy(F.concat("source", F.lit(".json")).alias("file"), F.concat(model, F.lit(" | "), "subtype").alias("config")).agg(F.round(F.avg("score"), 9).alias("mean_score"))
    return sinks.of_families(a, ["trees", "linear"], ["mean_score"])


GATES = {"trees": "score", "inverse": "1 - score", "narrow": "0.5 + (score - 0.5) / 2", "coarse": "round(score * 4) / 4"}


@query(f"""WITH {EMAILS}, {PREDICTIONS}, x AS (SELECT e.doc_id, label, tau, gate, CASE gate {' '.join(f"WHEN '{g}' THEN ({c})::DOUBLE" for g, c in GATES.items())} END AS g, CASE WHEN pred = 1 THEN conf ELSE 1 - conf END::DOUBLE AS p FROM emails e JOIN keyed k USING (doc_id) LEFT JOIN predictions USING (key), (SELECT unnest([60, 75, 90]) AS tau), (SELECT unnest({list(GATES)}) AS gate)),
r AS (SELECT *, greatest(g, 1 - g) < tau / 100.0::DOUBLE AS routed FROM x), f AS (SELECT gate, tau, label, routed, p IS NULL AS uncovered, round(CASE WHEN routed THEN p ELSE g END, 6) AS score FROM r),
d AS (SELECT gate, tau, score, sum(label) AS p, count(*) AS n FROM f WHERE score IS NOT NULL GROUP BY 1, 2, 3), c AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(p) OVER (PARTITION BY gate, tau) AS tp, sum(n) OVER (PARTITION BY gate, tau) AS tn FROM d WINDOW w AS (PARTITION BY gate, tau ORDER BY score DESC)),
m AS (SELECT gate, tau, CASE WHEN max(tp) > 0 AND max(tp) < max(tn) THEN round(sum(cp / cn * p) / max(tp), 6) END AS aucpr FROM c GROUP BY 1, 2), s AS (SELECT gate, tau, count(*) FILTER (routed) AS routed, count(*) FILTER (routed AND uncovered) AS uncovered FROM f GROUP BY 1, 2) SELECT * FROM s JOIN m USING (gate, tau)""")
def router_gate_sweep(spark, sf_dir):
    """Four gates at three thresholds before a second tier of stored scores: rows sent on, those without a score, average precision."""
    e = views.emails(spark, sf_dir).withColumn("key", replies.cache_key(F.col("text"), views.MODEL, views.PROMPT)).join(views.predictions(spark, sf_dir), "key", "left")
    gates = F.explode(F.array(*[F.struct(F.lit(name).alias("gate"), F.expr(f"double({c})").alias("g")) for name, c in GATES.items()]))
    e = e.select("label", replies.positive_probability(F.col("pred"), F.col("conf")).alias("p"), gates.alias("x")).select("label", "p", "x.*", F.explode(F.array(*map(F.lit, (60, 75, 90)))).alias("tau"))
    e = e.withColumn("routed", replies.routed(F.col("g"), F.col("tau") / 100)).withColumn("score", F.round(F.when(F.col("routed"), F.col("p")).otherwise(F.col("g")), 6))
    sent = e.groupBy("gate", "tau").agg(F.count_if("routed").alias("routed"), F.count_if(F.col("routed") & F.col("p").isNull()).alias("uncovered"))
    return sent.join(metrics.ranking(metrics.prefix_counts(e, ["gate", "tau"]), ["gate", "tau"]).select("gate", "tau", "aucpr"), ["gate", "tau"])
