"""All registered queries and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamis.functions import email, network, replies
from tamis.operators import learn, metrics, prevalence, report, sources, splits, sweeps

from . import views
from .views import EMAILS, PACKETS, PREDICTIONS

QUERIES: dict = {}
ORACLE: dict = {}


def query(oracle: str | None = None):
    def add(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are named {f.__name__}")
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


NORM = r"trim(regexp_replace(lower(regexp_replace(coalesce(text, ''), '[^\P{C}\n\t]|[\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]', '', 'g')), '\s+', ' ', 'g'))"
TEMPLATE = r"substr(sha256(array_to_string(string_split(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(norm, 'https?://\S+|www\.\S+', ' <url> ', 'g'), '[a-zA-Z0-9_.+-]+@[a-zA-Z0-9_-]+\.[a-zA-Z0-9_.-]+', ' <email> ', 'g'), '[0-9]+', '<num>', 'g'), '\s+', ' ', 'g')), ' ')[1:25], ' ')), 1, 24)"
RULES = {"phishing": ("phishing", "confirmed"), "ham": ("ham", "confirmed"), "bulk_spam": ("bulk_spam", "proxy"), "*": ("unknown_nonphishing", "unknown")}


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E-mails with hash and template group, made from the text before the labels are joined, so that texts that nobody reads
    stay out of that join."""
    d = views.spread(views.read(spark, sf_dir, "documents")).withColumn("norm", email.normalize_text(F.col("text")))
    d = d.withColumns({"content_hash": email.content_hash(F.col("norm")), "template_group": email.template_key(F.col("norm"))})
    return views.labelled(d, views.read(spark, sf_dir, "labels"), "norm", "content_hash", "template_group")


ANNOTATED = f"{EMAILS}, n AS (SELECT *, {NORM} AS norm FROM emails), annotated AS (SELECT *, sha256(norm) AS content_hash, {TEMPLATE} AS template_group FROM n)"


@query(f"""WITH {ANNOTATED} SELECT doc_id, content_hash, template_group, CASE WHEN subtype IN ('phishing', 'ham', 'bulk_spam') THEN subtype ELSE 'unknown_nonphishing' END AS mapped_subtype,
 CASE WHEN subtype IN ('phishing', 'ham') THEN 'confirmed' WHEN subtype = 'bulk_spam' THEN 'proxy' ELSE 'unknown' END AS confidence, label AS strict_label, CAST(subtype IN ('phishing', 'scam_fraud') AS INT) AS broad_label FROM annotated""")
def email_annotate(spark, sf_dir):
    m = email.mapped(F.upper("subtype"), RULES)
    return annotated(spark, sf_dir).withColumn("m", m).select("doc_id", "content_hash", "template_group", F.col("m.subtype").alias("mapped_subtype"), F.col("m.confidence").alias("confidence"), email.label_policy(F.col("subtype")).alias("strict_label"), email.label_policy(F.col("subtype"), "broad_malicious").alias("broad_label"))


@query(r"""SELECT doc_id, length(regexp_replace(regexp_replace(regexp_replace(t, '\b[\w.\-]+@enron\.com\b', '', 'gi'), '\bforwarded by\b', '', 'gi'), '\benron\b', '', 'gi')) AS chars_left FROM (SELECT doc_id, 'Forwarded by a.b@enron.com ' || coalesce(text, '') || ' Enron' AS t FROM documents)""")
def email_strip_provenance(spark, sf_dir):
    t = F.concat(F.lit("Forwarded by a.b@enron.com "), F.coalesce("text", F.lit("")), F.lit(" Enron"))
    return views.read(spark, sf_dir, "documents").select("doc_id", F.length(email.strip_provenance(t)).alias("chars_left"))


def _feature_sql(source: str, key: str, col: str) -> str:
    has = lambda words: " + ".join(f"CAST(contains(low, '{w}') AS INT)" for w in words)
    phrases = ", ".join(f"{has(ws)} AS {name}" for name, ws in email.PHRASES.items())
    tld = " OR ".join(f"ends_with(rtrim(u, '/'), '{x}') OR contains(u, '{x}/')" for x in email.SUSPICIOUS_TLDS)
    short = " OR ".join(f"contains(u, '{x}')" for x in email.SHORTENERS)
    n = lambda c, rx: f"len(regexp_extract_all({c}, '{rx}'))"
    return rf"""WITH s AS (SELECT {key}, coalesce({col}, '') AS t, lower(coalesce({col}, '')) AS low FROM {source}),
w AS (SELECT *, regexp_extract_all(t, '[^\s]+') AS words, regexp_extract_all(low, 'https?://[^\s]+') AS urls FROM s),
h AS (SELECT {key}, sum(c * log2(c)) AS s FROM (SELECT {key}, ch, count(*)::DOUBLE AS c FROM (SELECT {key}, unnest(string_split(t, '')) AS ch FROM s) GROUP BY ALL) GROUP BY 1)
SELECT w.{key}, length(t) AS text_length, len(words) AS word_count, round(CASE WHEN len(words) > 0 THEN length(regexp_replace(t, '\s', '', 'g')) / len(words) ELSE 0 END, 6) AS avg_word_length, len(urls) AS url_count, CAST(len(urls) > 0 AS INT) AS has_url,
 len([u FOR u IN urls IF {short}]) AS shortened_url_count, len([u FOR u IN urls IF regexp_matches(u, 'https?://[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}')]) AS ip_url_count, len([u FOR u IN urls IF {tld}]) AS suspicious_tld_count, round(len(urls) / greatest(len(words), 1), 6) AS url_to_text_ratio,
 {phrases}, CAST({has(email.GREETINGS)} > 0 AS INT) AS has_generic_greeting, {n('t', '!')} AS exclamation_count, {n('t', '[?]')} AS question_count, {n('t', '[$]')} AS dollar_sign_count, {n('t', '@')} AS at_sign_count,
 round(coalesce((length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g'))) / nullif(length(t) - length(regexp_replace(t, '\p{{L}}', '', 'g')), 0), 0), 6) AS uppercase_ratio, round(coalesce((length(t) - length(regexp_replace(t, '\p{{Nd}}', '', 'g'))) / nullif(length(t), 0), 0), 6) AS numeric_ratio,
 {n('t', '<[^>]+>')} AS html_tag_count, {n('low', '<form[\\s>]'.replace(chr(92) * 2, chr(92)))} AS form_tag_count, {n('low', 'onclick|onload|onmouseover|onerror|javascript:')} AS js_event_handler_count, {n('t', '[a-zA-Z]+[@$!0-9]+[a-zA-Z]+')} AS leetspeak_count, CAST(regexp_matches(t, '[A-Za-z0-9+/]{{20,}}={{0,2}}') AS INT) AS has_base64,
 round(CASE WHEN length(t) > 0 THEN log2(length(t)) - h.s / length(t) ELSE 0 END, 4) AS char_entropy, round(coalesce(len(list_distinct(regexp_extract_all(low, '[^\s]+'))) / nullif(len(words), 0), 0), 6) AS vocab_richness, length(t) - length(replace(t, chr(10), '')) + 1 AS line_count
FROM w LEFT JOIN h ON h.{key} = w.{key}"""


def _features(rows: DataFrame, key: str, col: str) -> DataFrame:
    f = email.features(F.col(col))
    places = {"char_entropy": 4}
    return rows.select(key, *[F.round(v, places.get(k, 6)).alias(k) if k in ("avg_word_length", "url_to_text_ratio", "uppercase_ratio", "numeric_ratio", "char_entropy", "vocab_richness") else v.alias(k) for k, v in f.items()])


@query(_feature_sql("documents", "doc_id", "text"))
def email_features(spark, sf_dir):
    return _features(views.spread(views.read(spark, sf_dir, "documents")), "doc_id", "text")


@query(_feature_sql("pages", "page_id", "html"))
def page_features(spark, sf_dir):
    return _features(views.spread(views.read(spark, sf_dir, "pages")), "page_id", "html")


@query(f"""WITH {ANNOTATED}, r AS (SELECT doc_id, source, template_group, content_hash, row_number() OVER (PARTITION BY content_hash ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY content_hash) AS copies FROM annotated),
x AS (SELECT content_hash, count(DISTINCT source) AS sources FROM annotated GROUP BY 1) SELECT doc_id, copies, sources, CAST(sources > 1 AS INT) AS cross_source, template_group FROM r JOIN x USING (content_hash) WHERE rn = 1""")
def email_dedup_keep_first(spark, sf_dir):
    g = annotated(spark, sf_dir).groupBy("content_hash").agg(F.min_by(F.struct("doc_id", "template_group"), "doc_id").alias("f"), F.count("*").alias("copies"), F.countDistinct("source").alias("sources"))
    return g.select("f.doc_id", "copies", "sources", (F.col("sources") > 1).cast("int").alias("cross_source"), "f.template_group")


@query(f"""WITH {ANNOTATED}, g AS (SELECT template_group, count(*) AS n FROM annotated GROUP BY 1) SELECT count(*) AS groups, max(n) AS largest, round(avg(n), 6) AS mean_size, count(*) FILTER (n > 1) AS groups_over_one FROM g""")
def email_group_report(spark, sf_dir):
    g = annotated(spark, sf_dir).groupBy("template_group").agg(F.count("*").alias("n"))
    return g.agg(F.count("*").alias("groups"), F.max("n").alias("largest"), F.round(F.avg("n"), 6).alias("mean_size"), F.count_if(F.col("n") > 1).alias("groups_over_one"))


@query(f"""WITH {EMAILS} SELECT coalesce(source, 'all') AS source, coalesce(subtype, 'all') AS subtype, coalesce(label, -1) AS label, count(*) AS n FROM emails GROUP BY GROUPING SETS ((emails.source), (emails.subtype), (emails.label), (emails.source, emails.subtype))""")
def value_counts(spark, sf_dir):
    e = views.emails(spark, sf_dir)
    return e.groupingSets([[F.col("source")], [F.col("subtype")], [F.col("label")], [F.col("source"), F.col("subtype")]], "source", "subtype", "label").agg(F.count("*").alias("n")).select(F.coalesce("source", F.lit("all")).alias("source"), F.coalesce("subtype", F.lit("all")).alias("subtype"), F.coalesce("label", F.lit(-1)).alias("label"), "n")


PART = """u AS (SELECT *, CAST('0x' || substr(sha256(salt || ':' || template_group), 1, 8) AS BIGINT)::DOUBLE / 4294967295 AS u FROM annotated, (SELECT '42' AS salt)),
parts AS (SELECT *, CASE WHEN u < 0.6 THEN 'train' WHEN u < 0.8 THEN 'cal' ELSE 'test' END AS part FROM u)"""


def partitioned(spark, sf_dir):
    return splits.group_partition(annotated(spark, sf_dir), "template_group", {"train": 0.6, "cal": 0.2, "test": 0.2}, ["ham"], salts=3)


@query(f"WITH {ANNOTATED}, {PART} SELECT doc_id, part FROM parts")
def split_hashed_groups(spark, sf_dir):
    return partitioned(spark, sf_dir).select("doc_id", "part")


@query(f"""WITH {ANNOTATED}, h AS (SELECT coalesce(source, '(none)') AS source, content_hash AS k FROM annotated GROUP BY ALL) SELECT a.source AS part_a, b.source AS part_b, count(*) AS shared FROM h a JOIN h b ON a.k = b.k AND a.source < b.source GROUP BY 1, 2""")
def partition_overlap(spark, sf_dir):
    """Hashes that two sources share; rows without a source are a part of their own."""
    rows = annotated(spark, sf_dir).select("content_hash", F.coalesce("source", F.lit("(none)")).alias("part"))
    return splits.partition_overlap(rows, "content_hash")


@query(f"""WITH {ANNOTATED}, {PART}, k AS (SELECT part, 'h' AS kind, content_hash AS k FROM parts UNION SELECT part, 'g', template_group FROM parts), pn AS (SELECT unnest(['train', 'cal', 'test']) AS part),
s AS (SELECT a.part AS part_a, b.part AS part_b, count(*) FILTER (a.kind = 'h') AS hash_overlap, count(*) FILTER (a.kind = 'g') AS group_overlap FROM k a JOIN k b ON a.kind = b.kind AND a.k = b.k AND a.part < b.part GROUP BY 1, 2),
o AS (SELECT a.part AS part_a, b.part AS part_b, coalesce(hash_overlap, 0) AS hash_overlap, coalesce(group_overlap, 0) AS group_overlap FROM pn a JOIN pn b ON a.part < b.part LEFT JOIN s ON s.part_a = a.part AND s.part_b = b.part)
SELECT *, sum(hash_overlap + group_overlap) OVER () = 0 AS clean FROM o""")
def partition_overlap_report(spark, sf_dir):
    return splits.overlap_report(partitioned(spark, sf_dir), ["train", "cal", "test"], {"hash_overlap": "content_hash", "group_overlap": "template_group"})


@query(f"""WITH {EMAILS}, r AS (SELECT doc_id, subtype, row_number() OVER (PARTITION BY subtype ORDER BY sha256('42:' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY subtype) AS n FROM emails)
SELECT doc_id, CASE WHEN r <= round(n * 0.25::DOUBLE) THEN 'test' ELSE 'train' END AS part, (r - 1) % 5 AS fold, CAST(r <= greatest(1, round(n * 0.1::DOUBLE)) AS INT) AS in_subset, CAST(r <= 20 AS INT) AS in_balanced FROM r""")
def split_stratified(spark, sf_dir):
    r = splits.ranked(views.emails(spark, sf_dir), ["subtype"], "doc_id", "42")
    n = F.col("class_size")
    return r.select("doc_id", F.when(F.col("rank") <= F.round(n * F.lit(0.25)), "test").otherwise("train").alias("part"), ((F.col("rank") - 1) % 5).alias("fold"), (F.col("rank") <= F.greatest(F.lit(1), F.round(n * F.lit(0.1)))).cast("int").alias("in_subset"), (F.col("rank") <= 20).cast("int").alias("in_balanced"))


FIRST = f"""{PACKETS}, r AS (SELECT *, row_number() OVER (ORDER BY time_us, event_id) <= floor(count(*) OVER () * 0.8::DOUBLE) AS train FROM packets)"""


@query(f"""WITH {FIRST} SELECT CASE WHEN train THEN 'train' ELSE 'test' END AS part, count(*) AS n, sum(label)::BIGINT AS positives, min(time_us) AS first_us, max(time_us) AS last_us FROM r GROUP BY 1""")
def split_temporal(spark, sf_dir):
    s = splits.temporal_split(views.packets(spark, sf_dir), "time_us", "event_id")
    return s.groupBy("part").agg(F.count("*").alias("n"), F.sum("label").alias("positives"), F.min("time_us").alias("first_us"), F.max("time_us").alias("last_us"))


@query(f"""WITH {FIRST}, g AS (SELECT count(*) FILTER (train) AS n_train, count(*) FILTER (NOT train) AS n_test, max(time_us) FILTER (train) AS cutoff_time, min(time_us) FILTER (NOT train) AS test_time_min,
 round(avg(label) FILTER (train), 6) AS train_prior, round(avg(label) FILTER (NOT train), 6) AS test_prior FROM r) SELECT *, cutoff_time <= test_time_min AS in_order FROM g""")
def split_temporal_report(spark, sf_dir):
    return splits.temporal_report(splits.temporal_split(views.packets(spark, sf_dir), "time_us", "event_id"), "time_us")


@query(f"""WITH {ANNOTATED}, g AS (SELECT template_group, sum(label) AS p, count(*) AS n, sha256('42:' || template_group) AS h FROM annotated GROUP BY 1), b AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (SELECT greatest(1, ceil(count(*) / 50000.0))::BIGINT FROM g) AS b FROM g),
r AS (SELECT template_group, (row_number() OVER (PARTITION BY b ORDER BY p DESC, n DESC, h) - 1) % 10 AS t FROM b) SELECT doc_id, template_group, label, CASE WHEN t < 5 THEN t ELSE 9 - t END AS fold FROM annotated JOIN r USING (template_group)""")
def split_group_folds(spark, sf_dir):
    return splits.group_folds(annotated(spark, sf_dir), "template_group", 5).select("doc_id", "template_group", "label", "fold")


@query(f"""WITH {EMAILS}, k AS (SELECT doc_id, subtype, CASE subtype WHEN 'phishing' THEN 'pos' WHEN 'ham' THEN 'ham' WHEN 'bulk_spam' THEN 'hard' WHEN 'scam_fraud' THEN 'hard' END AS kind FROM emails),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY sha256('42:' || doc_id), doc_id) AS r FROM k WHERE kind IS NOT NULL), n AS (SELECT count(*) FILTER (kind = 'ham') AS ham, count(*) FILTER (kind = 'hard') AS hard FROM r), b AS (SELECT *, least(round(0.1::DOUBLE * ham), hard) AS kk FROM r, n),
c AS (SELECT doc_id, subtype, 'A' AS condition FROM b WHERE kind IN ('pos', 'ham') UNION ALL SELECT doc_id, subtype, 'B' FROM b WHERE kind = 'pos' OR (kind = 'ham' AND r <= ham - kk) OR (kind = 'hard' AND r <= kk) UNION ALL SELECT doc_id, subtype, 'C' FROM b WHERE kind IN ('pos', 'ham') OR (kind = 'hard' AND r <= kk)) SELECT * FROM c""")
def hard_negative_conditions(spark, sf_dir):
    return splits.hard_negatives(views.emails(spark, sf_dir), 0.1, "doc_id").select("doc_id", "subtype", "condition")


CORPORA = """corpora AS (SELECT *, CASE CAST(substr(source, 4) AS INT) % 3 WHEN 0 THEN source || '-' || subtype WHEN 1 THEN 'only-' || source || '-' || subtype ELSE source END AS source_corpus FROM emails),
rc AS (SELECT source_corpus AS source, count(*) AS n, count(*) FILTER (subtype = 'phishing') AS phishing, count(*) FILTER (subtype = 'ham') AS ham, count(*) FILTER (subtype = 'bulk_spam') AS bulk_spam, count(*) FILTER (subtype = 'scam_fraud') AS scam_fraud,
 count(*) FILTER (subtype = 'unknown_nonphishing') AS unknown_nonphishing FROM corpora WHERE source_corpus IS NOT NULL GROUP BY 1),
roles AS (SELECT *, CASE WHEN phishing / n >= 0.9::DOUBLE THEN 'phishing' WHEN ham / n >= 0.9::DOUBLE THEN 'ham' WHEN (bulk_spam + scam_fraud) / n >= 0.9::DOUBLE THEN 'spam_like' WHEN unknown_nonphishing / n >= 0.9::DOUBLE THEN 'unknown_negative' ELSE 'mixed' END AS role FROM rc)"""


def corpora(spark, sf_dir):
    """E-mails of source corpora of three kinds: partitions of one collection, collections of one subtype, mixed ones."""
    k = F.substring("source", 4, 9).cast("int") % 3
    part = F.concat_ws("-", "source", "subtype")
    return views.emails(spark, sf_dir).withColumn("source_corpus", F.when(k == 0, part).when(k == 1, F.concat(F.lit("only-"), part)).otherwise(F.col("source")))


@query(f"WITH {EMAILS}, {CORPORA} SELECT * FROM roles")
def source_roles(spark, sf_dir):
    return sources.source_roles(corpora(spark, sf_dir), "source_corpus", 0.9)


@query(f"""WITH {EMAILS}, {CORPORA}, f AS (SELECT *, CASE WHEN source LIKE 'only-%' THEN source ELSE split_part(source, '-', 1) END AS family FROM roles), ok AS (SELECT * FROM f WHERE n >= 2),
b AS (SELECT d.source AS phishing_source, e.source AS ham_source, s.source AS spam_scam_source, d.n AS phishing_rows, e.n AS ham_rows, s.n AS spam_scam_rows, round(d.phishing / d.n, 4) AS phishing_share, round(e.ham / e.n, 4) AS ham_share, round((s.bulk_spam + s.scam_fraud) / s.n, 4) AS spam_scam_share,
 d.family AS df, e.family AS ef, s.family AS sf FROM ok d, ok e, ok s WHERE d.role = 'phishing' AND e.role = 'ham' AND s.role = 'spam_like'),
rest AS (SELECT b.*, (SELECT count(DISTINCT role) FROM f WHERE role IN ('phishing', 'ham', 'spam_like') AND source NOT IN (phishing_source, ham_source, spam_scam_source)) AS roles_left,
 (SELECT list(DISTINCT family) FROM f WHERE source NOT IN (phishing_source, ham_source, spam_scam_source)) AS dev_families FROM b),
t AS (SELECT *, CASE WHEN list_contains(dev_families, df) THEN 'within-family-partition' ELSE 'family-disjoint' END AS phishing_tier, CASE WHEN list_contains(dev_families, ef) THEN 'within-family-partition' ELSE 'family-disjoint' END AS ham_tier, CASE WHEN list_contains(dev_families, sf) THEN 'within-family-partition' ELSE 'family-disjoint' END AS spam_scam_tier FROM rest WHERE roles_left = 3)
SELECT 'b_' || substr(sha256(phishing_source || '|' || ham_source || '|' || spam_scam_source), 1, 8) AS bundle_id, phishing_source, phishing_rows, phishing_share, phishing_tier, ham_source, ham_rows, ham_share, ham_tier, spam_scam_source, spam_scam_rows, spam_scam_share, spam_scam_tier,
 phishing_tier = 'family-disjoint' AND ham_tier = 'family-disjoint' AND spam_scam_tier = 'family-disjoint' AS fully_family_disjoint, phishing_rows + ham_rows + spam_scam_rows AS held_out_rows, (SELECT sum(n) FROM f)::BIGINT - phishing_rows - ham_rows - spam_scam_rows AS development_rows, (SELECT count(*) FROM f) - 3 AS development_sources FROM t""")
def external_bundles(spark, sf_dir):
    """Triples of pure held-out sources of two rows and more, what is left of every role, and whose family stays in development."""
    family = F.when(F.col("source").startswith("only-"), F.col("source")).otherwise(F.substring_index("source", "-", 1))
    return sources.external_bundles(source_roles(spark, sf_dir), family, 2)


@query(f"""WITH {ANNOTATED}, held AS (SELECT DISTINCT template_group FROM annotated WHERE source = 'src0') SELECT doc_id, CAST(source = 'src0' AS INT) AS held_out FROM annotated WHERE source = 'src0' OR template_group NOT IN (SELECT template_group FROM held)""")
def development_without_held_groups(spark, sf_dir):
    a = annotated(spark, sf_dir)
    held = a.where("source = 'src0'")
    dev = a.where("source <> 'src0' OR source IS NULL").join(held.select("template_group").distinct(), "template_group", "left_anti")
    return held.select("doc_id", F.lit(1).alias("held_out")).unionByName(dev.select("doc_id", F.lit(0).alias("held_out")))


@query(f"""WITH {PACKETS}, t AS (SELECT src_ip AS h FROM packets WHERE event_id % 3 = 0 UNION SELECT dst_ip FROM packets WHERE event_id % 3 = 0), x AS (SELECT protocol, CAST(src_ip IN (SELECT h FROM t) AS INT) AS s, CAST(dst_ip IN (SELECT h FROM t) AS INT) AS d FROM packets WHERE event_id % 3 <> 0)
SELECT protocol, count(*) AS n, sum(s)::BIGINT AS src_seen, sum(d)::BIGINT AS dst_seen, sum(greatest(s, d))::BIGINT AS any_seen FROM x GROUP BY 1""")
def endpoint_membership(spark, sf_dir):
    p = views.packets(spark, sf_dir)
    train, test = p.where("event_id % 3 = 0"), p.where("event_id % 3 <> 0")
    seen = train.select(F.col("src_ip").alias("h")).union(train.select("dst_ip")).distinct().withColumn("hit", F.lit(1))
    x = test.join(seen.select(F.col("h").alias("src_ip"), F.col("hit").alias("s")), "src_ip", "left").join(seen.select(F.col("h").alias("dst_ip"), F.col("hit").alias("d")), "dst_ip", "left").fillna(0, ["s", "d"])
    return x.groupBy("protocol").agg(F.count("*").alias("n"), F.sum("s").alias("src_seen"), F.sum("d").alias("dst_seen"), F.sum(F.greatest("s", "d")).alias("any_seen"))


FLOWS = f"""{PACKETS}, g AS (SELECT *, time_us - lag(time_us) OVER (PARTITION BY src_ip, dst_ip, src_port, dst_port, protocol_int ORDER BY time_us, event_id) AS gap FROM packets),
f0 AS (SELECT src_ip, dst_ip, src_port, dst_port, protocol_int, any_value(protocol) AS protocol, count(*) AS pkt_count, sum(pkt_len)::BIGINT AS total_bytes, max(pkt_len) AS max_pkt_len, min(time_us) AS start_us, max(time_us) - min(time_us) AS duration_us, count(gap) AS gaps, sum(gap::HUGEINT)::DOUBLE AS s1, sum(gap::HUGEINT * gap)::DOUBLE AS s2, sum(syn)::BIGINT AS syn_count, sum(ack)::BIGINT AS ack_count, avg(ttl) AS mean_ttl, max(label) AS label FROM g GROUP BY 1, 2, 3, 4, 5),
flows AS (SELECT *, total_bytes / pkt_count AS mean_pkt_len, duration_us / 1000 AS duration_ms, CASE WHEN gaps > 0 THEN s1 / gaps / 1000 ELSE 0 END AS mean_iat_ms, CASE WHEN gaps > 1 THEN sqrt(greatest(0, s2 / gaps - (s1 / gaps) * (s1 / gaps))) / 1000 ELSE 0 END AS std_iat_ms FROM f0)"""
KEYS = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol_int"]


def flow_table(spark, sf_dir):
    return network.flows(views.packets(spark, sf_dir), order=["event_id"]).withColumn("protocol", network.protocol_name(F.col("protocol_int").cast("int")))


@query(f"WITH {FLOWS} SELECT src_ip, dst_ip, src_port, dst_port, protocol_int, protocol, pkt_count, total_bytes, max_pkt_len, round(mean_pkt_len, 4) AS mean_pkt_len, duration_us, round(mean_iat_ms, 1) AS mean_iat_ms, round(std_iat_ms, 0) AS std_iat_ms, syn_count, ack_count, 0::BIGINT AS fin_count, 0::BIGINT AS rst_count, 0::BIGINT AS psh_count, start_us, round(mean_ttl, 4) AS mean_ttl, label FROM flows")
def packet_flows(spark, sf_dir):
    return flow_table(spark, sf_dir).select(*KEYS, "protocol", "pkt_count", "total_bytes", "max_pkt_len", F.round("mean_pkt_len", 4).alias("mean_pkt_len"), "duration_us", F.round("mean_iat_ms", 1).alias("mean_iat_ms"), F.round("std_iat_ms", 0).alias("std_iat_ms"), "syn_count", "ack_count", "fin_count", "rst_count", "psh_count", "start_us", F.round("mean_ttl", 4).alias("mean_ttl"), "label")


@query(f"WITH {PACKETS} SELECT event_id, coalesce(time_us - lag(time_us) OVER (PARTITION BY dst_ip ORDER BY time_us, event_id), 0) AS interarrival_us, CAST(syn AS INT) AS tcp_flag_syn, src_ip || '_' || dst_ip || '_' || src_port || '_' || dst_port || '_' || protocol_int AS flow_id FROM packets")
def packet_interarrival(spark, sf_dir):
    return network.interarrival(views.packets(spark, sf_dir), ["dst_ip"], ["time_us", "event_id"]).select("event_id", "interarrival_us", "tcp_flag_syn", network.flow_id(*KEYS).alias("flow_id"))


@query(f"""WITH {PACKETS}, r AS (SELECT src_ip, dst_ip, pkt_len, row_number() OVER (PARTITION BY src_ip, dst_ip ORDER BY time_us, event_id) AS r FROM packets), a AS (SELECT src_ip, dst_ip, list(pkt_len ORDER BY r) AS v FROM r WHERE r <= 4 GROUP BY 1, 2)
SELECT src_ip, dst_ip, array_to_string(list_resize(v, 4, 0), ',') AS first_values FROM a""")
def flow_first_packets(spark, sf_dir):
    f = network.first_packets(views.packets(spark, sf_dir), 4, ["src_ip", "dst_ip"], ["time_us", "event_id"], "pkt_len")
    return f.select("src_ip", "dst_ip", F.array_join(F.col("first_values").cast("array<string>"), ",").alias("first_values"))


PORT_SQL = lambda c: f"{c} || CASE {c} " + " ".join(f"WHEN {p} THEN '({n})'" for p, n in network.PORTS.items()) + " ELSE '' END"


NUMBER_SQL = lambda c, digits: f"format('{{{{:.{digits}f}}}}', ({c})::DOUBLE)"


@query(f"""WITH {FLOWS} SELECT src_ip, dst_ip, src_port, dst_port, protocol_int, 'A ' || protocol || ' flow from port ' || {PORT_SQL('src_port')} || ' to port ' || {PORT_SQL('dst_port')} || ', with ' || pkt_count || ' packets totaling ' || total_bytes || ' bytes over ' || {NUMBER_SQL('duration_ms', 1)}
 || ' ms (mean inter-arrival ' || {NUMBER_SQL('mean_iat_ms', 2)} || ' ms, std ' || {NUMBER_SQL('std_iat_ms', 2)} || ' ms; mean packet size ' || {NUMBER_SQL('mean_pkt_len', 0)} || ' bytes)' || CASE WHEN protocol = 'TCP' THEN '. TCP flags observed: SYN=' || syn_count || ', ACK=' || ack_count || ', FIN=0, RST=0, PSH=0' ELSE '' END || '.' AS sentence,
 'Network flow: proto=' || protocol || ', src=' || {PORT_SQL('src_port')} || ', dst=' || {PORT_SQL('dst_port')} || ', pkts=' || pkt_count || ', bytes=' || total_bytes || ', duration_ms=' || {NUMBER_SQL('duration_ms', 1)} || ', mean_iat_ms=' || {NUMBER_SQL('mean_iat_ms', 2)} || ', std_iat_ms=' || {NUMBER_SQL('std_iat_ms', 2)} || ', mean_pkt_len=' || {NUMBER_SQL('mean_pkt_len', 1)}
 || CASE WHEN protocol = 'TCP' THEN ', flags=[SYN:' || syn_count || ' ACK:' || ack_count || ' FIN:0 RST:0]' ELSE '' END AS pairs FROM flows""".replace("{{", "{").replace("}}", "}"))
def flow_serialize(spark, sf_dir):
    """Both texts of a flow, whole."""
    return flow_table(spark, sf_dir).select(*KEYS, network.flow_sentence().alias("sentence"), network.flow_pairs().alias("pairs"))


def netflow_rows(spark, sf_dir):
    n = network.derived(views.netflow(spark, sf_dir))
    return n.withColumns({"sport": network.port(F.col("sport_raw")), "dport": network.port(F.col("dport_raw")), "label_kind": network.label_kind(F.col("label_raw"))})


NETFLOW = """netflow AS (SELECT l_orderkey, l_linenumber, CAST(substr(o_orderpriority, 1, 1) AS INT) AS scenario, '147.32.' || l_suppkey AS host, l_shipdate AS start_time, CASE l_linestatus WHEN 'O' THEN 6 ELSE 17 END AS proto_int, CASE l_returnflag WHEN 'A' THEN '->' WHEN 'N' THEN '<->' ELSE '<-' END AS dir,
 CASE WHEN l_linenumber = 2 THEN -1 ELSE l_partkey % 65536 END AS sport, CAST(l_quantity AS BIGINT) AS tot_pkts, CAST(floor(l_extendedprice) AS BIGINT) AS tot_bytes, CAST(floor(l_extendedprice / 3) AS BIGINT) AS src_bytes, CASE l_returnflag WHEN 'R' THEN 'Botnet' WHEN 'A' THEN 'Normal' ELSE 'Background' END AS label_kind, CAST(l_returnflag = 'R' AS INT) AS label FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query(f"""WITH {NETFLOW} SELECT l_orderkey, l_linenumber, scenario, sport, 80 AS dport, label_kind, proto_int, CAST(dir = '->' AS INT) AS dir_fwd, CAST(dir = '<-' AS INT) AS dir_bwd, CAST(dir = '<->' AS INT) AS dir_bi, round(tot_bytes / nullif(tot_pkts, 0), 4) AS bytes_per_pkt, round(src_bytes / nullif(tot_bytes, 0), 6) AS src_byte_ratio, label FROM netflow WHERE label_kind <> 'Background'""")
def netflow_load(spark, sf_dir):
    n = netflow_rows(spark, sf_dir).where("label_kind <> 'Background'")
    return n.select("l_orderkey", "l_linenumber", "scenario", "sport", "dport", "label_kind", "proto_int", "dir_fwd", "dir_bwd", "dir_bi", F.round("bytes_per_pkt", 4).alias("bytes_per_pkt"), F.round("src_byte_ratio", 6).alias("src_byte_ratio"), "label")


@query(f"""WITH {NETFLOW}, s AS (SELECT scenario, count(*) AS n, sum(label)::BIGINT AS n_pos, epoch(max(start_time)) - epoch(min(start_time)) AS span, count(DISTINCT host) AS hosts FROM netflow GROUP BY 1) SELECT scenario, n, n_pos, round(n_pos / n, 6) AS prior, round((n - n_pos) / greatest(n_pos, 1), 6) AS pos_weight, round(span / 3600.0, 4) AS hours, hosts, round((SELECT sum(span) FROM s) / 3600.0, 4) AS all_hours FROM s""")
def netflow_capture_stats(spark, sf_dir):
    s = views.netflow(spark, sf_dir).groupBy("scenario").agg(F.count("*").alias("n"), F.sum("label").alias("n_pos"), ((F.unix_micros(F.max("start_time").cast("timestamp")) - F.unix_micros(F.min("start_time").cast("timestamp"))) / 1000000).alias("span"), F.countDistinct("host").alias("hosts"))
    total = s.agg(F.sum("span").alias("t"))
    return s.crossJoin(F.broadcast(total)).select("scenario", "n", "n_pos", F.round(F.col("n_pos") / F.col("n"), 6).alias("prior"), F.round((F.col("n") - F.col("n_pos")) / F.greatest("n_pos", F.lit(1)), 6).alias("pos_weight"), F.round(F.col("span") / 3600, 4).alias("hours"), "hosts", F.round(F.col("t") / 3600, 4).alias("all_hours"))


@query(f"""WITH {PREDICTIONS} SELECT k.doc_id, k.key, coalesce(p.pred, -1) AS pred, round(CASE WHEN p.pred = 1 THEN p.conf ELSE 1 - p.conf END, 6) AS p_positive, CAST(p.key IS NOT NULL AS INT) AS covered FROM keyed k LEFT JOIN predictions p USING (key)""")
def prediction_join(spark, sf_dir):
    d = views.read(spark, sf_dir, "documents").select("doc_id", replies.cache_key(F.col("text"), views.MODEL, views.PROMPT).alias("key"))
    j = d.join(views.predictions(spark, sf_dir).withColumn("covered", F.lit(1)), "key", "left")
    return j.select("doc_id", "key", F.coalesce("pred", F.lit(-1)).alias("pred"), F.round(replies.positive_probability(F.col("pred"), F.col("conf")), 6).alias("p_positive"), F.coalesce("covered", F.lit(0)).alias("covered"))


@query(f"""WITH {EMAILS}, {PREDICTIONS}, m AS (SELECT source, key, count(*) OVER (PARTITION BY key) AS n FROM emails JOIN keyed USING (doc_id)) SELECT source, count(DISTINCT key) AS wanted, count(DISTINCT key) FILTER (key NOT IN (SELECT key FROM predictions)) AS missing FROM m GROUP BY 1""")
def cache_miss_plan(spark, sf_dir):
    d = views.read(spark, sf_dir, "documents").select("source", replies.cache_key(F.col("text"), views.MODEL, views.PROMPT).alias("key")).distinct()
    miss = d.join(views.predictions(spark, sf_dir).select("key", F.lit(1).alias("have")), "key", "left")
    return miss.groupBy("source").agg(F.count("*").alias("wanted"), F.count_if(F.col("have").isNull()).alias("missing"))


def _sweep(spark, sf_dir):
    e = views.emails(spark, sf_dir).withColumn("key", replies.cache_key(F.col("text"), views.MODEL, views.PROMPT))
    e = e.join(views.predictions(spark, sf_dir), "key", "left").withColumn("p", replies.positive_probability(F.col("pred"), F.col("conf")))
    taus = spark.createDataFrame([(60,), (70,), (80,), (90,)], "tau int")
    e = e.crossJoin(F.broadcast(taus))
    far = replies.routed(F.col("score"), F.col("tau") / 100)
    return e.withColumns({"routed": far, "final": F.when(far, F.col("p")).otherwise(F.col("score"))})


@query(f"""WITH {EMAILS}, {PREDICTIONS}, x AS (SELECT e.doc_id, label, score, tau, CASE WHEN pred = 1 THEN conf ELSE 1 - conf END AS p FROM emails e JOIN keyed k USING (doc_id) LEFT JOIN predictions USING (key), (SELECT unnest([60, 70, 80, 90]) AS tau)),
r AS (SELECT *, greatest(score, 1 - score) < tau / 100.0 AS routed FROM x), f AS (SELECT *, CASE WHEN routed THEN p ELSE score END AS final FROM r)
SELECT tau, count(*) AS n, count(*) FILTER (routed) AS routed, count(*) FILTER (routed AND p IS NULL) AS uncovered, count(*) FILTER (final >= 0.5 AND label = 1) AS tp, count(*) FILTER (final >= 0.5 AND label = 0) AS fp, count(*) FILTER (final < 0.5 AND label = 1) AS fn FROM f GROUP BY 1""")
def router_sweep(spark, sf_dir):
    s, hit, pos = _sweep(spark, sf_dir), F.col("final") >= 0.5, F.col("label") == 1
    return s.groupBy("tau").agg(F.count("*").alias("n"), F.count_if("routed").alias("routed"), F.count_if(F.col("routed") & F.col("p").isNull()).alias("uncovered"), F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"))


REPLIES = "CASE doc_id % 4 WHEN 0 THEN 'Sure: {\"prediction\": 1, \"confidence\": 0.9}' WHEN 1 THEN '{\"prediction\": 1}' WHEN 2 THEN 'this looks like PHISHING' ELSE 'no idea' END"


@query(f"""WITH r AS (SELECT doc_id, {REPLIES} AS reply FROM documents) SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN 0 ELSE 1 END AS pred, CASE doc_id % 4 WHEN 0 THEN 0.9::DOUBLE WHEN 1 THEN 0.5 WHEN 2 THEN 0.6 ELSE 0.5 END AS conf, least(1000, length(text)) + 23 AS prompt_chars FROM r JOIN documents USING (doc_id)""")
def reply_parse(spark, sf_dir):
    d = views.read(spark, sf_dir, "documents").withColumn("reply", F.expr(REPLIES))
    out = replies.parse_reply(F.col("reply"))
    return d.select("doc_id", out["pred"].alias("pred"), out["conf"].alias("conf"), F.length(replies.fill(views.PROMPT, F.col("text"))).alias("prompt_chars"))


COUNTS = f"""{EMAILS}, d AS (SELECT source, score, sum(label) AS p, count(*) AS n FROM emails GROUP BY 1, 2), c AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(p) OVER (PARTITION BY source) AS tp, sum(n) OVER (PARTITION BY source) AS tn FROM d WINDOW w AS (PARTITION BY source ORDER BY score DESC))"""


@query(f"""WITH {COUNTS} SELECT source, max(tn)::BIGINT AS n, max(tp)::BIGINT AS n_pos, CASE WHEN max(tp) > 0 AND max(tp) < max(tn) THEN round(sum(cp / cn * p) / max(tp), 6) END AS aucpr, CASE WHEN max(tp) > 0 AND max(tp) < max(tn) THEN round(sum(p * (2 * ((tn - tp) - (cn - cp)) + n - p)) / 2 / max(tp) / (max(tn) - max(tp)), 6) END AS rocauc FROM c GROUP BY 1""")
def ranking_metrics(spark, sf_dir):
    return metrics.ranking(metrics.prefix_counts(views.emails(spark, sf_dir), ["source"]), ["source"])


W_SQL = lambda k, n, s: f"CASE WHEN {n} > 0 THEN {'greatest(0,' if s == '-' else 'least(1,'} ({k} / {n} + 1.9208 / {n}) / (1 + 3.8416 / {n}) {s} 1.96 * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + 0.9604 / ({n} * {n})) / (1 + 3.8416 / {n})) ELSE {0 if s == '-' else 1} END"
RATES = f"""{EMAILS}, t AS (SELECT *, thr / 100.0 AS threshold FROM emails, (SELECT unnest([30, 50, 70]) AS thr)), r AS (SELECT threshold, count(*) FILTER (score >= threshold AND label = 1)::DOUBLE AS tp, count(*) FILTER (score >= threshold AND label = 0)::DOUBLE AS fp, count(*) FILTER (score < threshold AND label = 1)::DOUBLE AS fn, count(*) FILTER (score < threshold AND label = 0)::DOUBLE AS tn FROM t GROUP BY 1)"""


def _points(spark, sf_dir):
    at = spark.createDataFrame([(0.3,), (0.5,), (0.7,)], "threshold double")
    return views.emails(spark, sf_dir).crossJoin(F.broadcast(at))


@query(f"""WITH {RATES} SELECT threshold::DOUBLE AS threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall, round(fp / (fp + tn), 6) AS fpr, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
 round({W_SQL('tp', '(tp + fp)', '-')}, 6) AS precision_lo, round({W_SQL('tp', '(tp + fp)', '+')}, 6) AS precision_hi, round({W_SQL('tp', '(tp + fn)', '-')}, 6) AS recall_lo, round({W_SQL('tp', '(tp + fn)', '+')}, 6) AS recall_hi, round({W_SQL('fp', '(fp + tn)', '-')}, 6) AS fpr_lo, round({W_SQL('fp', '(fp + tn)', '+')}, 6) AS fpr_hi, (tp + fp)::BIGINT AS alerts FROM r""")
def operating_points(spark, sf_dir):
    return metrics.rates(_points(spark, sf_dir), ["threshold"])


@query(f"""WITH {COUNTS}, a AS (SELECT source, max(score) FILTER (tp > 0 AND cp >= ceil(0.9::DOUBLE * tp)) AS recall_threshold, min(score) FILTER (cp / cn >= 0.08::DOUBLE) AS precision_threshold FROM c GROUP BY 1) SELECT * FROM a""")
def threshold_selection(spark, sf_dir):
    c = metrics.prefix_counts(views.emails(spark, sf_dir), ["source"])
    # both in one grouping, so that a null source is a group as any other
    recall = F.max(F.when((F.col("tp") > 0) & (F.col("cp") >= F.ceil(F.lit(0.9) * F.col("tp"))), F.col("score")))
    precision = F.min(F.when(F.col("cp") / F.col("cn") >= 0.08, F.col("score")))
    return c.groupBy("source").agg(recall.alias("recall_threshold"), precision.alias("precision_threshold"))


@query(f"""WITH {RATES}, x AS (SELECT *, tp / (tp + fn) AS tpr, fp / (fp + tn) AS fpr FROM r, (SELECT unnest([0.01, 0.001]::DOUBLE[]) AS pi)) SELECT threshold::DOUBLE AS threshold, pi AS prior, round(pi * tpr / (pi * tpr + (1 - pi) * fpr), 6) AS precision_at_prior, round(1000 * (1 - pi) * fpr, 4) AS fp_per_1k, round(1000 * (pi * tpr + (1 - pi) * fpr), 4) AS alerts_per_1k FROM x""")
def prior_projection(spark, sf_dir):
    r = metrics.rates(_points(spark, sf_dir), ["threshold"]).crossJoin(F.broadcast(spark.createDataFrame([(0.01,), (0.001,)], "prior double")))
    p = metrics.projected(metrics.ratio(F.col("tp"), F.col("tp") + F.col("fn")), metrics.ratio(F.col("fp"), F.col("fp") + F.col("tn")), F.col("prior"))
    return r.select("threshold", "prior", F.round(p["precision_at_prior"], 6).alias("precision_at_prior"), F.round(p["fp_per_1k"], 4).alias("fp_per_1k"), F.round(p["alerts_per_1k"], 4).alias("alerts_per_1k"))


COND = f"""{EMAILS}, t AS (SELECT *, thr / 100.0 AS threshold FROM emails, (SELECT unnest([30, 50, 70]) AS thr)), cr AS (SELECT threshold::DOUBLE AS threshold, subtype, count(*) FILTER (score >= threshold)::DOUBLE AS k, count(*)::DOUBLE AS n, count(DISTINCT source) AS n_groups FROM t GROUP BY 1, 2), cw AS (SELECT *, k / n AS point, {W_SQL('k', 'n', '-')} AS lo, {W_SQL('k', 'n', '+')} AS hi FROM cr)"""


@query(f"""WITH {COND} SELECT threshold, subtype, k::BIGINT AS numerator, n::BIGINT AS denominator, n_groups, round(point, 6) AS point, round(lo, 6) AS lo, round(hi, 6) AS hi, round(1 / n, 6) AS resolution FROM cw""")
def subtype_rates(spark, sf_dir):
    return metrics.conditional_rates(_points(spark, sf_dir), ["threshold"], "source").select("threshold", "subtype", "numerator", "denominator", "n_groups", *[F.round(c, 6).alias(c) for c in ("point", "lo", "hi", "resolution")])


@query(f"""WITH {COND}, g AS (SELECT threshold, prior, s.share AS spam_share, max(point) FILTER (subtype = 'phishing') AS tpr, max(lo) FILTER (subtype = 'phishing') AS tpr_lo, sum(w * point) AS fm, sum(w * hi) AS fu, sum(w / n) AS res, bool_and(k = 0) FILTER (w > 0) AS zero FROM (SELECT *, CASE subtype WHEN 'ham' THEN 1 - share WHEN 'bulk_spam' THEN share / 2 WHEN 'scam_fraud' THEN share / 2 ELSE 0 END AS w FROM cw, (SELECT unnest([0.0, 0.5]::DOUBLE[]) AS share)) s, (SELECT unnest([0.01, 0.1]::DOUBLE[]) AS prior) GROUP BY 1, 2, 3),
p AS (SELECT *, prior * tpr / (prior * tpr + (1 - prior) * fm) AS pp, prior * tpr_lo / (prior * tpr_lo + (1 - prior) * fu) AS pc, prior * tpr * (1 - 0.9) / (0.9 * (1 - prior)) AS req FROM g)
SELECT threshold, prior, spam_share, round(pp, 6) AS precision_point, round(pc, 6) AS precision_conservative, round(req, 6) AS required_fpr, CASE WHEN pc >= 0.9 THEN 'supported' WHEN req >= res AND NOT zero THEN 'limited' ELSE 'extrapolative' END AS support_status FROM p""")
def deployment_grid(spark, sf_dir):
    g = prevalence.grid(prevalence.wide_rates(_points(spark, sf_dir), ["threshold"], "source"), [0.01, 0.1], [0.0, 0.5])
    return g.select("threshold", "prior", "spam_share", *[F.round(c, 6).alias(c) for c in ("precision_point", "precision_conservative", "required_fpr")], "support_status")


@query(f"""WITH {EMAILS}, g AS (SELECT source AS g, subtype, count(*) AS n, count(*) FILTER (score >= 0.5::DOUBLE) AS k FROM emails GROUP BY 1, 2), u AS (SELECT *, CAST('0x' || substr(sha256('42:' || rep || ':' || g), 1, 8) AS BIGINT)::DOUBLE / 4294967296 AS u FROM g, range(50) t(rep)),
w AS (SELECT *, CASE WHEN u < 0.36787944::DOUBLE THEN 0 WHEN u < 0.73575888::DOUBLE THEN 1 WHEN u < 0.91969860::DOUBLE THEN 2 WHEN u < 0.98101184::DOUBLE THEN 3 WHEN u < 0.99634015::DOUBLE THEN 4 WHEN u < 0.99940582::DOUBLE THEN 5 WHEN u < 0.99991676::DOUBLE THEN 6 ELSE 7 END AS w FROM u),
r AS (SELECT rep, subtype, sum(w * k) AS k, sum(w * n) AS n FROM w GROUP BY 1, 2) SELECT subtype, count(*) AS replicates, round(quantile_cont((k / n)::DOUBLE, 0.025), 6) AS lo, round(quantile_cont((k / n)::DOUBLE, 0.975), 6) AS hi FROM r WHERE n > 0 GROUP BY 1""")
def group_bootstrap(spark, sf_dir):
    e = views.emails(spark, sf_dir).withColumn("threshold", F.lit(0.5))
    return prevalence.bootstrap(e, [], "source", 50)


@query(f"""WITH {EMAILS}, d AS (SELECT label, score::DECIMAL(12,6) AS p, least(CAST(floor(score::DOUBLE * 10) AS INT), 9) AS bin FROM emails), g AS (SELECT bin, count(*) AS n, sum(p) AS sp, sum(label) AS sy, sum((p - label) * (p - label)) AS sq FROM d GROUP BY 1), t AS (SELECT sum(n) AS total, sum(sq)::DOUBLE AS sq, sum(abs(sy - sp))::DOUBLE AS gap FROM g)
SELECT b.bin::INT AS bin, coalesce(g.n, 0) AS n, round(sp::DOUBLE / g.n, 6) AS mean_confidence, round(sy / g.n, 6) AS positive_rate, round(t.sq / total, 6) AS brier, round(gap / total, 6) AS ece FROM range(10) b(bin) LEFT JOIN g ON g.bin = b.bin, t""")
def calibration_table(spark, sf_dir):
    return metrics.calibration(views.emails(spark, sf_dir))


@query(f"""WITH {EMAILS}, tok AS (SELECT DISTINCT doc_id, label, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS tok FROM emails WHERE doc_id % 4 <> 2), n AS (SELECT count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS q FROM emails WHERE doc_id % 4 <> 2), w AS (SELECT tok, ln((count(*) FILTER (label = 1) + 1.0) / (max(p) + 2.0)) - ln((count(*) FILTER (label = 0) + 1.0) / (max(q) + 2.0)) AS w FROM tok, n GROUP BY 1),
s AS (SELECT doc_id, sum(w) AS s FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS tok FROM emails WHERE doc_id % 4 = 2) JOIN w USING (tok) GROUP BY 1) SELECT e.doc_id, round(1 / (1 + exp(-least(30, greatest(-30, coalesce(s, 0))))), 6) AS p FROM emails e LEFT JOIN s USING (doc_id) WHERE e.doc_id % 4 = 2""")
def token_log_odds(spark, sf_dir):
    e = views.emails(spark, sf_dir).select("doc_id", "label", F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), F.lit(0))).alias("toks"))
    train, test = e.where("doc_id % 4 <> 2"), e.where("doc_id % 4 = 2")
    n = train.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("q"))
    w = train.select("label", F.explode("toks").alias("tok")).groupBy("tok").agg(F.count_if(F.col("label") == 1).alias("a"), F.count_if(F.col("label") == 0).alias("b")).crossJoin(F.broadcast(n))
    w = w.select("tok", (F.col("a") + F.col("b")).alias("docs"), (F.log((F.col("a") + 1) / (F.col("p") + 2)) - F.log((F.col("b") + 1) / (F.col("q") + 2))).alias("w"))
    # words that stand in many documents are few: they are looked up where the documents are, the others meet their weight by shuffle
    often = w.orderBy(F.desc("docs"), "tok").limit(2000).select(F.col("tok").alias("_t"), F.col("w").alias("_w"))
    each = test.select("doc_id", F.explode("toks").alias("tok")).join(F.broadcast(often), F.col("tok") == F.col("_t"), "left")
    near = each.where("_t IS NOT NULL").groupBy("doc_id").agg(F.sum("_w").alias("w"))
    far = each.where("_t IS NULL").select("doc_id", "tok").join(w.select("tok", "w"), "tok").groupBy("doc_id").agg(F.sum("w").alias("w"))
    s = near.unionByName(far).groupBy("doc_id").agg(F.sum("w").alias("s"))
    z = F.least(F.lit(30.0), F.greatest(F.lit(-30.0), F.coalesce("s", F.lit(0.0))))
    return test.select("doc_id").join(s, "doc_id", "left").select("doc_id", F.round(1 / (1 + F.exp(-z)), 6).alias("p"))


RUN_LOG = """run_log AS (SELECT event_type AS model, value AS latency_ms, CAST(json_extract_string(props, '$.k') AS BIGINT) + 100 AS tokens_in,
 CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 13 + 1 END AS tokens_out FROM events)"""


@query(f"""WITH {RUN_LOG} SELECT model, count(*) AS calls, count(latency_ms) AS timed, round(quantile_cont(latency_ms, 0.5), 4) AS p50, round(quantile_cont(latency_ms, 0.95), 4) AS p95,
 round(sum(latency_ms::DECIMAL(18, 6))::DOUBLE / count(latency_ms), 4) AS mean_ms, round(count(latency_ms) / (sum(latency_ms::DECIMAL(18, 6))::DOUBLE / 1000), 6) AS per_second,
 round(sum(tokens_in) / count(tokens_in), 6) AS tokens_in, round(sum(tokens_out) / count(tokens_out), 6) AS tokens_out, count(*) FILTER (tokens_out IS NULL) AS unreported,
 round(sum(tokens_in) / count(tokens_in) * 3 + sum(tokens_out) / count(tokens_out) * 15, 4) AS metered_per_million,
 round(1000000 / (count(latency_ms) / (sum(latency_ms::DECIMAL(18, 6))::DOUBLE / 1000)) / 3600 * 0.4, 4) AS amortised_per_million FROM run_log GROUP BY 1""")
def run_cost(spark, sf_dir):
    """Latency, throughput, tokens and both prices of a million records, by model, from a log of calls."""
    e = views.read(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint") + 100
    log = e.select(F.col("event_type").alias("model"), F.col("value").alias("latency_ms"), k.alias("tokens_in"), F.when(F.col("event_id") % 7 != 0, F.col("event_id") % 13 + 1).alias("tokens_out"))
    return report.run_costs(log, ["model"], price_in=3.0, price_out=15.0, hourly=0.4)


@query(f"""WITH {FLOWS}, s AS (SELECT *, ((total_bytes * 7 + pkt_count * 13) % 101) / 100.0 AS gate, ((dst_port * 31 + total_bytes) % 97) / 96.0 AS llm FROM flows), r AS (SELECT *, greatest(gate, 1 - gate) < 0.7 AS routed, CASE WHEN greatest(gate, 1 - gate) < 0.7 THEN llm ELSE gate END AS final FROM s)
SELECT protocol, count(*) AS flows, count(*) FILTER (routed) AS routed, count(*) FILTER (final >= 0.5 AND label = 1) AS tp, count(*) FILTER (final >= 0.5 AND label = 0) AS fp, count(*) FILTER (final < 0.5 AND label = 1) AS fn, count(*) FILTER (final < 0.5 AND label = 0) AS tn FROM r GROUP BY 1""")
def flow_router_report(spark, sf_dir):
    """Packets to flows, a gate score, routing to a second score at 0.7, the confusion by protocol."""
    f = flow_table(spark, sf_dir).withColumns({"gate": F.expr("((total_bytes * 7 + pkt_count * 13) % 101) / 100D"), "llm": F.expr("((dst_port * 31 + total_bytes) % 97) / 96D")})
    far = replies.routed(F.col("gate"), F.lit(0.7))
    f = f.withColumns({"routed": far, "final": F.when(far, F.col("llm")).otherwise(F.col("gate"))})
    hit, pos = F.col("final") >= 0.5, F.col("label") == 1
    return f.groupBy("protocol").agg(F.count("*").alias("flows"), F.count_if("routed").alias("routed"), F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"))


NUMBERS = ["pkt_count", "total_bytes", "max_pkt_len", "mean_pkt_len", "mean_iat_ms", "std_iat_ms"]


def _folded(spark, sf_dir):
    f = sweeps.kept(flow_table(spark, sf_dir).withColumn("flow", network.flow_id(*KEYS)))  # read for the folds and for their rows
    return sweeps.kept(splits.group_folds(f, "flow", 3))


@query()
def flow_out_of_fold(spark, sf_dir):
    """Out-of-fold scores of a linear model over flows."""
    return learn.out_of_fold(_folded(spark, sf_dir), NUMBERS, learn.logistic(), 3).select("flow", "fold", "label", "p1")


@query()
def flow_boosted_holdout(spark, sf_dir):
    """Boosted trees, 100 of depth 6, fitted on two folds, scored on the third."""
    rows = _folded(spark, sf_dir)
    return learn.fit_score(rows.where("fold <> 0"), rows.where("fold = 0"), NUMBERS, learn.boosted_trees()).select("flow", "label", "p1")


@query()
def calibrated_scores(spark, sf_dir):
    """Platt and isotonic calibration, fitted on half of the messages, of the other half."""
    e = views.emails(spark, sf_dir).select("doc_id", "label", "score")
    cal, test = e.where("doc_id % 2 = 0"), e.where("doc_id % 2 = 1")
    return learn.platt(cal, test).select("doc_id", F.col("p1").alias("platt")).join(learn.isotonic(cal, test).select("doc_id", F.col("p1").alias("isotonic")), "doc_id")


from . import evaluation, experiments, planning, reports  # noqa: E402,F401  register further queries
