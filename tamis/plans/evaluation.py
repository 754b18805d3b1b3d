"""Further registered queries: timelines, sentences, fingerprints, caps, thresholds at projected precision, stacking."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.functions import email, network
from tamis.operators import learn, metrics, prevalence, splits

from . import views
from .registry import NETFLOW, NUMBERS, PORT_SQL, W_SQL, _folded, netflow_rows, query
from .views import EMAILS, PACKETS

HOUR = 3_600_000_000


@query(f"""WITH {PACKETS}, r AS (SELECT event_id, label, time_us, row_number() OVER (PARTITION BY label ORDER BY time_us, event_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM packets)
SELECT event_id, label, CASE WHEN r <= n * 4 // 5 THEN 'train' ELSE 'test' END AS part FROM r""")
def split_class_timelines(spark, sf_dir):
    """The first four fifths of each class in time train, the rest tests."""
    t = splits.timeline(views.packets(spark, sf_dir), ["label"], "time_us", "event_id", HOUR)
    return t.select("event_id", "label", F.when(F.col("rank") <= F.expr("class_size * 4 div 5"), "train").otherwise("test").alias("part"))


@query(f"""WITH {PACKETS}, r AS (SELECT label, time_us, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY time_us, event_id) <= count(*) OVER (PARTITION BY label) * 4 // 5 THEN 'train' ELSE 'test' END AS part FROM packets),
g AS (SELECT label, max(time_us) FILTER (part = 'train') AS train_last, min(time_us) FILTER (part = 'test') AS test_first FROM r GROUP BY 1) SELECT label, train_last, test_first, CAST(train_last < test_first AS INT) AS ordered FROM g""")
def split_order_report(spark, sf_dir):
    """For each class: the last training time, the first test time and whether they are in order."""
    p = split_class_timelines(spark, sf_dir).select("event_id", "part").join(views.packets(spark, sf_dir), "event_id")
    g = p.groupBy("label").agg(F.max(F.when(F.col("part") == "train", F.col("time_us"))).alias("train_last"), F.min(F.when(F.col("part") == "test", F.col("time_us"))).alias("test_first"))
    return g.withColumn("ordered", (F.col("train_last") < F.col("test_first")).cast("int"))


@query(f"""WITH {PACKETS}, r AS (SELECT event_id, row_number() OVER (ORDER BY time_us, event_id) - 1 AS r, count(*) OVER () AS n FROM packets), s AS (SELECT event_id, r, n // 6 AS s, n - 5 * (n // 6) AS warm FROM r)
SELECT event_id, CASE WHEN r >= warm THEN CAST((r - warm) // s AS INT) ELSE -1 END AS fold FROM s""")
def split_forward_chaining(spark, sf_dir):
    """Five forward-chaining blocks in time; the first stretch is never scored (-1)."""
    return splits.forward_chaining(views.packets(spark, sf_dir), "time_us", "event_id", 5, HOUR).select("event_id", F.coalesce("fold", F.lit(-1)).alias("fold"))


@query(f"""WITH {EMAILS}, t AS (SELECT count(*) AS n, sum(label) AS p FROM emails), k AS (SELECT least(p, greatest(5, round(200 * p / n))) AS kp, n - p AS neg FROM t),
r AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY sha256('42:' || doc_id), doc_id) AS r FROM emails) SELECT doc_id, label FROM r, k WHERE r <= CASE WHEN label = 1 THEN kp ELSE least(neg, 200 - kp) END""")
def split_smoke_cap(spark, sf_dir):
    """A thinned table of 200 rows that keeps the class prior and five positives or more: a sampling operator."""
    return splits.smoke_cap(views.emails(spark, sf_dir), 200, "doc_id").select("doc_id", "label")


@query(f"""WITH {PACKETS}, g AS (SELECT *, coalesce(time_us - lag(time_us) OVER (PARTITION BY dst_ip ORDER BY time_us, event_id), 0) // 10000 * 10 AS ms FROM packets)
SELECT event_id, 'Packet: protocol=' || protocol || ', src_port=' || {PORT_SQL('src_port')} || ', dst_port=' || {PORT_SQL('dst_port')} || ', pkt_len=' || pkt_len || ', ttl=64, interarrival_ms=' || ms || '.00'
 || CASE WHEN protocol <> 'TCP' THEN '' WHEN syn = 1 THEN ', flags=[SYN]' WHEN ack = 1 THEN ', flags=[ACK]' ELSE ', flags=[none]' END AS sentence FROM g""")
def packet_sentences(spark, sf_dir):
    p = network.interarrival(views.packets(spark, sf_dir), ["dst_ip"], ["time_us", "event_id"])
    p = p.withColumns({"ttl": F.lit(64), "interarrival_ms": F.expr("interarrival_us div 10000 * 10").cast("double")})
    return p.select("event_id", network.packet_sentence().alias("sentence"))


@query(f"""WITH {NETFLOW} SELECT l_orderkey, l_linenumber, 'A ' || CASE proto_int WHEN 6 THEN 'TCP' ELSE 'UDP' END || ' flow from port ' || {PORT_SQL('sport')} || ' to port ' || {PORT_SQL('80')} || ' (direction ' || dir || '), lasting ' || format('{{:.3f}}', tot_pkts / 8.0::DOUBLE) || ' s with ' || tot_pkts || ' packets totaling ' || tot_bytes
 || ' bytes, of which the source sent ' || src_bytes || ' bytes' || CASE scenario WHEN 1 THEN '; connection state CON' WHEN 2 THEN '' ELSE '; connection state S_' END || '.' AS sentence FROM netflow""")
def netflow_sentences(spark, sf_dir):
    """An eighth of a second for each packet stands in for the duration; the state follows the scenario."""
    state = F.when(F.col("scenario") == 1, " CON").when(F.col("scenario") == 2, " ").otherwise("S_")
    n = netflow_rows(spark, sf_dir).withColumns({"dur": F.col("tot_pkts") / 8, "state": state})
    return n.select("l_orderkey", "l_linenumber", network.netflow_sentence().alias("sentence"))


@query("SELECT l_orderkey, l_linenumber, 'Packet stats: price=' || format('{:.4g}', l_extendedprice * sqrt(2)) || ', rate=' || format('{:.4g}', l_discount / 7000) || ', n=' || l_linenumber AS sentence FROM lineitem")
def statistic_sentences(spark, sf_dir):
    """Four significant digits; a tie in the last one rounds up."""
    li = views.read(spark, sf_dir, "lineitem")
    cols = {"price": network.significant(F.col("l_extendedprice") * F.sqrt(F.lit(2.0))), "rate": network.significant(F.col("l_discount") / 7000), "n": F.col("l_linenumber").cast("string")}
    return li.select("l_orderkey", "l_linenumber", network.statistic_sentence(cols).alias("sentence"))


@query("""WITH f AS (SELECT doc_id, source, CASE WHEN source IN ('src0', 'src2') THEN 'first' WHEN source LIKE 'src1%' THEN 'src1' ELSE source END AS family FROM documents)
SELECT family, count(*) AS n, count(DISTINCT source) AS sources FROM f GROUP BY 1""")
def source_families(spark, sf_dir):
    f = views.read(spark, sf_dir, "documents").select("source", email.source_family(F.col("source"), {"src0": "first", "src2": "first"}, ["src1"]).alias("family"))
    return f.groupBy("family").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))


@query("""WITH h AS (SELECT source, doc_id // 1000 AS b, sha256(string_agg(sha256(coalesce(text, '')), '' ORDER BY doc_id)) AS h FROM documents GROUP BY 1, 2)
SELECT source, count(*) AS blocks, sha256(string_agg(h, '' ORDER BY b)) AS fingerprint FROM h GROUP BY 1""")
def source_fingerprints(spark, sf_dir):
    d = views.read(spark, sf_dir, "documents").withColumn("h", F.sha2(F.coalesce("text", F.lit("")), 256))
    return splits.fingerprint(d, ["source"], "doc_id", "h", 1000)


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_extendedprice * sqrt(2) / nullif(l_quantity - 1, 0) AS a, CASE WHEN l_discount > 0 THEN ln(l_discount) END AS b FROM lineitem), m AS (SELECT quantile_cont(a, 0.5) AS ma, quantile_cont(b, 0.5) AS mb FROM x)
SELECT l_orderkey, l_linenumber, round(coalesce(a, ma), 4) AS a, round(coalesce(b, mb), 4) AS b FROM x, m""")
def numeric_matrix(spark, sf_dir):
    """Infinite and missing numbers take the column's median; a column without numbers is left out."""
    x = views.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.try_divide(F.col("l_extendedprice") * F.sqrt(F.lit(2.0)), F.col("l_quantity") - 1).alias("a"), F.when(F.col("l_discount") > 0, F.log("l_discount")).otherwise(float("-inf")).alias("b"), F.lit(None).cast("double").alias("none"))
    return learn.numeric_matrix(x, ["a", "b", "none"]).select("l_orderkey", "l_linenumber", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


@query(f"""WITH {EMAILS}, d AS (SELECT lang, source, score, sum(label) AS p, count(*) AS n FROM emails GROUP BY ALL),
c AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(p) OVER (PARTITION BY lang, source) AS tp, sum(n) OVER (PARTITION BY lang, source) AS tn FROM d WINDOW w AS (PARTITION BY lang, source ORDER BY score DESC)),
m AS (SELECT lang, source, CASE WHEN max(tp) > 0 AND max(tp) < max(tn) THEN round(sum(cp / cn * p) / max(tp), 6) END AS v FROM c GROUP BY 1, 2)
SELECT lang, count(*) AS bundles, count(v) AS n, round(quantile_cont(v, 0.5), 7) AS median, min(v) AS lowest, max(v) AS highest FROM m GROUP BY 1""")
def bundle_summary(spark, sf_dir):
    """Median and range of average precision over the sources of each language; sources of one class are skipped."""
    r = metrics.ranking(metrics.prefix_counts(views.emails(spark, sf_dir), ["lang", "source"]), ["lang", "source"])
    return metrics.summary(r, ["lang"], "aucpr")


@query(f"""WITH {EMAILS}, e AS (SELECT lang, score, subtype FROM emails), c AS (SELECT DISTINCT lang, score FROM e),
k AS (SELECT c.lang, c.score, {', '.join(f"count(*) FILTER (subtype = '{s}' AND e.score >= c.score)::DOUBLE AS k_{s}, count(*) FILTER (subtype = '{s}')::DOUBLE AS n_{s}" for s in ('phishing', 'ham', 'bulk_spam', 'scam_fraud'))} FROM c JOIN e ON e.lang = c.lang GROUP BY 1, 2),
p AS (SELECT lang, score, k_phishing, k_phishing / n_phishing AS t, 0.5 * k_ham / n_ham + 0.25 * k_bulk_spam / n_bulk_spam + 0.25 * k_scam_fraud / n_scam_fraud AS f, {W_SQL('k_phishing', 'n_phishing', '-')} AS tl,
 0.5 * {W_SQL('k_ham', 'n_ham', '+')} + 0.25 * {W_SQL('k_bulk_spam', 'n_bulk_spam', '+')} + 0.25 * {W_SQL('k_scam_fraud', 'n_scam_fraud', '+')} AS fu, n_ham > 0 AND n_bulk_spam > 0 AND n_scam_fraud > 0 AND n_phishing > 0 AS known FROM k)
SELECT lang, min(score) FILTER (known AND k_phishing > 0 AND 0.1 * t / (0.1 * t + 0.9 * f) >= 0.5) AS point_threshold, min(score) FILTER (known AND k_phishing > 0 AND 0.1 * tl / (0.1 * tl + 0.9 * fu) >= 0.3) AS conservative_threshold FROM p GROUP BY 1""")
def projected_precision_thresholds(spark, sf_dir):
    """Lowest score whose projected precision at a prior of 0.1, half of the negatives spam, meets a target; null if none does."""
    t = prevalence.threshold_rates(views.emails(spark, sf_dir), ["lang"])
    point = prevalence.projected_threshold(t, ["lang"], 0.1, 0.5, 0.5).withColumnRenamed("threshold", "point_threshold")
    return point.join(prevalence.projected_threshold(t, ["lang"], 0.1, 0.5, 0.3, conservative=True).withColumnRenamed("threshold", "conservative_threshold"), "lang")


@query()
def flow_meta_learner(spark, sf_dir):
    """Out-of-fold scores of two base models, stacked by a linear model that is fitted on two folds and scores the third."""
    rows = _folded(spark, sf_dir)
    scores = [learn.out_of_fold(rows, NUMBERS, e, 3) for e in (learn.logistic(), learn.forest(10))]
    wide = learn.stack(scores, "flow").join(rows.select("flow", "fold", "label"), "flow")
    return learn.fit_score(wide.where("fold <> 0"), wide.where("fold = 0"), ["p_0", "p_1"], learn.logistic()).select("flow", "label", "p1")
