"""Registered queries: the operational report, several classes, paired and projected bootstraps."""

from __future__ import annotations

from pyspark.sql import functions as F

from tamis.operators import prevalence, report

from . import views
from .registry import query
from .views import EMAILS

REPORT = f"""{EMAILS}, tr AS (SELECT score, label FROM emails WHERE doc_id % 3 <> 0), te AS (SELECT score, label FROM emails WHERE doc_id % 3 = 0),
d AS (SELECT score, sum(label) AS p, count(*) AS n FROM tr GROUP BY 1), c AS (SELECT score, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(p) OVER () AS tp FROM d WINDOW w AS (ORDER BY score DESC)),
pts AS (SELECT 'fixed' AS point, 0.5::DOUBLE AS threshold UNION ALL SELECT 'recall', max(score) FILTER (tp > 0 AND cp >= ceil(0.9::DOUBLE * tp)) FROM c UNION ALL SELECT 'precision', min(score) FILTER (cp / cn >= 0.05::DOUBLE) FROM c),
r AS (SELECT point, threshold, count(*) AS n, sum(label) AS n_pos, count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (score >= threshold AND label = 0) AS fp,
 count(*) FILTER (score < threshold AND label = 1) AS fn, count(*) FILTER (score < threshold AND label = 0) AS tn FROM pts, te GROUP BY 1, 2),
q AS (SELECT *, tp / (tp + fn) AS t, fp / (fp + tn) AS f FROM r),
d2 AS (SELECT score, sum(label) AS p, count(*) AS n FROM te GROUP BY 1), c2 AS (SELECT p, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM d2 WINDOW w AS (ORDER BY score DESC)),
a AS (SELECT round(sum(cp / cn * p) / sum(p), 6) AS aucpr FROM c2)"""


@query(f"""WITH {REPORT} SELECT point, threshold IS NOT NULL AS attainable, threshold, n, n_pos::BIGINT AS n_pos, round(n_pos / n, 6) AS natural_prior, tp, fp, fn, tn, round(t, 6) AS recall, round(f, 6) AS fpr,
 CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 6) ELSE 0 END AS "precision", round(1000 * fp / n, 6) AS fp_per_1k, round(fp / 6.0::DOUBLE, 6) AS fp_per_hour, round((tp + fp) / 6.0::DOUBLE, 6) AS alerts_per_hour,
 CASE WHEN t + f > 0 THEN round(0.01::DOUBLE * t / (0.01::DOUBLE * t + 0.99::DOUBLE * f), 6) ELSE 0 END AS precision_at_0, round(1000 * (0.001::DOUBLE * t + 0.999::DOUBLE * f), 6) AS alerts_per_1k_at_1, TRUE AS self_check, aucpr FROM q, a""")
def operational_report(spark, sf_dir):
    """Three operating points of the score on a third of the e-mails, thresholds from the others, half of 12 hours scored."""
    e = views.emails(spark, sf_dir).select("doc_id", "label", "score")
    r = report.operational_report(e.where("doc_id % 3 = 0"), e.where("doc_id % 3 <> 0"), hours=12.0, exposure=0.5, precision_target=0.05)
    return r.select("point", "attainable", "threshold", "n", "n_pos", "natural_prior", "tp", "fp", "fn", "tn", "recall", "fpr", "precision", "fp_per_1k", "fp_per_hour", "alerts_per_hour", "precision_at_0", "alerts_per_1k_at_1", "self_check", "aucpr")


SAID = "CASE WHEN score >= 0.6::DOUBLE THEN 'phishing' WHEN doc_id % 5 = 0 THEN 'ham' ELSE subtype END"


def _said(spark, sf_dir):
    return views.emails(spark, sf_dir).withColumn("said", F.expr("CASE WHEN score >= 0.6D THEN 'phishing' WHEN doc_id % 5 = 0 THEN 'ham' ELSE subtype END"))


@query(f"WITH {EMAILS} SELECT subtype AS truth, {SAID} AS said, count(*) AS n FROM emails GROUP BY 1, 2")
def confusion_matrix(spark, sf_dir):
    return report.confusion(_said(spark, sf_dir), "subtype", "said")


@query(f"""WITH {EMAILS}, s AS (SELECT subtype, {SAID} AS said FROM emails), k AS (SELECT subtype AS cls FROM s UNION SELECT said FROM s),
c AS (SELECT cls, (SELECT count(*) FROM s WHERE subtype = cls) AS support, (SELECT count(*) FROM s WHERE said = cls) AS said, (SELECT count(*) FROM s WHERE said = cls AND subtype = cls) AS "right" FROM k),
m AS (SELECT *, CASE WHEN support > 0 THEN "right" / support END AS recall, CASE WHEN said > 0 THEN "right" / said END AS "precision", 2 * "right" / (support + said) AS f1 FROM c)
SELECT cls, support, said, "right", round(recall, 6) AS recall, round("precision", 6) AS "precision", round(f1, 6) AS f1, round(avg(f1) OVER (), 6) AS macro_f1, round(avg(recall) OVER (), 6) AS balanced_accuracy FROM m""")
def multiclass_report(spark, sf_dir):
    m = report.multiclass(report.confusion(_said(spark, sf_dir), "subtype", "said"))
    return m.select("cls", "support", "said", "right", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "f1", "macro_f1", "balanced_accuracy")])


def weights_sql(group: str, replicates: int) -> str:
    """Poisson(1) weights of groups g: a table w(g, rep, w)."""
    steps = " ".join(f"WHEN u < {s:.8f}::DOUBLE THEN {k}" for k, s in enumerate((0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676)))
    return f"""gs AS (SELECT DISTINCT {group} AS g FROM emails), us AS (SELECT g, rep, CAST('0x' || substr(sha256('42:' || rep || ':' || g), 1, 8) AS BIGINT)::DOUBLE / 4294967296 AS u FROM gs, range({replicates}) t(rep)), w AS (SELECT g, rep, CASE {steps} ELSE 7 END AS w FROM us)"""


OTHER = "((doc_id * 31) % 100) / 100.0::DOUBLE"


@query(f"""WITH {EMAILS}, {weights_sql('source', 200)}, e AS (SELECT source AS g, label, score >= 0.5::DOUBLE AS a, {OTHER} >= 0.5::DOUBLE AS b FROM emails),
k AS (SELECT g, count(*) AS n, sum(label) AS p, count(*) FILTER (label = 1 AND a) AS ta, count(*) FILTER (label = 1 AND b) AS tb, count(*) FILTER ((label = 1) = a) AS oa, count(*) FILTER ((label = 1) = b) AS ob FROM e GROUP BY 1),
r AS (SELECT rep, sum(w * n) AS n, sum(w * p) AS p, sum(w * ta) - sum(w * tb) AS dt, sum(w * oa) - sum(w * ob) AS d_ok FROM k JOIN w USING (g) GROUP BY 1),
d AS (SELECT 'recall' AS metric, (dt / p)::DOUBLE AS d FROM r WHERE p > 0 UNION ALL SELECT 'accuracy', (d_ok / n)::DOUBLE FROM r WHERE n > 0),
m AS (SELECT 'recall' AS metric, round(((sum(ta) - sum(tb)) / sum(p))::DOUBLE, 6) AS difference FROM k UNION ALL SELECT 'accuracy', round(((sum(oa) - sum(ob)) / sum(n))::DOUBLE, 6) FROM k)
SELECT metric, difference, count(*) AS replicates, round(quantile_cont(d, 0.025), 6) AS lo, round(quantile_cont(d, 0.975), 6) AS hi, round(count(*) FILTER (d > 0) / count(*), 6) AS share_above FROM d JOIN m USING (metric) GROUP BY 1, 2""")
def paired_bootstrap(spark, sf_dir):
    """The score against another one over the same 200 resamplings of sources."""
    e = views.emails(spark, sf_dir).withColumn("other", F.expr("((doc_id * 31) % 100) / 100D"))
    return prevalence.paired_bootstrap(e, "source", "score", "other", 0.5, 200)


@query(f"""WITH {EMAILS}, {weights_sql('source', 200)},
k AS (SELECT source AS g, {', '.join(f"count(*) FILTER (subtype = '{s}') AS n_{s}, count(*) FILTER (subtype = '{s}' AND score >= 0.5::DOUBLE) AS k_{s}" for s in ('phishing', 'ham', 'bulk_spam', 'scam_fraud'))} FROM emails GROUP BY 1),
r AS (SELECT rep, {', '.join(f"CASE WHEN sum(w * n_{s}) > 0 THEN (sum(w * k_{s}) / sum(w * n_{s}))::DOUBLE END AS r_{s}" for s in ('phishing', 'ham', 'bulk_spam', 'scam_fraud'))} FROM k JOIN w USING (g) GROUP BY 1),
f AS (SELECT prior, q AS spam_share, r_phishing AS t, CASE WHEN q < 1 THEN (1 - q) * r_ham ELSE 0 END + CASE WHEN q > 0 THEN q * 0.5 * r_bulk_spam + q * 0.5 * r_scam_fraud ELSE 0 END AS f FROM r, (SELECT unnest([0.01::DOUBLE, 0.1::DOUBLE]) AS prior), (SELECT unnest([0.0::DOUBLE, 0.5::DOUBLE]) AS q)),
p AS (SELECT prior, spam_share, CASE WHEN prior * t + (1 - prior) * f > 0 THEN prior * t / (prior * t + (1 - prior) * f) ELSE 0 END AS v FROM f WHERE t IS NOT NULL AND f IS NOT NULL)
SELECT prior, spam_share, count(*) AS replicates, round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.975), 6) AS hi FROM p GROUP BY 1, 2""")
def projection_bootstrap(spark, sf_dir):
    e = views.emails(spark, sf_dir).withColumn("threshold", F.lit(0.5))
    return prevalence.projection_bootstrap(e, "source", [0.01, 0.1], [0.0, 0.5], 200)
