"""Projection of measured rates to deployment priors and mixtures, support of a target, group bootstrap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .metrics import by_group, conditional_rates, in_ranges, wilson

NEGATIVES = ["ham", "bulk_spam", "scam_fraud", "unknown_nonphishing"]


def mixture(spam_share: Column, bulk: float = 0.5) -> dict[str, Column]:
    """Weights of the negative subtypes when spam_share of the negatives is spam."""
    return {"ham": 1 - spam_share, "bulk_spam": spam_share * bulk, "scam_fraud": spam_share * (1 - bulk), "unknown_nonphishing": F.lit(0.0)}


def wide_rates(scored: DataFrame, by: list[str], group: str) -> DataFrame:
    """One row for each operating point: a struct of rates for each subtype."""
    r = conditional_rates(scored, by, group)
    return r.groupBy(*by).pivot("subtype", ["phishing", *NEGATIVES]).agg(F.first(F.struct("numerator", "denominator", "point", "lo", "hi", "resolution")))


def grid(rates: DataFrame, priors: list[float], shares: list[float], target: float = 0.9) -> DataFrame:
    """Each operating point at each prior and spam share: projected precision (point and conservative) and support.

    A weighted subtype without rows makes the projection null and the status extrapolative."""
    spark = rates.sparkSession
    cells = spark.createDataFrame([(p, s) for p in priors for s in shares], "prior double, spam_share double")
    d = rates.crossJoin(F.broadcast(cells))  # a grid of fixed size
    q, pi = mixture(F.col("spam_share")), F.col("prior")
    total = lambda f: reduce(lambda a, b: a + b, [F.when(w > 0, w * F.col(f"{s}.{f}")).otherwise(0.0) for s, w in q.items()])
    zero = reduce(lambda a, b: a & b, [(w <= 0) | (F.col(f"{s}.numerator") == 0) for s, w in q.items()])
    d = d.withColumns({"fpr_mix": total("point"), "fpr_upper": total("hi"), "resolution": total("resolution"), "zero_fp": zero, "tpr": F.col("phishing.point"), "tpr_lo": F.col("phishing.lo")})
    prec = lambda t, f: F.when(pi * t + (1 - pi) * f > 0, pi * t / (pi * t + (1 - pi) * f)).when(t.isNull() | f.isNull(), None).otherwise(0.0)
    d = d.withColumns({"precision_point": prec(F.col("tpr"), F.col("fpr_mix")), "precision_conservative": prec(F.col("tpr_lo"), F.col("fpr_upper")), "required_fpr": pi * F.col("tpr") * (1 - target) / (target * (1 - pi))})
    resolved = (F.col("required_fpr") >= F.col("resolution")) & ~F.col("zero_fp")
    status = F.when(F.col("precision_point").isNull(), "extrapolative").when(F.col("precision_conservative") >= target, "supported").when(resolved, "limited").otherwise("extrapolative")
    return d.withColumn("support_status", status)


#: Cumulative probabilities of Poisson(1).
POISSON = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676]


def poisson_weight(group: Column, replicate: Column, salt: str) -> Column:
    """How often a replicate draws a group: Poisson(1) by inverse distribution from a hash of both, whatever the partitioning."""
    u = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(salt), replicate.cast("string"), group.cast("string")), 256), 1, 8), 16, 10).cast("double") / 4294967296
    return reduce(lambda a, s: a + (u >= s).cast("int"), POISSON, F.lit(0))


def replicated(counts: DataFrame, by: list[str], sums: list[str], replicates: int, salt: str) -> DataFrame:
    """by, rep and the weighted sums of each replicate: groups `g` times replicates meet only in partial sums."""
    rep = counts.sparkSession.range(replicates).select(F.col("id").alias("rep"))
    w = counts.crossJoin(F.broadcast(rep)).withColumn("w", poisson_weight(F.col("g"), F.col("rep"), salt))  # a fixed number of replicates
    return w.groupBy(*by, "rep").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in sums])


def interval(column: str | Column, digits: int = 6) -> list[Column]:
    return [F.round(F.percentile(column, F.lit(q)), digits).alias(n) for q, n in ((0.025, "lo"), (0.975, "hi"))]


def bootstrap(scored: DataFrame, by: list[str], group: str, replicates: int, salt: str = "42") -> DataFrame:
    """95 % percentile interval of each subtype's alert rate over resampled groups. Rows are counted by group first."""
    g = scored.groupBy(*by, F.col(group).alias("g"), "subtype").agg(F.count("*").alias("n"), F.count_if(F.col("score") >= F.col("threshold")).alias("k"))
    r = replicated(g, [*by, "subtype"], ["k", "n"], replicates, salt).where("n > 0")
    return r.groupBy(*by, "subtype").agg(F.count("*").alias("replicates"), *interval(F.col("k") / F.col("n")))


def projection_bootstrap(scored: DataFrame, group: str, priors: list[float], shares: list[float], replicates: int = 200, salt: str = "42") -> DataFrame:
    """95 % interval of the projected precision at each prior and spam share over resampled groups; replicates in which a
    weighted subtype has no rows are left out."""
    kinds = ["phishing", *NEGATIVES]
    hit = F.col("score") >= F.col("threshold")
    g = scored.groupBy(F.col(group).alias("g")).agg(*[F.count_if(F.col("subtype") == s).alias(f"n_{s}") for s in kinds], *[F.count_if((F.col("subtype") == s) & hit).alias(f"k_{s}") for s in kinds])
    r = replicated(g, [], [f"{c}_{s}" for s in kinds for c in "nk"], replicates, salt)
    cells = r.sparkSession.createDataFrame([(p, s) for p in priors for s in shares], "prior double, spam_share double")
    rate = lambda s: F.when(F.col(f"n_{s}") > 0, F.col(f"k_{s}") / F.col(f"n_{s}"))
    mixed = reduce(lambda a, b: a + b, [F.when(w > 0, w * rate(s)).otherwise(0.0) for s, w in mixture(F.col("spam_share")).items()])
    pi, d = F.col("prior"), F.col("prior") * F.col("tpr") + (1 - F.col("prior")) * F.col("fpr")
    r = r.crossJoin(F.broadcast(cells)).withColumn("tpr", rate("phishing")).withColumn("fpr", mixed).where("tpr IS NOT NULL AND fpr IS NOT NULL")
    precision = F.when(d > 0, pi * F.col("tpr") / d).otherwise(0.0)
    return r.groupBy("prior", "spam_share").agg(F.count("*").alias("replicates"), *interval(precision))


def paired_bootstrap(scored: DataFrame, group: str, a: str, b: str, threshold: float, replicates: int = 200, salt: str = "42") -> DataFrame:
    """Differences of two scores a - b over the same resampled groups, in recall and in accuracy: measured value, 95 %
    percentile interval, and share of replicates above 0."""
    y, hit = F.col("label") == 1, {c: F.col(c) >= threshold for c in (a, b)}
    g = scored.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(group).alias("g")).agg(F.count("*").alias("n"), F.count_if(y).alias("p"), *[F.count_if(y & hit[c]).alias(f"tp_{k}") for k, c in enumerate((a, b))], *[F.count_if(y == hit[c]).alias(f"ok_{k}") for k, c in enumerate((a, b))])
    sums = ["n", "p", "tp_0", "tp_1", "ok_0", "ok_1"]
    differences = F.inline(F.array(F.struct(F.lit("recall").alias("metric"), F.when(F.col("p") > 0, (F.col("tp_0") - F.col("tp_1")) / F.col("p")).alias("d")), F.struct(F.lit("accuracy").alias("metric"), F.when(F.col("n") > 0, (F.col("ok_0") - F.col("ok_1")) / F.col("n")).alias("d"))))
    measured = g.agg(*[F.sum(c).alias(c) for c in sums]).select(differences).select("metric", F.round("d", 6).alias("difference"))
    r = replicated(g, [], sums, replicates, salt).select(differences).where("d IS NOT NULL")
    r = r.groupBy("metric").agg(F.count("*").alias("replicates"), *interval("d"), F.round(F.count_if(F.col("d") > 0) / F.count("*"), 6).alias("share_above"))
    return measured.join(r, "metric", "left")


def threshold_rates(scored: DataFrame, by: list[str], parts: int = 64) -> DataFrame:
    """For each distinct score of each group: the alert rate of every subtype at that threshold, as structs for grid().

    Counts by distinct score are summed in ranges of the score, so no task sees all scores of a group."""
    kinds = ["phishing", *NEGATIVES]
    d = scored.where("score IS NOT NULL").groupBy(*by, "score").agg(*[F.count_if(F.col("subtype") == s).alias(s) for s in kinds])
    d = in_ranges(d, by, "score", parts)
    ranges = d.groupBy(*by, "_r").agg(*[F.sum(s).alias(f"r_{s}") for s in kinds])
    above = W.partitionBy(*by).orderBy(F.desc("_r")).rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select(*by, "_r", *[F.coalesce(F.sum(f"r_{s}").over(above), F.lit(0)).alias(f"a_{s}") for s in kinds], *[F.sum(f"r_{s}").over(W.partitionBy(*by)).alias(f"t_{s}") for s in kinds])
    run = W.partitionBy(*by, "_r").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    d = by_group(d, ranges, [*by, "_r"]).select(*by, "score", *[(F.col(f"a_{s}") + F.sum(s).over(run)).alias(f"k_{s}") for s in kinds], *[f"t_{s}" for s in kinds])

    def rate(s: str) -> Column:
        k, n = F.col(f"k_{s}"), F.col(f"t_{s}")
        lo, hi = wilson(k, n)
        return F.when(n > 0, F.struct(k.alias("numerator"), n.alias("denominator"), (k / n).alias("point"), lo.alias("lo"), hi.alias("hi"), (1 / n).alias("resolution"))).alias(s)

    return d.select(*by, "score", *[rate(s) for s in kinds])


def projected_threshold(rates: DataFrame, by: list[str], prior: float, spam_share: float, target: float, conservative: bool = False) -> DataFrame:
    """Lowest score of each group whose projected precision meets the target and that a positive reaches; null if there is none."""
    g = grid(rates, [prior], [spam_share], target)
    meets = (F.col("precision_conservative" if conservative else "precision_point") >= target) & (F.col("phishing.numerator") > 0)
    return g.groupBy(*by).agg(F.min(F.when(meets, F.col("score"))).alias("threshold"))
