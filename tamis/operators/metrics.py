"""Detection metrics over scored tables, on prefix counts of distinct scores; nothing row-level leaves the executors."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by_group(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """rows with the columns of their group; a null in a group's name is a name like any other."""
    if not by:
        return rows.crossJoin(F.broadcast(groups))  # one row
    names = groups.select(*[F.col(c).alias(f"_g{k}") for k, c in enumerate(by)], *[c for c in groups.columns if c not in by])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_g{k}")) for k, c in enumerate(by)])
    return rows.join(names, same).drop(*[f"_g{k}" for k in range(len(by))])


def in_ranges(distinct: DataFrame, by: list[str], value: str, parts: int = 64, few: Callable[[DataFrame], DataFrame] = lambda g: g) -> DataFrame:
    """distinct, one row for each value of a group, with _r: the values of a group in at most `parts` ranges of like numbers
    of values, cut where the data are. However the values pile up, a range holds about one part of the distinct ones.
    few: F.broadcast where the groups are known to be few, so that a large group's rows stay where they are."""
    cuts = distinct.groupBy(*by).agg(F.percentile_approx(value, [k / parts for k in range(1, parts)], 1000).alias("_cuts"))
    return by_group(distinct, few(cuts), by).withColumn("_r", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")


def prefix_counts(scored: DataFrame, by: list[str], parts: int = 64) -> DataFrame:
    """For each distinct score of each group: p, n (positives and rows at it), cp, cn (at it or above), tp, tn (totals).

    Rows collapse to distinct scores first. The running sum is cut in ranges of the distinct scores: each range sums alone,
    and the totals of the ranges above are added, so nearly unique scores do not meet in one task. Groups may be null."""
    d = scored.where("score IS NOT NULL").groupBy(*by, "score").agg(F.sum("label").alias("p"), F.count("*").alias("n"))
    cut = in_ranges(d, by, "score", parts)
    ranges = cut.groupBy(*by, "_r").agg(F.sum("p").alias("rp"), F.sum("n").alias("rn"))
    above = W.partitionBy(*by).orderBy(F.desc("_r")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*by)
    ranges = ranges.select(*by, "_r", F.coalesce(F.sum("rp").over(above), F.lit(0)).alias("ap"), F.coalesce(F.sum("rn").over(above), F.lit(0)).alias("an"), F.sum("rp").over(whole).alias("tp"), F.sum("rn").over(whole).alias("tn"))
    run = W.partitionBy(*by, "_r").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    out = by_group(cut, ranges, [*by, "_r"])
    return out.select(*by, "score", "p", "n", (F.col("ap") + F.sum("p").over(run)).alias("cp"), (F.col("an") + F.sum("n").over(run)).alias("cn"), "tp", "tn")


def ranking(counts: DataFrame, by: list[str]) -> DataFrame:
    """Average precision and ROC-AUC with ties; null where only one class is there."""
    below = (F.col("tn") - F.col("tp")) - (F.col("cn") - F.col("cp"))
    at = F.col("n") - F.col("p")
    g = counts.groupBy(*by).agg(F.first("tp").alias("n_pos"), F.first("tn").alias("n"), F.sum(F.col("cp") / F.col("cn") * F.col("p")).alias("s"), F.sum((F.col("p") * (2 * below + at)).cast("decimal(38,0)")).alias("u"))
    both = (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n"))
    return g.select(*by, "n", "n_pos", F.when(both, F.round(F.col("s") / F.col("n_pos"), 6)).alias("aucpr"), F.when(both, F.round(F.col("u").cast("double") / 2 / F.col("n_pos") / (F.col("n") - F.col("n_pos")), 6)).alias("rocauc"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p, d = k / n, 1 + F.lit(z * z) / n
    c = (p + F.lit(z * z / 2) / n) / d
    h = F.lit(z) * F.sqrt(p * (1 - p) / n + F.lit(z * z / 4) / (n * n)) / d
    return F.when(n > 0, F.greatest(F.lit(0.0), c - h)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), c + h)).otherwise(1.0)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def rates(scored: DataFrame, by: list[str], threshold: str = "threshold") -> DataFrame:
    """Confusion, precision, recall, F1, false positive rate, accuracy with Wilson bounds, for rows with a threshold column."""
    hit, pos = F.col("score") >= F.col(threshold), F.col("label") == 1
    g = scored.where("score IS NOT NULL").groupBy(*by).agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = {"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "fpr": ratio(fp, fp + tn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "accuracy": ratio(tp + tn, tp + fp + fn + tn)}
    for name, k, n in (("precision", tp, tp + fp), ("recall", tp, tp + fn), ("fpr", fp, fp + tn)):
        out[f"{name}_lo"], out[f"{name}_hi"] = wilson(k, n)
    return g.withColumns({k: F.round(v, 6) for k, v in out.items()}).withColumn("alerts", tp + fp)


def recall_threshold(counts: DataFrame, by: list[str], target: float) -> DataFrame:
    """Highest threshold with recall of the target or more."""
    return counts.where(F.col("tp") > 0).where(F.col("cp") >= F.ceil(F.lit(target) * F.col("tp"))).groupBy(*by).agg(F.max("score").alias("threshold"))


def precision_threshold(counts: DataFrame, by: list[str], target: float) -> DataFrame:
    """Lowest threshold with precision of the target or more; no row where there is none."""
    return counts.where(F.col("cp") / F.col("cn") >= target).groupBy(*by).agg(F.min("score").alias("threshold"))


def projected(tpr: Column, fpr: Column, pi: Column) -> dict[str, Column]:
    """Precision and alerts for each thousand rows at class prior pi."""
    d = pi * tpr + (1 - pi) * fpr
    return {"precision_at_prior": F.when(d > 0, pi * tpr / d).otherwise(0.0), "fp_per_1k": 1000 * (1 - pi) * fpr, "alerts_per_1k": 1000 * d}


def conditional_rates(scored: DataFrame, by: list[str], group: str) -> DataFrame:
    """Alert rate of each subtype with Wilson bounds, resolution 1/n and number of groups."""
    g = scored.groupBy(*by, "subtype").agg(F.count_if(F.col("score") >= F.col("threshold")).alias("numerator"), F.count("*").alias("denominator"), F.countDistinct(group).alias("n_groups"))
    lo, hi = wilson(F.col("numerator"), F.col("denominator"))
    return g.withColumns({"point": F.col("numerator") / F.col("denominator"), "lo": lo, "hi": hi, "resolution": 1 / F.col("denominator")})


def calibration(scored: DataFrame, bins: int = 10) -> DataFrame:
    """Reliability rows with empty bins, and Brier score and expected calibration error on each of them.

    Scores and squares are summed as decimals, so that the order of addition does not matter."""
    p = F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0))
    d = scored.select("label", p.cast("decimal(12,6)").alias("p"), F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int").alias("bin"))
    g = d.groupBy("bin").agg(F.count("*").alias("n"), F.sum("p").alias("sp"), F.sum("label").alias("sy"), F.sum((F.col("p") - F.col("label")) * (F.col("p") - F.col("label"))).alias("sq"))
    every = scored.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(g, "bin", "left")
    total = g.agg(F.sum("n").alias("total"), F.sum("sq").cast("double").alias("all_sq"), F.sum(F.abs(F.col("sy") - F.col("sp"))).cast("double").alias("all_gap"))
    out = every.crossJoin(F.broadcast(total))  # one row
    return out.select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.col("sp").cast("double") / F.col("n"), 6).alias("mean_confidence"), F.round(F.col("sy") / F.col("n"), 6).alias("positive_rate"), F.round(F.col("all_sq") / F.col("total"), 6).alias("brier"), F.round(F.col("all_gap") / F.col("total"), 6).alias("ece"))


def quantiles(rows: DataFrame, columns: list[str], q: float, parts: int = 64, by: list[str] | None = None) -> DataFrame:
    """by columns, name, value: the exact quantile q of each column (linear between neighbours); nulls, NaN and infinities
    are left out. Rows collapse to distinct values, whose ranges are counted as in prefix_counts; only the range or two of
    each column that hold the wanted places are put in order. Without by, what is known of a column goes to the rows by
    broadcast, so that no task gets a whole column."""
    key = [*(by or []), "name"]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns]))
    d = rows.select(*(by or []), pairs.alias("x")).select(*(by or []), "x.name", "x.v").where("v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('Infinity')")
    few = (lambda g: g) if by else F.broadcast  # one row a column
    d = in_ranges(d.groupBy(*key, "v").agg(F.count("*").alias("n")), key, "v", parts, few)
    ranges = d.groupBy(*key, "_r").agg(F.sum("n").alias("rn"))
    before = F.coalesce(F.sum("rn").over(W.partitionBy(*key).orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select(*key, "_r", "rn", before.alias("below"), F.sum("rn").over(W.partitionBy(*key)).alias("total"))
    at = (F.col("total") - 1) * F.lit(q)
    holds = lambda place: (F.col("below") <= place) & (place < F.col("below") + F.col("rn"))
    ranges = ranges.withColumn("at", at).where(holds(F.floor("at")) | holds(F.ceil("at"))).select(*key, "_r", "below", "at")
    run = F.sum("n").over(W.partitionBy(*key, "_r").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    d = by_group(d, few(ranges), [*key, "_r"]).select(*key, "v", (F.col("below") + run).alias("upto"), "at")
    g = d.groupBy(*key).agg(F.first("at").alias("at"), F.min(F.when(F.col("upto") > F.floor("at"), F.col("v"))).alias("a"), F.min(F.when(F.col("upto") > F.ceil("at"), F.col("v"))).alias("b"))
    return g.select(*key, (F.col("a") + (F.col("at") - F.floor("at")) * (F.col("b") - F.col("a"))).alias("value"))


def quantile_by_condition(rows: DataFrame, columns: list[str], q: float, conditions: dict[str, Column], parts: int = 64) -> dict[str, dict[str, float]]:
    """condition -> column -> quantiles() of its rows, for all conditions in three passes over rows (pass stored ones).

    Ranges are cut from sketches of the columns, rows are counted by range and condition where they are, and only the values of
    the ranges that hold a wanted place are grouped and put in order: no pass shuffles a whole column. To the driver go a
    column's cuts, counts by range and results."""
    names = list(conditions)
    value = {c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double")) for c in columns}  # NaN is above infinity
    marked = rows.select(*[value[c].alias(f"v{i}") for i, c in enumerate(columns)], *[F.coalesce(conditions[k], F.lit(False)).alias(f"in{j}") for j, k in enumerate(names)])
    found = marked.agg(*[F.percentile_approx(f"v{i}", [k / parts for k in range(1, parts)], 1000).alias(f"v{i}") for i in range(len(columns))]).first()
    cuts = [sorted(set(found[f"v{i}"] or [])) for i in range(len(columns))]
    at = lambda i: F.size(F.filter(F.array(*map(F.lit, cuts[i])), lambda c: c < F.col(f"v{i}"))) if cuts[i] else F.lit(0)
    long = marked.select(F.inline(F.array(*[F.struct(F.lit(i).alias("i"), at(i).alias("r"), F.col(f"v{i}").alias("v")) for i in range(len(columns))])), *[f"in{j}" for j in range(len(names))]).where("v IS NOT NULL")
    counts: dict[tuple, dict[int, int]] = {}
    for row in long.groupBy("i", "r").agg(*[F.count_if(f"in{j}").alias(f"n{j}") for j in range(len(names))]).collect():  # columns x parts rows
        for j in range(len(names)):
            counts.setdefault((row["i"], j), {})[row["r"]] = row[f"n{j}"]
    places, wanted = [], set()
    for (i, j), n in counts.items():
        total, below = sum(n.values()), 0
        place = (total - 1) * q
        for r in sorted(n):
            if total and any(below <= x < below + n[r] for x in (math.floor(place), math.ceil(place))):
                places.append((i, r, j, below, place))
                wanted.add((i, r))
            below += n[r]
    if not places:
        return {k: {} for k in names}
    some = long.where(reduce(lambda a, b: a | b, [(F.col("i") == i) & F.col("r").isin([r for k, r in wanted if k == i]) for i in {i for i, _ in wanted}]))
    d = some.groupBy("i", "r", "v").agg(*[F.count_if(f"in{j}").alias(f"n{j}") for j in range(len(names))])
    run = W.partitionBy("i", "r").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    d = d.select("i", "r", "v", *[F.sum(f"n{j}").over(run).alias(f"n{j}") for j in range(len(names))])
    d = d.select("i", "r", "v", F.inline(F.array(*[F.struct(F.lit(j).alias("j"), F.col(f"n{j}").alias("upto")) for j in range(len(names))])))
    held = rows.sparkSession.createDataFrame(places, "i int, r int, j int, below bigint, at double")
    d = d.join(F.broadcast(held), ["i", "r", "j"]).select("i", "j", "v", "at", (F.col("below") + F.col("upto")).alias("upto"))
    g = d.groupBy("i", "j").agg(F.first("at").alias("at"), F.min(F.when(F.col("upto") > F.floor("at"), F.col("v"))).alias("a"), F.min(F.when(F.col("upto") > F.ceil("at"), F.col("v"))).alias("b"))
    out: dict[str, dict[str, float]] = {k: {} for k in names}
    for row in g.select("i", "j", (F.col("a") + (F.col("at") - F.floor("at")) * (F.col("b") - F.col("a"))).alias("value")).collect():  # columns x conditions rows
        out[names[row["j"]]][columns[row["i"]]] = row["value"]
    return out


def summary(cells: DataFrame, by: list[str], metric: str) -> DataFrame:
    """Median, range and number of a metric over small result rows; nulls are skipped, bundles counts all."""
    return cells.groupBy(*by).agg(F.count("*").alias("bundles"), F.count(metric).alias("n"), F.round(F.percentile(metric, F.lit(0.5)), 7).alias("median"), F.min(metric).alias("lowest"), F.max(metric).alias("highest"))
