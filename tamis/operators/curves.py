"""Average precision over resampled groups, from prefix sums that carry a vector of replicate weights."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import in_ranges
from .prevalence import POISSON, interval


@lru_cache(maxsize=20_000)
def replicate_weights(group: str | None, replicates: int, salt: str) -> np.ndarray:
    """Weight 1, then how often each replicate draws the group: prevalence.poisson_weight() as a vector."""
    name = [salt, "", *([] if group is None else [group])]
    u = np.empty(replicates)
    for r in range(replicates):
        name[1] = str(r)
        u[r] = int(hashlib.sha256(":".join(name).encode()).hexdigest()[:8], 16)
    return np.append(1, np.searchsorted(POISSON, u / 4294967296, side="right")).astype(np.int8)


def _ranges_of(rows: DataFrame, replicates: int, salt: str) -> DataFrame:
    """which, _r, p, n: the weighted sums of each range of scores, a vector each; its groups stream past."""

    def run(batches):
        sums: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for which, r, g, p, n in zip(pdf["which"], pdf["_r"], pdf["g"], pdf["p"], pdf["n"]):
                at = sums.setdefault((which, r), np.zeros((2, replicates + 1)))
                w = replicate_weights(g, replicates, salt)
                at[0] += np.float64(p) * w
                at[1] += np.float64(n) * w
        if sums:
            yield pd.DataFrame({"which": [k[0] for k in sums], "_r": [k[1] for k in sums], "p": [v[0] for v in sums.values()], "n": [v[1] for v in sums.values()]})

    g = rows.groupBy("which", "_r", "g").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    return g.repartition("which", "_r").mapInPandas(run, "which string, _r int, p array<double>, n array<double>")


def _above(ranges: DataFrame) -> DataFrame:
    """which, _r, p, n (sums of the ranges above), t (all positives); a score has a fixed number of ranges."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_r", ascending=False)
        p, n = (np.cumsum(np.stack(pdf[c]), axis=0) for c in "pn")
        before = lambda x: [np.zeros(x.shape[1]), *x[:-1]]
        return pd.DataFrame({"which": pdf["which"].to_numpy(), "_r": pdf["_r"].to_numpy(), "p": before(p), "n": before(n), "t": [p[-1]] * len(pdf)})

    return ranges.groupBy("which").applyInPandas(run, "which string, _r int, p array<double>, n array<double>, t array<double>")


def replicated_aucpr(scored: DataFrame, group: str, scores: list[str], replicates: int = 2000, salt: str = "42", parts: int = 64) -> DataFrame:
    """which, rep, aucpr: the average precision (ties count at their common score) of each score column under the weights of
    each replicate; rep -1 is the measured one. Replicates without a positive are left out.

    Rows collapse to (score, group) counts; scores are cut in ranges. The vector of a range's weighted sums is added up over its
    groups, the ranges' vectors are summed from above, and each range then streams its scores in order with running vectors.
    A task holds a few vectors of `replicates` numbers, never rows times replicates; no more than groups x ranges counts and
    ranges x replicates sums are shuffled. Rows that lack one of the scores are left out of all."""
    have = scored.select(F.col(group).cast("string").alias("g"), F.col("label").cast("bigint").alias("label"), *[F.col(c).cast("double").alias(c) for c in scores]).dropna(subset=["label", *scores])
    long = have.select("g", "label", F.inline(F.array(*[F.struct(F.lit(c).alias("which"), F.col(c).alias("score")) for c in scores])))
    d = long.groupBy("which", "score", "g").agg(F.sum("label").alias("p"), F.count("*").alias("n"))
    cut = in_ranges(d, ["which"], "score", parts).select("which", "_r", "score", "g", "p", "n")
    heads = _above(_ranges_of(cut, replicates, salt))
    none = F.lit(None).cast("array<double>")
    rows = cut.select("which", "_r", F.lit(1).alias("front"), "score", "g", "p", "n", none.alias("pv"), none.alias("nv"), none.alias("tv"))
    first = heads.select("which", "_r", F.lit(0).alias("front"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("g"), F.lit(0).cast("bigint").alias("p"), F.lit(0).cast("bigint").alias("n"), F.col("p").alias("pv"), F.col("n").alias("nv"), F.col("t").alias("tv"))

    def run(batches):
        name = last = None
        zero = lambda: np.zeros(replicates + 1)
        cp = cn = total = at_p = at_n = out = zero()

        def flush():
            nonlocal cp, cn, out, at_p, at_n
            cp, cn = cp + at_p, cn + at_n
            out = out + np.divide(cp * at_p, cn, out=zero(), where=cn > 0)
            at_p, at_n = zero(), zero()

        def row():
            flush()
            share = np.divide(out, total, out=np.full(replicates + 1, np.nan), where=total > 0)
            return pd.DataFrame({"which": [name], "parts": [np.where(np.isnan(share), None, share).tolist()]})

        for pdf in batches:
            for which, front, score, g, p, n, pv, nv, tv in zip(*[pdf[c] for c in ("which", "front", "score", "g", "p", "n", "pv", "nv", "tv")]):
                if front == 0:
                    if name is not None:
                        yield row()
                    name, last, cp, cn, total, out, at_p, at_n = which, None, np.array(pv), np.array(nv), np.array(tv), zero(), zero(), zero()
                    continue
                if score != last:
                    flush()
                    last = score
                w = replicate_weights(g, replicates, salt)
                at_p = at_p + np.float64(p) * w
                at_n = at_n + np.float64(n) * w
        if name is not None:
            yield row()

    streams = first.unionByName(rows).repartition("which", "_r").sortWithinPartitions("which", "_r", "front", F.desc("score"))
    sums = streams.mapInPandas(run, "which string, parts array<double>")
    each = sums.select("which", F.posexplode("parts").alias("rep", "part")).where("part IS NOT NULL")
    return each.groupBy("which", (F.col("rep") - 1).alias("rep")).agg(F.sum("part").alias("aucpr"))


def aucpr_bootstrap(scored: DataFrame, group: str, a: str, b: str, replicates: int = 2000, salt: str = "42", parts: int = 64) -> DataFrame:
    """Average precision of two scores over the same resampled groups: a row for each and one for a - b with the measured value,
    the 95 % percentile interval, the number of replicates with positives and the share of them above 0 (by 1e-12 or more).
    Without a positive there is no row."""
    each = replicated_aucpr(scored, group, [a, b], replicates, salt, parts)
    pair = each.groupBy("rep").agg(*[F.max(F.when(F.col("which") == c, F.col("aucpr"))).alias(k) for c, k in ((a, "x"), (b, "y"))])
    long = pair.select("rep", F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), v.alias("v")) for m, v in (("a", F.col("x")), ("b", F.col("y")), ("a - b", F.col("x") - F.col("y")))])))
    drawn = F.when(F.col("rep") >= 0, F.col("v"))
    out = long.groupBy("measure").agg(F.round(F.max(F.when(F.col("rep") < 0, F.col("v"))), 6).alias("value"), F.count(drawn).alias("replicates"), *interval(drawn), F.round(F.count_if(drawn > 1e-12) / F.count(drawn), 6).alias("share_above"))
    return out
