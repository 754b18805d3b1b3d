"""Sketches of distinct counts and quantiles that are stored by day or capture and merged instead of scanning the rows again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: HLL registers (2 to this power) and KLL size.
LOG_REGISTERS, KLL = 12, 200
#: Stated errors: three standard deviations of the distinct count, and the rank error of a quantile, each as a share.
DISTINCT_ERROR, RANK_ERROR = 3 * 1.04 / 2 ** (LOG_REGISTERS / 2), 0.0265


def sketched(rows: DataFrame, by: list[str], key: str, value: str) -> DataFrame:
    """One row for each group (say a day and a model): n, valued, distinct_keys and quantile sketches. Null and NaN values are
    not in the quantiles; null keys are not counted."""
    v = F.col(value).cast("double")
    v = F.when(~F.isnan(v), v)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count(v).alias("valued"), F.hll_sketch_agg(F.col(key).cast("string"), LOG_REGISTERS).alias("distinct_keys"), F.kll_sketch_agg_double(v, KLL).alias("quantiles"))


def merged(sketches: DataFrame, by: list[str], quantiles: dict[str, float]) -> DataFrame:
    """by, n, valued, distinct_keys (estimate) and a column for each quantile, from stored sketches alone: a month is the union
    of its days. Groups without a value have null quantiles."""
    g = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("valued").alias("valued"), F.hll_union_agg("distinct_keys").alias("_h"), F.kll_merge_agg_double("quantiles").alias("_q"))
    at = {name: F.when(F.col("valued") > 0, F.kll_sketch_get_quantile_double("_q", F.lit(q))) for name, q in quantiles.items()}
    return g.select(*by, "n", "valued", F.hll_sketch_estimate("_h").alias("distinct_keys"), *[c.alias(name) for name, c in at.items()])
