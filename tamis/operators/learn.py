"""Models as distributed jobs: out-of-fold scores with imputation fitted on each training fold, stacking, calibration."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import quantile_by_condition


def boosted_trees(iterations: int = 100, depth: int = 6) -> Estimator:
    return GBTClassifier(maxIter=iterations, maxDepth=depth, stepSize=0.1, weightCol="weight", featuresCol="v", labelCol="label", seed=42)


def forest(trees: int = 100) -> Estimator:
    return RandomForestClassifier(numTrees=trees, weightCol="weight", featuresCol="v", labelCol="label", seed=42)


def logistic() -> Estimator:
    return LogisticRegression(weightCol="weight", featuresCol="v", labelCol="label", maxIter=50)


def clean(c: str) -> Column:
    """The column as a number; NaN and infinities are null."""
    x = F.col(c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def medians(rows: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact medians of the columns that hold numbers."""
    return quantile_by_condition(rows, columns, 0.5, {"all": F.lit(True)})["all"]


def numeric_matrix(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with the columns as numbers: missing and infinite ones take the median, a column without any number goes."""
    middle = medians(rows, columns)
    return rows.withColumns({c: F.coalesce(clean(c), F.lit(middle[c])) for c in columns if c in middle}).drop(*[c for c in columns if c not in middle])


def fit_score(train: DataFrame, test: DataFrame, columns: list[str], estimator: Estimator, middle: dict[str, float] | None = None) -> DataFrame:
    """test with p1. Medians (unless given) and class weights come from train only; a train side of one class gives null scores."""
    first = train.agg(F.avg("label").alias("_prior")).first()
    if first["_prior"] is None or first["_prior"] in (0.0, 1.0):
        return test.withColumn("p1", F.lit(None).cast("double"))
    middle = medians(train, columns) if middle is None else middle
    ready = lambda df: VectorAssembler(inputCols=[f"_{c}" for c in columns], outputCol="v").transform(df.withColumns({f"_{c}": F.coalesce(clean(c), F.lit(middle.get(c, 0.0))) for c in columns}))
    weight = F.when(F.col("label") == 1, (1 - first["_prior"]) / first["_prior"]).otherwise(1.0)
    model = estimator.fit(ready(train).select("v", F.col("label").cast("double").alias("label"), weight.alias("weight")))
    out = model.transform(ready(test).withColumn("weight", F.lit(1.0)))
    return out.withColumn("p1", vector_to_array("probability")[1]).select(*test.columns, "p1")


def out_of_fold(rows: DataFrame, columns: list[str], estimator: Estimator, folds: int) -> DataFrame:
    """Each row scored by a model that did not see its fold. rows are read by every fold: pass stored ones (sweeps.kept). The
    medians of all training sides are found together; the folds are fitted at once."""
    middle = quantile_by_condition(rows, columns, 0.5, {str(k): F.col("fold") != k for k in range(folds)})
    one = lambda k: fit_score(rows.where(F.col("fold") != k), rows.where(F.col("fold") == k), columns, estimator, middle[str(k)])
    carried = inheritable_thread_target(rows.sparkSession)
    with ThreadPoolExecutor(min(folds, 4)) as pool:
        parts = [f.result() for f in [pool.submit(carried(one), k) for k in range(folds)]]
    return reduce(DataFrame.unionByName, parts)


def stack(scores: list[DataFrame], key: str) -> DataFrame:
    """Scores of several models side by side; rows that a model has no score for are left out."""
    wide = [s.select(key, F.col("p1").alias(f"p_{k}")) for k, s in enumerate(scores)]
    return reduce(lambda a, b: a.join(b, key), wide).dropna()


def platt(calibration: DataFrame, scored: DataFrame) -> DataFrame:
    return fit_score(calibration.withColumn("s", F.col("score")), scored.withColumn("s", F.col("score")), ["s"], LogisticRegression(featuresCol="v", labelCol="label", regParam=1e-6)).drop("s")


def isotonic(calibration: DataFrame, scored: DataFrame) -> DataFrame:
    model = IsotonicRegression(featuresCol="score", labelCol="label").fit(calibration.select(F.col("score").cast("double").alias("score"), F.col("label").cast("double").alias("label")))
    out = model.transform(scored)
    return out.withColumn("p1", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("prediction")))).drop("prediction")
