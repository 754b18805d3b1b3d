"""Quality classifier by positive-unlabelled learning: non-negative unbiased risk (Kiryo et al. 2017)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IS_SPACE, free_name, prefix_hash, span_hash, stored, table

#: Bounds of the training sample: this many trusted positives and unlabelled rows, chosen by hash over all rows.
MOST_POSITIVES = 20_000
MOST_UNLABELLED = 20_000
#: Labelled training rows kept back from the risk to place the threshold and to estimate the class prior.
MOST_TUNING = 20_000
THRESHOLD = 0.7

#: Byte classes of UTF-8 text.
UPPER = np.r_[65:91]
LETTER = np.r_[65:91, 97:123, 128:256]
DIGIT = np.r_[48:58]
PUNCTUATION = [ord(c) for c in ".,;:'"]
MARKS = [ord(c) for c in "!*#$%&@^~=+"]
BARS = [ord(c) for c in "|<>{}[]\\/_"]
FEATURES = ["log_bytes", "upper", "digits", "punctuation", "marks", "bars", "spaces", "newlines", "other", "mean_word", "long_words", "single_words", "upper_words", "marked_words", "repeats_next", "distinct_words", "distinct_cap", "distinct_lines", "line_length", "top_byte", "empty"]


def features(text: str | None) -> np.ndarray:
    """Shape of a text from its bytes and words; nothing else of the row is looked at. Null counts as empty."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    out = np.zeros(len(FEATURES), np.float32)
    n = len(raw)
    if not n:
        out[-1] = 1
        return out
    count = np.bincount(raw, minlength=256) / n
    space = IS_SPACE[raw]
    edge = np.flatnonzero(np.diff(np.r_[True, space, True]))
    start, end = edge[::2], edge[1::2]
    words = len(start)
    lines = text.split("\n")
    out[:9] = np.log1p(n), count[UPPER].sum(), count[DIGIT].sum(), count[PUNCTUATION].sum(), count[MARKS].sum(), count[BARS].sum(), count[[32, 9, 11, 12, 13]].sum(), count[10], 1 - count[LETTER].sum() - count[DIGIT].sum() - space.mean()
    if words:
        size = end - start
        total = lambda flag: np.add.reduceat(flag[: int(end[-1])].astype(np.int32), start)
        letters = IS_UPPER[raw]
        ends = raw[end - 1]
        code = span_hash(prefix_hash(raw), start, end) ^ size.astype(np.uint64)
        distinct = len(np.unique(code))
        out[9:17] = size.mean() / 10, (size > 14).mean(), (size == 1).mean(), (total(letters) * 2 > size).mean(), IS_MARK[ends].mean(), (code[1:] == code[:-1]).mean() if words > 1 else 0, distinct / words, min(distinct, 200) / min(words, 200)
    out[17:20] = len(set(lines)) / len(lines), np.log1p(n / len(lines)) / 5, count.max()
    return out


IS_UPPER = np.isin(np.arange(256), UPPER)
IS_MARK = np.isin(np.arange(256), MARKS)


def feature_table(docs: DataFrame) -> DataFrame:
    """doc_id, row_hash (of the text, to choose samples), x array<float>: one narrow pass over the whole texts."""

    fields = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float32()))])

    def run(batches):
        for batch in batches:
            x = [features(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float32()))], schema=fields)

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id bigint, x array<float>")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("bigint").cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Model:
    """Standardised features through one hidden layer; score = sigmoid, shifted so that the threshold sits where it should."""

    def __init__(self, mean, scale, w1, b1, w2, b2, shift=0.0):
        self.mean, self.scale, self.w1, self.b1, self.w2, self.b2, self.shift = mean, scale, w1, b1, w2, b2, shift

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2 + self.shift

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 24, epochs: int = 60, seed: int = 5) -> Model:
    """Minimise prior * R+(positive) + max(0, R-(unlabelled) - prior * R-(positive)) with the sigmoid loss.

    When the second part of a batch falls below zero the step goes against its gradient instead, as in the published
    algorithm. Adam, fixed seed: the same sample gives the same model.
    """
    rng = np.random.default_rng(seed)
    both = np.vstack([positive, unlabelled]).astype(np.float64)
    mean, scale = both.mean(0), both.std(0) + 1e-3
    d = both.shape[1]
    p = [rng.normal(0, 1 / np.sqrt(d), (d, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v, t = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
    zp, zu = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    batches = max(1, len(zu) // 512)

    def risk(z, sign, weight):
        """Mean sigmoid loss of margin sign * f and its gradient."""
        h = np.tanh(z @ p[0] + p[1])
        loss = 1 / (1 + np.exp(np.clip(sign * (h @ p[2] + p[3]), -30, 30)))
        g = -sign * loss * (1 - loss) * weight / len(z)
        back = np.outer(g, p[2]) * (1 - h * h)
        return weight * loss.mean(), [z.T @ back, back.sum(0), h.T @ g, np.array([g.sum()])]

    for _ in range(epochs):
        ip, iu = rng.permutation(len(zp)), rng.permutation(len(zu))
        for a, b in zip(np.array_split(ip, batches), np.array_split(iu, batches)):
            if not len(a) or not len(b):
                continue
            _, g_pos = risk(zp[a], 1, prior)
            r_neg, g_neg = risk(zp[a], -1, -prior)
            r_unl, g_unl = risk(zu[b], -1, 1.0)
            rest = [x + y for x, y in zip(g_neg, g_unl)]
            grad = [x + y for x, y in zip(g_pos, rest)] if r_unl + r_neg >= 0 else [-x for x in rest]
            t += 1
            for k, g in enumerate(grad):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 0.01 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Model(mean, scale, p[0], p[1], p[2], float(p[3][0]))


def train(x: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> Model | None:
    """A model from feature_table() rows and labels(doc_id, quality). Rows held out are never read for their labels.

    Trusted positives: training rows with quality 1. Unlabelled: rows of the web text whatever their label, which is not
    looked at. The class prior is the share of quality 1 among labelled training rows; the same rows place the
    threshold. Each sample takes the rows of smallest hash, up to its documented bound. None without labelled positives.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    joined = x.where(~held_out()).join(known.where(~held_out()), "doc_id").select("x", "quality", F.xxhash64("doc_id", F.lit(3)).alias("h"))
    take = lambda df, n: df.orderBy("h").limit(n).toPandas()  # noqa: E731  a bounded sample
    array = lambda pdf: np.array(pdf["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
    tuning = take(joined, MOST_TUNING)
    if not len(tuning) or not (tuning["quality"] == 1).any():
        return None
    prior = float(np.clip((tuning["quality"] == 1).mean(), 0.02, 0.98))
    positive = array(take(joined.where("quality = 1"), MOST_POSITIVES))
    unlabelled = array(take(x.select("x", F.xxhash64("doc_id", F.lit(4)).alias("h")), MOST_UNLABELLED))
    model = fit_nnpu(positive, unlabelled, prior)
    z, y = model.logit(array(tuning)), (tuning["quality"] == 1).to_numpy()
    if y.all():
        return model
    # the logit at which training rows are told apart best becomes the threshold
    cuts = np.unique(np.r_[np.quantile(z, np.linspace(0.001, 0.999, 999))])
    right = np.array([((z >= c) & y).sum() / y.sum() + ((z < c) & ~y).sum() / (~y).sum() for c in cuts])
    best = np.flatnonzero(right >= right.max() - 1e-9)
    model.shift = float(np.log(threshold / (1 - threshold)) - (cuts[best[0]] + cuts[best[-1]]) / 2)
    return model


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted.

    Whole texts are scored; null texts count as empty and are scored as such; a null doc_id is never held out and never
    labelled; repeated rows get the same score; several labels of one id count as the lowest. Without any label of
    quality 1 to learn from every score is 1. An empty table gives no rows.
    """
    x = stored(feature_table(docs), "features")
    model = train(x, labels, threshold)

    def run(batches):
        for pdf in batches:
            z = np.array(pdf["x"].tolist(), np.float64).reshape(-1, len(FEATURES))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": np.ones(len(pdf)) if model is None else model.score(z)})

    out = x.mapInPandas(run, "doc_id bigint, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose text the model rejects; columns and all other rows unchanged. The rows are written once
    with their features, from which the model is trained and which it scores."""
    name = free_name(docs, "features")
    shape = F.pandas_udf(lambda texts: pd.Series([features(t).tolist() for t in texts], dtype=object), "array<float>")
    marked = stored(docs.withColumn(name, shape(F.col("text").cast("string"))), "features")
    model = train(marked.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(name).alias("x")), labels, threshold)
    if model is None:
        return docs
    column = F.pandas_udf(lambda x: pd.Series(model.score(np.array(x.tolist(), np.float64).reshape(-1, len(FEATURES)))), "double")
    return marked.where(column(name) >= threshold).select(*[f"`{c}`" for c in docs.columns])


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = {}
