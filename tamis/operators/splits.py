"""Leakage-aware splits, folds and training-set composition; every random choice is a hash of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def draw(key: Column, salt: str) -> Column:
    """A number in [0, 1] from a key: eight hex digits of SHA-256(salt:key)."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), key.cast("string")), 256), 1, 8), 16, 10).cast("double") / 4294967295


def order_key(key: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{salt}:"), key.cast("string")), 256)


def ranked(rows: DataFrame, by: list[str], key: str, salt: str) -> DataFrame:
    """rank (from 1, by hash of the key) and size of each class.

    Rows of a class are counted by the first 16 bits of their hash, and ranked inside such a range, so no task ranks a class."""
    r = rows.withColumn("_h", order_key(F.col(key), salt)).withColumns({"_b": F.substring("_h", 1, 4), "_c": F.to_json(F.struct(*by)) if by else F.lit("")})
    counts = r.groupBy("_c", "_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_c").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_c", "_b", before.alias("_before"), F.sum("_n").over(W.partitionBy("_c")).alias("class_size"))
    rank = F.row_number().over(W.partitionBy("_c", "_b").orderBy("_h", key)) + F.col("_before")
    return r.join(counts, ["_c", "_b"]).withColumn("rank", rank).drop("_b", "_c", "_h", "_before")


def stratified_split(rows: DataFrame, by: list[str], key: str, test: float, salt: str = "42") -> DataFrame:
    r = ranked(rows, by, key, salt)
    return r.withColumn("part", F.when(F.col("rank") <= F.round(F.col("class_size") * test), "test").otherwise("train")).drop("rank", "class_size")


HOUR = 3_600_000_000


def temporal_split(rows: DataFrame, time: str, tie: str, train: float = 0.8, width: int = HOUR) -> DataFrame:
    """part: exactly the first floor(train * n) rows in time (ties by the tie column) are train, the rest test, whatever their class.
    Rows without time are left out. width: the stretches in which rows are ranked, in units of the time column (see timeline)."""
    t = timeline(rows, [], time, tie, width)
    return t.withColumn("part", F.when(F.col("rank") <= F.floor(F.col("class_size") * F.lit(train)), "train").otherwise("test")).drop("rank", "class_size")


def temporal_report(split: DataFrame, time: str) -> DataFrame:
    """One row on a temporal split: sizes, cutoff (the last training time), first test time, whether they are in order, both priors."""
    train, test = F.col("part") == "train", F.col("part") == "test"
    g = split.agg(F.count_if(train).alias("n_train"), F.count_if(test).alias("n_test"), F.max(F.when(train, F.col(time))).alias("cutoff_time"), F.min(F.when(test, F.col(time))).alias("test_time_min"), F.round(F.avg(F.when(train, F.col("label"))), 6).alias("train_prior"), F.round(F.avg(F.when(test, F.col("label"))), 6).alias("test_prior"))
    return g.withColumn("in_order", F.col("cutoff_time") <= F.col("test_time_min"))


def group_partition(rows: DataFrame, group: str, fractions: dict[str, float], required: list[str], salts: int = 20, seed: int = 42) -> DataFrame:
    """part by hash of the group, with the first salt under which every part has every required subtype (the first of all if none is
    required); raises if none has.

    All salts are tried in one pass over distinct (group, subtype); a draw of exactly 1 goes to the last part."""
    cuts, at = [], 0.0
    for name, f in fractions.items():
        at += f
        cuts.append((name, at))

    def part(u: Column) -> Column:
        out = F.when(u < cuts[0][1], cuts[0][0])
        for name, edge in cuts[1:-1]:
            out = out.when(u < edge, name)
        return out.otherwise(cuts[-1][0])

    salted = F.conv(F.substring(F.sha2(F.concat(F.col("salt"), F.lit(":"), F.col(group)), 256), 1, 8), 16, 10).cast("double") / 4294967295
    if not required:
        return rows.withColumn("salt", F.lit(str(seed))).withColumn("part", part(salted))
    names = rows.sparkSession.createDataFrame([(i, f"{seed}-{i}" if i else str(seed)) for i in range(salts)], "salt_no int, salt string")
    seen = rows.select(group, "subtype").distinct().crossJoin(F.broadcast(names)).withColumn("part", part(salted))
    full = seen.where(F.col("subtype").isin(required)).groupBy("salt_no", "salt").agg(F.countDistinct("part", "subtype").alias("k")).where(F.col("k") == len(required) * len(fractions))
    first = full.agg(F.min(F.struct("salt_no", "salt"))["salt"].alias("salt"))
    first = first.select(F.coalesce("salt", F.raise_error(F.lit("no salt gives every part every required subtype"))).alias("salt"))
    return rows.crossJoin(F.broadcast(first)).withColumn("part", part(salted))


def group_folds(rows: DataFrame, group: str, k: int, salt: str = "42") -> DataFrame:
    """fold by group: groups, most positives first, go round the folds in serpentine order; no group is in two folds.

    Groups are ranked inside hash buckets of about 50,000 groups, as many buckets as the groups need."""
    g = rows.groupBy(group).agg(F.sum("label").alias("_p"), F.count("*").alias("_n")).withColumn("_h", order_key(F.col(group), salt))
    buckets = g.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / 50_000)).alias("_k"))
    g = g.crossJoin(F.broadcast(buckets)).withColumn("_b", F.conv(F.substring("_h", 1, 8), 16, 10).cast("bigint") % F.col("_k"))
    r = F.row_number().over(W.partitionBy("_b").orderBy(F.desc("_p"), F.desc("_n"), "_h")) - 1
    turn = r % (2 * k)
    g = g.select(F.col(group).alias("_g"), F.when(turn < k, turn).otherwise(2 * k - 1 - turn).alias("fold"))
    return rows.join(g, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


def contiguous_folds(rows: DataFrame, time: str, tie: str, k: int, width: int) -> DataFrame:
    """fold 0 to k - 1 in blocks of the order; the first (rows modulo k) folds have one row more. Rows without time are left out."""
    t = timeline(rows, [], time, tie, width)
    q, more = F.expr(f"class_size div {k}"), F.col("class_size") % k
    at, edge = F.col("rank") - 1, more * (q + 1)
    fold = F.when(at < edge, F.floor(at / (q + 1))).otherwise(more + F.floor((at - edge) / F.greatest(q, F.lit(1))))
    return t.withColumn("fold", fold.cast("int")).drop("rank", "class_size")


def row_parts(rows: DataFrame, fractions: dict[str, float], key: str, salt: str = "42") -> DataFrame:
    """part of each row by hash of its key alone, whatever its group: a reference that leaks, kept to be compared with."""
    total, at, out, u = sum(fractions.values()), 0.0, None, draw(F.col(key), salt)
    for name, f in list(fractions.items())[:-1]:
        at += f
        out = F.when(u < at / total, name) if out is None else out.when(u < at / total, name)
    last = list(fractions)[-1]
    return rows.withColumn("part", F.lit(last) if out is None else out.otherwise(last))


def nested_split(rows: DataFrame, by: list[str], key: str, test: float, validation: float, salt: str = "42") -> DataFrame:
    """train, validation, test: test is that of stratified_split, validation is drawn from what is left only."""
    r = stratified_split(rows, by, key, test, salt)
    inner = stratified_split(r.where("part = 'train'"), by, key, validation, f"{salt}/validation")
    return r.where("part = 'test'").unionByName(inner.withColumn("part", F.when(F.col("part") == "test", "validation").otherwise("train")))


def thinned(rows: DataFrame, most: int, key: str, salt: str = "42") -> DataFrame:
    """At most so many rows by hash of the key, with exposure: the share of all rows that they are."""
    r = ranked(rows, [], key, salt)
    return r.where(F.col("rank") <= most).withColumn("exposure", F.least(F.lit(most), "class_size") / F.col("class_size")).drop("rank", "class_size")


def required_subtypes(rows: DataFrame, spam_shares: list[float]) -> DataFrame:
    """Subtypes that every part must have: phishing; ham where a mixture leaves weight to it; kinds of spam where one gives them weight. But for phishing, only those that the corpus has."""
    wanted = [*(["ham"] if any(s < 1 for s in spam_shares) else []), *(["bulk_spam", "scam_fraud"] if any(s > 0 for s in spam_shares) else [])]
    found = rows.where(F.col("subtype").isin(wanted)).select("subtype")
    return found.unionByName(rows.sparkSession.createDataFrame([("phishing",)], "subtype string")).distinct()


def split(rows: DataFrame, policy: str, key: str, test: float = 0.2, by: list[str] | None = None, time: str | None = None, group: str | None = None, held: list | None = None, salt: str = "42") -> DataFrame:
    """part (train or test) by policy: random (in the classes of by), temporal, group or host (no group in both), scenario (groups of held are test)."""
    if policy == "random":
        return stratified_split(rows, by or ["label"], key, test, salt)
    if policy == "temporal" and time:
        return temporal_split(rows, time, key, 1 - test)
    if policy in ("group", "host") and group:
        return rows.withColumn("part", F.when(draw(F.coalesce(F.col(group).cast("string"), F.lit("")), salt) < test, "test").otherwise("train"))
    if policy == "scenario" and group and held:
        return rows.withColumn("part", F.when(F.coalesce(F.col(group).isin(held), F.lit(False)), "test").otherwise("train"))
    raise ValueError(f"policy {policy!r} is unknown or lacks its column")


def crossing(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each key and each pair of parts that share it: one grouping, not a join for each pair."""
    parts = rows.groupBy(*keys).agg(F.array_sort(F.collect_set("part")).alias("p")).where(F.size("p") > 1)
    pairs = F.explode(F.flatten(F.transform("p", lambda a: F.transform(F.filter("p", lambda b: b > a), lambda b: F.struct(a.alias("part_a"), b.alias("part_b"))))))
    return parts.select(*keys, pairs.alias("q")).select(*keys, "q.*")


def partition_overlap(rows: DataFrame, key: str) -> DataFrame:
    """Keys that two parts share, for each pair of parts."""
    return crossing(rows, [key]).groupBy("part_a", "part_b").agg(F.count("*").alias("shared"))


def overlap_report(rows: DataFrame, parts: list[str], keys: dict[str, str]) -> DataFrame:
    """For each pair of the parts, shared or not, the number of keys in both (keys: column of the report and of rows), and
    clean: whether no pair shares a key of any kind. All rows and both kinds of key go through one grouping."""
    kinds = F.array(*[F.struct(F.lit(n).alias("kind"), F.col(k).cast("string").alias("value")) for n, k in keys.items()])
    shared = crossing(rows.select("part", F.inline(kinds)), ["kind", "value"]).groupBy("part_a", "part_b").agg(*[F.count_if(F.col("kind") == n).alias(n) for n in keys])
    pairs = rows.sparkSession.createDataFrame([(a, b) for a in parts for b in parts if a < b], "part_a string, part_b string")
    out = pairs.join(shared, ["part_a", "part_b"], "left").select("part_a", "part_b", *[F.coalesce(n, F.lit(0)).alias(n) for n in keys])
    return out.withColumn("clean", F.sum(sum(F.col(n) for n in keys)).over(W.partitionBy()) == 0)  # as many rows as pairs of parts


def hard_negative_flags(rows: DataFrame, fraction: float, key: str, salt: str = "42") -> DataFrame:
    """rows with in_A (positives and ham), in_B (same budget, some ham swapped for hard negatives) and in_C (hard negatives added).

    k = min(round(fraction * ham), hard) hard negatives; rows of other subtypes are in none. Nothing is copied: a row has three flags."""
    hard = F.col("subtype").isin("bulk_spam", "scam_fraud")
    kind = F.when(F.col("subtype") == "phishing", "pos").when(F.col("subtype") == "ham", "ham").when(hard, "hard").otherwise("other")
    r = ranked(rows.withColumn("kind", kind), ["kind"], key, salt)
    sizes = r.agg(F.count_if(F.col("kind") == "ham").alias("_ham"), F.count_if(F.col("kind") == "hard").alias("_hard"))
    r = r.crossJoin(F.broadcast(sizes)).withColumn("_k", F.least(F.round(F.lit(fraction) * F.col("_ham")), F.col("_hard")))
    pos, ham, some = F.col("kind") == "pos", F.col("kind") == "ham", (F.col("kind") == "hard") & (F.col("rank") <= F.col("_k"))
    flags = {"in_A": pos | ham, "in_B": pos | (ham & (F.col("rank") <= F.col("_ham") - F.col("_k"))) | some, "in_C": pos | ham | some}
    return r.withColumns(flags).drop("rank", "class_size", "_ham", "_hard", "_k")


def hard_negatives(rows: DataFrame, fraction: float, key: str, salt: str = "42") -> DataFrame:
    """The training sets of the three conditions (see hard_negative_flags) as rows: a row for each condition that a row is in."""
    r = hard_negative_flags(rows, fraction, key, salt)
    conditions = F.array_compact(F.array(*[F.when(F.col(f"in_{c}"), c) for c in "ABC"]))
    return r.withColumn("condition", F.explode(conditions)).drop("in_A", "in_B", "in_C")


def timeline(rows: DataFrame, by: list[str], time: str, tie: str, width: int) -> DataFrame:
    """rank (from 1, by time, then tie) and class_size of each row in its class; rows without time are left out.

    Stretches of width are counted first, so a task ranks one stretch of a class and not the class."""
    b = rows.where(F.col(time).isNotNull()).withColumn("_b", F.floor(F.col(time) / width))
    one = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by] or [F.lit("")]
    b = b.withColumn("_c", F.concat_ws("|", *one))
    counts = b.groupBy("_c", "_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_c").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_c", "_b", before.alias("_before"), F.sum("_n").over(W.partitionBy("_c")).alias("class_size"))
    rank = F.row_number().over(W.partitionBy("_c", "_b").orderBy(time, tie)) + F.col("_before")
    return b.join(counts, ["_c", "_b"]).withColumn("rank", rank).drop("_b", "_c", "_before")


def forward_chaining(rows: DataFrame, time: str, tie: str, k: int, width: int) -> DataFrame:
    """fold 0 to k - 1 by time, equal blocks that each follow all they are trained on; rows of the first stretch have none."""
    t = timeline(rows, [], time, tie, width)
    block = F.expr(f"class_size div {k + 1}")
    past = F.col("rank") - 1 - (F.col("class_size") - k * block)
    return t.withColumn("fold", F.when((past >= 0) & (block > 0), F.floor(past / block)).cast("int")).drop("rank", "class_size")


def smoke_cap(rows: DataFrame, limit: int, key: str, salt: str = "42") -> DataFrame:
    """At most max(limit, 200) rows by hash of the key, in the class proportions, with five positives or more where there are."""
    n = max(limit, 200)
    total = rows.agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("p")).first()
    if not total["n"]:
        return rows
    positives = min(total["p"], max(5, round(n * total["p"] / total["n"])))
    take = lambda label, k: rows.where(F.col("label") == label).orderBy(order_key(F.col(key), salt), key).limit(k)
    return take(1, positives).unionByName(take(0, n - positives))


def fingerprint(rows: DataFrame, by: list[str], order: str, digest: str, block: int) -> DataFrame:
    """SHA-256 over the digests of each group in order; blocks of the order column are hashed first, so no task lists a group."""
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda s: s["h"]), "")
    b = rows.groupBy(*by, F.floor(F.col(order) / block).alias("_b")).agg(F.sha2(text(F.struct(F.col(order).alias("o"), F.col(digest).alias("h"))), 256).alias("h"))
    return b.groupBy(*by).agg(F.count("*").alias("blocks"), F.sha2(text(F.struct(F.col("_b").alias("o"), F.col("h"))), 256).alias("fingerprint"))
