"""Secret scan: candidates by expression, a random forest on their shape and surroundings removes false positives."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, dropped, stored, table, text_or_empty
from .findings import NAMES, WORDS, planted_findings

#: A candidate is a run of key characters with a digit or a well-known key in it, this long at least; longer ones are judged
#: whole. What is assigned to a credential word is a candidate whatever its length and characters (ASSIGNED).
SHORTEST = 12
RUN = r"[A-Za-z0-9_+/\-]{12,}={0,2}"
#: A word can hold a candidate only if this is found in it; also the test for whole texts.
GATE = r"[A-Za-z0-9_+/\-]{12}"
#: Words that stand before credentials, formats of well-known keys, and formats that only look like keys.
NEAR_WORDS = ["password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "auth", "bearer", "credential", "private_key", "client_secret"]
PATH_WORDS = ["test", "example", "sample", "mock", "fixture", "doc", "readme"]
KNOWN_KEYS = [r"^AKIA[0-9A-Z]{16}$", r"^ASIA[0-9A-Z]{16}$", r"^gh[pousr]_[A-Za-z0-9]{36}", r"^xox[abpr]-[A-Za-z0-9\-]{10,}", r"^sk_live_[A-Za-z0-9]{16,}", r"^AIza[0-9A-Za-z_\-]{35}$", r"^eyJ[A-Za-z0-9_\-]{10,}"]
LOOKALIKES = [r"^[0-9+/\-]+$", r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", r"^[a-z]+[0-9]{1,4}$", r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{4}[0-9]+$"]
KNOWN = r"(?<![A-Za-z0-9])(?:" + "|".join(k.strip("^$") for k in KNOWN_KEYS) + ")"
_QUOTED = "|".join(rf"(?<={q})(?:[^{q}\\]++|\\[\s\S])++(?={q})" for q in "\"'`")
#: A credential word (1) and, looked at only so that values may hold further ones, what leads to its value (2: the rest of the
#: name, = or :, an opening quote) and the value (3): all between quotes, otherwise all up to white space.
ASSIGNED = r"(?i)(" + "|".join(NEAR_WORDS) + r")(?=([\w\-]*[\"'`]?\s*(?:=>|:=|==?|:)\s*(?:(?:bearer|basic)\s+)?[\"'`]?)(" + _QUOTED + r"|(?![\"'`])\S+))"
#: Bounds of the training sample (findings taken by smallest hash) and of the dictionary (commonest words).
MOST_FINDINGS = 40_000
DICTIONARY_WORDS = 5_000
TREES, DEPTH = 40, 8
FEATURES = ["length", "digit_share", "upper_share", "symbol_share", "class_changes", "transition_score", "letter_pairs", "vowel_share", "distinct_share", "dictionary_share", "near_word", "assigned", "quoted", "path_flag", "prior_length"]


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)).cast("double")


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def runs_of(word: Column) -> Column:
    return F.filter(F.regexp_extract_all(word, F.lit(RUN), F.lit(0)), lambda r: r.rlike("[0-9]") | r.rlike(KNOWN))


def assigned_values(text: Column, words: Column) -> Column:
    """Array of (i, run_no, candidate, own) of the values of ASSIGNED that are no runs of their word: word number, a number
    after those of the word's runs, value, what leads to it. Word numbers follow from the white space passed over."""
    kind = "array<struct<i:int,run_no:int,candidate:string,own:string>>"
    spaces = lambda c: F.regexp_count(c, F.lit(SPACE))
    parts = F.struct(F.split(text, ASSIGNED, -1).alias("between"), *[F.regexp_extract_all(text, F.lit(ASSIGNED), F.lit(k)).alias(n) for k, n in ((1, "name"), (2, "lead"), (3, "value"))])

    def step(p: Column, a: Column, j: Column) -> Column:
        at = a["n"] + spaces(F.get(p["between"], j))
        here = F.struct(at.alias("n"), (at + spaces(F.get(p["lead"], j))).alias("i"), F.get(p["value"], j).alias("v"), F.concat(F.get(p["name"], j), F.get(p["lead"], j)).alias("own"))

        def add(h: Column) -> Column:
            seen = (h["i"] == a["i"]) & (h["v"] == a["v"])  # auth_token=x is met at auth and at token
            k = F.when(h["i"] != a["i"], F.lit(0)).when(seen, a["k"]).otherwise(a["k"] + 1)
            word = F.get(words, h["i"])
            one = F.array(F.struct(h["i"].alias("i"), (F.regexp_count(word, F.lit(RUN)) + k).alias("run_no"), h["v"].alias("candidate"), h["own"].alias("own")))
            new = F.when(seen | F.array_contains(runs_of(word), h["v"]), a["all"]).otherwise(F.concat(a["all"], one))
            return F.struct(h["n"].alias("n"), h["i"].alias("i"), k.cast("int").alias("k"), h["v"].alias("v"), new.cast(kind).alias("all"))

        return let(here, add)

    first = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("i"), F.lit(0).alias("k"), F.lit("").alias("v"), F.array().cast(kind).alias("all"))
    each = lambda p: F.when(F.size(p["value"]) > 0, F.aggregate(F.sequence(F.lit(0), F.size(p["value"]) - 1), first, lambda a, j: step(p, a, j))["all"])
    return let(parts, each)


def candidates(docs: DataFrame, path_column: str | None = "source") -> DataFrame:
    """One row for each candidate: doc_id, word_no, run_no, candidate, before (three words), own (the word without the
    candidate; for an assigned value the name and sign before it), path. Whole texts are read; texts that cannot hold a candidate are passed over by one search."""
    path = F.col(path_column).cast("string") if path_column and path_column in docs.columns else F.lit(None).cast("string")
    t = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("t"), path.alias("path"))
    t = t.withColumn("assigned", F.col("t").rlike(ASSIGNED)).where(F.col("assigned") | (F.col("t").rlike(GATE) & (F.col("t").rlike(r"[0-9]") | F.col("t").rlike(KNOWN))))
    words = t.select("doc_id", "path", "t", "assigned", F.split("t", SPACE).alias("w"))
    # keep positions of words with a candidate only, then look at their neighbours
    at = F.filter(F.transform("w", lambda x, i: F.struct(i.alias("i"), F.when(x.rlike(GATE), runs_of(x)).alias("runs"))), lambda s: F.coalesce(F.size(s["runs"]), F.lit(0)) > 0)
    runs = F.flatten(F.transform(at, lambda s: F.transform(s["runs"], lambda r, k: F.struct(s["i"].alias("i"), k.alias("run_no"), r.alias("candidate"), F.lit(None).cast("string").alias("own")))))
    values = F.when(F.col("assigned"), assigned_values(F.col("t"), F.col("w")))
    rows = words.select("doc_id", "path", "w", F.explode(F.concat(runs, F.coalesce(values, F.array().cast("array<struct<i:int,run_no:int,candidate:string,own:string>>")))).alias("at"))
    before = F.array_join(F.slice("w", F.greatest(F.lit(1), F.col("at.i") - 2), F.least(F.lit(3), F.col("at.i"))), " ")
    rows = rows.select("doc_id", "path", F.col("at.i").alias("word_no"), F.expr("w[at.i]").alias("word"), before.alias("before"), "at.run_no", "at.candidate", "at.own")
    return rows.withColumn("own", F.expr("coalesce(own, replace(word, candidate, ' '))")).drop("word")


def dictionary(docs: DataFrame, words: int = DICTIONARY_WORDS) -> DataFrame:
    """word, count: the commonest lower-case words of 3 to 12 letters, counted once a text over all texts, at most `words` rows,
    and the words of the made-up findings."""
    w = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text_or_empty()), F.lit(r"\b[a-z]{3,12}\b"), F.lit(0)))).alias("word"))
    own = docs.sparkSession.createDataFrame([(x, 1) for x in sorted({*WORDS, *(p for n in NAMES for p in n.split("_"))})], "word string, count bigint")
    return w.groupBy("word").count().orderBy(F.desc("count"), "word").limit(words).unionByName(own).groupBy("word").agg(F.sum("count").alias("count"))


def pairs_of(word: Column) -> Column:
    """The neighbouring characters of a word, two by two."""
    n = F.length(word)
    return F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(word, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


#: Log-likelihood of a step that no dictionary word has.
UNSEEN = -8.0


def transitions(words: DataFrame) -> DataFrame:
    """pair, score: the log-likelihood of a letter after another, learned from the dictionary's words and their counts (676 rows at most)."""
    p = words.select("count", F.explode(pairs_of(F.col("word"))).alias("pair")).groupBy("pair").agg(F.sum("count").alias("n"))
    total = p.groupBy(F.substring("pair", 1, 1).alias("_first")).agg(F.sum("n").alias("_total"))
    return p.join(F.broadcast(total), F.substring("pair", 1, 1) == F.col("_first")).select("pair", F.log((F.col("n") + 1) / (F.col("_total") + 26)).alias("score"))


def features(found: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """The forest's inputs. words: the dictionary (bounded) and the transitions learned from it, broadcast as one row."""
    c, low = F.col("candidate"), F.lower(F.col("candidate"))
    n = F.length(c).cast("double")
    around = F.lower(F.concat_ws(" ", "before", "own"))
    changes = count_of(c, "(?<=[a-z])(?=[^a-z])") + count_of(c, "(?<=[A-Z])(?=[^A-Z])") + count_of(c, "(?<=[0-9])(?=[^0-9])")
    near = reduce(lambda a, b: a | b, [F.contains(around, F.lit(w)) for w in NEAR_WORDS])
    path = F.lower(F.coalesce("path", F.lit("")))
    parts = F.array_distinct(F.regexp_extract_all(low, F.lit("[a-z]{3,12}"), F.lit(0)))
    if words is not None:
        bag = words.agg(F.collect_list("word").alias("_bag"))  # at most DICTIONARY_WORDS words and our own
        steps = transitions(words).agg(F.map_from_entries(F.collect_list(F.struct("pair", "score"))).alias("_steps"))
        found = found.crossJoin(F.broadcast(bag)).crossJoin(F.broadcast(steps))  # one row each
        covered = F.aggregate(F.array_intersect(parts, F.col("_bag")), F.lit(0), lambda a, w: a + F.length(w)) / n
        likely = F.aggregate(pairs_of(low), F.lit(0.0), lambda a, p: a + F.coalesce(F.try_element_at("_steps", p), F.lit(UNSEEN))) / F.greatest(n - 1, F.lit(1.0))
    else:
        covered = likely = F.lit(0.0)
    out = found.withColumns({
        "length": n,
        "digit_share": count_of(c, "[0-9]") / n,
        "upper_share": count_of(c, "[A-Z]") / n,
        "symbol_share": count_of(c, "[^A-Za-z0-9]") / n,
        "class_changes": changes / n,
        "transition_score": likely,
        "letter_pairs": count_of(low, "(?=[a-z]{2})") / n,
        "vowel_share": count_of(low, "[aeiou]") / n,
        "distinct_share": F.size(F.array_distinct(F.split(c, ""))) / n,
        "dictionary_share": covered.cast("double"),
        "near_word": near.cast("double"),
        "assigned": F.col("own").rlike("[=:]").cast("double") + F.col("before").rlike("[=:]\\s*$").cast("double"),
        "quoted": F.col("own").rlike("[\"'`]").cast("double"),
        "path_flag": reduce(lambda a, b: a | b, [F.contains(path, F.lit(w)) for w in PATH_WORDS]).cast("double"),
        "prior_length": F.length("before").cast("double"),
    })
    return out.drop("_bag", "_steps") if words is not None else out


def by_rule(found: DataFrame) -> DataFrame:
    """rule_label for findings whose kind a rule on their format settles, null for the others; no part of what the forest learns.

    1: the format of a known key, or 16 and more mixed characters assigned next to a credential word. 0: a format that
    only looks like one, or a run of letters with a few digits and no such word near."""
    c = F.col("candidate")
    around = F.lower(F.concat_ws(" ", "before", "own"))
    known = reduce(lambda a, b: a | b, [c.rlike(k) for k in KNOWN_KEYS])
    near = reduce(lambda a, b: a | b, [F.contains(around, F.lit(w)) for w in NEAR_WORDS])
    like = reduce(lambda a, b: a | b, [c.rlike(k) for k in LOOKALIKES])
    digits = F.regexp_count(c, F.lit("[0-9]")) / F.length(c)
    return found.withColumn("rule_label", F.when(known, 1.0).when(like, 0.0).when(near & (F.length(c) >= 16) & (digits > 0.15), 1.0).when(~near & (digits < 0.1), 0.0))


def labelled_candidates(spark: SparkSession, seed: str = "1") -> DataFrame:
    """candidates() of the made-up findings with their planted label: what is trained on where no reviewed findings are given."""
    made = planted_findings(spark, seed=seed)
    known = made.select(F.col("doc_id").alias("_id"), "value", "label")
    found = candidates(made)
    return found.join(known, (F.col("doc_id") == F.col("_id")) & (F.col("candidate") == F.col("value"))).drop("_id", "value")


def train(labelled: DataFrame, seed: int = 7, most: int = MOST_FINDINGS) -> RandomForestClassificationModel | None:
    """A forest from findings with FEATURES and label, on at most `most` of them (by smallest hash of the candidate,
    equal candidates once). None if only one class is there."""
    once = labelled.where("label is not null").groupBy("candidate").agg(*[F.max(f).alias(f) for f in FEATURES], F.max("label").alias("label"))
    sample = stored(once.orderBy(F.xxhash64("candidate", F.lit(seed)), "candidate").limit(most).drop("candidate"), "findings")
    if sample.select("label").distinct().count() < 2:
        return None
    data = VectorAssembler(inputCols=FEATURES, outputCol="v", handleInvalid="keep").transform(sample)
    return RandomForestClassifier(featuresCol="v", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=seed, subsamplingRate=0.8).fit(data)


def scan(docs: DataFrame, labelled: DataFrame | None = None, path_column: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """One row for each candidate: doc_id, word_no, run_no, secret_sha256, length, rule_label, features, score, is_secret.

    labelled: reviewed findings (the columns of candidates() and label 0/1); without it the forest learns from made-up ones
    (findings.planted_findings), whose label is that of the planting. rule_label is what a rule on formats says (null: nothing); the
    forest does not see it. The candidate itself is not returned, only its hash and shape. Null texts count as empty and give no rows; a null path is an
    empty one; repeated rows give repeated findings; without both classes to learn from, score is rule_label (0.5 where unknown).
    Candidates of equal features have equal scores. Other columns are not read; an empty table gives no rows.
    """
    words = stored(dictionary(docs), "dictionary")
    found = stored(features(candidates(docs, path_column), words), "candidates")
    model = train(features((labelled if labelled is not None else labelled_candidates(docs.sparkSession)).drop(*FEATURES), words))
    marked = by_rule(found)
    if model is None:
        out = marked.withColumn("score", F.coalesce("rule_label", F.lit(0.5)))
    else:
        data = VectorAssembler(inputCols=FEATURES, outputCol="v", handleInvalid="keep").transform(marked)
        out = model.transform(data).withColumn("score", vector_to_array("probability")[1])
    dropped(words)
    return out.select("doc_id", "word_no", "run_no", F.sha2("candidate", 256).alias("secret_sha256"), F.col("length").cast("int").alias("length"), F.col("rule_label").cast("int").alias("rule_label"), *FEATURES[1:], F.round("score", 6).alias("score"), (F.col("score") >= threshold).alias("is_secret"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


ORACLE = {}
