"""Labelled findings for the secret scan: values planted in made-up lines, so that the label comes from the planting and not from a rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, stored

#: Findings of a default training table; ids are negative, so they meet no document.
FINDINGS = 6_000
#: Where values stand: lines that name a credential, and lines that do not. Both kinds of value stand in both, but for hex
#: digests, which only their surroundings tell from keys: named ones are secrets, unnamed ones are commits and checksums.
NAMED = ["{n} = {v}", "{n}: {v}", '"{n}": "{v}",', "export {N}={v}", "{n} := '{v}'", "curl -H 'Authorization: Bearer {v}' https://host/api", "https://host/x?{n}={v}&page=2", "the {n} for staging is {v} until friday", "set {n} to {v}", "{n}={v} # local"]
BARE = ["please use {v} to sign in", "{v}", "- {v} # rotate", "see {v} in the log", "id {v} was added", "commit {v} by build", "checksum {v} of the archive", "key={v}", "value: {v}", "row 17 {v} done"]
DIGEST_SECRET, DIGEST_OTHER = 3, 13
NAMES = ["password", "token", "secret", "api_key", "client_secret", "auth_token", "db_password", "access_key"]
WORDS = ["user", "config", "session", "service", "default", "value", "handler", "response", "required", "update", "index", "customer", "report", "storage", "optional", "network", "message", "example", "account", "release"]
PLACES = ["src/app", "tests/fixtures", "docs/readme", "deploy/env", "examples/sample", ""]


def _number(place: int, n: int) -> Column:
    """The place-th of 32 numbers of a row, below n."""
    return F.conv(F.substring("_draws", 1 + 8 * place, 8), 16, 10).cast("bigint") % n


def _one_of(values: list[str], place: int) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (_number(place, len(values)) + 1).cast("int"))


def _cut(c: Column, low: int, high: int, place: int) -> Column:
    """The first characters of c, low to high of them."""
    return F.substring(c, F.lit(1), (_number(place, high - low + 1) + low).cast("int"))


def _chosen(values: list[Column], place: int) -> Column:
    at, out = _number(place, len(values)), F.when(F.lit(False), F.lit(""))
    for k, v in enumerate(values):
        out = out.when(at == k, v)
    return out


def planted_findings(spark: SparkSession, n: int = FINDINGS, seed: str = "1") -> DataFrame:
    """doc_id, text, source, value, label: n lines with one value each, the same for the same seed. Half of the values are drawn at
    random, as keys and passwords are (label 1); half are what scanners mistake for them: identifiers, paths, placeholders,
    references to variables, serial numbers, dates, versions, ids in their usual format (label 0). Lines, names and places are
    drawn alike for both."""
    hexes = lambda k: F.sha2(F.concat(F.lit(f"{seed}:{k}:"), F.col("id").cast("string")), 512)
    base = spark.range(n).select("id", (F.col("id") % 2).cast("double").alias("label"), hexes(0).alias("_hex"), F.concat(hexes(1), hexes(2)).alias("_draws"))
    plain = F.regexp_replace(F.base64(F.unhex(F.concat("_hex", F.substring("_draws", 1, 64)))), "[\r\n=]", "")
    base = stored(base.withColumns({"_mixed": plain, "_letters": F.translate(plain, "+/", ""), "_word": F.concat_ws(" ", *[_one_of(WORDS, 24 + k) for k in range(7)])}), "drawn")
    mixed, letters, digest = F.col("_mixed"), F.col("_letters"), F.col("_hex")
    word = lambda k: F.get(F.split("_word", " "), F.lit(k))
    number = lambda low, high, place: (_number(place, high - low + 1) + low).cast("string")
    secrets = [
        _cut(letters, 20, 64, 0), _cut(letters, 14, 32, 0), _cut(mixed, 24, 60, 0), _cut(digest, 16, 64, 0), F.translate(_cut(mixed, 9, 20, 0), "+/ABab", "!@#$%&"),
        F.concat(F.lit("AKIA"), F.substring(F.upper(F.translate(letters, "189", "XYZ")), 1, 16)), F.concat(F.lit("ghp_"), F.substring(letters, 1, 36)), F.concat(F.lit("sk_live_"), _cut(letters, 20, 30, 0)),
        F.concat_ws("-", _cut(letters, 8, 12, 0), _cut(F.reverse(letters), 8, 12, 1)), F.concat_ws("_", word(0), _cut(letters, 14, 24, 0)),
    ]
    others = [
        F.concat(word(0), F.initcap(word(1)), F.initcap(word(2)), number(1, 99, 0)), F.concat_ws("_", word(0), word(1), number(1, 2030, 0)), F.concat(F.lit("/usr/"), word(0), F.lit("/"), word(1), F.lit("/v"), number(1, 9, 0), F.lit("/"), word(2)),
        F.concat(F.lit("your_"), word(0), F.lit("_here123")), F.concat(F.lit("${"), F.upper(word(0)), F.lit("_"), F.upper(word(1)), F.lit("}")), F.concat(F.lit("<"), word(0), F.lit("-"), word(1), F.lit("-1>")),
        F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.substring(digest, 13, 4), F.substring(digest, 17, 4), F.substring(digest, 21, 12)), F.conv(F.substring(digest, 1, 12), 16, 10), F.concat(F.lit("2024-"), F.lpad(number(1, 12, 0), 2, "0"), F.lit("-01T10-00-"), number(10, 59, 1)),
        F.concat_ws("-", word(0), word(1), number(1, 9, 0), number(0, 20, 1)), F.repeat(F.lit("x1"), 8), F.concat(word(0), number(1, 999, 0)), word(1), _cut(digest, 12, 64, 0),
    ]
    rows = stored(base.withColumn("value", F.when(F.col("label") == 1, _chosen(secrets, 2)).otherwise(_chosen(others, 3))), "planted")
    dropped(base)
    name = _one_of(NAMES, 4)
    secret = F.col("label") == 1
    template = F.when(secret & (_number(2, len(secrets)) == DIGEST_SECRET), _one_of(NAMED, 5)).when(~secret & (_number(3, len(others)) == DIGEST_OTHER), _one_of(BARE, 5)).otherwise(_one_of(NAMED + BARE, 5))
    line = F.replace(F.replace(template, F.lit("{n}"), name), F.lit("{N}"), F.upper(name))
    text = F.concat_ws("\n", F.concat_ws(" ", word(3), word(4), word(5)), F.replace(line, F.lit("{v}"), F.col("value")), word(6))
    return rows.select((-1 - F.col("id")).alias("doc_id"), text.alias("text"), _one_of(PLACES, 6).alias("source"), "value", "label")
