"""Roles of source corpora by purity, and external bundles: triples of held-out sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Subtypes of each role, in the order in which roles are tried; only the first three can be held out.
ROLES = {"phishing": ["phishing"], "ham": ["ham"], "spam_like": ["bulk_spam", "scam_fraud"], "unknown_negative": ["unknown_nonphishing"]}
HELD = ["phishing", "ham", "spam_like"]
SUBTYPES = [s for names in ROLES.values() for s in names]


def source_roles(rows: DataFrame, source: str = "source_corpus", purity: float = 0.9) -> DataFrame:
    """source, n, rows of each subtype, role. A source has a role only if at least `purity` of its rows carry the role's
    subtypes; any other is mixed. Rows without a source are left out: they belong to no corpus that could be held out."""
    g = rows.where(F.col(source).isNotNull()).groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n"), *[F.count_if(F.col("subtype") == s).alias(s) for s in SUBTYPES])
    share = lambda names: reduce(lambda a, b: a + b, [F.col(s) for s in names]) / F.col("n")
    role: Column | None = None
    for name, subtypes in ROLES.items():
        role = F.when(share(subtypes) >= purity, name) if role is None else role.when(share(subtypes) >= purity, name)
    return g.withColumn("role", role.otherwise("mixed"))


def external_bundles(roles: DataFrame, family: Column, min_rows: int) -> DataFrame:
    """All triples of a phishing, a ham and a spam-like source of min_rows rows and more whose removal leaves at least one source of
    each of these roles for development; mixed and unknown sources stay there.

    Each triple takes one source of each role, so what is left is known from the roles' counts: a role of one source offers none, and
    is dropped before triples are formed. In the same way a held-out source is family-disjoint if its family's count is used
    up by the triple itself. The result is the product of three short lists; it has one row a triple by definition."""
    known = roles.withColumn("family", family)
    by_role = known.groupBy("role").agg(F.count("*").alias("of_role"))
    by_family = known.groupBy("family").agg(F.count("*").alias("of_family"))
    total = known.agg(F.sum("n").alias("rows"), F.count("*").alias("sources"))
    fit = known.where(F.col("role").isin(HELD) & (F.col("n") >= min_rows)).join(by_role, "role").where("of_role > 1").join(by_family, "family")

    def side(role: str, k: str) -> DataFrame:
        names = {"source": f"{k}_source", "n": f"{k}_rows", "family": f"{k}_family", "of_family": f"{k}_of"}
        pure = reduce(lambda a, b: a + b, [F.col(s) for s in ROLES[role]]) / F.col("n")
        return fit.where(F.col("role") == role).select(*[F.col(c).alias(a) for c, a in names.items()], F.round(pure, 4).alias(f"{k}_share"))

    kinds = ["phishing", "ham", "spam_scam"]
    b = side("phishing", kinds[0]).crossJoin(side("ham", kinds[1])).crossJoin(side("spam_like", kinds[2])).crossJoin(F.broadcast(total))  # the product is the result

    def tier(k: str) -> Column:
        own = reduce(lambda a, c: a + c, [(F.col(f"{o}_family") == F.col(f"{k}_family")).cast("int") for o in kinds])
        return F.when(F.col(f"{k}_of") == own, "family-disjoint").otherwise("within-family-partition")

    b = b.withColumns({f"{k}_tier": tier(k) for k in kinds})
    held = F.col("phishing_rows") + F.col("ham_rows") + F.col("spam_scam_rows")
    name = F.concat(F.lit("b_"), F.substring(F.sha2(F.concat_ws("|", *[F.col(f"{k}_source") for k in kinds]), 256), 1, 8))
    disjoint = reduce(lambda a, c: a & c, [F.col(f"{k}_tier") == "family-disjoint" for k in kinds])
    return b.select(name.alias("bundle_id"), *[f"{k}_{c}" for k in kinds for c in ("source", "rows", "share", "tier")], disjoint.alias("fully_family_disjoint"), held.alias("held_out_rows"), (F.col("rows") - held).alias("development_rows"), (F.col("sources") - 3).alias("development_sources"))
