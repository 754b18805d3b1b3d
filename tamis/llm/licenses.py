"""License scan: ordered signature rules behind a keyword gate, contained detections suppressed by priority."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty
from .license_notices import NOTICES

#: What separates words, after lower-casing A-Z: the ASCII characters other than digits and lower-case letters.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Families for signature rules: label, keyword that gates them (a word of every match of each of the names), ways to write
#: the name (as expressions over words parted by single spaces), versions. A rule is one name with one version (or none) in
#: one of the FORMS.
FAMILIES = [
    ("apache", "apache", ["apache(?: software)?(?: license)?"], ["1 0", "1 1", "2 0"]),
    ("apache", "asl", ["asl"], ["1 0", "1 1", "2 0"]),
    ("mit", "mit", ["mit"], []),
    ("mit", "expat", ["expat"], []),
    ("x11", "x11", ["x11"], []),
    ("bsd", "bsd", ["bsd 2 clause", "bsd 3 clause", "bsd 4 clause", "simplified bsd", "new bsd", "modified bsd", "original bsd", "bsd"], []),
    ("gpl", "gpl", ["gnu gpl", "gpl"], ["1 0", "2 0", "3 0", "2", "3"]),
    ("gpl", "general", ["gnu general public license", "general public license"], ["1", "2", "3"]),
    ("lgpl", "lgpl", ["gnu lgpl", "lgpl"], ["2 0", "2 1", "3 0", "3"]),
    ("lgpl", "lesser", ["gnu lesser general public license", "lesser general public license"], ["2 1", "3"]),
    ("agpl", "agpl", ["gnu agpl", "agpl"], ["3 0", "3"]),
    ("agpl", "affero", ["gnu affero general public license", "affero general public license"], ["3"]),
    ("mpl", "mozilla", ["mozilla public license"], ["1 0", "1 1", "2 0"]),
    ("mpl", "mpl", ["mpl"], ["1 0", "1 1", "2 0"]),
    ("epl", "eclipse", ["eclipse public license"], ["1 0", "2 0"]),
    ("epl", "epl", ["epl"], ["1 0", "2 0"]),
    ("cddl", "cddl", ["cddl"], ["1 0", "1 1"]),
    ("eupl", "eupl", ["eupl"], ["1 0", "1 1", "1 2"]),
    ("isc", "isc", ["isc"], []),
    ("zlib", "zlib", ["zlib libpng", "zlib"], []),
    ("boost", "boost", ["boost software license", "boost"], ["1 0"]),
    ("unlicense", "unlicense", ["the unlicense", "unlicense"], []),
    ("wtfpl", "wtfpl", ["wtfpl"], ["2"]),
    ("artistic", "artistic", ["artistic license", "artistic"], ["1 0", "2 0"]),
    ("python", "psf", ["psf"], ["2"]),
    ("python", "python", ["python software foundation"], ["2"]),
    ("ofl", "ofl", ["sil ofl", "ofl"], ["1 0", "1 1"]),
    ("ofl", "font", ["sil open font license"], ["1 0", "1 1"]),
    ("postgresql", "postgresql", ["postgresql"], []),
    ("ms-pl", "microsoft", ["microsoft public license", "microsoft reciprocal license"], []),
    ("cc0", "cc0", ["cc0"], ["1 0"]),
    ("cc0", "zero", ["cc zero"], ["1 0"]),
    ("cc-by-nc-sa", "cc", ["cc by nc sa"], ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc-nd", "cc", ["cc by nc nd"], ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nc", "cc", ["cc by nc"], ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-nd", "cc", ["cc by nd"], ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by-sa", "cc", ["cc by sa"], ["2 0", "2 5", "3 0", "4 0"]),
    ("cc-by", "cc", ["cc by"], ["1 0", "2 0", "2 5", "3 0", "4 0"]),
    ("cc-by", "commons", ["creative commons attribution"], ["2 0", "3 0", "4 0"]),
    ("cc-by-sa", "commons", ["creative commons attribution share ?alike"], ["2 0", "3 0", "4 0"]),
    ("cc-by-nc", "commons", ["creative commons attribution non ?commercial"], ["2 0", "3 0", "4 0"]),
]
#: Ways in which a name stands in a text: a second gating word, the priority, the expression; {n} is the name with its version.
FORMS = [
    ("spdx", 4, "spdx license identifier {n}"),
    ("under", 3, "(?:is |are )?(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?{n}(?: license)?"),
    ("license", 2, "{n} license"),
]
def rules() -> list[tuple[str, str, str, int, str]]:
    """(label, keyword, second keyword, priority, expression), in order of priority: some two hundred signatures written by hand
    (license_notices), and names of licenses in the forms above. A rule is tried only on texts with both its keywords."""
    out = [(label, keyword, keyword, priority, rx) for label, keyword, priority, rx in NOTICES]
    for label, keyword, names, versions in FAMILIES:
        for name in names:
            for version in [None, *versions]:
                written = f"(?:{name})" + (f"(?: license)?(?: version| v)? v?{version}(?: only| or later)?" if version else "")
                out += [(label, keyword, form_word, priority + (1 if version else 0), form.replace("{n}", written)) for form_word, priority, form in FORMS]
    return sorted(dict.fromkeys(out), key=lambda r: -r[3])


def either(words: list[str]) -> str:
    """An expression for any of the words that shares their beginnings, so that a search tries a few branches at each place."""
    if not words:
        return ""
    end, tails = "" in words, {}
    for w in words:
        if w:
            tails.setdefault(w[0], []).append(w[1:])
    branches = [c + either(t) for c, t in sorted(tails.items())]
    if not branches:
        return ""
    return (branches[0] if len(branches) == 1 and not end else "(?:" + "|".join(branches) + ")") + ("?" if end else "")


RULES = rules()
KEYWORDS = sorted({k for r in RULES for k in r[1:3]})
#: A text is looked at further only if it has one of these; words such as "mit" and "under" alone open nothing.
GATE_WORDS = sorted({r[1] for r in RULES if r[1] == r[2]} | {r[2] for r in RULES if r[1] != r[2]})
TOP = max(r[3] for r in RULES)


def normal(column: str = "text") -> Column:
    """The words of a text, lower case, parted by single spaces."""
    low = F.translate(text_or_empty(column), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(low, NOT_WORD, " "))


def places(words: Column, phrase: str) -> Column:
    """Word numbers at which the phrase's words stand consecutively."""
    parts = phrase.split()
    hit = lambda w, i: _all([F.get(words, i + k) == F.lit(p) for k, p in enumerate(parts)])
    return F.filter(F.transform(words, lambda w, i: F.when(w == F.lit(parts[0]), F.when(hit(w, i), i))), lambda i: i.isNotNull())


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def let(value: Column, body) -> Column:
    """body(value), with value computed once: inside a lambda an expression is computed again for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def detections(text: Column) -> Column:
    """Array of (start, end, priority, label), in characters of the normalised text, of all rules whose keyword it has.

    Spark has no function for the places of matches; they follow from the lengths of the matches and of what lies between.
    """
    words = F.array_distinct(F.regexp_extract_all(text, F.lit(rf"\b{either(KEYWORDS)}\b"), F.lit(0)))
    table_ = F.from_json(F.lit(json.dumps([dict(zip(("label", "kw", "form", "p", "rx"), (*r[:4], rf"\b{r[4]}\b"))) for r in RULES])), "array<struct<label:string,kw:string,form:string,p:int,rx:string>>")
    none = F.from_json(F.lit("[]"), "array<struct<start:int,end:int,p:int,label:string>>")

    def spans(r: Column, s: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            start = a["end"] + F.length(F.get(s["between"], i))
            return let(F.struct(start.alias("start"), (start + F.length(F.get(s["found"], i))).alias("end")), lambda d: F.struct(d["end"].alias("end"), F.concat(a["all"], F.array(F.struct(d["start"].alias("start"), d["end"].alias("end"), r["p"].alias("p"), r["label"].alias("label")))).alias("all")))

        return F.aggregate(F.sequence(F.lit(0), F.size(s["found"]) - 1), F.struct(F.lit(0).alias("end"), none.alias("all")), step)["all"]

    def of_text(x: Column) -> Column:
        open_ = F.filter(table_, lambda r: F.array_contains(x["words"], r["kw"]) & F.array_contains(x["words"], r["form"]) & F.regexp_like(x["text"], r["rx"]))
        return F.flatten(F.transform(open_, lambda r: let(F.struct(F.regexp_extract_all(x["text"], r["rx"], F.lit(0)).alias("found"), F.split(x["text"], r["rx"], -1).alias("between")), lambda s: spans(r, s))))

    return let(F.struct(words.alias("words"), text.alias("text")), of_text)


def kept_labels(found: Column) -> Column:
    """(labels, best) of detections left when each that lies inside another of at least its priority is suppressed.

    Detections go in order of start, the longer and then the more important first, so whatever may contain one came
    before it; the furthest end seen for each priority or higher decides. Linear in the detections."""
    order = F.array_sort(found, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).when(a["end"] != b["end"], b["end"] - a["end"]).when(a["p"] != b["p"], b["p"] - a["p"]).when(a["label"] < b["label"], -1).when(a["label"] > b["label"], 1).otherwise(0).cast("int"))
    first = F.struct(F.array_repeat(F.lit(0), TOP + 1).alias("ends"), F.array().cast("array<string>").alias("labels"), F.lit(0).alias("best"), F.lit(0).alias("kept"))

    def step(a: Column, d: Column) -> Column:
        hidden = F.get(a["ends"], d["p"]) >= d["end"]
        ends = F.transform(a["ends"], lambda e, p: F.when(p <= d["p"], F.greatest(e, d["end"])).otherwise(e))
        return F.struct(ends.alias("ends"), F.when(hidden, a["labels"]).otherwise(F.array_union(a["labels"], F.array(d["label"]))).alias("labels"), F.when(hidden, a["best"]).otherwise(F.greatest(a["best"], d["p"])).alias("best"), (a["kept"] + F.when(hidden, 0).otherwise(1)).alias("kept"))

    return F.aggregate(order, first, step)


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    Whole texts, no shuffle. Null texts count as empty: no words, no labels, score 0. labels are the base labels and
    those of rules that are not suppressed; score grows with the priority of the best rule (a whole notice is 1).
    Repeated rows give equal rows; other columns are ignored.
    """
    gate = rf"\b{either(GATE_WORDS)}\b"
    t = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), normal().alias("t"))
    t = t.withColumn("n_words", F.when(F.col("t") == "", F.lit(0)).otherwise(F.regexp_count("t", F.lit(" ")) + 1).cast("bigint"))
    t = t.withColumn("open", F.col("t").rlike(gate))
    base_open = t["t"].rlike(r"\b(?:" + "|".join(BASE) + r")\b")
    words = F.when(base_open, F.split("t", " "))
    t = t.withColumn("w", words)
    for k, phrase in enumerate(BASE):
        t = t.withColumn(f"b{k}", F.when(F.col("w").isNotNull(), places(F.col("w"), phrase)))
    n = [F.coalesce(F.size(f"b{k}"), F.lit(0)) for k in range(len(BASE))]
    n = [F.greatest(x, F.lit(0)) for x in n]
    base = F.array_compact(F.array(*[F.when(x > 0, F.lit(label)) for x, label in zip(n, BASE.values())]))
    t = t.withColumn("base", base).withColumn("n_base", sum(n[1:], n[0]).cast("bigint"))
    t = t.withColumn("first_word", F.least(*[F.array_min(f"b{k}") for k in range(len(BASE))]).cast("bigint")).withColumn("last_word", F.greatest(*[F.array_max(f"b{k}") for k in range(len(BASE))]).cast("bigint"))
    t = t.withColumn("kept", F.when(F.col("open"), kept_labels(detections(F.col("t")))))
    score = F.when(F.col("n_base") > 0, F.greatest(F.lit(1), F.coalesce("kept.best", F.lit(0)))).otherwise(F.coalesce("kept.best", F.lit(0))) / F.lit(float(TOP))
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("kept.labels", F.array().cast("array<string>")))))
    return t.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"), F.coalesce("kept.kept", F.lit(0)).alias("detections"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


ORACLE = {}
