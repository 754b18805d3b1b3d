"""Repeated byte strings: bytes covered by a long string that also starts elsewhere, by distributed prefix doubling over a sample of positions."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, join_groups, mix64, partitions_for, prefix_hash, span_hash, stored, table, text_or_empty, tidy

#: Length in bytes of the strings whose repeats are removed, of the grams that choose the sampled positions, how many
#: consecutive starts choose one of them together, and the blocks in which these starts are compared at the end.
LENGTH = 400
GRAM = 8
SPAN = 128
BLOCKS = (SPAN, 16)
#: Bytes that decide on one sampled position; how far behind a sampled position all others are decided by a string of
#: LENGTH bytes that it stands for; and how many bytes behind it all these strings share.
REACH = SPAN + GRAM - 1
SURE = LENGTH - SPAN + 1 - REACH
CORE = LENGTH - SPAN + 1
RANGE_ROWS = 500_000
EMPTY = hashlib.sha256(b"").hexdigest()


def window_anchors(data: np.ndarray, length: int = REACH) -> np.ndarray:
    """For each start s of a window data[s : s + length] the place of its anchor: the leftmost of the window's 8-grams
    with the smallest hash. Equal windows have their anchors at equal distances, wherever they stand."""
    g = data.astype(np.uint64)
    for k in (1, 2, 4):
        g = g[:-k] | (g[k:] << np.uint64(8 * k))
    low = (mix64(g) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
    span, width = length - GRAM + 1, 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    return (np.minimum(low[: len(data) - length + 1], low[span - width :][: len(data) - length + 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def block_keys(prefix: np.ndarray, a: np.ndarray, d: np.ndarray, size: int, tid: int, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(core, hull) names of blocks of windows: those that start d .. d + size - 1 bytes before anchor a.

    The core is what all windows of the block share, the hull what they cover together. A core that stands nowhere else
    rules all of them out; a hull that does stand elsewhere makes all of them repeats. A hull that leaves the
    text gets a name of its own."""
    n = len(prefix) - 1
    last = d + size - 1
    salt = mix64(d.astype(np.uint64) * np.uint64(1024) + np.uint64(size))
    core = span_hash(prefix, a - d, a - last + length) ^ salt
    inside = (a - last >= 0) & (a - d + length <= n)
    start, end = np.where(inside, a - last, 0), np.where(inside, a - d + length, 0)
    alone = mix64(mix64(a.astype(np.uint64)) ^ np.uint64(tid & (2**64 - 1)) ^ salt)
    hull = np.where(inside, span_hash(prefix, start, end) ^ salt, alone)
    return core.view(np.int64), hull.view(np.int64)


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def raw_bytes(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer((value.as_py() or "").encode("utf-8", "surrogatepass"), np.uint8)


NAMES = ["key", "hull", "tid", "a", "d"]
KEYS = "key bigint, hull bigint, tid bigint, a bigint, d bigint"


def batches_of(parts, names: list[str], rows: int = 100_000):
    """Arrow batches of about `rows` rows from tuples of equal-length arrays."""
    held, n = [], 0
    for p in parts:
        held.append(p)
        n += len(p[0])
        if n >= rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=names)
            held, n = [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=names)


PLACES = "tid bigint, idx bigint, code bigint, tail bigint, rank bigint"


def sampled_places(batches):
    """The sampled positions of each distinct text that a task reads: (text, tid) -> PLACES.

    Each start of a string chooses the leftmost smallest gram of the next SPAN ones, so a string of LENGTH bytes chooses
    alike wherever it stands. idx counts the sampled positions of a text; code holds the position p, m, the number of
    sampled positions within SURE bytes behind it, and whether the text goes on for CORE bytes; tail names the last of these
    bytes; rank, the first one, names the prefix of REACH bytes and the distance to the next sampled position."""

    def parts():
        seen: set[int] = set()
        for batch in batches:
            for text, tid in zip(batch.column(0), batch.column(1).to_pylist()):
                if tid in seen:
                    continue
                if len(seen) < 2_000_000:
                    seen.add(tid)
                data = raw_bytes(text)
                if len(data) < LENGTH:
                    continue
                prefix, every = prefix_hash(data), window_anchors(data)
                every = every[runs(every)]
                p = every[:-1][every[:-1] + REACH <= len(data)]
                m = np.searchsorted(every, p + SURE, "right") - 1 - np.arange(len(p))
                whole = p + CORE <= len(data)
                first = span_hash(prefix, p, p + REACH) ^ mix64(np.diff(every)[: len(p)].astype(np.uint64))
                tail = np.zeros(len(p), np.uint64)
                tail[whole] = span_hash(prefix, p[whole] + (SURE - SPAN), p[whole] + CORE)
                yield np.full(len(p), tid, np.int64), np.arange(len(p)), p * 1024 + m * 2 + whole, tail.view(np.int64), first.view(np.int64)

    return batches_of(parts(), ["tid", "idx", "code", "tail", "rank"])


RANKED = "is_last boolean, tid bigint, idx bigint, code bigint, tail bigint, rank bigint"


def rerank(batches):
    """Name the runs of equal pairs in a sorted range, and drop the runs of one: the new rank is the pair's 64-bit name.

    A name, unlike a number, is the same in each range that a run reaches into. Only the last row is held back, so a run may be of any
    length. Whether the first and the last row of a range stand alone only other ranges know: these two stay."""
    held, held_same, first = None, False, True

    def rows(cols):
        name = mix64(mix64(cols[1].view(np.uint64)) * np.uint64(3) + cols[2].view(np.uint64)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (cols[0].astype(bool), *cols[3:], name)], names=[c.split()[0] for c in RANKED.split(", ")])

    for batch in batches:
        cols = [np.asarray(c.to_numpy(zero_copy_only=False)) for c in batch.columns]
        cols = [c if k == 0 else np.ascontiguousarray(c, np.int64) for k, c in enumerate(cols)]
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
        if not len(cols[0]):
            continue
        same = np.r_[held_same, np.logical_and.reduce([c[1:] == c[:-1] for c in cols[:3]])]
        again = np.r_[False, same[1:] & (cols[3][1:] == cols[3][:-1]) & (cols[4][1:] == cols[4][:-1])]  # a text that several tasks read
        cols, same = [c[~again] for c in cols], same[~again]
        keep = same[:-1] | same[1:]
        keep[:1] |= first
        if keep.any():
            yield rows([c[:-1][keep] for c in cols])
        first = first and len(keep) == 0
        held, held_same = [c[-1:] for c in cols], bool(same[-1])
    if held is not None:
        yield rows(held)


def ranked(pairs: DataFrame, n_rows: int) -> DataFrame:
    """Sort pairs(is_last, r1, r2, tid, idx, code, tail), give equal ones the same rank and drop those that stand alone.

    The sort goes on by text and place, so that a pair that many rows share lies in many ranges. Of each range two rows
    stay unjudged; the later rounds and the comparison of whole strings judge them."""
    order = ["is_last", "r1", "r2", "tid", "idx"]
    n = partitions_for(pairs.sparkSession, n_rows, RANGE_ROWS)
    return stored(pairs.select(*order, "code", "tail").repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(rerank, RANKED), "ranks")


def doubled(places: DataFrame) -> DataFrame:
    """Sampled positions whose CORE bytes also stand behind another one: (tid, a), by prefix doubling.

    In the round of offset h, h = 1, 2, 4, ... sampled positions, a position with 2h others within SURE bytes pairs its
    rank with that of the position h further on; one with fewer takes its last pair, which reaches its m-th one, and the
    name of its tail. Pairs are sorted and ranked anew, and unique ones go: a string that holds a unique one is unique too,
    so a position whose partner is gone goes with it. It ends when no position is left to double (at SURE places at most)."""
    m = F.expr("(code div 2) % 512")
    rows = ranked(places.select(F.lit(False).alias("is_last"), F.col("rank").alias("r1"), F.lit(0).cast("bigint").alias("r2"), "tid", "idx", "code", "tail"), places.count())
    found, h = [], 1
    while True:
        ends = m < 2 * h
        one = rows.where((~ends) | (F.col("code") % 2 == 1)).select("tid", "idx", "code", "tail", "rank", ends.alias("is_last"), (F.col("idx") + F.when(ends, m - h).otherwise(h)).alias("_at"))
        two = rows.select(F.col("tid").alias("_tid"), F.col("idx").alias("_idx"), F.col("rank").alias("_rank"))
        pairs = one.join(two, (F.col("tid") == F.col("_tid")) & (F.col("_at") == F.col("_idx")))
        pairs = pairs.select("is_last", F.col("rank").alias("r1"), F.when(F.col("is_last"), F.xxhash64("_rank", m, "tail")).otherwise(F.col("_rank")).alias("r2"), "tid", "idx", "code", "tail")
        new = ranked(pairs, rows.count())
        if h == 1:
            dropped(rows)
        found.append(new)
        rows, h = new.where("NOT is_last"), 2 * h
        if rows.isEmpty():
            break
    ends = [t.where("is_last").select("tid", F.expr("code div 1024").alias("a")) for t in found]
    out = stored(reduce(DataFrame.unionByName, ends), "anchors")
    dropped(*found)
    return out


def inner_keys(size: int, outer: int):
    """Blocks of `size` starts (or single windows) inside the open blocks of `outer` starts: (text, tid, open) -> KEYS."""

    def run(batches):
        def parts():
            for batch in batches:
                for text, tid, blocks in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2)):
                    data = raw_bytes(text)
                    prefix = prefix_hash(data)
                    a0 = np.array([b["a"].as_py() for b in blocks], np.int64)
                    d0 = np.array([b["d"].as_py() for b in blocks], np.int64)
                    d = (d0[:, None] + np.arange(0, outer, size)[None, :]).ravel()
                    a = np.repeat(a0, outer // size)
                    # a block counts if one of its windows lies in the text
                    fits = (a - d >= 0) & (a - (d + size - 1) + LENGTH <= len(data))
                    a, d = a[fits], d[fits]
                    if len(a):
                        core, hull = block_keys(prefix, a, d, size, tid)
                        yield core, hull, np.full(len(a), tid, np.int64), a, d

        return batches_of(parts(), NAMES)

    return run


def shared_names(rows: DataFrame, name: str) -> DataFrame:
    """(name, lo) of the names that two occurrences or more hold, lo the smallest of them, stored.

    An occurrence is a text and an anchor, so copies of one text, and a block sent by several tasks, are one. Smallest and largest
    are combined before the shuffle. Stored, since Spark splits the rows of a frequent name only in a join of plain shuffles: with
    the counting in the join's own stage they would be one task."""
    occurrence = F.xxhash64("tid", "a")
    return stored(rows.groupBy(name).agg(F.min(occurrence).alias("lo"), F.max(occurrence).alias("hi")).where("lo <> hi").drop("hi"), "often")


def resolved(keys: DataFrame, last: bool = False, shared: bool = False) -> DataFrame:
    """Drop blocks whose name is unique, mark those whose hull is not: (tid, a, d, repeated, goes_on), stored.

    goes_on: the block takes part in the next round, as it is open, or as it is the first of equal settled blocks and
    shares its name with an open one, which may repeat parts of it.
    Rows of a frequent name are split by the skew handling of the joins (shared_names()). shared: the names are known to
    stand elsewhere, but for a few that the next round drops."""
    keys = stored(keys, "names")
    often = None if shared else shared_names(keys, "key")
    left = keys if shared else keys.join(often.drop("lo"), "key", "left_semi")
    if last:
        out = stored(left.select("tid", "a", "d", F.lit(True).alias("repeated")), "repeats")
    else:
        left = left if shared else stored(left, "names")
        hulls = shared_names(left, "hull")
        marked = left.join(hulls, "hull", "left").select("key", "tid", "a", "d", F.col("lo").isNotNull().alias("repeated"), F.col("lo").eqNullSafe(F.xxhash64("tid", "a")).alias("first")).distinct()
        marked = stored(marked, "marks")
        open_names = stored(marked.where("NOT repeated").select("key").distinct().withColumn("is_open", F.lit(True)), "open")
        firsts = marked.where("repeated AND first").join(open_names, "key", "left")
        rest = marked.where("NOT (repeated AND first)").withColumn("is_open", ~F.col("repeated"))
        out = stored(firsts.unionByName(rest).select("tid", "a", "d", "repeated", F.coalesce("is_open", F.lit(False)).alias("goes_on")), "repeats")
        dropped(left, hulls, marked, open_names)
    dropped(keys, *([] if shared else [often]))
    return out


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(each, spans): each row of docs with its text's digest; and for each distinct text with a repeat its starts.

    Prefix doubling leaves the sampled positions that share CORE bytes with another (doubled()). Each stands for the SPAN starts before it;
    these are compared in blocks of SPAN, of 16 and of 1 by the names of their bytes: blocks whose shared bytes (core) are
    unique go, blocks of which all bytes (hull) repeat are settled, the others are split.
    """
    each = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.sha2(text_or_empty(), 256).alias("sha"), F.octet_length(text_or_empty()).cast("bigint").alias("n_bytes"))
    each = stored(each, "texts")
    tid = F.conv(F.substring("sha", 1, 15), 16, 10).cast("bigint").alias("tid")
    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"), F.sha2(text_or_empty(), 256).alias("sha")).where(F.octet_length("text") >= LENGTH)
    places = stored(read.select("text", tid).mapInArrow(sampled_places, PLACES), "places")
    anchors = doubled(places)
    dropped(places)
    blocks = anchors.groupBy("tid").agg(F.collect_list(F.struct("a", F.lit(0).cast("bigint").alias("d"))).alias("open"))  # of one text
    reps = each.where(F.col("n_bytes") >= LENGTH).groupBy("sha").agg(F.min("doc_id").alias("doc_id")).select(tid, "sha", "doc_id").join(anchors.select("tid").distinct(), "tid", "left_semi")
    reps = reps.select("tid", F.col("sha").alias("_sha"), F.col("doc_id").alias("_rep"))
    here = read.join(reps, F.col("doc_id").eqNullSafe(F.col("_rep")) & (F.col("sha") == F.col("_sha"))).select("text", "tid", "sha")
    here = stored(here.join(blocks, "tid"), "repeating-texts")
    tidy(docs.sparkSession)
    one = resolved(here.select("text", "tid", "open").mapInArrow(inner_keys(SPAN, SPAN), KEYS), shared=True)
    open2 = one.where("goes_on").groupBy("tid").agg(F.collect_list(F.struct("a", "d")).alias("open2"))
    two = resolved(here.select("text", "tid").join(open2, "tid").select("text", "tid", "open2").mapInArrow(inner_keys(BLOCKS[1], SPAN), KEYS))
    open3 = two.where("goes_on").groupBy("tid").agg(F.collect_list(F.struct("a", "d")).alias("open3"))
    three = resolved(here.select("text", "tid").join(open3, "tid").select("text", "tid", "open3").mapInArrow(inner_keys(1, BLOCKS[1]), KEYS), last=True)
    tidy(docs.sparkSession)
    span = lambda df, size: df.where("repeated").select("tid", (F.col("a") - F.col("d") - (size - 1)).alias("s"), (F.col("a") - F.col("d")).alias("e"))
    starts = span(one, SPAN).unionByName(span(two, BLOCKS[1])).unionByName(span(three, 1))
    starts = starts.groupBy("tid").agg(F.collect_list(F.struct("s", "e")).alias("starts"))  # of one text
    return each, stored(here.select("tid", "sha", "text").join(starts, "tid").dropDuplicates(["tid"]), "spans")


def covered(starts: np.ndarray, ends: np.ndarray, n: int, length: int = LENGTH) -> np.ndarray:
    """Mask of the bytes that windows starting in [starts, ends] cover."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(ends + length, n), -1)
    return np.cumsum(change[:-1]) > 0


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the text left, if asked).

    A byte goes if a string of LENGTH bytes over it also starts anywhere else, in this text or another; strings are judged
    on the input. Null texts count as empty and lose nothing; texts shorter than LENGTH lose nothing; two rows with equal texts of
    LENGTH bytes or more lose everything, repeated rows too. What is left may not be whole characters: kept is binary. Other columns are ignored; an
    empty table gives no rows. Strings are compared by 64-bit names.
    """

    def cut(batches):
        for batch in batches:
            rows = []
            for sha, text, starts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                data = raw_bytes(text)
                mask = covered(np.array([x["s"].as_py() for x in starts], np.int64), np.array([x["e"].as_py() for x in starts], np.int64), len(data))
                left = data[~mask].tobytes()
                rows.append((sha, int(mask.sum()), int((np.diff(np.r_[0, mask.astype(np.int8)]) == 1).sum()), hashlib.sha256(left).hexdigest(), left if with_text else b""))
            names = ["sha", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names) if rows else pa.RecordBatch.from_pylist([], schema=pa.schema([("sha", pa.string()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]))

    each, spans = repeated_spans(docs)
    cuts = spans.select("sha", "text", "starts").mapInArrow(cut, "sha string, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
    copies = each.groupBy("sha", "n_bytes").agg(F.count("*").alias("copies"))
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    cuts = copies.join(cuts, "sha", "left").select("sha", "copies", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"), F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"), F.when(gone, F.lit(EMPTY)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"), *(["kept"] if with_text else []))
    out = join_groups(each, cuts, "sha", "copies", max(1, each.count()))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *([F.when(F.col("n_removed") > 0, F.coalesce("kept", F.lit(b""))).alias("kept")] if with_text else []))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


ORACLE = {}
