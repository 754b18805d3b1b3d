"""N-gram Jaccard self-join: PartEnum signatures find candidates, exact set comparison decides."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from .common import IS_SPACE, LOWER, components, dropped, free_name, join_groups, mix64, partitions_for, prefix_hash, span_hash, stored, table, tidy

WORDS = 5
#: Two sets link when 100 * |x & y| >= 75 * |x | y|; the bounds below follow from this similarity.
SIMILARITY = 75
CHUNK = 1 << 20
BINS = 256
#: Elements whose signatures are made at once, and signatures of a shuffle partition.
HELD = 300_000
PER_PARTITION = 750_000
#: The signatures go through the shuffle in so many slices, one after the other, so that the disk holds one at a time.
SLICES = 2
#: Members of a signature's list, and texts of a cluster, that are compared with each other in one task.
LIST_BLOCK = 1_024
BLOCK = 512
#: List members, and texts, that come to one task together.
SLOT = 20_000
TEXT_SLOT = 600


# -- shingle sets ---------------------------------------------------------------------------------------------------

_STEP = np.array([pow(0x9E3779B97F4A7C15, j, 1 << 64) for j in range(WORDS)], np.uint64)


def shingle_sets(texts: pa.Array, words: int = WORDS):
    """(row, sorted distinct 64-bit shingle hashes) for each text of an Arrow string array; no words: an empty set.

    A-Z are lower-cased; words are runs of other than the six white-space bytes; a text of fewer words is one shingle.
    """
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    valid = np.asarray(texts.is_valid())
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK, "right")) - 1)
        end = min(end, len(texts))
        base = int(offsets[row])
        data = LOWER[raw[base : int(offsets[end])]]
        cuts = offsets[row : end + 1] - base
        solid = ~IS_SPACE[data]
        begin = solid.copy()
        begin[1:] &= ~solid[:-1]
        stop = solid.copy()
        stop[:-1] &= ~solid[1:]
        inner = cuts[(cuts > 0) & (cuts < len(data))]
        begin[inner] |= solid[inner]
        stop[inner - 1] |= solid[inner - 1]
        start, finish = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        word = span_hash(prefix_hash(data), start, finish) ^ (finish - start).astype(np.uint64)
        first = np.searchsorted(start, cuts)  # the first word of each text
        if len(word) >= words:
            grams = np.zeros(len(word) - words + 1, np.uint64)
            for j in range(words):
                grams += mix64(word[j : len(word) - words + 1 + j]) * _STEP[j]
            grams = mix64(grams)
        for k in range(row, end):
            a, b = int(first[k - row]), int(first[k - row + 1])
            if b == a or not valid[k]:
                yield k, np.zeros(0, np.uint64)
            elif b - a < words:
                yield k, mix64((mix64(word[a:b]) * _STEP[: b - a]).sum(keepdims=True) + np.uint64(b - a))
            else:
                yield k, np.unique(grams[a : b - words + 1])
        row = end


def set_key(s: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(s.tobytes())


def set_id(key: str) -> int:
    """64 bits of the key as a signed number: names a distinct set."""
    return int(key[:16], 16) - (1 << 63)


# -- PartEnum signatures ------------------------------------------------------------------------------------------------

#: Size bands: low and high ends, each half as long again as its low end, up to more shingles than a text can have.
LOWS = [1]
while LOWS[-1] < 1 << 34:
    LOWS.append(max(LOWS[-1] + 1, LOWS[-1] * 3 // 2 + 1))
LOW = np.array(LOWS, np.int64)
HIGH = LOW[1:] - 1
#: Most elements in which a set of a band differs from one that is not smaller: (n + m) / 7 for m up to n / 0.75.
MOST_DIFFERENT = HIGH // 3
#: First-level partitions: at least one more than can hold two differences; a fifth more, so that few of them are thin.
FIRST = (MOST_DIFFERENT // 2 + 1) * 6 // 5
SECOND = 3
_BAND_SALT = mix64(np.arange(1, len(HIGH) + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def bands(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The band of each size, and the one below where a smaller set of that band may link, else -1."""
    own = np.searchsorted(LOW, n, "right") - 1
    below = np.maximum(own - 1, 0)
    return own, np.where((own > 0) & (3 * n <= 4 * HIGH[below]), below, -1)


def enumerated(s: np.ndarray, row: np.ndarray, n: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, row of each) of the sets in which row k has the elements s[row == k], n[k] of them, in band[k] (or -1).

    PartEnum (Arasu, Ganti, Kaushik 2006). The domain falls into FIRST partitions, each of them into SECOND = 3; all
    subsets of two of the three are enumerated, and the content of each that is not empty is a signature. Of linking sets
    at most MOST_DIFFERENT // 2 first-level partitions hold two differences or more. In any other the differences lie in
    one second-level partition, and the subset without that one has the same content in both: one shared signature
    suffices. A set is rich when more of its first-level partitions than can hold two differences have elements in two
    second-level ones or more; then one such shared subset is not empty. A set that is not rich adds each element as a
    signature, so that two such sets share one too.
    """
    use = (band >= 0) & (n > 1)
    band = np.where(use, band, 0)
    cells = np.where(use, FIRST[band] * SECOND, 0)
    off = np.cumsum(cells) - cells
    mine = use[row]
    s, row = s[mine], row[mine]
    h = mix64(s ^ _BAND_SALT[band[row]])
    cell = off[row] + (h % cells[row].astype(np.uint64)).astype(np.int64)
    value, total = mix64(h + np.uint64(0x9E3779B97F4A7C15)), int(cells.sum())
    low = np.bincount(cell, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), total).astype(np.uint64)
    high = np.bincount(cell, (value >> np.uint64(32)).astype(np.float64), total).astype(np.uint64)
    content = (low + (high << np.uint64(32))).reshape(-1, SECOND)
    there = np.bincount(cell, minlength=total).reshape(-1, SECOND) > 0
    owner = np.repeat(np.arange(len(n)), cells // SECOND)
    full = np.bincount(owner, there.sum(1) >= 2, len(n))
    place = (np.arange(len(owner)) - off[owner] // SECOND).astype(np.uint64)
    tag = mix64(_BAND_SALT[band[owner]] ^ place)[:, None] + np.arange(SECOND, dtype=np.uint64)
    rest = mix64(content.sum(1, dtype=np.uint64)[:, None] - content ^ mix64(tag))
    seen = (there.sum(1)[:, None] - there) > 0
    most = np.where(n > HIGH[band], (n + HIGH[band]) // 7, n // 3)
    poor = use & (full <= most // 2)
    alone = poor[row]
    return np.r_[rest[seen], mix64(h[alone] ^ np.uint64(0x5851F42D4C957F2D))], np.r_[np.repeat(owner, SECOND)[seen.ravel()], row[alone]]


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, number of the set of each) of distinct sets; sets of less than two elements have none."""
    n = np.array([len(s) for s in sets], np.int64)
    s, row = np.concatenate([*sets, np.zeros(0, np.uint64)]), np.repeat(np.arange(len(sets)), n)
    parts = [enumerated(s, row, n, band) for band in bands(np.maximum(n, 1))]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def bins_of(s: np.ndarray) -> np.ndarray:
    """Elements by their top bits, at most 255 each: two sets differ in as many elements as their bins do, or more.

    At least a bin for four elements, so that bins of large sets that have nothing in common differ by more than links may."""
    bits = max(BINS.bit_length() - 1, (len(s) // 4 - 1).bit_length())
    return np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8)


def folded(bins: np.ndarray, size: int) -> np.ndarray:
    """The same counts in fewer bins."""
    return bins.reshape(size, -1).sum(1, dtype=np.int16)


def set_table(docs: DataFrame) -> DataFrame:
    """doc_id, n (set size), key (128 bits of the set), id (64 of them), bins (see bins_of)."""
    schema = "doc_id bigint, n bigint, key string, id bigint, bins binary"

    def run(batches):
        for batch in batches:
            sets = [s for _, s in shingle_sets(batch.column(1))]
            key = [set_key(s) for s in sets]
            columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(key, pa.string()), pa.array([set_id(k) for k in key], pa.int64()), pa.array([bins_of(s).tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "key", "id", "bins"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, schema)


class Once:
    """True for each id that a task has not met; beyond so many ids it forgets, and later steps meet some more than once."""

    def __init__(self, most: int = 2_000_000) -> None:
        self.seen, self.most = set(), most

    def __call__(self, me: int) -> bool:
        new = me not in self.seen
        if new and len(self.seen) < self.most:
            self.seen.add(me)
        return new


def sent_signatures(docs: DataFrame, buckets: int, part: int) -> DataFrame:
    """(bucket, high, low, ids): signatures of slice `part` of the distinct sets of each task, packed by bucket."""

    def emit(batches):
        once, sets, ids, held = Once(), [], [], 0

        def flush():
            s, of = signatures(sets)
            i = np.array(ids, np.int64)[of]
            mine = mix64(s) % np.uint64(SLICES) == part
            s, i = s[mine], i[mine]
            # sorted by bucket and 40 bits: the first of the five bytes compresses away, the packed size a signature does
            # not depend on the number of buckets; two signatures that fall together by chance only make candidates
            s = (s % np.uint64(buckets)) << np.uint64(40) | s >> np.uint64(24)
            order = np.argsort(s)
            s, i = s[order], i[order]
            b = (s >> np.uint64(40)).astype(np.int64)
            high, low = (s >> np.uint64(32)).astype(np.uint8), s.astype(np.uint32)
            at = np.flatnonzero(np.r_[True, b[1:] != b[:-1]][: len(b)])
            ends = np.r_[at[1:], len(b)]
            cut = lambda v: pa.array([v[x:y].tobytes() for x, y in zip(at, ends)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(b[at], pa.int64()), cut(high), cut(low), cut(i)], names=["bucket", "high", "low", "ids"])

        for batch in batches:
            for _, s in shingle_sets(batch.column(0)):
                if len(s) < 2:  # links with nothing but its equals
                    continue
                me = set_id(set_key(s))
                if once(me):
                    sets.append(s)
                    ids.append(me)
                    held += len(s)
                if held > HELD:
                    yield flush()
                    sets, ids, held = [], [], 0
        if sets:
            yield flush()

    return docs.selectExpr("cast(text as string) text").mapInArrow(emit, "bucket bigint, high binary, low binary, ids binary")


def met(batches):
    """(g, id, size): the members of each distinct list of two sets or more that share a signature; equal lists once."""
    sigs, ids = [], []
    for batch in batches:
        for b, high, low, i in zip(*batch.columns):
            top = np.uint64(b.as_py()) << np.uint64(40)
            sigs.append(top | np.frombuffer(high.as_py(), np.uint8).astype(np.uint64) << np.uint64(32) | np.frombuffer(low.as_py(), np.uint32))
            ids.append(np.frombuffer(i.as_py(), np.int64))
    if not sigs:
        return
    s, i = np.concatenate(sigs), np.concatenate(ids)
    del sigs, ids
    order = np.argsort(s, kind="stable")
    s, i = s[order], i[order]
    size = np.diff(np.r_[np.flatnonzero(np.r_[True, s[1:] != s[:-1]]), len(s)])
    many = np.repeat(size > 1, size)
    s, i = s[many], i[many]
    order = np.lexsort((i, s))
    s, i = s[order], i[order]
    fresh = np.ones(len(s), bool)  # a set sent by several tasks counts once
    fresh[1:] = (s[1:] != s[:-1]) | (i[1:] != i[:-1])
    s, i = s[fresh], i[fresh]
    if not len(s):
        return
    at = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    size = np.diff(np.r_[at, len(s)])
    name = mix64(np.add.reduceat(mix64(i.view(np.uint64)), at) + size.astype(np.uint64))
    first = np.zeros(len(at), bool)
    first[np.unique(np.where(size > 1, name, 0), return_index=True)[1]] = True
    take = np.repeat(first & (size > 1), size)
    g, i, size = np.repeat(name, size)[take].view(np.int64), i[take], np.repeat(size, size)[take].astype(np.int64)
    for k in range(0, len(i), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 100_000]) for c in (g, i, size)], names=["g", "id", "size"])


def shared_signatures(docs: DataFrame, n_signatures: float) -> DataFrame:
    """(g, id, size), stored: the lists of sets that share a signature; lists of equal members have one name and are one."""
    n = partitions_for(docs.sparkSession, n_signatures / SLICES, PER_PARTITION)
    out = None
    for part in range(SLICES):
        lists = stored(sent_signatures(docs, 8 * n, part).repartition(n, "bucket").mapInArrow(met, "g bigint, id bigint, size bigint"), "lists")
        tidy(docs.sparkSession)
        out = lists if out is None else out.unionByName(lists)
    out = stored(out.distinct(), "members")
    tidy(docs.sparkSession)
    return out


# -- comparison in blocks ----------------------------------------------------------------------------------------------


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) and len(y) else 0
    return 100 * both >= SIMILARITY * (len(x) + len(y) - both)


class ByBins:
    """Rows that may link: their sizes and bins do not rule it out, as |x ^ y| is at least the difference of the bins."""

    payload = ("n", "bins")

    def __init__(self, t: pa.Table, order: np.ndarray) -> None:
        self.n, raw = t.column("n").to_numpy()[order], t.column("bins").to_pylist()
        self.fine = [np.frombuffer(raw[k], np.uint8) for k in order]
        self.bins, self.group = np.stack([folded(x, BINS) for x in self.fine]), -1

    def may(self, k, others: np.ndarray) -> np.ndarray:
        n, m = self.n[k], self.n[others]
        out = 3 * np.maximum(n, m) <= 4 * np.minimum(n, m)
        some = np.flatnonzero(out)
        mine = self.bins[k] if np.isscalar(k) else self.bins[k[some]]
        out[some] = 7 * np.abs(self.bins[others[some]] - mine).sum(1, dtype=np.int64) <= (n if np.isscalar(k) else n[some]) + m[some]
        return out

    def to_heads(self, heads: np.ndarray) -> np.ndarray:
        """For each row whether it is similar to the first row of its group."""
        out = self.may(heads, np.arange(len(heads)))
        for k in np.flatnonzero(out):
            size = min(len(self.fine[k]), len(self.fine[heads[k]]))
            if size > BINS:
                differ = np.abs(folded(self.fine[k], size) - folded(self.fine[heads[k]], size)).sum(dtype=np.int64)
                out[k] = 7 * differ <= self.n[k] + self.n[heads[k]]
        return out

    def hits(self, k: int, span: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Rows of k's group that are similar to k, one of each other label."""
        others = span[label[span] != label[k]]
        near = others[self.may(int(k), others)]
        if len(near) and self.group != span[0]:
            self.group, size = span[0], min(len(self.fine[m]) for m in span)
            self.matrix = np.stack([folded(self.fine[m], size) for m in span]) if size > BINS else None
        if len(near) and self.matrix is not None:
            differ = np.abs(self.matrix[near - span[0]] - self.matrix[k - span[0]]).sum(1, dtype=np.int64)
            near = near[7 * differ <= self.n[k] + self.n[near]]
        return near[np.unique(label[near], return_index=True)[1]]


class BySets(ByBins):
    """Rows that link: exact comparison of the shingle sets of their texts, where the bins allow a link."""

    payload = ("text",)

    def __init__(self, t: pa.Table, order: np.ndarray) -> None:
        sets: list[np.ndarray] = []
        for chunk in t.column("text").chunks:
            sets += [s for _, s in shingle_sets(chunk)]
        self.sets = [sets[k] for k in order]
        self.n, self.group = np.array([len(s) for s in self.sets], np.int64), -1
        self.bins = np.stack([folded(bins_of(s), BINS) for s in self.sets])

    def to_heads(self, heads: np.ndarray) -> np.ndarray:
        out = self.may(heads, np.arange(len(heads)))
        for k in np.flatnonzero(out):
            out[k] = linked(self.sets[k], self.sets[heads[k]])
        return out

    def hits(self, k: int, span: np.ndarray, label: np.ndarray) -> np.ndarray:
        if self.group != span[0]:  # all sets of the group as places in one table of its elements
            self.group, self.first = span[0], np.cumsum(self.n[span]) - self.n[span]
            values, self.place = np.unique(np.concatenate([self.sets[m] for m in span]), return_inverse=True)
            self.mark = np.zeros(len(values), bool)
        at = self.first[k - span[0]]
        mine = self.place[at : at + self.n[k]]
        self.mark[mine] = True
        both = np.add.reduceat(self.mark[self.place], self.first, dtype=np.int64)
        self.mark[mine] = False
        near = span[(label[span] != label[k]) & (100 * both >= SIMILARITY * (self.n[k] + self.n[span] - both))]
        return near[np.unique(label[near], return_index=True)[1]]


def joining(a: np.ndarray, b: np.ndarray) -> pa.Table:
    """Those of the links (a, b) that join what the ones before them left apart."""
    names, place = np.unique(np.r_[a, b], return_inverse=True)
    root, kept = list(range(len(names))), []
    for k, (x, y) in enumerate(zip(place[: len(a)].tolist(), place[len(a) :].tolist())):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        while root[y] != y:
            root[y] = root[root[y]]
            y = root[y]
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append(k)
    return pa.table({"a": pa.array(a[kept], pa.int64()), "b": pa.array(b[kept], pa.int64())})


def spanning_forest(kind: type):
    """Links (a, b) that join the rows of each group (g, j, s) as far as kind's similarity does, one less than its rows at most.

    A row has a label c, and rows of equal labels are joined already. Each row is compared with the first of its group,
    then each row that asks (and, where all ask, did not join the first) with all rows of other labels."""

    def run(t: pa.Table) -> pa.Table:
        col = {c: t.column(c).to_numpy(zero_copy_only=False) for c in ("g", "j", "s", "id", "c", "asks")}
        order = np.lexsort((~col["asks"], col["id"], col["s"], col["j"], col["g"]))
        same = np.all([col[c][order][1:] == col[c][order][:-1] for c in ("g", "j", "s", "id")], axis=0)
        order = order[np.r_[True, ~same]]  # a row that came twice
        kind_of = kind(t, order)
        g, j, s, ids, label, asks = (col[c][order] for c in col)
        at = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (j[1:] != j[:-1]) | (s[1:] != s[:-1])])
        size = np.diff(np.r_[at, len(g)])
        heads = np.repeat(at, size)
        label = label.copy()
        star = kind_of.to_heads(heads) & (label != label[heads])
        a, b = [ids[star]], [ids[heads[star]]]
        joined = star | (label == label[heads])
        for begin, n in zip(at, size):
            if n < 2 or joined[begin : begin + n].all():
                continue
            span = np.arange(begin, begin + n)
            now = label[span]
            for lost in np.unique(now[star[span]]):  # whole labels join with the first row's
                now[now == lost] = now[0]
            label[span] = now
            every = asks[span].all()
            for k in span[asks[span]]:
                if every and label[k] == label[begin]:
                    continue
                hits = kind_of.hits(k, span, label)
                if len(hits):
                    a.append(np.full(len(hits), ids[k]))
                    b.append(ids[hits])
                    label[span[np.isin(label[span], label[hits])]] = label[k]
        return joining(np.concatenate(a), np.concatenate(b))

    return run


def joined_in_blocks(members: DataFrame, payload: DataFrame, kind: type, block: int, slot: int) -> DataFrame:
    """Links (a, b), stored, that join all of members(g, id, size of g) that share a g and are similar, directly or
    through others.

    payload(id, ...) has what kind compares. A group of more than `block` members is dealt out in blocks, each with the
    group's two pivots. What the blocks leave outside the group's largest component, the strays, then meets every block;
    strays beyond `block` are dealt in blocks too. So a group gives as many rows as members, unless more than a block of
    them are strays; nothing is ever emitted for a pair but a link that joins two components.
    """
    spark, total = members.sparkSession, max(1, members.count())
    placed = members.withColumn("nb", F.ceil(F.col("size") / block))
    placed = stored(placed.select("g", "id", "size", "nb", F.pmod(F.xxhash64("id", "g"), F.col("nb")).alias("j")), "placed")
    large = placed.where("nb > 1")
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    ends = F.array(F.min(F.struct(F.xxhash64("id").alias("h"), "id"))["id"], F.max(F.struct(F.xxhash64("id").alias("h"), "id"))["id"])
    pivots = large.groupBy("g", "nb").agg(ends.alias("ends")).select("g", "nb", F.explode("ends").alias("id")).select("g", "id", spread("nb").alias("j"))
    own = [F.lit(0).cast("bigint").alias("s"), F.col("id").alias("c"), F.lit(True).alias("asks")]
    first = placed.select("g", "j", "id").unionByName(pivots.select("g", "j", "id")).select("g", "j", "id", *own)

    def links(rows: DataFrame, name: str) -> DataFrame:
        slots = partitions_for(spark, 1.2 * total, slot)
        rows = rows.join(payload.select("id", *kind.payload), "id").withColumn("slot", F.pmod(F.xxhash64("g", "j", "s"), F.lit(slots)))
        out = stored(rows.groupBy("slot").applyInArrow(spanning_forest(kind), "a bigint, b bigint"), name)
        tidy(spark)
        return out

    one = links(first, "links")
    if large.isEmpty():
        dropped(placed)
        return one
    comp = components(one).withColumnRenamed("component", "c")
    named = stored(large.join(comp, "id", "left").withColumn("c", F.coalesce("c", "id")), "named")
    most = named.groupBy("g", "size", "c").agg(F.count("*").alias("rows")).groupBy("g", "size").agg(F.max(F.struct("rows", "c")).alias("m"))
    strays = F.col("size") - F.col("m.rows")
    apart = most.where(strays > 0).select("g", F.col("m.c").alias("main"), F.ceil(strays / block).alias("sb"), F.col("size").alias("of"))
    rest = stored(join_groups(named, apart, "g", "of", total).where("sb > 0"), "apart")
    if rest.isEmpty():
        dropped(placed, named, rest)
        return one
    base = rest.select("g", "j", "id", spread("sb").alias("s"), "c", F.lit(False).alias("asks"))
    ask = rest.where("c <> main").select("g", spread("nb").alias("j"), "id", F.pmod(F.xxhash64("id", F.lit(7)), F.col("sb")).alias("s"), "c", F.lit(True).alias("asks"))
    two = links(base.unionByName(ask), "links")
    dropped(placed, named, rest)
    return one.unionByName(two)


def named_texts(docs: DataFrame) -> DataFrame:
    """(id, text): the set id and text of each distinct set with two shingles or more that a task reads."""

    def run(batches):
        once = Once()
        for batch in batches:
            ids, keep = [], []
            for _, s in shingle_sets(batch.column(0)):
                ids.append(set_id(set_key(s)))
                keep.append(len(s) > 1 and once(ids[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), batch.column(0)], names=["id", "text"]).filter(pa.array(keep, pa.bool_()))

    return docs.selectExpr("cast(text as string) text").mapInArrow(run, "id bigint, text string")


def linked_sets(docs: DataFrame, info: DataFrame, n_signatures: float) -> DataFrame:
    """(id, component) of all sets that link with another.

    Linking sets share a signature. In each signature's list the members whose sizes and bins allow a link are joined;
    the components of these joins are clusters, and linking sets lie in one cluster. The texts of clusters are brought
    together, once, and joined by exact comparison.
    """
    members = shared_signatures(docs, n_signatures)
    may = joined_in_blocks(members, info, ByBins, LIST_BLOCK, SLOT)
    clusters = stored(components(may).select("id", F.col("component").alias("g")), "clusters")
    tidy(docs.sparkSession)
    texts = stored(named_texts(docs).join(clusters.select("id"), "id", "left_semi").dropDuplicates(["id"]), "texts")
    tidy(docs.sparkSession)
    sizes = clusters.groupBy("g").agg(F.count("*").alias("size"))
    placed = join_groups(clusters, sizes, "g", "size", max(1, clusters.count()))
    links = joined_in_blocks(placed, texts, BySets, BLOCK, TEXT_SLOT)
    out = stored(components(links), "components")
    dropped(members, clusters, texts)
    return out


# -- documents -----------------------------------------------------------------------------------------------------------


def rows_by_set(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(each, named): doc_id, n, key of each row; and key, copies, component (a set id), component_id of each distinct set
    with elements: component_id is the smallest doc_id of the component."""
    each = stored(set_table(docs), "sets-of-docs")
    info = stored(each.where("n > 0").groupBy("key", "id", "n").agg(F.min("doc_id").alias("rep"), F.first("bins").alias("bins"), F.count("*").alias("copies")), "distinct")
    sizes = info.agg(F.sum("n")).first()[0]
    comp = linked_sets(docs, info, 1.1 * sizes) if sizes else info.select("id", F.col("id").alias("component"))
    # only linked sets take part in the grouping by component; all others are their own
    linked_ = stored(info.select("key", "id", "rep").join(comp, "id"), "named")
    least = linked_.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("sets"))
    linked_ = join_groups(linked_, least, "component", "sets", max(1, linked_.count())).select("key", "component", "component_id")
    named = info.select("key", "id", "rep", "copies").join(linked_, "key", "left")
    return each, named.withColumns({"component_id": F.when(F.col("component").isNull(), F.col("rep")).otherwise(F.col("component_id")), "component": F.coalesce("component", "id")})


def near_groups(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    Whole texts; a set is the distinct 5-word shingles (the whole sequence of a shorter text); null and word-less texts
    have none and link with nothing. Equal sets link. Repeated rows and equal ids are rows of their own; a row without
    doc_id has the smallest id of its group, or null. Other columns are ignored; an empty table gives no rows. Sets are
    told apart by 128-bit hashes of their 64-bit shingle hashes, and in the join by 64 bits of them.
    """
    each, named = rows_by_set(docs)
    key = F.when(F.col("n") > 0, F.col("key")).otherwise(F.concat(F.lit("none:"), F.uuid())).alias("key")
    out = join_groups(each.select("doc_id", "n", key), named.select("key", "copies", "component_id"), "key", "copies", max(1, each.count()))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


@arrow_udf(StringType())
def key_of_text(text: pa.Array) -> pa.Array:
    """The set's key, null for word-less texts."""
    return pa.array([set_key(s) if len(s) else None for _, s in shingle_sets(text)], pa.string())


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one document of each group of near duplicates: the one of smallest id (rows without an id come last; of
    rows equal in id and set an arbitrary one stays, of one id on several linked sets that of the smallest set hash).
    Word-less documents all stay. Columns are unchanged; an empty table gives no rows."""
    _, named = rows_by_set(docs)
    reps = named.groupBy("component").agg(F.min(F.struct(F.col("rep").isNull().alias("no_id"), "rep", "key")).alias("r"))
    reps = reps.select(F.col("r.key").alias("_rep_key"), F.col("r.rep").alias("_rep_id"))
    name = free_name(docs, "set_key")
    marked = docs.withColumn(name, key_of_text(F.col("text").cast("string")))
    same = (F.col(name) == F.col("_rep_key")) & F.col("doc_id").cast("bigint").eqNullSafe(F.col("_rep_id"))
    once = marked.join(reps, same, "left_semi").dropDuplicates([name])
    return once.unionByName(marked.where(F.col(name).isNull())).select(*[f"`{c}`" for c in docs.columns])


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


ORACLE = {
    "op8_ngram_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_n FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * both_n >= 75 * (x.n + y.n - both_n)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.c, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT a, min(b) AS c FROM r GROUP BY 1) m ON m.a = d.doc_id""",
}
