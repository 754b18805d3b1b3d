"""Exact deduplication with a cuckoo-filter index that takes insertions and deletions of live digests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, free_name, join_groups, mix64, partitions_for, stored, table, text_or_empty

SLOTS = 4
MAX_KICKS = 64
#: Rows of a batch from which a digest is counted before the shuffle.
HOT_IN_BATCH = 8
NO_ID = 2**63 - 1


class CuckooFilter:
    """Partial-key cuckoo filter (Fan et al. 2014) over 64-bit keys: 16-bit fingerprints, four slots a bucket.

    insert() doubles the table and fills it again from the keys kept by the caller when a key finds no slot, so it
    never refuses one. Copies of a key are stored once for each insertion, and each deletion takes one away.
    """

    def __init__(self, expected: int = 64) -> None:
        self.n_buckets = 1 << max(1, int(np.ceil(np.log2(max(expected, 1) / (SLOTS * 0.85) + 1))))
        self.slots = np.zeros((self.n_buckets, SLOTS), np.uint16)
        self.resizes = 0

    def _place(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix64(np.asarray(keys, np.int64).view(np.uint64))
        mask = np.uint64(self.n_buckets - 1)
        mark = (h >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        first = h & mask
        return mark, first.astype(np.int64), self._other(first, mark)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return ((np.asarray(bucket, np.uint64) ^ mix64(np.asarray(mark, np.uint64))) & np.uint64(self.n_buckets - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, one, two = self._place(keys)
        return (self.slots[one] == mark[:, None]).any(1) | (self.slots[two] == mark[:, None]).any(1)

    def insert(self, keys: np.ndarray, live: list[np.ndarray]) -> None:
        """live: every key in the filter, those of this call included; read again only when the table must grow."""
        if not self._insert(keys):
            while True:
                self.n_buckets *= 2
                self.resizes += 1
                self.slots = np.zeros((self.n_buckets, SLOTS), np.uint16)
                if all(self._insert(part) for part in live):
                    break

    def _insert(self, keys: np.ndarray) -> bool:
        mark, one, two = self._place(keys)
        left = np.arange(len(keys))
        for bucket in (one, two):
            for slot in range(SLOTS):  # all keys at once: of those that want a slot the first takes it
                free = left[self.slots[bucket[left], slot] == 0]
                _, at = np.unique(bucket[free], return_index=True)
                won = free[at]
                self.slots[bucket[won], slot] = mark[won]
                left = np.setdiff1d(left, won, assume_unique=True)
        for k in left:  # the rest push others on
            m, at = mark[k], int(two[k])
            for kick in range(MAX_KICKS):
                empty = np.flatnonzero(self.slots[at] == 0)
                if len(empty):
                    self.slots[at, empty[0]] = m
                    break
                slot = (kick * 7 + at) % SLOTS
                m, self.slots[at, slot] = self.slots[at, slot], m
                at = int(self._other(np.array([at]), np.array([m], np.uint16))[0])
            else:
                return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        """Only keys known to be in the filter may be deleted; one copy of each goes."""
        for mark, one, two in zip(*self._place(keys)):
            for at in (one, two):
                found = np.flatnonzero(self.slots[at] == mark)
                if len(found):
                    self.slots[at, found[0]] = 0
                    break


class BucketIndex:
    """One bucket of the index: the filter answers look-ups, and each hit is verified against the content record kept for
    the digest: the whole SHA-256 with the length and a second, independent hash of the text."""

    def __init__(self, expected: int = 64) -> None:
        self.filter, self.kept, self.hits, self.false_hits = CuckooFilter(expected), {}, 0, 0

    @staticmethod
    def keys(digests: list[str]) -> np.ndarray:
        return np.array([int(d[:16], 16) for d in digests], np.uint64).view(np.int64)

    def insert(self, digests: list[str], content: list, ids: list[int], sizes: list[int]) -> None:
        """Rows of live digests, each with its content record, smallest id and number of documents. A digest that is not in
        the filter, or hits another's fingerprint, is inserted; a hit on the same content joins what is kept."""
        while digests:
            later: list[int] = []
            new: list[str] = []
            met: set[str] = set()
            hit = self.filter.contains(self.keys(digests))
            for k, d in enumerate(digests):
                if d in met and not hit[k]:  # inserted with this call: looked up again once it is in the filter
                    later.append(k)
                    continue
                have = self.kept.get(d) if hit[k] else None
                if have is None:
                    self.false_hits += bool(hit[k])
                    self.kept[d] = [content[k], ids[k], sizes[k], 0]
                    new.append(d)
                    met.add(d)
                elif have[0] != content[k]:
                    raise ValueError(f"different texts with digest {d}")
                else:
                    self.hits += 1
                    have[1], have[2], have[3] = min(have[1], ids[k]), have[2] + sizes[k], have[3] + 1
            if new:
                self.filter.insert(self.keys(new), [self.keys(list(self.kept))])
            digests, content, ids, sizes = ([v[k] for k in later] for v in (digests, content, ids, sizes))

    def delete(self, digests: list[str]) -> list[str]:
        """Take live digests out; returns those that were there."""
        gone = [d for d, hit in zip(digests, self.filter.contains(self.keys(digests))) if hit and self.kept.pop(d, None)] if digests else []
        if gone:
            self.filter.delete(self.keys(gone))
        return gone


def digest(column: str = "text"):
    """Lowercase hex SHA-256 of the text with each run of white space as one space; null counts as empty."""
    return F.sha2(F.regexp_replace(text_or_empty(column), SPACE, " "), 256)


def keyed_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, text_sha256 and the content record's length and second hash, of each row."""
    normal = F.regexp_replace(text_or_empty(text_column), SPACE, " ")
    rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), normal.alias("t"))
    return rows.select("doc_id", F.sha2("t", 256).alias("text_sha256"), F.octet_length("t").cast("bigint").alias("n_bytes"), F.xxhash64("t").alias("second"))


def build_index(keyed: DataFrame, n_keys: float, removed: DataFrame | None = None, bucket_rows: int = 100_000) -> DataFrame:
    """(text_sha256, keep_id, group_size, hits) of the live digests of keyed_rows().

    Every row is sent to the bucket of its digest and goes through that bucket's cuckoo filter; only of a digest that
    HOT_IN_BATCH rows or more of one Arrow batch share, as a third of all rows may, one counted row is sent for the
    batch. hits: how many rows of the digest met it in the filter and were verified. removed(text_sha256): digests
    that are deleted from the index once everything is in it. A lost bucket is built again from its rows.
    """
    n = partitions_for(keyed.sparkSession, n_keys, bucket_rows)
    names = ["text_sha256", "n_bytes", "second", "keep_id", "group_size", "gone"]

    def send(batches):
        for pdf in batches:
            pdf = pdf.rename(columns={"doc_id": "keep_id"})
            pdf["keep_id"], pdf["group_size"], pdf["gone"] = pdf["keep_id"].astype("Int64"), 1, False
            rows = pdf.groupby("text_sha256")["group_size"].transform("size") if len(pdf) else pdf["group_size"]
            hot = pdf[rows >= HOT_IN_BATCH].groupby("text_sha256", as_index=False).agg({"n_bytes": "first", "second": "first", "keep_id": "min", "group_size": "sum", "gone": "first"})
            for part in (pdf[rows < HOT_IN_BATCH], hot):
                if len(part):
                    yield part[names]

    def bucket(batches):
        index, gone = BucketIndex(1024), []
        for pdf in batches:
            old = pdf["gone"].to_numpy(bool)
            gone += list(pdf["text_sha256"][old])
            live = pdf[~old]
            ids = [NO_ID if pd.isna(i) else int(i) for i in live["keep_id"]]
            index.insert(list(live["text_sha256"]), list(zip(live["n_bytes"], live["second"])), ids, [int(x) for x in live["group_size"]])
        index.delete(gone)
        out = pd.DataFrame([(d, None if i == NO_ID else i, size, hits) for d, (_, i, size, hits) in index.kept.items()], columns=["text_sha256", "keep_id", "group_size", "hits"])
        out["keep_id"] = out["keep_id"].astype("Int64")
        yield out

    part = keyed.mapInPandas(send, "text_sha256 string, n_bytes bigint, second bigint, keep_id bigint, group_size bigint, gone boolean")
    if removed is not None:
        none = F.lit(None).cast("bigint")
        part = part.unionByName(removed.select("text_sha256", none.alias("n_bytes"), none.alias("second"), none.alias("keep_id"), F.lit(0).cast("bigint").alias("group_size"), F.lit(True).alias("gone")))
    return part.repartition(n, "text_sha256").mapInPandas(bucket, "text_sha256 string, keep_id bigint, group_size bigint, hits bigint")


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, text_sha256, keep_id, group_size, kept.

    Texts are equal when equal after each run of white space becomes one space; the smallest id of equal texts stays
    (an id that stands on several equal rows is marked kept on each of them; rows without an id stay only in groups
    that have no id). Null texts equal empty ones. An empty table gives no rows. Other columns are ignored.
    """
    keyed = stored(keyed_rows(docs, id_column, text_column), "digests")
    total = keyed.count()
    groups = stored(build_index(keyed, total), "index").drop("hits")
    out = join_groups(keyed.select("doc_id", "text_sha256"), groups, "text_sha256", "group_size", total)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text an earlier id has; of rows equal in id and text one stays (which, where their other
    columns differ, is left open). Columns are unchanged, whatever their names; an empty table gives no rows."""
    keep = exact_groups(docs).where("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_sha")).distinct()
    name = free_name(docs, "sha")
    same = F.col("doc_id").cast("bigint").eqNullSafe(F.col("_kept_id")) & (F.col(name) == F.col("_kept_sha"))
    once = docs.withColumn(name, digest()).join(keep, same, "left_semi")
    return once.dropDuplicates(["doc_id", name]).select(*[f"`{c}`" for c in docs.columns])


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE = {
    "op10_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
}
