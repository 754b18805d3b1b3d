"""Line deduplication: hashes of lines in ranges, sorted by document and place; keep bitmaps come back, never text."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, dropped, partitions_for, stored, table

#: Shortest key in code points, and documents that a key must stand in to be dropped.
LEAST_POINTS = 20
LEAST_DOCS = 3
#: Lines of a range.
RANGE_ROWS = 400_000
#: A missing doc_id counts as the smallest one.
NO_ID = -(2**63)
_SPACE = b" \t\n\x0b\x0c\r"
_CONTINUATION = bytes(range(0x80, 0xC0))
DROP, WAIT, EDGE = 0, 1, 2


def line_key(line: bytes) -> bytes:
    """The line in UTF-8 with white space stripped at both ends and A-Z lower-cased."""
    return line.strip(_SPACE).lower()


def _identified(docs: DataFrame) -> DataFrame:
    """doc, t, data: the id, a hash that tells rows of one id apart, and the text's bytes (null: empty)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("t"), text.cast("binary").alias("data"))


def line_hashes(docs: DataFrame, least_points: int = LEAST_POINTS) -> DataFrame:
    """h, g (128 bits of a key's hash), doc, t, at (line number from 0), for each line whose key is long enough."""

    def run(batches):
        for pdf in batches:
            marks, places, counts = [], [], []
            for data in pdf["data"]:
                before = len(places)
                for at, line in enumerate(bytes_of(data).split(b"\n")):
                    if len(line) >= least_points:
                        key = line_key(line)
                        if len(key) >= least_points and (key.isascii() or len(key.translate(None, _CONTINUATION)) >= least_points):
                            marks.append(xxhash.xxh3_128_digest(key))
                            places.append(at)
                counts.append(len(places) - before)
            both = np.frombuffer(b"".join(marks), dtype="<i8").reshape(-1, 2)
            yield pd.DataFrame({"h": both[:, 0], "g": both[:, 1], "doc": np.repeat(pdf["doc"].to_numpy(np.int64), counts), "t": np.repeat(pdf["t"].to_numpy(np.int64), counts), "at": np.array(places, np.int32)})

    return _identified(docs).mapInPandas(run, "h bigint, g bigint, doc bigint, t bigint, at int")


def _judge(least_docs: int):
    """Streams a range in the order h, g, doc (largest first), t, at. A key that begins and ends inside the range is settled:
    all its lines but those of its first document go (DROP). The first and the last key may reach into other ranges: their
    lines wait (WAIT), with one row on their documents (EDGE). Held: the rows of one key in one range."""

    def settle(part: np.ndarray, edge: bool) -> list[np.ndarray]:
        # columns: h, g, doc, t, at; repeated rows stand together and count once
        new = np.ones(len(part), bool)
        new[1:] = (part[1:] != part[:-1]).any(1)
        part = part[new]
        key = np.ones(len(part), bool)
        key[1:] = (part[1:, :2] != part[:-1, :2]).any(1)
        start = np.flatnonzero(key)
        end = np.append(start[1:], len(part))
        other = key.copy()
        other[1:] |= part[1:, 2] != part[:-1, 2]
        docs = np.add.reduceat(other.astype(np.int64), start)
        if not edge:
            go = np.repeat(docs >= least_docs, end - start) & (part[:, 2] != np.repeat(part[start, 2], end - start))
            rows = part[go]
            return [np.column_stack([rows, np.full(len(rows), DROP), np.zeros((len(rows), 1), np.int64)])]
        first, last = part[0, 2], part[-1, 2]
        inner = int(docs[0]) - (1 if first == last else 2)
        head = np.array([[part[0, 0], part[0, 1], d, 0, 0, EDGE, n] for d, n in ((first, inner), (last, 0))], np.int64)
        return [np.column_stack([part, np.full(len(part), WAIT), np.zeros((len(part), 1), np.int64)]), head]

    def run(batches):
        frame = lambda found: pd.DataFrame(np.concatenate(found), columns=["h", "g", "doc", "t", "at", "kind", "inner"])
        held: list[np.ndarray] = []
        first = True
        for pdf in batches:
            part = pdf[["h", "g", "doc", "t", "at"]].to_numpy(np.int64)
            if not len(part):
                continue
            change = np.flatnonzero((part[1:, :2] != part[:-1, :2]).any(1)) + 1
            if held and (held[-1][-1, :2] != part[0, :2]).any():
                change = np.insert(change, 0, 0)
            if not len(change):
                held.append(part)
                continue
            done = np.concatenate([*held, part[: change[0]]])  # one whole key
            found = settle(done, first)
            first = False
            if len(change) > 1:
                found += settle(part[change[0] : change[-1]], False)
            held = [part[change[-1] :]]
            yield frame(found)
        if held:
            yield frame(settle(np.concatenate(held), True))

    return run


def keep_bitmaps(docs: DataFrame, least_points: int = LEAST_POINTS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """doc, t, keep for each document that loses a line; keep is zlib over packed bits, one a line, 1: stays; lines after its end stay.

    Lines' hashes are cut in ranges by hash, then document, so a key that stands in a third of all documents lies in many
    ranges and no task gets it whole; what its ranges know of its documents (two rows a range) is put together by a broadcast.
    """
    lines = stored(line_hashes(docs, least_points), "lines")
    n = partitions_for(docs.sparkSession, lines.count(), RANGE_ROWS)
    order = ["h", "g", F.desc("doc")]
    judged = lines.repartitionByRange(n, *order).sortWithinPartitions(*order, "t", "at").mapInPandas(_judge(least_docs), "h bigint, g bigint, doc bigint, t bigint, at int, kind int, inner bigint")
    judged = stored(judged, "judged")
    edges = judged.where(F.col("kind") == EDGE).groupBy("h", "g").agg((F.sum("inner") + F.count_distinct("doc")).alias("docs"), F.max("doc").alias("stays"))
    edges = edges.where(F.col("docs") >= least_docs).select("h", "g", "stays")  # two keys a range at most
    waiting = judged.where(F.col("kind") == WAIT).join(F.broadcast(edges), ["h", "g"]).where("doc <> stays")
    gone = judged.where(F.col("kind") == DROP).select("doc", "t", "at").unionByName(waiting.select("doc", "t", "at"))

    def pack(batches):
        for pdf in batches:
            bits = []
            for places in pdf["places"]:
                bits.append(write_bitmap(np.asarray(places, np.int64)))
            yield pd.DataFrame({"doc": pdf["doc"], "t": pdf["t"], "keep": bits})

    found = gone.groupBy("doc", "t").agg(F.collect_list("at").alias("places"))
    out = stored(found.mapInPandas(pack, "doc bigint, t bigint, keep binary"), "keep")
    dropped(lines, judged)
    return out


def write_bitmap(gone: np.ndarray) -> bytes:
    """A bitmap in which the lines of these numbers are gone."""
    keep = np.ones((int(gone.max()) // 8 + 1) * 8, bool)
    keep[gone] = False
    return zlib.compress(np.packbits(keep).tobytes())


def read_bitmap(keep: bytes | None, n: int) -> np.ndarray:
    """n booleans: whether each line stays."""
    out = np.ones(n, bool)
    if keep is not None:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[:n].astype(bool)
        out[: len(bits)] = bits
    return out


def deduplicated(docs: DataFrame, least_points: int = LEAST_POINTS, least_docs: int = LEAST_DOCS, with_text: bool = False) -> DataFrame:
    """One row for each row of docs(doc_id, text): doc_id, n_lines, n_dropped, kept_sha256; with_text: also text, what is left.

    A text is split at newlines (null or empty: one empty line). A line's key is the line stripped of white space with A-Z
    lower-cased; keys of least_points code points and more that stand in least_docs documents lose all their lines, but for
    those in the largest doc_id. Documents are told apart by doc_id: rows of one id count as one document, each keeps its own
    lines and result; a null doc_id counts as one document smaller than all. Repeated rows give repeated results. Other columns
    are not read. An empty table gives no rows.
    """
    bits = keep_bitmaps(docs, least_points, least_docs)
    rows = _identified(docs).join(bits, ["doc", "t"], "left").select("doc", "data", "keep")

    def run(batches):
        for pdf in batches:
            out = []
            for data, keep in zip(pdf["data"], pdf["keep"]):
                lines = bytes_of(data).split(b"\n")
                if keep is not None:
                    stays = read_bitmap(keep, len(lines))
                    left = [line for line, stay in zip(lines, stays) if stay]
                    data = b"\n".join(left)
                else:
                    left, data = lines, bytes_of(data)
                out.append((len(lines), len(lines) - len(left), hashlib.sha256(data).hexdigest(), *([data.decode("utf-8", "replace")] if with_text else [])))
            yield pd.DataFrame(out, columns=["n_lines", "n_dropped", "kept_sha256", *(["text"] if with_text else [])]).assign(doc=pdf["doc"].to_numpy())

    schema = "doc bigint, n_lines bigint, n_dropped bigint, kept_sha256 string" + (", text string" if with_text else "")
    out = rows.mapInPandas(run, schema)
    return out.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), *out.columns[1:])


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents"))


ORACLE = {
    "op12_line_dedup": r"""WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS place, unnest(x) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS stays FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, place, line, coalesce(k.doc_id <> stays, false) AS gone FROM k LEFT JOIN g USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id"""
}
