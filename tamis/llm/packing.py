"""Packing token pieces into sequences of several lengths: tiers, gap filling, balanced step groups."""

from __future__ import annotations

import base64
import bisect
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import stored, table

#: Longest sequence; shorter tiers are the powers of two below it, and a sequence of any tier is exactly full.
LENGTH = 2048
SHORTEST = 256
EOS = 1
STEP_TOKENS = 64 * LENGTH

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, tier int, step_group bigint"


def encoder(name: str = "byte_bpe_50k"):
    """ids of a text: the public byte-level BPE vocabulary, its rank file driven by tiktoken, which gives the same ids
    as tokenizers with the JSON file (a test compares them); <|endoftext|> inside a text is its special id, as there."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 50256})
    return lambda text: enc.encode(text, allowed_special="all") if "<|endoftext|>" in text else enc.encode_ordinary(text)


def tiers(longest: int, shortest: int = SHORTEST) -> list[int]:
    """Context sizes from the longest: the powers of two down to the shortest."""
    return [1 << k for k in range(longest.bit_length() - 1, min(shortest, longest).bit_length() - 2, -1)]


def pack_pieces(lengths: np.ndarray, longest: int = LENGTH) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Sequences (tier, [(document, start, length), ...]) that hold every token of documents of these lengths once.

    Documents are routed to the tier of the smallest context size that holds them; of longer ones whole windows are cut
    off first. Each tier, from the longest, opens windows with its own pieces, largest first; the gap of a window is
    filled with the largest pieces that fit, from this tier or shorter ones, and the last filler is cut to fit. When less
    than a window is left its pieces go down a tier; below the shortest tier the tail is laid out in full powers of two.
    """
    out: list[tuple[int, list[tuple[int, int, int]]]] = []
    sizes = tiers(longest)
    waiting: list[tuple[int, int, int]] = []  # (length, document, start), sorted: a tier is a range of lengths
    for doc, n in enumerate(lengths.tolist()):
        whole = n // longest * longest
        out += [(longest, [(doc, start, longest)]) for start in range(0, whole, longest)]
        if n > whole:
            waiting.append((n - whole, doc, whole))
    waiting.sort()
    left = sum(p[0] for p in waiting)

    def window(size: int) -> None:
        nonlocal left
        now, room = [], size
        while room:
            at = bisect.bisect_right(waiting, (room, 1 << 62, 0)) - 1
            if at >= 0:
                n, doc, start = waiting.pop(at)
            else:  # every piece is longer than the gap: cut the shortest
                n, doc, start = waiting.pop(0)
                bisect.insort(waiting, (n - room, doc, start + room))
                n = room
            now.append((doc, start, n))
            room -= n
        out.append((size, now))
        left -= size

    for k, size in enumerate(sizes):
        own = sizes[k + 1] if k + 1 < len(sizes) else 0
        while left >= size and waiting[-1][0] > own:
            window(size)
    size = sizes[-1]
    while left:
        while size > left:
            size >>= 1
        window(size)
    return out


def step_groups(seq_tiers: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A group for each sequence: sequences, longest first, go round the groups in serpentine order, so that groups get
    like numbers of each tier and of tokens."""
    groups = max(1, sum(seq_tiers) // step_tokens)
    out = [0] * len(seq_tiers)
    for k, i in enumerate(sorted(range(len(seq_tiers)), key=lambda i: -seq_tiers[i])):
        turn, at = divmod(k, groups)
        out[i] = at if turn % 2 == 0 else groups - 1 - at
    return out


def pack(docs: DataFrame, longest: int = LENGTH, vocabulary: str = "byte_bpe_50k", with_ids: bool = False, pool_tokens: int = 4_000_000) -> DataFrame:
    """One row for each piece: where the tokens of a document go. See op5's columns; tier, step_group; ids if asked for.

    Each task packs the rows it reads, in pools of pool_tokens tokens, so no row is shuffled and memory is bounded; a
    pool ends in exactly full sequences, so there is no padding at all. Null texts count as empty and have one token
    (the end token). Each row is a document of its own, equal doc_ids or repeated rows included. sequence_id is the task
    number and a running number. An empty table gives no rows. The row order of a stored table fixes the result.
    """
    if longest & (longest - 1):
        raise ValueError("the longest sequence must be a power of two")

    def run(batches):
        from pyspark import TaskContext

        encode = encoder(vocabulary)
        base, serial, group0 = TaskContext.get().partitionId() << 40, 0, 0

        def flush(ids: list, tokens: list):
            nonlocal serial, group0
            packed = pack_pieces(np.array([len(t) for t in tokens], np.int64), longest)
            groups = step_groups([t for t, _ in packed])
            cols: list[tuple] = []
            for (tier, pieces), group in zip(packed, groups):
                at = 0
                for doc, start, n in pieces:
                    raw = tokens[doc][start : start + n]
                    cols.append((ids[doc], start, n, zlib.crc32(raw.tobytes()), len(tokens[doc]), base + serial, at, tier, base + group0 + group) + ((raw.astype(np.int64),) if with_ids else ()))
                    at += n
                serial += 1
            group0 += max(groups, default=-1) + 1
            for k in range(0, len(cols), 20_000):
                frame = pd.DataFrame(cols[k : k + 20_000], columns=names)
                frame["doc_id"] = frame["doc_id"].astype("Int64")
                yield frame

        ids, tokens, held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                t = np.array(encode(text) + [EOS], "<u4")
                ids.append(doc_id)
                tokens.append(t)
                held += len(t)
                if held >= pool_tokens:
                    yield from flush(ids, tokens)
                    ids, tokens, held = [], [], 0
        if ids:
            yield from flush(ids, tokens)

    import pyarrow as pa

    schema = PIECES + (", ids array<bigint>" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]

    def arrow(batches):
        for frame in run(batches):
            yield pa.RecordBatch.from_pandas(frame, schema=fields, preserve_index=False)

    kinds = {"bigint": pa.int64(), "int": pa.int32(), "array<bigint>": pa.list_(pa.int64())}
    fields = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(arrow, schema)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(pack(table(spark, sf_dir, "documents")), "pieces")


ORACLE = {}
