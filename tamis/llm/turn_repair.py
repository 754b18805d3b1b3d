"""Conversation structure repair: turns are aligned to each feasible length of the alternating grammar by Wagner-Fischer tables."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Costs of the edits, and of leaving a truncated turn in.
DELETE, INSERT, REROLE, CUT = 2, 5, 1, 5
#: Turns up to which the whole table is kept; beyond, its columns of one parity are folded (see folded()).
LONG = 4_096
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
_FAR = 1 << 40
_REROLED = (REROLE, REROLE + CUT)


def costs(initials: list[str], faults: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What it costs each turn to stand for a user, an assistant and a system turn."""
    own = np.array([ord(c[0]) if c else 0 for c in initials], np.int64)
    stay = np.where(faults == TRUNCATED, CUT, 0)
    off = (faults == BLANK) | (faults == DUPLICATE)
    stand = lambda c: np.where(off, _FAR, stay + np.where(own == ord(c), 0, REROLE))
    return stand("u"), stand("a"), np.where(off | (own != ord("s")), _FAR, stay)


def incumbent(as_user: np.ndarray, as_assistant: np.ndarray, as_system: np.ndarray) -> int:
    """Cost of a repair that is easy to find: turns in order, each kept or given the awaited role where that is no dearer than deletion."""
    total, state = 0, "start"
    for user, assistant, system in zip(as_user.tolist(), as_assistant.tolist(), as_system.tolist()):
        if state == "start" and system == 0:
            state = "s"
            continue
        cost = assistant if state == "u" else user
        if cost <= DELETE:
            total, state = total + cost, "a" if state == "u" else "u"
        else:
            total += DELETE
    return min(total + {"start": 0, "a": 0, "u": INSERT, "s": DELETE}[state], DELETE * len(as_user))


class Table:
    """Wagner-Fischer costs of aligning turns i.. to the last r places of the alternation `ua...ua`, row by row from the end.

    Targets of all lengths end alike, so one table serves them all. A cell is kept only while its cost and the least cost of
    the turns before it stay within the incumbent's: Ukkonen's band, as narrow as that cost allows."""

    def __init__(self, as_user: np.ndarray, as_assistant: np.ndarray, bound: int) -> None:
        n = len(as_user)
        self.as_user, self.as_assistant = as_user, as_assistant
        least = np.minimum(DELETE, np.minimum(as_user, as_assistant))
        least[least == REROLE] = 0  # a turn that is no user or assistant may be the system's
        before = np.concatenate([[0], np.cumsum(least)])
        self.low, self.rows = [0] * (n + 1), [np.zeros(0, np.int64)] * (n + 1)
        reach = max(0, (bound - int(before[n])) // INSERT)
        self.rows[n] = INSERT * np.arange(reach + 1, dtype=np.int64)
        for i in range(n - 1, -1, -1):
            low, after = self.low[i + 1], self.rows[i + 1]
            if not len(after):
                continue
            more = max(0, (bound - int(before[i]) - int(after.min())) // INSERT)
            r = np.arange(low, low + len(after) + 1 + more)
            row = np.full(len(r), _FAR, np.int64)
            row[: len(after)] = after + DELETE
            stand = np.where(r[1 : len(after) + 1] % 2 == 0, as_user[i], as_assistant[i])
            row[1 : len(after) + 1] = np.minimum(row[1 : len(after) + 1], after + stand)
            row = np.minimum.accumulate(row - INSERT * r) + INSERT * r
            inside = np.flatnonzero(row <= bound - before[i])
            if len(inside):
                self.low[i], self.rows[i] = int(r[inside[0]]), row[inside[0] : inside[-1] + 1]

    def cost(self, i: int, r: int) -> int:
        k = r - self.low[i]
        return int(self.rows[i][k]) if 0 <= k < len(self.rows[i]) else _FAR

    def lengths(self, i: int) -> range:
        """Even places that can be left at turn i."""
        low = self.low[i]
        return range(low + low % 2, low + len(self.rows[i]), 2)

    def audit(self, i: int, r: int) -> str:
        """The ASCII-least cheapest edits from a cell on."""
        out, n = [], len(self.as_user)
        while i < n or r:
            now = self.cost(i, r)
            if i < n and self.cost(i + 1, r) + DELETE == now:
                out.append("D")
                i += 1
            elif r and self.cost(i, r - 1) + INSERT == now:
                out.append("I")
                r -= 1
            else:
                stand = int((self.as_assistant if r % 2 else self.as_user)[i])
                out.append("R" if stand in _REROLED else "K")
                i, r = i + 1, r - 1
        return "".join(out)


def aligned(as_user: np.ndarray, as_assistant: np.ndarray, as_system: np.ndarray) -> tuple[int, str]:
    """(cost, audit) over all targets, with and without a system turn in front, by whole tables and their backtraces."""
    t = Table(as_user, as_assistant, incumbent(as_user, as_assistant, as_system))
    ends = [(t.cost(0, r), -1, r) for r in t.lengths(0)]
    for p in np.flatnonzero(as_system < _FAR).tolist():
        ends += [(DELETE * p + int(as_system[p]) + t.cost(p + 1, r), p, r) for r in t.lengths(p + 1) if r]
    best = min(c for c, _, _ in ends)
    return best, min(t.audit(0, r) if p < 0 else "D" * p + "K" + t.audit(p + 1, r) for c, p, r in ends if c == best)


def folded(as_user: np.ndarray, as_assistant: np.ndarray, as_system: np.ndarray) -> tuple[int, str]:
    """The same for very long conversations: whether a place awaits a user or an assistant depends on the parity of what is
    left alone, so the cheapest over all lengths needs one column for each parity, and one for nothing left. Cells:
    0 nothing left, 1 a user awaited, 2 an assistant awaited, 3 the start. All lengths are traced back at once."""
    n = len(as_user)
    user, assistant, system = as_user.tolist(), as_assistant.tolist(), as_system.tolist()
    after = [0, 2 * INSERT, INSERT, 0]
    cost = np.zeros((n + 1, 4), np.int64)
    cost[n] = after
    for i in range(n - 1, -1, -1):
        end = after[0] + DELETE
        a = min(after[2] + DELETE, assistant[i] + min(after[0], after[1]), INSERT + end)
        u = min(after[1] + DELETE, user[i] + after[2], INSERT + a)
        a = min(a, INSERT + u)
        start = min(end, u, after[3] + DELETE, system[i] + after[1])
        after = [end, u, a, start]
        cost[i] = after
    out, i, cells = [], 0, {3}
    while i < n or cost[i, next(iter(cells))]:
        now = int(cost[i, next(iter(cells))])  # of all cells alike
        here = cells | ({c for c in (0, 1) if cost[i, c] == now} if 3 in cells else set())
        move: dict[str, set] = {}

        def offer(op, c, at, spent, here_now=now, moves=move):
            if cost[at, c] + spent == here_now:
                moves.setdefault(op, set()).add(c)

        for c in here:
            if i < n:
                offer("D", c, i + 1, DELETE)
            if c == 1:
                offer("I", 2, i, INSERT)
                if i < n:
                    offer("R" if user[i] in _REROLED else "K", 2, i + 1, user[i])
            elif c == 2:
                for to in (0, 1):
                    offer("I", to, i, INSERT)
                    if i < n:
                        offer("R" if assistant[i] in _REROLED else "K", to, i + 1, assistant[i])
            elif c == 3 and i < n:
                offer("K", 1, i + 1, system[i])
        op = min(move)
        out.append(op)
        cells, i = move[op], i + (op != "I")
    return int(cost[0, 3]), "".join(out)


def repair(initials: list[str], faults: np.ndarray, long: int = LONG) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits of one conversation; equal costs: the ASCII-least audit."""
    if not len(faults):
        return 0, ""
    stand = costs(initials, faults)
    return (aligned if len(faults) <= long else folded)(*stand)


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def _conversations(batches, columns: list[str]):
    """(conv_id or None, one list for each column) for each conversation of a stream sorted by no_conv, conv."""
    now, held = None, [[] for _ in columns]
    for pdf in batches:
        null, key = pdf["no_conv"].to_numpy(bool), pdf["conv"].to_numpy(np.int64)
        lists = [pdf[c].tolist() for c in columns]
        cut = (np.flatnonzero((key[1:] != key[:-1]) | (null[1:] != null[:-1])) + 1).tolist()
        for a, b in zip([0, *cut], [*cut, len(pdf)]):
            if a == b:
                continue
            name = None if null[a] else int(key[a])
            if held[0] and name != now:
                yield now, held
                held = [[] for _ in columns]
            now = name
            for have, more in zip(held, lists):
                have += more[a:b]
    if held[0]:
        yield now, held


def _known(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Whole numbers that may be null as a number and a flag, so that pandas does not make them floats."""
    return df.withColumns({new: F.coalesce(old, F.lit(0).cast("bigint")) for old, new in names.items()} | {f"no_{new}": F.col(old).isNull() for old, new in names.items()})


def _facts(turns: DataFrame) -> DataFrame:
    """For each turn what the alignment needs in place of its text: a seal of role and text, and whether it is blank or cut off."""
    seal = F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256), 1, 32)
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(F.col("text").rlike(r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z"), TRUNCATED).otherwise(0)
    return turns.withColumns({"seal": seal, "fault": fault.cast("int")})


SUMMARY = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def audits(turns: DataFrame, long: int = LONG) -> DataFrame:
    """One row for each conversation: gaps, faults, cost and audit. turns: conv_id, turn, role, text without nulls in the last two,
    and gone (rows that only keep their conversation's id). About 60 bytes of a turn are held, no text."""

    def run(batches):
        done = []
        for conv, (place, no_place, initials, seals, fault, gone) in _conversations(batches, ["place", "no_place", "first", "seal", "fault", "gone"]):
            stay = [k for k, g in enumerate(gone) if not g]
            seen, faults = set(), np.zeros(len(stay), np.int64)
            for to, k in enumerate(stay):
                faults[to] = DUPLICATE if seals[k] in seen and fault[k] != BLANK else fault[k]
                seen.add(seals[k])
            numbers = {place[k] for k in stay if not no_place[k]}
            gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
            initials = [initials[k] for k in stay]
            cost, audit = repair(initials, faults, long)
            done.append((conv, gaps, *(int((faults == k).sum()) for k in (BLANK, DUPLICATE, TRUNCATED)), illegal_pairs(initials), cost, audit))
            if len(done) >= 1000:
                yield _frame(done, [c.split()[0] for c in SUMMARY.split(", ")])
                done = []
        yield _frame(done, [c.split()[0] for c in SUMMARY.split(", ")])

    facts = _known(_facts(turns), {"conv_id": "conv", "turn": "place"}).withColumn("first", F.substring("role", 1, 1))
    ordered = facts.select("conv", "no_conv", "place", "no_place", "role", "first", "seal", "fault", "gone").repartition("conv", "no_conv")
    ordered = ordered.sortWithinPartitions("no_conv", "conv", F.desc("no_place"), "place", "role", "seal")
    return ordered.drop("role").mapInPandas(run, SUMMARY)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    columns = dict(zip(names, zip(*rows))) if rows else {c: [] for c in names}
    return pd.DataFrame(columns | {"conv_id": pd.array(list(columns["conv_id"]), "Int64")})


def repaired(turns: DataFrame, long: int = LONG) -> DataFrame:
    """One row for each conversation of turns(conv_id, turn, role, text, gone boolean): conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256.

    Rows go by turn (null first; equal ones by role, then by a seal of the text). A null role or text counts as one space, a
    role without a character fits no place. Repeated rows are turns of their own, so all but the first are duplicates. Rows that are gone leave
    their conversation in the result. Tables are aligned first, without texts; then the texts stream past their audit in the
    same order and are hashed, so no task holds a conversation's texts. An empty table gives no rows.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    turns = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), space("role"), space("text"), F.coalesce("gone", F.lit(False)).alias("gone"))
    found = audits(turns, long)
    names = found.columns[1:]
    none = lambda c: F.lit(None).cast(c)
    heads = found.select("conv_id", F.lit(0).alias("front"), none("bigint").alias("turn"), none("string").alias("role"), none("string").alias("seal"), none("string").alias("text"), *names)
    types = dict(found.dtypes)
    rows = _facts(turns).where(~F.col("gone")).select("conv_id", F.lit(1).alias("front"), "turn", "role", "seal", "text", *[none(types[c]).alias(c) for c in names])
    both = _known(heads.unionByName(rows), {"conv_id": "conv"}).drop("conv_id").repartition("conv", "no_conv")
    both = both.sortWithinPartitions("no_conv", "conv", "front", F.asc_nulls_first("turn"), "role", "seal").drop("turn", "seal")

    class Digest:
        """Applies an audit to turns as they come; what is inserted before a turn goes first."""

        def __init__(self, conv, head):
            self.conv, self.head, self.at, self.last, self.some, self.sha = conv, head, 0, "", False, hashlib.sha256()

        def put(self, role, text):
            self.sha.update((("\n" if self.some else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            self.some, self.last = True, role[:1]

        def inserts(self):
            audit = self.head[-1]
            while self.at < len(audit) and audit[self.at] == "I":
                self.put("assistant" if self.last == "u" else "user", "")
                self.at += 1

        def turn(self, role, text):
            self.inserts()
            op = self.head[-1][self.at]
            self.at += 1
            if op != "D":
                self.put(role if op == "K" else "assistant" if self.last == "u" else "user", text)

        def row(self):
            self.inserts()
            return (self.conv, *self.head, self.sha.hexdigest())

    def run(batches):
        now, done, columns = None, [], ["conv_id", *names, "repaired_sha256"]
        for pdf in batches:
            for null, conv, front, role, text, *head in zip(*[pdf[c] for c in ("no_conv", "conv", "front", "role", "text", *names)]):
                if front == 0:
                    if now is not None:
                        done.append(now.row())
                    now = Digest(None if null else int(conv), [*map(int, head[:-1]), head[-1]])
                else:
                    now.turn(role, text)
            if len(done) >= 1000:
                yield _frame(done, columns)
                done = []
        if now is not None:
            done.append(now.row())
        yield _frame(done, columns)

    return both.mapInPandas(run, f"{SUMMARY}, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns with planted faults, by the remainder of crc32(`conv_id:turn`) by 20: 0 gone, 1 text emptied, 2 without [.!?], 3 twice,
    4 role user. Nulls of any of the four columns count as one space there; conv_id and turn stay null in the result."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), text("role").alias("role"), text("text").alias("text"), kind.alias("_kind"))
    said: Column = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": said, "role": F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")), "gone": F.col("_kind") == 0})
    twice = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.withColumn("_copy", twice).drop("_copy", "_kind")


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(table(spark, sf_dir, "conversations")))


ORACLE = {}
