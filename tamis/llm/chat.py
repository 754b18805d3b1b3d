"""Chat formatting by black-box rendering of successive turn prefixes, with spans found by comparing the outputs."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: A template is any function from [(role, text), ...] to a string; the renderer knows nothing about it.
Template = Callable[[list[tuple[str, str]]], str]
#: Turns rendered together by a local template: prefixes of such a stretch are rendered one after another, so a long
#: conversation costs a bounded multiple of its length.
STRETCH = 32
_CONTROL = re.compile(r"[\\#<]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"### (?P<role>(?:[^\\:#<\n]|\\.)*): (?P<text>(?:[^\\#<]|\\.)*) </turn>\n", re.DOTALL)


def escape(text: str) -> str:
    """A backslash before each character that a control string could begin with, and before backslashes themselves."""
    return _CONTROL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def write_role(role: str) -> str:
    """Plain lower-case roles are shown capitalised; what is not one is escaped so that it reads back as it was."""
    if re.fullmatch("[a-z]+", role):
        return role.capitalize()
    shown = re.sub(r"[\\#<:\n]", r"\\\g<0>", role)
    return "\\" + shown if re.fullmatch("[A-Z][a-z]*", shown) else shown


def read_role(shown: str) -> str:
    return shown.lower() if re.fullmatch("[A-Z][a-z]*", shown) else unescape(shown)


def plain_template(turns: list[tuple[str, str]]) -> str:
    """The default: `### Role: text </turn>` and a newline for each turn, texts escaped."""
    return "".join(f"### {write_role(role)}: {escape(text)} </turn>\n" for role, text in turns)


class Spans:
    """Spans of turns in a black-box template's output."""

    def __init__(self, template: Template) -> None:
        self.template, self.rewrites, self.at, self.output = template, 0, 0, ""

    def locate(self, turns: list[tuple[str, str]], done: int = 0) -> Iterator[str]:
        """The piece of output that each turn after the first `done` adds. When the output for a longer prefix does not
        start with the output for the shorter one, the template rewrites history: that is counted, and the piece is
        what differs after the common beginning. at and output: where the piece begins, and in which output."""
        before = self.template(turns[:done])
        for k in range(done + 1, len(turns) + 1):
            now = self.template(turns[:k])
            if now.startswith(before):
                self.at = len(before)
            else:
                self.rewrites += 1
                self.at = next((i for i, (a, b) in enumerate(zip(before, now)) if a != b), min(len(before), len(now)))
            before = self.output = now
            yield now[self.at :]


def rewrites_history(template: Template) -> bool:
    """Whether a longer prefix changes what was rendered before, on probes that hold each role first, last and repeated."""
    probe = [("system", "a"), ("user", "b"), ("assistant", "c"), ("user", "d"), ("assistant", "e"), ("assistant", "f"), ("user", "g")]
    for cut in range(len(probe)):
        spans = Spans(template)
        list(spans.locate(probe[cut:] + probe[:cut]))
        if spans.rewrites:
            return True
    return False


def read_turn(piece: str) -> tuple[str, str, int, int]:
    """(role, text, start, end) read back from a piece of the default template; start and end bound the escaped text."""
    m = _TURN.fullmatch(piece)
    if not m:
        raise ValueError("not a rendered turn")
    return read_role(m["role"]), unescape(m["text"]), m.start("text"), m.end("text")


def formatted(turns: DataFrame, template: Template = plain_template, trained: str = "assistant", with_text: bool = False, local: bool | None = None) -> DataFrame:
    """One row for each conversation, read back from the rendered output: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars, rewrites (steps at which the template changed what it had rendered before, or added what cannot be read back); with_text: also formatted and the loss spans
    (start, end of the escaped text in it).

    Turns go by turn number (null first; equal ones by role and text; repeated rows are turns of their own). Null texts
    and roles count as empty. local: each turn's output depends on that turn and the one before only, as declared by the
    caller (by default true for plain_template alone). With a local template conversations are streamed in order, a stretch
    of turns at a time with the turn before it as context, so no conversation is held whole (with_text holds its output).
    Any other is rendered on all full prefixes, which holds a conversation and costs the square of its length; formatted
    is then the output for all turns. Pieces that read_turn() cannot read are counted in rewrites and left out of the
    digests and spans; spans that a rewrite reaches are dropped. An empty table gives no rows.
    """
    local = template is plain_template if local is None else local
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"]
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, rewrites bigint"
    if with_text:
        schema += ", formatted string, loss_spans array<array<bigint>>"
        names += ["formatted", "loss_spans"]

    class Conversation:
        def __init__(self, conv_id):
            self.conv_id, self.last, self.waiting, self.spans = conv_id, [], [], Spans(template)
            self.turns, self.loss, self.n, self.loss_chars, self.chars, self.text, self.where = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, [], []

        def add(self, role, text):
            self.waiting.append((role, text))
            if local and len(self.waiting) == STRETCH:
                self.render()

        def render(self):
            rewrites = self.spans.rewrites
            for piece in self.spans.locate(self.last + self.waiting, len(self.last)):
                rewritten = self.spans.rewrites > rewrites
                if not local:
                    self.chars, self.text = self.spans.at, []
                    if rewritten:
                        self.where = [w for w in self.where if w[1] <= self.chars]
                self.n += 1
                try:
                    role, text, start, end = read_turn(piece)
                except ValueError:
                    self.spans.rewrites += not rewritten
                else:
                    self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    if role == trained:
                        self.loss.update(text.encode("utf-8", "surrogatepass"))
                        self.loss_chars += len(text)
                        self.where.append([self.chars + start, self.chars + end])
                self.chars += len(piece)
                if with_text:
                    self.text.append(piece if local else self.spans.output)
                rewrites = self.spans.rewrites
            self.last, self.waiting = self.waiting[-1:] or self.last, []
            if not with_text:
                self.where = []

        def row(self):
            self.render()
            return (self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.spans.rewrites) + (("".join(self.text), self.where) if with_text else ())

    def frame(rows):
        out = pd.DataFrame(rows, columns=names)
        out["conv_id"] = out["conv_id"].astype("Int64")
        return out

    def run(batches):
        now, rows = None, []
        for pdf in batches:
            for conv, null, role, text in zip(pdf["conv_id"], pdf["conv_id"].isna(), pdf["role"], pdf["text"]):
                conv = None if null else int(conv)
                if now is None or conv != now.conv_id:
                    if now is not None:
                        rows.append(now.row())
                    now = Conversation(conv)
                now.add(role, text)
            if len(rows) >= 1000:
                yield frame(rows)
                rows = []
        if now is not None:
            rows.append(now.row())
        yield frame(rows)

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    ordered = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), empty("role"), empty("text"))
    ordered = ordered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInPandas(run, schema)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, whose texts hold control strings."""
    own = spark.createDataFrame([(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return formatted(turns.unionByName(own))


ORACLE = {}
