"""Operator 4, chat formatting.

A declarative template (``ChatTemplate``) names, for every role, the marks
around a turn and whether its text bears loss.  A finite-state machine over
roles checks the turn order.  The formatter emits a conversation as a series
of segments, each with a loss flag; the formatted text is their
concatenation.  ``read_back`` parses that text again.

Texts may hold the template's own control strings.  Every control string and
every escape character in a text (or in an unknown role's name) gets the
escape character in front, so marks stay unique and the text comes back
unchanged.

Work is dealt out by conversation and sorted by turn inside each partition.
A task keeps the state of one conversation and one turn, never a whole
conversation, so a conversation of any length streams through.

Defined results
* null text or role: the empty string; null conv_id: one conversation of its own
* null turn: before all others; equal turns: ordered by role, then text
* repeated rows: each is a turn
* unknown role: the ``other`` marks with its name, no loss, not valid for the FSM
* empty table: no rows; other columns are ignored
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, read_table


@dataclass(frozen=True)
class Marks:
    prefix: str
    suffix: str
    loss: bool = False


@dataclass(frozen=True)
class ChatTemplate:
    """Marks by role, marks for other roles ({role} is the escaped name), the control strings to escape, and the FSM.

    ``moves[state][role]`` is the next state; a missing move makes the
    conversation invalid from there on.  It starts in ``start`` and is
    complete in one of ``final``.
    """

    roles: dict[str, Marks]
    other: Marks
    name_end: str
    controls: tuple[str, ...]
    moves: dict[str, dict[str, str]]
    start: str = "start"
    final: tuple[str, ...] = ("answered",)
    escape: str = "\\"
    _cache: dict = field(default_factory=dict, compare=False, repr=False)

    def _regex(self, kind: str = "control") -> re.Pattern:
        """``control``: a control string or the escape character; ``scan``: one of them, escaped or not."""
        if not self._cache:
            longest = sorted((*self.controls, self.escape), key=len, reverse=True)
            any_of = "|".join(map(re.escape, longest))
            self._cache["control"] = re.compile(any_of)
            self._cache["scan"] = re.compile(f"{re.escape(self.escape)}(?:{any_of})|{any_of}")
        return self._cache[kind]

    def escaped(self, text: str) -> str:
        return self._regex().sub(lambda m: self.escape + m[0], text)

    def unescaped(self, text: str) -> str:
        r = self._regex()
        out, at = [], 0
        while (i := text.find(self.escape, at)) >= 0:
            m = r.match(text, i + 1)
            out += text[at:i], m[0]
            at = m.end()
        out.append(text[at:])
        return "".join(out)

    def find_mark(self, text: str, mark: str, at: int = 0) -> int:
        """Place of the first unescaped ``mark`` (white space and one control string), or -1."""
        core = mark.strip()
        lead = len(mark) - len(mark.lstrip())
        for m in self._regex("scan").finditer(text, at):
            if m[0] == core:
                return m.start() - lead
        return -1

    def segments(self, role: str, text: str) -> list[tuple[str, str, bool]]:
        """(kind, piece, loss) of one turn."""
        known = self.roles.get(role)
        marks = known or self.other
        prefix = marks.prefix if known else marks.prefix.replace("{role}", self.escaped(role))
        return [("mark", prefix, False), ("text", self.escaped(text), marks.loss), ("mark", marks.suffix, False)]

    def read_turn(self, text: str, at: int) -> tuple[str, str, int] | None:
        """(role, turn's text, next place) of the turn that starts at ``at``; None if it isn't whole yet."""
        for role, marks in self.roles.items():
            if text.startswith(marks.prefix, at):
                begin = at + len(marks.prefix)
                break
        else:
            marks = self.other
            lead = marks.prefix.split("{role}")[0]
            if not text.startswith(lead, at):
                return None
            end = self.find_mark(text, self.name_end, at + len(lead))
            if end < 0:
                return None
            role, begin = self.unescaped(text[at + len(lead):end]), end + len(self.name_end)
        end = self.find_mark(text, marks.suffix, begin)
        if end < 0 or len(text) < end + len(marks.suffix):
            return None
        return role, self.unescaped(text[begin:end]), end + len(marks.suffix)


#: Instruction format with [INST] marks; the assistant's texts bear the loss.
INST = ChatTemplate(
    roles={
        "system": Marks("<<SYS>>\n", "\n<</SYS>>\n"),
        "user": Marks("[INST] ", " [/INST]\n"),
        "assistant": Marks("<s> ", " </s>\n", loss=True),
    },
    other=Marks("[ROLE]{role}[/ROLE] ", " [/TURN]\n"),
    name_end="[/ROLE] ",
    controls=("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[/TURN]"),
    moves={
        "start": {"system": "asked_to", "user": "waiting"},
        "asked_to": {"user": "waiting"},
        "waiting": {"assistant": "answered"},
        "answered": {"user": "waiting"},
    },
)

SEGMENTS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("turn_no", T.LongType()),
        T.StructField("seg_no", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("piece", T.StringType()),
        T.StructField("loss", T.BooleanType()),
        T.StructField("state", T.StringType()),
    ]
)


def format_chats(conversations: DataFrame, template: ChatTemplate = INST) -> DataFrame:
    """Segments of every conversation, in order within each partition.

    ``state`` is the FSM's state after the turn ("invalid" once a move is
    missing).  All segments of a conversation are in one partition, in the
    order of (turn_no, seg_no), so a later per-partition reader needs no
    further shuffle.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = arrow_schema(SEGMENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, turn_no, seg_no = object(), "", 0, 0
        for batch in batches:
            out = []
            for c, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if c != conv:
                    conv, state, turn_no, seg_no = c, template.start, 0, 0
                state = template.moves.get(state, {}).get(role, "invalid")
                for kind, piece, loss in template.segments(role, text):
                    out.append((c, turn_no, seg_no, kind, piece, loss, state))
                    seg_no += 1
                turn_no += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, SEGMENTS)


DIGESTS = T.StructType(
    [
        T.StructField("conv_id", T.LongType()),
        T.StructField("n_turns", T.LongType()),
        T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()),
        T.StructField("formatted_chars", T.LongType()),
        T.StructField("valid", T.BooleanType()),
    ]
)


class _Reader:
    """Digests of one conversation, read from its formatted text piece by piece."""

    def __init__(self, template: ChatTemplate) -> None:
        self.t, self.rest, self.n, self.chars, self.loss_chars, self.state = template, "", 0, 0, 0, ""
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, piece: str, loss: bool, state: str) -> None:
        self.chars += len(piece)
        self.rest += piece
        self.state = state
        if loss:
            plain = self.t.unescaped(piece)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode("utf-8", "surrogatepass"))

    def drain(self) -> None:
        """Read the whole turns that have come so far."""
        at = 0
        while at < len(self.rest) and (got := self.t.read_turn(self.rest, at)):
            role, text, at = got
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            self.n += 1
        self.rest = self.rest[at:]

    def row(self, conv) -> tuple:
        self.drain()
        if self.rest:
            raise ValueError(f"conversation {conv}: the formatted text doesn't parse at {self.rest[:80]!r}")
        return conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.state in self.t.final


def read_back(segments: DataFrame, template: ChatTemplate = INST) -> DataFrame:
    """One row of digests per conversation, from the segments of ``format_chats`` as they lie (no shuffle).

    Turns come from parsing the concatenated pieces, the loss digest from the
    pieces under the loss mask.  ``valid``: the FSM ended in a final state.
    """
    schema = arrow_schema(DIGESTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, reader = None, None

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            done = []
            cols = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            for c, kind, piece, loss, state, seg in zip(*(cols[n] for n in ("conv_id", "kind", "piece", "loss", "state", "seg_no")), strict=True):
                if reader is None or c != conv or seg == 0:
                    if reader is not None:
                        done.append(reader.row(conv))
                    conv, reader = c, _Reader(template)
                reader.feed(piece, loss, state)
                if len(reader.rest) > 1 << 16 and kind == "mark":
                    reader.drain()
            if done:
                yield table(done)
        if reader is not None:
            yield table([reader.row(conv)])

    return segments.mapInArrow(run, DIGESTS)


#: A conversation whose texts hold the template's own control strings.
PROBE_ID, PROBE_TEXT = -7, "</s>[INST] ok [/INST]"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and of the probe -7, read back from the formatted text."""
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE_TEXT).alias("text"),
    )
    return read_back(format_chats(rows.unionByName(probe)))


OP4_SQL = """
WITH marks(role, around, loss) AS (VALUES ('system', 18, false), ('user', 16, false), ('assistant', 10, true)),
turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (CAST(-7 AS BIGINT), CAST(0 AS BIGINT), 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
t AS (
  SELECT turns.*, m.loss,
    length(regexp_replace(text, '(</?s>|\\[/?INST\\]|<</?SYS>>|\\[/?ROLE\\]|\\[/TURN\\]|\\\\)', '\\\\\\1', 'g'))
      + CASE WHEN m.role IS NOT NULL THEN m.around
             ELSE 23 + length(regexp_replace(turns.role, '(</?s>|\\[/?INST\\]|<</?SYS>>|\\[/?ROLE\\]|\\[/TURN\\]|\\\\)', '\\\\\\1', 'g')) END AS chars,
    CASE turns.role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END AS step
  FROM turns LEFT JOIN marks m ON m.role = turns.role)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE loss), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE loss), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  regexp_full_match(string_agg(step, '' ORDER BY turn, role, text), 's?(ua)+') AS valid
FROM t GROUP BY conv_id
"""
