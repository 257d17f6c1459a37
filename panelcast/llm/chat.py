"""Chat formatting with a grammar round trip.

A turn is written as an opening mark, its text and a closing mark. The result is read again by a
deterministic parser; where what comes back is not the source, the text is escaped further until it is.

    turn  := open(role) text close(role)
    text  := any characters, in which a backslash before a backslash, "<" or "[" stands for that character

The forecasting project holds no dialogues, so the operators are general: any table with a conversation
key, an order, a role and a text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.llm.common import arrow_rows, free_names, limit_batches, small_batches

# The marks of each role; any other role is named inside its opening mark.
MARKS = {
    "system": ("<<SYS>>\n", "\n<</SYS>>\n"),
    "user": ("<s>[INST] ", " [/INST]"),
    "assistant": ("[OUT] ", "</s>"),
}
OTHER_OPEN, OTHER_TEXT, OTHER_CLOSE = "[ROLE] ", " [TEXT] ", " [/ROLE]"
CONTROLS = (
    "<<SYS>>", "<</SYS>>", "<s>", "</s>", "[INST]", "[/INST]", "[OUT]", "[ROLE]", "[TEXT]", "[/ROLE]",
)
TRAINED_ROLE = "assistant"
READ_TYPE = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\([\\<\[])")
_ENDS = {
    close: re.compile(r"\\[\\<\[]|" + re.escape(close))
    for close in (*(c for _, c in MARKS.values()), OTHER_TEXT, OTHER_CLOSE)
}


def _unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


#: From no escape to all: as it is; before control strings; before control strings and backslashes.
ESCAPES = (
    lambda text: text,
    lambda text: _CONTROL.sub(lambda m: "\\" + m.group(), text),
    lambda text: re.sub(r"[\\<\[]", lambda m: "\\" + m.group(), text),
)


class Incomplete(ValueError):
    """The text ends inside a turn."""


def parse_turn(text: str, at: int = 0) -> tuple[str, str, int, int, int]:
    """Role and text of the turn at ``at``, the span of its text as written, and where the next begins."""

    def upto(close: str, start: int) -> int:
        for found in _ENDS[close].finditer(text, start):
            if found.group() == close:
                return found.start()
        raise Incomplete(f"no {close!r} after {start}")

    for role, (opening, close) in MARKS.items():
        if text.startswith(opening, at):
            start = at + len(opening)
            end = upto(close, start)
            return role, _unescape(text[start:end]), start, end, end + len(close)
    if not text.startswith(OTHER_OPEN, at):
        if any(o.startswith(text[at:]) for o in (OTHER_OPEN, *(m[0] for m in MARKS.values()))):
            raise Incomplete("inside an opening mark")
        raise ValueError(f"no turn begins at {at}")
    name_end = upto(OTHER_TEXT, at + len(OTHER_OPEN))
    start = name_end + len(OTHER_TEXT)
    end = upto(OTHER_CLOSE, start)
    role = _unescape(text[at + len(OTHER_OPEN) : name_end])
    return role, _unescape(text[start:end]), start, end, end + len(OTHER_CLOSE)


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn as written, with as little escaping as the round trip allows, and the span of its text."""
    for escape in ESCAPES:
        if role in MARKS:
            opening, close = MARKS[role]
        else:
            opening, close = OTHER_OPEN + escape(role) + OTHER_TEXT, OTHER_CLOSE
        written = opening + escape(text) + close
        try:
            back, said, start, end, after = parse_turn(written)
        except ValueError:
            continue
        if (back, said, after) == (role, text, len(written)):
            return written, start, end
    raise ValueError(f"no escape makes a {role!r} turn readable")


class Parser:
    """Turns of a text that arrives in parts; keeps at most one unfinished turn."""

    def __init__(self):
        self.rest = ""

    def feed(self, part: str) -> Iterator[tuple[str, str]]:
        self.rest += part
        at = 0
        while at < len(self.rest):
            try:
                role, text, _, _, at = parse_turn(self.rest, at)
            except Incomplete:
                break
            yield role, text
        self.rest = self.rest[at:]


def format_turns(df: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """Add to every turn its ``segment`` as written and the span ``loss_start``, ``loss_end`` (code
    points inside the segment; null for roles that are not trained on).

    General: the forecasting project has no dialogues. A conversation's formatted text is its segments in turn order. Each segment is parsed again and
    compared with its source; as no turn's reading depends on what follows its closing mark, segments
    read alike alone and joined. Rows keep their partitions, so a conversation of any length is spread.
    Null roles and texts count as empty; a role without marks of its own is named; columns already
    named like the new ones are replaced; no rows give no rows.
    """
    kept = free_names(df, ["segment", "loss_start", "loss_end"], [role, text])
    schema = T.StructType([
        *kept.schema.fields, T.StructField("segment", T.StringType()),
        T.StructField("loss_start", T.LongType()), T.StructField("loss_end", T.LongType()),
    ])

    limit_batches(df.sparkSession)
    def write(batches):
        for batch in small_batches(batches, 4096):
            roles = [r or "" for r in batch.column(role).to_pylist()]
            texts = [t or "" for t in batch.column(text).to_pylist()]
            done = [render_turn(r, t) for r, t in zip(roles, texts, strict=True)]
            trained = [r == TRAINED_ROLE for r in roles]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array([d[0] for d in done], pa.string()),
                    pa.array([d[1] if t else None for d, t in zip(done, trained, strict=True)], pa.int64()),
                    pa.array([d[2] if t else None for d, t in zip(done, trained, strict=True)], pa.int64()),
                ],
                names=[f.name for f in schema.fields],
            )

    return kept.mapInArrow(write, schema)


def read_conversations(
    segments: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Parse every conversation's formatted text and return what it holds: (conversation, ``n_turns``,
    ``turns_sha256`` over role, newline, text, newline per turn, ``loss_chars``, ``loss_sha256`` over the
    texts under the loss mask: cut from the segments by it and unescaped, ``formatted_chars``).

    Segments follow each other by turn, nulls first; equal turns by role, then text. They stream through
    the parser in sorted partitions: a task holds one turn and two hash states, however long the
    conversation. Rows with a null conversation key form one conversation.
    """
    kind = {"string": "string", "int": "int"}.get(segments.schema[conversation].dataType.simpleString(), "long")
    ddl = f"conversation {kind}, {READ_TYPE}"
    at = lambda c: F.col(f"`{c}`")
    ordered = (
        segments.select(
            at(conversation).cast(kind).alias("conversation"), at(turn).alias("turn"), F.coalesce(at(role), F.lit("")).alias("role"),
            F.coalesce(at(text), F.lit("")).alias("text"), "segment", "loss_start", "loss_end",
        )
        .repartition("conversation")
        .sortWithinPartitions("conversation", "turn", "role", "text")
        .select("conversation", "segment", "loss_start", "loss_end")
    )

    def read(batches):
        now, out = None, []
        for batch in batches:
            for conv, *written in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                if now is None or now.key != conv:
                    if now is not None:
                        out.append(now.row())
                    now = _Conversation(conv)
                now.add(*written)
            if len(out) > 4096:
                yield arrow_rows(out, ddl)
                out = []
        if now is not None:
            out.append(now.row())
        if out:
            yield arrow_rows(out, ddl)

    return ordered.mapInArrow(read, ddl).withColumnRenamed("conversation", conversation)


class _Conversation:
    def __init__(self, key):
        self.key, self.parser = key, Parser()
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, segment: str, loss_start: int | None, loss_end: int | None) -> None:
        self.chars += len(segment)
        for role, text in self.parser.feed(segment):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        if loss_start is not None:
            said = _unescape(segment[loss_start:loss_end])
            self.loss_chars += len(said)
            self.loss.update(said.encode())

    def row(self) -> tuple:
        if self.parser.rest:
            raise ValueError(f"conversation {self.key!r} ends inside a turn")
        return (self.key, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)
