r"""Chat formatting with a grammar round trip.

A conversation is the concatenation of its turns' pieces, and a piece is opener, content, closer:

    system     <<SYS>>content<</SYS>>
    user       [INST]content[/INST]
    assistant  <s>content</s>
    others     <|role|>role<|/role|>content<|end|>

These ten strings are the control strings. Contents hold none of them; a text that does is escaped by one
backslash behind the first character of each (``[INST]`` becomes ``[\INST]``, what looks escaped already gets one
more), and the parser takes one backslash away. A control string has no backslash, and no proper end of one
starts another, so the escape changes each occurrence by itself and is undone exactly.

Every turn is rendered as it stands, parsed again by ``Reader``, a deterministic parser that knows the grammar
only, and compared with its source; the parts (role, text) that come back otherwise, or that break the grammar, are
escaped, until the turn comes back identical. As openers and closers delimit a piece and the parser is at the
start of a turn after each, a conversation parses as its pieces do; ``read_back`` parses each conversation whole and
compares it again.

Scale: ``format_turns`` is one pass without a shuffle; a piece never leaves its row, so a conversation of any
length is formatted by all tasks. ``read_back`` needs the pieces of a conversation in order: they are shuffled
once by conversation and sorted, and each conversation is read as a stream that holds one batch and one turn. A
SHA-256 of a whole conversation has to read it from its first byte to its last, so that last step of the query is
one task a conversation, with bounded memory; nothing else is.

Defined results: a null text is the empty text and a null role the empty role; turns go by ``turn``, nulls first, and
equal turns by their formatted piece, so repeated rows are turns of their own; a null conversation id is a
conversation; an empty table gives an empty result. Columns that are not named are kept by ``format_turns``
and not read by ``read_back``; the new columns of ``format_turns`` take free names (``turn_columns``).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe import runtime

#: Role -> opener and closer.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
ROLE, ROLE_END, END = "<|role|>", "<|/role|>", "<|end|>"
LEARNED = "assistant"
CONTROLS = (*(m for pair in MARKS.values() for m in pair), ROLE, ROLE_END, END)
OPENERS = {opener: role for role, (opener, _) in MARKS.items()}

_LONGEST = max(map(len, CONTROLS))
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))))
#: A control string with any number of backslashes behind its first character, as text for Python and for SQL.
LOOKALIKE = "|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in CONTROLS)
_LOOKALIKE = re.compile(LOOKALIKE)


def escape(text: str) -> str:
    return _LOOKALIKE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _LOOKALIKE.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


class GrammarError(ValueError):
    """Text that no sequence of turns renders to."""


class Reader:
    """The parser: fed with a conversation in any portions, gives the turns (role, text) that are complete."""

    def __init__(self) -> None:
        self.text, self.role = "", ""
        #: What ends the open part ("" between turns), and from where on it is still to be looked for.
        self.closer, self.seen = "", 0

    def feed(self, portion: str) -> Iterator[tuple[str, str]]:
        self.text += portion
        at = 0
        while True:
            m = (_CONTROL.search if self.closer else _CONTROL.match)(self.text, max(at, self.seen))
            if m is None:
                break
            if self.closer and m[0] != self.closer:
                raise GrammarError(f"{m[0]} where {self.closer} was to come")
            said = unescape(self.text[at : m.start()])
            at, self.seen = m.end(), 0
            if self.closer == ROLE_END:
                self.role, self.closer = said, END
            elif self.closer:
                self.closer = ""
                yield self.role, said
            elif m[0] == ROLE:
                self.closer = ROLE_END
            elif m[0] in OPENERS:
                self.role = OPENERS[m[0]]
                self.closer = MARKS[self.role][1]
            else:
                raise GrammarError(f"{m[0]} where a turn begins")
        self.text = self.text[at:]
        self.seen = max(0, len(self.text) - _LONGEST) if self.closer else 0
        if self.text and not self.closer and not any(c.startswith(self.text) for c in CONTROLS):
            raise GrammarError("a turn has to begin with an opener")

    def close(self) -> None:
        if self.text or self.closer:
            raise GrammarError("the last turn isn't closed")


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    reader = Reader()
    turns = list(reader.feed(text))
    reader.close()
    return turns


def _parts(role: str, text: str, escaped: set[str]) -> tuple[str, str, str]:
    body = escape(text) if "text" in escaped else text
    if role in MARKS:
        return MARKS[role][0], body, MARKS[role][1]
    return ROLE + (escape(role) if "role" in escaped else role) + ROLE_END, body, END


def render(role: str, text: str) -> tuple[str, int, int, int]:
    """A turn's piece, where its content begins, the content's length, and how many parts had to be escaped."""
    escaped: set[str] = set()
    while True:
        opener, body, closer = _parts(role, text, escaped)
        piece = opener + body + closer
        try:
            found = parse(piece)
        except GrammarError:
            found = []
        if found == [(role, text)]:
            return piece, len(opener), len(body), len(escaped)
        wrong = {name for name, part in (("role", role), ("text", text)) if _LOOKALIKE.search(part)} - escaped
        if not wrong:
            raise GrammarError(f"{role!r}: no rendering comes back identical")
        if len(found) == 1:
            wrong = {name for name, a, b in (("role", role, found[0][0]), ("text", text, found[0][1])) if a != b} & wrong or wrong
        escaped |= wrong


PIECE = ("piece", "loss_start", "loss_length", "n_escaped", "source_digest")


def turn_columns(df: DataFrame) -> list[str]:
    """The names that ``format_turns`` gives its columns over ``df``: the formatted text, the span of code points in it
    that a model learns from (null for other roles), the number of escaped parts, and the digest of the source."""
    return [runtime.free_name(df, name) for name in PIECE]


def _source_digest(role: str, text: str) -> bytes:
    return hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()


def format_turns(df: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """``df`` with the columns of ``turn_columns``."""
    names = turn_columns(df)
    types = (T.StringType(), T.LongType(), T.LongType(), T.IntegerType(), T.BinaryType())
    schema = T.StructType([*df.schema.fields, *map(T.StructField, names, types)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns: list[list] = [[] for _ in names]
            for r, t in zip(b.column(b.schema.get_field_index(role)).to_pylist(), b.column(b.schema.get_field_index(text)).to_pylist(), strict=True):
                r, t = r or "", t or ""
                piece, start, length, n = render(r, t)
                learned = r == LEARNED
                for column, value in zip(columns, (piece, start if learned else None, length if learned else None, n, _source_digest(r, t)), strict=True):
                    column.append(value)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], [*b.schema.names, *names])

    return df.mapInArrow(run, schema)


class _Conversation:
    """What is read back from the pieces of one conversation, fed in order."""

    def __init__(self) -> None:
        self.reader, self.turns, self.learned = Reader(), hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.escaped = 0

    def feed(self, piece: str, start: int | None, length: int | None, n_escaped: int, source: bytes) -> None:
        found = list(self.reader.feed(piece))
        if [_source_digest(*turn) for turn in found] != [source]:
            raise GrammarError("a turn isn't read back as it was")
        for role, text in found:
            self.turns.update(f"{role}\n{text}\n".encode())
        if start is not None:
            learned = unescape(piece[start : start + length])
            self.learned.update(learned.encode())
            self.loss_chars += len(learned)
        self.n_turns += len(found)
        self.chars += len(piece)
        self.escaped += n_escaped

    def row(self) -> tuple:
        self.reader.close()
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.learned.hexdigest(), self.chars, self.escaped


READ = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_escaped long"


def read_back(formatted: DataFrame, names: list[str], key: str = "conv_id", turn: str = "turn") -> DataFrame:
    """key and ``READ``: one row a conversation, from the pieces that ``format_turns`` made under ``names``."""
    rows = formatted.select(F.col(f"`{key}`").alias("key"), F.col(f"`{turn}`").alias("turn"), *[F.col(f"`{n}`").alias(p) for n, p in zip(names, PIECE, strict=True)])
    rows = rows.repartition("key").sortWithinPartitions("key", "turn", "piece").drop("turn")
    schema = T.StructType([rows.schema["key"], *T.StructType.fromDDL(READ).fields])
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, one, kind = None, None, None

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate([kind, *kinds])], schema.names)

        for b in batches:
            kind, done = b.schema.field("key").type, []
            for k, *piece in zip(*[b.column(n).to_pylist() for n in ("key", *PIECE)], strict=True):
                if one is None or k != open_key:
                    if one is not None:
                        done.append((open_key, *one.row()))
                    open_key, one = k, _Conversation()
                one.feed(*piece)
            if done:
                yield made(done)
        if one is not None:
            yield made([(open_key, *one.row())])

    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
