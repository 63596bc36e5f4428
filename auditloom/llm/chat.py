"""Chat formatting with a grammar that is read back.

A conversation is the sequence of its turns, each ``### Role: text`` and a line ``</turn>``. Inside a text a control
string (a turn's start or end mark) that would be read as markup gets a backslash in front, and so does one that already
has backslashes, which makes the escape reversible; other texts are untouched. Every rendered turn is parsed again and
escaped until the parser gives back the source.

The loss mask is a list of (start, length) spans in code points of the formatted conversation, one for each assistant
text in its escaped form.

Defined cases: a null text is empty; a null role is the empty role; roles other than system, user and assistant are kept,
with unusual characters as %-escapes; turns are ordered by turn (nulls first), ties by role and text; rows without
conv_id form one conversation; a repeated row is a turn of its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = "</turn>"
CONTROL = r"(?:### [A-Za-z0-9_.%~-]*: |</turn>)"
MAYBE_ESCAPED = re.compile(rf"(\\*)({CONTROL})")
HEADER = re.compile(r"### ([A-Za-z0-9_.%~-]*): ")
#: How the usual roles are written in a header.
TITLES = {"system": "System", "user": "User", "assistant": "Assistant"}
ROLES = {title: role for role, title in TITLES.items()}


def title_of(role: str) -> str:
    """A header name that leads back to the role."""
    if role in TITLES:
        return TITLES[role]
    return f"%{ord(role[0]):02X}{role[1:]}" if role in ROLES else quote(role, safe="")


def role_of(title: str) -> str:
    return ROLES.get(title) or unquote(title)


def escape(text: str) -> str:
    return MAYBE_ESCAPED.sub(r"\\\1\2", text)


def unescape(text: str) -> str:
    return MAYBE_ESCAPED.sub(lambda m: m[1][1:] + m[2], text)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, length of the escaped text) of every turn; raises ValueError where the grammar is broken."""
    turns, at = [], 0
    while at < len(formatted):
        head = HEADER.match(formatted, at)
        if not head:
            raise ValueError(f"no turn starts at {at}")
        start = head.end()
        for mark in MAYBE_ESCAPED.finditer(formatted, start):
            if not mark[1]:
                break
        else:
            raise ValueError(f"the turn at {at} has no end")
        if mark[2] != END or formatted[mark.start() - 1 : mark.start()] != "\n" or mark.start() <= start - 1 or formatted[mark.end() : mark.end() + 1] != "\n":
            raise ValueError(f"markup inside the turn at {at}")
        stop = mark.start() - 1
        if stop < start:
            raise ValueError(f"the turn at {at} has no end line")
        turns.append((role_of(head[1]), unescape(formatted[start:stop]), start, stop - start))
        at = mark.end() + 1
    return turns


def render(role: str, text: str, most: int = 4) -> tuple[str, int, int]:
    """A formatted turn, and start and length of its text; escaped until parsing gives back role and text."""
    body = text
    for _ in range(most):
        head = f"### {title_of(role)}: "
        turn = f"{head}{body}\n{END}\n"
        try:
            read = parse(turn)
        except ValueError:
            read = []
        if [x[:2] for x in read] == [(role, text)]:
            return turn, len(head), len(body)
        body = escape(text)
    raise ValueError("a turn can't be read back")


def format_turns(conversations: DataFrame, trained: str = "assistant") -> DataFrame:
    """Per turn: ``conv_id``, ``turn``, ``role``, ``formatted``, and ``loss_start``, ``loss_length`` (null outside the mask).

    Turns are rendered one by one, so a conversation of any length is spread over tasks. ``formatted`` of all turns of a
    conversation, in the order of (turn, role, text), is the formatted conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, bodies = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            made = [render(r, t) for r, t in zip(roles, bodies, strict=True)]
            masked = [(m[1], m[2]) if r == trained else (None, None) for r, m in zip(roles, made, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:4],
                    pa.array([m[0] for m in made], pa.string()),
                    pa.array([m[0] for m in masked], pa.int64()),
                    pa.array([m[1] for m in masked], pa.int64()),
                ],
                ["conv_id", "turn", "role", "text", "formatted", "loss_start", "loss_length"],
            )

    plain = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    schema = "conv_id long, turn long, role string, text string, formatted string, loss_start long, loss_length long"
    return plain.mapInArrow(run, schema)


def read_back(turns: DataFrame) -> DataFrame:
    """Per conversation, parsed from ``formatted`` and the mask alone: turns, digests and sizes.

    ``turns_sha256`` digests role, line feed, text, line feed of each turn, ``loss_sha256`` the unescaped text under
    the mask; ``loss_chars`` and ``formatted_chars`` are code points. Turns stream through in order and only the
    digests are held, so a conversation of any length needs no memory.
    """
    fields = [
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []

        def close() -> None:
            if now:
                done.append((now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [()] * len(fields)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])

        for batch in batches:
            for conv, formatted, start, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now[0] != conv:
                    close()
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in parse(formatted):
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    target = unescape(formatted[start : start + length])
                    now[3] += len(target)
                    now[4].update(target.encode())
                now[5] += len(formatted)
            yield flush()
        close()
        yield flush()

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return ordered.select("conv_id", "formatted", "loss_start", "loss_length").mapInArrow(run, schema)
