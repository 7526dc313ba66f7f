"""Chat formatting by a grammar that is parsed back.

A turn is rendered as ``### Role: text</turn>`` and a line end. The rendered turn
is parsed again by a deterministic parser; where the parser gives back other
turns than the source, what conflicts is escaped, and the turn is rendered and
parsed anew until both are identical.

Grammar: a backslash run right before a control string (``###`` or ``</turn>``)
is read in pairs; an odd one out makes the control string text. In a role, the
same holds for ``:`` and the line end. Backslashes elsewhere mean themselves.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: the template ------------------------------------------------
OPEN, CLOSE, SEPARATOR, END = "### ", "</turn>", ": ", "\n"
# -------------------------------------------------------------------------------

_TEXT = re.compile(r"(\\*)(###|</turn>)")
_ROLE = re.compile(r"(\\*)(###|</turn>|:|\n)")
_TRAIL = re.compile(r"\\+\Z")


class GrammarError(ValueError):
    """Rendered text that the grammar doesn't know."""


def escaped(text: str, control: re.Pattern) -> str:
    """``text`` with its control strings, and what might be read as their escape, escaped.

    A backslash run at the very end stands before the control string that
    follows, so it is doubled as well.
    """
    text = control.sub(lambda m: m[1] * 2 + "\\" + m[2], text)
    return _TRAIL.sub(lambda m: m[0] * 2, text)


def _until(rendered: str, at: int, control: re.Pattern, stop: str) -> tuple[str, int]:
    """Unescaped text from ``at`` to the next bare ``stop``, and where that begins."""
    parts = []
    for m in control.finditer(rendered, at):
        parts += [rendered[at : m.start()], m[1][: len(m[1]) // 2]]
        if len(m[1]) % 2:
            parts.append(m[2])
        elif m[2] == stop:
            return "".join(parts), m.start(2)
        else:
            raise GrammarError(f"bare {m[2]!r} at {m.start(2)}")
        at = m.end()
    raise GrammarError(f"no {stop!r}")


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """Turns of a rendered conversation: role, text, and where its text stands in ``rendered``."""
    turns, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(OPEN, at):
            raise GrammarError(f"no turn at {at}")
        role, colon = _until(rendered, at + len(OPEN), _ROLE, SEPARATOR[0])
        start = colon + len(SEPARATOR)
        if rendered[colon:start] != SEPARATOR:
            raise GrammarError(f"no text at {colon}")
        text, end = _until(rendered, start, _TEXT, CLOSE)
        if not rendered.startswith(END, end + len(CLOSE)):
            raise GrammarError(f"no line end at {end}")
        turns.append((role, text, start, end))
        at = end + len(CLOSE) + len(END)
    return turns


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn that parses back to itself, and where its text stands in it.

    The plain form is tried first; a text or role that conflicts is escaped.
    """
    for role_form, text_form in (
        (role, text), (role, escaped(text, _TEXT)), (escaped(role, _ROLE), text), (escaped(role, _ROLE), escaped(text, _TEXT)),
    ):
        rendered = f"{OPEN}{role_form}{SEPARATOR}{text_form}{CLOSE}{END}"
        try:
            turns = parse(rendered)
        except GrammarError:
            continue
        if [t[:2] for t in turns] == [(role, text)]:
            return rendered, turns[0][2], turns[0][3]
    raise GrammarError("a turn can't be told apart from its template")


def format_turns(
    turns: DataFrame,
    learned_role: str = "assistant",
    conversation_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Rendered turns: ``conversation, turn, rendered, loss_start, loss_end``.

    One row out for each row in; a conversation's formatted text is its rendered
    turns one after the other, by turn, then rendered text. Null roles and texts
    are empty. ``loss_start`` and ``loss_end`` are the code points of ``rendered``
    under the loss mask, null where the role isn't ``learned_role``. Turns are
    rendered apart, without a shuffle: every turn parses by itself, so their
    sequence does. Other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = ([x or "" for x in batch.column(k).to_pylist()] for k in (2, 3))
            found = [render(r, t) for r, t in zip(roles, texts, strict=True)]
            on = [r == learned_role for r in roles]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array([x[0] for x in found], type=pa.string()),
                    pa.array([x[1] if b else None for x, b in zip(found, on, strict=True)], type=pa.int32()),
                    pa.array([x[2] if b else None for x, b in zip(found, on, strict=True)], type=pa.int32()),
                ],
                names=["conversation", "turn", "rendered", "loss_start", "loss_end"],
            )

    rows = turns.select(
        F.col(conversation_col).alias("conversation"), F.col(turn_col).alias("turn"),
        F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"),
    )
    kinds = [rows.schema[c].dataType.simpleString() for c in ("conversation", "turn")]
    return rows.mapInArrow(
        run, f"conversation {kinds[0]}, turn {kinds[1]}, rendered string, loss_start int, loss_end int"
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted text of each conversation holds, read by the parser.

    ``conversation, n_turns, turns_sha256`` (role, line end, text, line end per
    turn), ``loss_chars, loss_sha256`` (the unescaped text under the loss mask),
    ``formatted_chars``. A conversation's digests are sequential, so one task
    reads it; it reads turn by turn from sorted rows and holds one batch, however
    long the conversation is. Rows without a conversation form one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, kind = None, pa.int64()

        def row() -> list:
            name, n, turns, chars, loss, total = state
            return [name, n, turns.hexdigest(), chars, loss.hexdigest(), total]

        def packed(rows: list[list]) -> pa.RecordBatch:
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conversation", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names
            )

        for batch in batches:
            kind, done = batch.column(0).type, []
            for name, rendered, mask in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if state is None or state[0] != name:
                    if state is not None:
                        done.append(row())
                    state = [name, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, start, _ in parse(rendered):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                    if mask is not None and mask == start:
                        state[3] += len(text)
                        state[4].update(text.encode())
                state[5] += len(rendered)
            if done:
                yield packed(done)
        if state is not None:
            yield packed([row()])

    kind = formatted.schema["conversation"].dataType.simpleString()
    return (
        formatted.select("conversation", "turn", "rendered", "loss_start")
        .repartition("conversation")
        .sortWithinPartitions("conversation", "turn", "rendered")
        .mapInArrow(
            run,
            f"conversation {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
        )
    )
