"""Chat formatting with a grammar round trip.

A turn is rendered as a start mark, its role, a line feed, its text, an end mark
and a line feed. No role and no text may hold a mark. Every rendered turn is
parsed again by that grammar; what does not come back as it went in is escaped and
the turn tried again, until source and parse are identical. The escape puts a
backslash into a control string, one more where there are some already, so
parsing takes one away and nothing is lost.

Turns are dealt by conversation, sorted, and streamed: memory does not grow with
the length of a conversation, and a text of any length is one turn.

Defined results: null role or text is empty. Turns without a number come first;
turns with equal numbers follow role and text. Rows with a null conv_id are one
conversation. Equal rows are turns of their own. An empty table gives an empty
result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
CONTROL = re.compile(r"<(\\*)\|(im_start|im_end)\|>")
ESCAPED = re.compile(r"<\\(\\*)\|(im_start|im_end)\|>")
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>", re.DOTALL)
LEARNED = "assistant"

DIGESTS = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
)


def escape_text(text: str) -> str:
    return CONTROL.sub(r"<\\\1|\2|>", text)


def unescape_text(text: str) -> str:
    return ESCAPED.sub(r"<\1|\2|>", text)


def escape_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n").replace("<", "\\l")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n", "l": "<"}.get(m[1], m[1]), role, flags=re.DOTALL)


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """Turns of a rendered text: role, text, and where the text stands; an error if anything else is in it."""
    turns, at = [], 0
    while at < len(rendered):
        m = TURN.match(rendered, at)
        if not m or rendered[m.end() : m.end() + 1] != "\n" or START in m[1] or END in m[1] or START in m[2]:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape_role(m[1]), unescape_text(m[2]), m.start(2), m.end(2)))
        at = m.end() + 1
    return turns


def _recovered(role: str, text: str) -> tuple[str | None, str | None]:
    """What a parse gives back for role and text, each rendered beside an empty other; None where there is no parse."""
    out = []
    for place, rendered in enumerate((f"{START}{role}\n{END}\n", f"{START}\n{text}{END}\n")):
        try:
            turns = parse(rendered)
            out.append(turns[0][place] if len(turns) == 1 else None)
        except ValueError:
            out.append(None)
    return out[0], out[1]


def render(role: str, text: str) -> str:
    """A turn as text that parses back to (role, text) and holds each mark once."""
    r, t = role, text
    while (got := _recovered(r, t)) != (role, text):
        before = r, t
        if got[0] != role:
            r = escape_role(role)
        if got[1] != text:
            t = escape_text(text)
        if (r, t) == before:  # the escapes leave no conflict, so this is not reached
            raise AssertionError("an escape was not undone")
    return f"{START}{r}\n{t}{END}\n"


def format_chat(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, rendered and start: the formatted text of a conversation is its rendered turns in order of start."""
    turns = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        conv, at = object(), 0
        for batch in batches:
            rendered, starts = [], []
            for key, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if key != conv:
                    conv, at = key, 0
                rendered.append(render(role, text))
                starts.append(at)
                at += len(rendered[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rendered, pa.string()), pa.array(starts, pa.int64())], ["conv_id", "turn", "rendered", "start"])

    return ordered.mapInArrow(run, "conv_id bigint, turn bigint, rendered string, start bigint")


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from what format_chat returned, in its order."""

    def run(batches):
        conv, state = None, None

        def row():
            n, turns, loss, loss_chars, chars = state
            return (conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(DIGESTS), DIGESTS, strict=True)], schema=DIGESTS)

        for batch in batches:
            rows = []
            for key, start, rendered in zip(*(batch.column(k).to_pylist() for k in (0, 3, 2)), strict=True):
                if start == 0:
                    if state:
                        rows.append(row())
                    conv, state = key, [0, hashlib.sha256(), hashlib.sha256(), 0, 0]
                for role, text, _, _ in parse(rendered):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    if role == LEARNED:
                        state[2].update(text.encode())
                        state[3] += len(text)
                state[4] += len(rendered)
            yield batch_of(rows)
        if state:
            yield batch_of([row()])

    return formatted.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
