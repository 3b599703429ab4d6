"""Chat formatting that survives a round trip through its own grammar."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks that open a turn by role; any other role is written into [ROLE ...]. Each turn ends with END.
OPEN = {"user": "[INST]", "assistant": "[/INST]"}
END = "</s>"
#: Control strings, cut after their first character, where an escape puts one more backslash than stands there.
_CONTROL = re.compile(r"([<\[])(\\*)(/?INST\]|ROLE |/?s>)")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?INST\]|ROLE |/?s>)")
_BARE = re.compile(r"[<\[](?:/?INST\]|ROLE |/?s>)")
_TURN = re.compile(r"(?:(\[INST\])|(\[/INST\])|\[ROLE ((?:[^\]\\]|\\.)*)\])(.*?)</s>", re.S)
SEGMENTS = "conv_id long, ordinal long, segment string, loss_start long, loss_length long"


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of every turn; start and end bound the escaped text. ValueError if anything stands outside of turns, or a control string inside one."""
    out, at = [], 0
    while at < len(formatted):
        if not (m := _TURN.match(formatted, at)):
            raise ValueError(f"no turn at {at}")
        if _BARE.search(m[4]):
            raise ValueError(f"control string inside the turn at {at}")
        role = "user" if m[1] else "assistant" if m[2] else re.sub(r"\\(.)", r"\1", m[3], flags=re.S)
        out.append((role, unescape(m[4]), m.start(4), m.end(4)))
        at = m.end()
    return out


def render(role: str, text: str) -> str:
    """The turn as it stands if the parser gives it back; otherwise with conflicting content escaped."""
    mark = OPEN.get(role) or "[ROLE " + re.sub(r"([\]\\])", r"\\\1", role) + "]"
    for body in (text, escape(text)):
        out = mark + body + END
        try:
            if [t[:2] for t in parse(out)] == [(role, text)]:
                return out
        except ValueError:
            pass
    raise AssertionError(f"turn can't be written: {role!r} {text!r}")


def format_conversations(rows: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, turn, role, text -> one row per turn: conv_id, ordinal, segment, loss_start, loss_length.

    A conversation's formatted text is its segments in order; loss_start and loss_length give, in code points of that
    whole text, what the loss mask covers (length 0: nothing). Turns are rendered plainly, read back by the parser and
    escaped where the turn read differs from the source, so every segment is checked.

    Turns of equal number are ordered by role and text; null turns come first, null roles and texts are empty. Rows
    without conv_id form one conversation. Partitions hold whole conversations sorted by turn and are read as a
    stream: a very long conversation takes time in its task but never memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, at, ordinal = object(), 0, 0
        for rb in batches:
            out = []
            for c, role, text in zip(*(rb.column(i).to_pylist() for i in range(3))):
                if c != conv:
                    conv, at, ordinal = c, 0, 0
                seg = render(role, text)
                ((_, _, low, high),) = parse(seg)
                out.append((c, ordinal, seg, at + low, high - low if role in loss_roles else 0))
                at, ordinal = at + len(seg), ordinal + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=[x.split()[0] for x in SEGMENTS.split(", ")])

    ready = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("turn"))
    ready = ready.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ready.select("conv_id", "role", "text").mapInArrow(run, SEGMENTS)


def read_back(segments: DataFrame) -> DataFrame:
    """Digests of each conversation from its formatted text alone; segments must stand as format_conversations leaves them."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def ended() -> tuple:
            c, n, turns, chars, loss, total = state
            return c, n, turns.hexdigest(), chars, loss.hexdigest(), total

        for rb in batches:
            out = []
            for c, group in groupby(zip(*(rb.column(i).to_pylist() for i in range(5))), key=lambda r: r[0]):
                for _, ordinal, seg, start, length in group:
                    if state is None or c != state[0] or ordinal == 0:
                        if state is not None:
                            out.append(ended())
                        state = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    for role, text, _, _ in parse(seg):
                        state[1] += 1
                        state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    if length:
                        masked = unescape(seg[start - state[5] : start - state[5] + length])
                        state[3] += len(masked)
                        state[4].update(masked.encode("utf-8", "surrogatepass"))
                    state[5] += len(seg)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(ended(), kinds)], names=names)

    return segments.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
