"""Token counts of sections from one encoding of the whole document."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.tokens import open_vocabulary, vocabulary_path

RULES = ("first", "last", "share")
COUNTS = "doc_id long, doc_tokens long, section long, start_char long, end_char long, n_tokens double"


def attribute(starts: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section [low, high): interval join of token spans and sorted, touching sections.

    A token that crosses a boundary goes to the section of its first character ("first"), of its last ("last"), or in
    equal shares to all sections it touches ("share").
    """
    n = len(low)
    a = np.searchsorted(low, starts, "right") - 1
    b = np.searchsorted(low, np.maximum(ends - 1, starts), "right") - 1
    if rule == "first":
        return np.bincount(a, minlength=n).astype(float)
    if rule == "last":
        return np.bincount(b, minlength=n).astype(float)
    share = 1.0 / (b - a + 1)
    step = np.bincount(a, share, n + 1) - np.bincount(b + 1, share, n + 1)
    return np.round(np.cumsum(step)[:n], 9)


def section_bounds(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lines, each with its line feed; the last may be empty only if the text is."""
    cuts = [m.end() for m in re.finditer("\n", text)]
    if not cuts or cuts[-1] < len(text):
        cuts.append(len(text))
    high = np.array(cuts, np.int64)
    return np.concatenate([[0], high[:-1]]).astype(np.int64), high


def count_tokens(docs: DataFrame, fields: tuple[str, ...] = ("text",), rule: str = "first", vocabulary: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """Documents -> one row per section, with the tokens attributed to it.

    Whole documents are encoded once. With one field, its sections are its lines, the line feed included. With several
    fields, they are joined by a line feed and encoded as one text; section i is field i with the line feed after it.
    Token spans are in characters; a token inside a character of several bytes spans that character. The counts of a
    document sum to doc_tokens under every rule.

    Null fields are empty; an empty document has one empty section with no token. Repeated rows are counted each for
    itself, further columns are ignored. No shuffle; memory is bounded by a batch and one document.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = open_vocabulary(path)
        for rb in batches:
            docs_, totals, order, lows, highs, counts = [], [], [], [], [], []
            for row in zip(rb.column(0).to_pylist(), *(rb.column(i + 1) for i in range(len(fields)))):
                parts = [x.as_py() or "" for x in row[1:]]
                text = "\n".join(parts)
                if len(parts) == 1:
                    low, high = section_bounds(text)
                else:
                    high = np.cumsum([len(p) + 1 for p in parts])
                    low = high - [len(p) + 1 for p in parts]
                    high[-1] -= 1
                starts = words.token_starts(text)
                following = starts[np.searchsorted(starts, starts, "right").clip(max=max(len(starts) - 1, 0))] if len(starts) else starts
                ends = np.where(following > starts, following, len(text)) if len(starts) else starts
                got = attribute(starts, ends, low, high, rule)
                docs_ += [row[0]] * len(low)
                totals += [len(starts)] * len(low)
                order += range(len(low))
                lows.append(low)
                highs.append(high)
                counts.append(got)
            if docs_:
                yield pa.RecordBatch.from_arrays([pa.array(docs_, pa.int64()), pa.array(totals, pa.int64()), pa.array(order, pa.int64()), pa.array(np.concatenate(lows)), pa.array(np.concatenate(highs)), pa.array(np.concatenate(counts))], names=[x.split()[0] for x in COUNTS.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(f"_{i}") for i, c in enumerate(fields)]).mapInArrow(run, COUNTS)
