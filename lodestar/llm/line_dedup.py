"""Removal of passages that repeat across documents, by overlapping windows of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import let, own_exchange

#: Placed behind every line end before splitting; texts that hold it are split by a look-behind instead.
_MARK = "\ue000"
#: A line ends at a line feed, or at one of these and a blank.
ENDS = ".!?,;:"
#: Seed of the second of the two 64-bit hashes of a window.
_SECOND = 77


def lines_of(text: Column) -> Column:
    """Array of the text's lines, their ends included. Their concatenation is the text."""
    marked = text
    for end in ("\n", *(f"{x} " for x in ENDS)):
        marked = F.replace(marked, F.lit(end), F.lit(end + _MARK))
    cut = F.when(F.contains(text, F.lit(_MARK)), F.split(text, rf"(?<=\n|[{ENDS}] )", -1)).otherwise(F.split(marked, _MARK, -1))
    return F.filter(cut, lambda x: x != "")


def window_hashes(lines: Column, size: int) -> Column:
    """Two hashes (h, g) of the trimmed lines i..i+size-1 for every i; fewer lines: one window of all; none: no window."""
    hashed = F.transform(lines, lambda x: F.xxhash64(F.trim(F.replace(x, F.lit("\n"), F.lit(" ")))))
    pair = lambda *x: F.struct(F.xxhash64(*x).alias("h"), F.xxhash64(F.lit(_SECOND), *x).alias("g"))

    def windows(h: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: pair(*[F.get(h, i + k) for k in range(size)]))
        return F.when(F.size(h) == 0, F.array().cast("array<struct<h:bigint,g:bigint>>")).when(F.size(h) < size, F.array(pair(h))).otherwise(each)

    return let(hashed, windows)


def _repeats(windows: Column, later: Column) -> Column:
    """Places of the windows that are in `later` or repeat an earlier window of the same text: once all are sorted, those behind an equal one."""
    known = F.transform(later, lambda x: F.struct(x["h"].alias("h"), x["g"].alias("g"), F.lit(-1).alias("i")))
    marked = F.array_sort(F.concat(known, F.transform(windows, lambda x, i: F.struct(x["h"].alias("h"), x["g"].alias("g"), i.alias("i")))))
    behind = lambda s: F.filter(s, lambda x, j: (j > 0) & (x["i"] >= 0) & (F.get(s, j - 1)["h"] == x["h"]) & (F.get(s, j - 1)["g"] == x["g"]))
    return F.transform(let(marked, behind), lambda x: x["i"])


def _kept(n: Column, places: Column, size: int) -> Column:
    """Of n lines, the places of those that no window at `places` covers, in order; by sorting, too."""
    gone = F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(p, F.least(p + (size - 1), n - 1)))))
    both = F.array_sort(F.concat(F.transform(gone, lambda i: F.struct(i.alias("i"), F.lit(0).alias("k"))), F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("i"), F.lit(1).alias("k")))))
    free = lambda s: F.filter(s, lambda x, j: (x["k"] == 1) & ((j == 0) | (F.get(s, j - 1)["i"] != x["i"])))
    return F.transform(let(both, free), lambda x: x["i"])


def line_dedup(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every later occurrence of `size` consecutive lines; the first, in order of id and position, stays.

    A line ends at a line feed or behind a mark of ENDS and a blank, so that a repeated passage of some fifty words
    inside a paragraph has three whole lines, wherever it starts and stops; blanks around a line don't count. A line
    goes if any window that covers it is a later occurrence. A document of fewer lines is one window.

    Returns the input's columns with the cleaned text, and _n_lines, _n_removed. Null text stays null with no lines.
    Rows of the same id are one document for the order, so none of them is later than another. Columns of the input
    called _n_lines or _n_removed are replaced. Windows are told apart by 128 bits.

    Plan: one aggregation on window hashes, combined before the shuffle, leaves the repeated ones with their first
    document; one join gives each document its later hashes; texts are shuffled once, to meet these. The work inside a
    document grows as n log n with its lines.
    """
    docs = docs.drop("_n_lines", "_n_removed")
    hashes = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), F.inline(window_hashes(lines_of(F.col(text_col)), size)).alias("_h", "_g"))
    repeated = hashes.groupBy("_h", "_g").agg(F.min("_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    repeated = repeated.select(own_exchange(F.col("_h")).alias("_h2"), own_exchange(F.col("_g")).alias("_g2"), "_first")
    later = hashes.join(repeated, (F.col("_h") == F.col("_h2")) & (F.col("_g") == F.col("_g2"))).where("_id > _first")
    later = later.groupBy("_id").agg(F.collect_set(F.struct(F.col("_h").alias("h"), F.col("_g").alias("g"))).alias("_later"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_key"))
    joined = rows.join(later, F.col("_key") == F.col("_id"), "left").withColumn("_text", F.col("_row")[text_col])
    none = F.array().cast("array<struct<h:bigint,g:bigint>>")

    def cleaned(lines: Column) -> Column:
        whole = F.struct(F.col("_text").alias("text"), F.size(lines).alias("n"), F.lit(0).alias("gone"))
        without = lambda kept: F.struct(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "").alias("text"), F.size(lines).alias("n"), (F.size(lines) - F.size(kept)).alias("gone"))
        found = lambda places: F.when(F.size(places) == 0, whole).otherwise(let(_kept(F.size(lines), places, size), without))
        return let(_repeats(window_hashes(lines, size), F.coalesce("_later", none)), found)

    work = joined.withColumn("_out", F.when(F.col("_text").isNotNull(), let(lines_of(F.col("_text")), cleaned)))
    count = lambda name: F.coalesce(F.col(f"_out.{name}"), F.lit(0)).cast("long")
    return work.select(*[F.col("_out.text").alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns], count("n").alias("_n_lines"), count("gone").alias("_n_removed"))
