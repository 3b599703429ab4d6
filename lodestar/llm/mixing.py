"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the sources in code-point order, null last, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: A source's rate at the end of training over its rate at the start, repeating like the weights; 1 is a constant rate.
TILTS = (0.5, 1.0, 2.0)
#: Leading hexadecimal digits of the hash that part a source into ranges, in each of which positions are summed up: one task sees 1/4096 of a source.
DIGITS = 3
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = 3.0) -> DataFrame:
    """(source, source_size long, ord) -> with target: total size shared by weight, none above cap times its size, the excess reshared by weight.

    This water filling has a closed form: sources in the order of cap size over weight; the first so many are filled to
    their cap, and the rest share what is left. One row per source goes through one task.
    """
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights)).cast("int"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    all_of = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    work = sizes.withColumn("_rank", F.row_number().over(by_name) - 1).withColumn("_weight", weight)
    work = work.withColumn("_cap", F.lit(cap) * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("_weight"))
    work = work.withColumn("_total", F.sum("source_size").over(all_of).cast("double"))
    work = work.withColumn("_filled", F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_cap"))
    work = work.withColumn("_open", F.sum("_weight").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    work = work.withColumn("_level", (F.col("_total") - F.col("_filled")) / F.col("_open"))
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct(F.col("_ratio"), F.col("_level").alias("l")))).over(all_of)["l"]
    target = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least(F.col("_cap"), F.col("_weight") * F.coalesce(level, F.lit(float("inf")))))
    return work.withColumn("target", target).select("source", "source_size", "target", F.col("_rank").alias("ord"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = 3.0, digits: int = DIGITS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: bool = False) -> DataFrame:
    """Documents -> one row per document with its copies in the mix and where they stand in the training run.

    A document's size is its number of words. Every source is ordered by the MD5 of the id; its words, repeated over
    and over, are demanded until its target is met: a document has floor(target / source size) copies, and one more if
    its middle lies in the remaining fraction. So a source's words miss its target by less than one document.

    The curriculum: a source's rate changes linearly over training time t in [0, 1], from 2 / (1 + tilt) to
    2 tilt / (1 + tilt) of its mean. The rate's integral is the share of its demand met by t; a copy's cumulative
    place in that demand, put through the inverse, is its training position.

    Returns doc_id, size, source, source_size, target, taken (words, repeats counted), copies, _place (words of the
    source before it). Null text has size 0, a null source is a source of its own (last). Rows of equal id and size
    are ordered among each other arbitrarily, which changes no result. Further columns are ignored; with `carry`, _row
    holds the whole input row.

    Plan: sums per source and hash range (combined before the shuffle) give each range its start; running sums are
    only taken inside a range, so a source with a third of all rows is spread over thousands of groups.
    """
    key = F.md5(F.col(id_col).cast("string"))
    kept = [F.struct(*docs.columns).alias("_row")] if carry else []
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.coalesce(key, F.lit("")).alias("_key"), *kept)
    # the window and the join below are dealt by the same columns, so that rows are shuffled once for both
    rows = rows.withColumn("_name", F.coalesce("source", F.lit(""))).withColumn("_none", F.col("source").isNull()).withColumn("_bin", F.substring("_key", 1, digits))
    ranges = rows.groupBy("source", "_bin").agg(F.sum("size").alias("_in"))
    before = Window.partitionBy("source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = ranges.withColumn("_before", F.sum("_in").over(before) - F.col("_in"))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("_in").alias("source_size")), weights, cap)
    starts = ranges.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "_in")
    starts = starts.select(F.coalesce("source", F.lit("")).alias("_name"), F.col("source").isNull().alias("_none"), "_bin", "_before", "source_size", "target", "ord")
    inside = Window.partitionBy("_name", "_none", "_bin").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("_place", F.sum("size").over(inside) - F.col("size"))
    placed = placed.join(starts, ["_name", "_none", "_bin"]).withColumn("_place", F.col("_place") + F.col("_before"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(ratio)
    extra = F.when(F.col("_place") + F.col("size") / 2.0 <= (ratio - whole) * F.col("source_size"), 1).otherwise(0)
    copies = F.least(whole + extra, F.floor(F.lit(cap))).cast("long")
    return placed.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size")).select("doc_id", "size", "source", "source_size", "target", "taken", "copies", "_place", "ord", *(["_row"] if carry else []))


def _met_at(share: Column, ord: Column, tilts: tuple[float, ...]) -> Column:
    """Training time at which a source has met this share of its demand: the inverse of its integrated rate."""
    tilt = F.get(F.array(*map(F.lit, tilts)), (ord % len(tilts)).cast("int"))
    # the share met by t is a t + b t t, with a = 2 / (1 + tilt) and b = (tilt - 1) / (1 + tilt)
    a, b = 2.0 / (1.0 + tilt), (tilt - 1.0) / (1.0 + tilt)
    return F.least(F.lit(1.0), 2.0 * share / (a + F.sqrt(F.greatest(F.lit(0.0), a * a + 4.0 * b * share))))


def _share(epoch: Column) -> Column:
    """Share of the source's demand met at the middle of a document's copy."""
    return F.when(F.col("target") > 0, F.least(F.lit(1.0), (epoch * F.col("source_size") + F.col("_place") + F.col("size") / 2.0) / F.col("target"))).otherwise(F.lit(0.0))


def positions(mixed: DataFrame, tilts: tuple[float, ...] = TILTS) -> DataFrame:
    """mix() rows -> one row per copy with epoch and position in [0, 1], range-sorted by position."""
    copy = mixed.where("copies > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("epoch"))
    return copy.withColumn("position", _met_at(_share(F.col("epoch")), F.col("ord"), tilts)).orderBy("position", "doc_id", "epoch")


def training_order(mixed: DataFrame, tilts: tuple[float, ...] = TILTS) -> DataFrame:
    """mix() rows with positions, an array with the position of each copy; range-sorted by it, documents without a copy last."""
    epochs = F.when(F.col("copies") > 0, F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    return mixed.withColumn("positions", F.transform(epochs, lambda e: _met_at(_share(e), F.col("ord"), tilts))).orderBy(F.col("positions").asc_nulls_last(), "doc_id")


def curriculum(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, range-sorted by training position; columns as given.

    Rows go through the mix with their places, so that each has its own copies, whether its id is repeated or null.
    """
    placed = mix(docs, id_col=id_col, carry=True, **{k: v for k, v in options.items() if k != "tilts"})
    at = positions(placed, options.get("tilts", TILTS))
    return at.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
