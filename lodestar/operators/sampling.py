"""Deterministic samples, pages and quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.ordered import greedy_quota, numbered, running_sum  # noqa: F401  greedy_quota is one of them


def spread(n: Column, budget: int) -> Column:
    """Indices of a systematic sample of n items: round(i (n - 1) / (budget - 1)), half to even; all if n <= budget; the middle one if budget is 1. No items: none; null: null."""
    none = F.when(n.isNull(), F.lit(None)).when(n <= 0, F.array().cast("array<bigint>"))
    if budget == 1:
        return none.otherwise(F.array((n / 2).cast("long")))
    picks = F.transform(F.sequence(F.lit(0), F.lit(budget - 1)), lambda i: F.rint(i * (n - 1) / (budget - 1)).cast("long"))
    return none.when(n <= budget, F.sequence(F.lit(0).cast("long"), F.greatest(n.cast("long") - 1, F.lit(0)))).otherwise(picks)


def systematic_sample(df: DataFrame, group: list[str], order: list[str], budget: int) -> DataFrame:
    """Of each group, the rows whose index in `order` is in spread(count, budget). Groups may be of any size."""
    return numbered(df, group, order, "_i", "_n").where(F.array_contains(spread(F.col("_n"), budget), F.col("_i"))).drop("_i", "_n")


def zones(df: DataFrame, group: list[str], order: list[str], head: float = 0.5, middle: float = 0.25) -> DataFrame:
    """Adds zone: head, middle, tail or rest. With budget b of n rows: the first b/2, a centred b/4 and the last b/4, b being half of n."""
    i, n = F.col("_i"), F.col("_n")
    budget = F.floor(n / 2)
    h, q = F.floor(budget * head), F.floor(budget * middle)
    start = F.floor((n - q) / 2)
    return numbered(df, group, order, "_i", "_n").withColumn("zone", F.when(i < h, "head").when(i >= n - q, "tail").when((i >= start) & (i < start + q), "middle").otherwise("rest")).drop("_i", "_n")


def kth_largest(df: DataFrame, key: str, k: int, parts: int = 4096, small: int = 10_000) -> int | None:
    """The k-th largest value of a column of whole numbers; null if there are fewer than k, nulls not counted.

    Exact without a global sort: counts of at most `parts` equal ranges come to the driver, and the range that holds the
    value is divided again, until at most `small` rows are in it or it is one value wide.
    """
    low, high, n = df.agg(F.min(key), F.max(key), F.count(key)).first()
    if k < 1 or n < k:
        return None
    while low < high and n > small:
        width = (high - low) // parts + 1
        inside = df.where(F.col(key).between(low, high))
        counts = dict(inside.groupBy(F.floor((F.col(key) - low) / width).alias("r")).agg(F.count("*")).collect())
        for r in sorted(counts, reverse=True):
            if k <= counts[r]:
                break
            k -= counts[r]
        low, high, n = low + r * width, min(high, low + (r + 1) * width - 1), counts[r]
    if low == high:
        return low
    return df.where(F.col(key).between(low, high)).select(key).orderBy(F.col(key).desc()).offset(k - 1).limit(1).first()[0]


def per_group(df: DataFrame, group: list[str], order: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= n).drop("_i")


def item_limit(df: DataFrame, size: str, limit: int) -> DataFrame:
    """Every row, with rejection too_large where it is above the limit and null where it is not; a null size is not."""
    return df.withColumn("rejection", F.when(F.col(size) > limit, "too_large"))


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def cursor_page(df: DataFrame, key: str, after: int, limit: int) -> DataFrame:
    """Up to `limit` rows behind the cursor, each with whether more follow and the next cursor (null if none do): keyset paging, one extra row is read."""
    read = df.where(F.col(key) > after).orderBy(key).limit(limit + 1)
    w = Window.orderBy(key)  # limit + 1 rows
    each = read.withColumn("_i", F.row_number().over(w)).withColumn("truncated", F.count("*").over(Window.partitionBy()) > limit).where(F.col("_i") <= limit)
    return each.withColumn("next_cursor", F.when(F.col("truncated"), F.max(key).over(Window.partitionBy()))).drop("_i")


def drift(df: DataFrame, key: str, column: Column, share: int = 100) -> DataFrame:
    """Value types in the first, the middle and the last 1/share of the rows in order of a column of distinct whole numbers: head, middle, tail (sorted lists) and drifted.

    The windows' bounds are found by kth_largest(), which runs jobs: no row is sorted or numbered.
    """
    n = df.where(F.col(key).isNotNull()).count()
    m = max(1, n // share)
    at = lambda k: kth_largest(df, key, max(1, min(k, n)))
    bounds = {"head": (at(n), at(n - m + 1)), "middle": (at(n // 2 + (m + 1) // 2), at(n // 2 - m // 2 + 1)), "tail": (at(m), at(1))}
    inside = lambda b: F.lit(False) if b[0] is None else F.col(key).between(*b)
    types = [F.array_sort(F.collect_set(F.when(inside(b), column))).alias(zone) for zone, b in bounds.items()]
    return df.agg(*types).withColumn("drifted", (F.col("head") != F.col("middle")) | (F.col("middle") != F.col("tail")))


def table_quota(tables: dict[str, DataFrame], rows: int, key: str) -> DataFrame:
    """The first rows // len(tables) rows of each table by its key, with the table's name in tbl. Tables have the same columns."""
    out = None
    for name, df in tables.items():
        part = page(df, [F.col(key)], rows // len(tables)).select(F.lit(name).alias("tbl"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def occurrence_index(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Adds occurrence: how many rows of the same key come before, by `order`. A key may hold all rows."""
    return numbered(df, key, order, "occurrence")


def running_budget(df: DataFrame, group: list[str], order: list[str], size: str, budget: int) -> DataFrame:
    """Adds accepted: whether the running total, this row included, is still within the budget. Once over, all later rows are out. A group may hold all rows."""
    return running_sum(df, group, order, size, "_sum").withColumn("accepted", F.col("_sum") <= budget).drop("_sum")
