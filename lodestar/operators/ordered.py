"""Row numbers, running sums and quotas inside groups of any size.

A window over one huge group is one task. Here rows are dealt into ranges of their order first, ranges are summed up, and
windows are only taken inside a range; what lies before it is added as one number.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.sources.sinks import kept


def ranged(df: DataFrame, keys: list[str], ranges: int | None = None) -> DataFrame:
    """The rows with _range: rows in order of the keys, nulls first, are those of range 0, then those of range 1, and so on.

    Spark draws the bounds from a sample, so ranges hold about equally many rows, those that tie in all keys together.
    The rows are written to the shared folder, since drawing the bounds again would give other ones.
    """
    by = [F.col(k) for k in keys]
    dealt = df.repartitionByRange(ranges, *by) if ranges else df.repartitionByRange(*by)
    return kept(dealt.withColumn("_range", F.spark_partition_id()))


def _offsets(rows: DataFrame, group: list[str], size: Column) -> DataFrame:
    """(group as _g0.., _range as _at) -> _before, _total of `size`, of the groups that reach over several ranges.

    A range begins inside one group at most, and ends inside one: there are fewer than two such rows a range, whatever the number of groups.
    """
    each = rows.groupBy(*group, "_range").agg(F.coalesce(F.sum(size), F.lit(0)).alias("_s"))
    w = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_s").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wide = each.select("*", before.alias("_before"), F.sum("_s").over(w).alias("_total"), F.count("*").over(w).alias("_ranges")).where("_ranges > 1")
    return wide.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_range").alias("_at"), "_before", "_total")


def _with_offsets(rows: DataFrame, group: list[str], size: Column) -> DataFrame:
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    on = reduce(Column.__and__, same, F.col("_range") == F.col("_at"))
    return rows.join(F.broadcast(_offsets(rows, group, size)), on, "left").drop("_at", *[f"_g{i}" for i in range(len(group))])


def numbered(df: DataFrame, group: list[str], order: list[str], number: str = "_i", total: str | None = None, ranges: int | None = None) -> DataFrame:
    """Adds the place of a row in its group from 0, by `order` (nulls first), and with `total` the group's number of rows.

    Null is a group of its own. Rows that tie in order are numbered among each other arbitrarily. An empty group list
    numbers the whole table.
    """
    rows = ranged(df, [*group, *order], ranges)
    inside = Window.partitionBy(*group, "_range")
    out = _with_offsets(rows, group, F.lit(1)).withColumn(number, (F.row_number().over(inside.orderBy(*order)) - 1 + F.coalesce("_before", F.lit(0))).cast("long"))
    if total:
        out = out.withColumn(total, F.coalesce("_total", F.count("*").over(inside)).cast("long"))
    return out.drop("_range", "_before", "_total")


def running_sum(df: DataFrame, group: list[str], order: list[str], size: str, name: str = "_sum", ranges: int | None = None) -> DataFrame:
    """Adds the sum of `size` over a group's rows up to this one, this one included; null sizes count as 0."""
    return sum_in_ranges(ranged(df, [*group, *order], ranges), group, order, size, name).drop("_range")


def sum_in_ranges(rows: DataFrame, group: list[str], order: list[str], size: str, name: str) -> DataFrame:
    """running_sum() over rows that are ranged() by group and order already; _range stays, so that more sums may follow."""
    inside = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = F.coalesce(F.sum(size).over(inside), F.lit(0))
    return _with_offsets(rows, group, F.col(size)).withColumn(name, here + F.coalesce("_before", F.lit(0))).drop("_before", "_total")


#: Rows of an owner that still fit into what is left of its quota, from which on they are folded at once.
FINISH = 50_000


def _fold(sizes: list, left: int, ok: list) -> int:
    for s in sizes:
        fits = (s or 0) <= left
        ok.append(fits)
        left -= (s or 0) if fits else 0
    return left


def quota_entries(rows: DataFrame, owner: str, order: str, size: str, quota: int, finish: int = FINISH) -> tuple[list[tuple], int]:
    """ranged() rows -> (owner, range, what is left of the quota where the range begins) of owners that reach over several ranges, and the rounds it took.

    A round takes, for every owner, the rows behind the last settled range that still fit into what is left. Their sums
    by range tell the first range in which they overflow; before it all of them are accepted, so that range's entry and
    those before are known. Only that range is folded row by row. Each round settles at least one more range of every
    owner; owners all of whose remaining rows fit, or none, are done. An owner of whose rows no more than `finish` still
    fit, which a filled quota soon brings about, has these folded at once. The lists hold a few numbers a range.
    """
    spark = rows.sparkSession
    wide = _offsets(rows, [owner], F.lit(1)).select(F.col("_g0").alias("o"), F.col("_at").alias("r")).collect()
    places: dict = {}
    for o, r in wide:
        places.setdefault(o, []).append(r)
    state = {o: (-1, quota) for o in places}  # settled up to this range, what is left behind it
    entries, rounds = [], 0
    kind = rows.schema[owner].dataType.simpleString()
    while state:
        rounds += 1
        now = F.broadcast(spark.createDataFrame([(o, r, left) for o, (r, left) in state.items()], f"_o {kind}, _done int, _left long"))
        live = rows.join(now, F.col(owner).eqNullSafe(F.col("_o"))).where((F.col("_range") > F.col("_done")) & (F.coalesce(size, F.lit(0)) <= F.col("_left")))
        sums, fitting = {}, {}
        for o, r, s, n in live.groupBy(owner, "_range").agg(F.sum(F.coalesce(size, F.lit(0))).alias("s"), F.count("*").alias("n")).collect():
            sums.setdefault(o, {})[r] = s
            fitting[o] = fitting.get(o, 0) + n
        few = [o for o in state if fitting.get(o, 0) <= finish and sum(sums.get(o, {}).values()) > state[o][1]]
        if few:
            these = F.broadcast(spark.createDataFrame([(o,) for o in few], f"_f {kind}"))
            item = F.struct(F.col("_range").alias("r"), F.col(order).alias("k"), F.coalesce(size, F.lit(0)).cast("long").alias("s"))
            listed = live.join(these, F.col(owner).eqNullSafe(F.col("_f"))).groupBy("_o", "_left").agg(F.array_sort(F.collect_list(item)).alias("l"))  # at most `finish` rows
            start = F.struct(F.col("_left").alias("left"), F.array().cast("array<struct<r:int,left:bigint>>").alias("ends"))
            after = lambda a, x: F.when(x["s"] <= a["left"], a["left"] - x["s"]).otherwise(a["left"])
            used = F.aggregate("l", start, lambda a, x: F.struct(after(a, x).alias("left"), F.when(x["s"] <= a["left"], F.array_append(a["ends"], F.struct(x["r"].alias("r"), after(a, x).alias("left")))).otherwise(a["ends"]).alias("ends")))
            last = F.map_from_entries(F.transform(F.array_distinct(F.transform("e", lambda x: x["r"])), lambda r: F.struct(r.alias("r"), F.array_min(F.transform(F.filter("e", lambda x: x["r"] == r), lambda x: x["left"])).alias("left"))))
            for o, ends in listed.select("_o", used["ends"].alias("e")).select("_o", last).collect():
                done, left = state.pop(o)
                for r in sorted(x for x in places[o] if x > done):
                    entries.append((o, r, left))
                    left = ends.get(r, left)
        broken = {}
        for o, (done, left) in list(state.items()):
            at = left
            for r in sorted(x for x in places[o] if x > done):
                entries.append((o, r, at))
                if at - sums.get(o, {}).get(r, 0) < 0:
                    broken[o] = (r, at)
                    break
                at -= sums.get(o, {}).get(r, 0)
            else:
                del state[o]
        if not broken:
            break
        todo = F.broadcast(spark.createDataFrame([(o, r, left) for o, (r, left) in broken.items()], f"_o {kind}, _r int, _left long"))
        inside = rows.join(todo, F.col(owner).eqNullSafe(F.col("_o")) & (F.col("_range") == F.col("_r"))).where(F.coalesce(size, F.lit(0)) <= F.col("_left"))
        listed = inside.groupBy("_o", "_r", "_left").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), F.coalesce(size, F.lit(0)).cast("long").alias("s")))).alias("l"))  # a range's rows
        left = F.aggregate("l", F.col("_left"), lambda a, x: F.when(x["s"] <= a, a - x["s"]).otherwise(a))
        for o, r, rest in listed.select("_o", "_r", left).collect():
            state[o] = (r, rest)
        state = {o: s for o, s in state.items() if s[0] < max(places[o])}
    return entries, rounds


def greedy_quota(df: DataFrame, owner: str, order: str, size: str, quota: int, ranges: int | None = None) -> DataFrame:
    """(owner, order, size) -> with accepted: rows in order, each accepted if it still fits; a rejected row uses nothing.

    A true fold, since a running sum can't express it, yet no task holds an owner: quota_entries() finds what is left
    where each range begins, then all ranges are folded side by side. Null sizes use nothing, a null owner is one of its
    own, `order` decides without ties. Runs jobs while the query is built.
    """
    rows = ranged(df.select(owner, order, size), [owner, order], ranges)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    entries, _ = quota_entries(rows, owner, order, size, quota)
    known = df.sparkSession.createDataFrame(entries, f"_o {kinds[owner]}, _r int, _left long")
    begun = rows.join(F.broadcast(known), F.col(owner).eqNullSafe(F.col("_o")) & (F.col("_range") == F.col("_r")), "left")
    begun = begun.select(owner, order, size, "_range", F.coalesce("_left", F.lit(quota).cast("long")).alias("_left"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, left = object(), 0
        for rb in batches:
            ok: list[bool] = []
            for o, s, r, begin in zip(*(rb.column(i).to_pylist() for i in (0, 2, 3, 4))):
                if (o, r) != of:
                    of, left = (o, r), begin
                left = _fold([s], left, ok)
            yield pa.RecordBatch.from_arrays([*rb.columns[:3], pa.array(ok, pa.bool_())], names=[owner, order, size, "accepted"])

    dealt = begun.repartition(owner, "_range").sortWithinPartitions(owner, "_range", order)
    return dealt.mapInArrow(run, f"{owner} {kinds[owner]}, {order} {kinds[order]}, {size} {kinds[size]}, accepted boolean")
