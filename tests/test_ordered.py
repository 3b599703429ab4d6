"""Numbers, sums and quotas of groups that reach over many ranges, against loops."""

import random

from pyspark.sql import functions as F

from lodestar.operators import ordered as O
from lodestar.operators import sampling as S
from lodestar.sources import sinks as W


def rows_of(spark, n=600, hot=0.8):
    random.seed(3)
    rows = [("hot" if random.random() < hot else random.choice(["b", "c", None]), i, random.choice([0, 1, 3, 7, 20, 60, None])) for i in range(n)]
    random.shuffle(rows)
    return rows, spark.createDataFrame(rows, "g string, k long, s long")


def by_group(rows):
    groups = {}
    for g, k, s in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(g, []).append((k, s))
    return groups


def test_numbers_and_sums(spark):
    rows, df = rows_of(spark)
    got = {(r["g"], r["k"]): (r["_i"], r["n"]) for r in O.numbered(df, ["g"], ["k"], total="n", ranges=9).collect()}
    sums = {(r["g"], r["k"]): r["_sum"] for r in O.running_sum(df, ["g"], ["k"], "s", ranges=9).collect()}
    for g, items in by_group(rows).items():
        total = 0
        for i, (k, s) in enumerate(items):
            total += s or 0
            assert got[g, k] == (i, len(items)) and sums[g, k] == total
    assert O.numbered(df.limit(0), ["g"], ["k"]).count() == 0
    whole = sorted((r["k"], r["_i"], r["n"]) for r in O.numbered(df, [], ["k"], total="n", ranges=5).collect())
    assert whole == [(i, i, 600) for i in range(600)]


def test_no_task_holds_the_group(spark):
    df = spark.range(4000).select(F.lit("one").alias("g"), F.col("id").alias("k"))
    ranged = O.ranged(df, ["g", "k"], 8)
    sizes = [r["count"] for r in ranged.groupBy("_range").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1500
    bounds = sorted((r["lo"], r["hi"]) for r in ranged.groupBy("_range").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).collect())
    assert all(a[1] < b[0] for a, b in zip(bounds, bounds[1:]))


def fold(items, quota):
    used, out = 0, []
    for k, s in items:
        ok = used + (s or 0) <= quota
        used += (s or 0) if ok else 0
        out.append((k, ok))
    return out


def test_greedy_quota_over_ranges(spark):
    rows, df = rows_of(spark)
    for quota in (0, 50, 900, 10**6):
        got = {(r["g"], r["k"]): r["accepted"] for r in O.greedy_quota(df, "g", "k", "s", quota, ranges=9).collect()}
        assert got == {(g, k): ok for g, items in by_group(rows).items() for k, ok in fold(items, quota)}
    falling = [("o", i, 100 - i // 2 if i % 2 else 1) for i in range(180)]  # a row that no longer fits after every row that does
    df = spark.createDataFrame(falling, "g string, k long, s long")
    ranged = O.ranged(df, ["g", "k"], 6)
    entries, rounds = O.quota_entries(ranged, "g", "k", "s", 100, finish=0)
    assert 1 < rounds <= 6 and len(entries) == 6
    at_once, one = O.quota_entries(ranged, "g", "k", "s", 100)
    assert one == 1 and sorted(at_once) == sorted(entries)
    got = {r["k"]: r["accepted"] for r in O.greedy_quota(df, "g", "k", "s", 100, ranges=6).collect()}
    assert got == dict(fold([(k, s) for _, k, s in falling], 100))
    assert O.greedy_quota(df.limit(0), "g", "k", "s", 5).count() == 0


def test_budget_occurrence_and_samples(spark):
    rows, df = rows_of(spark)
    got = {(r["g"], r["k"]): r["accepted"] for r in S.running_budget(df, ["g"], ["k"], "s", 300).collect()}
    nth = {r["k"]: r["occurrence"] for r in S.occurrence_index(df, ["g"], ["k"]).collect()}
    picked = {(r["g"], r["k"]) for r in S.systematic_sample(df, ["g"], ["k"], 4).collect()}
    for g, items in by_group(rows).items():
        total, n = 0, len(items)
        for i, (k, s) in enumerate(items):
            total += s or 0
            assert got[g, k] == (total <= 300) and nth[k] == i
            assert ((g, k) in picked) == (n <= 4 or i in {round(j * (n - 1) / 3) for j in range(4)})


def test_sequence_without_gaps(spark, tmp_path):
    path = str(tmp_path / "items")
    first = spark.createDataFrame([("b", i, 1000 - i) for i in range(500)], "batch_id string, file_id long, at long")
    W.append_items(first, path, ["at"])
    W.append_items(first.where("file_id < 50"), path, ["at"])
    rows = sorted((r["sequence"], r["at"]) for r in spark.read.parquet(path).collect())
    assert [s for s, _ in rows] == list(range(550))
    assert [a for _, a in rows] == sorted(1000 - i for i in range(500)) + sorted(1000 - i for i in range(50))


def test_positions_of_empty_and_null_arrays(spark):
    df = spark.createDataFrame([(1, []), (2, None), (3, [5]), (4, list(range(10)))], "i int, a array<int>")
    for budget, want in ((1, {1: [], 2: None, 3: [0], 4: [5]}), (3, {1: [], 2: None, 3: [0], 4: [0, 4, 9]})):
        n = F.when(F.col("a").isNotNull(), F.size("a"))
        assert {r["i"]: r["p"] for r in df.select("i", S.spread(n, budget).alias("p")).collect()} == want
    assert df.select(F.explode(S.spread(F.size("a"), 4))).count() == 5
