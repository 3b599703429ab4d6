"""What the operators share: input tables, written intermediate tables, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a few numbers that may be broadcast: some 24 MB.
BROADCAST_ROWS = 1_000_000
#: A node with more edges than HUB, and than one in HUBS of all, is a hub: at most 2 HUBS rows are broadcast at any size.
HUB, HUBS = 64, 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session names none: a temporary one in local mode, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-lodestar-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: inside another lambda, an expression would be computed for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def keep(df: DataFrame) -> tuple[DataFrame, str]:
    """Write df into the shared folder and read it back: lineage ends there, and lost executors cost no rework. The table goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestar-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def own_exchange(key: Column) -> Column:
    """The long key itself, in a form that Spark doesn't see through: a join on it deals an aggregate's rows anew, so that AQE may split a frequent key."""
    return key.bitwiseXOR(F.lit(0).cast("long"))


class Scratch:
    """keep() for tables that an operator needs only until its result is kept itself."""

    def __init__(self):
        self.paths: list[tuple[SparkSession, str]] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        kept, path = keep(df)
        self.paths.append((df.sparkSession, path))
        return kept

    def clear(self) -> None:
        for spark, path in self.paths:
            discard(spark, path)
        self.paths.clear()


def small(kept: DataFrame) -> DataFrame:
    """A kept table of a few numbers a row, marked for broadcast if it has no more than BROADCAST_ROWS rows; counting reads file footers only."""
    return F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept


def shuffled(df: DataFrame) -> DataFrame:
    """A table marked against broadcast: of what was exploded, Spark takes each row for one as before, and files that repeat values are far smaller than their rows in memory."""
    return df.hint("merge")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Undirected edges of longs -> (node, component): component is the smallest node reachable.

    Alternating large-star and small-star rounds: every round is two aggregations and two joins, the number of rounds
    grows with the logarithm of the longest path, and no group is ever gathered. Null ends and self-loops are ignored;
    nodes without an edge are absent. Each round is written to the shared folder, so lineage stays one round long.

    A large component becomes a star, whose edges all meet at one node. The least neighbours of such hubs are
    broadcast, a number bounded at any size, so that their edges are not dealt by the hub.
    """
    spark = edges.sparkSession
    start = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now, path = keep(start)
    mark = _mark(now)
    while mark[0]:
        heavy = max(HUB, mark[0] // HUBS)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"), "n")
        large = _at(both.where("v > u"), lowest, heavy).select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select(F.col("u").alias("w"), "m", "n")
        small_star = _at(large, least, heavy).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        then, new_path = keep(small_star.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct())
        new_mark = _mark(then)
        discard(spark, path)
        now, path = then, new_path
        if new_mark == mark:
            break
        mark = new_mark
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _at(rows: DataFrame, lowest: DataFrame, heavy: int) -> DataFrame:
    """rows (u, v) with m of lowest (w, m, n) at u = w. Hubs meet by broadcast; the rest is shuffled, and no key of it has more than `heavy` rows."""
    hubs = F.broadcast(lowest.where(F.col("n") > heavy).select(F.col("w").alias("h"), F.col("m").alias("hm")))
    met = rows.join(hubs, F.col("u") == F.col("h"), "left")
    rest = met.where("h is null").select("u", "v").join(lowest.where(F.col("n") <= heavy).select("w", "m"), F.col("u") == F.col("w"))
    return met.where("h is not null").select("u", "v", F.col("hm").alias("m")).unionByName(rest.select("u", "v", "m"))


def _mark(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
