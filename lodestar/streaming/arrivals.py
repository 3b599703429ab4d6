"""Arrivals as streams: files registered once, upload parts told apart, stale sessions found."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.sources.sinks import shared_folder


def arrivals(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """A folder of Parquet files, or one file, as a stream; the schema is that of what is there."""
    pattern = f"{path[:-1]}[{path[-1]}]"  # a stream's path must be a folder unless it is a pattern
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", per_trigger).parquet(pattern)


def register(stream: DataFrame, shape: Callable[[DataFrame], DataFrame], path: str | None = None) -> DataFrame:
    """Run a stream over what has arrived, shape each record and append it; returns the table.

    The checkpoint beside the table makes every record count once over restarts: a second run reads only what is new.
    """
    spark = stream.sparkSession
    path = path or shared_folder(spark)
    out = shape(stream)
    run = out.writeStream.format("parquet").option("path", f"{path}/table").option("checkpointLocation", f"{path}/progress").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/table")


def register_batches(stream: DataFrame, shape: Callable[[DataFrame], DataFrame], batch_id: str, path: str, failed: str = "false") -> None:
    """Register a stream's records micro-batch by micro-batch into an open batch.

    Each micro-batch writes its records to a folder of its own, named by Spark's number for it, and then its counters:
    finished rows, and broken ones (the SQL condition `failed` on the shaped rows). A micro-batch that fails leaves the
    batch interrupted and raises; run again from the checkpoint, it has the same number and the same records and
    overwrites both, so nothing counts twice. Read with registered() and batch_progress().
    """
    spark = stream.sparkSession

    def note(epoch: int, state: str, finished: int, broken: int) -> None:
        row = spark.createDataFrame([(batch_id, epoch, state, finished, broken)], PROGRESS)
        row.drop("epoch").coalesce(1).write.mode("overwrite").parquet(f"{path}/counters/epoch={epoch}")

    def write(df: DataFrame, epoch: int) -> None:
        try:
            shape(df).write.mode("overwrite").parquet(f"{path}/table/epoch={epoch}")
            there = spark.read.parquet(f"{path}/table/epoch={epoch}")
            finished, broken = there.agg(F.count_if(~F.coalesce(F.expr(failed), F.lit(False))), F.count_if(F.expr(failed))).first()
        except Exception:
            note(epoch, "interrupted", 0, 0)
            raise
        note(epoch, "open", finished, broken)

    run = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    run.awaitTermination()


PROGRESS = "batch_id string, epoch long, state string, finished long, broken long"


def registered(spark: SparkSession, path: str) -> DataFrame:
    """The records of all micro-batches that were counted; those of an interrupted one are left out until it is repeated."""
    counted = spark.read.option("basePath", f"{path}/counters").parquet(f"{path}/counters").where("state = 'open'").select("epoch")
    table = spark.read.option("basePath", f"{path}/table").parquet(f"{path}/table")
    return table.join(counted, "epoch", "left_semi").drop("epoch")


def batch_progress(spark: SparkSession, path: str) -> DataFrame:
    """One row per batch: micro-batches, finished, broken, state: interrupted while one of its micro-batches is, else completed."""
    seen = spark.read.option("basePath", f"{path}/counters").parquet(f"{path}/counters")
    out = seen.groupBy("batch_id").agg(F.count_if(F.col("state") == "open").alias("micro_batches"), F.sum("finished").alias("finished"), F.sum("broken").alias("broken"), F.count_if(F.col("state") == "interrupted").alias("_cut"))
    return out.withColumn("state", F.when(F.col("_cut") > 0, "interrupted").otherwise("completed")).drop("_cut")


def batch_state(registered: DataFrame) -> DataFrame:
    """Registered items (batch_id, status) -> batch_id, finished, broken, state: interrupted if any broke, else completed."""
    out = registered.groupBy("batch_id").agg(F.count_if(F.col("status") == "ok").alias("finished"), F.count_if(F.col("status") != "ok").alias("broken"))
    return out.withColumn("state", F.when(F.col("broken") > 0, "interrupted").otherwise("completed"))


def distinct_parts(parts: DataFrame, delay: str | None = None, time: str = "ts") -> DataFrame:
    """A part sent again with the same bytes counts once. On a stream, state is kept for `delay` behind the watermark."""
    keys = ["upload_id", "part", "sha256"]
    return parts.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys) if delay else parts.dropDuplicates(keys)


def part_conflicts(parts: DataFrame, order: str) -> DataFrame:
    """(upload_id, part, sha256, bytes, expected) -> the first arrival of each part and its verdict.

    rejected: its size isn't the expected one; conflict: other bytes came for it later; accepted. Combined before the
    shuffle, two numbers and two hashes per part.
    """
    first = F.min_by(F.struct("sha256", "bytes", "expected"), F.col(order)).alias("_f")
    got = parts.groupBy("upload_id", "part").agg(first, F.min("sha256").alias("_low"), F.max("sha256").alias("_high"))
    verdict = F.when(~F.col("_f.bytes").eqNullSafe(F.col("_f.expected")), "rejected").when(F.col("_low") != F.col("_high"), "conflict").otherwise("accepted")
    return got.select("upload_id", "part", F.col("_f.sha256").alias("sha256"), verdict.alias("verdict"))


def reclaimable(sessions: DataFrame, now, seconds: int = 120) -> DataFrame:
    """Sessions (state, updated) that have been finalizing for longer than `seconds`."""
    return sessions.where((F.col("state") == "finalizing") & (F.col("updated") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {seconds} SECONDS")))
