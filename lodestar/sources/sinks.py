"""Tables written: manifests, summaries, content by category, schemas by shape, batches, snapshots."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.catalog import verify_integrity


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that all executors share. Where the session names none: a temporary one in local mode, an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-lodestar-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/lodestar-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, so that its rows stay what they are; the table goes when the application ends."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def write_manifest(inspected: DataFrame, path: str) -> None:
    """One JSON line per file, errors included."""
    inspected.write.mode("errorifexists").json(path)


def review_examples(inspected: DataFrame, n: int = 20) -> DataFrame:
    """The first n records that aren't ok, by name and id."""
    return inspected.where("status <> 'ok'").orderBy("original_name", "file_id").limit(n)


def summary(inspected: DataFrame, n: int = 20) -> DataFrame:
    """One row: counts by status, category and format as sorted pairs, and the first n examples for review."""
    cols = ["status", "category", "detected_type"]
    counted = inspected.groupingSets([[F.col(c)] for c in cols], *cols).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))

    def pairs(c: str, g: int):
        return F.array_sort(F.collect_list(F.when(F.col("g") == g, F.struct(F.coalesce(c, F.lit("none")).alias("value"), "n"))))

    counts = counted.agg(pairs("status", 3).alias("statuses"), pairs("category", 5).alias("categories"), pairs("detected_type", 6).alias("formats"))
    few = review_examples(inspected, n).agg(F.array_sort(F.collect_list(F.struct("original_name", "file_id", "status"))).alias("review"))
    return counts.join(few)  # one row each


def write_by_category(content: DataFrame, path: str) -> None:
    """(category, source, ...) laid out in folders by category and source."""
    content.write.mode("errorifexists").partitionBy("category", "source").parquet(path)


def first_per_shape(schemas: DataFrame, order: str) -> DataFrame:
    """One schema per fingerprint, the first by `order`; combined before the shuffle."""
    rest = [c for c in schemas.columns if c != "fingerprint"]
    return schemas.where("fingerprint is not null").groupBy("fingerprint").agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r")).select("fingerprint", "_r.*")


def write_schema_per_shape(schemas: DataFrame, order: str, path: str) -> None:
    """One JSON document per fingerprint, the first by `order`; an existing path is refused."""
    first_per_shape(schemas, order).write.mode("errorifexists").json(path)


def append_items(items: DataFrame, path: str, order: list[str]) -> None:
    """Append items with a sequence that goes on without a gap from what is there, in the order of arrival given by the columns `order`.

    Rows are numbered inside ranges of their order, each range behind the rows counted before it; no task sees all of
    them. One writer at a time, as for any appended Parquet table.
    """
    from lodestar.operators.ordered import numbered

    spark = items.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    last = spark.read.parquet(path).agg(F.coalesce(F.max("sequence"), F.lit(-1))).first()[0] if there else -1
    placed = numbered(items, [], order, "sequence")
    placed.withColumn("sequence", F.col("sequence") + F.lit(last + 1).cast("long")).write.mode("append").parquet(path)


def backup(catalogue: DataFrame, originals: DataFrame, path: str) -> DataFrame:
    """Copy catalogue and originals to a new path, hash the copy, and write the manifest last.

    Returns the verdict of every file of the copy. The manifest (one row) is absent unless all of them are ok; an
    existing path is refused.
    """
    spark = catalogue.sparkSession
    catalogue.write.mode("errorifexists").parquet(f"{path}/catalogue")
    originals.write.mode("errorifexists").parquet(f"{path}/originals")
    verdicts = verify_integrity(spark.read.parquet(f"{path}/catalogue"), spark.read.parquet(f"{path}/originals"))
    total = verdicts.agg(F.count("*").alias("files"), F.count_if(F.col("verdict") != "ok").alias("bad"))
    if total.first()["bad"] == 0:
        total.write.mode("errorifexists").json(f"{path}/manifest")
    return verdicts


def restore(spark: SparkSession, path: str, target: str) -> None:
    """Verify a snapshot, then copy it to a new place; refuses snapshots without manifest or with a bad file."""
    spark.read.json(f"{path}/manifest").first()
    catalogue, originals = spark.read.parquet(f"{path}/catalogue"), spark.read.parquet(f"{path}/originals")
    if not verify_integrity(catalogue, originals).where("verdict <> 'ok'").isEmpty():
        raise ValueError("the snapshot does not match its hashes")
    catalogue.write.mode("errorifexists").parquet(f"{target}/catalogue")
    originals.write.mode("errorifexists").parquet(f"{target}/originals")
