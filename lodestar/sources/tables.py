"""Tables derived from the given ones: files, batches, analyses, upload parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages as files: file_id, original_name, content, source."""
    d, p = read(spark, sf_dir, "documents"), read(spark, sf_dir, "pages")
    ending = F.when(F.col("doc_id") % 3 == 0, ".dat").otherwise(".txt")
    docs = d.select(F.col("doc_id").alias("file_id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), ending).alias("original_name"), F.col("text").alias("content"), "source")
    return docs.unionByName(p.select((F.col("page_id") + 1_000_000).alias("file_id"), F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".dat")).alias("original_name"), F.col("html").alias("content"), F.lit("pages").alias("source")))


def batch_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """batch_id, sequence, file_id (null: rejected), rejection."""
    d = read(spark, sf_dir, "documents")
    out = F.col("doc_id") % 13 == 0
    return d.select(F.col("source").alias("batch_id"), F.col("doc_id").alias("sequence"), F.when(~out, F.col("doc_id")).alias("file_id"), F.when(out, F.lit('{"code":"quota"}')).alias("rejection"))


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per distinct content that has a label: sha256, policy_key."""
    d, lab = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return d.join(lab, "doc_id", "left_semi").select(F.sha2("text", 256).alias("sha256"), F.lit("p1").alias("policy_key")).distinct()


def upload_parts(spark: SparkSession, sf_dir: str, chunk: int = 1024) -> DataFrame:
    """upload_id, size, part, etag (null or blank: none), bytes (its own size) of the parts that arrived; some are a byte short."""
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("upload_id"), F.octet_length("text").cast("long").alias("size"))
    short = F.when((F.col("upload_id") + F.col("part")) % 23 == 0, 1).otherwise(0)
    n = F.greatest(F.ceil(F.col("size") / chunk), F.lit(1))
    parts = d.select("*", F.explode(F.sequence(F.lit(1).cast("long"), n.cast("long"))).alias("part")).where((F.col("upload_id") + F.col("part")) % 17 != 0)
    parts = parts.withColumn("bytes", F.greatest(F.lit(0).cast("long"), F.least(F.lit(chunk).cast("long"), F.col("size") - (F.col("part") - 1) * chunk) - short))
    at = F.col("upload_id") + F.col("part")
    return parts.withColumn("etag", F.when(at % 37 == 0, " ").when(at % 19 != 0, F.concat(F.lit("e"), F.col("part").cast("string"))))


def csv_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as delimited files of at most 50 rows: file_id, content. Delimiter, header and ragged rows vary by id."""
    o = read(spark, sf_dir, "orders").withColumn("file_id", F.floor(F.col("o_orderkey") / 50))
    k = F.col("o_orderkey").cast("string")
    d = F.element_at(F.array(*[F.lit(x) for x in (",", "\t", ";", "|")]), (F.col("file_id") % 4 + 1).cast("int"))
    numbers = F.col("file_id") % 5 == 0
    third = F.when(numbers, (F.col("o_orderkey") * 2).cast("string")).otherwise(F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit('"')))
    cells = F.array(k, F.col("o_custkey").cast("string"), third)
    cells = F.when(F.col("o_orderkey") % 7 == 0, F.array_append(cells, F.lit("9"))).when(F.col("o_orderkey") % 11 == 0, F.slice(cells, 1, 2)).otherwise(cells)
    lines = o.select("file_id", "o_orderkey", d.alias("d"), F.call_function("array_join", cells, d).alias("line"), numbers.alias("numbers"))
    text = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "line"))), lambda r: r["line"])  # at most 50
    grouped = lines.groupBy("file_id", "d", "numbers").agg(text.alias("rows"))
    names = F.when(F.col("file_id") % 3 == 0, F.array(F.lit("key"), F.lit(""), F.lit("key"))).otherwise(F.array(F.lit("key"), F.lit("customer"), F.lit("priority")))
    head = F.when(F.col("numbers"), F.array().cast("array<string>")).otherwise(F.array(F.call_function("array_join", names, F.col("d"))))
    return grouped.select("file_id", F.concat(F.array_join(F.concat(head, F.col("rows")), "\n"), F.lit("\n")).alias("content"))


def nested_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON texts with optional keys and mixed types: event_id, body."""
    i = F.col("event_id").cast("string")
    note = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(',"note":'), F.when(F.col("event_id") % 2 == 0, F.lit('"x"')).otherwise(F.lit("null")))).otherwise("")
    tag = F.when(F.col("event_id") % 5 == 0, F.lit("1.5")).otherwise(F.lit("2"))
    body = F.concat(F.lit('{"user":{"z":'), F.col("user_id").cast("string"), F.lit(',"a":['), tag, F.lit(',{"q":true}]},"id":'), i, note, F.lit("}"))
    return read(spark, sf_dir, "events").select("event_id", body.alias("body"))
