"""A corpus from documents to packed sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import line_dedup, mixing, packing, quality, simhash
from lodestar.llm.common import keep, own_exchange, small, table


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects; null and empty texts weigh 0 and are judged like any other."""
    scored = quality.resample(docs, table(spark, sf_dir, "labels"), text_hash=True)
    chosen = scored.where("selected").select(F.col("doc_id").alias("_id"), "text_hash").distinct()  # equal id and text: one verdict
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("text_hash"))
    return docs.join(chosen, same, "left_semi").select(*docs.columns)


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one holds; those of which nothing is left go, those that were empty stay."""
    done = line_dedup.line_dedup(docs)
    left = done.where((F.col("_n_removed") == 0) | (F.trim("text") != ""))
    return left.withColumn("n_chars", F.when(F.col("_n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the smallest id of each class of near copies (five words, similarity 0.8), those that repeat it included; one row where all ids are null."""
    keyed, _ = keep(docs.select(F.struct(*docs.columns).alias("_row"), F.monotonically_increasing_id().alias("_n")))
    rows = keyed.select("_n", F.col("_row.doc_id").alias("_id"), F.col("_row.text").alias("text"))
    classes, _ = keep(simhash.near_classes(rows, id_col="_n").select(F.col("node").alias("_m"), "component"))
    named = rows.select("_n", "_id").join(small(classes), F.col("_m") == F.col("_n")).select("_n", "_id", "component")
    first = named.groupBy("component").agg(F.min("_id").alias("_least"), F.min("_n").alias("_first")).withColumnRenamed("component", "_c")
    stays = F.col("_id").eqNullSafe(F.col("_least")) & (F.col("_least").isNotNull() | (F.col("_n") == F.col("_first")))
    gone, _ = keep(named.join(first, F.col("component") == own_exchange(F.col("_c"))).where(~stays).select(F.col("_n").alias("_k")))
    left = keyed.join(small(gone), F.col("_n") == F.col("_k"), "left_anti")
    return left.select(*[F.col("_row")[c].alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as the mix takes it."""
    return mixing.curriculum(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1,024 tokens."""
    return packing.digest(packing.pack(docs, capacity=1024, end_id=0))


STAGES = [("quality", select_quality), ("line_dedup", remove_lines), ("simhash", drop_near_copies), ("mixing", mix_sources), ("packing", pack_sequences)]

#: The quality classifier and near copies have no SQL form; tests hold the classes of near copies against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES) and stage is not mix_sources:  # written and read again, the training order would be lost
            docs, _ = keep(docs)
    return docs
