"""Rules, statuses and counts over inspection records (functions.content.inspect)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rule_table(inspected: DataFrame, whole: int) -> DataFrame:
    """file_id, rule, result: format passes for known types, coverage for content of at most `whole` bytes; otherwise unknown. Null sizes are unknown."""
    known = F.when(F.col("detected_type").isNotNull(), "pass").otherwise("unknown")
    covered = F.when(F.col("file_size") <= whole, "pass").otherwise("unknown")
    each = F.array(F.struct(F.lit("format").alias("rule"), known.alias("result")), F.struct(F.lit("coverage").alias("rule"), covered.alias("result")))
    return inspected.select("file_id", F.inline(each))


def rule_summary(rules: DataFrame) -> DataFrame:
    """How many files have which result, per rule."""
    return rules.groupBy("rule", "result").agg(F.count("*").alias("n"))


def extraction_status(inspected: DataFrame, whole: int, failed: list[str] = ("corrupt", "failed")) -> DataFrame:
    """file_id, extraction: insufficient_data for empty files, failed, unsupported without a type, complete up to `whole` bytes, partial beyond."""
    status = F.when(F.col("status") == "empty", "insufficient_data").when(F.col("status").isin(*failed), "failed").when(F.col("detected_type").isNull(), "unsupported").when(F.col("file_size") <= whole, "complete").otherwise("partial")
    return inspected.select("file_id", status.alias("extraction"))


def classification_status(files: DataFrame) -> DataFrame:
    """file_id, status, labels, review: nothing classifies files by topic, and every record says so."""
    return files.select("file_id", F.lit("insufficient_evidence").alias("status"), F.array().cast("array<string>").alias("labels"), F.lit("pending").alias("review"))


def status_counts(inspected: DataFrame) -> DataFrame:
    """status, category, format, n: counts by each of the three alone, in one pass; the other two are null."""
    seen = inspected.select("status", "category", F.col("detected_type").alias("format"))
    return seen.groupingSets([[F.col("status")], [F.col("category")], [F.col("format")]], "status", "category", "format").agg(F.count("*").alias("n"))


def catalog_totals(inspected: DataFrame) -> DataFrame:
    """One row: files, those told by a signature, those to review (no plain text). An empty table: zeros."""
    count = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    return inspected.agg(F.count("*").alias("total"), count(F.col("confidence") == "signature").alias("signatures"), count(F.col("detected_type") != "text").alias("review"))


def schema_groups(files: DataFrame, columns: list[str], limit: int = 200) -> DataFrame:
    """The `limit` most frequent combinations of type and schema columns, with n; null is a value of its own, ties go by the columns."""
    return files.groupBy(*columns).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), *columns).limit(limit)


def score_rollup(rows: DataFrame, key: str, value: str, review_below: float) -> DataFrame:
    """Per key: words, the mean score to two places, halves up, and whether it needs review. Scores count in whole hundredths, so that the order of rows can't change a mean."""
    cents = F.sum(F.round(F.col(value) * 100).cast("long")) / F.count(value)
    return rows.groupBy(key).agg(F.count(value).alias("words"), (F.floor(cents + 0.5) / 100).alias("score"), F.when(cents < review_below * 100, "needs_review").otherwise("sampled").alias("status"))
