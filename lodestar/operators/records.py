"""Records out of JSON texts and lines, windows of texts, sources merged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.shapes import json_type

#: The keys under which an envelope holds its list, in the order of their precedence.
ENVELOPE_KEYS = ["records", "rows", "data", "events", "items"]


def as_record(value: Column) -> Column:
    """A VARIANT as a record: objects as they are, anything else as {"value": it}; a missing value stays missing."""
    return F.when(json_type(value) == "object", value).when(value.isNotNull(), F.to_variant_object(F.named_struct(F.lit("value"), value)))


def is_jsonl(text: Column) -> Column:
    """More than one line that is not blank, and the first three of them open an object. Null texts are none."""
    lines = F.filter(F.split(text, r"\r\n|\r|\n", -1), lambda x: F.trim(x) != "")
    return F.coalesce((F.size(lines) > 1) & F.forall(F.slice(lines, 1, 3), lambda x: F.ltrim(x).startswith("{")), F.lit(False))


def read_jsonl(files: DataFrame) -> DataFrame:
    """(file_id, content) -> file_id, line_no, record, malformed: a row per line that is not blank.

    Lines are numbered from 0, blank ones counted. A malformed line keeps its row, without a record; values that are no
    objects are wrapped. Texts that are no JSON lines, empty and null ones give no rows.
    """
    lines = files.where(is_jsonl(F.col("content"))).select("file_id", F.posexplode(F.split("content", r"\r\n|\r|\n", -1)).alias("line_no", "_line"))
    parsed = lines.where(F.trim("_line") != "").withColumn("_v", F.try_parse_json("_line"))
    return parsed.select("file_id", "line_no", as_record(F.col("_v")).alias("record"), F.col("_v").isNull().alias("malformed"))


def json_envelope(text: Column) -> Column:
    """The records of a JSON text, as an array of VARIANT: the items of a list, or of an object's first list under one of
    ENVELOPE_KEYS; any other value is one record. Items that are no objects are wrapped. Null for what is no JSON.
    """
    v = F.try_parse_json(text)
    inside = [F.when(json_type(F.try_variant_get(v, f"$.{k}", "variant")) == "array", F.try_variant_get(v, f"$.{k}", "array<variant>")) for k in ENVELOPE_KEYS]
    whole = F.when(json_type(v) == "array", F.try_variant_get(v, "$", "array<variant>"))
    return F.transform(F.coalesce(*inside, whole, F.when(v.isNotNull(), F.array(v))), as_record)


def flatten_records(df: DataFrame, value: str) -> DataFrame:
    """A row per key of a VARIANT object, with its value as JSON text; other columns stay. What is no object, and null, gives no row."""
    spark, rest = df.sparkSession, [F.col(c) for c in df.columns if c != value]
    only = df.withColumn(value, F.when(json_type(F.col(value)) == "object", F.col(value)))
    return only.lateralJoin(spark.tvf.variant_explode(F.col(value).outer()).toDF("_pos", "_key", "_value")).select(*rest, F.col("_key").alias("key"), F.to_json("_value").alias("value"))


def text_windows(df: DataFrame, text: str, size: int = 2048) -> DataFrame:
    """A row per window of `size` characters, window_no from 0; the column holds the window. Empty and null texts have no window."""
    last = F.ceil(F.length(text) / size) - 1
    each = df.where(F.length(text) > 0).withColumn("window_no", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return each.withColumn(text, F.substring(F.col(text), (F.col("window_no") * size + 1).cast("int"), F.lit(size)))


def bounded_prefix(content: Column, limit: int = 65536) -> Column:
    """The first `limit` bytes, whatever character they end in, and the true size of it all; null content: null both."""
    raw = content.cast("binary")
    return F.struct(F.substring(raw, 1, limit).alias("prefix"), F.octet_length(raw).cast("long").alias("size"))


def merge_sources(sources: list[DataFrame], key: str) -> DataFrame:
    """The keys of several sources, each once, with the number (from 1) of the first source that has it; null is a key."""
    each = [df.select(key, F.lit(i).alias("source_index")) for i, df in enumerate(sources, 1)]
    return reduce(DataFrame.unionByName, each).groupBy(key).agg(F.min("source_index").alias("source_index"))
