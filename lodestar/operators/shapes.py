"""Nested schemas of semi-structured records: paths, types, required keys, fingerprints, violations."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.bounded import normalized_names
from lodestar.functions.values import type_union
from lodestar.operators.profile import column_profile, observed_types, proposed_types
from lodestar.sources.sinks import kept

# The schemas' dialect, and what the three candidates are for.
DIALECT = "https://json-schema.org/draft/2020-12/schema"
PURPOSES = {
    "faithful": "Preserve source columns and observed native types",
    "analytics": "Propose tidy columns, typed measures, missing-value and date handling",
    "semantic": "Describe the unit of observation and analytical field roles",
}
INFERENCE = "sampled hypothesis; not an enforced data contract"
TRANSFORM = "proposed; originals and sample values are unchanged"

def json_type(value: Column) -> Column:
    """null, boolean, integer, number, string, object or array of a VARIANT; a missing value (SQL null) has none."""
    kind = F.substring(F.schema_of_variant(value), 1, 3)
    return F.when(value.isNull(), F.lit(None)).when(kind == "BIG", "integer").when(kind == "STR", "string").when(kind == "OBJ", "object").when(kind == "ARR", "array").when(kind == "VOI", "null").when(kind == "BOO", "boolean").when(kind.isin("DEC", "DOU", "FLO"), "number").otherwise("string")


def canonical_json(value: Column) -> Column:
    """Compact JSON of a VARIANT, keys sorted at every level, arrays in order."""
    return F.to_json(value)


def paths(df: DataFrame, value: str, depth: int = 5) -> DataFrame:
    """One row per (path, parent, key, level, type) with n, over all records of a VARIANT column.

    One scan: every level is exploded beside its parent, and a node is counted on its first descendant's row only. The
    counts are combined before the only shuffle. `[]` marks array items; `$` is the root; keys that are empty or
    hold a dot, bracket, quote or backslash are quoted as in JSON; null records are left out. Levels below
    `depth` are not entered.
    """
    spark = df.sparkSession
    cur = df.where(F.col(value).isNotNull()).select(F.col(value).alias("_v0"), F.lit("$").alias("_p0"))
    for i in range(1, depth + 1):
        step = spark.tvf.variant_explode_outer(F.col(f"_v{i - 1}").outer()).toDF("_pos", "_key", "_value")
        special = (F.col("_key") == "") | F.regexp_like("_key", F.lit(r'[.\[\]"\\]'))
        name = F.when(F.col("_pos").isNull(), F.lit(None)).when(F.col("_key").isNull(), F.concat(f"_p{i - 1}", F.lit("[]"))).otherwise(F.concat(f"_p{i - 1}", F.lit("."), F.when(special, _quoted(F.col("_key"))).otherwise(F.col("_key"))))
        cur = cur.lateralJoin(step, how="left").select(*[c for c in cur.columns if c != f"_v{i - 1}"], json_type(F.col(f"_v{i - 1}")).alias(f"_t{i - 1}"), F.col("_pos").alias(f"_i{i}"), F.col("_key").alias(f"_k{i}"), name.alias(f"_p{i}"), F.col("_value").alias(f"_v{i}"))
    cur = cur.withColumn(f"_t{depth}", json_type(F.col(f"_v{depth}")))
    nodes = []
    for i in range(depth + 1):
        first = F.col(f"_p{i}").isNotNull()
        for j in range(i + 1, depth + 1):
            first = first & (F.coalesce(f"_i{j}", F.lit(0)) == 0)
        parent, key = (F.col(f"_p{i - 1}"), F.col(f"_k{i}")) if i else (F.lit(None).cast("string"), F.lit(None).cast("string"))
        nodes.append(F.when(first, F.struct(F.col(f"_p{i}").alias("path"), parent.alias("parent"), key.alias("key"), F.lit(i).alias("level"), F.col(f"_t{i}").alias("type"))))
    return cur.select(F.inline(F.array_compact(F.array(*nodes)))).groupBy("path", "parent", "key", "level", "type").agg(F.count("*").alias("n"))


def path_table(df: DataFrame, value: str, depth: int = 5) -> DataFrame:
    """paths() written down, one row per path: steps, types (sorted, number absorbs integer), n, objects (how many of the n are objects), counts (by type).

    steps are the keys from the root, in order, those of array items behind all names. The records are read once, however often what is made of the table is used; it is as large as the schema.
    """
    found = paths(df, value, depth).groupBy("path", "parent", "key", "level")
    tokens = F.regexp_extract_all("path", F.lit(r'\[\]|\.("(?:[^"\\]|\\.)*"|[^.\[]*)'), F.lit(0))
    plain = lambda t: F.when(t.startswith('."'), F.get(F.from_json(F.concat(F.lit("["), F.substring(t, 2, F.length(t)), F.lit("]")), "array<string>"), 0)).otherwise(F.substring(t, 2, F.length(t)))
    steps = F.transform(tokens, lambda t: F.struct((t == "[]").alias("item"), F.when(t == "[]", "").otherwise(plain(t)).alias("key"))).alias("steps")
    each = found.agg(type_union(F.collect_set("type")).alias("types"), F.sum("n").alias("n"), F.sum(F.when(F.col("type") == "object", F.col("n")).otherwise(0)).alias("objects"), F.array_sort(F.collect_list(F.struct("type", "n"))).alias("counts"))
    return kept(each.select("*", steps))


def nested_schema(df: DataFrame, value: str, depth: int = 5) -> DataFrame:
    """path, types (sorted, number absorbs integer), n, required: whether every object at the parent path has the key; with steps and level. Runs a job while it is built."""
    return _required(path_table(df, value, depth)).select("path", "types", "n", "required", "steps", "level")


def _required(table: DataFrame) -> DataFrame:
    owners = table.select(F.col("path").alias("_owner"), F.col("objects").alias("_of"))
    out = table.join(owners, F.col("parent") == F.col("_owner"), "left")
    return out.withColumn("required", F.col("key").isNotNull() & (F.col("n") == F.coalesce("_of", F.lit(-1)))).drop("_owner", "_of")


def nested_document(df: DataFrame, value: str, depth: int = 5) -> DataFrame:
    """One row: schema (canonical compact JSON: keys sorted at every level), fields, and fingerprint, its SHA-256.

    A node has its type (a sorted list if there are several), an object's properties, required keys (if any) and
    additionalProperties, an array's items, merged over all arrays ({} if none has any). What lies deeper than `depth`
    levels is {}. The path table is folded from the deepest level up: each level's nodes are joined into their parents'
    documents by one grouping of schema-sized rows. No records: no row. Runs a job while it is built.
    """
    table = _required(path_table(df, value, depth + 1))
    docs = table.where(F.col("level") == depth + 1).select("parent", "key", "required", F.lit("{}").alias("doc"))
    for level in range(depth, -1, -1):
        entry = F.struct("key", F.concat(_quoted(F.col("key")), F.lit(":"), F.col("doc")).alias("text"))
        inside = docs.groupBy(F.col("parent").alias("_path")).agg(
            F.array_sort(F.collect_list(F.when(F.col("key").isNotNull(), entry))).alias("_keys"),
            F.array_sort(F.collect_list(F.when(F.col("required"), F.col("key")))).alias("_needed"),
            F.max(F.when(F.col("key").isNull(), F.col("doc"))).alias("_items"),
        )
        here = table.where(F.col("level") == level).join(inside, F.col("path") == F.col("_path"), "left")
        is_object, is_array = F.col("objects") > 0, F.array_contains("types", "array")
        properties = F.concat(F.lit('"properties":{'), F.array_join(F.transform(F.coalesce("_keys", F.array().cast("array<struct<key:string,text:string>>")), lambda x: x["text"]), ","), F.lit("}"))
        needed = F.when(F.size("_needed") > 0, F.concat(F.lit('"required":'), F.to_json("_needed")))
        parts = [F.when(is_object, F.lit('"additionalProperties":true')), F.when(is_array, F.concat(F.lit('"items":'), F.coalesce("_items", F.lit("{}")))), F.when(is_object, properties), F.when(is_object, needed), F.concat(F.lit('"type":'), _type_of(F.col("types")))]
        if level == 0:
            parts = [F.concat(F.lit('"$schema":'), F.lit(json.dumps(DIALECT))), *parts]
        docs = here.select("parent", "key", "required", F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("doc"))
    fields = table.where(F.col("level") <= depth).agg(F.count("*").alias("fields"))
    return docs.select(F.col("doc").alias("schema"), F.sha2("doc", 256).alias("fingerprint")).join(F.broadcast(fields))  # one row each


def field_tree(schema: DataFrame, depth: int = 8, limit: int = 250) -> DataFrame:
    """nested_schema() rows depth first, keys in order, array items behind them, at most `limit`: path, level, type text, required."""
    text = F.when(F.size("types") == 1, F.col("types")[0]).otherwise(F.array_join("types", " | "))
    return schema.where(F.col("level") <= depth).orderBy("steps").limit(limit).select("path", "level", text.alias("type"), "required")


def violations(df: DataFrame, value: str, schema: DataFrame, depth: int = 5) -> DataFrame:
    """path, problem, n: value types the schema doesn't declare and required keys that objects lack; none if all fits. Runs a job while it is built."""
    table = path_table(df, value, depth)
    found = table.select("path", F.inline("counts"))
    declared = schema.select("path", F.col("types").alias("_types"))
    seen = found.join(declared, "path", "left")
    fits = F.array_contains("_types", F.col("type")) | ((F.col("type") == "integer") & F.array_contains("_types", "number"))
    bad = seen.where(F.col("_types").isNull() | ~fits).select("path", F.when(F.col("_types").isNull(), "undeclared").otherwise(F.concat(F.lit("type "), "type")).alias("problem"), "n")
    objects = table.where("objects > 0").select(F.col("steps").alias("_owner"), F.col("objects").alias("_of"))
    present = table.select(F.col("path").alias("_path"), F.col("n").alias("_has"))
    need = schema.where("required").select("path", F.slice("steps", 1, F.greatest(F.size("steps") - 1, F.lit(0))).alias("_at"))
    need = need.join(objects, F.col("_at") == F.col("_owner")).join(present, F.col("path") == F.col("_path"), "left")
    lacking = (F.col("_of") - F.coalesce("_has", F.lit(0))).alias("n")
    return bad.unionByName(need.select("path", F.lit("missing").alias("problem"), lacking).where("n > 0"))


def _quoted(value: Column) -> Column:
    """A string as JSON."""
    return F.regexp_replace(F.to_json(F.array(value)), r"(?s)^\[|\]$", "")


def _type_of(types: Column) -> Column:
    return F.when(F.size(types) == 1, _quoted(F.get(types, 0))).otherwise(F.to_json(types))


def schema_candidates(df: DataFrame, columns: list[str] | None = None, family: str = "tabular") -> DataFrame:
    """candidate, purpose, schema: three JSON Schemas of a table.

    faithful keeps source names and native types with their counts; analytics has plain distinct names, types read from
    the values and the format of dates; semantic adds each field's role and whether it may be a key. Fields are in the
    order of their names; a table without rows has none. Built from aggregates of one row per column.
    """
    names = columns or df.columns
    proposed = F.create_map(*[F.lit(x) for pair in zip(names, normalized_names(names)) for x in pair])
    native = observed_types(df, names).groupBy("column").agg(F.array_sort(F.collect_list(F.struct("native", "n"))).alias("native"))
    each = column_profile(df, names, family).join(native, "column").join(proposed_types(df, names).drop("types"), "column")
    counts = F.array_join(F.transform("native", lambda x: F.concat(_quoted(x["native"]), F.lit(":"), x["n"].cast("string"))), ",")
    dated = F.when(F.col("format").isNotNull(), F.concat(F.lit(',"format":'), _quoted(F.col("format")))).otherwise("")
    faithful = F.concat(_quoted(F.col("column")), F.lit(':{"type":'), _type_of(type_union(F.transform("native", lambda x: x["native"]))), F.lit(',"x-observed-types":{'), counts, F.lit("}}"))
    tidy = F.concat(_quoted(F.element_at(proposed, F.col("column"))), F.lit(':{"type":'), _type_of(F.split("types", ",")), F.lit(',"x-source-column":'), _quoted(F.col("column")), F.lit(f',"x-transform":{json.dumps(TRANSFORM)}'), dated, F.lit("}"))
    role = F.concat(_quoted(F.col("column")), F.lit(':{"role":'), _quoted(F.col("role")), F.lit(',"candidate_key":'), F.col("candidate_key").cast("string"), F.lit("}"))
    listed = lambda text: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("column", text.alias("t")))), lambda x: x["t"]), ",")
    one = each.agg(listed(faithful).alias("f"), listed(tidy).alias("a"), listed(role).alias("r"))
    head = json.dumps({"$schema": DIALECT, "type": "object", "additionalProperties": True, "required": [], "x-inference": INFERENCE}, separators=(",", ":"))[:-1] + ',"properties":{'
    semantic = F.concat(F.lit(head), "f", F.lit('},"x-content-family":'), _quoted(F.lit(family)), F.lit(',"x-field-roles":{'), "r", F.lit("}}"))
    out = one.select(F.concat(F.lit(head), "f", F.lit("}}")).alias("faithful"), F.concat(F.lit(head), "a", F.lit("}}")).alias("analytics"), semantic.alias("semantic"))
    purpose = F.element_at(F.create_map(*[F.lit(x) for pair in PURPOSES.items() for x in pair]), F.col("candidate"))
    return out.unpivot([], list(PURPOSES), "candidate", "schema").select("candidate", purpose.alias("purpose"), "schema")


def schema_catalog(files: DataFrame, shapes: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Files (sha256) with shapes (sha256, fingerprint): fingerprint, files, and the smallest hash as representative; a page of those with most files first if limited."""
    groups = files.join(shapes.where("fingerprint is not null"), "sha256").groupBy("fingerprint").agg(F.count("*").alias("files"), F.min("sha256").alias("representative"))
    return groups if limit is None else groups.orderBy(F.col("files").desc(), "fingerprint").offset(offset).limit(limit)


def shape_count(items: DataFrame, files: DataFrame, shapes: DataFrame) -> DataFrame:
    """Batch items (batch_id, file_id) -> batch_id, shapes: distinct fingerprints of the batch's files."""
    seen = items.join(files.select("file_id", "sha256"), "file_id").join(shapes, "sha256").select("batch_id", "fingerprint").distinct()
    return seen.groupBy("batch_id").agg(F.count("fingerprint").alias("shapes"))


def policy_key(version: str, options: dict) -> Column:
    """The cache key of a reader version and its options: equal options in any order give equal keys."""
    return F.sha2(F.lit(json.dumps({"options": options, "version": version}, sort_keys=True, separators=(",", ":"))), 256)


def public_record(catalogue: DataFrame, internal: list[str]) -> DataFrame:
    """A catalogue with `analysis` (JSON) for showing: internal columns go, names and fingerprint come out of the JSON."""
    at = F.get_json_object
    out = catalogue.select("*", F.coalesce(at("analysis", "$.source_filename"), "original_name").alias("source_filename"), at("analysis", "$.mapped_name").alias("mapped_name"), at("analysis", "$.schema_fingerprint").alias("schema_fingerprint"))
    return out.drop("analysis", *internal)
