"""Values made small enough to show, text from bytes of unknown encoding, names made plain."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.content import is_readable


def safe_value(value: Column, kind: T.DataType, depth: int = 0) -> Column:
    """A value within bounds: 5 levels, 200 items, 512 keys of 256 characters, 2,048 characters; bytes become size and hex; NaN null."""
    if depth > 5:
        return F.lit("depth_limit")
    if isinstance(kind, T.StringType):
        return F.substring(value, 1, 2048)
    if isinstance(kind, T.BinaryType):
        return F.struct(F.octet_length(value).alias("size"), F.lower(F.hex(F.substring(value, 1, 32))).alias("hex"))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(value), value)
    if isinstance(kind, T.ArrayType):
        return F.transform(F.slice(value, 1, 200), lambda x: safe_value(x, kind.elementType, depth + 1))
    if isinstance(kind, T.MapType):
        entries = F.slice(F.map_entries(value), 1, 512)
        return F.transform(entries, lambda e: F.struct(F.substring(e["key"].cast("string"), 1, 256).alias("key"), safe_value(e["value"], kind.valueType, depth + 1).alias("value")))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[safe_value(value[f.name], f.dataType, depth + 1).alias(f.name) for f in kind.fields[:512]]))
    return value


def safe_values(df: DataFrame) -> DataFrame:
    return df.select(*[safe_value(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


@F.pandas_udf(T.StringType())
def _compatible(names: pd.Series) -> pd.Series:
    return names.map(lambda n: None if n is None else unicodedata.normalize("NFKC", n))


def normalized_name(name: Column) -> Column:
    """Compatibility form, lower case, runs of other than letters, marks, digits and _ become one _, none at the ends; column if nothing is left. Only names with characters beyond ASCII leave the JVM."""
    plain = F.when(F.regexp_like(name, F.lit(r"^\p{ASCII}*\z")), name).otherwise(_compatible(F.when(~F.regexp_like(name, F.lit(r"^\p{ASCII}*\z")), name)))
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(plain)), r"[^\p{L}\p{M}\p{N}_]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit("column"))


def distinct_normalized_names(df: DataFrame, group: list[str], name: str, order: str) -> DataFrame:
    """Adds proposed: the normalised name, distinct inside the group; repeats get _2, _3, ... until they are free, in order of `order`.

    A group is the header of one file: its names meet in one list.
    """
    each = df.withColumn("_n", normalized_name(F.col(name)))

    def add(acc: Column, named: Column) -> Column:
        free = F.filter(F.transform(F.sequence(F.lit(2), F.size(acc) + 2), lambda k: F.concat(named, F.lit("_"), k.cast("string"))), lambda x: ~F.array_contains(acc, x))
        return F.array_append(acc, F.when(F.array_contains(acc, named), F.get(free, 0)).otherwise(named))

    rest = [c for c in df.columns if c not in group]
    listed = each.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), "_n", *[F.col(c).alias(f"_c{i}") for i, c in enumerate(rest)]))).alias("_l"))
    names = F.aggregate(F.transform("_l", lambda x: x["_n"]), F.array().cast("array<string>"), add)
    paired = F.arrays_zip(F.col("_l").alias("row"), names.alias("proposed"))
    out = listed.select(*group, F.inline(paired).alias("_row", "proposed"))
    return out.select(*group, *[F.col(f"_row._c{i}").alias(c) for i, c in enumerate(rest)], "proposed")


def normalized_names(names: list[str]) -> list[str]:
    """Column names in compatibility form, plain and distinct: repeats get _2, _3, ..."""
    out: list[str] = []
    for name in names:
        plain = "".join(c if c == "_" or unicodedata.category(c)[0] in "LMN" else " " for c in unicodedata.normalize("NFKC", name).strip().lower())
        base = "_".join(plain.split()).strip("_") or "column"
        k, free = 2, base
        while free in out:
            free, k = f"{base}_{k}", k + 1
        out.append(free)
    return out


@F.pandas_udf(T.StringType())
def _other_encodings(content: pd.Series) -> pd.Series:
    def one(raw):
        if raw is None:
            return None
        for bom, codec in ((b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
            if raw.startswith(bom):
                break
        else:
            codec = "gb18030"
        try:
            return codec + ":" + bytes(raw).decode(codec)
        except UnicodeDecodeError:
            return None

    return content.map(one)


def decode_text(content: Column) -> Column:
    """Struct (text, encoding) of bytes; both null if they are no readable text or null.

    A byte order mark decides first; bytes with NUL are no text; then UTF-8, then GB18030. Only values that are not plain
    UTF-8 leave the JVM.
    """
    marked = F.hex(F.substring(content, 1, 2)).isin("FFFE", "FEFF") | (F.hex(F.substring(content, 1, 4)) == "0000FEFF")
    eight = F.hex(F.substring(content, 1, 3)) == "EFBBBF"
    plain = F.try_validate_utf8(F.when(eight, F.substring(content, 4, 2147483647)).otherwise(content).cast("string"))
    nul = F.contains(F.decode(content, "ISO-8859-1"), F.lit("\u0000"))
    native = F.when(~marked & ~nul, plain)
    native = F.when(is_readable(native), native)
    other = _other_encodings(F.when(marked | (native.isNull() & ~nul), content))
    text = F.coalesce(native, F.regexp_replace(other, "^[^:]*:", ""))
    code = F.when(native.isNotNull(), F.when(eight, "utf-8-sig").otherwise("utf-8")).otherwise(F.regexp_extract(other, "^([^:]*):", 1))
    good = text.isNotNull() & is_readable(text)
    return F.struct(F.when(good, text).alias("text"), F.when(good, code).alias("encoding"))
