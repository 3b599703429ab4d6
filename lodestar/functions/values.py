"""Types and names of values. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that stand for a missing value.
NULL_WORDS = ["", "null", "none", "na", "n/a", "nan"]
# Patterns of integers, numbers, numeric cells, moments and key names.
_HOUR, _MINUTE = "([01][0-9]|2[0-3])", "[0-5][0-9]"
INTEGER = r"^-?(0|[1-9][0-9]*)$"
NUMBER = r"^[+-]?((0|[1-9][0-9]*)(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
CELL = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
MOMENT = rf"^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([T ]{_HOUR}(:{_MINUTE}(:{_MINUTE}([.,][0-9]+)?)?)?(Z|[+-]{_HOUR}(:?{_MINUTE})?)?)?$"
KEY_NAME = r"(^|_)(id|uuid|key|编号|序号)($|_)"


def stripped(value: Column) -> Column:
    return F.btrim(value, F.lit(" \t\n\x0b\f\r"))


def is_null_word(value: Column) -> Column:
    return F.lower(stripped(value)).isin(NULL_WORDS)


def analytical_type(value: Column) -> Column:
    """null, integer, number, boolean, date, date-time or string; leading zeros keep a value a string."""
    t = stripped(value)
    day = F.try_to_date(F.substring(t, 1, 10), "yyyy-MM-dd").isNotNull()
    moment = F.regexp_like(t, F.lit(MOMENT)) & day
    return F.when(value.isNull() | is_null_word(value), "null").when(F.regexp_like(t, F.lit(INTEGER)), "integer").when(F.regexp_like(t, F.lit(NUMBER)), "number").when(F.lower(t).isin("true", "false"), "boolean").when(moment, F.when(F.length(t) == 10, "date").otherwise("date-time")).otherwise("string")


def numeric_cell(value: Column) -> Column:
    return F.regexp_like(value, F.lit(CELL))


def native_type(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "number"
    if isinstance(kind, (T.StructType, T.MapType)):
        return "object"
    return "array" if isinstance(kind, T.ArrayType) else "string"


def type_union(types: Column) -> Column:
    """Sorted distinct types; number absorbs integer."""
    seen = F.array_distinct(types)
    return F.array_sort(F.when(F.array_contains(seen, "number"), F.array_remove(seen, "integer")).otherwise(seen))


def display_name(name: Column) -> Column:
    """Last path part without control characters, at most 255 characters, else unnamed."""
    last = F.element_at(F.split(F.replace(F.coalesce(name, F.lit("")), F.lit("\\"), F.lit("/")), "/"), -1)
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(last, r"\p{C}", ""), 1, 255), F.lit("")), F.lit("unnamed"))


def safe_name(name: Column) -> Column:
    """The plainer form of display_name: only ASCII control characters go, and the default is unnamed.dat."""
    last = F.element_at(F.split(F.replace(F.coalesce(name, F.lit("")), F.lit("\\"), F.lit("/")), "/"), -1)
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(last, r"[\x00-\x1f\x7f]", ""), 1, 255), F.lit("")), F.lit("unnamed.dat"))


def extension_of(name: Column) -> Column:
    return F.substring(F.lower(F.regexp_extract(name, r"^.+\.([^./\\]*)$", 1)), 1, 32)


def detected_name(name: Column, fmt: Column) -> Column:
    """A .dat name, or one without extension, gets the extension of its detected type."""
    ext = F.when(fmt == "jpeg", "jpg").when(fmt == "gzip", "gz").otherwise(fmt)
    neutral = extension_of(name).isin("", "dat")
    return F.when(neutral & fmt.isNotNull(), F.concat(F.regexp_replace(name, r"(?i)\.dat$", ""), F.lit("."), ext)).otherwise(name)


def unsafe_member(name: Column, mode: Column, encrypted: Column) -> Column:
    """Absolute or drive path, a parent step, a symbolic link or an encrypted entry."""
    path = F.replace(name, F.lit("\\"), F.lit("/"))
    return F.startswith(path, F.lit("/")) | F.regexp_like(path, F.lit("^[A-Za-z]:")) | F.array_contains(F.split(path, "/"), "..") | (mode.bitwiseAND(F.lit(0xF000)) == 0xA000) | encrypted


def expected_parts(size: Column, chunk: int) -> Column:
    return F.ceil(size / chunk).cast("long")


def part_bytes(size: Column, part: Column, chunk: int) -> Column:
    return F.least(F.lit(chunk).cast("long"), size - (part - 1) * chunk)
