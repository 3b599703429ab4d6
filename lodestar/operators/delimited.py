"""Delimited text to rows: delimiter, header, quoted cells, ragged rows. One projection per file; only explode adds rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions.values import numeric_cell
from lodestar.operators.ordered import ranged, sum_in_ranges
from lodestar.sources.sinks import kept

# Delimiters in order of preference.
DELIMITERS = [",", "\t", ";", "|"]
#: Headers, one a file, that are broadcast at most.
HEADERS = 10_000


def sniff_delimiter(content: Column, lines: int = 20) -> Column:
    """The delimiter by which the first rows agree best; null if none stands in the first row and in at least half of the first rows, and two.

    Delimiters inside quotes don't count. Of the candidates, the one with the most rows of its most common width wins,
    then the one that is most frequent in the first row, then the order of DELIMITERS. Null and empty texts have none.
    """
    head = F.filter(F.slice(split_rows(F.substring(content, 1, 65536)), 1, lines), lambda x: F.trim(x) != "")
    least = F.greatest(F.lit(2), F.ceil(F.size(head) / 2))

    def score(rank: int, d: str) -> Column:
        counts = F.transform(head, lambda row: F.size(split_cells(row, F.lit(d))) - 1)
        hits = F.filter(counts, lambda n: n > 0)
        agree = F.array_max(F.transform(F.array_distinct(hits), lambda n: F.size(F.filter(hits, lambda m: m == n))))
        return F.when((F.get(counts, 0) > 0) & (F.size(hits) >= least), F.struct(agree.alias("agree"), F.get(counts, 0).alias("n"), F.lit(-rank).alias("rank"), F.lit(d).alias("delimiter")))

    return F.array_max(F.array_compact(F.array(*[score(i, d) for i, d in enumerate(DELIMITERS)])))["delimiter"]


def split_rows(content: Column) -> Column:
    """Rows of a text; line ends inside quotes belong to their cell, blank rows are left out."""
    return F.regexp_extract_all(content, F.lit(r'(?:[^"\r\n]++|"[^"]*+"?)++'), F.lit(0))


def split_cells(row: Column, delimiter: Column) -> Column:
    """Cells of a row, without their quotes; a doubled quote is one."""
    d = F.concat(F.lit("\\Q"), delimiter, F.lit("\\E"))
    pattern = F.concat(d, F.lit('((?:[^"'), d, F.lit(']++|"[^"]*+"?)*+)'))
    raw = F.regexp_extract_all(F.concat(delimiter, row), pattern, F.lit(1))
    return F.transform(raw, lambda c: F.when(F.startswith(c, F.lit('"')), F.replace(F.regexp_replace(c, r'(?s)^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(c))


def unfinished(content: Column) -> Column:
    """Whether a text that may go on ends inside a row."""
    quotes = F.length(content) - F.length(F.replace(content, F.lit('"'), F.lit("")))
    return (quotes % 2 == 1) | ~F.regexp_like(content, F.lit(r"[\r\n]$"))


def has_header(cells: Column) -> Column:
    return F.exists(cells, lambda c: ~numeric_cell(c))


def distinct_headers(names: Column) -> Column:
    """Blank names become column_i; a repeated name gets _2, _3, ... until it is free."""

    def add(acc: Column, named: Column) -> Column:
        free = F.filter(F.transform(F.sequence(F.lit(2), F.size(acc) + 2), lambda k: F.concat(named, F.lit("_"), k.cast("string"))), lambda x: ~F.array_contains(acc, x))
        return F.array_append(acc, F.when(F.array_contains(acc, named), F.get(free, 0)).otherwise(named))

    named = F.transform(names, lambda c, i: F.when(F.trim(c) == "", F.concat(F.lit("column_"), (i + 1).cast("string"))).otherwise(F.trim(c)))
    return F.aggregate(named, F.array().cast("array<string>"), add)


def read_delimited(files: DataFrame, complete: Column | None = None, delimiter: str | None = None) -> DataFrame:
    """(file_id, content) -> file_id, delimiter, header, names, row_no, cells, record (map), extra_cells, ragged.

    header holds distinct names; names are those of the file as they stand, null where the first row is data.

    A file without delimiter gives no rows. Short rows lack their last keys, long rows keep extra_cells; both are
    ragged. Where `complete` is false, an unfinished last row is left out. A first row of numbers only is data. The
    delimiter is told from the text unless it is given.
    """
    whole = F.lit(True) if complete is None else complete
    rows = split_rows(F.col("content"))
    kept = F.when(whole | ~unfinished(F.col("content")), rows).otherwise(F.slice(rows, 1, F.greatest(F.size(rows) - 1, F.lit(0))))
    each = files.select("file_id", (F.lit(delimiter) if delimiter else sniff_delimiter(F.col("content"))).alias("delimiter"), kept.alias("_rows")).where("delimiter is not null and size(_rows) > 0")
    first = each.withColumn("_first", split_cells(F.col("_rows")[0], F.col("delimiter"))).withColumn("_named", has_header(F.col("_first")))
    unnamed = F.transform("_first", lambda c, i: F.concat(F.lit("column_"), (i + 1).cast("string")))
    first = first.withColumn("names", F.when(F.col("_named"), F.transform("_first", lambda c: F.trim(c))))
    headed = first.withColumn("header", F.when(F.col("_named"), distinct_headers(F.col("_first"))).otherwise(unnamed))
    body = F.when(F.col("_named"), F.slice("_rows", 2, F.greatest(F.size("_rows") - 1, F.lit(0)))).otherwise(F.col("_rows"))
    out = headed.select("file_id", "delimiter", "header", "names", F.posexplode(body).alias("row_no", "_row")).withColumn("cells", split_cells(F.col("_row"), F.col("delimiter")))
    width, n = F.size("header"), F.size("cells")
    both = F.least(width, n)
    return out.select("file_id", "delimiter", "header", "names", "row_no", "cells", F.map_from_arrays(F.slice("header", 1, both), F.slice("cells", 1, both)).alias("record"), F.when(n > width, F.slice("cells", width + 1, n)).alias("extra_cells"), (n != width).alias("ragged"))


def split_records(lines: DataFrame, file: str, order: list[str], line: str) -> DataFrame:
    """Lines of files of any size -> file, record_no (from 0), record: rows of delimited text, whose quoted cells may hold line ends.

    A line begins inside quotes if an odd number of quotes stands before it in its file. Quotes are summed up by ranges of
    the lines' order, ranges by a scan over their sums, so one file is spread over all tasks, and a range knows how it
    begins without reading the ones before. A second sum over the lines that begin outside numbers the records. Rows
    of blanks are left out, a return before a line's end goes, quotes left open at the end of a file close with it.
    """
    quotes = F.length(line) - F.length(F.replace(F.col(line), F.lit('"'), F.lit("")))
    rows = ranged(lines.select(file, *order, F.col(line).alias("_line"), quotes.alias("_quotes")), [file, *order])
    told = sum_in_ranges(rows, [file], order, "_quotes", "_sum")
    inside = (F.col("_sum") - F.col("_quotes")) % 2 == 1
    starts = ~inside & (F.trim(F.regexp_replace("_line", r"\r$", "")) != "")
    told = told.withColumn("_starts", starts.cast("int")).withColumn("_part", starts | inside).drop("_quotes", "_sum")
    placed = sum_in_ranges(told, [file], order, "_starts", "_no").where("_part")
    joined = placed.groupBy(file, "_no").agg(F.array_sort(F.collect_list(F.struct(*order, "_line"))).alias("_l"))  # one record
    text = F.array_join(F.transform("_l", lambda x: x["_line"]), "\n")
    return joined.select(file, (F.col("_no") - 1).cast("long").alias("record_no"), F.regexp_replace(text, r"\r$", "").alias("record"))


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """Text files below a path as lines: file, block (where the range of the file that held it begins), i (rises inside a block), value."""
    read = spark.read.option("lineSep", "\n").text(path)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"), "value")


def read_large_delimited(spark: SparkSession, path: str, delimiter: str | None = None) -> DataFrame:
    """Delimited files below a path -> file, row_no, header, cells, record (map), extra_cells, ragged: read_delimited() for files of any size.

    Spark cuts files into ranges of lines; split_records() puts rows together over the cuts. The first row of a file is its
    header unless it holds numbers only. The delimiter is sniffed from the first rows of each file unless given; files
    without one give no rows.
    """
    records = kept(split_records(lines_of(spark, path), "file", ["block", "i"], "value"))
    heads = records.where("record_no < 20").groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("record_no", "record"))), lambda x: x["record"]).alias("_h"))  # 20 rows
    told = F.lit(delimiter) if delimiter else sniff_delimiter(F.array_join("_h", "\n"))
    heads = heads.select("file", told.alias("delimiter"), F.get("_h", 0).alias("_first")).where("delimiter is not null")
    first = heads.withColumn("_first", split_cells(F.col("_first"), F.col("delimiter"))).withColumn("_named", has_header(F.col("_first")))
    unnamed = F.transform("_first", lambda c, i: F.concat(F.lit("column_"), (i + 1).cast("string")))
    named = first.select("file", "delimiter", "_named", F.when(F.col("_named"), distinct_headers(F.col("_first"))).otherwise(unnamed).alias("header"))
    named = kept(named)
    named = F.broadcast(named) if named.count() <= HEADERS else named
    out = records.join(named, "file").where(~F.col("_named") | (F.col("record_no") > 0)).withColumn("cells", split_cells(F.col("record"), F.col("delimiter")))
    width, n = F.size("header"), F.size("cells")
    both = F.least(width, n)
    row_no = F.col("record_no") - F.col("_named").cast("int")
    return out.select("file", row_no.alias("row_no"), "header", "cells", F.map_from_arrays(F.slice("header", 1, both), F.slice("cells", 1, both)).alias("record"), F.when(n > width, F.slice("cells", width + 1, n)).alias("extra_cells"), (n != width).alias("ragged"))


def numeric_matrix(files: DataFrame) -> DataFrame:
    """(file_id, content) of blank-separated numbers -> file_id, row_no, pos, value; rows with any other cell are left out."""
    rows = files.select("file_id", F.posexplode(F.split("content", r"\r?\n")).alias("row_no", "line")).withColumn("cells", F.split(F.trim("line"), r"\s+"))
    return rows.where(F.forall("cells", lambda c: numeric_cell(c))).select("file_id", "row_no", F.posexplode("cells").alias("pos", "cell")).select("file_id", "row_no", "pos", F.col("cell").try_cast("double").alias("value"))


def tabular_rule(rows: DataFrame) -> DataFrame:
    """read_delimited rows -> file_id, result: pass if the file's own names are neither blank nor repeated and no row is ragged, else fail. A file without names has none to fail."""
    unique = F.col("names").isNull() | ((F.size(F.array_distinct("names")) == F.size("names")) & ~F.array_contains("names", ""))
    return rows.groupBy("file_id").agg(F.when(F.bool_and(unique) & ~F.bool_or("ragged"), "pass").otherwise("fail").alias("result"))


def quality_summary(rows: DataFrame, malformed: DataFrame | None = None) -> DataFrame:
    """read_delimited rows -> file_id, row_count, duplicate_rows, ragged_rows, malformed_lines, warnings (sorted list).

    malformed: rows (file_id, malformed) of JSON lines, whose bad lines are counted; files that only stand there have
    their good lines as rows, which are not compared.

    Two aggregates, the first on (file, row hash), so that the rows of a large file never meet before they are distinct.
    """
    key = F.sha2(F.to_json("cells"), 256)
    once = rows.groupBy("file_id", key.alias("_k")).agg(F.count("*").alias("n"), F.count_if("ragged").alias("r"), F.bool_or(F.coalesce(F.col("names") != F.col("header"), F.lit(False))).alias("named"))
    out = once.groupBy("file_id").agg(F.bool_or("named").alias("_renamed"), F.sum("n").alias("row_count"), (F.sum("n") - F.count("*")).alias("duplicate_rows"), F.sum("r").alias("ragged_rows"))
    if malformed is None:
        out = out.withColumn("malformed_lines", F.lit(0).cast("long"))
    else:
        lines = malformed.groupBy(F.col("file_id").alias("_f")).agg(F.count_if("malformed").alias("malformed_lines"), F.count_if(~F.col("malformed")).alias("_good"))
        met = out.join(lines, F.col("file_id") == F.col("_f"), "full").withColumn("file_id", F.coalesce("file_id", "_f"))
        zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
        out = met.select("file_id", F.coalesce("_renamed", F.lit(False)).alias("_renamed"), F.coalesce("row_count", "_good").alias("row_count"), zero("duplicate_rows"), zero("ragged_rows"), zero("malformed_lines"))
    named = [F.when(F.col(c) > 0, c) for c in ("duplicate_rows", "malformed_lines", "ragged_rows")]
    return out.withColumn("warnings", F.array_compact(F.array(*named, F.when(F.col("_renamed"), "renamed_headers")))).drop("_renamed")
