"""Parts of large files, read by seeking: prefixes, and head, middle and tail windows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.sampling import spread

_WINDOWS = "path string, size long, windows int, window_no int, offset long, data binary"

_SCHEMA = pa.schema([("path", pa.string()), ("size", pa.int64()), ("windows", pa.int32()), ("window_no", pa.int32()), ("offset", pa.int64()), ("data", pa.binary())])


def _plan(size: int, budget: int) -> list[tuple[int, int]]:
    """(offset, width) of the windows of a file."""
    if size <= budget:
        return [(0, size)]
    widths = [budget // 2, budget // 4, budget - budget // 2 - budget // 4]
    offsets = [0, max(0, size // 2 - widths[1] // 2), max(0, size - widths[2])]
    return [(o - o % 4, w) for o, w in zip(offsets, widths)]


def _read(files: DataFrame, plan) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for path, size in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()):
                store, name = fs.FileSystem.from_uri(path)
                parts = plan(size)
                with store.open_input_file(name) as f:
                    rows = [{"path": path, "size": size, "windows": len(parts), "window_no": i, "offset": at, "data": f.read_at(width, at)} for i, (at, width) in enumerate(parts)]
                yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    return files.select(F.col("path").cast("string").alias("path"), F.col("length").cast("long").alias("size")).mapInArrow(run, _WINDOWS)


def read_prefixes(files: DataFrame, limit: int = 65536) -> DataFrame:
    """Files (path, length) -> path, size, windows 1, window_no 0, offset 0, data: their first `limit` bytes; no more is read.

    Paths are URIs of a store that Arrow opens (local or shared folders, HDFS, S3, GCS). A file that is gone fails the task.
    """
    return _read(files, lambda size: [(0, min(size, limit))])


def read_windows(files: DataFrame, budget: int = 65536) -> DataFrame:
    """Files (path, length) -> a row per window: path, size, windows (how many), window_no, offset, data. At most `budget` bytes of a file are read.

    Half of the budget from the start, a quarter around the middle and a quarter at the end; offsets go down to
    multiples of four, so that wide characters are not cut. A file within the budget is one window, an empty one, too.
    """
    return _read(files, lambda size: _plan(size, budget))


def window_lines(windows: DataFrame, encoding: str = "UTF-8") -> DataFrame:
    """path, size, windows, window_no, offset, lines: the lines of each window, without the first and last of later ones, which its bounds may cut; bytes that are no text become U+FFFD."""
    text = F.col("data").cast("string") if encoding == "UTF-8" else F.decode("data", encoding)
    whole = F.make_valid_utf8(text) if encoding == "UTF-8" else text
    lines = F.split(F.regexp_replace(whole, r"(\r\n|\r|\n)\z", ""), r"\r\n|\r|\n", -1)
    inner = F.slice(lines, 2, F.greatest(F.size(lines) - 2, F.lit(0)))
    none = F.array().cast("array<string>")
    return windows.select("path", "size", "windows", "window_no", "offset", F.when(F.length("data") == 0, none).when(F.col("window_no") == 0, lines).otherwise(inner).alias("lines"))


def sample_lines(lines: DataFrame, rows: int = 200) -> DataFrame:
    """window_lines() rows -> path, window_no, line: of each window, rows // windows lines spread evenly over it."""
    n = F.size("lines")
    picks = F.when(F.col("windows") == 1, spread(n, rows)).otherwise(spread(n, max(1, rows // 3)))
    return lines.select("path", "window_no", F.explode(F.transform(picks, lambda i: F.get("lines", i.cast("int")))).alias("line"))
