"""Uploads in parts as a stream: completions told once, stale finalizers found by timers."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestar.sources.sinks import shared_folder

#: Columns of an event: open (size), part (part, bytes, etag), finalizing and completed.
EVENTS = "upload_id long, kind string, size long, part long, bytes long, etag string"
#: The state store that such processors need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Uploads whose ids differ in their last bits only share a state, which is read and written once for all of them: 2 ** 5 at most.
GROUP_BITS = 5
#: Of a group: id, size, told, due time of a timer and number of parts of each upload; then the parts of all, one upload after the other.
_STATE = "ids array<long>, of array<long>, told array<boolean>, due array<long>, counts array<int>, parts array<long>, sizes array<long>, acknowledged array<boolean>"
_TOLD = "upload_id long, event string, size long"


def uploads(chunk: int, stale_seconds: int) -> StatefulProcessor:
    """The processor; its class is made here so that it travels to workers by value, which need not have this package."""

    class Uploads(StatefulProcessor):
        """State of a group of uploads: of each its size, the parts that arrived, whether it is complete, and when it is stale while it is finalizing."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle, self.state = handle, handle.getValueState("uploads", _STATE)

        def _load(self) -> dict:
            """Per upload: [size, told, due, {part: (bytes, acknowledged)}]."""
            found = self.state.get()
            if not found:
                return {}
            parts = iter(zip(*found[5:]))
            return {i: [size, told, due, {p: (n, ok) for p, n, ok in islice(parts, count)}] for i, size, told, due, count in zip(*found[:5])}

        def _save(self, group: dict) -> None:
            sizes, told, due, kept = zip(*group.values())
            parts = [(p, n, ok) for of in kept for p, (n, ok) in of.items()]
            columns = [list(c) for c in zip(*parts)] if parts else [[], [], []]
            self.state.update((list(group), list(sizes), list(told), list(due), [len(of) for of in kept], *columns))

        def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
            group, touched, timer = self._load(), {}, None
            for i, kind, of, part, n, etag, _ in rows:
                if i not in touched:
                    touched[i] = group.setdefault(i, [None, False, None, {}])
                one = touched[i]
                if kind == "open" and of is not None:
                    one[0] = of if one[0] is None else one[0]
                elif kind == "part" and not one[1] and part is not None:
                    if not one[3].get(part, (0, False))[1]:
                        one[3][part] = (n or 0, bool(etag and etag.strip()))
                elif kind == "finalizing":
                    one[2] = timer = timerValues.getCurrentProcessingTimeInMs() + stale_seconds * 1000
                elif kind == "completed":
                    one[2] = None
            if timer is not None:
                self.handle.registerTimer(timer)
            whole = [i for i, (size, told, _, parts) in touched.items() if not told and size is not None and self._whole(size, parts)]
            for i in whole:
                group[i][1], group[i][3] = True, {}
            self._save(group)
            for i in whole:
                yield Row(upload_id=i, event="complete", size=group[i][0])

        def _whole(self, size: int, parts: dict) -> bool:
            n = -(-size // chunk)
            return len(parts) == n and set(parts) == set(range(1, n + 1)) and all(ok for _, ok in parts.values()) and sum(b for b, _ in parts.values()) == size

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            """Tells those that are due; a timer of an upload that was completed or claimed again since finds none."""
            group, at = self._load(), expiredTimerInfo.getExpiryTimeInMs()
            stale = [i for i, one in group.items() if one[2] is not None and one[2] <= at]
            for i in stale:
                group[i][2] = None
            if stale:
                self._save(group)
            for i in stale:
                yield Row(upload_id=i, event="stale", size=group[i][0])

        def close(self) -> None:
            pass

    return Uploads()


def upload_events(events: DataFrame, chunk: int, stale_seconds: int = 120) -> DataFrame:
    """A stream of EVENTS -> (upload_id, event, size): complete and stale, each when it happens, once.

    A part with a tag that isn't blank is acknowledged; its first tag and size stay. An upload is complete as soon as
    parts 1 to n are acknowledged, no others are there and their bytes are the size; the parts are forgotten then. Parts
    may come in any order, again, or before the upload is opened. A finalizer that isn't completed within stale_seconds
    of processing time is told stale by a timer, and its upload may be claimed again. Needs STORE as the state store.
    """
    rows = events.select("upload_id", "kind", "size", "part", "bytes", "etag", F.shiftright("upload_id", GROUP_BITS).alias("group"))
    return rows.groupBy("group").transformWithState(uploads(chunk, stale_seconds), _TOLD, "Append", "ProcessingTime")


def run_uploads(events: DataFrame, chunk: int, path: str | None = None, stale_seconds: int = 120) -> DataFrame:
    """Run upload_events() over what has arrived and append what it tells; returns the table. A second run with the same path goes on from the state of the first.

    Timers fire with the next micro-batch that has data: with batches without data, a run that takes what is there would
    never end, since a timer may always be due later.
    """
    spark = events.sparkSession
    path = path or shared_folder(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    out = upload_events(events, chunk, stale_seconds)
    run = out.writeStream.format("parquet").option("path", f"{path}/table").option("checkpointLocation", f"{path}/progress").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/table")


def part_events(parts: DataFrame) -> DataFrame:
    """Parts (upload_id, size, part, etag, bytes) as EVENTS: a part each, and the opening of its upload beside the first."""
    opened = parts.groupBy("upload_id").agg(F.max("size").alias("size")).selectExpr("upload_id", "'open' AS kind", "size", "CAST(NULL AS LONG) AS part", "CAST(NULL AS LONG) AS bytes", "CAST(NULL AS STRING) AS etag")
    each = parts.select("upload_id", F.lit("part").alias("kind"), F.lit(None).cast("long").alias("size"), "part", "bytes", "etag")
    return each.unionByName(opened)


def stream_of(spark: SparkSession, table: DataFrame, path: str) -> DataFrame:
    """A table written to a folder and read back as a stream."""
    table.write.mode("append").parquet(path)
    return spark.readStream.schema(table.schema).parquet(path)
