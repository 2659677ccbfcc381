"""Change bursts: events of a stream closer together than a gap form one re-index pass."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

QUIET_SECONDS = 5
STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Times are microseconds, as the state hands back dates without their zone.
_BURST = "first_ts long, last_ts long, n_events long"


def change_bursts(
    events: DataFrame, stream: str, ts: str = "ts", quiet_seconds: int = QUIET_SECONDS,
    unit: str = "hour",
) -> DataFrame:
    """(stream, first_ts, last_ts, n_events) per burst; a longer pause than the gap ends it.

    Two events in a window as long as the gap are always in one burst, so events are first
    counted per such window, with map-side aggregation; raw events are never sorted. Windows
    are put together per time `unit` (at least the gap long). Only a unit's first and last burst
    can run on into the next unit; those few are joined up in a second step.
    """
    gap = F.expr(f"INTERVAL {quiet_seconds} SECONDS")
    length = F.expr(f"INTERVAL 1 {unit.upper()}")
    counted = (
        events.select(F.col(stream).alias("_stream"), F.col(ts).alias("_ts"))
        .groupBy("_stream", F.window("_ts", f"{quiet_seconds} seconds").alias("_w"))
        .agg(
            F.min("_ts").alias("first_ts"), F.max("_ts").alias("last_ts"),
            F.count(F.lit(1)).alias("n_events"),
        )
        .withColumn("_unit", F.date_trunc(unit, "_w.start").cast(events.schema[ts].dataType))
    )
    parts = _joined_up(counted.drop("_w"), ["_stream", "_unit"], gap).withColumn(
        "_at_edge",
        (F.col("first_ts") <= F.col("_unit") + gap + gap)
        | (F.col("last_ts") + gap >= F.col("_unit") + length),
    ).drop("_unit")
    inner = parts.where(~F.col("_at_edge")).drop("_at_edge")
    edge = _joined_up(parts.where("_at_edge").drop("_at_edge"), ["_stream"], gap)
    return inner.unionByName(edge).withColumnRenamed("_stream", stream)


def _joined_up(parts: DataFrame, keys: list[str], gap: Column) -> DataFrame:
    """Parts (first_ts, last_ts, n_events) of the same keys, those within the gap as one."""
    order = Window.partitionBy(*keys).orderBy("first_ts")
    opens = F.coalesce(F.col("first_ts") > F.lag("last_ts").over(order) + gap, F.lit(True))
    return (
        parts.withColumn("_opens", opens.cast("int"))
        .withColumn("_burst", F.sum("_opens").over(order))
        .groupBy(*keys, "_burst")
        .agg(
            F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
            F.sum("n_events").alias("n_events"),
        )
        .drop("_burst")
    )


def streaming_bursts(
    events: DataFrame, stream: str, ts: str = "ts", quiet_seconds: int = QUIET_SECONDS,
    lateness: str = "1 minute",
) -> DataFrame:
    """The same bursts over an unbounded stream, each emitted once it is over."""
    return (
        events.withWatermark(ts, lateness)
        .groupBy(stream, F.session_window(ts, f"{quiet_seconds} seconds").alias("_w"))
        .agg(
            F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
            F.count(F.lit(1)).alias("n_events"),
        )
        .select(stream, "first_ts", "last_ts", "n_events")
    )


class _TrailingEdge(StatefulProcessor):
    """One open burst per stream, and a timer that each event of it sets anew."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.burst = handle.getValueState("burst", _BURST + ", due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        first, last, count, due = self.burst.get() if self.burst.exists() else (None, None, 0, None)
        for row in rows:
            first = row.first_ts if first is None else min(first, row.first_ts)
            last = row.last_ts if last is None else max(last, row.last_ts)
            count += row.n_events
        if due is not None:
            self.handle.deleteTimer(due)
        due = timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms
        self.handle.registerTimer(due)
        self.burst.update((first, last, count, due))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        first, last, count, _ = self.burst.get()
        self.burst.clear()
        yield Row(stream=key[0], first_ts=first, last_ts=last, n_events=count)

    def close(self) -> None:
        pass


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last time and number of events per stream of a batch."""
    for batch in batches:
        table = pa.Table.from_batches([batch]).group_by("stream", use_threads=False)
        made = table.aggregate([("ts", "min"), ("ts", "max"), ("ts", "count")])
        made = made.select(["stream", "ts_min", "ts_max", "ts_count"])
        yield from made.rename_columns(["stream", "first_ts", "last_ts", "n_events"]).to_batches()


def settled_bursts(events: DataFrame, stream: str, ts: str = "ts", quiet_seconds: float = QUIET_SECONDS) -> DataFrame:
    """(stream, first_ts, last_ts, n_events) of each burst, `quiet_seconds` after its last event came.

    No later event is needed: a timer on the clock ends a burst, and every event sets it anew.
    Open bursts and their timers are in the query's checkpoint, so after a restart they go on, and
    one that fell due in between fires at once. Times are those of arrival; `ts` is only reported.
    Events without a stream make a burst of their own; those without a time do not count.

    Events are counted per stream before the shuffle, so a stream with most of them sends a few
    rows per task. The session needs `spark.sql.streaming.stateStore.providerClass` set to
    STATE_PROVIDER.
    """
    if events.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass") != STATE_PROVIDER:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {STATE_PROVIDER}")
    kind = events.schema[stream].dataType.simpleString()
    slim = events.select(F.col(stream).alias("stream"), F.unix_micros(F.col(ts).cast("timestamp")).alias("ts"))
    # After a restart Spark starts no batch before there is new data, and timers need batches: a
    # second stream ticks, none of whose rows goes any further.
    ticks = events.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load().where("value < 0")
    slim = slim.unionByName(ticks.select(F.lit(None).cast(kind).alias("stream"), F.col("value").alias("ts")))
    counted = slim.where("ts IS NOT NULL").mapInArrow(_counted, f"stream {kind}, {_BURST}")
    ended = (
        counted.groupBy("stream")
        .transformWithState(
            _TrailingEdge(int(quiet_seconds * 1000)), f"stream {kind}, {_BURST}", "Append", "ProcessingTime"
        )
    )
    times = [F.timestamp_micros(c).alias(c) for c in ("first_ts", "last_ts")]
    return ended.select(F.col("stream").alias(stream), *times, "n_events")
