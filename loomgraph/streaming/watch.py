"""Re-index on change events with Structured Streaming."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomgraph.engine import SOURCES, Workspace
from loomgraph.sources.changes import DEFAULT_INTERVAL_SECONDS, tree_changes
from loomgraph.streaming.debounce import QUIET_SECONDS, settled_bursts

EVENT_SCHEMA = "source string, file_path string, op string, ts timestamp"
REMOVED = "unlink"


def change_events(spark: SparkSession, folder: str) -> DataFrame:
    """Stream of (source, file_path, op, ts) from JSON files dropped into `folder`."""
    return spark.readStream.schema(EVENT_SCHEMA).json(folder)


def apply_changes(workspace: Workspace, batch: DataFrame) -> None:
    """Take removed files out at once, then bring each touched source up to date."""
    # Read several times below, and a batch of a stream is computed anew each time.
    events = batch.where(F.col("source").isin(*SOURCES)).checkpoint()
    touched = [r["source"] for r in events.select("source").distinct().collect()]
    removed = events.where(F.col("op") == REMOVED)
    if not removed.isEmpty():
        workspace.delete_files(removed)
    for source in touched:
        workspace.index(source)
    if "code" in touched:
        workspace.update_graph()


def watch(
    workspace: Workspace, events: DataFrame, checkpoint: str, quiet: str = "5 seconds", **trigger
) -> StreamingQuery:
    """Run `apply_changes` on the events of each interval.

    All events of an interval make one pass, and batches follow one another, so none is lost
    while a pass runs. Every pass compares a fresh scan with the index, which makes it safe to
    repeat after a failure.
    """
    return (
        events.writeStream.foreachBatch(lambda batch, _: apply_changes(workspace, batch))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": quiet}))
        .start()
    )


def workspace_changes(workspace: Workspace, state: str, interval_seconds: float = DEFAULT_INTERVAL_SECONDS) -> DataFrame:
    """Stream of (source, file_path, op, ts) of all trees of a workspace; `state` is a shared folder."""
    streams = []
    for source in SOURCES:
        root, globs, skip = workspace.tree(source)
        streams.append(
            tree_changes(workspace.spark, root, globs, f"{state}/{source}", skip, source, interval_seconds)
        )
    return reduce(DataFrame.unionByName, streams)


def apply_bursts(workspace: Workspace, bursts: DataFrame) -> None:
    """Bring the sources of ended bursts up to date. A pass compares listings, so it can be repeated."""
    touched = {r["source"] for r in bursts.select("source").distinct().collect()}
    for source in SOURCES:
        if source in touched:
            workspace.index(source)
    if "code" in touched:
        workspace.update_graph()


def watch_trees(
    workspace: Workspace, folder: str, quiet_seconds: float = QUIET_SECONDS,
    interval_seconds: float = DEFAULT_INTERVAL_SECONDS,
) -> StreamingQuery:
    """Watch a workspace's trees; a source is indexed once its changes have paused for the quiet time.

    `folder`, shared by driver and executors, holds the query's checkpoint and the listings. All
    changes until the pause make one pass, also those made while an earlier pass runs.
    """
    events = workspace_changes(workspace, f"{folder}/listings", interval_seconds)
    bursts = settled_bursts(events, "source", quiet_seconds=quiet_seconds)
    return (
        bursts.writeStream.foreachBatch(lambda batch, _: apply_bursts(workspace, batch))
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(processingTime=f"{max(int(interval_seconds * 1000), 1)} milliseconds")
        .start()
    )
