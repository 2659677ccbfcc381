"""Changes of a tree as a stream, and bursts that end by the clock, both across restarts."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from loomgraph.sources.changes import TreeChangeReader, split_tree, tree_changes
from loomgraph.streaming.debounce import settled_bursts
from loomgraph.streaming.watch import watch_trees
from tests.test_workspace import workspace


def write(root, path, text="x"):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w") as file:
        file.write(text)


@pytest.fixture
def run(spark, tmp_path):
    """Starts the query anew each time, as after a stop; returns the rows of all runs so far."""
    root, out = tmp_path / "tree", tmp_path / "out"
    root.mkdir()

    def once():
        rows = tree_changes(
            spark, str(root), ["**/*.ts"], str(tmp_path / "state"), ["node_modules/"], interval_seconds=0.001
        )
        query = (
            rows.writeStream.format("parquet").option("path", str(out))
            .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
        )
        query.awaitTermination(120)
        seen = spark.read.schema("source string, file_path string, op string, ts timestamp").parquet(str(out)).collect()
        return sorted((r.file_path, r.op) for r in seen)

    return str(root), once


def test_changes_across_restarts(run):
    root, once = run
    for path in ("a.ts", "b/c.ts", "b/d.ts", "b/node_modules/x.ts", "b/note.md"):
        write(root, path)
    want = [("a.ts", "add"), ("b/c.ts", "add"), ("b/d.ts", "add")]
    assert once() == sorted(want)
    write(root, "a.ts", "longer")
    os.unlink(os.path.join(root, "b/d.ts"))
    write(root, "new/deep/e.ts")
    want += [("a.ts", "change"), ("b/d.ts", "unlink"), ("new/deep/e.ts", "add")]
    assert once() == sorted(want)
    assert once() == sorted(want)
    # A part's whole folder goes, and a folder comes in its place.
    os.unlink(os.path.join(root, "b/c.ts"))
    os.rename(os.path.join(root, "b"), os.path.join(root, "z"))
    write(root, "z/f.ts")
    want += [("b/c.ts", "unlink"), ("z/f.ts", "add")]
    assert once() == sorted(want)


def test_a_batch_run_again_tells_the_same(tmp_path):
    root, state = str(tmp_path / "t"), str(tmp_path / "s")
    write(root, "a.ts")
    options = {"root": root, "state": state, "globs": json.dumps(["**/*.ts"]), "interval": "0.001"}
    reader = TreeChangeReader(options)
    first = reader.latestOffset()
    read = lambda r, old, new: [(p, op) for part in r.partitions(old, new) for p, op, _ in r.read(part)]
    assert read(reader, {"version": 0}, first) == [("a.ts", "add")]
    write(root, "b.ts")
    again = TreeChangeReader(options)
    assert read(again, {"version": 0}, first) == [("a.ts", "add")]
    time.sleep(0.01)
    second = again.latestOffset()
    assert second["version"] > first["version"]
    assert read(again, first, second) == [("b.ts", "add")] == read(reader, first, second)
    again.commit(second)
    assert {v for _, v in again._kept()} == {second["version"]}
    with pytest.raises(FileNotFoundError):
        read(again, first, {"version": second["version"] + 1})


def test_split_is_bounded(tmp_path):
    for i in range(20):
        for j in range(20):
            (tmp_path / f"d{i}" / f"e{j}").mkdir(parents=True)
    assert len(split_tree(str(tmp_path))) == 21
    assert len(split_tree(str(tmp_path), 1000)) == 421


def test_bursts_end_by_the_clock(spark, tmp_path):
    """Events in micro-batches make one burst, told once, after a stop in between and without a later event."""
    folder, out = tmp_path / "events", tmp_path / "bursts"
    folder.mkdir()

    def start():
        events = spark.readStream.schema("source string, ts timestamp").json(str(folder))
        return (
            settled_bursts(events, "source", quiet_seconds=25).writeStream.format("parquet")
            .option("path", str(out)).option("checkpointLocation", str(tmp_path / "ckpt"))
            .trigger(processingTime="500 milliseconds").start()
        )

    def put(name, rows):
        with open(tmp_path / name, "w") as file:
            file.writelines(json.dumps({"source": s, "ts": t}) + "\n" for s, t in rows)
        os.rename(tmp_path / name, folder / name)

    def read(query):
        sources = [source for p in query.recentProgress for source in p["sources"]]
        return sum(source["numInputRows"] for source in sources if "FileStream" in source["description"])

    def told():
        if not out.exists():
            return []
        rows = spark.read.schema("source string, first_ts timestamp, last_ts timestamp, n_events long").parquet(str(out))
        return sorted(tuple(r) for r in rows.select(
            "source", F.date_format("first_ts", "ss"), F.date_format("last_ts", "ss"), "n_events").collect())

    put("1.json", [("code", "2024-01-01 00:00:03"), ("code", "2024-01-01 00:00:01"), ("docs", "2024-01-01 00:00:02")])
    query = start()
    deadline = time.time() + 120
    while read(query) < 3 and time.time() < deadline:
        time.sleep(0.2)
    put("2.json", [("code", "2024-01-01 00:00:09")])
    while read(query) < 4 and time.time() < deadline:
        time.sleep(0.2)
    query.stop()
    query = start()
    while len(told()) < 2 and time.time() < deadline + 60:
        time.sleep(0.5)
    time.sleep(2)
    query.stop()
    assert told() == [("code", "01", "09", 3), ("docs", "02", "02", 1)]


def test_watched_trees_are_indexed(spark, tmp_path):
    root = tmp_path / "w"
    write(str(root), "a.ts", "export const a = 1\n")
    space = workspace(spark, root, tmp_path / "store", symbols_enabled=False)
    query = watch_trees(space, str(tmp_path / "watch"), quiet_seconds=2, interval_seconds=1)
    try:
        for change, want in ((None, {"a.ts"}), ("b.ts", {"a.ts", "b.ts"}), ("-a.ts", {"b.ts"})):
            if change and change[0] == "-":
                os.unlink(root / change[1:])
            elif change:
                write(str(root), change, "import { a } from './a'\nexport const b = a\n")
            deadline = time.time() + 120
            while live(space) != want and time.time() < deadline and query.isActive:
                time.sleep(1)
            assert live(space) == want
        assert query.exception() is None
    finally:
        query.stop()


def live(space):
    return {r[0] for r in space.store.live_chunks("a", "code").select("file_path").collect()}
