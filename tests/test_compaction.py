"""Compaction of the index: equal rows before, during and after, and no dead ones left."""

import os

import pytest
from pyspark.sql import functions as F

from loomgraph.store import Store


def put(store, spark, version, *files):
    """One run of an index: (repo, file, chunks), with no chunks for a deleted file."""
    chunks = [(f, k, f"{f} {version} {k}", "h", r, "code") for r, f, n in files for k in range(n)]
    rows = spark.createDataFrame(
        chunks, "file_path string, chunk_index int, chunk_text string, content_hash string, repo_id string, source string"
    )
    if chunks:
        store.append_chunks(rows, version)
    log = [(f, "h" if n else None, r, "code") for r, f, n in files]
    store.append_log(spark.createDataFrame(log, "file_path string, content_hash string, repo_id string, source string"), version)


def texts(frame):
    return sorted(r.chunk_text for r in frame.select("chunk_text").collect())


def test_compaction(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    put(store, spark, 1, ("a", "x.ts", 3), ("a", "y.ts", 2), ("b", "x.ts", 1))
    put(store, spark, 2, ("a", "x.ts", 2))
    put(store, spark, 3, ("a", "y.ts", 0))
    before = {repo: texts(store.live_chunks(repo)) for repo in "ab"}
    assert before == {"a": ["x.ts 2 0", "x.ts 2 1"], "b": ["x.ts 1 0"]}
    opened = store.live_chunks("a")

    # It dies after the chunks: the old generation is still the one that is read.
    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as patched:
        patched.setattr(type(spark.range(1).write), "partitionBy", dies)
        with pytest.raises(KeyboardInterrupt):
            store.compact()
    assert store.generation() == 0 and texts(store.live_chunks("a")) == before["a"]

    new = store.compact()
    assert store.generation() == new
    assert {repo: texts(store.live_chunks(repo)) for repo in "ab"} == before and texts(opened) == before["a"]
    assert spark.read.parquet(f"{tmp_path}/chunks-{new}").count() == 3
    assert spark.read.parquet(f"{tmp_path}/file_log-{new}").count() == 2

    put(store, spark, 9, ("b", "x.ts", 2), ("a", "z.ts", 1))
    assert texts(store.live_chunks("b")) == ["x.ts 9 0", "x.ts 9 1"]
    assert texts(store.live_chunks("a")) == [*before["a"], "z.ts 9 0"]
    assert store.drop_old_generations() == ["chunks", "file_log"] and not os.path.exists(tmp_path / "chunks")
    assert texts(store.live_chunks("a")) == [*before["a"], "z.ts 9 0"]


def test_a_writer_in_between_stops_it(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    put(store, spark, 1, ("a", "x.ts", 1))
    read = store._read
    reads = []

    def grows(name, columns):
        reads.append(name)
        if reads.count("file_log") == 2:
            put(Store(spark, str(tmp_path)), spark, 2, ("a", "y.ts", 1))
        return read(name, columns)

    monkeypatch.setattr(store, "_read", grows)
    with pytest.raises(RuntimeError):
        store.compact()
    monkeypatch.undo()
    assert store.generation() == 0
    assert store.live_chunks("a").where(F.col("file_path") == "y.ts").count() == 1
