"""What the plans must keep: pushed work, bounded groups, and parsing once."""

import re

import pytest

import __spark_entry__ as spark_entry
from loomgraph.functions.text import content_hash
from loomgraph.operators import cochange, depgraph
from loomgraph.plans import corpus
from loomgraph.sources.files import list_paths, scan_store, scan_tree
from loomgraph.streaming.debounce import streaming_bursts
from pyspark.sql import functions as F

SF_DIR = "/root/testdata/sf0.001"


def plan_of(frame, capsys):
    capsys.readouterr()
    frame.explain()
    return capsys.readouterr().out


def test_commit_sizes_are_cut_before_the_shuffle(spark, capsys):
    plan = plan_of(cochange.co_change_pairs(corpus.part_history(spark, SF_DIR)), capsys)
    partial, final = (plan.index(f"row_number(), 21, {w}") for w in ("Partial", "Final"))
    assert final < plan.index("Exchange", final) < partial
    assert "Join" not in plan


def test_search_keeps_the_best_per_task_and_reads_needed_columns(spark, capsys):
    plan = plan_of(spark_entry.queries()["search_code"](spark, SF_DIR), capsys)
    assert "TakeOrderedAndProject(limit=20" in plan and "Exchange" not in plan
    plan = plan_of(spark_entry.queries()["content_hash"](spark, SF_DIR), capsys)
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "Exchange" not in plan


def test_files_are_parsed_once(spark, capsys):
    outlined = depgraph.with_outline(corpus.code_files(spark, SF_DIR))
    plan = plan_of(depgraph.import_statements(outlined), capsys)
    assert len(re.findall(r"ArrowEvalPython", plan)) == 1


@pytest.mark.parametrize("name", ["semantic_overlay", "partition_waves", "partition_warnings",
                                  "co_change_pairs", "import_edges", "symbol_edges_calls"])
def test_no_cross_joins(spark, capsys, name):
    plan = plan_of(spark_entry.queries()[name](spark, SF_DIR), capsys)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_both_scanners(spark, tmp_path):
    for path, data in {
        "a.ts": b"one", "x/b.ts": b"\xff two", "x/c.js": b"", "node_modules/d.ts": b"no",
        "x/_e.ts": b"hidden from listings", "deep/1/2/3/4/f.ts": b"six",
    }.items():
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(data)
    walked = scan_tree(spark, str(tmp_path), ["**/*.ts"], ["node_modules"]).collect()
    texts = {r["file_path"]: r["content"] for r in walked}
    assert texts == {"a.ts": "one", "x/b.ts": "� two", "x/_e.ts": "hidden from listings",
                     "deep/1/2/3/4/f.ts": "six"}
    assert len(walked) == 4 and all(r["mtime"] > 1_600_000_000_000 for r in walked)
    listed = scan_store(spark, str(tmp_path), ["**/*.ts"], ["node_modules"]).collect()
    assert {r["file_path"]: r["content"] for r in listed} == {
        k: v for k, v in texts.items() if "_e" not in k
    }
    assert list_paths(spark, str(tmp_path)).count() == 6
    hashed = scan_tree(spark, str(tmp_path), ["a.ts"]).select(content_hash(F.col("content")))
    assert hashed.first()[0].startswith("7692c3ad3540")


def test_streaming_bursts(spark, tmp_path):
    rows = [("code", f"2024-01-01 00:00:{s:02}") for s in (1, 4, 9, 20)]
    rows += [("docs", "2024-01-01 00:00:02"), ("docs", "2024-01-01 01:00:00")]
    frame = spark.createDataFrame(rows, "stream string, t string").select(
        "stream", F.to_timestamp("t").alias("ts")
    )
    for i, part in enumerate((frame.where("ts < '2024-01-01 00:30:00'"), frame.where("ts > '2024-01-01 00:30:00'"))):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    events = (
        spark.readStream.schema("stream string, ts timestamp").option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    )
    query = (
        streaming_bursts(events, "stream", quiet_seconds=5).writeStream.format("memory")
        .queryName("bursts").option("checkpointLocation", str(tmp_path / "c"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    assert query.exception() is None
    got = spark.table("bursts").selectExpr("stream", "second(first_ts) a", "second(last_ts) b", "n_events")
    assert sorted(tuple(r) for r in got.collect()) == [
        ("code", 1, 9, 3), ("code", 20, 20, 1), ("docs", 2, 2, 1),
    ]
