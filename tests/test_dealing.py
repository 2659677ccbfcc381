"""Joins on keys that very many rows share, and joins that Spark would broadcast by its estimates."""

from collections import Counter
from itertools import combinations
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as spark_entry
from loomgraph.functions.outline import _tokens
from loomgraph.operators import cochange, depgraph, symbols, waves
from loomgraph.operators import dealing
from loomgraph.operators.dealing import key_counts, matched, stored
from loomgraph.plans import corpus, queries

ROWS = [("a", i) for i in range(900)] + [("b", 1), ("b", 1), ("c", 2), (None, 3), (None, 3)]
TABLE = [("a", "x"), ("a", "y"), ("b", "z"), ("d", "w"), (None, "v")]


@pytest.mark.parametrize("how", ["inner", "left_semi", "left_anti"])
def test_matched_is_the_plain_join(spark, how):
    rows = spark.createDataFrame(ROWS, "k string, n int").localCheckpoint()
    table = spark.createDataFrame(TABLE, "k string, v string")
    plain = Counter(map(tuple, rows.join(table, "k", how).collect()))
    for key_rows in (10, 1000):
        assert Counter(map(tuple, matched(rows, table, ["k"], how, key_rows).collect())) == plain


def test_a_hot_key_goes_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr("loomgraph.operators.dealing.dealt", lambda rows, n, *keys: rows.repartition(40, *keys))
    rows = spark.createDataFrame(ROWS, "k string, n int").localCheckpoint()
    table = spark.createDataFrame([("a", "x")], "k string, v string")
    found = matched(rows, table, ["k"], key_rows=10).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r[1] for r in found) == 900 and max(r[1] for r in found) < 200


def test_key_counts(spark):
    many = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("k"))
    assert {tuple(r) for r in key_counts(many, 60_000, ["k"]).collect()} == {("a", 20_000), ("b", 20_000)}
    rows = spark.createDataFrame(ROWS, "k string, n int")
    assert {tuple(r) for r in key_counts(rows, len(ROWS), ["k"]).collect()} == {("a", 900), ("b", 2), ("c", 1)}


def test_symbols_and_paths_are_not_broadcast(spark, capsys):
    files = [("lib.ts", "export class Area { size() {} }")] + [
        (f"u{i}.ts", "import { Area } from './lib';\nimport './none';\nexport const a = new Area();") for i in range(20)
    ]
    files = spark.createDataFrame(files, "file_path string, content string")
    outlined = depgraph.with_outline(files).checkpoint()
    nodes, paths = symbols.symbol_nodes(outlined), files.select("file_path")
    edges = symbols.symbol_edges(outlined, nodes, paths)
    assert edges.count() == 20
    for frame in (edges, symbols.incoming(edges, nodes, "Area"), depgraph.import_edges(outlined, paths)):
        capsys.readouterr()
        frame.explain()
        assert "Broadcast" not in capsys.readouterr().out


@pytest.mark.parametrize("name", ["query_symbol_in", "query_symbol_out", "symbol_edges_grouped", "symbol_edges_heritage"])
def test_symbol_queries_broadcast_nothing(spark, capsys, name):
    found = spark_entry.queries()[name](spark, "/root/testdata/sf0.001")
    capsys.readouterr()
    found.explain()
    assert "Broadcast" not in capsys.readouterr().out


def test_touches_are_dealt_by_their_number(spark, capsys):
    touches = corpus.module_touches(spark, "/root/testdata/sf0.001")
    for frame in (touches, waves.file_issues(touches, ["batch"]), waves.conflicts_of(touches, [1], ["batch"])):
        capsys.readouterr()
        frame.explain()
        plan = capsys.readouterr().out
        assert "REPARTITION_BY_NUM" in plan and "Broadcast" not in plan


def test_waves_are_planned_in_tasks_by_the_number_of_rows(spark, capsys, monkeypatch):
    real, counts = waves.dealt, []
    monkeypatch.setattr(waves, "dealt", lambda rows, n, *keys: counts.append(n) or real(rows, n, *keys, task_rows=100))
    rows = [(b, i, f"f{i % 7}") for b in range(50) for i in range(20)]
    planned = waves.waves(spark.createDataFrame(rows, "batch int, issue int, file string"), ["batch"])
    capsys.readouterr()
    planned.explain()
    assert "REPARTITION_BY_NUM" in capsys.readouterr().out and counts == [1000]
    assert planned.rdd.getNumPartitions() == 10
    assert {(r["issue"], r["wave"]) for r in planned.collect()} == {(i, i // 7) for i in range(20)}


def test_pairs_are_counted_in_tasks_by_the_number_of_rows(spark, capsys, monkeypatch):
    monkeypatch.setattr(cochange, "TASK_ROWS", 100)
    commits = {c: [f"f{(c * 7 + i) % 50}" for i in range(c % 6)] + ["hot1", "hot2"] for c in range(300)}
    commits[300] = [f"g{i}" for i in range(cochange.MAX_FILES)]
    commits[301] = [f"h{i}" for i in range(cochange.MAX_FILES + 1)]
    rows = [(s, c, f) for s in ("x", None) for c, files in commits.items() for f in files]
    rows += [("x", 300, "g0")] * 400 + [("x", None, "f1"), ("x", None, "f2"), ("x", 7, None)]
    frame = spark.createDataFrame(rows, "repo string, commit_id int, file string")
    pairs = cochange.co_change_pairs(frame, 1, ["repo"])
    capsys.readouterr()
    pairs.explain()
    assert capsys.readouterr().out.count("REPARTITION_BY_NUM") == 3
    assert pairs.rdd.getNumPartitions() == -(-cochange.ROW_PAIRS * len(rows) // 100)
    want = Counter()
    for repo in ("x", None):
        for files in commits.values():
            if len(files) <= cochange.MAX_FILES:
                want.update((repo, *pair) for pair in combinations(sorted(files), 2))
    want["x", "f1", "f2"] += 1
    assert {(r["repo"], r["file_a"], r["file_b"]): r["count"] for r in pairs.collect()} == want


def test_scripts_are_parsed_in_tasks_by_the_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(corpus, "PARSED_ROWS", 100)
    orders = corpus.table(spark, "/root/testdata/sf0.001", "orders")
    rows = corpus.dealt(spark, "/root/testdata/sf0.001", "orders", "o_orderkey", "o_custkey")
    tasks = rows.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) > 10 and max(r[1] for r in tasks) < 200
    assert Counter(map(tuple, rows.collect())) == Counter(map(tuple, orders.select("o_orderkey", "o_custkey").collect()))


def test_tokens_of_blanks():
    blank = "a \t b\n \t c \u2028d\t\u2028 e \t"
    assert [w for _, w, _ in _tokens(blank)] == ["a", "b", "c", "d", "e"]
    assert [n for _, _, n in _tokens(blank)] == [0, 0, 1, 1, 1]


@pytest.mark.parametrize("how", ["inner", "left_semi", "left_anti"])
@pytest.mark.parametrize("groups, most", [(2**16, 1000), (1, 1000), (2, 0)])
def test_matched_of_few_and_of_crowded_keys_is_the_plain_join(spark, monkeypatch, how, groups, most):
    monkeypatch.setattr(dealing, "KEY_GROUPS", groups)
    monkeypatch.setattr(dealing, "MOST_GROUPS", most)
    rows = spark.createDataFrame(ROWS, "k string, n int").localCheckpoint()
    table = spark.createDataFrame(TABLE, "k string, v string")
    for left, right in ((rows, table), (table, rows.withColumnRenamed("n", "v")), (table.limit(0), rows), (rows, table.limit(0))):
        plain = Counter(map(tuple, left.join(right, "k", how).collect()))
        for few in (0, 100):
            monkeypatch.setattr(dealing, "FEW_ROWS", few)
            for key_rows in (3, 1000):
                assert Counter(map(tuple, matched(left, right, ["k"], how, key_rows).collect())) == plain


def test_few_keys_are_looked_for_without_a_shuffle_of_the_rest(spark, capsys):
    rows = spark.createDataFrame(ROWS, "k string, n int").localCheckpoint()
    table = spark.createDataFrame(TABLE, "k string, v string")
    for how in ("left_semi", "left_anti"):
        capsys.readouterr()
        matched(rows, table, ["k"], how).explain()
        assert "Exchange" not in capsys.readouterr().out
    capsys.readouterr()
    matched(table, rows, ["k"]).explain()
    plan = capsys.readouterr().out
    assert "k#" in plan and " IN (" in plan


def test_stored_rows_are_the_rows_in_less_room(spark):
    files = spark.range(20_000).select(F.concat(F.lit("src/orders/o"), "id", F.lit(".tsx")).alias("file_path"))
    outlined = files.select("file_path", F.array(*[
        F.struct(F.concat("file_path", F.lit(f"::open{i}")).alias("name"), F.lit(None).cast("string").alias("base"))
        for i in range(3)
    ]).alias("refs"))
    kept = stored(outlined)
    assert kept.schema.simpleString() == outlined.schema.simpleString() and kept.exceptAll(outlined).isEmpty() and kept.count() == 20_000
    assert stored(outlined.limit(0)).count() == 0
    folder = kept.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:")
    size = sum(f.stat().st_size for f in Path(folder).glob("*.parquet"))
    assert size < 20_000 * 20


def test_the_symbol_graph_is_stored_in_columns(spark):
    nodes, edges = queries._symbol_graph(spark, "/root/testdata/sf0.001")
    for frame in (nodes, edges):
        assert frame.inputFiles() and all("/stored-" in f for f in frame.inputFiles())
