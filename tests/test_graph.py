import random
import subprocess
from collections import Counter
from itertools import combinations

import pytest

from loomgraph.operators import cochange, depgraph, symbols
from loomgraph.sources.gitlog import GitLogSource, commit_files, head_sha, parse_log_text


def tree(spark, files):
    frame = spark.createDataFrame(list(files.items()), "file_path string, content string")
    return depgraph.with_outline(frame).cache(), frame.select("file_path")


def test_import_resolution_order(spark):
    lines = ["./a", "./dir", "./esm.js", "./view.js", "./own.css", "./both", "./gone", "react", "../out"]
    files = {p: "" for p in (
        "src/a.ts", "src/dir/index.tsx", "src/esm.ts", "src/view.tsx", "src/own.css",
        "src/both.ts", "src/both.js", "src/both/index.ts", "src/odd.js", "src/odd.js.ts",
    )}
    files["src/main.ts"] = "\n".join(f"import '{s}'" for s in [*lines, "./odd.js"])
    edges = depgraph.import_edges(*tree(spark, files)).orderBy("stmt_pos")
    assert [(r["stmt_pos"], r["target"]) for r in edges.collect()] == [
        (0, "src/a.ts"), (1, "src/dir/index.tsx"), (2, "src/esm.ts"), (3, "src/view.tsx"),
        (4, "src/own.css"), (5, "src/both.ts"), (9, "src/odd.js.ts"),
    ]


def test_names_and_consumers(spark):
    files = {
        "t.ts": "export interface T {}\nexport const T = 1\n",
        "u.ts": "export type T = 1\n",
        "a.ts": "import { T as X } from './t'\nimport './t'\nimport D, { T } from './t'\n",
        "b.ts": "import { T } from './u'\nimport * as all from './t'\n",
        "constructor.ts": "import { constructor } from './t'\n",
    }
    outlined, paths = tree(spark, files)
    edges = depgraph.import_edges(outlined, paths).cache()
    assert edges.count() == 6
    named = {(r["source"], r["target"]): r["names"] for r in depgraph.named_imports(edges).collect()}
    assert named == {
        ("a.ts", "t.ts"): ["D", "T"], ("b.ts", "u.ts"): ["T"],
        ("constructor.ts", "t.ts"): ["constructor"],
    }
    by = {(r["target"], r["source"]) for r in depgraph.imported_by(edges).collect()}
    assert by == {("t.ts", "a.ts"), ("t.ts", "b.ts"), ("u.ts", "b.ts"), ("t.ts", "constructor.ts")}
    exported = depgraph.exports(outlined)

    def ask(name):
        return sorted(
            tuple(x or "" for x in r) for r in depgraph.consumers_of(edges, exported, name).collect()
        )

    assert ask("T") == [
        ("consumed", "", "", "a.ts"), ("consumed", "", "", "b.ts"),
        ("defined", "t.ts", "interface", ""), ("defined", "u.ts", "type", ""),
        ("qualified", "t.ts", "", "a.ts"), ("qualified", "u.ts", "", "b.ts"),
    ]
    assert ask("u.ts::T") == [
        ("consumed", "", "", "b.ts"), ("defined", "u.ts", "unknown", ""),
        ("qualified", "u.ts", "", "b.ts"),
    ]
    assert ask("no.ts::T") == [("defined", "no.ts", "unknown", "")]


def walk(edges, start, depth):
    seen, frontier = {}, {start}
    for level in range(1, depth + 1):
        frontier = {b for a, b in edges if a in frontier and b != start and b not in seen}
        seen.update({b: level for b in frontier})
    return seen


def test_traversal_equals_plain_search(spark):
    rng = random.Random(11)
    nodes = [f"n{i}" for i in range(14)]
    edges = {("n0", "n1"), ("n1", "n2"), ("n2", "n0")}
    edges |= {(rng.choice(nodes), rng.choice(nodes)) for _ in range(24)}
    frame = spark.createDataFrame(list(edges), "from_node string, to_node string").cache()
    for start in ("n0", "n5", "absent"):
        for depth in (1, 3, 5):
            got = depgraph.reachable(frame, start, depth).collect()
            assert {r["node"]: r["level"] for r in got} == walk(edges, start, depth)
    with pytest.raises(ValueError):
        depgraph.reachable(frame, "n0", 6)


def test_dependencies_name_direct_edges_only(spark):
    edges = spark.createDataFrame(
        [("a", "b", 0, ["X"]), ("b", "c", 0, ["Y"]), ("c", "a", 0, []), ("d", "a", 0, ["Z"])],
        "source string, target string, stmt_pos int, names array<string>",
    )
    got = depgraph.dependencies(edges, "a", "both", 2).collect()
    assert sorted((r["direction"], r["file"], r["level"], r["names"]) for r in got) == [
        ("importedBy", "b", 2, None), ("importedBy", "c", 1, None), ("importedBy", "d", 1, ["Z"]),
        ("imports", "b", 1, ["X"]), ("imports", "c", 2, None),
    ]


def test_symbol_edges(spark):
    from tests.test_outline import SCENE, SHAPES

    outlined, paths = tree(spark, {"lib/shapes.ts": SHAPES, "app/scene.ts": SCENE})
    nodes = symbols.symbol_nodes(outlined)
    ids = {r["id"] for r in nodes.collect()}
    frame = symbols.symbol_edges(outlined, nodes, paths)
    lib, app = "lib/shapes.ts::", "app/scene.ts::"
    assert {tuple(r) for r in frame.collect()} == {
        (lib + "Box.grow", lib + "Side", "uses-type"),
        (lib + "Box.grow", lib + "Box.note", "calls"),
        (lib + "Box.note", lib + "log", "calls"),
        (app + "Room", lib + "Box", "extends"),
        (app + "Room", lib + "Area", "implements"),
        (app + "Room", lib + "log", "calls"),
        (app + "Room.size", lib + "log", "calls"),
        (app + "Room.size", app + "Room.width", "calls"),
        (app + "measure", lib + "Area", "uses-type"),
        (app + "measure", app + "Room", "calls"),
    }
    assert all(a != b and {a, b} <= ids for a, b, _ in frame.collect())
    out = symbols.outgoing(frame, nodes, "measure").select("kind", "id").collect()
    assert sorted(tuple(r) for r in out) == [("calls", app + "Room"), ("uses-type", lib + "Area")]
    groups = symbols.edge_groups(symbols.incoming(frame, nodes, lib + "Area"), "incoming")
    assert sorted(tuple(r) for r in groups.collect()) == [
        (2, "implemented by", app + "Room"), (3, "used as type by", app + "measure"),
    ]


def test_pairs_equal_plain_counting(spark):
    rng = random.Random(2)
    commits = {c: {f"f{rng.randint(0, 30)}" for _ in range(rng.choice([1, 2, 5, 12]))} for c in range(60)}
    commits[100] = {f"f{i}" for i in range(20)}
    commits[101] = {f"f{i}" for i in range(21)}
    commits[102] = {f"g{i}" for i in range(3000)}
    rows = [(c, f) for c, files in commits.items() for f in files]
    frame = spark.createDataFrame(rows + rows[:50], "commit_id int, file string")
    want = Counter()
    for files in commits.values():
        if 2 <= len(files) <= 20:
            want.update(combinations(sorted(files), 2))
    for least in (1, 2, 3):
        got = {(r["file_a"], r["file_b"]): r["count"]
               for r in cochange.co_change_pairs(frame, least).collect()}
        assert got == {k: n for k, n in want.items() if n >= least}
    pairs = cochange.co_change_pairs(frame, 1)
    got = {(r["other"], r["count"]) for r in cochange.co_changes_of(pairs, "f3", 2).collect()}
    assert got == {
        ((b if a == "f3" else a), n) for (a, b), n in want.items() if "f3" in (a, b) and n >= 2
    }


def test_git_history(spark, tmp_path):
    def git(*args):
        subprocess.run(
            ["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *args],
            check=True, capture_output=True,
        )

    assert head_sha(str(tmp_path)) == ""
    git("init", "-q")
    for i in range(5):
        (tmp_path / "a.ts").write_text(str(i))
        (tmp_path / f"ü {i}.ts").write_text(str(i))
        git("add", "-A")
        git("commit", "-q", "-m", f"c{i}")
    assert len(head_sha(str(tmp_path))) == 40
    rows = commit_files(spark, {"r": str(tmp_path)}, max_commits=4, per_task=3).collect()
    assert len(rows) == 8 and len({r["commit_id"] for r in rows}) == 4
    assert {r["file"] for r in rows} == {"a.ts", *(f"ü {i}.ts" for i in range(1, 5))}
    assert len(commit_files(spark, {"r": str(tmp_path)}, per_task=2).collect()) == 10
    assert commit_files(spark, {"r": str(tmp_path / "none")}).count() == 0

    # A commit made after planning shifts nothing, and a failing git fails the read.
    reader = GitLogSource({"roots": f"r={tmp_path}", "commitspertask": "2"}).reader(None)
    ranges = reader.partitions()
    (tmp_path / "late.ts").write_text("x")
    git("add", "-A")
    git("commit", "-q", "-m", "late")
    found = [row for part in ranges for row in reader.read(part)]
    assert len(found) == 10 and "late.ts" not in {file for _, _, file in found}
    ranges[0].sha = "0" * 40
    with pytest.raises(OSError):
        list(reader.read(ranges[0]))


def test_log_text(spark):
    log = "---COMMIT---\n\n---COMMIT---\na.ts\n  \n b.ts\n---COMMIT---\nc.ts"
    rows = parse_log_text(spark.createDataFrame([(log,)], "log string")).collect()
    assert sorted(tuple(r) for r in rows) == [(0, 0, "a.ts"), (0, 1, " b.ts"), (1, 0, "c.ts")]


def test_bursts(spark):
    from datetime import datetime, timedelta

    from loomgraph.streaming.debounce import change_bursts

    rng = random.Random(4)
    start = datetime(2024, 1, 1, 0, 59, 50)
    rows, now = [], start
    for _ in range(400):
        now += timedelta(milliseconds=rng.choice([500, 4999, 5000, 5001, 9000, 1200_000]))
        rows.append(("code" if rng.random() < 0.9 else "docs", now))
    frame = spark.createDataFrame(rows, "stream string, ts timestamp")
    want = []
    for name in ("code", "docs"):
        times = [t for s, t in rows if s == name]
        first = last = times[0]
        n = 1
        for t in times[1:]:
            if t - last > timedelta(seconds=5):
                want.append((name, first, last, n))
                first, n = t, 0
            last, n = t, n + 1
        want.append((name, first, last, n))
    for unit in ("minute", "hour", "day"):
        got = change_bursts(frame, "stream", quiet_seconds=5, unit=unit)
        assert sorted(tuple(r[c] for c in ("stream", "first_ts", "last_ts", "n_events"))
                      for r in got.collect()) == sorted(want)


def test_walks_from_many_starts(spark):
    """Against a plain walk per start, with loops, a hub cut into slices, and rows of nulls."""
    draw = random.Random(6)
    pairs = {(draw.randrange(60), draw.randrange(60)) for _ in range(110)} | {(7, k) for k in range(60)}
    starts = list(range(0, 60, 3))

    def plainly(start, depth):
        level, found, edge = 0, {start: 0}, {start}
        while edge and (depth is None or level < depth):
            level += 1
            edge = {b for a, b in pairs if a in edge} - set(found)
            found |= dict.fromkeys(edge, level)
        return {(start, node, at) for node, at in found.items() if at}

    edges = spark.createDataFrame([*pairs, (None, 1), (1, None)], "from_node long, to_node long")
    given = spark.createDataFrame([(s,) for s in [*starts, 3, None, 999]], "start long")
    for depth in (1, 2, None):
        got = depgraph.reachable_from(edges, given, depth, slice_edges=8).collect()
        assert len(got) == len(set(got))
        assert {tuple(r) for r in got} == set().union(*(plainly(s, depth) for s in starts))
    assert depgraph.reachable_from(edges, given.limit(0)).count() == 0
