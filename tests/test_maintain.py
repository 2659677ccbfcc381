"""Delta maintenance of the graph against full rebuilds."""

import os
import random
import subprocess

from pyspark.sql import functions as F

from loomgraph.operators import depgraph, maintain
from tests.test_workspace import workspace, write

NAMES = ["a", "b", "sub/c", "sub/d/index"]
ENDINGS = [".ts", ".tsx", ".js", ".jsx"]


def test_possible_bases_invert_candidates(spark):
    bases = ["x/a", "x/a.js", "x/a.b", "a", "a.ts", ".hidden", "a/index", "x/.js", "a.jsx"]
    tried = spark.createDataFrame([(b,) for b in bases], "base string").select(
        "base", F.explode(depgraph.candidate_paths(F.col("base"))).alias("path")).where("path IS NOT NULL")
    back = tried.select("base", maintain.possible_bases(F.col("path")).alias("found")).collect()
    assert back and all(r.base in r.found for r in back)
    paths = ["x/a.ts", "x/a/index.tsx", "a.js", "b.css", "b", "x/b.jsx"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string").select(
        "path", F.explode(maintain.possible_bases(F.col("path"))).alias("base"))
    rows = rows.select("path", depgraph.candidate_paths(F.col("base")).alias("tried")).collect()
    assert all(r.path in r.tried for r in rows)


def tables(space):
    out = {}
    for name, key in (("import_edges", "source"), ("exports", "file_path"), ("import_targets", "base"),
                      ("co_changes", "file_a"), ("co_change_counts", "file_a"), ("graph_files", "file_path")):
        out[name] = sorted(map(str, space._table(name).orderBy(key).collect()))
    return out


def test_updates_equal_rebuilds(spark, tmp_path):
    """A series of random edits, some committed: files that come, go, change, or take over an import."""
    draw, root = random.Random(8), tmp_path / "t"

    def git(*args):
        subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *args],
                       check=True, capture_output=True)

    def edit():
        for _ in range(draw.randint(1, 4)):
            path = draw.choice(NAMES) + draw.choice(ENDINGS)
            if draw.random() < 0.3 and (root / path).exists():
                os.remove(root / path)
            else:
                lines = [f"import {{ x{k} }} from '{draw.choice(['./', '../', './sub/'])}{draw.choice(['a', 'b', 'c', 'd', 'a.js'])}'"
                         for k in range(draw.randint(0, 3))]
                write(root, path, "\n".join([*lines, f"export const v{draw.randint(0, 9)} = 1\n"]))

    write(root, "a.ts", "import { b } from './b'\nexport const a = b\n")
    git("init", "-q")
    git("add", ".")
    git("commit", "-q", "-m", "0")
    graph = {"symbols_enabled": False, "co_change_min_count": 2}
    kept = workspace(spark, root, tmp_path / "kept", **graph)
    kept.repo.code_globs[:] = ["**/*.ts", "**/*.tsx", "**/*.js", "**/*.jsx"]
    assert kept.update_graph() and not kept.update_graph()
    for step in range(2):
        edit()
        if step != 1:
            git("add", "-A", ".")
            git("commit", "-q", "--allow-empty", "-m", str(step))
        assert kept.update_graph() in (True, False)
        full = workspace(spark, root, tmp_path / f"full{step}", **graph)
        full.repo.code_globs[:] = kept.repo.code_globs
        full.build_graph()
        assert tables(kept) == tables(full), step


def test_counts_add_up(spark):
    old = spark.createDataFrame([("a", "b", 2), ("a", "c", 1)], "file_a string, file_b string, count long")
    new = spark.createDataFrame([("a", "b", 1), ("b", "c", 1)], "file_a string, file_b string, count long")
    got = {tuple(r) for r in maintain.updated_counts(old, new).collect()}
    assert got == {("a", "b", 3), ("a", "c", 1), ("b", "c", 1)}
