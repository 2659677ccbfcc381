import pytest
from pyspark.sql import functions as F

from loomgraph.functions.text import in_words
from loomgraph.store import TABLES, NotBuilt
from tests.test_workspace import workspace, write


def rows_of(space, name):
    rows = space.store.table(name, space.repo.repo_id)
    return sorted(repr(r) for r in rows.collect())


def test_graph_goes_out_as_json_and_comes_back_whole(spark, tmp_path):
    root, other = tmp_path / "a", tmp_path / "b"
    write(root, "one.ts", "export interface Shape { x: number }\nexport function area(s: Shape) { return s.x; }\n")
    write(root, "two.ts", 'import { area } from "./one";\nexport const twice = () => area({ x: 2 });\n')
    write(root, "ü \"quoted\".ts", 'import { area } from "./one";\nexport const again = () => area({ x: 3 });\n')
    write(other, "else.ts", "export const nothing = 1;\n")
    space, target = workspace(spark, root, tmp_path / "s1"), workspace(spark, other, tmp_path / "s2", "b")
    folder = str(tmp_path / "graph")
    with pytest.raises(NotBuilt):
        space.export_graph(folder)
    space.build()
    space.export_graph(folder)
    assert len(rows_of(space, "import_edges")) == 2

    target.import_graph(folder)
    for name in TABLES:
        assert rows_of(target, name) == rows_of(space, name), name
    found = target.query_symbol("one.ts::area")["incoming"].collect()
    assert {r.id for r in found} == {"two.ts::twice", 'ü "quoted".ts::again'}


def test_a_broken_export_leaves_the_graph_as_it_was(spark, tmp_path):
    root = tmp_path / "a"
    write(root, "one.ts", "export const one = 1;\n")
    space = workspace(spark, root, tmp_path / "store")
    space.build()
    folder = tmp_path / "graph"
    space.export_graph(str(folder))
    before = {name: rows_of(space, name) for name in TABLES}
    write(folder, "symbol_edges/part-x.json", '{"src": "a", "dst"\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        space.import_graph(str(folder))
    assert {name: rows_of(space, name) for name in TABLES} == before


def test_names_are_sorted_as_words(spark):
    names = ["B.ts", "a.ts", "é.ts", "b.ts", "A.ts", "f.ts", "e.ts"]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r.name for r in rows.orderBy(*in_words("name")).collect()] == [
        "a.ts", "A.ts", "b.ts", "B.ts", "e.ts", "é.ts", "f.ts",
    ]
    assert rows.orderBy(*in_words("name")).select(F.col("name")).schema["name"].dataType.simpleString() == "string"
