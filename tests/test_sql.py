"""The questions of a workspace in SQL, each against the API."""

import pytest

from loomgraph.sql import register_functions
from tests.test_workspace import workspace, write


def test_questions_in_sql(spark, tmp_path):
    root = tmp_path / "p"
    write(root, "base.ts", "export function shared() { return 1; }\nexport interface Shape {}\n")
    write(root, "sub/user.ts", "import { shared, Shape } from '../base';\nexport function use(s: Shape) { return shared(); }\n")
    write(root, "docs/guide.md", "intro\n## Setup\nrun it\n")
    write(root, "notes/n.md", "---\nname: n\ntype: feedback\n---\nkeep it small\n")
    write(root, "notes/u.md", "---\nname: u\ntype: user\n---\nlikes tests\n")
    space = workspace(spark, root, tmp_path / "store")
    space.build()
    names = register_functions(space)
    assert len(names) == 8

    def rows(query):
        return sorted(map(tuple, spark.sql(query).collect()), key=str)

    def api(frame):
        return sorted(map(tuple, frame.collect()), key=str)

    assert rows("SELECT * FROM search_code('shared shape', 2)") == api(space.search_code("shared shape", 2))
    assert rows("SELECT * FROM search_code('shared', file_filter => 'sub/**')") == api(space.search_code("shared", 5, "sub/**"))
    assert rows("SELECT * FROM search_docs('run it', 1)") == api(space.search_docs("run it", 1))
    assert rows("SELECT * FROM search_memory('small', 3, 'user')") == api(space.search_memory("small", 3, "user"))
    assert rows("SELECT * FROM search_wiki('short')") == api(space.search_wiki("short"))
    assert rows("SELECT file, names FROM query_dependencies('sub/user.ts')") == [("base.ts", ["shared", "Shape"])]
    assert rows("SELECT direction, file FROM query_dependencies('base.ts')") == [("importedBy", "sub/user.ts")]
    assert rows("SELECT * FROM query_type_consumers('Shape')") == [("consumed", "sub/user.ts", None), ("defined", "base.ts", "interface")]
    assert rows("SELECT * FROM query_co_changes('base.ts', 1)") == []
    found = space.query_symbol("shared")
    assert rows("SELECT id FROM query_symbol('shared') WHERE role = 'match'") == api(found["matches"].select("id"))
    assert rows("SELECT kind, id FROM query_symbol('shared') WHERE role = 'incoming'") == api(found["incoming"].select("kind", "id")) != []
    # Functions are tables: joined with each other and grouped.
    assert rows("SELECT count(*) FROM search_code('shared', 5) s JOIN query_dependencies('base.ts') d ON s.file = d.file") == [(1,)]
    with pytest.raises(Exception, match="between 1 and 20"):
        spark.sql("SELECT * FROM search_code('x', 21)").collect()
