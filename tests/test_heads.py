"""Import and export statements found by built-in expressions."""

import time

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import heads
from loomgraph.operators import depgraph


@pytest.fixture(scope="module")
def read(spark):
    def of(text, path="a/b.tsx"):
        rows = spark.createDataFrame([(path, text)], "file_path string, content string")
        found = depgraph.with_heads(rows)
        return (
            [(i.specifier, i.base, i.names) for i in depgraph.import_statements(found).orderBy("pos").collect()],
            [(n.name, n.kind) for n in depgraph.exports(found).orderBy("pos").collect()],
        )

    return of


def test_imports(read):
    cases = {
        "import D, { a as b, type T } from '../x.js'": ("../x.js", "x.js", ["D", "b", "T"]),
        "import * as ns from './ns'": ("./ns", "a/ns", []),
        "import E, * as ns from \"./ns\"": ("./ns", "a/ns", ["E"]),
        "import './side'": ("./side", "a/side", []),
        "import type { Q } from './q'": ("./q", "a/q", ["Q"]),
        "import type R from './q'": ("./q", "a/q", ["R"]),
        "import type from './q'": ("./q", "a/q", ["type"]),
        "import r from 'react'": ("react", None, ["r"]),
        "import {\n  a, // it's one (or two)\n  default as b,\n} from './q'\n": ("./q", "a/q", ["a", "b"]),
        "const x = 1; import y from '../../up'": ("../../up", "../up", ["y"]),
        "import a from \"./it's\"": ("./it's", "a/it's", ["a"]),
        "import a from './say \"so\"'": ('./say "so"', 'a/say "so"', ["a"]),
        "\ufeffimport a from './a'": ("./a", "a/a", ["a"]),
    }
    for text, want in cases.items():
        assert read(text)[0] == [want], text


def test_what_is_no_import(read):
    for text in (
        "export { a } from './a'; export * from './b'",
        "const a = require('./a'); const b = import('./b')",
        "// import a from './a'\n/* \nimport b from './b'\n*/\n",
        "const s = `\nimport a from './a'\n`\n",
        "const s = `${x ? `\nimport q from './ghost'\n` : ''}`\n",
        "function f() {\n  import('./a') }\nimport.meta.url\n",
        "import x = require('./x')",
        'const t = "import q from \'./q\'"',
        "const t = css `\nimport ghost from './ghost';\n`\n",
        "const B = styled.div `\nimport ghost from './ghost';\n`\n",
        "export default gql `\nimport ghost from './ghost';\n`\n",
        "f(html `\nimport ghost from './ghost';\n`)\n",
        "const f = () => css `\nimport ghost from './ghost';\n`\n",
        "x \ufeffimport a from './a'",
    ):
        assert read(text)[0] == [], text


def test_exports(read):
    cases = {
        "export type A = 'a' | 'b'": [("A", "type")],
        "export type { A } from './a'": [],
        "export const enum E { A }": [("E", "enum")],
        "export abstract class C {}": [("C", "class")],
        "export async function f() {}\nexport function* g() {}": [("f", "function"), ("g", "function")],
        "export const u = 1, v = 2;\nexport let w = 3": [("u", "variable"), ("w", "variable")],
        "export default class Foo {}": [("Foo", "class")],
        "export default class extends Foo {}": [],
        "@dec({a: 1})\nexport class Z<T> {}": [("Z", "class")],
        "export const { p } = s; export default function () {}": [],
        "const x = 1; export { x }; export default x": [],
        "function f() {\n  // export const y = 1\n  return '}'\n}\n": [],
        "namespace N {\n  export const inner = 1\n}\n": [],
        "export interface Ünder$1 {}": [("Ünder$1", "interface")],
    }
    for text, want in cases.items():
        assert read(text)[1] == want, text


def test_what_follows_odd_lines_is_found(read):
    for line in (
        "const A = () => { return <p>see http://x.y</p> }",
        "const A = () => <p>use ` here</p>",
        "if (x) /[{]/.test(y)",
        "const f = (s) => /[`'\"{]/.test(s)",
        "const q = a / b / c; // it's",
        "const s = 'it\\'s' + \"\\\"\" + '\\\\'",
    ):
        assert read(f"{line}\nexport const after = `x`\n")[1] == [("after", "variable")], line


def test_long_lines_are_linear(spark):
    texts = ["'" + "\\'" * 200_000, "/[" * 200_000, "`" * 200_001, "import " * 100_000, "/* " * 200_000,
             "\"" + "a" * 500_000, "${" * 200_000, "export default " * 50_000, "(" * 300_000]
    rows = spark.createDataFrame([(t + "\nexport const after = 1",) for t in texts], "t string")
    begun = time.time()
    rows.select(F.size(heads.statements(F.col("t")))).collect()
    assert time.time() - begun < 30


def test_paths(spark):
    cases = [("a/b", "./c", "a/b/c"), ("", "../x", "../x"), ("a", "../../x/./y", "../x/y"), ("a", "..", ""), ("", "./q", "q")]
    rows = spark.createDataFrame(cases, "f string, r string, want string")
    got = rows.select(heads.joined_path(F.col("f"), F.col("r")).alias("p"), "want").collect()
    assert all(r.p == r.want for r in got)


def test_plan_has_no_python(spark):
    rows = spark.createDataFrame([("a.ts", "export const a = 1")], "file_path string, content string")
    plan = depgraph.import_statements(depgraph.with_heads(rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
