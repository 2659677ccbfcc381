from loomgraph.functions.outline import outline, pack_nodes

SHAPES = """export interface Area { size(): number }
export type Side = number
export class Box { grow(by: Side): void { this.note(by); } note(x: number) { log(x) } }
export function log(x: number) { return x }
"""
SCENE = """import Kit, { Box as Crate, Area, log } from '../lib/shapes';

export class Room extends Crate implements Area {
  lamps = log(2);
  size() { return log(this.width()); }
  width(): number { return 4 }
}

export const measure = (a: Area) => {
  const room = new Room();
  return Kit.total(room.size(), a);
}
"""


def imports(text, path="a/b.ts"):
    return [(i["specifier"], i["base"], i["names"]) for i in outline(path, text)["imports"]]


def exported(text):
    return [(n["name"], n["kind"]) for n in outline("x.ts", text)["nodes"] if n["exported"]]


def test_import_names_follow_the_local_name():
    assert imports("import D, { a as b, type T } from '../x.js'") == [
        ("../x.js", "x.js", ["D", "b", "T"])
    ]
    assert imports("import * as ns from './ns'") == [("./ns", "a/ns", [])]
    assert imports("import './side'") == [("./side", "a/side", [])]
    assert imports("import type { Q } from './q'") == [("./q", "a/q", ["Q"])]
    assert imports("import type from './q'") == [("./q", "a/q", ["type"])]
    assert imports("import r from 'react'") == [("react", None, ["r"])]
    assert imports("import {\n  a,\n  b,\n} from './q'\n") == [("./q", "a/q", ["a", "b"])]


def test_what_is_no_import_declaration():
    assert imports("export { a } from './a'; export * from './b'") == []
    assert imports("const a = require('./a'); const b = import('./b')") == []
    assert imports("// import a from './a'\n/* import b from './b' */\n") == []
    assert imports("const s = `\nimport a from './a'\n`\n") == []
    assert imports("function f() { import('./a') }\nimport.meta.url\n") == []


def test_export_kinds():
    assert exported("export type A = 'a' | 'b'") == [("A", "type")]
    assert exported("export const enum E { A }") == [("E", "enum")]
    assert exported("export abstract class C {}") == [("C", "class")]
    assert exported("export async function f() {}\nexport function* g() {}") == [
        ("f", "function"), ("g", "function"),
    ]
    assert exported("export const u = 1, v = 2;\nexport let w = 3") == [
        ("u", "variable"), ("w", "variable"),
    ]
    assert exported("export default class Foo {}") == [("Foo", "class")]
    assert exported("@dec({a: 1})\nexport class Z {}") == [("Z", "class")]


def test_what_is_not_exported():
    assert exported("export const { p } = s; export default function () {}") == []
    assert exported("const x = 1; export { x }; export default x") == []
    assert exported("function f() {\n  // export const y = 1\n  return '}'\n}\n") == []


def test_symbols_and_references_of_two_files():
    shapes, scene = outline("lib/shapes.ts", SHAPES), outline("app/scene.ts", SCENE)
    assert [(s["name"], s["kind"], s["line"]) for s in shapes["symbols"]] == [
        ("Area", "interface", 1), ("Side", "type", 2), ("Box", "class", 3),
        ("Box.grow", "method", 3), ("Box.note", "method", 3), ("log", "function", 4),
    ]
    assert [(s["name"], s["kind"]) for s in scene["symbols"]] == [
        ("Room", "class"), ("Room.size", "method"), ("Room.width", "method"), ("measure", "variable"),
    ]
    within = {(r["owner"], r["name"], r["kind"]) for r in shapes["refs"]}
    assert within == {
        ("Box.grow", "Side", "uses-type"), ("Box.grow", "Box.note", "calls"), ("Box.note", "log", "calls"),
    }
    abroad = {(r["owner"], r["name"], r["kind"]) for r in scene["refs"] if r["base"] == "lib/shapes"}
    assert {
        ("Room", "Box", "extends"), ("Room", "Area", "implements"), ("Room", "log", "call"),
        ("Room.size", "log", "call"), ("measure", "Area", "type"), ("measure", "default.total", "call"),
    } <= abroad
    assert ("measure", "Room", "calls") in {(r["owner"], r["name"], r["kind"]) for r in scene["refs"]}


def test_members_and_receivers():
    found = outline("a.ts", """import * as ns from './ns'
import D from './d'
export class Foo<T> extends D<T> {
  static async *gen<U>(x: U) { return this.other(x) }
  private prop = () => { ns.foo() }
  get k() { return 1 }
  other(): { a: number } { return /a"b{/.test('x') }
  constructor() { D.make() }
}
const after = 1
""")
    assert [s["name"] for s in found["symbols"]] == ["Foo", "Foo.gen", "Foo.other", "after"]
    refs = {(r["owner"], r["base"], r["name"], r["kind"]) for r in found["refs"]}
    assert ("Foo.gen", None, "Foo.other", "calls") in refs
    assert ("Foo", "ns", "foo", "call") in refs
    assert ("Foo", "d", "default", "extends") in refs
    assert ("Foo", "d", "default.make", "call") in refs


def test_overloads_defaults_and_self_imports():
    found = outline("a/me.ts", """import me, { other as o } from './me'
export function f(a: string): void;
export function f(a: any) { me(); o() }
export default function main() { f(1) }
export interface other {}
""")
    assert [(s["name"], s["line"]) for s in found["symbols"]] == [("f", 2), ("main", 4), ("other", 5)]
    assert [(r["owner"], r["base"], r["name"], r["kind"]) for r in found["refs"]] == [
        ("f", None, "main", "calls"), ("f", None, "other", "uses-type"),
        ("main", None, "f", "calls"),
    ]


def test_statement_ends():
    nodes = outline("a.ts", """function g(): { a: number } {
  return 1
}
export type U =
  | 'a'
  | 'b'
if (g) { g() } else { g() }
const f = (x) =>
  x
let y = g
  ? 1
  : 2
export const tpl = `a
b`
""")["nodes"]
    assert [(n["first"], n["last"]) for n in nodes] == [
        (0, 2), (3, 5), (6, 6), (7, 8), (9, 11), (12, 13),
    ]


def test_packing_flushes_before_a_node_that_does_not_fit():
    chunks = pack_nodes("app/scene.ts", SCENE, 160)
    assert [c["exports"] for c in chunks] == [["Room"], ["measure"]]
    assert [c["imports"] for c in chunks] == [["../lib/shapes"], []]
    assert chunks[1]["chunk_text"].startswith("export const measure")
    assert [c["exports"] for c in pack_nodes("app/scene.ts", SCENE, 3900)] == [["Room", "measure"]]


def test_packing_edges():
    assert pack_nodes("a.ts", "import a from './a'\n", 3900) == []
    assert pack_nodes("a.ts", "// only words\n", 3900) == []
    (chunk,) = pack_nodes("a.ts", "// lead\nexport const a = 1; export const b = 2\n", 3900)
    assert chunk["chunk_text"] == "export const a = 1; export const b = 2"
    assert chunk["exports"] == ["a", "b"]
    long = "const s = '" + "\U0001f600" * 10 + "'"
    parts = pack_nodes("a.ts", long, 12)
    assert "".join(c["chunk_text"] for c in parts) == long
    assert all(len(c["chunk_text"].encode("utf-16-le")) <= 24 for c in parts)


def test_unbalanced_text_does_not_fail():
    for text in ("", "}}}", "class {", "import {", "'", "`", "export", "@", "/", "import x from"):
        outline("a.ts", text)
