"""Outline of one script: imports, top-level nodes, symbols and named references.

Spark has no built-in for reading TypeScript or JavaScript structure, so this is the
per-row helper behind one Arrow UDF. It reads tokens, not a type-checked tree: calls through
a receiver whose type must be inferred are not found. All name resolution is done by joins.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable, Iterable

import pyarrow as pa

from loomgraph.functions.text import BLANKS

_NAMES = pa.list_(pa.string())
_OUTLINE_FIELDS = {
    "imports": {"pos": pa.int32(), "specifier": pa.string(), "base": pa.string(), "names": _NAMES},
    "nodes": {
        "name": pa.string(), "kind": pa.string(), "exported": pa.bool_(),
        "is_default": pa.bool_(), "first": pa.int32(), "last": pa.int32(),
    },
    "symbols": {
        "name": pa.string(), "kind": pa.string(), "line": pa.int32(), "is_default": pa.bool_(),
    },
    "refs": {
        "owner": pa.string(), "base": pa.string(), "name": pa.string(), "kind": pa.string(),
    },
}
OUTLINE_ARROW = pa.struct(
    [(k, pa.list_(pa.struct(list(v.items())))) for k, v in _OUTLINE_FIELDS.items()]
)
OUTLINE_TYPE = (
    "struct<"
    "imports: array<struct<pos int, specifier string, base string, names array<string>>>,"
    "nodes: array<struct<name string, kind string, exported boolean, is_default boolean,"
    " first int, last int>>,"
    "symbols: array<struct<name string, kind string, line int, is_default boolean>>,"
    "refs: array<struct<owner string, base string, name string, kind string>>>"
)
PACKED_ARROW = pa.list_(
    pa.struct([("chunk_text", pa.string()), ("exports", _NAMES), ("imports", _NAMES)])
)
PACKED_TYPE = "array<struct<chunk_text string, exports array<string>, imports array<string>>>"

_PATTERN = r"/(?![*/])(?:[^\\/\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
# A slash starts a regular expression only after these; elsewhere it divides.
# Blanks before a token are taken with it; only those with a line end are found on their own.
_TOKEN = re.compile(
    rf"""(?:[ \t]+(?!\s))?((?<![\w$.])(?:return|typeof|case|void|delete)\s*{_PATTERN}
      |[^\W\d][\w$]*|\$[\w$]*
      |\s+
      |"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'
      |//[^\n]*|/\*.*?(?:\*/|\Z)
      |`(?:[^`\\]|\\.)*`
      |[=(,:;!&|?{{}}\[+~^*%-]\s*{_PATTERN}
      |\d[\w.]*
      |=>|\.\.\.|\?\.|.)""",
    re.VERBOSE | re.DOTALL,
)

# Parts of the language's grammar.
_DECLARATIONS = {
    "function": "function",
    "class": "class",
    "interface": "interface",
    "type": "type",
    "enum": "enum",
    "const": "variable",
    "let": "variable",
    "var": "variable",
}
_MODIFIERS = {"export", "default", "declare", "abstract", "async"}
_MEMBER_MODIFIERS = {
    "public", "private", "protected", "static", "async", "readonly", "override", "abstract",
    "declare", "*",
}
_BLOCK_HEADS = {
    "function", "class", "interface", "enum", "namespace", "module", "if", "for", "while",
    "try", "switch", "do",
}
_OPEN_AFTER = set(",=+-*/%.([{?:&|<!~^") | {
    "=>", "?.", "extends", "implements", "from", "import", "export", "default", "const", "let",
    "var", "function", "class", "async", "new", "typeof", "declare", "abstract", "interface",
    "type", "enum", "as", "in", "of", "instanceof",
}
_OPEN_BEFORE = set(".,?:=+-*/%&|<>)]}{;([") | {
    "=>", "?.", "else", "catch", "finally", "extends", "implements", "from", "as", "in", "of",
    "instanceof", "satisfies",
}
_TYPE_BEFORE = {":", "|", "&", "<", "as", "keyof", "is", "satisfies"}


_BRACKETS = frozenset("()[]{}")
_LONG_PUNCT = {"=>", "...", "?."}
_KIND_BY_START = {
    **dict.fromkeys(" \t\n\r\x0b\x0c\xa0", "blank"),
    **dict.fromkeys("(){}[]<>.,;:=+-*%&|^!~?@#\\", "punct"),
    **dict.fromkeys("0123456789", "number"),
    **dict.fromkeys("'\"", "string"),
    "`": "template",
    "/": "slash",
}


def _tokens(text: str) -> list[tuple[str, str, int]]:
    """(kind, text, line) of every token; comments and blanks are left out."""
    found: list[tuple[str, str, int]] = []
    add = found.append
    line = 0
    kind_of = _KIND_BY_START.get
    for word in _TOKEN.findall(text):
        kind = kind_of(word[0], "word")
        if kind == "word" and (len(word) < 7 or "/" not in word):
            add((kind, word, line))
        elif kind == "punct" and (len(word) == 1 or word in _LONG_PUNCT):
            add((kind, word, line))
        elif kind == "blank":
            line += word.count("\n")
        elif kind in ("word", "punct"):
            # A keyword or operator together with the regular expression after it.
            at = word.index("/") if kind == "word" else 1
            add((kind, word[:at].rstrip(), line))
            line += word.count("\n")
            add(("template", "/re/", line))
        elif kind == "slash":
            if len(word) == 1:
                add(("punct", word, line))
            else:
                line += word.count("\n")
        elif len(word) == 1 and kind != "number":
            add(("punct", word, line))
        else:
            add((kind, word, line))
            if kind == "template":
                line += word.count("\n")
    return found


def _statements(tokens: list[tuple[str, str, int]]) -> list[list[tuple[str, str, int]]]:
    """Tokens grouped by top-level statement."""
    current: list[tuple[str, str, int]] = []
    groups = [current]
    depth = 0
    for token in tokens:
        kind, word, line = token
        if depth == 0 and current:
            _, last, last_line = current[-1]
            if last == ";" or (
                (line > last_line or last == "}") and _starts_statement(current, token)
            ):
                current = []
                groups.append(current)
        current.append(token)
        if kind == "punct" and word in _BRACKETS:
            if word in "([{":
                depth += 1
            elif depth:
                depth -= 1
    return [g for g in groups if g and (g[0][1] != ";" or any(w != ";" for _, w, _ in g))]


def _starts_statement(current: list[tuple[str, str, int]], token: tuple[str, str, int]) -> bool:
    """Whether `token` opens a new statement after the tokens of `current`."""
    kind, word, line = token
    last_kind, last, last_line = current[-1]
    words = [w for _, w, _ in current[:6]]
    ends_block = last == "}" and not _BLOCK_HEADS.isdisjoint(words)
    if line == last_line and not ends_block:
        return False
    if last_kind in ("word", "punct") and last in _OPEN_AFTER:
        return False
    if kind in ("word", "punct") and word in _OPEN_BEFORE and not (ends_block and word in "(["):
        return False
    return words[0] != "@" or any(w == "class" for _, w, _ in current)


def _head(statement: list[tuple[str, str, int]]) -> tuple[str | None, str | None, set[str], int]:
    """(kind, name, modifiers, index of the declaring keyword) of a statement."""
    at = 0
    while at < len(statement) and statement[at][1] == "@":
        at += 2
        depth = 0
        while at < len(statement):
            word = statement[at][1]
            depth += (word in "([{") - (word in ")]}")
            if depth == 0 and word not in ").(" and statement[at - 1][1] != ".":
                break
            at += 1
    modifiers = set()
    while at < len(statement) and statement[at][1] in _MODIFIERS:
        modifiers.add(statement[at][1])
        at += 1
    kind = _DECLARATIONS.get(statement[at][1]) if at < len(statement) else None
    if kind is None:
        return None, None, modifiers, at
    words = [w for _, w, _ in statement[at : at + 4]] + [""] * 4
    kinds = [k for k, _, _ in statement[at : at + 4]] + [""] * 4
    if words[0] == "const" and words[1] == "enum":
        return "enum", words[2], modifiers, at
    if kind == "type" and words[2] not in ("=", "<"):
        return None, None, modifiers, at
    skip = 2 if kind == "function" and words[1] == "*" else 1
    named = kinds[skip] == "word" and words[skip] not in ("extends", "implements")
    return kind, words[skip] if named else None, modifiers, at


def _import_bindings(clause: list[tuple[str, str, int]]) -> list[tuple[str, str]]:
    """(local name, imported name) pairs; imported is `default` or `*` for those forms."""
    words = [w for _, w, _ in clause]
    if words[:1] == ["type"] and words[1:2] not in ([], [","]):
        words = words[1:]
    if not words:
        return []
    pairs: list[tuple[str, str]] = []
    if words[0] not in "{*":
        pairs.append((words[0], "default"))
    if "*" in words:
        pairs.append((words[-1], "*"))
    if "{" in words:
        inner = words[words.index("{") + 1 :]
        item: list[str] = []
        for word in inner:
            if word not in (",", "}"):
                item.append(word)
                continue
            if len(item) > 1 and item[0] == "type" and item[1] != "as":
                item = item[1:]
            if item:
                pairs.append((item[-1], item[0]))
            item = []
    return pairs


def _members(statement: list[tuple[str, str, int]], start: int) -> list[tuple[int, str | None]]:
    """(token index, method name or None) where each member of a class body begins."""
    found: list[tuple[int, str | None]] = []
    depth = 0
    at_member = False
    for i in range(start, len(statement)):
        _, word, line = statement[i]
        if depth != 1:
            if word in _BRACKETS:
                depth += 1 if word in "([{" else -1
                at_member = depth == 1 and word in "{}"
            continue
        if word != "}" and i and not at_member:
            _, last, last_line = statement[i - 1]
            at_member = line > last_line and last not in _OPEN_AFTER and word not in _OPEN_BEFORE
        if at_member and word not in (";", "}"):
            j = i
            while j < len(statement) - 1 and statement[j][1] in _MEMBER_MODIFIERS:
                if statement[j + 1][1] in "(=:;?":
                    break
                j += 1
            after = statement[j + 1][1] if j + 1 < len(statement) else ""
            is_method = statement[j][0] == "word" and after in ("(", "<")
            name = statement[j][1] if is_method and statement[j][1] != "constructor" else None
            found.append((i, name))
            at_member = False
        if word in _BRACKETS:
            depth += 1 if word in "([{" else -1
            at_member = False
        elif word == ";":
            at_member = True
    return found


def outline(path: str, text: str, with_symbols: bool = True) -> dict:
    """The outline of one file. `base` is an import's target path before extension search.

    Symbols and references are left empty unless asked for. Symbols are unique by name. A
    reference without a base is to a symbol of this file, and its kind is final; otherwise the
    kind still depends on what the target turns out to be.
    """
    folder = posixpath.dirname(path)
    own_bases = {path, posixpath.splitext(path)[0]}
    imports, nodes, symbols = [], [], []
    bindings: dict[str, tuple[str, str]] = {}
    bodies: list[tuple[str, str, list[tuple[str, str, int]], int, dict[int, str | None]]] = []
    for statement in _statements(_tokens(text)):
        words = [w for _, w, _ in statement] if statement[0][1] == "import" else []
        if words and words[1:2] not in (["("], ["."]) and "=" not in words:
            strings = [i for i, (k, _, _) in enumerate(statement) if k == "string"]
            if not strings:
                continue
            at = words.index("from", 1) + 1 if "from" in words[1 : strings[0]] else strings[0]
            at = at if at in strings else strings[0]
            specifier = statement[at][1][1:-1]
            relative = specifier.startswith(".")
            base = posixpath.normpath(posixpath.join(folder, specifier)) if relative else None
            clause = statement[1 : at - 1] if at > 1 else []
            pairs = _import_bindings(clause)
            names = [local for local, imported in pairs if imported != "*"]
            imports.append(
                {"pos": len(imports), "specifier": specifier, "base": base, "names": names}
            )
            if base is not None:
                target = None if base in own_bases else base
                bindings.update({local: (target, imported) for local, imported in pairs})
            continue
        kind, name, modifiers, at = _head(statement)
        is_default = "default" in modifiers
        nodes.append(
            {
                "name": name,
                "kind": kind,
                "exported": kind is not None and name is not None and "export" in modifiers,
                "is_default": is_default,
                "first": statement[0][2],
                "last": statement[-1][2]
                + (statement[-1][1].count("\n") if statement[-1][0] == "template" else 0),
            }
        )
        if name is None or not with_symbols:
            continue
        symbols.append(
            {"name": name, "kind": kind, "line": statement[at][2] + 1, "is_default": is_default}
        )
        members = dict(_members(statement, at)) if kind == "class" else {}
        bodies.append((name, kind, statement, at, members))
        if members:
            for start, method in members.items():
                if method:
                    symbols.append(
                        {
                            "name": f"{name}.{method}",
                            "kind": "method",
                            "line": statement[start][2] + 1,
                            "is_default": False,
                        }
                    )
    by_name = {s["name"]: s for s in reversed(symbols)}
    symbols = [s for s in symbols if by_name[s["name"]] is s]
    refs: set[tuple[str, str | None, str, str]] = set()
    for body in bodies:
        _collect_refs(*body, by_name, bindings, refs)
    default = next((s["name"] for s in symbols if s["is_default"]), "default")
    edges = set()
    for owner, base, name, role in refs:
        if base is None:
            name = default if name == "default" else name
            role = name in by_name and edge_kind(role, by_name[name]["kind"])
        if role and (owner != name or base is not None):
            edges.add((owner, base or "", name, role))
    return {
        "imports": imports,
        "nodes": nodes,
        "symbols": symbols,
        "refs": [
            {"owner": o, "base": b or None, "name": n, "kind": k} for o, b, n, k in sorted(edges)
        ],
    }


def edge_kind(role: str, target_kind: str) -> str | None:
    """Kind of the edge that a use of a symbol makes, None when it makes none."""
    if role in ("extends", "implements"):
        return role
    if role == "type" or target_kind in ("interface", "type"):
        return "uses-type"
    return "calls" if role == "call" else None


def _collect_refs(name, kind, statement, at, starts, by_name, bindings, refs) -> None:
    """Add (owner, base or None for this file, target name, role) of each known name used."""
    owner = name
    in_head = kind in ("class", "interface")
    heritage = None
    angle = 0
    last = len(statement) - 1
    for i, (token_kind, word, _) in enumerate(statement[at + 1 :], at + 1):
        if in_head:
            angle += (word == "<") - (word == ">")
            if word in ("extends", "implements") and angle == 0:
                heritage = word
            in_head = not (word == "{" and angle == 0)
        if i in starts:
            owner = f"{name}.{starts[i]}" if starts[i] else name
        if token_kind != "word":
            continue
        before = statement[i - 1][1]
        known = word in bindings or word in by_name
        if not known and before != ".":
            continue
        after = statement[i + 1][1] if i < last else ""
        if before == "." and statement[i - 2][1] == "this" and after == "(":
            if f"{name}.{word}" in by_name:
                refs.add((owner, None, f"{name}.{word}", "call"))
            continue
        if not known:
            continue
        is_key = after in (":", "?") and before in ("{", ",", "(")
        if before in (".", "?.") or is_key:
            continue
        base, target = bindings.get(word, (None, word))
        called = before == "new" or after == "("
        if after == "." and i + 2 <= last and statement[i + 2][0] == "word":
            member = statement[i + 2][1]
            member_called = i + 3 <= last and statement[i + 3][1] == "("
            target = member if target == "*" else f"{target}.{member}"
            called = called or member_called
        if in_head and heritage and angle == 0:
            role = heritage
        elif called:
            role = "call"
        elif before in _TYPE_BEFORE or (in_head and angle > 0):
            role = "type"
        else:
            role = "other"
        refs.add((owner, base, target, role))


def pack_nodes(path: str, text: str, max_chars: int) -> list[dict]:
    """Top-level nodes other than imports, packed in order into chunks of `max_chars`.

    Lengths count UTF-16 units. A line shared by two nodes is taken once.
    """
    found = outline(path, text, with_symbols=False)
    specifiers = [i["specifier"] for i in found["imports"]]
    source = text.split("\n")
    chunks: list[dict] = []
    held: list[str] = []
    size = 0
    exports: list[str] = []

    def flush() -> None:
        nonlocal held, size, exports
        body = "\n".join(held).strip(BLANKS)
        step = max_chars // 2 if any(ord(c) > 0xFFFF for c in body) else max_chars
        for at in range(0, len(body), max(step, 1)):
            part = body[at : at + max(step, 1)]
            chunks.append(
                {"chunk_text": part, "exports": exports, "imports": [] if chunks else specifiers}
            )
        held, size, exports = [], 0, []

    done = -1
    for node in found["nodes"]:
        rows = source[max(node["first"], done + 1) : node["last"] + 1]
        done = max(done, node["last"])
        length = len("\n".join(rows).encode("utf-16-le")) // 2
        if held and size + length > max_chars:
            flush()
        if rows:
            size += length + (1 if held else 0)
            held.extend(rows)
        if node["exported"]:
            exports.append(node["name"])
    flush()
    return chunks


def in_batches(make: Callable, rows: Iterable[tuple], kind: pa.DataType, size: int = 32) -> pa.Array:
    """Arrow array of `make(*row)`, built in short stretches so that few objects stay alive."""
    done = [pa.array([], type=kind)]
    held = []
    for row in rows:
        held.append(make(*row))
        if len(held) == size:
            done.append(pa.array(held, type=kind))
            held = []
    done.append(pa.array(held, type=kind))
    return pa.concat_arrays(done)
