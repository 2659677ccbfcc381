import random

import pytest

from loomgraph.functions.text import cut, glob_regex, page_file_name, trim
from loomgraph.operators import chunking
from loomgraph.wiki import page_name
from pyspark.sql import functions as F


def files(spark, texts, path="f{}.md"):
    rows = [(path.format(i), t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "file_path string, content string")


def rows_of(frame, *columns):
    return [tuple(r[c] for c in columns) for r in frame.orderBy("file_path", "chunk_index").collect()]


def js_trim(text):
    return text.strip("\t\n\x0b\x0c\r \xa0")


def plain_windows(text, size, step):
    found = []
    parts = text.split("\n")
    for start in range(0, len(parts), step):
        piece = js_trim("\n".join(parts[start : start + size]))
        if piece:
            found += [piece[k : k + 3900] for k in range(0, len(piece), 3900)]
    return found


@pytest.mark.parametrize("n", [1, 150, 151, 200, 201, 450])
def test_windows_by_line_count(spark, n):
    text = "\n".join(f"line {i}" for i in range(n))
    got = rows_of(chunking.chunk_windows(files(spark, [text])), "chunk_index", "chunk_text")
    assert got == list(enumerate(plain_windows(text, 200, 150)))


def test_windows_skip_blank_ones(spark):
    rng = random.Random(3)
    texts = ["", " \n\t\n", "\n" * 400 + "end"]
    for _ in range(20):
        texts.append("\n".join(rng.choice(["", "a", " b\t", "c" * 900]) for _ in range(rng.randint(1, 60))))
    got = rows_of(
        chunking.chunk_windows(files(spark, texts, "f{:03}"), window=7, overlap=2),
        "file_path", "chunk_index", "chunk_text",
    )
    want = [
        (f"f{i:03}", j, t)
        for i, text in enumerate(texts)
        for j, t in enumerate(plain_windows(text, 7, 5))
    ]
    assert got == want


def test_sections(spark):
    text = "intro\n# top\n## One\nbody\n### deeper\n##nospace\n##  Two \r\n\n## \n```\n## Fenced\n```\n"
    got = rows_of(
        chunking.chunk_sections(files(spark, [text])), "chunk_index", "section", "chunk_text"
    )
    assert got == [
        (0, "(intro)", "intro\n# top"),
        (1, "One", "## One\nbody\n### deeper\n##nospace"),
        (2, "Two", "##  Two \r\n\n## \n```"),
        (3, "Fenced", "## Fenced\n```"),
    ]


def test_sections_without_intro_or_text(spark):
    got = rows_of(
        chunking.chunk_sections(files(spark, ["\n \n## A\nx", "", "  \n", "plain"])),
        "file_path", "chunk_index", "section", "chunk_text",
    )
    assert got == [("f0.md", 0, "A", "## A\nx"), ("f3.md", 0, "(intro)", "plain")]


def test_notes(spark):
    texts = [
        "no matter\n",
        "---\nname: a\ntype:  feedback \nname: b\ndescription: d: e\n---\n\n body \n",
        "---\nname: never closed\n",
        "---\nname: x---y\n---\nrest",
        "---\n name: indented\ntype:\n---\nbody",
    ]
    got = rows_of(
        chunking.chunk_notes(files(spark, texts)), "name", "type", "description", "chunk_text"
    )
    assert got == [
        ("", "", "", "no matter\n"),
        ("b", "feedback", "d: e", "body"),
        ("", "", "", "---\nname: never closed\n"),
        ("x", "", "", "y\n---\nrest"),
        ("", "", "", "body"),
    ]


def test_declarations_fall_back_to_windows(spark):
    rows = [
        ("a.py", "def f():\n  pass\n"),
        ("b.ts", "import x from './x'\n"),
        ("c.tsx", "import x from './x'\nexport const y = 1\n"),
        ("d.ts", ""),
    ]
    frame = spark.createDataFrame(rows, "file_path string, content string")
    got = rows_of(chunking.chunk_declarations(frame), "file_path", "chunk_text", "exports", "imports")
    assert got == [
        ("a.py", "def f():\n  pass", [], []),
        ("b.ts", "import x from './x'", [], []),
        ("c.tsx", "export const y = 1", ["y"], ["./x"]),
    ]


def test_cut_counts_utf16_units(spark):
    frame = spark.createDataFrame([("a\U0001f600b" + "c" * 9,), ("abcdef",)], "t string")
    got = [
        [r[0] for r in frame.select(cut(F.col("t"), n)).collect()] for n in (1, 2, 3, 4)
    ]
    assert got == [["a", "a"], ["a", "ab"], ["a\U0001f600", "abc"], ["a\U0001f600b", "abcd"]]


def test_trim_and_page_names(spark):
    names = ["My Page", "A.b_C", "x\t\n y", "Ünï-1", "", "notes.md"]
    frame = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in frame.select(page_file_name(F.col("n"))).collect()]
    assert got == [page_name(n) for n in names]
    assert got[0] == "my-page.md" and got[-1] == "notesmd.md"
    (row,) = spark.range(1).select(trim(F.lit("\t a \n b\r\n"))).collect()
    assert row[0] == "a \n b"


@pytest.mark.parametrize(
    "glob, yes, no",
    [
        ("**/*.{ts,tsx}", ["a.ts", "x/y/b.tsx"], ["a.js", "a.ts.bak", ".x/a.ts", "x/.a.ts"]),
        ("docs/*.md", ["docs/a.md"], ["docs/x/a.md", "a.md"]),
        (".claude/rules/*.md", [".claude/rules/a.md"], ["claude/rules/a.md"]),
        ("sub/**", ["sub/a.ts", "sub/x/b.ts"], ["subs/a.ts", "sub"]),
        ("src/[ab]?.ts", ["src/a1.ts"], ["src/c1.ts", "src/a.ts"]),
    ],
)
def test_globs(spark, glob, yes, no):
    frame = spark.createDataFrame([(p,) for p in yes + no], "p string")
    got = {r[0] for r in frame.where(F.col("p").rlike(glob_regex(glob))).collect()}
    assert got == set(yes)
