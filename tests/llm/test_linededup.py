import random

from loomgraph.llm import linededup
from tests.llm.helpers import documents


def plainly(texts):
    seen, out = set(), {}
    for k, text in sorted(texts.items()):
        if text is None:
            out[k] = (0, 0, None)
            continue
        lines = text.split("\n")
        bare = [x.strip(" ") for x in lines]
        gone = set()
        for i in range(len(lines) - 2):
            window = tuple(bare[i : i + 3])
            if any(window):
                if window in seen:
                    gone |= {i, i + 1, i + 2}
                seen.add(window)
        out[k] = (len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def test_against_plain_code(spark):
    draw = random.Random(2)
    texts = {k: "\n".join(draw.choice(["a", "b", " b", "c", ""]) for _ in range(draw.randint(0, 12))) for k in range(60)}
    texts |= {100: None, 101: "", 102: "one\ntwo", 103: "\n\n\n\n", 104: "x\ny\nz\nx\ny\nz\nx"}
    rows = linededup.dedup_lines(documents(spark, texts))
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in rows.collect()} == plainly(texts)
    assert {"kept", "bucket", "size"} <= set(rows.columns)


def test_hot_window_and_long_text(spark):
    shared = "one\ntwo\nthree"
    texts = {k: f"{shared}\nown {k}" for k in range(3000)}
    texts[5000] = "\n".join(f"line {k}" for k in range(20_000)) + "\n" + shared
    got = {r.doc_id: r.text for r in linededup.dedup_lines(documents(spark, texts)).collect()}
    assert got[0] == texts[0] and got[1] == "own 1" and got[2999] == "own 2999"
    assert got[5000].endswith("line 19999") and got[5000].count("\n") == 19_999


def test_repeated_rows_and_empty_table(spark):
    docs = documents(spark, [(1, "a\nb\nc"), (1, "a\nb\nc"), (2, "a\nb\nc"), (None, "q\nr\ns")])
    got = sorted((r.doc_id or 0, r.n_removed) for r in linededup.dedup_lines(docs).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 3)]
    assert linededup.dedup_lines(docs.limit(0)).count() == 0
