import hashlib
import random

import zstandard

from loomgraph.llm import fim
from tests.llm.helpers import documents


def plainly(doc_id, text, seed="1:"):
    """(n, form, prefix_chars, middle_chars, output) by slices of the whole text."""
    text = text or ""
    digest = hashlib.sha256(f"{seed}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(text), "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return len(text), "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return len(text), "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_frames_are_independent_and_counted():
    text = "äß𝄞x\n" * 1000
    ends, frames = fim.to_frames(text, 512)
    assert ends[-1] == len(text) and ends[0] == 512
    assert fim.unpack(frames[3]).decode() == text[ends[2] : ends[3]]
    assert fim.to_frames("") == ([], [])


def test_only_cut_frames_are_opened(monkeypatch):
    ends, frames = fim.to_frames("abcdefgh" * 100, 64)
    opened = []
    monkeypatch.setattr(fim, "unpack", lambda f: opened.append(f) or zstandard.decompress(f))
    for cuts, n in (([70, 400], 2), ([64, 128], 0), ([70, 71], 1), ([0, 800], 0), ([5, 5], 1)):
        opened.clear()
        made = fim.parts(frames, ends, cuts)
        assert len(opened) == n
        got = ["".join(zstandard.decompress(f).decode() for f in part) for part in made]
        text = "abcdefgh" * 100
        assert got == [text[: cuts[0]], text[cuts[0] : cuts[1]], text[cuts[1] :]]


def test_round_trip_near_marks():
    """Texts with the pieces of marks, at every pair of cuts and with tiny frames."""
    for text in ("<<P", "P>S><", "<", "a<S b>M>", "<<<>>>", "é<P 𝄞>"):
        for units in (1, 2, 3, 100):
            ends, frames = fim.to_frames(text, units)
            for form in ("psm", "spm"):
                for a in range(len(text) + 1):
                    for b in range(a, len(text) + 1):
                        made = fim.sample(frames, ends, form, a, b)
                        assert b"".join(fim.restored(made, form)).decode() == text


def test_documents(spark):
    draw = random.Random(5)
    texts = [(k, "".join(draw.choice("ab <PSM>é𝄞\n") for _ in range(draw.randrange(90)))) for k in range(300)]
    texts += [(None, "no id at all"), (7, None), (8, ""), (9, "<S>"), (10, "same"), (10, "same"), (-5, "negative"),
              (11, "long text 𝄞 " * 20_000)]
    docs = documents(spark, texts, extra="n string, form string, output string, frames string, marked string")
    rows = fim.fill_in_middle(docs, units=16).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", fim.frames_text("output").alias("out"),
        fim.frames_sha256("output").alias("digest"), fim.restored_sha256("output", "form").alias("back"),
    ).collect()
    want = sorted(((k, *map(str, plainly(k, t)), hashlib.sha256((t or "").encode()).hexdigest()) for k, t in texts), key=str)
    got = sorted(((r.doc_id, *map(str, (r.n, r.form, r.prefix_chars, r.middle_chars, r.out)), r.back) for r in rows), key=str)
    assert got == want and {r.form for r in rows} == {"plain", "psm", "spm"}
    assert all(r.digest == hashlib.sha256(r.out.encode()).hexdigest() for r in rows)


def test_joined_frames_are_a_file(spark):
    row = fim.fill_in_middle(documents(spark, {3: "one two three " * 50}), units=32).first()
    read = zstandard.ZstdDecompressor().stream_reader(b"".join(map(bytes, row.output)), read_across_frames=True)
    assert read.read().decode() == plainly(3, "one two three " * 50)[4]


def test_empty_table(spark):
    rows = fim.fill_in_middle(documents(spark, {1: "x"}).limit(0))
    assert rows.count() == 0 and rows.columns[-1] == "output"
