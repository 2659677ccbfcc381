import hashlib
import random

import numpy as np

from loomgraph.llm import substrings
from loomgraph.llm.bytehash import Hashes, least_in_windows
from tests.llm.helpers import documents


def cut(docs):
    return {
        r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest())
        for r in substrings.cut_repeats(docs).collect()
    }


def check(spark, texts):
    texts = dict(enumerate(texts))
    assert cut(documents(spark, texts)) == dict(enumerate(substrings.cut_repeats_plainly(list(texts.values()))))


def letters(draw, n):
    return "".join(draw.choice("abcdefgh é") for _ in range(n))


def test_against_plain_code(spark):
    draw = random.Random(12)
    base = [letters(draw, 1500) for _ in range(4)]
    texts = [letters(draw, draw.randint(0, 900)) for _ in range(20)] + base
    for _ in range(40):
        text = draw.choice(base)
        begin = draw.randint(0, 700)
        part = text[begin : begin + draw.randint(380, 900)]
        for _ in range(draw.choice([0, 0, 1, 2])):
            at = draw.randrange(len(part))
            part = part[:at] + draw.choice("XYZ") + part[at:]
        texts.append(letters(draw, draw.randint(0, 300)) + part + letters(draw, draw.randint(0, 300)))
    check(spark, texts)


def test_exactly_the_length(spark):
    draw = random.Random(3)
    a = "".join(draw.choice("abcd") for _ in range(400))
    check(spark, [a, "x" + a, a[:399] + "!", a[1:] + "?", a + a[:10], None, "", "short"])


def test_within_a_document_and_runs(spark):
    draw = random.Random(4)
    a = letters(draw, 450)
    check(spark, [a + letters(draw, 50) + a, "z" * 401, "y" * 1500, "q" * 400, "ab" * 600, letters(draw, 2000)])


def test_hot_copies_and_long_text(spark):
    draw = random.Random(5)
    a, b = letters(draw, 700), letters(draw, 420)
    texts = [a] * 400 + [f"{k:04d}{b}{letters(draw, 40)}" for k in range(1200)] + [letters(draw, 60_000) + b]
    check(spark, texts)


def test_repeated_rows_and_empty_table(spark):
    draw = random.Random(6)
    a = letters(draw, 500)
    docs = documents(spark, [(1, a), (1, a), (None, letters(draw, 500)), (2, letters(draw, 600))])
    rows = sorted((r.doc_id or 0, r.n_removed) for r in substrings.cut_repeats(docs).collect())
    assert rows == [(0, 0), (1, len(a.encode())), (1, len(a.encode())), (2, 0)]
    assert substrings.cut_repeats(docs.limit(0)).count() == 0


def test_hashes_and_windows():
    data = random.Random(1).randbytes(3000) * 2
    h = Hashes(data)
    assert np.array_equal(h.every(50)[:2951], h.every(50)[3000:5951])
    assert len(np.unique(h.every(50)[:3000])) == 3000
    values = np.array([5, 3, 3, 9, 1, 1, 7], np.uint64) << np.uint64(30)
    want = [max(range(i, i + 3), key=lambda j: (-int(values[j]), j)) for i in range(5)]
    assert least_in_windows(values, 3).tolist() == want


def test_planted_passages_around_the_limit(spark):
    """Passages in two documents each, of 399, 400 and 401 bytes, and one of over 50 short words: from 400 bytes on they go."""
    draw = random.Random(17)

    def noise(n):
        return "".join(draw.choice("abcdefgh ") for _ in range(n))

    planted = {size: noise(size) for size in (399, 400, 401)}
    planted["words"] = " ".join(noise(3).replace(" ", "x") for _ in range(60))
    texts = {}
    for k, passage in enumerate(planted.values()):
        for copy in (0, 1):
            # The bytes on both sides differ, so that the repeat is exactly as long as planted.
            texts[10 * k + copy] = noise(300) + "XY"[copy] + passage + "VW"[copy] + noise(300)
    rows = {r.doc_id: r for r in substrings.cut_repeats(documents(spark, texts)).collect()}
    gone = {size: {rows[10 * k + copy].n_removed for copy in (0, 1)} for k, size in enumerate(planted)}
    assert gone == {399: {0}, 400: {400}, 401: {401}, "words": {0}}
