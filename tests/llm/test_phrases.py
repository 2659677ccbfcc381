import hashlib
import random

import numpy as np

from loomgraph.llm import phrases
from tests.llm.helpers import documents


def words(draw, n):
    return " ".join("".join(draw.choice("abcdefghijé") for _ in range(draw.randint(1, 9))) for _ in range(n))


def names(text, levels):
    symbols = np.frombuffer(text.encode(), np.uint8)
    first = np.zeros(len(symbols), bool)
    first[0] = True
    for _ in range(levels):
        symbols, first = phrases.parse(symbols, first)
    return set(symbols.tolist())


def test_equal_substrings_share_interior_phrases():
    draw = random.Random(1)
    inner = words(draw, 400)
    a, b = words(draw, 11) + inner + words(draw, 60), words(draw, 77) + inner
    for level in (1, 2, 3):
        own = names(inner, level)
        assert len(own & names(a, level)) >= len(own) - 8
        assert len(own & names(a, level) & names(b, level)) >= len(own) - 14


def test_blocks_are_bounded():
    draw = random.Random(2)
    for text in (words(draw, 3000), "a" * 5000, "ab" * 2000, "abcdefgh" * 500):
        symbols = np.frombuffer(text.encode(), np.uint8)
        first = np.zeros(len(symbols), bool)
        first[0] = True
        runs = 1 + int((np.diff(symbols) != 0).sum())
        parsed, _ = phrases.parse(symbols, first)
        assert runs / 13 <= len(parsed) <= runs / 2 + 2


def test_sketches_do_not_depend_on_the_batch():
    draw = random.Random(3)
    texts = [words(draw, draw.randint(0, 300)) for _ in range(50)] + ["", "a", "aa", "b" * 3000]
    alone = np.concatenate([phrases.sketches([t]) for t in texts])
    assert np.array_equal(alone, phrases.sketches(texts))
    edited = texts[0:1] + [words(draw, 200)]
    assert phrases.likeness(phrases.sketches(edited[:1]), phrases.sketches(edited[:1]))[0] == 1


def plainly(texts):
    order = sorted(texts, reverse=True)
    out = {}
    for i, k in enumerate(order):
        own, after = texts[k] or "", texts[order[(i + 1) % len(order)]] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        out[k] = (len(own), hashlib.sha256(edited.encode()).hexdigest(), edited)
    return out


def test_edits_over_ranges(spark, monkeypatch):
    draw = random.Random(4)
    texts = {k * 3: words(draw, draw.randint(0, 200)) for k in range(300)} | {1: None, 2: "", 4: "x"}
    want = plainly(texts)
    for size in (1 << 22, 2000):
        monkeypatch.setattr(phrases, "BUCKET_BYTES", size)
        rows = phrases.edited_fingerprints(documents(spark, texts)).collect()
        assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in rows} == {k: v[:2] for k, v in want.items()}
        assert len(rows) == len(texts)
        for r in rows:
            again = phrases.sketches([want[r.doc_id][2]])
            assert r.edited_fingerprint == ("" if not want[r.doc_id][2] else again[0].astype(">u2").tobytes().hex())
            assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        long = [r for r in rows if r.n_chars > 400]
        assert np.mean([r.near_edited for r in long]) > 0.2 > 0.05 > np.mean([r.near_next for r in long])


def test_odd_rows(spark):
    one = phrases.edited_fingerprints(documents(spark, {7: "abcdef"})).collect()
    assert [(r.near_next, r.n_chars) for r in one] == [(1.0, 6)]
    docs = documents(spark, [(1, "same"), (1, "same"), (None, "null"), (3, None)])
    rows = phrases.edited_fingerprints(docs).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in rows) == [(0, 4), (1, 4), (1, 4), (3, 0)]
    assert phrases.edited_fingerprints(docs.limit(0)).count() == 0
    prints = phrases.fingerprint_documents(docs).collect()
    assert len({r.fingerprint for r in prints if r.doc_id == 1}) == 1
    assert [r.fingerprint for r in prints if r.doc_id == 3] == [""]


MASK = (1 << 64) - 1


def mixed_plainly(h):
    h = ((h ^ h >> 32) * 0x9E3779B97F4A7C15) & MASK
    return h ^ h >> 32


def toss(own, left):
    place = next(k for k in range(64) if (own ^ left) >> k & 1)
    return 2 * place + (own >> place & 1)


def parse_plainly(symbols, tosses):
    runs = []
    for s in symbols:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    labels = [s for s, _ in runs]
    for _ in range(tosses):
        labels = [toss(x, labels[i - 1] if i else x ^ 1) for i, x in enumerate(labels)]
    begins = [0] + [i for i in range(1, len(runs) - 1) if labels[i] > labels[i - 1] and labels[i] > labels[i + 1]]
    out = []
    for start, end in zip(begins, begins[1:] + [len(runs)]):
        total, power = end - start, 1
        for symbol, n in runs[start:end]:
            total += mixed_plainly((symbol + 1 + n * 0xC2B2AE3D27D4EB4F) & MASK) * power
            power = power * 0xD1342543DE82EF95 & MASK
        out.append(mixed_plainly(total & MASK))
    return out


def sketch_plainly(text):
    """By loops over one text: the least of each class of names, and what empty classes take over."""
    symbols, out = list(text.encode()), []
    for level in range(1, 5):
        symbols = parse_plainly(symbols, 4)
        if level < 2:
            continue
        least = {}
        for name in symbols:
            value = name & (1 << 40) - 1
            least[name >> 59] = min(value, least.get(name >> 59, value))
        for k in range(32):
            order = [k, *np.random.default_rng(k).permutation(32).tolist()]
            out.append(next(least[i] for i in order if i in least) & 0xFFFF)
    return out


def test_query_rows_by_plain_loops(spark):
    draw = random.Random(6)
    shared = words(draw, 60)
    texts = {k: words(draw, draw.randint(0, 40)) + shared * (k % 3 == 0) for k in range(40)}
    texts |= {50: None, 51: "", 52: "x", 53: "aaaa", 54: "\U0001f600é" * 9}
    order = sorted(texts, reverse=True)
    sketch = {t: sketch_plainly(t) for t in {*map(lambda t: t or "", texts.values())} | {v[2] for v in plainly(texts).values()} if t}

    def alike(a, b):
        return sum(x == y for x, y in zip(sketch[a], sketch[b])) / 96 if a and b else float(a == b)

    def shown(text):
        return "".join(f"{x:04x}" for x in sketch[text]) if text else ""

    rows = {r.doc_id: r for r in phrases.edited_fingerprints(documents(spark, texts)).collect()}
    assert set(rows) == set(texts)
    for i, (doc_id, edited) in enumerate((k, plainly(texts)[k][2]) for k in order):
        own, after = texts[doc_id] or "", texts[order[(i + 1) % len(order)]] or ""
        got = rows[doc_id]
        assert (got.fingerprint, got.edited_fingerprint) == (shown(own), shown(edited))
        assert abs(got.near_edited - alike(own, edited)) < 1e-12 and abs(got.near_next - alike(own, after)) < 1e-12


def test_one_row_repeated_is_spread_and_ids_may_be_texts(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BUCKET_BYTES", 4000)
    draw = random.Random(8)
    pairs = [("m", "the same row again")] * 400 + [(f"k{i:03d}", words(draw, 20)) for i in range(400)] + [(None, "n")]
    docs = spark.createDataFrame(pairs, "doc_id string, text string").repartition(7)
    held = phrases.in_order(docs).rdd.mapPartitions(lambda rows: [sum(r.doc_id == "m" for r in rows)]).collect()
    assert sum(held) == 400 and max(held) < 200
    rows = phrases.edited_fingerprints(docs).collect()
    assert sorted(r.doc_id or "" for r in rows) == sorted(d or "" for d, _ in pairs)
    whole = sorted((d, t) for d, t in pairs if d)[::-1] + [(None, "n")]
    want = []
    for (doc_id, own), (_, after) in zip(whole, whole[1:] + whole[:1]):
        half = len(own) // 2
        want.append((doc_id or "", hashlib.sha256((own[: len(own) - half] + after[:half]).encode()).hexdigest()))
    assert sorted((r.doc_id or "", r.edited_sha256) for r in rows) == sorted(want)


def test_ranges_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BUCKET_BYTES", 500)
    monkeypatch.setattr(phrases, "MOST_RANGES", 3)
    draw = random.Random(9)
    texts = {k: words(draw, 30) for k in range(60)}
    assert phrases.in_order(documents(spark, texts)).rdd.getNumPartitions() == 3
    rows = phrases.edited_fingerprints(documents(spark, texts)).collect()
    assert {r.doc_id: r.edited_sha256 for r in rows} == {k: v[1] for k, v in plainly(texts).items()}
