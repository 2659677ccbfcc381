import random
import tracemalloc

import numpy as np

from loomgraph.llm import decontam
from tests.llm.helpers import documents


def greedy_plainly(item, doc, least):
    """String tiling as defined: the longest unmarked match again and again."""
    least = min(least, len(item))
    a, b, total = [False] * len(item), [False] * len(doc), []
    while least:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while (
                    i + n < len(item) and j + n < len(doc)
                    and item[i + n] == doc[j + n] and not a[i + n] and not b[j + n]
                ):
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            break
        a[i : i + n] = b[j : j + n] = [True] * n
        total.append((i, j, n))
    return total


def test_tiles_against_plain_code():
    draw = random.Random(5)
    for _ in range(150):
        item = [draw.randint(0, 3) for _ in range(draw.randint(0, 14))]
        doc = [draw.randint(0, 3) for _ in range(draw.randint(0, 30))]
        least = draw.randint(2, 4)
        made = decontam.tiles(np.array(item, np.uint64), np.array(doc, np.uint64), least)
        assert made == greedy_plainly(item, doc, least)


def test_tiles_in_steps(monkeypatch):
    draw = random.Random(6)
    monkeypatch.setattr(decontam, "PAIRS", 7)
    for n in range(250):
        words = draw.randint(0, 2)
        item = [draw.randint(0, words) for _ in range(draw.randint(0, 16))]
        doc = [draw.randint(0, words) for _ in range(draw.randint(0, 34))]
        least = draw.randint(1, 4)
        made = decontam.tiles(np.array(item, np.uint64), np.array(doc, np.uint64), least, held=1 + n % 5)
        assert made == greedy_plainly(item, doc, least)


def test_one_word_repeated_takes_bounded_memory():
    item, doc = np.zeros(400, np.uint64), np.zeros(200_000, np.uint64)
    doc[777::1000] = 1
    tracemalloc.start()
    made = decontam.tiles(item, doc)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made == [(0, 0, 400)]
    assert peak < 300e6


def leaks(docs, benchmark, **more):
    return {(r.doc_id, r.item_id): (r.matched_tokens, r.tiles) for r in decontam.find_leaks(docs, benchmark, **more).collect()}


def test_leaks(spark):
    item = [f"q{k}" for k in range(40)]
    other = [f"o{k}" for k in range(200)]
    benchmark = spark.createDataFrame(
        [(1, " ".join(item)), (2, "Short item"), (3, None), (4, ""), (5, "..."), (1, " ".join(item))],
        "item_id long, text string",
    )
    moved = item[20:30] + other[:5] + item[:10] + other[5:9] + item[30:] + other[9:20] + item[10:20]
    texts = {
        1: " ".join(other + item + other),
        2: " ".join(moved).upper() + "!",
        3: " ".join(other[:50] + item[:31] + other[50:]),
        4: " ".join(other[:50] + item[:32] + other[50:]),
        5: " ".join(x for pair in zip(item, other, strict=False) for x in pair),
        6: "a short, ITEM b",
        7: None,
        8: "",
        9: " ".join(item[:8] * 20),
        10: " ".join(other * 500 + item),
    }
    docs = documents(spark, texts).withColumnRenamed("kept", "item_id")
    want = {(1, 1): (40, 1), (2, 1): (40, 4), (4, 1): (32, 1), (6, 2): (2, 1), (10, 1): (40, 1)}
    assert leaks(docs, benchmark) == want
    assert leaks(docs, benchmark, slice_chars=0) == want
    twice = docs.union(docs)
    rows = [sorted(decontam.find_leaks(twice, benchmark, slice_chars=n).collect()) for n in (0, 10_000)]
    assert rows[0] == rows[1] and len(rows[0]) == 18
    for chars in (0, 10_000):
        kept = decontam.drop_leaks(docs, benchmark, slice_chars=chars)
        assert {r.doc_id for r in kept.collect()} == {3, 5, 7, 8, 9} and kept.columns == docs.columns
    assert leaks(docs.limit(0), benchmark) == {} and leaks(docs, benchmark.limit(0)) == {}
    assert leaks(docs.limit(0), benchmark, slice_chars=0) == {}
    assert leaks(docs, benchmark.where("text IS NULL OR text = '...'"), slice_chars=0) == {}


def test_items_of_frequent_windows_by_join(spark):
    draw = random.Random(9)
    common = [[f"c{k}w{n}" for n in range(6)] for k in range(8)]
    own = lambda k, n: [f"i{k}w{m}" for m in range(n)]
    items = [(k, " ".join(sum(draw.sample(common, k % 7), []) + own(k, draw.randint(0, 12)))) for k in range(60)]
    docs = {}
    for d in range(150):
        words = sum(draw.sample(common, 5), [])
        if d % 3 == 0:
            words = words[: draw.randint(0, 20)] + items[draw.randrange(60)][1].split() + words
        docs[d] = " ".join(words)
    docs, benchmark = documents(spark, docs), spark.createDataFrame(items, "item_id long, text string")
    want = leaks(docs, benchmark)
    assert len(want) > 50 and leaks(docs, benchmark, slice_chars=0) == want
