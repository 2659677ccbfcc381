import random
from collections import defaultdict

import numpy as np

from loomgraph.llm import minhash
from loomgraph.llm.common import components
from loomgraph.llm.shingles import WordHashes, ascii_words, shingle_set
from tests.llm.helpers import documents


def plain_sets(texts):
    out = {}
    for k, text in texts.items():
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        words = [w for w in low.replace("\t", " ").replace("\n", " ").split(" ") if w]
        out[k] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    return out


def plainly(texts, threshold=85):
    sets = plain_sets(texts)
    parent = {k: k for k in sets}

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= threshold * (len(sets[a]) + len(sets[b]) - common):
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), top(k), top(k) == k) for k in keys}


def got(docs):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_groups(docs).collect()}


def copies(draw, words, n, most):
    for _ in range(n):
        own = list(words)
        for _ in range(draw.randint(0, most)):
            own[draw.randrange(len(own))] = f"new{draw.randint(0, 10**6)}"
        yield " ".join(own)


def test_against_all_pairs(spark):
    draw = random.Random(8)
    texts = []
    for size in (6, 9, 14, 40, 120, 500):
        for most in (1, 2, max(1, size // 50), max(1, size // 30)):
            base = [f"w{draw.randint(0, 10**6)}" for _ in range(size)]
            texts += list(copies(draw, base, 12, most))
    texts += ["", None, " \t\n", "One Two", "one two", "one two three", "A b c d e", "a B c d e", "É b c d e", "é b c d e"]
    draw.shuffle(texts)
    texts = dict(enumerate(texts))
    assert got(documents(spark, texts)) == plainly(texts)


def test_links_past_the_centre_of_a_bucket(spark):
    """A chain in which each text links only with its neighbours: no star reaches the ends."""
    words = [f"w{k}" for k in range(400)]
    texts = {k: " ".join(words[2 * k : 2 * k + 100]) for k in range(40)}
    assert got(documents(spark, texts)) == plainly(texts)


def test_large_groups(spark):
    draw = random.Random(3)
    base = [f"w{k}" for k in range(150)]
    texts = ["hot copy of one text here"] * 1500 + list(copies(draw, base, 300, 3))
    texts = dict(enumerate(texts))
    assert got(documents(spark, texts)) == plainly(texts)


def test_odd_rows(spark):
    docs = documents(spark, [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, "x y"), (7, None), (7, "")])
    rows = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in minhash.near_groups(docs).collect())
    assert rows == [(0, 1, 0, True), (0, 2, 5, False), (5, 2, 5, True), (5, 2, 5, True), (7, 0, 7, True), (7, 0, 7, True)]
    assert minhash.near_groups(docs.limit(0)).count() == 0
    kept = minhash.drop_near_copies(docs)
    assert kept.count() == 5 and kept.columns == docs.columns


def test_signatures_estimate(spark):
    hashes, draw = WordHashes(), random.Random(1)
    words = [f"w{k}" for k in range(2000)]
    a = shingle_set(hashes.of(ascii_words(" ".join(words))))
    b = shingle_set(hashes.of(ascii_words(next(copies(draw, words, 1, 30)))))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((minhash.signature(a) == minhash.signature(b)).mean() - true) < 0.12


def test_components(spark):
    draw = random.Random(6)
    edges = [(k, k + 1) for k in range(200, 260)] + [(draw.randint(0, 150), draw.randint(0, 150)) for _ in range(90)]
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b), near[b].add(a)
    want = {}
    for k in sorted(near):
        if k not in want:
            todo = [k]
            while todo:
                if (x := todo.pop()) not in want:
                    want[x] = k
                    todo += near[x]
    rows = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in rows} == want and len(rows) == len(want)
