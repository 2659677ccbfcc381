import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

import corpus_pipeline
from loomgraph.llm import langid
from tests.llm.helpers import documents
from tests.llm.test_minhash import plain_sets

SF = "/root/testdata/sf0.001"


def near_kept(spark, docs):
    return sorted(r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, SF).collect())


def test_near_dedup_from_four_fifths(spark):
    """1000 words with 20 or 21 edits far apart: at least 0.8 alike, below 0.85; with 26, below 0.8."""
    words = [f"w{k}" for k in range(1000)]

    def edited(n):
        gap = 1000 // n
        return " ".join(f"new{k}" if k % gap == gap // 2 and k // gap < n else w for k, w in enumerate(words))

    texts = {1: " ".join(words), 2: edited(20), 3: edited(26), 4: " ".join(words[::-1]), 5: edited(21)}
    sets = plain_sets(texts)
    alike = {k: len(sets[1] & sets[k]) / len(sets[1] | sets[k]) for k in sets}
    assert 0.8 <= alike[5] <= alike[2] < 0.85 and alike[3] < 0.8
    assert near_kept(spark, documents(spark, texts)) == [1, 3, 4]


def test_near_dedup_of_the_sample(spark):
    """All pairs of the sample's documents, compared by plain code at 0.8."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets = plain_sets({r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()})
    least = {k: k for k in sets}

    def top(k):
        while least[k] != k:
            k = least[k]
        return k

    for a in sorted(sets):
        for b in range(a):
            if b in sets and (common := len(sets[a] & sets[b])) and 5 * common >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                least[y] = x
    assert near_kept(spark, docs) == [k for k in sorted(sets) if top(k) == k]


def test_near_dedup_leaves_one_of_each_group(spark):
    long = [f"w{k}" for k in range(60)]
    rows = [
        (1, "a b c d e f"), (1, "a b c d e f"), (9, "A b c d e f"),  # a repeated row and a copy
        (2, " ".join(long)), (2, " ".join(long[:-1])),  # near copies under one id
        (2, "of another kind than the others are"),  # the same id, but no copy
        (None, "p q r s t u"), (None, "p q r s t u"), (None, "P q r s t u"),  # a group without ids
        (None, "x y z"), (3, None), (4, ""),
    ]
    kept = corpus_pipeline.one_of_each(spark, documents(spark, rows), SF).collect()
    texts = sorted((r.doc_id or 0, (r.text or "").lower()[:6]) for r in kept)
    assert texts == [(0, "p q r "), (0, "x y z"), (1, "a b c "), (2, "of ano"), (2, "w0 w1 "), (3, ""), (4, "")]
    hot = documents(spark, [(5, "the same row again and again")] * 3000 + [(6, "another text than the others")])
    assert near_kept(spark, hot.repartition(4)) == [5, 6]


def test_language_decides(spark):
    """A long text half in one language, half in another is dropped; a short one is not judged."""
    first, second = "abcdefgh", "klmnopqr"
    draw = random.Random(4)

    def said(letters, words):
        return " ".join("".join(draw.choice(letters) for _ in range(5)) for _ in range(words))

    rows = [(k, said((first, second)[k % 2], 60)) for k in range(200)]
    rows += [(k, f"{said(first, 150)} {said(second, 150)}") for k in range(200, 220)] + [(220, "abcdk lmnop"), (221, "12")]
    lang = F.when(F.col("doc_id") < 200, F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b"))
    docs = documents(spark, rows).withColumn("lang", lang)
    kept = {r.doc_id for r in corpus_pipeline.known_language(spark, docs, SF).collect()}
    named = {r.doc_id: r.ambiguous for r in langid.identify(docs).collect()}
    assert any(named[k] for k in range(200, 220))
    assert kept == {k for k in range(221) if k == 220 or not named[k]} >= {*range(200), 220}


def test_language_without_labels(spark):
    rows = [(1, "some words"), (2, "é"), (3, "12 !?"), (4, None), (5, "")]
    docs = documents(spark, rows).withColumn("lang", F.lit(None).cast("string"))
    assert sorted(r.doc_id for r in corpus_pipeline.known_language(spark, docs, SF).collect()) == [1, 2]
