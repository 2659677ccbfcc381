import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from loomgraph.llm import shards
from tests.llm.helpers import documents


def weights(rows):
    sizes, slots = Counter(), defaultdict(list)
    for r in rows:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes


def test_near_equal_bytes_and_gapless_slots(spark):
    draw = random.Random(1)
    texts = {k: "w" * draw.randint(0, 400) + str(k) for k in range(4000)}
    sizes = weights(rows := shards.shard_documents(documents(spark, texts)).collect())
    assert len(rows) == 4000 and {r.doc_id for r in rows} == set(texts)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * 410
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 for r in rows)


def test_a_group_of_half_of_all_rows_is_cut(spark):
    texts = {k: "same text" if k % 2 else f"own {k:5d}" for k in range(4000)}
    sizes = weights(shards.shard_documents(documents(spark, texts)).collect())
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 40


def test_small_groups_stay_together(spark):
    texts = {k: f"text {k // 4}" for k in range(4000)}
    rows = shards.shard_documents(documents(spark, texts), tolerance=0.02).collect()
    where = defaultdict(set)
    for r in rows:
        where[texts[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_odd_rows(spark):
    docs = documents(spark, [(1, None), (1, None), (2, ""), (None, "é"), (1, "x" * 50_000)])
    rows = shards.shard_documents(docs, shards=3).collect()
    weights(rows)
    assert sorted(r.size for r in rows) == [1, 1, 1, 3, 50_001]
    assert shards.shard_documents(docs.limit(0)).count() == 0
    assert shards.shard_documents(documents(spark, {1: "only"})).count() == 1


def test_splitters_against_all_keys_sorted(spark):
    """Boundaries lie where the sorted keys of all rows have their share of bytes, within the tolerance."""
    draw = random.Random(2)
    texts = {k: "same" * 9 if k % 3 == 0 else "w" * draw.randint(0, 300) + str(k) for k in range(3000)}
    rows = shards.shard_documents(documents(spark, texts)).select(
        "size", "shard", "slot", F.xxhash64("text", F.col("text").isNull()).alias("h1"),
        F.xxhash64("doc_id", F.col("doc_id").isNull()).alias("h2"),
    ).collect()
    ordered = sorted(rows, key=lambda r: (r.h1, r.h2))
    assert [r.shard for r in ordered] == sorted(r.shard for r in rows)
    total, below, largest = sum(r.size for r in rows), 0, max(r.size for r in rows)
    for a, b in zip(ordered, ordered[1:]):
        below += a.size
        if a.shard != b.shard:
            assert b.shard == a.shard + 1
            assert abs(below - total * b.shard / 8) <= shards.TOLERANCE * total / 8 + largest


def test_offsets_are_not_forced_on_every_task(spark):
    docs = documents(spark, {k: str(k) for k in range(50)})
    assert "broadcast" not in shards.shard_documents(docs)._jdf.queryExecution().analyzed().toString().lower()
