import importlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.config import EmbeddingConfig
from loomgraph.functions import embedding as emb
from loomgraph.functions.vectors import cosine
from loomgraph.operators.overlay import overlay, overlay_work
from loomgraph.operators.search import nearest

ROWS = "id long, file int, embedding array<float>"


def frame(spark, vectors, files):
    rows = [(i, int(f), [float(x) for x in v]) for i, (v, f) in enumerate(zip(vectors, files))]
    return spark.createDataFrame(rows, ROWS)


def brute_force(vectors, files, least, top):
    vectors = np.asarray(vectors, dtype="float32").astype("float64")
    with np.errstate(invalid="ignore"):
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 6)
    found = set()
    for i in range(len(vectors)):
        ranked = sorted(
            (-scores[i, j], j) for j in range(len(vectors))
            if files[i] != files[j] and scores[i, j] >= least
        )
        found |= {(i, j, round(-s, 6)) for s, j in ranked[:top]}
    return found


def clustered(rng, n, copies):
    centres = rng.normal(size=(6, 8))
    vectors = centres[rng.integers(0, 6, n)] + 0.15 * rng.normal(size=(n, 8))
    vectors[:copies] = vectors[0]
    vectors[copies] = 0.0
    return vectors, rng.integers(0, 9, n)


@pytest.mark.parametrize("least, tile", [(0.9, 16), (0.2, 25), (-1.0, 2048)])
def test_overlay_equals_brute_force(spark, least, tile):
    vectors, files = clustered(np.random.default_rng(1), 150, 50)
    got = overlay(frame(spark, vectors, files), least, 4, tile_rows=tile).collect()
    assert len(got) == len({(r["src"], r["dst"]) for r in got})
    assert {(r["src"], r["dst"], round(r["score"], 6)) for r in got} == brute_force(
        vectors, files, least, 4
    )


@pytest.mark.parametrize("least, width, spread", [(0.78, 64, 1.0), (0.3, 48, 0.4), (-0.9, 3, 1.0), (-1.0, 33, 0.0), (0.1, 1, 1.0)])
def test_pairs_given_up_part_way_are_none_of_the_best(spark, least, width, spread):
    rng = np.random.default_rng(width)
    vectors = rng.normal(size=(4, width))[rng.integers(0, 4, 700)] + spread * rng.normal(size=(700, width))
    vectors[600:] = np.round(vectors[:100])
    vectors[690:] = vectors[5]
    files = rng.integers(0, 30, 700)
    # Products of few pairs and of many differ in their last bits, so scores are compared, not ids.
    got = overlay(frame(spark, vectors, files), least, 3, tile_rows=300).collect()
    best, found = {}, {}
    for src, _, score in brute_force(vectors, files, least, 3):
        best.setdefault(src, []).append(score)
    for r in got:
        found.setdefault(r["src"], []).append(r["score"])
    assert found.keys() == best.keys()
    for src, scores in best.items():
        assert sorted(found[src]) == pytest.approx(sorted(scores), abs=2e-6)


def test_share_of_full_products(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").selectExpr(
        "vec_id AS id", "label AS file", "embedding"
    )
    share = {}
    for least in (0.3, 0.78):
        work = overlay_work(rows, least).first()
        assert work.possible == 250_000 and work.full <= work.compared <= work.possible
        share[least] = work.full / work.possible
    assert share[0.3] < 0.25 and share[0.78] < 0.01
    none = overlay_work(rows.limit(0)).first()
    assert (none.possible, none.compared, none.full) == (0, 0, 0)


def test_overlay_stays_within_scopes(spark):
    vectors, files = clustered(np.random.default_rng(2), 40, 5)
    rows = frame(spark, vectors, files)
    both = rows.withColumn("repo", F.lit("a")).unionByName(
        rows.withColumn("repo", F.lit("b")).withColumn("id", F.col("id") + 1000)
    )
    got = overlay(both, 0.5, 3, scope="repo", tile_rows=10).collect()
    want = brute_force(vectors, files, 0.5, 3)
    assert {(r["src"], r["dst"]) for r in got if r["repo"] == "a"} == {(a, b) for a, b, _ in want}
    assert {(r["src"] - 1000, r["dst"] - 1000) for r in got if r["repo"] == "b"} == {
        (a, b) for a, b, _ in want
    }


def test_overlay_of_ids_with_several_vectors(spark):
    rng = np.random.default_rng(3)
    vectors, _ = clustered(rng, 90, 12)
    ids = rng.integers(0, 30, 90)
    files = ids % 7
    rows = [(int(i), int(f), [float(x) for x in v]) for i, f, v in zip(ids, files, vectors)]
    got = overlay(
        spark.createDataFrame(rows + rows[:9], ROWS), 0.3, 3, tile_rows=11, unique_ids=False
    ).collect()
    single = np.asarray(vectors, dtype="float32").astype("float64")
    with np.errstate(invalid="ignore"):
        unit = single / np.linalg.norm(single, axis=1, keepdims=True)
    best = {}
    for a, b in np.argwhere(np.round(unit @ unit.T, 6) >= 0.3):
        if files[a] != files[b]:
            pair = (int(ids[a]), int(ids[b]))
            best[pair] = max(best.get(pair, -1), round(float(unit[a] @ unit[b]), 6))
    want = set()
    for src in set(ids.tolist()):
        ranked = sorted((-s, b) for (a, b), s in best.items() if a == src)
        want |= {(src, b, -s) for s, b in ranked[:3]}
    assert {(r["src"], r["dst"], round(r["score"], 6)) for r in got} == want


def test_overlay_of_nothing(spark):
    assert overlay(frame(spark, [], [])).count() == 0


def test_nearest_filters_first_and_leaves_out_zero_vectors(spark):
    rows = frame(spark, [[1, 0], [2, 0], [0, 0], [1, 1], [-1, 0]], [1, 1, 1, 2, 2])
    got = nearest(rows, [1.0, 0.0], 10, ["id"]).collect()
    assert [(r["id"], r["score"]) for r in got] == [(0, 1.0), (1, 1.0), (3, 0.707107), (4, -1.0)]
    got = nearest(rows, [1.0, 0.0], 1, ["id"], where=F.col("file") == 2).collect()
    assert [r["id"] for r in got] == [3]
    pair = rows.select(cosine(F.col("embedding"), F.col("embedding")).alias("s"))
    assert [r["s"] for r in pair.collect()] == [1.0, 1.0, None, 1.0, 1.0]


def test_offline_embedder():
    vector = emb.char_bins("aab")
    assert vector[0] == pytest.approx(1 / 6**0.5) and vector[97] == pytest.approx(2 / 6**0.5)
    assert emb.char_bins("")[0] == 1.0
    assert emb.char_bins("\U0001f600")[[0xD83D % 768, 0xDE00 % 768]].min() > 0


@pytest.mark.parametrize("kind, model, size", [
    ("ollama", "nomic-embed-text", 768), ("tei", "x", 3584), ("openai", "mistral-embed", 1024),
    ("none", "none", 768),
])
def test_dimension(kind, model, size):
    assert emb.dimension(EmbeddingConfig(kind, model)) == size


@pytest.mark.parametrize("kind, base, url, auth", [
    ("openai", None, "https://api.openai.com/v1/embeddings", "Bearer k"),
    ("mistral", "http://ignored", "https://api.mistral.ai/v1/embeddings", "Bearer k"),
    ("lmstudio", "http://h:1/v1/", "http://h:1/v1/embeddings", None),
    ("tei", None, "http://localhost:8080/v1/embeddings", "Bearer k"),
    ("omlx", "http://h", "http://h/v1/embeddings", "Bearer k"),
])
def test_requests_in_the_common_format(kind, base, url, auth):
    seen = []

    def post(target, headers, body):
        seen.append((target, headers.get("Authorization"), body))
        return {"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]}

    config = EmbeddingConfig(kind, "m", "k", base)
    assert emb.request_vectors(["a", "b"], config, post) == [[1.0], [2.0]]
    assert seen == [(url, auth, {"model": "m", "input": ["a", "b"]})]


def test_requests_of_the_other_providers():
    urls = []

    def post(url, headers, body):
        urls.append(url)
        return {"embeddings": [[3.0]], "embedding": {"values": [4.0]}}

    assert emb.request_vectors(["a"], EmbeddingConfig("ollama", "m"), post) == [[3.0]]
    assert emb.request_vectors(["a", "b"], EmbeddingConfig("google", "m", "k"), post) == [[4.0]] * 2
    assert urls[0] == "http://localhost:11434/api/embed"
    assert urls[1].endswith("/v1beta/models/m:embedContent") and len(urls) == 3
    with pytest.raises(ValueError):
        emb.embed_texts(["a"], EmbeddingConfig("nobody", "m"))


def test_a_failed_call_is_repeated_and_then_an_error(monkeypatch):
    monkeypatch.setattr(emb.time, "sleep", lambda seconds: None)
    calls = []

    def call(texts, config):
        calls.append(list(texts))
        if len(calls) % 2 or "bad" in texts:
            raise OSError("no")
        return [[1.0] * 384 for _ in texts]

    config = EmbeddingConfig("lmstudio", "all-minilm")
    texts = ["x" * 3000, "y"] + ["z"] * 9
    assert [sum(v) for v in emb.embed_texts(texts, config, call)] == [384.0] * 11
    assert calls[0] == calls[1] == texts[:10] and calls[-1] == ["z"]
    with pytest.raises(OSError):
        emb.embed_texts(["bad"], config, call)
    with pytest.raises(ValueError):
        emb.embed_texts(["a"], config, lambda t, c: [[1.0]])


def test_texts_that_a_model_would_cut_are_an_error(spark):
    config = EmbeddingConfig("offline", "char-bins")
    rows = spark.createDataFrame([("x" * 4001,)], "t string")
    with pytest.raises(Exception, match="chunk it first"):
        rows.select(emb.embed(F.col("t"), config)).collect()
    with pytest.raises(ValueError):
        emb.embed_query("x" * 4001, config)


def test_null_and_other_sized_vectors(spark):
    rows = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.0, 0.0]), (5, [3.0, 4.0]), (6, [])], "id long, embedding array<double>"
    )
    assert [(r.id, r.score) for r in nearest(rows, [1.0, 0.0], 9, ["id"]).collect()] == [(1, 1.0), (5, 0.6)]
    turned = rows.select("id", cosine(F.col("embedding"), F.array(F.lit(0.0), F.lit(2.0))).alias("s"))
    assert {r.id: r.s for r in turned.collect()} == {1: 0.0, 2: None, 3: None, 4: None, 5: 0.8, 6: None}
    other = rows.select("id", cosine(F.col("embedding"), F.col("embedding")).alias("s"))
    assert {r.id: r.s for r in other.collect()} == {1: 1.0, 2: None, 3: 1.0, 4: None, 5: 1.0, 6: None}


@pytest.mark.parametrize("model, mode, prefix", [
    ("nomic-embed-code", "query", emb.CODE_QUERY_PREFIX), ("nomic-embed-code", "document", ""),
    ("nomic-embed-text", "query", "search_query: "),
    ("nomic-embed-text:v1", "document", "search_document: "), ("nomic-embed-text2", "query", ""),
    ("a/Qwen3-Embedding-8B", "query", emb.QWEN_QUERY_PREFIX), ("other", "document", ""),
])
def test_prefix_and_cut(spark, model, mode, prefix):
    rows = spark.createDataFrame([("x" * n,) for n in (1, 3999, 4000, 4001)], "t string")
    sent = emb.model_input(F.col("t"), F.lit(model), F.lit(mode))
    got = [r[0] for r in rows.select(sent).collect()]
    assert got == [(prefix + "x" * n)[:4000] for n in (1, 3999, 4000, 4001)]


def test_slices_grow_with_the_vectors_and_tiles_are_dealt_by_their_number(spark, monkeypatch):
    tiling = importlib.import_module("loomgraph.operators.overlay")
    monkeypatch.setattr(tiling, "TILE_ROWS", 20)
    monkeypatch.setattr(tiling, "SLICES", 4)
    vectors, files = clustered(np.random.default_rng(7), 400, 0)
    rows = frame(spark, vectors, files)
    _, entries, _, left, right, tile = tiling._tiles(rows, -1.0, 4, None, None, True)
    n = entries.count()
    # Of slices of 20, as few vectors have them, each vector would be sent about 20 times.
    assert max(left.count(), right.count()) <= 9 * n
    made = left.select(*tile).distinct().count()
    assert left.rdd.getNumPartitions() == right.rdd.getNumPartitions() >= made
    monkeypatch.setattr(tiling, "STEP_PAIRS", 100)
    got = {(r["src"], r["dst"], round(r["score"], 6)) for r in overlay(rows, -1.0, 4).collect()}
    assert got == brute_force(vectors, files, -1.0, 4)


def overlay_by_hand(rows, least, top):
    """{src: [(dst, score)]} of (id, file, vector) rows, whose ids may have several vectors."""
    unit = np.asarray([v for _, _, v in rows], dtype="float32").astype("float64")
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    best = {}
    for a, b in np.argwhere(np.round(unit @ unit.T, 12) >= least):
        if rows[a][1] != rows[b][1]:
            of_src = best.setdefault(rows[a][0], {})
            of_src[rows[b][0]] = max(of_src.get(rows[b][0], -2), round(float(unit[a] @ unit[b]), 12))
    return {
        src: [(b, round(s, 6)) for b, s in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:top]]
        for src, found in best.items()
    }


@pytest.mark.parametrize("files, least, per_id, steps", [(3, 0.2, 1, None), (90, 0.2, 3, None), (40, -1.0, 2, 7), (2, 0.9, 1, 7)])
def test_tile_of_named_ids(spark, monkeypatch, files, least, per_id, steps):
    tiling = importlib.import_module("loomgraph.operators.overlay")
    if steps:
        for name in ("BLOCK_ROWS", "FIRST_STEP", "SAMPLE", "STEP_PAIRS", "PART_VALUES"):
            monkeypatch.setattr(tiling, name, steps)
    rng = np.random.default_rng(files)
    vectors = rng.normal(size=(9, 40))[rng.integers(0, 9, 180)] + 0.4 * rng.normal(size=(180, 40))
    vectors[:20] = 2 * vectors[0]
    vectors[20:40] = np.round(vectors[20:40])
    owner = rng.integers(0, files, 180)
    rows = [(f"f{owner[i // per_id]}::s{i // per_id}", f"f{owner[i // per_id]}", [float(x) for x in v])
            for i, v in enumerate(vectors)]
    # Each vector has a second id, too.
    rows += [(f"{i}-more", f, v) for i, f, v in rows[::2]]
    frame = spark.createDataFrame(rows, "id string, file string, embedding array<float>")
    found = {}
    for r in overlay(frame, least, 4, unique_ids=False).orderBy("src", F.desc("score"), "dst").collect():
        found.setdefault(r["src"], []).append((r["dst"], r["score"]))
    assert found == {s: sorted(e, key=lambda x: (-x[1], x[0])) for s, e in overlay_by_hand(rows, least, 4).items()}


def test_few_products_are_exact_and_ids_of_a_vector_are_one_column(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").selectExpr(
        "vec_id AS id", "label AS file", "embedding"
    )
    assert overlay_work(rows, -0.5, 3).first().full < 0.05 * 250_000
    twice = rows.unionByName(rows.withColumn("id", F.col("id") + 1000))
    assert overlay_work(twice, -0.5, 3, unique_ids=False).first().compared == 250_000


def test_single_precision_gives_up_no_pair(spark):
    rng = np.random.default_rng(5)
    near = rng.normal(size=64) + 1e-7 * rng.normal(size=(300, 64))
    rows = [(i, i % 3, [float(x) for x in v]) for i, v in enumerate(near)]
    got = overlay(spark.createDataFrame(rows, "id long, file int, embedding array<double>"), 0.3, 2)
    unit = near / np.linalg.norm(near, axis=1, keepdims=True)
    scores = np.round(unit @ unit.T, 12)
    scores[np.arange(300)[:, None] % 3 == np.arange(300) % 3] = -1
    want = {(i, int(j)) for i in range(300) for j in np.lexsort((np.arange(300), -scores[i]))[:2]}
    assert {(r["src"], r["dst"]) for r in got.collect()} == want
