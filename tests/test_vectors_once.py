"""Vectors by content: a provider sees each text once."""

from collections import Counter

from pyspark.sql import functions as F

from loomgraph.config import EmbeddingConfig, RepoConfig
from loomgraph.engine import Workspace
from loomgraph.functions.embedding import char_bins, dimension
from loomgraph.operators.incremental import unseen_texts, with_vectors
from tests.test_workspace import write


def test_each_text_is_sent_once(spark, tmp_path):
    """Two sources and three runs with common texts, one of them in very many files."""
    root, seen = tmp_path / "p", tmp_path / "seen"
    seen.mkdir()
    folder = str(seen)

    def provider(texts, config):
        import uuid

        for text in texts:
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as file:
                file.write(text)
        return [char_bins(t, dimension(config)).tolist() for t in texts]

    def sent():
        return Counter(path.read_text() for path in seen.iterdir())

    (root / "notes").mkdir(parents=True)
    repo = RepoConfig("a", str(root), str(root / "notes"), ["**/*.txt"], ["docs/*.md"], [])
    space = Workspace(spark, repo, EmbeddingConfig("offline", "char-bins"), str(tmp_path / "store"), provider)
    for i in range(30):
        write(root, f"c{i}.txt", "a text that all share\n" if i % 3 else f"own text {i}\n")
    write(root, "docs/one.md", "a text that all share\n")
    assert space.index("code") == 30
    first = sent()
    assert set(first.values()) == {1} and len(first) == 11
    assert space.index("docs") == 1
    write(root, "c1.txt", "own text 0\n")
    write(root, "c2.txt", "something new\n")
    assert space.index("code") == 2
    assert set(sent().values()) == {1} and len(sent()) - len(first) in (1, 2)
    rows = space.store.live_chunks("a").select("chunk_text", "embedding").collect()
    assert len(rows) == 31
    for r in rows:
        assert abs(sum(a * b for a, b in zip(r.embedding, char_bins(r.chunk_text, len(r.embedding)), strict=True)) - 1) < 1e-5


def test_joins(spark):
    chunks = spark.createDataFrame([("h1", "a", 1), ("h1", "a", 2), ("h2", "b", 3)], "text_hash string, chunk_text string, n int")
    stored = spark.createDataFrame([("h2", [1.0]), ("h2", [1.0]), ("h9", [9.0])], "text_hash string, embedding array<float>")
    assert [tuple(r) for r in unseen_texts(chunks, stored).collect()] == [("h1", "a")]
    assert [(r.n, r.embedding) for r in with_vectors(chunks, stored).collect()] == [(3, [1.0])]
    assert unseen_texts(chunks.where(F.lit(False)), stored).count() == 0
