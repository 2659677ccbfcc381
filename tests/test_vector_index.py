"""The cell index against a scan of all rows."""

import numpy as np
import pytest

from loomgraph.operators import search, vector_index

KINDS = "id long, embedding array<double>, label string"


@pytest.fixture(scope="module")
def rows(spark):
    """Six clusters, one with a third of all rows as copies, and rows that never rank."""
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(6, 8))
    vectors = [(i, (centres[i % 6] + 0.05 * draw.normal(size=8)).tolist(), f"c{i % 6}") for i in range(300)]
    vectors += [(1000 + i, centres[2].tolist(), "copy") for i in range(150)]
    vectors += [(2000, None, "x"), (2001, [0.0] * 8, "x"), (2002, [1.0, 2.0], "x"), (2003, [float("nan")] * 8, "x")]
    return spark.createDataFrame(vectors, KINDS)


def same(got, want):
    assert [(r.id, r.label, r.score) for r in got] == [(r.id, r.label, r.score) for r in want]


def test_equal_to_a_scan_and_reads_less(spark, rows, tmp_path):
    vector_index.build_index(rows, str(tmp_path / "i"), cells=16)
    index = vector_index.VectorIndex(spark, str(tmp_path / "i"))
    assert sum(c.rows for c in index.cells) == 450
    draw = np.random.default_rng(6)
    for query in ([*draw.normal(size=8)], rows.where("id = 4").first().embedding):
        for k in (1, 40, 600):
            got, want = index.search(query, k, ["id"]).collect(), search.nearest(rows, query, k, ["id"]).collect()
            key = lambda r: (-r.score, r.id)
            same(sorted(got, key=key), sorted(want, key=key))
            assert len(got) == min(k, 450)
            if k == 1:
                assert len(index.read) < len(index.cells) / 2
    query = rows.where("id = 7").first().embedding
    got = index.search(query, 5, ["id"], where="label = 'c3'").collect()
    same(sorted(got, key=lambda r: r.id), sorted(search.nearest(rows.where("label = 'c3'"), query, 5, ["id"]).collect(), key=lambda r: r.id))


def test_only_chosen_cells_are_read(spark, rows, tmp_path):
    vector_index.build_index(rows, str(tmp_path / "i"), cells=16)
    part = spark.read.parquet(str(tmp_path / "i/vectors")).where("cell IN (1, 2)")
    assert "PartitionFilters: [cell" in part._jdf.queryExecution().executedPlan().toString()


def test_bounds_hold(rows, spark, tmp_path):
    vector_index.build_index(rows, str(tmp_path / "i"), cells=9)
    index = vector_index.VectorIndex(spark, str(tmp_path / "i"))
    query = np.random.default_rng(7).normal(size=8)
    query /= np.linalg.norm(query)
    best = {c.number: c.best_score(query) for c in index.cells}
    for r in spark.read.parquet(str(tmp_path / "i/vectors")).collect():
        v = np.array(r.embedding)
        assert v @ query / np.linalg.norm(v) <= best[r.cell] + 1e-12


def test_empty_index(spark, rows, tmp_path):
    vector_index.build_index(rows.where("id >= 2000 AND id < 2002"), str(tmp_path / "i"))
    index = vector_index.VectorIndex(spark, str(tmp_path / "i"))
    assert index.search([1.0] * 8, 3, ["id"]).count() == 0
