"""The clustered index against all pairs."""

import numpy as np
import pytest
from contigframe.operators import vector_index as V
from contigframe.plans.contigs import build_taxonomy, predict_taxa


def frames(spark, refs, queries):
    r = spark.createDataFrame([(int(i), int(i) % 7, [float(x) for x in v]) for i, v in refs], "vec_id long, taxid long, embedding array<double>")
    q = spark.createDataFrame([(int(i), None if v is None else [float(x) for x in v]) for i, v in queries], "query_id long, embedding array<double>")
    return r, q


def brute(refs, queries, k):
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1.0)
    out = {}
    for i, v in queries:
        if v is not None:
            sims = sorted((-round(float(unit(v) @ unit(x)), 9), j) for j, x in refs)
            out[i] = [(j, -s) for s, j in sims[:k]]
    return out


def clustered(n, n_centres, spread, seed, start=0):
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(99).normal(size=(n_centres, 16))
    return [(start + i, centres[i % n_centres] + spread * rng.normal(size=16)) for i in range(n)]


@pytest.mark.parametrize(("k", "cell"), [(1, 20), (5, 7), (40, 50)])
def test_neighbours_are_those_of_all_pairs(spark, tmp_path, k, cell):
    refs = clustered(300, 12, 0.3, 1)
    refs += [(1000 + i, refs[0][1] * (i + 1)) for i in range(60)]  # copies at many lengths: ties in one cell
    refs += [(2000, np.zeros(16)), (2001, -refs[5][1])]
    queries = [*clustered(40, 12, 0.3, 2, 5000), (6000, refs[0][1]), (6001, np.zeros(16)), (6002, None)]
    r, q = frames(spark, refs, queries)
    index = V.build_index(r, str(tmp_path / "i"), "m", "1", cell)
    got = {}
    for row in sorted(V.nearest_in_index(q, index, k).collect(), key=lambda x: (x.query_id, x.rank)):
        got.setdefault(row.query_id, []).append((row.vec_id, round(row.similarity, 9)))
        assert row.taxid == row.vec_id % 7
    want = brute(refs, queries, k)
    assert got.keys() == want.keys()
    for i, hits in want.items():
        assert [s for _, s in got[i]] == pytest.approx([s for _, s in hits])
        assert [j for j, _ in got[i]] == [j for j, _ in hits]


def test_far_cells_are_not_visited(spark, tmp_path):
    """Queries visit the cells of their own cluster; the others are neither read nor shuffled."""
    r, q = frames(spark, clustered(1200, 30, 0.02, 1), clustered(60, 30, 0.02, 2))
    index = V.build_index(r, str(tmp_path / "i"), cell_rows=20)
    visited = []
    assert V.nearest_in_index(q, index, 3, visited).count() == 180
    copies = sum(v.count() for v in visited)
    assert copies < 60 * len(index.sizes) / 5


def test_queries_are_copied_once_a_tile(spark, tmp_path, monkeypatch):
    """Vectors without clusters leave no cell out; a query is still not copied to every cell."""
    rng = np.random.default_rng(4)
    r, q = frames(spark, enumerate(rng.normal(size=(1500, 16))), enumerate(rng.normal(size=(200, 16)), 5000))
    index = V.build_index(r, str(tmp_path / "i"), cell_rows=5)
    copies, visit = [], V._visit
    monkeypatch.setattr(V, "_visit", lambda asked, *a: copies.append(asked.count()) or visit(asked, *a))
    assert V.nearest_in_index(q, index, 3).count() == 600
    assert len(index.sizes) > 100 and sum(copies) <= 200 * 6


def test_few_references_and_none(spark, tmp_path):
    r, q = frames(spark, clustered(3, 3, 0.1, 1), clustered(4, 3, 0.1, 2))
    assert V.nearest_vectors(q, r, 5).count() == 12
    assert V.nearest_vectors(q, r.limit(0), 5).count() == 0
    assert V.nearest_vectors(q.limit(0), r, 5).count() == 0


def test_taxonomy_of_another_model_is_refused(spark, tmp_path):
    r, q = frames(spark, clustered(30, 3, 0.1, 1), clustered(6, 3, 0.1, 2))
    windows = r.selectExpr("vec_id", "concat('acc', vec_id % 3) AS accession", "embedding")
    accessions = spark.createDataFrame([("acc0", 10), ("acc1", 99)], "accession string, taxid long")
    nodes = spark.createDataFrame([(1, None, "no rank"), (10, 1, "species"), (11, 1, "species")], "taxid long, parent long, rank string")
    names = spark.createDataFrame([(1, "root"), (10, "a"), (11, "b")], "taxid long, name string")
    merged = spark.createDataFrame([(99, 11)], "old long, new long")
    path = str(tmp_path / "tax")
    build_taxonomy(windows, accessions, nodes, names, path, "m", "1", merged, cell_rows=5)
    contigs = q.selectExpr("query_id", "query_id AS seq_id", "embedding")
    got = {x.seq_id: (x.lca, x.lineage) for x in predict_taxa(contigs, path, "m", "1").collect()}
    assert {got[i] for i in (0, 3)} == {(10, "s__a")} and {got[i] for i in (1, 4)} == {(11, "s__b")}
    with pytest.raises(ValueError, match="built with"):
        predict_taxa(contigs, path, "m", "2")
