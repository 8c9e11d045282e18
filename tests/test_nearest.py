"""The index of K1 against all pairs."""

import numpy as np
import pytest

from torqueline.operators import nearest, retrieval


def rows_of(spark, m, start=0):
    return spark.createDataFrame([(start + i, v) for i, v in enumerate(m.tolist())], "id long, vec array<double>")


@pytest.mark.parametrize("spread", [0.05, 0.6])
def test_cells_give_the_rows_of_all_pairs(spark, monkeypatch, spread):
    monkeypatch.setattr(nearest, "BLOCK", 40)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 6))
    m = centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 6)) * spread
    m[5], m[6], m[7], m[8] = 0, m[9], m[9], -m[9]
    corpus = rows_of(spark, m).unionByName(spark.createDataFrame([(5000, None)], "id long, vec array<double>"))
    asked = rows_of(spark, np.concatenate((m[:40], np.zeros((1, 6)))), 10_000)
    got, used = nearest.knn_by_cells(asked, corpus, k=7)
    want = retrieval.knn(asked, corpus, k=7)
    assert sorted(map(tuple, got.select("query", "doc", "relevance", "rank").collect())) == sorted(map(tuple, want.select("query", "doc", "relevance", "rank").collect()))
    pairs, read = used.first()
    assert pairs == 41 * 900 and read <= pairs
    if spread < 0.1:
        assert read < 0.35 * pairs  # most cells of a clustered table are never read


def test_few_rows_and_none(spark):
    asked = rows_of(spark, np.array([[1.0, 0.0], [0.0, 0.0]]), 100)
    few = rows_of(spark, np.array([[1.0, 1.0], [-1.0, 0.0], [0.0, 0.0]]))
    got = lambda corpus: sorted(map(tuple, nearest.knn_by_cells(asked, corpus, k=2)[0].select("query", "doc", "relevance", "rank").collect()))
    assert got(few) == [(100, 0, 0.707107, 1), (100, 1, 0.0, 2), (101, 0, 0.0, 1), (101, 1, 0.0, 2)]
    assert got(few.limit(0)) == []
