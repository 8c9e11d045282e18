"""The operators on embeddings against brute force, on rows with everything that a table may hold."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from torqueline.llm import negatives, vector_dedup, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, id string, node string, n string, x string, score string, row string"
ODD = [
    (900, None, 1), (901, [0.0] * 8, 1), (902, [], 1), (903, [float("nan")] + [1.0] * 7, 1), (904, [float("inf")] + [1.0] * 7, 2), (905, [None] + [1.0] * 7, 2),
    (906, [1.0, 2.0, 3.0], 1), (907, [2.0, 4.0, 6.0], 1), (908, [1.0] * 8, None), (909, [1.0] * 8, 3), (909, [1.0] * 8, 3), (909, [-1.0] * 8, 3), (None, [1.0] * 8, 3),
    (910, [2.0] * 8, 3), (700, [1.0] * 8, 3), (911, [-0.0, 1.0] * 4, 4), (912, [0.0, 1.0] * 4, 4), (None, None, None),
]


def clustered(seed: int, clusters=12, size=14, dim=8) -> list:
    """Vectors around cluster centres, at distances that lie on both sides of the threshold."""
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(clusters):
        centre = rng.normal(size=dim)
        centre /= np.linalg.norm(centre)
        for i in range(size):
            noise = rng.normal(size=dim) * rng.uniform(0.0, 0.09)
            rows.append((k * size + i, [float(np.float32(c)) for c in centre + noise], int(k % 3)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e", "f") for r in rows], SCHEMA)


def finite(v):
    return v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v)


def brute_links(rows, threshold=0.98):
    """n_links and component_id of each row, by comparing all pairs."""
    n = len(rows)
    links = [set() for _ in rows]
    for i, (_, v, a) in enumerate(rows):
        for j, (_, w, b) in enumerate(rows[:i]):
            if a is None or a != b or not finite(v) or not finite(w) or len(v) != len(w) or not any(v) or not any(w):
                continue
            x, y = np.array(v, float), np.array(w, float)
            if v == w or x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                links[i].add(j)
                links[j].add(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        component = min(ids) if ids else None
        out.append((rows[i][0], len(links[i]), component, rows[i][0] == component))
    return out


def key(row):
    return tuple((v is None, v) for v in row)


@pytest.mark.parametrize("block", [4096, 5])
def test_near_vectors_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    rows = clustered(1) + ODD
    got = [tuple(r) for r in vector_dedup.near_vectors(frame(spark, rows)).collect()]
    assert sorted(got, key=key) == sorted(brute_links(rows), key=key)
    assert max(r[1] for r in got) > 3


def test_recall_of_links_at_the_threshold(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    c = 0.9801
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate((x, c * x + math.sqrt(1 - c * c) * z)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = {r["id"]: r["component_id"] for r in vector_dedup.near_vectors(df).collect()}
    assert sum(found[i + 1500] == i for i in range(1500)) >= 0.999 * 1500


def test_one_dense_group_and_no_rows(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=16)
    rows = [(i, (base + rng.normal(size=16) * 0.05).tolist(), 7) for i in range(700)]
    got = sorted(tuple(r) for r in vector_dedup.near_vectors(frame(spark, rows)).collect())
    assert got == sorted(brute_links([(i, [float(np.float32(c)) for c in v], k) for i, v, k in rows]))
    assert vector_dedup.near_vectors(frame(spark, [])).collect() == []


def brute_whitening(rows, dim, components=4):
    kept = [(i, [math.floor(256 * c) for c in v]) for i, v, _ in rows if finite(v) and len(v) == dim]
    fit = np.array(sorted({tuple(x) for _, x in kept}))
    n, sums = len(fit), fit.sum(0)
    y = fit - sums / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return [
        (i, k + 1, n, sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums, strict=True)), abs(float((np.array(x) - sums / n) @ u[:, k] / math.sqrt(e[k]))), float(e[k] / (y * y).sum() * n))
        for i, x in kept for k in range(len(e))
    ]


def test_whitening_equals_a_plain_decomposition(spark):
    rows = clustered(3) + ODD
    got = whitening.whiten(frame(spark, rows)).collect()
    want = brute_whitening(rows, 8)
    whole = lambda r: ((r[0] is None, r[0]), r[1:4])
    got_rows = sorted(((r["id"], r["component"], r["n"], r["deviation"], abs(r["whitened"]), r["explained"]) for r in got), key=whole)
    want = sorted(want, key=whole)
    assert [r[:4] for r in got_rows] == [r[:4] for r in want]
    assert np.allclose([r[4:] for r in got_rows], [r[4:] for r in want], rtol=1e-9, atol=1e-9)
    assert {r["identity_error"] for r in got}.pop() < 1e-9
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0), (3, None, 0)])).collect() == []  # no spread, no component


def test_whitening_of_a_thin_cloud_far_from_zero(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (np.array([1e5, -3e5, 7.0]) + rng.normal(size=3) * np.array([3.0, 0.1, 1e-2])).tolist(), 0) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got, want = whitening.whiten(df).collect(), brute_whitening(rows, 3)
    pairs = {(r["id"], r["component"]): r for r in got}
    assert all(np.isclose(abs(pairs[w[0], w[1]]["whitened"]), w[4], rtol=1e-7, atol=1e-7) and pairs[w[0], w[1]]["deviation"] == w[3] for w in want)
    assert len(got) == len(want) == 900


@pytest.mark.parametrize(("d", "rank"), [(1, 1), (9, 9), (30, 4), (41, 41), (6, 0)])
def test_jacobi_on_the_triangular_factor(d, rank):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(d, rank)) * np.exp(2 * rng.normal(size=rank))
    v = a @ a.T
    e, u = whitening.principal(v)
    assert len(e) == rank and (np.diff(e) <= 0).all()
    assert np.allclose(u.T @ u, np.eye(rank), atol=1e-13) and np.allclose(u * e @ u.T, v, atol=1e-13 * max(1e-300, np.trace(v)))


def test_deviations_beyond_long():
    x = np.array([[2**40, -(2**40)], [0, 3]])
    sums = np.array([5, 7], dtype=object)
    exact = [sum((10 * int(c) - int(s)) ** 2 for c, s in zip(row, sums, strict=True)) for row in x.tolist()]
    assert whitening.deviations(x, 10, sums) == [None, exact[1]]


def brute_negatives(rows):
    part = [(k, i, b if i is None or i % 7 else (b + 1) % 10, [math.floor(256 * c) for c in v]) for k, (i, v, b) in enumerate(rows) if finite(v) and b is not None]
    out = []
    for k, i, label, x in part:
        if i is None or i % 100:
            continue
        scored = [(sum(a * b for a, b in zip(x, w, strict=True)), j is None, j, m, other) for m, j, other, w in part if m != k and len(w) == len(x)]
        order = sorted(scored, key=lambda r: (-r[0], r[1], r[2] or 0))
        for p in [r for r in order if r[4] == label][:5]:
            fit = [r for r in order if r[4] != label and 80 * p[0] <= 100 * r[0] <= 100 * p[0]][:5]
            out += [(i, p[2], rank + 1, r[2], p[0], r[0]) for rank, r in enumerate(fit)]
    return out


def mined(df):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return [tuple(r) for r in negatives.mine(df, label=moved, anchors=F.col("vec_id") % 100 == 0).collect()]


@pytest.mark.parametrize(("seed", "block", "chunk"), [(6, 2048, 4096), (7, 20, 2)])
def test_negatives_equal_all_pairs(spark, monkeypatch, seed, block, chunk):
    monkeypatch.setattr(negatives, "LEAST_BLOCK", block)
    monkeypatch.setattr(negatives, "CHUNK", chunk)
    rng = np.random.default_rng(seed)
    near = [(1000 + i, [float(np.float32(c)) for c in np.ones(8) * 0.4 + rng.normal(size=8) * 0.2], int(i % 4)) for i in range(300)]
    rows = near + ODD + [(1000, near[0][1], 2), (1100, near[100][1], near[100][2])]
    got, want = mined(frame(spark, rows)), brute_negatives(rows)
    assert sorted(got, key=key) == sorted(want, key=key) and len(want) > 100
    assert mined(frame(spark, [])) == []


def test_scores_beyond_doubles_are_exact(spark):
    big = 3.0e6
    rows = [(100, [big, big, 1.0], 1), (1, [big, big, 1 / 256], 1), (2, [big, big - 1 / 256, 3.0], 2), (3, [big, big, 0.0], 2), (4, [big * 0.9, big, 0.0], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    whole = {i: [math.floor(Fraction(c) * 256) for c in v] for i, v, _ in rows}
    dot = lambda a, b: sum(x * y for x, y in zip(whole[a], whole[b], strict=True))
    got = sorted(tuple(r) for r in negatives.mine(df, anchors=F.col("vec_id") == 100).collect())
    fit = sorted((n for n in (2, 3, 4) if 80 * dot(100, 1) <= 100 * dot(100, n) <= 100 * dot(100, 1)), key=lambda n: (-dot(100, n), n))
    assert got == sorted((100, 1, k + 1, n, dot(100, 1), dot(100, n)) for k, n in enumerate(fit)) and got
