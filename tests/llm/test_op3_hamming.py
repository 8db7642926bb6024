from __future__ import annotations

import numpy as np

from tropica.llm import hamming


def brute(vectors: dict, every: int, k: int) -> dict:
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids])
    out = {}
    for q in ids[ids % every == 0]:
        far = np.sqrt(((x - vectors[q]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, far)) if ids[j] != q][:k]
        out[int(q)] = [(int(ids[j]), float(far[j])) for j in order]
    return out


def test_recall_and_measures(spark):
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(40, 32))
    vectors = {i: (centres[i % 40] + 0.3 * draw.normal(size=32)).tolist() for i in range(1, 2001)}
    for i in range(3, 300, 7):
        vectors[i] = vectors[3]  # a vector that repeats
    rows = [(i, v, "x") for i, v in vectors.items()] + [(5000, None, "x"), (5100, [0.0] * 32, "x"), (5200, [float("nan")] * 32, "x"), (5300, [None] + [1.0] * 31, "x"), (None, [1.0] * 32, "x"), (5400, [1.0] * 3, "x"), (100, vectors[100], "x")]
    found = hamming.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")).collect()
    truth = brute(vectors, 100, 10)
    assert {r["query_id"] for r in found} == set(truth)
    hits = 0
    for q, near in truth.items():
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in found if r["query_id"] == q)
        assert [r for r, _, _ in own] == list(range(1, 11)) and [(s, v) for _, v, s in own] == sorted((s, v) for _, v, s in own)
        assert all(abs(s - np.linalg.norm(np.array(vectors[v]) - vectors[q])) < 1e-9 for _, v, s in own)
        hits += len({v for _, v, _ in own} & {v for v, _ in near})
    assert hits >= 0.9 * 10 * len(truth)


def test_few_rows(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert hamming.nearest(make([])).count() == 0 and hamming.nearest(make([(100, None)])).count() == 0
    found = hamming.nearest(make([(100, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (200, [5.0, 0.0])])).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found)[:3] == [(100, 1, 1, 1.0), (100, 2, 2, 1.0), (100, 3, 200, 4.0)] and len(found) == 6


def test_pigeonhole():
    for radius in (0, 3, 8, 13, 20):
        assert sum(r + 1 for r in hamming.part_radii(radius)) == radius + 1


def test_vectors_are_searched_among_their_own_length(spark):
    draw = np.random.default_rng(7)
    vectors = {i: draw.normal(size=8 if i < 150 else 5) for i in range(90, 260)}
    found = hamming.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<double>")).collect()
    for q in (100, 200):
        near = {r["vec_id"] for r in found if r["query_id"] == q}
        same = {i: v for i, v in vectors.items() if len(v) == len(vectors[q])}
        assert len(near) == 10 and len(near & {v for v, _ in brute(same, 100, 10)[q]}) >= 9
