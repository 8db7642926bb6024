"""Steps that work in blocks, held against brute force with blocks of a few rows."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import pytest

from tropica.graph import Graph
from tropica.operators import triangles
from tropica.plans import blocks


@pytest.fixture
def tiny(monkeypatch):
    """Every table of more than a few rows is cut."""
    of = blocks.tasks_for
    few = lambda spark, rows, each=40, least=10: of(spark, rows, 40, 10)
    monkeypatch.setattr(blocks, "tasks_for", few)
    monkeypatch.setattr(triangles, "tasks_for", few)


@pytest.fixture(scope="module")
def pairs():
    pick = random.Random(5)
    ids = [i * i * 7 - 900 for i in range(40)]
    return {p for p in combinations(ids, 2) if pick.random() < 0.25} | {(ids[0], i) for i in ids[1:]}


@pytest.fixture
def mesh(spark, pairs):
    rows = [(a, b, 1 + (a + b) % 5) for a, b in pairs]
    return Graph(spark.createDataFrame(rows + [(b, a, w) for a, b, w in rows], "src long, dst long, w long"), None, False)


def test_triangles_in_blocks(tiny, mesh, pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {(a, b): len(near[a] & near[b]) for x, y in pairs for a, b in ((x, y), (y, x))}
    found = triangles.support(mesh.edges.select("src", "dst"))
    assert {(r["src"], r["dst"]): r["w"] for r in found.collect()} == {e: w for e, w in want.items() if w}
    count = sum(want.values()) // 6
    assert {m: triangles.triangle_count(mesh, m) for m in ("auto", *triangles.METHODS)} == dict.fromkeys(("auto", *triangles.METHODS), count)
    lists = triangles.successors(mesh.edges)
    moved = triangles.meeting(lists)._jdf.queryExecution().analyzed().toString()
    assert moved.count("RepartitionByExpression") == 2  # lists go to blocks, not to edges


def test_blocks_are_told_apart(spark):
    df = spark.range(-300, 300).selectExpr("id * 3 as src", "id as dst")
    cut = blocks.Blocks.over(df, "src", 7)
    assert cut.n == 7 and len(set(cut.labels)) == 7
    placed = cut.spread(df.withColumn("_b", cut.of("src"))).selectExpr("_b", "spark_partition_id() as p").distinct().collect()
    assert len(placed) == 7 and len({r["p"] for r in placed}) == 7
    sizes = Counter(r["_b"] for r in df.select(cut.of("src").alias("_b")).collect())
    assert max(sizes.values()) <= 90


def test_products_in_blocks(spark, mesh, monkeypatch):
    from tropica.functions import semiring as s

    monkeypatch.setattr(s, "BLOCK_ENTRIES", 40)
    monkeypatch.setattr(s, "MASKED_ENTRIES", 40)
    rows = {(r["src"], r["dst"]): r["w"] for r in mesh.edges.collect()}
    want = Counter()
    for (i, k), x in rows.items():
        for j in (b for a, b in rows if a == k):
            want[i, j] += x * rows[k, j]
    found = lambda **how: {(r["src"], r["dst"]): r["w"] for r in s.mxm(mesh.edges, mesh.edges, "plus_times", **how).collect()}
    assert found() == dict(want)
    assert found(mask=mesh.edges) == {e: w for e, w in want.items() if e in rows}
    assert found(mask=mesh.edges, complement=True) == {e: w for e, w in want.items() if e not in rows}
    plan = s.mxm(mesh.edges, mesh.edges, "plus_times")
    assert "ShuffledHashJoin" in plan._jdf.queryExecution().executedPlan().toString()  # products are summed where they arise


def test_rounds_in_blocks(tiny, spark, mesh, pairs, monkeypatch):
    from tropica.operators import communities, cores, ranking

    ids = {i for p in pairs for i in p}
    near = {i: [a if b == i else b for a, b in pairs if i in (a, b)] for i in ids}
    rank, label, core = dict.fromkeys(ids, 1 / len(ids)), {i: i for i in ids}, {i: len(near[i]) for i in ids}
    for _ in range(3):
        rank = {i: 0.15 / len(ids) + 0.85 * sum(rank[j] / len(near[j]) for j in near[i]) for i in ids}
        seen = {i: Counter(label[j] for j in near[i]) for i in ids}
        label = {i: min(seen[i], key=lambda x: (-seen[i][x], x)) for i in ids}
    for _ in ids:
        core = {i: max(min(k + 1, c) for k, c in enumerate(sorted((core[j] for j in near[i]), reverse=True))) for i in ids}
    found = {r["id"]: r["rank"] for r in ranking.pagerank(mesh, fixed=3, sinks=False)[0].collect()}
    assert found.keys() == rank.keys() and max(abs(found[i] - rank[i]) for i in ids) < 1e-9
    assert {r["id"]: r["label"] for r in communities.cdlp(mesh, 3)[0].collect()} == label
    assert {r["id"]: r["core"] for r in cores.kcore_all(mesh)[0].collect()} == core
