"""What steps hold and move as tables grow."""

from __future__ import annotations

from pyspark.sql import functions as F

from tropica.functions import semiring as s
from tropica.graph import Graph
from tropica.operators import triangles
from tropica.plans import blocks


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_builds_of_one_table_move_it_once(spark):
    entries = spark.range(4000).select((F.col("id") % 50).alias("src"), (F.col("id") % 30).alias("dst"), (F.col("id") % 17).alias("w"))
    found = s.build_all(entries, ["src", "dst"], "w", ("plus", "min", "max"))
    assert _plan(found).count("Exchange ") == 1
    for how in ("plus", "min", "max"):
        alone = s.build(entries, ["src", "dst"], "w", how)
        assert sorted(map(tuple, found.where(F.col("how") == how).drop("how").collect())) == sorted(map(tuple, alone.collect()))


def test_lists_go_to_rows_and_columns_of_a_grid(spark, monkeypatch):
    monkeypatch.setattr(triangles, "tasks_for", lambda *_: 16)
    sent, spread = [], blocks.Grid.spread
    monkeypatch.setattr(blocks.Grid, "spread", lambda self, df: sent.append(df) or spread(self, df))
    ids = [(i * 7919) % 1009 for i in range(64)]
    edges = spark.createDataFrame([(a, b) for a in ids for b in ids if a != b and (a * b) % 5], "src long, dst long")
    lists = triangles.successors(edges)
    found = triangles.meeting(lists)
    there, here = sent
    entries = lists.agg(F.sum(F.size("upper"))).first()[0]
    assert there.agg(F.sum(F.size("_there"))).first()[0] == entries
    # A list went to all of sixteen blocks before, mask and all.
    assert here.agg(F.sum(F.size("_mask")) + F.sum(F.size("_left"))).first()[0] <= 8 * entries
    near = {r["src"]: set(r["upper"]) for r in lists.collect()}
    assert found.agg(F.sum(F.size("both"))).first()[0] == sum(len(near[a] & near.get(b, set())) for a in near for b in near[a])


def test_squares_in_tiles(spark, monkeypatch):
    from itertools import combinations

    from tropica.operators import squares

    monkeypatch.setattr(squares, "RANGE_ENTRIES", 150)
    monkeypatch.setattr(squares, "PATHS_AT_ONCE", 60)  # several vertices at once, and hubs by pieces
    ids = [(i * 7919) % 1009 for i in range(45)]
    near = {i: {j for j in ids if i != j and ((i * j) % 7 < 2 or ids[0] in (i, j))} for i in ids}
    want = {i: sum(c * (c - 1) // 2 for j in ids if i != j for c in [len(near[i] & near[j])]) for i in ids}
    edges = spark.createDataFrame([(i, j) for i in ids for j in near[i]], "src long, dst long")
    assert {r["id"]: r["squares"] for r in squares.squares(edges).collect()} == {i: n for i, n in want.items() if n}
    clique = spark.createDataFrame([(i, j) for a, b in combinations(range(5), 2) for i, j in ((a, b), (b, a))], "src long, dst long")
    assert {r["id"]: r["squares"] for r in squares.squares(clique).collect()} == dict.fromkeys(range(5), 12)


def test_trusses_find_triangles_once(spark, monkeypatch):
    from itertools import combinations

    from tropica.graph import Graph

    calls, find = [], triangles.triangles
    monkeypatch.setattr(triangles, "triangles", lambda edges: calls.append(1) or find(edges))
    half = {*combinations(range(6), 2), *combinations(range(5, 9), 2), (0, 10), (1, 10), (10, 11)}
    g = Graph(spark.createDataFrame([e for a, b in half for e in ((a, b), (b, a))], "src long, dst long"), None, False)
    found = triangles.all_ktruss(g)
    assert calls == [1]
    assert [(r["k"], r["ntris"], r["nedges"]) for r in found] == [(3, 25, 23), (4, 24, 21), (5, 20, 15), (6, 20, 15), (7, 0, 0)]
    # Steps as counted where each one finds the triangles of the edges that are left.
    edges, want, k = half, [], 3
    while not want or edges:
        before, steps = -1, 0
        while True:
            edges, steps = {e for e in edges if sum(tuple(sorted((e[0], c))) in edges and tuple(sorted((e[1], c))) in edges for c in range(12)) >= k - 2}, steps + 1
            if len(edges) in (before, 0):
                break
            before = len(edges)
        want.append(steps)
        k += 1
    assert [r["nsteps"] for r in found] == want
    for most in (-1, 22, 24):  # in rounds alone, and from some truss on in one task
        monkeypatch.setattr(triangles, "TASK_TRIANGLES", most)
        assert triangles.all_ktruss(g) == found


def test_rounds_leave_edges_where_they_lie(spark, monkeypatch):
    import random

    from tropica.graph import Graph
    from tropica.operators import communities, ranking, traversal

    pick = random.Random(3)
    half = {tuple(sorted(pick.sample(range(40), 2))) for _ in range(150)} | {(50, 51), (51, 52), (60, 61)}
    g = Graph(spark.createDataFrame([(a, b, 1 + (x + y) % 4) for x, y in half for a, b in ((x, y), (y, x))], "src long, dst long, w long"), None, False)
    placed, links = [], []
    few = lambda df, by: placed.append(by) or blocks.clustered(df, by)
    monkeypatch.setattr(blocks, "tasks_for", lambda *_: 5)
    for module in (communities, ranking, traversal):
        monkeypatch.setattr(module, "clustered", few)
    find = communities.components
    monkeypatch.setattr(communities, "components", lambda df, **how: links.append(df.count()) or find(df, **how))

    weight = {e: 1 + sum(e) % 4 for x, y in half for e in ((x, y), (y, x))}
    ids = sorted({a for a, _ in weight})
    away = dict.fromkeys(ids, 2**63 - 1) | {ids[0]: 0}
    for _ in ids:
        away = {i: min([away[i], *(away[j] + w for (j, k), w in weight.items() if k == i and away[j] < 2**62)]) for i in ids}
    assert {r["id"]: r["distance"] for r in traversal.shortest_paths(g, ids[0]).collect()} == away
    least = {i: i for i in ids}
    for _ in ids:
        least = {i: min([least[i], *(least[j] for j, k in weight if k == i)]) for i in ids}
    assert {r["id"]: r["component"] for r in communities.connected_components(g).collect()} == least
    assert links[0] <= 2 * len(ids) and sum(links) < len(weight)  # the rounds run on two links of a vertex, and on what they leave apart
    chosen = {r["id"] for r in communities.independent_set(g).collect()}
    assert not any(a in chosen and b in chosen for a, b in weight) and all(i in chosen or any(i == a and b in chosen for a, b in weight) for i in ids)
    ranking.betweenness(g, ids[:2])
    assert placed == ["src", "dst", "src"]


def test_lists_are_gathered_in_one_move_without_a_join(spark, monkeypatch):
    plans, keep = [], triangles.written
    monkeypatch.setattr(triangles, "written", lambda df, *a, **k: plans.append((df.columns, _plan(df))) or keep(df, *a, **k))
    g = Graph(spark.createDataFrame([(a, b) for a in range(12) for b in range(12) if a != b and (a + b) % 3], "src long, dst long"), directed=False)
    near = {a: {b for b in range(12) if a != b and (a + b) % 3} for a in range(12)}
    count = sum(b in near[a] and c in near[a] and c in near[b] for a in range(12) for b in range(a) for c in range(b))
    for method in triangles.METHODS:
        assert triangles.triangle_count(g, method) == count
    for columns, plan in plans:
        assert set(columns) == {"src", "upper", "lower"}  # of both no copy
        assert plan.count("Exchange ") == 1 and "REPARTITION_BY_NUM" in plan and "Join" not in plan
    # Of graphs that are ordered by degree no edges are sorted.
    monkeypatch.setattr(triangles, "PAIRS_PER_EDGE", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans.clear()
        assert [triangles.triangle_count(g, m) for m in ("auto", *triangles.METHODS)] == [count] * 7
        assert all("SortMergeJoin" not in plan for _, plan in plans) and sum("ShuffledHashJoin" in plan for _, plan in plans) == 6
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_forests_of_tasks(spark, monkeypatch):
    import random

    from tropica.operators import forests

    draw, n = random.Random(7), 60
    rows = sorted({(a, b): draw.choice([0.5, 1.0, 1.0, 2.0, float("nan")]) for a, b in ((draw.randrange(n), draw.randrange(n)) for _ in range(700)) if a < b}.items())
    edges = spark.createDataFrame([(a * 97 % 1009, b * 97 % 1009, w) for (a, b), w in rows], "src long, dst long, w double")
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    once = sorted((w != w, w, min(a, b), max(a, b)) for a, b, w in edges.collect() if w == w) + sorted(((True, 0.0, min(a, b), max(a, b)) for a, b, w in edges.collect() if w != w))
    part, tree = {}, set()

    def root(v):
        while part.get(v, v) != v:
            v = part[v]
        return v

    for _, _, a, b in once:
        if root(a) != root(b):
            part[root(a)] = root(b)
            tree.add((a, b))
    sizes, thin, cut = [], forests.thinned, []
    monkeypatch.setattr(forests, "thinned", lambda left, m: sizes.append(m) or thin(left, m))
    contract = forests._contracted
    monkeypatch.setattr(forests, "_contracted", lambda left, m: cut.append(m) or contract(left, m))
    for most, symmetric in ((50, True), (200, False), (10_000, True)):
        monkeypatch.setattr(forests, "TASK_EDGES", most)
        sizes.clear()
        assert {(r["src"], r["dst"]) for r in forests.spanning_forest(both, symmetric=symmetric).collect()} == tree
        assert sizes[0] == len(once) and sizes[-1] <= most and (len(sizes) == 1) == (most == 10_000)
    assert cut  # where thinning left more than half
    assert all(left <= m for left, m in zip(sizes[1:], sizes, strict=False))
