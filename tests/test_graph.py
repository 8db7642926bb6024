"""Golden results of small graphs (kept in FIXTURES.md), property checks and error paths."""

from __future__ import annotations

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tropica import errors, graph
from tropica.functions import semiring as s
from tropica.graph import Graph
from tropica.operators import communities, cores, dnn, graphlets, ranking, traversal, triangles

NOTES = (Path(__file__).resolve().parent.parent / "FIXTURES.md").read_text()


def listed(name: str):
    found = re.search(rf"\*\*{re.escape(name)}\*\* \(n=(\d+).*?\): (.*)", NOTES)
    return int(found[1]), found[2].split()


def numbers(label: str) -> list[float]:
    return [float(x) for x in re.search(rf"\*\*{label}.*?\): ([\d. ]+)", NOTES)[1].split()]


def undirected(spark, name: str) -> Graph:
    n, words = listed(name)
    edges = [tuple(map(int, w.split(":")[0].split("-"))) for w in words]
    return Graph.of_size(spark.createDataFrame([(a, b, 1) for a, b in edges] + [(b, a, 1) for a, b in edges], "src long, dst long, w long"), n, False)


def directed(spark, name: str) -> Graph:
    n, words = listed(name)
    edges = [(int(w.split(">")[0]), int(w.split(">")[1].split(":")[0]), float(w.split(":")[1])) for w in words]
    return Graph.of_size(spark.createDataFrame(edges, "src long, dst long, w double"), n)


def column(df, name: str) -> list:
    return [r[name] for r in df.orderBy("id").collect()]


def near(a: list, b: list, tolerance: float) -> bool:
    return len(a) == len(b) and max(abs(x - y) for x, y in zip(a, b, strict=True)) < tolerance


@pytest.fixture(scope="module")
def karate(spark):
    return undirected(spark, "karate")


@pytest.fixture(scope="module")
def small(spark):
    return undirected(spark, "A")


def test_triangle_methods(spark, karate, small):
    assert {m: triangles.triangle_count(karate, m) for m in ("auto", *triangles.METHODS)} == dict.fromkeys(("auto", *triangles.METHODS), 45)
    assert triangles.triangle_count(small, "cohen", presort=False) == 11
    with pytest.raises(errors.NoSelfEdgesAllowed):
        triangles.triangle_count(Graph(spark.createDataFrame([(0, 0)], "src long, dst long"), None, False))
    with pytest.raises(errors.SymmetryRequired):
        triangles.triangle_count(Graph(spark.createDataFrame([(0, 1)], "src long, dst long")))


def test_bfs(karate):
    levels = [int(x) for x in re.search(r"BFS levels karate from 30.*?: (.*)", NOTES)[1].split()]
    found = traversal.bfs(karate, 30)
    assert column(found, "level") == levels
    parents = {r["id"]: r["parent"] for r in found.collect()}
    edges = {(r["src"], r["dst"]) for r in karate.edges.collect()}
    assert all(v == 30 or (p, v) in edges and levels[p] == levels[v] - 1 for v, p in parents.items())
    with pytest.raises(errors.InvalidIndex):
        traversal.bfs(karate, 99)


def test_pagerank(spark, karate):
    ranks, rounds = ranking.pagerank(karate)
    assert rounds == 19 and near(column(ranks, "rank"), numbers("PageRank karate"), 1e-4)
    ranks, rounds = ranking.pagerank(directed(spark, "ldbc-directed-example"))
    assert rounds == 12 and near(column(ranks, "rank"), numbers("PageRank ldbc-directed-example"), 1e-4)
    with pytest.raises(errors.ConvergenceFailure) as failure:
        ranking.pagerank(karate, most=2)
    assert failure.value.code == -1005
    assert ranking.pagerank(karate, most=2, sinks=False)[1] == 2


def test_betweenness(karate):
    assert near(column(ranking.betweenness(karate, [6, 29, 0, 9]), "centrality"), numbers("Betweenness karate"), 1e-3)


def test_strong_and_weak_components(spark, karate):
    cover = directed(spark, "cover")
    assert column(communities.strong_components(cover), "component") == [0, 0, 2, 0, 4, 2, 0]
    assert set(column(communities.connected_components(cover, weak=True), "component")) == {0}
    two = Graph.of_size(spark.createDataFrame([(0, 1), (1, 0), (3, 2), (2, 3)], "src long, dst long"), 5, False)
    assert column(communities.connected_components(two), "component") == [0, 0, 2, 2, 4]
    with pytest.raises(errors.SymmetryRequired):
        communities.connected_components(cover)


def test_cores(karate, small):
    core, top = cores.kcore_all(karate)
    assert top == 4
    assert {r["id"] for r in cores.kcore(karate, 4).collect()} == {r["id"] for r in core.where("core >= 4").collect()}
    inside = cores.kcore_subgraph(karate, core, 4)
    assert inside.groupBy("src").count().agg(F.min("count")).first()[0] >= 4


@pytest.mark.parametrize("name", ["A", "karate"])
def test_graphlets(spark, name):
    block = re.search(rf"Graphlets {name}(?:\.mtx)?\*\*.*?```\n(.*?)```", NOTES, re.S)[1]
    expected = [list(map(int, line.split())) for line in block.strip().splitlines()]
    found = graphlets.graphlets(undirected(spark, name)).orderBy("id").collect()
    assert [[r[f"f{i}"] for i in range(16)] for r in found] == expected


def test_square_clustering(spark):
    words = re.search(r"square-clustering Lind graph\*\*.*?: (.*)", NOTES)[1].split()
    edges = [tuple(map(int, w.split("-"))) for w in words]
    g = Graph(spark.createDataFrame([*edges, *((b, a) for a, b in edges)], "src long, dst long"), None, False)
    found = {r["id"]: r["c"] for r in triangles.square_clustering(g).collect()}
    assert found == pytest.approx({1: 3 / 43, 2: 3 / 17, 3: 3 / 17, 4: 1 / 3, 5: 1 / 3, 6: 1 / 27, 7: 1 / 27, 8: 1 / 5})


def test_forest(spark, small):
    tree = {(r["src"], r["dst"]) for r in communities.spanning_forest(small.edges).collect()}
    assert tree == {(0, 1), (0, 2), (1, 3), (1, 4), (1, 5), (0, 6)}
    weighted = spark.createDataFrame([(0, 1, 5), (1, 2, 1), (0, 2, 2), (3, 4, 7)], "src long, dst long, w long")
    assert {tuple(r) for r in communities.spanning_forest(weighted).collect()} == {(1, 2, 1), (0, 2, 2), (3, 4, 7)}


def test_independent_set(spark, karate):
    ignored = spark.createDataFrame([(5,)], "id long")
    edges = {(r["src"], r["dst"]) for r in karate.edges.collect()}
    for skip in (None, ignored):
        chosen = {r["id"] for r in communities.independent_set(karate, 3, skip).collect()}
        assert not any((a, b) in edges for a in chosen for b in chosen)
        assert all(v in chosen or any((v, u) in edges for u in chosen) for v in range(34) if skip is None or v != 5)
        assert skip is None or 5 not in chosen


def test_labels(spark):
    labels, rounds = communities.cdlp(undirected(spark, "ldbc-cdlp-undirected-example"))
    assert column(labels, "label") == [0, 0, 0, 3, 3, 3, 3, 3]
    assert column(communities.cdlp(directed(spark, "ldbc-cdlp-directed-example"))[0], "label") == [0, 0, 0, 3, 3, 3, 3, 3]


def test_clustering_and_centrality(karate):
    edges = {(r["src"], r["dst"]) for r in karate.edges.collect()}
    around = {v: {b for a, b in edges if a == v} for v in range(34)}
    links = {v: sum((a, b) in edges for a in n for b in n) for v, n in around.items()}
    expected = {v: links[v] / (len(n) * (len(n) - 1)) for v, n in around.items() if links[v]}
    assert {r["id"]: r["lcc"] for r in triangles.lcc(karate).collect()} == pytest.approx(expected)
    assert triangles.triangle_centrality(karate)[1] == 45


def test_trusses(karate):
    rows = triangles.all_ktruss(karate)
    assert rows[0]["ntris"] == 45 and rows[-1]["nedges"] == 0 and [r["k"] for r in rows] == [3, 4, 5, 6]
    assert triangles.ktruss(karate, 4).count() == 2 * rows[1]["nedges"]
    with pytest.raises(errors.InvalidValue):
        triangles.ktruss(karate, 2)


def test_shortest_paths(spark):
    g = directed(spark, "test_BF")
    distance = column(traversal.shortest_paths(g, 0), "distance")
    assert distance == [0, 2, 8, 7, 7, 9, 10]
    rows = {r["id"]: r for r in traversal.bellman_ford(g, 0).collect()}
    assert [rows[i]["d"] for i in range(7)] == distance and rows[0]["pi"] == 0 and rows[2]["pi"] == 4
    assert {r["dst"]: r["d"] for r in traversal.all_pairs(g).where("src = 0").collect()} == dict(enumerate(map(float, distance)))
    loop = Graph(spark.createDataFrame([(0, 1, 1.0), (1, 2, -3.0), (2, 0, 1.0)], "src long, dst long, w double"))
    for run in (traversal.shortest_paths, traversal.bellman_ford):
        with pytest.raises(errors.NegativeCycle):
            run(loop, 0)


def test_verbs(spark):
    a = spark.createDataFrame([(0, 1, 2), (1, 2, 3), (0, 2, 0)], "src long, dst long, w long")
    x = spark.createDataFrame([(1, 10), (2, 20)], "id long, x long")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(s.mxv(a, x, "plus_times")) == [(0, 20), (1, 60)]
    assert rows(s.vxm(x, a, "min_plus")) == [(2, 13)]
    assert rows(s.mxm(a, a, "plus_times")) == [(0, 2, 6)]
    assert rows(s.mxm(a, a, "plus_pair", mask=a, valued="w")) == []  # the entry of the mask is an explicit zero
    assert rows(s.mxm(a, a, "plus_pair", mask=a)) == [(0, 2, 1)]
    assert rows(s.ewise_add(a, s.transpose(a), ["src", "dst"], "w", lambda p, q: p + q)) == [(0, 1, 2), (0, 2, 0), (1, 0, 2), (1, 2, 3), (2, 0, 0), (2, 1, 3)]
    assert rows(s.ewise_mult(a, s.transpose(a), ["src", "dst"], "w", lambda p, q: p * q)) == []
    assert rows(s.select(a, "gt", 1)) == [(0, 1, 2), (1, 2, 3)] and rows(s.reduce_rows(a, "max")) == [(0, 2), (1, 3)]
    assert rows(s.gather(x, spark.createDataFrame([(0, 2), (1, 2)], "position long, id long"))) == [(0, 20), (1, 20)]
    assert rows(s.scatter(x, spark.createDataFrame([(1, 5), (2, 5)], "position long, id long"))) == [(5, 10)]
    assert rows(s.accumulate(x, spark.createDataFrame([(2, 1), (3, 7)], "id long, x long"), ["id"], "x", F.sum)) == [(1, 10), (2, 21), (3, 7)]
    assert rows(s.diagonal_of(s.diagonal(x))) == [(1, 10), (2, 20)]
    with pytest.raises(errors.InvalidValue):
        s.build(a.unionByName(a), ["src", "dst"], "w", None)


def test_properties_and_equality(spark, karate):
    g = directed(spark, "cover")
    assert tuple(g.weight_range().first()) == (1, 9) and g.self_edges == 0 and not g.symmetric_structure and g.undirected().symmetric_structure
    g.check()
    with pytest.raises(errors.InvalidGraph):
        Graph(spark.createDataFrame([(0, 1), (0, 1)], "src long, dst long")).check()
    with pytest.warns(errors.CacheNotNeeded):
        karate.transpose()
    assert "34 vertices" in karate.summary()
    ordered = graph.sort_by_degree(karate, ascending=False).orderBy("position").collect()
    assert [r["position"] for r in ordered] == list(range(34)) and ordered[0]["id"] == 33
    x = spark.createDataFrame([(0, 1.0), (1, float("nan"))], "id long, x double")
    assert not graph.equal(x, x, ["id"], "x") and graph.equal(x.where("id = 0"), x.where("id = 0"), ["id"], "x")
    assert not graph.equal(x, x.withColumn("x", F.col("x").cast("float")), ["id"], "x")


def test_network(spark):
    y = spark.createDataFrame([(0, 0, 1.0), (0, 1, 40.0)], "src long, dst long, w double")
    w = spark.createDataFrame([(0, 0, 1.0), (1, 1, 1.0)], "src long, dst long, w double")
    bias = spark.createDataFrame([(0, -2.0), (1, -0.5), (2, 9.0)], "id long, x double")
    assert [tuple(r) for r in dnn.infer(y, [(w, bias)]).collect()] == [(0, 1, 32.0)]


def test_empty_graph(spark):
    g = Graph.of_size(spark.createDataFrame([], "src long, dst long, w long"), 3, False)
    assert triangles.triangle_count(g) == 0 and cores.kcore_all(g)[1] == 0 and column(communities.connected_components(g), "component") == [0, 1, 2]
    assert ranking.pagerank(g)[0].agg(F.sum("rank")).first()[0] == pytest.approx(1)
    assert communities.independent_set(g).count() == 3 and communities.spanning_forest(g.edges).count() == 0


def test_whole_graphs_leave_no_row_out(spark, tmp_path):
    from itertools import combinations

    from tropica.plans import queries as named

    orders = {1: [1, 2, 3, 4, 5], 2: [4, 6, 7], 3: [8, 9], 4: [1, 6]}
    spark.createDataFrame([(o, p, 1.0) for o, ps in orders.items() for p in ps], "l_orderkey long, l_partkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(i, i, u) for i, u in enumerate([1, 2, 1, 2, 3, 4, 3])], "ts long, event_id long, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    found = named.queries()
    rows = lambda name: sorted(map(tuple, found[name](spark, str(tmp_path)).collect()))
    edges = {p for ps in orders.values() for p in combinations(ps, 2)}
    trusses, k = [], 3
    while edges:
        triangles = lambda e: sum((min(e[0], c), max(e[0], c)) in edges and (min(e[1], c), max(e[1], c)) in edges for c in range(10))
        while weak := {e for e in edges if triangles(e) < k - 2}:
            edges -= weak
        trusses.append((k, sum(map(triangles, edges)) // 3, len(edges)))
        k += 1
    assert [r for r in rows("all_ktruss") if r[2]] == [r for r in trusses if r[2]]
    assert rows("cc_min_label") == [(i, 8 if i > 7 else 1) for i in range(1, 10)]
    assert rows("scc_min_id") == [(1, 1), (2, 1), (3, 3), (4, 3)]  # 1 -> 2 happened twice
    assert {*named._ON_PARTS, *named._ON_MOVES} - {*named.oracle_sql()} == {"all_ktruss"}
