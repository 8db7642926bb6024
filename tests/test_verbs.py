"""Verbs beside their queries: errors, lifecycles, forests against a plain algorithm, streaming degrees."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tropica import errors
from tropica.functions import semiring as s
from tropica.graph import Graph
from tropica.operators import communities
from tropica.operators.components import components
from tropica.sources import mtx
from tropica.streaming.degrees import windowed_degrees


def drawn(spark, n: int, m: int, seed: int, top: int = 6):
    draw = random.Random(seed)
    pairs = {(a, b): draw.randint(1, top) for a, b in ((draw.randrange(n), draw.randrange(n)) for _ in range(m)) if a < b}
    rows = [(a, b, w) for (a, b), w in pairs.items()] + [(b, a, w) for (a, b), w in pairs.items()]
    return spark.createDataFrame(rows, "src long, dst long, w long"), pairs


def roots(n: int, pairs) -> list[int]:
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_forest_edges_are_those_of_kruskal(spark, seed):
    edges, pairs = drawn(spark, 60, 150, seed)
    kept = []
    for w, a, b in sorted((w, a, b) for (a, b), w in pairs.items()):
        part = roots(60, [(x, y) for x, y, _ in kept])
        if part[a] != part[b]:
            kept.append((a, b, w))
    assert sorted(map(tuple, communities.spanning_forest(edges).collect())) == sorted(kept)


def test_components_of_chains_stars_and_noise(spark):
    draw = random.Random(4)
    ids = list(range(300))
    draw.shuffle(ids)
    pairs = list(zip(ids[:120], ids[1:120], strict=False)) + [(ids[200], x) for x in ids[130:190]] + [(draw.choice(ids), draw.choice(ids)) for _ in range(40)] + [(7, 7)]
    found = {r["id"]: r["component"] for r in components(spark.createDataFrame(pairs + pairs[:5], "u long, v long")).collect()}
    want = {x: r for x, r in enumerate(roots(300, pairs)) if x != r}
    assert found == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_replace_applies_with_an_accumulator(spark):
    old, new = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "id long, x long"), spark.createDataFrame([(2, 1), (4, 1)], "id long, x long")
    mask = spark.createDataFrame([(2,), (4,), (1,)], "id long")
    out = lambda **how: {r["id"]: r["x"] for r in s.accumulate(old, new, ["id"], "x", mask=mask, **how).collect()}
    assert out(op=F.sum) == {1: 10, 2: 21, 3: 30, 4: 1} and out(op=F.sum, replace=True) == {1: 10, 2: 21, 4: 1}
    assert out(op=None) == {2: 1, 3: 30, 4: 1} and out(op=None, replace=True) == {2: 1, 4: 1}
    assert out(op=F.sum, replace=True, complement=True) == {3: 30}


def test_properties_are_forgotten_and_found_again(spark):
    g = Graph(spark.createDataFrame([(0, 1), (1, 1)], "src long, dst long"))
    with pytest.raises(errors.NotCached):
        g.cached("self_edges")
    assert g.self_edges == 1 and g.cached("self_edges") == 1
    g.delete_cached()
    with pytest.raises(errors.NotCached):
        g.cached("self_edges")
    with pytest.raises(errors.InvalidGraph):
        Graph(g.edges, None, False).copied()


def test_prepared_edges_and_type_names(spark):
    raw = spark.createDataFrame([(0, 1, -2), (1, 0, 5), (2, 2, 1), (1, 2, 0), (0, 1, 1)], "src long, dst long, w long")
    g = Graph.from_edges(raw, symmetrize=True, drop_self=True, positive=True)
    assert sorted(map(tuple, g.edges.collect())) == [(0, 1, 5), (1, 0, 5)] and not g.directed
    assert mtx.kind_of(raw) == "int64_t" and mtx.kind_of(raw.withColumn("w", F.lit(True))) == "bool" and mtx.type_size("uint16_t") == 2
    with pytest.raises(errors.NotImplementedKind):
        mtx.type_size("complex")


def test_triples(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("1\t2\t0.5\n3\t1\t2\n")
    m = mtx.read_triples(spark, str(tmp_path / "t.tsv"), 3, 3)
    assert sorted(map(tuple, m.entries.collect())) == [(0, 1, 0.5), (2, 0, 2.0)] and m.kind == "float"


def test_streaming_degrees(spark, tmp_path):
    begin = datetime(2024, 1, 1)
    rows = [(begin + timedelta(minutes=20 * i), i % 3, i) for i in range(12)]
    edges = spark.createDataFrame(rows, "ts timestamp, src long, dst long")
    edges.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = windowed_degrees(spark.readStream.schema(edges.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("degrees").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    found = {(r["start"], r["id"]): r["degree"] for r in spark.table("degrees").collect()}
    want = {(r["start"], r["id"]): r["degree"] for r in windowed_degrees(edges).collect()}
    assert found == want and sum(found.values()) == 12
