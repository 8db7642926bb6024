"""Breadth-first search and shortest paths: one relaxation loop over frontiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tropica.errors import InvalidIndex, NegativeCycle, NotImplementedKind
from tropica.graph import Graph
from tropica.plans.blocks import clustered
from tropica.plans.fixpoint import released, written


def relax(edges: DataFrame, seeds: DataFrame, extend: Column, most: int | None = None) -> DataFrame:
    """The least label of every vertex that paths from seeds(id, x) reach.

    extend computes the label of e.dst from the edge e and the label x of its source. Only vertices whose label just
    fell send labels on, to edges that lie in blocks of their sources; a round is one join and one pre-aggregated minimum. More than `most` rounds that still improve
    something mean a negative cycle."""
    state, table = written(seeds.select("id", "x", F.lit(True).alias("fresh")), "labels"), clustered(edges, "src")
    rounds = 0
    try:
        while not (frontier := state.where("fresh")).isEmpty():
            if most is not None and rounds > most:
                raise NegativeCycle("labels still fall after as many rounds as there are vertices")
            sent = table.join(frontier.select("id", "x")).select(F.col("dst").alias("id"), extend.alias("x"), F.lit(None).cast(state.schema["x"].dataType).alias("old"))
            merged = state.select("id", "x", F.col("x").alias("old")).unionByName(sent).groupBy("id").agg(F.min("x").alias("x"), F.min("old").alias("old"))
            last, state = state, written(merged.select("id", "x", (F.col("old").isNull() | (F.col("x") < F.col("old"))).alias("fresh")), "labels", placed=True)
            released(last)
            rounds += 1
    finally:
        table.release()
    return state.select("id", "x")


def _seed(g: Graph, sources, x: Column) -> DataFrame:
    sources = [sources] if isinstance(sources, int) else list(sources)
    found = g.vertices.where(F.col("id").isin(sources))
    if found.count() != len(set(sources)):
        raise InvalidIndex("a source is no vertex")
    return found.select("id", x.alias("x"))


def bfs(g: Graph, source: int) -> DataFrame:
    """(id, level, parent) of every vertex reached; the source is its own parent, others have their least predecessor one level up."""
    start = F.struct(F.lit(0).cast("long").alias("level"), F.col("id").alias("parent"))
    step = F.struct((F.col("x.level") + 1).alias("level"), F.col("src").alias("parent"))
    return relax(g.edges, _seed(g, source, start), step).select("id", "x.level", "x.parent")


def shortest_paths(g: Graph, source: int, delta=None) -> DataFrame:
    """(id, distance) of every vertex; infinity (the greatest value of an integer type) where none is reached.

    delta only schedules work elsewhere and has no effect here. Raises NegativeCycle instead of running for ever."""
    kind = dict(g.edges.dtypes)["w"]
    if kind not in ("int", "bigint", "float", "double") and not kind.startswith("decimal"):
        raise NotImplementedKind(f"no shortest paths over {kind}")
    whole = kind in ("int", "bigint")
    edges = g.edges.withColumn("w", F.col("w").cast("long" if whole else "double"))
    found = relax(edges, _seed(g, source, F.lit(0).cast("long" if whole else "double")), F.col("x") + F.col("w"), g.n)
    far = F.lit(2**31 - 1 if kind == "int" else 2**63 - 1).cast("long") if whole else F.lit(float("inf"))
    return g.vertices.join(found, "id", "left").select("id", F.coalesce("x", far).alias("distance"))


def bellman_ford(g: Graph, source: int) -> DataFrame:
    """(id, d, h, pi) of every vertex reached: least distance, then fewest hops, then least parent.

    pi is the parent plus one, 0 at the source."""
    start = F.struct(F.lit(0.0).alias("d"), F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("pi"))
    step = F.struct((F.col("x.d") + F.col("w")).alias("d"), (F.col("x.h") + 1).alias("h"), (F.col("src") + 1).alias("pi"))
    edges = g.edges.where("src <> dst or w < 0").withColumn("w", F.col("w").cast("double"))
    return relax(edges, _seed(g, source, start), step, g.n).select("id", "x.d", "x.h", "x.pi")


def bellman_ford_dense(g: Graph, source: int) -> DataFrame:
    """bellman_ford with a row for every vertex: unreached ones at infinity, with the greatest count of hops and parent 0."""
    found = g.vertices.join(bellman_ford(g, source), "id", "left")
    return found.select("id", F.coalesce("d", F.lit(float("inf"))).alias("d"), F.coalesce("h", F.lit(2**63 - 1)).alias("h"), F.coalesce("pi", F.lit(0).cast("long")).alias("pi"))


def all_pairs(g: Graph, most: int = 60) -> DataFrame:
    """(src, dst, d) of all connected pairs by repeated min-plus squaring; for graphs whose square of vertices is affordable."""
    from tropica.functions.semiring import mxm
    from tropica.plans.fixpoint import until_stable

    own = g.vertices.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("w"))
    start = g.edges.withColumn("w", F.col("w").cast("double")).unionByName(own).groupBy("src", "dst").agg(F.min("w").alias("w"))
    paths, _ = until_stable(start, lambda d: mxm(d, d, "min_plus"), most, "paths")
    if not paths.where("src = dst and w < 0").isEmpty():
        raise NegativeCycle("a cycle has a negative sum")
    return paths.withColumnRenamed("w", "d")
