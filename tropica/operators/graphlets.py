"""Counts of the sixteen graphlets of up to four vertices at every vertex."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tropica.graph import Graph
from tropica.operators.squares import squares
from tropica.operators.triangles import support, triangles
from tropica.plans.fixpoint import written


def four_cliques(edges: DataFrame, found: DataFrame) -> DataFrame:
    """(id, k) of vertices in cliques of four: two of the vertices that close triangles over the first edge, with an edge between them."""
    over = found.groupBy("a", "b").agg(F.array_sort(F.collect_list("c")).alias("cs")).where(F.size("cs") > 1)
    pairs = over.select("a", "b", "cs", F.explode("cs").alias("src")).select("a", "b", "src", F.explode(F.filter("cs", lambda d: d > F.col("src"))).alias("dst"))
    closed = pairs.join(edges, ["src", "dst"], "left_semi")
    return closed.select(F.explode(F.array("a", "b", "src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("k"))


#: Net counts from raw ones d0..d15: coefficients by raw graphlet.
NET = [
    {0: 1}, {1: 1}, {2: 1, 4: -2}, {3: 1, 4: -1}, {4: 1}, {5: 1, 9: -2, 10: -1, 12: -2, 13: 4, 14: 2, 15: -6},
    {6: 1, 10: -1, 11: -2, 12: -2, 13: 2, 14: 4, 15: -6}, {7: 1, 9: -1, 10: -1, 13: 2, 14: 1, 15: -3}, {8: 1, 11: -1, 14: 1, 15: -1}, {9: 1, 13: -2, 15: 3},
    {10: 1, 13: -2, 14: -2, 15: 6}, {11: 1, 14: -2, 15: 3}, {12: 1, 13: -1, 14: -1, 15: 3}, {13: 1, 15: -3}, {14: 1, 15: -3}, {15: 1},
]


def graphlets(g: Graph) -> DataFrame:
    """id and f0 to f15 for every vertex."""
    g.require_symmetric(self_edges_allowed=False)
    edges = written(g.edges.select("src", "dst"), "edges")
    found = written(triangles(edges), "triangles", placed=True)
    tri = support(edges, found=found)
    p = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("p"))
    t = tri.groupBy(F.col("src").alias("id")).agg(F.expr("sum(w) div 2").alias("t"), F.expr("sum(w * (w - 1)) div 2").alias("d14"))
    base = g.vertices.join(p, "id", "left").join(t, "id", "left").select("id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("p", "t", "d14")))
    near = lambda values, *sums: edges.join(values.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(*sums)
    one = near(base, F.sum("p").alias("ap"), F.expr("sum((p - 1) * (p - 2)) div 2").alias("d7"), F.sum("t").alias("at"))
    base = written(base.join(one, "id", "left").na.fill(0).withColumn("d2", F.col("ap") - F.col("p")), "base")
    two = near(base.select("id", "d2"), F.sum("d2").alias("ad2"))
    dst = base.select(F.col("id").alias("dst"), F.col("p").alias("q"))
    ten = tri.join(dst, "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("w") * (F.col("q") - 2)).alias("d10"))
    twelve = squares(edges).withColumnRenamed("squares", "d12")
    # d13: over triangles at i, what the ends of the edge opposite share besides i.
    corner = F.explode(F.array(*(F.struct(F.col(i).alias("id"), F.col(x).alias("src"), F.col(y).alias("dst")) for i, x, y in ("abc", "bac", "cab")))).alias("t")
    thirteen = found.select(corner).select("t.*").join(tri, ["src", "dst"]).groupBy("id").agg(F.sum(F.col("w") - 1).alias("d13"))
    joined = reduce(lambda a, b: a.join(b, "id", "left"), [two, ten, twelve, thirteen, four_cliques(edges, found)], base).na.fill(0)
    raw = {
        0: "1", 1: "p", 2: "d2", 3: "p * (p - 1) div 2", 4: "t", 5: "ad2 - p * (p - 1) - 2 * t", 6: "d2 * (p - 1) - 2 * t", 7: "d7", 8: "p * (p - 1) * (p - 2) div 6",
        9: "at - 2 * t", 10: "d10", 11: "(p - 2) * t", 12: "d12", 13: "d13", 14: "d14", 15: "k",
    }
    net = [" + ".join(f"({c}) * ({raw[i]})" for i, c in row.items()) for row in NET]
    return joined.select("id", *(F.expr(e).cast("long").alias(f"f{i}") for i, e in enumerate(net)))
