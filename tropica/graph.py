"""Graphs as edge tables with lazily computed properties."""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tropica.errors import CacheNotNeeded, InvalidGraph, NoSelfEdgesAllowed, NotCached, SymmetryRequired


@dataclass
class Graph:
    """edges(src, dst, w) with unique (src, dst); vertices(id), by default the ends of edges.

    An undirected graph stores both directions. Entries that are zero are edges; an absent row is no edge."""

    edges: DataFrame
    vertices: DataFrame = None
    directed: bool = True

    def __post_init__(self):
        if "w" not in self.edges.columns:
            self.edges = self.edges.withColumn("w", F.lit(1).cast("long"))
        self.edges = self.edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "w")
        if self.vertices is None:
            self.vertices = self.edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()

    @classmethod
    def of_size(cls, edges: DataFrame, n: int, directed: bool = True) -> Graph:
        """A graph over the ids 0 to n - 1, isolated ones included."""
        return cls(edges, edges.sparkSession.range(n).select("id"), directed)

    @classmethod
    def from_edges(cls, edges: DataFrame, vertices: DataFrame | None = None, directed: bool = True, symmetrize: bool = False, drop_self: bool = False, positive: bool = False) -> Graph:
        """Prepares raw edges: self-edges and zeros dropped, weights made absolute, both directions added, as asked for."""
        if "w" not in edges.columns:
            edges = edges.withColumn("w", F.lit(1).cast("long"))
        if drop_self:
            edges = edges.where("src <> dst")
        if positive:
            edges = edges.where("w <> 0").withColumn("w", F.abs("w"))
        if symmetrize:
            edges = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
        return cls(edges.groupBy("src", "dst").agg(F.max("w").alias("w")), vertices, directed and not symmetrize)

    @cached_property
    def n(self) -> int:
        return self.vertices.count()

    def delete_cached(self) -> None:
        """Forgets the properties found so far; they are found anew when asked for."""
        for name in ("n", "symmetric_structure", "self_edges"):
            self.__dict__.pop(name, None)

    def cached(self, name: str):
        """A property found before; NotCached where it was not."""
        if name not in self.__dict__:
            raise NotCached(f"{name} has not been found yet")
        return self.__dict__[name]

    def copied(self) -> DataFrame:
        """The edges of a directed graph."""
        if not self.directed:
            raise InvalidGraph("the graph must be directed")
        return self.edges.select("src", "dst", "w")

    def transpose(self) -> DataFrame:
        if not self.directed:
            warnings.warn(CacheNotNeeded("an undirected graph is its own transpose"), stacklevel=2)
        return self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")

    def out_degree(self) -> DataFrame:
        """(id, degree) of vertices with an edge; self-edges and zero entries count."""
        return self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))

    def in_degree(self) -> DataFrame:
        if not self.directed:
            warnings.warn(CacheNotNeeded("an undirected graph has one degree"), stacklevel=2)
        return self.edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("degree"))

    @cached_property
    def symmetric_structure(self) -> bool:
        back = self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        return not self.directed or self.edges.join(back, ["src", "dst"], "left_anti").isEmpty()

    @cached_property
    def self_edges(self) -> int:
        return self.edges.where("src = dst").count()

    def weight_range(self) -> DataFrame:
        """Least and greatest entry; for booleans their conjunction and disjunction."""
        if dict(self.edges.dtypes)["w"] == "boolean":
            return self.edges.agg(F.bool_and("w").alias("emin"), F.bool_or("w").alias("emax"))
        return self.edges.agg(F.min("w").alias("emin"), F.max("w").alias("emax"))

    def without_self_edges(self) -> Graph:
        return Graph(self.edges.where("src <> dst"), self.vertices, self.directed)

    def structure(self) -> DataFrame:
        return self.edges.withColumn("w", F.lit(True))

    def undirected(self, combine=F.max) -> Graph:
        """Both directions of every edge, equal pairs combined."""
        both = self.edges.unionByName(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
        return Graph(both.groupBy("src", "dst").agg(combine("w").alias("w")), self.vertices, False)

    def induced(self, ids: DataFrame) -> Graph:
        """The subgraph on ids(id)."""
        keep = ids.select("id").distinct()
        inside = self.edges.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return Graph(inside.select("src", "dst", "w"), keep, self.directed)

    def require_symmetric(self, self_edges_allowed: bool = True) -> None:
        if not self.symmetric_structure:
            raise SymmetryRequired("the graph must be undirected or have a symmetric structure")
        if not self_edges_allowed and self.self_edges:
            raise NoSelfEdgesAllowed("the graph has self-edges")

    def check(self) -> None:
        """Raises InvalidGraph for repeated pairs, null ends, or ends that are no vertices."""
        if not self.edges.where("src is null or dst is null").isEmpty():
            raise InvalidGraph("an edge has a null end")
        if not self.edges.groupBy("src", "dst").count().where("count > 1").isEmpty():
            raise InvalidGraph("a pair of vertices has several edges")
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("id"))
        if not ends.join(self.vertices, "id", "left_anti").isEmpty():
            raise InvalidGraph("an edge ends outside the vertices")

    def summary(self, rows: int = 30, complete: bool = False) -> str:
        """A printable account: size, kind, properties and the first rows (all, if complete)."""
        count = self.edges.count()
        lines = [f"{'directed' if self.directed else 'undirected'} graph: {self.n} vertices, {count} entries, weights {dict(self.edges.dtypes)['w']}"]
        for r in self.edges.orderBy("src", "dst").limit(count if complete else rows).collect():
            lines.append(f"  ({r['src']}, {r['dst']})  {r['w']}")
        return "\n".join(lines + ["  ..."] * (not complete and count > rows))


def sort_by_degree(g: Graph, by_out: bool = True, ascending: bool = True) -> DataFrame:
    """(position, id, degree): vertices by degree, absent ones as 0, then by id.

    Positions come from counts per degree plus a rank inside each degree, so no task sees all vertices at once unless
    all have one degree."""
    degree = g.out_degree() if by_out or not g.directed else g.in_degree()
    ranked = g.vertices.join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))
    from tropica.functions.order import positions

    return positions(ranked, [F.col("degree") if ascending else -F.col("degree"), F.col("id")])


def equal(a: DataFrame, b: DataFrame, keys: list[str], value: str, same: Column | None = None) -> bool:
    """Whether two matrices or vectors have one type, one structure and equal values; NaN equals nothing.

    same replaces the comparison of a.value and b.value (types may then differ)."""
    if same is None and dict(a.dtypes)[value] != dict(b.dtypes)[value]:
        return False
    left, right = a.select(*keys, F.col(value).alias("_a")), b.select(*keys, F.col(value).alias("_b"))
    joined = left.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), keys, "full")
    test = same if same is not None else F.col("_a") == F.col("_b")
    if same is None and dict(a.dtypes)[value] in ("double", "float"):
        test = test & ~F.isnan("_a")
    return joined.where(F.col("_l").isNull() | F.col("_r").isNull() | ~F.coalesce(test, F.lit(False))).isEmpty()
