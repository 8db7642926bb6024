"""Triangles: counts, clustering, centrality and trusses.

Common neighbours come from intersecting sorted neighbour arrays of an orientation from lower to higher (degree, id).
In it a vertex has at most the square root of twice the edges as successors, however large a hub is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tropica.errors import InvalidValue
from tropica.graph import Graph
from tropica.operators.squares import squares
from tropica.plans.blocks import Grid, tasks_for
from tropica.plans.fixpoint import released, where_placed, written


#: Entries of the lists in which one task looks up others.
LIST_ENTRIES = 40_000_000


def oriented(edges: DataFrame, presort: bool = True) -> DataFrame:
    """Each undirected edge once, from lower to higher (degree, id); by id alone without presort.

    Degrees are looked up in hash tables of a vertex each, so that no edges are sorted."""
    half = edges.where("src < dst").select("src", "dst")
    if not presort:
        return half
    degree = edges.groupBy("src").agg(F.count("*").alias("d"))
    half = half.join(degree.hint("shuffle_hash"), "src").join(degree.select(F.col("src").alias("dst"), F.col("d").alias("e")).hint("shuffle_hash"), "dst")
    return half.select(F.when(F.expr("d <= e"), F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(F.expr("d <= e"), F.col("dst")).otherwise(F.col("src")).alias("dst"))


#: Where ids alone leave no more pairs of successors than this for an edge, ordering by degree isn't worth its joins.
PAIRS_PER_EDGE = 200


def _order(edges: DataFrame) -> tuple[int, bool]:
    """The number of undirected edges, and whether ordering them by degree pays."""
    after = edges.where("src < dst").groupBy("src").agg(F.count("*").alias("d"))
    n, work = after.agg(F.sum("d"), F.sum(F.col("d").cast("double") * F.col("d")) / F.sum("d")).first()
    return n or 0, (work or 0) > PAIRS_PER_EDGE


def _gathered(entries: DataFrame, rows: int, **lists: Column) -> DataFrame:
    """(src, *lists): what each source lists, as a table; entries are moved once, to tasks that sort theirs in memory."""
    placed = entries.repartition(tasks_for(entries.sparkSession, rows), "src")
    return written(placed.groupBy("src").agg(*(F.collect_list(x).alias(name) for name, x in lists.items())), "lists")


def successors(edges: DataFrame) -> DataFrame:
    """(src, upper): each vertex with its neighbours in the oriented graph, as a table."""
    n, presort = _order(edges)
    return _gathered(oriented(edges, presort), n, upper=F.col("dst"))


def meeting(lists: DataFrame, mask: str = "upper", left: str = "upper", right: str = "upper") -> DataFrame:
    """(src, dst, both) for src's entries dst in the list named mask: what src's left list and dst's right list share.

    The work lies in a grid, dst in ranges by what is shared in ranges. A right list goes there once, whatever the
    grid; an entry of a mask goes to each column and one of a left list to each row, so that what is moved grows with the
    square root of the number of tiles, wherever ids lie. A pair has a row for each column where both lists have
    entries; plans of the result belong inside `where_placed`."""
    spark = lists.sparkSession
    entries = lists.select("src", F.explode(right).alias("to"))
    found = entries.agg(F.count("*"), F.min(F.least("src", "to")), F.max(F.greatest("src", "to"))).first()
    grid = Grid.over((entries, "src"), (entries, "to"), tasks_for(spark, found[0], LIST_ENTRIES))
    ends = lists.agg(F.min("src"), F.max("src"), F.min(F.array_min(left)), F.max(F.array_max(left)), F.min(F.array_min(mask)), F.max(F.array_max(mask))).first()
    short = all(abs(x) < 1 << 31 for x in (*found[1:], *ends) if x is not None)
    ids = lambda name: F.col(name).cast("array<int>") if short else F.col(name)
    there = lists.select(F.col("src").alias("dst"), F.explode(grid.columns.cut(ids(right))).alias("_r"))
    there = grid.spread(there.select(grid.of(grid.rows.place("dst"), F.col("_r.i")).alias("_b"), "dst", F.col("_r.ids").alias("_there")))
    here = lists.select("src", grid.rows.cut(ids(mask)).alias("_m"), grid.columns.cut(ids(left)).alias("_l")).select("src", "_l", F.explode("_m").alias("_m")).select("src", "_m", F.explode("_l").alias("_l"))
    here = grid.spread(here.select(grid.of(F.col("_m.i"), F.col("_l.i")).alias("_b"), "src", F.col("_m.ids").alias("_mask"), F.col("_l.ids").alias("_left")))
    wanted = here.select("_b", "src", "_left", F.explode(F.col("_mask").cast("array<long>")).alias("dst"))
    return wanted.join(there.hint("shuffle_hash"), ["_b", "dst"]).select("src", "dst", F.array_intersect("_left", "_there").cast("array<long>").alias("both"))


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c) of every triangle once, in orientation order; plans of it belong inside `where_placed`."""
    return meeting(successors(edges)).select(F.col("src").alias("a"), F.col("dst").alias("b"), F.explode("both").alias("c"))


#: mask side, left neighbours, right neighbours, how often each triangle is counted; of symmetric products half is taken
METHODS = {
    "burkhardt": ("upper", "both", "both", 3), "cohen": ("upper", "lower", "lower", 1), "sandia_ll": ("lower", "lower", "upper", 1),
    "sandia_uu": ("upper", "upper", "lower", 1), "sandia_lut": ("lower", "lower", "upper", 1), "sandia_ult": ("upper", "upper", "lower", 1),
}


def triangle_count(g: Graph, method: str = "auto", presort: bool | None = True) -> int:
    """All methods count the same triangles; they differ in which products are taken. With presort, vertices are ordered by degree first
    where ids alone leave many pairs of successors and a product has a triangular side; None asks a sample of degrees whether that pays.

    auto takes the oriented form, whose work is bounded on skewed graphs."""
    g.require_symmetric(self_edges_allowed=False)
    if method == "auto":
        lists, names, times = successors(g.edges), (), 1
    elif method not in METHODS:
        raise InvalidValue(f"unknown method {method}")
    else:
        *names, times = METHODS[method]
        if presort is None:
            from tropica.sources.random_graph import prefers_presort

            presort = prefers_presort(g)
        n, pays = _order(g.edges)
        if presort and pays and "both" not in names:
            ends = lambda x, y, up: F.struct(F.col(x).alias("src"), F.col(y).alias("dst"), F.lit(up).alias("up"))
            sides = oriented(g.edges).select(F.explode(F.array(ends("src", "dst", True), ends("dst", "src", False))).alias("e")).select("e.*")
        else:  # both directions are there
            sides = g.edges.select("src", "dst", (F.col("src") < F.col("dst")).alias("up"))
        lists = _gathered(sides, 2 * n, upper=F.when(F.col("up"), F.col("dst")), lower=F.when(~F.col("up"), F.col("dst")))
    whole = lists.withColumn("both", F.concat("upper", "lower")) if "both" in names else lists
    with where_placed(lists.sparkSession):
        total = meeting(whole, *names).agg(F.sum(F.size("both"))).first()[0] or 0
    released(lists)
    return total // times


def triangles_per_vertex(g: Graph) -> DataFrame:
    """(id, triangles) of vertices in at least one."""
    g.require_symmetric(self_edges_allowed=False)
    corners = triangles(g.edges).select(F.explode(F.array("a", "b", "c")).alias("id"))
    return written(corners.groupBy("id").agg(F.count("*").alias("triangles")), "triangles", placed=True)


def support(edges: DataFrame, least: int = 1, found: DataFrame | None = None) -> DataFrame:
    """(src, dst, w): for each direction of an edge the triangles it is in, where there are at least so many; a table.

    Triangles (those found before, if given) are counted for one direction of each edge."""
    once = _sides(triangles(edges) if found is None else found).where(F.col("w") >= least)
    return written(_both(once), "support", placed=True)


def _sides(found: DataFrame) -> DataFrame:
    """(src, dst, w), src < dst: edges of triangles (a, b, c) and how many they are in."""
    pair = lambda x, y: F.struct(F.least(x, y).alias("src"), F.greatest(x, y).alias("dst"))
    sides = F.explode(F.array(*(pair(x, y) for x, y in ("ab", "ac", "bc")))).alias("e")
    return found.select(sides).groupBy("e.src", "e.dst").agg(F.count("*").alias("w"))


def _both(once: DataFrame) -> DataFrame:
    ends = lambda x, y: F.struct(F.col(x).alias("src"), F.col(y).alias("dst"), "w")
    return once.select(F.explode(F.array(ends("src", "dst"), ends("dst", "src"))).alias("e")).select("e.*")


def ktruss(g: Graph, k: int) -> DataFrame:
    """(src, dst, w) of the k-truss, w the support of the edge in it."""
    if k < 3:
        raise InvalidValue("k must be at least 3")
    return _both(_truss(*_triangles_of(g), k)[1])


def _triangles_of(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Tables of triangles a < b < c and of their sides."""
    g.require_symmetric()
    corners = triangles(g.edges.where("src <> dst").select("src", "dst")).select(F.array_sort(F.array("a", "b", "c")).alias("t"))
    found = written(corners.select(*(F.col("t")[i].alias(x) for i, x in enumerate("abc"))), "triangles", placed=True)
    return found, written(_sides(found), "sides")


def _truss(found: DataFrame, sides: DataFrame, k: int) -> tuple[DataFrame, DataFrame, dict]:
    """Triangles and sides of the k-truss, and its account; what a lesser truss left, or the whole graph, goes in.

    Triangles are found once: those with a side in too few go, until no more do."""
    before, steps = -1, 1
    while True:
        r = sides.agg(F.count("*"), F.count_if(F.col("w") >= k - 2), F.coalesce(F.sum("w"), F.lit(0))).first()
        if r[1] in (before, 0):
            if r[1] == 0:
                found, sides = found.where("false"), sides.where("false")
            return found, sides, {"k": k, "ntris": r[2] // 3 if r[1] else 0, "nedges": r[1], "nsteps": steps}
        before, steps = r[1], steps + 1
        if r[0] > r[1]:
            last, weak = (found, sides), sides.where(F.col("w") < k - 2).select("src", "dst")
            for x, y in ("ab", "ac", "bc"):
                found = found.join(weak.select(F.col("src").alias(x), F.col("dst").alias(y)), [x, y], "left_anti")
            found = written(found.select("a", "b", "c"), "triangles")
            sides = written(_sides(found), "sides")
            released(*last)


#: Triangles that one task peels to the end; more are peeled in rounds over tables.
TASK_TRIANGLES = 16_000_000


def _peel(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Accounts of the trusses from k to the first empty one, as `_truss` gives them, of all triangles (a, b, c) at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate([np.zeros(0, dtype=np.int64), *parts]) for parts in zip(*([c.to_numpy() for c in batch.columns] for batch in batches), strict=True)] or [np.zeros(0, dtype=np.int64)] * 3
        ids = np.unique(np.concatenate([np.unique(c) for c in columns]))
        a, b, c = (np.searchsorted(ids, x) for x in columns)
        sides = [x * len(ids) + y for x, y in ((a, b), (a, c), (b, c))]
        known = np.unique(np.concatenate([np.unique(x) for x in sides]))
        left = [np.searchsorted(known, x) for x in sides]
        count = lambda: sum(np.bincount(x, minlength=len(known)) for x in left)
        w, at, out = count(), k, []
        while not out or out[-1][2]:
            before, steps = -1, 1
            while (now := int((w >= at - 2).sum())) not in (before, 0):
                before, steps = now, steps + 1
                if (w > 0).sum() > now:
                    strong = w >= at - 2
                    keep = strong[left[0]] & strong[left[1]] & strong[left[2]]
                    left = [x[keep] for x in left]
                    w = count()
            out.append((at, int(w.sum()) // 3 if now else 0, now, steps))
            at += 1
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["k", "ntris", "nedges", "nsteps"])

    return run


def all_ktruss(g: Graph) -> list[dict]:
    """k, ntris, nedges and nsteps of every k-truss from 3 to the first empty one."""
    out, left = [], _triangles_of(g)
    n = (left[1].agg(F.sum("w")).first()[0] or 0) // 3
    while not out or out[-1]["nedges"]:
        if n <= TASK_TRIANGLES:
            rest = left[0].coalesce(1).mapInArrow(_peel(3 + len(out)), "k long, ntris long, nedges long, nsteps long").collect()
            return out + [r.asDict() for r in rest]
        *left, account = _truss(*left, 3 + len(out))
        out.append(account)
        n = account["ntris"]
    return out


def lcc(g: Graph) -> DataFrame:
    """(id, lcc) of vertices with triangles: edges among in- and out-neighbours over the possible ones; self-edges don't count."""
    edges = g.edges.where("src <> dst").select("src", "dst")
    if g.symmetric_structure:
        simple, weight = edges, None
    else:
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        weight = both.groupBy("src", "dst").agg(F.count("*").alias("m"))  # 1 or 2 directed edges between the two
        simple = weight.select("src", "dst")
    simple = written(simple, "simple")
    degree = simple.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d"))
    tri = triangles(simple)
    corner = F.explode(F.array(*(F.struct(F.col(i).alias("id"), F.col(x).alias("src"), F.col(y).alias("dst")) for i, x, y in ("abc", "bac", "cab")))).alias("t")
    opposite = tri.select(corner).select("t.*")
    if weight is None:
        links = opposite.groupBy("id").agg((2 * F.count("*")).alias("links"))
    else:
        links = opposite.join(weight, ["src", "dst"]).groupBy("id").agg(F.sum("m").alias("links"))
    links = written(links, "links", placed=True)
    return links.join(degree, "id").select("id", (F.col("links") / (F.col("d") * (F.col("d") - 1))).alias("lcc"))


def triangle_centrality(g: Graph) -> tuple[DataFrame, int]:
    """((id, centrality) of every vertex, number of triangles)."""
    g.require_symmetric(self_edges_allowed=False)
    edges = g.edges.select("src", "dst")
    t = support(edges)
    y = written(t.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("y")), "sums")
    k = y.agg(F.sum("y")).first()[0] or 0
    near = lambda e, name: e.join(y.select(F.col("id").alias("dst"), "y"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("y").alias(name))
    joined = g.vertices.join(near(edges, "a"), "id", "left").join(near(t.select("src", "dst"), "t"), "id", "left").join(y, "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return joined.select("id", ((3 * zero("a") - 2 * zero("t") + zero("y")) / F.lit(float(k or 1))).alias("centrality")), k // 6


def square_clustering(g: Graph) -> DataFrame:
    """(id, c) of vertices in squares: the squares there are over those there could be."""
    g.require_symmetric(self_edges_allowed=False)
    edges = written(g.edges.select("src", "dst"), "edges")
    degree = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d"))
    # Over pairs u, w of neighbours: degrees less own count, less what triangles share.
    near = edges.join(degree.select(F.col("id").alias("dst"), F.col("d").alias("e")), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("e").alias("e"))
    closed = support(edges).groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("tri"))
    joined = squares(edges).join(degree, "id").join(near, "id").join(closed, "id", "left")
    possible = F.col("e") * (F.col("d") - 1) - F.col("d") * (F.col("d") - 1) - F.coalesce("tri", F.lit(0)) - F.col("squares")
    return joined.select("id", (F.col("squares") / possible).alias("c"))
