"""Minimum spanning forests: tasks drop edges that close cycles of lighter ones, what is left is contracted."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tropica.errors import ConvergenceFailure
from tropica.operators.components import components
from tropica.plans.blocks import Grid, _labels, tasks_for
from tropica.plans.fixpoint import released, written

#: Edges whose forest one task finds.
TASK_EDGES = 4_000_000


def _order(table: pa.Table) -> np.ndarray:
    """The rows by (w, src, dst), as Spark orders them: nulls first, NaN last."""
    w = table["w"].combine_chunks()
    known = w.is_valid().to_numpy(zero_copy_only=False)
    if pa.types.is_integer(w.type) or pa.types.is_floating(w.type):
        w = w.fill_null(0).to_numpy(zero_copy_only=False)
    else:
        w = pc.rank(w, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy(zero_copy_only=False)
    return np.lexsort((table["dst"].to_numpy(), table["src"].to_numpy(), w, known))


def forest(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which of the edges between u and v, lightest first, are in the minimum spanning forest."""
    ids, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = np.split(ends, 2)
    kept, edges = np.zeros(len(u), dtype=bool), np.arange(len(u))
    while True:
        apart = u != v
        u, v, edges = u[apart], v[apart], edges[apart]
        if not len(edges):
            return kept
        at, best = np.arange(len(edges)), np.full(len(ids), len(edges))
        np.minimum.at(best, u, at)
        np.minimum.at(best, v, at)
        roots = np.flatnonzero(best < len(edges))
        best = best[roots]
        kept[edges[best]] = True
        part = np.arange(len(ids))
        part[roots] = u[best] + v[best] - roots
        part[roots[(part[part[roots]] == roots) & (roots < part[roots])]] = -1  # of two that chose one edge, one is the root
        part = np.where(part < 0, np.arange(len(ids)), part)
        while not np.array_equal(part, further := part[part]):
            part = further
        u, v = part[u], part[v]


def _lightest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows (src, dst, w, a, b) in the forest of all of them."""
    if batches := list(batches):
        table = pa.Table.from_batches(batches)
        order = _order(table)
        kept = forest(table["a"].to_numpy()[order], table["b"].to_numpy()[order])
        yield from table.take(pa.array(np.sort(order[kept]))).to_batches()


def thinned(left: DataFrame, n: int) -> tuple[DataFrame, bool]:
    """A table of the edges (src, dst, w, a, b) that close no cycle of lighter ones in their task, and whether there was one task alone.

    Of n edges a task has those between a range of a and one of b, TASK_EDGES about; more are split further. A task
    leaves fewer than its ranges have vertices, so that the grid leaves few edges wherever ids lie."""
    spark, tiles = left.sparkSession, -(-n // TASK_EDGES)
    if tiles > 1:
        grid = Grid.over((left, "a"), (left, "b"), tiles)
        tile = grid.rows.place("a") * grid.columns.n + grid.columns.place("b")
        sizes = dict(left.groupBy(tile.alias("t")).agg(F.count("*").alias("c")).collect())
        parts = [max(1, -(-sizes.get(t, 0) // TASK_EDGES)) for t in range(grid.rows.n * grid.columns.n)]
        firsts = np.cumsum([0, *parts[:-1]]).tolist()
        tiles = sum(parts)
        of = lambda values, i: F.element_at(F.lit(values).cast("array<long>"), (i + 1).cast("int"))
        placed = left.withColumn("_t", tile).withColumn("_b", of(_labels(spark, tiles), of(firsts, F.col("_t")) + F.pmod(F.hash("src", "dst"), of(parts, F.col("_t")))))
        placed = placed.repartition(tiles, "_b").select(left.columns)
    else:
        placed = left.repartition(1)
    return written(placed.mapInArrow(_lightest, left.schema), "thinned"), tiles <= 1


def _contracted(left: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The lightest edge of each end a or b of n edges, and the others between the parts that those make; tables."""
    edge = F.struct("w", "src", "dst", "a", "b")
    ends = left.select(F.explode(F.array("a", "b")).alias("part"), edge.alias("e")).repartition(tasks_for(left.sparkSession, 2 * n), "part")
    taken = written(ends.groupBy("part").agg(F.min("e").alias("e")).select("e.*").distinct().select(left.columns), "taken")
    part = written(components(taken.select(F.col("a").alias("u"), F.col("b").alias("v"))), "merged")
    rest = left
    for c in ("a", "b"):
        of = part.select(F.col("id").alias(c), F.col("component").alias("_c")).hint("shuffle_hash")
        rest = rest.join(of, c, "left").withColumn(c, F.coalesce("_c", c)).drop("_c")
    rest = written(rest.where("a <> b").select(left.columns), "crossing")
    released(part)
    return taken, rest


def spanning_forest(edges: DataFrame, both_directions_add: bool = False, most: int = 100, symmetric: bool = False) -> DataFrame:
    """(src, dst, w) of a minimum spanning forest, each edge once, src < dst; equal weights are told apart by (src, dst).

    both_directions_add sums the weights of both directions of a pair; otherwise the lesser counts. symmetric says that
    each pair is there once in each direction, with one weight."""
    if symmetric and not both_directions_add:
        pairs = edges.where("src < dst").select("src", "dst", "w")
    else:
        pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w")
        pairs = written(pairs.groupBy("src", "dst").agg((F.sum("w") if both_directions_add else F.min("w")).alias("w")), "pairs")
    left, tree = pairs.select("src", "dst", "w", F.col("src").alias("a"), F.col("dst").alias("b")), []
    n = left.count()
    for _ in range(most):
        last = left
        left, whole = thinned(left, n)
        released(last, pairs)
        if whole:
            out = left.select("src", "dst", "w")
            for t in tree:
                out = out.unionByName(t.select("src", "dst", "w"))
            return out
        before, n = n, left.count()
        if 2 * n > before:
            last = left
            taken, left = _contracted(left, n)
            tree.append(taken)
            released(last)
            n = left.count()
    raise ConvergenceFailure(f"forest not complete after {most} rounds")
