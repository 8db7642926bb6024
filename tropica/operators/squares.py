"""Cycles of four vertices at every vertex, from the number of neighbours that pairs of vertices share."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tropica.plans.blocks import Blocks, _labels
from tropica.plans.fixpoint import where_placed, written


#: Neighbours in the lists of one range of ids, and paths of two edges that are counted at once.
RANGE_ENTRIES = 8_000_000
PATHS_AT_ONCE = 4_000_000


def _ranges(cores: int, entries: int) -> int:
    """Ranges of ids: small graphs are cut finer, until pairs of ranges occupy all cores."""
    return max(1, -(-entries // RANGE_ENTRIES), min(math.isqrt(4 * cores), entries // 50_000))


def _flat(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, lengths of their lists, and the lists one after another."""
    lists = table["near"].combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
    return table["id"].to_numpy(), np.asarray(lists.value_lengths(), dtype=np.int64), np.asarray(lists.flatten())


def _pairs(left: pa.Table, right: pa.Table) -> pa.Table:
    """(id, squares) that pairs of a vertex on the left and a later one on the right add to both."""
    us, ulen, uk = _flat(left)
    vs, vlen, vk = _flat(right)
    by = np.argsort(vk, kind="stable")
    ends = np.repeat(np.arange(len(vs)), vlen)[by]
    middles, first = np.unique(vk[by], return_index=True)
    bounds = np.append(first, len(vk))
    of = np.repeat(np.arange(len(us)), ulen)
    at = np.searchsorted(middles, uk)
    there = at < len(middles)
    there[there] = middles[at[there]] == uk[there]
    of, at = of[there], at[there]
    begins, counts = bounds[at], bounds[at + 1] - bounds[at]
    reach = np.append(0, np.cumsum(counts))
    rows = np.searchsorted(of, np.arange(len(us) + 1))
    here, over = np.zeros(len(us), dtype=np.int64), np.zeros(len(vs), dtype=np.int64)

    def paths(a: int, b: int) -> np.ndarray:
        """Right ends of the paths through entries a to b."""
        n = counts[a:b]
        return ends[np.repeat(begins[a:b] - (reach[a:b] - reach[a]), n) + np.arange(reach[b] - reach[a])]

    u = 0
    while u < len(us):
        # As many vertices as have that many paths together, one at least.
        to = max(u + 1, int(np.searchsorted(reach[rows], reach[rows[u]] + PATHS_AT_ONCE, side="right")) - 1)
        to = min(to, len(us))
        a, b = rows[u], rows[to]
        if to == u + 1:
            shared = np.zeros(len(vs), dtype=np.int64)
            while a < b:
                stop = min(b, max(a + 1, int(np.searchsorted(reach, reach[a] + PATHS_AT_ONCE, side="right")) - 1))
                shared += np.bincount(paths(a, stop), minlength=len(vs))
                a = stop
            v = np.flatnonzero(shared > 1)
            owner, c = np.full(len(v), u), shared[v]
        else:
            keys = np.repeat(of[a:b] - u, counts[a:b]) * len(vs) + paths(a, b)
            keys.sort()
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
            c = np.diff(np.append(starts, len(keys)))
            starts, c = starts[c > 1], c[c > 1]
            owner, v = keys[starts] // len(vs) + u, keys[starts] % len(vs)
        later = vs[v] > us[owner]
        owner, v, c = owner[later], v[later], c[later]
        np.add.at(here, owner, c * (c - 1) // 2)
        np.add.at(over, v, c * (c - 1) // 2)
        u = to
    ids, found = np.append(us, vs), np.append(here, over)
    return pa.table({"id": ids[found > 0].astype(np.int64), "squares": found[found > 0]})


def squares(edges: DataFrame) -> DataFrame:
    """(id, squares) of vertices of symmetric edges(src, dst) in squares: over all others, pairs of neighbours shared with them.

    Ranges of ids meet once, in a task; a list of neighbours goes to each of the ranges, a path of two edges nowhere."""
    spark = edges.sparkSession
    lists = written(edges.groupBy(F.col("src").alias("id")).agg(F.collect_list("dst").alias("near"), F.count("*").alias("d")), "lists")
    r = lists.agg(F.sum("d"), F.min("id"), F.max("id")).first()
    blocks = Blocks.over(edges, "src", _ranges(spark.sparkContext.defaultParallelism, r[0] or 0))
    n = blocks.n
    labels = F.lit(_labels(spark, n * n)).cast("array<long>")
    place, other = blocks.place("id"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_j")
    short = r[0] and -(1 << 31) <= r[1] and r[2] < 1 << 31
    near = F.col("near").cast("array<int>") if short else F.col("near")
    cut = lists.select("id", near.alias("near"), place.alias("_i"), other)
    side = lambda i, j: cut.where("_i <= _j" if i == "_i" else "_i >= _j").select(F.element_at(labels, (F.col(i) * n + F.col(j) + 1).cast("int")).alias("_b"), "id", "near").repartition(n * n, "_b")
    tiles = side("_i", "_j").groupBy("_b").cogroup(side("_j", "_i").groupBy("_b"))
    with where_placed(spark):
        return written(tiles.applyInArrow(_pairs, "id long, squares long").groupBy("id").agg(F.sum("squares").alias("squares")), "squares")
