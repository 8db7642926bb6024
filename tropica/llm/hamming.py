"""Nearest neighbours by multi-index hashing of learned binary codes.

Vectors are rotated four ways (principal axes, then iterative quantisation from four starts) and cut to 4 x 64 signs.
Codes fall into blocks of bounded size. In a block the code is split into 32 bytes with an index each; for a search
radius r some byte of any code within r lies within r // 32 of the query's (pigeonhole), so probing those byte values
retrieves every code within r. What they retrieve and lies within r is ranked by the distance of the original vectors in
double precision.

Queries meet the index block by block. Blocks are dealt by a hash of the id, so a vector that repeats a million times
spreads over all of them, and each block answers a query with its k best at most.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tropica.llm.common import written

AXES, ROTATIONS = 64, 4
BITS, PARTS = AXES * ROTATIONS, AXES * ROTATIONS // 8
#: Vectors that the rotation and the radius are learned from at most: those with the smallest hash of vec_id.
SAMPLE_ROWS = 10_000
SAMPLE_QUERIES = 200
#: The radius is set to reach this share of the sample's true neighbours.
RECALL = 0.96
#: Of both sides of a block: all rows are sent once for each block of the other side, so blocks are as large as memory allows (0.5 KB a vector of 64 dimensions).
BLOCK_VECTORS, BLOCK_QUERIES = 16_384, 16_384


@dataclass
class Coder:
    mean: np.ndarray
    rotation: np.ndarray  # dimensions x BITS
    radius: int = BITS

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.packbits((x - self.mean) @ self.rotation > 0, axis=1)  # PARTS bytes, one for each index


def learn(x: np.ndarray, k: int, rounds: int = 30, seed: int = 5) -> Coder:
    """Principal axes and the rotation that loses least when signs are taken; with fewer than 64 dimensions the axes
    are first spread over 64 by random orthonormal rows."""
    draw = np.random.default_rng(seed)
    mean, dims = x.mean(axis=0), x.shape[1]
    _, axes = np.linalg.eigh(np.cov((x - mean).T).reshape(dims, dims) + 1e-12 * np.eye(dims))
    axes = axes[:, ::-1][:, :AXES]
    if dims < AXES:
        axes = axes @ np.linalg.qr(draw.normal(size=(AXES, dims)))[0].T
    z, rotations = (x - mean) @ axes, []
    for _ in range(ROTATIONS):
        rotation = np.linalg.qr(draw.normal(size=(AXES, AXES)))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.where(z @ rotation > 0, 1.0, -1.0).T @ z)
            rotation = (u @ vt).T
        rotations.append(axes @ rotation)
    coder = Coder(mean, np.hstack(rotations))
    codes, bits = coder.codes(x), []
    for q in range(min(SAMPLE_QUERIES, len(x))):
        apart = ((x - x[q]) ** 2).sum(axis=1)
        apart[q] = np.inf
        near = np.argsort(apart, kind="stable")[: min(k, len(x) - 1)]
        bits.append(np.bitwise_count(codes[near] ^ codes[q]).sum(axis=1))
    found = np.sort(np.concatenate(bits)) if bits else np.empty(0)
    if len(found):
        coder.radius = int(found[min(len(found) - 1, int(np.ceil(RECALL * len(found))))])
    return coder


def balls() -> list[np.ndarray]:
    """balls()[s]: the bytes with at most s bits."""
    weight = np.bitwise_count(np.arange(256, dtype=np.uint8))
    return [np.flatnonzero(weight <= s).astype(np.uint8) for s in range(9)]


def part_radii(radius: int) -> list[int]:
    """How far each byte is probed: if radius = PARTS s + a, the first a + 1 bytes within s and the others within s - 1."""
    s, a = divmod(radius, PARTS)
    return [min(8, s if j <= a else s - 1) for j in range(PARTS)]


def search_block(ids: np.ndarray, x: np.ndarray, codes: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, query_codes: np.ndarray, radius: int, k: int) -> list[tuple]:
    """The k nearest in one block of each query, of the codes within radius: (query_id, vec_id, score)."""
    within, radii = balls(), part_radii(radius)
    index = []
    for j in range(PARTS):
        order = np.argsort(codes[:, j], kind="stable")
        index.append((order, np.searchsorted(codes[order, j], np.arange(257))))
    out = []
    for query_id, query, code in zip(query_ids, queries, query_codes, strict=True):
        hit = np.zeros(len(ids), dtype=bool)
        for j, reach in enumerate(radii):
            if reach < 0:
                continue
            order, first = index[j]
            for value in (within[reach] ^ code[j]).tolist():
                hit[order[first[value] : first[value + 1]]] = True
        rows = np.flatnonzero(hit)
        rows = rows[np.bitwise_count(codes[rows] ^ code).sum(axis=1) <= radius]
        rows = rows[ids[rows] != query_id]
        if not len(rows):
            continue
        far = np.sqrt(((x[rows] - query) ** 2).sum(axis=1))
        best = np.lexsort((ids[rows], far))[:k]
        out += [(int(query_id), int(ids[rows[b]]), float(far[b])) for b in best]
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and e (array of double): not null, not all zero, every component finite."""
    e = F.col("embedding").cast("array<double>")
    good = F.col("vec_id").isNotNull() & e.isNotNull() & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    return vectors.where(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e"))


def nearest(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of each query, a row whose vec_id is divisible by `every`.

    Vectors that are null, zero or hold a null or non-finite component take no part, nor do rows without vec_id; of
    rows that repeat a vec_id the least vector counts. Vectors are searched among those of their own length, as others
    have no distance to them. An empty table gives no rows; further columns are not read. Where fewer than k codes lie
    within the radius, the query is answered by all vectors."""
    good = written(usable(vectors).groupBy("vec_id").agg(F.min("e").alias("e")), "vectors")
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = good.where(F.col("vec_id") % every == 0).select(F.size("e").alias("n")).distinct().orderBy("n").collect()  # one index for each length of queries
    for row in asked:
        same = written(good.where(F.size("e") == row["n"]), "length")
        if (n := same.count()) > 1:
            out = out.unionByName(_nearest(same, n, every, k))
    return out


def _nearest(good: DataFrame, n: int, every: int, k: int) -> DataFrame:
    picked = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).select("e").collect()  # SAMPLE_ROWS bounds it
    coder = learn(np.array([r["e"] for r in picked]), k)
    n_queries = good.where(F.col("vec_id") % every == 0).count()
    found = written(_search(good, good.where(F.col("vec_id") % every == 0), n, n_queries, coder, coder.radius, k), "nearest")
    few = found.groupBy("query_id").count().where(F.col("count") >= min(k, n - 1)).select("query_id")
    short = written(good.where(F.col("vec_id") % every == 0).join(few, F.col("vec_id") == F.col("query_id"), "left_anti"), "short")
    if n_short := short.count():  # the radius held too few: every code is within BITS
        done = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti")
        found = done.unionByName(_search(good, short, n, n_short, coder, BITS, k))
    ranked = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("best"))  # k rows for each block
    ranked = ranked.select("query_id", F.posexplode("best").alias("rank", "b"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")


def packed(vectors: DataFrame) -> DataFrame:
    """(vec_id, e) with each vector as the bytes of its doubles."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, rows = batch.column(1).flatten().to_numpy(), batch.num_rows
            parts = values.reshape(rows, -1) if rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in parts], pa.binary())], names=["vec_id", "e"])

    return vectors.select("vec_id", "e").mapInArrow(run, "vec_id long, e binary")


def _search(good: DataFrame, queries: DataFrame, n: int, n_queries: int, coder: Coder, radius: int, k: int) -> DataFrame:
    blocks, shares = max(1, -(-n // BLOCK_VECTORS)), max(1, -(-n_queries // BLOCK_QUERIES))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    share = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shares)).cast("int")
    index = packed(good).select(block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), "vec_id", "e")
    asked = packed(queries).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), share.alias("share"), "vec_id", "e")

    def one(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(index) and len(asked):
            x, q = (np.frombuffer(b"".join(side["e"])).reshape(len(side), -1) for side in (index, asked))
            rows = search_block(index["vec_id"].to_numpy(), x, coder.codes(x), asked["vec_id"].to_numpy(), q, coder.codes(q), radius, k)
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return index.groupBy("block", "share").cogroup(asked.groupBy("block", "share")).applyInPandas(one, "query_id long, vec_id long, score double")


def op3_multi_index_hashing(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
