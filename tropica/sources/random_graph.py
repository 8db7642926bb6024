"""Random vectors, matrices and degree samples from seeds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tropica.graph import Graph
from tropica.sources.mtx import KINDS, Matrix

_MASK = (1 << 64) - 1


def seed_vector(ids: DataFrame, seed: int) -> DataFrame:
    """(id, x): a random 64-bit state for every id."""
    return ids.select("id", F.xxhash64("id", F.lit(seed)).alias("x"))


def next_vector(states: DataFrame) -> DataFrame:
    return states.select("id", F.xxhash64("x").alias("x"))


def random_matrix(spark: SparkSession, kind: str, nrows: int, ncols: int, density: float, seed: int = 0) -> Matrix:
    """round(density * nrows * ncols) draws, equal places keep their largest value; infinite density gives a full matrix."""
    if math.isinf(density):
        places = spark.range(nrows * ncols).select(F.expr(f"id div {ncols}").alias("src"), (F.col("id") % ncols).alias("dst"), F.xxhash64("id", F.lit(seed)).alias("h"))
    else:
        draw = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 62))
        places = spark.range(round(density * nrows * ncols)).select((draw(1) % nrows).alias("src"), (draw(2) % ncols).alias("dst"), F.xxhash64("id", F.lit(seed), F.lit(3)).alias("h"))
    spark_kind, bounds = KINDS[kind]
    if kind == "bool":
        value = F.col("h") < 0
    elif bounds is None:
        value = (F.pmod(F.col("h"), F.lit(1 << 53)) / F.lit(float((1 << 53) - 1))).cast(spark_kind)
    else:
        value = (F.pmod(F.col("h"), F.lit(min(bounds[1], 2**62) + 1)) if bounds[1] < 2**63 - 1 else F.shiftright("h", 1)).cast(spark_kind)
    return Matrix(places.withColumn("w", value).groupBy("src", "dst").agg(F.max("w").alias("w")), nrows, ncols, kind)


class Random60:
    """60 random bits from four draws of 15, as sampling of vertices needs them."""

    def __init__(self, seed: int):
        self.seed = seed & _MASK

    def bits15(self) -> int:
        self.seed = (self.seed * 1103515245 + 12345) & _MASK
        return (self.seed // 65536) % 32768

    def __call__(self) -> int:
        out = 0
        for _ in range(4):
            out = out * 32767 + self.bits15()  # not 2**15: the published samples come from this factor
        return out % (1 << 60)


def sample_degree(g: Graph, by_out: bool = True, samples: int = 1000, seed: int = 0) -> tuple[float, int]:
    """Mean and median degree of vertices 0 to n - 1 drawn with replacement; absent degrees are 0. Only the sampled vertices' degrees are collected."""
    draw, n = Random60(seed), g.n
    ids = [draw() % n for _ in range(samples)]
    degree = g.out_degree() if by_out or not g.directed else g.in_degree()
    wanted = g.edges.sparkSession.createDataFrame([(i,) for i in sorted(set(ids))], "id long")
    found = {r["id"]: r["degree"] for r in degree.join(F.broadcast(wanted), "id").collect()}
    degrees = sorted(found.get(i, 0) for i in ids)
    return sum(degrees) / samples, degrees[samples // 2]


def prefers_presort(g: Graph) -> bool:
    """Whether ordering by degree pays: more than 1000 vertices, mean degree of at least 10, and a sampled mean over four times the median."""
    n = g.n
    if n <= 1000 or g.edges.count() / n < 10:
        return False
    mean, median = sample_degree(g, True, 1000, n)
    return mean > 4 * median
