"""Inference of sparse networks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tropica.plans.fixpoint import written


def infer(features: DataFrame, layers: list[tuple[DataFrame, DataFrame]], top: float = 32.0) -> DataFrame:
    """(src, dst, w) after all layers (weights(src, dst, w), bias(id, x)): products are summed, the bias is added where
    there is an entry, entries that are not positive go, larger ones than top become top."""
    y = features.select("src", "dst", "w")
    for weights, bias in layers:
        a, b = y.select("src", F.col("dst").alias("k"), F.col("w").alias("a")), weights.select(F.col("src").alias("k"), "dst", F.col("w").alias("b"))
        z = a.join(b, "k").groupBy("src", "dst").agg(F.sum(F.col("a") * F.col("b")).alias("w"))
        z = z.join(bias.select(F.col("id").alias("dst"), "x"), "dst", "left").withColumn("w", F.col("w") + F.coalesce("x", F.lit(0.0)))
        y = written(z.where("w > 0").select("src", "dst", F.least("w", F.lit(top)).alias("w")), "layer")
    return y
