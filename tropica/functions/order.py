"""Global positions without sending all rows to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positions(df: DataFrame, by: list[Column], name: str = "position") -> DataFrame:
    """df with the place (from 0) of each row in the order given: ranges are sorted apart and shifted by the rows before them."""
    from tropica.plans.fixpoint import written

    keys = [f"_o{i}" for i in range(len(by))]
    df = df.withColumns(dict(zip(keys, by, strict=True)))
    # Written once, so that both passes see the same partitions.
    placed = written(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ranges")
    starts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*keys)) - 1
    joined = placed.withColumn("_i", inner).join(F.broadcast(starts.select("_part", before.alias("_b"))), "_part")
    return joined.withColumn(name, (F.col("_i") + F.col("_b")).cast("long")).drop("_part", "_i", "_b", *keys)
