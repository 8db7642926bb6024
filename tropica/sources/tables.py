"""Graphs over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tropica.functions.order import positions
from tropica.graph import Graph
from tropica.plans.blocks import Blocks, tasks_for
from tropica.plans.fixpoint import written


#: Lines whose pairs one task counts.
TASK_LINES = 400_000


def co_purchase(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts that were ordered together; w counts the orders.

    Each pair is counted once and written both ways, in ranges of its lesser id; tasks grow in number with the lines."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")).where("o is not null and p is not null")
    n = tasks_for(spark, lines.count(), TASK_LINES)
    blocks = Blocks.over(lines, "p", n)
    # An order's parts are one list, and its pairs come from that list a part at a time: no join, and one sort in a task.
    orders = lines.repartition(n, "o").groupBy("o").agg(F.collect_set("p").alias("ps"))
    both = orders.select("ps", F.explode("ps").alias("src")).select("src", F.explode(F.filter("ps", lambda p: p > F.col("src"))).alias("dst"))
    both = blocks.spread(both.select("src", "dst", blocks.of("src").alias("_b")))
    once = both.groupBy("_b", "src", "dst").agg(F.count("*").alias("w"))
    ends = lambda x, y: F.struct(F.col(x).alias("src"), F.col(y).alias("dst"), "w")
    edges = written(once.select(F.explode(F.array(ends("src", "dst"), ends("dst", "src"))).alias("e")).select("e.*"), "co-purchase")
    return Graph(edges, written(edges.select(F.col("src").alias("id")).distinct(), "vertices"), False)


def user_transitions(spark: SparkSession, sf_dir: str) -> Graph:
    """From each event's user to the next event's, in order of time; w counts how often."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_id", "user_id")
    placed = positions(events, [F.col("ts"), F.col("event_id")]).select("position", "user_id")
    after = placed.select((F.col("position") - 1).alias("position"), F.col("user_id").alias("dst"))
    pairs = placed.join(after, "position").where("user_id <> dst").groupBy(F.col("user_id").alias("src"), "dst").agg(F.count("*").alias("w"))
    return Graph(written(pairs, "transitions"))


def customer_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src = customer, dst = supplier) pairs that share an order: a bipartite edge table."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_suppkey")
    joined = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(F.count("*").alias("w"))
