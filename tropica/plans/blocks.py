"""Tables cut into ranges of an id, one bucket each: joined by that id without moving them again.

Blocks hold about equally many rows, and their number grows with the table, so that what a task holds does not."""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tropica.plans.fixpoint import work_dir

#: Rows of a block where there are many; small tables are cut finer, to occupy all cores.
BLOCK_ROWS = 2_000_000
LEAST_ROWS = 50_000


def tasks_for(spark: SparkSession, rows: int, each: int = BLOCK_ROWS, least: int = LEAST_ROWS) -> int:
    """Partitions for that many rows: `each` rows in one at most, evenly spread, and not fewer than cores while a core has `least`."""
    return max(1, -(-rows // each), min(spark.sparkContext.defaultParallelism, rows // least))


def _labels(spark: SparkSession, n: int) -> list[int]:
    """For each of n partitions a number that hashes to it, so that no two blocks meet in one task."""
    found = spark.range(40 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id")).collect()
    return [r["id"] for r in sorted(found, key=lambda r: r["p"])]


@dataclass
class Blocks:
    """Ranges of ids: block i holds those above bounds[i - 1] and up to bounds[i]; its label stands for it in tables."""

    bounds: list[int]
    labels: list[int] = field(repr=False)

    @property
    def n(self) -> int:
        return len(self.labels)

    @classmethod
    def over(cls, df: DataFrame, by: str, n: int) -> Blocks:
        """Ranges of df.by with about equally many rows, n at most: a value is in one block whatever its number of rows."""
        spark = df.sparkSession
        cuts = []
        if n > 1:
            found = df.select(F.percentile_approx(by, [i / n for i in range(1, n)], 10 * max(n, 1000)).alias("c")).first()["c"] or []
            cuts = sorted(set(found))
        return cls(cuts, _labels(spark, len(cuts) + 1))

    def of(self, id_: Column | str) -> Column:
        """The label of the block of an id."""
        return self.place(id_, self.labels)

    def place(self, id_: Column | str, names: list[int] | None = None) -> Column:
        """The number of the block of an id, or its name by that number, found by halving."""
        value, names = F.col(id_) if isinstance(id_, str) else id_, names or range(self.n)

        def search(low: int, high: int) -> Column:
            if low == high:
                return F.lit(names[low]).cast("long")
            mid = (low + high) // 2
            return F.when(value <= self.bounds[mid], search(low, mid)).otherwise(search(mid + 1, high))

        return search(0, len(self.bounds))

    def cut(self, ids: Column | str) -> Column:
        """An array of ids as an array of (i, ids) for each block i that has some."""
        ids, ends = F.col(ids) if isinstance(ids, str) else ids, [None, *self.bounds, None]

        def within(low: int | None, high: int | None) -> Column:
            if low is None and high is None:
                return ids
            return F.filter(ids, lambda x: (F.lit(True) if low is None else x > low) & (F.lit(True) if high is None else x <= high))

        parts = F.array(*(F.struct(F.lit(i).cast("long").alias("i"), within(*ends[i : i + 2]).alias("ids")) for i in range(self.n)))
        return F.filter(parts, lambda p: F.size(p["ids"]) > 0)

    def spread(self, df: DataFrame, block: str = "_b") -> DataFrame:
        """df with each block in a partition of its own."""
        return df.repartition(self.n, block)


@dataclass
class Grid:
    """Blocks of one id by blocks of another: a tile has a label and a partition of its own, as a block has."""

    rows: Blocks
    columns: Blocks
    labels: list[int] = field(repr=False)

    @classmethod
    def over(cls, rows: tuple[DataFrame, str], columns: tuple[DataFrame, str], n: int) -> Grid:
        """About n tiles, nearly as many rows as columns."""
        down = math.isqrt(n - 1) + 1
        of = [Blocks.over(*rows, down), Blocks.over(*columns, -(-n // down))]
        return cls(*of, _labels(rows[0].sparkSession, of[0].n * of[1].n))

    def of(self, row: Column, column: Column) -> Column:
        return F.element_at(F.lit(self.labels).cast("array<long>"), (row * self.columns.n + column + 1).cast("int"))

    def spread(self, df: DataFrame, tile: str = "_b") -> DataFrame:
        return df.repartition(len(self.labels), tile)


@dataclass
class Clustered:
    """A table with a column _b for the block of rows.by, bucketed by it in the shared folder."""

    rows: DataFrame
    by: str
    blocks: Blocks
    table: str

    def join(self, values: DataFrame, key: str = "id") -> DataFrame:
        """Rows with the values of rows.by = values.key; only values, with one row for a key, are moved."""
        here = values.withColumnRenamed(key, self.by).withColumn("_b", self.blocks.of(self.by))
        return self.rows.join(self.blocks.spread(here).hint("shuffle_hash"), ["_b", self.by]).drop("_b")

    def release(self) -> None:
        from tropica.plans.fixpoint import released

        self.rows.sparkSession.sql(f"drop table if exists {self.table}")
        released(self.rows)


def clustered(df: DataFrame, by: str, name: str = "blocks") -> Clustered:
    """df written once, in ranges of df.by; df is read three times, so it should be a table or cheap."""
    spark = df.sparkSession
    blocks = Blocks.over(df, by, tasks_for(spark, df.count()))
    path, table = f"{work_dir(spark, name)}.blocks", f"tropica_{uuid.uuid4().hex}"
    columns = [by, *(c for c in df.columns if c != by)]
    placed = blocks.spread(df.select(*columns).withColumn("_b", blocks.of(by)))
    placed.write.format("parquet").bucketBy(blocks.n, "_b").sortBy(*columns[:2]).option("path", path).saveAsTable(table)
    rows = spark.table(table)
    rows._written_to = path
    return Clustered(rows, by, blocks, table)
