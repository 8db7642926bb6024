"""Loops over DataFrames: cutting a plan at a table in the shared folder, and running a step until nothing changes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tropica.errors import ConvergenceFailure


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which every executor and the driver share, with the scheme of its store.

    Only where the setting is absent (tests on one machine) a temporary folder stands in."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = tempfile.mkdtemp(prefix="tropica-")
        spark.sparkContext.setCheckpointDir(base)
    path, store = _located(spark, base)
    return f"{store.makeQualified(path).toString().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _located(spark: SparkSession, path: str) -> tuple:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def written(df: DataFrame, name: str = "step", placed: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, without lineage, and safe from lost executors.

    placed joins tables cut into blocks where they lie (see plans/blocks.py), not by all of their keys."""
    path = f"{work_dir(df.sparkSession, name)}.parquet"
    with _shuffles_removed(df.sparkSession), where_placed(df.sparkSession) if placed else nullcontext():
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    for made in _steps:
        made.append(out)
    return out


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What writes made inside shuffled goes from the executors' disks as soon as each has ended, not when the driver's
    memory is next cleared; nothing reads it again, as the table stands for it."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_steps: list[list[DataFrame]] = []


def settled(step: Callable[[], DataFrame], name: str) -> DataFrame:
    """What step returns, as a table; the tables that it wrote on the way are removed."""
    _steps.append(made := [])
    try:
        out = written(step(), name)
    finally:
        _steps[:] = [m for m in _steps if m is not made]
    released(*(t for t in made if t is not out))
    return out


PLACED = "spark.sql.requireAllClusterKeysForCoPartition"


def take_placed(spark: SparkSession) -> None:
    """From now on plans take a side that is partitioned by some keys of a join as it is: for results that are planned later."""
    spark.conf.set(PLACED, "false")


@contextmanager
def where_placed(spark: SparkSession) -> Iterator[None]:
    """Plans made inside take a side that is partitioned by some keys of a join as it is."""
    before = spark.conf.get(PLACED)
    spark.conf.set(PLACED, "false")
    try:
        yield
    finally:
        spark.conf.set(PLACED, before)


def released(*frames: DataFrame) -> None:
    """Removes tables of `written` that nothing will read any more."""
    for df in frames:
        if path := getattr(df, "_written_to", None):
            where, store = _located(df.sparkSession, path)
            store.delete(where, True)
            df._written_to = None


def fingerprint(df: DataFrame) -> tuple:
    """Row count and an order-free hash: equal for equal sets of rows."""
    h = F.xxhash64(*df.columns)
    row = df.agg(F.count("*"), F.coalesce(F.sum(F.shiftright(h, 20)), F.lit(0)), F.bit_xor(h)).first()
    return tuple(row)


def until_stable(state: DataFrame, step: Callable[[DataFrame], DataFrame], most: int = 1000, name: str = "step", placed: bool = False) -> tuple[DataFrame, int]:
    """Repeats step until the set of rows no longer changes; returns it and the number of steps."""
    state = written(state, name)
    before = fingerprint(state)
    for rounds in range(1, most + 1):
        last, state = state, written(step(state), name, placed)
        now = fingerprint(state)
        released(last)
        if now == before:
            return state, rounds
        before = now
    raise ConvergenceFailure(f"not stable after {most} rounds")
