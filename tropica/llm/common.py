"""Shared plumbing of the training-data operators: table reads, the shared work folder, and files in any store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tropica.plans.fixpoint import released, settled, work_dir, written

__all__ = ["open_fs", "released", "settled", "table", "text_or_empty", "work_dir", "written"]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit("")).alias(column)


def open_fs(path: str):
    """A pyarrow file system and the path inside it: any store pyarrow knows, not only local files."""
    from pyarrow import fs

    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
