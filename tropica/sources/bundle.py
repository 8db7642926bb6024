"""Collections of matrices, vectors and texts in one folder: Parquet tables under a manifest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from tropica.errors import ReadWriteError
from tropica.sources.mtx import Matrix


def save(spark: SparkSession, path: str, items: dict[str, Matrix | DataFrame | str], name: str = "") -> None:
    """Writes matrices, vectors (id, x) and texts; the manifest comes last, so a folder without one is not complete."""
    entries = []
    for key, item in items.items():
        if isinstance(item, str):
            entries.append({"name": key, "type": "text", "text": item})
            continue
        table = item.entries if isinstance(item, Matrix) else item
        table.write.parquet(f"{path}/{key}")
        entries.append({"name": key, "type": "matrix", "nrows": item.nrows, "ncols": item.ncols, "kind": item.kind} if isinstance(item, Matrix) else {"name": key, "type": "vector"})
    manifest = json.dumps({"version": 1, "collection": name, "items": entries})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.text(f"{path}/manifest")


def load(spark: SparkSession, path: str) -> dict[str, Matrix | DataFrame | str]:
    try:
        lines = [r["value"] for r in spark.read.text(f"{path}/manifest").collect()]
        entries = json.loads("\n".join(lines))["items"]
    except Exception as bad:
        raise ReadWriteError(f"invalid collection {path}") from bad
    out: dict[str, Matrix | DataFrame | str] = {}
    for e in entries:
        if e["type"] == "text":
            out[e["name"]] = e["text"]
        else:
            table = spark.read.parquet(f"{path}/{e['name']}")
            out[e["name"]] = Matrix(table, e["nrows"], e["ncols"], e["kind"]) if e["type"] == "matrix" else table
    return out
