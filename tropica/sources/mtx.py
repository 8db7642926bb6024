"""Matrix Market files."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tropica.errors import IndexOutOfBounds, InvalidValue, NotImplementedKind, ReadWriteError
from tropica.functions.order import positions

#: C name of an entry type: Spark type and, for whole numbers, its range.
KINDS = {
    "bool": (T.BooleanType(), None), "int8_t": (T.ByteType(), (-(2**7), 2**7 - 1)), "int16_t": (T.ShortType(), (-(2**15), 2**15 - 1)), "int32_t": (T.IntegerType(), (-(2**31), 2**31 - 1)), "int64_t": (T.LongType(), (-(2**63), 2**63 - 1)),
    "uint8_t": (T.ShortType(), (0, 2**8 - 1)), "uint16_t": (T.IntegerType(), (0, 2**16 - 1)), "uint32_t": (T.LongType(), (0, 2**32 - 1)), "uint64_t": (T.DecimalType(20, 0), (0, 2**64 - 1)), "float": (T.FloatType(), None), "double": (T.DoubleType(), None),
}


def type_size(kind: str) -> int:
    """Bytes of an entry of the type with this C name."""
    if kind not in KINDS:
        raise NotImplementedKind(f"unknown entry type {kind}")
    digits = re.sub(r"\D", "", kind)
    return int(digits) // 8 if digits else {"bool": 1, "float": 4, "double": 8}[kind]


def kind_of(table: DataFrame, value: str = "w") -> str:
    """The C name of a column's entry type; signed names where a Spark type stands for several."""
    signed = {of: kind for kind, (of, _) in reversed(KINDS.items()) if not kind.startswith("u") or kind == "uint64_t"}
    if (of := table.schema[value].dataType) not in signed:
        raise NotImplementedKind(f"no entry type for {of.simpleString()}")
    return signed[of]


@dataclass
class Matrix:
    """Entries (src, dst, w) from 0 on, with the shape and the C name of the entry type."""

    entries: DataFrame
    nrows: int
    ncols: int
    kind: str


@dataclass
class _Header:
    form: str = "coordinate"
    field: str = "real"
    storage: str = "general"
    kind: str | None = None


def _header(lines: list[str]) -> tuple[_Header, list[int], int]:
    """The header, the sizes and the number of lines before the first entry."""
    head, seen = _Header(), False
    for i, line in enumerate(lines):
        text = line.strip().lower()
        if text.startswith("%%matrixmarket"):
            words = text.split()
            if len(words) != 5 or words[1] != "matrix" or words[2] not in ("coordinate", "array") or words[3] not in ("real", "integer", "pattern", "complex"):
                raise ReadWriteError(f"not a Matrix Market header: {line.strip()}")
            if words[4] not in ("general", "symmetric", "skew-symmetric", "hermitian"):
                raise ReadWriteError(f"unknown storage {words[4]}")
            head, seen = _Header(*words[2:]), True
        elif typed := re.match(r"%%(\S+)\s+type\s+(\S.*)", text):  # whatever program wrote it
            head.kind = typed[2].strip()
        elif text and not text.startswith("%"):
            try:
                sizes = [int(x) for x in text.split()]
            except ValueError as bad:
                raise ReadWriteError(f"sizes can't be read: {line.strip()}") from bad
            if not seen:
                head.form = "coordinate" if len(sizes) == 3 else "array"
            if len(sizes) != (3 if head.form == "coordinate" else 2):
                raise ReadWriteError(f"{head.form} sizes can't be read: {line.strip()}")
            return head, sizes, i + 1
    raise ReadWriteError("the file ends before its sizes")


def read_matrix(spark: SparkSession, path: str) -> Matrix:
    """Reads a Matrix Market file; symmetric and skew-symmetric storage is expanded.

    Only the lines up to the sizes come to the driver. Entries out of range, repeated pairs and a wrong number of
    entries are errors; complex and hermitian matrices are not supported."""
    # Spark reads the largest parts first: lines are in order by part and place, not by task.
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_from"), F.monotonically_increasing_id().alias("_at"))
    numbered = positions(lines, [F.col("_file"), F.col("_from"), F.col("_at")]).select("value", "position")
    first, most = [], 64
    while True:  # comments may be long: look further until the sizes are there
        first = [r["value"] for r in numbered.where(F.col("position") < most).orderBy("position").collect()]
        try:
            head, sizes, skip = _header(first)
            break
        except ReadWriteError:
            if len(first) < most or any(not x.strip().startswith("%") and x.strip() for x in first):
                raise
            most *= 8
    if head.field == "complex" or head.storage == "hermitian" or head.kind and "complex" in head.kind:
        raise NotImplementedKind("complex matrices are not supported")
    kind = head.kind or {"real": "double", "integer": "int64_t", "pattern": "bool"}[head.field]
    if kind not in KINDS:
        raise NotImplementedKind(f"unknown entry type {kind}")
    nrows, ncols = sizes[0], sizes[1]
    if head.storage != "general" and nrows != ncols:
        raise ReadWriteError("a symmetric matrix must be square")
    if head.form == "array" and head.field == "pattern":
        raise ReadWriteError("an array has values")
    rows = numbered.where((F.col("position") >= skip) & (F.trim("value") != "") & ~F.trim("value").startswith("%"))
    parts = F.split(F.lower(F.trim("value")), r"\s+")
    if head.form == "coordinate":
        number = F.when(F.lit(head.field == "pattern"), F.lit("1")).otherwise(F.get(parts, 2))
        rows = rows.select((F.get(parts, 0).try_cast("long") - 1).alias("src"), (F.get(parts, 1).try_cast("long") - 1).alias("dst"), number.alias("v"))
        expected = sizes[2]
    else:
        rows = positions(rows.select("position", F.get(parts, 0).alias("v")).withColumnRenamed("position", "_p"), [F.col("_p")])
        if head.storage == "general":
            rows = rows.select((F.col("position") % nrows).alias("src"), F.expr(f"position div {nrows}").alias("dst"), "v")
            expected = nrows * ncols
        else:  # the lower triangle, column by column
            n, p = nrows, F.col("position").cast("double")
            j = F.floor((2 * n + 1 - F.sqrt((2 * n + 1) ** 2 - 8 * p)) / 2).cast("long")
            rows = rows.withColumn("dst", j).withColumn("src", F.col("position") - F.expr(f"dst * {n} - (dst * (dst - 1)) div 2") + F.col("dst"))
            rows = rows.select("src", "dst", "v")
            expected = n * (n + 1) // 2
    value = F.when(F.col("v").isin("inf", "+inf", "infinity"), F.lit(math.inf)).when(F.col("v").isin("-inf", "-infinity"), F.lit(-math.inf)).when(F.col("v") == "nan", F.lit(math.nan))
    spark_kind, bounds = KINDS[kind]
    wide = value.otherwise(F.col("v").try_cast("double")) if bounds is None else F.col("v").try_cast("decimal(38,6)")
    from tropica.plans.fixpoint import written

    rows = written(rows.select("src", "dst", wide.alias("w")), "entries")
    faults = rows.agg(
        F.count("*").alias("n"),
        F.coalesce(F.bool_or(F.col("src").isNull() | F.col("dst").isNull() | F.col("w").isNull()), F.lit(False)).alias("torn"),
        F.coalesce(F.bool_or((F.col("src") < 0) | (F.col("src") >= nrows) | (F.col("dst") < 0) | (F.col("dst") >= ncols)), F.lit(False)).alias("out"),
        F.coalesce(F.bool_or(F.lit(False) if bounds is None else (F.col("w") < bounds[0]) | (F.col("w") > bounds[1])), F.lit(False)).alias("range"),
    ).first()
    if faults["torn"] or faults["n"] != expected:
        raise ReadWriteError(f"{faults['n']} entries where {expected} are declared, or one that can't be read")
    if faults["out"]:
        raise IndexOutOfBounds("an entry lies outside the matrix")
    if faults["range"]:
        raise ReadWriteError(f"an entry is out of the range of {kind}")
    rows = rows.withColumn("w", (F.col("w") != 0) if kind == "bool" else F.col("w").cast(spark_kind))
    if head.storage != "general":
        other = (-F.col("w")).cast(spark_kind) if head.storage == "skew-symmetric" else F.col("w")
        rows = rows.unionByName(rows.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), other.alias("w")))
    if not rows.groupBy("src", "dst").count().where("count > 1").isEmpty():
        raise InvalidValue("a pair occurs twice")
    return Matrix(rows, nrows, ncols, kind)


def write_matrix(m: Matrix, path: str, comments: str = "") -> None:
    """Writes a folder of text parts that concatenate to a Matrix Market file, ordered by column.

    A symmetric or skew-symmetric matrix is stored as its lower triangle, one whose values are all 1 as a pattern, a
    full one as an array."""
    e, square = m.entries, m.nrows == m.ncols
    n = e.count()
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("o"))
    storage = "general"
    if square and n:
        r = e.join(back, ["src", "dst"], "left").agg(F.bool_and(F.coalesce(F.col("w") == F.col("o"), F.lit(False))).alias("same"), F.bool_and(F.coalesce(F.col("w").cast("double") == -F.col("o").cast("double"), F.lit(False))).alias("skew")).first()
        storage = "symmetric" if r["same"] else "skew-symmetric" if r["skew"] and m.kind != "bool" else "general"
    full = n == m.nrows * m.ncols
    pattern = not full and e.where(F.col("w").cast("double") != 1).isEmpty()
    field = "pattern" if pattern else "real" if m.kind in ("float", "double") else "integer"
    head = [f"%%MatrixMarket matrix {'array' if full else 'coordinate'} {field} {storage}", f"%%Tropica type {m.kind}", *(f"% {c}" for c in comments.splitlines())]
    if storage != "general":
        e = e.where("src >= dst" if storage == "symmetric" or full else "src > dst")
    number = F.col("w").cast("int").cast("string") if m.kind == "bool" else F.col("w").cast("string")
    number = F.regexp_replace(F.regexp_replace(number, "Infinity", "inf"), "NaN", "nan")
    line = number if full else F.concat_ws(" ", F.col("src") + 1, F.col("dst") + 1, *([] if pattern else [number]))
    head.append(f"{m.nrows} {m.ncols}" + ("" if full else f" {e.count()}"))
    body = e.select(F.col("dst").alias("a"), F.col("src").alias("b"), line.alias("value"))
    top = e.sparkSession.createDataFrame([(-1, i, h) for i, h in enumerate(head)], "a long, b long, value string")
    top.unionByName(body).repartitionByRange("a", "b").sortWithinPartitions("a", "b").select("value").write.text(path)


def read_triples(spark: SparkSession, path: str, nrows: int, ncols: int, kind: str = "float") -> Matrix:
    """Tab-separated `i j x` from 1 on; the shape comes from the caller."""
    rows = spark.read.csv(path, sep="\t", schema="i long, j long, x double").select((F.col("i") - 1).alias("src"), (F.col("j") - 1).alias("dst"), F.col("x").cast(KINDS[kind][0]).alias("w"))
    return Matrix(rows, nrows, ncols, kind)


