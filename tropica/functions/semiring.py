"""Matrix and vector verbs over semirings, as joins and aggregates.

Matrices are (src, dst, w), vectors (id, x); an absent row is no entry. A semiring names its aggregate and its product,
a mask keeps or drops result keys before they are aggregated.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tropica.errors import InvalidValue
from tropica.plans.blocks import Blocks, tasks_for
from tropica.plans.fixpoint import take_placed


@dataclass(frozen=True)
class Semiring:
    """add aggregates, multiply combines two entries; a positional product gets the indices (i, k, j) of A(i, k) B(k, j) instead."""

    add: Callable[[Column], Column]
    multiply: Callable[..., Column]
    positional: bool = False

    def product(self, a: Column, b: Column, i: Column, k: Column, j: Column) -> Column:
        return self.multiply(i, k, j) if self.positional else self.multiply(a, b)


_ADD = {"plus": F.sum, "times": F.product, "min": F.min, "max": F.max, "any": F.min, "lor": F.bool_or, "land": F.bool_and}
_TIMES = {
    "times": lambda a, b: a * b, "plus": lambda a, b: a + b, "first": lambda a, b: a, "second": lambda a, b: b, "min": F.least, "max": F.greatest, "minus": lambda a, b: a - b, "div": lambda a, b: a / b,
    "one": lambda a, b: F.lit(1).cast("long"), "land": lambda a, b: a & b, "lor": lambda a, b: a | b, "eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "lt": lambda a, b: a < b, "gt": lambda a, b: a > b, "le": lambda a, b: a <= b, "ge": lambda a, b: a >= b,
}
_PLACES = {"firsti": lambda i, k, j: i, "firstj": lambda i, k, j: k, "secondi": lambda i, k, j: k, "secondj": lambda i, k, j: j}
SEMIRINGS = {f"{a}_{t}": Semiring(_ADD[a], _TIMES[t]) for a in _ADD for t in _TIMES} | {f"{a}_pair": Semiring(_ADD[a], _TIMES["one"]) for a in _ADD} | {f"{a}_{t}": Semiring(_ADD[a], _PLACES[t], True) for a in _ADD for t in _PLACES}


def semiring(s: str | Semiring) -> Semiring:
    return SEMIRINGS[s] if isinstance(s, str) else s


def _truthy(mask: DataFrame, valued: str | None) -> DataFrame:
    if not valued:
        return mask
    return mask.where(F.col(valued) if dict(mask.dtypes)[valued] == "boolean" else F.col(valued) != 0)


def masked(df: DataFrame, mask: DataFrame | None, keys: list[str], complement: bool = False, valued: str | None = None) -> DataFrame:
    """Rows of df whose keys are in the mask (not in it, if complement); with valued only its truthy rows count."""
    if mask is None:
        return df
    return df.join(_truthy(mask, valued).select(*keys).distinct(), keys, "left_anti" if complement else "left_semi")


def accumulate(old: DataFrame | None, new: DataFrame, keys: list[str], value: str, op: Callable[[Column], Column] | None, mask: DataFrame | None = None, replace: bool = False, complement: bool = False) -> DataFrame:
    """Writes new into old through a mask: inside it the result is new, or with op the union of both combined by it;
    outside it old survives unless replace. Without a mask all is inside; complement turns the mask around."""
    if old is None:
        return masked(new, mask, keys, complement)
    if op:
        new = old.select(*keys, value).unionByName(new.select(*keys, value)).groupBy(*keys).agg(op(value).alias(value))
    if mask is None:
        return new
    inside = masked(new.select(*keys, value), mask, keys, complement)
    return inside if replace else inside.unionByName(masked(old.select(*keys, value), mask, keys, not complement))


#: Entries of A in a block of rows, which one task multiplies and adds up; under a mask of wanted pairs sums are as few as those.
BLOCK_ENTRIES, MASKED_ENTRIES = 50_000, 1_000_000


def mxm(a: DataFrame, b: DataFrame, s: str | Semiring, mask: DataFrame | None = None, complement: bool = False, valued: str | None = None) -> DataFrame:
    """C = A (+.x) B. A mask of wanted pairs is joined before the aggregation, so that unwanted pairs are never summed.

    Large products are taken in blocks of rows of A: each row of B goes once to every block that needs it, and products
    are summed where they arise, so that they are never moved. Both matrices should be tables; A is read more than once."""
    s, spark = semiring(s), a.sparkSession
    left, right = a.select(F.col("src"), F.col("dst").alias("k"), F.col("w").alias("a")), b.select(F.col("src").alias("k"), F.col("dst"), F.col("w").alias("b"))
    product = s.product(F.col("a"), F.col("b"), F.col("src"), F.col("k"), F.col("dst"))
    n = tasks_for(spark, a.count(), BLOCK_ENTRIES if mask is None or complement else MASKED_ENTRIES, BLOCK_ENTRIES // 10)
    if n == 1:
        pairs = masked(left.join(right, "k").select("src", "dst", product.alias("w")), mask, ["src", "dst"], complement, valued)
        return pairs.groupBy("src", "dst").agg(s.add("w").alias("w"))
    take_placed(spark)
    blocks = Blocks.over(a, "src", n)
    left = left.where("src is not null and k is not null").withColumn("_b", blocks.of("src"))
    lists = right.groupBy("k").agg(F.collect_list(F.struct("dst", "b")).alias("_row")).select("k", F.col("_row.dst").alias("_j"), F.col("_row.b").alias("_v"))
    sent = blocks.spread(left.select("k", "_b").distinct().join(lists, "k"))
    entries = sent.select("_b", "k", F.explode(F.arrays_zip("_j", "_v")).alias("_e")).select("_b", "k", F.col("_e._j").alias("dst"), F.col("_e._v").alias("b"))
    pairs = entries.join(blocks.spread(left).hint("shuffle_hash"), ["_b", "k"]).select("_b", "src", "dst", product.alias("w"))
    if mask is not None:
        kept = blocks.spread(_truthy(mask, valued).select("src", "dst", blocks.of("src").alias("_b"))).distinct()
        pairs = pairs.join(kept.hint("shuffle_hash"), ["_b", "src", "dst"], "left_anti" if complement else "left_semi")
    return pairs.groupBy("_b", "src", "dst").agg(s.add("w").alias("w")).drop("_b")


def mxv(a: DataFrame, x: DataFrame, s: str | Semiring, mask: DataFrame | None = None, complement: bool = False, valued: str | None = None) -> DataFrame:
    s = semiring(s)
    product = s.product(F.col("w"), F.col("x"), F.col("src"), F.col("dst"), F.lit(0).cast("long"))
    pairs = a.join(x.select(F.col("id").alias("dst"), "x"), "dst").select(F.col("src").alias("id"), product.alias("x"))
    return masked(pairs, mask, ["id"], complement, valued).groupBy("id").agg(s.add("x").alias("x"))


def vxm(x: DataFrame, a: DataFrame, s: str | Semiring, mask: DataFrame | None = None, complement: bool = False, valued: str | None = None) -> DataFrame:
    s = semiring(s)
    product = s.product(F.col("x"), F.col("w"), F.lit(0).cast("long"), F.col("src"), F.col("dst"))
    pairs = a.join(x.select(F.col("id").alias("src"), "x"), "src").select(F.col("dst").alias("id"), product.alias("x"))
    return masked(pairs, mask, ["id"], complement, valued).groupBy("id").agg(s.add("x").alias("x"))


def ewise_add(a: DataFrame, b: DataFrame, keys: list[str], value: str, op: Callable[[Column, Column], Column]) -> DataFrame:
    """The union of structures: op where both have an entry, else the one there is."""
    joined = a.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_l")).join(b.select(*keys, F.col(value).alias("_b"), F.lit(True).alias("_r")), keys, "full")
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    return joined.select(*keys, F.when(both, op(F.col("_a"), F.col("_b"))).when(F.col("_l").isNotNull(), F.col("_a")).otherwise(F.col("_b")).alias(value))


def ewise_mult(a: DataFrame, b: DataFrame, keys: list[str], value: str, op: Callable[[Column, Column], Column]) -> DataFrame:
    """The intersection of structures."""
    joined = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys)
    return joined.select(*keys, op(F.col("_a"), F.col("_b")).alias(value))


SELECT = {
    "tril": lambda k: F.col("dst") <= F.col("src") + k, "triu": lambda k: F.col("dst") >= F.col("src") + k, "offdiag": lambda k: F.col("dst") != F.col("src") + k, "diag": lambda k: F.col("dst") == F.col("src") + k,
    "eq": lambda k: F.col("w") == k, "ne": lambda k: F.col("w") != k, "lt": lambda k: F.col("w") < k, "le": lambda k: F.col("w") <= k, "gt": lambda k: F.col("w") > k, "ge": lambda k: F.col("w") >= k,
}


def select(a: DataFrame, predicate: str | Column, k=0) -> DataFrame:
    return a.where(SELECT[predicate](k) if isinstance(predicate, str) else predicate)


def apply(a: DataFrame, op: Callable[[Column], Column], value: str = "w") -> DataFrame:
    return a.withColumn(value, op(F.col(value)))


def reduce_rows(a: DataFrame, add: str = "plus") -> DataFrame:
    return a.groupBy(F.col("src").alias("id")).agg(_ADD[add]("w").alias("x"))


def reduce_all(a: DataFrame, add: str = "plus", value: str = "w") -> DataFrame:
    return a.agg(_ADD[add](value).alias(value))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")


def extract(a: DataFrame, rows: DataFrame | None = None, columns: DataFrame | None = None) -> DataFrame:
    """A(I, J), relabelled: rows and columns are (position, id)."""
    if rows is not None:
        a = a.join(rows.select(F.col("id").alias("src"), F.col("position").alias("_i")), "src").drop("src").withColumnRenamed("_i", "src")
    if columns is not None:
        a = a.join(columns.select(F.col("id").alias("dst"), F.col("position").alias("_j")), "dst").drop("dst").withColumnRenamed("_j", "dst")
    return a.select("src", "dst", "w")


def gather(x: DataFrame, index: DataFrame) -> DataFrame:
    """w(i) = x(index(i)) for index(position, id)."""
    return index.join(x, "id").select(F.col("position").alias("id"), "x")


def scatter(x: DataFrame, index: DataFrame, add: str = "min") -> DataFrame:
    """w(index(i)) = the combination of all x(i) sent there."""
    return x.join(index.select(F.col("position").alias("id"), F.col("id").alias("_to")), "id").groupBy(F.col("_to").alias("id")).agg(_ADD[add]("x").alias("x"))


def build(entries: DataFrame, keys: list[str], value: str, duplicates: str | None = "plus") -> DataFrame:
    """Entries to a matrix or vector; duplicates are combined, or an error where no operator is given."""
    if duplicates is None:
        if not entries.groupBy(*keys).count().where("count > 1").isEmpty():
            raise InvalidValue("an entry occurs twice")
        return entries.select(*keys, value)
    return entries.groupBy(*keys).agg(_ADD[duplicates](value).alias(value))


def build_all(entries: DataFrame, keys: list[str], value: str, duplicates: tuple[str, ...]) -> DataFrame:
    """build for several operators at once, told apart by a column how: entries are moved once, to as many tasks as their number asks for."""
    spread = entries.repartition(tasks_for(entries.sparkSession, entries.count()), *keys)
    found = spread.groupBy(*keys).agg(*(_ADD[d](value).alias(f"_{d}") for d in duplicates))
    each = F.explode(F.array(*(F.struct(F.lit(d).alias("how"), F.col(f"_{d}").alias("w")) for d in duplicates)))
    return found.select(*keys, each.alias("e")).select("e.how", *keys, F.col("e.w").alias(value))


def diagonal(x: DataFrame) -> DataFrame:
    return x.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.col("x").alias("w"))


def diagonal_of(a: DataFrame) -> DataFrame:
    return a.where("src = dst").select(F.col("src").alias("id"), F.col("w").alias("x"))


def set_element(a: DataFrame, at: dict[str, int], value, name: str = "w") -> DataFrame:
    """a with one entry put in, or overwritten where there is one."""
    here = reduce(lambda x, y: x & y, [F.col(k) == v for k, v in at.items()])
    one = a.sparkSession.range(1).select(*(F.lit(v).cast("long").alias(k) for k, v in at.items()), F.lit(value).cast(a.schema[name].dataType).alias(name))
    return a.select(*at, name).where(~here).unionByName(one)


def element(a: DataFrame, at: dict[str, int], name: str = "w"):
    """The value of one entry, None where there is none."""
    found = a.where(reduce(lambda x, y: x & y, [F.col(k) == v for k, v in at.items()])).select(name).first()
    return found and found[name]


def structure_of(x: DataFrame, value: str = "x") -> DataFrame:
    """The same entries, all true."""
    return x.withColumn(value, F.lit(True))
