"""From raw documents to packed training sequences: STAGES in order, each reading what the one before it wrote.

Every stage works on all rows that reach it and keeps the columns of documents; the last returns the pieces of packed
sequences. Rows that repeat a doc_id are judged row by row where texts differ; null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tropica.llm import decontam, neardup, packing, quality, substrings
from tropica.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good ones, at the cutoff of its query; without labels of both kinds none is known to be bad."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality.train(docs, labels)
    if model.network is None:
        return docs.select(COLUMNS)
    return quality.score(docs.select(COLUMNS), model, "_score").where(F.col("_score") >= quality.CUTOFF).select(COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that with the smallest doc_id, of several rows of it one; rows without words stay."""
    keys = substrings.row_keys()
    kept = written(neardup.kept_rows(docs).withColumnsRenamed({"k1": "_k1", "k2": "_k2"}), "kept")
    rows = docs.select(COLUMNS).withColumns({"_k1": keys["k1"], "_k2": keys["k2"]}).join(kept, ["_k1", "_k2"])
    copies = rows.where("linked").groupBy("_k1", "_k2").agg(F.min(F.struct(COLUMNS)).alias("row")).select("row.*")  # rows that repeat in full text too
    return rows.where("linked is null").select(COLUMNS).unionByName(copies)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 35 words that occur elsewhere; a text that nothing is cut from stays as it was."""
    cut = substrings.keyed_repeats(docs).where("n_removed > 0").select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("kept").alias("_kept"))
    keys = substrings.row_keys()
    joined = docs.select(COLUMNS).join(cut.dropDuplicates(["_k1", "_k2"]), (keys["k1"] == F.col("_k1")) & (keys["k2"] == F.col("_k2")), "left")
    changed = F.col("_kept").isNotNull()
    rows = joined.withColumns({"text": F.when(changed, F.col("_kept")).otherwise(F.col("text")), "n_chars": F.when(changed, F.length("_kept").cast("long")).otherwise(F.col("n_chars"))})
    return rows.where(~changed | (F.col("text") != "")).select(COLUMNS)  # a document that was nothing else goes


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontam.decontaminate(docs.select(COLUMNS), benchmark).where(~F.col("contaminated")).select(COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(written(packing.pieces(docs), "pieces"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substrings", substring_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]
#: SQL cannot express the learned classifier and the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
