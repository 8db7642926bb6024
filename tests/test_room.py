"""What steps leave on disk once they are done."""

from __future__ import annotations

import os
import time

from pyspark.sql import functions as F

from tropica.llm import neardup, substrings
from tropica.plans import fixpoint


def _tables(spark) -> set[str]:
    base = os.path.dirname(fixpoint.work_dir(spark, "x")).removeprefix("file:")
    return {f.rsplit("-", 5)[0] for f in os.listdir(base)}


def _shuffled(spark) -> int:
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    return env.blockManager().diskBlockManager().getAllFiles().size()


def test_writes_leave_no_shuffle_files(spark):
    before = _shuffled(spark)
    found = fixpoint.written(spark.range(5000).groupBy((F.col("id") % 700).alias("k")).agg(F.count("*").alias("c")))
    assert spark.conf.get(fixpoint.CLEANUP) == "false"
    until = time.time() + 10
    while _shuffled(spark) > before and time.time() < until:
        time.sleep(0.1)
    assert _shuffled(spark) <= before
    assert found.agg(F.sum("c"), F.count("*")).first()[:] == (5000, 700)


def test_steps_leave_only_their_result(spark):
    texts = [" ".join(f"w{(i * 7 + j) % 90}" for j in range(60)) for i in range(12)] + ["a b c", "", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    before = _tables(spark)
    neardup.kept_rows(docs).collect()
    assert _tables(spark) - before <= {"placed"}
    rows = substrings.remove_repeats(docs)
    assert rows.count() == len(texts) and _tables(spark) - before <= {"placed", "opened"}
