from __future__ import annotations

import random
import zlib

from tropica.llm import quality

GOOD, BAD = "the of river stone walked quietly home before evening and spoke about weather".split(), "BUY!!! $$$ click ###1 http://x.y 99% WIN now!!! >>> <<< 000 @@@ free!!!".split()


def made(n: int) -> tuple[list, list]:
    draw = random.Random(3)
    docs = [(i, " ".join(draw.choices(GOOD if i % 3 else BAD, k=draw.randint(30, 80)))) for i in range(n)]
    return docs, [(i, int(i % 3 > 0)) for i in range(n) if i % 10]


def test_held_out_rows_are_told_apart(spark):
    docs, labels = made(600)
    frame = spark.createDataFrame([(i, t, 5.0, -1) for i, t in docs] + [(9001, None, 5.0, -1), (None, "", 5.0, -1), (9002, "the river " * 100_000, 5.0, -1)], "doc_id long, text string, score double, y int")
    model = quality.train(frame, spark.createDataFrame(labels, "doc_id long, quality int"))
    found = quality.score(frame, model).withColumn("held", quality.held_out()).collect()
    assert len(found) == len(docs) + 3 and all(0 <= r["score"] <= 1 and r["y"] == -1 for r in found)
    held = [r for r in found if r["held"]]
    assert {r["doc_id"] for r in held} == {i for i in [*range(600), 9001, 9002] if zlib.crc32(str(i).encode()) % 4 == 2}
    right = [(r["score"] >= quality.CUTOFF) == bool(r["doc_id"] % 3) for r in held if r["doc_id"] < 600]
    assert sum(right) > 0.95 * len(right)
    losses = [(r["score"] - (r["doc_id"] % 3 > 0)) ** 2 for r in held if r["doc_id"] < 600]
    assert sum(losses) / len(losses) < 0.05


def test_labels_of_held_out_rows_are_never_learned(spark):
    docs, labels = made(120)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    score = lambda ls: {r["doc_id"]: r["score"] for r in quality.score(frame, quality.train(frame, spark.createDataFrame(ls, "doc_id long, quality int"))).collect()}
    assert score(labels) == score(turned)


def test_without_labels_or_rows(spark):
    frame = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "doc_id long, text string")
    none = quality.train(frame, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r["score"] for r in quality.score(frame, none).collect()] == [1.0] * 3
    zero = quality.train(frame, spark.createDataFrame([(1, 0), (1, None)], "doc_id long, quality int"))
    assert {r["score"] for r in quality.score(frame, zero).collect()} == {0.0} and quality.score(frame.limit(0), zero).count() == 0


def test_clashing_columns_and_repeated_ids(spark):
    docs, labels = made(90)
    frame = spark.createDataFrame([(i, t, "a", 1) for i, t in docs] + [(1, GOOD[0], "b", 2)] * 300, "doc_id long, text string, _text string, y int")
    model = quality.train(frame, spark.createDataFrame(labels, "doc_id long, quality int"))
    found = quality.score(frame, model).collect()
    assert len(found) == 390 and {r["_text"] for r in found} == {"a", "b"} and all(0 <= r["score"] <= 1 for r in found)
