from __future__ import annotations

from pyspark.sql import functions as F

from tropica.llm import decontam

ITEM = "A farmer named Alice sold 12 apples to Bob and then bought 12 pears, so how much money did the farmer keep at the end of the day?"
CLEAN = "Nothing in this note resembles any question that a careful examiner would ever set for pupils of whatever age or school."
CASES = {
    1: f"Some words before. {ITEM} Some words after.",
    2: ITEM.upper().replace("ALICE", "alice"),
    3: ITEM.replace("12", "37").replace("Alice", "Maria").replace("Bob", "Pedro"),  # other numbers and names, used alike
    4: ITEM.replace("12 apples", "37 apples").replace("12 pears", "38 pears"),  # one number of the question became two
    5: CLEAN,
    6: None,
    7: "",
    8: ITEM[:40],
    9: f"{CLEAN} " * 3000 + ITEM,
}


def test_cases(spark):
    rows = [(i, t, "x") for i, t in CASES.items()] + [(1, CASES[1], "x"), (None, ITEM, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_ids string")
    bench = spark.createDataFrame([(70, ITEM, 1), (71, None, 1), (72, "too short", 1), (73, "", 1), (70, ITEM, 1)], "item_id long, text string, doc_id int")
    found = decontam.decontaminate(docs, bench).collect()
    assert len(found) == len(rows)
    hit = {r["doc_id"] for r in found if r["contaminated"]}
    assert {None, 1, 3, 9} <= hit and not hit & {5, 6, 7, 8}
    assert all(r["item_ids"] == ([70] if r["contaminated"] else []) and (r["n_windows"] > 0) == r["contaminated"] for r in found)
    spans = {r["doc_id"]: r["n_windows"] for r in found}
    assert spans[1] == spans[9] == spans[None] and spans.get(4, 0) < spans[1]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert not decontam.decontaminate(docs, bench.limit(0)).first()["contaminated"]
    assert decontam.decontaminate(docs.limit(0), bench).count() == 0


def test_templates(spark):
    row = spark.range(1).select(decontam.words(F.lit("He paid $1,200.50 for 3 kg in Rome. Then 5% left")).alias("w"))
    tokens = row.select(decontam.template(F.col("w"), F.lit(0), F.size("w")).alias("t")).first()["t"]
    assert tokens == ["he", "paid", "<num>", "for", "<num>", "<unit>", "in", "<name>", "then", "<num>", "left"]


def test_joined_anchors_equal_listed_ones(spark, monkeypatch):
    docs = spark.createDataFrame(list(CASES.items()), "k long, text string")
    bench = spark.createDataFrame([(70, ITEM)], "item_id long, text string")
    listed = sorted(map(tuple, decontam.matches(docs, bench).collect()))
    monkeypatch.setattr(decontam, "LISTED_ANCHORS", 0)
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", 0)
    assert sorted(map(tuple, decontam.matches(docs, bench).collect())) == listed


def test_capitals_hide_no_passage(spark):
    docs = spark.createDataFrame([(1, f"Before it. {ITEM.upper()} AFTER IT."), (2, ITEM.title()), (3, CASES[2]), (4, CLEAN.upper())], "doc_id long, text string")
    upper = spark.createDataFrame([(70, ITEM)], "item_id long, text string")
    assert {r["doc_id"] for r in decontam.decontaminate(docs, upper).collect() if r["contaminated"]} == {1, 2, 3}
    upper = spark.createDataFrame([(70, ITEM.upper())], "item_id long, text string")  # and the other way round
    assert {r["doc_id"] for r in decontam.decontaminate(docs, upper).collect() if r["contaminated"]} == {1, 2, 3}


def test_slots_are_judged_inside_windows(spark):
    docs = spark.createDataFrame([(4, CASES[4]), (5, CASES[4].replace("Alice", "Maria").replace("how much", "how very much"))], "k long, text string")
    found = sorted((r["k"], r["q"]) for r in decontam.matches(docs, spark.createDataFrame([(70, ITEM)], "item_id long, text string")).collect())
    # Windows that hold both numbers (0 to 5) have two values for one; the second document has no other whole window.
    assert found == [(4, q) for q in range(6, 16)]


def test_one_altered_slot_hides_no_long_copy(spark):
    item = "A tank with a volume of 12 litres is filled by a pump that moves 3 litres every minute, while a leak drains 12 buckets a day from it, and the owner wants to know how long the pump must run until the tank holds water up to its very brim without any of it lost."
    docs = spark.createDataFrame([(1, item.replace("12 buckets", "13 buckets")), (2, item.replace("minute", "hour")), (3, CLEAN)], "doc_id long, text string")
    found = decontam.decontaminate(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).orderBy("doc_id").collect()
    assert [r["contaminated"] for r in found] == [True, True, False]


def test_clashing_columns_pass_through(spark):
    docs = spark.createDataFrame([(1, ITEM, 5, [6], 7, 8, 9, 10)], "doc_id long, text string, n int, ids array<int>, k int, _k int, row int, n_windows int")
    found = decontam.decontaminate(docs, spark.createDataFrame([(70, ITEM)], "item_id long, text string")).first().asDict()
    assert {k: found[k] for k in ("n", "ids", "k", "_k", "row")} == {"n": 5, "ids": [6], "k": 7, "_k": 8, "row": 9} and found["n_windows"] == 16


def test_short_and_placeholder_items_count_word_for_word(spark):
    items = {1: "Who wrote the old song?", 2: "What is the tallest of all mountains here?", 3: "12 15 18 21 24 27 30 33 36 39", 4: "Alice Bob Carol Dave Erin Frank Grace Heidi Ivan Judy", 5: "", 6: "?!"}
    texts = {1: "Question who wrote the OLD song then", 2: f"Question: {items[2]}", 3: f"Go on with {items[3]} and so on", 4: f"we met {items[4]} there", 5: CLEAN, 6: "Who wrote the new song? 13 15 18 21 24 27 30 33 36 39"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = decontam.decontaminate(docs, spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    assert {r["doc_id"]: r["item_ids"] for r in found} == {1: [1], 2: [2], 3: [3], 4: [4], 5: [], 6: []}
