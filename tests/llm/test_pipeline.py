from __future__ import annotations

import random

import corpus_pipeline

from tropica.llm import packing, quality, substrings


def test_each_stage_takes_effect(spark, tmp_path):
    draw = random.Random(12)
    say = lambda n: " ".join(f"word{draw.randrange(5000)}" for _ in range(n))
    bad = lambda: " ".join(draw.choices("$$$ 999 BUY!!! >>> ###".split(), k=60))
    texts = {i: bad() if i % 4 == 0 else say(80) for i in range(200)}
    passage, item = say(60), say(30)
    texts |= {1: f"{say(50)} {passage} {say(50)}", 2: f"{passage} {say(70)}", 3: texts[5], 6: f"{say(40)} {item} {say(40)}", 201: None, 202: ""}
    rows = [(i, t, "en", "s", len(t or ""), "more") for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(10, 200)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, str(tmp_path)), name)
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        assert name == "packing" or docs.columns == corpus_pipeline.COLUMNS
    good = {i for i in range(200) if i % 4}
    assert not set(seen["quality"]) & {i for i in range(200) if i % 4 == 0} and len(good - set(seen["quality"])) <= 2
    assert 3 in seen["near_duplicates"] and 5 not in seen["near_duplicates"] and set(seen["quality"]) - set(seen["near_duplicates"]) <= {5, 202}
    assert passage not in seen["substrings"][1]["text"] and seen["substrings"][1]["n_chars"] == len(seen["substrings"][1]["text"]) and seen["substrings"][7]["text"] == texts[7]
    assert set(seen["substrings"]) - set(seen["decontamination"]) == {6}
    assert set(seen["packing"]) == set(seen["decontamination"])
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "substrings", "decontamination", "packing"]
    assert (quality.CUTOFF, substrings.WINDOW, packing.CAPACITY) == (0.7, 35, 2048)


def test_cut_texts_stay_with_their_rows(spark):
    draw = random.Random(3)
    say = lambda n: " ".join(f"w{draw.randrange(5000)}" for _ in range(n))
    passage, head, clean, other = say(40), say(20), say(50), say(60)
    rows = [(None, f"{head} {passage}"), (None, clean), (7, f"{passage}"), (7, other), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.substring_stage(spark, docs, "").collect()
    assert sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in out), key=str) == sorted([(None, head, len(head)), (None, clean, len(clean)), (7, other, len(other)), (8, None, 0)], key=str)


def test_only_linked_rows_drop(spark):
    draw = random.Random(4)
    say = lambda n: " ".join(f"w{draw.randrange(5000)}" for _ in range(n))
    a, b, c, d, e = (say(60) for _ in range(5))
    rows = [(1, a), (1, b), (2, b), (3, c), (3, c), (None, c), (None, d), (None, e), (None, f"{e} more"), (4, None), (4, ""), (4, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()), key=str)
    of_e = [x for x in out if x[0] is None and x[1].startswith(e)]
    assert len(of_e) == 1
    assert [x for x in out if x not in of_e] == sorted([(1, a), (1, b), (3, c), (None, d), (4, None), (4, ""), (4, "")], key=str)


def test_empty_tables_and_clashing_names(spark, tmp_path):
    """Tables without rows go through all stages; so do further columns named like those used inside."""
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.written(stage(spark, out, str(tmp_path)), name)
        assert out.count() == 0 and (name == "packing" or out.columns == corpus_pipeline.COLUMNS)
    one = spark.createDataFrame([(1, "some words here", "en", "s", 15, 1, 2, 3, "x")], "doc_id long, text string, lang string, source string, n_chars long, k1 int, _k1 int, linked int, kept string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, one, str(tmp_path)).collect()
        assert len(found) == 1 and found[0]["text"] == "some words here", name
