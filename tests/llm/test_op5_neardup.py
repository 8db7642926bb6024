from __future__ import annotations

import random
import re

from tropica.llm import neardup


def brute(texts: dict, size: int, threshold: int) -> dict:
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[i] = {tuple(w[j : j + size]) for j in range(max(1, len(w) - size + 1))} if w else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_against_brute_force(spark):
    draw = random.Random(11)
    say = lambda n: [f"w{draw.randrange(3000)}" for _ in range(n)]
    passage, texts = say(30), []
    for n in (1, 2, 4, 5, 30, 60, 200):
        for _ in range(3):
            base = say(n)
            texts += [base, base, [w.upper() for w in base]]
            for _ in range(6):  # copies with edits: a chain and a cloud around the threshold
                copy = list(base)
                for _ in range(draw.randrange(1 + n // 20)):
                    copy[draw.randrange(n)] = f"w{draw.randrange(3000)}"
                texts.append(copy[: max(1, n - draw.randrange(1 + n // 10))])
    texts += [say(40)[:20] + passage + say(20) for _ in range(40)]  # one passage in many unlike documents
    docs = {3 * i + 1: " ".join(t) for i, t in enumerate(texts)} | {2: None, 3: "", 5: " \n", 6: "É é", 8: "é é", 9: " ".join(say(50_000))}
    rows = [(i, t, 1) for i, t in docs.items()]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(5), size=4).collect()
    want = brute(docs, 4, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want and len(found) == len(docs)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_repeated_rows_null_ids_and_empty_table(spark):
    frame = spark.createDataFrame([(4, "a b c d e f"), (4, "a b c d e f"), (None, "a b c d e f"), (9, None), (None, None)], "doc_id long, text string")
    found = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(frame).collect()]
    assert sorted(found, key=repr) == sorted([(4, 2, 4, True), (4, 2, 4, True), (None, 2, 4, False), (9, 0, 9, True), (None, 0, None, True)], key=repr)
    assert neardup.near_duplicates(frame.limit(0)).count() == 0


def test_parity_maps_never_differ_more_than_their_sets():
    import numpy as np

    draw = np.random.default_rng(1)
    pool = draw.integers(0, 1 << 63, 400, dtype=np.uint64)
    for _ in range(50):
        a, b = (np.unique(draw.choice(pool, draw.integers(1, 300))) for _ in range(2))
        bits = np.bitwise_count(neardup.odd_sketch(a, 1024) ^ neardup.odd_sketch(b, 1024)).sum()
        assert bits <= len(np.setxor1d(a, b))
