from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tropica.llm import substrings


def brute(texts: list, window: int) -> list[tuple[int, list[str]]]:
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    counts = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if counts[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((len(w), [x for x, g in zip(w, gone, strict=True) if not g]))
    return out


def planted() -> list:
    draw = random.Random(5)
    say = lambda n, m: [f"{draw.choice('abcdé')}{draw.randrange(m)}" for _ in range(n)]
    passages = [say(n, 1000) for n in (35, 36, 50, 200, 34)]
    texts = []
    for i in range(120):
        words = say(draw.choice([0, 3, 40, 120]), 1000)
        for _ in range(draw.randrange(3)):
            at, p = draw.randint(0, len(words)), draw.choice(passages)
            a = draw.choice([0, 0, 7])
            words[at:at] = p[a:]
        texts.append(draw.choice([" ", "  \n", "\t"]).join(words))
    texts += [texts[7]] * 4 + [None, "", " \n\t ", "x " * 400, "y " * 36, "a b " * 20 + "\x1f", " ".join(say(60_000, 10**6) + passages[3])]
    return texts


def test_against_brute_force(spark):
    texts = planted()
    rows = [(i if i != 5 else None, t, "z") for i, t in enumerate(texts)]
    found = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(7)).collect()
    want = brute(texts, 35)
    assert len(found) == len(texts)
    for r in found:
        n, kept = want[5 if r["doc_id"] is None else r["doc_id"]]
        assert (r["n_words"], r["n_removed"], r["kept"]) == (n, n - len(kept), " ".join(kept))
        assert sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"]


def test_repeated_rows_digest_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(40))
    frame = spark.createDataFrame([(1, text), (1, text), (2, "short"), (2, "short")], "doc_id long, text string")
    found = sorted((r["doc_id"], r["n_removed"], r["kept"]) for r in substrings.remove_repeats(frame, digest=True).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert found == [(1, 40, sha(""))] * 2 + [(2, 0, sha("short"))] * 2
    assert substrings.remove_repeats(frame.limit(0)).count() == 0


def thue_morse(a: str, b: str, doublings: int) -> str:
    for _ in range(doublings):
        a, b = a + b, b + a
    return a


def test_patterned_words_do_not_collide(spark):
    """Words that polynomial hashes modulo powers of two cannot tell apart."""
    words = [thue_morse(a, b, n) for n in (7, 10, 12) for a, b in ("ab", "ba")]
    hashes, sizes = substrings.word_hashes([" ".join(words).encode(), b"", b"a b"])
    assert len(set(hashes[: len(words)].tolist())) == len(words) and sizes.tolist() == [len(words), 0, 2]
    rest = " ".join(f"w{i}" for i in range(34))
    frame = spark.createDataFrame([(1, f"{words[2]} {rest}"), (2, f"{words[3]} {rest}")], "doc_id long, text string")
    assert [r["n_removed"] for r in substrings.remove_repeats(frame).collect()] == [0, 0]


def test_hashes_depend_on_words_alone():
    draw = random.Random(2)
    words = ["".join(draw.choices("abcdefgh", k=draw.randint(1, 40))).encode() for _ in range(300)]
    alone = [int(substrings.word_hashes([w])[0][0]) for w in words]
    assert substrings.word_hashes([b" ".join(words[:100]), b"\t\n" + b"\x0b ".join(words[100:])])[0].tolist() == alone
    hashes = substrings.word_hashes([b" ".join(words)])[0]
    for size in (1, 2, 5, 8, 35):
        found = substrings.runs(hashes, size)
        assert len(found) == 301 - size and found[17] == substrings.runs(hashes[17 : 17 + size], size)[0]


def test_thousands_of_equal_rows(spark):
    text = " ".join(f"w{i}" for i in range(500))
    rows = spark.range(5000).select("id", F.lit(text).alias("text"))
    for frame in (rows.withColumnRenamed("id", "doc_id"), rows.select(F.lit(None).cast("long").alias("doc_id"), "text")):
        found = substrings.remove_repeats(frame.unionByName(spark.createDataFrame([(9999, text + " end")], "doc_id long, text string")))
        assert {(r["n_words"], r["n_removed"]): r["count"] for r in found.groupBy("n_words", "n_removed").count().collect()} == {(500, 500): 5000, (501, 500): 1}


def test_nonbranching_fragments_become_one_path(spark):
    """A passage that two texts share whole is one path, cut where a third text shares a part of it only."""
    a, b, c = ([f"{x}{i}" for i in range(300)] for x in "abc")
    rows = [(1, " ".join(a + b)), (2, " ".join(b + c))]
    for extra, least in ([], 1), ([(3, " ".join(b[100:200]))], 2):
        keyed = substrings.keyed_rows(spark.createDataFrame(rows + extra, "doc_id long, text string"))
        found = substrings.find_fragments(keyed, 35, 8)
        twice = found.groupBy("mh", "ch").count().where("count > 1").select("mh", "ch")
        paths = {r["k2"]: substrings.joined_paths([f.asDict() for f in r["whole"]], r["heads"]) for r in substrings.compacted(found.join(twice, ["mh", "ch"])).collect()}
        assert len(paths[1]) >= least and [p[1:] for p in paths[1]] == [p[1:] for p in paths[2]]
        assert len(paths[1]) < len(twice.collect()) and (extra or len(paths[1]) == 1)
