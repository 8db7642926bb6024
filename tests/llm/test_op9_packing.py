from __future__ import annotations

import struct
import zlib
from collections import defaultdict

import numpy as np

from tropica.llm import packing
from tropica.llm.wordmemo import default_vocabulary, load


def naive(lengths: list[int], capacity: int) -> list[int]:
    """The gaps left by the sum-of-squares rule, tried out bin by bin."""
    gaps: list[int] = []
    for size in sorted(lengths, reverse=True):
        best = None
        for g in sorted({g for g in gaps if g >= size}):
            after = [*gaps]
            after[after.index(g)] = g - size
            cost = sum(after.count(x) ** 2 for x in set(after) if x)
            if best is None or cost < best[0]:
                best = (cost, after)
        gaps = best[1] if best else [*gaps, capacity - size]
    return sorted(gaps)


def check(sequence, offset, length, capacity):
    held = defaultdict(list)
    for s, o, n in zip(sequence, offset, length, strict=True):
        held[s].append((o, n))
    for places in held.values():
        at = 0
        for o, n in sorted(places):
            assert o == at and n > 0
            at += n
        assert at <= capacity
    return len(held)


def test_rule_against_the_naive_one():
    draw = np.random.default_rng(8)
    for _ in range(20):
        lengths = draw.integers(1, 13, 40)
        sequence, offset = packing.sum_of_squares(lengths, 12)
        check(sequence, offset, lengths, 12)
        gaps = [12 - int(lengths[sequence == s].sum()) for s in range(sequence.max() + 1)]
        assert sorted(gaps) == naive(lengths.tolist(), 12)


def test_few_sequences_and_bounded_blocks(spark):
    lengths = np.random.default_rng(9).integers(1, 1500, 4000)
    frame = spark.createDataFrame([(int(n),) for n in lengths], "length long")
    found = packing.pack(frame, block_pieces=1500).collect()
    n = check([r["sequence_id"] for r in found], [r["offset"] for r in found], [r["length"] for r in found], 2048)
    assert n <= 1.01 * lengths.sum() / 2048 + 3 and packing.pack(frame.limit(0)).count() == 0


def test_query_against_the_library(spark):
    texts = [(1, "one two"), (1, "one two"), (2, None), (3, ""), (None, "x"), (4, "word " * 2047), (5, "word " * 5000), (6, " ".join(map(str, range(4000))))]
    found = packing.pack(packing.pieces(spark.createDataFrame([(*t, 0) for t in texts], "doc_id long, text string, offset int"))).collect()
    check([r["sequence_id"] for r in found], [r["offset"] for r in found], [r["length"] for r in found], 2048)
    want = []
    for doc_id, text in texts:
        ids = [*load(default_vocabulary()).encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids), 2048), len(ids)] if len(ids) > 2048 else [0, len(ids)]
        want += [(doc_id, k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found), key=repr) == sorted(want, key=repr)


def test_clashing_columns(spark):
    frame = spark.createDataFrame([(5, "a", 1, 2, 3, "x"), (2048, "b", 1, 2, 3, "y")], "length long, offset string, sequence_id int, row int, block int, `c 0` string")
    found = {r["length"]: r.asDict() for r in packing.pack(frame).collect()}
    assert list(found[5]) == ["length", "row", "block", "c 0", "sequence_id", "offset"] and found[5]["c 0"] == "x" and found[2048]["offset"] == 0 and found[5]["block"] == 3
