from __future__ import annotations

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tropica.llm import transducer
from tropica.llm.wordmemo import default_vocabulary, load

VOCABULARY = default_vocabulary("word_bpe_49k.json")


def truth(texts: list[str]) -> list[int]:
    return [len(load(VOCABULARY).encode(t, add_special_tokens=False).ids) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abtshereélvİßé漢字'0९1  \n .!$€🙂́Σ"), max_size=60), max_size=4))
def test_counts_equal_the_library(texts):
    assert transducer.counter(VOCABULARY).count(texts) == truth(texts)


def test_words_special_strings_and_long_texts():
    draw = random.Random(6)
    say = lambda n: "".join(draw.choice("etaoinshrdlucmfwypvbgkjqxz") for _ in range(n))
    texts = [" ".join(say(draw.randint(1, 14)) for _ in range(300)) for _ in range(40)]
    texts += [say(5000), "a<|endoftext|>b <|startoftext|><|endoftext|>", "<|ENDOFTEXT|>", "", " ", "x" * 3000, "don't we'll I'VE 's ''s it's2", "word " * 100_000]
    assert transducer.counter(VOCABULARY).count(texts) == truth(texts)


def test_chunk_size_does_not_matter():
    machine, text = transducer.counter(VOCABULARY).transducer, b"internationalisation" * 30
    starts = np.zeros(len(text), dtype=bool)
    starts[[0, 45, 46, 300]] = True
    counts = {c: machine.count(np.frombuffer(text, dtype=np.uint8), starts, np.array([len(text), 0]), c).tolist() for c in (1, 7, 64, 10_000)}
    assert len({tuple(c) for c in counts.values()}) == 1


def test_maps_of_long_words_compose(monkeypatch):
    draw, machine = random.Random(3), transducer.counter(VOCABULARY).transducer
    words = ["x" * 900, "ab" * 400, "1" * 300, "".join(draw.choice("etaoinsh") for _ in range(2000)), "aaab" * 211, "a" * 129]
    data = np.frombuffer("".join(words).encode(), dtype=np.uint8)
    starts = np.zeros(len(data), dtype=bool)
    starts[np.cumsum([0, *map(len, words)])[:-1]] = True
    want = sum(truth([w])[0] for w in words if not w.isdigit()) + machine.count(data[:300] * 0 + 49, np.arange(300) == 0, np.array([300]), 10_000)[0]
    for guesses in (1, 2, 64):
        monkeypatch.setattr(transducer, "GUESSES", guesses)
        for chunk in (1, 3, 64, 10_000):
            assert machine.count(data, starts, np.array([len(data)]), chunk).tolist() == [want]
            assert machine.count(data, starts, np.array([1700, 0, len(data) - 1700]), chunk).sum() == want


def test_rows(spark):
    texts = [(1, "Hello World"), (1, "Hello World"), (2, None), (None, ""), (3, "straße " * 3000)]
    found = transducer.count_tokens(spark.createDataFrame([(*t, 0) for t in texts], "doc_id long, text string, n_tokens int")).collect()
    want = [(i, len((t or "").encode()), n, n > 2048) for (i, t), n in zip(texts, truth([t or "" for _, t in texts]), strict=True)]
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
    assert transducer.count_tokens(spark.createDataFrame([], "doc_id long, text string")).count() == 0
