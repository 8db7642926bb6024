from __future__ import annotations

import io
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tropica.llm import pfor
from tropica.llm.wordmemo import default_vocabulary, load, memo

TEXTS = ["", "one", "Hello there,  world \n\n new  line ", " lead", "trail ", "tab\t x", "naïve Ünïcode 漢字   x", "it's we've 12345", "<|endoftext|> a <|endoftext|>", "x " * 50_000, " ".join(f"w{i * 7919 % 100003}" for i in range(30_000))]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=200), st.integers(0, 32))
def test_block_round_trip(values, shift):
    ids = np.array(values, dtype=np.uint32) >> np.uint32(min(shift, 31))
    blocks = pfor.encode_blocks(ids)
    assert (pfor.decode_blocks(b"".join(blocks), [0])[0, : len(ids)] == ids).all()


def test_blocks_of_different_widths():
    draw = np.random.default_rng(3)
    ids = np.concatenate([draw.integers(0, 1 << bits, 4096, dtype=np.uint32) for bits in (0, 16, 3, 16, 31)] + [draw.integers(9, 2000, 77, dtype=np.uint32)])
    ids[[5, 9000]] = 2**32 - 1
    blocks = pfor.encode_blocks(ids)
    starts = np.cumsum([0, *map(len, blocks)]).tolist()[:-1]
    assert (pfor.decode_blocks(b"".join(blocks), starts).ravel()[: len(ids)] == ids).all()


class Source(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_file_round_trip_and_ranges():
    draw, sink = np.random.default_rng(4), io.BytesIO()
    docs = [(i, draw.integers(0, 50_000, n, dtype=np.uint32)) for i, n in enumerate((1, 0, 4095, 1, 4096, 70_000, 3))]
    writer = pfor.Writer(sink)
    for i, ids in docs:
        writer.add(None if i == 1 else i, ids[:3], ids[3:])
    writer.close()
    reader, everything = pfor.Reader(Source(sink.getvalue())), np.concatenate([d for _, d in docs])
    assert [(i, n.tolist()) for i, _, n in reader.documents()] == [(None if i == 1 else i, d.tolist()) for i, d in docs]
    for a, b in ((0, 1), (4090, 4100), (5, 5), (60_000, len(everything))):
        assert (reader.range(a, b) == everything[a:b]).all()
    with pytest.raises(ValueError):
        pfor.Reader(Source(sink.getvalue()[:-1]))


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("aé漢'1 \n\t<|>s ."), max_size=30))
def test_encoding_equals_the_library(text):
    found = [ids.tolist() for ids in memo(default_vocabulary()).encode_all([text, "x", text])]
    assert found == [load(default_vocabulary()).encode(t, add_special_tokens=False).ids for t in (text, "x", text)]


def test_a_full_memo_forgets_and_learns_again(monkeypatch):
    from tropica.llm import wordmemo

    monkeypatch.setattr(wordmemo, "MEMO_WORDS", 50)
    words, draw = wordmemo.WordMemo(default_vocabulary()), np.random.default_rng(1)
    for _ in range(20):
        texts = ["".join(f"w{i}{draw.choice(list(' \n\t'))}" for i in draw.integers(0, 200, 30)) + "end" for _ in range(3)]
        assert [ids.tolist() for ids in words.encode_some(texts)] == [load(default_vocabulary()).encode(t, add_special_tokens=False).ids for t in texts]
        assert len(words.keys) < 200 and len(words.pool) == words.n.sum()


def test_query_against_the_library(spark, tmp_path):
    docs = [(7 * i % 11, t, i) for i, t in enumerate(TEXTS)] + [(50, None, 0), (50, "b", 0)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, start int")
    found = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in pfor.read_ids(pfor.write_ids(frame, str(tmp_path / "ids"), files=3)).collect())
    order = {r["text"]: r["h"] for r in frame.selectExpr("coalesce(text, '') as text", "xxhash64(coalesce(text, '')) as h").collect()}
    want, start = [], 0
    for doc_id, text, _ in sorted(docs, key=lambda d: (d[0], order[d[1] or ""])):
        ids = [*load(default_vocabulary()).encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert found == sorted(want)
    assert pfor.read_ids(pfor.write_ids(frame.limit(0), str(tmp_path / "none"))).count() == 0
