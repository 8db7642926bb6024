"""Removal of repeated passages by compaction of the word graph.

Every window of 35 words is an edge of a De Bruijn graph. Consecutive windows that share their least k-mer form one
fragment; equal windows always lie in fragments with the same least k-mer, so

1. fragments whose least k-mer is unique drop out after one count of hashes;
2. fragments of equal content repeat with all their windows. They are the nodes of a graph in which each is followed by
   the next repeated fragment of its text; where a node has one successor and that one no other predecessor, a join
   compacts the two, so that nonbranching runs become paths with all their source coordinates;
3. the words at the coordinates of each path are compared by a cryptographic digest; should two sources differ, all is
   done again with other hashes;
4. where different fragments share the least k-mer (at the ends of a repeated passage), one copy of each is opened and
   its windows are compared one by one.

The least k-mer and the content are 64 bits each from two word hashes of their own. No hash is linear in the bytes or
words, so patterns in them (as in Thue-Morse words) do not collide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tropica.llm.common import released, settled, text_or_empty, written

WINDOW, KMER = 35, 8
#: Bytes of text that a worker holds in arrays at once (more where one text alone is longer).
GROUP_BYTES = 256_000
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[32, *range(9, 14)]] = True
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_HEADS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)  # the first k bytes of eight


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in order."""
    x = a * _FIRST + b
    x = (x ^ (x >> np.uint64(29))) * _SECOND
    return x ^ (x >> np.uint64(32))


class Words:
    """The words of bytes that end in eight zeros: where they start, how long they are, their first eight bytes and hashes."""

    def __init__(self, data: bytes):
        self.data = np.frombuffer(data, dtype=np.uint8)
        inside = ~_SPACES[self.data[:-8]]
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        self.starts, self.lengths = edges[::2], edges[1::2] - edges[::2]
        self.eights = np.ndarray((len(self.data) - 7,), dtype="<u8", buffer=self.data, strides=(1,))
        self.heads = self.eights[self.starts] & _HEADS[np.minimum(self.lengths, 8)]

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64 bits for each word: its bytes are taken eight at a time, each eight mixed with their place."""
        salt = lambda k: mix(k.astype(np.uint64) + np.uint64(1 + (seed << 32)))
        total = mix(self.heads ^ salt(np.zeros(1)))
        long = np.flatnonzero(self.lengths > 8)
        if len(long):
            more = (self.lengths[long] - 1) // 8
            firsts = np.cumsum(more) - more
            k = np.arange(int(more.sum())) - np.repeat(firsts, more) + 1
            at, left = np.repeat(self.starts[long], more) + 8 * k, np.repeat(self.lengths[long], more) - 8 * k
            total[long] += np.add.reduceat(mix((self.eights[at] & _HEADS[np.minimum(left, 8)]) ^ salt(k)), firsts)
        return mix(total + self.lengths.astype(np.uint64) * _FIRST)


def word_hashes(texts: list[bytes], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """64 bits for each word of all texts in one row, and the number of words of each text."""
    words = Words(b"\n".join([*texts, b""]) + bytes(8))
    sizes = np.diff(np.searchsorted(words.starts, np.cumsum([0, *(len(t) + 1 for t in texts)])))
    return words.hashes(seed) if len(words.starts) else np.empty(0, dtype=np.uint64), sizes


def runs(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of size consecutive words, from those of runs half as long."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out, level, width, at = None, words, 1, 0
    while True:
        if size & width:
            part = level[at : at + n]
            out, at = part if out is None else pair(out, part), at + width
        if 2 * width > size:
            return out
        level, width = pair(level[:-width], level[width:]), 2 * width


def fragments(kmer_words: np.ndarray, words: np.ndarray, sizes: np.ndarray, window: int = WINDOW, kmer: int = KMER) -> tuple[np.ndarray, ...]:
    """Text, first window, number of windows, least k-mer, content and repeats of each fragment of several texts in one row.

    In periodic text a fragment follows itself: such a run is one row that says how often."""
    n = len(words) - window + 1
    if n <= 0:
        return (np.empty(0, dtype=np.int64),) * 3 + (np.empty(0, dtype=np.uint64),) * 2 + (np.empty(0, dtype=np.int64),)
    text = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(text[:n] == text[window - 1 :])
    kmers, windows = runs(kmer_words, kmer), runs(words, window)
    least = np.lib.stride_tricks.sliding_window_view(kmers, window - kmer + 1).argmin(axis=1)[at] + at  # the leftmost of equals
    new = np.ones(len(at), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)
    edges = np.flatnonzero(new)
    first, count = at[edges], np.diff(np.append(edges, len(at)))
    # At most window - kmer + 1 windows: the first and the last cover all words between.
    content = pair(pair(windows[first], windows[first + count - 1]), count.astype(np.uint64))
    found = kmers[least[edges]]
    again = np.zeros(len(first), dtype=bool)
    again[1:] = (found[1:] == found[:-1]) & (content[1:] == content[:-1]) & (first[1:] == first[:-1] + count[:-1])
    runs_at = np.flatnonzero(~again)
    repeats = np.diff(np.append(runs_at, len(first)))
    first, count, found, content = (x[runs_at] for x in (first, count, found, content))
    return text[first], first - (np.cumsum(sizes) - sizes)[text[first]], count, found, content, repeats


def _groups(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list[bytes]]]:
    """The texts of a batch, as UTF-8, some MB at a time, with the place of the first."""
    texts, size, at = [], 0, 0
    for i, text in enumerate(batch.column(column).cast(pa.binary())):
        texts.append(text.as_py())
        size += len(texts[-1])
        if size > GROUP_BYTES:
            yield at, texts
            texts, size, at = [], 0, i + 1
    if texts:
        yield at, texts


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def row_keys() -> dict[str, Column]:
    """k1 and k2 tell rows apart (equal rows share them, and their windows repeat anyway)."""
    doc_id = F.col("doc_id").cast("long")
    return {"k1": F.xxhash64(doc_id, F.coalesce("text", F.lit(""))), "k2": F.coalesce(doc_id, F.lit(0).cast("long"))}


def keyed_rows(docs: DataFrame) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty())
    return docs.withColumns(row_keys())


def find_fragments(keyed: DataFrame, window: int, kmer: int, seed: int = 0) -> DataFrame:
    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            for at, texts in _groups(batch, 2):
                (first_hash, sizes), (other_hash, _) = word_hashes(texts, 2 * seed), word_hashes(texts, 2 * seed + 1)
                row, first, count, least, content, repeats = fragments(first_hash, other_hash, sizes, window, kmer)
                row += at
                yield pa.RecordBatch.from_arrays([pa.array(k1[row]), pa.array(k2[row]), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int16)), _signed(least), _signed(content), pa.array(repeats.astype(np.int32))], names=["k1", "k2", "p", "n", "mh", "ch", "m"])

    return keyed.select("k1", "k2", "text").mapInArrow(find, "k1 long, k2 long, p int, n short, mh long, ch long, m int")


def compacted(repeated: DataFrame) -> DataFrame:
    """(k1, k2, whole, heads): the repeated fragments (k1, k2, p, n, mh, ch) of each row in order, and the places p of
    those that start a path of the graph.

    Nodes are contents, edges lead from a fragment to the next one of its row. A node continues a path where it has one
    predecessor alone, everywhere, and that one no other successor; the others are heads."""
    node = F.struct("mh", "ch")
    row = Window.partitionBy("k1", "k2").orderBy("p")
    after, before = F.lead(F.struct("p", node.alias("node"))).over(row), F.lag(F.struct((F.col("p") + F.col("n")).alias("p"), node.alias("node"))).over(row)
    placed = repeated.select("k1", "k2", "p", "n", "mh", "ch", after.alias("after"), before.alias("before"))
    placed = placed.select("mh", "ch", F.when(F.col("after.p") == F.col("p") + F.col("n"), F.col("after.node")).alias("after"), F.when(F.col("before.p") == F.col("p"), F.col("before.node")).alias("before"))
    # One neighbour on a side: each occurrence has one there, and the least equals the greatest.
    one = lambda side: F.when((F.count(side) == F.count("*")) & (F.min(side) == F.max(side)), F.min(side)).alias(side)
    nodes = written(placed.groupBy("mh", "ch").agg(one("before"), one("after")), "nodes")
    back = nodes.where("after is not null").select("after.mh", "after.ch", F.col("mh").alias("b_mh"), F.col("ch").alias("b_ch"))
    tied = nodes.where("before is not null").select("mh", "ch", F.col("before.mh").alias("b_mh"), F.col("before.ch").alias("b_ch")).join(back, ["mh", "ch", "b_mh", "b_ch"], "left_semi")
    heads = written(nodes.select("mh", "ch").join(tied, ["mh", "ch"], "left_anti"), "heads")
    # Inside a path nothing is joined: of a passage that is everywhere, the rows that meet are its heads.
    starts = repeated.join(heads, ["mh", "ch"], "left_semi").select("k1", "k2", F.lit(None).cast(f"struct<p:int,n:{dict(repeated.dtypes)['n']},mh:bigint,ch:bigint>").alias("f"), F.col("p").alias("head"))
    every = repeated.select("k1", "k2", F.struct("p", "n", "mh", "ch").alias("f"), F.lit(None).cast("int").alias("head"))
    return every.unionByName(starts).groupBy("k1", "k2").agg(F.array_sort(F.collect_list("f")).alias("whole"), F.collect_list("head").alias("heads"))  # at most one for each window of a row


def joined_paths(spans: list[dict], heads: list[int]) -> list[tuple[int, int, int, int]]:
    """First window, number of windows and head (mh, ch) of the paths of a row."""
    out: list[list[int]] = []
    heads = set(heads)
    for s in spans:
        if out and s["p"] not in heads and out[-1][0] + out[-1][1] == s["p"]:
            out[-1][1] += s["n"]
        else:
            out.append([s["p"], s["n"], s["mh"], s["ch"]])
    return [tuple(x) for x in out]


def covered(n_words: int, starts: np.ndarray, windows: np.ndarray, window: int) -> np.ndarray:
    """Which words some window in starts[i] ... starts[i] + windows[i] - 1 covers."""
    steps = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + windows + window - 1, -1)
    return np.cumsum(steps[:-1]) > 0


def _render(words: list[bytes], gone: np.ndarray, digest: bool) -> str:
    kept = b" ".join(compress(words, ~gone) if gone.any() else words)
    return hashlib.sha256(kept).hexdigest() if digest else kept.decode()


def _spans(gone: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    return [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2], strict=True)]


OUT = "doc_id long, n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept string"
_OUT = pa.struct([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("kept", pa.string())])


def _result(doc_id, words: list[bytes], gone: np.ndarray, digest: bool) -> dict:
    return {"doc_id": doc_id, "n_words": len(words), "n_removed": int(gone.sum()), "removed": _spans(gone), "kept": _render(words, gone, digest)}


KEYED_OUT, _KEYED_OUT = f"{OUT}, k1 long, k2 long", pa.struct([*_OUT, ("k1", pa.int64()), ("k2", pa.int64())])


def remove_repeats(docs: DataFrame, window: int = WINDOW, kmer: int = KMER, digest: bool = False) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_words, n_removed, removed (spans of word places) and kept.

    Words are maximal runs without ASCII white space. A word goes if a window over it has a word sequence that also
    starts elsewhere in the input, in the same document or another; of a repeated passage no copy stays. kept holds
    the other words joined by one space, or with digest its SHA-256. Null and empty texts have no words, documents
    shorter than a window lose none, rows that repeat (null doc_id too) are judged like any others. An empty table gives
    no rows; columns beside doc_id and text are not read."""
    return keyed_repeats(docs, window, kmer, digest).drop("k1", "k2")


def keyed_repeats(docs: DataFrame, window: int = WINDOW, kmer: int = KMER, digest: bool = False, seed: int = 0) -> DataFrame:
    """What remove_repeats returns, with the keys k1 and k2 of each row."""
    keyed = keyed_rows(docs)
    all_fragments = written(find_fragments(keyed, window, kmer, seed), "fragments")
    shared = all_fragments.groupBy("mh").agg(F.sum("m").alias("c"), (F.min("ch") != F.max("ch")).alias("open")).where("c > 1").drop("c")
    least = written(shared, "least")  # a table of its own: the join below can then split a least k-mer that is everywhere
    shared = written(all_fragments.join(least, "mh"), "shared")
    released(all_fragments, least)
    # A least k-mer with one content alone repeats wherever it is; only where it has several are those counted and joined.
    paths = shared.where("open").groupBy("mh", "ch").agg(F.sum("m").alias("c"), F.min(F.struct("k1", "k2", "p", "n")).alias("at"))
    paths = written(paths, "paths")
    # A run of m repeats is a node of its own, as long as all of them.
    run = F.when(F.col("m") > 1, F.xxhash64("ch", "m")).otherwise(F.col("ch")).alias("ch")
    columns = ["k1", "k2", "p", (F.col("n") * F.col("m")).cast("int").alias("n"), "mh", run]
    several = shared.where("open").join(paths.where("c > 1").select("mh", "ch"), ["mh", "ch"])
    # Rows that repeat as a whole have one key: their fragments meet once, whatever their number.
    repeated = written(shared.where("not open").select(columns).unionByName(several.select(columns)).distinct(), "repeated")
    released(shared)
    opened = paths.groupBy("at.k1", "at.k2").agg(F.collect_list(F.struct("at.p", "at.n", "mh", "c")).alias("opened"))
    placed = lambda: keyed.join(compacted(repeated), ["k1", "k2"], "left").join(opened, ["k1", "k2"], "left")

    def first_pass(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            ids, whole, heads, opened = (batch.column(i) for i in (0, 2, 3, 4))
            keys = [batch.column(i).to_numpy() for i in (5, 6)]
            for at, texts in _groups(batch, 1):
                needs = [opened[at + i].is_valid for i in range(len(texts))]
                hashes, sizes = word_hashes([t for t, need in zip(texts, needs, strict=True) if need], 2 * seed + 1)
                hashes = iter(np.split(hashes, np.cumsum(sizes)[:-1]))
                for i, text in enumerate(texts, at):
                    words = text.split()
                    spans = joined_paths(whole[i].as_py() or [], heads[i].as_py() or [])
                    p, n = (np.array([s[k] for s in spans], dtype=np.int64) for k in (0, 1))
                    sums = [hashlib.blake2b(b" ".join(words[s[0] : s[0] + s[1] + window - 1]), digest_size=16).digest() for s in spans]
                    row = {"k1": int(keys[0][i]), "k2": int(keys[1][i]), "done": None, "text": None, "p": None, "n": None, "probe": None, "probe_mh": None, "probe_wh": None, "known_mh": None, "known_wh": None}
                    row["sums"] = [{"mh": s[2], "ch": s[3], "n": s[1], "digest": d} for s, d in zip(spans, sums, strict=True)] or None
                    parts: dict[str, list] = {"probe": [], "probe_mh": [], "probe_wh": [], "known_mh": [], "known_wh": []}
                    if needs[i - at]:
                        doc = next(hashes)
                        for f in opened[i].as_py():
                            at_words = np.arange(f["p"], f["p"] + f["n"])
                            wh = runs(doc[f["p"] : f["p"] + f["n"] + window - 1], window)
                            kind = "probe" if f["c"] == 1 else "known"
                            parts[f"{kind}_mh"].append(np.full(f["n"], f["mh"], dtype=np.int64))
                            parts[f"{kind}_wh"].append(wh.view(np.int64))
                            if kind == "probe":
                                parts["probe"].append(at_words)
                    row |= {k: np.concatenate(v) for k, v in parts.items() if v}
                    if row["probe"] is None:
                        row["done"] = _result(ids[i].as_py(), words, covered(len(words), p, n, window), digest)
                    else:
                        row |= {"text": text, "p": p, "n": n, "done": {"doc_id": ids[i].as_py()}}
                    rows.append(row)
                    size += len(text)
                if size > GROUP_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, FIRST)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, FIRST)

    schema = f"k1 long, k2 long, done struct<{OUT.replace(' long', ':long').replace(' string', ':string').replace('removed array', 'removed:array')}>, text binary, p array<int>, n array<int>, probe array<int>, probe_mh array<long>, probe_wh array<long>, known_mh array<long>, known_wh array<long>, sums array<struct<mh:long,ch:long,n:int,digest:binary>>"
    first = settled(lambda: placed().select("doc_id", "text", "whole", "heads", "opened", "k1", "k2").mapInArrow(first_pass, schema), "opened")
    released(repeated, paths)
    sums = first.select(F.explode("sums").alias("s")).groupBy("s.mh", "s.ch", "s.n").agg((F.min("s.digest") != F.max("s.digest")).alias("differ"))
    if not sums.where("differ").isEmpty():  # equal hashes of different words
        if seed == 3:
            raise RuntimeError("different words have equal hashes under four seeds")
        return keyed_repeats(docs, window, kmer, digest, seed + 1)
    probes = first.where("probe is not null").select("k1", "k2", F.explode(F.arrays_zip("probe", "probe_mh", "probe_wh")).alias("w")).select("k1", "k2", F.col("w.probe").alias("p"), F.col("w.probe_mh").alias("mh"), F.col("w.probe_wh").alias("wh"))
    known = first.where("known_wh is not null").select(F.explode(F.arrays_zip("known_mh", "known_wh")).alias("w")).select(F.col("w.known_mh").alias("mh"), F.col("w.known_wh").alias("wh"), F.lit(2).alias("c"))
    twice = probes.select("mh", "wh", F.lit(1).alias("c")).unionByName(known).groupBy("mh", "wh").agg(F.sum("c").alias("c")).where("c > 1")
    found = probes.join(twice, ["mh", "wh"], "left_semi").groupBy("k1", "k2").agg(F.collect_set("p").alias("found"))
    rest = first.where("probe is not null").select("done.doc_id", "text", "p", "n", "k1", "k2").join(found, ["k1", "k2"], "left")

    def second_pass(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, p, n, k1, k2, found in zip(*batch.columns, strict=True):
                words = text.as_py().split()
                own = np.array(found.as_py() or [], dtype=np.int64)
                starts = np.concatenate([np.array(p.as_py(), dtype=np.int64), own])
                windows = np.concatenate([np.array(n.as_py(), dtype=np.int64), np.ones(len(own), dtype=np.int64)])
                rows.append(_result(doc_id.as_py(), words, covered(len(words), starts, windows, window), digest) | {"k1": k1.as_py(), "k2": k2.as_py()})
            yield pa.RecordBatch.from_pylist(rows, pa.schema(list(_KEYED_OUT)))

    rest = rest.select("doc_id", "text", "p", "n", "k1", "k2", "found").mapInArrow(second_pass, KEYED_OUT)
    return first.where("probe is null").select("done.*", "k1", "k2").unionByName(rest)


_SUMS = pa.list_(pa.struct([("mh", pa.int64()), ("ch", pa.int64()), ("n", pa.int32()), ("digest", pa.binary())]))
FIRST = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("done", _OUT), ("text", pa.binary()), ("p", pa.list_(pa.int32())), ("n", pa.list_(pa.int32())), ("probe", pa.list_(pa.int32())), *((c, pa.list_(pa.int64())) for c in ("probe_mh", "probe_wh", "known_mh", "known_wh")), ("sums", _SUMS)])


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs, digest=True).select("doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


OP4_SQL = r"""
with d as (select doc_id, row_number() over () as r, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select r, unnest(range(1, len(w) - 33)) as p, w from d where len(w) >= 35),
h as (select r, p, md5(array_to_string(w[p:p + 34], ' ')) as k from s),
twice as (select k from h group by k having count(*) > 1),
hit as (select r, p from h semi join twice using (k)),
gone as (select distinct r, unnest(range(p, p + 35)) as i from hit),
words as (select r, unnest(range(1, len(w) + 1)) as i, unnest(w) as x from d),
kept as (select r, string_agg(x, ' ' order by i) as t, count(*) as n from words anti join gone using (r, i) group by r)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (r)
"""
