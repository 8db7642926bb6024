"""Token counts by finite-state transduction of byte-level BPE with word ends.

The vocabulary is compiled, state by state as texts need them, into a deterministic transducer over bytes. A state
knows the longest suffix of the word so far that some token continues, and for each place in it the last token of the
encoding up to there; a transition is annotated with the number of tokens that it adds (negative where merges take
tokens back), and a state with what the word's end adds. Word starts reset the state.

Texts are cut into chunks of equal size. A chunk's state map is constant from its first word start on, and before that
a walk over its head; all chunks are run side by side. Where a word runs over several chunks, their maps are found for
all states that can reach them, each chunk on its own, and a scan composes maps of 1, 2, 4, ... chunks.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tropica.llm.common import text_or_empty
from tropica.llm.wordmemo import byte_letters, default_vocabulary, load

SPACE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)
CHUNK = 64
#: Compiled states kept by a Python worker (about 5 bytes for each byte value in use); beyond, it starts anew.
MOST_STATES = 120_000
#: Up to here Python lower-cases and normalises as the library does; texts with later characters pass through it.
PLAIN = "ɏ"
GROUP_CHARS = 2_000_000
#: Rounds in which every state that a map hands on is followed; the few maps not closed by then go on from true states.
GUESSES = 64


class Transducer:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocabulary = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(merges)}
        self.heads = {t[:n] for t in (t.removesuffix(self.end) if self.end else t for t in self.vocabulary) for n in range(len(t))}
        letters = byte_letters()
        self.letter = [letters[b] for b in range(256)]
        self.stands: dict[str, bool] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.restart()

    def restart(self) -> None:
        self.column = np.full(256, -1, dtype=np.int64)
        self.columns = 0
        self.bytes: list[int] = []
        self.to = np.full((1024, 64), -1, dtype=np.int32)
        self.adds = np.zeros((1024, 64), dtype=np.int16)
        self.ends = np.zeros(1024, dtype=np.int16)
        self.states: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.number(("", (("", 0),), 0))

    def symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end):
            body = token.removesuffix(self.end)
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def merge(self, symbols: list[str]) -> list[str]:
        while len(symbols) > 1:
            rank, at = min((self.ranks.get((a, b), 1 << 40), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)))
            if rank == 1 << 40:
                break
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        return symbols

    def is_token(self, token: str) -> bool:
        """Whether the vocabulary has it and its own characters merge into it."""
        found = self.stands.get(token)
        if found is None:
            found = self.stands[token] = token in self.vocabulary and self.merge(self.symbols(token)) == [token]
        return found

    def follows(self, before: str, token: str) -> bool:
        """Whether encodings can have the two side by side: merged together, they stay as they are."""
        if not before:
            return True
        found = self.fits.get((before, token))
        if found is None:
            found = self.fits[before, token] = self.merge(self.symbols(before) + self.symbols(token)) == [before, token]
        return found

    def number(self, state: tuple) -> int:
        found = self.numbers.get(state)
        if found is None:
            found = self.numbers[state] = len(self.states)
            self.states.append(state)
            if found >= len(self.ends):
                grow = len(self.ends)
                self.to = np.vstack([self.to, np.full((grow, self.to.shape[1]), -1, dtype=np.int32)])
                self.adds = np.vstack([self.adds, np.zeros((grow, self.adds.shape[1]), dtype=np.int16)])
                self.ends = np.concatenate([self.ends, np.zeros(grow, dtype=np.int16)])
            self.ends[found] = state[2]
        return found

    def compile(self, state: int, column: int) -> None:
        """The transition of a state on a byte. The last token of the longer word is the longest one that ends there and may follow the last token of what is before it."""
        suffix, past, _ = self.states[state]
        grown = suffix + self.letter[self.bytes[column]]
        last, count, closed = None, 0, 0
        for start in range(len(grown)):
            token = grown[start:]
            before, so_far = past[start]
            if last is None and self.is_token(token) and self.follows(before, token):
                last, count = token, so_far + 1
            if not closed and self.end and self.is_token(token + self.end) and self.follows(before, token + self.end):
                closed = so_far + 1
        if last is None:
            raise ValueError(f"no token for byte {self.bytes[column]}")
        closed = closed if self.end else count
        keep = next(n for n in range(len(grown), -1, -1) if grown[len(grown) - n :] in self.heads)
        past = (*past, (last, count))[len(past) - keep :]
        to = self.number((grown[len(grown) - keep :], tuple((t, n - count) for t, n in past), closed - count))
        self.to[state, column], self.adds[state, column] = to, count

    def encode_columns(self, data: np.ndarray) -> np.ndarray:
        new = [int(b) for b in np.flatnonzero(np.bincount(data, minlength=256)) if self.column[b] < 0]
        for b in new:
            if len(self.bytes) == self.to.shape[1]:
                self.to = np.hstack([self.to, np.full_like(self.to, -1)])
                self.adds = np.hstack([self.adds, np.zeros_like(self.adds)])
            self.column[b] = len(self.bytes)
            self.bytes.append(b)
        return self.column[data].astype(np.int16)

    def walk(self, columns: np.ndarray, starts: np.ndarray, begin: np.ndarray, length: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs all lanes side by side: lane i over columns[begin[i]:begin[i] + length[i]] from state[i]. Returns the states and the tokens counted.

        At a word start after a lane's first place the word before is closed and the state reset."""
        order = np.argsort(-length, kind="stable")
        at, length, state = begin[order], length[order], state[order].astype(np.int64)
        count = np.zeros(len(order), dtype=np.int64)
        live = len(order)
        for step in range(int(length[0]) if live else 0):
            live = int(np.searchsorted(-length, -step, side="left"))  # lanes longer than step
            now, here = state[:live], at[:live] + step
            if step:
                fresh = starts[here]
                count[:live] += np.where(fresh, self.ends[now], 0)
                now = np.where(fresh, 0, now)
            column = columns[here]
            to = self.to[now, column]
            if (missing := np.flatnonzero(to < 0)).size:
                for pair in np.unique(now[missing] * 1024 + column[missing]):
                    self.compile(int(pair >> 10), int(pair & 1023))
                to = self.to[now, column]
            count[:live] += self.adds[now, column]
            state[:live] = to
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        return state[back], count[back]

    def compose(self, columns: np.ndarray, starts: np.ndarray, begin: np.ndarray, first: np.ndarray, end: np.ndarray, state: np.ndarray, total: np.ndarray, known: np.ndarray, chained: np.ndarray) -> None:
        """Adds the heads of chained chunks, whose words began two chunks before or earlier, to total and state.

        A map is a set of entries (chunk, state before) with the state after and the tokens counted. Guesses start every
        chunk at once, and each state that a chunk may hand on becomes an entry of the next, until the maps are closed:
        walks meet soon, whatever they began with. Entries then point at entries of the next chunk, and pointers double."""
        if not chained.any():
            return
        chunks = np.flatnonzero(chained)
        chained = np.append(chained, False)
        opening = chunks[known[chunks - 1]]  # the state before is known here
        entry = lambda chunk, at: chunk << 32 | at
        true = entry(opening, state[opening - 1])
        keys = after = added = np.empty(0, dtype=np.int64)
        new, rounds = np.unique(np.concatenate([true, entry(chunks[~known[chunks - 1]], 0)])), 0
        while True:
            while len(new):
                at = new >> 32
                to, n = self.walk(columns, starts, begin[at], (first - begin)[at], new & 0xFFFFFFFF)
                n += np.where(first[at] < end[at], self.ends[to], 0)
                order = np.argsort(np.concatenate([keys, new]), kind="stable")
                keys, after, added = (np.concatenate(c)[order] for c in ((keys, new), (after, to), (added, n)))
                rounds += 1
                on = entry(at + 1, to)[chained[at + 1]]
                new = np.setdiff1d(on, keys) if rounds < GUESSES else new[:0]
            at = keys >> 32
            wanted = entry(at + 1, after)
            place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            open_, own = chained[at + 1], np.arange(len(keys))
            linked = open_ & (keys[place] == wanted)
            to, tokens = np.where(linked, place, own), np.where(linked, added, 0)
            while (to != to[to]).any():
                tokens, to = tokens + tokens[to], to[to]
            mine = np.searchsorted(keys, true)
            last = to[mine]
            new = np.unique(wanted[last][open_[last]])  # maps that did not close within the rounds: on from the true states alone
            if not len(new):
                break
        total[opening] += (tokens + added[to])[mine]
        whole = first[at[last]] == end[at[last]]
        state[at[last][whole]] = after[last][whole]

    def count(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
        """Tokens of each of several byte strings that follow one another in data; starts marks where their words begin."""
        if len(self.states) > MOST_STATES or len(self.fits) > 3 * MOST_STATES:
            self.fits.clear()
            self.restart()
        columns = self.encode_columns(data)
        ends = np.cumsum(sizes)
        per = -(-sizes // chunk)
        text = np.repeat(np.arange(len(sizes)), per)
        k = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
        begin = (ends - sizes)[text] + k * chunk
        end = np.minimum(begin + chunk, ends[text])
        if not len(text):
            return np.zeros(len(sizes), dtype=np.int64)
        marks = np.append(np.flatnonzero(starts), len(data))
        first = np.minimum(marks[np.searchsorted(marks, begin)], end)  # a chunk's first word start, or its end
        # From the first word start on, a chunk's map is constant.
        state, total = self.walk(columns, starts, first, end - first, np.zeros(len(text), dtype=np.int64))
        known = (first < end) | (k == 0)
        # Heads after a chunk whose last state is known; then words over several chunks, by composed maps.
        later = k > 0
        before = np.concatenate([[False], known[:-1]])
        ready = np.flatnonzero(later & before)
        came, added = self.walk(columns, starts, begin[ready], (first - begin)[ready], state[ready - 1])
        inner = first[ready] < end[ready]
        total[ready] += added + np.where(inner, self.ends[came], 0)
        state[ready[~inner]] = came[~inner]
        known[ready] = True
        self.compose(columns, starts, begin, first, end, state, total, known, later & ~before)
        out = np.zeros(len(sizes), dtype=np.int64)
        np.add.at(out, text, total)
        closing = np.flatnonzero(sizes > 0)
        out[closing] += self.ends[state[np.cumsum(per)[closing] - 1]]
        return out


class Counter:
    """Splits texts into words as the vocabulary's own pre-tokenizer does and counts their tokens."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.transducer = Transducer(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.full(0x110000, UNKNOWN, dtype=np.uint8)

    def normalised(self, text: str) -> str:
        return text.lower() if text.isascii() or max(text) <= PLAIN else self.tokenizer.normalizer.normalize_str(text)

    def kind_of(self, character: str) -> int:
        pieces = lambda s: len(self.tokenizer.pre_tokenizer.pre_tokenize_str(s))
        if not pieces(character):
            return SPACE
        if pieces(2 * character) == 2:
            return NUMBER
        return LETTER if pieces("a" + character) == 1 else OTHER

    def kinds(self, points: np.ndarray) -> np.ndarray:
        kinds = self.kind[points]
        if (kinds == UNKNOWN).any():
            for point in np.unique(points[kinds == UNKNOWN]):
                self.kind[point] = self.kind_of(chr(point))
            kinds = self.kind[points]
        return kinds

    def sections(self, text: str) -> tuple[str, int]:
        """The normalised text without special strings, and how many those are: each is one token and parts words."""
        if "<|" not in text or not any(s in text for s in self.special):
            return self.normalised(text), 0
        import re

        parts = re.split("|".join(map(re.escape, self.special)), text)
        return "\n".join(map(self.normalised, parts)), len(parts) - 1

    def count(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        start, size = 0, 0
        for i, text in enumerate(texts):
            size += len(text)
            if size > GROUP_CHARS or i == len(texts) - 1:
                out += self._count(texts[start : i + 1])
                start, size = i + 1, 0
        return out

    def _count(self, texts: list[str]) -> list[int]:
        found = [self.sections(t) for t in texts]
        joined = "\n".join([*(t for t, _ in found), ""])  # a line end after each text: no word reaches into the next
        points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        kinds = self.kinds(points)
        before = np.concatenate([[SPACE], kinds[:-1]])
        starts = (kinds != SPACE) & ((kinds != before) | (kinds == NUMBER))
        # 's 't 'm 'd 're 've 'll: an apostrophe that opens a run takes these letters along, and no more of the word.
        for i in np.flatnonzero((points == 39) & (before != OTHER)):
            two = joined[i + 1 : i + 3]
            taken = 1 if two[:1] in ("s", "t", "m", "d") else 2 if two in ("re", "ve", "ll") else 0
            if taken:
                starts[i + 1] = False
                starts[i + 1 + taken] = kinds[i + 1 + taken] != SPACE
        width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        data = np.frombuffer(joined.encode(), dtype=np.uint8)
        place = np.cumsum(width) - width
        kept = np.repeat(kinds != SPACE, width)
        marks = np.zeros(len(data), dtype=bool)
        marks[place[starts]] = True
        lengths = np.array([len(t) + 1 for t, _ in found])
        edges = np.append(place, len(data))[np.cumsum(lengths)]
        sizes = np.diff(np.concatenate([[0], np.cumsum(kept)[edges - 1]])) if len(edges) else np.empty(0, dtype=np.int64)
        counts = self.transducer.count(data[kept], marks[kept], sizes.astype(np.int64))
        return [int(n) + special for n, (_, special) in zip(counts, found, strict=True)]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One per Python worker: what it has compiled serves all its batches."""
    return Counter(path)


def count_tokens(docs: DataFrame, vocabulary: str | None = None, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row of docs(doc_id, text).

    A null or empty text has 0 bytes and 0 tokens; null and repeated doc_id are kept row by row; other columns are
    not read."""
    vocabulary = vocabulary or default_vocabulary("word_bpe_49k.json")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = counter(vocabulary).count(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty())
    docs = docs.withColumn("n_bytes", F.octet_length("text").cast("long"))
    return docs.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
