"""Byte-level BPE over whole texts by the tokenizers library, its results remembered per distinct word.

The pattern starts a new pre-token at every single white space between other characters, so encoding is a concatenation
over the pieces cut there. A memo of numpy arrays maps hashes of words (with the white space before them) to their ids.
Words that a worker has not met go to the library many at once, joined; the tokens that begin with white space tell
where each word's ids begin. Texts where cutting does not hold (runs of white space, special strings) go to the library
whole. Every id comes from the library.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from tropica.llm.substrings import Words, pair

#: Runs of white space and white space at an end: cutting there would change the pre-tokens.
_UNSAFE = re.compile(r"\A\s|\s(?:\s|\Z)|<\|")
#: Words remembered by a worker, some 50 bytes each; beyond, the half that was met least goes.
MEMO_WORDS = 500_000
#: Characters of text that are encoded together.
GROUP_CHARS = 800_000


def default_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places starts[i] to starts[i] + lengths[i] - 1, one after another."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


class WordMemo:
    """Sorted hashes of words; with each its first eight bytes and length (which a hit must equal too) and the place and number of its ids in one pool."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        vocabulary, spaces = self.tokenizer.get_vocab(), tuple(byte_letters()[b] for b in b" \t\n\v\f\r")
        self.begins = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith(spaces)]] = True
        self.keys, self.heads = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64)
        self.lengths, self.at, self.n, self.uses = (np.empty(0, dtype=np.int64) for _ in range(4))
        self.pool = np.empty(0, dtype="<u4")

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """The library's ids of whole texts."""
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4") for e in found]

    def forget(self) -> None:
        """Keeps the half of the words that was met most since the last time."""
        kept = np.sort(np.argsort(-self.uses, kind="stable")[: MEMO_WORDS // 2])
        self.pool = self.pool[ragged(self.at[kept], self.n[kept])]
        self.keys, self.heads, self.lengths, self.n = (x[kept] for x in (self.keys, self.heads, self.lengths, self.n))
        self.at, self.uses = np.cumsum(self.n) - self.n, np.zeros(len(kept), dtype=np.int64)

    def learn(self, words: Words, first: np.ndarray, keys: np.ndarray) -> bool:
        """Has the library encode the words at the places first, with the white space before each, all at once."""
        text = words.data[ragged(words.starts[first] - 1, words.lengths[first] + 1)].tobytes().decode()
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        edges = np.append(np.flatnonzero(self.begins[ids]), len(ids))
        if len(edges) != len(first) + 1 or edges[0]:
            return False
        place = np.searchsorted(self.keys, keys)
        new = {"keys": keys, "heads": words.heads[first], "lengths": words.lengths[first], "at": len(self.pool) + edges[:-1], "n": np.diff(edges), "uses": np.zeros(len(first), dtype=np.int64)}
        for name, values in new.items():
            setattr(self, name, np.insert(getattr(self, name), place, values))
        self.pool = np.concatenate([self.pool, ids])
        return True

    def cut(self, texts: list[str]) -> list[np.ndarray] | None:
        """The ids of texts without runs of white space, or None where words can't be told apart."""
        encoded = [text.encode() for text in texts]
        words = Words(b"\n" + b"\n".join([*encoded, b""]) + bytes(8))  # a line end before each text: its id is dropped again
        every = pair(words.hashes(), words.data[words.starts - 1].astype(np.uint64))
        keys, first, inverse = np.unique(every, return_index=True, return_inverse=True)
        if (words.heads[first][inverse] != words.heads).any() or (words.lengths[first][inverse] != words.lengths).any():
            return None
        if len(self.keys) > MEMO_WORDS:
            self.forget()

        def places() -> tuple[np.ndarray, np.ndarray]:
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            return at, self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), dtype=bool)

        at, known = places()
        if not known.all():
            if not self.learn(words, first[~known], keys[~known]):
                return None
            at, _ = places()
        if (self.heads[at] != words.heads[first]).any() or (self.lengths[at] != words.lengths[first]).any():
            return None
        self.uses[at] += 1
        counts = self.n[at][inverse]
        ids = self.pool[ragged(self.at[at][inverse], counts)]
        edges = np.searchsorted(words.starts, np.cumsum([1, *(len(t) + 1 for t in encoded)]))
        edges = np.concatenate([[0], np.cumsum(counts)])[edges].tolist()
        return [ids[a + 1 : b] for a, b in zip(edges, edges[1:], strict=False)]

    def encode_some(self, texts: list[str]) -> list[np.ndarray]:
        apart = {i for i, text in enumerate(texts) if not text or _UNSAFE.search(text)}
        rest = [text for i, text in enumerate(texts) if i not in apart]
        found = (self.cut(rest) if rest else []) if len(apart) < len(texts) else []
        found, whole = iter(self.whole(rest) if found is None else found), iter(self.whole([texts[i] for i in sorted(apart)]))
        return [next(whole if i in apart else found) for i in range(len(texts))]

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of whole texts in order, as little-endian uint32."""
        some, size = [], 0
        for text in texts:
            some.append(text)
            size += len(text)
            if size > GROUP_CHARS:
                yield from self.encode_some(some)
                some, size = [], 0
        if some:
            yield from self.encode_some(some)


@lru_cache(maxsize=2)
def memo(path: str) -> WordMemo:
    """One memo per Python worker, kept from batch to batch."""
    return WordMemo(path)
