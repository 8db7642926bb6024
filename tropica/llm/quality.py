"""Document quality: random-indexing word vectors, pooled per document, under a two-layer network.

Words fall into hashed buckets. A bucket has a fixed sparse random index vector; its word vector adds the index vectors
of the words that stood next to it in the labelled sample. Word shapes (case, digits, punctuation, length, repetition
of the word before) are indexed alike. A document is the mean of its vectors; a network of numpy matrices scores it,
and a temperature fitted on rows apart makes the scores probabilities.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tropica.llm.common import text_or_empty, written
from tropica.llm.substrings import _SPACES, _groups, word_hashes

BUCKETS, WORD_DIMS, SHAPES, SHAPE_DIMS, NONZERO = 1 << 14, 32, 2048, 48, 6
#: Labelled rows that the classifier is fitted on at most: those with the smallest hash of doc_id.
TRAINING_ROWS = 20_000
CUTOFF = 0.7
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 25, 128, 3e-3, 1e-4


def index_vectors(rows: int, dims: int, seed: int) -> np.ndarray:
    """Sparse random vectors: NONZERO entries of +-1, scaled to length one."""
    draw = np.random.default_rng(seed)
    out = np.zeros((rows, dims), dtype=np.float32)
    places = draw.random((rows, dims)).argpartition(NONZERO, axis=1)[:, :NONZERO]
    np.put_along_axis(out, places, draw.choice([-1.0, 1.0], (rows, NONZERO)).astype(np.float32), axis=1)
    return out / np.float32(np.sqrt(NONZERO))


_KIND = np.zeros(256, dtype=np.uint8)  # 0 lower case and letters beyond ASCII, 1 upper case, 2 digit, 3 other
_KIND[65:91], _KIND[48:58] = 1, 2
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 3


def words_and_shapes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and shape of every word of all texts in one row, and the number of words of each text."""
    hashes, sizes = word_hashes(texts)
    if not len(hashes):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), sizes
    buckets = (hashes % np.uint64(BUCKETS)).astype(np.int64)
    data = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    inside = ~_SPACES[data]
    kept = _KIND[data[inside]]
    starts = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]]))
    firsts = (np.cumsum(inside) - 1)[starts]
    lengths = np.diff(np.append(firsts, len(kept)))
    upper, digit, other = (np.minimum(np.add.reduceat((kept == k).astype(np.int32), firsts), 3) for k in (1, 2, 3))
    same = np.concatenate([[False], buckets[1:] == buckets[:-1]])
    code = upper + 4 * np.minimum(digit, 1) + 8 * other + 32 * (kept[firsts] == 1) + 64 * np.minimum(lengths // 4, 3) + 256 * same + 512 * (lengths == other)
    return buckets, code.astype(np.int64), sizes


def pooled(vectors: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The mean of each text's vectors; zero without words."""
    out = np.zeros((len(sizes), vectors.shape[1]))
    full = np.flatnonzero(sizes)
    if len(full):
        out[full] = np.add.reduceat(vectors, (np.cumsum(sizes) - sizes)[full], axis=0) / sizes[full, None]
    return out


def features(texts: list[bytes], word_vectors: np.ndarray, shape_vectors: np.ndarray) -> np.ndarray:
    buckets, shapes, sizes = words_and_shapes(texts)
    return np.hstack([pooled(word_vectors[buckets], sizes), pooled(shape_vectors[shapes], sizes), np.log1p(sizes)[:, None]])


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
    """Adam on the log loss; a fifth of the rows stays apart and sets the temperature."""
    draw = np.random.default_rng(seed)
    order = draw.permutation(len(y))
    apart, rows = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[rows].mean(axis=0), x[rows].std(axis=0) + 1e-6
    net = Network(mean, scale, draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), 0.0)
    z = (x - mean) / scale
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    moment, square, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        draw.shuffle(rows)
        for at in range(0, len(rows), BATCH):
            part = rows[at : at + BATCH]
            hidden = np.tanh(z[part] @ params[0] + params[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3][0], -30, 30))) - y[part]) / len(part)
            back = np.outer(error, params[2]) * (1 - hidden**2)
            slopes = [z[part].T @ back + DECAY * params[0], back.sum(axis=0), hidden.T @ error + DECAY * params[2], np.array([error.sum()])]
            step += 1
            for p, m, s, g in zip(params, moment, square, slopes, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = *params[:3], float(params[3][0])
    if len(apart):
        logits, truth = net.logits(x[apart]), y[apart]
        loss = lambda t: np.mean(np.logaddexp(0, logits / t) - truth * logits / t)
        net.temperature = float(min(np.geomspace(0.25, 8, 200), key=loss))
    return net


@dataclass
class Model:
    words: np.ndarray
    shapes: np.ndarray
    network: Network | None
    constant: float = 1.0

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.constant)
        return self.network.score(features(texts, self.words, self.shapes))


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAINING_ROWS) -> Model:
    """Fits on labelled rows of docs(doc_id, text) that are not held out, at most `most` of them.

    With labels of one kind only every score is that label; without labels it is 1, as nothing speaks against a
    document. Of several labels of a document the smallest counts, of several texts that with the least hash; null labels and
    labels without text are left out."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min(label).cast("double").alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # rows of two numbers: `most` bounds what is sent
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(known), "doc_id")
    # One text for each label, the one of the least hash: a doc_id of many rows does not grow the sample.
    sample = sample.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    sample = written(sample.repartition(8, "doc_id"), "sample")
    word_index, shape_index = index_vectors(BUCKETS, WORD_DIMS, 1), index_vectors(SHAPES, SHAPE_DIMS, 2)

    def contexts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BUCKETS, WORD_DIMS), dtype=np.float64)
        for batch in batches:
            for _, texts in _groups(batch, 0):
                buckets, _, sizes = words_and_shapes(texts)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                for gap in (1, 2):
                    near = doc[gap:] == doc[:-gap]
                    a, b = buckets[:-gap][near], buckets[gap:][near]
                    for here, there in ((a, b), (b, a)):
                        order = np.argsort(here, kind="stable")
                        own, first = np.unique(here[order], return_index=True)
                        if len(own):
                            total[own] += np.add.reduceat(word_index[there[order]], first, axis=0)
        yield pa.RecordBatch.from_pydict({"total": [total.tobytes()]})

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BUCKETS, WORD_DIMS))
        for batch in batches:
            for part in batch.column(0):
                total += np.frombuffer(part.as_buffer()).reshape(total.shape)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        yield pa.RecordBatch.from_pydict({"words": [(word_index + total / np.maximum(length, 1e-9)).astype(np.float32).tobytes()]})

    # At most 8 matrices of fixed size meet in one task, and one comes to the driver.
    parts = sample.select("text").mapInArrow(contexts, "total binary").repartition(1).mapInArrow(gather, "words binary")
    words = np.frombuffer(parts.collect()[0]["words"], dtype=np.float32).reshape(BUCKETS, WORD_DIMS)

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _groups(batch, 2):
                found = features(texts, words, shape_index).astype(np.float32)
                rows = slice(at, at + len(texts))
                yield pa.RecordBatch.from_arrays([batch.column(0)[rows], batch.column(1)[rows], pa.array([f.tobytes() for f in found], pa.binary())], names=["doc_id", "y", "f"])

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches, schema=pa.schema([("doc_id", pa.int64()), ("y", pa.float64()), ("f", pa.binary())])).sort_by([("doc_id", "ascending"), ("y", "ascending")])
        y = rows["y"].to_numpy()
        found = float(y[0]) if len(y) else 1.0
        if len(set(y.tolist())) > 1:
            found = fit(np.frombuffer(b"".join(rows["f"].to_pylist()), dtype=np.float32).reshape(len(y), -1).astype(np.float64), y)
        yield pa.RecordBatch.from_pydict({"found": [pickle.dumps(found)]})

    # `most` rows of fixed size at most: fitted in one task, so that the driver holds the network alone.
    fitted = sample.select("doc_id", "y", "text").mapInArrow(describe, "doc_id long, y double, f binary").repartition(1).mapInArrow(learn, "found binary")
    found = pickle.loads(bytes(fitted.collect()[0]["found"]))
    return Model(words, shape_index, found) if isinstance(found, Network) else Model(words, shape_index, None, found)


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with a score between 0 and 1 for every row's whole text; null and empty texts score as no words.

    All columns pass through; one named like the score is replaced."""
    docs = docs.drop(column)
    names = docs.columns
    carried = docs.select("*", F.coalesce(F.col("text"), F.lit("")))  # found by its place, whatever names there are
    sent = docs.sparkSession.sparkContext.broadcast(model)  # some MB, whatever the corpus

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.score(texts) for _, texts in _groups(batch, len(names))]
            scores = np.concatenate(found) if found else np.empty(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(scores, pa.float64())], names=[*names, column])

    return carried.mapInArrow(run, docs.withColumn(column, F.lit(0.0)).schema)


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    found = score(docs, train(docs, labels))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
