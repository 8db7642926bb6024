"""Best-fit packing of documents into training sequences by the sum-of-squares rule.

Each piece goes where the sum over all gaps g of (open sequences with gap g)**2 becomes smallest, longest pieces first.
Pieces are dealt to blocks of bounded size and blocks are packed apart: a block closes with a few loose sequences, so
the loss is a few in tens of thousands, and no task or driver ever holds all lengths.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tropica.llm.common import text_or_empty, written
from tropica.llm.wordmemo import default_vocabulary, memo

CAPACITY = 2048
END_ID = 0
#: Pieces packed together; a block costs about 100 bytes of memory a piece.
BLOCK_PIECES = 50_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """The sequence (numbered from 0) and the offset of each piece, none longer than capacity.

    A new sequence opens only where nothing fits; between equal sums the smallest gap that fits is taken."""
    sequence, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    counts = np.zeros(capacity + 1, dtype=np.int64)  # open sequences by gap; a full one (gap 0) is closed
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        held = counts[size:]
        fits = np.flatnonzero(held)
        if len(fits):
            # Into gap g: the square of N(g) loses 2N(g) - 1, that of N(g - size) gains 2N(g - size) + 1.
            change = 2 * counts[fits] + 1 - (2 * held[fits] - 1)
            if fits[0] == 0:
                change[0] = 1 - 2 * held[0]  # filled up: no gap is left to count
            gap = int(fits[np.argmin(change)]) + size
            chosen = by_gap[gap].pop()
            counts[gap] -= 1
        else:
            gap, chosen, used = capacity, used, used + 1
        sequence[i], offset[i] = chosen, capacity - gap
        if gap > size:
            counts[gap - size] += 1
            by_gap[gap - size].append(chosen)
    return sequence, offset


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of a document's pieces: all of capacity ids but the first, which takes the rest."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] * bool(n) + [(start, capacity) for start in range(first, n, capacity)]


def pieces(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of each row of docs(doc_id, text), each document closed by end_id; a null text is that id alone."""
    vocabulary = vocabulary or default_vocabulary()

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.array([end_id], dtype="<u4")
        ids_of = memo(vocabulary).encode_all
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), ids_of(batch.column(1).to_pylist()), strict=True):
                ids = np.concatenate([ids, tail])
                rows += [(doc_id, k, start, n, zlib.crc32(ids[start : start + n])) for k, (start, n) in enumerate(cut(len(ids), capacity))]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty()).mapInArrow(encode, PIECES)


def pack(found: DataFrame, capacity: int = CAPACITY, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """Adds sequence_id and offset to a written table with a column length (1 to capacity).

    Pieces of full length are sequences of their own (negative numbers) and skip the packing. An empty table gives an
    empty result; rows that repeat are packed like any others; columns named like the result are replaced, others pass
    through."""
    names = found.drop("sequence_id", "offset").columns
    found = found.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), F.monotonically_increasing_id().alias("row"))
    length, columns = f"c{names.index('length')}", found.columns[:-1]
    full, short = found.where(F.col(length) >= capacity), found.where(F.col(length) < capacity)
    blocks = max(1, -(-short.count() // block_pieces))

    def one_block(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row", ignore_index=True)
        sequence, offset = sum_of_squares(rows[length].to_numpy(), capacity)
        return rows.assign(sequence_id=(rows["block"].to_numpy() << 32) + sequence, offset=offset)[[*columns, "sequence_id", "offset"]]

    schema = ", ".join(f"{n} {t}" for n, t in found.select(columns).dtypes) + ", sequence_id long, offset long"
    # By place, not by key: copies of one document spread over the blocks like all others.
    dealt = short.withColumn("block", F.pmod(F.col("row"), F.lit(blocks)))
    own = full.select(*columns, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return own.unionByName(dealt.groupBy("block").applyInPandas(one_block, schema)).toDF(*names, "sequence_id", "offset")


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(written(pieces(docs), "pieces"))
