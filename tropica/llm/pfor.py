"""Token-id files: patched frame-of-reference blocks behind a block index.

A file holds the ids of many documents back to back, cut into blocks of 4096. A block stores its minimum, the
differences to it packed at a width chosen from the percentiles of their bit lengths, and the few differences that are
wider as a list of exceptions (positions and values). The footer indexes where each block starts, so that any id range
is read from its own blocks only.

    "PFR1" | blocks | doc table | block index | 40-byte trailer
    block: u32 minimum, u8 width, u8 0, u16 exceptions, packed words u64[], positions u16[], values u32[]
    doc table: u8 valid[docs], i64 doc_id[docs], u64 tokens[docs];  block index: u64 offset[blocks + 1]
    trailer: u64 docs, u64 ids, u64 blocks, u64 offset of the doc table, "PFR1END."
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tropica.llm.common import open_fs, text_or_empty, work_dir, written
from tropica.llm.wordmemo import default_vocabulary, memo

BLOCK = 4096
LANES = BLOCK // 64
HEAD, TRAILER, MAGIC, END = struct.Struct("<IBBH"), struct.Struct("<QQQQ8s"), b"PFR1", b"PFR1END."
END_ID = 2
#: Text per file, as stored by the shuffle; more text makes more files.
MANIFEST = "shard long, path string, docs long, ids long"


def best_widths(lengths: np.ndarray) -> np.ndarray:
    """For each row of bit lengths the width with the fewest bytes: packed values at that width, 6 bytes for each wider one."""
    n = len(lengths)
    counts = np.bincount((lengths + 33 * np.arange(n)[:, None]).ravel(), minlength=33 * n).reshape(n, 33)
    wider = lengths.shape[1] - np.cumsum(counts, axis=1)
    return np.argmin(np.arange(33) * BLOCK / 8 + 6 * wider, axis=1)


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 4096 values below 2**width as width * 64 words each: value i * 64 + lane goes to the bit column of its lane."""
    rows = values.astype(np.uint64).reshape(-1, 64, LANES)
    out = np.zeros((len(rows), width + 1, LANES), dtype=np.uint64)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        out[:, word] |= rows[:, i] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= rows[:, i] >> np.uint64(64 - shift)
    return out[:, :width].reshape(len(rows), width * LANES)


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    if width == 0:
        return np.zeros((len(words), BLOCK), dtype=np.uint32)
    packed, mask = words.reshape(-1, width, LANES), np.uint64((1 << width) - 1)
    out = np.empty((len(words), 64, LANES), dtype=np.uint32)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        value = packed[:, word] >> np.uint64(shift)
        if shift + width > 64:
            value = value | (packed[:, word + 1] << np.uint64(64 - shift))
        out[:, i] = value & mask
    return out.reshape(len(words), BLOCK)


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """The blocks of ids, the last one filled up; blocks of one width are packed together."""
    n = -(-len(ids) // BLOCK)
    full = np.full(n * BLOCK, ids[-1], dtype=np.uint32)
    full[: len(ids)] = ids
    gaps = full.reshape(n, BLOCK)
    lows = gaps.min(axis=1)
    gaps -= lows[:, None]
    widths = best_widths(np.frexp(gaps.astype(np.float64))[1])
    out: list[bytes] = [b""] * n
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        part = gaps[rows]
        row, place = np.nonzero(part >> np.uint32(width)) if width < 32 else (np.empty(0, dtype=np.int64),) * 2
        values, edges = part[row, place], np.searchsorted(row, np.arange(len(rows) + 1)).tolist()
        part[row, place] = 0
        packed = pack(part, width).astype("<u8")
        for k, (at, a, b) in enumerate(zip(rows.tolist(), edges, edges[1:], strict=False)):
            out[at] = HEAD.pack(lows[at], width, 0, b - a) + packed[k].tobytes() + place[a:b].astype("<u2").tobytes() + values[a:b].astype("<u4").tobytes()
    return out


def decode_blocks(data: bytes, starts: list[int]) -> np.ndarray:
    """The ids of blocks that begin at starts in data, one block a row; the last block of a file is cut to its ids by the reader."""
    heads = [HEAD.unpack_from(data, at) for at in starts]
    widths = np.array([head[1] for head in heads])
    out = np.empty((len(starts), BLOCK), dtype=np.uint32)
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        out[rows] = unpack(np.stack([np.frombuffer(data, "<u8", width * LANES, starts[k] + HEAD.size) for k in rows.tolist()]), width)
    for row, at, (low, width, _, n) in zip(out, starts, heads, strict=True):
        if n:
            at += HEAD.size + width * LANES * 8
            row[np.frombuffer(data, "<u2", n, at)] = np.frombuffer(data, "<u4", n, at + 2 * n)
        row += np.uint32(low)
    return out


class Writer:
    """Writes one file to any binary sink; holds one block and the doc table in memory."""

    def __init__(self, sink):
        self.sink, self.at, self.pending, self.n = sink, 0, [], 0
        self.doc_ids: list[int | None] = []
        self.counts: list[int] = []
        self.starts: list[int] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, *ids: np.ndarray) -> None:
        """A document, its ids in one or more parts."""
        self.doc_ids.append(doc_id)
        self.counts.append(sum(map(len, ids)))
        self.pending += ids
        self.n += self.counts[-1]
        if self.n >= 16 * BLOCK:
            self._flush(BLOCK)

    def _flush(self, least: int) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.empty(0, dtype=np.uint32)
        whole = len(ids) if least == 1 else len(ids) // BLOCK * BLOCK
        for data in encode_blocks(ids[:whole]) if whole else ():
            self.starts.append(self.at)
            self._put(data)
        rest = ids[whole:].copy()
        self.pending, self.n = [rest] * bool(len(rest)), len(rest)

    def close(self) -> tuple[int, int]:
        """Documents and ids written."""
        self._flush(1)
        table, total = self.at, sum(self.counts)
        valid = np.array([d is not None for d in self.doc_ids], dtype="u1")
        self._put(valid.tobytes() + np.array([d or 0 for d in self.doc_ids], dtype="<i8").tobytes() + np.array(self.counts, dtype="<u8").tobytes())
        self._put(np.array([*self.starts, table], dtype="<u8").tobytes())
        self._put(TRAILER.pack(len(self.doc_ids), total, len(self.starts), table, END))
        return len(self.doc_ids), total


class Reader:
    """Random access to one file: source needs seek(), read() and size()."""

    def __init__(self, source):
        self.source = source
        source.seek(source.size() - TRAILER.size)
        self.docs, self.ids, blocks, table, end = TRAILER.unpack(source.read(TRAILER.size))
        if end != END:
            raise ValueError("not a token-id file, or cut short")
        source.seek(table)
        data = source.read(self.docs * 17 + 8 * (blocks + 1))
        self.valid = np.frombuffer(data, "u1", self.docs)
        self.doc_ids = np.frombuffer(data, "<i8", self.docs, self.docs)
        self.counts = np.frombuffer(data, "<u8", self.docs, 9 * self.docs).astype(np.int64)
        self.starts = np.frombuffer(data, "<u8", blocks + 1, 17 * self.docs).astype(np.int64)
        self.ends = np.cumsum(self.counts)

    def blocks(self, first: int, end: int) -> np.ndarray:
        """The ids of the blocks first to end - 1."""
        at = int(self.starts[first])
        self.source.seek(at)
        data = self.source.read(int(self.starts[end]) - at)
        return decode_blocks(data, (self.starts[first:end] - at).tolist()).ravel()[: self.ids - first * BLOCK]

    def range(self, start: int, end: int) -> np.ndarray:
        """The ids at places start to end, from their own blocks alone."""
        if start >= end:
            return np.empty(0, dtype=np.uint32)
        first = start // BLOCK
        return self.blocks(first, (end - 1) // BLOCK + 1)[start - first * BLOCK : end - first * BLOCK]

    def documents(self, together: int = 32) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, start in this file and ids of each document; each block is read once, several at a time."""
        held, first, done, n = np.empty(0, dtype=np.uint32), 0, 0, len(self.starts) - 1
        for valid, doc_id, count, end in zip(self.valid.tolist(), self.doc_ids.tolist(), self.counts.tolist(), self.ends.tolist(), strict=True):
            start = end - count
            if first + len(held) < end:
                parts, first = [held[start - first :]], start
                while sum(map(len, parts)) < count:
                    upto = min(n, done + together)
                    parts.append(self.blocks(done, upto))
                    done = upto
                held = np.concatenate(parts)
            yield doc_id if valid else None, start, held[start - first : end - first]


def write_ids(docs: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = END_ID, files: int | None = None) -> DataFrame:
    """Encodes docs(doc_id, text) into token-id files below folder and returns their manifest (shard, path, docs, ids).

    Documents are dealt to files by ranges of doc_id and sorted in each, so files in shard order hold ascending
    doc_id; equal doc_id are ordered by a hash of their texts, so that an id (or null) of many rows spreads over files
    too. Null doc_id come first, null texts are empty (the end id alone), an empty table gives no files; further columns
    are not read. A file is written under a name of its own attempt and listed only when its task has ended, so repeated
    tasks leave no doubt which file counts."""
    vocabulary = vocabulary or default_vocabulary()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty())
    docs = docs.withColumn("h", F.xxhash64("text"))
    docs = docs.repartitionByRange(files, "doc_id", "h") if files else docs.repartitionByRange("doc_id", "h")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encode, tail = TaskContext.get(), memo(vocabulary).encode_all, np.array([end_id], dtype="<u4")
        writer = sink = None
        path = f"{folder}/ids-{task.partitionId():06d}-{task.taskAttemptId()}.pfor"
        for batch in batches:
            if writer is None and batch.num_rows:
                store, inner = open_fs(path)
                store.create_dir(inner.rpartition("/")[0], recursive=True)
                writer = Writer(sink := store.open_output_stream(inner))
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                writer.add(doc_id, ids, tail)
        if writer:
            n, ids = writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"shard": [task.partitionId()], "path": [path], "docs": [n], "ids": [ids]})

    return written(docs.sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text").mapInArrow(write, MANIFEST), "manifest")


def read_ids(manifest: DataFrame) -> DataFrame:
    """The documents in the files of a manifest: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    # One row per file: the running sum over files is small however large the corpus is.
    before = F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("path", before.alias("base"))
    n = max(1, manifest.count())

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, inner = open_fs(path)
                rows: list[tuple] = []
                with store.open_input_file(inner) as source:
                    for doc_id, start, ids in Reader(source).documents():
                        rows.append((doc_id, base + start, len(ids), zlib.crc32(ids.astype("<u4", copy=False))))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.repartition(n, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_ids(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return read_ids(write_ids(docs, work_dir(spark, "token-ids")))
