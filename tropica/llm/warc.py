"""WARC archives of individually compressed records over a dictionary built from the archived records.

An archive opens with a skippable Zstandard frame (magic 0x184D2A5D) that holds the dictionary; each record follows as
a frame of its own, so a record is read from its offset with the dictionary alone. Pages whose payload was archived
already are written as revisit records that refer to the response.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tropica.llm.common import open_fs, work_dir, written

MAGIC = 0x184D2A5D
LEAST_REVISIT = 100
#: Records held back to build a file's dictionary, in bytes of payload; the dictionary itself is at most DICTIONARY.
TRAINING, DICTIONARY, LEVEL = 4_000_000, 65_536, 3
MANIFEST = "file int, path string, records long"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary trained on samples; the newest bytes themselves where there are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


class Writer:
    """Streams records to a binary sink; holds TRAINING bytes of records until the dictionary is built."""

    def __init__(self, sink):
        self.sink, self.held, self.size, self.compress, self.records = sink, [], 0, None, 0

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.compress:
            self.sink.write(self.compress(record))
            return
        self.held.append(record)
        self.size += len(record)
        if self.size > TRAINING:
            self._open()

    def _open(self) -> None:
        import zstandard

        trained = dictionary(self.held)
        self.sink.write(struct.pack("<II", MAGIC, len(trained)) + trained)
        self.compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(trained), write_checksum=True).compress
        for record in self.held:
            self.sink.write(self.compress(record))
        self.held = []

    def close(self) -> int:
        if not self.compress:
            self._open()
        return self.records


def records(source, piece: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, one frame after another, holding one record and one piece of the file."""
    import zstandard

    magic, size = struct.unpack("<II", source.read(8))
    if magic != MAGIC:
        raise ValueError("no dictionary frame at the start of the archive")
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(source.read(size)))
    frame, parts, rest, inside = decompressor.decompressobj(), [], b"", False
    while data := rest or source.read(piece):
        parts.append(frame.decompress(data))
        rest, inside = b"", not frame.eof
        if frame.eof:
            yield b"".join(parts)
            rest, frame, parts = frame.unused_data, decompressor.decompressobj(), []
    if inside:
        raise ValueError("archive ends inside a record")


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    if url:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    if len(rest) != size + 4:
        raise ValueError("record length doesn't match its header")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    page = lambda field: int(x) if (x := fields.get(field, "")[10:-1]) else None
    return {
        "page_id": page("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "refers_to": page("WARC-Refers-To"), "payload": payload,
        "payload_bytes": int(http.rpartition(b"Content-Length: ")[2]), "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"),
    }


def plan_records(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """pages(page_id, url, html) with payload_digest, revisit and refers_to; null html is an empty payload."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("payload_digest", F.sha2(F.encode("html", "UTF-8"), 256))
    large = F.octet_length("html") >= least
    # One row for each payload that repeats: pre-aggregated, so that copies by the thousand meet as counts.
    first = pages.where(large).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("c")).where("c > 1").drop("c")
    found = pages.join(first, "payload_digest", "left")
    revisit = large & F.col("first_id").isNotNull() & F.coalesce(F.col("page_id") != F.col("first_id"), F.lit(True))
    return found.withColumn("revisit", revisit).withColumn("refers_to", F.when(F.col("revisit"), F.col("first_id"))).drop("first_id")


def write_archives(planned: DataFrame, folder: str) -> DataFrame:
    """One archive for each partition of planned, below folder; returns their manifest (file, path, records).

    A file is named after its attempt and listed only when its task has ended."""

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        path = f"{folder}/pages-{task.partitionId():06d}-{task.taskAttemptId()}.warc.zst"
        writer = sink = None
        for batch in batches:
            for page_id, url, html, digest, revisit, refers_to in zip(*batch.columns, strict=True):
                if writer is None:
                    store, inner = open_fs(path)
                    store.create_dir(inner.rpartition("/")[0], recursive=True)
                    writer = Writer(sink := store.open_output_stream(inner))
                writer.add(build_record(page_id.as_py(), url.as_py(), html.as_py(), digest.as_py(), refers_to.as_py(), revisit.as_py()))
        if writer:
            n = writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"file": pa.array([task.partitionId()], pa.int32()), "path": [path], "records": [n]})

    columns = planned.select("page_id", "url", F.encode("html", "UTF-8").alias("html"), "payload_digest", "revisit", "refers_to")
    return written(columns.mapInArrow(write, MANIFEST), "manifest")


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the archives in a manifest; the payload too (null in revisits), if asked for.

    Digest and length of a response are checked against its payload."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    arrow = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, inner = open_fs(path)
                rows: list[dict] = []
                size = 0
                with store.open_input_stream(inner) as source:
                    for record in records(source):
                        row = parse_record(record)
                        payload = row["payload"]
                        if row["record_type"] == "response" and (len(payload) != row["payload_bytes"] or hashlib.sha256(payload).hexdigest() != row["payload_digest"]):
                            raise ValueError(f"payload of page {row['page_id']} is damaged")
                        if not payloads or row["record_type"] == "revisit":
                            row["payload"] = None
                        rows.append({n: row[n] for n in names})
                        size += len(row["payload"] or b"")
                        if len(rows) == 10_000 or size > 8_000_000:
                            yield pa.RecordBatch.from_pylist(rows, arrow)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    found = manifest.select("path").repartition(max(1, manifest.count()), "path").mapInArrow(read, schema)
    return found if payloads else found.drop("payload")


def archive_pages(pages: DataFrame, folder: str) -> DataFrame:
    """Writes every row of pages(page_id, url, html) to archives below folder; returns their manifest.

    Of payloads of at least 100 bytes that are equal, the one with the smallest page_id is a response and the others
    revisit it; smaller ones are all responses. Null html is an empty payload. Null page_id are written without a
    number and only revisit; where all copies lack one, all are responses. Rows that repeat a page_id keep the same
    kind."""
    return write_archives(plan_records(pages), folder)


def op8_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return read_archives(archive_pages(pages, work_dir(spark, "warc"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as d from pages),
f as (select d, min(page_id) as first_id from p where n >= 100 group by d)
select page_id, n::bigint as payload_bytes, p.d as payload_digest,
  case when n >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
  case when n >= 100 and page_id <> first_id then first_id end as refers_to
from p left join f on p.d = f.d
"""
