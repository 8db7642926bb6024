from __future__ import annotations

import hashlib
import io
import struct

import pytest
import zstandard

from tropica.llm import warc

BIG, SMALL = "<p>" + "página " * 60, "<p>x</p>"


def test_archives_round_trip(spark, tmp_path):
    rows = [(5, "u5", BIG, 1), (3, "u3\r\nX: y", BIG, 1), (9, None, BIG, 1), (4, "u", SMALL, 1), (6, "u", SMALL, 1), (7, "u", None, 1), (8, "u", "", 1), (3, "u3", BIG, 1), (None, "n", BIG, 1), (10, "l", "<b>" + "é\r\n\r\n" * 300_000, 1), (11, "a", "x" * 99, 1), (12, "a", "x" * 99, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, revisit int")
    found = warc.read_archives(warc.archive_pages(pages, str(tmp_path / "w")), payloads=True).collect()
    assert len(found) == len(rows)
    texts = {i: (h or "").encode() for i, _, h, _ in rows}
    for r in found:
        payload = texts[r["page_id"]]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), hashlib.sha256(payload).hexdigest())
        assert r["record_type"] == "revisit" or r["payload"] == payload
    kinds = {(r["page_id"], r["record_type"], r["refers_to"]) for r in found}
    assert kinds == {(3, "response", None), (5, "revisit", 3), (9, "revisit", 3), (None, "revisit", 3), *((i, "response", None) for i in (4, 6, 7, 8, 10, 11, 12))}
    assert warc.read_archives(warc.archive_pages(pages.limit(0), str(tmp_path / "none"))).count() == 0


def test_file_layout():
    sink = io.BytesIO()
    writer = warc.Writer(sink)
    made = [warc.build_record(i, f"http://a/{i}", f"<p>page {i} of many alike</p>".encode() * 20, "0" * 64, None, False) for i in range(200)]
    for record in made:
        writer.add(record)
    writer.close()
    data = sink.getvalue()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == warc.MAGIC and 0x184D2A50 <= magic <= 0x184D2A5F  # a skippable frame
    assert list(warc.records(io.BytesIO(data), 1000)) == made
    one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).decompressobj()
    assert one.decompress(data[8 + size :]) == made[0]  # a record is a frame of its own
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(data[:-5])))
