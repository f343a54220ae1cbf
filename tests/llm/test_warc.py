import hashlib
import os

import pytest
import zstandard

from tessera.llm import warc

LONG = "<p>" + "é" * 200


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], "page_id long, url string, html string, digest string, frame int")


def test_equals_definition(spark):
    rows = [(3, "http://a/x y\r\n", LONG), (2, None, LONG), (9, "http://b", LONG), (4, "http://c", None), (5, "http://d", ""), (6, "u", "short"), (1, "u", "short"), (7, "u", "x" * 100), (8, "u", "x" * 100), (10, "u", "y" * 99), (11, "u", "y" * 99), (12, "u", "z" * 300_000)]
    got = {r["page_id"]: tuple(r)[1:] for r in warc.archive_pages(pages(spark, rows)).collect()}
    first = {}
    for i, _, h in sorted(rows):
        first.setdefault((h or "").encode(), i)
    for i, _, h in rows:
        raw = (h or "").encode()
        revisit = len(raw) >= 100 and first[raw] != i
        assert got[i] == (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first[raw] if revisit else None)


def test_repeated_and_null_ids(spark):
    got = [tuple(r) for r in warc.archive_pages(pages(spark, [(1, "u", LONG), (1, "u", LONG), (None, "u", LONG)])).collect()]
    assert sorted((r[0] or 0, r[3], r[4]) for r in got) == [(0, "revisit", 1), (1, "response", None), (1, "response", None)]
    assert [r["record_type"] for r in warc.archive_pages(pages(spark, [(None, "u", LONG), (None, "v", LONG)])).collect()] == ["response"] * 2


def test_empty_table(spark):
    assert warc.archive_pages(pages(spark, [(1, "u", "h")]).limit(0)).count() == 0


def test_frames_decompress_alone_and_in_row(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 700)
    made, records = warc.Bundler(), []
    for i in range(12):
        records.append(warc.warc_record(i, f"http://h/{i}", str(i).encode() * 150, "d", None))
        made.add(i, records[-1])
    b = made.bundle()
    reader = warc.BundleReader(b["bytes"])
    assert len(reader.places) > 3
    for r in reversed(b["records"]):
        assert reader.record(r["frame"], r["offset"], r["length"]) == records[r["page_id"]]
    assert zstandard.ZstdDecompressor().stream_reader(b["bytes"], read_across_frames=True).read() == b"".join(records)
    with pytest.raises(ValueError):
        warc.BundleReader(b["bytes"][:-1] + b"\0")


def test_export(spark, tmp_path):
    path = str(tmp_path / "archive")
    warc.write_archive(pages(spark, [(1, "http://a", LONG), (2, "http://b", LONG)]), path)
    n = warc.export(spark.read.parquet(path), str(tmp_path / "files"))
    names = os.listdir(tmp_path / "files")
    assert n == len(names) >= 1
    whole = b"".join(zstandard.ZstdDecompressor().stream_reader((tmp_path / "files" / x).read_bytes(), read_across_frames=True).read() for x in names)
    assert whole.count(b"WARC/1.1\r\n") == 2 and b"WARC-Type: revisit" in whole
