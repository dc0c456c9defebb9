import base64
import hashlib

import pytest
import zstandard

from tallyguard.llm.warc import DICTIONARY_MAGIC, WarcParams, build_dictionary, format_record, parse_record, read_archive, read_archives, write_archives

SCHEMA = "page_id long, url string, html string, payload binary, keeper string, sha int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, None, "k", 1) for i, u, h in rows], SCHEMA).select("page_id", "url", "html")


def expected(rows):
    bodies = [(i, (h or "").encode()) for i, _, h in rows]
    out = []
    for i, body in bodies:
        same = [j for j, b in bodies if b == body]
        keeper = max((j for j in same if j is not None), default=None)
        revisit = len(same) > 1 and keeper is not None and i != keeper
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((i, len(body), digest, "revisit" if revisit else "response", keeper if revisit else None))
    return sorted(out, key=str)


ROWS = [
    (1, "http://a/", "<p>x</p>"),
    (2, None, "<p>x</p>"),
    (9, "http://a b/\r\nWARC-Type: evil%", "<p>x</p>"),
    (3, "http://b", None),
    (4, "http://c", ""),
    (5, "http://d", "é" * 70_000),
    (None, "http://e", "alone"),
    (None, "http://e", "<p>x</p>"),
    (6, "http://f", "twice"),
    (6, "http://f", "twice"),
    (7, "http://g", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"),
]


def test_round_trip(spark):
    manifest = write_archives(pages(spark, ROWS))
    found = read_archives(manifest).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=str) == expected(ROWS)
    urls = {r.page_id: r.url for r in found}
    assert urls[9] == ROWS[2][1] and urls[2] is None
    assert {r.page_id: r.payload for r in found}[7] == ROWS[-1][2].encode()
    assert manifest.groupBy().sum("records").first()[0] == len(ROWS)


def test_many_archives_and_no_rows(spark):
    rows = [(i, f"http://x/{i}", f"<p>page {i % 40} of the site with words in common</p>" * 20) for i in range(300)]
    manifest = write_archives(pages(spark, rows), params=WarcParams(archive_bytes=20_000, sample_records=20))
    assert manifest.count() > 3
    found = read_archives(manifest, payloads=False).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=str) == expected(rows)
    assert read_archives(write_archives(pages(spark, []))).count() == 0


def test_format(spark):
    path = write_archives(pages(spark, [(i, "http://x", f"<p>{i} and the same words</p>" * 9) for i in range(40)]).coalesce(1)).first()["path"]
    data = open(path.removeprefix("file://"), "rb").read()
    assert int.from_bytes(data[:4], "little") == DICTIONARY_MAGIC
    size = int.from_bytes(data[4:8], "little")
    frames = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    first = frames.decompressobj()
    record = first.decompress(data[8 + size :])
    # The first frame is one whole record.
    assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and record.count(b"WARC-Type") == 1
    assert first.unused_data
    # Every frame can be read by itself, with nothing but the dictionary at the start.
    rest, texts = data[8 + size :], []
    while rest:
        one = frames.decompressobj()
        texts.append(one.decompress(rest))
        rest = one.unused_data
    assert len(texts) == len(list(read_archive(path))) and all(t.startswith(b"WARC/1.1\r\n") and t.count(b"WARC-Type") == 1 for t in texts)


def test_manifest_and_dictionary_gain(spark):
    rows = [(i, f"http://x/{i}", f"<p>page {i} of the site with many words in common</p>" * 3) for i in range(200)]
    manifest = write_archives(pages(spark, rows).coalesce(1)).collect()
    sizes = [len(open(r["path"].removeprefix("file://"), "rb").read()) for r in manifest]
    assert sizes == [r["bytes"] for r in manifest]
    records = [format_record(i, url, html.encode(), "D", None, False, "d") for i, url, html in rows]
    assert sum(sizes) < sum(len(zstandard.ZstdCompressor(level=3).compress(r)) for r in records)


def test_small_sample_and_damage():
    assert build_dictionary([b"abc"], 2) == b"bc" and build_dictionary([], 10) == b""
    record = format_record(1, "u", b"payload", "WRONG", None, False, "d")
    head, _, block = record.partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    with pytest.raises(ValueError):
        parse_record(headers, block[:-4])
