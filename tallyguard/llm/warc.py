"""WARC archives in .warc.zst form: every record is a Zstandard frame of its own, compressed with a
dictionary that was built from the archive's first records and stands in a leading skippable frame.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyguard.llm.frames import arrow_map, stored
from tallyguard.session import fresh_path

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "path string, records long, bytes long"
_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


@dataclass(frozen=True)
class WarcParams:
    """``archive_bytes`` of records (before compression) close an archive. The dictionary is built
    from its first ``sample_records`` records, ``sample_bytes`` at most; all records are written."""

    archive_bytes: int = 64 << 20
    dictionary_bytes: int = 64 << 10
    sample_records: int = 400
    sample_bytes: int = 4 << 20
    level: int = 3
    date: str = "1970-01-01T00:00:00Z"


def payload_of(html: str | None) -> bytes:
    return (html or "").encode()


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _page_id(record_id: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", record_id or "")
    return int(found[1]) if found else None


def format_record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool, date: str) -> bytes:
    """One WARC record; a revisit holds the HTTP head only, which keeps the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(sample: list[bytes], size: int) -> bytes:
    """A trained dictionary; where the sample is too small for training, its own bytes serve as one."""
    if len(sample) >= 16:
        try:
            return zstandard.train_dictionary(size, sample, level=3).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(sample)[-size:]


class ArchiveWriter:
    """Writes one archive; the first records are held back until the dictionary is built."""

    def __init__(self, folder: str, name: str, params: WarcParams):
        self.path, self.params = f"{folder.rstrip('/')}/{name}", params
        self.store, self.key = fs.FileSystem.from_uri(self.path)
        self.held: list[bytes] | None = []
        self.records = self.size = self.written = 0
        self.out = self.frames = None

    def add(self, record: bytes) -> None:
        self.records += 1
        self.size += len(record)
        if self.held is None:
            self._put(self.frames.compress(record))
            return
        self.held.append(record)
        if len(self.held) >= self.params.sample_records or self.size >= self.params.sample_bytes:
            self._start()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.written += len(data)

    def _start(self) -> None:
        dictionary = build_dictionary(self.held, self.params.dictionary_bytes)
        self.out = self.store.open_output_stream(self.key, compression=None)
        self._put(DICTIONARY_MAGIC.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary)
        self.frames = zstandard.ZstdCompressor(level=self.params.level, dict_data=_dictionary(dictionary))
        held, self.held = self.held, None
        for record in held:
            self._put(self.frames.compress(record))

    def close(self) -> tuple[str, int, int]:
        if self.held is not None:
            self._start()
        self.out.close()
        return self.path, self.records, self.written


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if len(data) >= 8 else None


def read_archive(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, streamed: one record is in memory at a time."""
    store, key = fs.FileSystem.from_uri(path)
    with store.open_input_stream(key, compression=None) as source:
        if int.from_bytes(source.read(4), "little") != DICTIONARY_MAGIC:
            raise ValueError(f"no dictionary frame at the start of {path}")
        dictionary = source.read(int.from_bytes(source.read(4), "little"))
        frames = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
        records = io.BufferedReader(frames.stream_reader(source, read_across_frames=True), 1 << 16)
        while line := records.readline():
            if not line.startswith(b"WARC/"):
                raise ValueError(f"not a WARC record in {path}: {line[:40]!r}")
            headers = {}
            while (line := records.readline()) not in (b"\r\n", b""):
                name, _, value = line.decode().partition(":")
                headers[name] = value.strip()
            block = records.read(int(headers["Content-Length"]))
            if records.read(4) != b"\r\n\r\n":
                raise ValueError(f"cut record in {path}")
            yield headers, block


def parse_record(headers: dict[str, str], block: bytes) -> tuple:
    """The columns of a record; a response's payload must have the digest that the header gives."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
    if kind == "response" and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError(f"payload of {headers['WARC-Record-ID']} is not what was archived")
    url = headers.get("WARC-Target-URI")
    if url is not None:
        url = re.sub(r"%([01][0-9A-F]|7F|25)", lambda m: chr(int(m[1], 16)), url)
    return _page_id(headers["WARC-Record-ID"]), url, size, digest, kind, _page_id(headers.get("WARC-Refers-To")), payload if kind == "response" else None


def with_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id``, ``url``, ``html`` with keeper: the largest page_id of the records with the same
    payload, null for a payload of its own. Payloads are grouped by digest and length; the groups
    of more than one record are what is joined back, and a hot one is a skewed join, not a window."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(body).alias("sha"), F.octet_length(body).alias("size")
    )
    groups = (
        keyed.groupBy("sha", "size")
        .agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
        .filter((F.col("n") > 1) & (F.col("size") >= min_bytes))
        .select("sha", "size", "keeper")
    )
    return keyed.join(groups, ["sha", "size"], "left").select("page_id", "url", "html", "keeper")


def write_archives(pages: DataFrame, folder: str | None = None, params: WarcParams | None = None, min_bytes: int = 0) -> DataFrame:
    """Archive every row; returns the manifest (path, records, bytes), one row per archive.

    Rows whose id is the keeper's, or that have no equal, are responses; the others revisit the
    keeper. Null and empty html are empty payloads and count as equal. Equal rows that repeat the
    keeper's id are responses each. Null ids never win over others; urls may be null. No rows: no
    archive. A task that runs again writes new names, and only the manifest's archives count.
    """
    params = params or WarcParams()
    folder = folder or fresh_path(pages.sparkSession, "warc")
    fs.FileSystem.from_uri(folder)[0].create_dir(fs.FileSystem.from_uri(folder)[1], recursive=True)

    def write(batches):
        attempt, done, writer = uuid.uuid4().hex, [], None
        for batch in batches:
            for page_id, url, html, keeper in zip(*(c.to_pylist() for c in batch.columns)):
                if writer is None:
                    writer = ArchiveWriter(folder, f"pages-{attempt}-{len(done):05d}.warc.zst", params)
                payload = payload_of(html)
                revisit = keeper is not None and keeper != page_id
                writer.add(format_record(page_id, url, payload, digest_of(payload), keeper, revisit, params.date))
                if writer.size >= params.archive_bytes:
                    done.append(writer.close())
                    writer = None
        if writer is not None:
            done.append(writer.close())
        yield {"path": [d[0] for d in done], "records": [d[1] for d in done], "bytes": [d[2] for d in done]}

    return stored(arrow_map(with_revisits(pages, min_bytes), _MANIFEST, write), "warc-manifest")


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record of the listed archives; ``payload`` is null for revisits."""
    n = max(1, manifest.count())

    def read(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                for headers, block in read_archive(path):
                    row = parse_record(headers, block)
                    rows.append(row if payloads else (*row[:-1], None))
                    size += len(block) if payloads else 100
                    if size > 4 << 20:
                        yield _by_column(rows)
                        rows, size = [], 0
                yield _by_column(rows)

    return arrow_map(manifest.select("path").repartition(n), _RECORD, read)


def _by_column(rows: list[tuple]) -> dict[str, list]:
    return {part.split()[0]: [r[i] for r in rows] for i, part in enumerate(_RECORD.split(", "))}
