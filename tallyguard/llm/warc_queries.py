"""op1: pages written to archives and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyguard.llm.frames import table
from tallyguard.llm.queries import query
from tallyguard.llm.warc import read_archives, write_archives

# Fixed value: the base32 alphabet.
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def _base32(hex_column: str) -> str:
    """Five hex digits at a time are four letters."""
    letters = [
        f"substr('{_BASE32}', ((('0x' || substr({hex_column}, {5 * part + 1}, 5))::BIGINT >> {shift}) & 31) + 1, 1)"
        for part in range(8)
        for shift in (15, 10, 5, 0)
    ]
    return " || ".join(letters)


_SQL = f"""
WITH bodies AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
hashed AS (SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha1(body) AS sha FROM bodies),
kept AS (SELECT *, max(page_id) OVER (PARTITION BY sha, payload_bytes) AS keeper FROM hashed)
SELECT page_id, payload_bytes, {_base32("sha")} AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM kept
"""


@query("op1_warc", _SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), min_bytes=0)
    return read_archives(manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
