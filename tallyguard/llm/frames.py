"""Helpers shared by the operators: tables, Arrow mapping, words and shingles."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tallyguard.session import fresh_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
# The code points that part words and edge a line, \x09-\x0D and \x20.
SPACES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """``df`` written once to the shared folder and read again: later steps never run it twice,
    and a lost executor costs nothing that was written."""
    path = fresh_path(df.sparkSession, label)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Hands memory that this process has freed back to the machine, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def small(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, for functions that hold a batch as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def arrow_map(
    df: DataFrame,
    schema: str,
    fn: Callable[..., Iterable[dict[str, list | np.ndarray | pa.Array]]],
    *prepared: Callable[[], object],
) -> DataFrame:
    """``fn(batches, *made)`` over each partition; it yields columns by name.

    ``prepared`` are called once per task, so that automata and models are built in the worker. Workers
    serve many tasks: what a task has freed goes back to the machine when it ends.
    """
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for out in fn(batches, *(make() for make in prepared)):
                arrays = [
                    out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], type=f.type) for f in target
                ]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def lower_ascii(column):
    """A-Z in lower case, every other code point as it is."""
    return F.translate(column, UPPER, LOWER)


def pieces(total: int, size: int, least: int = 1) -> int:
    """How many parts of about ``size`` hold ``total``."""
    return max(least, -(-int(total or 0) // size))


class WordHashes(dict):
    """64-bit hash by word; forgets everything at ``limit`` words, which bounds its memory."""

    def __init__(self, limit: int = 500_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text with A-Z lowered. bytes.lower() and bytes.split() know ASCII only,
    and split at exactly the six code points of SPACES."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], hashes: WordHashes, width: int = 5) -> np.ndarray:
    """One 64-bit hash for each run of ``width`` words, in order; a shorter text is one run."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    span = min(width, len(words))
    n = len(words) - span + 1
    out = np.full(n, np.uint64(span), np.uint64)
    for i in range(span):
        out = (out ^ h[i : i + n]) * _MIX
        out ^= out >> np.uint64(29)
    return out
