"""Line dedup: lines repeated over many documents stay in one of them.

Hashes of long lines are range-partitioned by (hash, document, newest first) and sorted within the
partitions, so one pass sees the keeper of a line first and then its copies. What leaves the pass
are drop positions, folded into one compressed keep bitmap per document; texts are never shuffled
with the lines. A hash that a third of all documents hold is cut by document over many partitions:
the two runs at a partition's edges are settled from a summary of two rows per partition.
"""

from __future__ import annotations

import zlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyguard.llm.frames import SPACES, arrow_map, stored

_LINES = "hi long, lo long, doc long, body long, pos int, n_lines int"
_PASS = "kind string, hi long, lo long, doc long, body long, pos int, n_lines int, n_docs long"


def line_keys(text: str | None, min_chars: int = 40):
    """(number of lines, [(position, key)]) with the keys of at least ``min_chars`` code points."""
    lines = (text or "").encode().split(b"\n")
    keys = []
    for at, line in enumerate(lines):
        if len(line) >= min_chars:
            key = line.strip(SPACES).lower()
            if len(key) >= min_chars and len(key.decode()) >= min_chars:
                keys.append((at, key))
    return len(lines), keys


def _body_hash(column) -> F.Column:
    """Tells rows with one id and different texts apart."""
    return F.xxhash64(F.coalesce(column, F.lit("")))


def _lines(docs: DataFrame, text: str, doc_id: str, min_chars: int) -> DataFrame:
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"), _body_hash(F.col(text)).alias("body"))

    def hashed(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("hi", "lo", "doc", "body", "pos", "n_lines")}
            for doc, text_, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
                n_lines, keys = line_keys(text_, min_chars)
                for at, key in keys:
                    h = xxhash.xxh3_128_intdigest(key)
                    out["hi"].append((h >> 64) - (1 << 63))
                    out["lo"].append((h & ((1 << 64) - 1)) - (1 << 63))
                    out["pos"].append(at)
                out["doc"] += [doc] * len(keys)
                out["body"] += [body] * len(keys)
                out["n_lines"] += [n_lines] * len(keys)
            yield out

    return arrow_map(rows, _LINES, hashed)


def _first_seen(batches, min_docs: int):
    """One pass over rows sorted by (hash, document from the largest): 'drop' rows for lines that
    are settled, 'open' rows of a partition's first run (its keeper may stand in the partition
    before) and of a last run that is still short, and an 'edge' row for each of the two."""
    names = ("hi", "lo", "doc", "body", "pos", "n_lines")
    run, first, docs, last, keeper = None, True, 0, object(), None
    held: list[tuple] = []  # the run's rows that are not settled: those of fewer than min_docs documents
    out: list[tuple] = []

    def close(end: bool):
        if run is not None and (first or end):
            if not first:
                out.extend(("open", *row, 0) for row in held)
            out.append(("edge", *run, keeper, 0, 0, 0, docs))

    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in names)):
            key = row[:2]
            if key != run:
                close(False)
                first = run is None
                run, docs, last, keeper, held = key, 0, object(), row[2], []
            if row[2] != last:
                docs, last = docs + 1, row[2]
            if first:
                out.append(("open", *row, 0))
            elif docs < min_docs:
                held.append(row)
            else:
                out.extend(("drop", *r, 0) for r in held if r[2] != keeper)
                held = []
                out.append(("drop", *row, 0))
        yield _columns(out)
        out.clear()
    close(True)
    yield _columns(out)


def _columns(rows: list[tuple]) -> dict[str, list]:
    names = ("kind", "hi", "lo", "doc", "body", "pos", "n_lines", "n_docs")
    return {n: [r[i] for r in rows] for i, n in enumerate(names)}


def keep_bitmaps(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc, body, n_lines, n_dropped, keep) for each text that loses lines; ``keep`` is a
    zlib-compressed bitmap, bit i of byte i // 8 from the top set where line i stays."""
    order = [F.col("hi"), F.col("lo"), F.desc_nulls_last("doc")]
    ordered = _lines(docs, text, doc_id, min_chars).repartitionByRange(*order).sortWithinPartitions(*order, "body", "pos")
    seen = stored(arrow_map(ordered, _PASS, lambda batches: _first_seen(batches, min_docs)), "line-runs")
    # Two rows per partition at most, whatever the data: safe to broadcast.
    edges = (
        seen.filter("kind = 'edge'")
        .groupBy("hi", "lo")
        .agg(F.sum("n_docs").alias("all_docs"), F.max("doc").alias("keeper"))
        .filter(F.col("all_docs") >= min_docs)
    )
    settled = seen.filter("kind = 'open'").join(F.broadcast(edges), ["hi", "lo"]).filter(~F.col("doc").eqNullSafe(F.col("keeper")))
    drops = seen.filter("kind = 'drop'").select("doc", "body", "n_lines", "pos").unionByName(settled.select("doc", "body", "n_lines", "pos"))
    per_text = drops.groupBy("doc", "body", "n_lines").agg(F.collect_set("pos").alias("gone"))

    def pack(batches):
        for batch in batches:
            out = {n: batch.column(n) for n in ("doc", "body", "n_lines")}
            gone = batch.column("gone").to_pylist()
            out["keep"] = [_pack(n, g) for n, g in zip(out["n_lines"].to_pylist(), gone)]
            out["n_dropped"] = [len(g) for g in gone]
            yield out

    return arrow_map(per_text, "doc long, body long, n_lines int, n_dropped int, keep binary", pack)


def _pack(n_lines: int, gone: list[int]) -> bytes:
    bits = np.ones(n_lines, np.uint8)
    bits[gone] = 0
    return zlib.compress(np.packbits(bits).tobytes(), 1)


def unpack(keep: bytes, n_lines: int) -> np.ndarray:
    """The keep bitmap as booleans."""
    return np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n_lines).astype(bool)


def drop_repeated_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with ``text`` cleaned, and columns line_count (before) and lines_dropped.

    A line's key is the line stripped of ASCII white space, A-Z lowered. Keys of at least
    ``min_chars`` code points held by at least ``min_docs`` documents lose all their lines except
    those of the largest ``doc_id`` that holds them. Null and empty texts are one empty line and
    become empty texts. Rows that repeat an id count as one document and are cleaned one by one;
    a null id counts as a document below all others. Empty tables stay empty; all other columns
    pass through, but for those named like the two new ones, which are replaced.
    """
    docs = docs.drop("line_count", "lines_dropped")
    kept = keep_bitmaps(docs, text, doc_id, min_chars, min_docs).select(
        F.col("doc").alias("__doc"), F.col("body").alias("__body"), F.col("keep").alias("__keep")
    )
    marked = docs.withColumn("__key", F.col(doc_id).cast("long")).withColumn("__text_hash", _body_hash(F.col(text)))
    joined = marked.join(kept, F.col("__key").eqNullSafe(F.col("__doc")) & (F.col("__text_hash") == F.col("__body")), "left")
    names = docs.columns

    def clean(batches):
        for batch in batches:
            out = {n: batch.column(n) for n in names}
            texts, counts, dropped = [], [], []
            for body, keep in zip(batch.column(text).to_pylist(), batch.column("__keep").to_pylist()):
                lines = (body or "").split("\n")
                counts.append(len(lines))
                if keep is not None:
                    lines = [x for x, stays in zip(lines, unpack(keep, len(lines))) if stays]
                texts.append("\n".join(lines))
                dropped.append(counts[-1] - len(lines))
            out |= {text: texts, "line_count": counts, "lines_dropped": dropped}
            yield out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return arrow_map(joined.select(*names, "__keep"), f"{fields}, line_count long, lines_dropped long", clean)
