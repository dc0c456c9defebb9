"""Benchmark decontamination: short test items inside long documents.

Items are parted by size (powers of two of their shingle count). An item's sketch is its bottom-k
MinHash: the k shingles with the smallest hashes, k fixed by its part's upper size. With a needed
containment c, k > (1 - c) * size, so a document that holds an item to that degree shares at least
at least k - (1 - c) * size of its sketch shingles: the candidate search loses nothing. Only
candidates are then verified by exact containment: their items' shingles, by text, are looked up among
the document's own.

Document shingles are probed against two bitmaps of fixed size (sketches, whole items) before anything
is shuffled, so what moves is only what may belong to an item. Neither the items nor the documents are
collected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyguard.llm.frames import WordHashes, arrow_map, shingle_hashes, stored, words_of

_GRAM = "id long, h long, gram string"


@dataclass(frozen=True)
class DecontamParams:
    """``bitmap_bits`` (a power of two) fixes what is broadcast: 2**26 bits are 8 MB at any size of
    the benchmark; more items only let more shingles through to the exact join."""

    width: int = 5
    containment: float = 0.75
    bitmap_bits: int = 26


def sketch_size(n_shingles: int, containment: float) -> int:
    """k of the size part that ``n_shingles`` falls into: one more than may be missing at its upper size."""
    upper = 1 << max(0, (n_shingles - 1).bit_length())
    return int((1.0 - containment) * upper + 1e-9) + 1


def item_shingles(items: DataFrame, params: DecontamParams, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(id, h, gram, n, in_sketch, needed) for each distinct shingle of each item; ``needed`` sketch
    shingles at least are in every document that holds the item. Rows that repeat an id add up to one
    item; items without words have no rows."""
    rows = items.select(F.col(item_id).cast("long").alias("id"), F.col(text).alias("text"))

    def cut(batches, hashes):
        for batch in batches:
            out: dict[str, list] = {"id": [], "h": [], "gram": []}
            for item, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(body)
                found = dict(zip(_grams(words, params.width), shingle_hashes(words, hashes, params.width).view(np.int64).tolist()))
                out["id"] += [item] * len(found)
                out["gram"] += found.keys()
                out["h"] += found.values()
            yield out

    grams = arrow_map(rows, _GRAM, cut, WordHashes).distinct()
    # Ranks, not arrays: rows without an id add up to an item of any size.
    ranked = grams.withColumns(
        {"n": F.count(F.lit(1)).over(Window.partitionBy("id")), "nth": F.rank().over(Window.partitionBy("id").orderBy("h"))}
    )
    k = F.floor((1.0 - params.containment) * F.pow(F.lit(2.0), F.ceil(F.log2("n"))) + 1e-9).cast("int") + 1
    missing = F.floor((1.0 - params.containment) * F.col("n") + 1e-9)
    needed = F.greatest(F.least(k, F.col("n")) - missing, F.lit(1)).cast("int")
    return ranked.select("id", "h", "gram", "n", (F.col("nth") <= k).alias("in_sketch"), needed.alias("needed"))


def _grams(words: list[bytes], width: int) -> list[str]:
    span = min(width, len(words))
    return [b" ".join(words[i : i + span]).decode() for i in range(len(words) - span + 1)] if words else []


def _bitmap(items: DataFrame, bits: int) -> np.ndarray:
    """A bit for each hash's leading ``bits`` bits, in 64-bit words. Words are merged by key on the
    executors; the driver gets 2**bits / 64 of them at most, however many items there are."""
    slot = F.shiftrightunsigned("h", 64 - bits)
    one = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    words = items.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    full = np.zeros(1 << (bits - 6), np.uint64)
    full[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return full


def _may_hold(full: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """Where the hashes' bits are set."""
    slots = h >> np.uint64(64 - bits)
    return np.flatnonzero((full[slots >> np.uint64(6)] >> (slots & np.uint64(63))) & np.uint64(1))


def contained_items(docs: DataFrame, items: DataFrame, params: DecontamParams | None = None, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment) for each pair in which the document
    holds at least ``containment`` of the item's distinct shingles (five words, A-Z lowered; an
    item of fewer words is one shingle of them all, and so is looked for in documents of any size).

    Null and empty texts hold nothing and are held by nothing. Rows that repeat a doc_id or an
    item_id count as one with all their shingles. Null ids are kept as ids. Empty tables give no
    pairs. Other columns are not looked at.
    """
    params = params or DecontamParams()
    wanted = stored(item_shingles(items, params, item_id, text), "item-shingles")
    held = document_shingles(docs, wanted, params, doc_id, text)
    verified = contained(candidates(held, wanted), held, wanted, params)
    return verified.select(
        F.col("doc").alias(doc_id),
        F.col("item").alias(item_id),
        "shared",
        F.col("n").alias("item_shingles"),
        (F.col("shared") / F.col("n")).alias("containment"),
    )


def document_shingles(docs: DataFrame, wanted: DataFrame, params: DecontamParams, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, h, gram, probe) for the distinct shingles of the documents that some item may have;
    ``probe`` where a sketch may have it."""
    session = docs.sparkSession
    whole = session.sparkContext.broadcast(_bitmap(wanted, params.bitmap_bits))
    sketched = session.sparkContext.broadcast(_bitmap(wanted.filter("in_sketch"), params.bitmap_bits))
    widths = sorted(int(r[0]) for r in wanted.select(F.size(F.split("gram", " ")).alias("w")).distinct().collect())
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))

    def probe(batches, hashes):
        full, part, bits = whole.value, sketched.value, params.bitmap_bits
        for batch in batches:
            out: dict[str, list] = {"doc": [], "h": [], "gram": [], "probe": []}
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(body)
                for width in widths:  # up to params.width: short items are shingles of their own length
                    if len(words) < width:
                        continue
                    h = shingle_hashes(words, hashes, width)
                    at = _may_hold(full, h, bits)
                    found = {b" ".join(words[i : i + width]).decode(): int(v) for i, v in zip(at.tolist(), h[at].view(np.int64))}
                    hit = np.zeros(len(found), bool)
                    hit[_may_hold(part, np.fromiter(found.values(), np.int64, len(found)).view(np.uint64), bits)] = True
                    out["doc"] += [doc] * len(found)
                    out["gram"] += found.keys()
                    out["h"] += found.values()
                    out["probe"] += hit.tolist()
            if out["doc"]:
                yield out

    return stored(arrow_map(rows, "doc long, h long, gram string, probe boolean", probe, WordHashes).distinct(), "document-shingles")


def candidates(held: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, item): pairs that share as many sketch shingles as the item's size part asks for."""
    sketches = wanted.filter("in_sketch").select(F.col("id").alias("item"), "h", "gram", "needed")
    met = held.filter("probe").select("doc", "h", "gram").join(sketches, ["h", "gram"])
    return met.groupBy("doc", "item").agg(F.count(F.lit(1)).alias("met"), F.max("needed").alias("needed")).filter("met >= needed").select("doc", "item")


def contained(pairs: DataFrame, held: DataFrame, wanted: DataFrame, params: DecontamParams) -> DataFrame:
    """(doc, item, shared, n) of the candidate pairs that hold: each pair brings its item's shingles,
    and those that the document has are counted."""
    item = wanted.select(F.col("id").alias("_item"), "h", "gram", "n")
    asked = pairs.join(item, F.col("item").eqNullSafe(F.col("_item"))).drop("_item")
    own = held.select(F.col("doc").alias("_doc"), F.col("h").alias("_h"), F.col("gram").alias("_gram"))
    same = (F.col("h") == F.col("_h")) & (F.col("gram") == F.col("_gram")) & F.col("doc").eqNullSafe(F.col("_doc"))
    counted = asked.join(own, same).groupBy("doc", "item").agg(F.count(F.lit(1)).alias("shared"), F.max("n").alias("n"))
    return counted.filter(F.col("shared") >= params.containment * F.col("n"))


def decontaminate(docs: DataFrame, items: DataFrame, params: DecontamParams | None = None, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the documents that hold an item; all columns and repeated rows stay.
    Rows with a null id are held to the pairs found for null."""
    found = contained_items(docs, items, params, doc_id).select(F.col(doc_id).alias("__held")).distinct()
    return docs.join(found, F.col(doc_id).cast("long").eqNullSafe(F.col("__held")), "left_anti")
