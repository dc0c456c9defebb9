"""N-gram Jaccard join by grouped prefixes.

1. Texts are dealt to blocks by hash, each different word sequence once.
2. Every block sends its distinct shingles, packed and parted by hash range, to one count per range,
   which sends back how many texts hold each. No shingle count is broadcast or collected.
3. A set's shingles are ordered from rare to frequent. Its prefix (the first n - ceil(t n) + 1) must
   share a shingle with every set that it can be similar to. Shingles that one set alone holds come
   first and meet nothing: sets with equal size, as many of those and an equal rest of the prefix are
   one group. Groups meet at the shingles of their prefixes that more than one text holds.
4. Group pairs pass a size and a position filter; their members are verified, by bitmaps and then
   exactly. Where many meet, differences within the family take the place of pairs (family_links),
   so a thousand near copies cost about a thousand checks, and no link between components is lost.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyguard.llm.components import components
from tallyguard.llm.family_links import LinkRule, bitmap, either, links, met
from tallyguard.llm.frames import WordHashes, arrow_map, pieces, shingle_hashes, stored, words_of

_NO_ID = -(1 << 63)
_SETS = "unit long, key binary, n int, grp long, shared binary, bits binary, prefix array<long>, place array<int>"


@dataclass(frozen=True)
class JoinParams:
    """Sets are linked if den * intersection >= num * union."""

    width: int = 5
    num: int = 75
    den: int = 100
    block_chars: int = 16 << 20
    range_shingles: int = 4 << 20
    #: Up to so many sets at a shingle are paired; beyond it they are a family. A pair costs one row,
    #: a family's member a row for each element of its difference, and a set is in many families.
    many: int = 64
    #: Word sequences that one task remembers to send once; beyond it, copies are sent again.
    seen: int = 1_000_000

    @property
    def rule(self) -> LinkRule:
        return LinkRule(self.num, self.den, self.many)


def _words_key(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def _unit(key: bytes) -> int:
    """The number that a word sequence goes by: 64 bits of its key."""
    return int.from_bytes(key[:8], "little", signed=True)


def _keys(docs: DataFrame) -> DataFrame:
    """(id, key) of every row; key is null where there are no words."""

    def run(batches):
        for batch in batches:
            words = (words_of(t) for t in batch.column("text").to_pylist())
            yield {"id": batch.column("id"), "key": [_words_key(w) if w else None for w in words]}

    return arrow_map(docs, "id long, key binary", run)


def _bodies(docs: DataFrame, params: JoinParams, blocks: int) -> DataFrame:
    """(block, key, body): different word sequences. A task sends each but once, so many copies of
    one text do not fill a block."""

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            out: dict[str, list] = {"block": [], "key": [], "body": []}
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                if not words or (key := _words_key(words)) in seen:
                    continue
                if len(seen) >= params.seen:
                    seen.clear()
                seen.add(key)
                out["block"].append(int.from_bytes(key[:8], "little") % blocks)
                out["key"].append(key)
                out["body"].append(b" ".join(words))
            yield out

    return arrow_map(docs, "block int, key binary, body binary", run)


def _block_sets(table: pa.Table, params: JoinParams) -> dict[bytes, np.ndarray]:
    """key -> sorted distinct shingles of a block, in the keys' order."""
    hashes, out = WordHashes(), {}
    for key, body in sorted(zip(*(table.column(n).to_pylist() for n in ("key", "body")))):
        if key not in out:
            out[key] = np.unique(shingle_hashes(body.split(b" "), hashes, params.width))
    return out


def _block_counts(sets: dict) -> tuple[np.ndarray, np.ndarray]:
    """The block's distinct shingles, and how many of its sets hold each."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *sets.values()]), return_counts=True)


def _pack(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _by_range(shingles: np.ndarray, ranges: int) -> list[slice]:
    """Slices of the sorted shingles, one for each of ``ranges`` (a power of two) hash ranges."""
    bits = ranges.bit_length() - 1
    edges = np.arange(1, ranges, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.empty(0, np.uint64)
    at = [0, *np.searchsorted(shingles, edges).tolist(), len(shingles)]
    return [slice(a, b) for a, b in zip(at, at[1:])]


def _low_bits(shingles: np.ndarray, ranges: int) -> np.ndarray:
    """32 bits below those that name the range: enough to order by frequency, never to verify."""
    bits = ranges.bit_length() - 1
    return ((shingles << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)


def _frequencies(bodies: DataFrame, params: JoinParams, ranges: int) -> DataFrame:
    """(block, part, counts): for each block and range, how many texts of all hold its shingles, in
    the order of the block's shingles (1, 2, or more up to 65535)."""
    schema = "block int, part int, low binary, held binary"

    def ask(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        shingles, held = _block_counts(_block_sets(table, params))
        rows = {"block": [], "part": [], "low": [], "held": []}
        for part, span in enumerate(_by_range(shingles, ranges)):
            if span.stop > span.start:
                low = _low_bits(shingles[span], ranges)
                rows["block"].append(block)
                rows["part"].append(part)
                rows["low"].append(_pack(np.diff(low, prepend=np.uint32(0))))
                rows["held"].append(_pack(held[span].astype(np.uint32)))
        return pa.table({"block": pa.array(rows["block"], pa.int32()), "part": pa.array(rows["part"], pa.int32()), "low": pa.array(rows["low"], pa.binary()), "held": pa.array(rows["held"], pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        lows = [np.cumsum(_unpack(x, np.uint32), dtype=np.uint32) for x in table.column("low").to_pylist()]
        held = [_unpack(x, np.uint32) for x in table.column("held").to_pylist()]
        values, index = np.unique(np.concatenate(lows), return_inverse=True)
        total = np.bincount(index, np.concatenate(held), len(values))
        own = np.minimum(total, 65535).astype(np.uint16)[index]
        ends = np.cumsum([len(x) for x in lows])[:-1]
        counts = [_pack(x) for x in np.split(own, ends)]
        return pa.table({"block": table.column("block"), "part": table.column("part"), "counts": pa.array(counts, pa.binary())})

    asked = bodies.groupBy("block").applyInArrow(ask, schema)
    return asked.groupBy("part").applyInArrow(answer, "block int, part int, counts binary")


def _prefixes(bodies: DataFrame, counts: DataFrame, params: JoinParams) -> DataFrame:
    """One row for each different text: its size, group, prefix shingles that others hold with their
    places in the order, and all its shingles that others hold (the only ones that can be shared)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(_SETS))

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        rows: dict[str, list] = {f.name: [] for f in target}
        if texts.num_rows:
            sets = _block_sets(texts, params)
            shingles, _ = _block_counts(sets)
            parts = sorted(zip(answers.column("part").to_pylist(), answers.column("counts").to_pylist()))
            df = np.concatenate([_unpack(c, np.uint16) for _, c in parts])
            for key, own in sets.items():
                held = df[np.searchsorted(shingles, own)]
                order = np.lexsort((own, held))
                n = len(own)
                head = order[: n - params.rule.least_overlap(n) + 1]
                place = np.flatnonzero(held[head] > 1)
                prefix = own[head]
                rows["unit"].append(_unit(key))
                rows["key"].append(key)
                rows["n"].append(n)
                # Places tell how many shingles of this text alone come first.
                rows["grp"].append(xxhash.xxh3_64_intdigest(prefix[place].tobytes() + place.astype(np.int32).tobytes(), n) - (1 << 63))
                rows["prefix"].append(prefix[place].view(np.int64))
                rows["place"].append(place.astype(np.int32))
                rows["shared"].append(own[held > 1].tobytes() if len(place) else None)
                rows["bits"].append(bitmap(own) if len(place) else None)
        return pa.Table.from_arrays([pa.array(rows[f.name], f.type) for f in target], schema=target)

    return bodies.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(run, _SETS)


def shingle_sets(rows: DataFrame, params: JoinParams) -> DataFrame:
    """One row for each different word sequence of ``rows`` (text): its set with its prefix."""
    chars = rows.agg(F.sum(F.length("text"))).first()[0]
    blocks = pieces(chars, params.block_chars)
    ranges = 1 << (pieces(chars, 6 * params.range_shingles) - 1).bit_length()
    bodies = _bodies(rows, params, blocks)
    counts = stored(_frequencies(bodies, params, ranges), "frequencies")
    return stored(_prefixes(bodies, counts, params), "sets")


def similar_links(sets: DataFrame, params: JoinParams) -> DataFrame:
    """(a, b): links that join all components of the units."""
    rule = params.rule
    sets = sets.filter(F.col("shared").isNotNull())
    members = sets.select("grp", "unit", "n")
    # A group's sets have one prefix: any of them tells where it meets others.
    groups = stored(
        sets.groupBy("grp").agg(F.min("unit").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("n").alias("n"), F.first(F.arrays_zip("prefix", "place")).alias("at")),
        "groups",
    )
    meetings = groups.select(F.col("grp").alias("unit"), "size", "n", F.inline("at")).withColumnsRenamed({"prefix": "h", "place": "at"})
    meetings = meetings.select("h", "unit", "n", rule.gap(F.col("n"), F.col("n")).alias("g"), F.col("n").alias("d"), "at", F.lit(True).alias("open"), "size")
    met_pairs, met_families = met(meetings, rule)
    one, two = (members.select(F.col("grp").alias(g), F.col("unit").alias(u)) for g, u in (("a", "ua"), ("b", "ub")))
    between = met_pairs.join(one, "a").join(two, "b").select(*either(F.col("ua"), F.col("ub")))
    few = groups.filter(F.col("size").between(2, rule.few)).select("grp")
    inside = members.join(few, "grp")
    inside = inside.alias("x").join(inside.alias("y"), (F.col("x.grp") == F.col("y.grp")) & (F.col("x.unit") < F.col("y.unit")))
    pairs = between.union(inside.select(F.col("x.unit").alias("a"), F.col("y.unit").alias("b"))).distinct()
    pivots = groups.select(F.col("grp").alias("p"), "rep")
    families = met_families.withColumnRenamed("unit", "grp").join(members.select("grp", "unit"), "grp").join(pivots, "p").select(F.col("rep").alias("p"), "unit", "n")
    return links(pairs, families.distinct(), sets, rule)


def near_duplicate_components(docs: DataFrame, params: JoinParams | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row.

    Words are runs between ASCII white space with A-Z lowered; a set is the distinct shingles of
    ``width`` words, or the whole sequence where there are fewer. Null, empty and wordless texts
    have an empty set, are linked with nothing, and are their own component. component_id is the
    smallest id reachable by links. Rows that repeat an id are one document with the links of all
    its texts. Null ids are one document, smaller than all others, and give a null component_id.
    An empty table gives no rows; other columns are not looked at.
    """
    params = params or JoinParams()
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("id"), F.col(text).alias("text"))
    keyed = stored(_keys(rows), "document-keys")
    sets = shingle_sets(rows, params)
    edges = similar_links(sets, params)
    placed = keyed.join(sets.select("key", "unit", "n"), "key", "left")
    # One id with several texts links them, each to the smallest of them.
    own = placed.filter("unit is not null").select("id", "unit")
    several = own.groupBy("id").agg(F.min("unit").alias("a"), F.max("unit").alias("b")).filter("a <> b").select("id", "a")
    labels = components(edges.union(own.join(several, "id").select("a", F.col("unit").alias("b"))))
    rooted = placed.join(labels, placed.unit == labels.node, "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), F.coalesce("root", "unit").alias("root"))
    rooted = stored(rooted, "rooted")
    smallest = rooted.filter("root is not null").groupBy("root").agg(F.min("id").alias("least"))
    found = rooted.join(smallest, "root", "left").select("id", "n_shingles", F.coalesce("least", "id").alias("component"))
    return found.select(
        F.nullif(F.col("id"), F.lit(_NO_ID)).alias(doc_id), "n_shingles", F.nullif(F.col("component"), F.lit(_NO_ID)).alias("component_id")
    )


def one_of_each(docs: DataFrame, params: JoinParams | None = None, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the documents whose component holds a smaller id; of rows that repeat an id
    all stay or go. Documents without words stay."""
    found = near_duplicate_components(docs, params, doc_id).filter(~F.col("component_id").eqNullSafe(F.col(doc_id)))
    gone = found.select(F.col(doc_id).alias("__gone")).distinct()
    return docs.join(gone, F.col(doc_id).cast("long").eqNullSafe(F.col("__gone")), "left_anti")
