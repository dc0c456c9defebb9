"""MinHash near-duplicates by a multi-index Hamming join.

1. A text's signature has one b-bit value for each of ``positions`` hash orders of its shingles.
   Two texts differ at a position with probability (1 - J) (1 - 2**-b).
2. Signatures are split into ``chunks`` of positions. By the pigeonhole principle, two signatures
   that differ at no more than ``distance`` = chunks * (errors + 1) - 1 positions have a chunk that
   differs at no more than ``errors``. All allowed errors are listed: a chunk is looked up with each
   choice of ``errors`` positions left out, so every pair within ``distance`` meets, without loss.
3. Pairs that meet are compared by their whole signatures; what is within ``distance`` is confirmed
   on full shingle sets, which are made for those texts only.
4. Texts that meet many others at one key (large groups of copies, and texts that share long
   passages) are not paired there. They are joined exactly by their rarest shingles: texts with
   passages in common part ways, and families of copies are told apart by their differences
   (jaccard_join, family_links). So no key is capped, and no pair of a crowded key is listed.

At the default 65 positions and distance 25 a pair of similarity 0.85 is beyond the distance about
once in a million times, one of 0.9 about never.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyguard.llm.components import components
from tallyguard.llm.family_links import LinkRule, bitmap, verified
from tallyguard.llm.frames import WordHashes, arrow_map, shingle_hashes, stored, words_of
from tallyguard.llm.jaccard_join import JoinParams, shingle_sets, similar_links

_NO_ID = -(1 << 63)


@dataclass(frozen=True)
class SignatureParams:
    """Sets are linked if den * intersection >= num * union. ``positions`` is a multiple of
    ``chunks``; a position has one byte, of which ``bits`` are used."""

    width: int = 5
    num: int = 85
    den: int = 100
    positions: int = 65
    chunks: int = 13
    errors: int = 1
    bits: int = 8
    seed: int = 20_11
    #: Up to so many sets at a lookup key are paired; beyond it they are joined by rare shingles.
    many: int = 8
    #: Up to so many of those sets are paired at a rare shingle; beyond it they are a family.
    dense: int = 64
    #: Signatures that one task remembers, so that copies are not hashed again.
    seen: int = 50_000

    def __post_init__(self):
        if self.positions % self.chunks or not 0 <= self.errors < self.positions // self.chunks or not 1 <= self.bits <= 8:
            raise ValueError("chunks of equal size, with more positions than errors, and one to eight bits")

    @property
    def distance(self) -> int:
        return self.chunks * (self.errors + 1) - 1

    @property
    def rule(self) -> LinkRule:
        return LinkRule(self.num, self.den, self.many)


def hash_orders(params: SignatureParams) -> tuple[np.ndarray, np.ndarray]:
    """What makes one order of all shingles for each position: a mask and an odd factor."""
    draw = np.random.Generator(np.random.PCG64(params.seed)).integers(0, 1 << 63, (2, params.positions), dtype=np.uint64)
    return draw[0] << np.uint64(1), draw[1] << np.uint64(1) | np.uint64(1)


def signature(shingles: np.ndarray, orders: tuple[np.ndarray, np.ndarray], bits: int) -> bytes:
    """The lowest ``bits`` of the middle of each position's smallest hash; long sets go in pieces."""
    masks, factors = (x[:, None] for x in orders)
    least = np.full(len(masks), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1 << 14):
        least = np.minimum(least, ((shingles[at : at + (1 << 14)] ^ masks) * factors).min(axis=1))
    return ((least >> np.uint64(20)).astype(np.uint8) & np.uint8((1 << bits) - 1)).tobytes()


def _key(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def signatures(rows: DataFrame, params: SignatureParams) -> DataFrame:
    """(id, unit, n, sig) of every row (id, text); unit and sig are null where there are no words."""

    def run(batches):
        orders, hashes = hash_orders(params), WordHashes()
        seen: dict[bytes, tuple[int, bytes]] = {}
        for batch in batches:
            out: dict[str, list] = {"unit": [], "n": [], "sig": []}
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                key = _key(words) if words else None
                if key is not None and key not in seen:
                    if len(seen) >= params.seen:
                        seen.clear()
                    own = np.unique(shingle_hashes(words, hashes, params.width))
                    seen[key] = len(own), signature(own, orders, params.bits)
                n, sig = seen[key] if key is not None else (0, None)
                out["unit"].append(_unit(key) if key is not None else None)
                out["n"].append(n)
                out["sig"].append(sig)
            yield {"id": batch.column("id"), **out}

    return arrow_map(rows, "id long, unit long, n int, sig binary", run)


def lookup_keys(sig: Column, params: SignatureParams) -> list[Column]:
    """A hash for each chunk and each choice of positions left out of it."""
    size = params.positions // params.chunks
    out = []
    for chunk in range(params.chunks):
        for left_out in combinations(range(size), params.errors):
            kept = [F.substring(sig, chunk * size + i + 1, 1) for i in range(size) if i not in left_out]
            out.append(F.xxhash64(F.lit(len(out)), *kept))
    return out


def _within(pairs: DataFrame, units: DataFrame, params: SignatureParams) -> DataFrame:
    """Pairs whose signatures differ at no more than ``distance`` positions."""
    left, right = (units.select(F.col("unit").alias(u), F.col("sig").alias(s)) for u, s in (("a", "x"), ("b", "y")))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in "xy")
                mask = pa.array((x != y).sum(axis=1) <= params.distance)
                yield {n: batch.column(n).filter(mask) for n in ("a", "b")}

    return arrow_map(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y"), "a long, b long", run)


def _unit(key: bytes) -> int:
    """The number that a word sequence goes by: 64 bits of its key."""
    return int.from_bytes(key[:8], "little", signed=True)


def _full_sets(texts: DataFrame, wanted: DataFrame, params: SignatureParams) -> DataFrame:
    """(unit, n, shared, bits): all shingles of the wanted units, whose texts are among ``texts``."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            out: dict[str, list] = {"unit": [], "n": [], "shared": [], "bits": []}
            for text in batch.column("text").to_pylist():
                if words := words_of(text):
                    own = np.unique(shingle_hashes(words, hashes, params.width))
                    for name, value in zip(out, (_unit(_key(words)), len(own), own.tobytes(), bitmap(own))):
                        out[name].append(value)
            yield out

    made = arrow_map(texts.select("text"), "unit long, n int, shared binary, bits binary", run)
    # An id on several rows brings other texts along, or its own more than once.
    return made.join(wanted.select("unit"), "unit").groupBy("unit").agg(*(F.first(c).alias(c) for c in ("n", "shared", "bits")))


def _texts_of(rows: DataFrame, units: DataFrame, paired: DataFrame, crowded: DataFrame) -> DataFrame:
    """(text, paired, crowded) of the rows of ``units`` (unit, id) in either: the texts are dealt by id
    once, and only those that later steps read are kept, so they never deal the whole table again."""
    either = paired.withColumn("use", F.lit("paired")).union(crowded.withColumn("use", F.lit("crowded")))
    uses = units.join(either, "unit").groupBy("id").agg(*(F.max(F.col("use") == u).alias(u) for u in ("paired", "crowded")))
    return stored(rows.join(uses, "id").select("text", "paired", "crowded"), "texts")


def signature_links(rows: DataFrame, signed: DataFrame, params: SignatureParams) -> DataFrame:
    """(a, b): links between units, one for each different word sequence."""
    units = stored(signed.filter("unit is not null").groupBy("unit").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig")), "units")
    keyed = units.select("unit", F.explode(F.array(*lookup_keys(F.col("sig"), params))).alias("h"))
    shared = keyed.groupBy("h").agg(F.count(F.lit(1)).alias("crowd")).filter("crowd > 1")
    met = stored(keyed.join(shared, "h"), "lookups")
    few = met.filter(F.col("crowd") <= params.many)
    pairs = few.alias("x").join(few.alias("y"), (F.col("x.h") == F.col("y.h")) & (F.col("x.unit") < F.col("y.unit")))
    pairs = stored(_within(pairs.select(F.col("x.unit").alias("a"), F.col("y.unit").alias("b")).distinct(), units, params), "pairs")
    paired = pairs.select(F.col("a").alias("unit")).union(pairs.select("b")).distinct()
    crowded = met.filter(F.col("crowd") > params.many).select("unit").distinct()
    texts = _texts_of(rows, units.select("unit", "id"), paired, crowded)
    sets = stored(_full_sets(texts.filter("paired"), paired, params), "sets")
    dense = JoinParams(width=params.width, num=params.num, den=params.den, many=params.dense)
    return verified(pairs, sets, params.rule).union(similar_links(shingle_sets(texts.filter("crowded").select("text"), dense), dense))


def near_duplicates(docs: DataFrame, params: SignatureParams | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row.

    Words are runs between ASCII white space with A-Z lowered; a set is the distinct shingles of
    ``width`` words, or the whole sequence where there are fewer. Null, empty and wordless texts
    have an empty set, are linked with nothing, and are kept. component_id is the smallest id
    reachable by links; kept marks the rows with that id. Rows that repeat an id are one document
    with the links of all its texts. Null ids are one document, smaller than all others, and give a
    null component_id. An empty table gives no rows; other columns are not looked at.
    """
    params = params or SignatureParams()
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("id"), F.col(text).alias("text"))
    signed = stored(signatures(rows, params), "signatures")
    edges = signature_links(rows, signed, params)
    placed = signed.select("id", "unit", "n")
    own = placed.filter("unit is not null").select("id", "unit")
    several = own.groupBy("id").agg(F.min("unit").alias("a"), F.max("unit").alias("b")).filter("a <> b").select("id", "a")
    labels = components(edges.union(own.join(several, "id").select("a", F.col("unit").alias("b"))))
    rooted = placed.join(labels, placed.unit == labels.node, "left").select("id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("root", "unit").alias("root"))
    rooted = stored(rooted, "rooted")
    smallest = rooted.filter("root is not null").groupBy("root").agg(F.min("id").alias("least"))
    found = rooted.join(smallest, "root", "left").select("id", "n_shingles", F.coalesce("least", "id").alias("component"))
    return found.select(
        F.nullif(F.col("id"), F.lit(_NO_ID)).alias(doc_id),
        "n_shingles",
        F.nullif(F.col("component"), F.lit(_NO_ID)).alias("component_id"),
        (F.col("id") == F.col("component")).alias("kept"),
    )
