"""Phrase collocations from a weighted de Bruijn graph of words.

1. Texts are read once into blocks of word numbers. Every block asks, by hash range, for the counts
   of its words: a word below the least count is in no phrase that reaches it, so it ends a piece
   like a full stop does. Then pairs are counted by range, and two words whose pair is below the
   least count are parted too: frequent pairs have a bit each in a bitmap of fixed size, and a bit
   that two pairs share only lets more through. What is left are stretches.
2. Each place of a stretch is the start of one edge: the longest gram (``most_words`` words) where
   the stretch goes on for so long, and what is left of it at its end. A long gram joins two nodes,
   its words without the last and without the first. Equal edges are added up, in the block first,
   then by hash range of their first three words.
3. The count of a shorter phrase is the flow through its node: the weight of all edges that start
   with it, one word longer, and the ends that are just it. No shorter gram is ever listed. Ranges
   add up what starts with three words or more; flows of pairs go on to ranges of their own, one
   entry from each range, so a pair that starts a third of all edges still meets in small lists.
4. A node whose whole flow runs through one longer neighbour lies on a path without branches and is
   merged into it. What remains is scored at its weakest cut.

Texts, words, pairs and edges move as packed lists; none of them is broadcast, or collected by the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyguard.llm.frames import arrow_map, pieces, stored

# What ends a piece, [.,;:!?\x0A-\x0D], and what parts words within one, [\x20\x09].
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
WORD_GAPS = b" \t"
_PLAIN = bytes.maketrans(PIECE_ENDS + WORD_GAPS, b"\n" * len(PIECE_ENDS) + b" " * len(WORD_GAPS))
_END, _NONE = -1, -2
_MIX = np.uint64(0x9E3779B97F4A7C15)
_PACKED = "block long, part int, body binary, counts binary, n long"
_STREAM, _LANG = -1, -2


@dataclass(frozen=True)
class PhraseParams:
    """Phrases of 2 to ``most_words`` words (5 at most here) that occur ``least_count`` times in their
    language; the first ``top`` of each language are returned (None: all). 2**26 bits for pairs
    (``pair_bits``) are 8 MB at any size of the input."""

    least_count: int = 100
    most_words: int = 5
    top: int | None = 2000
    block_chars: int = 16 << 20
    range_chars: int = 24 << 20
    pair_bits: int = 26


def _zip(values: np.ndarray) -> bytes:
    """Compressed by byte planes: the high bytes of small numbers are all alike."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unzip(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _zip_words(words: list[bytes]) -> bytes:
    ends = np.cumsum([0, *map(len, words)], dtype=np.int32)
    return zstandard.ZstdCompressor(level=1).compress(ends.tobytes() + b"".join(words))


def _unzip_words(data: bytes, count: int) -> pa.Array:
    data = pa.py_buffer(zstandard.ZstdDecompressor().decompress(data))
    return pa.Array.from_buffers(pa.binary(), count, [None, data.slice(0, 4 * (count + 1)), data.slice(4 * (count + 1))])


class _Numbers(dict):
    """Number of a word within its block; a word is known by its language and itself."""

    def __init__(self, lang: bytes, keys: list[bytes]):
        super().__init__({b"": _NONE, b"\n": _END})
        self.lang, self.keys_ = lang + b"\t", keys

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.keys_)
        self.keys_.append(self.lang + word)
        return number


class _Block:
    def __init__(self):
        self.keys: list[bytes] = []
        self.langs: dict[str, _Numbers] = {}
        self.streams: list[np.ndarray] = []
        self.tokens: dict[str, int] = {}
        self.chars = 0

    def add(self, lang: str, text: str) -> None:
        numbers = self.langs.get(lang)
        if numbers is None:
            numbers = self.langs[lang] = _Numbers(lang.encode("utf-8", "surrogatepass"), self.keys)
        # bytes.lower() knows ASCII only: A-Z.
        words = text.encode("utf-8", "surrogatepass").lower().translate(_PLAIN).replace(b"\n", b" \n ").split(b" ")
        own = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
        own = own[own != _NONE]
        self.tokens[lang] = self.tokens.get(lang, 0) + int((own >= 0).sum())
        self.streams += own, np.array([_END], np.int32)
        self.chars += len(text)

    def rows(self, block: int, parts: int) -> dict[str, list]:
        """The stream of word numbers with each number's range, the words of each range with their
        counts, tokens by language. Numbers are dealt anew, frequent words first."""
        stream = np.concatenate(self.streams)
        counts = np.bincount(stream[stream >= 0], minlength=len(self.keys))
        turn = np.argsort(-counts, kind="stable")
        number = np.empty(len(turn) + 1, np.int32)
        number[turn] = np.arange(len(turn))
        number[-1] = _END  # what _END, -1, points at
        keys, counts = [self.keys[i] for i in turn.tolist()], counts[turn]
        part = np.fromiter((xxhash.xxh3_64_intdigest(k) % parts for k in keys), np.int32, len(keys))
        rows = {"part": [_STREAM], "body": [_zip(number[stream])], "counts": [_zip(part)], "n": [None]}
        order = np.argsort(part, kind="stable")
        found, first = np.unique(part[order], return_index=True)
        for p, span in zip(found.tolist(), np.split(order, first[1:]) if len(order) else []):
            rows["part"].append(p)
            rows["body"].append(_zip_words([keys[i] for i in span.tolist()]))
            rows["counts"].append(_zip(counts[span].astype(np.int64)))
            rows["n"].append(len(span))
        for lang, n in self.tokens.items():
            rows["part"].append(_LANG)
            rows["body"].append(lang.encode("utf-8", "surrogatepass"))
            rows["counts"].append(None)
            rows["n"].append(n)
        return {"block": [block] * len(rows["part"]), **rows}


def _blocks(docs: DataFrame, params: PhraseParams, parts: int) -> DataFrame:
    """Texts as word numbers, written once: numbers and blocks stay as they are."""

    def run(batches):
        from pyspark import TaskContext

        number, block = TaskContext.get().partitionId() << 32, _Block()
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                block.add(lang, text)
                if block.chars >= params.block_chars:
                    yield block.rows(number, parts)
                    number, block = number + 1, _Block()
        if block.streams:
            yield block.rows(number, parts)

    return stored(arrow_map(docs, _PACKED, run), "phrase-blocks")


def _table(rows: list[tuple]) -> pa.Table:
    kinds = {"block": pa.int64(), "part": pa.int32(), "body": pa.binary(), "counts": pa.binary(), "n": pa.int64()}
    columns = zip(*rows) if rows else ((),) * len(kinds)
    return pa.table({name: pa.array(values, kind) for (name, kind), values in zip(kinds.items(), columns)})


def _frequent_words(asked: DataFrame, params: PhraseParams, parts: int) -> DataFrame:
    """By range: to every block, the final numbers of its words (-1: too rare); and one row (block
    -1) with the range's words and their counts. Frequent words get small numbers."""

    def answer(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        sizes = table.column("n").to_pylist()
        lists = [_unzip_words(d, n) for d, n in zip(table.column("body").to_pylist(), sizes)]
        coded = pa.concat_arrays(lists).dictionary_encode()
        index = coded.indices.to_numpy()
        total = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(total, index, np.concatenate([_unzip(c, np.int64) for c in table.column("counts").to_pylist()]))
        many = np.argsort(-total, kind="stable")[: int((total >= params.least_count).sum())]
        if len(many) * parts >= 1 << 31:
            raise ValueError("more than 2**31 frequent words")
        number = np.full(len(total), -1, np.int32)
        number[many] = np.arange(len(many)) * parts + part
        own = np.split(number[index], np.cumsum(sizes)[:-1])
        rows = [(block, part, _zip(x), None, len(x)) for block, x in zip(table.column("block").to_pylist(), own)]
        rows.append((-1, part, _zip_words(coded.dictionary.take(pa.array(many)).to_pylist()), _zip(total[many]), len(many)))
        return _table(rows)

    return stored(asked.groupBy("part").applyInArrow(answer, _PACKED), "phrase-words")


def summed(edges: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different rows of ``edges`` in order, with their added weights."""
    if not len(edges):
        return edges, weights
    turn = np.lexsort(edges.T[::-1])
    edges = edges[turn]
    first = np.flatnonzero(np.append(True, (edges[1:] != edges[:-1]).any(axis=1)))
    return edges[first], np.add.reduceat(weights[turn], first)


def edges_of(stream: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(edges, weights): from each place of ``stream`` that a word follows, as many words as follow
    without a break (-1), ``most`` at most; -1 where an edge has fewer."""
    padded = np.append(stream, np.full(most, _END, stream.dtype))
    at = np.flatnonzero((padded[: len(stream)] >= 0) & (padded[1 : len(stream) + 1] >= 0))
    edges = np.full((len(at), most), -1, np.int32)
    here = np.ones(len(at), bool)
    for k in range(most):
        here = here & (padded[at + k] >= 0)
        edges[here, k] = padded[at[here] + k]
    return summed(edges, np.ones(len(at), np.int64))


def _range_of(parts: int, *words: np.ndarray) -> np.ndarray:
    h = np.full(len(words[0]), 7, np.uint64)
    for w in words:
        h = (h ^ (w.astype(np.int64) + 1).astype(np.uint64)) * _MIX
        h ^= h >> np.uint64(29)
    return ((h >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)


def _spans(part: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(range, places in it) in the places' order."""
    turn = np.argsort(part, kind="stable")
    found, first = np.unique(part[turn], return_index=True)
    return list(zip(found.tolist(), np.split(turn, first[1:]) if len(turn) else []))


def _zip_edges(edges: np.ndarray) -> bytes:
    """Sorted edges by columns, the first two as differences: second words rise below one first word."""
    columns = edges.T.copy()
    columns[:2] = np.diff(columns[:2], prepend=np.int32(0), axis=1)
    return _zip(columns.ravel())


def _unzip_edges(data: bytes, most: int) -> np.ndarray:
    columns = _unzip(data, np.int32).reshape(most, -1).copy()
    columns[:2] = np.cumsum(columns[:2], axis=1, dtype=np.int32)
    return columns.T


def pairs_of(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, keys) of the words of ``stream`` that a word follows; a key is both numbers in one."""
    at = np.flatnonzero((stream[:-1] >= 0) & (stream[1:] >= 0))
    return at, stream[at].astype(np.int64) << 32 | stream[at + 1]


def _pair_slots(keys: np.ndarray, bits: int) -> np.ndarray:
    h = keys.astype(np.uint64) * _MIX
    return (h ^ h >> np.uint64(32)) * _MIX >> np.uint64(64 - bits)


def broken(stream: np.ndarray, full: np.ndarray, bits: int) -> np.ndarray:
    """``stream`` with a break between two words whose pair has no bit in ``full``."""
    at, keys = pairs_of(stream)
    rare = np.empty(len(at), bool)
    for i in range(0, len(at), 1 << 18):
        slots = _pair_slots(keys[i : i + (1 << 18)], bits)
        rare[i : i + (1 << 18)] = (full[slots >> np.uint64(6)] >> (slots & np.uint64(63))) & np.uint64(1) == 0
    return np.insert(stream, at[rare] + 1, _END)


def _stretches(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """Each block's stream in final numbers, cut at rare words."""

    def run(streams: pa.Table, answers: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if streams.num_rows and answers.num_rows:
            part = _unzip(streams.column("counts")[0].as_py(), np.int32)
            told = dict(zip(answers.column("part").to_pylist(), answers.column("body").to_pylist()))
            final = np.full(len(part) + 1, _END, np.int32)
            for p, places in _spans(part):
                final[places] = _unzip(told[p], np.int32)
            stream = final[_unzip(streams.column("body")[0].as_py(), np.int32)]
            rows.append((streams.column("block")[0].as_py(), _STREAM, _zip(stream), None, None))
        return _table(rows)

    streams = blocks.filter(F.col("part") == _STREAM)
    return stored(streams.groupBy("block").cogroup(words.filter("block >= 0").groupBy("block")).applyInArrow(run, _PACKED), "phrase-stretches")


def _packed_by_range(block: int, grams: np.ndarray, weights: np.ndarray, part: np.ndarray) -> dict[str, list]:
    """Sorted grams of a block with their weights, a row for each range."""
    spans = _spans(part)
    return {
        "block": [block] * len(spans),
        "part": [p for p, _ in spans],
        "body": [_zip_edges(grams[x]) for _, x in spans],
        "counts": [_zip(weights[x]) for _, x in spans],
        "n": [len(x) for _, x in spans],
    }


def _pairs(stretches: DataFrame, parts: int) -> DataFrame:
    """Each block's pairs, parted by range."""

    def run(batches):
        for batch in batches:
            for block, body in zip(batch.column("block").to_pylist(), batch.column("body").to_pylist()):
                keys, counts = np.unique(pairs_of(_unzip(body, np.int32))[1], return_counts=True)
                pairs = np.stack([keys >> 32, keys & 0xFFFFFFFF], axis=1).astype(np.int32)
                yield _packed_by_range(block, pairs, counts.astype(np.int32), _range_of(parts, pairs[:, 0], pairs[:, 1]))

    return arrow_map(stretches, _PACKED, run)


def _frequent_pairs(pairs: DataFrame, params: PhraseParams) -> np.ndarray:
    """A bit for each pair that reaches the least count, at its hash, in 64-bit words. They are merged
    by key on the executors; the driver gets 2**pair_bits / 64 of them at most, at any size."""

    def answer(table: pa.Table) -> pa.Table:
        lists = [_unzip_edges(x, 2).astype(np.int64) for x in table.column("body").to_pylist()]
        keys = np.concatenate([x[:, 0] << 32 | x[:, 1] for x in lists])
        turn = np.argsort(keys, kind="stable")
        keys = keys[turn]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        total = np.add.reduceat(np.concatenate([_unzip(x, np.int32) for x in table.column("counts").to_pylist()])[turn], first, dtype=np.int64)
        slots = np.unique(_pair_slots(keys[first[total >= params.least_count]], params.pair_bits))
        word, start = np.unique(slots >> np.uint64(6), return_index=True)
        ones = np.uint64(1) << (slots & np.uint64(63))
        bits = np.bitwise_or.reduceat(ones, start) if len(start) else ones
        return pa.table({"word": pa.array(word.astype(np.int64)), "bits": pa.array(bits.view(np.int64))})

    own = pairs.select("part", "body", "counts").groupBy("part").applyInArrow(answer, "word long, bits long")
    words = own.groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    full = np.zeros(1 << (params.pair_bits - 6), np.uint64)
    full[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return full


def _edges(stretches: DataFrame, params: PhraseParams, parts: int) -> DataFrame:
    """Each block's edges, parted by the range of their first three words."""
    frequent = stretches.sparkSession.sparkContext.broadcast(_frequent_pairs(_pairs(stretches, parts), params))

    def run(batches):
        for batch in batches:
            for block, body in zip(batch.column("block").to_pylist(), batch.column("body").to_pylist()):
                stream = broken(_unzip(body, np.int32), frequent.value, params.pair_bits)
                edges, weights = edges_of(stream, params.most_words)
                third = edges[:, 2] if params.most_words > 2 else np.full(len(edges), -1)
                yield _packed_by_range(block, edges, weights, _range_of(parts, edges[:, 0], edges[:, 1], third))

    return arrow_map(stretches, _PACKED, run)


def flows(edges: np.ndarray, weights: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(phrases of ``words`` words, flow through each) of sorted, different edges: the edges that
    start with a phrase lie together, those that end with it first."""
    edges, weights = edges[edges[:, words - 1] >= 0], weights[edges[:, words - 1] >= 0]
    if not len(edges):
        return edges[:, :words], weights
    heads = edges[:, :words]
    first = np.flatnonzero(np.append(True, (heads[1:] != heads[:-1]).any(axis=1)))
    return heads[first], np.add.reduceat(weights, first)


def _grams(edges: DataFrame, params: PhraseParams, parts: int) -> DataFrame:
    """(w, k, f): phrases of 2 words and more that are frequent, counted by the flow through them."""
    gram = "w array<int>, f long"

    def triples(table: pa.Table) -> pa.Table:
        lists = [_unzip_edges(x, params.most_words) for x in table.column("body").to_pylist()]
        own, weights = summed(np.concatenate(lists), np.concatenate([_unzip(x, np.int64) for x in table.column("counts").to_pylist()]))
        phrases: list[list[int]] = []
        counts: list[int] = []
        for k in range(3, params.most_words + 1):
            heads, flow = flows(own, weights, k)
            many = flow >= params.least_count
            phrases += heads[many].tolist()
            counts += flow[many].tolist()
        pairs, flow = flows(own, weights, 2)
        found = []
        for p, places in _spans(_range_of(parts, pairs[:, 0], pairs[:, 1])):
            found.append((p, _zip_edges(pairs[places]), _zip(flow[places]), None, None))
        rows = [*((None, None, None, w, f) for w, f in zip(phrases, counts)), *found]
        kinds = {"part": pa.int32(), "body": pa.binary(), "counts": pa.binary(), "w": pa.list_(pa.int32()), "f": pa.int64()}
        columns = zip(*rows) if rows else ((),) * len(kinds)
        return pa.table({name: pa.array(values, kind) for (name, kind), values in zip(kinds.items(), columns)})

    def pairs(table: pa.Table) -> pa.Table:
        lists = [_unzip_edges(x, 2) for x in table.column("body").to_pylist()]
        own, flow = summed(np.concatenate(lists), np.concatenate([_unzip(x, np.int64) for x in table.column("counts").to_pylist()]))
        many = flow >= params.least_count
        return pa.table({"w": pa.array(own[many].tolist(), pa.list_(pa.int32())), "f": pa.array(flow[many], pa.int64())})

    by_range = stored(edges.groupBy("part").applyInArrow(triples, f"part int, body binary, counts binary, {gram}"), "phrase-flows")
    short = by_range.filter("part is not null").select("part", "body", "counts").groupBy("part").applyInArrow(pairs, gram)
    found = short.union(by_range.filter("w is not null").select("w", "f"))
    return stored(found.select("w", F.size("w").alias("k"), "f"), "phrase-grams")


def _word_table(words: DataFrame, parts: int) -> DataFrame:
    """(id, lang, word, f) of the frequent words."""

    def run(batches):
        for batch in batches:
            for part, body, counts, n in zip(*(batch.column(c).to_pylist() for c in ("part", "body", "counts", "n"))):
                keys = [k.rsplit(b"\t", 1) for k in _unzip_words(body, n).to_pylist()]
                yield {
                    "id": (np.arange(n) * parts + part).astype(np.int32),
                    "lang": [k[0].decode("utf-8", "surrogatepass") for k in keys],
                    "word": [k[1].decode("utf-8", "surrogatepass") for k in keys],
                    "f": _unzip(counts, np.int64),
                }

    listed = words.filter("block = -1 and n > 0").select("part", "body", "counts", "n")
    return stored(arrow_map(listed, "id int, lang string, word string, f long", run), "phrase-vocabulary")


def exact_score(a: Column, n: Column, l: Column, r: Column) -> Column:
    """floor(1000 a n / (l r)) in whole numbers of up to 38 digits."""
    whole = [c.cast("decimal(17,0)") for c in (a, n, l, r)]
    above = F.lit(1000).cast("decimal(4,0)") * (whole[0] * whole[1]).cast("decimal(34,0)")
    parts = F.struct(above.alias("above"), (whole[2] * whole[3]).cast("decimal(34,0)").alias("below"))
    return F.call_function("div", parts["above"], parts["below"]).cast("long")


def unbranched(grams: DataFrame) -> DataFrame:
    """``grams`` (w, k, f) without those that lie on a longer one with the same count: the flow of
    such a node has no other way. A longer phrase that holds it has at most its count, and so has
    every phrase between the two, so looking one word further to each side sees all of them."""
    longer = grams.filter("k > 2").select(F.explode(F.array(F.expr("slice(w, 1, k - 1)"), F.expr("slice(w, 2, k - 1)"))).alias("w"), F.col("f").alias("through"))
    through = longer.groupBy("w").agg(F.max("through").alias("through"))
    return grams.join(through, "w", "left").filter("through is null or through < f").drop("through")


def collocations(docs: DataFrame, params: PhraseParams | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score and k (words before the weakest cut) of the phrases.

    A-Z are lowered; texts fall into pieces at [.,;:!?] and line ends, pieces into words at spaces
    and tabs. n counts a language's words, a the phrase's occurrences in pieces (overlapping ones
    too), l and r those of its two sides at the cut with the lowest floor(1000 a n / (l r)), of
    several the first. Phrases inside a longer one that is as frequent are left out. Null languages
    are ``und``; null, empty and wordless texts add nothing; repeated rows count each by itself.
    Ranks follow score, then a, both falling, then the phrase's bytes. An empty table gives no rows;
    other columns are not looked at.
    """
    params = params or PhraseParams()
    if not 2 <= params.most_words <= 16:
        raise ValueError("phrases have 2 to 16 words")
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = min(4096, pieces(rows.agg(F.sum(F.length("text"))).first()[0], params.range_chars))
    blocks = _blocks(rows, params, parts)
    words = _frequent_words(blocks.filter("part >= 0"), params, parts)
    grams = _grams(_edges(_stretches(blocks, words), params, parts), params, parts)
    vocabulary = _word_table(words, parts)
    totals = blocks.filter(F.col("part") == _LANG).groupBy(F.decode("body", "utf-8").alias("lang")).agg(F.sum("n").alias("n"))
    counted = stored(grams.select("w", "f").union(vocabulary.select(F.array("id").alias("w"), "f")), "phrase-counts")
    kept = stored(unbranched(grams), "phrase-kept").select("w", "k", F.col("f").alias("a"))
    cuts = kept.select("*", F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    cuts = cuts.select("w", "a", "cut", F.expr("slice(w, 1, cut)").alias("lw"), F.expr("slice(w, cut + 1, k - cut)").alias("rw"), F.col("w")[0].alias("id"))
    sides = cuts.join(counted.select(F.col("w").alias("lw"), F.col("f").alias("l")), "lw").join(counted.select(F.col("w").alias("rw"), F.col("f").alias("r")), "rw")
    placed = sides.join(vocabulary.select("id", "lang"), "id").join(totals, "lang")
    scored = placed.select("w", "lang", "a", "n", F.struct(exact_score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("score"), "cut", "l", "r").alias("side"))
    weakest = scored.groupBy("w", "lang", "a", "n").agg(F.min("side").alias("side"))
    spelt = kept.select("w", F.posexplode("w").alias("pos", "id")).join(vocabulary.select("id", "word"), "id").groupBy("w")
    spelt = spelt.agg(F.concat_ws(" ", F.expr("transform(array_sort(collect_list(struct(pos, word))), x -> x.word)")).alias("phrase"))
    found = weakest.join(spelt, "w").select("lang", "phrase", "a", "side.l", "side.r", "n", "side.score", F.col("side.cut").alias("k"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order))
    if params.top is not None:
        ranked = ranked.filter(F.col("rank") <= params.top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", F.col("k").cast("long").alias("k"))
