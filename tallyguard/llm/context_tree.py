"""Language-model scores by context-tree weighting.

Bytes are decomposed into eight binary decisions. Every context of 0 to DEPTH preceding bytes has,
for each decision, a Krichevsky-Trofimov estimate from the training texts; each node of the tree
weighs its own estimate against its children's, and a prediction mixes all depths along its path.

After training, a byte's probability depends on it and the DEPTH bytes before it alone (a gram). So
texts are packed into blocks as they are read; each block lists its distinct words by hash range, and
its distinct grams parted by the two nearest context bytes, with training counts. Each range adds up
the blocks' counts and answers every block in the order of its words; each part of grams also weighs
its subtrees and answers with the values of the block's grams. No table that grows with the corpus is
broadcast or collected; what the driver sees and broadcasts has 256 * 255 rows at most.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyguard.llm.frames import arrow_map, pieces, stored, words_of

DEPTH = 5
_HALF = float(np.log(0.5))
_SEEN = "block long, packed binary, range int, words binary, part int, grams binary, counts binary"
_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, n_bytes long, base_score double, score double"


@dataclass(frozen=True)
class TreeParams:
    """``folds``: rows whose crc32(doc_id as text) modulo it is 0 are held out. ``smoothing`` is
    that of the token baseline. Sizes only cut the work into parts."""

    folds: int = 10
    smoothing: float = 0.1
    block_chars: int = 12 << 20
    chunk_bytes: int = 1 << 20
    range_chars: int = 24 << 20
    most_parts: int = 4096


def coded(words: list[bytes]) -> bytes:
    """The bytes that are scored: words between single spaces, and one line feed for the end. A line
    feed stands in no word, so texts are told apart by what they code to."""
    return b" ".join(words) + b"\n"


def grams_of(data: bytes) -> np.ndarray:
    """For each byte of a run of coded texts: DEPTH bytes before it and itself, big-endian.
    ``data`` starts with DEPTH line feeds, as every text does."""
    a = np.frombuffer(data, np.uint8)
    two = (a[:-1].astype(np.uint16) << np.uint16(8)) | a[1:]
    four = (two[:-2].astype(np.uint32) << np.uint32(16)) | two[2:]
    return (four[:-2].astype(np.uint64) << np.uint64(16)) | two[4:]


class _Chunks:
    """Coded texts joined into chunks; ``own`` marks the bytes that are scored, not the padding."""

    def __init__(self, size: int):
        self.size, self.parts, self.lengths, self.held = size, [], [], 0

    def add(self, data: bytes) -> bool:
        self.parts.append(data)
        self.lengths.append(len(data))
        self.held += len(data)
        return self.held >= self.size

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        """(grams of all scored bytes, bytes per text)."""
        pad = b"\n" * DEPTH
        lengths = np.array(self.lengths, np.int64)
        grams = grams_of(b"".join(pad + p for p in self.parts))
        own = np.ones(len(grams), bool)
        starts = np.cumsum(lengths + DEPTH)[:-1] - DEPTH
        if len(starts):
            own[(starts[:, None] + np.arange(DEPTH)).ravel()] = False
        self.parts, self.lengths, self.held = [], [], 0
        return grams[own], lengths


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    values, index = np.unique(np.concatenate(keys), return_inverse=True)
    return values, np.bincount(index, np.concatenate(counts), len(values)).astype(np.int64)


def _zip(values: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.tobytes())


def _unzip(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def _zip_grams(grams: np.ndarray) -> bytes:
    """Sorted grams as differences."""
    return _zip(np.diff(grams, prepend=np.uint64(0)))


def _unzip_grams(data: bytes) -> np.ndarray:
    return np.cumsum(_unzip(data, np.uint64), dtype=np.uint64)


def _part_of(grams: np.ndarray, parts: int) -> np.ndarray:
    """Part by the two context bytes next to the predicted one: whole subtrees of depth 2."""
    near = (grams >> np.uint64(8)) & np.uint64(0xFFFF)
    return (((near * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def _spans(part: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(part, places in it) by part, places in their order."""
    turn = np.argsort(part, kind="stable")
    found, first = np.unique(part[turn], return_index=True)
    return list(zip(found.tolist(), np.split(turn, first[1:]) if len(turn) else []))


def _range_of(words: list[bytes], ranges: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) % ranges for w in words), np.int64, len(words))


def _zip_words(words: list[bytes]) -> bytes:
    """Words hold no line feed."""
    return zstandard.ZstdCompressor(level=3).compress(b"\n".join(words))


def _unzip_words(data: bytes) -> pa.Array:
    return pa.array(zstandard.ZstdDecompressor().decompress(data).split(b"\n"), pa.binary())


class _Block:
    """Texts of one block with the words and grams that they hold."""

    def __init__(self, params: TreeParams):
        self.params = params
        self.rows: list[tuple] = []
        self.chars = 0
        self.words: dict[bytes, int] = {}
        self.keys, self.counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        self.chunks = {held: _Chunks(params.chunk_bytes) for held in (True, False)}

    def add(self, doc, held: bool, text: str) -> bool:
        """Whether the block is full now."""
        tokens, step = words_of(text), 0 if held else 1
        for token in tokens:
            self.words[token] = self.words.get(token, 0) + step
        self.words[b""] = self.words.get(b"", 0) + step  # the end of a text
        if self.chunks[held].add(coded(tokens)):
            self._count(held)
        self.rows.append((doc, held, text))
        self.chars += len(text)
        return self.chars >= self.params.block_chars

    def _count(self, held: bool) -> None:
        if self.chunks[held].parts:
            grams, n = np.unique(self.chunks[held].take()[0], return_counts=True)
            self.keys.append(grams)
            self.counts.append(np.zeros_like(n) if held else n)
            if len(self.keys) > 8:
                merged = _added(self.keys, self.counts)
                self.keys, self.counts = [merged[0]], [merged[1]]

    def listed(self, block: int, ranges: int, parts: int) -> dict[str, list]:
        """One row with the texts, one for each range of the words, one for each part of the grams."""
        self._count(True)
        self._count(False)
        grams, n = _added(self.keys, self.counts)
        spans = _spans(_part_of(grams, parts))
        words, held = list(self.words), np.fromiter(self.words.values(), np.int64, len(self.words))
        ranged = _spans(_range_of(words, ranges))
        w, g = len(ranged), len(spans)
        sink = pa.BufferOutputStream()
        texts = pa.table({"doc_id": pa.array([r[0] for r in self.rows], pa.int64()), "held_out": [r[1] for r in self.rows], "text": pa.array([r[2] for r in self.rows], pa.large_string())})
        with pa.ipc.new_stream(sink, texts.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
            out.write_table(texts)
        return {
            "block": [block] * (1 + w + g),
            "packed": [sink.getvalue().to_pybytes(), *[None] * (w + g)],
            "range": [None, *(r for r, _ in ranged), *[None] * g],
            "words": [None, *(_zip_words([words[i] for i in at.tolist()]) for _, at in ranged), *[None] * g],
            "part": [*[None] * (1 + w), *(p for p, _ in spans)],
            "grams": [*[None] * (1 + w), *(_zip_grams(grams[at]) for _, at in spans)],
            "counts": [None, *(_zip(held[at]) for _, at in ranged), *(_zip(n[at]) for _, at in spans)],
        }


def _blocks(docs: DataFrame, doc_id: str, text: str, params: TreeParams) -> tuple[DataFrame, int]:
    """(blocks of the texts as they are read, whatever rows they hold; number of word ranges).
    Written once, so their numbers and contents stay as they are."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0]
    parts, ranges = (min(params.most_parts, pieces(chars, size)) for size in (params.block_chars, params.range_chars))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % params.folds == 0, F.lit(True))

    def run(batches):
        from pyspark import TaskContext

        number, block = TaskContext.get().partitionId() << 32, _Block(params)
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held_out", "text"))):
                if block.add(*row):
                    yield block.listed(number, ranges, parts)
                    number, block = number + 1, _Block(params)
        if block.rows:
            yield block.listed(number, ranges, parts)

    return stored(arrow_map(rows.select("doc_id", held.alias("held_out"), "text"), _SEEN, run), "blocks"), ranges


# --- the tree -------------------------------------------------------------------------------------


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series at x + 8, taken back by the recurrence."""
    low = np.ones_like(x)
    for k in range(8):
        low = low * (x + k)
    y = x + 8.0
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(low)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


@dataclass
class Level:
    """Nodes of one depth: context bytes (nearest first) << 8 | decision prefix, counts, log
    probability of the subtree, and each node's place one level up."""

    keys: np.ndarray
    n0: np.ndarray
    n1: np.ndarray
    log_pw: np.ndarray
    up: np.ndarray | None = None

    def weight(self) -> np.ndarray:
        """What the node gives its own estimate; the rest goes to its children."""
        return np.exp(_HALF + log_kt(self.n0, self.n1) - self.log_pw)

    def estimate(self, bit: np.ndarray | int, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        n0, n1 = self.n0[at], self.n1[at]
        return (np.where(bit, n1, n0) + 0.5) / (n0 + n1 + 1.0)


def above(child: Level) -> tuple[np.ndarray, ...]:
    """(nodes one depth less, sums of their children's counts and log probabilities, each child's
    place among them)."""
    keys, up = np.unique(((child.keys >> np.uint64(16)) << np.uint64(8)) | (child.keys & np.uint64(255)), return_inverse=True)
    return keys, *(np.bincount(up, x, len(keys)) for x in (child.n0, child.n1, child.log_pw)), up


def weighed(keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray) -> Level:
    """A level from its children's sums."""
    return Level(keys, n0, n1, np.logaddexp(_HALF + log_kt(n0, n1), _HALF + below))


def parent_level(child: Level) -> Level:
    """One depth less: counts and log probabilities of the children add up."""
    *sums, child.up = above(child)
    return weighed(*sums)


def nearest_first(grams: np.ndarray) -> np.ndarray:
    """Context bytes from the nearest to the farthest, then the byte itself."""
    g = grams.view(np.uint64) if grams.dtype == np.int64 else grams
    out = g & np.uint64(255)
    for k in range(1, DEPTH + 1):
        out = out | (((g >> np.uint64(8 * k)) & np.uint64(255)) << np.uint64(8 * (DEPTH + 1 - k)))
    return out


def deepest_level(grams: np.ndarray, n: np.ndarray) -> tuple[Level, np.ndarray, np.ndarray]:
    """(level, node of each gram and decision, bit of each gram and decision)."""
    keys, byte = nearest_first(grams), grams.astype(np.int64) & 255
    j = np.arange(8)
    prefix = (1 << j) | (byte[:, None] >> (8 - j))
    bit = ((byte[:, None] >> (7 - j)) & 1).astype(bool).ravel()
    nodes = ((keys >> np.uint64(8))[:, None] << np.uint64(8)) | prefix.astype(np.uint64)
    keys, at = np.unique(nodes.ravel(), return_inverse=True)
    weights = np.repeat(n.astype(np.float64), 8)
    n1 = np.bincount(at, weights * bit, len(keys))
    n0 = np.bincount(at, weights, len(keys)) - n1
    return Level(keys, n0, n1, log_kt(n0, n1)), at, bit


def subtree(grams: np.ndarray, n: np.ndarray) -> tuple[list[Level], np.ndarray, np.ndarray]:
    """Levels DEPTH to 2 of the grams, with the deepest's nodes and bits."""
    level, at, bit = deepest_level(grams, n)
    levels = [level]
    for _ in range(DEPTH - 2):
        levels.append(parent_level(levels[-1]))
    return levels, at, bit


@dataclass
class Top:
    """By depth-1 node (256 * 255 at most): what depths 0 and 1 add to a zero's and a one's
    probability, and the weight that is left for the depths below."""

    keys: np.ndarray
    zero: np.ndarray
    one: np.ndarray
    rest: np.ndarray


def top_of(level: Level) -> Top:
    """From all nodes of depth 2."""
    return top_from(parent_level(level))


def top_from(first: Level) -> Top:
    """From all nodes of depth 1."""
    root = parent_level(first)
    w1, w0 = first.weight(), root.weight()[first.up]
    mixed = [w0 * root.estimate(bit, first.up) + (1 - w0) * w1 * first.estimate(bit) for bit in (0, 1)]
    return Top(first.keys, mixed[0], mixed[1], (1 - w0) * (1 - w1))


def log10_probabilities(grams: np.ndarray, n: np.ndarray, top: Top) -> np.ndarray:
    """log10 of each gram's last byte after its context; ``grams`` holds whole subtrees of depth 2."""
    levels, at, bit = subtree(grams, n)
    path = [at]
    for level in levels[:-1]:
        path.append(level.up[path[-1]])
    two = levels[-1].keys[path[-1]]
    above = np.searchsorted(top.keys, ((two >> np.uint64(16)) << np.uint64(8)) | (two & np.uint64(255)))
    p, rest = np.where(bit, top.one[above], top.zero[above]), top.rest[above]
    for depth, level in zip(range(2, DEPTH + 1), reversed(levels)):
        nodes = path[DEPTH - depth]
        own = level.estimate(bit, nodes)
        if depth == DEPTH:
            p = p + rest * own
        else:
            w = level.weight()[nodes]
            p, rest = p + rest * w * own, rest * (1 - w)
    return np.log10(p).reshape(-1, 8).sum(axis=1)


def word_counts(asked: DataFrame) -> DataFrame:
    """For rows (block, range, words, counts): to each block the counts of its words over all blocks,
    in its order; and for each range one row without a block, with the words' total and the number
    of those that were counted at all."""

    def answer(table: pa.Table) -> pa.Table:
        lists = [_unzip_words(x) for x in table.column("words").to_pylist()]
        coded = pa.concat_arrays(lists).dictionary_encode()
        index = coded.indices.to_numpy()
        total = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(total, index, np.concatenate([_unzip(x, np.int64) for x in table.column("counts").to_pylist()]))
        own = np.split(total[index], np.cumsum([len(x) for x in lists])[:-1])
        blocks, range_ = table.column("block").to_pylist(), table.column("range")[0].as_py()
        more = [None] * len(blocks)
        return pa.table({
            "block": pa.array([*blocks, None], pa.int64()),
            "range": pa.array([range_] * (len(blocks) + 1), pa.int32()),
            "counts": pa.array([*map(_zip, own), None], pa.binary()),
            "total": pa.array([*more, int(total.sum())], pa.int64()),
            "known": pa.array([*more, int((total > 0).sum())], pa.int64()),
        })

    return asked.groupBy("range").applyInArrow(answer, "block long, range int, counts binary, total long, known long")


def _part_grams(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(each block's grams, all different grams of the part, their training counts)."""
    own = [_unzip_grams(x) for x in table.column("grams").to_pylist()]
    return own, *_added(own, [_unzip(x, np.int64) for x in table.column("counts").to_pylist()])


def gram_values(asked: DataFrame) -> DataFrame:
    """(block, grams, logp) for rows (block, part, grams, counts): log10 of each gram's probability
    under the tree that all counts make."""
    node = "key long, n0 double, n1 double, below double"

    def lower(table: pa.Table) -> pa.Table:
        _, grams, n = _part_grams(table)
        keys, n0, n1, below, _ = above(subtree(grams, n)[0][-1])
        return pa.table({"key": keys.view(np.int64), "n0": n0, "n1": n1, "below": below})

    # Nodes of depth 1: 256 * 255 at most, whatever the corpus.
    nodes = asked.groupBy("part").applyInArrow(lower, node).groupBy("key").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "below"))).orderBy("key").toArrow()
    keys, n0, n1, below = (nodes.column(c).to_numpy() for c in ("key", "n0", "n1", "below"))
    sent = asked.sparkSession.sparkContext.broadcast(top_from(weighed(keys.view(np.uint64), n0, n1, below)))

    def upper(table: pa.Table) -> pa.Table:
        own, grams, n = _part_grams(table)
        logp = log10_probabilities(grams, n, sent.value)
        found = [_zip(logp[np.searchsorted(grams, x)]) for x in own]
        return pa.table({"block": table.column("block"), "grams": table.column("grams"), "logp": pa.array(found, pa.binary())})

    return asked.groupBy("part").applyInArrow(upper, "block long, grams binary, logp binary")


class GramTable:
    """Values by gram with open addressing, looked up for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self.bits = max(8, int(len(keys) * 6).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        slot = self._slot(keys)
        while len(left):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]
            lost = self.slots[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = self.slots[slot]
        wrong = np.flatnonzero(self.keys[found] != keys)
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & ((1 << self.bits) - 1)
            found[wrong] = self.slots[slot[wrong]]
            if (found[wrong] < 0).any():
                raise KeyError("a gram that its block did not list")
            wrong = wrong[self.keys[found[wrong]] != keys[wrong]]
        return self.values[found]


def _score_block(params: TreeParams, ranges: int, n_train: int, distinct: int):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(_SCORES))
    whole = n_train + params.smoothing * (distinct + 1)

    def run(packed: pa.Table, values: pa.Table) -> pa.Table:
        rows: dict[str, list] = {f.name: [] for f in target}
        if not packed.num_rows:
            return pa.Table.from_arrays([pa.array([], f.type) for f in target], schema=target)
        texts = pa.ipc.open_stream(packed.column("packed")[0].as_py()).read_all()
        is_word = values.column("range").is_valid().to_pylist()
        told = zip(is_word, *(values.column(c).to_pylist() for c in ("range", "counts")))
        told = {r: c for known, r, c in told if known}
        grams = values.filter(values.column("grams").is_valid())
        # The block's words in the order in which it listed them, found again in its texts.
        index: dict[bytes, int] = {}
        for text in texts.column("text").to_pylist():
            for token in words_of(text):
                index.setdefault(token, len(index))
            index.setdefault(b"", len(index))
        counts = np.empty(len(index), np.int64)
        for r, at in _spans(_range_of(list(index), ranges)):
            counts[at] = _unzip(told[r], np.int64)
        logs = np.log10((counts + params.smoothing) / whole)
        table = GramTable(
            np.concatenate([_unzip_grams(x) for x in grams.column("grams").to_pylist()]),
            np.concatenate([_unzip(x, np.float64) for x in grams.column("logp").to_pylist()]),
        )
        chunk = _Chunks(params.chunk_bytes)

        def close() -> None:
            if chunk.parts:
                found, lengths = chunk.take()
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                rows["score"] += np.add.reduceat(table[found], starts).tolist()

        for doc, held, text in zip(*(texts.column(n).to_pylist() for n in ("doc_id", "held_out", "text"))):
            tokens = words_of(text)
            at = np.fromiter(map(index.__getitem__, tokens), np.int64, len(tokens))
            at = np.append(at, index[b""])
            data = coded(tokens)
            rows["doc_id"].append(doc)
            rows["held_out"].append(held)
            rows["n_tokens"].append(len(at))
            rows["n_known"].append(int((counts[at] > 0).sum()))
            rows["n_bytes"].append(len(data))
            rows["base_score"].append(float(logs[at].sum()))
            if chunk.add(data):
                close()
        close()
        return pa.Table.from_arrays([pa.array(rows[f.name], f.type) for f in target], schema=target)

    return run


def score_documents(docs: DataFrame, params: TreeParams | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, n_bytes, train_tokens, base_score, score and
    bits_per_byte for every row.

    Tokens are words between ASCII white space, A-Z lowered, and one end. Null and empty texts are
    an end alone. Rows with a null id are held out. Repeated rows are scored, and learned from, each
    by itself. Without training rows all counts are 0 and every binary decision has probability
    one half. An empty table gives no rows; other columns are not looked at.
    """
    params = params or TreeParams()
    seen, ranges = _blocks(docs, doc_id, text, params)
    counts = stored(word_counts(seen.filter("range is not null").select("block", "range", "words", "counts")), "word-counts")
    n_train, distinct = counts.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("known"), F.lit(0))).first()
    answers = gram_values(seen.filter("part is not null").select("block", "part", "grams", "counts"))
    none = F.lit(None).cast("binary")
    values = (
        counts.filter("block is not null")
        .select("block", "range", "counts", none.alias("grams"), none.alias("logp"))
        .unionByName(answers.select("block", F.lit(None).cast("int").alias("range"), none.alias("counts"), "grams", "logp"))
    )
    packed = seen.filter("packed is not null").select(F.col("block").alias("own"), "packed")
    scored = packed.groupBy("own").cogroup(values.groupBy("block")).applyInArrow(_score_block(params, ranges, int(n_train), int(distinct)), _SCORES)
    return scored.select("*", F.lit(int(n_train)).cast("long").alias("train_tokens"), (-F.col("score") * F.log2(F.lit(10.0)) / F.col("n_bytes")).alias("bits_per_byte"))
