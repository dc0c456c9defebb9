"""SentencePiece encoding and decoding with a given vocabulary.

An Aho-Corasick automaton over all pieces reads the text once; at each position its output links
give the pieces that end there, which relax the best score reached so far. What wins is the
segmentation with the highest sum of piece scores (the library's unigram rule). Text is cut first
where no piece can reach across, and the cuts' results are remembered, within a fixed limit.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyguard.llm.frames import arrow_map, small

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"


@dataclass(frozen=True)
class Vocabulary:
    """(piece, score, kind) by id, where kind is normal, byte, unknown or control."""

    pieces: tuple[tuple[str, float, str], ...]
    unknown: int

    @staticmethod
    def load(path: str = MODEL) -> Vocabulary:
        """Read a .model file on the driver; a vocabulary is configuration and travels with the tasks."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        rows = []
        for i in range(model.get_piece_size()):
            kind = "unknown" if model.is_unknown(i) else "control" if model.is_control(i) else "byte" if model.is_byte(i) else "normal"
            rows.append((model.id_to_piece(i), model.get_score(i), kind))
        return Vocabulary(tuple(rows), model.unk_id())


class Codec:
    """Encodes and decodes texts; built once per Python worker."""

    #: Results of at most so many cuts, each of at most so many code points, are remembered.
    REMEMBERED, LONGEST = 400_000, 64

    def __init__(self, vocabulary: Vocabulary):
        self.automaton = ahocorasick.Automaton()
        self.bytes: dict[int, int] = {}
        self.out: list[bytes] = []
        self.unknown = vocabulary.unknown
        self.letters: set[str] = set()  # code points that are pieces
        lowest, letters = 0.0, set()
        for i, (piece, score, kind) in enumerate(vocabulary.pieces):
            self.out.append(b"")
            if kind == "normal":
                self.automaton.add_word(piece, (len(piece), score, i))
                self.out[i] = piece.replace(SPACE, " ").encode()
                lowest = min(lowest, score)
                letters.update(piece)
                if len(piece) == 1:
                    self.letters.add(piece)
            elif kind == "byte":
                value = int(piece[1:-1], 16)
                self.bytes[value], self.out[i] = i, bytes([value])
            elif kind == "unknown":
                self.out[i] = " ⁇ ".encode()
        self.automaton.make_automaton()
        self.unknown_score = lowest - 10.0
        inner = any(SPACE in p.lstrip(SPACE) for p, _, kind in vocabulary.pieces if kind == "normal")
        apart = "".join(c for c in "\n\t\r" if c not in letters)
        # No piece reaches from a letter to a space after it, nor across a code point of no piece.
        self.cuts = None if inner else re.compile(f"{SPACE}*[^{SPACE}{apart}]+|{SPACE}+" + (f"|[{apart}]" if apart else ""))
        self.known: dict[str, bytes] = {}

    def encode(self, text: str | None) -> np.ndarray:
        """Piece ids; no text and an empty one have none."""
        if not text:
            return np.empty(0, np.int32)
        marked = SPACE + text.replace(" ", SPACE)
        parts = self.cuts.findall(marked) if self.cuts else [marked]
        known = self.known
        return np.frombuffer(b"".join([known.get(p) or self._cut(p) for p in parts]), np.int32)

    def _cut(self, part: str) -> bytes:
        ids = array("i", self.best_path(part)).tobytes()
        if len(part) <= self.LONGEST:
            if len(self.known) >= self.REMEMBERED:
                self.known.clear()
            self.known[part] = ids
        return ids

    def best_path(self, text: str) -> list[int]:
        """Viterbi in one pass over the automaton's matches; of equal scores the longer piece wins."""
        n = len(text)
        best: list[float] = [0.0] + [float("-inf")] * n
        back: list[tuple] = [()] * (n + 1)
        if self.letters.issuperset(text):
            for end, match in self.automaton.iter(text):
                value = best[end + 1 - match[0]] + match[1]
                if value > best[end + 1]:
                    best[end + 1], back[end + 1] = value, match
        else:
            self._relax_with_unknown(text, best, back)
        ids, at = [], n
        while at:
            size, _, i = back[at]
            if i >= 0:
                ids.append(i)
            else:
                ids += [self.bytes.get(b, self.unknown) for b in reversed(text[at - 1].encode())] if self.bytes else [self.unknown]
            at -= size
        return ids[::-1]

    def _relax_with_unknown(self, text: str, best: list[float], back: list[tuple]) -> None:
        """The same, where some code points are no piece of their own and may pass as unknown."""
        matches: list[list[tuple]] = [[] for _ in range(len(text) + 1)]
        for end, match in self.automaton.iter(text):
            matches[end + 1].append(match)
        for at in range(1, len(text) + 1):
            for match in matches[at]:
                value = best[at - match[0]] + match[1]
                if value > best[at]:
                    best[at], back[at] = value, match
            if text[at - 1] not in self.letters and best[at - 1] + self.unknown_score > best[at]:
                best[at], back[at] = best[at - 1] + self.unknown_score, (1, 0.0, -1)

    def decode(self, ids) -> str:
        """Text of the ids; byte pieces are read as UTF-8, the leading space that encoding adds goes."""
        out = self.out
        text = b"".join([out[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def _codec(vocabulary: Vocabulary) -> Codec:
    return Codec(vocabulary)


def _lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
    flat = np.concatenate([np.empty(0, np.int32), *ids])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)).cast(pa.list_(pa.int32()))


def encode(df: DataFrame, vocabulary: Vocabulary | None = None, text: str = "text", into: str = "pieces") -> DataFrame:
    """``df`` with the ids of each whole text in column ``into`` (array of int; a column of that
    name is replaced). Null and empty texts have no ids. Rows are encoded one by one: repeated rows
    get equal ids, an empty table stays empty."""
    vocabulary = vocabulary or Vocabulary.load()
    df = df.drop(into)

    def run(batches, codec):
        for batch in batches:
            out = {n: batch.column(n) for n in batch.schema.names}
            out[into] = _lists([codec.encode(t) for t in batch.column(text).to_pylist()])
            yield out

    return arrow_map(df, f"{_fields(df)}`{into}` array<int>", run, lambda: _codec(vocabulary))


def decode(df: DataFrame, vocabulary: Vocabulary | None = None, pieces: str = "pieces", into: str = "decoded") -> DataFrame:
    """``df`` with the text of the ids in column ``into``; null and empty lists give empty texts.
    Decoding gives back what was encoded, but that a text's own U+2581 becomes a space."""
    vocabulary = vocabulary or Vocabulary.load()
    df = df.drop(into)

    def run(batches, codec):
        for batch in batches:
            out = {n: batch.column(n) for n in batch.schema.names}
            out[into] = [codec.decode(ids.values.to_numpy().tolist() if ids.is_valid else ()) for ids in batch.column(pieces)]
            yield out

    return arrow_map(df, f"{_fields(df)}`{into}` string", run, lambda: _codec(vocabulary))


def _fields(df: DataFrame) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields)


def round_trip(df: DataFrame, vocabulary: Vocabulary | None = None, text: str = "text") -> DataFrame:
    """``df`` with pieces, n_pieces and round_trip (whether decoding gives the text back), in one
    pass; columns of these names are replaced. Rows are handled as in ``encode`` and ``decode``."""
    vocabulary = vocabulary or Vocabulary.load()
    df = df.drop("pieces", "n_pieces", "round_trip")

    def run(batches, codec):
        for batch in small(batches):
            out = {n: batch.column(n) for n in batch.schema.names}
            texts = batch.column(text).to_pylist()
            ids = [codec.encode(t) for t in texts]
            out["pieces"] = _lists(ids)
            out["n_pieces"] = [len(x) for x in ids]
            out["round_trip"] = [codec.decode(x.tolist()) == (t or "") for x, t in zip(ids, texts)]
            yield out

    return arrow_map(df, f"{_fields(df)}pieces array<int>, n_pieces long, round_trip boolean", run, lambda: _codec(vocabulary))
