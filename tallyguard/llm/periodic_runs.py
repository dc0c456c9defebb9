"""Periodic runs of words by maximal pairs.

Two equal stretches of a text that start ``p`` words apart and are extended as far as they go, to
the left and to the right, are a maximal pair; where they overlap far enough, both together are one
stretch that repeats with period ``p``. So the maximal pairs whose distance is small against their
length are exactly the runs, and nothing has to be extended.

Maximal pairs come from the tree of LCP intervals of the sorted suffixes, from the deepest interval
upwards. Every interval keeps the starts of its suffixes by the word to their left: where two
intervals meet, starts of different classes are pairs, and their interval's depth is their length.
Suffixes of many texts are sorted at once, by doubling, and only as long as they are not told apart.
Texts never leave the task that reads them.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyguard.llm.frames import arrow_map, small

_OUT = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


@dataclass(frozen=True)
class RunParams:
    """A run has at least ``least_words`` words and ``least_repeats`` periods (2 at least).
    ``chunk_words`` only says how many words are sorted at once."""

    least_words: int = 6
    least_repeats: int = 4
    chunk_words: int = 400_000

    def __post_init__(self):
        if self.least_repeats < 2:
            raise ValueError("a run repeats its period")

    @property
    def least_lcp(self) -> int:
        """Words that a run has in common with itself one period on, at least."""
        return max(1, min(max(self.least_words - p, (self.least_repeats - 1) * p) for p in range(1, self.least_words + 1)))


def suffix_levels(codes: np.ndarray, ends: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(levels, starts in suffix order): level t ranks the stretches of 2**t words from each start.
    Equal ranks are equal stretches; ``ends`` has each start's end of text, which no stretch passes."""

    def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first of each one's group, whether its group has it alone) for sorted keys."""
        first = np.append(True, keys[1:] != keys[:-1])
        return np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0)), first & np.append(first[1:], True)

    order = np.argsort(codes, kind="stable")
    place, alone = groups(codes[order])
    rank = np.empty(len(codes), np.int32)
    rank[order] = place
    levels, open_ = [rank], order[~alone]
    while len(open_):
        after = open_ + (1 << (len(levels) - 1))
        second = np.where(after < ends[open_], rank[np.minimum(after, len(codes) - 1)] + 1, 0)
        keys = (rank[open_].astype(np.int64) << 32) | second
        turn = np.argsort(keys, kind="stable")
        open_, keys = open_[turn], keys[turn]
        place, alone = groups(keys)
        rank = rank.copy()
        rank[open_] = (keys >> 32) + place - groups(keys >> 32)[0]
        levels.append(rank)
        open_ = open_[~alone]
    return levels, np.argsort(rank, kind="stable")


def common_words(levels: list[np.ndarray], ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words the suffixes at ``a`` and at ``b`` start with in common."""
    lcp, last = np.zeros(len(a), np.int64), len(ends) - 1
    for t in range(len(levels) - 1, -1, -1):
        x, y = a + lcp, b + lcp
        inside = (x < ends[a]) & (y < ends[b])
        lcp += (inside & (levels[t][np.minimum(x, last)] == levels[t][np.minimum(y, last)])).astype(np.int64) << t
    return lcp


class _Starts:
    """Starts of an interval's suffixes, in order, and again by the word to their left."""

    __slots__ = ("all", "by_left")

    def __init__(self, start: int, left: int):
        self.all, self.by_left = [start], {left: [start]}

    def near(self, start: int, left: int, reach: int, left_of) -> list[int]:
        """Starts within ``reach`` whose left word is another."""
        lo, hi = bisect_left(self.all, start - reach), bisect_right(self.all, start + reach)
        if hi - lo <= len(self.by_left):
            return [x for x in self.all[lo:hi] if left_of[x] != left]
        out = []
        for other, starts in self.by_left.items():
            if other != left:
                out += starts[bisect_left(starts, start - reach) : bisect_right(starts, start + reach)]
        return out

    def add(self, start: int, left: int) -> None:
        insort(self.all, start)
        insort(self.by_left.setdefault(left, []), start)


def maximal_pairs(starts: list[int], lcps: list[int], left_of, repeats: int):
    """(first, second, length) of the maximal pairs whose distance is at most length / (repeats - 1).

    ``starts`` are suffixes in order, ``lcps`` the words that neighbours have in common, ``left_of``
    the code of the word before a start (of its own kind at a text's start).
    """
    out = []

    def joined(one: _Starts, two: _Starts, depth: int) -> _Starts:
        large, small = (one, two) if len(one.all) >= len(two.all) else (two, one)
        reach = depth // (repeats - 1)
        for start in small.all:
            out.extend((min(x, start), max(x, start), depth) for x in large.near(start, left_of[start], reach, left_of))
        for start in small.all:
            large.add(start, left_of[start])
        return large

    waiting: list[tuple[int, _Starts]] = []
    at = _Starts(starts[0], left_of[starts[0]])
    for start, depth in zip(starts[1:], lcps):
        while waiting and waiting[-1][0] >= depth:
            deeper, before = waiting.pop()
            at = joined(before, at, deeper)
        waiting.append((depth, at))
        at = _Starts(start, left_of[start])
    while waiting:
        depth, before = waiting.pop()
        at = joined(before, at, depth)
    return out


def runs_of(texts: list[list[bytes]], params: RunParams) -> list[list[tuple[int, int, int]]]:
    """For each text (a list of words) its runs (start, length, period), by start, then period."""
    found: list[dict[tuple[int, int], int]] = [{} for _ in texts]
    lengths = np.array([len(t) for t in texts], np.int64)
    if not lengths.sum():
        return [[] for _ in texts]
    coded, base = [], 0
    for words in texts:
        own: dict[bytes, int] = {}
        coded.append(np.fromiter((own.setdefault(w, len(own)) for w in words), np.int64, len(words)) + base)
        base += len(own)
    codes = np.concatenate(coded)
    stops = np.cumsum(lengths)
    text_of = np.repeat(np.arange(len(texts)), lengths)
    ends, firsts = stops[text_of], (stops - lengths)[text_of]
    levels, order = suffix_levels(codes, ends)
    lcps = common_words(levels, ends, order[:-1], order[1:])
    left = np.append(-1, codes[:-1])
    left[firsts == np.arange(len(codes))] = -1
    # Suffixes with too little in common with both neighbours are in no pair that counts.
    linked = lcps >= params.least_lcp
    kept = np.flatnonzero(np.append(linked, False) | np.append(False, linked))
    if not len(kept):
        return [[] for _ in texts]
    starts, with_next = order[kept], np.append(linked, False)[kept]
    depth = np.append(lcps, 0)[kept]
    edge = np.append(0, np.flatnonzero(~with_next)[:-1] + 1)
    tops = np.maximum.reduceat(depth * with_next, edge)
    # Families of suffixes with one left word only, or too far from each other, have no such pair.
    mixed = np.minimum.reduceat(left[starts], edge) != np.maximum.reduceat(left[starts], edge)
    family = np.cumsum(np.append(0, ~with_next[:-1]))
    turn = np.lexsort((starts, family))
    gaps = np.append(np.diff(starts[turn]), 1 << 40)
    gaps[np.append(family[1:] != family[:-1], True)] = 1 << 40
    near = np.minimum.reduceat(gaps, edge) * (params.least_repeats - 1) <= tops
    close = np.append(edge[1:], len(starts))
    for k in np.flatnonzero(mixed & near):
        span = slice(edge[k], close[k])
        here = starts[span].tolist()
        text = text_of[here[0]]
        left_of = dict(zip(here, left[starts[span]].tolist()))
        for one, two, length in maximal_pairs(here, depth[span].tolist()[:-1], left_of, params.least_repeats):
            period = two - one
            if length + period >= max(params.least_words, params.least_repeats * period):
                key = int(one - firsts[one]), int(length + period)
                found[text][key] = min(period, found[text].get(key, period))
    # One stretch can be paired at multiples of its period: the smallest is its period.
    return [sorted((start, length, period) for (start, length), period in runs.items()) for runs in found]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """``words`` without those that a run repeats: of each run its first period stays."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, n in zip(words, np.cumsum(gone).tolist()) if not n]


def periodic_runs(docs: DataFrame, params: RunParams | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, runs and collapsed (the text without repeats, words between single spaces)
    for every row.

    Words are runs of bytes between ASCII white space, as they are written. Null, empty and wordless
    texts have no words and no runs. A run is a stretch with smallest period q that has at least
    ``least_words`` words and ``least_repeats * q`` words, and that no neighbouring word extends.
    Rows are judged one by one: null ids, repeated ids and repeated texts are as any other. An empty
    table gives no rows; other columns are not looked at. A text is held whole by one task, with
    about 100 bytes for each of its words.
    """
    params = params or RunParams()

    def run(batches):
        ids: list = []
        texts: list[list[bytes]] = []
        held = 0

        def flush():
            runs = runs_of(texts, params)
            return {
                "doc_id": list(ids),
                "n_words": [len(t) for t in texts],
                "runs": [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs],
                "collapsed": [b" ".join(collapsed(t, r)).decode("utf-8", "surrogatepass") for t, r in zip(texts, runs)],
            }

        for batch in small(batches):
            for key, value in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = (value or "").encode("utf-8", "surrogatepass").split()
                ids.append(key)
                texts.append(words)
                held += len(words)
                if held >= params.chunk_words or len(ids) >= 10_000:
                    yield flush()
                    ids, texts, held = [], [], 0
        if ids:
            yield flush()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = arrow_map(rows, _OUT, run)
    return found if doc_id == "doc_id" else found.withColumnRenamed("doc_id", doc_id)
