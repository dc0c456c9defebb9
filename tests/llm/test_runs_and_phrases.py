import random
from collections import Counter

import pyarrow as pa
import pytest

from tallyguard.llm import collocations as co
from tallyguard.llm import periodic_runs as pr
from tallyguard.llm.collocations import PhraseParams, collocations, exact_score
from tallyguard.llm.periodic_runs import RunParams, collapsed, periodic_runs, runs_of

SCHEMA = "doc_id long, text string, lang string, runs string, n int, w string"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(d, t, lang, "x", 1, "y") for d, t, lang in rows], schema)


# --- runs -----------------------------------------------------------------------------------------


def brute_runs(words, least_words=6, repeats=4):
    found = {}
    for p in range(1, len(words)):
        i = 0
        while i < len(words) - p:
            j = i
            while j < len(words) - p and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(least_words, repeats * p):
                found[i, j - i + p] = min(p, found.get((i, j - i + p), p))
            i = max(j, i + 1)
    return sorted((s, n, p) for (s, n), p in found.items())


@pytest.mark.parametrize("params", [RunParams(), RunParams(2, 2), RunParams(9, 3)])
def test_runs_against_all_periods(params):
    rnd = random.Random(3)
    for _ in range(150):
        texts = []
        for _ in range(rnd.randint(1, 6)):
            letters = [b"a", b"b", b"c", b"d", b"e"][: rnd.randint(1, 5)]
            words = [rnd.choice(letters) for _ in range(rnd.randint(0, 60))]
            if words and rnd.random() < 0.5:
                words += words[: rnd.randint(1, 8)] * rnd.randint(1, 9) + words[:5]
            texts.append(words)
        assert runs_of(texts, params) == [brute_runs(t, params.least_words, params.least_repeats) for t in texts]


def test_one_word_repeated_and_many_left_words():
    assert runs_of([[b"a"] * 5000, [], [b"a"] * 5], RunParams()) == [[(0, 5000, 1)], [], []]
    assert runs_of([[x for i in range(2000) for x in (b"%d" % i, b"a", b"b", b"c", b"d", b"e")]], RunParams()) == [[]]
    with pytest.raises(ValueError):
        RunParams(least_repeats=1)


def test_collapsed_keeps_each_first_period():
    words = b"x a b a b a b a b y".split()
    assert collapsed(words, runs_of([words], RunParams())[0]) == b"x a b y".split()


def test_run_rows(spark):
    rows = [(1, "A b A b A b A b", "en"), (1, None, None), (None, "", "en"), (2, " \t\n ", "en"), (3, "a a a a a a z " * 2, "en"), (3, "a a a a a a z " * 2, "en")]
    found = periodic_runs(frame(spark, rows)).collect()
    told = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in found)
    twice = ("3", 14, [(0, 6, 1), (7, 6, 1)], "a z a z")
    assert told == sorted([("1", 8, [(0, 8, 2)], "A b"), ("1", 0, [], ""), ("None", 0, [], ""), ("2", 0, [], ""), twice, twice])
    assert periodic_runs(frame(spark, [])).count() == 0


class Batch:
    """A record batch that tells how many rows are asked for at once."""

    def __init__(self, batch, asked):
        self.batch, self.asked, self.num_rows = batch, asked, batch.num_rows

    def slice(self, at, rows):
        return Batch(self.batch.slice(at, rows), self.asked)

    def column(self, name):
        self.asked.append(self.num_rows)
        return self.batch.column(name)


def test_texts_are_held_in_small_parts(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(pr, "arrow_map", lambda rows, schema, run: (taken.append(run), rows)[1])
    periodic_runs(frame(spark, []), RunParams(chunk_words=700))
    ids = list(range(2500))
    whole = pa.record_batch({"doc_id": ids, "text": [f"x{i} " + "a b " * (i % 7) for i in ids]})
    asked = []
    out = list(taken[0](iter([Batch(whole, asked)])))
    assert max(asked) <= 1000
    assert [d for part in out for d in part["doc_id"]] == ids
    assert [len(r) for part in out for r in part["runs"]] == [int(i % 7 >= 4) for i in ids]


# --- phrases --------------------------------------------------------------------------------------


def brute_phrases(rows, least, top=2000, most=5):
    counts, totals = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for end in ".,;:!?\n\x0b\x0c\r":
            low = low.replace(end, "\n")
        for piece in low.split("\n"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            totals[lang] += len(words)
            for k in range(1, most + 1):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, held in counts.items():
        many = {g: f for g, f in held.items() if len(g) > 1 and f >= least}
        inside = set()
        for g, f in many.items():
            for i in range(len(g)):
                for j in range(i + 2, len(g) + 1):
                    if j - i < len(g) and f >= held[g[i:j]]:
                        inside.add(g[i:j])
        scored = []
        for g, a in many.items():
            if g not in inside:
                score, k = min((1000 * a * totals[lang] // (held[g[:k]] * held[g[k:]]), k) for k in range(1, len(g)))
                scored.append((-score, -a, " ".join(g).encode(), held[g[:k]], held[g[k:]], k))
        for rank, (s, a, g, left, right, k) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, g.decode(), -a, left, right, totals[lang], -s, k))
    return sorted(out)


def test_phrases_against_counting(spark, monkeypatch):
    rnd = random.Random(5)
    fixed = [["new", "york", "city"], ["the", "end", "of", "the", "day", "is"], ["a", "a", "a", "a"], ["É", "ñu"]]
    rows = []
    for i in range(160):
        words = []
        for _ in range(rnd.randint(0, 40)):
            words += rnd.choice(fixed) if rnd.random() < 0.3 else [rnd.choice("abcdefgh") + rnd.choice(["", "", "X", ".", ",", "!\n"])]
        text = rnd.choice([" ", "  ", "\t"]).join(words)
        rows.append((i % 50, text, rnd.choice(["en", "fr", "und", None, "odd\tlang\n"])))
    rows += [(1, None, "en"), (2, "", None), (3, "...", "xx"), (4, "\x1c \x00 a", "en")]
    params = PhraseParams(least_count=6, top=40, block_chars=900, range_chars=1500)
    found = sorted(tuple(r) for r in collocations(frame(spark, rows), params).collect())
    assert found == brute_phrases(rows, 6, 40) and len(found) > 40
    assert collocations(frame(spark, []), params).count() == 0


@pytest.mark.parametrize("bits", [6, 26])
def test_rare_pairs_move_no_edges(spark, monkeypatch, bits):
    rnd = random.Random(8)
    names = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*rnd.sample(names, 40), "a", "b", "c"]), "en") for i in range(60)]
    moved, grams = [], co._grams

    def counted(edges, *rest):
        edges = edges.cache()
        moved.append(edges.agg({"n": "sum"}).first()[0])
        return grams(edges, *rest)

    monkeypatch.setattr(co, "_grams", counted)
    found = sorted(tuple(r) for r in collocations(frame(spark, rows), PhraseParams(least_count=20, block_chars=3000, range_chars=4000, pair_bits=bits)).collect())
    assert found == brute_phrases(rows, 20) and [r[2] for r in found] == ["a b c"]
    # Every word is frequent, of the pairs in 2520 places only two; bits that pairs share let some more through.
    blocks = -(-sum(len(r[1]) for r in rows) // 3000) + 8
    assert moved[0] <= 2 * blocks or bits == 6


def test_flow_counts_shorter_phrases():
    import numpy as np

    stream = np.array([1, 2, 3, 1, 2, 3, 4, -1, 1, 2, -1, 3], np.int32)
    edges, weights = co.edges_of(stream, 3)
    counted = {tuple(w): n for k in (2, 3) for w, n in zip(co.flows(edges, weights, k)[0].tolist(), co.flows(edges, weights, k)[1].tolist())}
    assert counted == {(1, 2): 3, (2, 3): 2, (3, 1): 1, (3, 4): 1, (1, 2, 3): 2, (2, 3, 1): 1, (3, 1, 2): 1, (2, 3, 4): 1}
    assert (co._unzip_edges(co._zip_edges(edges), 3) == edges).all()


def test_score_is_exact_beyond_64_bits(spark):
    rows = [(10**10, 9 * 10**11, 10**10 + 1, 10**10 + 3), (7, 10**12, 11, 13), (100, 10**6, 100, 100)]
    df = spark.createDataFrame(rows, "a long, n long, l long, r long")
    found = [r[0] for r in df.select(exact_score(df.a, df.n, df.l, df.r)).collect()]
    assert found == [1000 * a * n // (left * right) for a, n, left, right in rows]
