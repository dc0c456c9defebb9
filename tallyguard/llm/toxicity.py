"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

The lexicon holds whole words and word beginnings (stems). Its weights are log odds from labelled rows, counted by
Spark; a small seed list stands in where no labels are given. A text is folded first (lower case,
homoglyphs, digits written for letters), matches inside exception phrases do not count, and the
summed weight is divided by a power of the text's length before a logistic curve maps it to 0..1.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyguard.llm.frames import arrow_map, small, stored

# Look-alike letters and digits or signs written for letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "һ": "h", "ԁ": "d",
    "ο": "o", "ι": "i", "κ": "k", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "α": "a", "ѵ": "v", "ɡ": "g", "ɩ": "i", "ꞁ": "l",
    "０": "0", "１": "1", "３": "3", "４": "4", "５": "5", "７": "7",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

# Seed words, and phrases in which such a word means no harm.
SEED = {
    "idiot": 3.0, "moron": 3.0, "stupid": 2.0, "loser": 2.5, "scum": 3.0, "trash": 1.5, "clown": 1.5,
    "pathetic": 2.0, "worthless": 2.0, "disgusting": 2.0,
}
EXCEPTIONS = [
    "trash can", "trash bin", "trash collection", "clown fish", "class clown", "circus clown", "pond scum",
    "sore loser", "stupid mistake", "idiot proof",
]


#: Terms that a task counts before it hands the counts on, to be added up by Spark.
_TERMS_HELD = 1 << 16


@dataclass(frozen=True)
class ToxicityParams:
    """``max_rows_per_class`` bounds the labelled sample that weights and curve are fitted on, whatever
    the size of the corpus, and with it the lexicon: a term needs ``min_docs`` toxic rows of it and
    ``min_evidence``, the log likelihood ratio of its labels against those of all rows."""

    max_rows_per_class: int = 20_000
    min_docs: int = 5
    min_log_odds: float = 3.0
    min_evidence: float = 10.0
    stem: tuple[int, int] = (4, 8)
    length_power: float = 0.5
    exceptions: list[str] = field(default_factory=lambda: list(EXCEPTIONS))


@dataclass(frozen=True)
class ToxicityModel:
    """Term (see ``terms``) -> weight, and the logistic curve's intercept and slopes (summed weight, share)."""

    weights: dict[str, float]
    curve: tuple[float, float, float]
    params: ToxicityParams


_FOLD = str.maketrans({**HOMOGLYPHS, **DIGITS, **{h: DIGITS[d] for h, d in HOMOGLYPHS.items() if d in DIGITS}})


_LETTERS = re.compile(r"[^\W\d_]+")


def fold(text: str | None) -> str:
    """Lower case, look-alikes and digits folded to letters; no text gives an empty one."""
    return (text or "").lower().translate(_FOLD)


def terms(text: str | None, stem: tuple[int, int]) -> set[str]:
    """What a folded text can be known by: its whole words of any length, written ``=word``, and the
    beginnings of its words of ``stem[0]`` to ``stem[1]`` letters."""
    low, high = stem
    words = set(_LETTERS.findall(fold(text)))
    return {f"={w}" for w in words} | {w[:k] for w in words for k in range(low, min(high, len(w)) + 1)}


def build_automaton(model: ToxicityModel) -> ahocorasick.Automaton:
    """Values are (length, weight at the beginning of a word, weight as a whole word, spares)."""
    entries: dict[str, tuple[float, float, bool]] = {}
    for term, weight in model.weights.items():
        word = term.removeprefix("=")
        begins, whole, _ = entries.get(word, (0.0, 0.0, False))
        entries[word] = (begins, weight, False) if term != word else (weight, whole, False)
    for phrase in map(fold, model.params.exceptions):
        entries[phrase] = (*entries.get(phrase, (0.0, 0.0))[:2], True)
    found = ahocorasick.Automaton()
    for word, entry in entries.items():
        found.add_word(word, (len(word), *entry))
    if len(found):
        found.make_automaton()
    return found


def lexicon_hits(text: str | None, automaton: ahocorasick.Automaton) -> tuple[float, int, int]:
    """(summed weight, matched words, folded length). A match starts where a word starts; of the
    terms that fit one word the heaviest counts; a word inside an exception phrase counts nothing."""
    folded = fold(text)
    if not len(automaton):
        return 0.0, 0, len(folded)
    best: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (size, begins, whole, spares) in automaton.iter(folded):
        start = end - size + 1
        if start and folded[start - 1].isalpha():
            continue
        ends = end + 1 == len(folded) or not folded[end + 1].isalpha()
        if spares and ends:
            spared.append((start, end))
        weight = max(begins, whole) if ends else begins
        if weight > best.get(start, 0.0):
            best[start] = weight
    if spared:
        inside = {at for at in best for a, b in spared if a <= at <= b}
        best = {at: w for at, w in best.items() if at not in inside}
    return math.fsum(best.values()), len(best), len(folded)


def features(total: float, hits: int, length: int, power: float) -> tuple[float, float]:
    """Two length-normalised values: summed weight, and hits per 1000 code points (both as logs)."""
    scaled = (length / 1000.0 + 0.1) ** power
    return math.log1p(total / scaled), math.log1p(hits / (length / 1000.0 + 0.1))


def probability(curve: tuple[float, float, float], x: tuple[float, float]) -> float:
    z = curve[0] + curve[1] * x[0] + curve[2] * x[1]
    return 1.0 / (1.0 + math.exp(-max(-40.0, min(40.0, z))))


def fit(docs: DataFrame, labels: DataFrame, params: ToxicityParams | None = None, folds: int = 5) -> ToxicityModel:
    """Learn weights and curve from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic 0 or 1)
    outside the held-out fold.

    At most ``max_rows_per_class`` ids of each label take part, those with the smallest hash. The
    curve counts each of them for its share of all ids of its label, so it has the labels' own
    balance whatever part of them is sampled. Rows
    without a label or an id are left out; an id labelled both ways counts as toxic; of rows that
    repeat an id one takes part. Without rows of both labels, the seed lexicon and a fixed curve
    are used.
    """
    params = params or ToxicityParams()
    sample = stored(_sample(docs, labels, params, folds), "toxicity-sample")
    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n1 or not n0:
        return ToxicityModel(dict(SEED), (-4.0, 2.0, 1.0), params)

    def count(batches):
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def told() -> dict[str, list]:
            known = list(seen[0].keys() | seen[1].keys())
            out = {"term": known, "neg": [seen[0][t] for t in known], "pos": [seen[1][t] for t in known]}
            for counter in seen:
                counter.clear()
            return out

        for batch in small(batches):
            for body, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                seen[y].update(terms(body, params.stem))
                if len(seen[0]) + len(seen[1]) > _TERMS_HELD:
                    yield told()
        yield told()

    # The sample bounds this: at most 2 * max_rows_per_class texts' terms, added up by term.
    odds = F.log((F.col("pos") + 0.5) / F.lit(n1 + 1.0)) - F.log((F.col("neg") + 0.5) / F.lit(n0 + 1.0))
    in_toxic = F.col("pos") * F.log(F.col("pos") * (n0 + n1) / ((F.col("pos") + F.col("neg")) * n1))
    in_clean = F.when(F.col("neg") == 0, 0.0).otherwise(F.col("neg") * F.log(F.col("neg") * (n0 + n1) / ((F.col("pos") + F.col("neg")) * n0)))
    chosen = (
        arrow_map(sample, "term string, neg long, pos long", count)
        .groupBy("term")
        .agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
        .filter((F.col("pos") >= params.min_docs) & (in_toxic + in_clean >= params.min_evidence))
        .withColumn("weight", odds)
        .filter(F.col("weight") >= params.min_log_odds)
        .select("term", "weight")
        .collect()
    )
    weights = {r["term"]: float(r["weight"]) for r in chosen} or dict(SEED)
    model = ToxicityModel(weights, (0.0, 0.0, 0.0), params)

    def measure(batches, automaton):
        for batch in small(batches):
            x = [features(*lexicon_hits(t, automaton), params.length_power) for t in batch.column("text").to_pylist()]
            yield {"a": [v[0] for v in x], "b": [v[1] for v in x], "y": batch.column("y")}

    rows = arrow_map(sample, "a double, b double, y int", measure, lambda: build_automaton(model)).groupBy("a", "b", "y").count().collect()
    totals = {r["y"]: r["count"] for r in _marked(labels, folds).groupBy("y").count().collect()}
    stands_for = {y: total / sizes[y] for y, total in totals.items()}
    return ToxicityModel(weights, _logistic(rows, stands_for), params)


def _marked(labels: DataFrame, folds: int) -> DataFrame:
    """Every labelled id outside the held-out fold, once, with its label."""
    return (
        labels.filter(F.col("toxic").isin(0, 1) & ~held_out(folds))
        .groupBy(F.col("doc_id").alias("id"))
        .agg(F.max("toxic").cast("int").alias("y"))
    )


def _sample(docs: DataFrame, labels: DataFrame, params: ToxicityParams, folds: int) -> DataFrame:
    """The labelled texts with the smallest hashes of their ids: a fixed number, whatever comes in.
    Ids are chosen before texts are read, so the list that is broadcast has that bound too."""
    marked = _marked(labels, folds).withColumn("h", F.xxhash64("id"))
    ids = [marked.filter(F.col("y") == y).orderBy("h", "id").limit(params.max_rows_per_class) for y in (0, 1)]
    chosen = F.broadcast(ids[0].unionByName(ids[1]).select("id", "y"))
    texts = docs.select(F.col("doc_id").alias("id"), "text").join(chosen, "id")
    return texts.groupBy("id", "y").agg(F.min("text").alias("text")).select("text", "y")


def _logistic(rows: list, stands_for: dict[int, float]) -> tuple[float, float, float]:
    """Newton steps for a ridge logistic curve over the sample's (value, value, label, count), where
    a row of a label stands for so many."""
    rows = sorted(rows, key=lambda r: (r["a"], r["b"], r["y"]))
    x = np.array([[1.0, r["a"], r["b"]] for r in rows])
    y = np.array([float(r["y"]) for r in rows])
    n = np.array([r["count"] * stands_for[r["y"]] for r in rows])
    w, ridge = np.zeros(3), np.diag([1e-6, 1e-2, 1e-2])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (n * (y - p)) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def score(df: DataFrame, model: ToxicityModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with tox_score (0 to 1), tox_hits and tox_weight for every row; input columns
    of these three names are replaced.

    Null and empty texts get the curve's value at no hit. Every row is scored alone on its whole
    text, so repeated rows get equal scores and an empty table gives an empty one.
    """
    keep = tuple(k for k in keep if k not in ("tox_score", "tox_hits", "tox_weight"))
    rows = df.select(*[F.col(k) for k in keep], *([] if text in keep else [F.col(text).alias("__text")]))
    # A text that is kept goes to the workers once.
    read = text if text in keep else "__text"
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)])

    def run(batches, automaton):
        for batch in small(batches):
            out = {name: batch.column(name) for name in batch.schema.names if name != "__text"}
            found = [lexicon_hits(t, automaton) for t in batch.column(read).to_pylist()]
            out["tox_score"] = [probability(model.curve, features(*f, model.params.length_power)) for f in found]
            out["tox_hits"] = [f[1] for f in found]
            out["tox_weight"] = [f[0] for f in found]
            yield out

    return arrow_map(rows, f"{names}, tox_score double, tox_hits int, tox_weight double", run, lambda: build_automaton(model))


def held_out(folds: int = 5):
    """True for rows of fold 0; a row without an id is in fold 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(True))
