import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyguard.llm import toxicity as tox
from tallyguard.llm.frames import small


@pytest.fixture(scope="module")
def tables(spark):
    rnd = random.Random(3)
    syllables = "ka lo mi ne ru so ta ve zi pa".split()
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randrange(1, 4)))
    docs, labels = [], []
    for i in range(600):
        words = [word() for _ in range(rnd.randrange(5, 80))]
        bad = i % 4 == 0
        if bad:
            for _ in range(rnd.randrange(1, 4)):
                words.insert(rnd.randrange(len(words)), rnd.choice(["grumblefig", "Snarkwort", "gr0mbly"]))
        docs.append((i, " ".join(words), "x", 1.0))
        if i % 3:
            labels.append((i, 1, int(bad)))
    docs += [(1000, None, None, None), (1001, "", "x", 0.0), (None, "grumblefig", "x", 0.0), (1, "a second text", "x", 1.0)]
    labels += [(None, 0, 1), (2, 1, None), (1, 0, 0)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, tox_hits string, y double"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_held_out_rows(tables):
    docs, labels = tables
    model = tox.fit(docs, labels)
    assert {"grum", "snar"} <= {t[:4] for t in model.weights}
    found = tox.score(docs.drop("tox_hits"), model, keep=("doc_id", "y")).withColumn("held", tox.held_out())
    rows = [r for r in found.filter("held and doc_id is not null and doc_id < 600").collect()]
    wrong = [r for r in rows if (r.tox_score >= 0.5) != (r.doc_id % 4 == 0)]
    assert len(rows) > 80 and not wrong
    values = {r.doc_id: r.tox_score for r in found.filter("doc_id >= 1000").collect()}
    assert values[1000] == values[1001] < 0.5
    assert found.count() == docs.count()


def test_held_out_labels_are_never_read(tables):
    docs, labels = tables
    turned = labels.withColumn("toxic", F.when(tox.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert tox.fit(docs, labels) == tox.fit(docs, turned)


def test_no_labels_and_no_rows(spark, tables):
    docs, labels = tables
    model = tox.fit(docs, labels.limit(0))
    assert model.weights == tox.SEED
    assert tox.score(docs.limit(0), model).count() == 0
    hits = lambda t: tox.lexicon_hits(t, tox.build_automaton(model))[1]
    assert hits("You 1D10T, what a ѕtupid plan") == 2
    assert hits("Take the trash can out") == 0 and hits("trash canal") == 1
    assert hits("ridiot") == 0 and hits("idiotic IDIOT!") == 2
    assert hits(None) == hits("") == 0


def test_sample_is_bounded(tables):
    docs, labels = tables
    small = tox.ToxicityParams(max_rows_per_class=30, min_docs=1)
    assert tox._sample(docs, labels, small, 5).groupBy("y").count().agg(F.max("count")).first()[0] <= 30
    assert tox.fit(docs, labels, small).weights


def test_capped_sample_keeps_the_balance_of_the_labels(spark):
    """The marker stands in half of the toxic texts and in 8 % of the clean ones, and 3 % are toxic."""
    rnd = random.Random(5)
    rows = [(i, int(rnd.random() < 0.03)) for i in range(4000)]
    text = lambda y: "some plain words" + " grumblefig" * (rnd.random() < (0.5 if y else 0.08))
    docs = spark.createDataFrame([(i, text(y)) for i, y in rows], "doc_id long, text string")
    labels = spark.createDataFrame(rows, "doc_id long, toxic int")
    marked = spark.createDataFrame([(1, "some plain words grumblefig")], "doc_id long, text string")
    scores = []
    for cap in (20_000, 200):
        model = tox.fit(docs, labels, tox.ToxicityParams(min_log_odds=1.0, max_rows_per_class=cap))
        assert any(t.startswith("grum") for t in model.weights)
        scores.append(tox.score(marked, model).first().tox_score)
    assert scores[0] < 0.3 and abs(scores[1] - scores[0]) < 0.15


def test_long_text(spark):
    model = tox.ToxicityModel(dict(tox.SEED), (-4.0, 2.0, 1.0), tox.ToxicityParams())
    text = "word " * 200_000
    clean, bad = (tox.score(spark.createDataFrame([(1, t)], "doc_id long, text string"), model).first() for t in (text, text + "idiot"))
    assert clean.tox_hits == 0 and bad.tox_hits == 1 and bad.tox_score >= clean.tox_score


def test_counts_handed_on_early_add_up(tables, monkeypatch):
    docs, labels = tables
    whole = tox.fit(docs, labels)
    monkeypatch.setattr(tox, "_TERMS_HELD", 5)
    assert tox.fit(docs, labels) == whole


def test_hits_by_brute_force():
    """Every term tried at every place where a word starts; texts of few letters, so terms overlap."""
    rnd = random.Random(11)
    draw = lambda low, high: "".join(rnd.choice("abo") for _ in range(rnd.randrange(low, high)))
    for _ in range(60):
        weights = {draw(4, 8): rnd.uniform(1, 5) for _ in range(12)} | {"=" + draw(1, 10): rnd.uniform(1, 5) for _ in range(12)}
        phrases = [f"{draw(1, 5)} {draw(1, 5)}", draw(3, 5)]
        model = tox.ToxicityModel(weights, (0.0, 0.0, 0.0), tox.ToxicityParams(exceptions=phrases))
        text = "".join(rnd.choice([draw(1, 9), " ", ", ", "\u0430b0", "A"]) for _ in range(120))
        folded = tox.fold(text)
        first = [i for i in range(len(folded)) if folded[i].isalpha() and not (i and folded[i - 1].isalpha())]
        over = lambda i, word: i + len(word) == len(folded) or not folded[i + len(word)].isalpha()
        spared = {j for p in phrases for i in first if folded.startswith(p, i) and over(i, p) for j in range(i, i + len(p))}
        best = {}
        for i in first:
            fits = [w for t, w in weights.items() if folded.startswith(t.removeprefix("="), i) and (t[0] != "=" or over(i, t[1:]))]
            if fits and i not in spared:
                best[i] = max(fits)
        total, hits, length = tox.lexicon_hits(text, tox.build_automaton(model))
        assert (hits, length) == (len(best), len(folded)) and total == pytest.approx(sum(best.values()))


def test_short_and_long_words_count(spark):
    """Marks of two letters, and words that part after their eighth letter only."""
    rows = [(i, "plain words here " + ("zq xanthophyllous" if i % 4 == 0 else "za xanthophyllite"), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = tox.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert set(model.weights) == {"=zq", "=xanthophyllous"}


def test_a_kept_text_goes_to_the_workers_once(spark, tables):
    docs, labels = tables
    model = tox.fit(docs, labels)
    alone = {(r.doc_id, r.tox_score) for r in tox.score(docs, model).collect()}
    kept = tox.score(docs, model, keep=("doc_id", "text"))
    assert kept.columns == ["doc_id", "text", "tox_score", "tox_hits", "tox_weight"]
    assert {(r.doc_id, r.tox_score) for r in kept.collect()} == alone
    assert sorted(map(str, (r.text for r in kept.collect()))) == sorted(map(str, (r.text for r in docs.collect())))
    assert "__text" not in kept._jdf.queryExecution().toString()


def test_batches_are_cut_small():
    batches = [pa.record_batch({"x": list(range(a, b))}) for a, b in ((0, 2500), (2500, 2500), (2500, 2507))]
    cut = list(small(iter(batches)))
    assert [b.num_rows for b in cut] == [1000, 1000, 500, 7]
    assert [x for b in cut for x in b.column("x").to_pylist()] == list(range(2507))
