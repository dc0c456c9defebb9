import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tallyguard.llm import imatch
from tallyguard.llm.components import components
from tallyguard.llm.decontaminate import DecontamParams, candidates, contained, contained_items, decontaminate, document_shingles, item_shingles, sketch_size
from tallyguard.llm.jaccard_join import JoinParams, near_duplicate_components, one_of_each

SCHEMA = "doc_id long, text string, id string, unit int, h double"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(d, t, "x", 1, 2.0) for d, t in rows], schema)


def words(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")


def shingles(text):
    w = [x for x in words(text) if x]
    span = min(5, len(w))
    return {tuple(w[i : i + span]) for i in range(len(w) - span + 1)} if w else set()


# --- Jaccard join ---------------------------------------------------------------------------------


def brute_components(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (di, a) in enumerate(sets):
        for j in range(i):
            dj, b = sets[j]
            both = len(a & b)
            if di == dj and a and b or both and 100 * both >= 75 * len(a | b):
                parent[find(i)] = find(j)
    low = {}
    key = lambda d: (d is not None, d or 0)
    for i, (d, _) in enumerate(sets):
        low[find(i)] = min((low.get(find(i), d), d), key=key)
    return sorted(((d, len(s), low[find(i)]) for i, (d, s) in enumerate(sets)), key=str)


def mine(spark, rows, **params):
    found = near_duplicate_components(frame(spark, rows), JoinParams(**params)).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str)


def near_copies():
    rnd = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    passage, rows = text(60), []
    for _ in range(12):
        base = text(rnd.randrange(20, 120))
        for _ in range(rnd.randrange(1, 12)):
            copy = list(base)
            for _ in range(rnd.randrange(0, 6)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            if rnd.random() < 0.3:
                copy = passage + copy
            rows.append(" ".join(copy))
    base = text(100)
    for i in range(60):  # one large group, some of it beyond the threshold
        copy = list(base)
        for _ in range(i % 9):
            copy[rnd.randrange(100)] = f"new{i}"
        rows.append(" ".join(copy))
    rows += ["", None, " \t\n", "one", "One", "one two", "a b c d", "a b c d", "A  b\tc\nd", " ".join(passage)] + [rows[0]] * 20
    rnd.shuffle(rows)
    numbered = list(enumerate(rows, 100))
    return numbered + [(None, rows[3]), (None, "a b c d"), (100, " ".join(text(40))), (100, rows[50])]


def test_components_against_all_pairs(spark):
    rows = near_copies()
    assert mine(spark, rows, block_chars=4000, range_shingles=1000, many=3) == brute_components(rows)


def test_threshold_is_exact(spark):
    # 6 of 8 shingles shared is 0.75 of the union, 5 of 7 is less.
    a = [f"a{i}" for i in range(11)]
    rows = [(1, " ".join(a)), (2, " ".join(a[:10] + ["z"])), (3, " ".join(a[:9] + ["y", "z"])), (4, " ".join(a[1:11]))]
    assert mine(spark, rows) == brute_components(rows)


def test_no_rows(spark):
    assert mine(spark, []) == []
    assert mine(spark, [(1, None), (2, "")]) == [(1, 0, 1), (2, 0, 2)]


def test_one_of_each(spark):
    rows = [(5, "a b c d e f"), (3, "a b c d e f"), (9, "a b c d e g h"), (1, None), (2, "")]
    assert sorted(r.doc_id for r in one_of_each(frame(spark, rows)).collect()) == [1, 2, 3, 9]


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r.node: r.root for r in components(edges).collect()}
    assert all(found[i] == 0 for i in range(41)) and found[101] == 100
    assert components(edges.limit(0)).count() == 0


# --- decontamination ------------------------------------------------------------------------------


def brute_contained(docs, items):
    def merged(rows):
        out = {}
        for i, t in rows:
            out.setdefault(i, []).append(t)
        return out

    texts, result = merged(docs), []
    for item, bodies in merged(items).items():
        wanted = set().union(*map(shingles, bodies))
        spans = {len(x) for x in wanted}
        for doc, whole in texts.items():
            held = set()
            for t in whole:
                w = [x for x in words(t) if x]
                held |= {tuple(w[i : i + n]) for n in spans for i in range(len(w) - n + 1)}
            both = len(wanted & held)
            if wanted and both >= 0.75 * len(wanted):
                result.append((doc, item, both, len(wanted)))
    return sorted(result, key=str)


@pytest.mark.parametrize("bits", [8, 26])
def test_items_against_brute_force(spark, bits):
    rnd = random.Random(4)
    text = lambda n: [f"v{rnd.randrange(500)}" for _ in range(n)]
    items = [(i, " ".join(text(rnd.choice([1, 3, 5, 6, 9, 30, 70])))) for i in range(30)]
    items += [(30, None), (31, ""), (None, "the null item of the list is here"), (2, "another part of item two"), (32, items[5][1])]
    docs = []
    for i in range(80):
        own = text(rnd.randrange(0, 300))
        piece = items[rnd.randrange(30)][1].split(" ")
        cut = rnd.randrange(0, max(1, len(piece) // 3))
        docs.append((i, " ".join(own[:50] + piece[cut:] + own[50:]) if i % 2 else " ".join(own)))
    docs += [(200, None), (201, ""), (None, items[7][1].upper()), (3, items[8][1]), (3, items[8][1])]
    found = contained_items(frame(spark, docs), frame(spark, items, "item_id long, text string, n string, gram int, h double"), DecontamParams(bitmap_bits=bits))
    assert sorted(((r.doc_id, r.item_id, r.shared, r.item_shingles) for r in found.collect()), key=str) == brute_contained(docs, items)


def test_sketches_lose_nothing():
    for n in range(1, 300):
        assert sketch_size(n, 0.75) > n - -(-3 * n // 4)


def test_sketches_decide(spark):
    """A document without the item's sketch is no candidate, a pair that is no candidate is not
    counted, and candidates are few beside the pairs that share a shingle."""
    rnd, params = random.Random(9), DecontamParams()
    items = [(i, " ".join(f"i{i}w{j}" for j in range(40))) for i in range(40)]
    docs = []
    for i in range(400):
        piece = items[i % 40][1].split(" ")
        cut = 40 if i % 4 == 0 else rnd.randrange(6, 30)  # three of four hold too little
        docs.append((i, " ".join([f"d{i}x{j}" for j in range(30)] + piece[:cut])))
    wanted = item_shingles(spark.createDataFrame(items, "item_id long, text string"), params).cache()
    held = document_shingles(frame(spark, docs), wanted, params).cache()
    pairs = candidates(held, wanted).cache()
    true = {(r.doc, r.item) for r in contained(pairs, held, wanted, params).collect()}
    assert true == {(d, i) for d, i, *_ in brute_contained(docs, items)} and len(true) >= 100
    touching = held.join(wanted.withColumnRenamed("id", "item"), ["h", "gram"]).select("doc", "item").distinct().count()
    # 8 of the item's 17 sketch shingles are asked for: about half of the short pieces have fewer.
    assert touching == 400 and len(true) < pairs.count() < 0.65 * touching
    sketch = {(r.id, r.gram) for r in wanted.filter("in_sketch").collect()}
    needed = wanted.first().needed
    lost = sorted(sketch & {(0, r.gram) for r in wanted.filter("id = 0").collect()})[needed - 1 :]
    without = held.filter(~((F.col("doc") == 0) & F.col("gram").isin([gram for _, gram in lost])))
    assert (0, 0) in true and not candidates(without, wanted).filter("doc = 0").count()
    assert {(r.doc, r.item) for r in contained(pairs.filter("doc <> 0"), held, wanted, params).collect()} == true - {(0, 0)}


def test_decontaminate(spark):
    items = spark.createDataFrame([(1, "this very passage is a test item of the benchmark")], "item_id long, text string")
    docs = [(1, "x " * 50 + "This very passage is a test item of the benchmark" + " y" * 50), (2, "nothing of it"), (None, None), (2, "nothing of it")]
    assert sorted(str(r.doc_id) for r in decontaminate(frame(spark, docs), items).collect()) == ["2", "2", "None"]
    assert decontaminate(frame(spark, docs), items.limit(0)).count() == 4
    assert decontaminate(frame(spark, []), items).count() == 0


# --- fingerprints ---------------------------------------------------------------------------------


def fingerprinted(spark, rows, **params):
    return imatch.compare_with_edits(frame(spark, rows), imatch.IMatchParams(**params)).collect()


def test_edits_and_likeness(spark):
    rnd = random.Random(9)
    pool = [f"Term{i}é" for i in range(400)]
    texts = [" ".join(rnd.choice(pool) for _ in range(rnd.randrange(0, 80))) for _ in range(57)]
    rows = [(3 * i, t) for i, t in enumerate(texts)] + [(900, texts[4]), (901, None), (902, ""), (903, "x")]
    found = {r.doc_id: r for r in fingerprinted(spark, rows, bucket=7, commonest=2)}
    assert len(found) == len(rows)
    ordered = sorted(rows)
    for at, (doc, text) in enumerate(ordered):
        following = ordered[(at + 1) % len(ordered)][1] or ""
        text = text or ""
        k = len(text) // 4
        edited = text[: len(text) - k] + following[:k]
        r = found[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert found[900].fingerprint == found[12].fingerprint
    assert found[901].fingerprint == found[902].fingerprint and found[901].near_next == 1.0
    long = [r for r in found.values() if r.n_chars > 200]
    assert sum(r.near_edited for r in long) > 3 * sum(r.near_next for r in long)


def test_repeated_null_and_missing_rows(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (1, "other text"), (None, "null row"), (2, None)]
    found = fingerprinted(spark, rows)
    assert sorted(str(r.doc_id) for r in found) == ["1", "1", "1", "2", "None"]
    assert len({(r.fingerprint, r.edited_sha256) for r in found if r.n_chars == 7}) == 1
    assert fingerprinted(spark, []) == []
    assert len(fingerprinted(spark, [(1, "alone " * 9)])) == 1
