import random

import numpy as np
import pytest

from tallyguard.llm import family_links as fl
from tallyguard.llm import minhash_join as mj
from tallyguard.llm.frames import WordHashes, shingle_hashes, words_of
from tallyguard.llm.jaccard_join import JoinParams, near_duplicate_components
from tallyguard.llm.minhash_join import SignatureParams, hash_orders, lookup_keys, near_duplicates, signature

SCHEMA = "doc_id long, text string, unit int, n string, h double"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x", 2.0) for d, t in rows], SCHEMA)


def shingles(text):
    w = words_of(text)
    span = min(5, len(w))
    return {tuple(w[i : i + span]) for i in range(len(w) - span + 1)} if w else set()


def brute(rows, num):
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
            if di == dj and a and b or both and 100 * both >= num * len(a | b):
                parent[find(i)] = find(j)
    low = {}
    key = lambda d: (d is not None, d or 0)
    for i, (d, _) in enumerate(sets):
        low[find(i)] = min((low.get(find(i), d), d), key=key)
    return sorted(((d, len(s), low[find(i)], d == low[find(i)]) for i, (d, s) in enumerate(sets)), key=str)


def family(count, seed, words=110, changes=4):
    """Copies of one text with up to ``changes`` words changed: some linked, some just not."""
    rnd = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    out = []
    for i in range(count):
        copy = list(base)
        for k in rnd.sample(range(words), rnd.randint(0, changes)):
            copy[k] = f"n{rnd.randrange(50)}" if rnd.random() < 0.3 else f"n{i}x{k}"
        out.append(" ".join(copy))
    return out


def test_components_against_all_pairs(spark):
    rnd = random.Random(11)
    texts = family(90, 1) + family(30, 2, 40, 2)
    for _ in range(20):
        base = [rnd.choice("abcdefgh") + str(rnd.randrange(40)) for _ in range(rnd.randrange(1, 80))]
        texts += [" ".join(base), " ".join([*base[:-1], "z"]), " ".join([*base, "y", "x"])]
    texts += ["", None, " \t\n", "one", "One", "a b c d", "A  b\tc\nd"] + [texts[0]] * 20
    rnd.shuffle(texts)
    rows = [*enumerate(texts, 100), (None, texts[3]), (None, "a b c d"), (100, "quite another text of seven words"), (100, texts[50])]
    found = near_duplicates(frame(spark, rows), SignatureParams(many=3)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found), key=str) == brute(rows, 85)


def test_texts_are_dealt_once_and_only_those_in_use_are_kept(spark, monkeypatch):
    read = []

    def told(own):
        return lambda texts, *rest: (read.append(texts), own(texts, *rest))[1]

    for name in ("_full_sets", "shingle_sets"):
        monkeypatch.setattr(mj, name, told(getattr(mj, name)))
    pair = [" ".join(f"p{i}" for i in range(60)), " ".join(f"p{i}" for i in range(59))]
    lone = [" ".join(f"l{k}x{i}" for i in range(30)) for k in range(50)]
    rows = [*enumerate(family(12, 4, changes=1) + pair + lone), (12, "quite another text of seven words")]
    found = near_duplicates(frame(spark, rows), SignatureParams(many=3)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found), key=str) == brute(rows, 85)
    assert len(read) == 2
    for texts in read:
        # Read from the stored part, not joined out of all rows again.
        assert texts.inputFiles() and all("/texts-" in f for f in texts.inputFiles())
        assert 0 < texts.count() <= 12 + 3


def test_no_rows(spark):
    assert near_duplicates(frame(spark, [])).count() == 0
    found = near_duplicates(frame(spark, [(1, None), (2, "")])).collect()
    assert sorted(tuple(r) for r in found) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_every_pair_within_the_distance_meets(spark):
    params = SignatureParams(positions=12, chunks=3, errors=1)
    rnd = np.random.default_rng(1)
    rows = []
    for i in range(200):
        one = rnd.integers(0, 4, 12, dtype=np.uint8)
        two = one.copy()
        two[rnd.choice(12, params.distance, replace=False)] += 1
        rows += [(2 * i, one.tobytes()), (2 * i + 1, two.tobytes())]
    df = spark.createDataFrame([(i, bytearray(s)) for i, s in rows], "unit long, sig binary")
    keys = {r[0]: {*r[1:]} for r in df.select("unit", *lookup_keys(df.sig, params)).collect()}
    assert params.distance == 5 and all(keys[2 * i] & keys[2 * i + 1] for i in range(200))
    with pytest.raises(ValueError):
        SignatureParams(positions=64, chunks=13)


def test_positions_differ_as_often_as_sets(spark):
    params = SignatureParams()
    orders, hashes = hash_orders(params), WordHashes()
    differ = []
    for seed in range(40):
        one = shingle_hashes([b"%d-%d" % (seed, i) for i in range(304)], hashes)
        a, b = one[:276], one[24:]  # 252 of 300 shared
        x, y = (np.frombuffer(signature(np.unique(s), orders, 8), np.uint8) for s in (a, b))
        differ.append((x != y).mean())
    assert abs(np.mean(differ) - (1 - 252 / 300) * 255 / 256) < 0.02
    assert max(differ) * params.positions <= params.distance


def test_family_work_grows_in_proportion(spark, monkeypatch):
    made = {}
    plain = fl.stored

    def counted(df, label, *by):
        out = plain(df, label, *by)
        made[label] = made.get(label, 0) + out.count()
        return out

    monkeypatch.setattr(fl, "stored", counted)
    sizes = []
    for count in (200, 400):
        made.clear()
        rows = list(enumerate(family(count, count)))
        near_duplicate_components(frame(spark, rows), JoinParams()).count()
        sizes.append(sum(made.values()))
    assert sizes[1] < 2.6 * sizes[0]


def test_members_are_in_few_families(spark, monkeypatch):
    made, plain = [], fl.stored

    def counted(df, label, *by):
        out = plain(df, label, *by)
        made.append((label, out.count()))
        return out

    monkeypatch.setattr(fl, "stored", counted)
    rows = list(enumerate(family(200, 5)))
    found = near_duplicate_components(frame(spark, rows), JoinParams()).collect()
    assert sorted(tuple(r) for r in found) == sorted(b[:3] for b in brute(rows, 75))
    # One family, in one band of sizes or two.
    members = [n for label, n in made if label == "differences"]
    assert 0 < sum(members) <= 2 * len(rows)


def test_families_over_bands_of_sizes(spark):
    rnd = random.Random(9)
    texts = [" ".join(f"b{i}" for i in range(rnd.randint(8, 60))) for _ in range(60)]
    texts += [f"{t} {rnd.choice('xyz')}" for t in texts[:30]]
    rows = list(enumerate(texts))
    found = near_duplicate_components(frame(spark, rows), JoinParams(many=3)).collect()
    assert sorted(tuple(r) for r in found) == sorted(b[:3] for b in brute(rows, 75))


def test_crowds_of_some_dozen_are_paired(spark, monkeypatch):
    made, plain = [], fl.stored
    monkeypatch.setattr(fl, "stored", lambda df, label, *by: made.append(label) or plain(df, label, *by))
    rows = list(enumerate(family(40, 3)))
    for params, families in ((SignatureParams(), False), (SignatureParams(many=3, dense=3), True)):
        found = near_duplicates(frame(spark, rows), params).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found), key=str) == brute(rows, 85)
        assert ("differences" in made) == families


def test_differences_decide_links():
    """The bound on which families rest, for all pairs of small sets and any centre."""
    rule, rnd = fl.LinkRule(75, 100), random.Random(2)
    g = lambda x, d: 175 * len(d) - 25 * len(x)
    for _ in range(3000):
        a, b, centre = (frozenset(rnd.sample(range(12), rnd.randint(1, 10))) for _ in range(3))
        da, db = a ^ centre, b ^ centre
        assert rule.linked(len(a), len(b), len(a & b)) == (g(a, da) + g(b, db) <= rule.twice * len(da & db))
