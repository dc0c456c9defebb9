import hashlib
import random

from tallyguard.llm.line_dedup import drop_repeated_lines, keep_bitmaps, line_keys, unpack
from tallyguard.llm.url_filter import UrlRules, judge_urls, vocabulary_hits

SCHEMA = "doc_id long, text string, lang string, `keep` string, pos int, kind string"


def brute(rows, min_chars=40, min_docs=5):
    def key(line):
        out = line.strip(" \t\n\x0b\x0c\r")
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in out)

    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(doc)
    result = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        stay = [
            x
            for x in lines
            if len(holders.get(key(x), ())) < min_docs or doc == max(holders[key(x)], key=lambda d: (d is not None, d or 0))
        ]
        result.append((doc, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(result, key=str)


def mine(spark, rows, partitions=None, **params):
    frame = spark.createDataFrame([(d, t, None, "x", 1, "y") for d, t in rows], SCHEMA)
    if partitions:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = drop_repeated_lines(frame, **params).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert all(r["keep"] == "x" and r["pos"] == 1 and r["kind"] == "y" for r in found)
    return sorted(((r.doc_id, r.line_count, r.lines_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in found), key=str)


def corpus():
    rnd = random.Random(5)
    shared = [f"Shared line number {i} that is long enough to be counted, {'é' * (i % 3)}" for i in range(12)]
    rows = []
    for doc in range(60):
        lines = [f"own line {doc} {i}" * 3 for i in range(rnd.randrange(4))]
        lines += rnd.sample(shared, rnd.randrange(6)) + [shared[0].upper() + "  \t"] * rnd.randrange(3)
        rnd.shuffle(lines)
        rows.append((doc, "\n".join(lines)))
    return rows + [(None, shared[0] + "\n" + shared[1]), (70, None), (71, ""), (72, "\n\n"), (3, shared[2]), (3, shared[2])]


def test_lines_against_brute_force(spark):
    assert mine(spark, corpus()) == brute(corpus())


def test_hot_line_over_many_partitions(spark):
    rows = [(d, "one line that every document of the corpus holds, over and over\nmy own " + str(d)) for d in range(400)]
    assert mine(spark, rows, partitions=16) == brute(rows)


def test_small_runs_at_partition_edges(spark):
    rows = [(d, f"line {d % 30} is held by several documents of this little corpus") for d in range(180)]
    for n in (3, 31, 64):
        assert mine(spark, rows, partitions=n) == brute(rows)


def test_no_rows_and_bitmaps(spark):
    assert mine(spark, []) == []
    rows = [(d, "short\n" + "x" * 50 + "\nend") for d in range(6)]
    found = keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc for r in found) == [0, 1, 2, 3, 4]
    assert all(unpack(r.keep, r.n_lines).tolist() == [True, False, True] for r in found)


def test_key_length_counts_code_points():
    assert line_keys("é" * 39)[1] == [] and len(line_keys("é" * 40)[1]) == 1
    assert line_keys(None) == (1, []) and line_keys("a\n")[0] == 2


def verdicts(spark, urls, rules=None):
    rows = [(i, u, "h", "v", 7) for i, u in enumerate(urls)]
    frame = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string, soft_hits int")
    found = judge_urls(frame, rules=rules).collect()
    return [(r.host, r.path, r.rule, r.verdict) for r in sorted(found, key=lambda r: r.page_id)]


def test_urls(spark):
    assert verdicts(spark, [None, "", "no scheme", "HTTP://WWW.Example.COM/en/x?y#z", "a://example.com/en/", "a://x.example.com/en/"]) == [
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        ("example.com", "/en/", "example.com/en/", "block"),
        ("x.example.com", "/en/", "example.com/en/", "block"),
    ]
    assert verdicts(spark, ["a://b.com", "a://b.net/es/1", "a://notnet/es/", "a://x.net/de/", "a://b.com?q"]) == [
        ("b.com", "", None, "allow"),
        ("b.net", "/es/1", "net/es/", "block"),
        ("notnet", "/es/", None, "allow"),
        ("x.net", "/de/", None, "allow"),
        ("b.com", "", None, "allow"),
    ]
    assert [v[3] for v in verdicts(spark, ["a://casino-win.org/", "a://casinowin.org/", "a://free-bets.org/", "a://free.org/free", "a://freebets.org"])] == [
        "block", "allow", "block", "allow", "allow",
    ]
    assert verdicts(spark, []) == []
    assert verdicts(spark, ["a://casino.org/"] * 2, UrlRules(rules=[], strict=[], soft={})) == [("casino.org", "/", None, "allow")] * 2


def test_vocabulary_in_the_whole_url(spark):
    urls = ["https://a.org/out?to=casino-xxx", "https://a.org/#/porn", "CASINO-porn.org/xxx", "a.org/?free=1&bet=2", "a.org/pornhouse?xxxl"]
    assert verdicts(spark, urls) == [
        ("a.org", "/out", None, "block"),
        ("a.org", "/", None, "block"),
        ("", "", None, "block"),
        ("", "", None, "block"),
        ("", "", None, "allow"),
    ]
    assert verdicts(spark, ["a://b.com/?q=casino", "a://b.com/x#porn"]) == [("b.com", "/", "com/", "allow"), ("b.com", "/x", "com/", "allow")]


def test_vocabulary_boundaries():
    found = UrlRules().automaton()
    assert vocabulary_hits("xxx.pornhouse-porn_x", found) == {"xxx", "porn", "x"}
    assert vocabulary_hits("", found) == set()
