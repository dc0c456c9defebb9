import math
import random
from collections import Counter

import numpy as np
import pytest

from tallyguard.llm import context_tree as ct
from tallyguard.llm import html_text, sentencepiece_codec
from tallyguard.llm.frames import words_of

# --- context tree ---------------------------------------------------------------------------------


class Tree:
    """Context-tree weighting as the definition has it: one dictionary per depth, counts, then the
    weighted probability of every node by recursion."""

    def __init__(self):
        self.counts = Counter()

    def learn(self, data):
        padded = b"\n" * ct.DEPTH + data
        for i in range(ct.DEPTH, len(padded)):
            for prefix, bit in self.decisions(padded[i]):
                for d in range(ct.DEPTH + 1):
                    self.counts[padded[i - d : i], prefix, bit] += 1

    @staticmethod
    def decisions(byte):
        return [((1 << j) | (byte >> (8 - j)), (byte >> (7 - j)) & 1) for j in range(8)]

    def finish(self):
        self.children = {}
        for context, prefix, _ in self.counts:
            if context:
                self.children.setdefault((context[1:], prefix), set()).add(context)
        self.weighted = {}

    def n(self, context, prefix):
        return self.counts[context, prefix, 0], self.counts[context, prefix, 1]

    def log_kt(self, context, prefix):
        a, b = self.n(context, prefix)
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def log_pw(self, context, prefix):
        key = context, prefix
        if key not in self.weighted:
            own = self.log_kt(context, prefix)
            if len(context) < ct.DEPTH:
                below = sum(self.log_pw(c, prefix) for c in self.children.get(key, ()))
                own = np.logaddexp(own, below) - math.log(2)
            self.weighted[key] = own
        return self.weighted[key]

    def bit(self, context, prefix, bit, depth=0):
        own = context[len(context) - depth :]
        a, b = self.n(own, prefix)
        p = ((b if bit else a) + 0.5) / (a + b + 1)
        if depth == ct.DEPTH:
            return p
        w = math.exp(self.log_kt(own, prefix) - math.log(2) - self.log_pw(own, prefix))
        return w * p + (1 - w) * self.bit(context, prefix, bit, depth + 1)

    def log10(self, data):
        padded = b"\n" * ct.DEPTH + data
        return sum(
            math.log10(self.bit(padded[i - ct.DEPTH : i], prefix, bit))
            for i in range(ct.DEPTH, len(padded))
            for prefix, bit in self.decisions(padded[i])
        )


def held(doc):
    import zlib

    return doc is None or zlib.crc32(str(doc).encode()) % 10 == 0


def brute(rows):
    words = {i: words_of(t) for i, (_, t) in enumerate(rows)}
    train = Counter()
    tree = Tree()
    for i, (doc, _) in enumerate(rows):
        if not held(doc):
            train.update([*words[i], b""])
            tree.learn(ct.coded(words[i]))
    tree.finish()
    total, distinct = sum(train.values()), len(train)
    out = []
    for i, (doc, _) in enumerate(rows):
        tokens = [*words[i], b""]
        base = sum(math.log10((train[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in tokens)
        out.append((doc, held(doc), len(tokens), sum(train[t] > 0 for t in tokens), total, base, tree.log10(ct.coded(words[i]))))
    return sorted(out, key=str)


def scored(spark, rows, **params):
    frame = spark.createDataFrame([(d, t, 1, 2.0) for d, t in rows], "doc_id long, text string, block int, score double")
    found = ct.score_documents(frame, ct.TreeParams(**params)).collect()
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found), key=str)


def same(mine, theirs):
    assert [m[:5] for m in mine] == [t[:5] for t in theirs]
    assert np.allclose([m[5:] for m in mine], [t[5:] for t in theirs], rtol=1e-9)


def test_scores_against_definition(spark):
    rnd = random.Random(1)
    words = "the of and a Être naïve tion ing er that 你好 x1".split()
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 9))) + rnd.choice(["", "\n", "  \tEnd"])) for i in range(30)]
    rows += [(40, None), (41, ""), (None, "the end"), (5, "the of"), (5, "the of"), (42, "unseenword")]
    same(scored(spark, rows, block_chars=200, chunk_bytes=100), brute(rows))


def test_probabilities_of_a_byte_add_up():
    grams = ct.grams_of(b"\n" * ct.DEPTH + b"abracadabra abracadabra")
    seen, n = np.unique(grams, return_counts=True)
    context = int(seen[3]) >> 8
    every = np.array([(context << 8) | byte for byte in range(256)], np.uint64)
    keys = np.union1d(seen, every)
    counts = np.zeros(len(keys), np.int64)
    counts[np.searchsorted(keys, seen)] = n
    levels, _, _ = ct.subtree(keys, counts)
    logs = ct.log10_probabilities(keys, counts, ct.top_of(levels[-1]))
    assert math.isclose((10 ** logs[np.searchsorted(keys, every)]).sum(), 1.0, rel_tol=1e-9)


def test_no_rows_and_no_training(spark):
    assert scored(spark, []) == []
    rows = [(None, "abc")]
    same(scored(spark, rows), brute(rows))


# --- html -----------------------------------------------------------------------------------------

GOOD = "This is the story of the town and of the people that live in it, as it was told to me by one of them when we had the time for it. " * 2


def pages():
    nav = "<nav><ul>" + "".join(f"<li><a href='/{i}'>Menu point {i}</a></li>" for i in range(5)) + "</ul></nav>"
    yield f"<html><head><title>T</title><style>p{{}}</style></head><body>{nav}<article><h1>Head &amp; line</h1><p>{GOOD}</p><p>Short one.</p></article><footer>&copy; us</footer>", f"Head & line\n{GOOD.strip()}\nShort one."
    yield f"<body>{nav}<div class='x'><h2>Head</h2><p>{GOOD}<p>Between.<p>{GOOD}</div><div class='sidebar'><p>{GOOD}</p></div>", f"Head\n{GOOD.strip()}\nBetween.\n{GOOD.strip()}"
    yield f"<div id=cookie-notice><p>{GOOD}</p></div><main><p>{GOOD}</p><form><p>{GOOD}</p></form><div class='comments'><p>{GOOD}</p></div></main>", GOOD.strip()
    yield f"<p>{GOOD}<script>var a='</p>';</script> tail<br>line", GOOD.strip() + " tail line"
    yield f"<article><p>a  b\n\tc&nbsp;&lt;d&gt; {GOOD}</p></article", f"a b c <d> {GOOD.strip()}"
    yield None, ""
    yield "", ""
    yield "<nav>only a menu</nav>", ""
    yield "<p>" + "plain text of no known language zzz " * 20000, ("plain text of no known language zzz " * 20000).strip()


def test_pages(spark):
    cases = list(pages())
    rows = [(i, f"http://{i}", page, "t", 0) for i, (page, _) in enumerate(cases)] * 2
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    found = html_text.extract(frame).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.text == cases[r.page_id][1], r.page_id
        assert r.n_chars == len(r.text)
    assert html_text.extract(frame.limit(0)).count() == 0


def test_short_blocks_inherit():
    both = html_text.second_pass(["good", "short", "short", "bad", "near", "bad"], [True] * 6)
    assert both == [True, True, False, False, False, False]
    assert html_text.second_pass(["short", "near"], [True, True]) == [False, True]
    assert html_text.second_pass(["good", "bad", "short"], [True, False, True]) == [True, False, True]


@pytest.mark.parametrize(
    "wrapper",
    [
        "class='content-sidebar-wrap'", "class='site has-sidebar'", "class='no-comments'", "id='search-results'", "class=sidebar",
        "class='flex hidden lg:block'", "data-title='The hidden city'", "data-title='a hidden=x b'",
    ],
)
@pytest.mark.parametrize("tag", ["article", "main", "div itemprop=articleBody"])
def test_wrappers_do_not_hide_a_marked_article(wrapper, tag):
    end = tag.split()[0]
    assert html_text.main_text(f"<div {wrapper}><{tag}><p>{GOOD}</p></{end}></div><p>{GOOD} outside</p>") == GOOD.strip()
    if "class=sidebar" not in wrapper:
        assert html_text.main_text(f"<{tag} {wrapper}><p>{GOOD}</p></{end}>") == GOOD.strip()


def test_articles_that_are_not_the_pages():
    for around in ("nav", "footer", "aside", "form", "div hidden", "div hidden=''", "div class='comments'"):
        page = f"<main><p>{GOOD}</p></main><{around}><article><p>{GOOD} other</p></article></{around.split()[0]}>"
        assert html_text.main_text(page) == GOOD.strip(), around
    assert html_text.main_text(f"<div class='site-footer x'><p>{GOOD} other</p></div><p>{GOOD}</p>") == GOOD.strip()


@pytest.mark.parametrize(
    "start",
    [
        "<svg class=i />", "<math/>", "<object data=x>", "<video src=x>no film", "<audio>", "<canvas>", "<map name=m>",
        "<select><option>one<option>two", "<svg><path d='x'/>", "<iframe src=x />", "<object><object>inner</object>",
    ],
)
def test_silent_elements_without_end_do_not_cut_the_page(start):
    own = start.strip("<").split()[0].split(">")[0].rstrip("/")
    for rest in ("", f"<div><{own}>gone</{own}></div>"):
        if rest and "iframe" in start:
            continue
        page = f"<body><div>{start}<article><p>{GOOD}</p><p>Second. {GOOD}</p></article></div>{rest}</body>"
        assert html_text.main_text(page) == f"{GOOD.strip()}\nSecond. {GOOD.strip()}", rest
        plain = f"<body><div>{start}</div><p>{GOOD}</p>{rest}</body>"
        assert html_text.main_text(plain) == GOOD.strip(), rest


def test_silent_elements_with_end_are_left_out():
    for inner in ("<svg><title>t</title><g/><text>no</text></svg>", "<object><p>no</p><object>no</object>no</object>", "<noscript><p>no</p></noscript>"):
        assert html_text.main_text(f"<p>{GOOD}{inner} tail</p>") == GOOD + "tail", inner


# --- pieces ---------------------------------------------------------------------------------------

TEXTS = [
    "", "a", " ", "  a  b ", "\n", "Hello  world\n\tfoo é 　漢字\x00 thering", "🙂🙂 x\t\ty", "<s> </s> <0x41> <unk>",
    "tion " * 3000, "x" * 5000, "ünïcödé ẞ​﻿", "\r\nline\r\n",
]


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(open(sentencepiece_codec.MODEL, "rb").read())
    model.trainer_spec.model_type = 1  # the library's own best-score segmentation
    for piece in model.pieces:
        piece.score = max(piece.score, -40_000.0)  # it adds up in 32 bits: without the lowest score it stays exact
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def test_pieces_against_library(library):
    vocabulary = sentencepiece_codec.Vocabulary.load()
    raised = sentencepiece_codec.Vocabulary(tuple((p, max(s, -40_000.0), k) for p, s, k in vocabulary.pieces), vocabulary.unknown)
    codec = sentencepiece_codec.Codec(raised)
    rnd = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz   .,éñ漢\n"
    texts = TEXTS + ["".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(400)]
    for text in texts:
        assert codec.encode(text).tolist() == library.encode(text), text[:50]
        assert codec.decode(codec.encode(text)) == text == library.decode(library.encode(text)), text[:50]


def test_piece_frames(spark):
    rows = [(i, t, 9, "x") for i, t in enumerate(TEXTS)] + [(None, None, None, None), (0, "", 1, "y"), (3, "  a  b ", 9, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_pieces int, decoded string")
    found = sentencepiece_codec.round_trip(frame).collect()
    assert len(found) == len(rows) and all(r.round_trip and r.n_pieces == len(r.pieces) for r in found)
    back = sentencepiece_codec.decode(sentencepiece_codec.encode(frame)).collect()
    assert all(r.decoded == (r.text or "") for r in back)
    assert sentencepiece_codec.round_trip(frame.limit(0)).count() == 0
    marked = sentencepiece_codec.round_trip(spark.createDataFrame([(1, "a▁b")], "doc_id long, text string")).first()
    assert not marked.round_trip


def test_remembered_cuts_are_bounded():
    codec = sentencepiece_codec.Codec(sentencepiece_codec.Vocabulary.load())
    codec.REMEMBERED = 5
    texts = [f"word{i} and{i}" for i in range(50)]
    assert [codec.decode(codec.encode(t)) for t in texts] == texts and len(codec.known) <= 6
