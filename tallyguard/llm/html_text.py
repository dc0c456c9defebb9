"""Main text of HTML pages by two passes of block rules.

A tolerant scan cuts the page into text blocks. The first pass labels each block by stop-word
density, length and link density: good, bad, or short/near for those that it cannot decide. The
second gives undecided blocks the label of their nearest decided neighbours. Blocks inside elements
that never hold an article's text (menus, headers, footers, sidebars, notices, adverts, forms,
scripts, reader comments; by tag, role, class or id) are bad from the start and decide nothing for
the blocks around them; where the page marks an article, blocks outside it are bad as well. Classes
and ids count as whole names, and those around a marked article say nothing about it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyguard.llm.frames import arrow_map

# Frequent function words by language.
STOP_WORDS = {
    "en": "a about after all also an and are as at be been but by can could do for from had has have he her his how i if in into is it its just like me more my no not of on one or our out she so some than that the their them then there these they this to up us was we were what when which who will with would you your",
    "de": "aber als am an auch auf aus bei bin bis da das dass dem den der des die doch du durch ein eine einem einen einer es für hat hatte ich ihr im in ist ja kann man mehr mit nach nicht noch nur oder sein sich sie sind so um und uns von vor war was wenn werden wie wir wird zu zum zur über",
    "fr": "à ai alors au aussi aux avec ce ces cette comme dans de des du elle en est et eu il ils je la le les leur lui mais me même mon ne nous on ont ou par pas plus pour qu que qui sa sans se ses si son sont sur ta te tu un une vous y été être",
    "es": "a al algo como con cuando de del donde el ella ellos en entre era es esta este esto estos fue ha han hasta hay la las le les lo los más me mi muy no nos o para pero por porque que quien se ser si sin sobre son su sus también te tiene todo un una uno y ya yo",
}
# Tags by their role.
SILENT = frozenset("script style noscript template svg math iframe object embed audio video canvas map title textarea select datalist noembed noframes".split())
RAW = frozenset("script style iframe title textarea noembed noframes".split())  # nothing in them is markup
BOILERPLATE = frozenset("nav footer aside form menu dialog button fieldset".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img input".split()
)
IN_HEAD = SILENT | {"head", "base", "link", "meta"}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open one of these is closed by the next start tag of its group.
CLOSED_BY = {"p": "block", "li": "li", "dt": "dd", "dd": "dd", "tr": "tr", "td": "td", "th": "td", "option": "option"}
GROUP = {"li": "li", "dt": "dd", "dd": "dd", "tr": "tr", "td": "td", "th": "td", "option": "option"}
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar".split())
# Whole names in a class or id that mark something beside the article.
BESIDE = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer "
    "gdpr login masthead menu modal nav navbar navigation newsletter notice pagination popup promo promoted related "
    "respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar "
    "ad-banner ad-box ad-container ad-slot ad-wrapper comment-form comment-list comments-area cookie-banner cookie-bar "
    "cookie-consent cookie-notice main-menu main-nav main-navigation nav-bar nav-menu newsletter-signup page-footer "
    "related-articles related-posts search-form share-buttons side-bar site-footer site-nav site-navigation "
    "social-links social-share".split()
)
# In these each entry may be an <article> of its own.
ENTRIES = frozenset("comment comments commentlist comment-list comments-area disqus respond related related-articles related-posts".split())
#: An article inside one of these is not the page's.
CLOSED_OFF = frozenset("nav footer aside form".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SILENT_START = re.compile(rf"<(?:{'|'.join(sorted(SILENT - RAW))})\b", re.IGNORECASE)
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.IGNORECASE) for tag in RAW}
_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class HtmlParams:
    """``length_low``/``length_high`` in code points, densities as shares of words or characters."""

    length_low: int = 40
    length_high: int = 200
    stop_low: float = 0.10
    stop_high: float = 0.20
    link_density: float = 0.3
    stop_words: frozenset[str] = field(default_factory=lambda: frozenset(w for words in STOP_WORDS.values() for w in words.split()))


@dataclass
class Block:
    text: str
    linked: int  # code points inside links
    heading: bool
    beside: bool  # inside an element that never holds an article's text
    article: bool  # inside the article


class _Open:
    """An open element and what holds inside it."""

    __slots__ = ("tag", "beside", "article", "silent", "closed_off", "entries", "muted")

    def __init__(self, tag: str, beside: bool, article: bool, silent: bool, closed_off: bool = False, entries: bool = False, muted: bool = False):
        self.tag, self.beside, self.article, self.silent = tag, beside, article, silent
        self.closed_off, self.entries = closed_off, entries
        self.muted = muted  # its own text, not that of blocks in it, stands for something else

    def child(self, tag: str, raw: str) -> _Open:
        """The element that a start tag opens in this one. What is beside stays so below it, but a
        marked article starts afresh outside of menus, footers, asides, forms and hidden parts; an
        ``<article>`` among comments or related pages is an entry of theirs."""
        beside, article, whole, hidden, entries = _marks(tag, raw, self.article)
        afresh = whole and not self.closed_off and not (self.entries and tag == "article")
        return _Open(
            tag,
            beside or self.beside and not afresh,
            self.article or article,
            self.silent or tag == "head",
            self.closed_off or hidden or tag in CLOSED_OFF,
            entries or self.entries and not afresh,
            tag in SILENT or self.muted and (tag in INLINE or tag in ("option", "optgroup")),
        )


def _marks(tag: str, raw: str, in_article: bool) -> tuple[bool, bool, bool, bool, bool]:
    """(beside, article, an element that starts afresh, hidden, one with entries) of a start tag by
    its name and attributes."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or ""))
    role = found.get("role", "").lower()
    body = "articleBody" in found.get("itemprop", "").split()
    article = tag in ("article", "main") or role in ("article", "main") or body
    names = {n.replace("_", "-") for n in f"{found.get('class', '')} {found.get('id', '')}".lower().split()}
    hidden = "hidden" in found and found["hidden"].lower() != "until-found"
    beside = tag in BOILERPLATE or role in ROLES or hidden
    if not in_article and (tag == "header" or names & {"header", "site-header"}):
        beside = True
    marked = tag not in ("html", "body", "article", "main") and not body
    if marked and names & BESIDE:
        beside = True
    return beside, article, tag in ("article", "main") or body, hidden, marked and bool(names & ENTRIES)


def _raw_end(page: str, tag: str, at: int, empty: bool) -> int:
    """Where the text goes on behind a raw element's start tag that ends at ``at``. Without an end
    tag it takes the rest of the page, but for a self-closed one."""
    close = _RAW_END[tag].search(page, at)
    return close.end() if close else at if empty else len(page)


def _silent_ends(page: str) -> dict[int, int]:
    """Start tags of silent elements that are not raw -> the end of their own end tag, by place, for
    those that have one before their parent ends."""
    out: dict[int, int] = {}
    if not _SILENT_START.search(page):
        return out
    stack: list[tuple[str, int]] = []
    depth: Counter = Counter()
    at = 0
    while (token := _next(page, at)) is not None:
        at = token.end()
        tag = (token[2] or "").lower()
        if not tag or tag in VOID:
            continue
        if not token[1]:
            empty = token[3].endswith("/")
            if empty and (tag in ("svg", "math") or depth["svg"] or depth["math"]):
                continue
            if tag in RAW:
                at = _raw_end(page, tag, at, empty)
                continue
            stack.append((tag, token.start()))
            depth[tag] += 1
        elif depth[tag]:
            gone = ""
            while gone != tag:
                gone, start = stack.pop()
                depth[gone] -= 1
            if tag in SILENT:
                out[start] = at
    return out


def blocks_of(page: str | None) -> list[Block]:
    """The page's blocks in order, white space collapsed, character references decoded. Missing end
    tags and cut pages are taken as far as they go: a picture, film or list without its own end tag
    silences its own text only and ends with its parent."""
    out: list[Block] = []
    stack: list[_Open] = [_Open("", False, False, False)]
    texts: list[str] = []
    linked = links = headings = 0
    page = page or ""
    ends = _silent_ends(page)

    def flush() -> None:
        nonlocal linked
        if texts:
            text = " ".join("".join(texts).split())
            if text:
                top = stack[-1]
                out.append(Block(text, min(linked, len(text)), headings > 0, top.beside, top.article))
            texts.clear()
        linked = 0

    def leave(upto: int) -> None:
        nonlocal links, headings
        for gone in stack[upto:]:
            links -= gone.tag == "a"
            headings -= len(gone.tag) == 2 and gone.tag[0] == "h" and gone.tag[1].isdigit()
        del stack[upto:]

    at, end = 0, len(page)
    while at < end:
        token = _next(page, at)
        start = token.start() if token else end
        if start > at and not (stack[-1].silent or stack[-1].muted):
            text = html.unescape(page[at:start])
            texts.append(text)
            if links:
                linked += len("".join(text.split()))
        if token is None:
            break
        at = token.end()
        tag = (token[2] or "").lower()
        if not tag:
            continue
        if tag == "br":
            texts.append(" ")
            continue
        if tag not in INLINE and tag not in SILENT:
            flush()
        if token[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    leave(i)
                    break
            continue
        if tag in VOID:
            continue
        if tag in SILENT:
            # Go on behind its end tag, if it has one.
            empty = token[3].endswith("/")
            if tag in RAW:
                at = _raw_end(page, tag, at, empty)
            elif start in ends:
                at = ends[start]
            elif not empty:
                stack.append(stack[-1].child(tag, token[3]))
            continue
        if tag not in INLINE:
            # An open paragraph or item, with what is inline in it, ends where the next block starts.
            for i in range(len(stack) - 1, 0, -1):
                by = CLOSED_BY.get(stack[i].tag)
                if by == "block" or by and by == GROUP.get(tag):
                    leave(i)
                    break
                if stack[i].tag not in INLINE:
                    break
        if stack[-1].silent and tag not in IN_HEAD or tag == "body":
            leave(1)  # the head ends with the first tag that cannot stand in it
        stack.append(stack[-1].child(tag, token[3]))
        links += tag == "a"
        headings += len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
    flush()
    return out


def _next(page: str, at: int):
    """The next piece of markup; a ``<`` that starts none is text."""
    while (at := page.find("<", at)) >= 0:
        found = _TOKEN.match(page, at)
        if found:
            return found
        at += 1
    return None


def first_pass(block: Block, params: HtmlParams) -> str:
    """good, bad, near (long enough, few stop words) or short, from the block alone."""
    size = len(block.text)
    if block.beside or block.linked > params.link_density * size:
        return "bad"
    if "\xa9" in block.text and size < params.length_high:
        return "bad"
    if size < params.length_low:
        return "short"
    words = _WORD.findall(block.text.lower())
    density = sum(w in params.stop_words for w in words) / max(1, len(words))
    if density >= params.stop_high:
        return "good" if size > params.length_high else "near"
    if density >= params.stop_low:
        return "near"
    return "short" if size < params.length_high else "bad"


def second_pass(labels: list[str], decides: list[bool]) -> list[bool]:
    """Whether each block is main text. An undecided block inherits from its nearest decided
    neighbours: where the two differ, a near block is text and a short one goes with the closer (bad
    if both are as close). Blocks that do not decide are skipped over; without any decided
    neighbour a near block is text and a short one is not."""
    n = len(labels)

    def nearest(order) -> list[int | None]:
        seen, out = None, [None] * n
        for i in order:
            out[i] = seen
            if decides[i] and labels[i] in ("good", "bad"):
                seen = i
        return out

    before, after = nearest(range(n)), nearest(range(n - 1, -1, -1))
    kept = []
    for i, (label, a, b) in enumerate(zip(labels, before, after)):
        if label in ("good", "bad"):
            kept.append(label == "good")
            continue
        good = [abs(i - x) for x in (a, b) if x is not None and labels[x] == "good"]
        bad = [abs(i - x) for x in (a, b) if x is not None and labels[x] == "bad"]
        if not good or not bad:
            kept.append(bool(good) or label == "near" and not bad)
        else:
            kept.append(label == "near" or good[0] < bad[0])
    return kept


def main_text(page: str | None, params: HtmlParams | None = None) -> str:
    """The article's blocks joined by one newline; empty for null, empty and wordless pages."""
    params = params or HtmlParams()
    blocks = blocks_of(page)
    if any(b.article and not b.beside for b in blocks):
        # The page says where its article is: what is outside neither stays nor decides, and inside
        # only links and the marks above speak against a block. Short ones have no other neighbours.
        inner = [b for b in blocks if b.article and not b.beside]
        labels = [_inside(b, params) for b in inner]
        kept = second_pass(labels, [True] * len(inner))
        if not any(label == "good" for label in labels):
            kept = [label != "bad" for label in labels]
        return "\n".join(b.text for b, stays in zip(inner, kept) if stays)
    labels = [first_pass(b, params) for b in blocks]
    if "good" not in labels:
        # No block has the stop words of a known language: what is not beside the text or links stays.
        labels = ["good" if not b.beside and b.linked <= params.link_density * len(b.text) and "\xa9" not in b.text else "bad" for b in blocks]
    kept = second_pass(labels, [not b.beside for b in blocks])
    # A heading is short by nature: it stays before a block that does.
    for i in range(len(blocks) - 2, -1, -1):
        if blocks[i].heading and labels[i] in ("short", "near") and kept[i + 1]:
            kept[i] = True
    return "\n".join(b.text for b, stays in zip(blocks, kept) if stays)


def _inside(block: Block, params: HtmlParams) -> str:
    """The first pass inside a marked article, where few stop words alone condemn nothing."""
    label = first_pass(block, params)
    return "near" if label == "bad" and block.linked <= params.link_density * len(block.text) else label


def extract(pages: DataFrame, source: str = "html", keep: tuple[str, ...] = ("page_id", "url"), params: HtmlParams | None = None) -> DataFrame:
    """``keep`` columns with text and n_chars (its code points) for every row.

    Null and empty pages have an empty text. Pages are handled whole and one by one: repeated rows
    give equal texts, an empty table stays empty, columns that are not kept may have any name.
    """
    params = params or HtmlParams()
    rows = pages.select(*[F.col(k) for k in keep], F.col(source).alias("__page"))
    names = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])

    def run(batches):
        for batch in batches:
            out = {n: batch.column(n) for n in batch.schema.names if n != "__page"}
            out["text"] = [main_text(page, params) for page in batch.column("__page").to_pylist()]
            out["n_chars"] = [len(t) for t in out["text"]]
            yield out

    return arrow_map(rows, f"{names}text string, n_chars long", run)
