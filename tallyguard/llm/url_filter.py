"""URL filter: host and path rules first, then a weighted vocabulary matched in the whole url by Aho-Corasick."""

from __future__ import annotations

from dataclasses import dataclass, field

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyguard.llm.frames import arrow_map, lower_ascii

# Fixed values: (verdict, host and path) rules of the query's contract.
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]

# Vocabulary. One strict term rejects; soft terms add their weights.
STRICT = ["adult", "casino", "escort", "hentai", "porn", "pills", "spam", "viagra", "warez", "xxx"]
SOFT = {
    "ads": 0.5,
    "bet": 0.5,
    "bets": 0.5,
    "bonus": 0.5,
    "cheap": 0.5,
    "dating": 0.5,
    "farm": 0.5,
    "free": 0.5,
    "poker": 0.5,
    "sex": 0.5,
    "slots": 0.5,
    "torrent": 0.5,
    "track": 0.5,
    "win": 0.5,
    "x": 0.5,
}


@dataclass(frozen=True)
class UrlRules:
    """Rules and vocabulary; both are configuration, so their size does not follow the data."""

    rules: list[tuple[str, str]] = field(default_factory=lambda: list(RULES))
    strict: list[str] = field(default_factory=lambda: list(STRICT))
    soft: dict[str, float] = field(default_factory=lambda: dict(SOFT))
    soft_limit: float = 1.0

    def by_host(self) -> dict[str, list[tuple[str, str, str]]]:
        """host -> (path, rule, verdict), longest path first."""
        out: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in self.rules:
            host, slash, path = rule.partition("/")
            out.setdefault(host, []).append((slash + path, rule, verdict))
        return {host: sorted(paths, key=lambda x: -len(x[0])) for host, paths in out.items()}

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for term in {*self.strict, *self.soft}:
            found.add_word(term, (term, len(term)))
        if len(found):
            found.make_automaton()
        return found


def _edge(text: str, at: int) -> bool:
    """Whether a term may begin or end at this place: no ASCII letter or digit stands there."""
    return not (0 <= at < len(text) and text[at].isascii() and text[at].isalnum())


def vocabulary_hits(text: str, automaton: ahocorasick.Automaton) -> set[str]:
    """The distinct terms in ``text`` that stand between boundaries."""
    if not len(automaton):
        return set()
    return {
        term
        for end, (term, size) in automaton.iter(text)
        if _edge(text, end + 1) and _edge(text, end - size)
    }


def fitting_rule(host: str, path: str, by_host: dict) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits; of two as long, that of the longer host."""
    best, labels = None, host.split(".")
    for k in range(len(labels)):
        for start, rule, verdict in by_host.get(".".join(labels[k:]), ()):
            if path.startswith(start):
                if best is None or len(rule) > len(best[0]):
                    best = rule, verdict
                break
    return best


def judge_urls(df: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",), rules: UrlRules | None = None) -> DataFrame:
    """``keep`` columns with host, path, rule, verdict, strict_hits, soft_hits, soft_weight.

    Null urls, empty ones and those without ``://`` have empty host and path and fit no rule. The
    vocabulary is searched in the whole url, query and fragment included, whatever its form; a null
    url has no hit. Each row is judged alone: repeated rows give repeated rows, an empty table an
    empty one; columns that are not named are dropped, whatever they are called.
    """
    rules = rules or UrlRules()
    parsed = df.select(
        *keep,
        F.coalesce(lower_ascii(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit("")).alias("host"),
        F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit("")).alias("path"),
        F.coalesce(F.col(url), F.lit("")).alias("__whole"),
    )

    def decide(batches, by_host, automaton):
        for batch in batches:
            out = {name: batch.column(name) for name in batch.schema.names if name != "__whole"}
            read = (batch.column(name).to_pylist() for name in ("host", "path", "__whole"))
            found = [_decide(*row, by_host, automaton, rules) for row in zip(*read)]
            for i, name in enumerate(("rule", "verdict", "strict_hits", "soft_hits", "soft_weight")):
                out[name] = [row[i] for row in found]
            yield out

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parsed.schema.fields[:-1])
    return arrow_map(
        parsed,
        f"{kept}, rule string, verdict string, strict_hits int, soft_hits int, soft_weight double",
        decide,
        rules.by_host,
        rules.automaton,
    )


def _decide(host: str, path: str, whole: str, by_host: dict, automaton, rules: UrlRules) -> tuple:
    hits = vocabulary_hits(whole.translate(_LOWER), automaton)
    strict = len(hits.intersection(rules.strict))
    soft = sorted(t for t in hits if t in rules.soft)
    weight = sum(rules.soft[t] for t in soft)
    fits = fitting_rule(host, path, by_host)
    rejected = strict > 0 or (len(soft) > 1 and weight >= rules.soft_limit)
    rule, verdict = fits if fits else (None, "block" if rejected else "allow")
    return rule, verdict, strict, len(soft), weight


_LOWER = {ord(a): ord(a) + 32 for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
