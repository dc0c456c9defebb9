"""Links between similar sets that meet at a key, without all pairs of a crowded key.

Sets meet at keys (a shingle of a prefix, a part of a signature). Where few meet, all their pairs
are verified. Where many meet, they are the family of one of them, the pivot:

* Every member is described by its difference to a common set, D = set XOR centre. The centre starts
  as the pivot and is moved to what most of the family holds. For any centre
  |a XOR b| = |Da| + |Db| - 2 |Da AND Db|, so with g(x) = (den + num) |Dx| - (den - num) |x| two
  sets are linked exactly if g(a) + g(b) <= 2 (den + num) |Da AND Db|.
* Let m be the member with the smallest g. Whoever has g(a) + g(m) <= 0 is linked with m, whatever
  they share. The others must share ceil((g(a) + g(b)) / (2 (den + num))) >= 1 elements of their
  differences with a partner, so they meet again at the rare elements of D, by the prefix rule.
* What meets there is a smaller problem of the same kind.

A thousand copies with a few changes each cost a thousand differences and the few pairs that share a
change, while no link between components is lost. Families are never held in one task: differences
are rows, counted and joined by Spark.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyguard.llm.frames import arrow_map, stored

BITS = 1024


@dataclass(frozen=True)
class LinkRule:
    """Sets are linked if den * intersection >= num * union. Up to ``few`` sets at a key are paired;
    after ``levels`` of families what still meets is paired under the prefix rule's bound."""

    num: int = 75
    den: int = 100
    few: int = 64
    levels: int = 2

    def least_overlap(self, n: int) -> int:
        """Elements that a set of n shares at least with any set it is linked with."""
        return -(-self.num * n // self.den)

    def linked(self, a: int, b: int, both: int) -> bool:
        return both > 0 and self.den * both >= self.num * (a + b - both)

    @property
    def twice(self) -> int:
        return 2 * (self.den + self.num)

    def gap(self, size: Column, difference: Column) -> Column:
        """g of a set with ``size`` elements and ``difference`` elements in D (for D = the set: an
        empty centre)."""
        return ((self.den + self.num) * difference.cast("long") - (self.den - self.num) * size.cast("long")).cast("long")


def bitmap(elements: np.ndarray) -> bytes:
    flags = np.zeros(BITS, np.uint8)
    flags[(elements & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return np.packbits(flags).tobytes()


def either(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def verified(pairs: DataFrame, sets: DataFrame, rule: LinkRule) -> DataFrame:
    """(a, b) of the pairs (units of ``sets``: unit, n, shared, bits) that are linked. Bitmaps go
    first: bits that only one set has bound the overlap from above, so no linked pair is left out."""
    left = sets.select(F.col("unit").alias("a"), F.col("n").alias("an"), F.col("bits").alias("ab"))
    right = sets.select(F.col("unit").alias("b"), F.col("n").alias("bn"), F.col("bits").alias("bb"))

    def possible(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("ab", "bb"))
            an, bn = (batch.column(c).to_numpy().astype(np.int64) for c in ("an", "bn"))
            only_a, only_b = (np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64) for x, y in ((a, b), (b, a)))
            most = np.minimum(an - only_a, bn - only_b)
            mask = pa.array(rule.den * most >= rule.num * (an + bn - most))
            yield {n: batch.column(n).filter(mask) for n in ("a", "b")}

    def exact(batches):
        for batch in batches:
            keep = []
            for an, ax, bn, bx in zip(*(batch.column(n).to_pylist() for n in ("an", "ax", "bn", "bx"))):
                x, y = np.frombuffer(ax, np.uint64), np.frombuffer(bx, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True)) if ax != bx else len(x)
                keep.append(rule.linked(an, bn, both))
            mask = pa.array(keep, pa.bool_())
            yield {n: batch.column(n).filter(mask) for n in ("a", "b")}

    left_over = arrow_map(pairs.join(left, "a").join(right, "b").select("a", "b", "an", "ab", "bn", "bb"), "a long, b long", possible)
    left = sets.select(F.col("unit").alias("a"), F.col("n").alias("an"), F.col("shared").alias("ax"))
    right = sets.select(F.col("unit").alias("b"), F.col("n").alias("bn"), F.col("shared").alias("bx"))
    return arrow_map(left_over.join(left, "a").join(right, "b").select("a", "b", "an", "ax", "bn", "bx"), "a long, b long", exact)


def _together(meetings: DataFrame, rule: LinkRule) -> DataFrame:
    """Pairs at a key that sizes and the prefix rule allow; one of them has to be open."""
    small, large = F.least("a.n", "b.n"), F.greatest("a.n", "b.n")
    # A linked pair shares nothing before the first element that it meets at.
    reach = F.least(F.col("a.d") - F.col("a.at"), F.col("b.d") - F.col("b.at"))
    allowed = (small * rule.den >= large * rule.num) & (reach * rule.twice >= F.col("a.g") + F.col("b.g"))
    here = (F.col("a.h") == F.col("b.h")) & (F.col("a.unit") < F.col("b.unit")) & (F.col("a.open") | F.col("b.open"))
    return meetings.alias("a").join(meetings.alias("b"), here & allowed).select(F.col("a.unit").alias("a"), F.col("b.unit").alias("b"))


def met(meetings: DataFrame, rule: LinkRule, last: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(pairs, families) of ``meetings`` (h, unit, n, g, d, at, open, size): pairs (a, b) of units
    where at most ``few`` meet, and (p, unit, n) with the pivot p where more do. A unit stands for
    ``size`` sets of one size. ``last``: all are paired."""
    crowd = meetings.groupBy("h").agg(F.sum("size").alias("crowd"), F.max("open").alias("any"), F.count(F.lit(1)).alias("units"))
    crowd = crowd.filter(F.col("any") & ((F.col("units") > 1) | (F.col("crowd") > rule.few))).select("h", "crowd")
    placed = stored(meetings.join(crowd, "h"), "meetings")
    if last:
        return _together(placed, rule).distinct(), None
    pairs = _together(placed.filter(F.col("crowd") <= rule.few), rule).distinct()
    return pairs, _gathered(placed.filter(F.col("crowd") > rule.few).select("h", "unit", "n"))


def _gathered(crowded: DataFrame) -> DataFrame:
    """(p, unit, n): the families of the crowded keys (h, unit, n). A key's pivot is the member that meets
    others at the most crowded keys, so that the keys of one group of copies have one pivot, and a
    member is in a few families instead of one for each of its keys. A pivot that shares at least a
    quarter of its keys with another's family gives its own keys up to that."""
    crowded = stored(crowded, "crowded")
    rank = stored(crowded.groupBy("unit").agg(F.count(F.lit(1)).alias("keys"), F.min("n").alias("n")), "ranks")
    order = F.struct("keys", (-F.col("n")).alias("small"), "unit")
    first = stored(crowded.select("h", "unit").join(rank, "unit").groupBy("h").agg(F.max(order).alias("first")), "pivots")
    pivots = first.select(F.col("first.unit").alias("unit"), F.col("first").alias("own")).distinct()
    shared = crowded.select("h", "unit").join(pivots, "unit").join(first, "h").filter("first > own").groupBy("unit", "own", "first").agg(F.count(F.lit(1)).alias("both"))
    shared = shared.filter(F.col("both") * 4 >= F.col("own.keys")).groupBy("unit").agg(F.max(F.struct("both", "first")).alias("to"))
    moves = stored(shared.select(F.col("unit").alias("p"), F.col("to.first.unit").alias("to")), "moves")
    # A pivot moves to one of higher rank, which may move in turn: two steps gather nearly all of them.
    chosen = first.select("h", F.col("first.unit").alias("p"))
    for _ in range(2):
        chosen = chosen.join(moves, "p", "left").select("h", F.coalesce("to", "p").alias("p"))
    return crowded.join(chosen, "h").select("p", "unit", "n").distinct()


def _banded(families: DataFrame, rule: LinkRule) -> DataFrame:
    """(fam, p, unit): families parted by size. Linked sets lie in one band of sizes or in two
    neighbouring ones, so each unit goes to its own band and to the next; a band is a little wider
    than the ratio of two linked sizes, so rounding cannot part them. A band's family that would only
    repeat a part of the next one's is left out."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(rule.den / rule.num) * 1.001)))
    placed = families.select("p", "unit", band.alias("own"))
    held = placed.groupBy("p").agg(F.collect_set("own").alias("held"))
    has = lambda b: F.array_contains("held", b)
    needed = F.filter(F.array(F.col("own"), F.col("own") + 1), lambda b: has(b) & (has(b - 1) | ~has(b + 1)))
    both = placed.join(held, "p").select("p", "unit", F.explode(needed).alias("band"))
    return both.select(F.xxhash64("p", "band").alias("fam"), "p", "unit")


def _differences(families: DataFrame, sets: DataFrame) -> DataFrame:
    """(fam, unit, n, d, diff): each member's difference to its pivot; elements that no other set holds
    are counted in d and not listed."""
    own = sets.select("unit", "n", F.col("shared").alias("x"))
    pivot = sets.select(F.col("unit").alias("p"), F.col("shared").alias("y"))

    def run(batches):
        for batch in batches:
            out: dict[str, list] = {"d": [], "diff": []}
            for n, x, y in zip(*(batch.column(c).to_pylist() for c in ("n", "x", "y"))):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                diff = np.setxor1d(x, y, assume_unique=True)
                out["d"].append(len(diff) + n - len(x))
                out["diff"].append(diff.view(np.int64))
            yield {"fam": batch.column("fam"), "unit": batch.column("unit"), "n": batch.column("n"), **out}

    joined = families.join(own, "unit").join(pivot, "p").select("fam", "unit", "n", "x", "y")
    return arrow_map(joined, "fam long, unit long, n int, d int, diff array<long>", run)


def _centred(families: DataFrame, sets: DataFrame, rule: LinkRule) -> tuple[DataFrame, DataFrame]:
    """(members with differences to what most of their family holds, how many hold each element)."""
    members = stored(_differences(_banded(families, rule), sets), "differences")
    sizes = members.groupBy("fam").agg(F.count(F.lit(1)).alias("size"))
    held = members.select("fam", F.explode("diff").alias("x")).groupBy("fam", "x").agg(F.count(F.lit(1)).alias("held"))
    held = stored(held.filter("held > 1").join(sizes, "fam"), "held")
    # At most twice the mean difference: each is in more than half of them.
    moved = held.filter("2 * held > size").groupBy("fam").agg(F.collect_list("x").alias("moved"))
    members = members.join(moved, "fam", "left").withColumn("moved", F.coalesce("moved", F.array().cast("array<long>")))
    members = members.withColumn("stay", F.array_except("diff", "moved")).withColumn("come", F.array_except("moved", "diff"))
    d = F.col("d") - F.size("diff") + F.size("stay") + F.size("come")
    members = members.select("fam", "unit", "n", d.alias("d"), F.concat("stay", "come").alias("diff"))
    members = members.withColumn("g", rule.gap(F.col("n"), F.col("d")))
    held = held.select("fam", "x", F.when(F.col("held") * 2 > F.col("size"), F.col("size") - F.col("held")).otherwise(F.col("held")).alias("held"))
    return stored(members, "centred"), held.filter("held > 1")


def _family_links(families: DataFrame, sets: DataFrame, rule: LinkRule) -> tuple[DataFrame, DataFrame]:
    """(links to each family's nearest member, meetings of those that may have others)."""
    members, held = _centred(families, sets, rule)
    nearest = members.groupBy("fam").agg(F.min(F.struct("g", "unit")).alias("m"))
    told = members.join(nearest, "fam").withColumn("open", F.col("g") + F.col("m.g") > 0)
    stars = told.filter(~F.col("open") & (F.col("unit") != F.col("m.unit"))).select(*either(F.col("unit"), F.col("m.unit")))
    least_open = told.filter("open").groupBy("fam").agg(F.min("g").alias("go"))
    told = told.join(least_open, "fam").withColumn("other", F.when(F.col("open"), F.col("m.g")).otherwise(F.col("go")))
    least = F.expr(f"(g + other + {rule.twice - 1}) div {rule.twice}")
    told = told.withColumn("keep", (F.col("d") - least + 1).cast("int")).filter("keep > 0")
    seen = told.select("fam", "unit", "n", "g", "d", "open", "keep", F.explode("diff").alias("x")).join(held, ["fam", "x"])
    ordered = seen.groupBy("fam", "unit", "n", "g", "d", "open", "keep").agg(F.array_sort(F.collect_list(F.struct("held", "x"))).alias("xs"))
    # Elements of one member alone come before all others, so the first of xs is at place d - size.
    ordered = ordered.withColumn("lone", F.col("d") - F.size("xs")).filter("keep > lone")
    ordered = ordered.select("fam", "unit", "n", "g", "d", "open", "lone", F.posexplode(F.expr("slice(xs, 1, keep - lone)")).alias("pos", "e"))
    one = F.lit(1).cast("long")
    return stars, ordered.select(F.xxhash64("fam", "e.x").alias("h"), "unit", "n", "g", "d", (F.col("lone") + F.col("pos")).alias("at"), "open", one.alias("size"))


def links(pairs: DataFrame, families: DataFrame, sets: DataFrame, rule: LinkRule) -> DataFrame:
    """(a, b): links that join every component of the similarity graph over the sets' units, given
    the pairs and families in which all linked units meet."""
    # Each part is written by itself: one plan of all of them is planned again after every stage of it.
    found = [stored(verified(pairs, sets, rule), "verified")]
    families = stored(families, "families")
    for level in range(rule.levels):
        if families.isEmpty():
            break
        stars, meetings = _family_links(families, sets, rule)
        pairs, deeper = met(stored(meetings, "family-meetings"), rule, last=level + 1 == rule.levels)
        found += stored(stars, "stars"), stored(verified(pairs, sets, rule), "verified")
        if deeper is None:
            break
        families = stored(deeper, "families")
    return reduce(DataFrame.union, found)
