"""I-Match fingerprints with DataFrame functions only.

A text's distinct terms are kept if their document frequency lies in a band, sorted, and hashed
once per randomised subset of the lexicon: every lexicon term belongs to one of ``subsets`` random
classes, and a fingerprint lists ``class:hash`` for the classes that the text has terms of. An edit
changes the classes of the terms it touches and leaves the others, so the share of equal classes
tells how much two texts have in common.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyguard.llm.frames import stored


@dataclass(frozen=True)
class IMatchParams:
    """The band: a lexicon term stands in at least one of ``rarest`` documents (and in two), and at
    most in one of ``commonest``. The lexicon then has ``rarest`` times the mean number of distinct
    terms per document at most, however large the corpus is; up to ``broadcast_terms`` of them are
    broadcast, a larger one is joined by shuffle."""

    rarest: int = 1000
    commonest: int = 20
    subsets: int = 96
    broadcast_terms: int = 1_000_000
    bucket: int = 500


def terms_of(text: Column) -> Column:
    """Distinct lower-case terms between ASCII white space, without the empty one."""
    return F.array_except(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), F.array(F.lit("")))


def lexicon(docs: DataFrame, params: IMatchParams, text: str = "text") -> DataFrame:
    """(term, class) of the terms inside the band; counts cover all documents. Null texts count as
    documents without terms."""
    n = docs.count()
    counted = docs.select(F.explode(terms_of(F.col(text))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    inside = (F.col("df") >= 2) & (F.col("df") * params.rarest >= n) & (F.col("df") * params.commonest <= n)
    kind = F.conv(F.substring(F.md5(F.col("term").cast("binary")), 1, 4), 16, 10).cast("int") % params.subsets
    return counted.filter(inside).select("term", F.lpad(F.lower(F.hex(kind)), 2, "0").alias("class"))


_NO_ID = -(1 << 63)


def order_positions(rows: DataFrame) -> DataFrame:
    """(id, body, n, pos, copies, total): the place of every different row of (id, body, n) in the
    order of ids and hashes. Only these are sorted, by ranges; one number per range is what the
    offsets are made of."""
    different = rows.groupBy("id", "body", "n").agg(F.count(F.lit(1)).alias("copies"))
    ranged = stored(different.repartitionByRange("id", "body").withColumn("part", F.spark_partition_id()), "id-ranges")
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    # One row per range partition, so this window and its broadcast stay small.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"), F.sum("rows").over(Window.partitionBy()).alias("total"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("id", "body")) - 1
    return (
        ranged.withColumn("place", place)
        .join(F.broadcast(offsets), "part")
        .select("id", "body", "n", (F.col("place") + F.col("offset")).alias("pos"), "copies", "total")
    )


def with_next_start(rows: DataFrame, places: DataFrame) -> DataFrame:
    """(id, body, pos, copies, total, text, head): head is the start of the next text, as long as a
    quarter of this one; after the last document comes the first.

    Each document sends its start to the one before it, so one quarter of the texts moves, and what
    a document sends or gets is bounded by its own neighbours.
    """
    before = places.select(((F.col("pos") + 1) % F.col("total")).alias("pos"), F.col("id").alias("to_id"), F.col("body").alias("to_body"), F.expr("n div 4").alias("wanted"))
    told = places.join(before, "pos").select("id", "body", "pos", "copies", "total", "to_id", "to_body", "wanted")
    placed = rows.select("id", "body", "text").join(told, ["id", "body"])
    heads = placed.select(F.col("to_id").alias("id"), F.col("to_body").alias("body"), F.substring("text", F.lit(1), F.col("wanted").cast("int")).alias("head"))
    return placed.select("id", "body", "pos", "copies", "total", "text").join(heads, ["id", "body"])


def in_buckets(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` (with pos and total) in buckets of ``size`` by position, with columns bucket, at and
    guest. The first of each bucket is also a guest at the end of the bucket before (and the very
    first, of the last), so that no bucket has to look into another and none is larger than the rest."""
    here = F.struct(F.expr(f"pos div {size}").alias("bucket"), F.col("pos").alias("at"), F.lit(False).alias("guest"))
    before = F.struct(F.expr(f"pos div {size} - 1").alias("bucket"), F.col("pos").alias("at"), F.lit(True).alias("guest"))
    last = F.struct(F.expr(f"(total - 1) div {size}").alias("bucket"), F.col("total").alias("at"), F.lit(True).alias("guest"))
    sent = F.when(F.col("pos") == 0, F.array(here, last)).when(F.col("pos") % size == 0, F.array(here, before)).otherwise(F.array(here))
    return rows.select("*", F.inline(sent))


def edited_text(text: Column, head: Column) -> Column:
    """The last quarter of the code points (rounded down) replaced by ``head``."""
    n = F.char_length(text)
    return F.concat(F.substring(text, F.lit(1), n - F.floor(n / 4).cast("int")), head)


def fingerprints(texts: DataFrame, words: DataFrame, key: list[str], params: IMatchParams) -> DataFrame:
    """``key``, note and fingerprint of rows with ``key``, text and note (any string). Texts without
    a term in the band, the empty ones among them, get ``text:`` and a hash of their sorted terms."""
    size = words.count()
    side = F.broadcast(words) if size <= params.broadcast_terms else words
    terms = terms_of(F.col("text"))
    # One element that no term can equal carries the note and the hash of all terms through the explode.
    whole = F.concat(F.lit(" "), F.substring(F.md5(F.array_join(F.array_sort(terms), " ").cast("binary")), 1, 8), "note")
    rows = texts.select(*key, F.explode(F.concat(F.array(whole), terms)).alias("term"))
    known = rows.join(side, "term", "left").withColumn("class", F.when(F.substring("term", 1, 1) == " ", "!").otherwise(F.col("class")))
    sums = known.filter(F.col("class").isNotNull()).groupBy(*key, "class").agg(F.array_sort(F.collect_list("term")).alias("terms"))
    hashed = F.when(F.col("class") == "!", F.element_at("terms", 1)).otherwise(F.substring(F.md5(F.array_join("terms", " ").cast("binary")), 1, 8))
    listed = sums.select(*key, F.struct("class", hashed.alias("sum")).alias("part")).groupBy(*key).agg(F.array_sort(F.collect_list("part")).alias("parts"))
    # "!" sorts before all classes.
    carried = F.element_at("parts", 1)["sum"]
    blocks = F.array_join(F.transform(F.slice("parts", F.lit(2), F.size("parts")), lambda x: F.concat(x["class"], F.lit(":"), x["sum"])), " ")
    alone = F.concat(F.lit("text:"), F.substring(carried, 2, 8))
    return listed.select(*key, F.expr("substring(parts[0].sum, 10)").alias("note"), F.when(F.size("parts") > 1, blocks).otherwise(alone).alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal classes among the classes that either fingerprint has."""
    left, right = F.split(a, " "), F.split(b, " ")
    classes = F.array_union(F.transform(left, lambda x: F.substring_index(x, ":", 1)), F.transform(right, lambda x: F.substring_index(x, ":", 1)))
    return F.size(F.array_intersect(left, right)) / F.size(classes)


def compare_with_edits(docs: DataFrame, params: IMatchParams | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next.

    Null texts are empty. Rows equal in id and text are one document in the order and give equal
    result rows; of rows that share an id but not the text, each is a document. Null ids come first.
    A table of one document has itself as next; an empty one gives no rows. Other columns are not
    looked at.
    """
    params = params or IMatchParams()
    words = stored(lexicon(docs, params, text), "lexicon")
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("body", F.xxhash64("text"))
    places = stored(order_positions(rows.select("id", "body", F.char_length("text").alias("n"))), "places")
    if places.filter("copies > 1").head() is not None:
        rows = rows.dropDuplicates(["id", "body"])
    base = with_next_start(rows, places)
    edited = edited_text(F.col("text"), F.col("head"))
    key = ["id", "body", "pos", "copies", "total", "which"]
    both = base.withColumn("edited", edited).select(*key[:-1], F.posexplode(F.array("text", "edited")).alias("which", "text"))
    noted = both.withColumn("note", F.when(F.col("which") == 0, F.char_length("text").cast("string")).otherwise(F.sha2(F.col("text").cast("binary"), 256)))
    two = F.array_sort(F.collect_list(F.struct("which", "note", "fingerprint")))
    marks = fingerprints(noted, words, key, params).groupBy(*key[:-1]).agg(two.alias("two"))
    ordered = Window.partitionBy("bucket").orderBy("at")
    marks = marks.select("id", "pos", "copies", "total", F.expr("two[0].note").cast("long").alias("n_chars"), F.expr("two[1].note").alias("edited_sha256"), F.expr("two[0].fingerprint").alias("fingerprint"), F.expr("two[1].fingerprint").alias("edited_fingerprint"))
    follow = in_buckets(marks, params.bucket).withColumn("next_fingerprint", F.lead("fingerprint").over(ordered)).filter(~F.col("guest"))
    return follow.select(
        F.nullif(F.col("id"), F.lit(_NO_ID)).alias(doc_id),
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("__copy"),
    ).drop("__copy")
