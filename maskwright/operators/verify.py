"""Checks of the finished text: originals that are still there, and personal data that is no replacement.

A null document is a document like others: joins take null as equal to null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.skew import safe_join, spread_join
from .names import identifying

MIN_LEAK, MIN_WORD = 4, 3
#: Originals are looked up by a gram of so many signs (shorter ones by :data:`MIN_LEAK`); a document's grams are told by so many buckets.
GRAM, BUCKETS = 8, 16_384


def _grams(text: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` signs of a text."""
    return F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1))), lambda g: F.xxhash64(F.lit(size), g))


def leaked(blocks: DataFrame, replacements: DataFrame, doc: str = "doc_id", row: list[str] | None = None) -> DataFrame:
    """(doc, entity_type, text, location): originals of at least four signs that pass the name gate and still stand, as written, in a finished block.

    One row per (doc, type, original), with the first block that holds it. Each original is told by one of its runs of eight signs (four for short
    ones), the one with the smallest hash, so originals that begin alike are spread. Of a block only the runs that may be such a run of its
    document (at most 16,384 buckets a document) are joined, by equality on document and run; only then the candidates are sought in the text.
    Null texts hold nothing. ``row`` tells a block from all others (default doc and block_id).
    """
    row = row or [doc, "block_id"]
    r = replacements.where((F.length("original") >= MIN_LEAK) & identifying(F.col("entity_type"), F.col("original"))).select(doc, "entity_type", "original").distinct()
    r = r.withColumn("short", F.length("original") < GRAM).withColumn("gram", F.array_min(F.when(F.col("short"), _grams(F.col("original"), MIN_LEAK)).otherwise(_grams(F.col("original"), GRAM))))
    bucket = lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")
    told = r.groupBy(doc).agg(F.collect_set(bucket(F.col("gram"))).alias("buckets"), F.max("short").alias("short"))
    sizes = blocks.groupBy(doc).agg(F.count(F.lit(1)).alias("n"))  # a run stands once a block here, so these bound (document, run) too
    b = spread_join(blocks.where(F.col("text").isNotNull()).select(*dict.fromkeys([doc, *row]), "text"), told, [doc], F.struct(*row), counts=sizes)
    hashes = F.concat(_grams(F.col("text"), GRAM), F.when(F.col("short"), _grams(F.col("text"), MIN_LEAK)).otherwise(F.array().cast("array<bigint>")))
    b = b.withColumn("hashes", hashes).withColumn("hit", F.array_intersect(F.transform("hashes", bucket), "buckets")).where(F.size("hit") > 0)
    w = b.select(*dict.fromkeys([doc, *row]), F.explode(F.filter("hashes", lambda h: F.array_contains("hit", bucket(h)))).alias("gram"))
    cand = spread_join(w, r.select(doc, "gram", "entity_type", "original"), [doc, "gram"], F.struct(*row), counts=sizes, hot_on=[doc])
    hits = cand.groupBy(*row).agg(F.collect_set(F.struct("entity_type", "original")).alias("hits"))
    text = F.col("text")
    placed = F.transform("hits", lambda h: F.struct((F.instr(text, h["original"]) - 1).alias("place"), h["entity_type"].alias("entity_type"), h["original"].alias("original")))
    found = safe_join(blocks, hits, row).select(doc, "block_id", "location", F.inline(F.filter(placed, lambda h: h["place"] >= 0)))
    first = found.groupBy(doc, "entity_type", "original").agg(F.min(F.struct("block_id", "place", "location")).alias("f"))
    return first.select(doc, "entity_type", F.col("original").alias("text"), F.col("f.location").alias("location"))


def not_fakes(found: DataFrame, replacements: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, entity_type, text, location): distinct spans found again whose text is no replacement of the document."""
    fakes = replacements.select(doc, F.col("fake").alias("text")).distinct()
    return safe_join(found.select(doc, "entity_type", "text", "location").distinct(), fakes, [doc, "text"], "left_anti")


def unexpected(found: DataFrame, replacements: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, entity_type, text, location): spans found again in finished blocks that are no replacement, nor made of words of replacements only."""
    rows = not_fakes(found, replacements, doc)
    words = replacements.select(doc, F.explode(F.split(F.lower("fake"), r"(?U)[^\w]+")).alias("word")).where(F.length("word") >= MIN_WORD).distinct()
    parts_of = F.filter(F.split(F.lower("text"), r"(?U)[^\w]+"), lambda w: F.length(w) >= MIN_WORD)
    each = rows.withColumn("_id", F.sha2(F.concat_ws("\u0001", *[F.coalesce(c, F.lit("\u0002")) for c in (doc, "entity_type", "text", "location")]), 256))
    parts = each.select("_id", doc, F.explode(parts_of).alias("word"))
    strange = safe_join(parts, words, [doc, "word"], "left_anti").select("_id").distinct()
    short = each.join(parts.select("_id").distinct(), "_id", "left_anti")
    return each.join(strange, "_id", "left_semi").unionByName(short).drop("_id")


def report(leaks: DataFrame, others: DataFrame, blocks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One row per document of ``blocks``: clean (no leaks; advisory findings do not count), counts, sorted types, scanned_characters."""
    scanned = blocks.groupBy(doc).agg(F.sum(F.length("text")).alias("scanned_characters"))
    kinds = leaks.withColumn("kind", F.lit("leaked")).unionByName(others.withColumn("kind", F.lit("unexpected")))
    by = kinds.groupBy(doc).agg(F.count_if(F.col("kind") == "leaked").alias("leaked"), F.count_if(F.col("kind") == "unexpected").alias("unexpected"), F.array_join(F.sort_array(F.collect_set("entity_type")), ",").alias("types"))
    return safe_join(scanned, by, [doc], "left").select(doc, F.coalesce(F.col("leaked") == 0, F.lit(True)).alias("clean"), F.coalesce("leaked", F.lit(0)).alias("leaked"), F.coalesce("unexpected", F.lit(0)).alias("unexpected"), F.coalesce("types", F.lit("")).alias("types"), F.coalesce("scanned_characters", F.lit(0)).alias("scanned_characters"))
