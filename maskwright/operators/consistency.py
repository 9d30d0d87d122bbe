"""Names of a whole document: known names by vote, aliases, short forms, and the sweep for occurrences the detectors missed.

A null document is a document like others: joins take null as equal to null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.skew import safe_join, spread_join
from ..functions.spans import let, matches
from ..functions.vocab import LEGAL_TAIL, SPANS
from .names import identifying
from .resolve import reconcile, resolve


def type_votes(spans: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, name, entity_type): PERSON and ORG spans by lower-case text with the type most of them have, on a tie the first met (then by type).

    ``spans`` is exploded and has doc, block_id, start, entity_type, text. Null texts give no name.
    """
    s = spans.where(F.col("entity_type").isin("PERSON", "ORG") & F.col("text").isNotNull())
    votes = s.groupBy(doc, F.lower(F.trim("text")).alias("name"), "entity_type").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("block_id", "start")).alias("first"))
    return votes.groupBy(doc, "name").agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "entity_type")).alias("best")).select(doc, "name", F.col("best.entity_type").alias("entity_type"))


def known_names(spans: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, name, entity_type) of PERSON and ORG spans that pass the gate, by :func:`type_votes`."""
    return type_votes(spans.where(identifying(F.col("entity_type"), F.trim("text"))), doc)


def _unique(short: DataFrame, known: DataFrame, doc: str) -> DataFrame:
    """Aliases that one full name only gives and that are no known name themselves."""
    one = short.groupBy(doc, "alias").agg(F.count_distinct("name").alias("n"), F.min("name").alias("full")).where("n = 1 and alias <> full")
    return safe_join(one, known.select(doc, F.col("name").alias("alias")), [doc, "alias"], "left_anti").select(doc, "alias", "full")


def person_aliases(known: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, alias, full): first and last word of persons with three or more, where one full name only gives it and it is no known name itself."""
    parts = F.split("name", r"(?U)\s+")
    short = known.where(F.col("entity_type") == "PERSON").where(F.size(parts) >= 3).select(doc, "name", F.concat_ws(" ", F.element_at(parts, 1), F.element_at(parts, -1)).alias("alias"))
    return _unique(short, known, doc)


def firm_short_forms(known: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, alias, full): names of firms without their legal form, of two or more words, unique in the document and no known name."""
    short = known.where(F.col("entity_type") == "ORG").select(doc, "name", F.trim(F.regexp_replace("name", LEGAL_TAIL, "")).alias("alias"))
    return _unique(short.where((F.col("alias") != F.col("name")) & (F.size(F.split("alias", r"(?U)\s+")) >= 2)), known, doc)


def all_names(known: DataFrame, doc: str = "doc_id", aliases: bool = True) -> DataFrame:
    """(doc, name, entity_type, full): known names, aliases and short forms; ``full`` is the name whose replacement is used."""
    every = known.select(doc, "name", "entity_type", F.col("name").alias("full"), F.lit(0).alias("rank"))
    if aliases:
        every = every.unionByName(person_aliases(known, doc).select(doc, F.col("alias").alias("name"), F.lit("PERSON").alias("entity_type"), "full", F.lit(1).alias("rank")))
        every = every.unionByName(firm_short_forms(known, doc).select(doc, F.col("alias").alias("name"), F.lit("ORG").alias("entity_type"), "full", F.lit(2).alias("rank")))
    return every.groupBy(doc, "name").agg(F.max(F.struct("rank", "entity_type", "full")).alias("b")).select(doc, "name", "b.entity_type", "b.full")


def occurrences(text: Column, names: Column) -> Column:
    """Spans of the places of names (struct<name, entity_type>, lower case) in a text, in any case, at word bounds; source consistency_sweep, 0.75."""
    word = r"[\p{L}\p{N}\p{M}_]"

    def of(n: Column) -> Column:
        found = matches(text, F.concat(F.lit(rf"(?iu)(?<!{word})\Q"), F.replace(n["name"], F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(rf"\E(?!{word})")))
        return F.transform(found, lambda m: F.struct(n["entity_type"].alias("entity_type"), m["text"].alias("text"), m["start"].alias("start"), m["end"].alias("end"), F.lit(0.75).alias("confidence"), F.lit("consistency_sweep").alias("source")))

    return F.flatten(F.transform(names, of)).cast(SPANS)


#: The word behind a word, in group 1: what the word bounds of :func:`occurrences` tell apart; empty if there is none.
BEHIND = r"(?U)\w+(?=[^\p{L}\p{N}\p{M}_]*+([\p{L}\p{N}\p{M}_]+)?)"
#: First words of a document's names are told by so many buckets.
BUCKETS = 16_384


def _folded(word: Column) -> Column:
    """Equal for any two words that are the same in any case, as patterns take it."""
    return F.upper(F.lower(word))


def sweep(blocks: DataFrame, names: DataFrame, doc: str = "doc_id", row: list[str] | None = None) -> DataFrame:
    """``blocks`` (doc, block_id, text, spans) with occurrences of the document's names that no span covers yet, resolved and reconciled.

    Each block is told the first words of its document's names (at most 16,384 buckets a document), and only its words that may be such a one go on,
    each with the word behind it. These and the first two words of names are joined by equality on (doc, word, word): what is shuffled are the few names
    that may stand in a block, however many names of a document begin alike. Only then they are sought in the text. A document with very many words
    is split. Longer names go first. Null texts stay as they are. ``row``, never null, tells a block from all others (default doc and block_id, which may be).
    """
    keys = row or [doc, "block_id"]
    n = names.where(F.col("name").rlike(r"(?U)\w")).select(doc, "name", "entity_type", F.regexp_extract("name", r"(?U)\w+", 0).alias("first"), _folded(F.regexp_extract("name", BEHIND, 1)).alias("second"))
    bucket = lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")
    alone = F.col("second") == ""
    told = n.groupBy(doc).agg(F.collect_set(F.when(~alone, bucket(F.col("first")))).alias("_led"), F.collect_set(F.when(alone, bucket(F.col("first")))).alias("_alone"))
    # a word stands once a block here, so no (document, word) has more rows than its document has blocks
    sizes = blocks.groupBy(doc).agg(F.count(F.lit(1)).alias("n"))
    text = spread_join(blocks.where(F.col("text").isNotNull()).select(*dict.fromkeys([doc, *keys]), "text"), told, [doc], F.struct(*keys), counts=sizes)
    firsts = F.transform(F.regexp_extract_all("text", F.lit(r"(?U)\w+"), F.lit(0)), lambda w: F.lower(w))
    words = F.array_distinct(F.zip_with(firsts, F.regexp_extract_all("text", F.lit(BEHIND), F.lit(1)), lambda w, v: F.struct(w.alias("first"), _folded(v).alias("second"), bucket(w).alias("at"))))
    text = text.select(*dict.fromkeys([doc, *keys]), "_led", "_alone", words.alias("_w"))
    ats = F.transform("_w", lambda w: w["at"])
    text = text.withColumn("_led", F.array_intersect(ats, "_led")).withColumn("_alone", F.array_intersect(ats, "_alone"))
    led = F.filter("_w", lambda w: F.array_contains("_led", w["at"]) & (w["second"] != ""))
    lone = F.transform(F.filter("_w", lambda w: F.array_contains("_alone", w["at"])), lambda w: F.struct(w["first"].alias("first"), F.lit("").alias("second"), w["at"].alias("at")))
    word = text.where((F.size("_led") > 0) | (F.size("_alone") > 0)).select(*dict.fromkeys([doc, *keys]), F.inline(F.array_distinct(F.concat(led, lone)))).drop("at")
    cand = spread_join(word, n, [doc, "first", "second"], F.struct(*keys), counts=sizes, hot_on=[doc])
    hits = cand.groupBy(*keys).agg(F.collect_set(F.struct("name", "entity_type")).alias("hits"))
    j = blocks.join(hits, row, "left") if row else safe_join(blocks, hits, keys, "left")
    longest = lambda spans: F.transform(F.array_sort(F.transform(spans, lambda s: F.struct((-F.length(s["text"])).alias("l"), s["start"].alias("at"), s["entity_type"].alias("t"), s.alias("s")))), lambda k: k["s"])
    add = lambda found: F.aggregate(found, F.col("spans"), lambda kept, s: F.when(F.exists(kept, lambda k: (k["end"] > s["start"]) & (k["start"] < s["end"])), kept).otherwise(F.concat(kept, F.array(s))).cast(SPANS))
    merged = let(longest(occurrences(F.col("text"), F.col("hits"))), add)
    spans = F.when(F.col("hits").isNull(), reconcile(F.col("spans"))).otherwise(reconcile(resolve(merged)))
    return j.withColumn("spans", spans.cast(SPANS)).drop("hits")


def email_hints(spans: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, email, person): for each e-mail address of a document the first person whose dotted or joined name its local part holds.

    Addresses and persons meet by equality on (doc, the first three signs of the name at any place of the local part).
    """
    p = spans.where("entity_type = 'PERSON'").groupBy(doc, F.lower(F.trim("text")).alias("person")).agg(F.min(F.struct("block_id", "start")).alias("first"))
    p = p.withColumn("dotted", F.regexp_replace("person", r"(?U)\s+", ".")).withColumn("joined", F.regexp_replace("person", r"(?U)\s+", ""))
    p = p.withColumn("gram", F.explode(F.array_distinct(F.array(F.substring("dotted", 1, 3), F.substring("joined", 1, 3))))).where("gram <> ''")
    e = spans.where("entity_type = 'EMAIL'").select(doc, F.lower(F.trim("text")).alias("email")).distinct().withColumn("local", F.substring_index("email", "@", 1)).where("local <> ''")
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.length("local")), lambda i: F.transform(F.array(*[F.lit(k) for k in (1, 2, 3)]), lambda k: F.substring(F.col("local"), i, k))))
    e = e.withColumn("gram", F.explode(F.array_distinct(grams)))
    hit = spread_join(e, p, [doc, "gram"], F.col("email")).where(F.contains("local", "dotted") | F.contains("local", "joined"))
    return hit.groupBy(doc, "email").agg(F.min(F.struct("first", "person")).alias("b")).select(doc, "email", F.col("b.person").alias("person"))
