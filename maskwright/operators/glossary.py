"""Defined terms of a document: cleaning, variants, the glossary table and its anti-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.skew import safe_join

MAX_TERM, MAX_CELL, MAX_ALIAS = 60, 180, 90
# Words that make a description the name of a firm.
_FIRM_WORD = r"(?iU)\b(?:Ltd|Limited|LLP|Pvt|Private|Inc|Corp|Corporation|Bank|PLC|LLC|Partners|Associates|Advisors|Securities)\b"


def clean(raw: Column) -> Column:
    """Without double quotes, blanks collapsed, edge punctuation off."""
    flat = F.trim(F.regexp_replace(F.regexp_replace(raw, "[\"“”]", ""), r"(?U)\s+", " "))
    return F.regexp_replace(flat, "^[,;:]+|[,;:]+$", "")


def normalise(raw: Column) -> Column:
    """Cleaned, lower case, one leading article off."""
    return F.trim(F.regexp_replace(F.lower(clean(raw)), r"^(?:the|our|an|a)\s+", ""))


def is_company_alias(term: Column, description: Column) -> Column:
    """Whether a term is the short name of a firm: a short description that holds a legal form and one of the term's alternatives."""
    parts = F.transform(F.split(F.lower(clean(term)), r"\s*/\s*|\s+or\s+"), lambda x: F.trim(x))
    return (F.length(description) <= MAX_ALIAS) & description.rlike(_FIRM_WORD) & F.exists(parts, lambda x: (F.length(x) > 0) & F.contains(F.lower(description), x))


def variants(term: Column) -> Column:
    """Distinct writings of one term: without "(s)", with and without a final s (terms of over three signs); over-long terms give none."""
    t = F.regexp_replace(normalise(term), r"\(s\)$", "")
    more = F.when(F.length(t) > 3, F.array(t, F.when(F.endswith(t, F.lit("s")), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(F.concat(t, F.lit("s"))))).otherwise(F.array(t))
    return F.when((F.length(t) > 0) & (F.length(t) <= MAX_TERM), F.array_distinct(more)).otherwise(F.array().cast("array<string>"))


def is_glossary_header(first: Column, others: Column) -> Column:
    """Header row of a glossary table: first cell "term(s)", another "description(s)", "definition" or "meaning"."""
    low = F.trim(F.lower(first))
    return low.isin("term", "terms", "term(s)") & F.exists(others, lambda c: F.trim(F.lower(c)).isin("description", "descriptions", "definition", "definitions", "meaning"))


def glossary(rows: DataFrame, doc: str = "doc_id", term: str = "term", description: str = "description") -> DataFrame:
    """Distinct (doc, term) of two-column glossary rows; empty and over-long cells, and short names of firms, are left out. Nulls give no term."""
    ok = rows.where(F.col(term).isNotNull() & (F.length(term) <= MAX_CELL)).where(~F.coalesce(is_company_alias(F.col(term), F.col(description)), F.lit(False)))
    parts = ok.select(doc, F.explode(F.split(clean(F.col(term)), r"(?iU)\s*/\s*|\s+or\s+")).alias("part"))
    return parts.select(doc, F.explode(variants(F.col("part"))).alias("term")).distinct()


def without_terms(spans: DataFrame, terms: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Name spans that are no defined term, neither as written nor without a prefix such as pre- or post- (left anti joins on the document)."""
    t = terms.select(doc, F.col("term").alias("_n"))
    key = spans.withColumn("_n", normalise(F.col("text"))).withColumn("_m", F.trim(F.regexp_replace("_n", r"^(?:pre|post|non|sub|re)[-\s]+", "")))
    name = F.col("entity_type").isin("PERSON", "ORG")
    # spans that are no names have no key that a term could have
    key = key.withColumns({"_n": F.when(name, F.col("_n")), "_m": F.when(name & (F.col("_m") != ""), F.col("_m"))})
    out = safe_join(key, t.where("_n is not null"), [doc, "_n"], "left_anti")
    return safe_join(out, t.where("_n is not null").withColumnRenamed("_n", "_m"), [doc, "_m"], "left_anti").drop("_n", "_m")
