"""Detectors of names of persons and firms from labels and legal forms, and the predicates on names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.spans import let, matches, no_spans, typed
from ..functions.vocab import ACRONYMS, LABEL_WORDS, PROCESS_WORDS, PUBLIC_BODIES, SPANS, STOPWORDS, STRONG_FIRM, TITLE_WORDS
from .glossary import normalise

# Labels before names, labels that end a name, the shape of names.
CONTACT = r"(?iU)(?:Contact\s+Person(?:\(s\))?|Contact|Compliance\s+Officer|Company\s+Secretary|Name\s+of\s+(?:the\s+)?Contact\s+Person)\s*[:\-]\s*"
FIELD = r"(?iU)\b(?:Website|Web|Email|E-?mail|Telephone|Tel|Fax|SEBI|Investor|Address|CIN|Registration|Registered|Corporate|Contact)\b"
NAME = r"(?U)\b[A-Z][A-Za-z.'’-]*(?:\s+[A-Z][A-Za-z.'’-]*){1,3}"
LEGAL_NAME = r"(?U)\b(?:(?:[A-Z][\w&.\-]*|&)\s+){1,6}?(?:Private\s+|Pvt\.?\s+)?(?:Limited|Ltd\.?|LLP|LLC|PLC|Incorporated|Inc\.?|Corporation|Corp\.?)(?!\w)"
CONNECTORS = r"^(?:(?i:formerly|namely|erstwhile|and|or|the|our|its|viz|including)[,.]*\s+(?=\S+\s+\S))+"
# Words for a firm that name none, codes that are none, and what makes a single word of a recogniser a firm.
GENERIC_FIRMS = ("company", "the company", "issuer", "the issuer", "the corporation")
CODE = r"(?U)\b[A-Za-z]{1,6}-?\d{3,}\b"
FIRM_WORD = r"(?iU)\b(?:Ltd|Limited|LLP|Pvt|Inc|Corp|Corporation|Bank|Group|Partners|Advisors|Associates|Company|Co\.|PLC|LLC)\b"
WINDOW = 160


def content_words(text: Column) -> Column:
    """Lower-case words without edge punctuation, possessive 's and stop-words."""
    words = F.transform(F.split(F.lower(F.trim(text)), r"(?U)\s+"), lambda w: F.regexp_replace(F.regexp_replace(w, "^[,.'’]+|[,.'’]+$", ""), "['’]s$", ""))
    return F.filter(words, lambda w: (w != "") & ~w.isin(*STOPWORDS))


def is_acronym(text: Column) -> Column:
    return F.upper(F.regexp_replace(F.trim(text), ":+$", "")).isin(*ACRONYMS)


def is_title_phrase(text: Column) -> Column:
    return let(content_words(text), lambda w: (F.size(w) > 0) & F.forall(w, lambda x: x.isin(*TITLE_WORDS)))


def is_label_phrase(text: Column) -> Column:
    return let(content_words(text), lambda w: (F.size(w) > 0) & F.forall(w, lambda x: x.isin(*LABEL_WORDS)))


def is_public_body(text: Column) -> Column:
    return normalise(text).isin(*PUBLIC_BODIES)


def _words(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.trim(text), r"(?U)\s+"), lambda w: F.regexp_replace(w, "^[,.'’-]+|[,.'’-]+$", "")), lambda w: w != "")


def sweepable_person(text: Column) -> Column:
    """Two or more words, all capitalised, no stop-word and no offer noun."""
    ok = lambda w: (F.size(w) >= 2) & F.forall(w, lambda x: ~x.rlike(r"^\p{L}") | x.rlike(r"^[\p{Lu}\p{Lt}]")) & ~F.exists(w, lambda x: F.lower(x).isin(*STOPWORDS, *PROCESS_WORDS))
    return let(_words(text), ok)


def firm_shape(text: Column) -> Column:
    """Two or more words, first and last capitalised and with letters."""
    edge = lambda x: x.rlike(r"\p{L}") & (~x.rlike(r"^\p{L}") | x.rlike(r"^[\p{Lu}\p{Lt}]"))
    return let(_words(text), lambda w: F.when(F.size(w) >= 2, edge(F.try_element_at(w, F.lit(1))) & edge(F.try_element_at(w, F.lit(-1)))).otherwise(False))


def sweepable_firm(text: Column) -> Column:
    """A firm's shape with a company word, or three or more words in a person's shape."""
    return (firm_shape(text) & text.rlike(rf"(?iU)\b(?:{STRONG_FIRM})\b")) | (sweepable_person(text) & (F.size(F.split(F.trim(text), r"(?U)\s+")) >= 3))


def identifying(entity_type: Column, text: Column) -> Column:
    """Whether every occurrence of the text may be treated alike; all types but names always qualify."""
    return F.when(entity_type == "PERSON", sweepable_person(text)).when(entity_type == "ORG", sweepable_firm(text)).otherwise(True)


def contact_persons(text: Column, heading: Column | None = None) -> Column:
    """PERSON spans after contact labels: the next 160 signs up to the next label hold two to four capitalised words each. None in headings."""
    leads = matches(text, CONTACT, "(?i)contact|officer|secretary")

    def of(m: Column) -> Column:
        part = F.element_at(F.split(F.substring(text, m["end"] + 1, F.lit(WINDOW)), FIELD, 2), 1)
        found = F.filter(matches(part, NAME), lambda n: F.size(F.split(n["text"], r"(?U)\s+")).between(2, 4) & ~is_title_phrase(n["text"]) & ~is_acronym(n["text"]))
        return F.transform(found, lambda n: F.struct(n["text"].alias("text"), (n["start"] + m["end"]).alias("start"), (n["end"] + m["end"]).alias("end")))

    got = typed(F.array_distinct(F.flatten(F.transform(leads, of))), "PERSON", 0.8, "heuristic")
    return F.when(F.coalesce(heading, F.lit(False)), no_spans()).otherwise(got) if heading is not None else got


def firm_excluded(text: Column, strict: Column | None = None, issuers: tuple[str, ...] = ()) -> Column:
    """Spans that are no firm: acronyms, public bodies, codes, labels, generic words, the issuer, and in headings all without a company word."""
    low = F.lower(F.trim(text))
    out = is_acronym(text) | is_public_body(text) | text.rlike(CODE) | is_label_phrase(text) | low.isin(*GENERIC_FIRMS)
    if strict is not None:
        out = out | (F.coalesce(strict, F.lit(False)) & ~text.rlike(rf"(?iU)\b(?:{STRONG_FIRM})\b"))
    for name in issuers:
        out = out | F.contains(low, F.lit(name)) | F.contains(F.lit(name), low)
    return out


def legal_form_firms(text: Column, heading: Column | None = None, issuers: tuple[str, ...] = ()) -> Column:
    """ORG spans: up to six capitalised words before a legal form; words that only introduce the name are cut off its start."""

    def cut(m: Column) -> Column:
        return let(F.regexp_replace(m["text"], CONNECTORS, ""), lambda t: F.struct(t.alias("text"), (m["end"] - F.length(t)).alias("start"), m["end"].alias("end")))

    found = F.transform(matches(text, LEGAL_NAME, r"(?:Limited|Ltd|LLP|LLC|PLC|Inc|Corp)"), cut)
    return typed(F.filter(found, lambda m: (F.size(F.split(m["text"], r"(?U)\s+")) >= 2) & ~firm_excluded(m["text"], heading, issuers)), "ORG", 0.9, "heuristic")


def recognised(spans: Column, text: Column, heading: Column | None = None, issuers: tuple[str, ...] = ()) -> Column:
    """Filters the spans of a statistical recogniser (struct<entity_type, text, start, end>) as PERSON and ORG."""
    persons = F.filter(spans, lambda s: (s["entity_type"] == "PERSON") & ~is_acronym(s["text"]) & ~is_title_phrase(s["text"]) & ~is_public_body(s["text"]) & s["text"].rlike(r"\p{L}"))
    shape = lambda t: (F.size(F.split(F.trim(t), r"(?U)\s+")) >= 2) | t.rlike(FIRM_WORD) | t.rlike(r"^[\p{Lu}&]{2,6}$")
    firms = F.filter(spans, lambda s: (s["entity_type"] == "ORG") & shape(s["text"]) & ~firm_excluded(s["text"], heading, issuers))
    persons = F.when(F.coalesce(heading, F.lit(False)), no_spans()).otherwise(persons.cast(SPANS)) if heading is not None else persons
    return F.concat(persons, firms).cast(SPANS)
