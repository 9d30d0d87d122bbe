"""Detector of postal addresses: lead-in phrase, labelled cell, split line, and sentences with postcode and keyword."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.spans import let, matches, no_spans, typed

# Postcodes, words of addresses, labels of address fields, phrases before an address.
PIN = r"(?U)\b\d{3}[\s-]?\d{3}\b"
KEYWORDS = (
    r"(?iU)\b(?:Road|Rd|Street|St|Lane|Marg|Path|Avenue|Highway|Bypass|Cross|Circle|Gali|Village|Taluka|Tehsil|District|Dist|Post|Mandal|Ward|Sector|Phase|Zone|Tower|Towers|Building|Bldg|Centre|Center|Complex|Estate|Industrial|Park|"
    r"Plot|Gat|Survey|Khasra|Floor|Wing|Unit|Premises|Compound|House|Bhavan|Chambers|Mansion|Heights|Residency|Arcade|Plaza|Apartments?|Block|Nagar|Colony|Layout|Society|Vihar|Puram|Pura|Bagh|Enclave|Garden|Gardens|"
    r"Wadi|Peth|Chowk|Bazaar|Bazar|Market|Farms|Farm|Extension|Annexe|Annex|Opposite|Opp|Behind|Near|Beside|Adjacent)\b"
)
LABEL = r"(?iU)^\s*(?:our\s+|the\s+)?(?:registered\s+office|corporate\s+office|head\s+office|branch\s+office|registered\s+address|correspondence\s+address|office\s+address|address)\b"
LEAD_IN = r"(?iU)(?:situated at|located at|resides?\s+at|residing at|office at|registered address(?:\s+is)?:?|address(?:\s+is)?:?|(?:registered|corporate) office\s*:|contact details?[^:\n]{0,40}:)\s+"
CLAUSE_END = r"(?U)\n|;|(?i)\s+and\s+(?:its|our|the)\s+|(?-i)(?<!No)(?<!Nos)(?<!Sr)(?<!Jr)(?<!Dr)(?<!St)(?<!Rd)(?<!Mr)(?<!Ms)\.(?:\s|$)"
WINDOW = 240


def looks_like_address(text: Column) -> Column:
    return text.rlike(PIN) | text.rlike(KEYWORDS)


def clause(window: Column) -> Column:
    """The text up to the first line end, semicolon, other field or sentence end, without punctuation at its end."""
    return F.regexp_replace(F.element_at(F.split(window, CLAUSE_END, 2), 1), r"[ ,.;:]+$", "")


def _whole(text: Column) -> Column:
    """The block without blanks at its edges, as one match."""
    t = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    start = F.length(text) - F.length(F.regexp_replace(text, r"(?U)^\s+", ""))
    return F.array(F.struct(t.alias("text"), start.cast("int").alias("start"), (start + F.length(t)).cast("int").alias("end")))


def addresses(text: Column, context: Column | None = None) -> Column:
    """ADDRESS spans of a block; ``context`` is the label of its cell or the text of its neighbours. Null text gives none."""
    ctx = F.coalesce(context, F.lit("")) if context is not None else F.lit("")

    def after(m: Column) -> Column:
        return let(clause(F.substring(text, m["end"] + 1, F.lit(WINDOW))), lambda c: F.struct(c.alias("text"), m["end"].alias("start"), (m["end"] + F.length(c)).cast("int").alias("end")))

    lead = F.filter(F.transform(matches(text, LEAD_IN, r"(?iU)\sat\s|address|office|contact detail"), after), lambda m: (F.length(m["text"]) >= 5) & looks_like_address(m["text"]))
    one = typed(lead, "ADDRESS", 0.9, "heuristic")
    stripped = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    cell = ctx.rlike(LABEL) & (F.length(stripped) >= 12) & looks_like_address(stripped)
    line = (ctx != "") & F.length(stripped).between(1, 120) & ~F.endswith(stripped, F.lit(".")) & (F.contains(stripped, F.lit(",")) | stripped.rlike(r"(?U)\d")) & looks_like_address(stripped) & F.concat_ws(" ", ctx, stripped).rlike(PIN)
    first = let(one, lambda o: F.when(F.size(o) > 0, o).when(cell, typed(_whole(text), "ADDRESS", 0.88, "heuristic")).when(line, typed(_whole(text), "ADDRESS", 0.82, "heuristic")).otherwise(no_spans()))
    # sentences: the gaps between sentence ends, trimmed at the right
    sentence = r"(?Us)\S.*?(?:(?<=[.!?])(?=\s)|$)"
    found = F.filter(matches(text, sentence, r"(?U)\d{3}[\s-]?\d{3}"), lambda m: m["text"].rlike(PIN) & m["text"].rlike(KEYWORDS) & (F.length(F.rtrim(m["text"])) >= 8))
    trimmed = F.transform(found, lambda m: F.struct(F.regexp_replace(m["text"], r"(?U)\s+$", "").alias("text"), m["start"].alias("start"), (m["start"] + F.length(F.regexp_replace(m["text"], r"(?U)\s+$", ""))).cast("int").alias("end")))
    sentences = typed(trimmed, "ADDRESS", 0.8, "heuristic")
    both = let(first, lambda f: F.concat(f, F.filter(sentences, lambda s: ~F.exists(f, lambda c: (c["start"] <= s["start"]) & (s["end"] <= c["end"])))))
    return F.when(text.isNotNull(), both).otherwise(no_spans())
