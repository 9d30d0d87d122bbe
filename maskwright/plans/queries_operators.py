"""Queries of single operators, each through the library, with SQL twins: over delivered tables, and over texts made from keys of whole tables.

A made text is one SQL expression that both engines evaluate; its twin says by arithmetic on the key what must be found, near-misses included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.skew import running, safe_join
from ..functions.spans import no_spans
from ..functions.vocab import SPANS, DetectionConfig, priority, splittable, tier
from ..operators import address, consistency, evaluate, glossary, names, pseudonymise, resolve, structured, verify
from . import pipeline
from .queries import _near_sql, _spans_sql, _t, query


def _made(s: SparkSession, sf: str, table: str, **columns: str) -> DataFrame:
    """Columns of SQL expressions over a whole table."""
    return _t(s, sf, table).selectExpr(*[f"{e} AS `{c}`" for c, e in columns.items()])


def _spans(df: DataFrame, spans: Column, *keep: str) -> DataFrame:
    return df.select("rec_id", *keep, F.inline(spans)).select("rec_id", *keep, "entity_type", F.col("text").alias("span"), F.col("start").alias("start_pos"), F.col("end").alias("end_pos"))


def _span_sql(table: str, key: str, text: str, kind: str, span: str, where: str) -> str:
    """The twin of :func:`_spans` over a made text that holds at most one span, given as an SQL expression (null: none)."""
    return (
        f"SELECT rec_id, '{kind}' AS entity_type, span, CAST(strpos(text, span) - 1 AS INT) AS start_pos, CAST(strpos(text, span) - 1 + length(span) AS INT) AS end_pos "
        f"FROM (SELECT {key} AS rec_id, {text} AS text, {span} AS span FROM {table} WHERE {where}) WHERE span IS NOT NULL"
    )


def _pick(key: str, *words: str) -> str:
    return f"CASE {key} % {len(words)} " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(words)) + " END"


# ---- structured types on made texts --------------------------------------------------------------------------------------------------------

_K = "c_custkey"
_PHONE = (
    f"CASE {_K} % 6 WHEN 0 THEN concat('Call +91 98765 ', lpad(concat({_K} % 100000), 5, '0'), ' now') WHEN 1 THEN concat('Ref 1234 ', lpad(concat({_K} % 1000), 3, '0'), ' here') WHEN 2 THEN concat('INM0000', lpad(concat({_K} % 100000), 5, '0')) "
    f"WHEN 3 THEN concat('+1 234 567 ', lpad(concat({_K} % 100), 2, '0'), ' is short') WHEN 4 THEN concat('Tel 022-2659-8', lpad(concat({_K} % 1000), 3, '0'), '.') ELSE concat('Long 123456789012', lpad(concat({_K} % 100), 2, '0'), ' one') END"
)


@query(_span_sql("customer", _K, _PHONE, "PHONE", f"CASE {_K} % 6 WHEN 0 THEN concat('+91 98765 ', lpad(concat({_K} % 100000), 5, '0')) WHEN 4 THEN concat('022-2659-8', lpad(concat({_K} % 1000), 3, '0')) END", "true"))
def x2_phone_shapes(s: SparkSession, sf: str) -> DataFrame:
    """Numbers with prefix, with separators, too short, behind letters, of a length their country lacks, too long."""
    return _spans(_made(s, sf, "customer", rec_id=_K, text=_PHONE), structured.phone(F.col("text")))


_IP = f"concat('host 10.', {_K} % 256, '.', {_K} % 300, '.', {_K} % 270, CASE WHEN {_K} % 7 = 0 THEN '' ELSE ' up' END)"


@query(_span_sql("customer", _K, _IP, "IP_ADDRESS", f"CASE WHEN {_K} % 300 <= 255 AND {_K} % 270 <= 255 THEN concat('10.', {_K} % 256, '.', {_K} % 300, '.', {_K} % 270) END", "true"))
def x3_ipv4_shapes(s: SparkSession, sf: str) -> DataFrame:
    return _spans(_made(s, sf, "customer", rec_id=_K, text=_IP), structured.ip_address(F.col("text")))


_PASS = f"CASE {_K} % 4 WHEN 0 THEN concat('Passport No: M', lpad(concat({_K}), 7, '1'), ' valid') WHEN 1 THEN concat('Reference M', lpad(concat({_K}), 7, '1')) WHEN 2 THEN concat('passport is kept in a box that is a long way off, no. M', lpad(concat({_K}), 7, '1')) ELSE concat('Passport MM', lpad(concat({_K}), 7, '1')) END"


@query(_span_sql("customer", _K, _PASS, "PASSPORT_NUMBER", f"CASE {_K} % 4 WHEN 0 THEN concat('M', lpad(concat({_K}), 7, '1')) END", "true"))
def x13_passport_shapes(s: SparkSession, sf: str) -> DataFrame:
    """With its label, without, with the label too far away, and with a letter too many."""
    return _spans(_made(s, sf, "customer", rec_id=_K, text=_PASS), structured.passport_number(F.col("text")))


_VOTE = f"CASE {_K} % 4 WHEN 0 THEN concat('EPIC: ABC', lpad(concat({_K}), 7, '1')) WHEN 1 THEN concat('Batch ABC', lpad(concat({_K}), 7, '1')) WHEN 2 THEN concat('Voter ID AB', lpad(concat({_K}), 7, '1')) ELSE concat('elector ', 'XYZ', lpad(concat({_K}), 7, '2'), ';') END"


@query(_span_sql("customer", _K, _VOTE, "VOTER_ID", f"CASE {_K} % 4 WHEN 0 THEN concat('ABC', lpad(concat({_K}), 7, '1')) WHEN 3 THEN concat('XYZ', lpad(concat({_K}), 7, '2')) END", "true"))
def x14_voter_shapes(s: SparkSession, sf: str) -> DataFrame:
    return _spans(_made(s, sf, "customer", rec_id=_K, text=_VOTE), structured.voter_id(F.col("text")))


_UNI = "SELECT id, regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g') AS text FROM real_sample"


@query(_spans_sql(_UNI, "id", structured.VOTER) + f"SELECT rec_id, span, start_pos FROM s WHERE {_near_sql(40, '(?i)voter|epic|elector')}")
def x14_voter_blocks(s: SparkSession, sf: str) -> DataFrame:
    """Over all blocks, each sign beyond ASCII written as a letter, so that the word bounds of both engines agree."""
    t = _t(s, sf, "real_sample").select(F.col("id").alias("rec_id"), F.regexp_replace("text", r"[^\x00-\x7F]", "x").alias("text"))
    return _spans(t, structured.voter_id(F.col("text"))).select("rec_id", "span", "start_pos")


# ---- names, firms, addresses ---------------------------------------------------------------------------------------------------------------

_NAME = f"concat({_pick(_K, 'Asha', 'Rohan', 'Meera', 'Vikram')}, ' ', {_pick(_K, 'Rao', 'Hegde', 'Menon', 'Iyer', 'Nayak')})"
_CONTACT = (
    f"CASE {_K} % 6 WHEN 0 THEN concat('Contact Person: ', {_NAME}, ', Tel: 12') WHEN 1 THEN concat('We met ', {_NAME}) WHEN 2 THEN concat('Compliance Officer - ', {_NAME}, ' Email: a') "
    f"WHEN 3 THEN concat('Company Secretary: ', lower({_NAME})) WHEN 4 THEN 'Contact Person: Managing Director' ELSE concat('Contact Person: see ', repeat('- ', 90), {_NAME}) END"
)


@query(_span_sql("customer", _K, _CONTACT, "PERSON", f"CASE WHEN {_K} % 6 IN (0, 2) THEN {_NAME} END", "true"))
def n3_contact_shapes(s: SparkSession, sf: str) -> DataFrame:
    """Behind labels, without one, in small letters, a role instead of a name, and a name beyond the window."""
    return _spans(_made(s, sf, "customer", rec_id=_K, text=_CONTACT), names.contact_persons(F.col("text")))


@query(f"SELECT {_K} AS rec_id, CAST(CASE WHEN {_K} % 2 = 0 AND {_K} % 6 IN (0, 2) THEN 1 ELSE 0 END AS BIGINT) AS persons FROM customer")
def n7_headings_name_nobody(s: SparkSession, sf: str) -> DataFrame:
    """The texts of n3_contact_shapes, every odd one as a heading."""
    t = _made(s, sf, "customer", rec_id=_K, text=_CONTACT)
    return t.select("rec_id", F.size(names.contact_persons(F.col("text"), F.col("rec_id") % 2 == 1)).cast("long").alias("persons"))


_FIRM = f"concat({_pick(_K, 'Amber', 'Bluepeak', 'Cedarway')}, ' ', {_pick(_K, 'Tools', 'Foods', 'Steel', 'Cables')}, ' ', {_pick(_K, 'Private Limited', 'Ltd.', 'LLP', 'Inc.', 'Corporation')})"
_FIRMS = (
    f"CASE {_K} % 6 WHEN 0 THEN concat('pays ', {_FIRM}, ' now') WHEN 1 THEN concat('pays ', {_pick(_K, 'Amber', 'Bluepeak')}, ' Tools now') WHEN 2 THEN concat('ask Formerly Namely ', {_FIRM}, ' then') "
    f"WHEN 3 THEN 'with Securities and Exchange Board of India' WHEN 4 THEN concat('of Kept Issuer ', {_FIRM}, ' only') ELSE concat('in ', 'Limited', ' numbers') END"
)


@query(_span_sql("customer", _K, _FIRMS, "ORG", f"CASE WHEN {_K} % 6 IN (0, 2) THEN {_FIRM} END", "true"))
def n5_firm_shapes(s: SparkSession, sf: str) -> DataFrame:
    """With a legal form, without, behind words that introduce it, a public body, the issuer, and a legal form alone."""
    return _spans(_made(s, sf, "customer", rec_id=_K, text=_FIRMS), names.legal_form_firms(F.col("text"), None, ("kept issuer",)))


_STREET = f"concat({_K} % 900 + 1, ', Lotus Road, Pune 4', lpad(concat({_K} % 100000), 5, '0'))"
_ADDR = (
    f"CASE {_K} % 7 WHEN 0 THEN concat('The firm is situated at ', {_STREET}, '; and its works') WHEN 1 THEN {_STREET} WHEN 2 THEN concat('Lotus Tower, wing ', {_K} % 9) WHEN 3 THEN concat('It moved. The office of record is ', {_STREET}, '. So it was.') "
    f"WHEN 4 THEN concat('Plain words number ', {_K} % 9, ' here') WHEN 5 THEN {_STREET} ELSE concat('resides at ', 'home') END"
)
_CTX = f"CASE {_K} % 7 WHEN 1 THEN 'Registered Office' WHEN 2 THEN 'Pune 411001' WHEN 5 THEN 'Remarks' ELSE '' END"


_SPAN8 = f"CASE {_K} % 7 WHEN 0 THEN {_STREET} WHEN 1 THEN {_STREET} WHEN 2 THEN {_ADDR} WHEN 3 THEN concat('The office of record is ', {_STREET}, '.') WHEN 5 THEN {_STREET} END"


@query(
    "SELECT rec_id, 'ADDRESS' AS entity_type, span, CAST(strpos(text, span) - 1 AS INT) AS start_pos, CAST(strpos(text, span) - 1 + length(span) AS INT) AS end_pos, confidence FROM ("
    f"SELECT {_K} AS rec_id, {_ADDR} AS text, {_SPAN8} AS span, CAST(CASE {_K} % 7 WHEN 0 THEN 0.9 WHEN 1 THEN 0.88 WHEN 2 THEN 0.82 WHEN 5 THEN 0.82 ELSE 0.8 END AS DOUBLE) AS confidence FROM customer "
    f"UNION ALL SELECT {_K}, {_ADDR}, {_ADDR}, CAST(0.8 AS DOUBLE) FROM customer WHERE {_K} % 7 = 0) WHERE span IS NOT NULL"
)
def n8_address_rules(s: SparkSession, sf: str) -> DataFrame:
    """Each of the four rules: lead-in (and the sentence around it), labelled cell, line that goes on in its neighbour, sentence with postcode; and two that are no address."""
    t = _made(s, sf, "customer", rec_id=_K, text=_ADDR, context=_CTX)
    got = t.select("rec_id", F.inline(address.addresses(F.col("text"), F.col("context"))))
    return got.select("rec_id", "entity_type", F.col("text").alias("span"), F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "confidence")


_GATE = f"CASE {_K} % 8 WHEN 0 THEN {_NAME} WHEN 1 THEN {_pick(_K, 'Rao', 'Menon')} WHEN 2 THEN concat('Selling ', {_NAME}) WHEN 3 THEN lower({_NAME}) WHEN 4 THEN concat({_NAME}, ' Securities') WHEN 5 THEN concat('The ', {_NAME}) WHEN 6 THEN concat({_NAME}, ' de Sa') ELSE concat({_pick(_K, 'Rao', 'Menon')}, ' Bank') END"


@query(f"SELECT {_K} AS rec_id, {_K} % 8 IN (0, 4) AS person, {_K} % 8 IN (0, 2, 4, 5, 6, 7) AS shape, {_K} % 8 IN (4, 7) AS firm, {_K} % 8 IN (0, 4) AS identifying_person, {_K} % 8 IN (4, 7) AS identifying_firm, true AS identifying_email FROM customer")
def f7_gates(s: SparkSession, sf: str) -> DataFrame:
    """Which names may be searched for everywhere. Two words; one; an offer noun; small letters; a company word; a stop-word; a small particle; a bank."""
    t = F.col("text")
    return _made(s, sf, "customer", rec_id=_K, text=_GATE).select(
        "rec_id", names.sweepable_person(t).alias("person"), names.firm_shape(t).alias("shape"), names.sweepable_firm(t).alias("firm"),
        *[names.identifying(F.lit(k), t).alias(f"identifying_{n}") for k, n in (("PERSON", "person"), ("ORG", "firm"), ("EMAIL", "email"))],
    )


_WORDY = f"CASE {_K} % 7 WHEN 0 THEN 'SSN:' WHEN 1 THEN 'Compliance Officer' WHEN 2 THEN 'the Managing Director' WHEN 3 THEN 'Reference No' WHEN 4 THEN 'Reserve Bank of India' WHEN 5 THEN {_NAME} ELSE '' END"


@query(f"SELECT {_K} AS rec_id, {_K} % 7 = 0 AS acronym, {_K} % 7 IN (1, 2) AS title, {_K} % 7 IN (1, 2, 3) AS label, {_K} % 7 = 4 AS body FROM customer")
def n13_word_lists(s: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return _made(s, sf, "customer", rec_id=_K, text=_WORDY).select("rec_id", names.is_acronym(t).alias("acronym"), names.is_title_phrase(t).alias("title"), names.is_label_phrase(t).alias("label"), names.is_public_body(t).alias("body"))


_SINGLE = "array_contains(['ssn', 'pan', 'dob', 'cfo', 'ceo', 'coo', 'cto', 'hr', 'it', 'ip', 'pin'], lower(trim(text)))"


@query(
    f"SELECT DISTINCT match_id, entity_type, text FROM pii_match WHERE text IS NOT NULL AND entity_type IN ('PERSON', 'ORG') AND NOT {_SINGLE} AND CASE WHEN entity_type = 'PERSON' THEN regexp_matches(text, '\\p{{L}}') "
    f"ELSE regexp_matches(trim(text), '\\s') OR regexp_matches(text, '^[\\p{{Lu}}&]{{2,6}}$') OR regexp_matches(text, '(?i)(?:^|[^0-9A-Za-z_])(?:Ltd|Limited|LLP|Pvt|Inc|Corp|Corporation|Bank|Group|Partners|Advisors|Associates|Company|PLC|LLC)(?:$|[^0-9A-Za-z_])') END AND NOT (entity_type = 'ORG' AND regexp_matches(text, '\\b[A-Za-z]{{1,6}}-?\\d{{3,}}\\b'))"
)
def n2_recognised(s: SparkSession, sf: str) -> DataFrame:
    """Delivered spans as what a statistical recogniser says: which of them stay as persons and firms."""
    p = _t(s, sf, "pii_match").where("text is not null").select("match_id", "entity_type", "text").distinct()
    one = F.array(F.struct("entity_type", "text", F.lit(0).alias("start"), F.length("text").alias("end"), F.lit(0.85).alias("confidence"), F.lit("ner").alias("source"))).cast(SPANS)
    return p.select("match_id", F.inline(names.recognised(one, F.col("text")))).select("match_id", "entity_type", "text")


# ---- glossary ------------------------------------------------------------------------------------------------------------------------------

_BLANK = "[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"


def _normal(c: str) -> str:
    return f"trim(regexp_replace(lower(regexp_replace(trim(regexp_replace(regexp_replace({c}, '[\"“”]', '', 'g'), '{_BLANK}+', ' ', 'g')), '^[,;:]+|[,;:]+$', '', 'g')), '^(?:the|our|an|a)\\s+', ''))"


@query(f"SELECT finding_id, {_normal('text')} AS term FROM residual_finding")
def t2_normalise(s: SparkSession, sf: str) -> DataFrame:
    return _t(s, sf, "residual_finding").select("finding_id", glossary.normalise(F.col("text")).alias("term"))


@query(
    f"WITH t AS (SELECT DISTINCT filing_id, {_normal('text')} AS term FROM residual_finding WHERE filing_id IS NOT NULL AND text IS NOT NULL), p AS (SELECT match_id, filing_id, entity_type, text, {_normal('text')} AS n FROM pii_match WHERE filing_id IS NOT NULL) "
    "SELECT match_id, entity_type, text FROM p WHERE entity_type NOT IN ('PERSON', 'ORG') OR NOT EXISTS (SELECT 1 FROM t WHERE t.filing_id = p.filing_id AND (t.term = p.n OR (t.term <> '' AND t.term = trim(regexp_replace(p.n, '^(?:pre|post|non|sub|re)[-\\s]+', '')))))"
)
def j2_without_terms(s: SparkSession, sf: str) -> DataFrame:
    """Name spans that are no term of their filing; the terms are what was found in it."""
    terms = _t(s, sf, "residual_finding").where("filing_id is not null and text is not null").select("filing_id", glossary.normalise(F.col("text")).alias("term")).distinct()
    spans = _t(s, sf, "pii_match").where("filing_id is not null").select("match_id", "filing_id", "entity_type", "text")
    return glossary.without_terms(spans, terms, "filing_id").select("match_id", "entity_type", "text")


_S = "s_suppkey"
_TERM = f"CASE {_S} % 6 WHEN 0 THEN concat('Equity Share', {_S}, '(s)') WHEN 1 THEN concat('“The Bid ', {_S}, '”') WHEN 2 THEN concat('Alpha', {_S}, ' / Beta', {_S}) WHEN 3 THEN concat('Acme', {_S}) WHEN 4 THEN concat(repeat('long ', 20), {_S}) ELSE concat('Unit', {_S}, 's') END"
_MEANS = f"CASE {_S} % 6 WHEN 3 THEN concat('Acme', {_S}, ' Tools Limited') ELSE 'what it means' END"


@query(
    f"SELECT {_S} AS rec_id, unnest(CASE {_S} % 6 WHEN 0 THEN [concat('equity share', {_S}), concat('equity share', {_S}, 's')] WHEN 1 THEN [concat('bid ', {_S}), concat('bid ', {_S}, 's')] "
    f"WHEN 2 THEN [concat('alpha', {_S}), concat('alpha', {_S}, 's'), concat('beta', {_S}), concat('beta', {_S}, 's')] WHEN 5 THEN [concat('unit', {_S}, 's'), concat('unit', {_S})] ELSE [] END) AS term FROM supplier"
)
def t3_glossary_terms(s: SparkSession, sf: str) -> DataFrame:
    """Terms with "(s)", quotes and article, synonyms, a firm's short name, too long, plural."""
    return glossary.glossary(_made(s, sf, "supplier", rec_id=_S, term=_TERM, description=_MEANS), "rec_id")


# ---- consistency ---------------------------------------------------------------------------------------------------------------------------

# blocks of one document per customer: a full name, its two-word form in capitals, a firm and its short form
_DOC = f"lpad(concat({_K}), 9, '0')"
_FULL = f"concat({_pick(_K, 'Asha', 'Rohan', 'Meera')}, ' ', {_pick(_K, 'Kiran', 'Bala')}, ' ', {_pick(_K, 'Rao', 'Hegde', 'Menon', 'Iyer', 'Nayak')})"
_ALIAS = f"concat({_pick(_K, 'Asha', 'Rohan', 'Meera')}, ' ', {_pick(_K, 'Rao', 'Hegde', 'Menon', 'Iyer', 'Nayak')})"
_BLOCKS = [f"concat('By ', {_FULL}, ' today')", f"concat('so said ', upper({_ALIAS}), ' twice, ', {_ALIAS}, 'son did not')", f"concat('from ', {_ALIAS}, ' again')"]


def _named_blocks(s: SparkSession, sf: str) -> DataFrame:
    parts = [_made(s, sf, "customer", doc_id=_DOC, block_id=f"CAST({i} AS BIGINT)", text=e, full=_FULL) for i, e in enumerate(_BLOCKS)]
    b = parts[0].unionByName(parts[1]).unionByName(parts[2])
    span = F.struct(F.lit("PERSON").alias("entity_type"), F.col("full").alias("text"), F.lit(3).alias("start"), (F.lit(3) + F.length("full")).alias("end"), F.lit(0.8).alias("confidence"), F.lit("heuristic").alias("source"))
    return b.withColumn("spans", F.when(F.col("block_id") == 0, F.array(span).cast(SPANS)).otherwise(no_spans())).withColumn("location", F.lit("body")).drop("full")


@query(
    f"SELECT {_DOC} AS doc_id, CAST(b AS BIGINT) AS block_id, span, CAST(strpos(text, span) - 1 AS INT) AS start_pos, source FROM (SELECT {_K}, 0 AS b, {_BLOCKS[0]} AS text, {_FULL} AS span, 'heuristic' AS source FROM customer "
    f"UNION ALL SELECT {_K}, 1, {_BLOCKS[1]}, upper({_ALIAS}), 'consistency_sweep' FROM customer UNION ALL SELECT {_K}, 2, {_BLOCKS[2]}, {_ALIAS}, 'consistency_sweep' FROM customer)"
)
def j5_sweep(s: SparkSession, sf: str) -> DataFrame:
    """Known names and their short forms are found in all blocks of their document, in any case and as whole words only."""
    b = _named_blocks(s, sf)
    known = consistency.known_names(pipeline.spans_of(b))
    swept = consistency.sweep(b, consistency.all_names(known))
    return pipeline.spans_of(swept).select("doc_id", "block_id", F.col("text").alias("span"), F.col("start").alias("start_pos"), "source")


@query(f"SELECT {_DOC} AS doc_id, CAST(3 AS BIGINT) AS replaced, true AS one_value FROM customer")
def j6_one_value_for_a_name(s: SparkSession, sf: str) -> DataFrame:
    """The full name, its short form and its capitals get one value in a document."""
    b = _named_blocks(s, sf).withColumn(pipeline.ROW, F.monotonically_increasing_id())
    swept, every = pipeline.refine(b)
    r = pipeline.replaced(swept, every)
    return r.groupBy("doc_id").agg(F.count(F.lit(1)).alias("replaced"), (F.count_distinct(F.lower("fake")) == 1).alias("one_value"))


@query(
    f"SELECT {_DOC} AS doc_id, concat(CASE WHEN {_K} % 3 = 0 THEN lower(replace({_ALIAS}, ' ', '.')) WHEN {_K} % 3 = 1 THEN concat('x', lower(replace({_ALIAS}, ' ', '')), '7') END, '@x.example') AS email, lower({_ALIAS}) AS person FROM customer WHERE {_K} % 3 < 2"
)
def j9_email_hints(s: SparkSession, sf: str) -> DataFrame:
    """Addresses with the dotted or the joined name of a person of the document, and with neither."""
    mail = f"concat(CASE WHEN {_K} % 3 = 0 THEN lower(replace({_ALIAS}, ' ', '.')) WHEN {_K} % 3 = 1 THEN concat('x', lower(replace({_ALIAS}, ' ', '')), '7') ELSE 'office' END, '@x.example')"
    cols = {"doc_id": _DOC, "start": "0"}
    a = _made(s, sf, "customer", **cols, block_id="CAST(0 AS BIGINT)", entity_type="'PERSON'", text=_ALIAS)
    z = _made(s, sf, "customer", **cols, block_id="CAST(1 AS BIGINT)", entity_type="'PERSON'", text="'Zoya Other'")
    return consistency.email_hints(a.unionByName(z).unionByName(_made(s, sf, "customer", **cols, block_id="CAST(2 AS BIGINT)", entity_type="'EMAIL'", text=mail)))


@query(
    "WITH n AS (SELECT filing_id, block_id, lower(trim(text)) AS name, count(*) FILTER (entity_type = 'PERSON') AS p, count(*) FILTER (entity_type = 'ORG') AS o FROM (SELECT DISTINCT filing_id, block_id, entity_type, text, start_pos, end_pos, match_id FROM pii_match WHERE entity_type IN ('PERSON', 'ORG') AND text IS NOT NULL) GROUP BY 1, 2, 3) "
    "SELECT filing_id, block_id, name, CASE WHEN p > o THEN 'PERSON' ELSE 'ORG' END AS entity_type FROM n WHERE p <> o"
)
def r3_reconciled(s: SparkSession, sf: str) -> DataFrame:
    """The type that most spans of a text have in its block; ties are left out, as they go to the first."""
    p = _t(s, sf, "pii_match").where("text is not null").select("filing_id", "block_id", "entity_type", "text", F.col("start_pos").alias("start"), F.col("end_pos").alias("end"), "match_id").distinct()
    p = p.where("entity_type in ('PERSON', 'ORG')")
    folded = p.groupBy("filing_id", "block_id").agg(F.collect_list(F.struct("entity_type", "text", "start", "end", F.lit(0.8).alias("confidence"), F.lit("x").alias("source"))).cast(SPANS).alias("s"))
    each = folded.select("filing_id", "block_id", F.inline(resolve.reconcile(F.col("s")))).withColumn("name", F.lower(F.trim("text")))
    ties = p.groupBy("filing_id", "block_id", F.lower(F.trim("text")).alias("name")).agg((F.count_if(F.col("entity_type") == "PERSON") * 2 == F.count(F.lit(1))).alias("tie")).where("tie")
    return safe_join(each.select("filing_id", "block_id", "name", "entity_type").distinct(), ties, ["filing_id", "block_id", "name"], "left_anti")


# ---- resolution ----------------------------------------------------------------------------------------------------------------------------

# made blocks with spans that conflict in several ways: each case has a phone in an address, a rival address, a name at an edge
_KINDS = "[('PHONE', 20, 35, 0.95), ('ADDRESS', 0, 60, 0.9), ('ADDRESS', 5, 40, 0.85), ('PERSON', 30, 48, 0.8), ('ORG', 44, 70, 0.9), ('EMAIL', 66, 80, 0.99)]"
_LINE = "concat(repeat('abcdefghi ', 8), 'x')"


@query(
    f"WITH RECURSIVE raw AS (SELECT {_K} AS rec_id, {_LINE} AS line, unnest({_KINDS}) AS z FROM customer), sp AS (SELECT rec_id, line, z[1] AS t, CAST(z[2] + rec_id % 5 AS INT) AS s, CAST(z[3] + rec_id % 7 - rec_id % 3 AS INT) AS e, CAST(z[4] AS DOUBLE) AS c FROM raw), "
    "r AS (SELECT *, substring(line, s + 1, e - s) AS x, row_number() OVER (PARTITION BY rec_id ORDER BY CASE t WHEN 'ADDRESS' THEN 1 WHEN 'PERSON' THEN 2 WHEN 'ORG' THEN 3 ELSE 0 END, -c, s - e, s, t) AS i FROM sp), "
    "k AS (SELECT rec_id, 0 AS i, CAST([] AS STRUCT(t VARCHAR, s INT, e INT, x VARCHAR)[]) AS kept FROM (SELECT DISTINCT rec_id FROM r) UNION ALL "
    "SELECT k.rec_id, k.i + 1, CASE WHEN len(list_filter(k.kept, lambda q: q.e > r.s AND q.s < r.e)) = 0 THEN list_append(k.kept, {'t': r.t, 's': r.s, 'e': r.e, 'x': r.x}) "
    "WHEN r.t = 'ADDRESS' AND len(list_filter(k.kept, lambda q: q.e > r.s AND q.s < r.e AND q.t = 'ADDRESS')) = 0 THEN list_concat(k.kept, list_filter(list_transform(list_zip("
    "list_filter(range(r.s, r.e), lambda p: len(list_filter(k.kept, lambda q: q.s <= p AND p < q.e)) = 0 AND (p = r.s OR len(list_filter(k.kept, lambda q: q.s <= p - 1 AND p - 1 < q.e)) > 0)), "
    "list_filter(range(r.s, r.e), lambda p: len(list_filter(k.kept, lambda q: q.s <= p AND p < q.e)) = 0 AND (p = r.e - 1 OR len(list_filter(k.kept, lambda q: q.s <= p + 1 AND p + 1 < q.e)) > 0))), "
    "lambda g: {'t': r.t, 's': CAST(g[1] AS INT), 'e': CAST(g[2] + 1 AS INT), 'x': substring(r.x, CAST(g[1] - r.s + 1 AS BIGINT), CAST(g[2] + 1 - g[1] AS BIGINT))}), "
    "lambda f: length(regexp_replace(f.x, '^[ ,.;:\\-()]+|[ ,.;:\\-()]+$', '', 'g')) >= 10)) ELSE k.kept END FROM k JOIN r ON r.rec_id = k.rec_id AND r.i = k.i + 1), "
    "f AS (SELECT rec_id, unnest(kept) AS q FROM k WHERE i = 6) SELECT rec_id, q.t AS entity_type, q.x AS span, q.s AS start_pos, q.e AS end_pos FROM f"
)
def r2_resolved_shapes(s: SparkSession, sf: str) -> DataFrame:
    """Greedy resolution with splitting, against a recursion in SQL that keeps lists of positions."""
    kinds = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for t, a, b, c in (("PHONE", 20, 35, 0.95), ("ADDRESS", 0, 60, 0.9), ("ADDRESS", 5, 40, 0.85), ("PERSON", 30, 48, 0.8), ("ORG", 44, 70, 0.9), ("EMAIL", 66, 80, 0.99))])
    k, line = F.col("rec_id"), F.col("line")

    def span(z: Column) -> Column:
        a, b = (z["a"] + k % 5).cast("int"), (z["b"] + k % 7 - k % 3).cast("int")
        return F.struct(z["t"].alias("entity_type"), F.substring(line, a + 1, b - a).alias("text"), a.alias("start"), b.alias("end"), z["c"].alias("confidence"), F.lit("x").alias("source"))

    t = _made(s, sf, "customer", rec_id=_K, line=_LINE)
    return _spans(t, resolve.resolve(F.transform(kinds, span).cast(SPANS)))


@query("SELECT entity_type, priority, splittable FROM pii_type")
def u7_vocabulary(s: SparkSession, sf: str) -> DataFrame:
    """Priority and splitting of each type, as the library has them, beside the delivered table."""
    return _t(s, sf, "pii_type").select("entity_type", priority(F.col("entity_type")).alias("priority"), splittable(F.col("entity_type")).alias("splittable"))


# ---- values --------------------------------------------------------------------------------------------------------------------------------

_TYPES18 = "['PERSON', 'EMAIL', 'PHONE', 'ORG', 'ADDRESS', 'SSN', 'CREDIT_CARD', 'DATE_OF_BIRTH', 'IP_ADDRESS', 'PAN_NUMBER', 'AADHAAR_NUMBER', 'IFSC_CODE', 'GSTIN', 'UPI_ID', 'PASSPORT_NUMBER', 'VOTER_ID', 'DRIVING_LICENSE', 'BANK_ACCOUNT_NUMBER']"
#: What a value of each type must look like, in both engines' patterns.
_SHAPES = {
    "PERSON": "[A-Z][a-z]+ [A-Z][a-z]+", "EMAIL": "[a-z]+[.][a-z]+[0-9]{2}@example[.]com", "PHONE": "[+]91 [6-9][0-9]{4} [0-9]{5}", "ORG": "[A-Z][a-z]+ [A-Z][a-z]+ (Private Limited|Limited|LLP)", "ADDRESS": "[1-9][0-9]{2}, [A-Z][a-z]+ Road, [A-Z][a-z]+ - [1-9][0-9]{5}",
    "SSN": "[0-8][0-9]{2}-[0-9]{2}-[0-9]{4}", "CREDIT_CARD": "4[0-9]{15}", "DATE_OF_BIRTH": "[0-9]{2} [A-Z][a-z]+ (19|20)[0-9]{2}", "IP_ADDRESS": "[0-9]{2,3}([.][0-9]{1,3}){3}", "PAN_NUMBER": "[A-Z]{5}[0-9]{4}[A-Z]", "AADHAAR_NUMBER": "[1-9][0-9]{3} [0-9]{4} [0-9]{4}",
    "IFSC_CODE": "[A-Z]{4}0[A-Z0-9]{6}", "GSTIN": "[0-3][0-9][A-Z]{5}[0-9]{4}[A-Z][1-9]Z[0-9A-Z]", "UPI_ID": "[a-z]+[.][a-z]+@(okaxis|okicici|oksbi|ybl|paytm|upi)", "PASSPORT_NUMBER": "[A-Z][0-9]{7}", "VOTER_ID": "[A-Z]{3}[0-9]{7}", "DRIVING_LICENSE": "[A-Z]{2}[0-9]{2} (19|20)[0-9]{9}", "BANK_ACCOUNT_NUMBER": "[1-9][0-9]{11}",
}


@query("SELECT t AS entity_type, count(*) AS n, count(*) AS fits, count(*) AS again FROM (SELECT unnest(" + _TYPES18 + ") AS t, c_custkey FROM customer) GROUP BY 1")
def g0_value_shapes(s: SparkSession, sf: str) -> DataFrame:
    """A value of each of the 18 types for every customer: how many have the type's shape and pass its own detector again."""
    t = _made(s, sf, "customer", k=_K)
    rows = t.select("k", F.explode(F.array(*[F.lit(x) for x in _SHAPES])).alias("entity_type"))
    original = F.when(F.col("entity_type") == "PHONE", F.concat(F.lit("+91 98765 "), F.lpad((F.col("k") % 100000).cast("string"), 5, "0"))).when(F.col("entity_type") == "BANK_ACCOUNT_NUMBER", F.lpad(F.col("k").cast("string"), 12, "1")).otherwise(F.concat(F.lit("v "), F.col("k").cast("string")))
    v = rows.select("entity_type", pseudonymise.value(42, F.col("entity_type"), original).alias("fake"))
    fits = F.lit(False)
    for k, p in _SHAPES.items():
        fits = F.when(F.col("entity_type") == k, F.col("fake").rlike(f"^(?:{p})$")).otherwise(fits)
    near = {"DATE_OF_BIRTH": "born on ", "PASSPORT_NUMBER": "passport ", "VOTER_ID": "voter ", "DRIVING_LICENSE": "driving licence ", "BANK_ACCOUNT_NUMBER": "account no "}
    again = F.lit(True)
    for k, build in structured.DETECTORS.items():
        spans = build(F.concat(F.lit(near.get(k, "")), F.col("fake"), F.lit(" .")), F.lit(""))
        again = F.when(F.col("entity_type") == k, F.exists(spans, lambda x: x["text"] == F.col("fake"))).otherwise(again)
    return v.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(fits).alias("fits"), F.count_if(again).alias("again"))


@query("SELECT DISTINCT match_id, text = upper(text) AND regexp_matches(text, '\\p{L}') AND entity_type IN ('PERSON', 'ORG', 'ADDRESS') AS capital FROM pii_match WHERE text IS NOT NULL AND entity_type IN ('PERSON', 'ORG', 'ADDRESS') AND NOT regexp_matches(text, '[^\\x00-\\x7F]')")
def g0_mirrored_capitals(s: SparkSession, sf: str) -> DataFrame:
    """Values of names and addresses in capitals are in capitals, and no others."""
    p = _t(s, sf, "pii_match").where("text is not null and entity_type in ('PERSON', 'ORG', 'ADDRESS')").where(~F.col("text").rlike(r"[^\x00-\x7F]"))
    fake = pseudonymise.value(42, F.col("entity_type"), F.col("text"))
    return p.select("match_id", (fake == F.upper(fake)).alias("capital")).distinct()


# ---- checks of the finished text -----------------------------------------------------------------------------------------------------------

_PLANTED = "CASE WHEN match_id % 3 = 0 THEN concat('see q', original, '9 at the end') WHEN match_id % 3 = 1 THEN concat('0123456789abcdefghijklmnopqrstuvwxyz_', original) ELSE concat('nothing of ', match_id) END"


@query(
    f"WITH b AS (SELECT DISTINCT filing_id, {_PLANTED} AS text FROM replacement WHERE original IS NOT NULL), r AS (SELECT DISTINCT filing_id, entity_type, original FROM replacement WHERE entity_type NOT IN ('PERSON', 'ORG') AND length(original) >= 4) "
    "SELECT r.filing_id, r.entity_type, r.original AS text FROM r WHERE EXISTS (SELECT 1 FROM b WHERE b.filing_id IS NOT DISTINCT FROM r.filing_id AND contains(b.text, r.original))"
)
def j10_planted_leaks(s: SparkSession, sf: str) -> DataFrame:
    """Originals set into blocks of their filing: inside longer words, behind long ones, and not at all."""
    b = _t(s, sf, "replacement").where("original is not null").selectExpr("filing_id", f"{_PLANTED} AS text").distinct()
    b = b.select("filing_id", F.xxhash64("text").alias("block_id"), F.lit("body").alias("location"), "text")
    return verify.leaked(b, _t(s, sf, "replacement").where("entity_type not in ('PERSON', 'ORG')"), "filing_id").select("filing_id", "entity_type", "text")


@query(
    "WITH f AS (SELECT DISTINCT filing_id, entity_type, text, location FROM residual_finding WHERE filing_id IS NOT NULL AND text IS NOT NULL AND NOT regexp_matches(text, '[^\\x00-\\x7F]')), k AS (SELECT DISTINCT filing_id, fake FROM replacement WHERE filing_id IS NOT NULL), "
    "w AS (SELECT DISTINCT filing_id, unnest(regexp_split_to_array(lower(fake), '[^0-9a-z_]+')) AS word FROM k WHERE NOT regexp_matches(fake, '[^\\x00-\\x7F]')), n AS (SELECT *, row_number() OVER () AS i FROM f WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.filing_id = f.filing_id AND k.fake = f.text)), "
    "p AS (SELECT i, filing_id, unnest(regexp_split_to_array(lower(text), '[^0-9a-z_]+')) AS word FROM n), q AS (SELECT i, filing_id, word FROM p WHERE length(word) >= 3) "
    "SELECT filing_id, entity_type, text, location FROM n WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.i = n.i) OR EXISTS (SELECT 1 FROM q WHERE q.i = n.i AND NOT EXISTS (SELECT 1 FROM w WHERE w.filing_id = q.filing_id AND w.word = q.word AND length(w.word) >= 3))"
)
def f12_made_of_fakes(s: SparkSession, sf: str) -> DataFrame:
    """Findings that are no replacement and not made of words of replacements, in plain ASCII (where the engines agree on words)."""
    f = _t(s, sf, "residual_finding").where("filing_id is not null and text is not null").where(~F.col("text").rlike(r"[^\x00-\x7F]"))
    r = _t(s, sf, "replacement").where("filing_id is not null").where(~F.col("fake").rlike(r"[^\x00-\x7F]"))
    return verify.unexpected(f, r, "filing_id")


@query(f"SELECT {_DOC} AS doc_id, CAST(CASE WHEN {_K} % 4 = 0 THEN 1 ELSE 0 END AS BIGINT) AS leaked, {_K} % 4 <> 0 AS clean FROM customer")
def a9_clean(s: SparkSession, sf: str) -> DataFrame:
    """Reports of finished documents, every fourth of which still holds its original."""
    b = _made(s, sf, "customer", doc_id=_DOC, block_id="CAST(0 AS BIGINT)", location="'body'", text=f"CASE WHEN {_K} % 4 = 0 THEN concat('to u', {_K}, '@x.example') ELSE 'to nobody' END")
    r = _made(s, sf, "customer", doc_id=_DOC, entity_type="'EMAIL'", original=f"concat('u', {_K}, '@x.example')", fake="'a.b@example.com'")
    leaks = verify.leaked(b, r)
    none = leaks.where("false")
    return verify.report(leaks, none, b).select("doc_id", "leaked", "clean")


# ---- labels and measures -------------------------------------------------------------------------------------------------------------------

_LABEL = f"concat('to ', {_ALIAS}, ' and ', {_ALIAS}, ' of x')"


@query(
    f"SELECT {_K} AS id, CAST(n - 1 AS INT) AS seq, CASE WHEN n = 1 THEN CAST(3 AS INT) ELSE CAST(8 + length({_ALIAS}) AS INT) END AS start_pos FROM customer, (SELECT unnest([1, 2]) AS n)"
)
def j13_located_labels(s: SparkSession, sf: str) -> DataFrame:
    """The n-th label of a value stands at its n-th place; a third label has none."""
    blocks = _made(s, sf, "customer", id=_K, text=_LABEL)
    labels = _made(s, sf, "customer", id=_K, entity_type="'PERSON'", value=_ALIAS).withColumn("seq", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    got = evaluate.located(labels, blocks)
    order = running(got, ["id"], ["start"], F.lit(1), "seq")
    return order.select("id", F.col("seq").cast("int").alias("seq"), F.col("start").alias("start_pos"))


@query(
    "WITH g AS (SELECT DISTINCT match_id, entity_type FROM pii_match WHERE entity_type IS NOT NULL), c AS (SELECT entity_type, stratum, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (SELECT entity_type, CASE WHEN match_id % 2 = 0 THEN 'even' ELSE 'odd' END AS stratum, "
    "CASE match_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 0 END AS tp, CASE match_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 0 END AS fp, CASE match_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 2 END AS fn FROM g) GROUP BY GROUPING SETS ((entity_type), (stratum), ())) "
    "SELECT entity_type, stratum, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(CASE WHEN tp + fp > 0 THEN tp * 1.0 / (tp + fp) ELSE CASE WHEN fn = 0 THEN 1.0 ELSE 0.0 END END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp * 1.0 / (tp + fn) ELSE CASE WHEN fp = 0 THEN 1.0 ELSE 0.0 END END, 6) AS recall, "
    "round(CASE WHEN tp + fp + fn > 0 THEN tp * 1.0 / (tp + fp + fn) ELSE 0.0 END, 6) AS accuracy FROM c"
)
def a10_by_type_and_stratum(s: SparkSession, sf: str) -> DataFrame:
    """Two labels a document, of four kinds: both found; one prediction that covers both; one right and one wrong; none. Matching has to choose."""
    g = _t(s, sf, "pii_match").where("entity_type is not null").select("match_id", "entity_type").distinct()
    rows = lambda *spans: F.array(*[F.struct(F.lit(a).alias("start"), F.lit(b).alias("end")) for a, b in spans])
    doc = g.select(F.concat(F.col("match_id").cast("string"), F.lit("/"), "entity_type").alias("doc_id"), "entity_type", "match_id")
    gold = doc.select("doc_id", "entity_type", F.inline(rows((0, 10), (8, 18))))
    k = F.col("match_id") % 4
    pred = doc.select("doc_id", "entity_type", F.inline(F.when(k == 0, rows((0, 10), (7, 16))).when(k == 1, rows((0, 18))).when(k == 2, rows((0, 9), (30, 40))).otherwise(rows().cast("array<struct<start: int, end: int>>"))))
    m = evaluate.matched(gold, pred).join(doc.select("doc_id", F.when(F.col("match_id") % 2 == 0, "even").otherwise("odd").alias("stratum")), "doc_id")
    return evaluate.scores(m, ["entity_type", "stratum"]).select("entity_type", "stratum", "tp", "fp", "fn", "precision", "recall", "accuracy")


@query(f"SELECT 'd' AS doc_id, row_number() OVER (ORDER BY {_K}) AS seq, CAST(coalesce(sum(length({_NAME}) + 1) OVER (ORDER BY {_K} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS start_pos FROM customer")
def t8_built_corpus(s: SparkSession, sf: str) -> DataFrame:
    """One document put together of a labelled name and a blank for each customer: where each name stands."""
    names_ = _made(s, sf, "customer", doc_id="'d'", seq=f"{_K} * 2", text=_NAME, entity_type="'PERSON'")
    blanks = _made(s, sf, "customer", doc_id="'d'", seq=f"{_K} * 2 + 1", text="' '", entity_type="CAST(NULL AS STRING)")
    _, spans = evaluate.built(names_.unionByName(blanks))
    n = running(spans, ["doc_id"], ["start"], F.lit(1), "n")
    return n.select("doc_id", (F.col("n") + 1).cast("long").alias("seq"), F.col("start").alias("start_pos"))


@query("SELECT entity_type, stratum, count(*) AS labels FROM (SELECT DISTINCT match_id, entity_type, CASE WHEN filing_id IS NULL THEN 'none' ELSE 'filed' END AS stratum FROM pii_match) GROUP BY 1, 2")
def a15_label_counts(s: SparkSession, sf: str) -> DataFrame:
    p = _t(s, sf, "pii_match").select("match_id", "entity_type", F.when(F.col("filing_id").isNull(), "none").otherwise("filed").alias("stratum")).distinct()
    return evaluate.label_counts(p, ["entity_type", "stratum"])


# ---- the pipeline's filters ----------------------------------------------------------------------------------------------------------------

_MIX = f"CASE {_K} % 5 WHEN 0 THEN concat('u', {_K}, '@x.example and 219-09-', lpad(concat({_K} % 9999 + 1), 4, '0')) WHEN 1 THEN '   ' WHEN 2 THEN concat('Aadhaar 1234 5678 ', lpad(concat({_K} % 10000), 4, '0')) WHEN 3 THEN concat('no. 1234 5678 ', lpad(concat({_K} % 10000), 4, '0'), 'x') ELSE concat('born on 14 March 1985, ', {_K}) END"


@query(
    f"SELECT {_K} AS block_id, unnest(CASE {_K} % 5 WHEN 0 THEN ['EMAIL'] WHEN 2 THEN ['AADHAAR_NUMBER'] WHEN 4 THEN ['DATE_OF_BIRTH'] ELSE [] END) AS entity_type, CASE {_K} % 5 WHEN 4 THEN 'high' ELSE 'high' END AS tier FROM customer"
)
def u1_detected(s: SparkSession, sf: str) -> DataFrame:
    """All detectors at once, without SSN and PHONE and from confidence 0.7: blank blocks and low confidences give nothing."""
    b = _made(s, sf, "customer", doc_id=_DOC, block_id=_K, text=_MIX)
    d = pipeline.detect(b, DetectionConfig(disabled=frozenset({"SSN", "PHONE"}), min_confidence=0.7))
    return pipeline.spans_of(d).select("block_id", "entity_type", tier(F.col("confidence")).alias("tier"))
