"""Queries of the engine over the driver's tables, each over whole tables, with the SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.barrier import wide
from ..functions.skew import running
from ..functions.vocab import DetectionConfig, tier
from ..operators import address, consistency, context, evaluate, names, pseudonymise, resolve, structured, verify
from ..streaming import windowed_counts
from . import pipeline

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(s: SparkSession, sf: str, name: str) -> DataFrame:
    return s.read.parquet(f"{sf}/{name}.parquet")


def _spans_sql(source: str, key: str, pattern: str) -> str:
    """All matches with offsets in DuckDB: gaps and matches, summed up."""
    p = pattern.replace("(?U)", "").replace("'", "''")
    return f"""
    WITH d AS (SELECT {key} AS rec_id, text AS t, regexp_extract_all(text, '{p}') AS m, regexp_split_to_array(text, '{p}') AS g FROM ({source}) WHERE text IS NOT NULL),
    i AS (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM d WHERE len(m) > 0),
    s AS (SELECT rec_id, t, m[k] AS span, CAST(list_sum(list_transform(g[1:k], lambda v: length(v))) + coalesce(list_sum(list_transform(m[1:k-1], lambda v: length(v))), 0) AS INT) AS start_pos FROM i)
    """


def _exploded(df: DataFrame, key: str, spans: Column) -> DataFrame:
    return df.select(F.col(key).alias("rec_id"), F.inline(spans)).select("rec_id", F.col("text").alias("span"), F.col("start").alias("start_pos"), "confidence")


def _blocks(s: SparkSession, sf: str) -> DataFrame:
    return _t(s, sf, "real_sample").select("id", "text")


# ---- structured types ----------------------------------------------------------------------------------------------------------------------


_ASCII = "SELECT id, regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g') AS text FROM real_sample"


def _ascii(s: SparkSession, sf: str) -> DataFrame:
    """All blocks with a blank for every sign that is not ASCII: DuckDB's word bounds know ASCII letters only."""
    return _blocks(s, sf).select("id", F.regexp_replace("text", r"[^\x00-\x7F]", " ").alias("text"))


@query(_spans_sql(_ASCII, "id", structured.EMAIL) + "SELECT rec_id, span, start_pos, CAST(0.99 AS DOUBLE) AS confidence FROM s")
def x1_email(s: SparkSession, sf: str) -> DataFrame:
    return _exploded(_ascii(s, sf), "id", structured.email(F.col("text")))


@query()
def x1_email_stored(s: SparkSession, sf: str) -> DataFrame:
    """x1_email over the texts as stored, whose word bounds SQL cannot follow."""
    return _exploded(_blocks(s, sf), "id", structured.email(F.col("text")))


@query()
def x2_phone(s: SparkSession, sf: str) -> DataFrame:
    return _exploded(_blocks(s, sf), "id", structured.phone(F.col("text")))


@query(_spans_sql("SELECT * FROM documents", "doc_id", structured.IPV4) + "SELECT rec_id, span, start_pos, CAST(0.98 AS DOUBLE) AS confidence FROM s UNION ALL (" + _spans_sql("SELECT * FROM documents", "doc_id", structured.IPV6) + "SELECT rec_id, span, start_pos, CAST(0.85 AS DOUBLE) FROM s)")
def x3_ip_documents(s: SparkSession, sf: str) -> DataFrame:
    return _exploded(_t(s, sf, "documents"), "doc_id", structured.ip_address(F.col("text")))


@query(_spans_sql("SELECT * FROM real_sample", "id", structured.IPV6) + "SELECT rec_id, span, start_pos, CAST(0.85 AS DOUBLE) AS confidence FROM s")
def x4_ipv6_clock(s: SparkSession, sf: str) -> DataFrame:
    """The IPv6 shape also fires on clock times, as specified."""
    return _exploded(_blocks(s, sf), "id", structured.ip_address(F.col("text"))).where("confidence = 0.85")


_SSN_SRC = "SELECT c_custkey, concat('SSN ', lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0'), '-', lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0'), '-', lpad(CAST(c_custkey * 7 % 10000 AS VARCHAR), 4, '0'), ' and 666-12-3456') AS text FROM customer"


@query(
    _spans_sql(_SSN_SRC, "c_custkey", structured.SSN)
    + "SELECT rec_id, span, start_pos, CAST(0.97 AS DOUBLE) AS confidence FROM s WHERE span[1:3] NOT IN ('000', '666') AND span[1:1] <> '9' AND span[5:6] <> '00' AND span[8:11] <> '0000'"
)
def x5_ssn(s: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    text = F.concat(F.lit("SSN "), pad(c % 1000, 3), F.lit("-"), pad(c % 100, 2), F.lit("-"), pad(c * 7 % 10000, 4), F.lit(" and 666-12-3456"))
    return _exploded(_t(s, sf, "customer").select("c_custkey", text.alias("text")), "c_custkey", structured.ssn(F.col("text")))


_CARD_SRC = "SELECT o_orderkey, concat('Card ', lpad(CAST(o_orderkey * 7919 AS VARCHAR), 16, '4'), ' on file') AS text FROM orders"


@query(
    _spans_sql(_CARD_SRC, "o_orderkey", structured.CARD)
    + """, d2 AS (SELECT rec_id, rtrim(span, ' -') AS span, start_pos, replace(replace(span, ' ', ''), '-', '') AS n FROM s)
    SELECT rec_id, span, start_pos, CAST(0.96 AS DOUBLE) AS confidence FROM d2 WHERE length(n) BETWEEN 13 AND 19 AND
    list_sum(list_transform(range(1, length(n) + 1), lambda i: CASE WHEN (length(n) - i) % 2 = 1 THEN [0,2,4,6,8,1,3,5,7,9][CAST(n[i:i] AS INT) + 1] ELSE CAST(n[i:i] AS INT) END)) % 10 = 0"""
)
def x6_card_luhn(s: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("Card "), F.lpad((F.col("o_orderkey") * 7919).cast("string"), 16, "4"), F.lit(" on file"))
    return _exploded(_t(s, sf, "orders").select("o_orderkey", text.alias("text")), "o_orderkey", structured.credit_card(F.col("text")))


_DOB_SRC = "SELECT o_orderkey, concat(CASE WHEN o_orderkey % 3 = 0 THEN 'Date of Birth: ' WHEN o_orderkey % 3 = 1 THEN 'Filed on ' ELSE 'born on a day that is a long way off, namely in ' END, strftime(o_orderdate, '%Y-%m-%d'), ' here') AS text FROM orders"


@query(_spans_sql(_DOB_SRC, "o_orderkey", structured.DATE) + "SELECT rec_id, span, start_pos, CAST(0.9 AS DOUBLE) AS confidence FROM s WHERE regexp_matches(substring(t, greatest(start_pos - 40, 0) + 1, start_pos - greatest(start_pos - 40, 0)), '(?i)date of birth|d\\.?o\\.?b\\.?|born on|born')")
def x7_birth_date(s: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    text = F.concat(F.when(k == 0, "Date of Birth: ").when(k == 1, "Filed on ").otherwise("born on a day that is a long way off, namely in "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" here"))
    return _exploded(_t(s, sf, "orders").select("o_orderkey", text.alias("text")), "o_orderkey", structured.date_of_birth(F.col("text"), F.lit("")))


@query(_spans_sql("SELECT * FROM pii_match", "match_id", structured.PAN) + "SELECT rec_id, span, start_pos, CAST(0.9 AS DOUBLE) AS confidence FROM s")
def x8_pan(s: SparkSession, sf: str) -> DataFrame:
    return _exploded(_t(s, sf, "pii_match"), "match_id", structured.pan_number(F.col("text")))


@query(
    _spans_sql("SELECT * FROM pii_match", "match_id", structured.AADHAAR)
    + "SELECT rec_id, span, start_pos, CAST(CASE WHEN regexp_matches(substring(t, greatest(start_pos - 25, 0) + 1, start_pos - greatest(start_pos - 25, 0)), '(?i)aadhaar|uidai') THEN 0.98 ELSE 0.6 END AS DOUBLE) AS confidence FROM s"
)
def x9_aadhaar(s: SparkSession, sf: str) -> DataFrame:
    return _exploded(_t(s, sf, "pii_match"), "match_id", structured.aadhaar_number(F.col("text")))


_CODE = "chr(CAST(65 + c_custkey % 26 AS INT))"
_IFSC_SRC = f"SELECT c_custkey, concat('IFSC ', repeat({_CODE}, 4), CASE WHEN c_custkey % 2 = 0 THEN '0' ELSE '1' END, lpad(CAST(c_custkey AS VARCHAR), 6, '0'), '.') AS text FROM customer"


@query(_spans_sql(_IFSC_SRC, "c_custkey", structured.IFSC) + "SELECT rec_id, span, start_pos, CAST(0.93 AS DOUBLE) AS confidence FROM s")
def x10_ifsc(s: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    text = F.concat(F.lit("IFSC "), F.repeat(F.char((c % 26 + 65).cast("int")), 4), F.when(c % 2 == 0, "0").otherwise("1"), F.lpad(c.cast("string"), 6, "0"), F.lit("."))
    return _exploded(_t(s, sf, "customer").select("c_custkey", text.alias("text")), "c_custkey", structured.ifsc_code(F.col("text")))


_GST_SRC = f"SELECT c_custkey, concat('GSTIN ', lpad(CAST(c_custkey % 38 AS VARCHAR), 2, '0'), repeat({_CODE}, 5), lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0'), 'C', CAST(c_custkey % 10 AS VARCHAR), CASE WHEN c_custkey % 3 = 0 THEN 'X' ELSE 'Z' END, '5') AS text FROM customer"


@query(_spans_sql(_GST_SRC, "c_custkey", structured.GSTIN) + "SELECT rec_id, span, start_pos, CAST(0.92 AS DOUBLE) AS confidence FROM s")
def x11_gstin(s: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey")
    text = F.concat(F.lit("GSTIN "), F.lpad((c % 38).cast("string"), 2, "0"), F.repeat(F.char((c % 26 + 65).cast("int")), 5), F.lpad((c % 10000).cast("string"), 4, "0"), F.lit("C"), (c % 10).cast("string"), F.when(c % 3 == 0, "X").otherwise("Z"), F.lit("5"))
    return _exploded(_t(s, sf, "customer").select("c_custkey", text.alias("text")), "c_custkey", structured.gstin(F.col("text")))


_HANDLES = ", ".join(f"'{h}'" for h in structured.UPI_HANDLES)
_UPI_SRC = "SELECT s_suppkey, concat('pay ', replace(lower(s_name), '#', '.'), '@', CASE WHEN s_suppkey % 3 = 0 THEN 'okhdfcbank' WHEN s_suppkey % 3 = 1 THEN 'noon' ELSE 'YBL' END, ' now') AS text FROM supplier"


@query(_spans_sql(_UPI_SRC, "s_suppkey", structured.UPI) + f"SELECT rec_id, span, start_pos, CAST(0.9 AS DOUBLE) AS confidence FROM s WHERE lower(string_split(span, '@')[-1]) IN ({_HANDLES})")
def x12_upi(s: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey") % 3
    text = F.concat(F.lit("pay "), F.replace(F.lower("s_name"), F.lit("#"), F.lit(".")), F.lit("@"), F.when(k == 0, "okhdfcbank").when(k == 1, "noon").otherwise("YBL"), F.lit(" now"))
    return _exploded(_t(s, sf, "supplier").select("s_suppkey", text.alias("text")), "s_suppkey", structured.upi_id(F.col("text")))


def _near_sql(width: int, keyword: str) -> str:
    return f"regexp_matches(substring(t, greatest(start_pos - {width}, 0) + 1, start_pos - greatest(start_pos - {width}, 0)), '{keyword}')"


@query(_spans_sql("SELECT * FROM pii_match", "match_id", structured.PASSPORT) + f"SELECT rec_id, span, start_pos, CAST(0.88 AS DOUBLE) AS confidence FROM s WHERE {_near_sql(40, '(?i)passport')}")
def x13_passport(s: SparkSession, sf: str) -> DataFrame:
    return _exploded(_t(s, sf, "pii_match"), "match_id", structured.passport_number(F.col("text")))


@query(_spans_sql("SELECT * FROM pii_match", "match_id", structured.VOTER) + f"SELECT rec_id, span, start_pos, CAST(0.88 AS DOUBLE) AS confidence FROM s WHERE {_near_sql(40, '(?i)voter|epic|elector')}")
def x14_voter(s: SparkSession, sf: str) -> DataFrame:
    return _exploded(_t(s, sf, "pii_match"), "match_id", structured.voter_id(F.col("text")))


_DL_SRC = "SELECT o_orderkey, concat(CASE WHEN o_orderkey % 2 = 0 THEN 'Driving Licence No: ' ELSE 'Batch ' END, 'MH12 ', CASE WHEN o_orderkey % 5 = 0 THEN '2155' ELSE '2011' END, lpad(CAST(o_orderkey % 10000000 AS VARCHAR), 7, '0')) AS text FROM orders"


@query(_spans_sql(_DL_SRC, "o_orderkey", structured.LICENCE) + f"SELECT rec_id, span, start_pos, CAST(0.96 AS DOUBLE) AS confidence FROM s WHERE {_near_sql(40, '(?i)driving licen[cs]e')}")
def x15_driving_licence(s: SparkSession, sf: str) -> DataFrame:
    o = F.col("o_orderkey")
    text = F.concat(F.when(o % 2 == 0, "Driving Licence No: ").otherwise("Batch "), F.lit("MH12 "), F.when(o % 5 == 0, "2155").otherwise("2011"), F.lpad((o % 10000000).cast("string"), 7, "0"))
    return _exploded(_t(s, sf, "orders").select("o_orderkey", text.alias("text")), "o_orderkey", structured.driving_license(F.col("text")))


_ACC_SRC = "SELECT o_orderkey, concat(CASE WHEN o_orderkey % 3 = 0 THEN 'Account No: ' WHEN o_orderkey % 3 = 1 THEN 'Order number ' ELSE 'X' END, lpad(CAST(o_orderkey AS VARCHAR), 12, '1')) AS text FROM orders"


@query(
    f"WITH d AS (SELECT o_orderkey AS rec_id, text AS t, regexp_extract_all(text, '[A-Za-z0-9]+') AS m FROM ({_ACC_SRC})), i AS (SELECT rec_id, t, unnest(m) AS span FROM d), s AS (SELECT rec_id, t, span, CAST(strpos(t, span) - 1 AS INT) AS start_pos FROM i WHERE regexp_full_match(span, '\\d{{9,18}}')) "
    f"SELECT rec_id, span, start_pos, CAST(0.96 AS DOUBLE) AS confidence FROM s WHERE {_near_sql(40, '(?i)account')}"
)
def x16_account(s: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    text = F.concat(F.when(k == 0, "Account No: ").when(k == 1, "Order number ").otherwise("X"), F.lpad(F.col("o_orderkey").cast("string"), 12, "1"))
    return _exploded(_t(s, sf, "orders").select("o_orderkey", text.alias("text")), "o_orderkey", structured.bank_account_number(F.col("text")))


# ---- names, addresses ----------------------------------------------------------------------------------------------------------------------


@query()
def n3_contact_persons(s: SparkSession, sf: str) -> DataFrame:
    return _exploded(_blocks(s, sf), "id", names.contact_persons(F.col("text")))


@query()
def n5_legal_form_firms(s: SparkSession, sf: str) -> DataFrame:
    return _exploded(_blocks(s, sf), "id", names.legal_form_firms(F.col("text")))


@query()
def n8_addresses(s: SparkSession, sf: str) -> DataFrame:
    t = _t(s, sf, "real_sample").select("id", "text", "context")
    return _exploded(t, "id", address.addresses(F.col("text"), F.col("context")))


@query("SELECT match_id, regexp_matches(text, '\\b\\d{3}[\\s-]?\\d{3}\\b') AS has_pin, regexp_matches(text, '" + address.KEYWORDS.replace("(?iU)", "(?i)") + "') AS has_keyword FROM pii_match WHERE entity_type = 'ADDRESS'")
def n12_address_evidence(s: SparkSession, sf: str) -> DataFrame:
    t = _t(s, sf, "pii_match").where("entity_type = 'ADDRESS'")
    return t.select("match_id", F.col("text").rlike(address.PIN).alias("has_pin"), F.col("text").rlike(address.KEYWORDS).alias("has_keyword"))


_NORM = "trim(regexp_replace(lower(regexp_replace(trim(regexp_replace(regexp_replace(text, '[\"“”]', '', 'g'), '\\s+', ' ', 'g')), '^[,;:]+|[,;:]+$', '', 'g')), '^(?:the|our|an|a)\\s+', ''))"


@query(f"SELECT finding_id, {_NORM} AS term FROM residual_finding")
def t2_normalised_terms(s: SparkSession, sf: str) -> DataFrame:
    """DuckDB's blanks are ASCII only, so both sides read texts whose blanks are made common first."""
    return _t(s, sf, "residual_finding").select("finding_id", F.trim(F.regexp_replace(F.lower(F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace("text", "[\"“”]", ""), r"\s+", " ")), "^[,;:]+|[,;:]+$", "")), r"^(?:the|our|an|a)\s+", "")).alias("term"))


@query("SELECT match_id, text FROM pii_match WHERE entity_type = 'ORG' AND lower(trim(text)) NOT IN (SELECT DISTINCT lower(trim(text)) FROM residual_finding WHERE entity_type = 'ORG' AND text IS NOT NULL) AND text IS NOT NULL")
def j2_terms_anti(s: SparkSession, sf: str) -> DataFrame:
    terms = _t(s, sf, "residual_finding").where("entity_type = 'ORG' and text is not null").select(F.lower(F.trim("text")).alias("term")).distinct()
    t = _t(s, sf, "pii_match").where("entity_type = 'ORG' and text is not null")
    return t.join(terms, F.lower(F.trim("text")) == F.col("term"), "left_anti").select("match_id", "text")


@query()
def f7_sweep_gate(s: SparkSession, sf: str) -> DataFrame:
    t = _t(s, sf, "pii_match").where("entity_type in ('PERSON', 'ORG')")
    return t.select("match_id", names.identifying(F.col("entity_type"), F.col("text")).alias("identifying"), names.is_title_phrase(F.col("text")).alias("title"), names.is_acronym(F.col("text")).alias("acronym"))


# ---- tiers, counts, joins ------------------------------------------------------------------------------------------------------------------


@query("SELECT entity_type, CASE WHEN confidence >= 0.9 THEN 'high' WHEN confidence >= 0.8 THEN 'medium' ELSE 'needs_review' END AS tier, count(*) AS n FROM pii_match GROUP BY GROUPING SETS ((entity_type), (2), (entity_type, 2), ())")
def a1_counts_by_type_and_tier(s: SparkSession, sf: str) -> DataFrame:
    t = _t(s, sf, "pii_match").select("entity_type", tier(F.col("confidence")).alias("tier"))
    e, r = F.col("entity_type"), F.col("tier")
    return t.groupingSets([[e], [r], [e, r], []], e, r).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT entity_type, count(*) AS n FROM pii_match WHERE entity_type NOT IN ('EMAIL', 'SSN') AND confidence >= 0.5 GROUP BY 1")
def f1_enabled_types(s: SparkSession, sf: str) -> DataFrame:
    c = DetectionConfig(disabled=frozenset({"EMAIL", "SSN"}))
    return _t(s, sf, "pii_match").where(F.col("entity_type").isin(*c.enabled) & (F.col("confidence") >= c.min_confidence)).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT f.file_format, lower(p.source) AS source, count(*) AS n, count(DISTINCT p.filing_id) AS filings FROM pii_match p LEFT JOIN filing f USING (filing_id) GROUP BY 1, 2")
def j_spans_by_format(s: SparkSession, sf: str) -> DataFrame:
    j = _t(s, sf, "pii_match").join(_t(s, sf, "filing").select("filing_id", "file_format"), "filing_id", "left")
    return j.groupBy("file_format", F.lower("source").alias("source")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("filing_id").alias("filings"))


@query("SELECT p.entity_type, count(*) AS spans, count(r.match_id) AS with_fake FROM (SELECT DISTINCT match_id, entity_type FROM pii_match) p LEFT JOIN (SELECT DISTINCT match_id FROM replacement) r USING (match_id) GROUP BY 1")
def j8_fake_lookup(s: SparkSession, sf: str) -> DataFrame:
    p = _t(s, sf, "pii_match").select("match_id", "entity_type").distinct()
    r = _t(s, sf, "replacement").select("match_id", F.lit(1).alias("hit")).distinct()
    return p.join(r, "match_id", "left").groupBy("entity_type").agg(F.count(F.lit(1)).alias("spans"), F.count("hit").alias("with_fake"))


@query(
    "WITH p AS (SELECT DISTINCT match_id, filing_id, block_id, start_pos, end_pos FROM pii_match) SELECT a.match_id AS id_a, b.match_id AS id_b, least(a.end_pos, b.end_pos) - greatest(a.start_pos, b.start_pos) AS shared "
    "FROM p a JOIN p b ON a.filing_id = b.filing_id AND a.block_id = b.block_id AND a.match_id < b.match_id AND a.start_pos < b.end_pos AND b.start_pos < a.end_pos"
)
def j1_overlapping_spans(s: SparkSession, sf: str) -> DataFrame:
    p = _t(s, sf, "pii_match").select("match_id", "filing_id", "block_id", "start_pos", "end_pos").distinct()
    a, b = p.alias("a"), p.alias("b")
    j = a.join(b, F.expr("a.filing_id = b.filing_id and a.block_id = b.block_id and a.match_id < b.match_id and a.start_pos < b.end_pos and b.start_pos < a.end_pos"))
    return j.selectExpr("a.match_id as id_a", "b.match_id as id_b", "least(a.end_pos, b.end_pos) - greatest(a.start_pos, b.start_pos) as shared")


@query()
def r1_resolved_spans(s: SparkSession, sf: str) -> DataFrame:
    """Greedy resolution of all delivered spans, islands first."""
    p = _t(s, sf, "pii_match").where("filing_id is not null").select("filing_id", "block_id", "entity_type", "text", F.col("start_pos").alias("start"), F.col("end_pos").alias("end"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    return resolve.resolve_rows(p, ["filing_id", "block_id"])


@query(
    "WITH v AS (SELECT filing_id, lower(trim(text)) AS name, entity_type, count(*) AS n, min(block_id * 1000000 + start_pos) AS first FROM pii_match WHERE entity_type IN ('PERSON', 'ORG') AND filing_id IS NOT NULL GROUP BY 1, 2, 3) "
    "SELECT filing_id, name, entity_type FROM v QUALIFY row_number() OVER (PARTITION BY filing_id, name ORDER BY n DESC, first, entity_type) = 1"
)
def a4_type_vote(s: SparkSession, sf: str) -> DataFrame:
    return consistency.type_votes(_t(s, sf, "pii_match").where("filing_id is not null").withColumnRenamed("start_pos", "start"), "filing_id")


_PERSONS = "SELECT DISTINCT filing_id, lower(trim(text)) AS name FROM pii_match WHERE entity_type = 'PERSON' AND filing_id IS NOT NULL"


@query(
    f"WITH k AS ({_PERSONS}), c AS (SELECT filing_id, name, concat(w[1], ' ', w[-1]) AS alias FROM (SELECT *, regexp_split_to_array(name, '\\s+') AS w FROM k) WHERE len(w) >= 3), o AS (SELECT filing_id, alias, min(name) AS \"full\" FROM c GROUP BY 1, 2 HAVING count(DISTINCT name) = 1) "
    'SELECT filing_id, alias, "full" FROM o WHERE alias <> "full" AND NOT EXISTS (SELECT 1 FROM k WHERE k.filing_id = o.filing_id AND k.name = o.alias)'
)
def r5_person_aliases(s: SparkSession, sf: str) -> DataFrame:
    k = _t(s, sf, "pii_match").where("entity_type = 'PERSON' and filing_id is not null").select("filing_id", F.lower(F.trim("text")).alias("name"), "entity_type").distinct()
    return consistency.person_aliases(k, "filing_id")


@query(
    "WITH k AS (SELECT DISTINCT filing_id, lower(trim(text)) AS name FROM pii_match WHERE entity_type = 'ORG' AND filing_id IS NOT NULL), c AS (SELECT filing_id, name, trim(regexp_replace(name, '(?i)\\s+(?:(?:private|pvt\\.?)\\s+)?(?:limited|ltd\\.?|llp|llc|plc|inc\\.?|incorporated|corporation|corp\\.?)$', '')) AS alias FROM k), "
    "o AS (SELECT filing_id, alias, min(name) AS \"full\" FROM c WHERE alias <> name AND len(regexp_split_to_array(alias, '\\s+')) >= 2 GROUP BY 1, 2 HAVING count(DISTINCT name) = 1) SELECT filing_id, alias, \"full\" FROM o WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.filing_id = o.filing_id AND k.name = o.alias)"
)
def r6_firm_short_forms(s: SparkSession, sf: str) -> DataFrame:
    k = _t(s, sf, "pii_match").where("entity_type = 'ORG' and filing_id is not null").select("filing_id", F.lower(F.trim("text")).alias("name"), F.lit("ORG").alias("entity_type")).distinct()
    return consistency.firm_short_forms(k, "filing_id").select("filing_id", "alias", "full")


# ---- replacement, audit, checks ------------------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT entity_type, original, concat('REDACTED-', left(sha256(original), 8)) AS digest FROM replacement WHERE original IS NOT NULL")
def g19_generic_value(s: SparkSession, sf: str) -> DataFrame:
    return _t(s, sf, "replacement").where("original is not null").select("entity_type", "original", pseudonymise.generic(F.col("original")).alias("digest")).distinct()


@query()
def g1_values(s: SparkSession, sf: str) -> DataFrame:
    """The replacement value of every distinct (type, key)."""
    t = _t(s, sf, "pii_match").groupBy("entity_type", pseudonymise.fake_key(F.col("text")).alias("key")).agg(F.min("text").alias("original"))
    return t.select("entity_type", "key", pseudonymise.value(42, F.col("entity_type"), F.col("original"), F.col("key")).alias("fake"))


@query("SELECT id, regexp_replace(text, '" + structured.EMAIL.replace("(?U)", "") + "', '[EMAIL]', 'g') AS redacted FROM (" + _ASCII + ")")
def g2_redact_email(s: SparkSession, sf: str) -> DataFrame:
    return _redacted(_ascii(s, sf))


def _redacted(blocks: DataFrame) -> DataFrame:
    edits = F.transform(structured.email(F.col("text")), lambda e: e.withField("fake", F.lit("[EMAIL]")))
    return blocks.select("id", pseudonymise.spliced(F.col("text"), edits).alias("redacted"))


@query()
def g2_redact_email_stored(s: SparkSession, sf: str) -> DataFrame:
    """g2_redact_email over the texts as stored: nothing else is changed."""
    return _redacted(_blocks(s, sf))


@query("SELECT filing_id, match_id, CAST(row_number() OVER (PARTITION BY filing_id ORDER BY block_id, start_pos, match_id) - 1 AS INT) AS seq FROM (SELECT DISTINCT filing_id, match_id, block_id, start_pos FROM pii_match WHERE filing_id IS NOT NULL)")
def w6_audit_order(s: SparkSession, sf: str) -> DataFrame:
    p = _t(s, sf, "pii_match").where("filing_id is not null").select("filing_id", "match_id", "block_id", "start_pos").distinct()
    return running(p, ["filing_id"], ["block_id", "start_pos", "match_id"], F.lit(1), "seq").select("filing_id", "match_id", F.col("seq").cast("int").alias("seq"))


@query("SELECT filing_id, match_id, CAST(coalesce(sum(length(text)) OVER (PARTITION BY filing_id ORDER BY block_id, start_pos, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at FROM (SELECT DISTINCT filing_id, match_id, block_id, start_pos, text FROM pii_match WHERE filing_id IS NOT NULL)")
def w7_cumulative_offsets(s: SparkSession, sf: str) -> DataFrame:
    p = _t(s, sf, "pii_match").where("filing_id is not null").select("filing_id", "match_id", "block_id", "start_pos", "text").distinct()
    return running(p, ["filing_id"], ["block_id", "start_pos", "match_id"], F.length("text"), "at").select("filing_id", "match_id", F.col("at").cast("long").alias("at"))


_STRUCT = "entity_type NOT IN ('PERSON', 'ORG')"


@query(
    f"WITH r AS (SELECT DISTINCT filing_id, entity_type, original FROM replacement WHERE {_STRUCT} AND length(original) >= 4), f AS (SELECT filing_id, finding_id, location, text FROM residual_finding WHERE text IS NOT NULL AND filing_id IS NOT NULL) "
    "SELECT r.filing_id, r.entity_type, r.original AS text FROM r WHERE EXISTS (SELECT 1 FROM f WHERE f.filing_id = r.filing_id AND contains(f.text, r.original))"
)
def j10_leaked_originals(s: SparkSession, sf: str) -> DataFrame:
    blocks = _t(s, sf, "residual_finding").where("text is not null and filing_id is not null").select("filing_id", F.col("finding_id").alias("block_id"), "location", "text").distinct()
    r = _t(s, sf, "replacement").where(_STRUCT)
    return verify.leaked(blocks, r, "filing_id").select("filing_id", "entity_type", "text")


@query(
    "WITH f AS (SELECT DISTINCT filing_id, entity_type, text, location FROM residual_finding WHERE filing_id IS NOT NULL AND text IS NOT NULL), k AS (SELECT DISTINCT filing_id, fake FROM replacement WHERE filing_id IS NOT NULL) "
    "SELECT filing_id, entity_type, text, location FROM f WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.filing_id = f.filing_id AND k.fake = f.text)"
)
def j11_not_a_fake(s: SparkSession, sf: str) -> DataFrame:
    f = _t(s, sf, "residual_finding").where("filing_id is not null and text is not null")
    return verify.not_fakes(f, _t(s, sf, "replacement"), "filing_id")


@query()
def f12_unexpected(s: SparkSession, sf: str) -> DataFrame:
    f = _t(s, sf, "residual_finding").where("filing_id is not null and text is not null")
    return verify.unexpected(f, _t(s, sf, "replacement").where("filing_id is not null"), "filing_id")


@query(
    "SELECT filing_id, count(*) FILTER (kind = 'leaked') = 0 AS clean, count(*) FILTER (kind = 'leaked') AS leaked, count(*) FILTER (kind = 'unexpected') AS unexpected, string_agg(DISTINCT entity_type, ',' ORDER BY entity_type) AS types, CAST(sum(length(text)) AS BIGINT) AS scanned_characters "
    "FROM (SELECT DISTINCT finding_id, filing_id, kind, entity_type, text FROM residual_finding) WHERE filing_id IS NOT NULL GROUP BY 1"
)
def a7_scan_report(s: SparkSession, sf: str) -> DataFrame:
    f = _t(s, sf, "residual_finding").where("filing_id is not null").select("finding_id", "filing_id", "kind", "entity_type", "text").distinct()
    blocks = f.select("filing_id", "text")
    rows = f.select("filing_id", "entity_type", "text", F.lit("").alias("location"), "kind")
    part = lambda k: rows.where(F.col("kind") == k).drop("kind")
    return verify.report(part("leaked"), part("unexpected"), blocks, "filing_id")


# ---- measures, context, sample -------------------------------------------------------------------------------------------------------------

_GOLD = "SELECT DISTINCT match_id, entity_type, start_pos, end_pos FROM pii_match"


@query(
    f"WITH g AS ({_GOLD}), m AS (SELECT entity_type, CASE WHEN match_id % 11 = 0 THEN NULL WHEN end_pos > start_pos AND greatest(0, end_pos - (start_pos + match_id % 9)) * 1.0 / (end_pos - start_pos) >= 0.5 THEN 1 ELSE 0 END AS hit FROM g), "
    "c AS (SELECT entity_type, count(*) FILTER (hit = 1) AS tp, count(*) FILTER (hit = 0) AS fp, count(*) FILTER (hit IS NULL OR hit = 0) AS fn FROM m GROUP BY GROUPING SETS ((entity_type), ())) "
    "SELECT entity_type, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(CASE WHEN tp + fp > 0 THEN tp * 1.0 / (tp + fp) ELSE CASE WHEN fn = 0 THEN 1.0 ELSE 0.0 END END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp * 1.0 / (tp + fn) ELSE CASE WHEN fp = 0 THEN 1.0 ELSE 0.0 END END, 6) AS recall FROM c"
)
def a10_measures(s: SparkSession, sf: str) -> DataFrame:
    """Labelled spans against the same spans moved right by match_id % 9 signs, every eleventh left out."""
    g = _t(s, sf, "pii_match").select("match_id", "entity_type", "start_pos", "end_pos").distinct()
    gold = g.select(F.col("match_id").cast("string").alias("doc_id"), "entity_type", F.col("start_pos").alias("start"), F.col("end_pos").alias("end"))
    move = (F.col("match_id") % 9).cast("int")
    pred = g.where("match_id % 11 <> 0").select(F.col("match_id").cast("string").alias("doc_id"), "entity_type", (F.col("start_pos") + move).alias("start"), (F.col("end_pos") + move).alias("end"))
    return evaluate.scores(evaluate.matched(gold, pred), ["entity_type"]).select("entity_type", "tp", "fp", "fn", "precision", "recall")


_RS = "SELECT id, batch_no, min(text) AS text FROM real_sample GROUP BY 1, 2"


@query(f"WITH r AS ({_RS}) SELECT id, batch_no, left(concat_ws(' | ', nullif(trim(lag(text) OVER w), ''), nullif(trim(lead(text) OVER w), '')), 220) AS context FROM r WINDOW w AS (PARTITION BY batch_no ORDER BY id)")
def w1_neighbour_context(s: SparkSession, sf: str) -> DataFrame:
    r = _t(s, sf, "real_sample").groupBy("id", "batch_no").agg(F.min("text").alias("text"))
    return context.neighbour_context(r, "batch_no", "id").select("id", "batch_no", "context")


_MARK = context.MARKER.replace("(?iU)", "(?i)")


@query(
    f"WITH t AS (SELECT DISTINCT text FROM real_sample WHERE length(text) BETWEEN 60 AND 700), r AS (SELECT text, CASE WHEN regexp_matches(text, '{_MARK}') THEN 'dense' ELSE 'prose' END AS stratum FROM t) "
    "SELECT text, stratum, CAST(row_number() OVER (PARTITION BY stratum ORDER BY md5(concat('7', text)), text) AS INT) AS rank FROM r QUALIFY rank <= 18"
)
def s22_stratified_sample(s: SparkSession, sf: str) -> DataFrame:
    return context.stratified_sample(_t(s, sf, "real_sample").select("text")).select("text", "stratum", "rank")


@query("SELECT kind, entity_type, text, location FROM (SELECT DISTINCT kind, entity_type, text, location FROM residual_finding) UNION SELECT 'replaced', entity_type, original, NULL FROM replacement")
def u5_distinct_findings(s: SparkSession, sf: str) -> DataFrame:
    a = _t(s, sf, "residual_finding").select("kind", "entity_type", "text", "location")
    b = _t(s, sf, "replacement").select(F.lit("replaced").alias("kind"), "entity_type", F.col("original").alias("text"), F.lit(None).cast("string").alias("location"))
    return a.unionByName(b).distinct()


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2")
def st_events_by_hour(s: SparkSession, sf: str) -> DataFrame:
    return windowed_counts(_t(s, sf, "events"))


# ---- the whole pipeline --------------------------------------------------------------------------------------------------------------------


def _filing_blocks(s: SparkSession, sf: str) -> DataFrame:
    """Blocks of the sample as documents: a document for each batch."""
    t = _t(s, sf, "real_sample").where("id is not null").groupBy("id").agg(F.min(F.struct("batch_no", "text", "context")).alias("b"))
    return t.select(F.col("b.batch_no").cast("string").alias("doc_id"), F.col("id").cast("long").alias("block_id"), F.col("b.text").alias("text"), F.col("b.context").alias("context"))


@query()
def flow_detected_counts(s: SparkSession, sf: str) -> DataFrame:
    d = pipeline.spans_of(pipeline.detect(wide(_filing_blocks(s, sf))))
    return d.groupBy("entity_type", tier(F.col("confidence")).alias("confidence_tier")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("text").alias("texts"))


@query()
def flow_redacted(s: SparkSession, sf: str) -> DataFrame:
    r = pipeline.redact(_filing_blocks(s, sf), check=False)
    return r.redacted.select("doc_id", "block_id", "redacted")


@query()
def flow_verified(s: SparkSession, sf: str) -> DataFrame:
    return pipeline.redact(_filing_blocks(s, sf)).report


def entry(s: SparkSession, sf: str) -> DataFrame:
    return flow_detected_counts(s, sf)

