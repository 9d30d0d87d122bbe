"""Detectors of structured types: one pattern each, with its validator, as column expressions over a text block."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.spans import before, let, matches, typed, where
from ..functions.vocab import PHONE_LENGTHS, UPI_HANDLES

# Shapes of the types.
EMAIL = r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = r"(?U)(?<![A-Za-z\d])(?:\+?\d{1,3}[\s-]?)?(?:\(?\d{2,5}\)?[\s-]?){2,5}\d{3,4}(?!\d)"
IPV4 = r"(?U)\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"
IPV6 = r"(?U)\b(?:[A-Fa-f0-9]{1,4}:){2,7}[A-Fa-f0-9]{1,4}\b"
SSN = r"(?U)\b\d{3}-\d{2}-\d{4}\b"
CARD = r"(?U)\b(?:\d[ -]?){13,19}\b"
_MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
DATE = rf"(?U)\b(?:\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}|\d{{4}}-\d{{2}}-\d{{2}}|{_MONTH}\s+\d{{1,2}},?\s+\d{{4}}|\d{{1,2}}\s+{_MONTH}\s+\d{{4}})\b"
BIRTH = r"(?i)date of birth|d\.?o\.?b\.?|born on|born"
PAN = r"(?U)\b[A-Z]{5}\d{4}[A-Z]\b"
AADHAAR = r"(?U)\b\d{4}\s\d{4}\s\d{4}\b"
IFSC = r"(?U)\b[A-Z]{4}0[A-Z0-9]{6}\b"
GSTIN = r"(?U)\b\d{2}[A-Z]{5}\d{4}[A-Z][1-9A-Z]Z[0-9A-Z]\b"
UPI = r"(?U)\b[\w.\-]{2,49}@[a-zA-Z][a-zA-Z0-9]{1,64}\b"
PASSPORT = r"(?U)\b[A-Z]\d{7}\b"
VOTER = r"(?U)\b[A-Z]{3}\d{7}\b"
LICENCE = r"(?U)\b[A-Z]{2}[-\s]?\d{2}[-\s]?(?:19|20)\d{2}[-\s]?\d{7}\b"
ACCOUNT = r"(?U)(?<![A-Za-z0-9])\d{9,18}(?![A-Za-z0-9])"


def digits(col: Column) -> Column:
    return F.regexp_replace(col, r"(?U)\D", "")


def luhn(number: Column) -> Column:
    """Whether a row of digits passes the Luhn check; the empty text fails."""
    return (F.length(number) > 0) & F.call_function("luhn_check", number)


def possible_phone(number: Column) -> Column:
    """9 to 13 digits, and with a plus sign a national number of a length that its country code allows (the longest code that fits)."""
    d = digits(number)
    size = F.length(d)
    fits = F.lit(True)
    for width in (1, 2, 3):
        codes = {c: v for c, v in PHONE_LENGTHS.items() if len(c) == width}
        rest = size - width
        ok = F.lit(None).cast("boolean")
        for c, (lo, hi) in codes.items():
            ok = F.when(F.startswith(d, F.lit(c)), rest.between(lo, hi)).otherwise(ok)
        fits = F.coalesce(ok, fits)
    return size.between(9, 13) & (~F.startswith(F.trim(number), F.lit("+")) | fits)


def _near(text: Column, keyword: str, width: int) -> Callable[[Column], Column]:
    return lambda m: before(text, m["start"], width).rlike(keyword)


def email(text: Column, context: Column | None = None) -> Column:
    return typed(matches(text, EMAIL, "@"), "EMAIL", 0.99)


def phone(text: Column, context: Column | None = None) -> Column:
    return typed(where(matches(text, PHONE, r"(?U)\d{3}"), lambda m: possible_phone(m["text"])), "PHONE", 0.95)


def ip_address(text: Column, context: Column | None = None) -> Column:
    return F.concat(typed(matches(text, IPV4, r"\d\.\d"), "IP_ADDRESS", 0.98), typed(matches(text, IPV6, r"[0-9A-Fa-f]:[0-9A-Fa-f]"), "IP_ADDRESS", 0.85))


def ssn(text: Column, context: Column | None = None) -> Column:
    def valid(m: Column) -> Column:
        area = F.substring(m["text"], 1, 3)
        return ~area.isin("000", "666") & ~F.startswith(area, F.lit("9")) & (F.substring(m["text"], 5, 2) != "00") & (F.substring(m["text"], 8, 4) != "0000")

    return typed(where(matches(text, SSN, r"(?U)\d-\d"), valid), "SSN", 0.97)


def credit_card(text: Column, context: Column | None = None) -> Column:
    trimmed = F.transform(
        matches(text, CARD, r"(?U)\d[ -]?\d[ -]?\d[ -]?\d[ -]?\d"),
        lambda m: let(F.regexp_replace(m["text"], "[ -]+$", ""), lambda t: F.struct(t.alias("text"), m["start"].alias("start"), (m["start"] + F.length(t)).cast("int").alias("end"))),
    )
    ok = lambda m: let(F.regexp_replace(m["text"], "[ -]", ""), lambda n: F.length(n).between(13, 19) & luhn(n))
    return typed(where(trimmed, ok), "CREDIT_CARD", 0.96)


def date_of_birth(text: Column, context: Column | None = None) -> Column:
    near = _near(text, BIRTH, 40)
    labelled = F.coalesce(context.rlike(BIRTH), F.lit(False)) if context is not None else F.lit(False)
    return typed(where(matches(text, DATE, r"(?U)\d{4}|\d[/-]\d"), lambda m: labelled | near(m)), "DATE_OF_BIRTH", 0.9)


def pan_number(text: Column, context: Column | None = None) -> Column:
    return typed(matches(text, PAN, r"(?U)[A-Z]\d{4}[A-Z]"), "PAN_NUMBER", 0.9)


def aadhaar_number(text: Column, context: Column | None = None) -> Column:
    near = _near(text, r"(?i)aadhaar|uidai", 25)
    return typed(matches(text, AADHAAR, r"(?U)\d{4}\s\d{4}\s\d{4}"), "AADHAAR_NUMBER", lambda m: F.when(near(m), 0.98).otherwise(0.6))


def ifsc_code(text: Column, context: Column | None = None) -> Column:
    return typed(matches(text, IFSC, "[A-Z]{4}0"), "IFSC_CODE", 0.93)


def gstin(text: Column, context: Column | None = None) -> Column:
    return typed(matches(text, GSTIN, r"(?U)[A-Z]\d{4}[A-Z][1-9A-Z]Z"), "GSTIN", 0.92)


def upi_id(text: Column, context: Column | None = None) -> Column:
    return typed(where(matches(text, UPI, "@"), lambda m: F.lower(F.substring_index(m["text"], "@", -1)).isin(*UPI_HANDLES)), "UPI_ID", 0.9)


def passport_number(text: Column, context: Column | None = None) -> Column:
    return typed(where(matches(text, PASSPORT, r"(?iU)passport.*[A-Z]\d{7}|(?s)passport"), _near(text, "(?i)passport", 40)), "PASSPORT_NUMBER", 0.88)


def voter_id(text: Column, context: Column | None = None) -> Column:
    return typed(where(matches(text, VOTER, "(?i)voter|epic|elector"), _near(text, "(?i)voter|epic|elector", 40)), "VOTER_ID", 0.88)


def driving_license(text: Column, context: Column | None = None) -> Column:
    near = _near(text, r"(?iU)driving licen[cs]e|\bdl\s*(?:no\.?|number)?\b", 40)
    return typed(where(matches(text, LICENCE, r"(?U)\d{7}"), near), "DRIVING_LICENSE", 0.96)


def bank_account_number(text: Column, context: Column | None = None) -> Column:
    near = _near(text, r"(?iU)\ba\s*/\s*c\b|account\s*(?:no\.?|number)?\b|bank\s*account", 40)
    return typed(where(matches(text, ACCOUNT, r"(?iU)a\s*/\s*c|account"), near), "BANK_ACCOUNT_NUMBER", 0.96)


DETECTORS: dict[str, Callable[..., Column]] = {
    "EMAIL": email, "PHONE": phone, "SSN": ssn, "CREDIT_CARD": credit_card, "DATE_OF_BIRTH": date_of_birth, "IP_ADDRESS": ip_address, "PAN_NUMBER": pan_number, "AADHAAR_NUMBER": aadhaar_number, "IFSC_CODE": ifsc_code, "GSTIN": gstin, "UPI_ID": upi_id,
    "PASSPORT_NUMBER": passport_number, "VOTER_ID": voter_id, "DRIVING_LICENSE": driving_license, "BANK_ACCOUNT_NUMBER": bank_account_number,
}
