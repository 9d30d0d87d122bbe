"""Types, priorities, tiers and the fixed word lists of the rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<entity_type: string, text: string, start: int, end: int, confidence: double, source: string>"
SPANS = f"array<{SPAN}>"

# The types and the priority in which they claim characters (lower first).
STRUCTURED = (
    "EMAIL", "PHONE", "SSN", "CREDIT_CARD", "DATE_OF_BIRTH", "IP_ADDRESS", "PAN_NUMBER", "AADHAAR_NUMBER", "IFSC_CODE", "GSTIN", "UPI_ID", "PASSPORT_NUMBER", "VOTER_ID", "DRIVING_LICENSE", "BANK_ACCOUNT_NUMBER",
)
TYPES = (*STRUCTURED, "ADDRESS", "PERSON", "ORG")
PRIORITY = {**dict.fromkeys(STRUCTURED, 0), "ADDRESS": 1, "PERSON": 2, "ORG": 3}
SPLITTABLE = ("ADDRESS",)
CASE_MIRRORED = ("PERSON", "ORG", "ADDRESS")
#: Types of detectors added by users: their priority and whether they are cut around winners.
EXTRA: dict[str, tuple[int, bool]] = {}

# Acronyms that are no names.
ACRONYMS = (
    "SSN", "PAN", "DOB", "CFO", "CEO", "COO", "CTO", "HR", "IT", "IP", "PIN", "IFSC", "GST", "TAN", "CIN", "ISIN", "KYC", "ID", "AADHAAR", "NRI", "RHP", "SEBI", "NSE", "BSE", "IPO", "PAT", "EPS", "P&L", "GSTIN", "UPI", "EPIC", "DL", "MICR", "NEFT", "RTGS",
    "IMPS", "NPCI", "UIDAI", "EPFO", "ESIC", "DIN", "LEI",
)
# Words of roles and of field labels.
TITLE_WORDS = (
    "compliance", "officer", "director", "directors", "managing", "independent", "company", "secretary", "statutory", "auditor", "auditors", "legal", "counsel", "chief", "chairman", "president", "registrar", "trustee", "advisor", "advisers", "advisors", "manager", "executive", "board",
    "issue", "lead", "email", "e-mail", "website", "web", "telephone", "tel", "fax", "contact", "person", "address", "grievance", "investor", "name",
)
LABEL_WORDS = (*TITLE_WORDS, "invoice", "order", "reference", "ref", "case", "docket", "ticket", "no", "number", "id")
# Public bodies, which are not redacted.
PUBLIC_BODIES = (
    "securities and exchange board of india", "sebi", "reserve bank of india", "rbi", "national stock exchange of india limited", "national stock exchange", "bse limited", "bombay stock exchange", "stock exchanges", "registrar of companies", "ministry of corporate affairs", "government of india",
    "income tax department", "national payments corporation of india", "npci", "insurance regulatory and development authority",
)
STOPWORDS = ("the", "of", "and", "to", "a", "an", "for", "in", "on")
# Nouns of offer documents that bar a name from being searched for everywhere.
PROCESS_WORDS = (
    "offer", "bid", "bidder", "bidders", "promoter", "promoters", "selling", "shareholder", "shareholders", "equity", "share", "shares", "investor", "investors", "anchor", "proceeds", "price", "facility", "portion", "amount", "account", "period", "date", "report", "statement", "statements",
    "personnel", "managerial", "fund", "funds", "email", "bank", "group", "trust", "institutional", "retail", "qualified", "net", "key", "cap", "floor", "restated", "financial", "form",
)
# Words that make a capitalised phrase a firm, and legal forms at the end of a name.
STRONG_FIRM = "Ltd|Limited|LLP|Pvt|Private|Inc|Corp|Corporation|PLC|LLC|Bank|Securities|Insurance|Partners|Associates|Advisors|Advisers|Consultants|Industries|Technologies|Enterprises|Ventures"
LEGAL_TAIL = r"(?iU)\s+(?:(?:private|pvt\.?)\s+)?(?:limited|ltd\.?|llp|llc|plc|inc\.?|incorporated|corporation|corp\.?)$"
# Handles of payment addresses.
UPI_HANDLES = (
    "okhdfcbank", "okicici", "oksbi", "okaxis", "okbizaxis", "ybl", "ibl", "axl", "apl", "jio", "paytm", "ptsbi", "ptaxis", "ptyes", "hdfcbank", "icici", "axisbank", "sbi", "yesbank", "kotak", "federal", "indus", "idfcbank", "rbl", "freecharge", "airtel", "fbl", "cnrb", "barodampay", "upi",
    "waaxis", "wahdfcbank", "waicici", "wasbi",
)
# Possible lengths of national numbers by country code (public numbering plans); others take 7 to 12 digits.
PHONE_LENGTHS = {"1": (10, 10), "7": (10, 10), "20": (8, 10), "27": (9, 9), "31": (9, 11), "33": (9, 9), "34": (9, 9), "39": (6, 12), "41": (9, 12), "44": (7, 10), "49": (4, 15), "52": (10, 11), "55": (10, 11), "60": (8, 10), "61": (5, 12), "62": (7, 13), "63": (8, 13), "64": (7, 10), "65": (8, 11), "66": (8, 13), "81": (8, 12), "82": (8, 12), "84": (7, 10), "86": (7, 12), "90": (10, 10), "91": (8, 13), "92": (8, 12), "94": (7, 9), "971": (7, 12), "974": (7, 8), "977": (8, 11), "880": (6, 10), "966": (8, 10)}


@dataclass(frozen=True)
class DetectionConfig:
    """Which types are planned, and from what confidence; unknown types are an error."""

    disabled: frozenset[str] = frozenset()
    min_confidence: float = 0.5
    redact_issuer: bool = False
    issuer_names: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        unknown = set(self.disabled) - set(TYPES)
        if unknown:
            raise ValueError(f"unknown types: {', '.join(sorted(unknown))}")

    @property
    def enabled(self) -> tuple[str, ...]:
        return tuple(t for t in TYPES if t not in self.disabled)

    @property
    def kept_issuers(self) -> tuple[str, ...]:
        """Issuer names that stay in the text; empty names are dropped."""
        return () if self.redact_issuer else tuple(n.strip().lower() for n in self.issuer_names if n.strip())


def priority(entity_type: Column) -> Column:
    """Rank of a type in overlap resolution; unknown types come last (9)."""
    ranks = {**PRIORITY, **{t: p for t, (p, _) in EXTRA.items()}}
    out = F.lit(9)
    for rank in sorted(set(ranks.values()), reverse=True):
        out = F.when(entity_type.isin([t for t, p in ranks.items() if p == rank]), rank).otherwise(out)
    return out


def splittable(entity_type: Column) -> Column:
    """Whether a losing span of the type is cut around the winners."""
    return entity_type.isin(*SPLITTABLE, *[t for t, (_, cut) in EXTRA.items() if cut])


def tier(confidence: Column) -> Column:
    """high from 0.9, medium from 0.8, else needs_review (null too)."""
    return F.when(confidence >= 0.9, "high").when(confidence >= 0.8, "medium").otherwise("needs_review")
