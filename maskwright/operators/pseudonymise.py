"""Consistent replacement values as pure expressions of (seed, type, key), and their insertion into the text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.vocab import CASE_MIRRORED

# Parts of the replacement values, of which names are put together; all invented combinations.
GIVEN_HEADS = ("Aa", "Adv", "Bha", "Cha", "Dev", "Esh", "Fal", "Gir", "Har", "Ish", "Jay", "Kav", "Lal", "Mee", "Nak", "Oj", "Pal", "Rit", "San", "Tar", "Urv", "Var", "Yam", "Zoy")
GIVEN_TAILS = ("rav", "ika", "vesh", "rvi", "ansh", "lini", "ant", "esh", "avi", "ita", "un", "ara", "in", "osh", "ya", "endra")
FAMILY_HEADS = ("Ach", "Bhat", "Chand", "Desh", "Fern", "Gokh", "Heg", "Iyer", "Josh", "Kulk", "Lamb", "Men", "Nay", "Ober", "Pill", "Rang", "Saw", "Thak", "Upadh", "Verm", "Wag", "Yad")
FAMILY_MIDDLES = ("", "ar", "an", "ul", "in", "am", "esh", "av")
FAMILY_TAILS = ("arya", "ia", "ran", "mukh", "andes", "ale", "kar", "pande", "sekar", "karni", "wal", "on", "ak", "oi", "raj")
FIRM_HEADS = ("Amber", "Blue", "Cedar", "Dawn", "East", "Fern", "Gold", "Harbor", "Iron", "Jade", "King", "Lark", "Maple", "North", "Oak", "Pine", "Quarry", "River", "Silver", "Thorn", "Umber", "Vale", "West", "Yarrow")
FIRM_TAILS = ("line", "peak", "way", "field", "mere", "hill", "crest", "view", "bridge", "stone", "ford", "spur", "wood", "gate", "haven", "dale", "bend", "lake", "bury", "mount", "shore", "well", "brook", "cliff")
TRADE = ("Advisory", "Analytics", "Components", "Consulting", "Foods", "Holdings", "Logistics", "Motors", "Polymers", "Software", "Textiles", "Traders", "Agro", "Cables", "Ceramics", "Chemicals", "Packaging", "Steel", "Systems", "Tyres")
FORM = ("Private Limited", "Limited", "LLP")
STREET = ("Lotus", "Temple", "Station", "Garden", "Lake", "Hill", "Market", "Park", "River", "School", "Mill", "Palm")
CITY_HEADS = ("Anand", "Bhav", "Dev", "Kishan", "Madhav", "Ram", "Shiv", "Sundar", "Gopal", "Hari", "Lakshm", "Nand")
CITY_TAILS = ("pur", "nagar", "garh", "abad", "wadi", "kheda")
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
UPI = ("okaxis", "okicici", "oksbi", "ybl", "paytm", "upi")
UPPER, DIGITS, ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def fake_key(text: Column) -> Column:
    """Key of a value: trimmed and lower case."""
    return F.lower(F.trim(text))


def _n(seed: int, kind: str, key: Column, salt: object, size: int) -> Column:
    """A number below ``size`` drawn by a digest of seed, type, key and salt."""
    return F.pmod(F.xxhash64(F.lit(f"{seed}/{kind}/{salt}"), key), F.lit(size)).cast("int")


def _pick(words: tuple[str, ...], n: Column) -> Column:
    """The word at place ``n``; the words are one literal, which the optimiser splits once, so expressions stay small."""
    return F.element_at(F.split(F.lit("|".join(words)), r"\|"), n + 1)


def _template(seed: int, kind: str, key: Column, shape: str) -> Column:
    """L: letter, D: digit, N: digit from 1, A: letter or digit; other signs stay."""
    alphabet = {"L": UPPER, "D": DIGITS, "N": DIGITS[1:], "A": ALNUM}
    return F.concat(*[F.substring(F.lit(alphabet[c]), _n(seed, kind, key, i, len(alphabet[c])) + 1, F.lit(1)) if c in alphabet else F.lit(c) for i, c in enumerate(shape)])


def _digits_like(seed: int, kind: str, key: Column, original: Column, first: Column, skip: Column) -> Column:
    """``original`` with every digit after the first ``skip`` signs drawn anew; the first of them comes from ``first``."""
    signs = F.filter(F.split(original, ""), lambda c: c != "")
    drawn = F.transform(
        signs,
        lambda c, i: F.when(
            (i >= skip) & c.rlike(r"^\d$"),
            F.when(F.exists(F.slice(signs, F.lit(1), i), lambda x: F.lit(False)) | ~F.concat_ws("", F.slice(signs, skip + 1, F.greatest(i - skip, F.lit(0)))).rlike(r"\d"), first).otherwise(F.pmod(F.xxhash64(F.lit(f"{seed}/{kind}/digit"), key, i), F.lit(10)).cast("string")),
        ).otherwise(c),
    )
    return F.array_join(drawn, "")


def luhn_digit(number: Column) -> Column:
    """The digit that makes a row of digits pass the Luhn check when set behind it."""
    n = F.length(number)
    total = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        F.lit(0),
        lambda acc, i: acc + F.when((n - i) % 2 == 0, F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substring(number, i, F.lit(1)).cast("int") + 1)).otherwise(F.substring(number, i, F.lit(1)).cast("int")),
    )
    return ((10 - total % 10) % 10).cast("string")


def generic(original: Column) -> Column:
    """Replacement of types without a generator: REDACTED- and eight signs of the SHA-256 of the value."""
    return F.concat(F.lit("REDACTED-"), F.substring(F.sha2(original, 256), 1, 8))


def _built(seed: int, kind: str, key: Column, salt: str, *parts: tuple[str, ...]) -> Column:
    """A name put together of one of each part."""
    return F.concat(*[_pick(p, _n(seed, kind, key, f"{salt}{i}", len(p))) for i, p in enumerate(parts)])


def person(seed: int, key: Column) -> Column:
    """One of about a million names."""
    return F.concat_ws(" ", _built(seed, "PERSON", key, "g", GIVEN_HEADS, GIVEN_TAILS), _built(seed, "PERSON", key, "f", FAMILY_HEADS, FAMILY_MIDDLES, FAMILY_TAILS))


def firm(seed: int, key: Column) -> Column:
    """One of about thirty thousand names, in three legal forms."""
    return F.concat_ws(" ", _built(seed, "ORG", key, "n", FIRM_HEADS, FIRM_TAILS), _pick(TRADE, _n(seed, "ORG", key, 1, len(TRADE))), _pick(FORM, _n(seed, "ORG", key, 2, len(FORM))))


def email(seed: int, key: Column, hint: Column | None = None) -> Column:
    """user@example.com; ``hint`` is the replacement name of the person whose name the local part holds."""
    name = F.coalesce(hint, person(seed, key)) if hint is not None else person(seed, key)
    number = F.when(hint.isNull(), _n(seed, "EMAIL", key, 2, 90) + 10).otherwise(F.lit(None)) if hint is not None else _n(seed, "EMAIL", key, 2, 90) + 10
    return F.concat(F.replace(F.lower(name), F.lit(" "), F.lit(".")), F.coalesce(number.cast("string"), F.lit("")), F.lit("@example.com"))


def phone(seed: int, key: Column, original: Column) -> Column:
    """Country prefix, separators and group lengths stay; also a leading 91 of long numbers and a leading 0. Mobile numbers start with 6 to 9."""
    prefix = F.length(F.regexp_extract(original, r"^(\s*\+\d{1,3}(?=\D))", 1))
    size = F.length(F.regexp_replace(original, r"\D", ""))
    bare = F.when(F.regexp_replace(original, r"\D", "").rlike(r"^91") & (size >= 11), F.length(F.regexp_extract(original, r"^(\D*9\D*1)", 1))).when(F.regexp_replace(original, r"\D", "").rlike("^0"), F.length(F.regexp_extract(original, r"^(\D*0)", 1))).otherwise(0)
    skip = F.when(prefix > 0, prefix).otherwise(bare).cast("int")
    left = F.length(F.regexp_replace(F.substring(original, skip + 1, F.length(original)), r"\D", ""))
    first = F.when(left == 10, _n(seed, "PHONE", key, "m", 4) + 6).otherwise(_n(seed, "PHONE", key, "f", 9) + 1).cast("string")
    return _digits_like(seed, "PHONE", key, original, first, skip)


def value(seed: int, entity_type: Column, original: Column, key: Column | None = None, hint: Column | None = None) -> Column:
    """Replacement of one value. The same (seed, type, key) always gives the same; all-capital names and addresses give all-capital ones.

    Null type or value gives null. Distinct keys may share a replacement; :func:`..plans.pipeline.fakes` draws again where two of a document do.
    """
    k = fake_key(original) if key is None else key
    t = lambda kind, shape: _template(seed, kind, k, shape)
    card = t("CREDIT_CARD", "4" + "D" * 14)
    two = lambda kind, salt, low, size: F.lpad((_n(seed, kind, k, salt, size) + low).cast("string"), 2, "0")
    born = F.concat_ws(" ", two("DATE_OF_BIRTH", 0, 1, 28), _pick(MONTHS, _n(seed, "DATE_OF_BIRTH", k, 1, 12)), (_n(seed, "DATE_OF_BIRTH", k, 2, 57) + 1948).cast("string"))
    area = F.lpad((_n(seed, "SSN", k, 0, 665) + 1).cast("string"), 3, "0")
    ipv4 = F.concat_ws(".", F.element_at(F.array(*[F.lit(x) for x in ("23", "45", "62", "81", "93", "104", "139", "155")]), _n(seed, "IP_ADDRESS", k, 0, 8) + 1), *[_n(seed, "IP_ADDRESS", k, i, 254).cast("string") for i in (1, 2, 3)])
    ipv6 = F.concat_ws(":", F.lit("2001"), F.lit("db8"), *[F.lower(F.hex(_n(seed, "IP_ADDRESS", k, i, 65536))) for i in range(6)])
    fake = (
        F.when(entity_type == "PERSON", person(seed, k))
        .when(entity_type == "EMAIL", email(seed, k, hint))
        .when(entity_type == "PHONE", phone(seed, k, original))
        .when(entity_type == "ORG", firm(seed, k))
        .when(entity_type == "ADDRESS", F.concat((_n(seed, "ADDRESS", k, 0, 899) + 100).cast("string"), F.lit(", "), _pick(STREET, _n(seed, "ADDRESS", k, 1, len(STREET))), F.lit(" Road, "), _built(seed, "ADDRESS", k, "c", CITY_HEADS, CITY_TAILS), F.lit(" - "), t("ADDRESS", "NDDDDD")))
        .when(entity_type == "SSN", F.concat(area, F.lit("-"), two("SSN", 1, 1, 99), F.lit("-"), F.lpad((_n(seed, "SSN", k, 2, 9999) + 1).cast("string"), 4, "0")))
        .when(entity_type == "CREDIT_CARD", F.concat(card, luhn_digit(card)))
        .when(entity_type == "DATE_OF_BIRTH", born)
        .when(entity_type == "IP_ADDRESS", F.when(F.contains(original, F.lit(":")), ipv6).otherwise(ipv4))
        .when(entity_type == "PAN_NUMBER", t("PAN_NUMBER", "LLLLLDDDDL"))
        .when(entity_type == "AADHAAR_NUMBER", t("AADHAAR_NUMBER", "NDDD DDDD DDDD"))
        .when(entity_type == "IFSC_CODE", t("IFSC_CODE", "LLLL0AAAAAA"))
        .when(entity_type == "GSTIN", F.concat(two("GSTIN", 0, 1, 37), t("GSTIN", "LLLLLDDDDLNZA")))
        .when(entity_type == "UPI_ID", F.concat(F.replace(F.lower(person(seed, k)), F.lit(" "), F.lit(".")), F.lit("@"), _pick(UPI, _n(seed, "UPI_ID", k, 2, len(UPI)))))
        .when(entity_type == "PASSPORT_NUMBER", t("PASSPORT_NUMBER", "LDDDDDDD"))
        .when(entity_type == "VOTER_ID", t("VOTER_ID", "LLLDDDDDDD"))
        .when(entity_type == "DRIVING_LICENSE", F.concat(t("DRIVING_LICENSE", "LLDD "), (_n(seed, "DRIVING_LICENSE", k, "y", 34) + 1990).cast("string"), t("DRIVING_LICENSE", "-----DDDDDDD").substr(6, 7)))
        .when(entity_type == "BANK_ACCOUNT_NUMBER", _digits_like(seed, "BANK_ACCOUNT_NUMBER", k, original, (_n(seed, "BANK_ACCOUNT_NUMBER", k, "f", 9) + 1).cast("string"), F.lit(0)))
        .otherwise(generic(original))
    )
    capital = entity_type.isin(*CASE_MIRRORED) & (original == F.upper(original)) & original.rlike(r"\p{L}")
    return F.when(entity_type.isNull() | original.isNull(), None).otherwise(F.when(capital, F.upper(fake)).otherwise(fake))


def faked(spans: Column, seed: int) -> Column:
    """Spans with a field ``fake``."""
    return F.transform(spans, lambda s: s.withField("fake", value(seed, s["entity_type"], s["text"])))


def spliced(text: Column, edits: Column) -> Column:
    """The text with each edit (struct with start, end, fake; disjoint, in order of start) put in; the rest stays sign for sign."""
    state = F.aggregate(
        edits,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, e: F.struct(e["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, e["start"] - acc["at"]), e["fake"]).alias("out")),
    )
    return F.when(text.isNotNull(), F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text))))
