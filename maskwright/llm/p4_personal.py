"""Personal information inside free text: candidate gradient boosting.

High-recall generators propose overlapping spans on the text as it looks (look-alike signs mapped, offsets kept); boosted trees score each
proposal by format and context; a calibrated threshold per type selects, and among overlapping proposals the best score wins.

Labels come from the data itself, on a bounded sample (``blocks`` and ``spans`` rows): fields of contact blocks whose label names a type, and
delivered spans of a known type, each also set into contexts of the data's own prose (where something of a sure format or with known words stands)
so that the trees learn to do without the label. What the words before a proposal tell is learned from the same sample. Words of names, of
addresses and of ordinary prose are counted over all spans and blocks; the ``most`` most frequent ones of a kind are broadcast. Names that are on
no list are proposed too, by their capitals, and left to the trees, which see a part of the names as if they were on none.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from math import log1p

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boost import Boosted, best_threshold
from .common import _PY, first_distinct, plain, stored
from .p1_address import KINDS, _TAIL, deletions
from .p3_names import BUSINESS

TYPES = ("EMAIL", "PHONE", "ADDRESS", "PERSON", "PAN_NUMBER", "AADHAAR_NUMBER", "SSN", "PASSPORT_NUMBER", "VOTER_ID")
# Labels of fields and the type of what follows; '' is nothing personal.
LABELS = {
    "contact person": "PERSON", "attention": "PERSON", "kind attention": "PERSON", "compliance officer": "PERSON", "company secretary": "PERSON", "investor grievance e-mail": "EMAIL", "investor grievance email": "EMAIL", "e-mail": "EMAIL", "email": "EMAIL",
    "telephone no": "PHONE", "telephone": "PHONE", "tel. no": "PHONE", "tel no": "PHONE", "tel": "PHONE", "phone": "PHONE", "mobile": "PHONE", "fax": "PHONE", "registered office": "ADDRESS", "corporate office": "ADDRESS", "head office": "ADDRESS", "address": "ADDRESS",
    "pan": "PAN_NUMBER", "aadhaar no": "AADHAAR_NUMBER", "aadhaar": "AADHAAR_NUMBER", "passport no": "PASSPORT_NUMBER", "passport": "PASSPORT_NUMBER", "voter id": "VOTER_ID", "ssn": "SSN", "website": "", "sebi registration no": "", "our ref": "", "your ref": "",
    "reference": "", "name of the lead manager": "", "name of the banker": "", "name of the registrar": "",
}
_ENDS = {c: [re.escape(x[1:]).replace(r"\ ", r"\s+").replace(r"\.", r"\.?") for x in sorted(LABELS, key=lambda x: -len(x)) if x[0] == c] for c in sorted({x[0] for x in LABELS})}  # by first letter
_LABEL = re.compile(rf"(?=[{''.join(_ENDS)}])(?<![^\s|;/.])(?P<l>" + "|".join(f"{c}(?:{'|'.join(xs)})" for c, xs in _ENDS.items()) + r")\b\.?\s*(?P<c>:-?|-(?=\s)|\||\s)\s*")  # on lower-case text
# Words before a value that tell its type, as patterns.
CUES = {
    "EMAIL": r"mail", "PHONE": r"\btel\b|phone|\bmobile|\bcall\b|\bfax\b|\(t\)|\bph\b", "ADDRESS": r"office|address|\bat\b|resid|situated|located", "PERSON": r"officer|person|attention|\b(?:mr|mrs|ms|miss|smt|shri|sri|dr|prof)\b",
    "PAN_NUMBER": r"\bpan\b|permanent account", "AADHAAR_NUMBER": r"aadhaar|uid", "SSN": r"ssn|social security|taxpayer", "PASSPORT_NUMBER": r"passport", "VOTER_ID": r"voter|epic|elector",
}
_CUES = {k: re.compile(v) for k, v in CUES.items()}  # on lower-case text
_REF = re.compile(r"\b(?:ref|reference|invoice|document|folio|file|annexure|order|ticket|isin|registration|regn|clause|version|rs|form|tck|inm|din|no)\b\.?[^a-z]*$", re.I)
TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "shri", "sri", "smt", "kum", "adv", "messrs", "m/s"}
_BLANK = r"[^\S\n]*\n?[^\S\n]*"
_EMAIL = re.compile(
    rf"(?<![\w.+-])(?:[\w+-]+(?:\.[\w+-]+)*@[\w-]+(?:\.[\w-]+)*\.[a-z]{{2,}}"
    rf"|[\w+-]+(?:(?:\.|\s+dot\s+|\s*[(\[]dot[)\]]\s*)[\w+-]+)*(?:\s+at\s+|\s*[(\[]\s*at\s*[)\]]\s*)[\w-]+(?:(?:\s+dot\s+|\s*[(\[]\s*dot\s*[)\]]\s*|\.)[\w-]+)*(?:\s+dot\s+|\s*[(\[]\s*dot\s*[)\]]\s*|\.)[a-z]{{2,}})(?![\w@])", re.I
)
_PHONE = re.compile(r"(?=[+(\d])(?<![\w/@#])(?<![\d][-./])(?:\+\s{0,3}\d{1,3}[\s.-]{0,4}(?:\(\d{1,5}\)[\s.-]{0,4})?|\(\+?\d{2,5}\)[\s.-]{0,4})?\d{2,11}(?:(?:\s{1,4}|[.-]|\s{1,3}-\s{1,3})\d{2,6}){0,4}(?![\w/])(?![-.]\d)")
_IDS = re.compile(
    r"(?<![\w/+-])(?:(?P<PAN_NUMBER>[A-Za-z]{5}\s?\d{4}\s?[A-Za-z])|(?P<VOTER_ID>[A-Za-z]{3}\d{7})|(?P<PASSPORT_NUMBER>[A-Za-z]\d{7})|(?P<SSN>\d{3}-\d{2}-\d{4})|(?P<AADHAAR_NUMBER>\d{4}(?:\s{1,4}|-)\d{4}(?:\s{1,4}|-)\d{4}(?!\s\d)))(?![\w/]|-\w)"
)
_PLAIN_EMAIL = re.compile(r"(?<![\w.+-])[\w+-]+(?:\.[\w+-]+)*@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}(?![\w@])")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d[\d/]*[a-h]?(?![\w])|\d+")
_NAME_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_STREET = re.compile(r"(?<![^\W\d_])(?:" + "|".join(KINDS.values()) + r")(?![^\W\d_])")  # on lower-case text
_UNITS = {"flat", "shop", "office", "unit", "u", "f", "s", "o", "plot", "door", "no", "h", "house"}
_FUNCTION = {"to", "at", "of", "the", "and", "in", "on", "by", "for", "a", "is", "next", "near", "opp", "opposite", "behind", "d", "b", "c"}
_ODD = re.compile("[" + "".join(re.escape(chr(c)) for c in _PY) + "]")
_EASY = {" ", ", ", "; ", ". ", "., ", "-", " - "}
_BREAK = re.compile(r"[|:!?()\[\]<>]|\n\s*\n|-{2,}")
_RESIZED = re.compile("[" + "".join(re.escape(chr(c)) for c, v in _PY.items() if len(v or "") != 1) + "]")
_STRONG = re.compile(r"\b(?:mr|mrs|ms|miss|dr|prof|shri|sri|smt)\b\.?\s+(?=[^\W\d_])")
_STRONG_WORDS = {"mr", "mrs", "ms", "miss", "dr", "prof", "shri", "sri", "smt"}
_CAPITALS = re.compile(r"(?<![\w'’.&-])[A-Z][\w'’]*\.?[ \t]{1,2}[A-Z][\w'’.]*(?:[ \t]{1,2}[A-Z][\w'’.]*)*")
_GAP = re.compile(r"[ \t]+")
_MAIL = re.compile(r"\W{0,2}mail")
_FIRM_NEXT = re.compile(r"[\s,]{0,3}(?:limited|ltd|llp|l\.l\.p|private|pvt|\(p\)|(?:and|&|\+) (?:sons|company|co))\b", re.I)
_TITLE_BEFORE = re.compile(r"(?:\b(?:mr|mrs|ms|miss|dr|prof|shri|sri|smt)\b\.?\s*)+$", re.I)
_VALUE_END = re.compile(r"\n|\||;|/|(?<!\b\w)\.\s+(?=[^\W\d_]{3,})|\s\(")
#: What follows the value in a delivered span, as the JVM cuts it off before words are counted.
_SPAN_TAIL = r"\([^()]*\)|(?:\be-?\s?mails?\b|\btel(?:ephone)?\b|\bphone\b|\bpan\s+[a-z]{5}\d|\baadhaar\b|\bpassport\b|\bssn\b|\bvoter\b|\bph\.?\s*[+(\d]|(?<!\S)\S+@|\+\s?\d).*"
_LETTERS_ONLY = bytes(c if chr(c).isalpha() else 32 for c in range(128)) + bytes(range(128, 256))
_ID_HINT = re.compile(r"\d{4}(?:(?<=[A-Za-z]\d{4})(?:\d{3}|\s?[A-Za-z])|(?<=[A-Za-z]{5}\s\d{4})\s?[A-Za-z])|\d-\d\d-\d|\d{4}[\s-]{1,4}\d{4}[\s-]{1,4}\d{4}")
#: ASCII bytes by kind: digits as 0, letters as a, all blanks as one.
_SHAPE = bytes(48 if 48 <= c < 58 else 97 if chr(c).isascii() and chr(c).isalpha() else 32 if c < 128 and chr(c).isspace() else c for c in range(256))
_DIALLED = re.compile(rb"[0+(][0 ().+-]{8,}")  # in the shape: a run of all signs of phone numbers, from the first that may begin one
_SEVEN, _FOUR = re.compile(rb"a0000000(?![0a_/])"), re.compile(rb"aaaaa ?0000 ?a(?![0a_/])")
_LETTERS = re.compile(r"[^\W\d_]{2,}")
_JOIN = re.compile(r"\.?,?[^\S\n]{1,6}|\.?,?[^\S\n]*\n|-|\.|,")
_HONOUR = re.compile(r"^(?:(?:mr|mrs|ms|miss|dr|prof|shri|sri|smt)\b\.?\s*)+", re.I)
_PERSON_LABELS = {"contact", "attention", "compliance", "secretary"}
_FIRM = re.compile(r"\b(?:limited|ltd|llp|l\.l\.p|private|pvt|(?:and|&|\+) (?:sons|company|co))\b", re.I)
_PART = re.compile(r"[\n|;:()]|\.\s(?=[A-Z])")
_UPPER = re.compile(r"[A-Z]")
_DIGIT, _GROUP, _ALPHA, _PIN6 = re.compile(r"\d"), re.compile(r"\d+"), re.compile(r"[^\W\d_]+"), re.compile(r"\d{3}[\s-]?\d{3}(?!\d)")
#: The same on ASCII texts, faster.
_WORD_A, _NAME_WORD_A, _LETTERS_A, _ALPHA_A, _GROUP_A = (re.compile(p.pattern.replace(r"[^\W\d_]", "[A-Za-z]"), re.A) for p in (_WORD, _NAME_WORD, _LETTERS, _ALPHA, _GROUP))
_MORE, _NUMBER = re.compile(r"[\s.,]*[^\W_]"), re.compile(r"\d+[a-h]?(?:/\d+)?")
_FIRST = re.compile(r"#|\d|flat|shop|office|unit|[ufso]\b|plot|door|no\b|h\.", re.I)
_LEFT_LETTER, _RIGHT_LETTER = re.compile(r"[^\W\d_]\.?,?\s*$"), re.compile(r"[.,]?\s*[^\W\d_]")
_RIGHT_WORD, _RIGHT_DIGIT = re.compile(r"[\s,;.-]*[^\W\d_]"), re.compile(r"[\s,;-]*\d")
_LEFT_PART, _OFFICE = re.compile(r"([^\W_]+)[.#]?[\s,;.-]{0,4}$"), re.compile(r"(?:corporate|registered|head|regd)\W+\w+\W*$", re.I)
_STREET_WORDS = {"road", "rd", "raod", "street", "str", "st", "lane", "ln", "marg", "mg", "avenue", "aven", "ave", "av", "path", "pth"}
_AREA_WORDS = {"sector", "sec", "block", "blk", "phase", "ph", "near", "opp", "opposite", "behind", "next", "post", "ii", "iii"}
_NO_NAME = TITLES | {"limited", "ltd", "private", "pvt", "llp", "india", "and", "to", "of", "the", "in", "at", "by", "for", "no", "is", "or", "ref", "website", "www", "tel", "phone", "telephone", "email", "mail", "sebi", "reference", "attention", "pan", "voter", "passport", "aadhaar", "ssn", "contact", "person", "officer", "compliance", "office", "registered", "corporate", "address", "invoice", "document", "folio", "file", "annexure", "revised", "promoter", "promoters", "director", "directors", "our", "board", "withdrawn"}
_NO_PERSON = {"the", "of", "and", "officer", "person", "contact"}
FEATURES = 42


def mapped(text: str) -> tuple[str, list[int] | None]:
    """The text as it looks, and of each of its signs the place in ``text`` (None: the same place)."""
    if text.isascii() or not _ODD.search(text):
        return text, None
    if not _RESIZED.search(text):
        return text.translate(_PY), None
    out, at = [], []
    for i, ch in enumerate(text):
        v = _PY.get(ord(ch), ch)
        if v:
            out.append(v)
            at.extend([i] * len(v))
    return "".join(out), at


@dataclass
class Words:
    """Word lists learned from delivered spans: share of persons / firms / addresses among the spans that hold a word, and log counts."""

    person: dict[str, float]
    address: dict[str, float]
    fuzzy: set[str]
    common: frozenset[str] = frozenset()  # words of ordinary prose
    shown: frozenset[str] = frozenset()  # words that stand in many blocks, in any case, and hardly ever in names
    lean: dict[tuple[str, str], float] | None = None  # of a type and a word before a proposal: log odds that it is right

    def __post_init__(self) -> None:
        self._known: dict[str, bool] = {}
        top = max(self.address.values(), default=0.0)
        # no parts of a name: words of prose, of firms, of the kinds of streets, titles, labels; and with the names on the list: words of which the way by capitals needs no look
        self.plain = frozenset({*self.shown, *self.common, *_NO_NAME, *BUSINESS, *(x for x in _UNITS if len(x) > 1), *(x for x in self.address if x not in self.person), *_STREET_WORDS, *_AREA_WORDS})
        self.told = self.plain.union(self.person)
        self.barred = frozenset({*self.common, *_NO_NAME, *BUSINESS})  # in no window of a name
        self.generic = {x for x, n in self.address.items() if n > top - 3}  # words of a twentieth of the top count and more: kinds of streets, towns

    def is_address(self, w: str) -> bool:
        got = self._known.get(w)
        if got is None:
            if len(self._known) > 200_000:
                self._known.clear()
            got = self._known[w] = self._is_address(w)
        return got

    def _is_address(self, w: str) -> bool:
        return w in self.address or (len(w) > 4 and w not in self.common and w not in self.person and any(d in self.fuzzy for d in deletions(w, 1)))


_last: list = ["", []]


def _fields(t: str) -> list[tuple[int, int, str]]:
    """(start, end of value, type) of each labelled field; the value runs to the next label. The last text's are kept."""
    if _last[0] is not t:
        _last[:] = [t, _labelled_fields(t)]
    return _last[1]


def _lower(t: str) -> str:
    """Lower case, sign for sign."""
    low = t.lower()
    return low if len(low) == len(t) else "".join(c.lower() if len(c.lower()) == 1 else c for c in t)


def _word_set(low: str) -> set[str]:
    """The runs of letters of a lower-case text."""
    return set(low.encode().translate(_LETTERS_ONLY).decode().split()) if low.isascii() else set(_LETTERS.findall(low))


def _label_type(label: str) -> str:
    got = LABELS.get(label)
    return LABELS.get(" ".join(label.split()).replace("tel no", "tel. no"), "") if got is None else got


def _labelled_fields(t: str) -> list[tuple[int, int, str]]:
    ms = []
    for m in _LABEL.finditer(_lower(t)):
        left = t[max(0, m.start() - 8) : m.start()].rstrip(" \t")[-1:]
        if m["c"].strip() or left in ("", "\n", "|", ";", "/", ".") or (left == "," and t[m.end("l") : m.end("l") + 1] == "."):
            ms.append(m)
    return [(m.end(), (ms[i + 1].start() if i + 1 < len(ms) else len(t)), _label_type(m["l"])) for i, m in enumerate(ms)]


def _numbers(t: str) -> tuple[list[tuple[int, int]], bool]:
    """Where in a text phone numbers may stand, with the sign behind; whether it may hold an identity number. Nothing is left out."""
    if not t.isascii():
        digits = len(_DIGIT.findall(t))
        return [(0, len(t))] if digits > 8 else [], digits > 3 and bool(_ID_HINT.search(t))
    shape = t.encode().translate(_SHAPE)
    runs = [(m.start(), m.end() + 1, m[0]) for m in _DIALLED.finditer(shape) if m[0].count(b"0") > 8]
    ids = b"0-00-0" in shape or _SEVEN.search(shape) or _FOUR.search(shape) or any(b"0000-0000-0000" in b"-".join(x.replace(b"-", b" ").split()) for _, _, x in runs)
    return [(a, b) for a, b, _ in runs], bool(ids)


def propose(t: str, w: Words, only: frozenset[str] | None = None) -> list[tuple[str, int, int]]:
    """Overlapping (type, start, end) proposals in the mapped text."""
    out: list[tuple[str, int, int]] = []
    low = _lower(t)
    seen = _word_set(low)
    if "dot" in seen or "at)" in low or "at]" in low or "at )" in low:
        out += [("EMAIL", m.start(), m.end()) for m in _EMAIL.finditer(t)]
    elif "@" in t:
        end = t.find(" ", t.rfind("@"))  # no address crosses a blank
        out += [("EMAIL", m.start(), m.end()) for m in _PLAIN_EMAIL.finditer(t, t.rfind(" ", 0, t.find("@")) + 1, end if end >= 0 else len(t))]
    phones, ids = _numbers(t)
    for a, b in phones:
        for m in _PHONE.finditer(t, a, b):
            s, e = m.span()
            if e - s >= 9 and 9 <= (d := len(_DIGIT.findall(m[0]))) <= 14 and (d > 9 or t[s] in "+(" or _CUES["PHONE"].search(low, max(0, s - 40), s)):
                out.append(("PHONE", s, e))  # nine digits without prefix only behind a word for telephones
    if ids:
        out += [(m.lastgroup or "", m.start(), m.end()) for m in _IDS.finditer(t)]
    if only:
        return [c for c in out if c[0] in only]
    # runs of capitalised words that are on no list; a dot ends them, except behind an initial
    alpha = _ALPHA_A if t.isascii() else _ALPHA
    if len(seen.difference(w.told)) > 1:
        for m in _CAPITALS.finditer(t):
            if len([x for x in alpha.findall(t, m.start(), m.end()) if x.lower() not in w.plain]) < 2:
                continue
            run: list[tuple[str, int, int]] = []
            runs = [run]
            for x in alpha.finditer(t, m.start(), m.end()):
                a, b = x.span()
                word = x[0].lower()
                gap = t[run[-1][2] : a] if run else " "
                if word in w.plain or not _GAP.fullmatch(gap[1:] if run and gap[0] == "." and run[-1][2] - run[-1][1] == 1 else gap):
                    run = []
                    runs.append(run)
                if word not in w.plain:
                    run.append((word, a, b))
            for run in runs:
                if len(run) > 1 and any(len(x[0]) > 1 for x in run) and not _FIRM_NEXT.match(t, run[-1][2]):
                    e = run[-1][2]
                    out.append(("PERSON", run[0][1], e + 1 if len(run[-1][0]) == 1 and t[e : e + 1] == "." else e))
    named = not w.person.keys().isdisjoint(seen) or not seen.isdisjoint(_PERSON_LABELS)
    strong = set() if seen.isdisjoint(_STRONG_WORDS) else {m.end() for m in _STRONG.finditer(low)}
    mixed = bool(strong)
    streets = list(_STREET.finditer(low)) if not seen.isdisjoint(_STREET_WORDS) else []
    if not (named or mixed or streets):
        return sorted(set(out))
    word, name_word = (_WORD_A, _NAME_WORD_A) if low.isascii() else (_WORD, _NAME_WORD)
    toks = [(m[0], *m.span()) for m in (word if streets else name_word).finditer(low)]  # numbers are needed in addresses only
    n = len(toks)
    mails = [(s, e) for k, s, e in out if k == "EMAIL"]
    # persons: windows of two and three tokens, joined by blanks, a comma or an initial's dot, that hold a word of names or are unknown capitalised words; and label values
    if named or mixed:
        barred = w.barred
        listed = [x[0] in w.person for x in toks]
        near = {k for i, x in enumerate(listed) if x for k in (i - 3, i - 2, i - 1, i)} | ({i for i, x in enumerate(toks) if x[1] in strong} if strong else set())

        def plain(k: int) -> bool:
            x, _, b = toks[k]
            return x not in barred and (x not in w.generic or len(x) < 3) and not x[0].isdigit() and not (len(x) == 1 and t[b : b + 2].lower() == "-m")

        for i in sorted(near):
            if i < 0 or not plain(i) or (mails and any(a <= toks[i][1] < b for a, b in mails)):
                continue
            capital = t[toks[i][1]].isupper()
            for j in (i + 1, i + 2, i + 3):
                if j == i + 3 and not listed[j - 1] and len(toks[j - 1][0]) > 1:
                    break
                if j < n and t[toks[j][1]].isupper() != capital and not listed[j if capital else i]:
                    break  # a word of the sentence before or behind a name in capitals
                if j >= n or not plain(j) or not ((gap := t[toks[j - 1][2] : toks[j][1]]) == " " or _JOIN.fullmatch(gap)):
                    break
                if True in listed[i : j + 1] or (toks[i][1] in strong and t[toks[i][1]].isupper() and t[toks[j][1]].isupper()):
                    e = toks[j][2]
                    if len(toks[j][0]) == 1 and t[e : e + 1] == ".":
                        e += 1
                    out.append(("PERSON", toks[i][1], e))
        for s, e, kind in _fields(t) if not seen.isdisjoint(_PERSON_LABELS) else ():
            if kind == "PERSON":
                v = _VALUE_END.split(t[s:e], 1)[0].rstrip(" .,;|/-")
                v2 = _HONOUR.sub("", v)
                ws = _ALPHA.findall(v2.lower())
                if len(v2) > 2 and ws and not any(x in w.common or x in _NO_NAME for x in ws):
                    a = s + len(v) - len(v2)
                    out.append(("PERSON", a, a + len(v2) + (1 if re.search(r"(?<!\w)\w$", v2) and t[a + len(v2) : a + len(v2) + 1] == "." else 0)))
    # addresses: from each word of a street outward while the words are words of addresses or numbers
    done = -1
    starts = [x[1] for x in toks] if streets else []
    for m in streets:
        i = bisect_left(starts, m.start())
        if i == n or starts[i] < done or i == 0:
            continue

        def ok(k: int, step: int) -> bool:
            x, a, b = toks[k]
            gap = t[b : toks[k + 1][1]] if step < 0 and k + 1 < n else t[toks[k - 1][2] : a] if k else ""
            if gap not in _EASY and (_BREAK.search(gap) or len(gap) > 12):
                return False
            if x[0].isdigit():
                return len(x) <= 6 and "@" not in gap
            if x == "address" or (x == "office" and k and toks[k - 1][0] in ("corporate", "registered", "head", "regd")):
                return False
            if x in _UNITS and len(x) > 1:
                return bool(re.match(r"\W{0,4}(?:no\b\W{0,3})?\s{0,4}\d", low[b : b + 12])) or (k > 0 and (x == "house" or (x == "office" and toks[k - 1][0] == "post")))
            if step < 0 and k == i - 1 and len(x) > 3 and x not in _NO_NAME:
                return True
            if x in _AREA_WORDS or (len(x) == 1 and x in "ufsohd" and re.match(r"\s?[-.]\s{0,4}(?:\d|no\b)", low[b : b + 8])):
                return True
            if len(x) == 1 and x in "nsew" and not _MAIL.match(low, b) and ((k > 0 and w.is_address(toks[k - 1][0])) or (k + 1 < n and w.is_address(toks[k + 1][0]))):
                return True
            if x in w.common and x not in w.address:
                return False
            if w.is_address(x):
                return True
            # one strange word, or two, before the next word of addresses (misspelt, or a blank that slipped)
            if x in w.person or x in _NO_NAME or _LABEL.match(low, a):
                return False
            for nxt in (k + step, k + 2 * step):
                if not 0 <= nxt < n or toks[nxt][0] in w.common or toks[nxt][0] in w.person or toks[nxt][0] in _NO_NAME:
                    return False
                if w.is_address(toks[nxt][0]):
                    return len(x) > 1 and not re.search(r"[|:!?()\[\]<>]|\n\s*\n|\.\s", t[min(b, toks[nxt][2]) : max(a, toks[nxt][1])])
                if toks[nxt][0][0].isdigit():
                    return len(x) > 3 and bool(re.search(r"[,;\n]", gap + t[b : b + 2]))
            return False

        a = b = i
        while a > 0 and ok(a - 1, -1):
            a -= 1
        b = min(n - 1, i + (1 if re.match(r"(?:main|mn|mian|cross|crs|x)\b", toks[i][0]) else 0))
        while b + 1 < n and ok(b + 1, 1):
            b += 1
        while a < i and ((toks[a][0] in _FUNCTION and not (toks[a][0] == "d" and low[toks[a][2] : toks[a][2] + 4].strip(". ").startswith("no"))) or (toks[a][0] in ("no", "office", "unit") and not re.match(r"\W*(?:no\W+)?\d", low[toks[a][2] : toks[a][2] + 9]))):
            a += 1
        while b > i and toks[b][0] in ("and", "at", "to", "of", "the", "no"):
            b -= 1
        s = toks[a][1]
        while s > 0 and t[s - 1] == "#":
            s -= 1
        if (mm := re.search(r"#\s?$", t[:s])) and toks[a][0][0].isdigit():
            s = mm.start()
        e = toks[b][2]
        if t[e : e + 1] == "." and re.fullmatch(r"(?:rd|st|str|ln|mg|ave|av|col|extn|est|twrs|apts|bldg|resi)", toks[b][0]):
            out.append(("ADDRESS", s, e + 1))
        out.append(("ADDRESS", s, e))
        done = e
        if b > i + 1:
            out.append(("ADDRESS", s, toks[b - 1][2]))
        if a < i - 1 and toks[a][0] in ("office", "address", "no", "house"):  # the end of a label, perhaps
            out.append(("ADDRESS", toks[a + 1][1], e))
    return sorted(set(out))


def _before(low: str, s: int) -> list[str]:
    """The last three words before a place, without titles."""
    return [x for x in (_LETTERS_A if low.isascii() else _LETTERS).findall(low, max(0, s - 40), s) if x not in TITLES][-3:]


def _left(t: str, low: str, kind: str, s: int, fields: list[tuple[int, int, str]], w: Words) -> tuple[list[float], int]:
    """The features that a proposal's start tells, the others 0; the end of the labelled field that starts there, or 0."""
    f, end = [0.0] * FEATURES, 0
    f[TYPES.index(kind)] = 1
    alpha = _ALPHA_A if low.isascii() else _ALPHA
    before = t[max(0, s - 40) : s]
    for y in fields:
        if y[0] - 2 <= s < y[1]:
            f[17], f[18] = y[2] == kind, y[2] != kind
            if s - y[0] <= 6:
                f[19], end = 1, y[1]
            break
    if _CUES[kind].search(low, max(0, s - 40), s):
        f[22], f[21] = 1, bool(_CUES[kind].search(low, max(0, s - 18), s))
    f[27] = (t[s - 1 : s] if s else " ").isalnum() or t[s - 1 : s] in ("/", "-", "#", "@")
    f[29] = kind not in ("ADDRESS", "PERSON", "EMAIL") and bool(_REF.search(before[-20:]))
    f[13] = t[s] == "+"
    if w.lean and kind in ("PERSON", "ADDRESS"):
        told = [w.lean.get((kind, x), 0.0) for x in _before(low, s)]
        if told:
            f[40], f[41] = told[-1], sum(told)
    if kind == "PERSON":
        pw = alpha.findall(low, max(0, s - 25), s)
        f[20] = bool(pw) and pw[-1] in TITLES
        f[35] = w.person.get(pw[-1], 0.0) if pw and _LEFT_LETTER.search(before) else 0
    elif kind == "ADDRESS":
        left = _LEFT_PART.search(before)
        prev = left[1].lower() if left and not (left[1].lower() in ("office", "address") and _OFFICE.search(before)) else ""
        f[35] = bool(prev) and (prev in _UNITS or prev in _AREA_WORDS or prev[0].isdigit() or w.is_address(prev)) and prev not in _FUNCTION - {"u", "f", "s", "o", "h"}
    return f, end


def featured(t: str, cands: list[tuple[str, int, int]], w: Words, hidden: frozenset[str] = frozenset()) -> np.ndarray:
    """Format and context features of the proposals of one text. Words in ``hidden`` count as being on no list of names."""
    if not cands:
        return np.zeros((0, FEATURES), np.float32)
    rows = []
    low = _lower(t)
    fields = _fields(t) if any(c in t for c in (":", " - ", "|", "\n")) or t.isupper() else []
    alpha, number = (_ALPHA_A, _GROUP_A) if low.isascii() else (_ALPHA, _GROUP)
    lefts: dict[tuple[str, int], tuple[list[float], int]] = {}  # what proposals with the same start share
    for kind, s, e in cands:
        if (kind, s) not in lefts:
            lefts[kind, s] = _left(t, low, kind, s, fields, w)
        left, end = lefts[kind, s]
        v, after, f = low[s:e], t[e : e + 30], left.copy()
        rows.append(f)
        groups = number.findall(v)
        f[9], f[10], f[16] = e - s, sum(map(len, groups)), len(groups)
        if end:
            f[34] = not _MORE.match(_PART.split(t[e:end], 1)[0])
        f[14] = "(" in v
        f[28] = after[:1].isalnum() or after[:1] in ("/", "@")
        if kind == "PERSON":
            toks = alpha.findall(v)
            f[11] = len(toks)
            f[12] = 1.0 if t[s:e].isupper() else len(_UPPER.findall(t, s, e)) / (e - s)
            sc = [0.0 if y in hidden else w.person.get(y, 0.0) for y in toks]
            f[23], f[24] = (sc[0] if sc else 0), (sc[-1] if sc else 0)
            f[25] = sum(y > 0 for y in sc)
            f[26] = bool(_FIRM.search(_PART.split(after, 1)[0]))
            nw = alpha.findall(low, e, e + 25)
            f[36] = w.person.get(nw[0], 0.0) if nw and _RIGHT_LETTER.match(after) else 0
            f[37] = sum(len(y) == 1 for y in toks)
            f[39] = bool(_FIRM.search(t[s:e])) or not _NO_PERSON.isdisjoint(toks)
        elif kind == "ADDRESS":
            toks = alpha.findall(v)
            f[11] = len(toks)
            f[30] = sum(map(w.is_address, toks)) / max(1, len(toks))
            f[31], f[32] = bool(_STREET.search(v)), bool(_PIN6.search(v))
            f[33] = bool(_FIRST.match(v))
            nw = alpha.findall(low, e, e + 25)
            f[38] = (bool(nw) and w.is_address(nw[0]) and bool(_RIGHT_WORD.match(after))) or bool(_RIGHT_DIGIT.match(after))
            f[36] = len(_NUMBER.findall(v))
    return np.array(rows, np.float32)


def learned_words(spans: DataFrame, blocks: DataFrame, most: int = 200_000, least: float = 0.005) -> Words:
    """Word lists over all delivered spans (type, text) and all blocks (text).

    Words of names and addresses: in at least three spans, four fifths of them of the type; the ``most`` most frequent of a kind come to the
    driver (names beyond are still proposed by their capitals). Words of ordinary prose: in small letters in at least the share ``least`` of the
    blocks (and in four), and no words of names or addresses; as a block has some hundred words, some ten thousand words at most.
    """
    low = F.lower(plain(F.col("text")))
    cut = F.when(F.col("text").rlike(r"[@(]|\d{3}"), F.regexp_replace(low, _SPAN_TAIL, " ")).otherwise(low)
    words = F.array_distinct(F.filter(F.split(cut, r"[^\p{L}]+"), lambda x: F.length(x) > 1))
    typed = spans.where("text is not null and entity_type in ('PERSON', 'ORG', 'ADDRESS')").select("entity_type", F.explode(words).alias("w"))
    each = typed.groupBy("w", "entity_type").agg(F.count(F.lit(1)).alias("n"))
    n = stored(each.groupBy("w").pivot("entity_type", ["PERSON", "ORG", "ADDRESS"]).sum("n").fillna(0), "words")
    total = F.col("PERSON") + F.col("ORG") + F.col("ADDRESS")
    per = n.where((F.col("PERSON") >= 3) & (F.col("PERSON") > 0.8 * total)).orderBy(F.desc("PERSON"), "w").limit(most).collect()
    adr = n.where((F.col("ADDRESS") >= 3) & (F.col("ADDRESS") > 0.8 * total)).orderBy(F.desc("ADDRESS"), "w").limit(most).collect()
    person = {r["w"]: log1p(r["PERSON"]) for r in per if r["w"] not in TITLES and r["w"] not in ("director", "holder", "din")}
    address = {r["w"]: log1p(r["ADDRESS"]) for r in adr if r["w"] not in ("no", "tel", "email", "pan", "ssn", "voter", "passport", "aadhaar", "mail", "telephone", "phone")}
    fuzzy = {d for x in address if len(x) > 4 for d in deletions(x, 1)}
    # of each word the blocks that hold it (in each way of writing it), and those that hold it in small letters beside capitals
    size = blocks.where(F.col("text").isNotNull()).count()

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mixed: Counter[str] = Counter()  # in blocks with capitals
        plain: Counter[str] = Counter()

        def flush() -> pd.DataFrame:
            rows = [(x.lower(), mixed[x] + plain[x], mixed[x] if x.islower() else 0) for x in mixed.keys() | plain.keys()]
            mixed.clear()
            plain.clear()
            return pd.DataFrame(rows, columns=["w", "n", "small"])

        for p in parts:
            for t in p["text"]:
                (plain if t.islower() else mixed).update(_word_set(t))
            if len(mixed) + len(plain) > 200_000:
                yield flush()
        yield flush()

    parts = blocks.where(F.col("text").isNotNull()).select("text").mapInPandas(count, "w string, n long, small long")
    every = parts.where("length(w) > 1").groupBy("w").agg(F.sum("n").alias("n"), F.sum("small").alias("small"))
    often = every.where(F.col("n") >= max(4.0, least * size)).join(n.select("w", "PERSON"), "w", "left").collect()
    listed = lambda r: r["w"] in person or r["w"] in address
    common = frozenset(r["w"] for r in often if r["small"] >= max(4.0, least * size) and not listed(r))
    return Words(person, address, fuzzy, common, frozenset(r["w"] for r in often if (r["PERSON"] or 0) < 0.1 * r["n"] and not listed(r)))


@dataclass
class Model:
    words: Words
    trees: Boosted
    thresholds: dict[str, float]


_TITLES_SHOWN = ("", "Mr. ", "", "Smt. ", "", "Dr ", "Shri ", "", "Prof. ", "Ms. ")
_SURE = ("EMAIL", "PAN_NUMBER", "AADHAAR_NUMBER", "SSN", "PASSPORT_NUMBER", "VOTER_ID", "PHONE")
#: A text with its proposals, which of them are right, and the words whose being listed the trees shall not see.
Labelled = tuple[str, list[tuple[str, int, int]], np.ndarray, frozenset[str]]


def contexts(blocks: list[str], w: Words) -> dict[str, list[tuple[str, str]]]:
    """Of each type what stands before and behind it in prose, by proposals that are sure without it: a format, or names and addresses all of known words."""
    out: dict[str, list[tuple[str, str]]] = {k: [] for k in TYPES}
    for raw in blocks:
        t = mapped(raw)[0]
        if "\n" in t.strip() or " | " in t or _fields(t):
            continue
        sure: list[tuple[str, int, int]] = []
        for kind, s, e in sorted(propose(t, w), key=lambda c: c[1] - c[2]):
            toks = _ALPHA.findall(t[s:e].lower())
            known = all(x in w.person for x in toks) if kind == "PERSON" else sum(map(w.is_address, toks)) > 0.6 * len(toks) if kind == "ADDRESS" else kind in _SURE and (kind != "PHONE" or t[s] in "+(")
            if known and all(e <= b or a <= s for _, a, b in [(k, y, x) for k, x, y in sure]):
                sure.append((kind, s, e))
        for kind, s, e in sure:
            left = t[max(0, s - 80) : s]
            out[kind].append((_TITLE_BEFORE.sub("", left) if kind == "PERSON" else left, t[e : e + 60]))
    return out


def _labelled(blocks: list[str], spans: list[tuple[str, str]], w: Words, longest: int, around: dict[str, list[tuple[str, str]]]) -> list[Labelled]:
    """Labelled texts: fields of contact blocks, and values set into the contexts ``around`` of their type (every third time of any type)."""
    out: list[Labelled] = []

    def add(t: str, gold: set[tuple[str, int, int]], within: tuple[int, int], hidden: frozenset[str]) -> None:
        c = [p for p in propose(t, w) if p[1] < within[1] and p[2] > within[0]]
        if c:
            out.append((t, c, np.array([p in gold for p in c], np.float32), hidden))

    values: list[tuple[str, str]] = []
    for raw in blocks:
        t = mapped(raw)[0]
        if not re.search(r"\n| \| ", t) or len(re.findall(r": | - ", t)) < 2:
            continue
        gold, known = set(), []
        for s, e, kind in _fields(t):
            v = re.split(r"\n\S*(?=[A-Z][\w. -]{2,30}\s*:)| \| ", t[s:e])[0]
            v = re.sub(r"\s*\([A-Za-z ]+\)\s*$", "", v).rstrip(" ;|,\n")
            v = v[:-1] if v.endswith(".") and not re.search(r"(?:\b\w|\b(?:rd|st|str|ln|mg|ave|av|col|extn|est|twrs|apts|bldg|resi))\.$", v, re.I) else v
            if kind == "PERSON":
                v2 = re.sub(r"^(?:(?:mr|mrs|ms|miss|dr|prof|shri|sri|smt)\b\.?\s*)+", "", v, flags=re.I)
                s, v = s + len(v) - len(v2), v2
            known.append((s, s + len(v)))
            if kind in ("PERSON", "ADDRESS"):
                # a remark of one ordinary word behind the value is no part of it
                m = re.search(r"\s+([A-Z][a-z]{4,})$", v)
                if m and "," not in v[m.start() - 1 : m.start()] and m[1].lower() not in w.person and not w.is_address(m[1].lower()) and len(v[: m.start()].split()) > 1:
                    v = v[: m.start()]
                gold.add((kind, s, s + len(v)))
            elif kind:  # the format tells where it ends
                gold |= {c for c in propose(t, w) if c[0] == kind and c[1] == s}
            values.append((kind, v))
        c = [p for p in propose(t, w) if any(a <= p[1] < b for a, b in known)]
        if c:
            out.append((t, c, np.array([p in gold for p in c], np.float32), frozenset()))
    for kind, v in spans:
        v = mapped(v)[0]
        m = _TAIL.search(v.lower())
        values.append((kind if kind in TYPES else "", v[: m.start()] if m and m.start() > 0 and kind in ("PERSON", "ORG", "ADDRESS") else v))
    every = [x for k in TYPES for x in around[k]] or [("", "")]
    for i, (kind, v) in enumerate(values):
        if not v.strip() or "\n" in v or len(v) > longest:
            continue
        for k in range(2 if kind == "PERSON" else 1):
            own = around.get(kind) or every
            a, b = every[(i * 7 + k) % len(every)] if not kind or i % 3 == 0 else own[(i * 7 + 11 * k) % len(own)]
            u = v
            if kind == "PERSON":  # with a title before it or none, the given name in full or as an initial
                u = _HONOUR.sub("", v)
                if k and (m := re.fullmatch(r"(\w)\w+ (\w{4,})", u)):
                    u = f"{m[1]}. {m[2]}"
                a += _TITLES_SHOWN[(i + k) % len(_TITLES_SHOWN)]
            hidden = frozenset(_ALPHA.findall(u.lower())) if kind == "PERSON" and i % 4 == 1 else frozenset()
            add(a + u + b, {(kind, len(a), len(a) + len(u))}, (len(a), len(a) + len(u)), hidden)
    return out


def leanings(rows: list[Labelled], least: int = 5) -> dict[tuple[str, str], float]:
    """Log odds that a proposal is right by each word among the last three before it, against all proposals of its type; words seen ``least`` times."""
    n: dict[tuple[str, str], list[float]] = {}
    total: dict[str, list[float]] = {}
    for t, c, y, _ in rows:
        low = _lower(t)
        for (kind, s, _), right in zip(c, y.tolist()):
            total.setdefault(kind, [1.0, 1.0])[int(right)] += 1
            for x in set(_before(low, s)):
                n.setdefault((kind, x), [0.5, 0.5])[int(right)] += 1
    return {k: float(np.log(v[1] / v[0]) - np.log(total[k[0]][1] / total[k[0]][0])) for k, v in n.items() if v[0] + v[1] > least}


def fit(blocks: DataFrame, spans: DataFrame, n_blocks: int = 3000, n_spans: int = 3000, most: int = 200_000, longest_block: int = 2000, longest_span: int = 300, longest_value: int = 200) -> Model:
    """Trains on at most ``n_blocks`` blocks and ``n_spans`` spans, the first by a keyed hash of their text, so every run has the same model.

    Longer blocks, spans and values than the bounds named are not trained on; all are searched.
    """
    w = learned_words(spans, blocks, most)
    bs = [r["text"] for r in first_distinct(blocks.where(F.length("text") < longest_block), n_blocks, "text")]
    ss = [(r["entity_type"], r["text"]) for r in first_distinct(spans.where(F.length("text") < longest_span), n_spans, "entity_type", "text")]
    rows = _labelled(bs, ss, w, longest_value, contexts(bs, w))
    train, held = [r for i, r in enumerate(rows) if i % 5 != 4], rows[4::5]
    w = replace(w, lean=leanings(train))
    none = (np.zeros((0, FEATURES), np.float32), np.zeros(0, np.float32))
    shown = lambda part: [(c, featured(t, c, w, hidden), y) for t, c, y, hidden in part]
    join = lambda part: (np.concatenate([r[1] for r in part]), np.concatenate([r[2] for r in part])) if part else none
    kept = shown(held)
    trees = Boosted(rounds=50, depth=4, rate=0.25).fit(*join(shown(train))).calibrate(*join(kept))
    # thresholds: on held-out texts, over the proposals that win their overlaps
    won: dict[str, list[tuple[float, float]]] = {k: [] for k in TYPES}
    everything = dict.fromkeys(TYPES, 0.0)
    for c, x, y in kept:
        right = dict(zip(c, y))
        for k, s, e, q in selected("", c, trees.score(x), everything):
            won[k].append((q, float(right[k, s, e])))
    th = {k: best_threshold(*(np.array(z) for z in zip(*v))) if v else 0.5 for k, v in won.items()}
    return Model(w, trees, th)


def selected(t: str, cands: list[tuple[str, int, int]], p: np.ndarray, th: dict[str, float]) -> list[tuple[str, int, int, float]]:
    """Non-overlapping proposals above the threshold of their type, the best score first, then the longer one, then by type and place."""
    kept: list[tuple[str, int, int, float]] = []
    for q, c in sorted(zip(p.tolist(), cands), key=lambda z: (-round(z[0], 2), z[1][1] - z[1][2], z[1])):
        if q >= th[c[0]] and all(c[2] <= k[1] or c[1] >= k[2] for k in kept):
            kept.append((*c, q))
    return sorted(kept, key=lambda k: k[1])


#: Implied by every e-mail address, phone and identity number: an at-sign or the word dot, nine digits with nothing but separators between, or
#: letters and seven digits in a row; texts with other signs than ASCII are always looked at.
GUARD = r"(?i)@|\bdot\b|\[dot|\(dot|(?:\d[\s().+-]{0,10}){8}\d|[a-z]\d{7}|[a-z]{5}\s?\d{4}|[^\x00-\x7f]"


def _found(texts: list[str | None], m: Model, wanted: frozenset[str] | None, known: dict[str | None, list] | None = None) -> list[list[tuple[str, int, int, float]]]:
    """Selected items of each text, in places of the stored text; equal texts (``known``: those of the task so far) are looked at once."""
    known = {} if known is None else known
    if len(known) > 50_000:
        known.clear()
    fresh = list(dict.fromkeys(t for t in texts if t not in known))
    known.update(zip(fresh, _search(fresh, m, wanted)))
    return [known[t] for t in texts]


def _search(texts: list[str | None], m: Model, wanted: frozenset[str] | None) -> Iterator[list[tuple[str, int, int, float]]]:
    maps = [mapped(t) if t else ("", None) for t in texts]
    cands, xs = [], []
    for t, _ in maps:
        cands.append(propose(t, m.words, wanted))
        if cands[-1]:
            xs.append(featured(t, cands[-1], m.words))
    scores, at = (m.trees.score(np.concatenate(xs)) if xs else np.zeros(0)), 0
    for (t, pos), c in zip(maps, cands):
        if not c:
            yield []
            continue
        p, at = scores[at : at + len(c)], at + len(c)
        got = selected(t, c, p, m.thresholds)
        yield got if pos is None else [(k, pos[s], pos[e - 1] + 1, q) for k, s, e, q in got]


def items(rows: DataFrame, key: str, col: str, model: Model, only: tuple[str, ...] | None = None) -> DataFrame:
    """One row per item: key, entity_type, start_pos, end_pos (of the stored text, end-exclusive), confidence. Null and empty texts give none.

    With ``only`` texts that fail :data:`GUARD` never leave the JVM.
    """
    share = rows.sparkSession.sparkContext.broadcast(model)
    wanted = frozenset(only) if only else None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str | None, list] = {}
        for part in parts:
            ks, out = part["k"].tolist(), []
            for k, got in zip(ks, _found(part["t"].tolist(), share.value, wanted, known)):
                out += [(k, *g) for g in got]
            yield pd.DataFrame(out, columns=["k", "entity_type", "start_pos", "end_pos", "confidence"])

    src = rows.select(F.col(key).cast("long").alias("k"), F.col(col).alias("t")).where("t is not null and t <> ''")
    if wanted and wanted.isdisjoint(("ADDRESS", "PERSON")):
        src = src.where(F.col("t").rlike(GUARD))
    return src.mapInPandas(run, "k long, entity_type string, start_pos long, end_pos long, confidence double").withColumnRenamed("k", key)


def redacted(rows: DataFrame, key: str, col: str, model: Model, only: tuple[str, ...] | None = None) -> DataFrame:
    """One row per text: key, n_items, and the text with every item replaced by its type in brackets; a null text stays null."""
    share = rows.sparkSession.sparkContext.broadcast(model)
    wanted = frozenset(only) if only else None

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts, n, red = part["t"].tolist(), [], []
            for text, got in zip(texts, _found(texts, share.value, wanted)):
                out, last = [], 0
                for kind, s, e, _ in got:
                    out += [text[last:s], f"[{kind}]"]
                    last = e
                n.append(len(got))
                red.append(None if text is None else "".join(out) + text[last:])
            yield pd.DataFrame({"k": part["k"], "n_items": n, "redacted": red})

    src = rows.select(F.col(key).cast("long").alias("k"), F.col(col).alias("t"))
    return src.mapInPandas(run, "k long, n_items int, redacted string").withColumnRenamed("k", key)
