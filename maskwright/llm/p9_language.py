"""Missing or wrong document language labels: multilingual mixture inference.

Running prose is taken out of the markup without moving it. Each sentence has a likelihood under a character n-gram model of each language
(trained on right-labelled sentences). Expectation-maximisation estimates a document's language proportions; the set of languages is the one
with the best penalised likelihood, and sentences get the posterior of their language. Runs of sentences in another language than the main one
are passages.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from hashlib import sha256
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .p7_leak import folded

# Usual notations of the languages, lower case, without region.
NOTATIONS = {
    "en": "en eng english anglais englisch inglés inglês inglese engels", "de": "de deu ger german deutsch allemand alemán alemão tedesco duits", "fr": "fr fra fre french français francais französisch francés francês francese frans",
    "es": "es spa spanish español espanol castellano espagnol spanisch espanhol spagnolo spaans", "pt": "pt por portuguese português portugues portugais portugiesisch portugués portoghese portugees", "it": "it ita italian italiano italien italienisch italiaans",
    "nl": "nl nld dut dutch nederlands néerlandais niederländisch neerlandés olandese holandês flemish", "hi": "hi hin hindi हिन्दी हिंदी",
}
LANGS = tuple(NOTATIONS)
_SKIP_ENV = "equation|align|gather|multline|eqnarray|displaymath|math|figure|table|tabular|tabularx|thebibliography|verbatim|lstlisting|algorithm|algorithmic|tikzpicture|array"
_SKIP_CMD = (
    "title|author|date|affiliation|institute|email|address|keywords|thanks|section|subsection|subsubsection|chapter|part|paragraph|subparagraph|caption|cite|citep|citet|ref|eqref|label|cref|autoref|pageref|input|include|includegraphics|usepackage|documentclass|"
    "bibliography|bibliographystyle|url|href|newcommand|renewcommand|providecommand|def|let|newtheorem|begin|end|vspace|hspace|setlength|texttt|textsc|bibitem"
)
_MARKUP = re.compile(
    rf"(?<!\\)%[^\n]*|\\begin\s*\{{({_SKIP_ENV})(\*?)\}}.*?(?:\\end\s*\{{\1\2\}}|\Z)|\\begin\s*\{{thebibliography\}}.*"
    rf"|\\(?:{_SKIP_CMD})\*?(?![a-zA-Z])(?:\s*\\[a-zA-Z]+)?(?:\s*\[[^\]]*\])*(?:\s*\{{(?:[^{{}}]|\{{(?:[^{{}}]|\{{[^{{}}]*\}})*\}})*\}})*(?:\s*\[[^\]]*\])*(?:\{{(?:[^{{}}]|\{{(?:[^{{}}]|\{{[^{{}}]*\}})*\}})*\}})*"
    r"|\$\$.*?\$\$|\$[^$\n]{0,300}?\$|\\\(.*?\\\)|\\\[.*?\\\]|\\(?!(?:ss|o|O|l|L|ae|oe|AE|OE|aa|AA|i|j|c|v|u|H)(?![a-zA-Z]))[a-zA-Z]+\*?",
    re.S,
)
_START = re.compile(r"\\begin\s*\{document\}|\\maketitle|\\begin\s*\{abstract\}")
_TOKEN = re.compile(r"(?:[^\W\d_]|[\u0900-\u0963\u0970-\u097f]|\\['`^\"~=.]\s?\{?\\?[a-zA-Z]\}?|\\[cvuH]\s?\{[a-zA-Z]\}|\\(?:ss|o|O|l|L|ae|oe|AE|OE|aa|AA|i|j)(?![a-zA-Z])(?:\{\}|\s)?)+")
_STOP = re.compile(r"[.!?।](?=\s|\Z|[~}])|\n\s*\n|\\item")


def label_language(col: Column, more: tuple[str, ...] = ()) -> Column:
    """The language a label names, of the eight and of the codes in ``more``; null for none (null, empty, placeholder or another language)."""
    base = F.split(F.trim(F.lower(col)), r"[-_ (]")[0]
    notes = {**{x: x for x in more}, **{n: k for k, v in NOTATIONS.items() for n in v.split()}}
    return F.element_at(F.create_map(*[F.lit(x) for kv in notes.items() for x in kv]), base)


def prose(text: str) -> str:
    """The text with everything that is no running prose blanked, sign for sign, so that places stay."""
    m = _START.search(text)
    head = m.start() if m else 0
    body = text[head:]
    return " " * head + _MARKUP.sub(lambda m: "\\item" if m[0] == "\\item" else " " * len(m[0]), body)


class Model:
    """Character n-gram log likelihoods of words for each language, kept per word form."""

    forms = 400_000  # so many word forms are kept from one document to the next

    def __init__(self, rows: list[tuple[str, str]], order: int = 4, alpha: float = 0.05) -> None:
        self.order, self.alpha = order, alpha
        there = {k for k, _ in rows}
        self.langs = (*(x for x in LANGS if x in there), *sorted(there.difference(LANGS))) or LANGS
        self.counts: list[dict[str, Counter]] = [defaultdict(Counter) for _ in self.langs]
        signs = set()
        for k, t in rows:
            c = self.counts[self.langs.index(k)]
            for w in _TOKEN.findall(t):
                w = "^" + folded(w) + "$"
                signs |= set(w)
                for n in range(1, order + 1):
                    for i in range(1, len(w)):
                        if i - n + 1 >= 0 or n == 1:
                            c[w[max(0, i - n + 1) : i]][w[i]] += 1
        self.signs = len(signs) + 20
        self.totals = [{h: sum(x.values()) for h, x in c.items()} for c in self.counts]
        self.known: dict[str, int] = {}
        self.matrix = np.zeros((1024, len(self.langs)))

    def word(self, raw: str) -> np.ndarray:
        """Log likelihood of a word: each sign given the signs before it, shorter histories smoothing longer ones."""
        w = "^" + folded(raw) + "$"
        out = np.zeros(len(self.langs))
        for k, (c, total) in enumerate(zip(self.counts, self.totals)):
            for i in range(1, len(w)):
                p = 1 / self.signs
                for n in range(1, self.order + 1):
                    if i - n + 1 < 0 and n > 1:
                        break
                    h = w[max(0, i - n + 1) : i]
                    t = total.get(h, 0)
                    if not t:
                        break
                    p = (c[h][w[i]] + 2.0 * p) / (t + 2.0) if n > 1 else (c[h][w[i]] + self.alpha * self.signs * p) / (t + self.alpha * self.signs)
                out[k] += log(p)
        return np.maximum(out - out.max(), -14.0)

    def between(self) -> None:
        """To be called between documents: forgets the word forms if there are many. Places hold until then."""
        if len(self.known) > self.forms:
            self.known, self.matrix = {}, np.zeros((1024, len(self.langs)))

    def places(self, tokens: list[str]) -> list[int]:
        """Rows of the tokens in ``matrix``, which grows by doubling."""
        known = self.known
        got = [known.get(t, -1) for t in tokens]
        if -1 in got:
            for i, g in enumerate(got):
                if g < 0:
                    t = tokens[i]
                    at = known.get(t)
                    if at is None:
                        at = known[t] = len(known)
                        if at >= len(self.matrix):
                            self.matrix = np.concatenate([self.matrix, np.zeros((at + 1, len(self.langs)))])
                        self.matrix[at] = self.word(t)
                    got[i] = at
        return got


def mixture(ll: np.ndarray, size: np.ndarray, penalty: float = 8.0) -> tuple[np.ndarray, np.ndarray]:
    """(proportions by words, posteriors of the sentences) after expectation-maximisation with the best penalised set of languages.

    ``ll``: log likelihood of each sentence in each language, ``size``: its words. What is fitted, and what the sets of languages are compared
    by, is the log likelihood of the sentences weighted by their words (with mean weight 1). A language stays only if it lifts it by more than
    ``penalty``. Ties go to the first language.
    """
    n, k = ll.shape
    weight = size / size.mean()
    top = ll.argmax(1)
    if (top == top[0]).all():
        p = np.zeros(k)
        p[top[0]] = 1
        return p, np.tile(p, (n, 1))

    def em(use: list[int]) -> tuple[float, np.ndarray, np.ndarray]:
        p = np.full(len(use), 1 / len(use))
        part = ll[:, use]
        m = part.max(1, keepdims=True)
        e = np.exp(part - m)
        for _ in range(12):
            r = e * p
            tot = r.sum(1, keepdims=True)
            r /= np.maximum(tot, 1e-300)
            p = np.maximum((r * weight[:, None]).sum(0) / n, 1e-9)
        return float(((np.log(np.maximum((e * p).sum(1), 1e-300)) + m[:, 0]) * weight).sum()), p, r

    use = sorted(set(top.tolist()))
    best, p, r = em(use)
    while len(use) > 1:
        tries = [(em([u for u in use if u != x]), x) for x in use]
        (l2, p2, r2), x = max(tries, key=lambda z: (z[0][0], -z[1]))
        if l2 + penalty < best:
            break
        use, best, p, r = [u for u in use if u != x], l2, p2, r2
    whole, post = np.zeros(k), np.zeros((n, k))
    whole[use], post[:, use] = p, r
    return whole, post


_models: dict[str, Model] = {}


def languages(docs: DataFrame, key: str, samples: DataFrame, rows: int = 20_000, keep: list[str] | None = None) -> DataFrame:
    """One row per document: key, shares array<struct<lang, share>>, lang, confidence, passages array<struct<start_pos, end_pos, lang, confidence>>.

    ``shares`` are the proportions by words that expectation-maximisation found. The languages are those of the samples, whichever they are.
    The model is fitted on at most ``rows`` sample sentences (the first by a keyed hash). Null texts and texts without prose have null lang,
    no shares and no passages. Places refer to the stored text. ``docs`` has columns key and text; those of ``keep`` come along as label_<name>.
    No shuffle; a document that comes twice comes out twice.
    """
    got = samples.where("text is not null and lang is not null").select("lang", "text").distinct().orderBy(F.xxhash64("text", "lang"), "text").limit(rows).collect()
    share = docs.sparkSession.sparkContext.broadcast([(r["lang"], r["text"]) for r in got])
    version = sha256(repr(share.value).encode()).hexdigest()
    more = keep or []

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if version not in _models:  # one model a Python worker, kept from task to task
            _models.clear()
            _models[version] = Model(share.value)
        model = _models[version]
        names = model.langs
        for part in parts:
            out = []
            for k, text in zip(part["k"], part["t"]):
                out.append((k, *analyse(text or "", model, names)))
            frame = pd.DataFrame(out, columns=["k", "shares", "lang", "confidence", "passages"])
            for c in more:
                frame[f"label_{c}"] = part[f"label_{c}"].values
            yield frame

    schema = "k long, shares array<struct<lang: string, share: double>>, lang string, confidence double, passages array<struct<start_pos: long, end_pos: long, lang: string, confidence: double>>"
    schema += "".join(f", label_{c} {docs.schema[c].dataType.simpleString()}" for c in more)
    src = docs.select(F.col(key).cast("long").alias("k"), F.col("text").alias("t"), *[F.col(c).alias(f"label_{c}") for c in more])
    return src.mapInPandas(run, schema).withColumnRenamed("k", key)


def analyse(text: str, model: Model, names: tuple[str, ...]) -> tuple[list, str | None, float | None, list]:
    """Shares, main language, its confidence and the passages in other languages of one text."""
    model.between()
    t = prose(text)
    spans, idx, starts, at = [], [], [], 0
    for m in _STOP.finditer(t):
        spans.append((at, m.start()))
        at = m.end()
    spans.append((at, len(t)))
    kept = []
    for a, b in spans:
        if b - a > 2 and (tokens := _TOKEN.findall(t, a, b)):
            starts.append(len(idx))
            idx += model.places(tokens)
            kept.append((a, b))
    if not idx:
        return [], None, None, []
    word = model.matrix[idx]
    ll = np.add.reduceat(word, starts, axis=0)
    size = np.diff([*starts, len(idx)]).astype(float)
    p, post = mixture(ll, size)
    best = post.argmax(1)
    main = int(p.argmax())
    conf = float((post[best == main, main] * size[best == main]).sum() / size[best == main].sum()) if (best == main).any() else float(p[main])
    passages: list[list] = []
    for (a, b), x, s, q in zip(kept, best.tolist(), size.tolist(), post.max(1).tolist()):
        if x != main:
            while a < b and t[a].isspace():
                a += 1
            if passages and passages[-1][5] and passages[-1][2] == x:
                old = passages[-1]
                old[1], old[3], old[4] = b, (old[3] * old[4] + q * s) / (old[4] + s), old[4] + s
            else:
                passages.append([a, b, x, q, s, True])
        elif passages:
            passages[-1][5] = False
    shares = [{"lang": names[i], "share": q} for i in np.argsort(-p, kind="stable") if (q := round(float(p[i]), 4)) > 0]
    return shares, names[main], round(conf, 4), [{"start_pos": a, "end_pos": b, "lang": names[x], "confidence": round(float(q), 4)} for a, b, x, q, _, _ in passages]
