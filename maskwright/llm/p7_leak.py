"""Evaluation texts leaking into training text: BM25 over an inverted index of test items, block-max WAND, verified overlap.

The held-out items are indexed (terms, postings in blocks with the largest impact of each block). Every passage of every document is a query:
terms that cannot lift any item over its threshold alone only count for items that another term brings up (so most passages end at once), and
blocks whose bound is too low are skipped. Runs of five words of the items that the document holds (anchors) bring up what is quoted so often that its
words tell nothing. The items retrieved for a document are verified on its whole text: words of the item in the item's
order in one or two pieces.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import log
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ACCENT = re.compile(r"\\(?:['`^\"~=.]|[cvuHdbkr](?![a-zA-Z]))\s*\{?\s*\\?([a-zA-Z])\s*\}?")
_MARKUP = re.compile(
    r"-\s*\n\s*(?=[^\W\d_])|\\(?:cite|ref|eqref|label|cref|autoref|citep|citet|pageref|includegraphics|input|include)\w*\*?(?:\[[^\]]*\])?\{[^{}]*\}|\$[^$]{0,400}\$|\\\([^)]{0,400}?\\\)|\\[a-zA-Z]+\*?|[~%{}]"
)
_MARKS = re.compile("[\u0300-\u036f]+")
_SPECIAL = {"ss": "ss", "o": "o", "O": "O", "l": "l", "L": "L", "ae": "ae", "oe": "oe", "aa": "a", "AA": "A", "i": "i", "j": "j"}


def folded(text: str) -> str:
    """Lower case without Latin accents (typed as signs, combining signs or commands)."""
    if "\\" in text:
        text = _ACCENT.sub(r"\1", text)
        text = re.sub(r"\\(ss|ae|oe|aa|AA|AE|OE|[oOlLij])(?![a-zA-Z])\s?(?:\{\})?", lambda m: _SPECIAL.get(m[1], m[1]), text)
    text = text.lower()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFD", text)).replace("ß", "ss").replace("ø", "o").replace("ł", "l").replace("æ", "ae").replace("œ", "oe")
        text = unicodedata.normalize("NFC", text)
    return text


_SPLIT = bytes(c if chr(c).isalnum() else 32 for c in range(128)) + bytes(range(128, 256))
_ODD = re.compile(r"[^\x00-\x7f\w\u0900-\u0963\u0966-\u097f]+")
_ANSWER = re.compile(r"\?[\"'»”)\s]*|(?:\A|\n|\s)\s*(?:answer|a|antwort|réponse|respuesta|resposta|risposta|antwoord|उत्तर)\s*:\s*", re.I)
_SENTENCE = re.compile(r"[.!।]\s+(?=\S)")


def _split(folded_text: str) -> list[str]:
    """Runs of letters, digits and vowel signs of a folded text; the bytes of other scripts are parts of words, so no pattern runs on each sign."""
    t = folded_text if folded_text.isascii() else _ODD.sub(" ", folded_text)
    return t.encode().translate(_SPLIT).decode().split()


def words(text: str, markup: bool = True) -> list[str]:
    """Words of a text; with ``markup`` after references, inline formulas, commands and line-end hyphens are taken out."""
    t = folded(text)
    if markup:
        t = _MARKUP.sub(lambda m: "" if m[0][0] == "-" else " " if m[0][:2] != "\\-" else "", t)
    return _split(t)


def answer_at(text: str) -> int:
    """Number of words before the answer of an item: it begins behind the last question mark or answer label; without one, its last sentence is the answer."""
    ends = [m.end() for m in _ANSWER.finditer(text) if m.end() < len(text.rstrip())] or [m.end() for m in _SENTENCE.finditer(text)]
    return len(words(text[: ends[-1]])) if ends else 0


_at = itemgetter(0)


class Index:
    """Inverted index of items: per term its postings (item, impact), in blocks of ``block`` postings with the largest impact of each.

    ``df`` counts the documents of the whole corpus that hold a term, ``n`` all documents: a term is worth what it tells in the corpus. Impacts
    are shares of what an item needs to be retrieved, so one bound, 1, holds for short and long items alike.
    """

    def __init__(self, items: list[tuple[int, str]], df: dict[str, int], n: int, share: float, block: int = 16, window: int = 8, k1: float = 1.2, b: float = 0.5) -> None:
        self.ids = [i for i, _ in items]
        self.tokens = [words(t) for _, t in items]
        self.answer = [answer_at(t) for _, t in items]
        mean = sum(map(len, self.tokens)) / max(1, len(items)) or 1
        idf = lambda w: log(1 + (max(n, df.get(w, 0)) - df.get(w, 0) + 0.5) / (df.get(w, 0) + 0.5))
        self.weight = [[idf(w) ** 2 for w in t] for t in self.tokens]
        self.telling = [telling(w) for w in self.weight]
        # items of under ``window`` words are retrieved where all their words stand one after the other
        self.short: dict[str, list[int]] = defaultdict(list)
        post: dict[str, list[tuple[int, float]]] = defaultdict(list)
        # essential terms: what is left of an item without them cannot reach its threshold (least first, per item)
        self.essential: set[str] = set()
        for i, t in enumerate(self.tokens):
            if len(t) < window:
                if t:
                    self.short[min(t, key=lambda w: (df.get(w, 0), w))].append(i)
                continue
            count = Counter(t)
            # of each window of words the rarest two are indexed
            kept = {w for s in range(0, len(t), window) for w in sorted(set(t[s : s + window]), key=lambda w: (df.get(w, 0), -len(w), w))[:2]}
            impact = {w: idf(w) * count[w] * (k1 + 1) / (count[w] + k1 * (1 - b + b * len(t) / mean)) for w in sorted(kept)}
            need = share * sum(impact.values())
            left = 0.0
            for x, w in sorted((x / need, w) for w, x in impact.items()):
                post[w].append((i, x))
                left += x
                if left >= 1 - 1e-9:
                    self.essential.add(w)
        self.post = dict(post)
        self.terms = frozenset(post)
        self.blocks = {w: [(p[min(len(p), s + block) - 1][0], max(x for _, x in p[s : s + block])) for s in range(0, len(p), block)] for w, p in self.post.items()}
        self.top = {w: max(x for _, x in p) for w, p in self.post.items()}
        # anchors: of each four neighbouring runs of five words the rarest, so any eight words of an item in a row hold one, however frequent they are
        self.anchors: dict[tuple[str, ...], Counter[int]] = defaultdict(Counter)
        for i, t in enumerate(self.tokens):
            fives = list(zip(*(t[k:] for k in range(5))))
            cost = [(min(df.get(w, 0) for w in x), sum(df.get(w, 0) for w in x), k) for k, x in enumerate(fives)]
            for k in {min(cost[s : s + 4])[2] for s in range(max(1, len(fives) - 3)) if cost} if len(t) >= window else ():
                self.anchors[fives[k]][i] += 1
        # half an item of n words, word for word in pieces of eight words and more, holds (n / 2 - 14) / 4 anchors at least
        self.held = [max(1, -(-(len(t) - 28) // 8)) for t in self.tokens]
        self.runs = frozenset(self.anchors)

    def quoted(self, doc: list[str]) -> list[int]:
        """Places of the items of which the document holds enough anchors."""
        n: Counter[int] = Counter()
        for x in self.runs.intersection(zip(*(doc[k:] for k in range(5)))):
            n.update(self.anchors[x])
        return [i for i, k in n.items() if k >= self.held[i]]

    def whole(self, doc: list[str], seen: set[str]) -> list[int]:
        """Places of the short items that stand in the document word for word."""
        out = []
        for w in seen.intersection(self.short):
            for i in self.short[w]:
                t = self.tokens[i]
                if seen.issuperset(t) and any(doc[j : j + len(t)] == t for j in (j for j, x in enumerate(doc) if x == t[0])):
                    out.append(i)
        return out

    def search(self, query: set[str]) -> list[int]:
        """Places of the items that the query lifts over their thresholds: document-at-a-time block-max WAND."""
        post, enough = self.post, 1 - 1e-9
        # of each list: the item it stands at, its largest impact, postings, blocks, place
        lists = [[p[0][0], self.top[w], p, self.blocks[w], 0] for w in query.intersection(self.terms) for p in (post[w],)]
        out: list[int] = []
        while lists:
            lists.sort(key=_at)
            bound, pivot = 0.0, -1
            for z in lists:
                bound += z[1]
                if bound >= enough:
                    pivot = z[0]
                    break
            if pivot < 0:
                break
            # block bound of the lists up to the pivot
            block, skip = 0.0, len(self.ids)
            for at, _, _, blocks, _ in lists:
                if at > pivot:
                    if at < skip:
                        skip = at
                    break
                k = bisect_left(blocks, (pivot, -1.0))
                if k < len(blocks):
                    block += blocks[k][1]
                    if blocks[k][0] < skip:
                        skip = blocks[k][0] + 1
            if block < enough:
                goal = max(skip, pivot + 1)
            elif lists[0][0] == pivot:
                score = 0.0
                for z in lists:
                    if z[0] != pivot:
                        break
                    score += z[2][z[4]][1]
                if score >= enough:
                    out.append(pivot)
                goal = pivot + 1
            else:
                goal = pivot
            over = False
            for z in lists:
                if z[0] >= goal:
                    break
                p = z[2]
                k = z[4] = bisect_left(p, (goal, -1.0), z[4])
                if k < len(p):
                    z[0] = p[k][0]
                else:
                    over = True
            if over:
                lists = [z for z in lists if z[4] < len(z[2])]
        return out

    def possible(self, i: int, pairs: set[tuple[str, str]], least: float) -> bool:
        """Whether :func:`overlap` may reach ``least`` by the neighbouring words that document and item share.

        It may with a run word for word, or where enough telling words of some stretch are held that is long enough for the longer of two pieces.
        """
        t = self.tokens[i]
        n = len(t)
        shared = [x in pairs for x in zip(t, t[1:])]
        run = longest = 0
        for x in shared:
            run = run + 1 if x else 0
            longest = max(longest, run)
        if longest >= max(8, 0.2 * n) - 1:
            return True
        told = self.telling[i]
        known = [(k < n - 1 and shared[k]) or (k > 0 and shared[k - 1]) for k in told]
        edges = [-1, *told, n]
        if max(b - a - 1 for a, b in zip(edges, edges[1:])) >= 0.4 * n:
            return True
        for x in range(len(told)):
            held = 0
            for y in range(x, len(told)):
                held += known[y]
                if held and held >= 0.4 * (y - x + 1) and edges[y + 2] - edges[x] - 1 >= 0.5 * least * n:
                    return True
        return False


def telling(weight: list[float]) -> list[int]:
    """Places of the most telling words of an item: the rarest 15 %."""
    return sorted(k for k, _ in sorted(enumerate(weight), key=lambda z: (-z[1], z[0]))[: max(2, round(0.15 * len(weight)))])


def overlap(item: list[str], weight: list[float], doc: list[str], gap: int = 14) -> tuple[float, list[tuple[int, int]]]:
    """Share of the item's words that the document holds in the item's order, in the best one or two pieces, and the places of these in the item.

    A piece is a chain of common word pairs whose places advance in both texts with few words put in or altered between; within a piece single
    altered words count as held. A piece must hold most of the weight of its words (rare words weigh most) and two fifths of the most telling
    words of its stretch (the rarest 15 % of the item's), so that the same turn of phrase about something else is none. A fifth of the item (eight
    words at least) word for word is a piece however common its words are: much quoted text has no rare ones.
    """
    at: dict[tuple[str, str], list[int]] = defaultdict(list)
    for i in range(len(item) - 1):
        at[item[i], item[i + 1]].append(i)
    word_for_word = max(8, 0.2 * len(item)) - 1
    points = [(j, i) for j in range(len(doc) - 1) for i in at.get((doc[j], doc[j + 1]), ())]
    runs: dict[int, list[int]] = {}  # by diagonal: first and last place of the words held one after the other
    exact: list[tuple[int, int, int, int]] = []
    for j, i in points:
        run = runs.get(j - i)
        if run and run[1] == i:
            run[1] = i + 1
        else:
            if run and run[1] - run[0] >= word_for_word:
                exact.append((run[0], run[1] + 1, run[0] + j - i, run[1] + j - i))
            runs[j - i] = [i, i + 1]
    exact += [(a, b + 1, a + d, b + d) for d, (a, b) in runs.items() if b - a >= word_for_word]
    pieces: list[list] = []  # first i, last i, last j, first j, held places
    near: list[list] = []  # those that a point may still carry on
    for j, i in points:
        if near and j - near[0][2] > 2 * gap:
            near = [p for p in near if j - p[2] <= 2 * gap]
        best = None
        for p in near:
            di, dj = i - p[1], j - p[2]
            if 0 < di <= gap and 0 < dj <= gap + di and (best is None or len(p[4]) > len(best[4])):
                best = p
        if best:
            best[1], best[2] = i, j
            best[4] |= {i, i + 1}
        else:
            pieces.append([i, i, j, j, {i, i + 1}])
            near.append(pieces[-1])
    good = exact
    total = sum(weight)
    told = telling(weight)
    for a, last, end, start, held in pieces:
        b = last + 2
        worth = sum(weight[k] for k in held)
        known = [k in held for k in told if a <= k < b]
        if len(held) >= max(5, 0.4 * (b - a)) and (sum(known) >= 0.4 * len(known) if known else b - a >= 0.4 * len(item)) and worth >= 0.5 * sum(weight[a:b]) and worth >= 0.45 * total * (b - a) / len(item):
            good.append((a, b, start, end))
    best = max((((b - a), [(a, b)]) for a, b, _, _ in good), default=(0, []), key=lambda z: z[0])
    good.sort(key=lambda p: -(p[1] - p[0]))
    for x in range(len(good)):
        for y in range(x):
            p, q = sorted((good[x], good[y]))
            if p[3] < q[2] and q[1] > p[1]:
                both = (p[1] - p[0]) + q[1] - max(q[0], p[1])
                if both > best[0]:
                    best = both, [(p[0], p[1]), (max(q[0], p[1]), q[1])]
    return best[0] / max(1, len(item)), best[1]


def _quick(text: str) -> list[str]:
    """Words without taking out markup: enough to count in how many documents a word stands."""
    return _split(folded(text) if not text.isascii() or "\\" in text and _ACCENT.search(text) else text.lower())


def frequencies(docs: DataFrame, vocabulary: set[str]) -> tuple[dict[str, int], int]:
    """Document frequency of each word of the vocabulary over all documents (column t), and their number; counted per partition, then summed."""
    share = docs.sparkSession.sparkContext.broadcast(frozenset(vocabulary))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter[str] = Counter()
        for p in parts:
            for t in p["t"]:
                n.update(share.value.intersection(_quick(t)))
                n[""] += 1
        yield pd.DataFrame(n.items(), columns=["w", "n"])

    got = {r["w"]: r["n"] for r in docs.select("t").mapInPandas(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()}
    total = got.pop("", 0)
    return got, total


def leaks(docs: DataFrame, key: str, items: DataFrame, item_key: str, least: float = 0.5, share: float = 0.12, passage: int = 160, most_bytes: int = 32_000_000) -> DataFrame:
    """key, item key, held, question_held, answer_held and part, for every document that holds at least ``least`` of the words of an item.

    ``held`` is the share of the item's words, question_held and answer_held that of the words before and in its answer (:func:`answer_at`; null
    where there are none), ``part`` what leaked by at least ``least``: both, question, answer, or neither alone.

    Items come to every executor in groups of at most about ``most_bytes`` of text (checked; larger test sets take several passes over the
    documents). Null or empty texts and items match nothing; an item twice with one id counts once; a document id twice counts once. No shuffle
    of documents. Items of under 8 words leak where they stand word for word.
    """
    spark = docs.sparkSession
    one = items.where(F.col(item_key).isNotNull() & F.col("text").isNotNull()).groupBy(F.col(item_key).cast("long").alias("i")).agg(F.min("text").alias("t"))
    size = one.agg(F.sum(F.length("t"))).first()[0] or 0
    groups = size * 4 // most_bytes + 1
    out = None
    texts = docs.where(F.col(key).isNotNull() & F.col("text").isNotNull()).select(F.col(key).cast("long").alias("k"), F.col("text").alias("t"))
    for g in range(groups):
        rows = [(r["i"], r["t"]) for r in one.where(F.pmod(F.xxhash64("i"), F.lit(groups)) == g).orderBy("i").collect()]
        df, n = frequencies(texts, {w for _, t in rows for w in words(t)})
        index = spark.sparkContext.broadcast(Index(rows, df, n, share))

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ix = index.value
            for p in parts:
                found = [(k, *x) for k, t in zip(p["k"], p["t"]) for x in held(t, ix, least, passage)]
                yield pd.DataFrame(found, columns=["k", "i", "held", "question_held", "answer_held"])

        part = texts.mapInPandas(run, "k long, i long, held double, question_held double, answer_held double")
        out = part if out is None else out.union(part)
    best = out.groupBy("k", "i").agg(F.max(F.struct("held", "question_held", "answer_held")).alias("b")).select("k", "i", "b.*")
    q, a = (F.coalesce(F.col(c) >= least, F.lit(False)) for c in ("question_held", "answer_held"))
    kind = F.when(q & a, "both").when(q, "question").when(a, "answer").otherwise("neither alone")
    return best.select(F.col("k").alias(key), F.col("i").alias(item_key), *[F.round(c, 4).alias(c) for c in ("held", "question_held", "answer_held")], kind.alias("part"))


def held(text: str, ix: Index, least: float, passage: int) -> Iterator[tuple[int, float, float | None, float | None]]:
    """(item id, share held, of the question, of the answer) of the items of which a text holds enough."""
    doc = words(text)
    seen = set(doc)
    hit = set(ix.quoted(doc))
    if not ix.essential.isdisjoint(seen):
        for s in range(0, max(1, len(doc)), 2 * passage):  # any ``passage`` words stand together in one of the queries
            q = set(doc[s : s + 3 * passage])
            if not ix.essential.isdisjoint(q):
                hit.update(ix.search(q))
    for i in ix.whole(doc, seen):
        yield ix.ids[i], 1.0, 1.0 if ix.answer[i] else None, 1.0
    if hit:
        pairs = set(zip(doc, doc[1:]))
        for i in sorted(hit):
            if ix.possible(i, pairs, least):
                share, pieces = overlap(ix.tokens[i], ix.weight[i], doc)
                if share >= least:
                    cut, n = ix.answer[i], len(ix.tokens[i])
                    before = sum(max(0, min(b, cut) - a) for a, b in pieces)
                    after = sum(max(0, b - max(a, cut)) for a, b in pieces)
                    yield ix.ids[i], share, before / cut if cut else None, after / (n - cut) if n > cut else None
