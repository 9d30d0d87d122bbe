"""Same postal address written differently.

Each span is parsed into components (unit, house number, street, kind of street, town, postcode). Spans with equal components are one node.
Nodes lie in blocks of the postcode area and of neighbouring localities: areas told by the postcode, by the name of a town and by the names of
localities, learned from the spans that have both. Inside blocks nodes meet through a deletion-neighbourhood index on their street token. Unit,
number, kind of street and postcode are hard vetoes where both sides have them and differ. Of the candidates of a node the one is taken whose
components give the best optimal assignment, and the nodes reached that way are one place. A node that leaves out a part joins the full address
of its block that fits, if only one does.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.skew import spread_join
from .common import latest, pairs_in_classes, plain, plain_py, rooted, stored

# Kinds of street and the ways they are written, longest first.
KINDS = {
    "main road": r"(?:main|mn|mian)\.?\s*(?:road|rd|raod)", "cross road": r"(?:cross|crs|x)\.?\s*(?:road|rd|raod)", "road": r"(?:road|rd|raod)", "street": r"(?:street|str|st)", "lane": r"(?:lane|ln)",
    "marg": r"(?:marg|mg)", "avenue": r"(?:avenue|aven|ave|av)", "path": r"(?:path|pth)",
}
# Words of units by kind; one letter and a dash is the short form.
UNITS = {"flat": "flat", "f": "flat", "shop": "shop", "s": "shop", "office": "office", "o": "office", "off": "office", "unit": "unit", "u": "unit", "apt": "flat", "suite": "office"}
_KIND = re.compile(r"(?P<name>[^\W\d_]{3,}(?:['’-][^\W\d_]+)?)\.?,?\s+(?:" + "|".join(f"(?P<k{i}>{p})" for i, p in enumerate(KINDS.values())) + r")(?![^\W\d_])\.?")
_TAIL = re.compile(
    r"[\s,;:.(<\-]*(?:\be-?\s?mails?\b|\btel(?:ephone)?\b|\bphone\b|\bmob(?:ile)?\b|\bfax\b|\bph\b\.?\s*:?\s*(?=[+(\d])|\(t\)|\(m\)|\bpan\b(?=\W{1,6}(?:no\W{1,3})?[a-z]{5}\s?\d)|\baadhaar\b|\bpassport\b|\bssn\b|\bvoter\b|\bwww\."
    r"|[\w.+-]+@[\w.-]+|[\w.+-]+\s+(?:at|\[at\]|\(at\))\s+[\w.-]+\s+(?:dot|\[dot\]|\(dot\))\s|\+\s?\d|(?<![\d/])\d{5}[ -]\d{5}(?!\d)|(?<![\d/])0?\d{10}(?!\d)|\(\d{3}\)\s*\d{3}|(?<!\d)\d{3}-\d{2}-\d{4}(?!\d))"
)
_PIN = re.compile(r"(?<![\d/#])([1-9]\d{2})[\s-]?(\d{3})(?![\d/])(?!\s?[a-d]\b)")
_UNIT = re.compile(r"(?<![^\W_])(?:(?P<w>flat|shop|office|off|unit|apt|suite|u)\b\.?\s*(?:no\b\.?|number)?\s*[-:#]?\s*|(?P<l>[fsou])\s?-\s?)(?P<n>\d+[a-h]?(?:/\d+)?)(?![\w/])")
_HOUSE = re.compile(r"(?<![^\W_])(?:plot\s*no|door\s*no|h\.?\s*no|house\s*no|d\.?\s*no|plot|no)\b\.?\s*[:#]?\s*(?P<n>\d+[a-h]?(?:/\d+)?)(?![\w/])")
_AREA = re.compile(r"(?<![^\W_])(?:sector|sec|sc|phase|ph|block|blk|ward|stage)\b\.?\s*(?:no\b\.?)?\s*\d{1,2}(?![\w/])")
_NUM = re.compile(r"(?<![\w/])#?\s?(\d+[a-h]?(?:/\d+)?)(?![\w/])")
_DROP = re.compile(r"(?<![^\W_])(?:near|next to|opposite|opp|behind|beside)\b\.?(?:\s+[^\W\d_]+){1,2}")


def parse(text: str) -> dict[str, str | None]:
    """Components of one address: unit_kind, unit, house, street, kind, pin, rest (words of buildings, localities, towns), whole (all words and numbers, of an address without street only). Missing ones are None."""
    t = plain_py(text).lower()
    m = _TAIL.search(t)
    if m and m.start() > 0:
        t = t[: m.start()]
    out: dict[str, str | None] = dict.fromkeys(("unit_kind", "unit", "house", "street", "kind", "pin", "rest", "whole"))
    if m := list(re.finditer(r"[^\W_]+", t)):
        out["whole"] = " ".join(x[0] for x in m)
    num = lambda s: re.sub(r"\s", "", s)
    t = _AREA.sub(" ", t)
    if m := _UNIT.search(t):
        out["unit_kind"], out["unit"] = UNITS[m["w"] or m["l"]], num(m["n"])
        t = t[: m.start()] + " ,, " + t[m.end() :]
    if m := _HOUSE.search(t):
        out["house"] = num(m["n"])
        t = t[: m.start()] + " " + t[m.end() :]
    pins = list(_PIN.finditer(t))
    if pins:
        m = pins[-1]
        out["pin"] = m[1] + m[2]
        t = t[: m.start()] + " ,, " + t[m.end() :]
    t = _DROP.sub(" ", t) if _KIND.search(_DROP.sub(" ", t)) else t
    loose = list(_NUM.finditer(t))
    best = None
    for m in _KIND.finditer(t):
        near = any(0 <= m.start() - n.end() <= 3 or 0 <= n.start() - m.end() <= 4 for n in loose)
        comma = bool(re.search(r",\s", t[m.start() : m.end()]))
        kind = next(k for i, k in enumerate(KINDS) if m[f"k{i}"])
        rank = (comma, not near, kind == "marg" and m.end() >= len(t.rstrip(" ,;india")), m.start())
        if m["name"] in ("main", "cross", "mn") or (best and best[0] <= rank):
            continue
        best = (rank, m, kind)
    if best:
        out["whole"] = None
        out["street"], out["kind"] = best[1]["name"].replace("'", "").replace("-", ""), best[2]
    for n in loose[::-1]:
        v = num(n[1])
        if not out["house"]:
            out["house"] = v
        elif not out["unit"]:
            out["unit"] = v
    if best:
        t = t[: best[1].start()] + " " + t[best[1].end() :]
    out["rest"] = " ".join(re.findall(r"[^\W\d_]{2,}", _NUM.sub(" ", t)))
    return out


def deletions(word: str, most: int = 2) -> list[str]:
    """The word and what is left of it without up to ``most`` letters; words of under eight letters lose at most one, of under three none."""
    k = min(most, 0 if len(word) < 3 else 1 if len(word) < 8 else most)
    return sorted({"".join(c for i, c in enumerate(word) if i not in drop) for n in range(k + 1) for drop in combinations(range(len(word)), n)})


def deletion_hashes(words: list[str], seeds: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the word, hash of its seed and of the word without up to ``most`` letters), all variants of all words, words of one length at a time.

    Equal words with equal seeds have equal hashes; a word whose variants are equal has that hash several times.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(sizes)
    factor, places, out = np.uint64(0x9E3779B97F4A7C15), [], []
    group = sizes * 3 + most
    with np.errstate(over="ignore"):
        for g in np.unique(group):
            rows = np.flatnonzero(group == g)
            size, k = divmod(int(g), 3)
            letters = codes[(ends[rows] - size)[:, None] + np.arange(size)] if size else np.zeros((len(rows), 0), np.uint64)
            for n in range(k + 1):
                for drop in combinations(range(size), n):
                    h = seeds[rows].copy()
                    for i in range(size):
                        if i not in drop:
                            h = (h ^ letters[:, i]) * factor
                            h ^= h >> np.uint64(29)
                    places.append(rows)
                    out.append(h)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(out).view(np.int64)


def letters_lost(words: list[str]) -> np.ndarray:
    """How many letters each word may lose, as in :func:`deletions`."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    return np.where(n < 3, 0, np.where(n < 8, 1, 2))


def distance(a: str, b: str, most: int) -> int:
    """Edits (insert, drop, replace, swap of neighbours) between two words, most + 1 if there are more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            v = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, two[j - 2] + 1)
            row.append(v)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1] if one[-1] <= most else most + 1


@lru_cache(100_000)
def _near(a: str, b: str) -> float:
    if a == b:
        return 1.0
    most = 2 if min(len(a), len(b)) > 5 else 1
    d = distance(a, b, most)
    return 1 - d / (most + 1)


def assigned(a: list[str], b: list[str]) -> float:
    """Mean similarity of the shorter list of component words to the longer under the best one-to-one assignment (exact, at any size); 0.5 for an empty list.

    Shortest augmenting paths with potentials (the Hungarian method), one row after the other.
    """
    if not a or not b:
        return 0.5
    rows, cols = (a, b) if len(a) <= len(b) else (b, a)
    if len(rows) == 1:
        return max(_near(rows[0], y) for y in cols)
    cost = [[1 - _near(x, y) for y in cols] for x in rows]
    n, m = len(rows), len(cols)
    u, v, match = [0.0] * n, [0.0] * (m + 1), [-1] * (m + 1)  # column m is where a row starts
    for i in range(n):
        match[m], at = i, m
        least, before, done = [float("inf")] * (m + 1), [m] * (m + 1), [False] * (m + 1)
        while match[at] >= 0:
            done[at] = True
            r, step, nxt = match[at], float("inf"), m
            for j in range(m):
                if not done[j]:
                    c = cost[r][j] - u[r] - v[j]
                    if c < least[j]:
                        least[j], before[j] = c, at
                    if least[j] < step:
                        step, nxt = least[j], j
            for j in range(m + 1):
                if done[j]:
                    u[match[j]] += step
                    v[j] -= step
                else:
                    least[j] -= step
            at = nxt
        while at != m:
            match[at] = match[before[at]]
            at = before[at]
        match[m] = -1
    return 1 - sum(cost[match[j]][j] for j in range(m) if match[j] >= 0) / n


_COLS = ("unit_kind", "unit", "house", "street", "kind", "pin", "rest", "whole")


def parsed(rows: DataFrame, key: str, col: str = "text") -> DataFrame:
    """``key`` and the components of the address in ``col``; a null text gives null components."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            got = [parse(t) if t else dict.fromkeys(_COLS) for t in p["t"]]
            yield pd.DataFrame({"k": p["k"], **{c: pd.Series([g[c] for g in got], dtype=object) for c in _COLS}})

    schema = "k long, " + ", ".join(f"{c} string" for c in _COLS)
    return rows.select(F.col(key).cast("long").alias("k"), plain(F.col(col)).alias("t")).mapInPandas(run, schema)


def localities(p: DataFrame) -> DataFrame:
    """word, area and n: names of places by the area (first three digits of postcodes) to which most spans with both bind them."""
    w = p.where("pin is not null").select(F.substring("pin", 1, 3).alias("area"), F.explode(F.array_distinct(F.split("rest", " "))).alias("word")).where("length(word) > 3")
    n = w.groupBy("area", "word").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("word").agg(F.sum("n").alias("t"), F.max(F.struct("n", "area")).alias("b"))
    return best.select("word", F.col("b.area").alias("area"), F.col("b.n").alias("n"), "t")


def towns(known: DataFrame) -> DataFrame:
    """area and the word most bound to it, its town: at most 900 rows."""
    return known.groupBy("area").agg(F.max(F.struct((F.col("n") * F.col("n") / F.col("t")).alias("bound"), "word")).alias("b")).select("area", F.col("b.word").alias("town"))


def _keys(nodes: DataFrame) -> DataFrame:
    """node, block, role and h (hash of block and a deletion variant of the street) of each row of ``nodes`` (node, block, role, street)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in parts:
            for at in range(0, len(whole), 4000):  # some forty keys a street: small frames keep the worker small
                p = whole.iloc[at : at + 4000]
                streets = p["street"].tolist()
                i, h = deletion_hashes(streets, p["block"].to_numpy(np.int64).view(np.uint64), letters_lost(streets))
                yield pd.DataFrame({"node": p["node"].to_numpy(np.int64)[i], "role": p["role"].to_numpy(np.int32)[i], "h": h}).drop_duplicates()

    return nodes.select("node", "block", "role", "street").mapInPandas(run, "node long, role int, h long")


def places(spans: DataFrame, key: str, col: str = "text") -> DataFrame:
    """key and place of every address span with a letter or digit; ``spans`` has one row per key.

    Null and empty texts have no place. Spans without street are one place if all their words and numbers are the same in the same order. Copies
    are one node however many there are. A span without postcode, town or known locality is in an area of its own, named ''. A span that leaves
    out unit, number or area is one place with the full address that fits, if exactly one place of its blocks does; where none or several fit it
    is a place of its own. Ties go to the node with more spans, then to the smaller id.
    """
    spark = spans.sparkSession
    p = stored(parsed(spans.where(F.col(col).isNotNull()), key, col).where("street is not null or whole is not null"), "address")
    names = stored(localities(p), "localities")
    known = {r["town"]: r["area"] for r in towns(names).collect()}  # at most 900 rows
    index: dict[str, set[str]] = {}
    for t in known:
        for d in deletions(t, 1 if len(t) < 7 else 2):
            index.setdefault(d, set()).add(t)
    share = spark.sparkContext.broadcast((known, index))

    @F.pandas_udf("string")  # type: ignore[call-overload]
    def town_area(rest: pd.Series) -> pd.Series:
        known, index = share.value

        @lru_cache(50_000)
        def nearest(w: str) -> tuple[int, str] | None:
            c = {t for d in deletions(w) for t in index.get(d, ())}
            best = min(((distance(w, t, 2), t) for t in c), default=None)
            return best if best and best[0] <= (1 if len(w) < 7 else 2) else None

        def of(words: str) -> str:
            ws = words.split()
            for w in reversed(ws):
                if w in known:
                    return known[w]
            got = min((x for w in ws if len(w) > 4 and (x := nearest(w))), default=None)
            if not got:
                got = min((x for a, b in zip(ws, ws[1:]) if (x := nearest(a + b))), default=None)
            return known[got[1]] if got else ""

        return rest.fillna("").map(of)

    # areas by postcode, town and locality: distinct words of places only
    p = p.withColumn("pin_area", F.coalesce(F.substring("pin", 1, 3), F.lit(""))).withColumn("town_area", F.when(F.col("pin_area") == "", town_area("rest")).otherwise(F.lit("")))
    lost = p.where("pin_area = '' and town_area = ''").select("k", F.explode(F.array_distinct(F.split("rest", " "))).alias("word"))
    told = names.where("n >= 5 and n >= 0.8 * t").select("word", F.col("area").alias("locality_area"), (F.col("n") * F.col("n") / F.col("t")).alias("bound"))
    found = lost.join(told, "word").groupBy("k").agg(F.max(F.struct("bound", "locality_area")).alias("b")).select("k", F.col("b.locality_area").alias("locality_area"))
    p = p.join(found, "k", "left")
    area = F.coalesce(F.nullif("pin_area", F.lit("")), F.nullif("town_area", F.lit("")), "locality_area", F.lit(""))
    node_of = ["area", "house", "street", "kind", "unit", "whole"]
    p = p.withColumn("area", area).fillna("", ["house", "unit", "street", "kind", "unit_kind", "whole"])
    p = stored(p.withColumn("node", F.xxhash64(*node_of)), "spans")
    # distinct nodes only from here on; what they say besides is their most complete writing
    nodes = stored(p.groupBy("node", *node_of).agg(F.count(F.lit(1)).alias("n"), F.max("rest").alias("rest"), F.max("unit_kind").alias("unit_kind")), "nodes")

    # block rows. Role 0: nodes with the same parts; 1 to 4: nodes without unit, number, both, area (odd sign: the full addresses that they look for)
    n = nodes.where("street <> ''")
    has = {c: F.col(c) != "" for c in ("area", "house", "unit")}
    cut = lambda role, *parts: F.struct(F.xxhash64(F.lit(abs(role)), *[F.col(c) for c in parts]).alias("block"), F.lit(role).alias("role"))
    rows = [
        F.when(F.lit(True), cut(0, "area", "house", "kind", "unit")),
        F.when(has["house"] & ~has["unit"], cut(1, "area", "house", "kind")), F.when(has["house"] & has["unit"], cut(-1, "area", "house", "kind")),
        F.when(has["unit"] & ~has["house"], cut(2, "area", "unit", "kind")), F.when(has["unit"] & has["house"], cut(-2, "area", "unit", "kind")),
        F.when(~has["unit"] & ~has["house"], cut(3, "area", "kind")), F.when(has["house"], cut(-3, "area", "kind")),
        F.when(~has["area"], cut(4, "house", "unit", "kind")), F.when(has["area"], cut(-4, "house", "unit", "kind")),
    ]
    b = n.select("node", "street", F.inline(F.filter(F.array(*rows), lambda x: x.isNotNull())))
    # only blocks in which somebody may meet somebody
    size = b.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("role") > 0).alias("partial"), F.count_if(F.col("role") < 0).alias("full"), F.count_if(F.col("role") == 0).alias("equal"))
    size = stored(size, "blocks")
    live = size.where("equal > 1 or (partial > 0 and full > 0)").select("block")
    k = stored(_keys(spread_join(b, live, ["block"], F.col("node"), "left_semi", size.select("block", "n"))), "keys")
    held = k.groupBy("h").agg(F.count_if(F.col("role") >= 0).alias("a"), F.count(F.lit(1)).alias("n")).where("a > 0 and n > 1").select("h")
    k = k.join(held, "h", "left_semi")
    met = k.where("role >= 0").alias("x").join(k.where("role <= 0").alias("y"), F.expr("x.h = y.h and x.node <> y.node and x.role = -y.role"))
    met = met.select(F.col("x.node").alias("node"), F.col("y.node").alias("other"), F.col("x.role").alias("role")).distinct()
    side = nodes.select("node", *[F.col(c).alias(f"a_{c}") for c in ("area", "house", "street", "kind", "unit", "unit_kind", "rest", "n")])
    other = nodes.select(F.col("node").alias("other"), *[F.col(c).alias(f"b_{c}") for c in ("area", "house", "street", "kind", "unit", "unit_kind", "rest", "n")])
    veto = " and ".join(f"(a_{c} = b_{c} or a_{c} = '' or b_{c} = '')" for c in ("area", "house", "unit", "unit_kind")) + " and a_kind = b_kind"
    cand = met.join(side, "node").join(other, "other").where(veto).where("role > 0 or b_n > a_n or (b_n = a_n and other < node)")

    @F.pandas_udf("double")  # type: ignore[call-overload]
    def fit(s: pd.Series, r: pd.Series, s2: pd.Series, r2: pd.Series) -> pd.Series:
        def one(a: str, x: str, b: str, y: str) -> float:
            most = 2 if min(len(a), len(b)) > 7 else 1
            d = distance(a, b, most)
            return 1 - d / 10 + 0.2 * assigned((x or "").split(), (y or "").split()) if d <= most else -1.0

        return pd.Series([one(*z) for z in zip(s, r, s2, r2)], dtype=float)

    cand = stored(cand.select("node", "other", "role", F.col("b_n").alias("other_n"), fit("a_street", "a_rest", "b_street", "b_rest").alias("fit")).where("fit >= 0"), "fits")
    up = stored(cand.where("role = 0").groupBy("node").agg(F.max(F.struct("fit", "other_n", "other")).alias("b")).select("node", F.col("b.other").alias("up")), "up")
    root = stored(rooted(nodes, up), "roots")
    # nodes that leave out a part: the places that fit any node of their class, if it is one; those without unit and number come last
    for roles in ("1, 2, 4", "3"):
        part = cand.where(f"role in ({roles})").join(root, "node").select("root", "other").join(root.select(F.col("node").alias("other"), F.col("root").alias("goal")), "other").where("goal <> root")
        one = part.groupBy("root").agg(F.count_distinct("goal").alias("g"), F.min("goal").alias("to")).where("g = 1").select("root", "to")
        joined = rooted(root.select(F.col("root").alias("node")).distinct(), one.select(F.col("root").alias("node"), F.col("to").alias("up"))).select(F.col("node").alias("root"), F.col("root").alias("place"))
        root = stored(root.join(joined, "root").select("node", F.col("place").alias("root")), "places")
    of = root.withColumnRenamed("root", "place")
    return spread_join(p.select("node", F.col("k").alias(key)), of, ["node"], F.col(key), counts=nodes.select("node", "n")).select(key, "place")


def same_place(spans: DataFrame, key: str, col: str = "text", block: int = 1000) -> DataFrame:
    """Pairs id_a < id_b of spans that denote the same premises; ``spans`` may hold a key twice, it counts once."""
    one = latest(spans.select(key, col), key, col)
    return pairs_in_classes(stored(places(one, key, col), "places"), "place", key, block=block)
