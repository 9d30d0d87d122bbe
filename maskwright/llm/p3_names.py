"""Variant spellings of names typed by people: noisy-channel attribution inside each filing.

Every record is reduced to a bag of name tokens (honorifics, legal forms, credentials and what follows the name are dropped). Equal bags of a
filing are one spelling with a frequency. Tokens of a filing that are misspellings of each other are linked by a deletion index over the distinct
tokens of each filing; spellings that share a token, or a link, together with the initial of another token are compared: the posterior of a
candidate canonical form is its log frequency plus the log likelihood that the channel (typo, abbreviation, nickname, dropped part) turned it
into the variant. Each spelling goes to its maximum posterior. Short forms (initials, a firm without its line of business) are placed
last and only where a single entity of the filing fits.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.skew import spread_join
from .common import by_shuffle, latest, pairs_in_classes, plain, plain_py, rooted, stored
from .p1_address import _TAIL, deletion_hashes, distance, letters_lost

# Legal forms, as lower-case patterns over words without dots.
LEGAL = re.compile(
    r"\b(?:limited liability partnership|l\s?l\s?p|l\s?l\s?c|private limited|private ltd|pvt limited|pvt ltd|\(?p\)? ltd|\(p\) limited|public limited company|p\s?l\s?c|limited|ltd|private|pvt|incorporated|inc|corporation|corp|gmbh|"
    r"sons|company|co)\b|\(p\)"
)
# Titles before a name and credentials behind it.
TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "shri", "sri", "smt", "kum", "adv", "ca", "cs", "m/s", "the", "messrs", "er", "capt", "sir"}
CREDENTIALS = {"cfa", "fca", "aca", "acs", "fcs", "mba", "phd", "md", "llb", "jr", "sr", "esq", "frm", "cpa", "llm", "bcom", "mcom", "acma", "fcma", "ca", "cs", "iii", "ii"}
# Lines of business of firms, for proposals in free text; here they are told by the legal forms seen with them.
BUSINESS = set(
    "agro products capital advisors cables ceramics chemicals constructions electronics engineering enterprises foods hospitality industries infrastructure insurance brokers international laboratories "
    "logistics manufacturing motors packaging pharmaceuticals polymers power systems properties securities services shipping steel technologies textiles holdings ventures bank finance trading".split()
)
# Nicknames that are no beginning of the full name.
NICKNAMES = {
    "bob": "robert", "rob": "robert", "bill": "william", "will": "william", "dick": "richard", "rick": "richard", "peggy": "margaret", "meg": "margaret", "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "kate": "katherine",
    "kathy": "katherine", "cathy": "catherine", "jim": "james", "jack": "john", "ted": "theodore", "theo": "theodore", "tony": "anthony", "vicky": "victoria", "larry": "lawrence", "mike": "michael", "nick": "nicholas", "tina": "christina", "becky": "rebecca",
    "kit": "christopher", "sasha": "alexander", "sandy": "alexander", "harry": "harold", "hank": "henry", "fred": "frederick", "freddie": "frederick", "gwen": "gwendolyn", "debbie": "deborah", "deb": "deborah", "steph": "stephanie", "patty": "patricia", "tricia": "patricia",
    "trish": "patricia", "pat": "patricia", "val": "valentina", "lenny": "leonard", "leo": "leonard", "len": "leonard", "zach": "zachary", "zack": "zachary", "ken": "kenneth", "kenny": "kenneth", "joe": "joseph", "ollie": "oliver", "izzy": "isabella", "bella": "isabella",
    "flo": "florence", "matt": "matthew", "greg": "gregory", "nat": "nathaniel", "nate": "nathaniel", "jackie": "jacqueline", "pam": "pamela", "tim": "timothy", "sam": "samuel", "chris": "christopher", "wally": "walter", "walt": "walter", "vince": "vincent", "bea": "beatrice",
    "ros": "rosalind", "roz": "rosalind", "nell": "helen", "ed": "edward", "ned": "edward", "eddie": "edward", "raju": "rajesh", "nacho": "ignacio", "lola": "dolores", "lulu": "lourdes", "yoyo": "yolanda", "dee": "deepak", "winnie": "wilhelmina", "minnie": "wilhelmina", "mina": "wilhelmina",
    "tommy": "thomas", "andy": "andrew", "dan": "daniel", "danny": "daniel", "dave": "david", "steve": "stephen", "sue": "susan",
}


def reduced(text: str) -> tuple[list[str], bool, str]:
    """Name tokens in their order, whether a legal form tells a firm, and the letters of the whole name in a row."""
    t = plain_py(text)
    m = _TAIL.search(t.lower())
    if m and m.start() > 0:
        t = t[: m.start()]
    t = re.sub(r"\((?!\s*[Pp]\s*\))[^()]*\)?|[\"“”][^\"“”]*[\"“”]", " ", t)
    if not re.search(r"(?<!\w)(?:Mc|Mac|De|Le)[A-Z]", t):
        t = regex.sub(r"(?<=\p{Ll})(?=\p{Lu}\p{Ll})", " ", t)
    t = "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))
    low = " " + re.sub(r"\s+", " ", t.lower().replace("’", "'")) + " "
    low = re.sub(r"(?<=\s)m/s\.?", " ", low).replace("int'l", "intl")
    words = re.sub(r"[^\w\s&+()]|_", lambda m: "" if m[0] in "'." else " ", re.sub(r"(?<=\b\w)\.(?=\w\b)", "", low))
    firm = bool(LEGAL.search(words))
    words = LEGAL.sub(" ", words) if firm else words
    out = [w for w in re.findall(r"[^\W\d_]+", words) if w not in ("and",)]
    while out and out[0] in TITLES and len(out) > 1:
        out = out[1:]
    while len(out) > 1 and out[-1] in CREDENTIALS and not firm:
        out = out[:-1]
    return out, firm, "".join(out)


#: A token is a name of its own, not a misspelling of another, if so many filings hold it and a quarter as many as hold the other.
OWN = 6


@lru_cache(200_000)
def _apart(a: str, b: str, most: int) -> int:
    return distance(a, b, most)


def token_cost(v: str, c: str, df_v: int, df_c: int) -> float | None:
    """Negative log likelihood that the channel wrote token ``c`` as ``v``; None if it cannot. df_*: number of filings that hold the token."""
    if v == c:
        return 0.0
    if len(v) == 1:
        return 2.0 if c[0] == v else None
    if NICKNAMES.get(v) == c or (3 <= len(v) < len(c) and c.startswith(v)):
        return 1.5
    real = df_v > 0.25 * df_c and df_v >= OWN
    d = _apart(v, c, 2 if min(len(v), len(c)) >= 8 else 1)
    if min(len(v), len(c)) >= 3 and max(len(v), len(c)) >= 4 and d <= (2 if min(len(v), len(c)) >= 8 else 1) and not real:
        return 2.0 * d
    if len(v) < len(c) and v[0] == c[0] and len(v) >= 2 and not real:
        it = iter(c)
        if all(ch in it for ch in v.rstrip("s")) and len(v) <= 0.7 * len(c):
            return 2.5
    if len(v) + 1 >= 5 and v[:-1] and v.endswith("s") and c.startswith(v[:-1]) and len(v) < len(c):
        return 2.5
    return None


def channel(v: list[str], c: list[str], df_v: list[int], df_c: list[int], firm: bool) -> tuple[float, bool] | None:
    """(negative log likelihood, short form?) of the spelling ``v`` of the canonical tokens ``c``, by the best assignment of its tokens."""
    used: set[int] = set()
    cost, short = 0.0, False
    for i in sorted(range(len(v)), key=lambda i: -len(v[i])):
        best = min(((x, j) for j in range(len(c)) if j not in used and (x := token_cost(v[i], c[j], df_v[i], df_c[j])) is not None), default=None)
        if best is None:
            if len(v[i]) == 1 and not firm and len(c) >= 2 and all(len(x) > 1 for x in c) and sum(len(x) > 1 for x in v) >= 2:
                cost += 1.5  # a middle initial that the canonical form lacks
                continue
            return None
        used.add(best[1])
        cost += best[0]
        short |= len(v[i]) == 1 and len(c[best[1]]) > 1
    left = [c[j] for j in range(len(c)) if j not in used]
    if any(len(x) > 1 for x in left):
        short = True
        cost += 3.0 * sum(len(x) > 1 for x in left)
    cost += 1.0 * sum(len(x) == 1 for x in left)
    if not any(len(x) >= 3 for x in v):
        return None
    return cost, short


def _prior(n: int, tokens: list[str], dfs: list[int]) -> float:
    """Log frequency of a spelling in its filing, and of its tokens in all filings: what makes it a likely canonical form."""
    logs = [math.log(x) for t, x in zip(tokens, dfs) if len(t) > 1] or [-5.0]
    return math.log(n) + sum(logs) / len(logs)


@lru_cache(50_000)
def again(text: str) -> tuple[list[str], bool, str]:
    return reduced(text)


def spellings(rows: DataFrame, key: str, filing: str, col: str = "text") -> DataFrame:
    """key, filing, tokens in order, bag (sorted tokens in one string), firm, glued."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            got = [again(t) for t in p["t"]]
            yield pd.DataFrame({"k": p["k"], "f": p["f"], "bag": [" ".join(sorted(g[0])) for g in got], "firm": [g[1] for g in got], "glued": [g[2] for g in got]})

    src = rows.select(F.col(key).cast("long").alias("k"), F.col(filing).alias("f"), plain(F.col(col)).alias("t")).where("k is not null and f is not null and t is not null")
    return src.mapInPandas(run, "k long, f string, bag string, firm boolean, glued string").where("bag <> ''")


def entities(rows: DataFrame, key: str, filing: str, col: str = "text", least: float = -4.6) -> DataFrame:
    """key and entity (id unique over filings) of every record with a filing and at least one letter; one row per key in ``rows``.

    Null texts or filings and texts without letters have no entity. Equal spellings of a filing always share one. Ties of the posterior go to
    the longer form, then to the smaller spelling id. No group is collected: comparison is an equi-join on anchor keys of distinct spellings.
    """
    s = stored(spellings(rows, key, filing, col).withColumn("node", F.xxhash64("f", "bag")), "names")
    nodes = s.groupBy("node", "f", "bag").agg(F.count(F.lit(1)).alias("n"), F.max("firm").alias("firm"), F.min("glued").alias("glued"))
    nodes = stored(nodes, "spelling")
    tok = nodes.select("node", "f", "firm", F.posexplode(F.split("bag", " ")).alias("i", "t"))
    # of each token the filings that hold it, and how many of its spellings have a legal form: that tells words of firms
    known = stored(tok.groupBy("t").agg(F.count_distinct("f").alias("df"), F.avg(F.col("firm").cast("int")).alias("legal"), F.count(F.lit(1)).alias("n")), "tokens")
    told = spread_join(tok, known.select("t", "df", "legal"), ["t"], F.col("node"), counts=known.select("t", "n"))
    told = told.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "df"))), lambda x: x["df"]).alias("dfs"), (F.max("legal") >= 0.3).alias("firmlike"))
    nodes = stored(by_shuffle(nodes).join(by_shuffle(told), "node").withColumn("firm", F.col("firm") | F.col("firmlike")).drop("firmlike"), "spelling")
    pairs = stored(candidates(nodes), "pairs")
    a = nodes.select("node", F.col("bag").alias("v"), F.col("dfs").alias("vs"), F.col("n").alias("vn"), F.col("firm").alias("vfirm"), F.col("glued").alias("vg"))
    b = nodes.select(F.col("node").alias("other"), F.col("bag").alias("c"), F.col("dfs").alias("cs"), F.col("n").alias("cn"), F.col("firm").alias("cfirm"), F.col("glued").alias("cg"))
    both = by_shuffle(by_shuffle(pairs).join(by_shuffle(a), "node")).join(by_shuffle(b), "other")

    def likelihood(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Both directions of each pair."""

        def one(v: list[str], c: list[str], vs: list[int], cs: list[int], vg: str, cg: str, firm: bool) -> tuple[float, bool] | None:
            got = (1.0, False) if vg == cg else channel(v, c, vs, cs, firm)
            if got is None and len(v) != len(c) and abs(len(v) - len(c)) == 1 and len(vg) > 7:
                d = _apart(vg, cg, 1)
                got = (2.0 * d, False) if d <= 1 else None
            return got

        for p in parts:
            out = []
            for r in p.itertuples(index=False):
                v, c, vs, cs, firm = r.v.split(" "), r.c.split(" "), r.vs.tolist(), r.cs.tolist(), r.cfirm or r.vfirm
                there, back = one(v, c, vs, cs, r.vg, r.cg, firm), one(c, v, cs, vs, r.cg, r.vg, firm)
                if there is None and back is None:
                    continue
                vp, cp = (_prior(r.vn, v, vs), len(r.v), -r.node), (_prior(r.cn, c, cs), len(r.c), -r.other)
                # one way only: whatever the priors say; the channel's word, not that of the letters in a row, tells that
                exact = r.vg == r.cg
                one_way = lambda got, x, y, xs, ys: got is not None and not got[1] and not exact and channel(y, x, ys, xs, firm) is None
                if there and (there[1] or cp > vp or one_way(there, v, c, vs, cs)):
                    out.append((r.node, r.other, math.log(r.cn) - there[0], there[1], len(r.c)))
                if back and (back[1] or vp > cp or one_way(back, c, v, cs, vs)):
                    out.append((r.other, r.node, math.log(r.vn) - back[0], back[1], len(r.v)))
            yield pd.DataFrame(out, columns=["node", "other", "posterior", "short", "size"])

    scored = stored(both.mapInPandas(likelihood, "node long, other long, posterior double, short boolean, size int"), "posterior")
    full = scored.where(~F.col("short") & (F.col("posterior") >= least))
    up = stored(full.groupBy("node").agg(F.max(F.struct("posterior", "size", -F.col("other"))).alias("b"), F.max_by("other", F.struct("posterior", "size", -F.col("other"))).alias("up")).select("node", "up"), "up")
    root = stored(rooted(nodes, up), "root")
    # short forms: the roots that fit; a form that is short of itself only (no full form) keeps its own root
    fits = scored.where("short").join(root.withColumnRenamed("node", "other").withColumnRenamed("root", "goal"), "other").where("goal <> node")
    shorts = scored.where("short").select("node").distinct()
    goals = fits.join(shorts.withColumnRenamed("node", "_s"), F.col("goal") == F.col("_s"), "left_anti")  # canonical forms that are not short themselves
    only = goals.groupBy("node").agg(F.count_distinct("goal").alias("g"), F.first("goal").alias("goal")).where("g = 1").select("node", F.col("goal").alias("to"))
    root = root.join(only.withColumnRenamed("node", "_n"), F.col("root") == F.col("_n"), "left").select("node", F.coalesce("to", "root").alias("entity"))
    root = stored(root, "entities")
    return spread_join(s.select("node", "k"), root, ["node"], F.col("k"), counts=nodes.select("node", "n")).select(F.col("k").alias(key), "entity")


def candidates(nodes: DataFrame) -> DataFrame:
    """Pairs node < other of spellings of one filing that the channel may relate; ``nodes`` (stored): node, f, bag, glued.

    Distinct tokens of a filing meet through deletion variants (64-bit hashes). Spellings then meet through exact tokens: each is looked for under
    its tokens and those linked to them, with the initial of another token (or of what that one is linked to, or of the name it is short for);
    spellings of one token are looked for without initial. Names whose blanks slipped meet through the letters in a row.
    """
    parts = F.split("bag", " ")
    anchors = F.when(F.exists(parts, lambda w: F.length(w) >= 3), F.filter(parts, lambda w: F.length(w) >= 3)).otherwise(parts)
    tok = nodes.select("node", "f", F.size(parts).alias("m"), F.explode(F.array_distinct(anchors)).alias("t"))
    each = stored(tok.select("f", "t").distinct().withColumn("tid", F.xxhash64("f", "t")), "filing_tokens")

    def keys(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in parts:
            for at in range(0, len(whole), 4000):
                p = whole.iloc[at : at + 4000]
                words = p["t"].tolist()
                i, h = deletion_hashes(words, p["s"].to_numpy(np.int64).view(np.uint64), letters_lost(words))
                yield pd.DataFrame({"tid": p["tid"].to_numpy(np.int64)[i], "h": h})

    k = by_shuffle(each.select("tid", "t", F.xxhash64("f").alias("s")).mapInPandas(keys, "tid long, h long"))
    # hashes that one token only has are most of them: one pass without strings
    met = k.alias("x").join(k.alias("y"), F.expr("x.h = y.h and x.tid < y.tid")).select(F.col("x.tid").alias("x"), F.col("y.tid").alias("y")).distinct()
    met = by_shuffle(met.join(by_shuffle(each.select(F.col("tid").alias("x"), "f", F.col("t").alias("tx"))), "x")).join(by_shuffle(each.select(F.col("tid").alias("y"), F.col("t").alias("ty"))), "y")
    most = F.when(F.least(F.length("tx"), F.length("ty")) >= 8, 4).otherwise(2)  # a swap of neighbours counts twice here
    met = stored(met.where(F.levenshtein("tx", "ty") <= most).select("f", "tx", "ty"), "token_links")
    links = met.select("f", F.col("tx").alias("t"), F.col("ty").alias("goal")).union(met.select("f", F.col("ty"), F.col("tx"))).union(each.select("f", "t", F.col("t").alias("goal")))
    short = F.element_at(F.create_map(*[F.lit(x) for kv in NICKNAMES.items() for x in kv]), F.col("t"))
    # of each token: what it is looked for under, and the initials it may stand for
    grouped = links.groupBy("f", "t").agg(F.collect_set("goal").alias("goals"))
    first = lambda w: F.substring(w, 1, 1)
    every = nodes.select("node", "f", F.explode(F.array_distinct(parts)).alias("t"))
    of = by_shuffle(every).join(by_shuffle(grouped), ["f", "t"], "left").select("node", "f", "t", F.coalesce("goals", F.array("t")).alias("goals"))
    of = of.withColumn("initials", F.array_distinct(F.concat(F.transform("goals", first), F.when(short.isNotNull(), F.array(first(short))).otherwise(F.array().cast("array<string>")))))
    by = of.groupBy("node", "f").agg(F.collect_list(F.struct("t", "goals", "initials")).alias("ts"))
    anchor = lambda x: (F.length(x["t"]) >= 3) | ~F.exists("ts", lambda y: F.length(y["t"]) >= 3)
    others = lambda x: F.array_distinct(F.flatten(F.transform(F.filter("ts", lambda y: y["t"] != x["t"]), lambda y: y["initials"])))
    own = lambda x: F.array_distinct(F.transform(F.filter("ts", lambda y: y["t"] != x["t"]), lambda y: first(y["t"])))
    key = lambda w, c: F.xxhash64("f", w, c)
    none = F.array(F.lit(""))
    one = F.size("ts") == 1
    asked = F.flatten(F.transform(F.filter("ts", anchor), lambda x: F.flatten(F.transform(x["goals"], lambda g: F.transform(F.when(one, none).otherwise(others(x)), lambda c: key(g, c))))))
    shown = F.flatten(F.transform(F.filter("ts", anchor), lambda x: F.transform(F.concat(own(x), none), lambda c: key(x["t"], c))))
    ask, show = by.select("node", F.explode(F.array_distinct(asked)).alias("h")), by.select(F.col("node").alias("other"), F.explode(F.array_distinct(shown)).alias("h"))
    found = by_shuffle(ask).join(by_shuffle(show), "h").where("node <> other").select(F.least("node", "other").alias("node"), F.greatest("node", "other").alias("other"))

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in parts:
            for at in range(0, len(whole), 4000):
                p = whole.iloc[at : at + 4000]
                words = p["glued"].tolist()
                i, h = deletion_hashes(words, p["s"].to_numpy(np.int64).view(np.uint64), np.ones(len(words), np.int64))
                yield pd.DataFrame({"node": p["node"].to_numpy(np.int64)[i], "m": p["m"].to_numpy(np.int32)[i], "h": h})

    g = by_shuffle(nodes.where(F.length("glued") > 7).select("node", "glued", F.size(parts).alias("m"), F.xxhash64("f").alias("s")).mapInPandas(rows, "node long, m int, h long"))
    slipped = g.alias("x").join(g.alias("y"), F.expr("x.h = y.h and x.m < y.m")).select(F.least("x.node", "y.node").alias("node"), F.greatest("x.node", "y.node").alias("other"))
    same = by_shuffle(nodes.select("node", F.xxhash64("f", "glued").alias("h")))  # the same letters in a row
    same = same.alias("x").join(same.alias("y"), F.expr("x.h = y.h and x.node < y.node")).select(F.col("x.node").alias("node"), F.col("y.node").alias("other"))
    return found.union(slipped).union(same).distinct()


def same_entity(rows: DataFrame, key: str, filing: str, col: str = "text", block: int = 1000) -> DataFrame:
    """Pairs id_a < id_b of records of one filing that name the same person or firm."""
    one = latest(rows.select(key, filing, col), key, filing, col)
    return pairs_in_classes(stored(entities(one, key, filing, col), "entity"), "entity", key, block=block)
