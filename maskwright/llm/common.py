"""Helpers shared by the corpus operators: lineage cuts, skew-safe joins, look-alike mapping."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.barrier import shared_dir, stored, table_path
from ..functions.skew import spread_join

__all__ = ["shared_dir", "stored", "table_path"]

# Signs that are invisible when shown.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩︀︁︎️﻿"
# Blanks that look like a common blank.
BLANKS = "               　"
# Cyrillic, Greek and Armenian letters and the Latin letters they look like, for Python workers; in the JVM :func:`look_alikes` adds all others.
LOOK_ALIKE = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "ν": "v", "ο": "o", "ϲ": "c", "ϳ": "j", "ɡ": "g", "ı": "i", "օ": "o", "ս": "u", "ց": "g", "հ": "h", "Օ": "O", "Ս": "U",
    "‐": "-", "‑": "-",
}
# Ligatures and the letters they show.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "Ĳ": "IJ", "ĳ": "ij"}

_ONE = {**LOOK_ALIKE, **{b: " " for b in BLANKS}, **{chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}}
_PY = {**{ord(k): v for k, v in _ONE.items()}, **{ord(c): None for c in INVISIBLE}, **{ord(k): v for k, v in LIGATURES.items()}}
#: Letters with one accent that some keyboards type as letter and combining accent.
_COMPOSED = {unicodedata.normalize("NFD", c): c for c in map(chr, range(0xC0, 0x250)) if len(unicodedata.normalize("NFD", c)) == 2}


def plain_py(text: str) -> str:
    """Python twin of :func:`plain`."""
    return unicodedata.normalize("NFC", text.translate(_PY))


_tables: dict[int, dict[str, str]] = {}


def look_alikes(spark: SparkSession) -> dict[str, str]:
    """Letters of all scripts and the ASCII letter of the same look and case: the confusables of the Unicode Consortium (UTS 39), from the ICU library of the JVM.

    Letters whose look is shared by several ASCII signs (I, l, 1) are taken by their case; those that are shown bold, raised or otherwise in
    another style are left out, as they look different. The fixed letters above go before.
    """
    if not _tables:
        checker = getattr(spark._jvm.com.ibm.icu.text, "SpoofChecker$Builder")().build()
        signs = [c for c in map(chr, range(0x21, 0x20000)) if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nl"]
        looks = dict(zip(signs, checker.getSkeleton("\n".join(signs)).split("\n")))
        shown: dict[str, list[str]] = {}
        for c in (x for x in signs if ord(x) < 128):
            shown.setdefault(looks[c], []).append(c)
        out = {}
        for c in (x for x in signs if ord(x) > 127):
            kind, style = unicodedata.category(c), unicodedata.decomposition(c)
            fits = [x for x in shown.get(looks[c], ()) if kind not in ("Lu", "Ll") or x.isupper() == (kind == "Lu")]
            if len(fits) == 1 and not style.startswith(("<font", "<super", "<sub", "<circle", "<square")):
                out[c] = fits[0]
        _tables[0] = {**out, **_ONE}
    return _tables[0]


def plain(text: Column) -> Column:
    """Text with every sign replaced by the common one of the same look; letters and combining accents are left as they are.

    Null stays null. Runs in the JVM: one ``translate`` (which also drops the invisible signs), and ligatures only where there are any.
    """
    table = look_alikes(SparkSession.active())
    out = F.translate(text, "".join(table) + INVISIBLE, "".join(table.values()))
    spelt = out
    for k, v in LIGATURES.items():
        spelt = F.replace(spelt, F.lit(k), F.lit(v))
    return F.when(~text.rlike(r"[^\x00-\x7f]"), text).when(out.rlike("[" + "".join(LIGATURES) + "]"), spelt).otherwise(out)


def composed(text: Column) -> Column:
    """Joins a letter and a following combining accent where one sign for both exists (Latin)."""
    out = text
    for k, v in _COMPOSED.items():
        out = F.replace(out, F.lit(k), F.lit(v))
    return F.when(text.rlike("[\\u0300-\\u036f]"), out).otherwise(text)


def checked_broadcast(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``df`` (stored, of rows of under some 100 bytes) to be broadcast if it has at most so many rows; else it is joined by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def first_distinct(df: DataFrame, n: int, *cols: str) -> list:
    """The ``n`` distinct rows of ``cols`` with the smallest keyed hash, collected in that order: the same on every run.

    Hashes are made distinct first, so the texts themselves are shuffled only for the rows taken, however often one is repeated.
    """
    h = df.select(*cols).withColumn("_h", F.xxhash64(*cols))
    top = h.select("_h").distinct().orderBy("_h").limit(n).agg(F.max("_h").alias("m")).first()["m"]
    if top is None:
        return []
    return h.where(F.col("_h") <= top).distinct().orderBy("_h", *cols).limit(n).drop("_h").collect()


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df``, never to be broadcast: where rows come from Python or strings repeat, Spark takes a table for far smaller than it is in the driver's memory."""
    return df.hint("merge")


def rooted(nodes: DataFrame, up: DataFrame) -> DataFrame:
    """node and root: where the links (node, up; at most one a node) lead from each of ``nodes``, by pointer doubling until nothing moves.

    The nodes of a cycle, and what leads into it, have the smallest node of the cycle as root. No pass is broadcast: there are many, and the driver
    frees what it collected only when it comes to clear its heap.
    """
    g = stored(up.select("node", F.col("up").alias("goal"), F.col("node").alias("low"), F.lit(True).alias("open")), "links")
    left, before, steps = g.count(), -1, 1
    while left and not (left == before and steps >= left):
        h = g.select(F.col("node").alias("_n"), F.col("goal").alias("_g"), F.col("low").alias("_l"))
        moved = by_shuffle(g).join(by_shuffle(h), F.col("goal") == F.col("_n"), "left")
        g = stored(moved.select("node", F.coalesce("_g", "goal").alias("goal"), F.least("low", "_l").alias("low"), F.col("_n").isNotNull().alias("open")), "links")
        left, before, steps = g.where("open").count(), left, steps * 2
    if left:
        low = g.where("open").select(F.col("node").alias("_n"), F.col("low").alias("_l"))
        g = g.join(low, F.col("goal") == F.col("_n"), "left").select("node", F.coalesce("_l", "goal").alias("goal"))
    return by_shuffle(nodes.select("node")).join(by_shuffle(g.select("node", "goal")), "node", "left").select("node", F.coalesce("goal", "node").alias("root"))


def latest(df: DataFrame, key: str, *by: str) -> DataFrame:
    """One row per key, the smallest by the columns named; rows with a null key are left out."""
    rest = [c for c in df.columns if c != key]
    best = F.min(F.struct(*by, *[c for c in rest if c not in by])).alias("_best")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, *[F.col(f"_best.{c}").alias(c) for c in rest])


def pairs_in_classes(members: DataFrame, cls: str, key: str, differ: str | None = None, block: int = 1000, carry: tuple[str, ...] = ()) -> DataFrame:
    """All pairs (id_a < id_b) of members of one class; with ``differ`` only pairs that differ in that column.

    ``members`` has one row per key. Large classes are cut into blocks of about ``block`` keys, and each two blocks of a class meet in
    a join group of their own: a row is copied once per block of its class, the output has ``block`` times as many rows. Classes with over a
    ten thousandth of all rows are split before the first shuffle, so no task holds one. Rows with a null class pair with none. Columns in
    ``carry`` are equal within a class and come along.
    """
    m = members.where(F.col(cls).isNotNull()).select(cls, key, *([differ] if differ else []), *carry)
    size = m.groupBy(cls).agg(F.count(F.lit(1)).alias("n"), *([F.min(differ).alias("_lo"), F.max(differ).alias("_hi")] if differ else []))
    some = size.where((F.col("n") > 1) & (F.col("_lo") != F.col("_hi") if differ else F.lit(True)))
    m = spread_join(m, some.select(cls, F.ceil(F.col("n") / F.lit(block)).cast("int").alias("_k")), [cls], F.col(key), counts=size.select(cls, "n"))
    m = m.withColumn("_b", F.pmod(F.xxhash64(key), F.col("_k")).cast("int"))
    m = m.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    keep = [cls, key] + ([differ] if differ else [])
    # a row of block b stands on the left of (b, o) for o >= b and on the right of (o, b) for o <= b
    left = m.where("_o >= _b").select(*[F.col(c).alias(f"l_{c}") for c in keep], *carry, F.col("_b").alias("lb"), F.col("_o").alias("lo"))
    right = m.where("_o <= _b").select(*[F.col(c).alias(f"r_{c}") for c in keep], F.col("_o").alias("rb"), F.col("_b").alias("ro"))
    on = (F.col(f"l_{cls}") == F.col(f"r_{cls}")) & (F.col("lb") == F.col("rb")) & (F.col("lo") == F.col("ro"))
    on = on & ((F.col("lb") != F.col("lo")) | (F.col(f"l_{key}") < F.col(f"r_{key}")))
    if differ:
        on = on & (F.col(f"l_{differ}") != F.col(f"r_{differ}"))
    j = left.join(right, on)
    a, b = F.col(f"l_{key}"), F.col(f"r_{key}")
    return j.select(*carry, F.least(a, b).alias("id_a"), F.greatest(a, b).alias("id_b"))
