"""Visually identical text with different characters.

Values are mapped sign by sign to the common sign of the same look (in the JVM), then grouped in SQL under the accent- and case-sensitive
collation UNICODE, which also equates composed and decomposed accents. The canonical member of a class is the value that needs the fewest
replacements, then the most frequent, then the smallest; it is joined back.

Only digests of the texts are shuffled at first: of a text the hash of its ASCII signs after mapping, with accents off. Texts that the collation
equates have the same, so only where several texts share it (a few in a hundred) do the texts themselves meet.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.skew import spread_join
from .common import checked_broadcast, composed, pairs_in_classes, plain, stored

#: Signs whose canonical decomposition begins with an ASCII sign, and that sign.
_BASE = {c: d for c in map(chr, range(0x80, 0x10000)) if not 0xD800 <= ord(c) < 0xE000 and (d := unicodedata.normalize("NFD", c)[0]) < "\x7f"}


def rough(text: Column) -> Column:
    """Hash that texts of one look share: of the printable ASCII signs, tabs and line ends that are left when look-alikes are mapped and accents taken off."""
    out = F.regexp_replace(F.translate(plain(text), "".join(_BASE), "".join(_BASE.values())), r"[^\t\n\r\x20-\x7e]", "")
    return F.xxhash64(F.when(text.rlike(r"[^\t\n\r\x20-\x7e]"), out).otherwise(text))


def _digests(df: DataFrame, col: str, *keep: str) -> DataFrame:
    """``keep``, _k (what texts of one look share, with the columns ``keep`` named _g), _t (digest of the text) of each row with a text."""
    t = F.col(col)
    group = [F.col("_g")] if "_g" in keep else []
    return df.where(t.isNotNull()).select(*keep, F.xxhash64(rough(t), *group).alias("_k"), F.unhex(F.md5(t)).alias("_t"))


def _classes(texts: DataFrame) -> DataFrame:
    """_k, _t, look (class id), canonical of distinct texts (_k, _t, text, copies) by collation; classes with one member are left out."""
    mapped = texts.withColumn("mapped", plain(F.col("text")))
    odd = F.when(F.col("mapped") == F.col("text"), 0).otherwise(1 + F.abs(F.length("text") - F.length("mapped")))
    mapped = stored(mapped.withColumn("odd", odd + F.when(composed(F.col("mapped")) != F.col("mapped"), 1).otherwise(0)), "mapped")
    return mapped.sparkSession.sql(
        """
        WITH looks AS (
            SELECT _k, mapped, min(struct(odd, -copies AS fewer, text)) AS best, count(*) AS n FROM {mapped} GROUP BY _k, mapped
        ), classes AS (
            SELECT _k AS k, collate(mapped, 'UNICODE') AS same, min(best).text AS canonical FROM looks GROUP BY _k, collate(mapped, 'UNICODE') HAVING sum(n) > 1
        ), members AS (
            SELECT _k, mapped, canonical FROM looks JOIN classes ON _k = k AND collate(mapped, 'UNICODE') = same
        )
        SELECT _k, _t, sha2(concat(_k, ' ', canonical), 256) AS look, canonical FROM {mapped} JOIN members USING (_k, mapped)
        """,
        mapped=mapped,
    )


def _several(counted: DataFrame) -> DataFrame:
    """Of (_k, _t, copies) those whose _k several texts share."""
    groups = counted.groupBy("_k").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1").select("_k")
    return stored(counted.join(groups, "_k", "left_semi"), "several")


def _texts(df: DataFrame, col: str, wanted: DataFrame, *keep: str) -> DataFrame:
    """(_k, _t, text, copies) of the texts in ``wanted`` (_k, _t, copies)."""
    src = df.where(F.col(col).isNotNull()).select(*keep, F.col(col).alias("text"))
    d = _digests(src, "text", "text", *keep).drop(*keep)
    return d.join(checked_broadcast(wanted), ["_k", "_t"]).groupBy("_k", "_t", "text").agg(F.max("copies").alias("copies"))


def canonicalise(df: DataFrame, col: str = "text", out: str = "canonical") -> DataFrame:
    """``df`` with the canonical text of the look of ``col`` in ``out``; every row is kept, a null text has a null canonical text.

    Texts that no other text looks like are their own canonical text. The empty text is in one class with texts of invisible signs only. Copies
    are counted before anything is joined, and a text that is a large share of all rows is split.
    """
    counted = stored(_digests(df, col).groupBy("_k", "_t").agg(F.count(F.lit(1)).alias("copies")), "counted")
    wanted = _several(counted)
    look = stored(_classes(_texts(df, col, wanted)).select(F.col("_t").alias("_x"), F.col("canonical").alias("_c")), "looks")
    own = df.withColumn("_x", F.unhex(F.md5(F.col(col))))
    found = own.join(F.broadcast(look), "_x", "left") if look.limit(20_001).count() <= 20_000 else spread_join(own, look, ["_x"], F.xxhash64(*df.columns), "left", counted.select(F.col("_t").alias("_x"), F.col("copies").alias("n")))
    return found.withColumn(out, F.coalesce("_c", F.col(col))).drop("_x", "_c")


def look_pairs(records: DataFrame, key: str, col: str = "text", within: str | None = None, block: int = 1000) -> DataFrame:
    """Pairs id_a < id_b of records that look the same and differ in their characters; with ``within`` (a column) only of records that are equal in it.

    A key that comes twice (in one value of ``within``) counts once, by the text with the smallest digest. Null texts, and nulls in ``within``,
    pair with none. Classes with one spelling give no rows.
    """
    src = records.select(key, (F.col(within) if within else F.lit("")).alias("_g"), F.col(col).alias("_text")).where(F.col(key).isNotNull() & F.col("_g").isNotNull())
    r = _digests(src, "_text", key, "_g").groupBy("_g", key).agg(F.min(F.struct("_t", "_k")).alias("_b")).select("_g", key, "_b._k", "_b._t")
    r = stored(r, "looks")
    wanted = _several(r.groupBy("_k", "_t").agg(F.count(F.lit(1)).alias("copies")))
    values = stored(_classes(_texts(src, "_text", wanted, "_g")).select("_k", "_t", "look"), "classes")
    members = spread_join(r, values, ["_k", "_t"], F.col(key), counts=wanted.withColumnRenamed("copies", "n"))
    members = stored(members.select("look", key, F.hex("_t").alias("spelling"), "_g"), "members")
    pairs = pairs_in_classes(members, "look", key, "spelling", block, ("_g",))
    return pairs.withColumnRenamed("_g", within) if within else pairs.drop("_g")
