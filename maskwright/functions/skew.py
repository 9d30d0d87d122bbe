"""Joins and running sums in which no task holds a whole key, however many rows one key has. Null keys are keys like others."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .barrier import stored

#: A key is hot if it holds more than one in so many of all rows, so at most so many keys are hot and broadcasting them is bounded.
SHARES = 10_000
#: Below so many rows no key is split, whatever its share.
LEAST = 10_000


def same(pairs: list[tuple[Column, Column]]) -> Column:
    """Null-safe equality of each pair."""
    return reduce(lambda x, y: x & y, [a.eqNullSafe(b) for a, b in pairs])


def safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on equal columns in which null equals null; the key columns are those of the left side."""
    r = right.withColumnsRenamed({c: f"__r_{c}" for c in on})
    out = left.join(r, same([(left[c], r[f"__r_{c}"]) for c in on]), how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"__r_{c}" for c in on])


def hot_keys(counts: DataFrame, on: list[str], n: str, least: int = LEAST) -> DataFrame:
    """``on`` and ``__k``, the number of parts into which each hot key is split; ``counts`` has one row per key with its rows in ``n``.

    At most :data:`SHARES` rows, so it may be broadcast whatever the size of the data.
    """
    total = counts.agg(F.sum(n).alias("__t"))
    share = F.greatest(F.col("__t") / F.lit(SHARES), F.lit(least))
    hot = counts.crossJoin(F.broadcast(total)).where(F.col(n) > share)  # one row on the right
    return hot.select(*on, F.least(F.ceil(F.col(n) / share), F.lit(1000)).cast("int").alias("__k"))


def spread_join(left: DataFrame, right: DataFrame, on: list[str], by: Column, how: str = "inner", counts: DataFrame | None = None, least: int = LEAST, hot_on: list[str] | None = None) -> DataFrame:
    """``left`` joined with ``right``, where single keys may hold a large share of the rows of ``left``.

    Rows of hot keys are split by a hash of ``by``, and the rows of ``right`` with these keys are copied to each part. ``counts`` (key, n) are
    the rows of ``left`` by key, where they are known; they may be those of a part of the key, ``hot_on``, as a bound for all keys that share
    it. ``how``: inner, left, left_semi or left_anti.
    """
    key = hot_on or on
    counts = left.groupBy(*key).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts
    hot = F.broadcast(hot_keys(counts, key, "n", least))
    a = safe_join(left, hot, key, "left").withColumn("__s", F.coalesce(F.pmod(F.xxhash64(by), F.col("__k")).cast("int"), F.lit(0))).drop("__k")
    b = safe_join(right, hot, key, "left").withColumn("__s", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__k"), F.lit(1)) - 1))).drop("__k")
    return safe_join(a, b, [*on, "__s"], how).drop("__s")


def running(df: DataFrame, group: list[str], order: list[str], value: Column, out: str, how: str = "sum") -> DataFrame:
    """``df`` with ``out``: the sum (or the largest) of ``value`` over the rows of the same group before this one; 0 (or null) at the first.

    Rows are cut by ranges of (group, order), so a group that is most of the table lies in many tasks; what each range adds is summed over the
    ranges of a group, of which there are no more than partitions. ``order`` must tell any two rows of a group apart where that matters.
    """
    p = stored(df.withColumn("__v", value).repartitionByRange(*group, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    agg = F.sum if how == "sum" else F.max
    inside = Window.partitionBy(*group, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = p.groupBy(*group, "__part").agg(agg("__v").alias("__all"))
    before = totals.withColumn("__before", agg("__all").over(earlier)).drop("__all")
    j = safe_join(p.withColumn("__in", agg("__v").over(inside)), before, [*group, "__part"])
    both = F.coalesce("__in", F.lit(0)) + F.coalesce("__before", F.lit(0)) if how == "sum" else F.greatest("__in", "__before")
    return j.withColumn(out, both).drop("__v", "__part", "__in", "__before")
