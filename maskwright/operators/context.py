"""Structural context of blocks, and the stratified sample of blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.barrier import stored
from ..functions.skew import running, safe_join

BODY_CONTEXT = 220
MARKER = r"(?iU)@|\btel\b|\btelephone\b|\bphone\b|\bfax\b|contact person|e-?mail|registered office|\b\d{3}[\s-]?\d{3}\b"


def neighbour_context(blocks: DataFrame, doc: str = "doc_id", order: str = "block_id") -> DataFrame:
    """Adds ``context``: the block before and the block after, non-empty ones joined by " | ", cut at 220 signs.

    Blocks are numbered by ranges and meet their neighbours by equality on (document, number), so a document may be most of the table.
    Blocks with the same order stand in the order of their texts.
    """
    n = stored(running(blocks, [doc], [order, "text"], F.lit(1), "_n"), "numbered")
    shown = F.substring(F.nullif(F.trim("text"), F.lit("")), 1, BODY_CONTEXT)
    side = lambda step, name: n.select(doc, (F.col("_n") + step).alias("_n"), shown.alias(name))
    j = safe_join(safe_join(n, side(1, "_last"), [doc, "_n"], "left"), side(-1, "_next"), [doc, "_n"], "left")
    return j.withColumn("context", F.substring(F.concat_ws(" | ", "_last", "_next"), 1, BODY_CONTEXT)).drop("_n", "_last", "_next")


def stratum(text: Column) -> Column:
    return F.when(text.rlike(MARKER), "dense").otherwise("prose")


def stratified_sample(blocks: DataFrame, n: int = 18, low: int = 60, high: int = 700, seed: str = "7") -> DataFrame:
    """``n`` distinct texts of each stratum, of 60 to 700 signs, the first by a keyed digest: the same on every run. Adds ``stratum``."""
    t = blocks.where(F.length("text").between(low, high)).select("text").distinct().withColumn("stratum", stratum(F.col("text")))
    w = Window.partitionBy("stratum").orderBy(F.md5(F.concat(F.lit(seed), F.col("text"))), "text")
    return t.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
