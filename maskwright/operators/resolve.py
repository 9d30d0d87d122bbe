"""Overlap resolution inside a block as one array fold: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import let, no_spans
from ..functions.vocab import SPANS, priority, splittable

MIN_FRAGMENT = 10


def ordered(spans: Column) -> Column:
    """Spans in the order in which they claim characters: priority, confidence, length, start, type (the last makes the order total)."""
    keyed = F.transform(
        spans,
        lambda s: F.struct(priority(s["entity_type"]).alias("p"), (-s["confidence"]).alias("c"), (s["start"] - s["end"]).alias("l"), s["start"].alias("b"), s["entity_type"].alias("t"), s["source"].alias("o"), s.alias("s")),
    )
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def _overlaps(a: Column, b: Column) -> Column:
    return (a["end"] > b["start"]) & (a["start"] < b["end"])


def fragments(s: Column, blockers: Column) -> Column:
    """What of a span the blockers leave: pieces of at least ten signs (without edge punctuation) with a letter, type and confidence kept."""
    cuts = F.array_sort(F.transform(blockers, lambda b: F.struct(b["start"].alias("b"), b["end"].alias("e"))))
    state = F.aggregate(
        cuts,
        F.struct(s["start"].alias("at"), F.array().cast("array<struct<b: int, e: int>>").alias("gaps")),
        lambda acc, c: F.struct(
            F.greatest(acc["at"], c["e"]).alias("at"),
            F.when(c["b"] > acc["at"], F.concat(acc["gaps"], F.array(F.struct(acc["at"].alias("b"), F.least(c["b"], s["end"]).alias("e"))))).otherwise(acc["gaps"]).alias("gaps"),
        ),
    )
    gaps = let(state, lambda z: F.when(z["at"] < s["end"], F.concat(z["gaps"], F.array(F.struct(z["at"].alias("b"), s["end"].alias("e"))))).otherwise(z["gaps"]))
    cut = F.transform(
        gaps,
        lambda g: F.struct(
            s["entity_type"].alias("entity_type"), F.substring(s["text"], g["b"] - s["start"] + 1, g["e"] - g["b"]).alias("text"), g["b"].alias("start"), g["e"].alias("end"), s["confidence"].alias("confidence"), s["source"].alias("source")
        ),
    )
    return F.filter(cut, lambda f: (F.length(F.regexp_replace(f["text"], r"^[ ,.;:\-()]+|[ ,.;:\-()]+$", "")) >= MIN_FRAGMENT) & f["text"].rlike(r"\p{L}"))


def resolve(spans: Column) -> Column:
    """Disjoint spans in order of start. A losing ADDRESS is cut around winners of other types; other losers are dropped whole."""

    def step(kept: Column, s: Column) -> Column:
        def with_hits(hits: Column) -> Column:
            cut = splittable(s["entity_type"]) & ~F.exists(hits, lambda k: k["entity_type"] == s["entity_type"])
            return F.when(F.size(hits) == 0, F.concat(kept, F.array(s))).when(cut, F.concat(kept, fragments(s, hits))).otherwise(kept)

        return let(F.filter(kept, lambda k: _overlaps(k, s)), with_hits).cast(SPANS)

    def fold(every: Column) -> Column:
        kept = F.aggregate(ordered(every), no_spans(), step)
        by_start = F.array_sort(F.transform(kept, lambda s: F.struct(s["start"].alias("b"), s.alias("s"))))
        return F.when(F.size(every) <= 1, every).otherwise(F.transform(by_start, lambda k: k["s"]))

    return let(spans, fold).cast(SPANS)


def islands(spans: DataFrame, block: list[str]) -> DataFrame:
    """Adds ``island``: spans of one block that overlap in a chain share it. Spans of different islands never conflict, so each may be folded alone."""
    w = Window.partitionBy(*block).orderBy("start", "end", "entity_type")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("start") >= F.coalesce(reach, F.lit(-1)), 1).otherwise(0)
    return spans.withColumn("_new", fresh).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def resolve_rows(spans: DataFrame, block: list[str]) -> DataFrame:
    """Resolution of exploded spans: islands by window, one fold per island. For blocks with very many spans; rows with null offsets are dropped."""
    cols = ["entity_type", "text", "start", "end", "confidence", "source"]
    rows = islands(spans.where("start is not null and end is not null"), block)
    folded = rows.groupBy(*block, "island").agg(F.collect_list(F.struct(*cols)).cast(SPANS).alias("s"))
    return folded.select(*block, F.inline(resolve(F.col("s"))))


def reconcile(spans: Column) -> Column:
    """PERSON and ORG spans of one block with the same text get the type most of them have; on a tie the type met first."""
    def winner(names: Column, s: Column) -> Column:
        same = F.filter(names, lambda n: F.lower(F.trim(n["text"])) == F.lower(F.trim(s["text"])))
        vote = lambda z: let(F.size(F.filter(z, lambda n: n["entity_type"] == "PERSON")) * 2 - F.size(z), lambda d: F.when(d > 0, "PERSON").when(d < 0, "ORG").otherwise(F.element_at(z, 1)["entity_type"]))
        return let(same, vote)

    def voted(every: Column) -> Column:
        return let(
            F.filter(every, lambda s: s["entity_type"].isin("PERSON", "ORG")),
            lambda names: F.when(F.size(names) < 2, every).otherwise(F.transform(every, lambda s: F.when(s["entity_type"].isin("PERSON", "ORG"), s.withField("entity_type", winner(names, s))).otherwise(s))),
        )

    return let(spans, voted).cast(SPANS)
