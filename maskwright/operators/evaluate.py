"""Detection quality: greedy one-to-one matching of predicted and labelled spans, and its measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.skew import running

THRESHOLD = 0.5


def overlap_ratio(gold_start: Column, gold_end: Column, start: Column, end: Column) -> Column:
    """Share of the labelled span that the other covers; 0 for an empty labelled span."""
    size = gold_end - gold_start
    both = F.greatest(F.lit(0), F.least(gold_end, end) - F.greatest(gold_start, start))
    return F.when(size > 0, both / size).otherwise(0.0)


def matched(gold: DataFrame, predicted: DataFrame, doc: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """(doc, entity_type, tp, fp, fn) per document and type: labelled spans in order each take the first free prediction of their type that covers enough.

    Both sides have doc, entity_type, start, end. Only spans that overlap can match, so each chain of overlapping spans of a document and type is
    folded alone; chains are told by running maxima of ends, and no task holds a document. Null documents and types are values like others.
    """
    key = [doc, "entity_type"]
    side = lambda df, g: df.select(*key, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.lit(g).alias("gold"))
    every = side(gold, True).unionByName(side(predicted, False))
    reach = running(every, key, ["start", "end", "gold"], F.col("end"), "reach", "max")
    fresh = reach.withColumn("fresh", F.when(F.col("start") < F.col("reach"), 0).otherwise(1)).drop("reach")
    chain = running(fresh, key, ["start", "end", "gold"], F.col("fresh"), "before").withColumn("island", F.col("before") + F.col("fresh"))
    both = F.struct("start", "end")
    j = chain.groupBy(*key, "island").agg(F.array_sort(F.collect_list(F.when(F.col("gold"), both))).alias("g"), F.array_sort(F.collect_list(F.when(~F.col("gold"), both))).alias("p"))

    def take(used: Column, x: Column) -> Column:
        free = F.filter(F.sequence(F.lit(1), F.greatest(F.size("p"), F.lit(1))), lambda i: (i <= F.size("p")) & ~F.array_contains(used, i) & (overlap_ratio(x["start"], x["end"], F.try_element_at(F.col("p"), i)["start"], F.try_element_at(F.col("p"), i)["end"]) >= threshold))
        return F.when(F.size(free) > 0, F.concat(used, F.array(F.element_at(free, 1)))).otherwise(used)

    tp = F.size(F.aggregate("g", F.array().cast("array<int>"), take))
    n = j.select(*key, tp.alias("tp"), F.size("p").alias("np"), F.size("g").alias("ng")).groupBy(*key).agg(F.sum("tp").alias("tp"), F.sum("np").alias("np"), F.sum("ng").alias("ng"))
    return n.select(*key, "tp", (F.col("np") - F.col("tp")).alias("fp"), (F.col("ng") - F.col("tp")).alias("fn"))


def measures(tp: Column, fp: Column, fn: Column, per_group: bool = True) -> list[Column]:
    """precision, recall, f1, accuracy. Without predictions precision is 1 if nothing was missed else 0, without labels recall is 1 if nothing was invented else 0 (``per_group``), or both are 0."""
    empty_p = F.when(fn == 0, 1.0).otherwise(0.0) if per_group else F.lit(0.0)
    empty_r = F.when(fp == 0, 1.0).otherwise(0.0) if per_group else F.lit(0.0)
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(empty_p)
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(empty_r)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    acc = F.when(tp + fp + fn > 0, tp / (tp + fp + fn)).otherwise(0.0)
    return [F.round(c, 6).alias(n) for c, n in ((p, "precision"), (r, "recall"), (f1, "f1"), (acc, "accuracy"))]


def scores(counts: DataFrame, by: list[str]) -> DataFrame:
    """Measures of each value of each column in ``by`` and in total (grouping sets); other columns of a row are null."""
    sets = [[c] for c in by] + [[]]
    agg = counts.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in by]).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return agg.select(*by, "tp", "fp", "fn", *measures(F.col("tp"), F.col("fp"), F.col("fn")))


def located(labels: DataFrame, blocks: DataFrame, key: str = "id") -> DataFrame:
    """Offsets of labelled values: the n-th label of a value in a block gets its n-th occurrence. Labels without one are left out.

    ``labels``: key, seq (order), entity_type, value; ``blocks``: key, text.
    """
    n = labels.withColumn("n", F.row_number().over(Window.partitionBy(key, "value").orderBy("seq")))
    found = n.join(blocks.select(key, "text"), key).where("value <> ''")
    before = F.expr("substring_index(text, value, n)")
    ok = F.expr("size(split(text, concat('\\\\Q', value, '\\\\E'))) > n")
    return found.where(ok).select(key, "entity_type", "value", F.length(before).cast("int").alias("start"), (F.length(before) + F.length("value")).cast("int").alias("end"))


def label_counts(labels: DataFrame, by: list[str]) -> DataFrame:
    """Number of labelled spans by the columns named."""
    return labels.groupBy(*by).agg(F.count(F.lit(1)).alias("labels"))


def built(pieces: DataFrame, doc: str = "doc_id", order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(texts, labelled spans) of documents put together of pieces (doc, seq, text, entity_type; null type: plain text).

    A piece stands where the pieces before it end, so offsets are right by construction.
    """
    at = running(pieces.withColumn("text", F.coalesce("text", F.lit(""))), [doc], [order], F.length("text"), "start")
    texts = at.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", F.col(order).alias("o"), "text"))), lambda x: x["text"]), "").alias("text"))
    spans = at.where("entity_type is not null").select(doc, "entity_type", "text", F.col("start").cast("int").alias("start"), (F.col("start") + F.length("text")).cast("int").alias("end"))
    return texts, spans
