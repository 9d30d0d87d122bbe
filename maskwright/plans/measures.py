"""Detection quality on labelled sets: readers of samples, labels and whole texts, the measure by type and stratum, and its report."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.barrier import stored
from ..functions.skew import safe_join
from ..functions.vocab import DetectionConfig
from ..operators import evaluate
from . import pipeline


def read_json_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON file that is an array of objects, or an object of which one field is such an array; in the file's order as ``seq``."""
    t = spark.read.option("multiLine", "true").json(path)
    inner = [f.name for f in t.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    if len(inner) == 1:
        return t.select(F.posexplode(inner[0]).alias("seq", "r")).select("seq", "r.*")
    return t.withColumn("seq", F.monotonically_increasing_id())


def located_labels(blocks: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, entity_type, start, end of labels (id, type, value, seq) in blocks (id, text)."""
    got = evaluate.located(labels.select("id", "seq", F.col("type").alias("entity_type"), "value"), blocks)
    return got.select(F.col("id").cast("string").alias("doc_id"), "entity_type", "start", "end")


def measured(blocks: DataFrame, gold: DataFrame, config: DetectionConfig | None = None, aliases: bool = False) -> tuple[DataFrame, DataFrame]:
    """(scores in total, by entity_type and by stratum, with doc counts; predicted spans) of blocks (doc_id, stratum, context, text) against labelled spans.

    Each block is a document of its own, with what the sweep for its own names finds.
    """
    found = stored(pipeline.detect(blocks.withColumn("block_id", F.lit(0).cast("long")), config).withColumn(pipeline.ROW, F.monotonically_increasing_id()), "measured")
    swept, _ = pipeline.refine(found, aliases=aliases)
    predicted = stored(pipeline.spans_of(swept).select("doc_id", "entity_type", "start", "end", "text"), "predicted")
    counts = safe_join(evaluate.matched(gold, predicted), blocks.select("doc_id", "stratum"), ["doc_id"], "left")
    return evaluate.scores(counts, ["entity_type", "stratum"]).orderBy(F.col("entity_type").asc_nulls_last(), F.col("stratum").asc_nulls_last()), predicted


def report(scores: DataFrame, gold: DataFrame) -> dict:
    """Totals, measures by type and by stratum in order, and the number of labels by type."""
    pick = lambda r: {k: r[k] for k in ("tp", "fp", "fn", "precision", "recall", "f1", "accuracy")}
    out: dict = {"overlap_threshold": evaluate.THRESHOLD, "totals": {}, "per_type": {}, "per_stratum": {}}
    for r in scores.collect():  # a row for each type and stratum
        if r["entity_type"] is not None:
            out["per_type"][r["entity_type"]] = pick(r)
        elif r["stratum"] is not None:
            out["per_stratum"][r["stratum"]] = pick(r)
        else:
            out["totals"] = pick(r)
    out["labels"] = {r["entity_type"]: r["labels"] for r in evaluate.label_counts(gold, ["entity_type"]).orderBy("entity_type").collect()}
    return out


def run(spark: SparkSession, sample: str, labels: str, config: DetectionConfig | None = None, output: str | None = None) -> dict:
    """Measures a sample (JSON rows: id, stratum, context, text) with labels (id, type, value), or a text file with spans (start, end, type)."""
    rows = read_json_rows(spark, labels)
    if sample.lower().endswith(".txt"):
        blocks = spark.read.text(sample, wholetext=True).select(F.lit("text").alias("doc_id"), F.lit("text").alias("stratum"), F.lit("").alias("context"), F.col("value").alias("text"))
        gold = rows.select(F.lit("text").alias("doc_id"), F.col("type").alias("entity_type"), "start", "end")
    else:
        src = read_json_rows(spark, sample)
        blocks = src.select(F.col("id").cast("string").alias("doc_id"), "stratum", "context", "text")
        gold = located_labels(src, rows.where("value is not null"))
    gold = stored(gold, "gold")
    scores, _ = measured(blocks, gold, config)
    out = report(scores, gold)
    if output:
        spark.createDataFrame([(json.dumps(out),)], "value string").coalesce(1).write.mode("overwrite").text(output)
    return out


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="maskwright.plans.measures", description=__doc__)
    p.add_argument("--sample", required=True)
    p.add_argument("--labels", required=True)
    p.add_argument("--issuer", action="append", default=[])
    p.add_argument("--output")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("maskwright-measures").getOrCreate()
    print(json.dumps(run(spark, a.sample, a.labels, DetectionConfig(issuer_names=tuple(a.issuer)), a.output), indent=2))


if __name__ == "__main__":
    main()
