"""The stateless part of the pipeline on streams, whole documents by micro-batch, and counts by event-time window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.vocab import DetectionConfig
from ..operators import pseudonymise
from ..plans.pipeline import detect, redact


def read_blocks(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of blocks as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def redacted_stream(blocks: DataFrame, config: DetectionConfig | None = None, seed: int = 42) -> DataFrame:
    """Blocks of a stream (or a batch) with ``spans`` and ``redacted``; values are functions of the text, so no state is kept."""
    d = detect(blocks, config)
    return d.withColumn("redacted", pseudonymise.spliced(F.col("text"), pseudonymise.faked(F.col("spans"), seed)))


def redact_documents(blocks: DataFrame, sink: Callable[[DataFrame, DataFrame, int], None], config: DetectionConfig | None = None, checkpoint: str | None = None) -> DataStreamWriter:
    """The whole pipeline for each micro-batch in which documents arrive whole; ``sink`` gets redacted blocks, audit rows and the batch number."""

    def each(batch: DataFrame, number: int) -> None:
        r = redact(batch, config, check=False)
        sink(r.redacted, r.replacements, number)

    w = blocks.writeStream.foreachBatch(each)
    return w.option("checkpointLocation", checkpoint) if checkpoint else w


def windowed_counts(rows: DataFrame, time: str = "ts", kind: str = "event_type", size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Rows by tumbling event-time window and kind, with a watermark for late rows: window_start, kind, n. The same on a batch; rows without time are left out."""
    r = rows.where(F.col(time).isNotNull())
    r = r.withWatermark(time, late) if r.isStreaming else r
    return r.groupBy(F.window(time, size).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")
