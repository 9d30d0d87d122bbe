"""Reader registry: blocks from Word, text, PDF and tabular files, single ones and folders, on any file system that Spark knows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .docx import SCHEMAS, rows_of


def files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """path and content of a file, or of all files of a folder and its folders with the suffix, in any case."""
    glob = "*" + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in suffix)
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "content")


def read_docx(spark: SparkSession, path: str, what: str = "blocks") -> DataFrame:
    """Blocks (or glossary rows, or warnings) of Word documents, one document after the other in each task."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for name, content in zip(p["path"], p["content"]):
                yield pd.DataFrame(list(rows_of(name, content, what)), columns=names)

    schema = SCHEMAS[what]
    names = [c.split()[0] for c in schema.split(", ")]
    return files(spark, path, ".docx").mapInPandas(run, schema)


def _one_block(found: DataFrame, text: str) -> DataFrame:
    return found.select(
        F.col("path").alias("doc_id"), F.lit(0).cast("long").alias("block_id"), F.lit("text").alias("location"), F.lit("").alias("part"), F.lit(0).alias("paragraph"), F.expr(text).alias("text"), F.lit("").alias("context"), F.lit(False).alias("is_heading")
    )


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Each file is one block; bytes that are no UTF-8 are dropped."""
    return _one_block(files(spark, path, ".txt"), "replace(make_valid_utf8(cast(content as string)), '\ufffd', '')")


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    """Each file is one block of its pages' texts joined by line ends; needs pypdf on the executors, else an error that says so."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for p in parts:
            try:
                import pypdf
            except ImportError as e:
                raise RuntimeError("reading PDF needs the package pypdf on every executor") from e
            texts = ["\n".join(page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(c)).pages) for c in p["content"]]
            yield pd.DataFrame({"path": p["path"], "text": texts})

    return _one_block(files(spark, path, ".pdf").mapInPandas(run, "path string, text string"), "text")


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of a parquet, json, csv or orc table as blocks; the row number in the document is not known, so block_id is a digest of the text."""
    t = spark.read.format(fmt).load(path)
    return t.select(F.col(doc).cast("string").alias("doc_id"), F.xxhash64(text).alias("block_id"), F.lit("table").alias("location"), F.lit("").alias("part"), F.lit(0).alias("paragraph"), F.col(text).alias("text"), F.lit("").alias("context"), F.lit(False).alias("is_heading"))


READERS: dict[str, Callable[..., DataFrame]] = {".docx": read_docx, ".txt": read_text, ".pdf": read_pdf, ".parquet": read_table}
DOCUMENTS = (".docx", ".txt", ".pdf")


def is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def read(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of a file, by suffix, or of all Word, text and PDF files of a folder and its folders; another suffix is an error."""
    low = path.lower().rstrip("/")
    for suffix, reader in READERS.items():
        if low.endswith(suffix):
            return reader(spark, path)
    if is_folder(spark, path):
        return reduce(DataFrame.unionByName, [READERS[x](spark, path) for x in DOCUMENTS])
    raise ValueError(f"no reader for {path}; known: {', '.join(READERS)}")
