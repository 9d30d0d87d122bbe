"""spark-submit entry: redacts a file or a folder and writes documents, audit log and summary."""

from __future__ import annotations

import argparse
import json
from collections import defaultdict
from pathlib import Path, PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.barrier import stored
from .functions.vocab import TYPES, DetectionConfig
from .operators.glossary import glossary
from .plans.pipeline import Result, redact, summary, verified
from .sources.docx import Docx, from_text
from .sources.readers import DOCUMENTS, files, is_folder, read, read_docx


def target(doc: str, root: str | None) -> str:
    """Where below the output folder the document goes. Below a folder ``root`` its place and whole name are kept, so no two documents meet."""
    plain = lambda p: PurePosixPath("/" + p.split(":", 1)[-1].lstrip("/"))
    p = plain(doc)
    if root is None:
        return f"{p.stem}.redacted.docx"
    base = plain(root)
    inside = p.relative_to(base) if p.is_relative_to(base) else PurePosixPath(*p.parts[1:])
    return str(inside.with_name(f"{inside.name}.redacted.docx"))


def write_documents(result: Result, contents: DataFrame, out_dir: str, root: str | None = None) -> DataFrame:
    """Writes each document of the result as .docx into a folder that all executors share; returns doc_id and path written, one task per document.

    ``contents``: path and content of the sources. A .docx source is rewritten in place (only what changed differs), other sources become a
    heading and a paragraph per line.
    """
    edits = result.replacements.select("doc_id", "block_id", "start", "end", "fake")
    places = result.redacted.select("doc_id", "block_id", "part", "paragraph", "redacted")
    rows = places.join(edits, ["doc_id", "block_id"], "left")

    def one(key: tuple, g: pd.DataFrame, source: pd.DataFrame) -> pd.DataFrame:
        if g.empty or source.empty:
            return pd.DataFrame({"doc_id": [], "path": []})
        doc = str(key[0])
        path = Path(out_dir) / target(doc, root)
        if doc.lower().endswith(".docx"):
            todo: dict[tuple[str, int], list[tuple[int, int, str]]] = defaultdict(list)
            for r in g.itertuples(index=False):
                if r.fake is not None and r.start == r.start:
                    todo[r.part, int(r.paragraph)].append((int(r.start), int(r.end), r.fake))
            content = Docx(source["content"].iloc[0]).rewritten(todo)
        else:
            content = from_text("\n".join(g.drop_duplicates("block_id").sort_values("block_id")["redacted"].fillna("")), PurePosixPath(doc).stem)
        path.parent.mkdir(parents=True, exist_ok=True)
        half = path.with_name(path.name + f".{id(g):x}.part")
        half.write_bytes(content)
        half.replace(path)  # a task that runs again leaves a whole file
        return pd.DataFrame({"doc_id": [doc], "path": [str(path)]})

    return rows.groupBy("doc_id").cogroup(contents.withColumnRenamed("path", "doc_id").groupBy("doc_id")).applyInPandas(one, "doc_id string, path string")


def finished_blocks(spark: SparkSession, written: DataFrame, out_dir: str) -> DataFrame:
    """Blocks of the documents written, read from their files, under the names of their sources: what is in the file counts, not what was meant."""
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, "^[a-z0-9]+:", ""), "/+", "/")
    source = written.select(F.col("doc_id").alias("_source"), bare(F.col("path")).alias("_path"))
    b = read_docx(spark, out_dir).withColumn("_path", bare(F.col("doc_id")))
    return b.join(source, "_path").drop("_path", "doc_id").withColumnRenamed("_source", "doc_id")


def run(spark: SparkSession, source: str, out_dir: str, config: DetectionConfig, seed: int = 42, audit: str | None = None, verify: bool = True) -> dict:
    """Redacts, writes, reads the written files again and reports: totals, counts by type and tier, warnings by kind, findings by type.

    Texts of findings are never in the summary. ``audit`` is a folder: rows of replacements, and in the folders warnings, findings and summary what
    their names say.
    """
    Path(out_dir).mkdir(parents=True, exist_ok=True)
    folder = is_folder(spark, source)
    kinds = [x for x in DOCUMENTS if folder or source.lower().endswith(x)]
    if not kinds:
        raise ValueError(f"no document: {source}; known: {', '.join(DOCUMENTS)}")
    blocks = stored(read(spark, source), "blocks")
    terms, warnings = None, None
    if ".docx" in kinds:
        terms = glossary(read_docx(spark, source, "glossary"))
        warnings = stored(read_docx(spark, source, "warnings"), "warnings")
    word = F.lower("doc_id").endswith(".docx")
    # Word documents are searched with aliases and their glossary, single texts with their own names only
    parts = []
    if ".docx" in kinds:
        parts.append(redact(blocks.where(word), config, terms, seed, check=False))
    if len(kinds) > 1 or ".docx" not in kinds:
        parts.append(redact(blocks.where(~word), config, None, seed, check=False, aliases=False))
    redacted, replacements = parts[0].redacted, parts[0].replacements
    for p in parts[1:]:
        redacted, replacements = redacted.unionByName(p.redacted), replacements.unionByName(p.replacements)
    contents = files(spark, source, kinds[0])
    for x in kinds[1:]:
        contents = contents.union(files(spark, source, x))
    written = stored(write_documents(Result(redacted, replacements, replacements), contents, out_dir, source if folder else None), "written")
    counts: dict[str, dict] = {"by_type": {}, "by_tier": {}}
    total = 0
    for row in summary(replacements).orderBy("entity_type", "confidence_tier").collect():  # a row for each type and tier
        if row.entity_type is not None:
            counts["by_type"][row.entity_type] = row.n
        elif row.confidence_tier is not None:
            counts["by_tier"][row.confidence_tier] = row.n
        else:
            total = row.n
    out = {"documents": written.count(), "replacements": total, **counts, "warnings": {}}
    if warnings is not None:
        out["warnings"] = {r["kind"]: {"documents": r["documents"], "n": r["n"]} for r in warnings.groupBy("kind").agg(F.count_distinct("doc_id").alias("documents"), F.sum("n").alias("n")).orderBy("kind").collect()}
    findings = None
    if verify:
        findings, report = verified(stored(finished_blocks(spark, written, out_dir), "finished"), replacements, config, ["doc_id", "block_id"])
        t = report.agg(F.coalesce(F.sum("leaked"), F.lit(0)).alias("leaked"), F.coalesce(F.sum("unexpected"), F.lit(0)).alias("unexpected"), F.coalesce(F.sum("scanned_characters"), F.lit(0)).alias("scanned")).first()
        by = {r["entity_type"]: r["n"] for r in findings.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n")).orderBy("entity_type").collect()}
        out["residual_scan"] = {"clean": t.leaked == 0, "leaked": t.leaked, "unexpected": t.unexpected, "scanned_characters": t.scanned, "by_type": by}
    if audit:
        replacements.drop("start", "end").write.mode("overwrite").json(audit)
        if warnings is not None:
            warnings.write.mode("overwrite").json(f"{audit}/warnings")
        if findings is not None:
            findings.write.mode("overwrite").json(f"{audit}/findings")
        spark.createDataFrame([(json.dumps(out),)], "value string").write.mode("overwrite").text(f"{audit}/summary")
    return out


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="maskwright", description=__doc__)
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--issuer", action="append", default=[])
    p.add_argument("--redact-issuer-company", action="store_true")
    p.add_argument("--disable", action="append", default=[], choices=TYPES)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--audit-log")
    p.add_argument("--no-verify", action="store_true")
    a = p.parse_args(argv)
    config = DetectionConfig(disabled=frozenset(a.disable), redact_issuer=a.redact_issuer_company, issuer_names=tuple(a.issuer))
    spark = SparkSession.builder.appName("maskwright").getOrCreate()
    print(json.dumps(run(spark, a.input, a.output, config, a.seed, a.audit_log, not a.no_verify), indent=2))


if __name__ == "__main__":
    main()
