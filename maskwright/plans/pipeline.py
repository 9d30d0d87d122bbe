"""The redaction of documents from blocks to finished text, audit rows and checks, as lazy DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.barrier import stored, wide
from ..functions.skew import running, safe_join, spread_join
from ..functions.spans import no_spans
from ..functions.vocab import SPANS, DetectionConfig, tier
from ..operators import address, consistency, names, pseudonymise, structured, verify
from ..operators.glossary import without_terms
from ..operators.resolve import reconcile, resolve

@dataclass(frozen=True)
class Plugin:
    """A detector added by a user: ``build`` is a function of the columns text, context and heading to an array of spans."""

    build: Callable[[Column, Column, Column], Column]
    types: tuple[str, ...] = ()
    priority: int = 9
    splittable: bool = False


#: Detectors added by users, by name.
PLUGINS: dict[str, Plugin] = {}


def register_detector(name: str, build: Callable[[Column, Column, Column], Column], types: tuple[str, ...] = (), priority: int = 9, splittable: bool = False) -> None:
    """Adds a detector: a function of the columns text, context and heading to an array of spans (a pandas UDF's result is fine).

    ``types`` are the types it finds that the engine does not know; they claim signs by ``priority`` (0 first), and a span of a splittable
    type that loses is cut around the winners instead of dropped.
    """
    clash = set(types).intersection(vocab.TYPES)
    if clash:
        raise ValueError(f"types the engine has already: {', '.join(sorted(clash))}")
    PLUGINS[name] = Plugin(build, types, priority, splittable)
    for t in types:
        vocab.EXTRA[t] = (priority, splittable)


def unregister_detector(name: str) -> None:
    """Takes a detector out again, with its types."""
    for t in PLUGINS.pop(name).types:
        vocab.EXTRA.pop(t, None)


def detected(text: Column, context: Column, heading: Column, config: DetectionConfig) -> Column:
    """All spans of the enabled types above the confidence, unresolved. Disabled types are not planned at all."""
    parts = [build(text, context) for t, build in structured.DETECTORS.items() if t in config.enabled]
    if "ADDRESS" in config.enabled:
        parts.append(address.addresses(text, context))
    if "PERSON" in config.enabled:
        parts.append(names.contact_persons(text, heading))
    if "ORG" in config.enabled:
        parts.append(names.legal_form_firms(text, heading, config.kept_issuers))
    parts += [p.build(text, context, heading) for p in PLUGINS.values()]
    every = F.concat(*parts) if parts else no_spans()
    return F.filter(every, lambda s: s["confidence"] >= config.min_confidence).cast(SPANS)


def detect(blocks: DataFrame, config: DetectionConfig | None = None) -> DataFrame:
    """Adds ``spans`` (resolved, reconciled per block) to blocks with doc_id, block_id, text and, if there, context and is_heading. Blank blocks have none."""
    config = config or DetectionConfig()
    for c, default in (("context", F.lit("")), ("is_heading", F.lit(False)), ("location", F.lit("text"))):
        if c not in blocks.columns:
            blocks = blocks.withColumn(c, default)
    raw = detected(F.col("text"), F.col("context"), F.col("is_heading"), config)
    # comment authors are persons whatever they look like
    author = F.struct(F.lit("PERSON").alias("entity_type"), F.col("text"), F.lit(0).alias("start"), F.length("text").alias("end"), F.lit(1.0).alias("confidence"), F.lit("metadata").alias("source"))
    raw = F.when(F.col("location") == "comment_author", F.array(author).cast(SPANS)).otherwise(raw)
    out = blocks.withColumn("_raw", F.when(F.trim("text") != "", raw).otherwise(no_spans()))
    return out.withColumn("spans", F.coalesce(reconcile(resolve(F.col("_raw"))), no_spans())).drop("_raw")


def spans_of(blocks: DataFrame, *keep: str) -> DataFrame:
    """Exploded spans with doc_id, block_id and the columns named."""
    return blocks.select("doc_id", "block_id", *keep, F.inline("spans"))


@dataclass
class Result:
    """redacted blocks, audit rows, spans after refinement; findings and report where verification was asked for."""

    redacted: DataFrame
    replacements: DataFrame
    spans: DataFrame
    findings: DataFrame | None = None
    report: DataFrame | None = None


#: The number of a block in a run of the pipeline: what joins a block with what was found in it, whatever its document and block number are.
ROW = "_row"


def refine(blocks: DataFrame, terms: DataFrame | None = None, aliases: bool = True) -> tuple[DataFrame, DataFrame]:
    """(blocks after the sweep for known names, names of the documents). ``terms``: doc_id, term of the glossaries; such spans are dropped first."""
    if terms is not None:
        kept = without_terms(spans_of(blocks, ROW), terms)
        again = kept.groupBy(ROW).agg(F.array_sort(F.collect_list(F.struct("start", F.struct("entity_type", "text", "start", "end", "confidence", "source").alias("s")))).alias("_k"))
        blocks = safe_join(blocks, again, [ROW], "left").withColumn("spans", F.coalesce(F.transform("_k", lambda k: k["s"]), no_spans()).cast(SPANS)).drop("_k")
    every = consistency.all_names(consistency.known_names(spans_of(blocks)), aliases=aliases)
    return consistency.sweep(wide(blocks), every, row=[ROW]), every


def fakes(keys: DataFrame, seed: int) -> DataFrame:
    """``keys`` (doc_id, entity_type, key, original, hint; one row per key of a document and type) with ``fake``.

    Names of persons and firms of one document that drew the same value draw again, all but the first by key; a second clash stays.
    """
    k = keys.withColumn("fake", pseudonymise.value(seed, F.col("entity_type"), F.col("original"), F.col("key"), F.col("hint")))
    named = F.col("entity_type").isin("PERSON", "ORG")
    taken = k.where(named).groupBy("doc_id", "entity_type", F.lower("fake").alias("_f")).agg(F.min("key").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    k = safe_join(k.withColumn("_f", F.lower("fake")), taken, ["doc_id", "entity_type", "_f"], "left")
    again = pseudonymise.value(seed, F.col("entity_type"), F.col("original"), F.concat("key", F.lit("#2")), F.col("hint"))
    return k.withColumn("fake", F.when(named & (F.col("key") != F.col("_first")), again).otherwise(F.col("fake"))).drop("_f", "_first")


def replaced(blocks: DataFrame, every: DataFrame | None, seed: int = 42) -> DataFrame:
    """Audit rows: doc_id, block_id, seq (the place in the document's order), entity_type, original, fake, confidence, source, confidence_tier, start, end, location.

    The same name of a document has the same value everywhere in it; aliases and short forms have that of the full name.
    """
    s = spans_of(blocks, ROW, "location")
    key = pseudonymise.fake_key(F.col("text"))
    s = s.withColumn("_n", F.when(F.col("entity_type").isin("PERSON", "ORG"), key))
    hint = F.lit(None).cast("string")
    if every is not None:
        alias = every.where("full <> name").select("doc_id", F.col("name").alias("_n"), "full")
        s = safe_join(s, alias, ["doc_id", "_n"], "left")
        s = s.withColumn("key", F.coalesce("full", key)).drop("full")
    else:
        s = s.withColumn("key", key)
    # capital letters of a value follow those of what it replaces, so each is a key of its own with the same draw
    capital = F.col("text") == F.upper("text")
    s = s.withColumn("_cap", capital & F.col("entity_type").isin(*vocab.CASE_MIRRORED)).withColumn("_form", F.when(F.col("entity_type").isin("PHONE", "BANK_ACCOUNT_NUMBER", "IP_ADDRESS"), F.col("text")))
    on = ["doc_id", "entity_type", "key", "_cap", "_form"]
    keys = s.groupBy(*on).agg(F.min("text").alias("original"))
    if every is not None:
        # the person's own value, be it the second draw
        persons = fakes(keys.where("entity_type = 'PERSON' and not _cap").withColumn("hint", hint), seed).select("doc_id", F.col("key").alias("person"), F.col("fake").alias("hint"))
        hints = consistency.email_hints(s.select("doc_id", "block_id", "start", "entity_type", "text"))
        full = safe_join(hints, every.select("doc_id", F.col("name").alias("person"), "full"), ["doc_id", "person"], "left").select("doc_id", F.col("email").alias("key"), F.coalesce("full", "person").alias("person"))
        shown = safe_join(full, persons, ["doc_id", "person"], "left").select("doc_id", "key", F.lit("EMAIL").alias("entity_type"), F.coalesce("hint", pseudonymise.person(seed, F.col("person"))).alias("hint"))
        keys = safe_join(keys, shown, ["doc_id", "key", "entity_type"], "left")
    else:
        keys = keys.withColumn("hint", hint)
    values = fakes(keys, seed).select(*on, "fake")
    per_key = s.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    out = spread_join(s, values, on, F.struct(ROW, "start"), "left", per_key)
    # numbers in the document: spans before the block, then the place in the block
    sizes = blocks.select("doc_id", "block_id", ROW, F.size("spans").alias("_c")).where("_c > 0")
    before = running(sizes, ["doc_id"], ["block_id", ROW], F.col("_c"), "_before").select(ROW, "_before")
    inside = blocks.select(ROW, F.posexplode(F.transform("spans", lambda x: x["start"])).alias("_i", "start"))
    at = safe_join(inside, before, [ROW]).select(ROW, "start", (F.col("_before") + F.col("_i")).cast("int").alias("seq"))
    out = safe_join(out, at, [ROW, "start"], "left")
    return out.select(ROW, "doc_id", "block_id", "seq", "entity_type", F.col("text").alias("original"), "fake", "confidence", "source", tier(F.col("confidence")).alias("confidence_tier"), "start", "end", "location")


def spliced(blocks: DataFrame, replacements: DataFrame) -> DataFrame:
    """Blocks with ``redacted``: every replacement in its place."""
    edits = replacements.groupBy(ROW).agg(F.array_sort(F.collect_list(F.struct("start", "end", "fake"))).alias("_e"))
    j = safe_join(blocks, edits, [ROW], "left")
    return j.withColumn("redacted", F.when(F.col("_e").isNull(), F.col("text")).otherwise(pseudonymise.spliced(F.col("text"), F.col("_e")))).drop("_e")


def redact(blocks: DataFrame, config: DetectionConfig | None = None, terms: DataFrame | None = None, seed: int = 42, names_sweep: bool = True, check: bool = True, aliases: bool = True) -> Result:
    """The whole pipeline. Its stages are tables in the shared folder, written when it is called: detection, refinement and audit rows are each computed once.

    Null documents, null block numbers and rows delivered twice are blocks like others: each row comes out once, redacted. A null document is one
    document. ``aliases``: whether names cut short are sought too (not so for single texts, which are swept with their own names only).
    """
    config = config or DetectionConfig()
    found = stored(detect(wide(blocks), config).withColumn(ROW, F.monotonically_increasing_id()), "detected")
    if names_sweep:
        refined, every = refine(found, terms, aliases)
        refined, every = stored(refined, "refined"), stored(every, "names")
    else:
        refined, every = found, None
    replacements = stored(replaced(refined, every, seed), "replacements")
    out = spliced(refined, replacements)
    if not check:
        return Result(out.drop(ROW), replacements.drop(ROW), spans_of(refined))
    finished = stored(out.select(ROW, "doc_id", "block_id", "location", "context", "is_heading", F.col("redacted").alias("text")), "finished")
    findings, report = verified(finished, replacements, config, row=[ROW])
    return Result(out.drop(ROW), replacements.drop(ROW), spans_of(refined), findings, report)


def verified(finished: DataFrame, replacements: DataFrame, config: DetectionConfig | None = None, row: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, report) of finished blocks: doc_id, block_id, location, text and, if there, context and is_heading."""
    finished = wide(finished)
    again = stored(spans_of(detect(finished, config), "location"), "again")
    leaks, others = verify.leaked(finished, replacements, row=row), verify.unexpected(again, replacements)
    findings = stored(leaks.withColumn("kind", F.lit("leaked")).unionByName(others.withColumn("kind", F.lit("unexpected"))), "findings")
    part = lambda k: findings.where(F.col("kind") == k).drop("kind")
    return findings, verify.report(part("leaked"), part("unexpected"), finished)


def summary(replacements: DataFrame) -> DataFrame:
    """Counts by type and tier and in total (grouping sets)."""
    g = replacements.groupingSets([[F.col("entity_type")], [F.col("confidence_tier")], []], F.col("entity_type"), F.col("confidence_tier"))
    return g.agg(F.count(F.lit(1)).alias("n"))
