"""Queries of the corpus operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, p1_address, p2_permanent, p3_names, p4_personal, p5_blocks, p6_lookalike, p7_leak, p8_mixing, p9_language
from ..functions.skew import spread_join
from .common import latest, stored, table_path


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return p1_address.same_place(_t(spark, sf, "pii_match").where("entity_type = 'ADDRESS'").select("match_id", "text"), "match_id")


def p1_places(spark: SparkSession, sf: str) -> DataFrame:
    """Each address span with the smallest match_id of its premises and the number of spans there; a span without any letter or digit is alone."""
    spans = stored(latest(_t(spark, sf, "pii_match").where("entity_type = 'ADDRESS'").select("match_id", "text"), "match_id", "text"), "spans")
    p = stored(p1_address.places(spans, "match_id"), "place")
    head = p.groupBy("place").agg(F.min("match_id").alias("place_id"), F.count(F.lit(1)).alias("spans"))
    every = spread_join(p, head, ["place"], F.col("match_id"), counts=head.select("place", F.col("spans").alias("n"))).select("match_id", "place_id", "spans")
    return every.union(spans.join(p, "match_id", "left_anti").select("match_id", F.col("match_id").alias("place_id"), F.lit(1).cast("long")))


def p2_sample(spark: SparkSession, sf: str) -> DataFrame:
    """A tenth of each stratum (half of the rare ones) of all blocks: two deliveries, each to the register as it is found at its path, as two jobs would."""
    rows = _t(spark, sf, "real_sample").select("id", "stratum", "batch_no")
    path = table_path(spark, "prn")
    middle = rows.agg(F.percentile_approx("batch_no", 0.5).alias("m")).first()["m"] or 0
    rates = {"annexure": 0.5, "footnote": 0.5}
    for part in (rows.where(F.col("batch_no") <= middle), rows.where((F.col("batch_no") > middle) | F.col("batch_no").isNull())):
        p2_permanent.Register(spark, path).insert(part, rates, 0.1)
    return p2_permanent.Register(spark, path).sample().select("id", "stratum", F.round("prn", 9).alias("prn"))


def _names(spark: SparkSession, sf: str) -> DataFrame:
    a = _t(spark, sf, "pii_match").where("entity_type in ('PERSON', 'ORG')").selectExpr("match_id as rec_id", "filing_id", "text")
    b = _t(spark, sf, "residual_finding").where("entity_type in ('PERSON', 'ORG')").selectExpr("finding_id as rec_id", "filing_id", "text")
    return a.union(b)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_names.same_entity(_names(spark, sf), "rec_id", "filing_id")


def p3_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Each name record with the smallest record of its person or firm in the filing and the number of records there."""
    e = p3_names.entities(latest(_names(spark, sf), "rec_id", "filing_id", "text"), "rec_id", "filing_id")
    e = stored(e, "entity")
    head = e.groupBy("entity").agg(F.min("rec_id").alias("entity_id"), F.count(F.lit(1)).alias("records"))
    return spread_join(e, head, ["entity"], F.col("rec_id"), counts=head.select("entity", F.col("records").alias("n"))).select("rec_id", "entity_id", "records")


def _personal(spark: SparkSession, sf: str) -> tuple[p4_personal.Model, DataFrame, DataFrame, tuple[str, ...]]:
    """(model, blocks, spans to search, types to search spans for)."""
    blocks = _t(spark, sf, "real_sample").where("id is not null").select(F.col("id").cast("long").alias("rec_id"), "text")
    spans = _t(spark, sf, "pii_match").select("match_id", "entity_type", "text")
    wide = spans.where("match_id is not null and entity_type in ('ADDRESS', 'ORG', 'PERSON')").select(F.col("match_id").alias("rec_id"), "text")
    return p4_personal.fit(blocks, spans), blocks, wide, tuple(t for t in p4_personal.TYPES if t not in ("ADDRESS", "PERSON"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """A record delivered again gives the same items again, so items are made distinct, not texts: they are far smaller to shuffle."""
    model, blocks, wide, ids = _personal(spark, sf)
    one = p4_personal.items(blocks, "rec_id", "text", model).select(F.lit("real_sample").alias("src"), "rec_id", "entity_type", "start_pos", "end_pos")
    two = p4_personal.items(wide, "rec_id", "text", model, ids).select(F.lit("pii_match"), "rec_id", "entity_type", "start_pos", "end_pos")
    return one.union(two).distinct()


def p4_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """Every text with each personal item replaced by its type in brackets."""
    model, blocks, wide, ids = _personal(spark, sf)
    one = p4_personal.redacted(latest(blocks, "rec_id", "text"), "rec_id", "text", model)
    two = p4_personal.redacted(latest(wide, "rec_id", "text"), "rec_id", "text", model, ids)
    return one.select(F.lit("real_sample").alias("src"), "*").union(two.select(F.lit("pii_match"), "*"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    g = p5_blocks.block_groups(_t(spark, sf, "real_sample").select("id", "text"), "id")
    return g.where("id > first").select(F.col("first").cast("long").alias("first_id"), F.col("id").cast("long").alias("copy_id"))


def p5_blocks_counted(spark: SparkSession, sf: str) -> DataFrame:
    """One record per block, with the number of its copies."""
    return p5_blocks.deduplicated(_t(spark, sf, "real_sample"), "id").select("id", "text", "n_copies")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Both tables in one run: records of a group (the sample, or a filing of the findings) are compared among themselves."""
    a = _t(spark, sf, "real_sample").select(F.col("id").cast("long").alias("rec_id"), F.lit("real_sample").alias("within"), "text")
    b = _t(spark, sf, "residual_finding").select(F.col("finding_id").cast("long").alias("rec_id"), F.concat(F.lit("residual_finding/"), "filing_id").alias("within"), "text")
    pairs = p6_lookalike.look_pairs(a.union(b), "rec_id", within="within")
    return pairs.select(F.substring_index("within", "/", 1).alias("src"), "id_a", "id_b")


def p6_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """Each record of both tables with the canonical text of its look."""
    a = _t(spark, sf, "real_sample").select(F.lit("real_sample").alias("src"), F.col("id").cast("long").alias("rec_id"), "text")
    b = _t(spark, sf, "residual_finding").select(F.lit("residual_finding").alias("src"), F.col("finding_id").alias("rec_id"), "text")
    return p6_lookalike.canonicalise(a.union(b)).select("src", "rec_id", "canonical")


def p7_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold at least half of an item, with the share of the item's words held."""
    return p7_leak.leaks(_t(spark, sf, "documents").select("doc_id", "text"), "doc_id", _t(spark, sf, "eval_item").select("item_id", "text"), "item_id")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_leaks(spark, sf).select("doc_id", "item_id")


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The mix: each document of a target source with the times it is taken."""
    return p8_mixing.mixed(_t(spark, sf, "documents").select("doc_id", "source", "text"), "doc_id", _t(spark, sf, "mix_target"))[0]


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and reached shares of the mix by source."""
    return p8_mixing.mixed(_t(spark, sf, "documents").select("doc_id", "source", "text"), "doc_id", _t(spark, sf, "mix_target"))[1]


def p8_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """Of each target source: documents over their cap, whether the report adds up to the mix, and whether the share is that of the target (of the sources that are there) to within a hundredth."""
    mix, shares = p8_mixing.mixed(_t(spark, sf, "documents").select("doc_id", "source", "text"), "doc_id", _t(spark, sf, "mix_target"))
    mix, shares = stored(mix, "mix"), stored(shares, "shares")
    by = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("t"), F.max("copies").alias("most"), (F.count(F.lit(1)) - F.count_distinct("doc_id")).alias("twice"))
    there = shares.where("available_tokens > 0").agg(F.sum("target_share").alias("all"))
    j = shares.join(by, "source", "left").crossJoin(F.broadcast(there))  # one row
    want = F.when(F.col("available_tokens") > 0, F.col("target_share") / F.col("all")).otherwise(0.0)
    over = F.when((F.coalesce("most", F.lit(0)) > F.col("max_repeats")) | (F.coalesce("twice", F.lit(0)) > 0), 1).otherwise(0)
    return j.select("source", over.cast("long").alias("over_cap"), (F.coalesce("t", F.lit(0)) == F.col("mixed_tokens")).alias("adds_up"), (F.abs(F.col("actual_share") - want) <= 0.01).alias("near"))


def _languages(spark: SparkSession, sf: str) -> DataFrame:
    return p9_language.languages(_t(spark, sf, "documents").select("doc_id", "text"), "doc_id", _t(spark, sf, "lang_sample"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    docs = _t(spark, sf, "documents").select("doc_id", "text", "lang")
    got = p9_language.languages(docs, "doc_id", _t(spark, sf, "lang_sample"), keep=["lang"])
    label = p9_language.label_language(F.col("label_lang"))
    rows = got.select("doc_id", label.alias("label"), F.explode("shares").alias("s")).where("s.share >= 0.2 and (label is null or label <> s.lang)")
    return rows.select("doc_id", F.col("s.lang").alias("lang")).distinct()


def p9_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Each document with its main language, the confidence and the number of passages in other languages."""
    return _languages(spark, sf).select("doc_id", "lang", "confidence", F.size("passages").alias("n_passages"))


def p9_passages(spark: SparkSession, sf: str) -> DataFrame:
    """Each passage in another language than its document's, with place, language and confidence."""
    return _languages(spark, sf).select("doc_id", F.explode("passages").alias("p")).select("doc_id", "p.*")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_places, p2_sample, p3_entities, p3_found, p4_found, p4_redacted, p5_blocks_counted, p5_found, p6_canonical, p6_found, p7_found, p7_leaks, p8_invariants, p8_mix, p8_shares, p9_documents, p9_found, p9_passages)}


def oracle_sql() -> dict[str, str]:
    quoted = lambda x: x.replace("'", "''")
    spelt = f"translate(text, '{quoted(''.join(common._ONE) + common.INVISIBLE)}', '{quoted(''.join(common._ONE.values()))}')"
    for k, v in common.LIGATURES.items():
        spelt = f"replace({spelt}, '{k}', '{v}')"
    look = f"nfc_normalize({spelt})"
    return {
        "p2_sample": """
            WITH m AS (SELECT quantile_disc(batch_no, 0.5) AS m FROM real_sample),
            r AS (SELECT id, coalesce(nullif(lower(trim(stratum)), ''), 'unknown') AS s, coalesce(batch_no > m, true) AS late FROM real_sample, m WHERE id IS NOT NULL),
            f AS (SELECT id, late, min(s) AS s FROM r GROUP BY 1, 2),
            one AS (SELECT id, s FROM f QUALIFY row_number() OVER (PARTITION BY id ORDER BY late) = 1),
            u AS (SELECT id, s, CAST(CAST(concat('0x', left(sha256(concat('maskwright-1:', id)), 13)) AS UBIGINT) AS DOUBLE) / 4503599627370496.0 AS p FROM one)
            SELECT CAST(id AS BIGINT) AS id, s AS stratum, round(p, 9) AS prn FROM u WHERE p < CASE WHEN s IN ('annexure', 'footnote') THEN 0.5 ELSE 0.1 END""",
        "p8_invariants": "SELECT regexp_replace(lower(trim(source)), '[\\s-]+', '_', 'g') AS source, CAST(0 AS BIGINT) AS over_cap, true AS adds_up, true AS near FROM mix_target WHERE source IS NOT NULL AND target_share IS NOT NULL GROUP BY 1",
        "p6_found": f"""
            WITH a AS (SELECT CAST(id AS BIGINT) AS k, min(text) AS text FROM real_sample GROUP BY 1), b AS (SELECT finding_id AS k, filing_id, min(text) AS text FROM residual_finding WHERE filing_id IS NOT NULL GROUP BY 1, 2),
            m AS (SELECT 'real_sample' AS src, k, '' AS f, text, {look} AS look FROM a UNION ALL SELECT 'residual_finding', k, filing_id, text, {look} FROM b)
            SELECT x.src, x.k AS id_a, y.k AS id_b FROM m x JOIN m y ON x.src = y.src AND x.f = y.f AND x.look = y.look AND x.k < y.k AND x.text <> y.text""",
    }
