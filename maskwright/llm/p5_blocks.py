"""Duplicates hidden by formatting differences: Merkle digests of nested records.

A block of text is read as a record: labelled fields are an unordered node, each field a leaf; prose is one leaf. Leaves are normalised
(look-alike signs, case, blanks, punctuation), leaf digests are sorted at unordered nodes and hashed upward, records are grouped by root
digest, and a member is confirmed by comparing its whole normalised structure with that of its group's first record.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.skew import spread_join
from .common import checked_broadcast, composed, plain, stored

# Labels of the fields of contact blocks in filings, as lower-case words.
LABELS = (
    "name of the lead manager", "name of the banker", "name of the registrar", "name of the company", "name", "contact person", "contact no", "contact", "compliance officer",
    "company secretary", "attention", "kind attention", "registered office", "corporate office", "head office", "office", "address", "investor grievance e mail",
    "investor grievance email", "investor grievance id", "e mail", "email", "website", "web site", "telephone", "telephone no", "tel no", "tel", "phone", "phone no", "mobile", "mobile no",
    "fax", "fax no", "sebi registration no", "sebi registration number", "registration no", "our ref", "your ref", "reference", "reference no", "pan", "aadhaar no", "aadhaar", "passport no",
    "passport", "voter id", "ssn", "date",
)


def words(text: Column) -> Column:
    """Lower-case words of letters, digits and accents, joined by one blank; look-alike signs count as the common ones."""
    return F.trim(F.regexp_replace(F.lower(composed(plain(text))), r"[^\p{L}\p{N}\p{M}]+", " "))


def learned_labels(rows: DataFrame, col: str = "text", least: float = 0.002) -> tuple[str, ...]:
    """Labels of two to five words that at least the share ``least`` of all texts have at the start of a line or field, before a colon or dash.

    Over all texts; as each text has a few fields, no more than some thousand labels can reach the share.
    """
    t = rows.where(F.col(col).isNotNull())
    at = F.regexp_extract_all(F.lower(col), F.lit(r"(?:^|[\n|;])\s{0,4}(\p{L}[\p{L} .-]{2,40}?)\s{0,2}(?::|\s-\s)"), F.lit(1))
    raw = t.where(F.col(col).contains(":") | F.col(col).contains(" - ")).select(F.explode(F.array_distinct(at)).alias("raw")).groupBy("raw").agg(F.count(F.lit(1)).alias("n"))
    n = raw.select(words(F.col("raw")).alias("label"), "n").groupBy("label").agg(F.sum("n").alias("n")).where(F.size(F.split("label", " ")).between(2, 5))
    n = n.crossJoin(F.broadcast(t.agg(F.count(F.lit(1)).alias("all"))))  # one row
    return tuple(r["label"] for r in n.where(F.col("n") >= F.greatest(F.lit(3), least * F.col("all"))).orderBy("label").collect())


def structure(text: Column, labels: tuple[str, ...] = LABELS) -> Column:
    """The normalised record of a block: struct<labelled: boolean, leaves: array<string>>, fields (unordered) or one leaf of prose.

    Fields are cut before each label that follows the start or another word; a text is labelled if it begins with a label or has at least
    two. The short labels name, contact, office and date count only at the start of a line or field, so that they do not cut prose.
    """
    bare = {"name", "contact", "office", "date", "reference", "address"}
    alt = "|".join(sorted((x for x in labels if x not in bare or x in ("reference", "address")), key=lambda x: (-len(x), x)))
    w = words(text)
    marked = F.regexp_replace(w, rf"(?<!\S)({alt})(?!\S)", "\u001e$1")
    parts = F.filter(F.split(marked, "\u001e"), lambda x: F.trim(x) != "")
    leaves = F.transform(parts, lambda x: F.replace(x, F.lit(" "), F.lit("")))
    labelled = F.startswith(marked, F.lit("\u001e")) | (F.size(F.split(marked, "\u001e")) > 2)
    return F.struct(labelled.alias("labelled"), F.when(labelled, leaves).otherwise(F.array(F.replace(w, F.lit(" "), F.lit("")))).alias("leaves"))


def bare(text: Column) -> Column:
    """A text without blanks and punctuation, in lower case."""
    return F.replace(words(text), F.lit(" "), F.lit(""))


def merkle(col: Column, kind: T.DataType, ordered: bool = True, leaf: Callable[[Column], Column] = bare) -> Column:
    """Digest of any nested column, bottom-up: leaves are texts normalised by ``leaf``, structs and maps unordered nodes, arrays ordered unless told otherwise.

    A null anywhere has a digest of its own, unequal to that of the empty text.
    """
    if isinstance(kind, T.StructType):
        kids = F.array(*[F.sha2(F.concat(F.lit(f.name.lower() + "="), merkle(col[f.name], f.dataType, ordered, leaf)), 256) for f in kind.fields])
        out = F.sha2(F.concat(F.lit("s"), F.array_join(F.array_sort(kids), ",")), 256)
    elif isinstance(kind, T.MapType):
        kids = F.transform(F.map_entries(col), lambda e: F.sha2(F.concat(merkle(e["key"], kind.keyType, ordered, leaf), F.lit("="), merkle(e["value"], kind.valueType, ordered, leaf)), 256))
        out = F.sha2(F.concat(F.lit("m"), F.array_join(F.array_sort(kids), ",")), 256)
    elif isinstance(kind, T.ArrayType):
        kids = F.transform(col, lambda x: merkle(x, kind.elementType, ordered, leaf))
        out = F.sha2(F.concat(F.lit("a"), F.array_join(kids if ordered else F.array_sort(kids), ",")), 256)
    else:
        out = F.sha2(F.concat(F.lit("l"), leaf(col) if isinstance(kind, T.StringType) else col.cast("string")), 256)
    return F.coalesce(out, F.lit("null"))


RECORD = T.StructType([T.StructField("labelled", T.BooleanType()), T.StructField("leaves", T.ArrayType(T.StringType()))])


def _rooted(rows: DataFrame, key: str, col: str, labels: tuple[str, ...]) -> DataFrame:
    """_key, root (Merkle digest of the record) and body (its leaves in sorted order, in one text) of each row with key and text."""
    s = rows.where(F.col(key).isNotNull() & F.col(col).isNotNull()).select(F.col(key).alias("_key"), structure(F.col(col), labels).alias("_s"))
    root = F.unhex(merkle(F.col("_s"), RECORD, ordered=False, leaf=lambda x: x))  # the leaves are normalised already
    return s.select("_key", root.alias("root"), F.concat_ws("\u001e", F.col("_s.labelled").cast("string"), F.array_sort("_s.leaves")).alias("body"))


def block_groups(rows: DataFrame, key: str, col: str = "text", labels: tuple[str, ...] | None = None, hot: int = 10_000) -> DataFrame:
    """One row per key: key, first (smallest key of its group), copies (keys in the group).

    ``rows`` may hold a key several times; it counts once, with the text of the smallest digest. Null keys and null texts are left out; texts
    without any letter or digit form one group. ``labels``: what begins a field; without them :data:`LABELS` and :func:`learned_labels` of the rows.

    Keys and digests are shuffled; whole records only of groups of several keys, to be compared with the first of the group. Groups of over
    ``hot`` keys and a ten thousandth of all keys are split. A member whose structure differs from the group's first (equal digests) stays alone.
    """
    if labels is None:
        labels = (*LABELS, *(x for x in learned_labels(rows, col) if x not in LABELS))
    r = stored(_rooted(rows, key, col, labels), "roots")
    one = stored(r.groupBy("_key").agg(F.min("root").alias("root")), "keys")
    groups = stored(one.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min("_key").alias("first")), "groups")
    big = groups.where("n > 1")
    counts = groups.select("root", "n")
    several = stored(big.select("root", "first"), "several")
    # the record of the first of each group, once
    heads = r.join(checked_broadcast(several).withColumnRenamed("root", "_g"), (F.col("root") == F.col("_g")) & (F.col("_key") == F.col("first"))).groupBy("root").agg(F.min("body").alias("head"))
    mine = spread_join(one, big, ["root"], F.col("_key"), "left", counts, hot)
    bodies = r.join(checked_broadcast(several.select(F.col("root").alias("_g"))), F.col("root") == F.col("_g")).select("_key", "root", "body")
    met = spread_join(bodies, heads, ["root"], F.col("_key"), "inner", counts, hot)
    other = met.where("body <> head").select("_key", "root").distinct().withColumn("_alone", F.lit(True))
    j = mine.join(F.broadcast(other) if other.isEmpty() else other, ["_key", "root"], "left")
    alone = F.col("n").isNull() | F.coalesce("_alone", F.lit(False))
    return j.select(F.col("_key").alias(key), F.when(alone, F.col("_key")).otherwise(F.col("first")).alias("first"), F.when(alone, F.lit(1)).otherwise(F.col("n")).cast("long").alias("copies"))


def deduplicated(rows: DataFrame, key: str, col: str = "text", labels: tuple[str, ...] | None = None) -> DataFrame:
    """The first record of each group with the number of its copies: all columns of ``rows`` and n_copies."""
    g = block_groups(rows, key, col, labels).where(F.col(key) == F.col("first")).select(F.col(key).alias("_first"), F.col("copies").alias("n_copies"))
    met = rows.join(g, F.col(key) == F.col("_first"))
    rest = [c for c in rows.columns if c not in (key, col)]
    best = met.groupBy("_first").agg(F.min(F.struct(F.col(col), *[F.col(c) for c in rest])).alias("_b"), F.max("n_copies").alias("n_copies"))
    return best.select(F.col("_first").alias(key), *[F.col(f"_b.{c}").alias(c) for c in rows.columns if c != key], "n_copies")
