"""Mixing sources to target weights: cube-method balanced sampling.

Every document of a source has the same expected number of copies, so that the source has its target share of all tokens; the whole part is taken
for sure, the fraction is an inclusion probability. The flight phase moves the probabilities of a bucket of documents through the null-space of
two constraints (documents, tokens) until at most two are left between 0 and 1; those of many buckets meet in a next round, and the last few of a
source are landed at random with the number of documents kept.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from hashlib import blake2b
from math import ceil, floor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.skew import spread_join
from .common import stored

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_encoders: dict[str, object] = {}


def source_name(col: Column) -> Column:
    """One notation per source: lower case, trimmed, blanks and dashes as underscores; null and empty stay null."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(col)), r"[\s-]+", "_"), F.lit(""))


def token_counts(docs: DataFrame, key: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """key, source and tokens of each document; null and empty texts have 0 tokens. ``vocabulary``: ranks of a byte-level BPE, read on each worker."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if vocabulary not in _encoders:
            import tiktoken

            with open(vocabulary, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            _encoders[vocabulary] = tiktoken.Encoding("maskwright", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        encode = _encoders[vocabulary].encode_ordinary
        for p in parts:
            yield pd.DataFrame({"k": p["k"], "source": p["source"], "tokens": [len(encode(t)) if t else 0 for t in p["t"]]})

    src = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), source_name(F.col("source")).alias("source"), F.col("text").alias("t"))
    return src.mapInPandas(run, "k long, source string, tokens long")


def _uniform(seed: str, *what: object) -> float:
    return int.from_bytes(blake2b(":".join([seed, *map(str, what)]).encode(), digest_size=7).digest(), "big") / 2**56


def flight(ids: np.ndarray, p: np.ndarray, x: np.ndarray, seed: str, eps: float = 1e-9) -> np.ndarray:
    """Probabilities after the flight phase under two constraints, their sum and the sum of p * x; at most two stay strictly between 0 and 1.

    Walks over the units in the order given with three active ones at a time; the direction is the null vector of the three, the step goes to
    the nearest bound on a side drawn so that the mean of every probability is kept. Deterministic in ids and seed.
    """
    p = p.astype(float).copy()
    open_ = [i for i in range(len(p)) if eps < p[i] < 1 - eps]
    active, rest = open_[:3], iter(open_[3:])
    step = 0
    while len(active) == 3:
        a = x[active]
        u = np.array([a[1] - a[2], a[2] - a[0], a[0] - a[1]], float)
        if not np.abs(u).max() > 0:  # three equal sizes: any direction with sum 0 keeps both totals
            u = np.array([1.0, -1.0, 0.0])
        q = p[active]
        up = min((1 - v) / d if d > 0 else v / -d for v, d in zip(q, u) if d)
        down = min(v / d if d > 0 else (1 - v) / -d for v, d in zip(q, u) if d)
        step += 1
        q = q + up * u if _uniform(seed, ids[active[0]], ids[active[1]], ids[active[2]], step) < down / (up + down) else q - down * u
        p[active] = np.clip(q, 0, 1)
        still = [i for i in active if eps < p[i] < 1 - eps]
        for i in active:
            if i not in still:
                p[i] = round(p[i])
        for i in rest:
            still.append(i)
            if len(still) == 3:
                break
        active = still
    return p


def landing(ids: np.ndarray, p: np.ndarray, seed: str, eps: float = 1e-9) -> np.ndarray:
    """Rounds the last fractions: they are laid in a row on a line and a comb with one random offset picks, so their number is kept to within one."""
    p = p.astype(float).copy()
    open_ = [i for i in range(len(p)) if eps < p[i] < 1 - eps]
    if open_:
        at, total = _uniform(seed, "landing", *[ids[i] for i in open_]), 0.0
        for i in open_:
            before, total = total, total + p[i]
            p[i] = 1.0 if floor(total - at + 1e-12) > floor(before - at + 1e-12) else 0.0
    return p


def plan(available: dict[str, int], targets: dict[str, tuple[float, int]], budget: float | None = None) -> tuple[float, dict[str, float]]:
    """(total tokens aimed at, expected copies of each source). Sources that are not there leave their share to the others in proportion.

    Without ``budget`` the total is the largest at which every source that is there reaches its share within its cap; with one, a source whose
    cap is too low is taken as often as allowed and falls short.
    """
    there = {s: (w, c) for s, (w, c) in targets.items() if available.get(s, 0) > 0 and w > 0 and c > 0}
    weight = sum(w for w, _ in there.values())
    if not there:
        return 0.0, {}
    total = budget if budget is not None else min(c * available[s] * weight / w for s, (w, c) in there.items())
    return total, {s: min(float(c), w / weight * total / available[s]) for s, (w, c) in there.items()}


def mixed(docs: DataFrame, key: str, targets: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, budget: float | None = None, seed: str = "mix-1", bucket: int = 5000) -> tuple[DataFrame, DataFrame]:
    """(documents with copies, report by source).

    The first has key, source, tokens and copies (at least 1, at most max_repeats of the source). The report has a row for each target source:
    source, target_share, max_repeats, n_documents, available_tokens, mixed_documents, copies, mixed_tokens, actual_share. Documents without
    text, with a null key or of a source without target are in no mix; a key twice counts once. Duplicate targets of a source: the largest counts.
    """
    spark = docs.sparkSession
    sizes = token_counts(docs, key, vocabulary).groupBy("k").agg(F.min(F.struct("source", "tokens")).alias("d")).select("k", "d.source", "d.tokens")
    goal = targets.where("source is not null and target_share is not null").groupBy(source_name(F.col("source")).alias("source")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    goal = stored(goal, "targets")
    some = sizes.where("tokens > 0")
    some = some.join(F.broadcast(goal), "source") if goal.limit(100_001).count() <= 100_000 else spread_join(some, goal, ["source"], F.col("k"))
    sizes = stored(some.select("k", "source", "tokens"), "sizes")
    totals = sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
    have = {r["source"]: (r["tokens"], r["n"]) for r in totals.collect()}  # one row for each target source
    want = {r["source"]: (r["target_share"], r["max_repeats"] or 0) for r in goal.collect()}
    _, copies = plan({s: t for s, (t, _) in have.items()}, want, budget)
    copies = {s: round(c, 9) for s, c in copies.items()}
    frame = spark.createDataFrame([(s, floor(c), c - floor(c), max(1, ceil(have[s][1] / bucket))) for s, c in copies.items()], "source string, sure int, part double, buckets int")
    units = sizes.join(F.broadcast(frame), "source")

    def fly(last: bool):
        def run(g: pd.DataFrame) -> pd.DataFrame:
            g = g.assign(o=[_uniform(seed, "order", k) for k in g["k"]]).sort_values(["o", "k"])
            ids, p = g["k"].to_numpy(), g["p"].to_numpy(float)
            p = flight(ids, p, g["tokens"].to_numpy(float), seed)
            g["p"] = landing(ids, p, seed) if last else p
            return g[["k", "source", "tokens", "sure", "p"]]

        return run

    schema = "k long, source string, tokens long, sure int, p double"
    sure = units.where("part < 1e-9").select("k", "source", "tokens", "sure", F.lit(0.0).alias("p"))
    todo = units.where("part >= 1e-9").select("k", "source", "tokens", "sure", F.col("part").alias("p"), "buckets")
    most = max([b for _, _, f, b in frame.collect() if f >= 1e-9], default=1)
    done = [sure]
    while most > 1:
        todo = todo.withColumn("g", F.pmod(F.xxhash64("k"), F.col("buckets")))
        flown = stored(todo.groupBy("source", "g").applyInPandas(lambda g: fly(False)(g).assign(buckets=int(g["buckets"].iloc[0])), schema + ", buckets int"), "flight")
        between = (F.col("p") > 1e-9) & (F.col("p") < 1 - 1e-9)
        done.append(flown.where(~between).drop("buckets"))
        todo = flown.where(between).withColumn("buckets", F.greatest(F.ceil(F.col("buckets") * 2 / bucket), F.lit(1)).cast("int"))
        most = ceil(most * 2 / bucket)
    done.append(todo.drop("buckets").groupBy("source").applyInPandas(fly(True), schema))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    out = stored(out.withColumn("copies", (F.col("sure") + F.round("p")).cast("int")).where("copies > 0").select("k", "source", "tokens", "copies"), "mix")
    by = out.groupBy("source").agg(F.count(F.lit(1)).alias("mixed_documents"), F.sum("copies").alias("copies"), F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"))
    everything = out.agg(F.sum(F.col("tokens") * F.col("copies")).alias("everything"))
    report = goal.join(totals.withColumnsRenamed({"tokens": "available_tokens", "n": "n_documents"}), "source", "left").join(by, "source", "left").crossJoin(F.broadcast(everything))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    report = report.select("source", "target_share", "max_repeats", zero("n_documents"), zero("available_tokens"), zero("mixed_documents"), zero("copies"), zero("mixed_tokens"), F.round(F.coalesce(F.col("mixed_tokens") / F.col("everything"), F.lit(0.0)), 6).alias("actual_share"))
    return out.withColumnRenamed("k", key), report
