"""Regex matches with offsets as column expressions, without a Python worker.

``split`` gives the gaps and ``regexp_extract_all`` the matches, so match i starts after i + 1 gaps and i matches. Offsets are code points,
end-exclusive. Patterns must not match the empty text; ``(?U)`` makes classes and word bounds Unicode-aware.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocab import SPANS


_BOUND = r"(?:(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_]))"


def java(pattern: str) -> str:
    """A pattern whose word bounds take letters, digits and the underscore as words; with ``(?U)`` alone the JVM takes zero-width joiners too."""
    return pattern.replace(r"\b", _BOUND) if "U)" in pattern[:5] else pattern


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, however often the body names it: the value becomes a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def no_spans() -> Column:
    return F.array().cast(SPANS)


def matches(text: Column, pattern: str | Column, guard: str | None = None) -> Column:
    """array<struct<text, start, end>> of all matches; null text gives an empty array.

    ``guard`` is a cheap pattern that every match implies: where it fails, the dear pattern is not run. ``pattern`` may be a column.
    """
    regex = F.lit(java(pattern)) if isinstance(pattern, str) else pattern
    empty = F.array().cast("array<struct<text: string, start: int, end: int>>")

    def placed(found: Column) -> Column:
        # the match number k starts where the one before ended and its gap is over: places are summed up once, in one fold
        gaps = F.transform(F.split(text, regex, -1), lambda g: F.length(g))
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), F.transform(found, lambda m: F.length(m)), lambda g, m: F.struct(g.alias("g"), m.alias("m")))
        ends = F.aggregate(steps, F.array().cast("array<int>"), lambda acc, z: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + z["g"] + z["m"]))
        return let(
            ends,
            lambda e: F.transform(found, lambda m, i: let(F.get(e, i), lambda at: F.struct(m.alias("text"), (at - F.length(m)).cast("int").alias("start"), at.alias("end")))),
        )

    run = let(F.regexp_extract_all(text, regex, F.lit(0)), lambda found: F.when(F.size(found) > 0, placed(found)).otherwise(empty))
    return F.when(text.rlike(guard) if guard else text.isNotNull(), run).otherwise(empty)


def typed(found: Column, entity_type: str, confidence: Column | float, source: str = "regex") -> Column:
    """Matches as spans; ``confidence`` may be a function of the match given as a column builder."""
    conf = confidence if callable(confidence) else (lambda m: F.lit(float(confidence)))  # type: ignore[arg-type]
    return F.transform(
        found,
        lambda m: F.struct(
            F.lit(entity_type).alias("entity_type"), m["text"].alias("text"), m["start"].alias("start"), m["end"].alias("end"), conf(m).cast("double").alias("confidence"), F.lit(source).alias("source")
        ),
    ).cast(SPANS)


def before(text: Column, start: Column, width: int) -> Column:
    """The ``width`` signs before a place."""
    first = F.greatest(start - width, F.lit(0))
    return F.substring(text, first + 1, start - first)


def where(found: Column, keep: Callable[[Column], Column]) -> Column:
    return F.filter(found, keep)
