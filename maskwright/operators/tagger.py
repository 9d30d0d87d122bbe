"""A statistical recogniser of names: an averaged perceptron over words, trained from labelled texts and applied to arrays of blocks in Arrow batches.

It stands where a pretrained model would: :func:`detector` gives its spans, filtered by the rules for recognised names, to
``pipeline.register_detector``. The training set is small enough for the driver (``rows``, a documented bound).
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import no_spans
from ..functions.vocab import SPANS
from .names import recognised

KINDS = ("PERSON", "ORG")
CONFIDENCE = {"PERSON": 0.85, "ORG": 0.8}
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*\.?(?=\s|$)|[^\W_]+(?:['’][^\W_]+)*|[^\w\s]")


def _shape(w: str) -> str:
    out = re.sub(r"[^\W\d_]", lambda m: "X" if m[0].isupper() else "x", re.sub(r"\d", "9", w))
    return re.sub(r"(.)\1+", r"\1+", out)


class Tagger:
    """Weights of an averaged perceptron with the two tags before as features; tags are chosen word by word."""

    def __init__(self, weights: dict[str, dict[str, float]]) -> None:
        self.weights = weights

    @staticmethod
    def features(words: list[str], low: list[str], shapes: list[str], i: int, last: str) -> list[str]:
        at = lambda xs, k: xs[k] if 0 <= k < len(xs) else "<>"
        w = low[i]
        return [
            "b", f"w={w}", f"s={shapes[i]}", f"e={w[-3:]}", f"a={w[:2]}", f"l={last}", f"p={at(low, i - 1)}", f"ps={at(shapes, i - 1)}", f"n={at(low, i + 1)}", f"ns={at(shapes, i + 1)}", f"pp={at(low, i - 2)}",
            f"nn={at(low, i + 2)}", f"l,s={last},{shapes[i]}", f"p,s={at(low, i - 1)},{shapes[i]}",
        ]

    def tags(self, words: list[str], learn: Callable[[int, list[str], str], None] | None = None, gold: list[str] | None = None) -> list[str]:
        low, shapes, out, last = [w.lower() for w in words], [_shape(w) for w in words], [], "O"
        for i in range(len(words)):
            fs = self.features(words, low, shapes, i, last)
            score = dict.fromkeys(TAGS, 0.0)
            for f in fs:
                for t, x in self.weights.get(f, {}).items():
                    score[t] += x
            allowed = [t for t in TAGS if t[0] != "I" or last[1:] == t[1:]]
            best = max(allowed, key=lambda t: (score[t], t == "O"))
            if learn and gold:
                learn(i, fs, best)
            last = gold[i] if gold else best
            out.append(best)
        return out

    def spans(self, text: str | None) -> list[dict]:
        """entity_type, text, start, end, confidence, source of each name; null and blank texts have none."""
        found: list[dict] = []
        ms = list(_WORD.finditer(text or ""))
        for m, tag in zip(ms, self.tags([m[0] for m in ms])):
            if tag[0] == "B":
                found.append({"entity_type": tag[2:], "start": m.start(), "end": m.end()})
            elif tag[0] == "I" and found:
                found[-1]["end"] = m.end()
        for f in found:
            cut = text[f["start"] : f["end"]].rstrip(".") if f["entity_type"] == "PERSON" else text[f["start"] : f["end"]]
            f |= {"text": cut, "end": f["start"] + len(cut), "confidence": CONFIDENCE[f["entity_type"]], "source": "ner"}
        return found


def train(texts: list[tuple[str, list[tuple[int, int, str]]]], epochs: int = 6, seed: int = 7) -> Tagger:
    """From texts with labelled spans (start, end, type); other types than PERSON and ORG count as no name. The same for the same texts."""
    rows = []
    for text, spans in texts:
        ms = list(_WORD.finditer(text or ""))
        gold = ["O"] * len(ms)
        for a, b, kind in spans:
            inside = [i for i, m in enumerate(ms) if m.start() < b and m.end() > a] if kind in KINDS else []
            for k, i in enumerate(inside):
                gold[i] = ("B-" if k == 0 else "I-") + kind
        if ms:
            rows.append(([m[0] for m in ms], gold))
    w: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
    total: dict[tuple[str, str], float] = defaultdict(float)
    stamp: dict[tuple[str, str], int] = defaultdict(int)
    tagger, now, order = Tagger(w), 0, random.Random(seed)

    def add(f: str, t: str, x: float) -> None:
        total[f, t] += (now - stamp[f, t]) * w[f][t]
        stamp[f, t] = now
        w[f][t] += x

    for _ in range(epochs):
        order.shuffle(rows)
        for words, gold in rows:
            def learn(i: int, fs: list[str], best: str, gold: list[str] = gold) -> None:
                nonlocal now
                now += 1
                if best != gold[i]:
                    for f in fs:
                        add(f, gold[i], 1.0)
                        add(f, best, -1.0)

            tagger.tags(words, learn, gold)
    mean = {f: {t: (total[f, t] + (now - stamp[f, t]) * x) / max(now, 1) for t, x in ts.items() if x or total[f, t]} for f, ts in w.items()}
    return Tagger({f: ts for f, ts in mean.items() if ts})


def fit(labelled: DataFrame, rows: int = 20_000, epochs: int = 6) -> Tagger:
    """From a table of text and spans (array<struct<start, end, entity_type>>): the first ``rows`` texts by a keyed hash."""
    got = labelled.where(F.col("text").isNotNull()).select("text", "spans").orderBy(F.xxhash64("text"), "text").limit(rows).collect()
    return train([(r["text"], [(s["start"], s["end"], s["entity_type"]) for s in r["spans"] or []]) for r in got], epochs)


def detector(tagger: Tagger, issuers: tuple[str, ...] = ()) -> Callable[[Column, Column, Column], Column]:
    """A detector for ``pipeline.register_detector``: names the tagger recognises, as far as the rules let them stand."""
    weights = tagger.weights

    @F.pandas_udf(SPANS)  # type: ignore[call-overload]
    def run(texts: pd.Series) -> pd.Series:
        t = Tagger(weights)
        return texts.map(t.spans)

    return lambda text, context, heading: F.when(F.trim(text) != "", recognised(run(text), text, heading, issuers)).otherwise(no_spans())
