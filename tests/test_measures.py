import json
import random

from pyspark.sql import functions as F

from maskwright.functions.vocab import DetectionConfig
from maskwright.operators import tagger
from maskwright.plans import measures, pipeline

GIVEN, FAMILY = ["Asha", "Rohan", "Meera", "Vikram", "Nandini", "Farah"], ["Tendrubov", "Reivtugas", "Bannuvos", "Krerpomez", "Seigdruzir"]
FIRMS = ["Amber Tools", "Bluepeak Foods", "Cedarway Steel", "Oakhaven Motors"]
LINES = ["The board thanked {p} for the work of the year.", "{p} joined {o} in June.", "Shares of {o} were sold to {p} by the trustee.", "Nothing was said of the price.", "In 2019 {o} closed its plant at the Lake.", "The Offer was signed by {p}."]


def _texts(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        line, spans = rng.choice(LINES), []
        for mark, kind in (("{p}", "PERSON"), ("{o}", "ORG")):
            if mark in line:
                name = f"{rng.choice(GIVEN)} {rng.choice(FAMILY)}" if kind == "PERSON" else rng.choice(FIRMS)
                at = line.index(mark)
                line = line.replace(mark, name)
                spans = [(a + len(name) - 3, b + len(name) - 3, k) if a > at else (a, b, k) for a, b, k in spans] + [(at, at + len(name), kind)]
        out.append((line, sorted(spans)))
    return out


def test_tagger_on_held_out_texts_and_as_detector(spark):
    t = tagger.train(_texts(300, 1))
    hit = total = wrong = 0
    for text, gold in _texts(100, 2):
        got = {(s["start"], s["end"], s["entity_type"]) for s in t.spans(text)}
        hit, total, wrong = hit + len(got & set(gold)), total + len(gold), wrong + len(got - set(gold))
    assert hit > 0.95 * total and wrong < 0.05 * total
    assert t.spans(None) == [] and t.spans("") == [] and t.spans(" ,") == []
    same = tagger.fit(spark.createDataFrame([(x, [{"start": a, "end": b, "entity_type": k} for a, b, k in s]) for x, s in _texts(300, 1)], "text string, spans array<struct<start: int, end: int, entity_type: string>>"))
    pipeline.register_detector("ner", tagger.detector(same))
    try:
        b = spark.createDataFrame([("d", 0, "The board thanked Meera Bannuvos for the work of the year."), ("d", 1, None), ("d", 2, "")], "doc_id string, block_id long, text string")
        assert [(r.entity_type, r.text, r.source) for r in pipeline.spans_of(pipeline.detect(b)).collect()] == [("PERSON", "Meera Bannuvos", "ner")]
    finally:
        pipeline.unregister_detector("ner")


def test_measures_of_a_labelled_sample(spark, tmp_path):
    sample = [
        {"id": 0, "stratum": "dense", "context": "", "text": "Contact Person: Asha Rao, Tel: +91 98765 43210, or Asha Rao"},
        {"id": 1, "stratum": "prose", "context": None, "text": "Write to a.b@c.org. See the ledger."},
        {"id": 2, "stratum": "prose", "context": "", "text": "Missed: Somebody Unknown"},
    ]
    labels = {"_about": ["by hand"], "labels": [{"id": 0, "type": "PERSON", "value": "Asha Rao"}, {"id": 0, "type": "PERSON", "value": "Asha Rao"}, {"id": 0, "type": "PHONE", "value": "+91 98765 43210"}, {"id": 1, "type": "EMAIL", "value": "a.b@c.org"}, {"id": 2, "type": "PERSON", "value": "Somebody Unknown"}]}
    (tmp_path / "sample.json").write_text(json.dumps(sample))
    (tmp_path / "labels.json").write_text(json.dumps(labels))
    got = measures.run(spark, str(tmp_path / "sample.json"), str(tmp_path / "labels.json"), DetectionConfig(), str(tmp_path / "out"))
    assert (got["totals"]["tp"], got["totals"]["fp"], got["totals"]["fn"]) == (4, 0, 1)
    assert list(got["per_type"]) == ["EMAIL", "PERSON", "PHONE"] and got["per_type"]["PERSON"]["recall"] == round(2 / 3, 6) and got["per_stratum"]["dense"]["recall"] == 1.0 and got["labels"] == {"EMAIL": 1, "PERSON": 3, "PHONE": 1}
    assert json.loads("".join(p.read_text() for p in (tmp_path / "out").glob("*.txt"))) == got
    (tmp_path / "corpus.txt").write_text("Mail a.b@c.org\nnow")
    (tmp_path / "gold.json").write_text(json.dumps([{"start": 5, "end": 14, "type": "EMAIL", "text": "a.b@c.org"}]))
    got = measures.run(spark, str(tmp_path / "corpus.txt"), str(tmp_path / "gold.json"))
    assert got["totals"]["f1"] == 1.0
    assert F is not None
