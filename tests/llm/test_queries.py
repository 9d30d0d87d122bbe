"""The registered queries on odd tables: empty ones, nulls everywhere, repeated rows, clashing extra columns, and equal results under another partitioning."""

import pytest
from pyspark.sql import functions as F

from maskwright.llm import queries as q

SCHEMAS = {
    "pii_match": "match_id long, filing_id string, block_id long, entity_type string, text string, start_pos int, end_pos int, confidence double, source string",
    "real_sample": "id int, stratum string, context string, text string, batch_no int",
    "residual_finding": "finding_id long, filing_id string, kind string, entity_type string, text string, location string",
    "documents": "doc_id long, text string, lang string, source string",
    "eval_item": "item_id long, task string, text string",
    "mix_target": "source string, target_share double, max_repeats int",
    "lang_sample": "lang string, text string",
}
ROWS = {
    "pii_match": [(1, "f", 0, "ADDRESS", "Shop 3, 9 Other Road, Teluvari 614001", 0, 5, 0.9, "ner"), (2, "f", 0, "ADDRESS", "SHOP 3, No. 9 Other Rd, Teluvari", 0, 5, None, None), (3, "f", 1, "PERSON", "Asha Rao", 0, 8, 0.8, "ner"), (4, "f", 1, "ORG", "Rao, Asha", 0, 8, 0.8, None), (5, None, None, None, None, None, None, None, None), (6, "f", 2, "PERSON", "", 0, 0, 0.5, "")],
    "real_sample": [(1, "dense", None, "Tel: +91 12345 67890 | E-mail: a@b.example"), (2, " Dense", "", "E-mail - a@b.example; Tel - +91 12345 67890"), (3, None, None, None), (None, None, None, None), (4, "prose", "", ""), (5, "prose", "", "Café ​text"), (6, "prose", "", "Café text")],
    "residual_finding": [(100, "f", "leaked", "PERSON", "A. Rao", None), (101, None, None, None, None, None)],
    "documents": [(1, "The inner loop controls the signal. We show the results of the model.", None, "big"), (2, None, None, None), (3, "", "", ""), (None, "x", "en", "big")],
    "eval_item": [(1, "t", "The inner loop controls the signal and the outer loop shows nothing at all."), (2, None, None)],
    "mix_target": [("big", 1.0, 1), (None, None, None)],
    "lang_sample": [("en", "The inner loop controls the signal in the field."), ("de", "Wir zeigen, dass die Kurve sinkt."), (None, None)],
}


def _write(spark, path, empty=False, odd=False):
    for name, schema in SCHEMAS.items():
        n = len(schema.split(","))
        rows = [] if empty else [(*r, *[None] * (n - len(r))) for r in ROWS[name]]
        df = spark.createDataFrame(rows + rows, schema)
        if odd:
            df = df.withColumn("k", F.lit("k")).withColumn("t", F.lit(1)).withColumn("node", F.lit(2)).withColumn("first", F.lit(3)).repartition(5)
        df.write.parquet(f"{path}/{name}.parquet")
    return str(path)


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_empty_tables(spark, tmp_path_factory, name):
    if not hasattr(test_empty_tables, "path"):
        test_empty_tables.path = _write(spark, tmp_path_factory.mktemp("empty"), empty=True)
    rows = q.queries()[name](spark, test_empty_tables.path).collect()
    assert rows == []


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_nulls_repeats_and_clashing_columns(spark, tmp_path_factory, name):
    f = test_nulls_repeats_and_clashing_columns
    if not hasattr(f, "paths"):
        f.paths = _write(spark, tmp_path_factory.mktemp("one")), _write(spark, tmp_path_factory.mktemp("two"), odd=True)
    one, two = (sorted(map(repr, q.queries()[name](spark, p).collect())) for p in f.paths)
    assert one == two
    if name.endswith("_found"):
        assert len(one) == len(set(one))
    expected = {"p1_found": 1, "p3_found": 3, "p5_found": 2, "p6_found": 1, "p9_found": 1}
    if name in expected:
        assert len(one) == expected[name], one
