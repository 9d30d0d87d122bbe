import re

import pytest
from pyspark.sql import functions as F

from maskwright.functions import spans
from maskwright.functions.vocab import DetectionConfig
from maskwright.operators import structured
from maskwright.plans.pipeline import detect, detected, spans_of

CASES = [
    # type, text, context, expected texts
    ("EMAIL", "Contact rashi.patil@example.com for details.", "", ["rashi.patil@example.com"]),
    ("EMAIL", "This costs 5.00@ per unit, not an email.", "", []),
    ("PHONE", "Call +91 9876543210 for support.", "", ["+91 9876543210"]),
    ("PHONE", "Order #45678 was shipped.", "", []),
    ("PHONE", "SEBI Registration no.: INM000013004", "", []),
    ("SSN", "SSN 219-09-9999.", "", ["219-09-9999"]),
    ("SSN", "not 666-12-3456, 000-12-3456, 900-12-3456, 123-00-1234, 123-12-0000", "", []),
    ("CREDIT_CARD", "Card 4532015112830366 on file", "", ["4532015112830366"]),
    ("CREDIT_CARD", "Card 1234567890123456", "", []),
    ("IP_ADDRESS", "from 192.168.1.104 today", "", ["192.168.1.104"]),
    ("IP_ADDRESS", "999.999.999.999", "", []),
    ("DATE_OF_BIRTH", "14 March 1985", "Date of Birth | Rohan Dey", ["14 March 1985"]),
    ("DATE_OF_BIRTH", "12 January 2024", "Board Meeting | Approval", []),
    ("DATE_OF_BIRTH", "He was born on 1985-03-14.", "", ["1985-03-14"]),
    ("PAN_NUMBER", "PAN: ABCDE1234F", "", ["ABCDE1234F"]),
    ("AADHAAR_NUMBER", "Aadhaar 1234 5678 9012", "", ["1234 5678 9012"]),
    ("IFSC_CODE", "HDFC0001234", "", ["HDFC0001234"]),
    ("IFSC_CODE", "ABCD1234567", "", []),
    ("GSTIN", "27AAAPL1234C1Z5", "", ["27AAAPL1234C1Z5"]),
    ("GSTIN", "271234AAAAC1Z5X", "", []),
    ("UPI_ID", "pay rohan.dey@okhdfcbank or 9876543210@ybl", "", ["rohan.dey@okhdfcbank", "9876543210@ybl"]),
    ("UPI_ID", "meet@noon, rohan.dey@gmail.com", "", []),
    ("PASSPORT_NUMBER", "Passport No M1234567", "", ["M1234567"]),
    ("PASSPORT_NUMBER", "Reference M1234567", "", []),
    ("VOTER_ID", "Voter ID ABC1234567", "", ["ABC1234567"]),
    ("VOTER_ID", "Batch ABC1234567", "", []),
    ("DRIVING_LICENSE", "Driving Licence No: MH12 20110012345 valid.", "", ["MH12 20110012345"]),
    ("DRIVING_LICENSE", "Batch MH12 20110012345 was processed.", "", []),
    ("BANK_ACCOUNT_NUMBER", "Account No: 123456789012", "", ["123456789012"]),
    ("BANK_ACCOUNT_NUMBER", "Order number 123456789012", "", []),
    ("ADDRESS", "The office is situated at 11/3, Village Birdewadi, Pune - 410 501, Maharashtra", "", ["11/3, Village Birdewadi, Pune - 410 501, Maharashtra", "The office is situated at 11/3, Village Birdewadi, Pune - 410 501, Maharashtra"]),
    ("ADDRESS", "Plot No. J-25, Sector 5, Navi Mumbai 400701", "Registered Office", ["Plot No. J-25, Sector 5, Navi Mumbai 400701"]),
    ("ADDRESS", "Changes to the registered office require a resolution.", "", []),
    ("PERSON", "Contact Person: Manisha Shukla Website: www.example.com", "", ["Manisha Shukla"]),
    ("ORG", "advised by Kirtane & Pandit LLP on tax", "", ["Kirtane & Pandit LLP"]),
    ("ORG", "(Formerly Link Time India Private Limited)", "", ["Link Time India Private Limited"]),
]


def test_each_detector(spark):
    rows = [(str(i), 0, t, c) for i, (_, t, c, _) in enumerate(CASES)]
    src = spark.createDataFrame(rows, "doc_id string, block_id long, text string, context string")
    df = src.withColumn("spans", detected(F.col("text"), F.col("context"), F.lit(False), DetectionConfig()))
    got = {}
    for r in df.select("doc_id", F.explode(F.col("spans")).alias("s")).select("doc_id", "s.entity_type", "s.text").collect():
        got.setdefault((int(r[0]), r[1]), []).append(r[2])
    for i, (kind, text, _, expected) in enumerate(CASES):
        assert got.get((i, kind), []) == expected, (kind, text, got.get((i, kind)))


@pytest.mark.parametrize("pattern", [structured.EMAIL, structured.PHONE, structured.SSN, structured.CARD, structured.PAN, structured.ACCOUNT, structured.UPI])
def test_offsets_equal_python(spark, pattern):
    texts = ["", "a@b.co, c@d.org", "😀 tel +91 98765 43210, 219-09-9999;4532 0151 1283 0366 ", "naïve é́ x@y.in ABCDE1234F", "１２３ 123456789012 x", "12:30:45 and " * 20 + "q.r@s.tu"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.explode(spans.matches(F.col("t"), pattern)).alias("m"))
    got = {(r.i, r.m.start, r.m.end, r.m.text) for r in df.collect()}
    p = re.compile(pattern.replace("(?U)", ""))
    want = {(i, m.start(), m.end(), m[0]) for i, t in enumerate(texts) for m in p.finditer(t)}
    assert got == want


def test_nulls_blanks_and_clashing_columns(spark):
    df = spark.createDataFrame([("d", 0, None, 1), ("d", 1, "", 2), ("d", 2, "  ", 3), (None, 3, "a@b.co", 4)], "doc_id string, block_id long, text string, spans_extra int")
    rows = detect(df).orderBy("block_id").collect()
    assert [len(r.spans) for r in rows] == [0, 0, 0, 1]


def test_disabled_types(spark):
    df = spark.createDataFrame([("d", 0, "a@b.co 219-09-9999")], "doc_id string, block_id long, text string")
    got = spans_of(detect(df, DetectionConfig(disabled=frozenset({"EMAIL"})))).collect()
    assert [r.entity_type for r in got] == ["SSN"]
    with pytest.raises(ValueError):
        DetectionConfig(disabled=frozenset({"NOPE"}))


def test_email_queries_over_stored_texts(spark, tmp_path):
    import re

    from maskwright.operators import structured
    from maskwright.plans.queries import Q

    texts = {1: "Écrire à a.b@c.org, señor", 2: "éa.b@c.orgé und x@y.de", 3: "日本 m@n.example\U0001f600", 4: "none"}
    spark.createDataFrame([(k, t) for k, t in texts.items()], "id long, text string").write.parquet(str(tmp_path / "real_sample.parquet"))
    p = re.compile(structured.EMAIL.replace("(?U)", ""))
    got = {(r.rec_id, r.span, r.start_pos) for r in Q["x1_email_stored"](spark, str(tmp_path)).collect()}
    assert got == {(k, m[0], m.start()) for k, t in texts.items() for m in p.finditer(t)} and len(got) > 2
    assert {r.id: r.redacted for r in Q["g2_redact_email_stored"](spark, str(tmp_path)).collect()} == {k: p.sub("[EMAIL]", t) for k, t in texts.items()}
