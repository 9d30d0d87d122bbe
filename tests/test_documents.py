import io
import json
import zipfile

from pyspark.sql import functions as F

from maskwright.cli import run
from maskwright.functions.vocab import DetectionConfig
from maskwright.sources.docx import Docx, accept_revisions, from_text
from maskwright.sources.readers import read

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:pic="p"'
R = lambda t: f'<w:r><w:t xml:space="preserve">{t}</w:t></w:r>'
P = lambda *r: "<w:p>" + "".join(r) + "</w:p>"


def _docx(body, **parts):
    base = from_text("", "x")
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(base)) as z, zipfile.ZipFile(out, "w") as to:
        for n in z.namelist():
            to.writestr(n, f"<?xml version='1.0'?><w:document {NS}><w:body>{body}</w:body></w:document>" if n == "word/document.xml" else z.read(n))
        for n, x in parts.items():
            to.writestr(n.replace("__", "/").replace("_xml", ".xml"), x)
    return out.getvalue()


def _full():
    table = "<w:tbl><w:tr><w:tc>" + P(R("Term")) + "</w:tc><w:tc>" + P(R("Meaning")) + "</w:tc></w:tr><w:tr><w:tc>" + P(R("Equity Shares")) + "</w:tc><w:tc>" + P(R("shares")) + "</w:tc></w:tr></w:tbl>"
    dob = "<w:tbl><w:tr><w:tc>" + P(R("Name")) + "</w:tc><w:tc>" + P(R("Date of Birth")) + "</w:tc></w:tr><w:tr><w:tc>" + P(R("Rohan Dey")) + "</w:tc><w:tc>" + P(R("14 March 1985")) + "</w:tc></w:tr></w:tbl>"
    box = "<w:p><w:r><w:pict><w:txbxContent>" + P(R("box a.b@c.org")) + "</w:txbxContent></w:pict></w:r>" + R("after") + "</w:p>"
    body = (
        '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr>' + R("Capital Structure") + "</w:p>"
        + P(R("Write to rashi."), R("patil@exam"), R("ple.com &amp; more"))
        + P("<w:ins w:id='1'>" + R("new x@y.org") + "</w:ins><w:del w:id='2'><w:r><w:delText>old</w:delText></w:r></w:del><w:moveFrom w:id='3'>" + R("gone z@z.org") + "</w:moveFrom>")
        + table + dob + box + "<w:p><w:r><pic:pic/></w:r></w:p>"
    )
    notes = f"<w:footnotes {NS}><w:footnote w:type='separator' w:id='0'>{P(R('sep'))}</w:footnote><w:footnote w:id='1'>{P(R('note SSN 219-09-9999'))}</w:footnote></w:footnotes>"
    comments = f'<w:comments {NS}><w:comment w:id="1" w:author="Jane Roe" w:initials="JR">{P(R("ask a@b.org"))}</w:comment></w:comments>'
    custom = "<Properties><property name='x'><vt:lpwstr>mail q@r.org</vt:lpwstr></property></Properties>"
    core = "<cp:coreProperties><dc:creator>Jane Roe</dc:creator></cp:coreProperties>"
    return _docx(body, word__footnotes_xml=notes, word__comments_xml=comments, docProps__custom_xml=custom, docProps__core_xml=core)


def test_blocks_of_all_places():
    blocks = Docx(_full()).blocks()
    by = {}
    for b in blocks:
        by.setdefault(b.location, []).append(b)
    assert [b.text for b in by["body"]][:3] == ["Capital Structure", "Write to rashi.patil@example.com & more", "new x@y.org"]
    assert by["body"][0].is_heading and by["body"][1].context == "Capital Structure | new x@y.org"
    assert [b.text for b in by["text_box"]] == ["box a.b@c.org"] and [b.text for b in by["footnote"]] == ["note SSN 219-09-9999"]
    assert next(b for b in by["table"] if b.text == "14 March 1985").context == "Date of Birth | Rohan Dey"
    assert [b.text for b in by["comment_author"]] == ["Jane Roe"] and [b.text for b in by["custom_property"]] == ["mail q@r.org"]
    d = Docx(_full())
    assert d.glossary_rows() == [("Equity Shares", "shares")] and [w[0] for w in d.warnings()] == ["image"]


def test_revisions():
    assert accept_revisions("<w:ins a='1'><w:hyperlink>x</w:hyperlink></w:ins><w:del b='2'>y</w:del>") == "x"


def test_edit_over_runs_keeps_other_parts():
    content = _docx(P(R("a "), R("bc"), R("d")), word__other_xml="<x/>")
    new = Docx(content).rewritten({("word/document.xml", 0): [(1, 4, "<Z>")]})
    assert Docx(new).blocks()[0].text == "a<Z>d"
    with zipfile.ZipFile(io.BytesIO(new)) as z:
        assert z.read("word/other.xml") == b"<x/>"


def test_command_line_flow(spark, tmp_path):
    src = tmp_path / "in.docx"
    src.write_bytes(_full())
    got = run(spark, str(src), str(tmp_path / "out"), DetectionConfig(), audit=str(tmp_path / "audit"))
    new = (tmp_path / "out" / "in.redacted.docx").read_bytes()
    with zipfile.ZipFile(io.BytesIO(new)) as z:
        everything = "".join(z.read(n).decode() for n in z.namelist() if n.endswith(".xml"))
    for secret in ("rashi", "x@y.org", "a.b@c.org", "219-09-9999", "Jane Roe", "q@r.org", "14 March 1985", "z@z.org"):
        assert secret not in everything, secret
    assert got["residual_scan"]["clean"] and got["by_type"]["EMAIL"] >= 4 and got["warnings"] and got["documents"] == 1
    rows = [json.loads(x) for f in (tmp_path / "audit").glob("*.json") for x in f.read_text().splitlines()]
    assert len(rows) == got["replacements"] and any(r["source"] == "metadata" and r["confidence_tier"] == "high" for r in rows)


def test_text_source(spark, tmp_path):
    f = tmp_path / "a.txt"
    f.write_bytes(b"mail me@x.org\xff now\nline 2")
    assert read(spark, str(f)).select("text").first()[0] == "mail me@x.org now\nline 2"
    got = run(spark, str(f), str(tmp_path / "out"), DetectionConfig(), verify=False)
    assert got["replacements"] == 1 and Docx((tmp_path / "out" / "a.redacted.docx").read_bytes()).blocks()[2].text == "line 2"


def test_stream_equals_batch(spark, tmp_path):
    from maskwright.streaming import read_blocks, redacted_stream, windowed_counts

    rows = [("d", i, f"mail u{i}@x.org and 219-09-9999") for i in range(5)]
    schema = "doc_id string, block_id long, text string"
    df = spark.createDataFrame(rows, schema)
    df.write.parquet(str(tmp_path / "in"))
    q = redacted_stream(read_blocks(spark, str(tmp_path / "in"), schema)).select("block_id", "redacted").writeStream.format("memory").queryName("red").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    stream = {(r.block_id, r.redacted) for r in spark.table("red").collect()}
    assert stream == {(r.block_id, r.redacted) for r in redacted_stream(df).collect()} and len(stream) == 5
    ev = spark.sql("select timestamp'2024-01-01 10:10:00' ts, 'a' event_type union all select timestamp'2024-01-01 10:50:00', 'a' union all select null, 'b'")
    assert [(r.event_type, r.n) for r in windowed_counts(ev).collect()] == [("a", 2)]
    assert F is not None


def _cell(t, *props):
    return "<w:tc><w:tcPr>" + "".join(props) + "</w:tcPr>" + P(R(t)) + "</w:tc>"


def test_merged_cells_keep_their_columns():
    row = lambda *c: "<w:tr>" + "".join(c) + "</w:tr>"
    span, first, on = '<w:gridSpan w:val="2"/>', '<w:vMerge w:val="restart"/>', "<w:vMerge/>"
    table = "<w:tbl>" + row(_cell("Name", span), _cell("Date of Birth"), _cell("City")) + row(_cell("Rohan", first), _cell("Dey"), _cell("14 March 1985"), _cell("Pune")) + row(_cell("", on), _cell("Rao"), _cell("2 May 1990"), _cell("Goa")) + "</w:tbl>"
    by = {b.text: b.context for b in Docx(_docx(table)).blocks() if b.location == "table"}
    assert by["14 March 1985"] == "Date of Birth | Rohan" and by["2 May 1990"] == "Date of Birth | Rohan" and by["Pune"] == "City | Rohan" and by["Dey"] == "Name | Rohan" and by["City"] == "Name" or by["City"] == ""
    assert [b.text for b in Docx(_docx(table)).blocks() if b.location == "table"].count("Rohan") == 1


def test_folder_of_documents(spark, tmp_path):
    for d in ("a", "b"):
        (tmp_path / "in" / d).mkdir(parents=True)
        (tmp_path / "in" / d / "same.docx").write_bytes(_docx(P(R(f"mail {d}@x.org"))))
    (tmp_path / "in" / "a" / "same.txt").write_text("Contact Person: Asha Rao, of the office.\nASHA RAO signed")
    (tmp_path / "in" / "b" / "note.md").write_text("not a document")
    got = run(spark, str(tmp_path / "in"), str(tmp_path / "out"), DetectionConfig(), audit=str(tmp_path / "audit"))
    files = sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*") if p.is_file())
    assert files == ["a/same.docx.redacted.docx", "a/same.txt.redacted.docx", "b/same.docx.redacted.docx"]
    assert got["documents"] == 3 and got["by_type"] == {"EMAIL": 2, "PERSON": 2} and got["residual_scan"]["clean"]
    text = [b.text for b in Docx((tmp_path / "out" / "a" / "same.txt.redacted.docx").read_bytes()).blocks()]
    assert "asha" not in " ".join(text).lower()  # the name in capitals is found by the sweep
    assert json.loads("".join(f.read_text() for f in (tmp_path / "audit" / "summary").glob("*.txt")))["replacements"] == 4
    import pytest

    with pytest.raises(ValueError, match="no reader|no document"):
        run(spark, str(tmp_path / "in" / "b" / "note.md"), str(tmp_path / "out2"), DetectionConfig())


def test_scan_reads_the_finished_file(spark, tmp_path, monkeypatch):
    """A writer that leaves an original in the file is seen, though the frame is right."""
    src = tmp_path / "in.docx"
    src.write_bytes(_docx(P(R("mail asha@x.org now"))))
    from maskwright import cli

    true = cli.write_documents

    def faulty(result, contents, out_dir, root=None):
        return true(type(result)(result.redacted, result.replacements.where("false"), result.spans), contents, out_dir, root)

    monkeypatch.setattr(cli, "write_documents", faulty)
    got = run(spark, str(src), str(tmp_path / "out"), DetectionConfig())
    assert not got["residual_scan"]["clean"] and got["residual_scan"]["leaked"] == 1 and got["residual_scan"]["by_type"]["EMAIL"] >= 1


def test_pdf_without_library_says_so(spark, tmp_path):
    import importlib.util

    import pytest

    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4")
    if importlib.util.find_spec("pypdf") is None:
        with pytest.raises(Exception, match="pypdf"):
            read(spark, str(tmp_path / "a.pdf")).collect()
