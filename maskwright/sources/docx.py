"""Word documents as a Spark data source, and their rewriting: zip and XML from the standard library, untouched parts stay byte-identical."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import escape, unescape
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "doc_id string, block_id long, location string, part string, paragraph int, text string, context string, is_heading boolean"
WARNING_SCHEMA = "doc_id string, kind string, n long, message string"
SCHEMAS = {"blocks": SCHEMA, "warnings": WARNING_SCHEMA, "glossary": "doc_id string, term string, description string"}
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
BODY_CONTEXT, TABLE_CONTEXT = 220, 200
# Properties of a document that may name people.
CORE_PROPERTIES = ("dc:creator", "cp:lastModifiedBy", "dc:title", "dc:subject", "dc:description", "cp:keywords", "cp:category", "cp:contentStatus", "dc:identifier")
APP_PROPERTIES = ("Company", "Manager")
_DELETED = re.compile(r"<w:(del|moveFrom)(?=[\s>])[^>]*(?<!/)>.*?</w:\1>", re.S)
_WRAPPER = re.compile(r"</?w:(?:ins|moveTo|hyperlink|smartTag)(?=[\s>/])[^>]*>")
_TOKEN = re.compile(r"<w:p(?=[\s>])[^>]*?(?P<single>/?)>|(?P<close></w:p>)|<w:t(?=[\s>])[^>]*(?<!/)>(?P<text>[^<]*)</w:t>|(?P<tab><w:tab/>)|(?P<br><w:br(?=[\s/])[^>]*/>)")
_TEXT_PARTS = re.compile(r"word/(?:document|header\d*|footer\d*|footnotes|endnotes|comments)\.xml$")


def accept_revisions(xml: str) -> str:
    """Insertions, moved text and links stay without their wrapper, deletions and moved-away text go; to a fixpoint."""
    while True:
        out = _WRAPPER.sub("", _DELETED.sub("", xml))
        if out == xml:
            return out
        xml = out


def _runs(xml: str) -> dict[int, list[tuple[str, int, int]]]:
    """Of each paragraph (by its number in the part) its text runs: text and place in the XML; tabs and breaks have an empty place."""
    runs: dict[int, list[tuple[str, int, int]]] = defaultdict(list)
    stack, number = [], -1
    for m in _TOKEN.finditer(xml):
        if m["close"]:
            if stack:
                stack.pop()
        elif m["text"] is not None:
            if stack:
                runs[stack[-1]].append((unescape(m["text"]), m.start("text"), m.end("text")))
        elif m["tab"] or m["br"]:
            if stack:
                runs[stack[-1]].append(("\t" if m["tab"] else "\n", -1, -1))
        else:
            number += 1
            if not m["single"]:
                stack.append(number)
    return runs


@dataclass
class Block:
    location: str
    part: str
    paragraph: int
    text: str
    context: str = ""
    is_heading: bool = False


@dataclass
class Cell:
    """A cell of a table: first column of the grid, columns it covers, whether it carries on the cell above, and its paragraphs."""

    column: int
    width: int
    continued: bool
    paragraphs: list[int] = field(default_factory=list)


class Docx:
    """One document: its parts, its blocks in reading order, and the document with edits put in."""

    def __init__(self, content: bytes) -> None:
        self.content = content
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            self.parts = {n: z.read(n) for n in z.namelist()}
        self.xml = {n: accept_revisions(b.decode("utf-8")) for n, b in self.parts.items() if _TEXT_PARTS.search(n)}
        self.runs = {n: _runs(x) for n, x in self.xml.items()}

    def _text(self, part: str, number: int) -> str:
        return "".join(t for t, _, _ in self.runs[part].get(number, ()))

    def _walk(self, part: str) -> tuple[list[tuple[int, ET.Element, bool, bool]], list[list[list[Cell]]], set[int]]:
        """Paragraphs (number, element, inside a table, inside a text box), tables as rows of cells (nested tables are tables too), and paragraphs of separator notes."""
        root = ET.fromstring(self.xml[part])
        paragraphs, tables, separators = [], [], set()
        count = -1

        def go(e: ET.Element, table: bool, box: bool, cells: list[int] | None) -> None:
            nonlocal count
            if e.tag == W + "p":
                count += 1
                paragraphs.append((count, e, table, box))
                if cells is not None and not box:
                    cells.append(count)
            if e.tag == W + "tbl":
                rows: list[list[Cell]] = []
                tables.append(rows)
                for child in e:
                    if child.tag == W + "tr":
                        row: list[Cell] = []
                        rows.append(row)
                        skip = child.find(f"{W}trPr/{W}gridBefore")
                        column = int(skip.get(W + "val", "0")) if skip is not None else 0
                        for c in child:
                            if c.tag == W + "tc":
                                wide, merge = c.find(f"{W}tcPr/{W}gridSpan"), c.find(f"{W}tcPr/{W}vMerge")
                                cell = Cell(column, int(wide.get(W + "val", "1")) if wide is not None else 1, merge is not None and merge.get(W + "val", "continue") == "continue")
                                column += cell.width
                                row.append(cell)
                                for x in c:
                                    go(x, True, box, cell.paragraphs)
                            else:
                                go(c, True, box, None)
                    else:
                        go(child, True, box, None)
                return
            first = count + 1
            for child in e:
                go(child, table, box or e.tag == W + "txbxContent", cells)
            if e.tag in (W + "footnote", W + "endnote") and e.get(W + "type") in ("separator", "continuationSeparator", "continuationNotice"):
                separators.update(range(first, count + 1))

        go(root, False, False, None)
        return paragraphs, tables, separators

    def _shown(self, part: str, rows: list[list[Cell]]) -> list[dict[int, str]]:
        """Of each row the text shown in each column of the grid: a cell over several columns or rows is shown in all of them."""
        out: list[dict[int, str]] = []
        for row in rows:
            line: dict[int, str] = {}
            for cell in row:
                text = out[-1].get(cell.column, "") if cell.continued and out else " ".join(self._text(part, n) for n in cell.paragraphs).strip()
                line.update(dict.fromkeys(range(cell.column, cell.column + cell.width), text))
            out.append(line)
        return out

    def blocks(self) -> list[Block]:
        """Body, text boxes, tables, headers and footers, notes, comments with their authors, custom properties; blank ones too."""
        out: list[Block] = []
        names = sorted(self.xml, key=lambda n: (["document", "header", "footer", "footnotes", "endnotes", "comments"].index(re.sub(r"\d", "", Path(n).stem)), n))
        for part in names:
            kind = re.sub(r"\d", "", Path(part).stem)
            where = {"document": "body", "header": "header", "footer": "footer", "footnotes": "footnote", "endnotes": "endnote", "comments": "comment"}[kind]
            paragraphs, tables, skip = self._walk(part)
            plain = [(n, e) for n, e, table, box in paragraphs if not table and not box and n not in skip]
            texts = [self._text(part, n) for n, _ in plain]
            for i, ((n, e), t) in enumerate(zip(plain, texts)):
                style = e.find(f"{W}pPr/{W}pStyle")
                heading = style is not None and bool(re.match(r"Heading|Title", style.get(W + "val", "")))
                near = [x for x in (texts[i - 1] if i else "", texts[i + 1] if i + 1 < len(texts) else "") if x.strip()]
                out.append(Block(where, part, n, t, " | ".join(near)[:BODY_CONTEXT] if kind == "document" else "", heading))
            out += [Block("text_box", part, n, self._text(part, n)) for n, _, _, box in paragraphs if box]
            for rows in tables:
                shown = self._shown(part, rows)
                for r, row in enumerate(rows):
                    for cell in row:
                        own = " ".join(self._text(part, n) for n in cell.paragraphs).strip()
                        head = shown[0].get(cell.column, "")
                        label = shown[r].get(0, "") if r else ""
                        ctx = " | ".join(x for x in dict.fromkeys((head, label)) if x and x != own)[:TABLE_CONTEXT] if kind == "document" else ""
                        out += [Block("table" if kind == "document" else where, part, n, self._text(part, n), ctx) for n in cell.paragraphs]
            if kind == "comments":
                out += [Block("comment_author", part, -1 - i, unescape(a)) for i, a in enumerate(re.findall(r'w:author="([^"]*)"', self.xml[part]))]
        custom = self.parts.get("docProps/custom.xml", b"").decode("utf-8")
        out += [Block("custom_property", "docProps/custom.xml", i, unescape(v)) for i, v in enumerate(re.findall(r"<vt:lpwstr>([^<]*)</vt:lpwstr>", custom))]
        return out

    def glossary_rows(self) -> list[tuple[str, str]]:
        """(term, description) of two-column tables with a glossary header."""
        out = []
        for rows in self._walk("word/document.xml")[1] if "word/document.xml" in self.xml else []:
            shown = self._shown("word/document.xml", rows)
            texts = [[line[c.column] for c in row] for line, row in zip(shown, rows)]
            if texts and len(texts[0]) >= 2 and texts[0][0].lower() in ("term", "terms", "term(s)") and any(x.lower() in ("description", "descriptions", "definition", "definitions", "meaning") for x in texts[0][1:]):
                out += [(r[0], r[1]) for r in texts[1:] if len(r) >= 2]
        return out

    def warnings(self) -> list[tuple[str, int, str]]:
        """Pictures and embedded objects of the body, which are not redacted."""
        xml = self.xml.get("word/document.xml", "")
        pictures, objects = len(re.findall(r"<(?:pic:pic|w:pict)(?=[\s>])", xml)), len(re.findall(r"<(?:o:OLEObject|w:object)(?=[\s>])", xml))
        out = [("image", pictures, f"{pictures} picture(s) were not examined")] if pictures else []
        return out + ([("object", objects, f"{objects} embedded object(s) were not examined")] if objects else [])

    def rewritten(self, edits: dict[tuple[str, int], list[tuple[int, int, str]]], scrub: bool = True) -> bytes:
        """The document with edits (part, paragraph) -> [(start, end, text)] in block offsets; a replacement goes into the first run it covers.

        Revisions are accepted, properties blanked; parts without change stay as they are.
        """
        new = {}
        for part, xml in self.xml.items():
            cuts: list[tuple[int, int, str]] = []
            for (p, number), todo in edits.items():
                if p != part or number < 0:
                    continue
                at = 0
                for text, a, b in self.runs[part].get(number, ()):
                    own = [(max(s, at) - at, min(e, at + len(text)) - at, f if s >= at else "") for s, e, f in todo if s < at + len(text) and e > at]
                    if own and a >= 0:
                        piece, last = "", 0
                        for s, e, f in sorted(own):
                            piece += text[last:s] + f
                            last = e
                        cuts.append((a, b, escape(piece + text[last:], quote=False)))
                    at += len(text)
            for a, b, t in sorted(cuts, reverse=True):
                xml = xml[:a] + t + xml[b:]
            authors = {-1 - n: todo[0][2] for (p, n), todo in edits.items() if p == part and n < 0 and todo}
            if authors:
                seen = iter(range(10**9))
                xml = re.sub(r'w:author="[^"]*"', lambda m: f'w:author="{escape(authors.get(next(seen), ""))}"', xml)
                xml = re.sub(r'w:initials="[^"]*"', 'w:initials=""', xml)
            if xml.encode("utf-8") != self.parts[part]:
                new[part] = xml.encode("utf-8")
        custom = self.parts.get("docProps/custom.xml")
        if custom is not None:
            seen = iter(range(10**9))

            def put(m: re.Match) -> str:
                todo = edits.get(("docProps/custom.xml", next(seen)), [])
                t = unescape(m[1])
                for s, e, f in sorted(todo, reverse=True):
                    t = t[:s] + f + t[e:]
                return f"<vt:lpwstr>{escape(t, quote=False)}</vt:lpwstr>"

            new["docProps/custom.xml"] = re.sub(r"<vt:lpwstr>([^<]*)</vt:lpwstr>", put, custom.decode("utf-8")).encode("utf-8")
        if scrub:
            for name, tags in (("docProps/core.xml", CORE_PROPERTIES), ("docProps/app.xml", APP_PROPERTIES)):
                if name in self.parts:
                    xml = self.parts[name].decode("utf-8")
                    for t in tags:
                        xml = re.sub(rf"(<{t}(?=[\s>])[^>]*>)[^<]*(</{t}>)", r"\1\2", xml)
                    new[name] = xml.encode("utf-8")
        out = io.BytesIO()
        with zipfile.ZipFile(io.BytesIO(self.content)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as to:
            for info in z.infolist():
                to.writestr(info, new.get(info.filename, self.parts[info.filename]))
        return out.getvalue()


def from_text(text: str, title: str = "Document") -> bytes:
    """A new document: a heading and one paragraph for each line."""
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, style="": f'<w:p>{style}<w:r><w:t xml:space="preserve">{escape(t, quote=False)}</w:t></w:r></w:p>'
    body = p(title, '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>') + "".join(p(line) for line in text.split("\n"))
    files = {
        "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
        "_rels/.rels": '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document {ns}><w:body>{body}</w:body></w:document>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n, x in files.items():
            z.writestr(n, x)
    return out.getvalue()


def local_files(path: str, suffix: str) -> list[str]:
    p = Path(path.removeprefix("file://"))
    return sorted(str(x) for x in (p.rglob(f"*{suffix}") if p.is_dir() else [p]))


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.what = options["path"], options.get("rows", "blocks")

    def partitions(self) -> list[InputPartition]:
        return [_File(f) for f in local_files(self.path, ".docx")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return rows_of(partition.path, Path(partition.path).read_bytes(), self.what)


def rows_of(path: str, content: bytes, what: str = "blocks") -> Iterator[tuple]:
    """Rows of one document: blocks, glossary or warnings, by :data:`SCHEMAS`."""
    d = Docx(content)
    if what == "warnings":
        yield from ((path, *w) for w in d.warnings())
    elif what == "glossary":
        yield from ((path, *g) for g in d.glossary_rows())
    else:
        for i, b in enumerate(d.blocks()):
            yield path, i, b.location, b.part, b.paragraph, b.text, b.context, b.is_heading


class DocxSource(DataSource):
    """``spark.read.format("docx").load(path)``: one partition per file on a file system all executors share; option rows: blocks, glossary or warnings.

    :func:`..readers.read_docx` reads from any file system that Spark knows.
    """

    @classmethod
    def name(cls) -> str:
        return "docx"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("rows", "blocks")]

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.options)
