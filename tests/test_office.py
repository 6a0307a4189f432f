"""Office files put together by hand: spans, nested tables, groups, notes, kinds of cells, bombs and broken files."""

import io
import zipfile

from pyspark.sql import functions as F

from fernweave.functions import office
from fernweave.jobs.extracting import packed

W, P = 'xmlns:w="http://x/w"', 'xmlns:a="http://x/a" xmlns:p="http://x/p" xmlns:r="http://x/r"'
RELS = '<Relationships xmlns="http://x/q">{}</Relationships>'


def run(parts, extension, **more):
    return office.read(packed(parts), extension, **more)


def para(text):
    return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


def cell(text, properties=""):
    return f"<w:tc><w:tcPr>{properties}</w:tcPr>{para(text)}</w:tc>"


def test_word():
    inner = f"<w:tbl><w:tr>{cell('inner')}</w:tr></w:tbl>"
    rows = f"<w:tr>{cell('wide', '<w:gridSpan w:val=\"2\"/>')}{cell('tall', '<w:vMerge w:val=\"restart\"/>')}</w:tr><w:tr>{cell('a')}<w:tc>{para('b')}{para('c')}{inner}</w:tc>{cell('', '<w:vMerge/>')}</w:tr><w:tr>{cell('')}{cell(' ')}</w:tr>"
    body = f"<w:p><w:pPr><w:tabs><w:tab w:val=\"left\" w:pos=\"720\"/></w:tabs></w:pPr><w:r><w:t>one</w:t><w:tab/><w:t>two</w:t><w:br/></w:r></w:p><w:tbl>{rows}</w:tbl>{para('  ')}{para('last &amp; least')}"
    got = run({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"}, ".docx")
    assert got == {"text": "one\ttwo\n\n\nlast & least\n\nwide | wide | tall\n\na | b\nc | tall", "status": "ok", "error": None, "truncated": False}


def test_slides():
    shape = "<p:sp><p:txBody><a:p><a:r><a:t>{}</a:t></a:r><a:r><a:t> more</a:t></a:r></a:p><a:p/></p:txBody></p:sp>"
    table = "<p:graphicFrame><a:tbl><a:tr><a:tc><a:txBody><a:p><a:r><a:t>x</a:t></a:r></a:p></a:txBody></a:tc><a:tc><a:txBody><a:p/></a:txBody></a:tc></a:tr></a:tbl></p:graphicFrame>"
    slide = f"<p:sld {P}><p:spTree>{shape.format('first')}<p:grpSp>{shape.format('grouped')}</p:grpSp>{table}</p:spTree></p:sld>"
    notes = f'<p:notes {P}><p:sp><p:ph type="sldNum"/><a:p><a:r><a:t>9</a:t></a:r></a:p></p:sp><p:sp><p:ph type="body"/><a:p><a:r><a:t>say</a:t></a:r></a:p><a:p><a:r><a:t>this</a:t></a:r></a:p></p:sp></p:notes>'
    parts = {
        "ppt/presentation.xml": f'<p:presentation {P}><p:sldId id="1" r:id="rB"/><p:sldId id="2" r:id="rA"/><p:sldId id="3" r:id="none"/></p:presentation>',
        "ppt/_rels/presentation.xml.rels": RELS.format('<Relationship Id="rA" Type="t/slide" Target="slides/a.xml"/><Relationship Id="rB" Type="t/slide" Target="/ppt/slides/b.xml"/>'),
        "ppt/slides/a.xml": slide,
        "ppt/slides/b.xml": f"<p:sld {P}/>",
        "ppt/slides/_rels/a.xml.rels": RELS.format('<Relationship Id="n" Type="t/notesSlide" Target="../notes/n.xml"/>'),
        "ppt/notes/n.xml": notes,
    }
    assert run(parts, ".PPTX")["text"] == "# Slide 2\nfirst more\nx | \nNotes: say\nthis"


def test_sheets():
    cells = '<c t="s"><v>1</v></c><c><v>3</v></c><c><v>2.50</v></c><c t="b"><v>1</v></c><c t="e"><v>#DIV/0!</v></c><c s="1"><v>45292.5</v></c><c s="2"><v>0.25</v></c><c t="str"><f>A1</f><v> formula </v></c><c/><c t="inlineStr"><is><t>in</t></is></c><c s="3"><v>7</v></c>'
    parts = {
        "xl/workbook.xml": '<workbook xmlns="http://x/m" xmlns:r="http://x/r"><sheets><sheet name="S &amp; T" r:id="r2"/><sheet name="empty" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": RELS.format('<Relationship Id="r1" Type="t/worksheet" Target="worksheets/1.xml"/><Relationship Id="r2" Type="t/worksheet" Target="worksheets/2.xml"/>'),
        "xl/sharedStrings.xml": '<sst xmlns="http://x/m"><si><t>no</t></si><si><r><t>rich</t></r><r><t> text</t></r><rPh><t>spoken</t></rPh></si></sst>',
        "xl/styles.xml": '<styleSheet xmlns="http://x/m"><numFmts><numFmt numFmtId="164" formatCode="yyyy&quot;m&quot;"/><numFmt numFmtId="165" formatCode="0.0&quot;days&quot;"/></numFmts><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="21"/><xf numFmtId="165"/></cellXfs></styleSheet>',
        "xl/worksheets/1.xml": '<worksheet xmlns="http://x/m"><sheetData><row/></sheetData></worksheet>',
        "xl/worksheets/2.xml": f'<worksheet xmlns="http://x/m"><sheetData><row>{cells}</row><row/>{"<row><c><v>1</v></c></row>" * (office.MOST_ROWS + 5)}</sheetData></worksheet>',
    }
    lines = run(parts, ".xlsx")["text"].split("\n")
    assert lines[:2] == ["# Sheet: S & T", "rich text | 3 | 2.5 | True | #DIV/0! | 2024-01-01 12:00:00 | 06:00:00 | formula | in | 7"]
    assert len(lines) == 2 + office.MOST_ROWS - 2


def test_budget_and_refusals():
    long = {"word/document.xml": f"<w:document {W}>{para('x' * 600)}{para('y' * 600)}</w:document>"}
    got = run(long, ".docx", most_chars=700)
    assert got["truncated"] and got["text"] == "x" * 600 + "\n\n" + "y" * 98
    assert run(long, ".docx", most_expanded=500)["status"] == "too_large"
    assert office.read(b"PK nothing", ".docx")["status"] == "error" and office.read(None, ".docx")["status"] == "empty"
    assert office.read(b"x", ".odt")["status"] == "unsupported" and office.read(b"x", None)["status"] == "unsupported"
    assert run({"word/document.xml": "<w:document"}, ".docx")["status"] == "error"
    assert run({"other": ""}, ".docx")["status"] == "empty"
    assert run({"xl/workbook.xml": "<a/>"}, ".xlsx")["status"] == "empty"


def test_a_container_that_lies():
    """A part that says it has 100 bytes and has a million."""
    raw = packed({"word/document.xml": f"<w:document {W}>{para('z' * 1_000_000)}</w:document>"})
    size = zipfile.ZipFile(io.BytesIO(raw)).getinfo("word/document.xml").file_size.to_bytes(4, "little")
    assert raw.count(size) == 2
    got = office.read(raw.replace(size, (100).to_bytes(4, "little")), ".docx", most_expanded=1000)
    assert got["status"] in ("too_large", "error") and got["text"] == ""


def test_in_spark(spark):
    raw = packed({"word/document.xml": f"<w:document {W}>{para('hello')}</w:document>"})
    df = spark.createDataFrame([(bytearray(raw), ".docx"), (None, ".docx"), (bytearray(b"no"), ".pptx")], "raw binary, extension string")
    assert [(r.f.text, r.f.status) for r in df.select(office.office_text(F.col("raw"), F.col("extension")).alias("f")).collect()] == [("hello", "ok"), ("", "empty"), ("", "error")]
