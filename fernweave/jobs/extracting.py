"""Registered queries: text of office files that are made of the given documents."""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import functions as F

from ..functions import office
from ..sources.corpus import table
from .queries import query

#: Every 40th file expands to more than the limit.
LIMIT, BOMB = 4 << 20, 40
_ODD = re.compile("[^\t\n\x20-퟿-�\U00010000-\U0010ffff]")
_RELATION = '<Relationship Id="r{}" Type="http://x/{}" Target="{}"/>'


def _relations(rows: list[tuple[int, str, str]]) -> str:
    return '<Relationships xmlns="http://x/package">' + "".join(_RELATION.format(*r) for r in rows) + "</Relationships>"


def _word(lines: list[str], doc_id: int) -> dict[str, str]:
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in lines)
    body += f"<w:tbl><w:tr><w:tc><w:p><w:r><w:t>id</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>{doc_id}</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    return {"word/document.xml": f'<w:document xmlns:w="http://x/w"><w:body>{body}</w:body></w:document>'}


def _slides(lines: list[str], doc_id: int) -> dict[str, str]:
    """A slide a line, the number of the line as a note of every third one."""
    head = 'xmlns:a="http://x/a" xmlns:p="http://x/p" xmlns:r="http://x/r"'
    text = lambda x: f"<p:txBody><a:p><a:r><a:t>{escape(x)}</a:t></a:r></a:p></p:txBody>"
    out = {"ppt/presentation.xml": f"<p:presentation {head}><p:sldIdLst>" + "".join(f'<p:sldId id="{256 + k}" r:id="r{k}"/>' for k in range(len(lines))) + "</p:sldIdLst></p:presentation>"}
    out["ppt/_rels/presentation.xml.rels"] = _relations([(k, "slide", f"slides/slide{k}.xml") for k in range(len(lines))])
    for k, x in enumerate(lines):
        out[f"ppt/slides/slide{k}.xml"] = f"<p:sld {head}><p:cSld><p:spTree><p:sp>{text(x)}</p:sp></p:spTree></p:cSld></p:sld>"
        if k % 3 == 0:
            out[f"ppt/slides/_rels/slide{k}.xml.rels"] = _relations([(1, "notesSlide", f"../notes/n{k}.xml")])
            out[f"ppt/notes/n{k}.xml"] = f'<p:notes {head}><p:cSld><p:spTree><p:sp><p:nvPr><p:ph type="body"/></p:nvPr>{text(f"line {k}")}</p:sp></p:spTree></p:cSld></p:notes>'
    return out


def _sheets(lines: list[str], doc_id: int) -> dict[str, str]:
    """A row a line: its number and its text, which every second row takes from the shared strings."""
    row = lambda k, x: f'<row r="{k + 1}"><c r="A{k + 1}"><v>{k}</v></c>' + (f'<c t="s"><v>{k // 2}</v></c>' if k % 2 == 0 else f"<c t=\"inlineStr\"><is><t>{escape(x)}</t></is></c>") + "</row>"
    return {
        "xl/workbook.xml": f'<workbook xmlns="http://x/m" xmlns:r="http://x/r"><sheets><sheet name={quoteattr(f"doc {doc_id}")} r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": _relations([(1, "worksheet", "/xl/worksheets/one.xml")]),
        "xl/sharedStrings.xml": '<sst xmlns="http://x/m">' + "".join(f"<si><r><t>{escape(x)}</t></r></si>" for x in lines[::2]) + "</sst>",
        "xl/worksheets/one.xml": '<worksheet xmlns="http://x/m"><sheetData>' + "".join(row(k, x) for k, x in enumerate(lines)) + "</sheetData></worksheet>",
    }


def packed(parts: dict[str, str], bomb: int = 0) -> bytes:
    """A zipped container; a bomb is that many more bytes of nothing."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
        if bomb:
            z.writestr("media/nothing.bin", bytes(bomb))
    return out.getvalue()


def _files(ids: pd.Series, texts: pd.Series) -> pd.Series:
    make = {0: _word, 1: _slides, 2: _sheets}
    return pd.Series([packed(make[d % 3]([_ODD.sub("", x) for x in (t or "").split("\n")], d), LIMIT + 1 if d % BOMB == 7 else 0) for d, t in zip(ids, texts, strict=True)])


@query(f"""WITH l AS (SELECT doc_id, i - 1 AS k, lines[i] AS line, trim(lines[i]) AS t FROM (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, string_split(text, chr(10)) AS lines FROM documents)),
p AS (SELECT doc_id, k, CASE doc_id % 3 WHEN 0 THEN CASE WHEN t <> '' THEN line END
  WHEN 1 THEN CASE WHEN t <> '' OR k % 3 = 0 THEN '# Slide ' || (k + 1) || CASE WHEN t <> '' THEN chr(10) || t ELSE '' END || CASE WHEN k % 3 = 0 THEN chr(10) || 'Notes: line ' || k ELSE '' END END
  ELSE CASE WHEN k < 5000 THEN k || CASE WHEN t <> '' THEN ' | ' || t ELSE '' END END END AS part FROM l),
g AS (SELECT doc_id, CASE doc_id % 3 WHEN 2 THEN string_agg(part, chr(10) ORDER BY k) ELSE string_agg(part, chr(10) || chr(10) ORDER BY k) END AS body FROM p GROUP BY doc_id),
x AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN coalesce(body || chr(10) || chr(10), '') || 'id | ' || doc_id WHEN 1 THEN coalesce(body, '') ELSE coalesce('# Sheet: doc ' || doc_id || chr(10) || body, '') END AS text FROM documents LEFT JOIN g USING (doc_id))
SELECT doc_id, CASE WHEN doc_id % {BOMB} = 7 THEN 'too_large' ELSE 'ok' END AS status, md5(CASE WHEN doc_id % {BOMB} = 7 THEN '' ELSE text END) AS text_md5 FROM x""")
def office_files(spark, sf_dir):
    """Every document as a word file, slides or a sheet by its id, read back; those that expand beyond the limit are refused."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.pandas_udf(_files, "binary")(F.col("doc_id"), F.col("text")).alias("raw"))
    extension = F.element_at(F.array(*(F.lit(e) for e in (".docx", ".PPTX", ".xlsx"))), (F.col("doc_id") % 3 + 1).cast("int"))
    found = docs.select("doc_id", office.office_text(F.col("raw"), extension, most_expanded=LIMIT).alias("f"))
    return found.select("doc_id", "f.status", F.md5(F.col("f.text").cast("binary")).alias("text_md5"))
