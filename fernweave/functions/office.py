"""Text of office files: word documents, slides, sheets, read part by part from their zipped XML.

A container says how large its parts are; one that would expand beyond a limit
is refused before anything is read, and one that lies about it while it is read.
The parts are pulled through an event parser, so a part is never held as a tree,
and reading ends when the budget of characters is used up.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from posixpath import join, normpath
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA = "struct<text string, status string, error string, truncated boolean>"
KINDS = {".docx": "word", ".pptx": "slides", ".xlsx": "sheets", ".xlsm": "sheets"}
#: Bytes that a container may expand to, characters that are kept, and rows of a sheet.
MOST_EXPANDED, MOST_CHARS, MOST_ROWS = 512 << 20, 2_000_000, 5000
#: Formats of numbers that are dates or times without saying so.
DATE_FORMATS = frozenset([*range(14, 23), *range(45, 48)])
EPOCH = datetime(1899, 12, 30)


class TooLarge(Exception):
    pass


class _Bounded(io.RawIOBase):
    """A part of the container that may give so many bytes and no more."""

    def __init__(self, part: io.BufferedIOBase, left: int):
        self.part, self.left = part, left

    def read(self, n: int = -1) -> bytes:
        got = self.part.read(n)
        self.left -= len(got)
        if self.left < 0:
            raise TooLarge("a part is larger than the container says")
        return got


class Container:
    """A zipped office file: its parts as events, and where its relations lead."""

    def __init__(self, raw: bytes, most: int):
        self.zip = zipfile.ZipFile(io.BytesIO(raw))
        size = sum(x.file_size for x in self.zip.infolist())
        if size > most:
            raise TooLarge(f"expands to {size} bytes, over {most}")
        self.names = set(self.zip.namelist())

    def events(self, part: str) -> Iterator[tuple[str, str, ElementTree.Element]]:
        """(start or end, name without its namespace, element) of a part; nothing of one that isn't there."""
        if part not in self.names:
            return
        with self.zip.open(part) as f:
            for event, x in ElementTree.iterparse(_Bounded(f, self.zip.getinfo(part).file_size), ("start", "end")):
                yield event, x.tag.rsplit("}", 1)[-1], x

    def relations(self, part: str) -> dict[str, tuple[str, str]]:
        """Of each relation of a part its kind and the part that it leads to."""
        folder, _, name = part.rpartition("/")
        out = {}
        for event, tag, x in self.events(f"{folder}/_rels/{name}.rels"):
            if event == "end" and tag == "Relationship":
                target = x.get("Target", "")
                out[x.get("Id", "")] = x.get("Type", "").rsplit("/", 1)[-1], target.lstrip("/") if target.startswith("/") else normpath(join(folder, target))
        return out


def _attribute(x: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in x.attrib.items() if k.rsplit("}", 1)[-1] == name), None)


def _relation(x: ElementTree.Element) -> str | None:
    """The relation that an element names; an id without a namespace is its own."""
    return next((v for k, v in x.attrib.items() if k.endswith("}id")), None)


def word(file: Container) -> Iterator[str]:
    """Paragraphs that aren't blank, then the rows of all tables."""
    yield from _word(file, False)
    yield from _word(file, True)


def _word(file: Container, tables: bool) -> Iterator[str]:
    """Paragraphs outside tables, or the rows of outer tables. A cell over several columns stands in each, one over several rows in each row."""
    depth, text, cells, above, column, span, merged = 0, [], [], {}, 0, 1, False
    cell: list[str] = []
    for event, tag, x in file.events("word/document.xml"):
        if event == "start":
            if tag == "tbl":
                depth += 1
                above = {} if depth == 1 else above
            elif tag == "tr" and depth == 1:
                cells, column = [], 0
            elif tag == "tc" and depth == 1:
                cell, span, merged = [], 1, False
            elif tag == "p":
                text = []
            continue
        if tag == "t":
            text.append(x.text or "")
        elif tag in ("tab", "br", "cr") and x.attrib.get("pos") is None and _attribute(x, "val") is None:
            text.append("\t" if tag == "tab" else "\n")
        elif tag == "gridSpan" and depth == 1:
            span = int(_attribute(x, "val") or 1)
        elif tag == "vMerge" and depth == 1:
            merged = _attribute(x, "val") in (None, "continue")
        elif tag == "p":
            if depth == 1:
                cell.append("".join(text))
            elif not depth and not tables and "".join(text).strip():
                yield "".join(text)
        elif tag == "tc" and depth == 1:
            value = above.get(column, "") if merged else "\n".join(cell).strip()
            for k in range(column, column + span):
                above[k] = value
            cells += [value] * span
            column += span
        elif tag == "tr" and depth == 1 and tables and any(cells):
            yield " | ".join(cells)
        elif tag == "tbl":
            depth -= 1
        if tag in ("p", "tr", "tbl"):
            x.clear()


def slides(file: Container) -> Iterator[str]:
    """Each slide that has text, with its number: shapes' paragraphs and tables' rows in order, then its notes."""
    related = file.relations("ppt/presentation.xml")
    order = [_relation(x) for event, tag, x in file.events("ppt/presentation.xml") if event == "end" and tag == "sldId"]
    for number, r in enumerate((r for r in order if r in related), 1):
        part = related[r][1]
        lines = [f"# Slide {number}", *_shapes(file, part)]
        for kind, notes in file.relations(part).values():
            if kind == "notesSlide" and (said := _notes(file, notes)):
                lines.append("Notes: " + said)
        if len(lines) > 1:
            yield "\n".join(lines)


def _shapes(file: Container, part: str) -> Iterator[str]:
    """Paragraphs of runs and rows of cells of the shapes that stand by themselves (not those of a group)."""
    group, cells, row, runs, inside = 0, None, [], [], False
    for event, tag, x in file.events(part):
        if event == "start":
            group += tag == "grpSp"
            if tag == "p":
                runs = []
            elif tag == "tr":
                row = []
            elif tag == "tc":
                cells = []
            inside = inside or tag == "r"
            continue
        if tag == "grpSp":
            group -= 1
        elif tag == "r":
            inside = False
        elif tag == "t" and inside:
            runs.append(x.text or "")
        elif tag == "p" and cells is not None:
            cells.append("".join(runs))
        elif tag == "p" and not group and (text := "".join(runs).strip()):
            yield text
        elif tag == "tc":
            row.append("\n".join(cells or ()).strip())
            cells = None
        elif tag == "tr" and not group and any(row):
            yield " | ".join(row)


def _notes(file: Container, part: str) -> str:
    """The text of the notes' body."""
    body, lines, runs = False, [], []
    for event, tag, x in file.events(part):
        if event == "start":
            if tag == "sp":
                body = False
            elif tag == "ph":
                body = x.get("type") == "body"
            elif tag == "p":
                runs = []
        elif tag == "t":
            runs.append(x.text or "")
        elif tag == "p" and body:
            lines.append("".join(runs))
    return "\n".join(lines).strip()


def sheets(file: Container) -> Iterator[str]:
    """Each sheet that has values, with its name: the values of a row that aren't blank."""
    related = file.relations("xl/workbook.xml")
    named = [(x.get("name", ""), _relation(x)) for event, tag, x in file.events("xl/workbook.xml") if event == "end" and tag == "sheet"]
    strings, dates = list(_strings(file)), _date_styles(file)
    for name, r in named:
        if r in related:
            lines = [f"# Sheet: {name}", *_rows(file, related[r][1], strings, dates)]
            if len(lines) > 1:
                yield "\n".join(lines)


def _strings(file: Container) -> Iterator[str]:
    text, spoken = [], False
    for event, tag, x in file.events("xl/sharedStrings.xml"):
        if tag == "rPh":
            spoken = event == "start"
        elif event == "start":
            text = [] if tag == "si" else text
        elif tag == "t" and not spoken:
            text.append(x.text or "")
        elif tag == "si":
            yield "".join(text)
            x.clear()


def _date_styles(file: Container) -> set[int]:
    """The numbers of cell styles that show dates or times."""
    own, out, inside, number = {}, set(), False, 0
    for event, tag, x in file.events("xl/styles.xml"):
        if tag == "cellXfs":
            inside = event == "start"
        elif event == "end" and tag == "numFmt":
            code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", x.get("formatCode", ""))
            own[int(x.get("numFmtId", 0))] = bool(re.search("[ymdhs]", code, re.I)) and code.lower() != "general"
        elif event == "end" and tag == "xf" and inside:
            shown = int(x.get("numFmtId", 0))
            if own.get(shown, shown in DATE_FORMATS):
                out.add(number)
            number += 1
    return out


def _rows(file: Container, part: str, strings: list[str], dates: set[int]) -> Iterator[str]:
    n, values, kind, style, held = 0, [], None, 0, []
    for event, tag, x in file.events(part):
        if event == "start":
            if tag == "row":
                values = []
            elif tag == "c":
                kind, style, held = x.get("t"), int(x.get("s") or 0), []
        elif tag in ("v", "t"):
            held.append(x.text or "")
        elif tag == "c":
            value = _shown("".join(held), kind, style in dates, strings).strip()
            if value:
                values.append(value)
        elif tag == "row":
            n += 1
            if values:
                yield " | ".join(values)
            if n == MOST_ROWS:
                return
            x.clear()


def _shown(value: str, kind: str | None, is_date: bool, strings: list[str]) -> str:
    """A cell's value as text: numbers without needless places, dates as ISO has them with a space."""
    if kind == "s":
        return strings[int(value)] if value else ""
    if kind == "b":
        return "True" if value == "1" else "False"
    if kind in ("str", "inlineStr", "e", "d") or not value:
        return value
    number = float(value)
    if is_date:
        when = EPOCH + timedelta(milliseconds=round(number * 86_400_000))
        return str(when.time() if 0 <= number < 1 else when)
    return str(int(number)) if re.fullmatch(r"-?\d+", value) or number.is_integer() and "e" not in value.lower() and "." not in value else str(number)


def read(raw: bytes | None, extension: str | None, most_chars: int = MOST_CHARS, most_expanded: int = MOST_EXPANDED) -> dict:
    """text, status (ok, empty, too_large, error or unsupported), error, and whether the budget cut the text."""
    out = {"text": "", "status": "empty", "error": None, "truncated": False}
    make = {"word": word, "slides": slides, "sheets": sheets}.get(KINDS.get((extension or "").lower(), ""))
    if make is None or raw is None:
        return out | {"status": "unsupported" if raw is not None else "empty"}
    parts, left = [], most_chars
    try:
        for part in make(Container(raw, most_expanded)):
            if left <= 0 or len(part) > left:
                out["truncated"] = True
                parts += [part[:left]] if left > 0 else []
                break
            parts.append(part)
            left -= len(part)
    except TooLarge as e:
        return out | {"status": "too_large", "error": str(e)}
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, IndexError, RuntimeError, NotImplementedError, EOFError, OSError) as e:
        return out | {"status": "error", "error": f"not a readable office file: {e}"[:300]}
    text = "\n\n".join(parts)[:most_chars]
    return out | {"text": text, "status": "ok" if text.strip() else "empty"}


def office_text(raw: Column, extension: Column, most_chars: int = MOST_CHARS, most_expanded: int = MOST_EXPANDED) -> Column:
    """What ``read`` gives for each file's bytes."""

    @F.pandas_udf(SCHEMA)
    def run(files: pd.Series, extensions: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read(f, e, most_chars, most_expanded) for f, e in zip(files, extensions, strict=True)], columns=["text", "status", "error", "truncated"])

    return run(raw, extension)
