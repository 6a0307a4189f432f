"""Cutting documents into overlapping chunks for an index.

Blocks are paragraphs, cut again before headings (prose) or definitions (code);
a block over the limit is cut between sentences, else at a space, else hard.
Blocks are packed until the target is passed. How far a chunk reaches depends
on all chunks before it, which no window frame can say, so a document is folded
in one Arrow-batched function, in time linear in its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_newlines

SCHEMA = "array<struct<ordinal int, start int, end int, text string, truncated boolean>>"

# What begins a block of prose, what begins one of code, where a sentence ends, and which files are code.
HEADING = r"(?:#{1,6}\s|={3,}\s*$|-{3,}\s*$)"
DEFINITION = r"(?:def |class |function |fn |pub fn |func |export |public |private |static |#region|///|/\*\*)"
SENTENCE = r"(?<=[.!?])\s+(?=[A-Z0-9\"'(\[])"
CODE = (
    ".py", ".pyi", ".js", ".mjs", ".ts", ".tsx", ".jsx", ".cs", ".c", ".h", ".cpp", ".hpp", ".cc", ".rs", ".go", ".java", ".kt", ".swift", ".rb", ".php", ".lua", ".sql", ".r", ".jl",
    ".scala", ".ps1", ".psm1", ".sh", ".bash", ".zsh", ".bat", ".cmd", ".css", ".scss",
)


@dataclass(frozen=True)
class Limits:
    target: int = 1400
    longest: int = 2200
    overlap: int = 180
    shortest: int = 40
    #: Chunks of a document, if there is to be a bound; what it cuts off is marked on the document's chunks.
    most_chunks: int | None = None


#: Changes with the rules by which texts are cut.
VERSION = 1


def identity(limits: Limits = Limits()) -> str:
    """What decides how a text is cut, apart from the text: indexes of another identity must be made anew."""
    return f"v{VERSION}:{limits.target}:{limits.longest}:{limits.overlap}:{limits.shortest}:{limits.most_chunks or 'all'}"


Span = tuple[int, int]


def blocks(text: str, opens: re.Pattern) -> Iterator[Span]:
    """Runs of lines that aren't blank; a line that ``opens`` matches begins a new one."""
    begin = end = -1
    at = 0
    for line in text.split("\n"):
        blank = not line.strip()
        if begin >= 0 and (blank or opens.match(line)):
            yield begin, end
            begin = -1
        if not blank:
            begin, end = at if begin < 0 else begin, at + len(line)
        at += len(line) + 1
    if begin >= 0:
        yield begin, end


def _pieces(text: str, span: Span, sentence: re.Pattern, longest: int) -> Iterator[tuple[Span, bool]]:
    """Sentences of a span, those over the limit in parts; with each whether it must stand alone."""
    at = span[0]
    ends = [(m.start() + span[0], m.end() + span[0]) for m in sentence.finditer(text[span[0] : span[1]])]
    for end, following in [*ends, (span[1], span[1])]:
        while end - at > longest:
            space = text.rfind(" ", at, at + longest)
            cut = space if space - at >= longest // 2 else at + longest
            yield (at, cut), True
            at = cut
        yield (at, end), False
        at = following


def fitted(text: str, span: Span, sentence: re.Pattern, longest: int) -> Iterator[Span]:
    """The span itself, or spans of whole sentences within the limit; between two sentences one space is counted."""
    if span[1] - span[0] <= longest:
        yield span
        return
    begin = size = 0
    for (a, b), alone in _pieces(text, span, sentence, longest):
        if size and (alone or size + 1 + b - a > longest):
            yield begin, begin + size
            size = 0
        if alone:
            yield a, b
        elif size:
            size += 1 + b - a
        else:
            begin, size = a, b - a
    if size:
        yield begin, begin + size


def _tail(text: str, overlap: int) -> str:
    """The last characters of a chunk from its first whole word on."""
    last = text[-overlap:] if overlap > 0 else ""
    return last[last.find(" ") + 1 :].strip()


def packed(spans: Iterator[Span], target: int) -> Iterator[Span]:
    """Unions of neighbouring spans; each counts two more characters than it has."""
    begin = end = size = 0
    for a, b in spans:
        if size and size + b - a + 2 > target:
            yield begin, end
            size = 0
        begin, end, size = a if not size else begin, b, size + b - a + 2
    if size:
        yield begin, end


def chunk(text: str, is_code: bool, limits: Limits) -> list[tuple[int, int, int, str]]:
    """(ordinal, start, end, text) of each chunk of a normalised text."""
    opens, sentence = re.compile(DEFINITION if is_code else HEADING), re.compile(SENTENCE)
    spans = (s for block in blocks(text, opens) for s in fitted(text, block, sentence, limits.longest))
    out: list[tuple[int, int, int, str]] = []
    for a, b in packed(spans, limits.target):
        body = text[a:b]
        if out and len(body.strip()) < limits.shortest:
            n, start, _, before = out[-1]
            out[-1] = (n, start, b, before + "\n" + body)
            continue
        if len(out) == limits.most_chunks:
            break
        lead = _tail(out[-1][3], limits.overlap) if out else ""
        out.append((len(out), a, b, f"{lead}\n{body}" if lead else body))
    return out


def chunks_of(text: Column, extension: Column, limits: Limits = Limits()) -> Column:
    """Array of a text's chunks; null and blank texts have none."""

    def rows(text: str, is_code: bool) -> list[dict]:
        found = chunk(text, is_code, limits)
        cut = bool(found) and found[-1][2] < len(text.rstrip())
        return [dict(zip(("ordinal", "start", "end", "text"), c, strict=True), truncated=cut) for c in found]

    @F.pandas_udf(SCHEMA)
    def run(texts: pd.Series, code: pd.Series) -> pd.Series:
        return pd.Series([rows(t or "", bool(k)) for t, k in zip(texts, code, strict=True)])

    return run(normalize_newlines(text), F.coalesce(F.lower(extension).isin(*CODE), F.lit(False)))


def chunked(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(doc_id, ordinal, start, end, text, truncated) of all chunks of ``docs`` (doc_id, text, extension); no shuffle.

    ``truncated`` is whether the document has text behind its last chunk, which only ``most_chunks`` can bring about.
    """
    return docs.select("doc_id", F.inline(chunks_of(F.col("text"), F.col("extension"), limits)))
