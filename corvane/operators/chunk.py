"""Chunkers: text to line-addressed chunks, by lines, by headings or by declarations."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from ..functions.batches import pieces
from ..schema import CHUNKS, CODE_LANGUAGES
from .scanner import Unbalanced, declarations

MAX_TOKENS, OVERLAP = 800, 5
#: A section, a header and an unexported variable count from so many tokens.
SECTION_OVER, HEADER_OVER, VARIABLE_OVER = 30, 50, 100
_WS = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_HEADING = re.compile(r"#{1,3}[" + re.escape(_WS) + r"]+(.+)")
_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


class Piece(NamedTuple):
    text: str
    start: int
    end: int
    kind: str = "block"
    symbol: str = ""


def units(text: str) -> int:
    """Length in UTF-16 code units."""
    return len(text) if text.isascii() else len(text) + sum(c > "\uffff" for c in text)


def tokens_of(n: int) -> int:
    return -(-n // 4)


def hash_id(path: str, line: int) -> str:
    """Base-36 id of ``path:line``; see the Column form in functions.text."""
    h, raw = 0, f"{path}:{line}".encode("utf-16-be")
    for k in range(0, len(raw), 2):
        h = (h * 31 + (raw[k] << 8 | raw[k + 1])) & 0xFFFFFFFF
    h, out = min(h, (1 << 32) - h), ""
    while h:
        h, d = divmod(h, 36)
        out = _DIGITS[d] + out
    return out.rjust(8, "0")


def by_lines(text: str, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP) -> Iterator[Piece]:
    """Windows of lines of at most ``max_tokens``, one line at least; each begins ``overlap`` lines before the last one's end."""
    rows = text.split("\n")
    sizes = [units(r) + 1 for r in rows]
    ends, room = [0], 4 * max_tokens
    for n in sizes:
        ends.append(ends[-1] + n)
    start, stop = 0, 0
    while start < len(rows):
        stop = max(stop, start + 1)
        while stop < len(rows) and ends[stop + 1] - ends[start] <= room:
            stop += 1
        body = "\n".join(rows[start:stop]).rstrip(_WS)
        if body:
            yield Piece(body, start + 1, stop)
        if stop >= len(rows):
            return
        start = max(start + 1, stop - overlap)


def fallback(text: str, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP) -> list[Piece]:
    return list(by_lines(text, max_tokens, overlap)) if text.strip(_WS) else []


def sections(text: str) -> list[tuple[str, int, str]]:
    """(title, first line, trimmed text) by headings of level 1 to 3; what comes before the first is ``intro``."""
    rows, marks = text.split("\n"), []
    for k, row in enumerate(rows):
        if m := _HEADING.match(row):
            marks.append((k, m[1].split("\r")[0]))
    if not marks or marks[0][0] > 0:
        marks.insert(0, (0, "intro"))
    return [(title, k + 1, "\n".join(rows[k:stop]).strip(_WS)) for (k, title), stop in zip(marks, [m[0] for m in marks[1:]] + [len(rows)], strict=True)]


def markdown(text: str, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP) -> list[Piece]:
    """Sections over SECTION_OVER tokens, split by lines; a text without any is split whole."""
    out = [Piece(p.text, first + p.start - 1, first + p.end - 1, "section", title)
           for title, first, body in sections(text) if tokens_of(units(body)) > SECTION_OVER
           for p in by_lines(body, max_tokens, overlap)]
    return out or fallback(text, max_tokens, overlap)


def code(text: str, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP) -> list[Piece]:
    """Declarations, large ones split by lines, after a header; without any, or unbalanced, the text is split whole."""
    try:
        found = [d for d in declarations(text) if d.kind != "variable" or d.exported or tokens_of(units(d.text)) > VARIABLE_OVER]
    except Unbalanced:
        found = []
    if not found:
        return fallback(text, max_tokens, overlap)
    out, first = [], found[0].start
    header = "\n".join(text.split("\n")[:first - 1]).strip(_WS)
    if tokens_of(units(header)) > HEADER_OVER:
        out.append(Piece(header, 1, first - 1, "imports", "file-header"))
    for d in found:
        body = d.text.strip(_WS)
        if tokens_of(units(body)) <= max_tokens:
            out.append(Piece(body, d.start, d.end, d.kind, d.name))
        else:
            out += [Piece(p.text, d.start + p.start - 1, d.start + p.end - 1, d.kind, d.name) for p in by_lines(body, max_tokens, overlap)]
    return out


def chunk_text(text: str, language: str, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP) -> list[Piece]:
    """Chunks of one file by its language."""
    split = code if language in CODE_LANGUAGES else markdown if language == "markdown" else fallback
    return split(text, max_tokens, overlap)


def chunk_files(files: DataFrame, max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of all files (schema FILES), a piece of a task's batch at a time; nothing is exchanged."""
    names = [f.name for f in CHUNKS]

    def run(batches):
        for batch in pieces(batches, "content"):
            rows = []
            for path, language, module, at, text in zip(*(batch.column(c).to_pylist() for c in ("file_path", "language", "module", "last_modified", "content")), strict=True):
                rows += [(hash_id(path, p.start), p.text, path, language, module, p.kind, p.symbol, p.start, p.end, at)
                         for p in chunk_text(text or "", language or "text", max_tokens, overlap)]
            kinds = [pa.int32() if n in ("start_line", "end_line") else pa.string() for n in names]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)

    return files.select("file_path", "language", "module", "last_modified", "content").mapInArrow(run, CHUNKS)


@udtf(returnType="text string, start_line int, end_line int, chunk_type string, symbol_name string")
class ChunkText:
    """``LATERAL chunk_text(content, language)`` in SQL."""

    def eval(self, content: str, language: str):
        for p in chunk_text(content or "", language or "text"):
            yield p.text, p.start, p.end, p.kind, p.symbol


def register(spark: SparkSession) -> None:
    spark.udtf.register("chunk_text", ChunkText)
