"""Splitting sources into spans that can be verified: text, markdown, lines and code.

A span has its index, byte offsets into the source's UTF-8, 1-based lines, the
text and its fingerprint. Offsets are bytes, so that a span can be cut from the
source file; sizes of text chunks are characters. Spans of one source are in
order, do not overlap and are exact slices.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.hashing import fingerprint_text
from weftline.functions.text import EXTENSIONS, LANGUAGE_NAMES
from weftline.session import frame

SPAN = "struct<index:int,start:int,end:int,line_start:int,line_end:int,text:string,fingerprint:string>"

#: Boundaries of a text chunk from the strongest to the weakest; a piece ends after a match.
_TEXT_LEVELS = [re.compile(p) for p in (r"\n\s*\n", r"\n", r"(?<=[.!?])\s+|(?<=[。！？])", r"\s+")]
_MARKDOWN_LEVELS = [re.compile(r"\n(?=#{1,6} )"), re.compile(r"\n(?=```)"), *_TEXT_LEVELS]


def _pieces(text: str, a: int, b: int, size: int, levels: list) -> Iterator[tuple[int, int]]:
    """Parts of text[a:b] no longer than size, cut at the strongest level that does it."""
    if b - a <= size:
        yield a, b
        return
    if not levels:
        for at in range(a, b, size):
            yield at, min(b, at + size)
        return
    at = a
    for m in levels[0].finditer(text, a, b):
        if m.end() > at:
            yield from _pieces(text, at, m.end(), size, levels[1:])
            at = m.end()
    if at < b:
        yield from _pieces(text, at, b, size, levels[1:])


def text_ranges(text: str, size: int = 2000, slack: int = 200, markdown: bool = False) -> list[tuple[int, int]]:
    """Character ranges of chunks of at most size characters; one is closed once it has size - slack.

    White space at both ends is left out of a chunk; blank texts have no chunks.
    """
    size = max(1, size)
    enough = max(1, size - max(0, slack))
    out: list[tuple[int, int]] = []
    begin = None
    end = 0
    for a, b in _pieces(text, 0, len(text), size, _MARKDOWN_LEVELS if markdown else _TEXT_LEVELS):
        if begin is not None and (b - begin > size or end - begin >= enough):
            out.append((begin, end))
            begin = None
        if begin is None:
            begin = a
        end = b
    if begin is not None:
        out.append((begin, end))
    trimmed = []
    for a, b in out:
        part = text[a:b]
        left = len(part) - len(part.lstrip())
        right = len(part.rstrip())
        if right > left:
            trimmed.append((a + left, a + right))
    return trimmed


def spans_of(text: str, ranges: list[tuple[int, int]]) -> list[dict]:
    """Spans of character ranges in order: byte offsets, lines, fingerprints."""
    out = []
    at = byte = 0
    line = 1
    for i, (a, b) in enumerate(ranges):
        byte += len(text[at:a].encode())
        line += text.count("\n", at, a)
        body = text[a:b]
        size = len(body.encode())
        breaks = body.count("\n")
        out.append({"index": i, "start": byte, "end": byte + size, "line_start": line, "line_end": line + breaks, "text": body, "fingerprint": fingerprint_text(body)})
        byte += size
        line += breaks
        at = b
    return out


def chunk_spans(text: str | None, size: int = 2000, slack: int = 200, markdown: bool = False) -> list[dict]:
    return spans_of(text, text_ranges(text, size, slack, markdown)) if text else []


def line_spans(text: str | None, max_bytes: int) -> list[dict]:
    """Whole lines packed into spans of at most max_bytes; a longer line stands alone. Loses nothing."""
    if not text:
        return []
    budget = max(1, max_bytes)
    out: list[dict] = []
    begin_line, line, start, size = 1, 1, 0, 0
    held: list[str] = []

    def close() -> None:
        nonlocal start, size, held, begin_line
        body = "".join(held)
        out.append({"index": len(out), "start": start, "end": start + size, "line_start": begin_line, "line_end": begin_line + len(held) - 1, "text": body, "fingerprint": fingerprint_text(body)})
        start, size, held, begin_line = start + size, 0, [], line

    for row in text.splitlines(keepends=True) if "\r" not in text and "\x0b" not in text and "\x0c" not in text else re.findall(r"[^\n]*\n|[^\n]+$", text):
        n = len(row.encode())
        if held and size + n > budget:
            close()
        held.append(row)
        size += n
        line += 1
    if held:
        close()
    return out


def resize_span(text: str, span: dict, grow_top: int, grow_bottom: int) -> dict:
    """The span widened (or narrowed, below 0) by whole lines at both ends, kept within the source and not empty."""
    rows = re.findall(r"[^\n]*\n|[^\n]+$", text)
    if not rows:
        return span
    first = min(max(1, span["line_start"] - grow_top), len(rows))
    last = min(max(1, span["line_end"] + grow_bottom), len(rows))
    if last < first:
        first = last = min(max(1, span["line_start"]), len(rows))
    return span_at(rows, first, last, span["index"])


def span_at(rows: list[str], first: int, last: int, index: int = 0) -> dict:
    """The span of lines first..last (1-based) of a source given by its lines."""
    start = sum(len(r.encode()) for r in rows[: first - 1])
    body = "".join(rows[first - 1 : last])
    kept = body.rstrip("\n")
    return {"index": index, "start": start, "end": start + len(body.encode()), "line_start": first, "line_end": first + kept.count("\n"), "text": body, "fingerprint": fingerprint_text(body)}


_CODE_START = {
    "rust": r"^(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*(?:fn|struct|enum|trait|impl|mod|type|static|union|macro_rules!)\b|^#\[",
    "javascript": r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function|class|const|let|var)\b",
    "typescript": r"^(?:export\s+)?(?:default\s+)?(?:declare\s+)?(?:async\s+)?(?:abstract\s+)?(?:function|class|interface|type|enum|namespace|const|let|var)\b",
    "go": r"^(?:func|type|var|const)\b",
    "c": r"^[A-Za-z_][\w\s*]*\([^;]*$|^(?:struct|enum|union|typedef|static)\b",
    "cpp": r"^[A-Za-z_][\w\s*:<>,&~]*\([^;]*$|^(?:class|struct|enum|union|namespace|template|typedef|using|static)\b",
}


def _code_starts(text: str, language: str) -> list[int] | None:
    """First lines (0-based) of the top-level items of a source, or None if it cannot be parsed."""
    if language == "python":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            return None
        return sorted({min([n.lineno, *(d.lineno for d in getattr(n, "decorator_list", []))]) - 1 for n in tree.body})
    rule = re.compile(_CODE_START[language])
    rows, starts, depth, leading = text.split("\n"), [], 0, None
    for i, row in enumerate(rows):
        plain = re.sub(r"\"(?:[^\"\\]|\\.)*\"|//.*$", "", row)
        if depth == 0:
            if row.startswith(("//", "/*", " *", "#[", "@")):
                leading = i if leading is None else leading
            elif rule.match(row):
                starts.append(i if leading is None else leading)
                leading = None
            elif not row.strip():
                leading = None
        depth += plain.count("{") - plain.count("}")
        if depth < 0:
            return None
    return starts if depth == 0 else None


def code_spans(text: str | None, language: str, max_bytes: int = 2000) -> list[dict] | None:
    """Spans of whole items of a code source, packed up to max_bytes; None if the source cannot be parsed."""
    if not text:
        return []
    starts = _code_starts(text, language)
    if starts is None:
        return None
    rows = re.findall(r"[^\n]*\n|[^\n]+$", text)
    edges = sorted({0, *[s for s in starts if s < len(rows)], len(rows)})
    groups: list[tuple[int, int]] = []
    for a, b in zip(edges, edges[1:]):
        size = sum(len(r.encode()) for r in rows[a:b])
        if size > max_bytes:
            # an item over the limit falls apart into whole lines
            at, held = a, 0
            for i in range(a, b):
                n = len(rows[i].encode())
                if held and held + n > max_bytes:
                    groups.append((at, i))
                    at, held = i, 0
                held += n
            groups.append((at, b))
        elif groups and groups[-1][1] == a and sum(len(r.encode()) for r in rows[groups[-1][0] : b]) <= max_bytes:
            groups[-1] = (groups[-1][0], b)
        else:
            groups.append((a, b))
    return [span_at(rows, a + 1, b, i) for i, (a, b) in enumerate(groups)]


def code_spans_auto(text: str | None, path: str | None, max_bytes: int = 2000) -> tuple[str, list[dict]]:
    """(strategy, spans): by items where the path's language is known and parses, else by lines."""
    language = EXTENSIONS.get((path or "").rpartition(".")[2].lower())
    if language:
        found = code_spans(text, language, max_bytes)
        if found is not None:
            return f"code:{language}", found
    return "lines", line_spans(text, max_bytes)


def span_status(text: Column, expected: Column, fingerprint: Column) -> Column:
    """verify_span for columns: the text found at a span (null if there is none), its fingerprint and the one expected."""
    return F.when(text.isNull(), "out_of_range").when(fingerprint == expected, "ok").otherwise("fingerprint_mismatch")


def window_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 2000) -> DataFrame:
    """(key, index, text): the overlapping windows of each text."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield frame(**{key: batch[key]}, parts=[split_with_overlap(t, most) if t else [] for t in batch[text]])

    found = docs.select(key, text).mapInPandas(run, f"`{key}` {kind}, parts array<string>")
    return found.select(key, F.posexplode("parts").alias("index", "text"))


def verify_span(span: dict | None, expected: str) -> str:
    """ok, out_of_range or fingerprint_mismatch."""
    return "out_of_range" if span is None else "ok" if span["fingerprint"] == expected else "fingerprint_mismatch"


def sed_range(start: Column, end: Column) -> Column:
    return F.concat(start.cast("string"), F.lit(","), end.cast("string"), F.lit("p"))


def split_with_overlap(text: str, most: int) -> list[str]:
    """Windows of at most `most` characters that step by most - most // 5, cut back to a sentence end or blank past the half."""
    step = most - most // 5
    out, at = [], 0
    while at < len(text):
        part = text[at : at + most]
        if at + most < len(text):
            ends = [i for i, c in enumerate(part) if c in ".!?"] or [i for i, c in enumerate(part) if c.isspace()]
            if ends and ends[-1] > most // 2:
                part = part[: ends[-1] + 1]
        if part.strip():
            out.append(part)
        at += step
    return out


def _explode_spans(rows: DataFrame, key: str, text: str, make, extra: str = "") -> DataFrame:
    """One row per span of each text; make(row) gives the spans."""
    kind = rows.schema[key].dataType.simpleString()
    columns = [c for c in rows.columns if c not in (key, text)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield frame(**{key: batch[key]}, spans=[make(t, *others) for t, *others in batch[[text, *columns]].itertuples(index=False)])

    found = rows.select(key, text, *columns).mapInPandas(run, f"`{key}` {kind}, spans array<{SPAN}>")
    return found.select(key, F.explode("spans").alias("s")).select(key, "s.*")


def chunk_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 2000, slack: int = 200) -> DataFrame:
    """Spans of each document, as markdown where it looks like it."""

    def make(value):
        markdown = value is not None and ("# " in value or "```" in value)
        return chunk_spans(value, size, slack, markdown)

    return _explode_spans(docs.select(key, text), key, text, make)


def line_span_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", max_bytes: int = 500) -> DataFrame:
    return _explode_spans(docs.select(key, text), key, text, lambda value: line_spans(value, max_bytes))


def code_span_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = "origin_path", max_bytes: int = 1000) -> DataFrame:
    return _explode_spans(docs.select(key, text, path), key, text, lambda value, p: code_spans_auto(value, p, max_bytes)[1])


class ChunkError(ValueError):
    """An unknown language, a source that cannot be parsed, or a chunk that is not there."""


def cut_source(text: str, path: str = "", size: int = 2000, slack: int = 200, markdown: bool | None = None, lines: bool = False, code: bool = False, language: str | None = None, nth: int | None = None, expand: int = 0) -> list[dict]:
    """The spans of one source as a caller wants them.

    Whole lines come before code, code before text: lines cuts between lines; a
    language, or code with that of the path, cuts between items. Without markdown
    the path's ending tells. nth picks one span of all, and only then is what is
    left widened by `expand` lines at both ends (narrowed, if below 0).
    """
    if lines:
        found = line_spans(text, size)
    elif language is not None:
        name = LANGUAGE_NAMES.get(language.lower()) or EXTENSIONS.get(language.lower())
        if name is None:
            raise ChunkError(f"unknown language {language}; known endings: {', '.join(sorted(EXTENSIONS))}")
        found = code_spans(text, name, size)
        if found is None:
            raise ChunkError(f"the source cannot be parsed as {name}")
    elif code:
        found = code_spans_auto(text, path, size)[1]
    else:
        found = chunk_spans(text, size, slack, path.lower().endswith((".md", ".markdown")) if markdown is None else markdown)
    if nth is not None:
        if not 0 <= nth < len(found):
            raise ChunkError(f"there is no chunk {nth}")
        found = [found[nth]]
    return [resize_span(text, s, expand, expand) for s in found] if expand else found
