"""Splitting oversized texts at natural boundaries, with overlap.

Method: recursive bisection. A text longer than the limit is cut at the
strongest boundary near its midpoint (empty line, line end, sentence end,
clause mark, blank, any place beside a character that is no letter or digit),
and each half that is still longer than the limit less the overlap is cut in
the same way. Only where a half has no such place at all is it cut inside a run
of letters and digits, never before a combining mark if that can be helped.
Last, each piece but the first gets the `overlap` characters before it put in
front, so a piece never exceeds the limit and the pieces without their overlaps
are the text again.

Sizes are counted in Unicode code points. The limit less the overlap binds
pieces that carry an overlap; a text within the limit stays whole.

Defined results: null texts give no pieces, empty texts one empty piece; a null
or negative overlap is 0, one of the size or more is cut to half the size; rows
whose configuration is unknown or has no positive size give no row. Repeated
rows of one key give one result. Extra columns are dropped.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import frame

#: Kinds of boundary from the strongest to the weakest. A cut lies at the end of a match.
BOUNDARIES = (
    ("paragraph", regex.compile(r"\n[^\S\n]*\n\s*")),
    ("line", regex.compile(r"\n")),
    ("sentence", regex.compile(r"(?:[.!?…]+[\"'”’»)\]]*(?=\s)|[。！？｡][」』”’）]*|[।؟۔]+)\s*")),
    ("clause", regex.compile(r"(?:[,;:](?=\s)|[、，；：،؛])\s*")),
    ("blank", regex.compile(r"\s+")),
    ("mark", regex.compile(r"(?<=[^\p{L}\p{N}\p{M}\s])(?!\p{M})|(?<!^)(?=[^\p{L}\p{N}\p{M}\s])")),
    ("cluster", regex.compile(r"(?<=\p{M})(?!\p{M})")),
)
_RUN = regex.compile(r"[\p{L}\p{N}]+")
_MARK = regex.compile(r"\p{M}")


def longest_run(text: str) -> int:
    """Most letters and digits in a row."""
    return max((m.end() - m.start() for m in _RUN.finditer(text)), default=0)


def cut_points(text: str, limit: int, room: int) -> list[tuple[int, str]]:
    """Places to cut a text, in order, each with the kind of boundary there.

    The whole text may have `limit` characters; once it is cut, each part may
    have `room`.
    """
    if len(text) <= limit:
        return []
    places = [(kind, sorted({m.end() for m in rule.finditer(text)})) for kind, rule in BOUNDARIES]
    cuts: list[tuple[int, str]] = []
    todo = [(0, len(text))]
    while todo:
        a, b = todo.pop()
        if b - a <= room:
            continue
        at, kind = _strongest(text, places, a, b)
        cuts.append((at, kind))
        todo += [(a, at), (at, b)]
    return sorted(cuts)


def _strongest(text: str, places, a: int, b: int) -> tuple[int, str]:
    """The strongest boundary in the middle half of (a, b), else anywhere inside, else a forced place."""
    middle, quarter = (a + b) // 2, max(1, (b - a) // 4)
    for low, high in ((middle - quarter, middle + quarter), (a + 1, b - 1)):
        low, high = max(low, a + 1), min(high, b - 1)
        for kind, ends in places:
            k = bisect_left(ends, middle)
            near = [p for p in ends[max(0, k - 1) : k + 1] if low <= p <= high]
            if near:
                return min(near, key=lambda p: (abs(p - middle), p)), kind
    at = middle
    while at > a + 1 and _MARK.match(text[at]):
        at -= 1
    return (middle if at == a + 1 else at), "forced"


def split_text(text: str, size: int, overlap: int = 0) -> list[tuple[int, int, int, str]]:
    """Pieces (start, core_start, end, kind): text[start:end] with its overlap, kind of the cut before it."""
    overlap = overlap if 0 <= overlap < size else (size // 2 if overlap >= size else 0)
    cuts = cut_points(text, size, size - overlap)
    starts = [(0, "start"), *cuts]
    ends = [at for at, _ in cuts] + [len(text)]
    return [(max(0, at - overlap) if kind != "start" else 0, at, end, kind) for (at, kind), end in zip(starts, ends)]


PIECE = "array<struct<piece:int,start:int,core_start:int,end:int,cut:string,text:string>>"


def split_spans(spans: DataFrame, configs: DataFrame, key: str = "span_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """(key, chunk_size, n_chars, longest_run, pieces) of each row with a text. No shuffle but for a large configs."""
    sized = configs.select("config_id", F.col("chunk_size").cast("int").alias("chunk_size"), F.coalesce("overlap", F.lit(0)).cast("int").alias("overlap"))
    sized = sized.where("config_id is not null and chunk_size > 0").dropDuplicates(["config_id"])
    rows = spans.select(key, "config_id", text).where(F.col(text).isNotNull()).join(sized, "config_id").select(key, text, "chunk_size", "overlap")
    key_type = spans.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            runs, pieces = [], []
            for value, size, overlap in zip(batch[text], batch["chunk_size"], batch["overlap"]):
                runs.append(longest_run(value))
                pieces.append([
                    {"piece": i, "start": a, "core_start": c, "end": b, "cut": kind, "text": value[a:b] if with_text else None}
                    for i, (a, c, b, kind) in enumerate(split_text(value, int(size), int(overlap)))
                ])
            yield frame(**{key: batch[key]}, chunk_size=batch["chunk_size"], n_chars=[len(t) for t in batch[text]], longest_run=runs, pieces=pieces)

    return rows.mapInPandas(run, f"`{key}` {key_type}, chunk_size int, n_chars int, longest_run int, pieces {PIECE}")


def pieces_of(split: DataFrame, key: str = "span_id") -> DataFrame:
    """One row per piece, each key once."""
    return split.dropDuplicates([key]).select(key, F.explode("pieces").alias("p")).select(key, "p.*")


def oversized(split: DataFrame, key: str = "span_id") -> DataFrame:
    """(key, forced) of each row that was cut; forced is 1 if a run of letters and digits exceeds the limit."""
    cut = split.where(F.size("pieces") > 1)
    return cut.groupBy(key).agg(F.max((F.col("longest_run") > F.col("chunk_size")).cast("int")).alias("forced"))
