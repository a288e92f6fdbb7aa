"""Encoding and decoding of a whole corpus with a public byte-level BPE vocabulary.

Method: backtracking encoding. One Aho-Corasick pass over a piece of text
finds, for each start, the longest token of the vocabulary there. The encoder
then takes the longest token at each place and keeps it only if it is
compatible with the token before it, that is, if merging the two tokens' text
by rank would give just these two tokens. If not, it tries the next shorter
prefix token and, when there is none, takes the previous token back. A bit per
position stops any position from being tried twice, so the work is linear in
the text, and the result equals that of merging by rank exactly.

Defined results: a null, an empty and a blank-only text are ordinary inputs;
null and empty give an empty list, blank texts give the ids of their blanks.
Texts of any length are encoded whole. Special-token strings in a text are
ordinary text. Extra columns are dropped; rows that come twice stay twice.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame

#: Where the vocabulary files lie unless a caller says otherwise.
TOKENIZER_DIR = "/opt/tokenizers"

#: Fixed value: the public pattern that splits text before the merges of the rank files.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Pieces of text whose ids a worker keeps, at most.
CACHE_PIECES = 100_000

#: Longest piece, in characters, that is worth keeping.
CACHE_CHARS = 40


class ByteBpe:
    """A rank vocabulary with exact, linear-time encoding and offset-table decoding."""

    def __init__(self, path: str, pattern: str = SPLIT_PATTERN):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        if sorted(ranks.values()) != list(range(len(ranks))):
            raise ValueError("ranks must be 0 .. n-1 without a gap")
        self.tokens: list[bytes] = [b""] * len(ranks)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.lengths = [len(t) for t in self.tokens]
        self._split = regex.compile(pattern)
        # latin-1 maps each byte to one character, which is what the automaton takes
        self._machine = ahocorasick.Automaton()
        for rank, token in enumerate(self.tokens):
            self._machine.add_word(token.decode("latin-1"), rank)
        self._machine.make_automaton()
        self._shorter = self._prefix_links(ranks)
        self._merge: dict[tuple[int, int], int] = {}
        self._parts: list[tuple[int, int]] = []
        self._learn_merges(ranks)
        self._blob = b"".join(self.tokens)
        self._offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self._cache: dict[str, list[int]] = {}

    @staticmethod
    def _prefix_links(ranks: dict[bytes, int]) -> list[int]:
        """For each token its longest proper prefix that is a token, or -1."""
        links = [-1] * len(ranks)
        for token, rank in ranks.items():
            for end in range(len(token) - 1, 0, -1):
                if (hit := ranks.get(token[:end])) is not None:
                    links[rank] = hit
                    break
        return links

    def _learn_merges(self, ranks: dict[bytes, int]) -> None:
        """The pair each token is merged from, in rank order; bytes stand for themselves."""
        for rank, token in enumerate(self.tokens):
            parts = (rank, rank)
            head = self._shorter[rank]
            while head != -1:
                tail = ranks.get(token[self.lengths[head] :])
                if tail is not None and head < rank and tail < rank and self.compatible(head, tail):
                    parts = (head, tail)
                    self._merge[parts] = rank
                    break
                head = self._shorter[head]
            self._parts.append(parts)

    def compatible(self, left: int, right: int) -> bool:
        """Whether the text of the two tokens, merged by rank, is just these two tokens.

        Undoes the merges along the border of the two from the latest to the
        earliest and looks for a merge across the border that would have come
        before the one undone.
        """
        bound = len(self.tokens)
        while True:
            across = self._merge.get((left, right))
            if across is not None and across < bound:
                return False
            undo_left = left > right
            for _ in range(2):
                if undo_left:
                    inner = self._parts[left][1]
                    if inner != left:
                        bound, left = left, inner
                        break
                    bound = right + 1
                else:
                    inner = self._parts[right][0]
                    if inner != right:
                        bound, right = right + 1, inner
                        break
                    bound = left
                undo_left = not undo_left
            else:
                return True

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of one piece of text, as its UTF-8 bytes."""
        size = len(data)
        longest = [-1] * size
        for end, rank in self._machine.iter(data.decode("latin-1")):
            # shorter tokens that end later never displace a longer one at the same start
            start = end + 1 - self.lengths[rank]
            seen = longest[start]
            if seen == -1 or self.lengths[seen] < self.lengths[rank]:
                longest[start] = rank
        if longest[0] != -1 and self.lengths[longest[0]] == size:
            return [longest[0]]
        open_at = bytearray(b"\x01") * (size + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while True:
            stop = at + self.lengths[token]
            if open_at[stop] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = stop
                if at == size:
                    return out
                token = longest[at]
                continue
            token = self._shorter[token]
            while token == -1:
                open_at[at] = 0
                token = out.pop()
                at -= self.lengths[token]
                token = self._shorter[token]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens; null and empty give no ids."""
        out: list[int] = []
        if not text:
            return out
        cache = self._cache
        for piece in self._split.findall(text):
            ids = cache.get(piece)
            if ids is None:
                ids = self.encode_piece(piece.encode("utf-8", "replace"))
                if len(piece) <= CACHE_CHARS:
                    if len(cache) >= CACHE_PIECES:
                        cache.clear()
                    cache[piece] = ids
            out += ids
        return out

    def decode(self, ids) -> str:
        """Text of a list of ids, read from the offset table; an id outside the vocabulary raises."""
        ids = np.asarray(ids, dtype=np.int64)
        if ids.size == 0:
            return ""
        if ids.min() < 0 or ids.max() >= len(self.tokens):
            raise ValueError("an id lies outside the vocabulary")
        begin, end = self._offsets[ids], self._offsets[ids + 1]
        return b"".join(self._blob[a:b] for a, b in zip(begin.tolist(), end.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    """The vocabulary of a rank file, once per worker process."""
    return ByteBpe(path)


def shipped(docs: DataFrame, path: str) -> str:
    """The path under which tasks find a vocabulary; its file goes to every executor that has none there."""
    if os.path.exists(path):
        docs.sparkSession.sparkContext.addFile(path)
    return path


def found_path(path: str) -> str:
    """In a task: the file at the path, or the one that was sent along."""
    return path if os.path.exists(path) else SparkFiles.get(os.path.basename(path))


def vocabulary_path(name: str = "byte_bpe_50k", directory: str | None = None) -> str:
    return os.path.join(directory or os.environ.get("WEFTLINE_TOKENIZERS", TOKENIZER_DIR), f"{name}.tiktoken")


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids): the token ids of each row's text. No shuffle."""
    path = shipped(docs, path or vocabulary_path())
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(found_path(path))
        for batch in batches:
            flat: list[np.ndarray] = []
            ends = [0]
            for value in batch.column(1):
                ids = bpe.encode(value.as_py())
                flat.append(np.array(ids, dtype=np.int32))
                ends.append(ends[-1] + len(ids))
            values = np.concatenate(flat) if flat else np.empty(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {key_type}, ids array<int>")


def count_tokens(docs: DataFrame, columns: list[str], text: str = "text", path: str | None = None) -> DataFrame:
    """The given columns with n_tokens, the number of token ids of the text. No shuffle."""
    path = shipped(docs, path or vocabulary_path())
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns) + ", n_tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(found_path(path))
        for batch in batches:
            counts = pa.array([len(bpe.encode(v.as_py())) for v in batch.column(len(columns))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], counts], names=[*columns, "n_tokens"])

    return docs.select(*columns, text).mapInArrow(run, schema)


def decode_corpus(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """(key, text): the text of each row's ids; null ids give null."""
    path = shipped(encoded, path or vocabulary_path())
    key_type = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(found_path(path))
        for batch in batches:
            texts = pa.array([None if (v := x.as_py()) is None else bpe.decode(v) for x in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=[key, "text"])

    return encoded.select(key, ids).mapInArrow(run, f"`{key}` {key_type}, text string")
