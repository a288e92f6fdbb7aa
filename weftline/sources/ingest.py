"""Taking records, notes and documents into a store, with injected embedders and models."""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.spans import chunk_documents, split_with_overlap
from weftline.functions.text import source_label
from weftline.operators.strategies import continuation_prompt, reflection_prompt, strategy_for
from weftline.session import frame


class Embedder(Protocol):
    """Texts to vectors of one dimension; must be picklable, as it runs in the workers."""

    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class ChatClient(Protocol):
    """A model: system prompt and user prompt to a response."""

    def chat(self, system: str | None, user: str) -> str: ...


class HashEmbedder:
    """A deterministic embedder for tests: signed hashes of words."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dim
            for word in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                v[h % self.dim] += 1.0 if h >> 40 & 1 else -1.0
            norm = sum(x * x for x in v) ** 0.5
            out.append([x / norm for x in v] if norm else v)
        return out


def mean_unit(vectors: list[list[float]]) -> list[float]:
    mean = [sum(x) / len(vectors) for x in zip(*vectors)]
    norm = sum(x * x for x in mean) ** 0.5
    return [x / norm for x in mean] if norm else mean


def embed_long(embedder: Embedder, text: str, max_tokens: int = 512) -> list[float]:
    """One vector of a text; a text of more than four bytes a token is embedded in windows and pooled."""
    most = max_tokens * 4
    if len(text.encode()) <= most:
        return embedder.embed([text])[0]
    parts = split_with_overlap(text, most)
    return mean_unit(embedder.embed(parts)) if parts else embedder.embed([text])[0]


def embed_column(rows: DataFrame, key: str, text: str, embedder: Embedder) -> DataFrame:
    """(key, embedding) of each row with a text."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield frame(**{key: batch[key]}, embedding=[embed_long(embedder, t) for t in batch[text]])

    return rows.select(key, text).where(F.col(text).isNotNull()).mapInPandas(run, f"`{key}` {kind}, embedding array<float>")


def backfill_embeddings(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """(chunk_id, embedding) of all chunks, to replace what there was."""
    return embed_column(chunks.select(F.col("id").alias("chunk_id"), "content"), "chunk_id", "content", embedder)


def check_dims(records: DataFrame, dim: int) -> DataFrame:
    """records, failing on a missing content or a vector of another dimension."""
    bad = F.col("content").isNull() | F.col("embedding").isNull() | (F.size("embedding") != dim)
    return records.withColumn("embedding", F.when(bad, F.raise_error(F.lit(f"a record needs content and {dim} dimensions"))).otherwise(F.col("embedding")))


def ingest_records(records: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """(chunks, mentions) of records (seq, content, embedding, source?, metadata?, entities array<struct<name,entity_type>>)."""
    good = check_dims(records, dim)
    chunks = good.select("seq", "content", "embedding", *[c for c in ("source", "metadata") if c in records.columns])
    if "entities" not in records.columns:
        return chunks, None
    mentions = good.select("seq", F.posexplode("entities").alias("pos", "e")).select("seq", "pos", "e.*")
    return chunks, mentions


def document_chunks(docs: DataFrame, size: int = 2000, slack: int = 200) -> DataFrame:
    """(doc_id, index, content, source) of each document's chunks; several chunks number their source."""
    spans = chunk_documents(docs, size=size, slack=slack)
    totals = spans.groupBy("doc_id").agg(F.count("*").alias("total"))
    return spans.join(totals, "doc_id").join(docs.select("doc_id", "source"), "doc_id").select("doc_id", "index", F.col("text").alias("content"), source_label(F.col("source"), F.col("index"), F.col("total")).alias("source"))


def ask_models(units: DataFrame, client: ChatClient) -> DataFrame:
    """(unit_id, kind, chunk_id, community_id, model, response) of each work unit that the model answers, asked in the workers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield frame(**{c: batch[c] for c in _UNIT}, response=[_ask(client, s, u) for s, u in zip(batch["system_prompt"], batch["user_prompt"])])

    return _whole_units(units).mapInPandas(run, _REPLY).where("response is not null")


def extract_with_reflection(units: DataFrame, client: ChatClient, rounds: int = 2) -> DataFrame:
    """Replies as of ask_models to extraction units, each asked again for what was missed.

    After a round that found something the model is asked whether anything was
    missed; if its answer holds a yes it is asked for the rest, at most `rounds`
    times. What the rounds found is one reply, as triple lines. A passage's rounds
    follow each other in one worker, and passages do not wait for each other.
    """

    def one(model: str, system: str | None, user: str) -> str | None:
        strategy = strategy_for(model)
        content = user.partition("\n\n")[2] or user
        response = _ask(client, system, user)
        if response is None:
            return None
        found = fresh = strategy.parse(response)
        for _ in range(rounds):
            if not fresh or "yes" not in (_ask(client, *reflection_prompt(content, found)) or "").lower():
                break
            fresh = strategy.parse(_ask(client, *continuation_prompt(content, found, strategy)) or "")
            found = found + fresh
        if not found:
            return response
        node = lambda name, kind: f"{name} ({kind})" if kind else name
        lines = [f"{node(h, ht)} -[{r}]-> {node(t, tt)}" for h, ht, r, t, tt in found]
        return "\n".join(lines) if not strategy.as_json else json.dumps({"entities": [dict(zip(("head", "head_type", "relation", "tail", "tail_type"), t)) for t in found]}, ensure_ascii=False)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield frame(**{c: batch[c] for c in _UNIT}, response=[one(*x) for x in zip(batch["model"], batch["system_prompt"], batch["user_prompt"])])

    return _whole_units(units).mapInPandas(run, _REPLY).where("response is not null")


_UNIT = ["unit_id", "kind", "chunk_id", "community_id", "model"]
_REPLY = "unit_id string, kind string, chunk_id bigint, community_id bigint, model string, response string"


def _ask(client: ChatClient, system: str | None, user: str) -> str | None:
    """The response, or None if the model fails: the unit stays pending."""
    try:
        return client.chat(system, user)
    except Exception as err:
        print(f"no response: {err}", file=sys.stderr)
        return None


def _whole_units(units: DataFrame) -> DataFrame:
    """Units with every column that asking needs; ids without nulls in pandas would be floats, so absent ones are 0."""
    has = lambda c, kind: F.col(c) if c in units.columns else F.lit(None).cast(kind)
    ids = [F.coalesce(has(c, "bigint"), F.lit(0)).cast("bigint").alias(c) for c in ("chunk_id", "community_id")]
    return units.select("unit_id", "kind", *ids, "model", has("system_prompt", "string").alias("system_prompt"), "user_prompt")
