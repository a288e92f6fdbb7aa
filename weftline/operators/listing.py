"""Scans, lookups, sorts and limits over one store's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class NotFound(KeyError):
    pass


def limited(rows: DataFrame, limit: int | None) -> DataFrame:
    """At most limit rows; None or a negative limit is none."""
    return rows if limit is None or limit < 0 else rows.limit(limit)


def list_stores(stores: DataFrame) -> DataFrame:
    return stores.orderBy("name")


def list_chunks(chunks: DataFrame, store: str) -> DataFrame:
    return chunks.where(F.col("store") == store).orderBy("id")


def list_recent_chunks(chunks: DataFrame, store: str, limit: int) -> DataFrame:
    """The newest chunks by id, newest first."""
    return limited(chunks.where(F.col("store") == store).orderBy(F.desc("id")), limit)


def chunks_by_ids(chunks: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """The chunks named by a table of ids, in no order; unknown ids give nothing."""
    return chunks.join(ids.select(F.col(column).alias("id")).distinct(), "id", "left_semi")


def list_entities(entities: DataFrame, store: str) -> DataFrame:
    return entities.where(F.col("store") == store).orderBy("name", "id")


def entity_by_name(entities: DataFrame, store: str, name: str) -> dict:
    """Exact and case-sensitive; raises NotFound."""
    return _one(entities.where((F.col("store") == store) & (F.col("name") == name)), name)


def entities_by_name(entities: DataFrame, names: DataFrame) -> DataFrame:
    """The entities that a table of (store, name) names, exactly; unknown names give nothing."""
    return entities.join(names.select("store", "name").distinct(), ["store", "name"], "left_semi")


def entity_by_id(entities: DataFrame, id_: int) -> dict:
    return _one(entities.where(F.col("id") == id_), id_)


def _one(rows: DataFrame, what) -> dict:
    found = rows.limit(1).collect()
    if not found:
        raise NotFound(what)
    return found[0].asDict(recursive=True)


def list_relations(relations: DataFrame, store: str) -> DataFrame:
    return relations.where(F.col("store") == store)


def relations_of(relations: DataFrame, entities: DataFrame, column: str = "id") -> DataFrame:
    """(entity_id, relation columns): relations with either end among the entities; a loop counts once.

    Two equi-joins, as a join on either end could use neither.
    """
    ids = entities.select(F.col(column).alias("entity_id")).distinct()
    heads = relations.join(ids, relations.head_id == ids.entity_id)
    tails = relations.join(ids, relations.tail_id == ids.entity_id).where("head_id <> tail_id")
    return heads.unionByName(tails)


def relations_by_canonical(relations: DataFrame, store: str, canonical: str) -> DataFrame:
    return relations.where((F.col("store") == store) & ((F.col("canonical_relation") == canonical) | (F.col("relation") == canonical)))


def list_communities(communities: DataFrame, store: str) -> DataFrame:
    return communities.where(F.col("store") == store).orderBy("level", "id")


def child_communities(communities: DataFrame, parents: DataFrame) -> DataFrame:
    """The communities whose parent is among the ids of a table (id)."""
    return communities.join(parents.select(F.col("id").alias("parent_id")).distinct(), "parent_id", "left_semi")


def chunks_of_entities(chunk_entities: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_id, chunk_id) of the entities of a table (id)."""
    return chunk_entities.join(entities.select(F.col("id").alias("entity_id")).distinct(), "entity_id", "left_semi").select("entity_id", "chunk_id")


def log_view(chunks: DataFrame, store: str, limit: int) -> DataFrame:
    """(id, line): the newest chunks as `time [source] content`; an unknown store gives nothing."""
    line = F.concat_ws(" ", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"), F.concat(F.lit("["), F.coalesce("source", F.lit("-")), F.lit("]")), F.col("content"))
    return list_recent_chunks(chunks, store, limit).select("id", line.alias("line"))


def nth_chunk(spans: DataFrame, n: int, index: Column | None = None) -> DataFrame:
    """The n-th span of each source; none past the end."""
    return spans.where((F.col("index") if index is None else index) == n)


def entity_page(entities: DataFrame, store: str, limit: int = 100) -> DataFrame:
    """The first entities by name, each with the number of all."""
    own = entities.where(F.col("store") == store)
    return limited(own.orderBy("name", "id"), limit).crossJoin(F.broadcast(own.agg(F.count("*").alias("total"))))
