"""Joins between chunks, entities, relations and communities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def entities_of_chunks(entities: DataFrame, chunk_entities: DataFrame) -> DataFrame:
    """(chunk_id, entity columns)."""
    return chunk_entities.join(entities, chunk_entities.entity_id == entities.id).drop("entity_id")


def members_of_communities(entities: DataFrame, entity_communities: DataFrame) -> DataFrame:
    """(community_id, entity columns)."""
    return entity_communities.join(entities, entity_communities.entity_id == entities.id).drop("entity_id")


def communities_of_entities(communities: DataFrame, entity_communities: DataFrame) -> DataFrame:
    """(entity_id, community columns)."""
    return entity_communities.join(communities, entity_communities.community_id == communities.id).drop("community_id")


def entity_vectors(entities: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(store, entity_id, name, embedding); entities without a vector are left out."""
    return entities.join(embeddings, entities.id == embeddings.entity_id).select("store", "entity_id", "name", "embedding")


def chunk_vectors(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(store, chunk_id, embedding); chunks without a vector are left out."""
    return chunks.select("id", "store").join(embeddings.select("chunk_id", "embedding"), F.col("id") == F.col("chunk_id")).select("store", "chunk_id", "embedding")


def pending_chunks(chunks: DataFrame, extractions: DataFrame) -> DataFrame:
    """Chunks that were never extracted."""
    return chunks.join(extractions.select(F.col("chunk_id").alias("id")), "id", "left_anti")


def unembedded_entities(entities: DataFrame, embeddings: DataFrame) -> DataFrame:
    return entities.join(embeddings.select(F.col("entity_id").alias("id")), "id", "left_anti")


def unclustered_entities(entities: DataFrame, entity_communities: DataFrame) -> DataFrame:
    return entities.join(entity_communities.select(F.col("entity_id").alias("id")), "id", "left_anti")


def pending_communities(communities: DataFrame) -> DataFrame:
    """Communities to be summarised now: without a summary, and no child without one. '' is a summary."""
    open_children = communities.where("summary is null and parent_id is not null").select(F.col("parent_id").alias("id")).distinct()
    return communities.where("summary is null").join(open_children, "id", "left_anti")


def child_summaries(communities: DataFrame) -> DataFrame:
    """(parent_id, id, summary) of children that have a summary."""
    return communities.where("summary is not null and parent_id is not null").select("parent_id", "id", "summary")


def triples_view(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, store, head, relation, tail) with names for ids; an unknown entity is ''."""
    names = entities.select("id", "name")
    heads = names.select(F.col("id").alias("head_id"), F.col("name").alias("head"))
    tails = names.select(F.col("id").alias("tail_id"), F.col("name").alias("tail"))
    joined = relations.join(heads, "head_id", "left").join(tails, "tail_id", "left")
    return joined.select("id", "store", F.coalesce("head", F.lit("")).alias("head"), "relation", F.coalesce("tail", F.lit("")).alias("tail"))


def relations_view(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_id, relation_id, direction, relation, other_id, other, other_type): each relation from both ends.

    A loop shows once, as outgoing. An unknown entity is named entity_<id>.
    """
    out = relations.select(F.col("head_id").alias("entity_id"), F.col("id").alias("relation_id"), F.lit("outgoing").alias("direction"), "relation", F.col("tail_id").alias("other_id"))
    back = relations.where("head_id <> tail_id").select(F.col("tail_id").alias("entity_id"), F.col("id").alias("relation_id"), F.lit("incoming").alias("direction"), "relation", F.col("head_id").alias("other_id"))
    names = entities.select(F.col("id").alias("other_id"), F.col("name").alias("other"), F.col("entity_type").alias("other_type"))
    joined = out.unionByName(back).join(names, "other_id", "left")
    return joined.select("entity_id", "relation_id", "direction", "relation", "other_id", F.coalesce("other", F.concat(F.lit("entity_"), F.col("other_id").cast("string"))).alias("other"), "other_type")


def canonical_lookup(relations: DataFrame, synonyms: DataFrame) -> DataFrame:
    """relations with canonical_relation looked up exactly, one hop; unknown relations give null."""
    table = synonyms.select(F.col("raw").alias("relation"), F.col("canonical").alias("_c"))
    return relations.drop("canonical_relation").join(table, "relation", "left").withColumnRenamed("_c", "canonical_relation")


def refresh_canonical(relations: DataFrame, synonyms: DataFrame) -> DataFrame:
    """relations with known canonicals put in; others keep theirs; refreshed tells which rows matched."""
    table = synonyms.select(F.col("raw").alias("relation"), F.col("canonical").alias("_c"))
    joined = relations.join(table, "relation", "left")
    return joined.withColumn("canonical_relation", F.coalesce("_c", "canonical_relation")).withColumn("refreshed", F.col("_c").isNotNull()).drop("_c")
