"""Counts and latest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def store_stats(stores: DataFrame, chunks: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(name, dim, chunks, entities, relations) of every store."""
    out = stores.select("name", "dim")
    for label, rows in (("chunks", chunks), ("entities", entities), ("relations", relations)):
        out = out.join(rows.groupBy(F.col("store").alias("name")).agg(F.count("*").alias(label)), "name", "left")
    return out.fillna(0, ["chunks", "entities", "relations"])


def full_stats(stats: DataFrame, communities: DataFrame, pending_extract: DataFrame, pending_summarize: DataFrame) -> DataFrame:
    """store_stats with communities, pending_extract and pending_summarize."""
    out = stats
    for label, rows in (("communities", communities), ("pending_extract", pending_extract), ("pending_summarize", pending_summarize)):
        out = out.join(rows.groupBy(F.col("store").alias("name")).agg(F.count("*").alias(label)), "name", "left")
    return out.fillna(0, ["communities", "pending_extract", "pending_summarize"])


def relation_types(relations: DataFrame) -> DataFrame:
    """(store, relation, canonical_relation, n): the canonical of the row with the lowest id."""
    return relations.groupBy("store", "relation").agg(F.min_by("canonical_relation", "id").alias("canonical_relation"), F.count("*").alias("n"))


def level_summary(communities: DataFrame) -> DataFrame:
    """(store, level, n, summarised)."""
    return communities.groupBy("store", "level").agg(F.count("*").alias("n"), F.count("summary").alias("summarised"))


def community_members(members: DataFrame) -> DataFrame:
    """(community_id, size, names): the names sorted."""
    return members.groupBy("community_id").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("name")).alias("names"))


def latest_per_group(rows: DataFrame, group: str, order: str = "id") -> DataFrame:
    """The row with the highest order of each group; partial aggregation, no window."""
    columns = rows.columns
    return rows.groupBy(group).agg(F.max_by(F.struct(*columns), order).alias("r")).select("r.*")


def history(rows: DataFrame, group: str, value: str) -> DataFrame:
    return rows.where(F.col(group) == value).orderBy(F.desc("id"))


def canonical_relations(synonyms: DataFrame) -> DataFrame:
    return synonyms.select("canonical").distinct()
