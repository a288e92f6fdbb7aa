"""Entity resolution, synonyms and merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import fold_key, normalize_type, trim_unicode
from weftline.operators.components import connected_components
from weftline.operators.retrieval import vector_top_k


def resolve_entities(mentions: DataFrame) -> DataFrame:
    """(store, key, id, name, entity_type, properties) of mentions (store, seq, name, entity_type, properties).

    One entity for each folded name of a store. The first mention gives the
    display name and the id, its seq; the last non-null type and properties hold.
    Null and blank names are left out.
    """
    rows = mentions.withColumn("key", fold_key(F.col("name"))).where("key <> ''")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))
    return rows.groupBy("store", "key").agg(F.min("seq").alias("id"), F.min_by(trim_unicode(F.col("name")), "seq").alias("name"), last("entity_type").alias("entity_type"), last("properties").alias("properties"))


def mentions_of_triples(triples: DataFrame) -> DataFrame:
    """(store, seq, name, entity_type, properties, chunk_id): head and tail of each triple; the head comes first."""
    none = F.lit(None).cast("string")
    head = triples.select("store", (F.col("seq") * 2).alias("seq"), F.col("head").alias("name"), F.col("head_type").alias("entity_type"), none.alias("properties"), "chunk_id")
    tail = triples.select("store", (F.col("seq") * 2 + 1).alias("seq"), F.col("tail").alias("name"), F.col("tail_type").alias("entity_type"), none.alias("properties"), "chunk_id")
    return head.unionByName(tail)


def persist_triples(triples: DataFrame, synonyms: DataFrame) -> dict[str, DataFrame]:
    """entities, relations and chunk_entities of triples (store, seq, chunk_id, head, head_type, relation, tail, tail_type).

    Whole triples only: one with a null or blank end or relation is left out.
    Relations are not deduplicated; links are.
    """
    whole = triples.where((F.trim("head") != "") & (F.trim("tail") != "") & (F.trim("relation") != ""))
    mentions = mentions_of_triples(whole)
    entities = resolve_entities(mentions)
    ids = entities.select("store", "key", F.col("id").alias("entity_id"))
    keyed = whole.withColumn("hk", fold_key(F.col("head"))).withColumn("tk", fold_key(F.col("tail")))
    heads = ids.select("store", F.col("key").alias("hk"), F.col("entity_id").alias("head_id"))
    tails = ids.select("store", F.col("key").alias("tk"), F.col("entity_id").alias("tail_id"))
    relations = keyed.join(heads, ["store", "hk"]).join(tails, ["store", "tk"]).select(F.col("seq").alias("id"), "store", "chunk_id", "head_id", "tail_id", "relation")
    table = synonyms.select(F.col("raw").alias("relation"), F.col("canonical").alias("canonical_relation"))
    links = relations.select("chunk_id", F.col("head_id").alias("entity_id")).union(relations.select("chunk_id", "tail_id")).distinct()
    return {"entities": entities.drop("key"), "relations": relations.drop("chunk_id").join(table, "relation", "left"), "chunk_entities": links}


def upsert_synonyms(old: DataFrame, new: DataFrame, lower: bool = False) -> DataFrame:
    """(raw, canonical) after adding new (seq, raw, canonical); the last of a raw value holds."""
    fold = (lambda c: F.lower(c)) if lower else (lambda c: F.col(c))
    fresh = new.select("seq", fold("raw").alias("raw"), fold("canonical").alias("canonical")).groupBy("raw").agg(F.max_by("canonical", "seq").alias("canonical"))
    return old.join(fresh.select("raw"), "raw", "left_anti").select("raw", "canonical").unionByName(fresh)


def remove_synonym(synonyms: DataFrame, raw: str) -> DataFrame:
    return synonyms.where(F.col("raw") != raw)


def synonyms_of(synonyms: DataFrame, canonical: str) -> DataFrame:
    return synonyms.where(F.col("canonical") == canonical).select("raw").orderBy("raw")


def normalize_types(entities: DataFrame, synonyms: DataFrame) -> DataFrame:
    """entities with normalized_type: the canonical type, else the type in lower case."""
    table = synonyms.select(F.col("raw").alias("_t"), F.col("canonical").alias("_c"))
    return entities.withColumn("_t", F.lower("entity_type")).join(table, "_t", "left").withColumn("normalized_type", normalize_type(F.col("entity_type"), F.col("_c"))).drop("_t", "_c")


def checkpoint(old: DataFrame, results: DataFrame) -> DataFrame:
    """extractions after results (chunk_id, model, triple_count, extracted_at, seq); the last of a chunk holds."""
    fresh = results.groupBy("chunk_id").agg(F.max_by(F.struct("model", "triple_count", "extracted_at"), "seq").alias("r")).select("chunk_id", "r.*")
    return old.join(fresh.select("chunk_id"), "chunk_id", "left_anti").unionByName(fresh)


class MergeError(ValueError):
    pass


def merge_targets(merges: DataFrame, entities: DataFrame) -> DataFrame:
    """(source, target) of merges after following chains, every source to one surviving target.

    A merge into itself or with an unknown end is left out. Of merges that form a
    chain or circle the least id survives unless a target is never a source.
    """
    ids = entities.select("id")
    good = merges.select("target", "source").where("target <> source").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
    groups = connected_components(good, "source", "target")
    finals = good.select(F.col("target").alias("node")).distinct().join(good.select(F.col("source").alias("node")).distinct(), "node", "left_anti").withColumn("final", F.lit(True))
    chosen = groups.join(finals, "node", "left").groupBy("component").agg(F.coalesce(F.min(F.when(F.col("final"), F.col("node"))), F.min("node")).alias("target"))
    return groups.join(chosen, "component").where("node <> target").select(F.col("node").alias("source"), "target")


def check_merge(entities: DataFrame, target: int, source: int) -> None:
    if target == source:
        raise MergeError("an entity cannot be merged into itself")
    if entities.where(F.col("id").isin(target, source)).select("id").distinct().count() != 2:
        raise MergeError("both entities must exist")


def merge_entities(tables: dict[str, DataFrame], merges: DataFrame, merged_at=None) -> dict[str, DataFrame]:
    """entities, relations, chunk_entities, entity_communities, entity_embeddings and entity_merges after merges (target, source).

    Ends move to the target, links that double are dropped, loops may result, the
    sources and their vectors go, and each merge is logged with the source's name.
    """
    moves = merge_targets(merges, tables["entities"])
    gone = moves.select(F.col("source").alias("id"))

    def move(rows: DataFrame, column: str) -> DataFrame:
        m = moves.select(F.col("source").alias(column), F.col("target").alias("_to"))
        order = rows.columns
        return rows.join(m, column, "left").withColumn(column, F.coalesce("_to", column)).select(*order)

    out = {"entities": tables["entities"].join(gone, "id", "left_anti"), "relations": move(move(tables["relations"], "head_id"), "tail_id")}
    for t in ("chunk_entities", "entity_communities"):
        if t in tables:
            out[t] = move(tables[t], "entity_id").distinct()
    if "entity_embeddings" in tables:
        out["entity_embeddings"] = tables["entity_embeddings"].join(gone.withColumnRenamed("id", "entity_id"), "entity_id", "left_anti")
    names = tables["entities"].select(F.col("id").alias("source"), F.col("name").alias("merged_entity_name"))
    log = moves.join(names, "source").select(F.col("target").alias("target_entity_id"), "merged_entity_name", F.lit(merged_at).cast("timestamp").alias("merged_at"))
    out["entity_merges"] = tables["entity_merges"].unionByName(log) if "entity_merges" in tables else log
    return out


def merge_history(log: DataFrame, target: int) -> DataFrame:
    return log.where(F.col("target_entity_id") == target).orderBy("merged_at", "merged_entity_name")


def similar_entities(vectors: DataFrame, query: list[float], threshold: float, limit: int) -> DataFrame:
    """(entity_id, name, score) of vectors (entity_id, name, embedding) at least threshold similar to a query vector."""
    best = vector_top_k(vectors, query, limit, key="entity_id").where(F.col("score") >= threshold)
    named = vectors.select("entity_id", "name").join(F.broadcast(best), "entity_id")
    return named.select("entity_id", "name", "score").orderBy(F.desc("score"), "entity_id")
