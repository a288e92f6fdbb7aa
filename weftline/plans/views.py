"""The model's tables as views over the shared test tables, for Spark and as SQL.

A key names one record however often its row appears, so every view takes the
distinct rows. chunk_entities comes from the triples' ends, memberships from
ids, entity vectors from the embeddings table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import fold_key
from weftline.session import table


class Views:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def t(self, name: str) -> DataFrame:
        return table(self.spark, self.root, name)

    @property
    def stores(self) -> DataFrame:
        return self.t("stores")

    @property
    def chunks(self) -> DataFrame:
        return self.t("documents").where("text is not null").select(F.col("doc_id").alias("id"), "store", F.col("text").alias("content"), "source", F.lit(None).cast("string").alias("metadata"), "created_at")

    @property
    def vectors(self) -> DataFrame:
        """Chunk vectors whose length is the dimension of their store."""
        dims = F.broadcast(self.stores.select(F.col("name").alias("store"), "dim"))
        rows = self.t("chunk_embeddings").select("chunk_id", "store", "embedding").join(dims, "store").where((F.size("embedding") == F.col("dim")) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)))
        return rows.select("chunk_id", "store", "embedding").distinct()

    @property
    def entities(self) -> DataFrame:
        return self.t("entities").select("id", "store", "name", "entity_type", F.col("props_json").alias("properties")).distinct()

    @property
    def relations(self) -> DataFrame:
        return self.t("relations").select("id", "store", "head_id", "tail_id", "relation", "canonical_relation", F.col("props_json").alias("properties")).distinct()

    @property
    def triples(self) -> DataFrame:
        return self.t("triples").select(F.col("triple_id").alias("seq"), "chunk_id", "store", "model", "head", "head_type", "relation", "tail", "tail_type").distinct()

    @property
    def communities(self) -> DataFrame:
        return self.t("communities").select("id", "store", "level", "parent_id", "summary", "modularity").distinct()

    @property
    def replies(self) -> DataFrame:
        return self.t("replies").select(F.col("reply_id").alias("seq"), "kind", "chunk_id", "community_id", "model", "response").distinct()

    @property
    def synonyms(self) -> DataFrame:
        return self.t("vocab").where("kind = 'relation'").select(F.col("label").alias("raw"), "canonical")

    @property
    def type_synonyms(self) -> DataFrame:
        return self.t("vocab").where("kind = 'entity_type'").select(F.lower("label").alias("raw"), F.lower("canonical").alias("canonical"))

    @property
    def extractions(self) -> DataFrame:
        return self.replies.where("kind = 'extract' and chunk_id is not null").select("chunk_id").distinct()

    @property
    def chunk_entities(self) -> DataFrame:
        ids = self.entities.withColumn("k", fold_key(F.col("name"))).where("k <> ''").groupBy("store", "k").agg(F.min("id").alias("entity_id"))
        t = self.triples
        ends = t.select("store", "chunk_id", fold_key(F.col("head")).alias("k")).union(t.select("store", "chunk_id", fold_key(F.col("tail"))))
        return ends.where("chunk_id is not null").join(ids, ["store", "k"]).select("chunk_id", "entity_id").distinct()

    @property
    def entity_communities(self) -> DataFrame:
        """Entities with a type go round all communities by their ids; those without belong to none."""
        known = self.communities.select(F.col("id").alias("community_id")).distinct()
        last = known.agg(F.max("community_id").alias("last"))
        made = self.entities.where("entity_type is not null").crossJoin(F.broadcast(last)).select(F.col("id").alias("entity_id"), (F.col("id") % F.col("last") + 1).alias("community_id"))
        return made.join(known, "community_id", "left_semi").select("entity_id", "community_id")

    @property
    def entity_embeddings(self) -> DataFrame:
        return self.t("embeddings").select(F.col("vec_id").alias("entity_id"), "embedding").join(self.entities.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")


#: The same views as SQL.
SQL = {
    "v_chunks": "SELECT doc_id AS id, store, text AS content, source, created_at FROM documents WHERE text IS NOT NULL",
    "v_vectors": "SELECT DISTINCT e.chunk_id, e.store, e.embedding::DOUBLE[] AS embedding FROM chunk_embeddings e JOIN stores s ON e.store = s.name WHERE len(e.embedding) = s.dim AND len(list_filter(e.embedding, lambda x: x IS NULL OR isnan(x))) = 0",
    "v_entities": "SELECT DISTINCT id, store, name, entity_type, props_json AS properties FROM entities",
    "v_relations": "SELECT DISTINCT id, store, head_id, tail_id, relation, canonical_relation, props_json AS properties FROM relations",
    "v_triples": "SELECT DISTINCT triple_id AS seq, chunk_id, store, model, head, head_type, relation, tail, tail_type FROM triples",
    "v_communities": "SELECT DISTINCT id, store, level, parent_id, summary, modularity FROM communities",
    "v_replies": "SELECT DISTINCT reply_id AS seq, kind, chunk_id, community_id, model, response FROM replies",
    "v_synonyms": "SELECT label AS raw, canonical FROM vocab WHERE kind = 'relation'",
    "v_type_synonyms": "SELECT lower(label) AS raw, lower(canonical) AS canonical FROM vocab WHERE kind = 'entity_type'",
    "v_extractions": "SELECT DISTINCT chunk_id FROM v_replies WHERE kind = 'extract' AND chunk_id IS NOT NULL",
    "v_keys": r"SELECT store, k, min(id) AS entity_id FROM (SELECT store, id, translate(regexp_replace(name, '^[\s\pZ]+|[\s\pZ]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM v_entities) WHERE k <> '' GROUP BY 1, 2",
    "v_chunk_entities": r"SELECT DISTINCT chunk_id, entity_id FROM (SELECT store, chunk_id, translate(regexp_replace(n, '^[\s\pZ]+|[\s\pZ]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM (SELECT store, chunk_id, head AS n FROM v_triples UNION ALL SELECT store, chunk_id, tail FROM v_triples)) JOIN v_keys USING (store, k) WHERE chunk_id IS NOT NULL",
    "v_entity_communities": "SELECT id AS entity_id, id % (SELECT max(id) FROM v_communities) + 1 AS community_id FROM v_entities WHERE entity_type IS NOT NULL AND id % (SELECT max(id) FROM v_communities) + 1 IN (SELECT id FROM v_communities)",
    "v_entity_embeddings": "SELECT vec_id AS entity_id, embedding::DOUBLE[] AS embedding FROM embeddings WHERE vec_id IN (SELECT id FROM v_entities)",
    "v_edges": "SELECT store, least(head_id, tail_id) AS src, greatest(head_id, tail_id) AS dst, count(*)::DOUBLE AS weight FROM v_relations WHERE head_id <> tail_id GROUP BY ALL",
}


def with_views(body: str, *names: str) -> str:
    """body with the views it needs (and those they need) in front."""
    needed: list[str] = []

    def need(name: str) -> None:
        for other in SQL:
            if other != name and other in SQL[name] and other not in needed:
                need(other)
        if name not in needed:
            needed.append(name)

    for name in names or [n for n in SQL if n in body]:
        need(name)
    ctes = ", ".join(f"{n} AS ({SQL[n]})" for n in needed)
    text = body.strip()
    if not ctes:
        return text
    if text.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes}, {text[14:]}"
    if text.upper().startswith("WITH "):
        return f"WITH {ctes}, {text[5:]}"
    return f"WITH {ctes} {text}"
