"""Queries over scans, joins, aggregates and writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.text import embed_text, fold_key
from weftline.operators import aggregates, joins, listing, resolve
from weftline.operators.numbering import with_ids
from weftline.plans.views import Views, with_views
from weftline.sources import catalog
from weftline.sources.jsonl import export_lines

STORE = "handbook"


def same_type_merges(v):
    """(target, source): entities whose names differ by case and outer blanks only, into the first, over all stores."""
    named = v.entities.withColumn("k", fold_key(F.col("name"))).where("k <> ''")
    first = named.groupBy("k").agg(F.min("id").alias("target"))
    return named.join(first, "k").where("id <> target").select("target", F.col("id").alias("source"))


def queries():
    q = {}

    def add(f):
        q[f.__name__] = lambda spark, root: f(Views(spark, root))
        return f

    @add
    def list_stores(v):
        return listing.list_stores(v.stores).select("name", "dim")

    @add
    def delete_store(v):
        # what is left of each table once a store is gone
        tables = {"stores": v.stores, "chunks": v.chunks, "entities": v.entities, "relations": v.relations, "communities": v.communities, "chunk_entities": v.chunk_entities}
        left = catalog.delete_store(tables, STORE)
        out = None
        for name, df in left.items():
            part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
            out = part if out is None else out.union(part)
        return out

    @add
    def list_chunks(v):
        return listing.list_chunks(v.chunks, STORE).select("id", "source", F.length("content").cast("bigint").alias("n_chars"))

    @add
    def recent_chunks(v):
        return listing.list_recent_chunks(v.chunks, STORE, 25).select("id", "source")

    @add
    def chunks_by_ids(v):
        return listing.chunks_by_ids(v.chunks, v.t("hits").select(F.col("chunk_id").alias("id"))).select("id", "store")

    @add
    def log_view(v):
        return listing.log_view(v.chunks, STORE, 10)

    @add
    def nth_chunk(v):
        return listing.nth_chunk(v.t("chunk_spans").select("span_id", "source", "span_index").distinct(), 1, F.col("span_index")).select("span_id", "source")

    @add
    def list_entities(v):
        return listing.list_entities(v.entities, STORE).select("id", "name", "entity_type")

    @add
    def entity_page(v):
        return listing.entity_page(v.entities, STORE, 50).select("id", "name", "total")

    @add
    def entity_by_name(v):
        names = v.t("triples").select("store", F.col("head").alias("name")).distinct()
        return listing.entities_by_name(v.entities, names).select("id", "store", "name")

    @add
    def list_relations(v):
        return listing.list_relations(v.relations, STORE).select("id", "head_id", "tail_id", "relation")

    @add
    def relations_for_entity(v):
        wanted = v.entities.where("store = 'handbook'").select("id")
        return listing.relations_of(v.relations, wanted).select("entity_id", "id", "head_id", "tail_id")

    @add
    def relations_by_canonical(v):
        return listing.relations_by_canonical(v.relations, STORE, "depends_on").select("id", "relation", "canonical_relation")

    @add
    def list_communities(v):
        return listing.list_communities(v.communities, STORE).select("id", "level", "parent_id")

    @add
    def child_communities(v):
        return listing.child_communities(v.communities, v.communities).select("parent_id", "id", "level")

    @add
    def chunks_for_entity(v):
        return listing.chunks_of_entities(v.chunk_entities, v.entities.where(F.col("store") == STORE))

    @add
    def entities_for_chunk(v):
        return joins.entities_of_chunks(v.entities, v.chunk_entities).select("chunk_id", "id", "name")

    @add
    def community_entities(v):
        return joins.members_of_communities(v.entities, v.entity_communities).select("community_id", "id", "name")

    @add
    def entity_communities(v):
        return joins.communities_of_entities(v.communities, v.entity_communities).select("entity_id", "id", "level")

    @add
    def entity_vectors(v):
        return joins.entity_vectors(v.entities, v.entity_embeddings).select("store", "entity_id", "name", F.size("embedding").cast("bigint").alias("dim"))

    @add
    def chunk_vectors(v):
        return joins.chunk_vectors(v.chunks, v.vectors).select("store", "chunk_id", F.size("embedding").cast("bigint").alias("dim"))

    @add
    def pending_extract(v):
        return joins.pending_chunks(v.chunks, v.extractions).select("id", "store")

    @add
    def unembedded_entities(v):
        return joins.unembedded_entities(v.entities, v.entity_embeddings).select("id", embed_text(F.col("name"), F.col("entity_type")).alias("text"))

    @add
    def unclustered_count(v):
        return joins.unclustered_entities(v.entities, v.entity_communities).groupBy("store").agg(F.count("*").alias("n"))

    @add
    def pending_summarize(v):
        return joins.pending_communities(v.communities).select("id", "store", "level")

    @add
    def child_summaries(v):
        return joins.child_summaries(v.communities)

    @add
    def triples_view(v):
        return joins.triples_view(v.relations, v.entities)

    @add
    def relations_view(v):
        return joins.relations_view(v.relations, v.entities)

    @add
    def canonicalise_relations(v):
        return joins.canonical_lookup(v.relations, v.synonyms).select("id", "relation", "canonical_relation")

    @add
    def refresh_canonical(v):
        return joins.refresh_canonical(v.relations, v.synonyms).select("id", "canonical_relation", "refreshed")

    @add
    def store_stats(v):
        return aggregates.store_stats(v.stores, v.chunks, v.entities, v.relations)

    @add
    def full_stats(v):
        stats = aggregates.store_stats(v.stores, v.chunks, v.entities, v.relations)
        return aggregates.full_stats(stats, v.communities, joins.pending_chunks(v.chunks, v.extractions), joins.pending_communities(v.communities))

    @add
    def relation_types(v):
        return aggregates.relation_types(v.relations)

    @add
    def level_summary(v):
        return aggregates.level_summary(v.communities)

    @add
    def community_members(v):
        members = joins.members_of_communities(v.entities, v.entity_communities).where("name is not null")
        return aggregates.community_members(members).select("community_id", "size", F.array_join("names", "|").alias("names"))

    @add
    def latest_per_group(v):
        return aggregates.latest_per_group(v.replies.where("chunk_id is not null"), "chunk_id", "seq").select("chunk_id", "seq", "model")

    @add
    def canonical_relations(v):
        return aggregates.canonical_relations(v.synonyms)

    @add
    def resolve_entities(v):
        return resolve.resolve_entities(resolve.mentions_of_triples(v.triples)).select("store", "key", "id", "name", "entity_type")

    @add
    def persist_triples(v):
        return resolve.persist_triples(v.triples, v.synonyms)["relations"].select("id", "store", "head_id", "tail_id", "relation", "canonical_relation")

    @add
    def persist_links(v):
        return resolve.persist_triples(v.triples, v.synonyms)["chunk_entities"]

    @add
    def upsert_synonyms(v):
        new = v.t("vocab").where("kind = 'relation'").select(F.col("entry_id").alias("seq"), F.col("canonical").alias("raw"), F.col("label").alias("canonical"))
        return resolve.upsert_synonyms(v.synonyms, new)

    @add
    def normalize_types(v):
        return resolve.normalize_types(v.entities, v.type_synonyms).select("id", "normalized_type")

    @add
    def checkpoint_extractions(v):
        old = v.extractions.select("chunk_id", F.lit(None).cast("string").alias("model"), F.lit(0).cast("bigint").alias("triple_count"), F.lit(None).cast("timestamp").alias("extracted_at"))
        results = v.triples.where("chunk_id is not null").groupBy("chunk_id").agg(F.max_by("model", "seq").alias("model"), F.count("*").alias("triple_count"), F.max("seq").alias("seq"))
        results = results.withColumn("extracted_at", F.lit(None).cast("timestamp"))
        return resolve.checkpoint(old, results).select("chunk_id", "model", "triple_count")

    @add
    def merge_entities(v):
        out = resolve.merge_entities({"entities": v.entities, "relations": v.relations, "chunk_entities": v.chunk_entities}, same_type_merges(v))
        return out["relations"].select("id", "head_id", "tail_id")

    @add
    def merge_history(v):
        out = resolve.merge_entities({"entities": v.entities, "relations": v.relations, "chunk_entities": v.chunk_entities}, same_type_merges(v))
        return out["entity_merges"].select("target_entity_id", "merged_entity_name")

    @add
    def synonyms_of(v):
        return resolve.synonyms_of(resolve.remove_synonym(v.synonyms, "relies_on"), "depends_on")

    @add
    def upsert_type_synonyms(v):
        new = v.t("vocab").where("kind = 'entity_type'").select(F.col("entry_id").alias("seq"), F.upper("canonical").alias("raw"), F.col("label").alias("canonical"))
        return resolve.upsert_synonyms(v.type_synonyms, new, lower=True)

    @add
    def merge_links(v):
        return resolve.merge_entities({"entities": v.entities, "relations": v.relations, "chunk_entities": v.chunk_entities}, same_type_merges(v))["chunk_entities"]

    @add
    def add_chunks_ids(v):
        old = v.chunks.where("store = 'handbook'").select("id")
        return with_ids(v.chunks.where("store = 'papers'").select("content", F.col("id").alias("seq")), old, "seq").select("seq", "id")

    @add
    def export_jsonl(v):
        tables = {"store": v.stores.select("name", "dim"), "chunk": v.chunks.drop("created_at"), "entity": v.entities, "relation": v.relations, "community": v.communities}
        return export_lines(tables, STORE).select("ord", "id", F.sha2("json", 256).alias("json"))

    return q


_S = "store = 'handbook'"
_FOLD = "translate(regexp_replace({0}, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_MERGED = f"""
    g AS (SELECT {_FOLD.format('name')} AS k, min(id) AS target FROM v_entities GROUP BY 1 HAVING k <> ''),
    m AS (SELECT id AS source, target FROM v_entities JOIN g ON {_FOLD.format('name')} = k WHERE id <> target)"""
_MENTIONS = f"""
    w AS (SELECT * FROM v_triples WHERE __WHOLE__),
    m AS (SELECT store, seq * 2 AS seq, head AS name, head_type AS t FROM w UNION ALL SELECT store, seq * 2 + 1, tail, tail_type FROM w),
    e AS (SELECT store, {_FOLD.format('name')} AS key, min(seq) AS id, arg_min(regexp_replace(name, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g'), seq) AS name,
          arg_max(t, CASE WHEN t IS NOT NULL THEN seq END) AS entity_type FROM m WHERE {_FOLD.format('name')} <> '' GROUP BY 1, 2)"""


def oracle_sql() -> dict[str, str]:
    raw = {
        "list_stores": "SELECT name, dim FROM stores",
        "delete_store": f"""
            SELECT 'stores' AS table_name, count(*) AS n FROM stores WHERE name <> 'handbook' UNION ALL
            SELECT 'chunks', count(*) FROM v_chunks WHERE NOT {_S} UNION ALL SELECT 'entities', count(*) FROM v_entities WHERE NOT {_S} UNION ALL
            SELECT 'relations', count(*) FROM v_relations WHERE NOT {_S} UNION ALL SELECT 'communities', count(*) FROM v_communities WHERE NOT {_S} UNION ALL
            SELECT 'chunk_entities', count(*) FROM v_chunk_entities WHERE chunk_id NOT IN (SELECT id FROM v_chunks WHERE {_S}) AND entity_id NOT IN (SELECT id FROM v_entities WHERE {_S})""",
        "list_chunks": f"SELECT id, source, length(content) AS n_chars FROM v_chunks WHERE {_S}",
        "recent_chunks": f"SELECT id, source FROM v_chunks WHERE {_S} ORDER BY id DESC LIMIT 25",
        "chunks_by_ids": "SELECT id, store FROM v_chunks WHERE id IN (SELECT chunk_id FROM hits)",
        "log_view": f"SELECT id, concat_ws(' ', strftime(created_at::TIMESTAMP, '%Y-%m-%d %H:%M:%S'), '[' || coalesce(source, '-') || ']', content) AS line FROM v_chunks WHERE {_S} ORDER BY id DESC LIMIT 10",
        "nth_chunk": "SELECT DISTINCT span_id, source FROM chunk_spans WHERE span_index = 1",
        "list_entities": f"SELECT id, name, entity_type FROM v_entities WHERE {_S}",
        "entity_page": f"SELECT id, name, (SELECT count(*) FROM v_entities WHERE {_S}) AS total FROM v_entities WHERE {_S} ORDER BY name NULLS FIRST, id LIMIT 50",
        "entity_by_name": "SELECT id, store, name FROM v_entities WHERE (store, name) IN (SELECT store, head FROM triples)",
        "list_relations": f"SELECT id, head_id, tail_id, relation FROM v_relations WHERE {_S}",
        "relations_for_entity": f"SELECT e.id AS entity_id, r.id, r.head_id, r.tail_id FROM v_relations r JOIN (SELECT id FROM v_entities WHERE {_S}) e ON r.head_id = e.id OR r.tail_id = e.id",
        "relations_by_canonical": f"SELECT id, relation, canonical_relation FROM v_relations WHERE {_S} AND (canonical_relation = 'depends_on' OR relation = 'depends_on')",
        "list_communities": f"SELECT id, level, parent_id FROM v_communities WHERE {_S}",
        "child_communities": "SELECT parent_id, id, level FROM v_communities WHERE parent_id IN (SELECT id FROM v_communities)",
        "chunks_for_entity": f"SELECT entity_id, chunk_id FROM v_chunk_entities WHERE entity_id IN (SELECT id FROM v_entities WHERE {_S})",
        "merge_history": f"WITH {_MERGED} SELECT target AS target_entity_id, name AS merged_entity_name FROM m JOIN v_entities ON id = source",
        "synonyms_of": "SELECT raw FROM v_synonyms WHERE canonical = 'depends_on' AND raw <> 'relies_on'",
        "upsert_type_synonyms": """
            WITH n AS (SELECT lower(canonical) AS raw, lower(arg_max(label, entry_id)) AS canonical FROM vocab WHERE kind = 'entity_type' GROUP BY 1)
            SELECT raw, canonical FROM v_type_synonyms WHERE raw NOT IN (SELECT raw FROM n) UNION ALL SELECT raw, canonical FROM n""",
        "entities_for_chunk": "SELECT chunk_id, id, name FROM v_chunk_entities JOIN v_entities ON entity_id = id",
        "community_entities": "SELECT community_id, id, name FROM v_entity_communities JOIN v_entities ON entity_id = id",
        "entity_communities": "SELECT entity_id, id, level FROM v_entity_communities JOIN v_communities ON community_id = id",
        "entity_vectors": "SELECT store, entity_id, name, len(embedding) AS dim FROM v_entities JOIN v_entity_embeddings ON id = entity_id",
        "chunk_vectors": "SELECT c.store, chunk_id, len(embedding) AS dim FROM v_chunks c JOIN v_vectors v ON c.id = v.chunk_id",
        "pending_extract": "SELECT id, store FROM v_chunks WHERE id NOT IN (SELECT chunk_id FROM v_extractions)",
        "unembedded_entities": "SELECT id, CASE WHEN coalesce(entity_type, '') = '' THEN name ELSE name || ' (' || entity_type || ')' END AS text FROM v_entities WHERE id NOT IN (SELECT entity_id FROM v_entity_embeddings)",
        "unclustered_count": "SELECT store, count(*) AS n FROM v_entities WHERE id NOT IN (SELECT entity_id FROM v_entity_communities) GROUP BY store",
        "pending_summarize": "SELECT id, store, level FROM v_communities c WHERE summary IS NULL AND NOT EXISTS (SELECT 1 FROM v_communities k WHERE k.parent_id = c.id AND k.summary IS NULL)",
        "child_summaries": "SELECT parent_id, id, summary FROM v_communities WHERE summary IS NOT NULL AND parent_id IS NOT NULL",
        "triples_view": "SELECT r.id, r.store, coalesce(h.name, '') AS head, relation, coalesce(t.name, '') AS tail FROM v_relations r LEFT JOIN v_entities h ON head_id = h.id LEFT JOIN v_entities t ON tail_id = t.id",
        "relations_view": """
            SELECT x.entity_id, x.relation_id, x.direction, x.relation, x.other_id, coalesce(e.name, 'entity_' || x.other_id) AS other, e.entity_type AS other_type FROM (
                SELECT head_id AS entity_id, id AS relation_id, 'outgoing' AS direction, relation, tail_id AS other_id FROM v_relations UNION ALL
                SELECT tail_id, id, 'incoming', relation, head_id FROM v_relations WHERE head_id <> tail_id) x LEFT JOIN v_entities e ON e.id = x.other_id""",
        "canonicalise_relations": "SELECT id, relation, s.canonical AS canonical_relation FROM v_relations LEFT JOIN v_synonyms s ON relation = raw",
        "refresh_canonical": "SELECT id, coalesce(s.canonical, canonical_relation) AS canonical_relation, s.canonical IS NOT NULL AS refreshed FROM v_relations LEFT JOIN v_synonyms s ON relation = raw",
        "store_stats": """
            SELECT name, dim, (SELECT count(*) FROM v_chunks WHERE store = name) AS chunks, (SELECT count(*) FROM v_entities WHERE store = s.name) AS entities,
                   (SELECT count(*) FROM v_relations WHERE store = name) AS relations FROM stores s""",
        "full_stats": """
            SELECT name, dim, (SELECT count(*) FROM v_chunks WHERE store = name) AS chunks, (SELECT count(*) FROM v_entities WHERE store = s.name) AS entities,
                   (SELECT count(*) FROM v_relations WHERE store = name) AS relations, (SELECT count(*) FROM v_communities WHERE store = name) AS communities,
                   (SELECT count(*) FROM v_chunks WHERE store = name AND id NOT IN (SELECT chunk_id FROM v_extractions)) AS pending_extract,
                   (SELECT count(*) FROM v_communities c WHERE store = s.name AND summary IS NULL AND id NOT IN (
                       SELECT parent_id FROM v_communities k WHERE summary IS NULL AND parent_id IS NOT NULL)) AS pending_summarize FROM stores s""",
        "relation_types": "SELECT store, relation, arg_min_null(canonical_relation, id) AS canonical_relation, count(*) AS n FROM v_relations GROUP BY 1, 2",
        "level_summary": "SELECT store, level, count(*) AS n, count(summary) AS summarised FROM v_communities GROUP BY 1, 2",
        "community_members": "SELECT community_id, count(*) AS size, string_agg(name, '|' ORDER BY name) AS names FROM v_entity_communities JOIN v_entities ON entity_id = id WHERE name IS NOT NULL GROUP BY 1",
        "latest_per_group": "SELECT chunk_id, seq, model FROM v_replies r WHERE chunk_id IS NOT NULL AND seq = (SELECT max(seq) FROM v_replies x WHERE x.chunk_id = r.chunk_id)",
        "canonical_relations": "SELECT DISTINCT canonical FROM v_synonyms",
        "resolve_entities": f"WITH {_MENTIONS.replace('__WHOLE__', 'true')} SELECT store, key, id, name, entity_type FROM e",
        "persist_triples": f"""
            WITH {_MENTIONS.replace('__WHOLE__', "trim(head) <> '' AND trim(tail) <> '' AND trim(relation) <> ''")} SELECT t.seq AS id, t.store, h.id AS head_id, x.id AS tail_id, t.relation, s.canonical AS canonical_relation FROM v_triples t
            JOIN e h ON h.store = t.store AND h.key = {_FOLD.format('t.head')} JOIN e x ON x.store = t.store AND x.key = {_FOLD.format('t.tail')}
            LEFT JOIN v_synonyms s ON s.raw = t.relation WHERE trim(t.relation) <> ''""",
        "persist_links": f"""
            WITH {_MENTIONS.replace('__WHOLE__', "trim(head) <> '' AND trim(tail) <> '' AND trim(relation) <> ''")}
            SELECT chunk_id, e.id AS entity_id FROM w JOIN e ON e.store = w.store AND e.key = {_FOLD.format('w.head')} UNION
            SELECT chunk_id, e.id FROM w JOIN e ON e.store = w.store AND e.key = {_FOLD.format('w.tail')}""",
        "upsert_synonyms": """
            WITH n AS (SELECT canonical AS raw, arg_max(label, entry_id) AS canonical FROM vocab WHERE kind = 'relation' GROUP BY 1)
            SELECT raw, canonical FROM v_synonyms WHERE raw NOT IN (SELECT raw FROM n) UNION ALL SELECT raw, canonical FROM n""",
        "normalize_types": "SELECT id, coalesce(s.canonical, lower(entity_type)) AS normalized_type FROM v_entities LEFT JOIN v_type_synonyms s ON lower(entity_type) = raw",
        "checkpoint_extractions": """
            WITH n AS (SELECT chunk_id, arg_max(model, seq) AS model, count(*) AS triple_count FROM v_triples WHERE chunk_id IS NOT NULL GROUP BY 1)
            SELECT chunk_id, NULL AS model, 0::BIGINT AS triple_count FROM v_extractions WHERE chunk_id NOT IN (SELECT chunk_id FROM n) UNION ALL SELECT * FROM n""",
        "merge_entities": f"WITH {_MERGED} SELECT r.id, coalesce(a.target, head_id) AS head_id, coalesce(b.target, tail_id) AS tail_id FROM v_relations r LEFT JOIN m a ON a.source = head_id LEFT JOIN m b ON b.source = tail_id",
        "merge_links": f"WITH {_MERGED} SELECT DISTINCT chunk_id, coalesce(target, entity_id) AS entity_id FROM v_chunk_entities LEFT JOIN m ON source = entity_id",
        "add_chunks_ids": "SELECT id AS seq, (SELECT max(id) FROM v_chunks WHERE store = 'handbook') + row_number() OVER (ORDER BY id) AS id FROM v_chunks WHERE store = 'papers'",
        "export_jsonl": f"""
            SELECT 0 AS ord, 0::BIGINT AS id, sha256(to_json({{'record': 'store', 'name': name, 'dim': dim}})::VARCHAR) AS json FROM stores WHERE name = 'handbook' UNION ALL
            SELECT 1, id, sha256(to_json({{'record': 'chunk', 'id': id, 'store': store, 'content': content, 'source': source, 'metadata': NULL}})::VARCHAR) FROM v_chunks WHERE {_S} UNION ALL
            SELECT 2, id, sha256(to_json({{'record': 'entity', 'id': id, 'store': store, 'name': name, 'entity_type': entity_type, 'properties': properties}})::VARCHAR) FROM v_entities WHERE {_S} UNION ALL
            SELECT 3, id, sha256(to_json({{'record': 'relation', 'id': id, 'store': store, 'head_id': head_id, 'tail_id': tail_id, 'relation': relation, 'canonical_relation': canonical_relation, 'properties': properties}})::VARCHAR)
            FROM v_relations WHERE {_S} UNION ALL
            SELECT 4, id, sha256(to_json({{'record': 'community', 'id': id, 'store': store, 'level': level, 'parent_id': parent_id, 'summary': summary, 'modularity': modularity}})::VARCHAR) FROM v_communities WHERE {_S}""",
    }
    return {name: with_views(body) for name, body in raw.items()}
