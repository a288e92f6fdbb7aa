"""Queries over vector, lexical and hybrid search."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.vectors import mean_pool
from weftline.operators import retrieval
from weftline.operators.joins import members_of_communities
from weftline.operators.resolve import similar_entities
from weftline.plans.views import Views, with_views

QUERY = "the synonym list rebuilds"


def _first_vector(v):
    """The vector of the least id of the embeddings table."""
    return list(v.t("embeddings").orderBy("vec_id").limit(1).collect()[0]["embedding"])


def _all(v):
    return v.t("embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def queries():
    q = {}

    def add(f):
        q[f.__name__] = lambda spark, root: f(Views(spark, root))
        return f

    @add
    def vector_topk(v):
        return retrieval.vector_top_k(_all(v), _first_vector(v), 10, 64).select("chunk_id", F.round("score", 6).alias("score"))

    @add
    def vector_topk_chunks(v):
        # the ranked hits with what they are
        top = retrieval.vector_top_k(v.vectors.where("store = 'handbook'"), [1.0] * 64, 10, 64)
        return v.chunks.join(F.broadcast(top), F.col("id") == F.col("chunk_id")).select("chunk_id", "source", F.round("score", 6).alias("score"))

    @add
    def find_similar_entities(v):
        vectors = v.entity_embeddings.join(v.entities.select(F.col("id").alias("entity_id"), "name"), "entity_id")
        return similar_entities(vectors, _first_vector(v), 0.1, 20).select("entity_id", "name", F.round("score", 6).alias("score"))

    @add
    def mean_pool_(v):
        pooled = mean_pool(_all(v), "label", "embedding")
        return pooled.select("label", F.posexplode("embedding").alias("pos", "x")).select("label", (F.col("pos") + 1).cast("bigint").alias("pos"), F.round("x", 6).alias("x"))

    q["mean_pool"] = q.pop("mean_pool_")

    @add
    def bm25_term_stats(v):
        index = retrieval.Bm25Index(v.chunks.select(F.col("id").alias("chunk_id"), "content"))
        return index.frequencies

    def bm25(v, query, top=20):
        index = retrieval.Bm25Index(v.chunks.select(F.col("id").alias("chunk_id"), "content"))
        return index.search(query, top).select("chunk_id", F.round("score", 6).alias("score"))

    @add
    def bm25_topk_or(v):
        return bm25(v, QUERY)

    @add
    def bm25_topk_and(v):
        return bm25(v, "synonym AND list AND rebuilds")

    @add
    def bm25_not(v):
        return bm25(v, "(synonym OR vectors) NOT importer")

    @add
    def rrf_hybrid(v):
        chunks = v.chunks.where("store = 'handbook'")
        index = retrieval.Bm25Index(chunks.select(F.col("id").alias("chunk_id"), "content"))
        found = retrieval.hybrid_recall(v.vectors.where("store = 'handbook'"), index, chunks, [1.0] * 64, QUERY, 10, 64)
        return found.select("chunk_id", "source", F.round("rrf", 9).alias("rrf"), F.round("similarity", 6).alias("similarity"), F.round("lexical", 6).alias("lexical"))

    @add
    def global_contexts(v):
        members = members_of_communities(v.entities, v.entity_communities).where("name is not null").select("community_id", "id", "name")
        out = retrieval.global_contexts(v.communities, members, v.relations.where("relation is not null"), v.chunk_entities, v.chunks)
        text = lambda c: F.sha2(F.array_join(c, "\n"), 256).alias(c)
        return out.select("store", "level", "community_id", "summary", text("names"), text("relation_texts"), text("samples"))

    return q


_COS = "(CASE WHEN list_inner_product({a}, {a}) = 0 OR list_inner_product({b}, {b}) = 0 THEN 0 ELSE list_cosine_similarity({a}, {b}) END)"
_Q = "q AS (SELECT embedding::DOUBLE[] AS x FROM embeddings ORDER BY vec_id LIMIT 1)"


def _bm25(where: str = "") -> str:
    return f"""
    docs AS (SELECT id, list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda t: t <> '') AS words FROM v_chunks {where}),
    c AS (SELECT count(*) AS n, avg(len(words)) AS mean_length FROM docs),
    p AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(words) AS term FROM docs) GROUP BY 1, 2),
    f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
    s AS (SELECT p.id, p.term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean_length)) AS score
          FROM p JOIN f USING (term) JOIN docs USING (id), c)"""


def oracle_sql() -> dict[str, str]:
    ones = "list_value(" + ", ".join(["1.0::DOUBLE"] * 64) + ")"
    lanes = f"""
        sim AS (SELECT chunk_id AS id, {_COS.format(a='embedding', b=ones)} AS score FROM v_vectors WHERE store = 'handbook' ORDER BY score DESC, id LIMIT 40),
        lex AS (SELECT id, sum(score) AS score FROM s WHERE term IN ('the', 'synonym', 'list', 'rebuilds') GROUP BY 1 ORDER BY score DESC, id LIMIT 40),
        lanes AS (SELECT id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, id)) AS part, score AS similarity, NULL::DOUBLE AS lexical FROM sim UNION ALL
                  SELECT id, 1.0 / (60 + row_number() OVER (ORDER BY score DESC, id)), NULL, score FROM lex)"""
    raw = {
        "vector_topk": f"WITH {_Q} SELECT vec_id AS chunk_id, round(list_cosine_similarity(embedding::DOUBLE[], x), 6) AS score FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], x) DESC, vec_id LIMIT 10",
        "vector_topk_chunks": f"""
            SELECT chunk_id, source, round(score, 6) AS score FROM (SELECT chunk_id, {_COS.format(a='embedding', b=ones)} AS score FROM v_vectors
            WHERE store = 'handbook' ORDER BY score DESC, chunk_id LIMIT 10) JOIN v_chunks ON id = chunk_id""",
        "find_similar_entities": f"""
            WITH {_Q} SELECT entity_id, name, round(list_cosine_similarity(embedding, x), 6) AS score FROM v_entity_embeddings JOIN v_entities ON id = entity_id, q
            WHERE list_cosine_similarity(embedding, x) >= 0.1 ORDER BY list_cosine_similarity(embedding, x) DESC, entity_id LIMIT 20""",
        "mean_pool": """
            WITH u AS (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
            m AS (SELECT label, pos, avg(x) AS x FROM u GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(x * x)) AS norm FROM m GROUP BY 1)
            SELECT label, pos, round(x / norm, 6) AS x FROM m JOIN n USING (label)""",
        "bm25_term_stats": f"WITH {_bm25()} SELECT term, df FROM f",
        "bm25_topk_or": f"WITH {_bm25()}, r AS (SELECT id AS chunk_id, sum(score) AS score FROM s WHERE term IN ('the', 'synonym', 'list', 'rebuilds') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20) SELECT chunk_id, round(score, 6) AS score FROM r",
        "bm25_topk_and": f"WITH {_bm25()}, r AS (SELECT id AS chunk_id, sum(score) AS score FROM s WHERE term IN ('synonym', 'list', 'rebuilds') GROUP BY 1 HAVING count(*) = 3 ORDER BY 2 DESC, 1 LIMIT 20) SELECT chunk_id, round(score, 6) AS score FROM r",
        "bm25_not": f"WITH {_bm25()}, r AS (SELECT id AS chunk_id, sum(score) AS score FROM s WHERE term IN ('synonym', 'vectors') AND id NOT IN (SELECT id FROM p WHERE term = 'importer') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20) SELECT chunk_id, round(score, 6) AS score FROM r",
        "rrf_hybrid": f"""
            WITH {_bm25("WHERE store = 'handbook'")}, {lanes},
            fused AS (SELECT id, sum(part) AS rrf, max(similarity) AS similarity, max(lexical) AS lexical FROM lanes GROUP BY 1 ORDER BY rrf DESC, id LIMIT 10)
            SELECT fused.id AS chunk_id, source, round(rrf, 9) AS rrf, round(similarity, 6) AS similarity, round(lexical, 6) AS lexical FROM fused JOIN v_chunks ON v_chunks.id = fused.id""",
        "global_contexts": """
            WITH mem AS (SELECT community_id, id, name FROM v_entity_communities JOIN v_entities ON id = entity_id WHERE name IS NOT NULL),
            sz AS (SELECT community_id, string_agg(name, chr(10) ORDER BY name) AS names FROM mem GROUP BY 1 HAVING count(*) >= 2),
            rel AS (SELECT community_id, string_agg(x, chr(10) ORDER BY x) AS texts FROM (SELECT DISTINCT h.community_id, h.name || ' -[' || relation || ']-> ' || t.name AS x FROM v_relations JOIN mem h ON h.id = head_id JOIN mem t ON t.id = tail_id AND t.community_id = h.community_id WHERE relation IS NOT NULL) GROUP BY 1),
            fst AS (SELECT entity_id, min(chunk_id) AS chunk_id FROM v_chunk_entities GROUP BY 1),
            pick AS (SELECT community_id, chunk_id, k FROM (SELECT community_id, chunk_id, row_number() OVER (PARTITION BY community_id ORDER BY name, mem.id) AS k FROM mem JOIN fst ON entity_id = mem.id) WHERE k <= 3),
            smp AS (SELECT community_id, string_agg(CASE WHEN length(content) > 500 THEN substr(content, 1, 500) || '...' ELSE content END, chr(10) ORDER BY k) AS texts FROM pick JOIN v_chunks ON v_chunks.id = chunk_id GROUP BY 1)
            SELECT c.store, c.level, c.id AS community_id, summary, sha256(sz.names) AS names, sha256(coalesce(rel.texts, '')) AS relation_texts, sha256(coalesce(smp.texts, '')) AS samples
            FROM v_communities c JOIN sz ON sz.community_id = c.id LEFT JOIN rel ON rel.community_id = c.id LEFT JOIN smp ON smp.community_id = c.id""",
    }
    return {name: with_views(body) for name, body in raw.items()}
