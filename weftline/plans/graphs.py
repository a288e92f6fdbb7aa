"""Queries over the relation graph and its communities."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import graph, leiden
from weftline.operators.components import connected_components
from weftline.operators.similarity import merge_candidates
from weftline.plans.views import Views, with_views


def _membership(v):
    return v.entity_communities.select(F.col("entity_id").alias("node"), F.col("community_id").alias("community"))


def _seeds(v):
    """The chunks that search hits name, with their best fused score."""
    return v.t("hits").where("chunk_id is not null").groupBy("chunk_id").agg(F.max("rrf").alias("score"))


def queries():
    q = {}

    def add(f):
        q[f.__name__] = lambda spark, root: f(Views(spark, root))
        return f

    @add
    def fold_edges(v):
        return graph.fold_edges(v.relations)

    @add
    def degree(v):
        return graph.degrees(graph.fold_edges(v.relations), v.entities.select("store", F.col("id").alias("node")))

    @add
    def connected_components_(v):
        return connected_components(graph.fold_edges(v.relations))

    q["connected_components"] = q.pop("connected_components_")

    @add
    def induced_subgraph(v):
        return graph.induced_subgraph(graph.fold_edges(v.relations), _membership(v))

    @add
    def inter_community_weights(v):
        return graph.inter_community_weights(v.relations, _membership(v))

    @add
    def modularity_given_partition(v):
        return graph.modularity(graph.fold_edges(v.relations), _membership(v)).select("store", F.round("q", 9).alias("q"))

    @add
    def newman_modularity(v):
        return graph.newman_modularity(graph.fold_edges(v.relations), _membership(v)).select("store", F.round("q", 9).alias("q"))

    @add
    def expand_bfs_1(v):
        return graph.expand_breadth_first(v.relations, v.chunk_entities, _seeds(v), 1)["chunks"].select("chunk_id", "from_graph")

    @add
    def expand_bfs_2(v):
        return graph.expand_breadth_first(v.relations, v.chunk_entities, _seeds(v), 2)["entities"]

    @add
    def expand_comention(v):
        return graph.expand_comention(v.chunk_entities, _seeds(v))

    @add
    def leiden_flat(v):
        return leiden.detect(graph.fold_edges(v.relations), v.entities.select("store", F.col("id").alias("node")))

    @add
    def leiden_coverage(v):
        # every entity is in one community, of its own store
        found = leiden.detect(graph.fold_edges(v.relations), v.entities.select("store", F.col("id").alias("node")))
        return found.groupBy("store").agg(F.count("*").alias("nodes"), F.countDistinct("node").alias("distinct_nodes"))

    @add
    def leiden_connected(v):
        # a community of one connected part has as many parts as communities
        edges = graph.fold_edges(v.relations)
        nodes = v.entities.select("store", F.col("id").alias("node"))
        found = leiden.detect(edges, nodes)
        homes = found.select("store", "node")
        own = edges.join(homes.withColumnRenamed("node", "src"), ["store", "src"], "left_semi").join(homes.withColumnRenamed("node", "dst"), ["store", "dst"], "left_semi")
        inside = graph.induced_subgraph(own, found.select("node", "community"))
        parts = found.join(connected_components(inside), "node", "left").withColumn("part", F.coalesce("component", "node"))
        return parts.groupBy("store").agg((F.countDistinct("community", "part") == F.countDistinct("community")).alias("connected"))

    @add
    def leiden_hierarchical(v):
        return leiden.detect_hierarchy(graph.fold_edges(v.relations), v.entities.select("store", F.col("id").alias("node")))

    @add
    def community_hierarchy_up(v):
        return leiden.build_upward(v.relations, v.entities)

    @add
    def hierarchy_single_root(v):
        tree = leiden.build_upward(v.relations, v.entities)
        return tree.groupBy("store").agg(F.count(F.when(F.col("level") == 0, 1)).alias("roots"), F.count(F.when(F.col("parent").isNull() & (F.col("level") > 0), 1)).alias("orphans"))

    @add
    def merge_candidates_(v):
        vectors = v.t("embeddings").select(F.lit("all").alias("store"), F.col("vec_id").alias("id"), "embedding")
        return merge_candidates(vectors, 0.35).select("a", "b", F.round("score", 6).alias("score"))

    q["merge_candidates"] = q.pop("merge_candidates_")

    @add
    def merge_candidate_names(v):
        # chunk vectors in the place of entity vectors, each also under a second id: copies among them, the real threshold
        rows = v.vectors.groupBy("store", "chunk_id").agg(F.min("embedding").alias("embedding"))
        twice = rows.select("store", F.explode(F.array((F.col("chunk_id") * 2), F.col("chunk_id") * 2 + 1)).alias("id"), "embedding")
        names = twice.select("id", F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"))
        return merge_candidates(twice, 0.85, names).select("a", "b", "name_a", "name_b", F.round("score", 4).alias("score"))

    return q


_SEEDS = "seeds AS (SELECT chunk_id, max(rrf) AS score FROM hits WHERE chunk_id IS NOT NULL GROUP BY 1)"
_WAYS = "ways AS (SELECT head_id AS a, tail_id AS b FROM v_relations WHERE head_id <> tail_id UNION SELECT tail_id, head_id FROM v_relations WHERE head_id <> tail_id)"
_HOPS = f"""{_SEEDS}, {_WAYS},
    e0 AS (SELECT DISTINCT entity_id FROM v_chunk_entities JOIN seeds USING (chunk_id)),
    e1 AS (SELECT DISTINCT b AS entity_id FROM ways JOIN e0 ON a = e0.entity_id WHERE b NOT IN (SELECT entity_id FROM e0)),
    e2 AS (SELECT DISTINCT b AS entity_id FROM ways JOIN e1 ON a = e1.entity_id WHERE b NOT IN (SELECT entity_id FROM e0) AND b NOT IN (SELECT entity_id FROM e1))"""
_DEGREE = "d AS (SELECT store, node, sum(weight) AS k FROM (SELECT store, src AS node, weight FROM v_edges UNION ALL SELECT store, dst, weight FROM v_edges) GROUP BY 1, 2)"
_TOTAL = "t AS (SELECT store, sum(weight) AS m FROM v_edges GROUP BY 1)"
_INSIDE = "i AS (SELECT e.store, a.community_id AS community, src, dst, weight FROM v_edges e JOIN v_entity_communities a ON a.entity_id = src JOIN v_entity_communities b ON b.entity_id = dst WHERE a.community_id = b.community_id)"


def oracle_sql() -> dict[str, str]:
    raw = {
        "fold_edges": "SELECT * FROM v_edges",
        "degree": f"WITH {_DEGREE} SELECT e.store, e.id AS node, coalesce(k, 0) AS degree FROM (SELECT DISTINCT store, id FROM v_entities) e LEFT JOIN d ON d.store = e.store AND d.node = e.id",
        "connected_components": """
            WITH RECURSIVE n AS (SELECT src AS a, dst AS b FROM v_edges UNION SELECT dst, src FROM v_edges),
            r AS (SELECT a AS node, a AS c FROM n UNION SELECT n.b, r.c FROM r JOIN n ON n.a = r.node)
            SELECT node, min(c) AS component FROM r GROUP BY 1""",
        "induced_subgraph": f"WITH {_INSIDE} SELECT * FROM i",
        "inter_community_weights": "SELECT least(a.community_id, b.community_id) AS community_a, greatest(a.community_id, b.community_id) AS community_b, count(*) AS weight FROM v_relations JOIN v_entity_communities a ON a.entity_id = head_id JOIN v_entity_communities b ON b.entity_id = tail_id WHERE a.community_id <> b.community_id GROUP BY 1, 2",
        "modularity_given_partition": f"""
            WITH {_DEGREE}, {_TOTAL}, {_INSIDE}
            SELECT t.store, round(coalesce(sum((weight - x.k * y.k / (2 * m)) / m), 0), 9) AS q FROM t LEFT JOIN i ON i.store = t.store
            LEFT JOIN d x ON x.store = i.store AND x.node = src LEFT JOIN d y ON y.store = i.store AND y.node = dst GROUP BY 1""",
        "newman_modularity": f"""
            WITH {_DEGREE}, {_TOTAL}, {_INSIDE}, w AS (SELECT store, community, sum(weight) AS w FROM i GROUP BY 1, 2),
            g AS (SELECT d.store, c.community_id AS community, sum(k) AS k FROM d JOIN v_entity_communities c ON c.entity_id = node GROUP BY 1, 2)
            SELECT g.store, round(sum(coalesce(w, 0) / m - (k / (2 * m)) ** 2), 9) AS q FROM g JOIN t USING (store) LEFT JOIN w ON w.store = g.store AND w.community = g.community GROUP BY 1""",
        "expand_bfs_1": f"""
            WITH {_HOPS} SELECT chunk_id, false AS from_graph FROM seeds UNION ALL
            SELECT DISTINCT chunk_id, true FROM v_chunk_entities JOIN e1 USING (entity_id) WHERE chunk_id NOT IN (SELECT chunk_id FROM seeds)""",
        "expand_bfs_2": f"WITH {_HOPS} SELECT entity_id, 0 AS hop FROM e0 UNION ALL SELECT entity_id, 1 FROM e1 UNION ALL SELECT entity_id, 2 FROM e2",
        "expand_comention": f"""
            WITH {_SEEDS} SELECT DISTINCT chunk_id FROM v_chunk_entities WHERE entity_id IN (SELECT entity_id FROM v_chunk_entities JOIN seeds USING (chunk_id))
            AND chunk_id NOT IN (SELECT chunk_id FROM seeds)""",
        "leiden_coverage": "SELECT store, count(*) AS nodes, count(*) AS distinct_nodes FROM (SELECT DISTINCT store, id FROM v_entities) GROUP BY 1",
        "leiden_connected": "SELECT DISTINCT store, true AS connected FROM v_entities",
        "hierarchy_single_root": "SELECT DISTINCT store, 1::BIGINT AS roots, 0::BIGINT AS orphans FROM v_entities",
        "merge_candidates": """
            SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
            WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.35""",
        "merge_candidate_names": """
            WITH one AS (SELECT store, chunk_id, min(embedding) AS x FROM v_vectors GROUP BY 1, 2),
            w AS (SELECT store, chunk_id * 2 + k AS id, x FROM one, (SELECT unnest([0, 1]) AS k) WHERE len(list_filter(x, lambda t: t <> 0)) > 0)
            SELECT a.id AS a, b.id AS b, 'n' || a.id AS name_a, 'n' || b.id AS name_b, round(list_cosine_similarity(a.x, b.x), 4) AS score
            FROM w a JOIN w b ON a.store = b.store AND a.id < b.id WHERE list_cosine_similarity(a.x, b.x) >= 0.85""",
    }
    return {name: with_views(body) for name, body in raw.items()}
