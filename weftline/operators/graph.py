"""Relations as an undirected weighted graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import stage


def fold_edges(relations: DataFrame, weight: str | None = None) -> DataFrame:
    """(store, src, dst, weight), src < dst: repeated pairs add up, loops are dropped."""
    w = F.col(weight) if weight else F.lit(1.0)
    pairs = relations.where("head_id <> tail_id").select("store", F.least("head_id", "tail_id").alias("src"), F.greatest("head_id", "tail_id").alias("dst"), w.cast("double").alias("w"))
    return pairs.groupBy("store", "src", "dst").agg(F.sum("w").alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    """(store, node, other, weight): each edge from both ends."""
    return edges.select("store", F.col("src").alias("node"), F.col("dst").alias("other"), "weight").union(edges.select("store", F.col("dst").alias("node"), F.col("src").alias("other"), "weight"))


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(store, node, degree): the weight of a node's edges; nodes without edges have 0 if nodes (store, node) is given."""
    found = both_ways(edges).groupBy("store", "node").agg(F.sum("weight").alias("degree"))
    return found if nodes is None else nodes.select("store", "node").distinct().join(found, ["store", "node"], "left").fillna(0.0, ["degree"])


def induced_subgraph(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(store, community, src, dst, weight): edges with both ends in one community."""
    m = membership.select("node", "community")
    a = m.select(F.col("node").alias("src"), F.col("community").alias("community"))
    b = m.select(F.col("node").alias("dst"), F.col("community").alias("other"))
    return edges.join(a, "src").join(b, "dst").where("community = other").select("store", "community", "src", "dst", "weight")


def inter_community_weights(relations: DataFrame, membership: DataFrame) -> DataFrame:
    """(community_a, community_b, weight), a < b: relations that cross communities."""
    a = membership.select(F.col("node").alias("head_id"), F.col("community").alias("ca"))
    b = membership.select(F.col("node").alias("tail_id"), F.col("community").alias("cb"))
    crossing = relations.select("head_id", "tail_id").join(a, "head_id").join(b, "tail_id").where("ca <> cb")
    return crossing.groupBy(F.least("ca", "cb").alias("community_a"), F.greatest("ca", "cb").alias("community_b")).agg(F.count("*").alias("weight"))


def modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(store, q): sum over edges inside communities of (w - ki kj / 2m), over m. Pairs without an edge do not count."""
    k = degrees(edges)
    total = edges.groupBy("store").agg(F.sum("weight").alias("m"))
    inside = induced_subgraph(edges, membership)
    ki = k.select("store", F.col("node").alias("src"), F.col("degree").alias("ki"))
    kj = k.select("store", F.col("node").alias("dst"), F.col("degree").alias("kj"))
    joined = inside.join(ki, ["store", "src"]).join(kj, ["store", "dst"]).join(total, "store")
    gain = joined.groupBy("store").agg(F.sum((F.col("weight") - F.col("ki") * F.col("kj") / (2 * F.col("m"))) / F.col("m")).alias("q"))
    return total.select("store").join(gain, "store", "left").fillna(0.0, ["q"])


def newman_modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(store, q): the standard modularity, over all pairs of a community."""
    k = degrees(edges).join(membership.select("node", "community"), "node")
    total = edges.groupBy("store").agg(F.sum("weight").alias("m"))
    inside = induced_subgraph(edges, membership).groupBy("store", "community").agg(F.sum("weight").alias("w"))
    by = k.groupBy("store", "community").agg(F.sum("degree").alias("d")).join(inside, ["store", "community"], "left").fillna(0.0, ["w"]).join(total, "store")
    return by.groupBy("store").agg(F.sum(F.col("w") / F.col("m") - (F.col("d") / (2 * F.col("m"))) ** 2).alias("q"))


def expand_breadth_first(relations: DataFrame, chunk_entities: DataFrame, seeds: DataFrame, depth: int) -> dict[str, DataFrame]:
    """Grow from seed chunks (chunk_id, score) over relations.

    entities: (entity_id, hop), the seeds' entities at 0 and newly found ones at
    their hop. chunks: (chunk_id, score, from_graph): the seeds, then chunks of
    newly found entities that are no seeds, without a score.
    """
    seeds = seeds.select("chunk_id", "score")
    found = stage(chunk_entities.join(seeds.select("chunk_id"), "chunk_id", "left_semi").select("entity_id").distinct().withColumn("hop", F.lit(0)))
    ends = relations.select(F.col("head_id").alias("a"), F.col("tail_id").alias("b")).union(relations.select("tail_id", "head_id")).where("a <> b")
    for hop in range(1, depth + 1):
        frontier = found.where(F.col("hop") == hop - 1).select(F.col("entity_id").alias("a"))
        fresh = ends.join(frontier, "a", "left_semi").select(F.col("b").alias("entity_id")).distinct().join(found.select("entity_id"), "entity_id", "left_anti")
        fresh = stage(fresh.withColumn("hop", F.lit(hop)))
        if fresh.isEmpty():
            break
        found = found.unionByName(fresh)
    grown = chunk_entities.join(found.where("hop > 0").select("entity_id"), "entity_id", "left_semi").select("chunk_id").distinct().join(seeds.select("chunk_id"), "chunk_id", "left_anti")
    chunks = seeds.withColumn("from_graph", F.lit(False)).unionByName(grown.select("chunk_id", F.lit(None).cast("double").alias("score"), F.lit(True).alias("from_graph")))
    return {"entities": found, "chunks": chunks}


def expand_comention(chunk_entities: DataFrame, seeds: DataFrame) -> DataFrame:
    """(chunk_id): chunks that share an entity with a seed chunk and are no seeds."""
    ids = seeds.select("chunk_id").distinct()
    shared = chunk_entities.join(ids, "chunk_id", "left_semi").select("entity_id").distinct()
    return chunk_entities.join(shared, "entity_id", "left_semi").select("chunk_id").distinct().join(ids, "chunk_id", "left_anti")
