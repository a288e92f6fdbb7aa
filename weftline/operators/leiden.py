"""Communities by modularity: local moving and splitting into connected parts.

Local moving is sequential, so a task gets one connected component of a store
with at most `part_edges` edges; the total weight of the store is a column, so
that components do not depend on each other. A larger component is made smaller
first, by the same moves in rounds over the whole cluster: half of the nodes,
another half each round, go to the community of their neighbours with the best
gain, until hardly any goes; communities are then the nodes of the next graph,
which keeps all weights. What has become small enough goes on in one task, and
what does not is moved in rounds until nothing gains. So no task ever holds more
than `part_edges` edges, and every community is connected in the end.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.components import connected_components
from weftline.operators.graph import both_ways, induced_subgraph, inter_community_weights
from weftline.session import stage

#: Edges of a component that one task may hold.
PART_EDGES = 500_000

#: Rounds of moves on one graph, and graphs on the way to one that is small enough, at most.
ROUNDS, GRAPHS = 40, 12

#: Share of the nodes under which a round counts as quiet.
QUIET = 0.001


def connected_parts(labels: dict, neighbours: dict) -> dict:
    """Labels after each community is split into its connected parts; a part is named by its least node."""
    out: dict = {}
    for node in sorted(labels):
        if node in out:
            continue
        part, todo = [], [node]
        out[node] = node
        while todo:
            at = todo.pop()
            part.append(at)
            for other in neighbours[at]:
                if other not in out and labels[other] == labels[node]:
                    out[other] = node
                    todo.append(other)
    return out


def quality(labels: dict, edges: list, degree: dict, m: float) -> float:
    """Sum over edges inside communities of (w - ki kj / 2m), over m."""
    return sum(w - degree[a] * degree[b] / (2 * m) for a, b, w in edges if labels[a] == labels[b]) / m if m else 0.0


def local_moving(labels: dict, order: list, neighbours: dict, degree: dict, m: float, sweeps: int = 50) -> dict:
    """Move nodes in order to the community with the best gain until a sweep moves none."""
    labels = dict(labels)
    total: dict = defaultdict(float)
    for node, c in labels.items():
        total[c] += degree[node]
    for _ in range(sweeps):
        moved = False
        for node in order:
            k, own = degree[node], labels[node]
            if not k:
                continue
            links: dict = defaultdict(float)
            for other, w in neighbours[node].items():
                links[labels[other]] += w
            stay = links.get(own, 0.0) - total[own] * k / (2 * m)
            best, best_gain = own, 0.0
            for c in sorted(links):
                if c != own and (gain := links[c] - total[c] * k / (2 * m)) > best_gain:
                    best, best_gain = c, gain
            if best != own and best_gain > stay + 1e-10:
                total[own] -= k
                total[best] += k
                labels[node] = best
                moved = True
        if not moved:
            break
    return labels


def leiden_kernel(nodes: list, edges: list, m: float | None = None, max_iterations: int = 100, tolerance: float = 1e-6, degree: dict | None = None) -> dict:
    """Community of each node, named by its least node. edges: (a, b, weight), folded, without loops.

    degree holds the weight of each node's edges if it is more than that of the edges given.
    """
    neighbours: dict = {n: {} for n in nodes}
    for a, b, w in edges:
        neighbours[a][b] = neighbours[a].get(b, 0.0) + w
        neighbours[b][a] = neighbours[b].get(a, 0.0) + w
    degree = degree or {n: sum(neighbours[n].values()) for n in nodes}
    m = sum(w for _, _, w in edges) if m is None else m
    labels = {n: n for n in nodes}
    if not m:
        return labels
    order, last = sorted(nodes), float("-inf")
    for _ in range(max_iterations):
        labels = connected_parts(local_moving(labels, order, neighbours, degree, m), neighbours)
        q = quality(labels, edges, degree, m)
        if abs(q - last) < tolerance:
            break
        last = q
    return labels


def _in_tasks(graph: DataFrame, max_iterations: int, tolerance: float) -> DataFrame:
    """(store, node, community) of edges (store, component, src, dst, weight, m, src_degree, dst_degree): one task a component."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        edges = list(rows[["src", "dst", "weight"]].itertuples(index=False, name=None))
        degree = {**dict(zip(rows["src"], rows["src_degree"])), **dict(zip(rows["dst"], rows["dst_degree"]))}
        labels = leiden_kernel(sorted(degree), edges, float(rows["m"].iloc[0]), max_iterations, tolerance, degree)
        return pd.DataFrame({"store": rows["store"].iloc[0], "node": list(labels), "community": list(labels.values())})

    return graph.groupBy("store", "component").applyInPandas(run, "store string, node bigint, community bigint")


def _round(graph: DataFrame, labels: DataFrame, total: DataFrame, seed: int) -> DataFrame:
    """(store, node, to) of the nodes that move: graph (store, node, other, weight), labels (store, node, community, degree)."""
    sums = labels.groupBy("store", "community").agg(F.sum("degree").alias("sum"))
    mine = labels.where(F.pmod(F.xxhash64("node", F.lit(seed)), F.lit(2)) == 0).join(sums, ["store", "community"]).join(total, "store")
    mine = mine.select("store", "node", F.col("community").alias("own"), "degree", F.col("sum").alias("own_sum"), "m")
    theirs = labels.select("store", F.col("node").alias("other"), "community")
    links = graph.join(theirs, ["store", "other"]).groupBy("store", "node", "community").agg(F.sum("weight").alias("w"))
    seen = links.join(mine, ["store", "node"]).join(sums, ["store", "community"])
    rest = F.when(F.col("community") == F.col("own"), F.col("sum") - F.col("degree")).otherwise(F.col("sum"))
    gain = F.col("w") - rest * F.col("degree") / (2 * F.col("m"))
    alone = -(F.col("own_sum") - F.col("degree")) * F.col("degree") / (2 * F.col("m"))
    seen = seen.withColumn("gain", gain).withColumn("alone", alone)
    best = seen.groupBy("store", "node").agg(
        F.max(F.struct("gain", (-F.col("community")).alias("c"))).alias("best"), F.max(F.when(F.col("community") == F.col("own"), F.col("gain"))).alias("stay"), F.first("alone").alias("alone"), F.first("own").alias("own")
    )
    return best.where((-F.col("best.c") != F.col("own")) & (F.col("best.gain") > F.coalesce("stay", "alone") + 1e-10)).select("store", "node", (-F.col("best.c")).alias("to"))


def _move(graph: DataFrame, nodes: DataFrame, total: DataFrame, seed: int) -> DataFrame:
    """(store, node, community, degree) after rounds of moves from every node by itself; nodes: (store, node, degree)."""
    labels = stage(nodes.select("store", "node", F.col("node").alias("community"), "degree"))
    n, quiet = labels.count(), 0
    for r in range(ROUNDS):
        moves = stage(_round(graph, labels, total, seed * ROUNDS + r))
        moved = moves.count()
        if moved:
            labels = stage(labels.join(moves, ["store", "node"], "left").withColumn("community", F.coalesce("to", "community")).drop("to"))
        quiet = quiet + 1 if moved <= QUIET * n else 0
        # both halves of the nodes, about, have had their turn
        if quiet >= 3:
            break
    return labels


def _in_rounds(edges: DataFrame, degrees: DataFrame, total: DataFrame, part_edges: int, max_iterations: int, tolerance: float) -> DataFrame:
    """(store, node, community) of large components: edges (store, component, src, dst, weight), degrees (store, node, degree)."""
    graph, nodes = edges, degrees
    whole = stage(nodes.select("store", "node", F.col("node").alias("community")))
    for k in range(GRAPHS):
        sizes = stage(graph.groupBy("store", "component").agg(F.count("*").alias("n")))
        if sizes.where(F.col("n") > part_edges).isEmpty():
            break
        large = graph.join(sizes.where(F.col("n") > part_edges), ["store", "component"], "left_semi")
        ends = stage(both_ways(large))
        inside = nodes.join(ends.select("store", "node").distinct(), ["store", "node"], "left_semi")
        moved = _move(ends, inside, total, k)
        named = moved.select("store", "node", F.col("community").alias("to"))
        to = lambda c: named.select("store", F.col("node").alias(c), F.col("to").alias(f"{c}_to"))
        ends_to = graph.join(to("src"), ["store", "src"], "left").join(to("dst"), ["store", "dst"], "left")
        a, b = F.coalesce("src_to", "src"), F.coalesce("dst_to", "dst")
        before = nodes.count()
        graph = stage(ends_to.select("store", "component", F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), "weight").where("src <> dst").groupBy("store", "component", "src", "dst").agg(F.sum("weight").alias("weight")))
        nodes = stage(nodes.join(named, ["store", "node"], "left").groupBy("store", F.coalesce("to", "node").alias("node")).agg(F.sum("degree").alias("degree")))
        whole = stage(whole.join(named.withColumnRenamed("node", "community"), ["store", "community"], "left").select("store", "node", F.coalesce("to", "community").alias("community")))
        if nodes.count() == before:
            break
    sizes = graph.groupBy("store", "component").agg(F.count("*").alias("n")).where(F.col("n") <= part_edges)
    degree = lambda c: nodes.select("store", F.col("node").alias(c), F.col("degree").alias(f"{c}_degree"))
    fitting = graph.join(sizes, ["store", "component"], "left_semi").join(total, "store").join(degree("src"), ["store", "src"]).join(degree("dst"), ["store", "dst"])
    last = _in_tasks(fitting, max_iterations, tolerance).select("store", F.col("node").alias("community"), F.col("community").alias("to"))
    found = stage(whole.join(last, ["store", "community"], "left").select("store", "node", F.coalesce("to", "community").alias("community")))
    # a community of several parts is as many communities
    inner = induced_subgraph(edges.select("store", "src", "dst", "weight"), found.select("node", "community"))
    parts = connected_components(inner)
    return found.join(parts, "node", "left").select("store", "node", F.coalesce("component", "node").alias("community"))


def detect(edges: DataFrame, nodes: DataFrame, max_iterations: int = 100, tolerance: float = 1e-6, part_edges: int = PART_EDGES) -> DataFrame:
    """(store, node, community) of every node (store, node); a community is named by its least node.

    Edges count whose ends are both nodes of the edge's store.
    """
    own = nodes.select("store", "node").distinct()
    edges = edges.join(own.withColumnRenamed("node", "src"), ["store", "src"], "left_semi").join(own.withColumnRenamed("node", "dst"), ["store", "dst"], "left_semi")
    edges = stage(edges.select("store", "src", "dst", "weight"))
    total = edges.groupBy("store").agg(F.sum("weight").alias("m"))
    parts = stage(connected_components(edges))
    placed = edges.join(parts.withColumnRenamed("node", "src"), "src").join(total, "store")
    sizes = stage(placed.groupBy("store", "component").agg(F.count("*").alias("n")))
    large = sizes.where(F.col("n") > part_edges)
    degrees = both_ways(edges).groupBy("store", "node").agg(F.sum("weight").alias("degree"))
    degree = lambda c: degrees.select("store", F.col("node").alias(c), F.col("degree").alias(f"{c}_degree"))
    fitting = placed.join(large, ["store", "component"], "left_anti").join(degree("src"), ["store", "src"]).join(degree("dst"), ["store", "dst"])
    found = _in_tasks(fitting, max_iterations, tolerance)
    if not large.isEmpty():
        big = stage(placed.join(large, ["store", "component"], "left_semi").select("store", "component", "src", "dst", "weight"))
        theirs = stage(degrees.join(both_ways(big).select("store", "node").distinct(), ["store", "node"], "left_semi"))
        found = found.unionByName(_in_rounds(big, theirs, stage(total), part_edges, max_iterations, tolerance))
    return own.join(found, ["store", "node"], "left").select("store", "node", F.coalesce("community", "node").alias("community"))


def detect_hierarchy(edges: DataFrame, nodes: DataFrame, min_size: int = 10, max_levels: int = 10, **options) -> DataFrame:
    """(store, level, community, parent, node): communities, and within large ones their parts.

    A community of at least min_size nodes is detected again on its own edges, and
    its parts kept if there are several; parts of one node are left out.
    """
    edges = stage(edges)
    level = stage(detect(edges, nodes, **options).select("store", F.lit(0).alias("level"), "community", F.lit(None).cast("bigint").alias("parent"), "node"))
    out = level
    for depth in range(1, max_levels + 1):
        big = level.groupBy("store", "community").agg(F.count("*").alias("n")).where(F.col("n") >= min_size)
        inside = level.join(big.select("store", "community"), ["store", "community"], "left_semi")
        if inside.isEmpty():
            break
        key = F.concat_ws("/", F.col("store"), F.col("community").cast("string"))
        sub = induced_subgraph(edges, inside.select("node", "community")).select(key.alias("store"), "src", "dst", "weight")
        found = detect(sub, inside.select(key.alias("store"), "node"), **options)
        back = inside.select(key.alias("key"), "store", F.col("community").alias("parent"), "node")
        parts = found.withColumnRenamed("store", "key").join(back, ["key", "node"])
        sizes = parts.groupBy("key", "community").agg(F.count("*").alias("n"))
        several = sizes.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key")
        kept = parts.join(several, "key", "left_semi").join(sizes.where("n > 1").select("key", "community"), ["key", "community"], "left_semi")
        level = stage(kept.select("store", F.lit(depth).alias("level"), "community", "parent", "node"))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def build_upward(relations: DataFrame, entities: DataFrame, max_levels: int = 10, **options) -> DataFrame:
    """(store, level, community, parent, members) of one tree for each store, level 0 the root.

    Entities are clustered, then their communities on the relations that cross
    them, until one is left, none crosses or nothing shrinks; a store that ends
    with several gets a synthetic root, named -1.
    """
    from weftline.operators.graph import fold_edges

    nodes = entities.select("store", F.col("id").alias("node"))
    current = stage(detect(fold_edges(relations), nodes, **options))
    membership = current.select("store", "node", "community")
    steps = [membership.select("store", F.col("community"), F.col("node").alias("member")).withColumn("step", F.lit(0))]
    count = membership.select("store", "community").distinct().count()
    top = membership
    for step in range(1, max_levels):
        crossing = inter_community_weights(relations, membership.select("node", "community"))
        stores = membership.select("store", F.col("community").alias("node")).distinct()
        joined = crossing.join(stores.withColumnRenamed("node", "community_a"), "community_a").select("store", F.col("community_a").alias("src"), F.col("community_b").alias("dst"), F.col("weight").cast("double").alias("weight"))
        if joined.isEmpty():
            break
        merged = stage(detect(joined, stores, **options))
        fresh = merged.select("store", "community").distinct().count()
        if fresh >= count:
            break
        steps.append(merged.select("store", "community", F.col("node").alias("member")).withColumn("step", F.lit(step)))
        membership = stage(membership.join(merged.select("store", F.col("node").alias("community"), F.col("community").alias("up")), ["store", "community"]).select("store", "node", F.col("up").alias("community")))
        top, count = merged, fresh
    tops = top.select("store", "community").distinct()
    several = tops.groupBy("store").agg(F.count("*").alias("k")).where("k > 1").select("store")
    root = tops.join(several, "store", "left_semi").select("store", F.lit(-1).cast("bigint").alias("community"), F.col("community").alias("member")).withColumn("step", F.lit(len(steps)))
    tree = root
    for s in steps:
        tree = tree.unionByName(s)
    # a community's parent is the one of the next step that has it as a member
    highest = tree.groupBy("store").agg(F.max("step").alias("top"))
    ups = tree.select("store", (F.col("step") - 1).alias("step"), F.col("member").alias("community"), F.col("community").alias("parent"))
    rows = tree.groupBy("store", "step", "community").agg(F.count("*").alias("members"))
    return rows.join(ups, ["store", "step", "community"], "left").join(highest, "store").select("store", (F.col("top") - F.col("step")).alias("level"), "community", "parent", "members")
