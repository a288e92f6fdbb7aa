"""Connected components of an undirected graph."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.hot import HOT_ROWS, hot_keys, lookup
from weftline.session import frame, stage


#: Graphs of up to this many edges are solved by one task.
SMALL_EDGES = 200_000


def _solve_small(pairs: DataFrame) -> DataFrame:
    """One task's answer for a small graph (a, b)."""
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        least: dict = {}

        def top(x):
            while least.setdefault(x, x) != x:
                least[x] = least[least[x]]
                x = least[x]
            return x

        for batch in batches:
            for a, b in zip(batch["a"], batch["b"]):
                x, y = top(a), top(b)
                if x != y:
                    least[max(x, y)] = min(x, y)
        yield frame(node=list(least), component=[top(x) for x in list(least)])

    return pairs.coalesce(1).mapInPandas(run, f"node {kind}, component {kind}")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, small_edges: int = SMALL_EDGES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(node, component) of every node with an edge; the component is its least node.

    Alternating stars: each node links its greater neighbours to the least node
    it knows, then its lesser neighbours, until nothing changes. Rounds grow with
    the logarithm of the longest chain, not with the chain, and no round
    multiplies the edges. A node with very many neighbours is counted by partial
    aggregation, and its neighbours learn its least one by broadcast.

    A graph of at most small_edges edges goes to one task instead. Null ends and
    loops are left out. Raises if max_rounds do not suffice.
    """
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = stage(pairs)
    if pairs.count() <= small_edges:
        return _solve_small(pairs)

    def both(p: DataFrame) -> DataFrame:
        return p.union(p.select("b", "a")).toDF("u", "v")

    def with_least(p: DataFrame, n: int) -> DataFrame:
        """(u, v, m): each link with the least neighbour of u."""
        # partial aggregation first, so a hub is one row per task before the shuffle
        least = stage(p.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        return lookup(p, least.select("u", "m"), "u", hot_keys(least, "u", "n", n, hot_rows))

    size = pairs.count()
    for _ in range(max_rounds):
        large = with_least(both(pairs), 2 * size).select("v", F.least("u", "m").alias("a"), "u").where("v > u")
        large = stage(large.select(F.col("v").alias("b"), "a").where("a <> b").distinct())
        joined = with_least(large.select(F.col("b").alias("u"), F.col("a").alias("v")), size)
        small = joined.select(F.col("m").alias("a"), F.col("v").alias("b")).union(joined.select(F.col("m").alias("a"), F.col("u").alias("b")))
        new = stage(small.where("a <> b").select("a", "b").distinct())
        count = new.count()
        same = count == size and new.exceptAll(pairs).isEmpty()
        pairs, size = new, count
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    found = pairs.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return found.union(pairs.select(F.col("a").alias("node"), F.col("a").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
