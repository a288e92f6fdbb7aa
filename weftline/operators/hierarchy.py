"""Parent-child links to whole hierarchies: status, root, depth and path of every node, and descendants.

Method: each round spreads the nodes over partitions, follows the links that
stay inside a partition and so contracts every chain to its fragment exit, the
node whose parent lies elsewhere. Only exits that another fragment hangs on go
into the smaller quotient forest, which is solved in the same way; after one
round at least, a quotient of up to `base_nodes` links is solved by one task.
Depth, root and, if asked for, path of the quotient are then put in front of
those inside the fragments. A cycle shows inside a partition, or as a cycle of
fragments; then the nodes between the place a fragment is entered and its exit
are on it too, the others of these fragments lead into it.

Status, root and depth take a few numbers a node, however deep the trees are;
paths are put together only for those who ask for them, and only then does a row
grow with its depth. Inside a partition links are followed by doubling on arrays.

So that links do stay inside partitions, a node whose coin shows tails goes to
the partition of its parent if the parent's coin shows heads; the coins are
hashes of id and round. Children of a parent with very many children stay
where they are, so that no partition gets a third of all rows, and they get
their parent's answer by a broadcast of the answers of such parents, of which
there are a thousand at most.

Status of a node: `root` (no parent), `missing_parent` (its parent names no
node; it counts as a root for what hangs on it), `child`, `on_cycle`,
`below_cycle`. Nodes on or below a cycle have null root, depth and path.

Defined results: null ids are left out; repeated rows count once, and of
several parents of one id the least counts, null before all. An empty table
gives an empty result. Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.hot import HOT_ROWS, hot_keys, lookup
from weftline.session import frame, parallelism, stage

#: Quotient forests up to this size are solved by one task.
BASE_NODES = 2_000

#: A parent with more children than this, and than a thousandth of all nodes, draws none of them to its partition.
HOT_CHILDREN = HOT_ROWS

#: Rows of paths that are handed on at a time.
PATH_ROWS = 2_048

ROOT, CYCLE, BELOW, OPEN = "root", "cycle", "below", "open"
_LONGS = "array<bigint>"
_ANSWER = f"id bigint, state string, root bigint, depth bigint, path {_LONGS}"


def follow(ids: np.ndarray, parents: np.ndarray, has: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(up, states, exits, distances) of nodes whose links are followed as far as both ends are here.

    up holds places of parents, a node's own if its parent is not here. Exits are
    places: of the root, the node whose parent lies elsewhere, or the node itself
    on or below a cycle. Doubling: the jumps after k rounds are 2**k links long.
    """
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    found = np.searchsorted(ids[order], parents)
    found = np.where(found < n, found, 0)
    place = order[found] if n else found
    here = has & (ids[place] == parents) if n else has
    up = np.where(here, place, np.arange(n))
    jump, far = up.copy(), np.where(here, weights, 0)
    for _ in range(max(1, n).bit_length()):
        far, jump = far + far[jump], jump[jump]
    ended = ~here[jump]
    states = np.where(ended, np.where(has[jump], OPEN, ROOT), BELOW).astype(object)
    # who ends nowhere has arrived on its cycle after n links, and every node of a cycle is arrived at
    states[np.unique(jump[~ended])] = CYCLE
    return up, states, np.where(ended, jump, np.arange(n)), np.where(ended, far, 0)


def chain(place: int, up: np.ndarray, ids: list[int], vias: list | None) -> list[int]:
    """The path down to a node from where its links end, with what the links skip."""
    out = []
    while True:
        out.append(ids[place])
        if up[place] == place:
            return out[::-1]
        if vias is not None:
            out += vias[place][::-1]
        place = up[place]


def _whole(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(batches) or [pd.DataFrame({c: pd.Series(dtype=object) for c in ("id", "parent", "has", "weight", "via")})], ignore_index=True)


def _arrays(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return tuple(rows[c].to_numpy(dtype=kind) for c, kind in (("id", np.int64), ("parent", np.int64), ("has", bool), ("weight", np.int64)))


def _sent(nodes: DataFrame) -> DataFrame:
    """Nodes as the workers get them: without null numbers, which pandas would turn into floats."""
    return nodes.select("id", F.coalesce("parent", F.lit(0)).alias("parent"), F.col("parent").isNotNull().alias("has"), "weight", "via")


def _vias(rows: pd.DataFrame, paths: bool) -> list | None:
    return [[] if v is None else [int(x) for x in v] for v in rows["via"]] if paths else None


def _solve_small(nodes: DataFrame, paths: bool) -> DataFrame:
    """One task's answer for a small forest of (id, parent, weight, via)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = _whole(batches)
        ids, parents, has, weights = _arrays(rows)
        up, states, exits, far = follow(ids, parents, has, weights)
        vias, names, up = _vias(rows, paths), ids.tolist(), up.tolist()
        for a in range(0, len(ids), PATH_ROWS):
            part = range(a, min(a + PATH_ROWS, len(ids)))
            sound = [states[i] == ROOT for i in part]
            yield frame(
                id=names[a : a + PATH_ROWS],
                state=states[a : a + PATH_ROWS].tolist(),
                root=[names[exits[i]] if s else None for i, s in zip(part, sound)],
                depth=[int(far[i]) if s else None for i, s in zip(part, sound)],
                path=[chain(i, up, names, vias) if s and paths else None for i, s in zip(part, sound)],
            )

    return _sent(nodes).coalesce(1).mapInPandas(run, _ANSWER)


def _hot_parents(nodes: DataFrame, n: int, hot_children: int) -> DataFrame:
    return hot_keys(nodes.where("parent is not null").groupBy("parent").count(), "parent", "count", n, hot_children)


def _solve(nodes: DataFrame, round_: int, base_nodes: int, hot_children: int, paths: bool) -> DataFrame:
    """(id, state, root, depth, path) of a forest (id, parent, weight, via) whose parents all exist; path is null without paths.

    A link stands for `weight` links, and via holds the nodes that it skips.
    """
    spark = nodes.sparkSession
    n = nodes.count()
    if round_ and n <= base_nodes:
        return stage(_solve_small(nodes, paths))
    hot = stage(_hot_parents(nodes, n, hot_children))
    coin = lambda c: F.pmod(F.xxhash64(c, F.lit(round_)), F.lit(2)) == 0
    follows = F.col("parent").isNotNull() & F.col("hot").isNull() & ~coin("id") & coin("parent")
    keyed = nodes.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "parent", "left").withColumn("key", F.when(follows, F.col("parent")).otherwise(F.col("id")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = _whole(batches)
        ids, parents, has, weights = _arrays(rows)
        up, states, exits, far = follow(ids, parents, has, weights)
        vias, names, ups = _vias(rows, paths), ids.tolist(), up.tolist()
        for a in range(0, len(ids), PATH_ROWS):
            part = range(a, min(a + PATH_ROWS, len(ids)))
            yield frame(
                id=names[a : a + PATH_ROWS],
                parent=[int(parents[i]) if has[i] else None for i in part],
                weight=weights[a : a + PATH_ROWS].tolist(),
                via=[vias[i] if paths else None for i in part],
                state=states[a : a + PATH_ROWS].tolist(),
                exit=[names[exits[i]] for i in part],
                far=far[a : a + PATH_ROWS].tolist(),
                path=[chain(i, ups, names, vias) if paths and states[i] in (OPEN, ROOT) else None for i in part],
            )

    width = max(2, parallelism(spark))
    schema = f"id bigint, parent bigint, weight bigint, via {_LONGS}, state string, exit bigint, far bigint, path {_LONGS}"
    local = stage(_sent(keyed.repartition(width, "key")).mapInPandas(run, schema))

    # the quotient: a link goes from an exit to the exit of the fragment its parent lies in
    exits = local.where((F.col("state") == OPEN) & (F.col("id") == F.col("exit"))).select("id", "parent", "weight", "via")
    landing = local.select(F.col("id").alias("parent"), F.col("state").alias("to_state"), F.col("exit").alias("to_exit"), F.col("far").alias("to_far"), F.col("path").alias("to_path"))
    is_open, is_root = F.col("to_state") == OPEN, F.col("to_state") == ROOT
    # to_path runs from where the fragment ends to the parent; what follows its first node lies on the link
    links = stage(
        lookup(exits, landing, "parent", hot).select(
            "id",
            F.col("parent").alias("enters"),
            F.when(is_open, F.col("to_exit")).alias("parent"),
            (F.col("weight") + F.col("to_far")).alias("weight"),
            F.when(is_open, F.concat(F.slice("to_path", 2, 1_000_000_000), "via")).alias("via"),
            F.when(is_root, F.lit(ROOT)).when(~is_open, F.lit(BELOW)).alias("state"),
            F.when(is_root, F.col("to_exit")).alias("root"),
            F.when(is_root, F.concat("to_path", "via", F.array("id"))).alias("path"),
        )
    )
    inner = links.join(links.where("parent is not null").select(F.col("parent").alias("id")).distinct(), "id", "left_semi")
    solved = _solve(inner.select("id", "parent", "weight", "via"), round_ + 1, base_nodes, hot_children, paths)

    # what the quotient's roots hang on comes in front of what hangs on them
    ends = links.where("parent is null").select("id", "state", "root", F.col("weight").alias("depth"), "path")
    fronts = ends.select(F.col("id").alias("root"), F.col("state").alias("top_state"), F.col("root").alias("top"), F.col("depth").alias("top_depth"), F.col("path").alias("front"))
    known = stage(
        solved.join(fronts, "root", "left").select(
            "id",
            F.when(F.col("state") == ROOT, F.col("top_state")).otherwise(F.col("state")).alias("state"),
            F.col("top").alias("root"),
            (F.col("depth") + F.col("top_depth")).alias("depth"),
            F.concat("front", F.slice("path", 2, 1_000_000_000)).alias("path"),
        )
    )
    # exits nothing hangs on take the answer of the exit they hang on
    rest = links.join(known.select("id"), "id", "left_anti")
    up = known.select(F.col("id").alias("parent"), F.col("state").alias("up_state"), F.col("root").alias("up_root"), F.col("depth").alias("up_depth"), F.col("path").alias("up_path"))
    leaves = lookup(rest.where("parent is not null").select("id", "parent", "weight", "via"), up, "parent", _hot_parents(rest, n, hot_children)).select(
        "id",
        F.when(F.col("up_state") == ROOT, F.lit(ROOT)).otherwise(F.lit(BELOW)).alias("state"),
        F.col("up_root").alias("root"),
        (F.col("up_depth") + F.col("weight")).alias("depth"),
        F.concat("up_path", "via", F.array("id")).alias("path"),
    )
    answers = known.unionByName(leaves).unionByName(rest.where("parent is null").select("id", "state", "root", F.col("weight").alias("depth"), "path"))
    answers = answers.select(F.col("id").alias("exit"), F.col("state").alias("exit_state"), F.col("root").alias("exit_root"), F.col("depth").alias("exit_depth"), F.col("path").alias("exit_path"))
    on_cycle = known.where(F.col("state") == CYCLE).select("id")
    between = _between(local, links.join(on_cycle, "id", "left_semi").select(F.col("enters").alias("id"), F.lit(True).alias("entered")), on_cycle)
    cyclic = F.col("exit_state") == CYCLE
    full = local.where(F.col("state") == OPEN).select("id", "exit", "far", F.col("path").alias("own")).join(answers, "exit").join(between, "id", "left")
    expanded = full.select(
        "id",
        F.when(cyclic & F.col("between"), F.lit(CYCLE)).when(cyclic, F.lit(BELOW)).otherwise(F.col("exit_state")).alias("state"),
        F.col("exit_root").alias("root"),
        (F.col("exit_depth") + F.col("far")).alias("depth"),
        F.concat("exit_path", F.slice("own", 2, 1_000_000_000)).alias("path"),
    )
    ended = local.where(F.col("state") != OPEN).select("id", "state", F.when(F.col("state") == ROOT, F.col("exit")).alias("root"), F.when(F.col("state") == ROOT, F.col("far")).alias("depth"), "path")
    return stage(ended.unionByName(expanded))


def _between(local: DataFrame, entered: DataFrame, on_cycle: DataFrame) -> DataFrame:
    """(id, between): the nodes of fragments on a cycle from where they are entered to their exit."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        above = dict(zip(rows["id"].tolist(), rows["parent"].tolist()))
        out: set[int] = set()
        for at in rows["id"][rows["entered"].notna()].tolist():
            while at in above and at not in out:
                out.add(at)
                at = above[at]
        return frame(id=sorted(out), between=[True] * len(out))

    parts = local.where(F.col("state") == OPEN).select("id", "parent", "exit").join(on_cycle.withColumnRenamed("id", "exit"), "exit", "left_semi")
    marked = parts.join(entered.distinct(), "id", "left")
    # a fragment lies in one partition, so its nodes fit where they have been before
    return marked.groupBy("exit").applyInPandas(run, "id bigint, between boolean")


def resolve_hierarchy(rows: DataFrame, id_: str = "id", parent: str = "parent_id", base_nodes: int = BASE_NODES, hot_children: int = HOT_CHILDREN, paths: bool = True) -> DataFrame:
    """(id, parent_id, status, root, depth, path) of every node; the path runs from the root to the node, and is left out without paths."""
    links = rows.select(F.col(id_).cast("bigint").alias("id"), F.col(parent).cast("bigint").alias("parent")).where("id is not null")
    links = links.groupBy("id").agg(F.min(F.struct(F.col("parent").isNotNull(), "parent")).alias("p")).select("id", F.col("p.parent").alias("parent"))
    links = stage(links)
    # one row a parent, so that very many children of one cost nothing in the join
    named = stage(links.where("parent is not null").groupBy("parent").agg(F.count("*").alias("children")).join(links.select(F.col("id").alias("parent"), F.lit(True).alias("there")), "parent", "left"))
    n = links.count()
    hot = stage(hot_keys(named, "parent", "children", n, hot_children))
    inner_ids = named.where("there").select(F.col("parent").alias("id"))
    # nodes without children need no contraction: they take the answer of their parent
    inner = lookup(links.join(inner_ids, "id", "left_semi").where("parent is not null"), named.select("parent", "there"), "parent", hot)
    inner = stage(inner.select("id", "parent", F.col("there").isNull().alias("missing")).unionByName(links.join(inner_ids, "id", "left_semi").where("parent is null").withColumn("missing", F.lit(False))))
    via = (F.array() if paths else F.lit(None)).cast(_LONGS)
    solved = _solve(inner.select("id", F.when(~F.col("missing"), F.col("parent")).alias("parent"), F.lit(1).cast("bigint").alias("weight"), via.alias("via")), 0, base_nodes, hot_children, paths)
    inner_rows = inner.join(solved, "id")
    outer = links.join(inner_ids, "id", "left_anti")
    up = named.select("parent", "there").join(solved.select(F.col("id").alias("parent"), F.col("state").alias("up_state"), F.col("root").alias("up_root"), F.col("depth").alias("up_depth"), F.col("path").alias("up_path")), "parent", "left")
    hung = lookup(outer.where("parent is not null"), up, "parent", hot).select(
        "id",
        "parent",
        F.col("there").isNull().alias("missing"),
        F.when(F.col("there").isNull() | (F.col("up_state") == ROOT), F.lit(ROOT)).otherwise(F.lit(BELOW)).alias("state"),
        F.when(F.col("there").isNull(), F.col("id")).otherwise(F.col("up_root")).alias("root"),
        F.when(F.col("there").isNull(), F.lit(0)).otherwise(F.col("up_depth") + 1).cast("bigint").alias("depth"),
        F.when(F.col("there").isNull(), F.array("id")).otherwise(F.concat("up_path", F.array("id"))).alias("path"),
    )
    alone = outer.where("parent is null").select("id", "parent", F.lit(False).alias("missing"), F.lit(ROOT).alias("state"), F.col("id").alias("root"), F.lit(0).cast("bigint").alias("depth"), F.array("id").alias("path"))
    everything = inner_rows.unionByName(hung).unionByName(alone)
    sound = F.col("state") == ROOT
    status = (
        F.when(F.col("state") == CYCLE, "on_cycle")
        .when(F.col("state") == BELOW, "below_cycle")
        .when(F.col("missing"), "missing_parent")
        .when(F.col("parent").isNull(), "root")
        .otherwise("child")
    )
    out = [F.when(sound, F.col("root")).alias("root"), F.when(sound, F.col("depth")).cast("int").alias("depth")]
    return everything.select("id", F.col("parent").alias("parent_id"), status.alias("status"), *out, *([F.when(sound, F.col("path")).alias("path")] if paths else []))


def descendants(resolved: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance), distance at least 1, for nodes of sound trees."""
    pairs = resolved.where("path is not null").select(F.col("id").alias("descendant"), "depth", F.posexplode("path").alias("pos", "ancestor"))
    return pairs.where("pos < depth").select("ancestor", "descendant", (F.col("depth") - F.col("pos")).alias("distance"))


def faulty_links(resolved: DataFrame) -> DataFrame:
    """(community_id, status) of nodes whose links are faulty."""
    return resolved.where(F.col("status").isin("on_cycle", "below_cycle", "missing_parent")).select(F.col("id").alias("community_id"), "status")
