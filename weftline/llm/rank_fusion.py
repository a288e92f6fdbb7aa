"""One ranking from several scores on unlike scales.

Method: median rank aggregation. Each score ranks the items of its group by
itself, highest first, ties at their middle rank; an item without that score
(null or NaN) takes the last rank of the group, so that a missing score speaks
for nothing. The group is then ordered by the weighted median of the item's
ranks, then by their weighted mean, then by the identifier.

Weighted median: the least rank at which the weights of the ranks up to it
reach half of all weights; where they reach it exactly, the mean of this rank
and the next.

Scale: a group may hold a third of all rows. Groups above `hot_rows` are cut
into ranges at percentiles of each score, so that no task sorts a whole group:
equal values are counted first, a window numbers the values of one range, and
the ranges' totals, a bounded number, give the offsets. A value that very many
items share, and a missing one, is joined in parts.

Defined results: repeated rows and several hits of one item in one group count
once, with the highest value of each score; infinite scores rank as the
extremes; null groups or items are left out; an item with no score at all ranks
last; an empty table gives an empty ranking. Extra columns are dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.session import stage

#: Groups above this size, or above a thousandth of all rows, are ranked by ranges.
HOT_ROWS = 200_000

#: Ranges of a hot group for each score.
RANGES = 128

#: Parts in which the items of one frequent value, or without a value, get their rank.
SALTS = 32


def _lane_ranks(items: DataFrame, hot: DataFrame, group: str, score: str) -> DataFrame:
    """(group, score, n, rank): the middle rank of each value of one score in its group, and how many items have it."""
    counts = items.where(F.col(score).isNotNull()).groupBy(group, score).agg(F.count("*").alias("n"))
    counts = counts.join(F.broadcast(hot.select(group, F.col(f"cuts_{score}").alias("cuts"))), group, "left")
    counts = counts.withColumn("range", F.coalesce(F.expr(f"size(filter(cuts, c -> c > `{score}`))"), F.lit(0))).withColumn(
        "range", F.when(F.col("cuts").isNull(), 0).otherwise(F.col("range"))
    )
    totals = counts.groupBy(group, "range").agg(F.sum("n").alias("range_n"))
    earlier = Window.partitionBy(group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(group, "range", F.coalesce(F.sum("range_n").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(group, "range").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("above", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(offsets, [group, "range"])
    return ranked.select(group, score, "n", (F.col("offset") + F.col("above") + (F.col("n") + 1) / 2).alias(f"rank_{score}"))


def weighted_median(ranks: list[Column], weights: list[float]) -> Column:
    """The weighted median of a row's ranks."""
    pairs = F.array_sort(F.array(*[F.struct(r.cast("double").alias("r"), F.lit(float(w)).alias("w")) for r, w in zip(ranks, weights)]))
    half = sum(weights) / 2
    # state: weight so far, rank that reached half, rank after it when half was met exactly
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))

    def step(acc: Column, x: Column) -> Column:
        total = acc["sum"] + x["w"]
        exact = F.abs(acc["sum"] - half) < 1e-9
        low = F.when(acc["low"].isNull() & (total > half - 1e-9), x["r"]).otherwise(acc["low"])
        high = F.when(acc["high"].isNull() & acc["low"].isNotNull() & exact, x["r"]).otherwise(acc["high"])
        return F.struct(total.alias("sum"), low.alias("low"), high.alias("high"))

    return F.aggregate(pairs, start, step, lambda a: (a["low"] + F.coalesce(a["high"], a["low"])) / 2)


def median_rank(
    hits: DataFrame,
    group: str = "query_id",
    item: str = "chunk_id",
    scores: tuple[str, ...] = ("rrf", "similarity", "lexical"),
    weights: tuple[float, ...] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """(group, item, rank_<score>..., median_rank, mean_rank, n_items) of every item of every group."""
    weights = tuple(weights or [1.0] * len(scores))
    if len(weights) != len(scores) or min(weights) <= 0:
        raise ValueError("each score needs a positive weight")
    clean = [F.when(F.isnan(F.col(s).cast("double")), None).otherwise(F.col(s).cast("double")).alias(s) for s in scores]
    # -0.0 and 0.0 are one value to rank
    items = (
        hits.select(group, item, *clean)
        .where(F.col(group).isNotNull() & F.col(item).isNotNull())
        .groupBy(group, item)
        .agg(*[(F.max(s) + F.lit(0.0)).alias(s) for s in scores])
    )
    items = stage(items)
    limit = max(hot_rows, items.count() // 1000)
    steps = F.array(*[F.lit(k / RANGES) for k in range(1, RANGES)])
    sizes = items.groupBy(group).agg(F.count("*").alias("n_items"))
    hot = sizes.where(F.col("n_items") > limit).select(group)
    # at most 1000 groups are hot, so what is broadcast is bounded
    cuts = items.join(F.broadcast(hot), group, "left_semi").groupBy(group).agg(
        *[F.array_distinct(F.percentile_approx(s, steps, F.lit(1000))).alias(f"cuts_{s}") for s in scores]
    )
    ranked = items.join(sizes, group)
    salts, none = F.sequence(F.lit(0), F.lit(SALTS - 1)), F.array(F.lit(0))
    for s in scores:
        # a value of very many items, of which there are 1000 at most, is joined in parts, and so are missing values
        often = items.where(F.col(s).isNotNull()).groupBy(group, s).agg(F.count("*").alias("n")).where(F.col("n") > limit).select(group, s, F.lit(True).alias("_often"))
        lane = _lane_ranks(items, cuts, group, s).withColumn("_salt", F.explode(F.when(F.col("n") > limit, salts).otherwise(none))).drop("n")
        spread = F.when(F.col("_often") | F.col(s).isNull(), F.pmod(F.xxhash64(item), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
        ranked = ranked.join(F.broadcast(often), [group, s], "left").withColumn("_salt", spread).join(lane, [group, s, "_salt"], "left").drop("_salt", "_often")
    ranks = [F.coalesce(F.col(f"rank_{s}"), F.col("n_items").cast("double")) for s in scores]
    ranked = ranked.select(group, item, "n_items", *[r.alias(f"rank_{s}") for r, s in zip(ranks, scores)])
    columns = [F.col(f"rank_{s}") for s in scores]
    mean = reduce(lambda a, b: a + b, [c * w for c, w in zip(columns, weights)]) / sum(weights)
    return ranked.withColumn("median_rank", weighted_median(columns, list(weights))).withColumn("mean_rank", mean)


def top_of_groups(ranking: DataFrame, limits: DataFrame, group: str = "query_id", item: str = "chunk_id", limit: str = "top_n", slices: int = 64) -> DataFrame:
    """The first rows of each group's ranking, as many as its limit, with their place.

    A group is cut into slices that are shortened first, so that the last sort
    of a group sees at most slices * limit rows.
    """
    few = limits.select(group, F.col(limit).cast("bigint").alias("_limit")).where(f"`{group}` is not null and _limit > 0").groupBy(group).agg(F.max("_limit").alias("_limit"))
    order = ["median_rank", "mean_rank", item]
    part = Window.partitionBy(group, "_slice").orderBy(*order)
    whole = Window.partitionBy(group).orderBy(*order)
    return (
        ranking.join(few, group)
        .withColumn("_slice", F.pmod(F.xxhash64(item), F.lit(slices)))
        .withColumn("_place", F.row_number().over(part))
        .where("_place <= _limit")
        .withColumn("place", F.row_number().over(whole))
        .where("place <= _limit")
        .drop("_slice", "_place", "_limit")
    )
