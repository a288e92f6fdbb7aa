"""Mixing sources to target shares of all tokens.

Method: Sainte-Laguë apportionment. The mixture is made of blocks of equal
token size. Each next block goes to the source with the highest quotient
share / (2 * blocks so far + 1), as long as the source has tokens left within
its cap of repetitions. The output shards are filled one after the other by the
same rule with the quotas as shares, which gives whole-number quotas per shard,
so that every shard has the mixture's shares. Within a
source, documents lie in a seeded random order; copy r of a document lies one
whole pass later; block b holds the documents that begin in tokens
[b * block, (b + 1) * block) of that order, and the first `quota` blocks of
the seeded order are taken.

The order needs no sort of a whole source: a seeded hash puts each document in
one of many small bins, bins are summed before they are put in order, and a
running sum inside a bin gives the place. A source with a third of all rows is
so spread over as many tasks as its size asks for.

Defined results: documents with a null source, a source without a target or a
text without tokens are left out; a target source without documents gets 0
blocks and its share is reported as missing; null or negative shares count as
0; null or non-positive max_repeats count as 1. Repeated rows of one document
id count once; should they differ, the least source and size hold. Empty tables
give an empty mixture and a report of zeros.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from weftline.llm.token_encode import count_tokens
from weftline.session import stage

#: The mixture is apportioned on the driver, so the list of target sources must be this short.
MAX_TARGETS = 10_000

#: Tokens of one bin of the seeded order, about, and most bins of a source; beyond that bins are larger.
BIN_TOKENS, MOST_BINS = 200_000, 100_000


def sainte_lague(shares: list[float], seats: int, caps: list[int]) -> list[int]:
    """Seats by highest quotient share / (2a + 1) under a cap for each party.

    Ties go to the party that comes first. Seats that no party can take are
    left over. Most of the seats are given at once, so that the cost is in the
    number of parties: a party with share s of the sum S gets at least
    floor(s * seats / S) - 1 seats minus those that caps return to others.
    """
    n = len(shares)
    got = [0] * n
    exact = [Fraction(max(s, 0.0)) for s in shares]
    free = [i for i in range(n) if exact[i] > 0 and caps[i] > 0]
    left = seats
    while free and left > 0:
        total = sum(exact[i] for i in free)
        held = sum(got[i] for i in free)
        bulk = {i: min(caps[i], max(got[i], int(exact[i] * (held + left) / total) - n)) for i in free}
        gain = sum(bulk[i] - got[i] for i in free)
        if gain <= 0:
            break
        for i in free:
            got[i] = bulk[i]
        left -= gain
        free = [i for i in free if got[i] < caps[i]]
    heap = [(-(exact[i] / (2 * got[i] + 1)), i) for i in free]
    heapq.heapify(heap)
    while heap and left > 0:
        _, i = heapq.heappop(heap)
        got[i] += 1
        left -= 1
        if got[i] < caps[i]:
            heapq.heappush(heap, (-(exact[i] / (2 * got[i] + 1)), i))
    return got


def shard_quotas(quotas: list[int], shards: int) -> list[list[int]]:
    """Whole-number quotas of each source for each shard; rows are shards.

    The first s shards together are apportioned to the sources by their quotas;
    as the rule never takes a seat back when there are more, shard s gets what
    comes with its seats. All shards have the same size, give or take a block.
    """
    total = sum(quotas)
    upto = [sainte_lague([float(q) for q in quotas], total * s // shards, quotas) for s in range(shards + 1)]
    return [[b - a for a, b in zip(upto[s], upto[s + 1])] for s in range(shards)]


def mix_plan(supply: dict[str, int], targets: list[tuple[str, float, int]], block_tokens: int, total_tokens: int | None) -> list[dict]:
    """Quota of blocks of each target source.

    Without total_tokens the mixture is as large as the scarcest source that
    has documents lets the targets be met.
    """
    shares = [max(s or 0.0, 0.0) for _, s, _ in targets]
    repeats = [r if r and r > 0 else 1 for _, _, r in targets]
    room = [supply.get(name, 0) * r for (name, _, _), r in zip(targets, repeats)]
    if total_tokens is None:
        whole = sum(shares) or 1.0
        total_tokens = int(min((r * whole / s for r, s in zip(room, shares) if s > 0 and r > 0), default=0))
    caps = [r // block_tokens for r in room]
    quotas = sainte_lague(shares, total_tokens // block_tokens, caps)
    return [
        {"source": name, "target_share": share, "max_repeats": r, "supply_tokens": supply.get(name, 0), "quota": q}
        for (name, _, _), share, r, q in zip(targets, shares, repeats, quotas)
    ]


def mix_sources(
    docs: DataFrame,
    targets: DataFrame,
    block_tokens: int = 2048,
    shards: int = 8,
    total_tokens: int | None = None,
    seed: int = 17,
    vocabulary: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(rows, report) of the mixture.

    rows: doc_id, source, copy, block, shard, n_tokens; copy counts from 0.
    report: one row per target source with its target and actual share.
    """
    spark = docs.sparkSession
    few = targets.select("source", "target_share", "max_repeats").where(F.col("source").isNotNull()).dropDuplicates(["source"]).orderBy("source")
    wanted = [tuple(r) for r in few.limit(MAX_TARGETS + 1).collect()]
    if len(wanted) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} target sources")
    names = spark.createDataFrame([(w[0],) for w in wanted], "source string")
    known = docs.select("doc_id", "source", "text").join(F.broadcast(names), "source", "left_semi")
    sized = count_tokens(known, ["doc_id", "source"], path=vocabulary).where("n_tokens > 0")
    sized = stage(sized.groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("r")).select("doc_id", "r.*"))
    supply = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    plan = mix_plan(supply, wanted, block_tokens, total_tokens)

    quotas = shard_quotas([p["quota"] for p in plan], shards)
    # the first block of each shard of each source: a block's shard is found by counting the firsts up to it
    firsts = [[sum(quotas[s][i] for s in range(k)) for k in range(1, shards)] for i in range(len(plan))]
    bins = [max(1, min(MOST_BINS, p["supply_tokens"] // BIN_TOKENS)) for p in plan]
    schema = "source string, supply bigint, quota bigint, copies int, bins bigint, firsts array<bigint>"
    per_source = spark.createDataFrame([(p["source"], p["supply_tokens"], p["quota"], p["max_repeats"], b, f) for p, b, f in zip(plan, bins, firsts)], schema)

    order = sized.join(F.broadcast(per_source), "source").where("quota > 0").withColumn("h", F.xxhash64("doc_id", F.lit(seed))).withColumn("bin", F.pmod("h", "bins"))
    sums = order.groupBy("source", "bin").agg(F.sum("n_tokens").alias("bin_tokens"))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "bin", F.coalesce(F.sum("bin_tokens").over(before), F.lit(0)).alias("bin_start"))
    within = Window.partitionBy("source", "bin").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = order.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(starts, ["source", "bin"])
    rows = (
        # only the copies that begin before the quota's last block ends
        placed.withColumn("begin", F.expr("bin_start + inside"))
        .withColumn("most", F.expr(f"least(copies, (quota * {int(block_tokens)} - begin + supply - 1) div supply)"))
        .where("most > 0")
        .withColumn("copy", F.explode(F.expr("sequence(0, cast(most as int) - 1)")))
        .withColumn("block", F.expr(f"(copy * supply + begin) div {int(block_tokens)}"))
        .where("block < quota")
        .withColumn("shard", F.expr("size(filter(firsts, f -> f <= block))"))
        .select("doc_id", "source", "copy", "block", "shard", "n_tokens")
    )
    rows = stage(rows)
    drawn = rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_rows"), (F.max("copy") + 1).alias("times"))
    kept = T.StructType.fromDDL("source string, target_share double, max_repeats int, supply_tokens bigint, quota bigint")
    base = spark.createDataFrame([(p["source"], float(p["target_share"]), p["max_repeats"], p["supply_tokens"], p["quota"]) for p in plan], kept)
    whole = Window.partitionBy()
    report = (
        base.join(F.broadcast(drawn), "source", "left")
        .withColumn("tokens", F.coalesce("tokens", F.lit(0)))
        .withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
        .withColumn("times", F.coalesce("times", F.lit(0)))
        .withColumn("actual_share", F.when(F.sum("tokens").over(whole) > 0, F.col("tokens") / F.sum("tokens").over(whole)).otherwise(0.0))
    )
    return rows, report
