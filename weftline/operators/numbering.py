"""Dense numbers for rows in an order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import stage

#: monotonically_increasing_id keeps the partition above these bits and the place in it below.
_PLACE_BITS = 33


def numbered(rows: DataFrame, order: str, name: str = "id", above: DataFrame | None = None, column: str = "id") -> DataFrame:
    """rows with name = place in order, from 1, or from the highest `column` of `above` on.

    The rows are cut into sorted ranges and written once with their place in their
    range; only then are the ranges counted, so counts and places belong to the
    same cut. No window runs over all rows. What is broadcast is one row a
    range. Ties in order are numbered one after the other, in no set order.
    """
    ranged = rows.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id())
    fixed = stage(ranged).withColumn("_part", F.shiftright("_at", _PLACE_BITS))
    sizes = {r["_part"]: r["n"] for r in fixed.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    top = 0
    if above is not None:
        top = above.agg(F.coalesce(F.max(column), F.lit(0))).first()[0]
    before, so_far = [], int(top)
    for part in sorted(sizes):
        before.append((part, so_far))
        so_far += sizes[part]
    offsets = rows.sparkSession.createDataFrame(before, "_part long, _before long")
    place = F.col("_before") + F.col("_at") - F.shiftleft("_part", _PLACE_BITS) + 1
    return fixed.join(F.broadcast(offsets), "_part").withColumn(name, place).drop("_part", "_at", "_before")


def with_ids(rows: DataFrame, existing: DataFrame, order: str) -> DataFrame:
    """rows with id = highest existing id + place in order."""
    return numbered(rows, order, "id", existing)
