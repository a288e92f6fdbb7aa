"""Joins in which one key may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key from which it is hot, if that is also more than a thousandth of all rows; so at most a thousand keys are.
HOT_ROWS = 10_000


def hot_keys(counts: DataFrame, key: str, count: str, rows: int, least: int = HOT_ROWS) -> DataFrame:
    """(key) of the keys of counts (key, count) that are hot among so many rows."""
    return counts.where(F.col(count) > max(least, rows // 1000)).select(key)


def lookup(rows: DataFrame, answers: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """rows joined with the answers (key, ...) of their key.

    Rows of hot keys (a table of a thousand keys at most) stay where they are and
    get their answers, one a key, by broadcast; the others are shuffled.
    """
    hot = hot.withColumn("_hot", F.lit(True))
    marked = rows.join(F.broadcast(hot), key, "left")
    few = answers.join(F.broadcast(hot.select(key)), key, "left_semi")
    usual = marked.where("_hot is null").drop("_hot").join(answers, key)
    return usual.unionByName(marked.where("_hot").drop("_hot").join(F.broadcast(few), key))
