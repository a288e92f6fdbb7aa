"""Results as text for people and models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def format_hits(hits: DataFrame, score: str = "rrf", key: str = "chunk_id") -> DataFrame:
    """(place, text): each hit (key, content, source, score) under its source and score, best first; hits without a score come last.

    A text is made from its own row, so a score never stands with another chunk. Hits are short top lists.
    """
    from pyspark.sql.window import Window

    title = F.concat(F.lit("### ["), F.coalesce("source", F.lit("unknown")), F.lit("]"), F.when(F.col(score).isNull(), "").otherwise(F.concat(F.lit(" (score: "), F.format_string("%.3f", F.col(score)), F.lit(")"))))
    place = F.row_number().over(Window.orderBy(F.col(score).desc_nulls_last(), key))
    return hits.select(place.alias("place"), F.concat(title, F.lit("\n\n"), F.coalesce("content", F.lit("")), F.lit("\n\n---\n")).alias("text"))


def community_contexts(members: DataFrame, relations: DataFrame) -> DataFrame:
    """(community_id, text): members (community_id, id, name, entity_type) by name, each with its relations to other members.

    Members are matched by id. A relation shows under both its ends. What is
    brought together in one row is what one prompt holds.
    """
    one = members.select("community_id", "id", "name", "entity_type")
    ends = relations.select(F.col("head_id").alias("id"), F.col("tail_id").alias("other_id"), "relation").unionByName(relations.where("head_id <> tail_id").select(F.col("tail_id").alias("id"), F.col("head_id").alias("other_id"), "relation"))
    others = one.select("community_id", F.col("id").alias("other_id"), F.col("name").alias("other"))
    inside = one.select("community_id", "id").join(ends, "id").join(others, ["community_id", "other_id"])
    lines = inside.groupBy("community_id", "id").agg(F.array_sort(F.collect_list(F.concat(F.lit("  -> "), F.coalesce("relation", F.lit("")), F.lit(" -> "), F.coalesce("other", F.lit(""))))).alias("lines"))
    head = F.concat(F.lit("- "), F.coalesce("name", F.lit("")), F.lit(" ("), F.coalesce("entity_type", F.lit("unknown")), F.lit(")"))
    each = one.join(lines, ["community_id", "id"], "left").select("community_id", F.struct(F.coalesce("name", F.lit("")).alias("n"), "id", F.concat_ws("\n", head, F.array_join(F.coalesce("lines", F.array().cast("array<string>")), "\n")).alias("t")).alias("x"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: F.rtrim(x["t"], F.lit("\n"))), "\n")
    return each.groupBy("community_id").agg(F.concat(F.lit("Entities in this community:\n"), text).alias("text"))


def review_spans(spans: list[dict], preview: int = 60) -> str:
    """Spans for a look over: number, lines, bytes, fingerprint and the first characters of each."""
    out = []
    for s in spans:
        out.append(f"[{s['index']:>3}] lines {s['line_start']:>5}-{s['line_end']:<5} bytes {s['start']:>7}-{s['end']:<7} ({s['end'] - s['start']} B) {s['fingerprint']}")
        out.append("      " + s["text"][:preview].replace("\n", " ⏎ "))
    return "".join(line + "\n" for line in out)
