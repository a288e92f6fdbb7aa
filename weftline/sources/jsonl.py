"""JSON lines and text files in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of each record of an export, in order.
RECORDS = {
    "store": ["name", "dim", "created_at"],
    "chunk": ["id", "store", "content", "source", "metadata", "created_at"],
    "entity": ["id", "store", "name", "entity_type", "properties"],
    "relation": ["id", "store", "head_id", "tail_id", "relation", "canonical_relation", "properties"],
    "community": ["id", "store", "level", "parent_id", "summary", "modularity"],
}


def export_lines(tables: dict[str, DataFrame], store: str) -> DataFrame:
    """(ord, id, json) of a store: the store, its chunks, entities, relations and communities; no vectors or links."""
    out = None
    for i, (record, columns) in enumerate(RECORDS.items()):
        rows = tables[record]
        rows = rows.where(F.col("name" if record == "store" else "store") == store)
        fields = [F.lit(record).alias("record"), *[F.col(c) for c in columns if c in rows.columns]]
        part = rows.select(F.lit(i).alias("ord"), (F.lit(0) if record == "store" else F.col("id")).cast("bigint").alias("id"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("json"))
        out = part if out is None else out.unionByName(part)
    return out


def write_lines(lines: DataFrame, path: str) -> None:
    """Write an export as text, in order."""
    lines.orderBy("ord", "id").select("json").write.text(path)


def write_units(units: DataFrame, path: str) -> None:
    """One work unit per line."""
    units.write.json(path)


def read_replies(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Replies from JSON lines; blank lines are skipped, a bad line fails the whole read with its text."""
    return parse_replies(spark.read.text(path), schema)


def parse_replies(lines: DataFrame, schema: str) -> DataFrame:
    """read_replies for lines (value) that are there already."""
    lines = lines.where(F.trim(F.regexp_replace("value", r"\s+$", "")) != "")
    parsed = lines.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.try_parse_json("value").alias("v"))
    checked = parsed.withColumn("r", F.when(F.col("v").isNull(), F.raise_error(F.concat(F.lit("not JSON: "), F.substring("value", 1, 200)))).otherwise(F.col("r")))
    return checked.select("r.*")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
