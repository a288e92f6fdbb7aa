"""Schemas of the tables and migration of older ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

_TYPES = {"string": StringType(), "int": IntegerType(), "bigint": LongType(), "double": DoubleType(), "timestamp": TimestampType(), "array<float>": ArrayType(FloatType())}


def _struct(columns: str) -> StructType:
    return StructType([StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in columns.split(", "))])


TABLES: dict[str, StructType] = {
    name: _struct(ddl)
    for name, ddl in {
        "stores": "name string, dim int, created_at timestamp",
        "chunks": "id bigint, store string, content string, source string, metadata string, created_at timestamp",
        "chunk_embeddings": "chunk_id bigint, embedding array<float>",
        "entities": "id bigint, store string, name string, entity_type string, properties string",
        "relations": "id bigint, store string, head_id bigint, tail_id bigint, relation string, canonical_relation string, properties string",
        "relation_synonyms": "raw string, canonical string",
        "entity_type_synonyms": "raw string, canonical string",
        "entity_embeddings": "entity_id bigint, embedding array<float>",
        "entity_merges": "target_entity_id bigint, merged_entity_name string, merged_at timestamp",
        "chunk_entities": "chunk_id bigint, entity_id bigint",
        "communities": "id bigint, store string, level int, parent_id bigint, summary string, modularity double, created_at timestamp",
        "entity_communities": "entity_id bigint, community_id bigint",
        "extractions": "chunk_id bigint, model string, triple_count bigint, extracted_at timestamp",
        "capsules": "id bigint, capsule_id string, project_id string, kind string, content_fingerprint string, generated_at string, body string",
    }.items()
}

#: Tables whose rows belong to a store directly, and the links that follow them: table -> (column, table it points to).
OWNED = ("chunks", "entities", "relations", "communities")
LINKS = {
    "chunk_embeddings": [("chunk_id", "chunks")],
    "entity_embeddings": [("entity_id", "entities")],
    "chunk_entities": [("chunk_id", "chunks"), ("entity_id", "entities")],
    "entity_communities": [("entity_id", "entities"), ("community_id", "communities")],
    "extractions": [("chunk_id", "chunks")],
}


def migrate(df: DataFrame, name: str) -> DataFrame:
    """df with exactly the columns of a table: missing ones null, all cast, others dropped."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES[name]])


def empty(spark, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])
