"""Queries over parent-child hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.hierarchy import descendants, faulty_links, resolve_hierarchy
from weftline.session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faulty_links(resolve_hierarchy(table(spark, sf_dir, "communities"), paths=False))


def p4_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve_hierarchy(table(spark, sf_dir, "communities"))
    return found.withColumn("path", F.concat_ws("/", F.col("path").cast("array<string>"))).withColumn("path", F.when(F.col("root").isNotNull(), F.col("path")))


def p4_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descendants(resolve_hierarchy(table(spark, sf_dir, "communities")))


def queries():
    return {f.__name__: f for f in (p4_found, p4_paths, p4_descendants)}


_LINKS = """
    RECURSIVE c AS (SELECT id, min(parent_id) AS parent_id FROM communities WHERE id IS NOT NULL GROUP BY id),
    links AS (SELECT c.id, p.id AS parent FROM c JOIN c p ON c.parent_id = p.id),
    up AS (SELECT id, parent AS above FROM links UNION SELECT up.id, links.parent FROM up JOIN links ON up.above = links.id),
    cyc AS (SELECT id FROM up WHERE id = above),
    status AS (
        SELECT c.id, c.parent_id, CASE
            WHEN c.id IN (SELECT id FROM cyc) THEN 'on_cycle'
            WHEN c.id IN (SELECT u.id FROM up u JOIN cyc ON u.above = cyc.id) THEN 'below_cycle'
            WHEN c.parent_id IS NULL THEN 'root'
            WHEN c.parent_id NOT IN (SELECT id FROM c) THEN 'missing_parent' ELSE 'child' END AS status
        FROM c)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": f"WITH {_LINKS} SELECT id AS community_id, status FROM status WHERE status IN ('on_cycle', 'below_cycle', 'missing_parent')",
        "p4_paths": f"""
            WITH {_LINKS},
            sound AS (SELECT id FROM status WHERE status NOT IN ('on_cycle', 'below_cycle')),
            down AS (SELECT id, id AS root, 0 AS depth, id::VARCHAR AS path FROM status WHERE status IN ('root', 'missing_parent')
                UNION ALL SELECT l.id, d.root, d.depth + 1, d.path || '/' || l.id FROM down d JOIN links l ON l.parent = d.id)
            SELECT s.id, s.parent_id, s.status, d.root, d.depth, d.path FROM status s LEFT JOIN down d USING (id)""",
        "p4_descendants": f"""
            WITH {_LINKS},
            sound AS (SELECT id FROM status WHERE status NOT IN ('on_cycle', 'below_cycle')),
            tree AS (SELECT l.parent AS ancestor, l.id AS descendant, 1 AS distance FROM links l JOIN sound USING (id)
                UNION ALL SELECT l.parent, t.descendant, t.distance + 1 FROM tree t JOIN links l ON t.ancestor = l.id)
            SELECT ancestor, descendant, distance FROM tree""",
    }
