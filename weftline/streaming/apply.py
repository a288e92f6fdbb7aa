"""Applying model replies as a stream.

Replies may come late, out of order and more than once. Each micro-batch applies
only chunks that have no checkpoint yet, so a chunk is terminal once it has been
applied and a batch that is run again after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import fold_key
from weftline.operators.numbering import with_ids
from weftline.operators.pipeline import apply_extract, apply_summarize
from weftline.operators.strategies import Strategy
from weftline.session import stage
from weftline.sources.catalog import Catalog


def apply_batch(catalog: Catalog, replies: DataFrame, batch_id: int = 0, strategy: Strategy | str | None = None) -> int:
    """Apply one micro-batch of extraction replies (chunk_id, model, response, received_at); returns how many relations came of it.

    Entities, relations, links and checkpoints become visible in one commit, so a
    batch that fails leaves nothing and one that is run again finds its chunks
    done. Ids go on densely from the highest there are. Only an entity that gets
    a type it lacked makes the entities be written anew; all else is appended.
    """
    since = catalog.state()[0]
    latest = replies.where("chunk_id is not null").groupBy("chunk_id").agg(F.max_by(F.struct("model", "response"), "received_at").alias("r")).select("chunk_id", "r.*")
    done = catalog.read("extractions")
    fresh_rows = stage(latest.join(done.select("chunk_id"), "chunk_id", "left_anti"))
    if fresh_rows.isEmpty():
        return 0
    out = apply_extract(fresh_rows.withColumn("seq", F.col("chunk_id")), catalog.read("chunks"), done, catalog.read("relation_synonyms"), strategy=strategy)
    old = catalog.read("entities")
    known = old.select("store", fold_key(F.col("name")).alias("key"), F.col("id").alias("known_id"), F.col("entity_type").alias("known_type"))
    named = stage(out["entities"].withColumn("key", fold_key(F.col("name"))).join(known, ["store", "key"], "left"))
    new = with_ids(named.where("known_id is null").select(F.col("id").alias("local"), "store", "name", "entity_type", "properties"), old, "local")
    ids = stage(new.select("local", "id").unionByName(named.where("known_id is not null").select(F.col("id").alias("local"), F.col("known_id").alias("id"))))
    retyped = named.where("known_id is not null and entity_type is not null and not entity_type <=> known_type").select(F.col("known_id").alias("id"), F.col("entity_type").alias("_t"))
    heads, tails = ids.select(F.col("local").alias("head_id"), F.col("id").alias("_h")), ids.select(F.col("local").alias("tail_id"), F.col("id").alias("_u"))
    top = catalog.read("relations").agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    # relations are numbered by triple; the next ids follow the highest there is
    relations = stage(out["relations"].join(heads, "head_id").join(tails, "tail_id").select((F.col("id") + F.lit(int(top))).alias("id"), "store", F.col("_h").alias("head_id"), F.col("_u").alias("tail_id"), "relation", "canonical_relation"))
    links = out["chunk_entities"].join(ids.withColumnRenamed("local", "entity_id"), "entity_id").select("chunk_id", F.col("id").alias("entity_id")).distinct()
    links = links.join(catalog.read("chunk_entities"), ["chunk_id", "entity_id"], "left_anti")
    checked = out["extractions"].join(fresh_rows.select("chunk_id"), "chunk_id", "left_semi").withColumn("extracted_at", F.current_timestamp())
    replace, append = {}, {"entities": new.drop("local"), "relations": relations, "chunk_entities": links, "extractions": checked}
    if not retyped.isEmpty():
        replace["entities"] = old.join(retyped, "id", "left").withColumn("entity_type", F.coalesce("_t", "entity_type")).drop("_t")
    catalog.commit(replace, append, since)
    return relations.count()


def start_apply(replies: DataFrame, catalog: Catalog, checkpoint: str, **trigger):
    """A streaming query that applies extraction replies to a catalog."""
    writer = replies.writeStream.foreachBatch(lambda df, n: apply_batch(catalog, df, n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def apply_summary_batch(catalog: Catalog, replies: DataFrame, batch_id: int) -> None:
    """Apply one micro-batch of summaries (community_id, response, received_at)."""
    rows = replies.withColumn("seq", F.col("received_at"))
    catalog.write("communities", apply_summarize(catalog.read("communities"), rows))


def start_summaries(replies: DataFrame, catalog: Catalog, checkpoint: str, **trigger):
    writer = replies.writeStream.foreachBatch(lambda df, n: apply_summary_batch(catalog, df, n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
