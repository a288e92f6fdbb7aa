"""Planning and applying work for models, and the state of a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.parsing import parse_replies, wants_json
from weftline.functions.text import embed_text
from weftline.operators.joins import pending_chunks, pending_communities, unclustered_entities, unembedded_entities
from weftline.operators.listing import limited
from weftline.operators.numbering import numbered
from weftline.operators.resolve import persist_triples
from weftline.operators.strategies import Strategy, strategy_for


def plan_extract(chunks: DataFrame, extractions: DataFrame, model: str, limit: int | None = None, strategy: Strategy | None = None) -> DataFrame:
    """(unit_id, kind, chunk_id, store, model, system_prompt, user_prompt, format) of chunks still to be extracted, by id.

    The strategy is the one that suits the model unless one is given. Places in
    a store are counted over ids alone, cut into ranges, so no store's texts meet
    in one task and no window runs over a store.
    """
    strategy = strategy or strategy_for(model)
    pending = limited(pending_chunks(chunks, extractions).orderBy("id"), limit)
    order = numbered(pending.select(F.struct("store", "id").alias("order")), "order", "at").select(F.col("order.store").alias("store"), F.col("order.id").alias("id"), "at")
    sizes = F.broadcast(order.groupBy("store").agg(F.min("at").alias("first"), F.count("*").alias("total")).withColumnRenamed("store", "_store"))
    places = order.join(sizes, F.col("store").eqNullSafe(F.col("_store"))).select("id", (F.col("at") - F.col("first") + 1).alias("place"), "total")
    rows = pending.join(places, "id")
    unit = F.concat(F.lit("extract:chunk:"), F.col("id").cast("string")).alias("unit_id")
    prompt = strategy.user_prompt(F.col("content"), F.col("place"), F.col("total"))
    return rows.select(unit, F.lit("extract").alias("kind"), F.col("id").alias("chunk_id"), "store", F.lit(model).alias("model"), F.lit(strategy.system).alias("system_prompt"), prompt.alias("user_prompt"), F.lit(strategy.format).cast("string").alias("format"))


def apply_extract(replies: DataFrame, chunks: DataFrame, extractions: DataFrame, synonyms: DataFrame, skip_done: bool = False, strategy: Strategy | str | None = None) -> dict[str, DataFrame]:
    """Results of replies (seq, chunk_id, model, response): entities, relations, chunk_entities and extractions.

    Replies are read in the strategy's form, with "model" in that which suits each
    row's model, and without one in the form that each reply has.

    Ids are places among these replies: a relation's is the place of its triple,
    an entity's twice that of the triple it is first named in, plus 1 as its tail.
    Every reply is checkpointed, also without triples. Replaying adds relations
    again unless skip_done leaves out chunks that are in extractions.
    """
    rows = replies.where("chunk_id is not null")
    if skip_done:
        rows = rows.join(extractions.select("chunk_id"), "chunk_id", "left_anti")
    as_json = None if strategy is None else wants_json(F.col("model")) if strategy == "model" else F.lit(strategy.as_json)
    parsed = parse_replies(rows, as_json)
    exploded = parsed.select("seq", "chunk_id", F.posexplode("triples").alias("pos", "t")).join(chunks.select(F.col("id").alias("chunk_id"), "store"), "chunk_id")
    # dense places of triples: replies in order, triples within a reply in order
    placed = numbered(exploded.select("store", F.struct("seq", "chunk_id", "pos").alias("order"), "chunk_id", "t.head", "t.head_type", "t.relation", "t.tail", "t.tail_type"), "order", "seq")
    out = persist_triples(placed.drop("order"), synonyms)
    done = parsed.groupBy("chunk_id").agg(F.max_by("model", "seq").alias("model"), F.max_by(F.size("triples"), "seq").cast("bigint").alias("triple_count"), F.max_by("malformed", "seq").alias("malformed"))
    kept = extractions.join(done.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", "model", "triple_count")
    out["extractions"] = kept.unionByName(done.select("chunk_id", "model", "triple_count"))
    out["malformed"] = done.select("chunk_id", "malformed")
    return out


def plan_summarize(communities: DataFrame, members: DataFrame, model: str, limit: int | None = None) -> DataFrame:
    """(unit_id, kind, chunk_id, community_id, model, user_prompt) of communities whose children are all summarised.

    A leaf's prompt lists its members by name, a parent's the summaries of its children by id.
    """
    ready = limited(pending_communities(communities).orderBy("level", "id"), limit)
    named = members.groupBy("community_id").agg(F.array_join(F.array_sort(F.collect_list(embed_text(F.col("name"), F.col("entity_type")))), "\n").alias("lines"))
    below = communities.where("parent_id is not null and summary is not null").groupBy(F.col("parent_id").alias("community_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "summary"))), lambda x: F.concat(F.lit("- "), x["summary"])), "\n").alias("below")
    )
    parents = communities.where("parent_id is not null").select(F.col("parent_id").alias("community_id")).distinct().withColumn("is_parent", F.lit(True))
    joined = ready.withColumnRenamed("id", "community_id").join(named, "community_id", "left").join(below, "community_id", "left").join(parents, "community_id", "left")
    body = F.when(F.col("is_parent"), F.coalesce("below", F.lit(""))).otherwise(F.coalesce("lines", F.lit("")))
    return joined.select(F.concat(F.lit("summarize:community:"), F.col("community_id").cast("string")).alias("unit_id"), F.lit("summarize").alias("kind"), F.lit(0).cast("bigint").alias("chunk_id"), "community_id", "store", F.lit(model).alias("model"), F.concat(F.lit("Summarise what joins this group:\n"), body).alias("user_prompt"))


def apply_summarize(communities: DataFrame, replies: DataFrame) -> DataFrame:
    """communities with the trimmed responses of replies (seq, community_id, response); a blank response is a summary, ''."""
    fresh = replies.where("community_id is not null and response is not null").groupBy(F.col("community_id").alias("id")).agg(F.max_by(F.regexp_replace("response", r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), "seq").alias("_s"))
    return communities.join(fresh, "id", "left").withColumn("summary", F.coalesce("_s", "summary")).drop("_s").select(*communities.columns)


def plan_embed(entities: DataFrame, embeddings: DataFrame, limit: int | None = None) -> DataFrame:
    """(entity_id, text) of entities without a vector."""
    return limited(unembedded_entities(entities, embeddings).orderBy("id"), limit).select(F.col("id").alias("entity_id"), embed_text(F.col("name"), F.col("entity_type")).alias("text"))


def pipeline_status(chunks: DataFrame, extractions: DataFrame, entities: DataFrame, embeddings: DataFrame, entity_communities: DataFrame, communities: DataFrame, stores: DataFrame) -> DataFrame:
    """(store, ord, phase, total, done, pending, blocked, ready, blocked_by, guidance): four rows a store."""

    def count(rows: DataFrame, label: str) -> DataFrame:
        return rows.groupBy("store").agg(F.count("*").alias(label))

    base = stores.select(F.col("name").alias("store"))
    for label, rows in (
        ("chunks", chunks), ("todo", pending_chunks(chunks, extractions)), ("entities", entities), ("bare", unembedded_entities(entities, embeddings)),
        ("loose", unclustered_entities(entities, entity_communities)), ("groups", communities), ("written", communities.where("summary is not null")), ("next", pending_communities(communities)),
    ):
        base = base.join(count(rows, label), "store", "left")
    base = base.fillna(0)
    c = F.col
    open_ = c("groups") - c("written")
    phase = lambda ord_, name, total, done, pending, blocked, by, text: F.struct(
        F.lit(ord_).alias("ord"), F.lit(name).alias("phase"), total.alias("total"), done.alias("done"), pending.alias("pending"), blocked.alias("blocked"), (pending > 0).alias("ready"), by.alias("blocked_by"), text.alias("guidance"),
    )
    say = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    n = lambda x: x.cast("string")
    zero = F.lit(0).cast("bigint")
    no_entities = F.when(c("entities") == 0, "extract")
    phases = F.array(
        phase(0, "extract", c("chunks"), c("chunks") - c("todo"), c("todo"), zero, F.lit(None).cast("string"), F.when(c("chunks") == 0, F.lit("no chunks: add documents")).when(c("todo") > 0, say(n(c("todo")), " chunks to extract")).otherwise(F.lit("every chunk is extracted"))),
        phase(1, "embed", c("entities"), c("entities") - c("bare"), c("bare"), zero, no_entities, F.when(c("entities") == 0, F.lit("no entities: extract first")).when(c("bare") > 0, say(n(c("bare")), " entities to embed")).otherwise(F.lit("every entity is embedded"))),
        phase(2, "communities", c("entities"), c("entities") - c("loose"), c("loose"), zero, no_entities, F.when(c("entities") == 0, F.lit("no entities: extract first")).when(c("loose") > 0, say(n(c("loose")), " entities in no community")).otherwise(F.lit("every entity is in a community"))),
        phase(3, "summarize", c("groups"), c("written"), c("next"), open_ - c("next"), F.when(c("groups") == 0, "communities"), F.when(c("groups") == 0, F.lit("no communities: detect them first")).when(c("next") > 0, say(n(c("next")), " communities to summarise")).when(open_ > 0, say(n(open_), " communities wait for their children")).otherwise(F.lit("every community is summarised"))),
    )
    return base.select("store", F.explode(phases).alias("p")).select("store", "p.*")


def next_step(status: DataFrame) -> DataFrame:
    """(store, next): the guidance of the first ready phase."""
    first = status.groupBy("store").agg(F.min_by("guidance", F.when(F.col("ready"), F.col("ord"))).alias("next"))
    return first.select("store", F.coalesce("next", F.lit("nothing is pending")).alias("next"))
