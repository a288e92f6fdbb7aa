"""One store of a catalog with all that can be done to it."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.spans import ChunkError, code_span_documents
from weftline.functions.text import EXTENSIONS, LANGUAGE_NAMES, fold_key, language_of_name, language_of_path, source_label
from weftline.functions.vocabulary import standard_synonyms, standard_types
from weftline.operators import aggregates, formatting, graph, joins, leiden, listing, pipeline, resolve, retrieval, similarity
from weftline.operators.numbering import with_ids
from weftline.operators.strategies import Strategy
from weftline.session import stage
from weftline.sources.catalog import Catalog, StoreNotFound, upsert
from weftline.sources.ingest import ChatClient, Embedder, HashEmbedder, ask_models, document_chunks, embed_column, extract_with_reflection
from weftline.sources.jsonl import export_lines


class Store:
    """A named store. Every call works on the newest commit; a call's writes become visible together."""

    def __init__(self, catalog: Catalog, name: str = "default", embedder: Embedder | None = None, create: bool = True, vector_source: retrieval.VectorSource | None = None):
        self.catalog, self.name, self.embedder, self.vector_source = catalog, name, embedder or HashEmbedder(), vector_source
        self._index: tuple[str | None, retrieval.Bm25Index] | None = None
        try:
            self.dim = catalog.get_store(name)["dim"]
        except StoreNotFound:
            if not create:
                raise
            catalog.create_store(name, self.embedder.dim)
            self.dim = self.embedder.dim
        if catalog.version("relation_synonyms") is None:
            catalog.write("relation_synonyms", standard_synonyms(catalog.spark))
            catalog.write("entity_type_synonyms", standard_types(catalog.spark))

    def _own(self, table: str) -> DataFrame:
        return self.catalog.read(table).where(F.col("store") == self.name)

    # taking in

    def note(self, text: str, source: str | None = None) -> DataFrame:
        """Add one text as a chunk with its vector."""
        return self.add_chunks(self.catalog.spark.createDataFrame([(text, source, 1)], "content string, source string, seq long"))

    def add_chunks(self, rows: DataFrame) -> DataFrame:
        """Add chunks (content, source?, metadata?, seq) and their vectors."""
        fresh = stage(self.catalog.fresh_chunks(self.name, rows).withColumn("created_at", F.current_timestamp()))
        made = stage(embed_column(fresh.select(F.col("id").alias("chunk_id"), "content"), "chunk_id", "content", self.embedder))
        self.catalog.check_dims("chunk_id", made, self.dim)
        self.catalog.commit(append={"chunks": fresh, "chunk_embeddings": made})
        return fresh

    def add_documents(self, docs: DataFrame, size: int = 2000, slack: int = 200) -> DataFrame:
        """Split documents (doc_id, text, source) and add their chunks in order."""
        return self.add_chunks(document_chunks(docs, size, slack).withColumn("seq", F.struct("doc_id", "index")))

    def add_code(self, docs: DataFrame, language: str | None = None, max_bytes: int = 2000) -> DataFrame:
        """Split sources (doc_id, text, source, a path) by their items and add the chunks.

        The language is the one named, else that of the path's ending; a source
        with neither fails. One that cannot be parsed is split between lines.
        """
        known = F.coalesce(language_of_name(F.lit(language).cast("string")), language_of_path(F.col("source")))
        odd = docs.where(known.isNull()).limit(1).collect()
        if odd:
            raise ChunkError(f"no language is known for {odd[0]['source']}")
        ending = {name: end for end, name in reversed(EXTENSIONS.items())}
        path = F.col("source") if language is None else F.lit(f"x.{ending[LANGUAGE_NAMES[language.lower()]]}")
        found = code_span_documents(docs.select("doc_id", "text", path.alias("origin_path")), max_bytes=max_bytes)
        totals = found.groupBy("doc_id").agg(F.count("*").alias("total"))
        rows = found.join(totals, "doc_id").join(docs.select("doc_id", "source"), "doc_id")
        return self.add_chunks(rows.select(F.struct("doc_id", "index").alias("seq"), F.col("text").alias("content"), source_label(F.col("source"), F.col("index"), F.col("total")).alias("source")))

    def backfill_embeddings(self) -> None:
        """Embed all chunks of the store anew."""
        made = embed_column(self._own("chunks").select(F.col("id").alias("chunk_id"), "content"), "chunk_id", "content", self.embedder)
        self.catalog.set_embeddings("chunk_embeddings", "chunk_id", stage(made), self.dim)

    # looking at

    def stats(self) -> dict:
        c = self.catalog
        base = aggregates.store_stats(c.read("stores"), c.read("chunks"), c.read("entities"), c.read("relations"))
        full = aggregates.full_stats(base, c.read("communities"), joins.pending_chunks(c.read("chunks"), c.read("extractions")), joins.pending_communities(c.read("communities")))
        return full.where(F.col("name") == self.name).first().asDict()

    def status(self) -> DataFrame:
        c = self.catalog
        rows = pipeline.pipeline_status(c.read("chunks"), c.read("extractions"), c.read("entities"), c.read("entity_embeddings"), c.read("entity_communities"), c.read("communities"), c.read("stores"))
        return rows.where(F.col("store") == self.name).orderBy("ord")

    def log(self, limit: int = 10) -> DataFrame:
        return listing.log_view(self.catalog.read("chunks"), self.name, limit)

    def entities(self, limit: int = 100) -> DataFrame:
        return listing.entity_page(self.catalog.read("entities"), self.name, limit)

    def relations(self, entity: str) -> DataFrame:
        """Relations of an entity by its exact name, seen from it."""
        found = listing.entity_by_name(self.catalog.read("entities"), self.name, entity)
        return joins.relations_view(self._own("relations"), self.catalog.read("entities")).where(F.col("entity_id") == found["id"])

    def triples(self) -> DataFrame:
        return joins.triples_view(self._own("relations"), self.catalog.read("entities"))

    def communities(self) -> DataFrame:
        """Communities with their size and the names of their members."""
        members = joins.members_of_communities(self._own("entities"), self.catalog.read("entity_communities"))
        return self._own("communities").join(aggregates.community_members(members), F.col("id") == F.col("community_id"), "left").drop("community_id").orderBy("level", "id")

    def export(self) -> DataFrame:
        c = self.catalog
        names = {"store": "stores", "chunk": "chunks", "entity": "entities", "relation": "relations", "community": "communities"}
        return export_lines({k: c.read(t) for k, t in names.items()}, self.name)

    # searching

    def _lexical(self) -> retrieval.Bm25Index:
        """The lexical index of the store's chunks; it is kept beside the tables, under what the chunks consist of."""
        version = self.catalog.version("chunks") or ""
        if self._index is None or self._index[0] != version:
            key = hashlib.sha256(f"{self.name}\n{version}".encode()).hexdigest()
            path = f"{self.catalog.root}/_lexical/{key}"
            if self.catalog.exists(f"{path}/corpus/_SUCCESS"):
                index = retrieval.Bm25Index.load(self.catalog.spark, path)
            else:
                index = retrieval.Bm25Index(self._own("chunks").select(F.col("id").alias("chunk_id"), "content")).save(path)
            self._index = (version, index)
        return self._index[1]

    def search(self, query: str, top: int = 10, expand: int = 0) -> DataFrame:
        """Hybrid recall; with expand, also chunks that share entities (1) or are reached over relations (more)."""
        vectors = self.vector_source or joins.chunk_vectors(self._own("chunks"), self.catalog.read("chunk_embeddings"))
        hits = retrieval.hybrid_recall(vectors, self._lexical(), self._own("chunks"), self.embedder.embed([query])[0], query, top, self.dim)
        if not expand:
            return hits
        seeds = stage(hits.select("chunk_id", F.col("rrf").alias("score")))
        links = self.catalog.read("chunk_entities")
        more = graph.expand_comention(links, seeds) if expand == 1 else graph.expand_breadth_first(self._own("relations"), links, seeds, expand)["chunks"].where("from_graph").select("chunk_id")
        grown = self._own("chunks").join(more, F.col("id") == F.col("chunk_id")).select("chunk_id", "content", "source")
        return hits.unionByName(grown, allowMissingColumns=True)

    def search_text(self, query: str, top: int = 10, expand: int = 0) -> str:
        """The hits of a search as text, best first."""
        rows = formatting.format_hits(self.search(query, top, expand)).orderBy("place").collect()
        return "## Search results\n\n" + "\n".join(r["text"] for r in rows)

    def query_global(self, min_entities: int = 2, max_communities: int | None = None) -> DataFrame:
        members = joins.members_of_communities(self._own("entities"), self.catalog.read("entity_communities")).select("community_id", "id", "name")
        return retrieval.global_contexts(self._own("communities"), members, self._own("relations"), self.catalog.read("chunk_entities"), self._own("chunks"), min_entities, max_communities)

    # working

    def plan(self, phase: str, model: str = "model", limit: int | None = None, strategy: Strategy | None = None) -> DataFrame:
        """Work units of a phase: extract, summarize or embed. Extraction is asked for in the strategy's form, or that which suits the model."""
        c = self.catalog
        if phase == "extract":
            return pipeline.plan_extract(self._own("chunks"), c.read("extractions"), model, limit, strategy)
        if phase == "summarize":
            members = joins.members_of_communities(self._own("entities"), c.read("entity_communities")).select("community_id", "name", "entity_type")
            return pipeline.plan_summarize(self._own("communities"), members, model, limit)
        if phase == "embed":
            return pipeline.plan_embed(self._own("entities"), c.read("entity_embeddings"), limit)
        raise ValueError(f"unknown phase {phase}")

    def apply(self, phase: str, replies: DataFrame, strategy: Strategy | str | None = None) -> int:
        """Apply replies: extract (chunk_id, model, response, received_at), summarize (community_id, response, received_at), embed (entity_id, embedding).

        Returns how many relations came of them. Chunks that are done are left as they are.
        """
        from weftline.streaming.apply import apply_batch, apply_summary_batch

        if phase == "extract":
            return apply_batch(self.catalog, replies, strategy=strategy)
        elif phase == "summarize":
            apply_summary_batch(self.catalog, replies, 0)
        elif phase == "embed":
            self.catalog.set_embeddings("entity_embeddings", "entity_id", replies, self.dim)
        else:
            raise ValueError(f"unknown phase {phase}")
        return 0

    def extract_all(self, client: ChatClient, model: str = "model", rounds: int = 0, limit: int | None = None) -> int:
        """Ask a model about every chunk that is not extracted yet, with up to `rounds` reflections each, and apply its replies; returns how many relations came of them.

        Chunks about which the model fails stay to be done.
        """
        units = stage(self.plan("extract", model, limit))
        replies = extract_with_reflection(units, client, rounds) if rounds else ask_models(units, client)
        return self.apply("extract", stage(replies.select("chunk_id", "model", "response").withColumn("received_at", F.current_timestamp())), "model")

    def summarize_all(self, client: ChatClient, model: str = "model") -> int:
        """Ask a model for every summary, from the leaves up; returns how many levels that took."""
        levels = 0
        while not (units := stage(self.plan("summarize", model))).isEmpty():
            replies = stage(ask_models(units, client).select("community_id", "response").withColumn("received_at", F.current_timestamp()))
            if replies.isEmpty():
                break
            self.apply("summarize", replies)
            levels += 1
        return levels

    def embed_entities(self, limit: int | None = None) -> int:
        """Embed the entities that lack a vector; returns how many."""
        units = self.plan("embed", limit=limit).select("entity_id", "text")
        made = stage(embed_column(units, "entity_id", "text", self.embedder))
        self.apply("embed", made)
        return made.count()

    def detect_communities(self, hierarchical: bool = False, clear: bool = True) -> None:
        """Cluster the store's entities and keep the communities; clear drops earlier ones."""
        since = self.catalog.state()[0]
        nodes = self._own("entities").select("store", F.col("id").alias("node"))
        edges = stage(graph.fold_edges(self._own("relations")))
        found = leiden.detect_hierarchy(edges, nodes) if hierarchical else leiden.detect(edges, nodes).select("store", F.lit(0).alias("level"), "community", F.lit(None).cast("bigint").alias("parent"), "node")
        found = stage(found)
        quality = graph.modularity(edges, found.where("level = 0").select("node", "community")).select("store", F.col("q").alias("modularity"))
        old = self.catalog.read("communities")
        kept = old.where(F.col("store") != self.name) if clear else old
        rows = found.select("store", "level", "community", "parent").distinct().withColumn("seq", F.struct("level", "community"))
        made = stage(with_ids(rows, old, "seq"))
        parents = made.select((F.col("level") + 1).alias("level"), F.col("community").alias("parent"), F.col("id").alias("parent_id"))
        fresh = made.join(parents, ["level", "parent"], "left").join(quality, "store", "left")
        links = found.join(made.select("level", "community", F.col("id").alias("community_id")), ["level", "community"]).select(F.col("node").alias("entity_id"), "community_id")
        gone = old.where(F.col("store") == self.name).select(F.col("id").alias("community_id")) if clear else old.limit(0).select(F.col("id").alias("community_id"))
        rows = fresh.select("id", "store", "level", "parent_id", F.lit(None).cast("string").alias("summary"), "modularity", F.current_timestamp().alias("created_at"))
        joined = self.catalog.read("entity_communities").join(gone, "community_id", "left_anti").select("entity_id", "community_id").unionByName(links)
        self.catalog.commit(replace={"entity_communities": joined, "communities": kept.unionByName(rows)}, since=since)

    def preview_communities(self, **options) -> DataFrame:
        """(community, size, ids, names, types) as they would be found now; nothing is kept."""
        nodes = self._own("entities").select("store", F.col("id").alias("node"))
        found = leiden.detect(graph.fold_edges(self._own("relations")), nodes, **options)
        named = found.join(self._own("entities").select(F.col("id").alias("node"), "name", "entity_type"), "node")
        sorted_ = F.array_sort(F.collect_list(F.struct(F.col("node").alias("id"), "name", F.col("entity_type").alias("type"))))
        groups = named.groupBy("community").agg(F.count("*").alias("size"), sorted_.alias("m"))
        return groups.select("community", "size", *[F.col(f"m.{a}").alias(b) for a, b in (("id", "ids"), ("name", "names"), ("type", "types"))]).orderBy(F.desc("size"), "community")

    def community(self, id_: int) -> dict:
        """One community: its record, its children's ids and its members; raises NotFound."""
        record = listing._one(self._own("communities").where(F.col("id") == id_), id_)
        one = self.catalog.spark.createDataFrame([(id_,)], "id long")
        children = listing.child_communities(self._own("communities"), one).select("id").orderBy("id").collect()
        members = joins.members_of_communities(self._own("entities"), self.catalog.read("entity_communities").where(F.col("community_id") == id_)).orderBy("id").collect()
        return record | {"children": [r["id"] for r in children], "entity_count": len(members), "entities": [{"id": r["id"], "name": r["name"], "type": r["entity_type"]} for r in members]}

    def community_contexts(self) -> DataFrame:
        """(community_id, text) to summarise each community by: its members with their relations inside it."""
        members = joins.members_of_communities(self._own("entities"), self.catalog.read("entity_communities"))
        return formatting.community_contexts(members, self._own("relations"))

    def update_summary(self, community: int, summary: str) -> None:
        rows = self.catalog.read("communities")
        self.catalog.write("communities", rows.withColumn("summary", F.when(F.col("id") == community, F.lit(summary)).otherwise(F.col("summary"))))

    # entities

    def find_merge_candidates(self, threshold: float = 0.85) -> DataFrame:
        vectors = joins.entity_vectors(self._own("entities"), self.catalog.read("entity_embeddings")).select("store", F.col("entity_id").alias("id"), "embedding")
        return similarity.merge_candidates(vectors, threshold, self._own("entities").select("id", "name")).orderBy(F.desc("score"), "a", "b")

    def merge(self, target: int, source: int) -> None:
        since = self.catalog.state()[0]
        resolve.check_merge(self._own("entities"), target, source)
        names = ("entities", "relations", "chunk_entities", "entity_communities", "entity_embeddings", "entity_merges")
        tables = {t: self.catalog.read(t) for t in names}
        merges = self.catalog.spark.createDataFrame([(target, source)], "target long, source long")
        self.catalog.commit(replace=resolve.merge_entities(tables, merges), since=since)

    def refresh_canonical(self) -> int:
        """Look canonical relations up again in all stores; returns how many rows have one."""
        rows = stage(joins.refresh_canonical(self.catalog.read("relations"), self.catalog.read("relation_synonyms")))
        self.catalog.write("relations", rows.drop("refreshed"))
        return rows.where("refreshed").count()

    def add_synonym(self, raw: str, canonical: str, types: bool = False) -> None:
        table = "entity_type_synonyms" if types else "relation_synonyms"
        new = self.catalog.spark.createDataFrame([(1, raw, canonical)], "seq long, raw string, canonical string")
        self.catalog.write(table, resolve.upsert_synonyms(self.catalog.read(table), new, lower=types))

    def add_entities(self, rows: DataFrame) -> None:
        """Add entities (seq, name, entity_type, properties); known names keep their id and spelling."""
        old = self._own("entities")
        found = resolve.resolve_entities(rows.withColumn("store", F.lit(self.name)))
        known = old.select(fold_key(F.col("name")).alias("key"), F.col("id").alias("known_id"), F.col("name").alias("known_name"), F.col("entity_type").alias("_t"), F.col("properties").alias("_p"))
        joined = stage(found.join(known, "key", "left"))
        same = joined.where("known_id is not null").select(F.col("known_id").alias("id"), "store", F.col("known_name").alias("name"), F.coalesce("entity_type", "_t").alias("entity_type"), F.coalesce("properties", "_p").alias("properties"))
        fresh = with_ids(joined.where("known_id is null").select("store", "name", "entity_type", "properties", F.col("id").alias("seq")), self.catalog.read("entities"), "seq")
        self.catalog.write("entities", upsert(self.catalog.read("entities"), same.unionByName(fresh.select("id", "store", "name", "entity_type", "properties")), ["id"]))
