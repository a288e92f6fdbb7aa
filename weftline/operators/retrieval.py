"""Vector, lexical and hybrid search."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.session import stage

K1, B, RRF_K = 1.2, 0.75, 60

#: Parts by hash of the term into which a kept index is cut.
TERM_PARTS = 64

#: Gives (key, score) of the vectors most similar to a query vector: anything that can stand in for the exact search.
VectorSource = Callable[[list[float], int], DataFrame]


class DimensionMismatch(ValueError):
    pass


def vector_top_k(vectors: DataFrame, query: list[float], k: int, dim: int | None = None, key: str = "chunk_id") -> DataFrame:
    """(key, score): the k vectors most similar to a query vector; ties to the lesser key.

    With dim, a query or stored vector of another dimension raises. The cosine is
    0 for a zero vector and one of another length; null vectors are left out.
    Scores are products of whole Arrow batches, and each task hands on its k best.
    """
    if dim is not None and len(query) != dim:
        raise DimensionMismatch(f"query has {len(query)} dimensions, the store {dim}")
    k, q = max(0, k), np.asarray(query, dtype=np.float64)
    norm = float(np.sqrt(q @ q))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: pa.Table | None = None
        for batch in batches:
            rows = batch.column("embedding")
            sizes = pc.list_value_length(rows).to_numpy(zero_copy_only=False)
            if dim is not None and (sizes != dim).any():
                raise DimensionMismatch(f"a stored vector lacks {dim} dimensions")
            found = np.zeros(len(sizes))
            fit = np.flatnonzero(sizes == len(q))
            if len(fit) and len(q):
                x = rows.take(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(q))
                norms = np.sqrt((x * x).sum(1)) * norm
                found[fit] = np.divide(x @ q, norms, out=np.zeros(len(x)), where=norms != 0)
            part = pa.table({key: batch.column(key), "score": found})
            best = part if best is None else pa.concat_tables([best, part])
            best = best.take(pc.sort_indices(best, sort_keys=[("score", "descending"), (key, "ascending")])[:k])
        if best is not None:
            yield from best.combine_chunks().to_batches()

    rows = vectors.select(key, F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null")
    scored = rows.mapInArrow(score, f"`{key}` {vectors.schema[key].dataType.simpleString()}, score double")
    return scored.orderBy(F.desc("score"), key).limit(k)


def tokens(text: Column) -> Column:
    """Words between white space in lower case."""
    bare = F.btrim(F.lower(text), F.lit(" \t\n\x0b\f\r"))
    return F.when(F.coalesce(bare, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"\s+"))


class Bm25Index:
    """Term frequencies and lengths of a table of texts.

    Made from texts it reads them once for each query and keeps their lengths and
    the counts of its terms. Saved, it is a table of postings in parts
    by hash of the term, of which a query reads its own terms' parts.
    """

    def __init__(self, docs: DataFrame, key: str = "chunk_id", text: str = "content"):
        self.key, self.saved = key, None
        self.words = docs.select(F.col(key).alias("id"), tokens(F.col(text)).alias("words"))
        self.corpus = self.words.agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("mean_length"))

    @property
    def postings(self) -> DataFrame:
        """(id, term, tf, length) of all terms."""
        if self.saved is not None:
            return self.saved
        rows = self.words.select("id", F.size("words").alias("length"), F.explode_outer("words").alias("term")).where("term is not null")
        return rows.groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))

    @property
    def frequencies(self) -> DataFrame:
        return self.postings.groupBy("term").agg(F.count("*").alias("df"))

    def save(self, path: str) -> Bm25Index:
        """Write the postings under a path and search there from now on."""
        part = lambda c: F.pmod(F.xxhash64(c), F.lit(TERM_PARTS)).cast("int")
        rows = self.postings.withColumn("part", part("term"))
        rows.repartition(TERM_PARTS, "part", F.pmod(F.xxhash64("id"), F.lit(4))).sortWithinPartitions("part", "term").write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")
        self.corpus.withColumn("key", F.lit(self.key)).coalesce(1).write.mode("overwrite").parquet(f"{path}/corpus")
        return self._opened(rows.sparkSession, path)

    def _opened(self, spark: SparkSession, path: str) -> Bm25Index:
        self.saved = spark.read.parquet(f"{path}/postings")
        self.corpus = spark.read.parquet(f"{path}/corpus").select("n", "mean_length")
        return self

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Bm25Index:
        index = cls.__new__(cls)
        index.key, index.words = spark.read.parquet(f"{path}/corpus").first()["key"], None
        return index._opened(spark, path)

    def matching(self, terms: list[str]) -> tuple[DataFrame, DataFrame]:
        """(id, term, tf, length) of the query's terms, and (n, mean_length) of all texts."""
        if self.saved is not None:
            parts = self.saved.sparkSession.createDataFrame([(t,) for t in terms], "term string").select(F.pmod(F.xxhash64("term"), F.lit(TERM_PARTS)).cast("int")).collect()
            return self.saved.where(F.col("part").isin(sorted({p[0] for p in parts})) & F.col("term").isin(terms)).select("id", "term", "tf", "length"), self.corpus
        # one pass over the texts leaves their lengths and the counts of these terms
        tf = lambda t: F.size("words") - F.size(F.array_remove("words", t))
        counted = stage(self.words.select("id", F.size("words").alias("length"), F.array(*[F.struct(F.lit(t).alias("term"), tf(t).alias("tf")) for t in terms]).alias("terms")))
        mine = counted.select("id", "length", F.explode("terms").alias("t")).select("id", "t.term", F.col("t.tf").cast("bigint").alias("tf"), "length").where("tf > 0")
        return mine, counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean_length"))

    def scores(self, terms: list[str]) -> DataFrame:
        """(id, term, score) of the query's terms."""
        mine, corpus = self.matching(terms)
        df = mine.groupBy("term").agg(F.count("*").alias("df"))
        joined = mine.join(F.broadcast(df), "term").crossJoin(F.broadcast(corpus))
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        tf = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
        return joined.select("id", "term", (idf * tf).alias("score"))

    def search(self, query: str, top: int) -> DataFrame:
        """(key, score): the best texts for a query of words, or of AND, OR, NOT and brackets."""
        tree = parse_query(query)
        if tree is None:
            return self.postings.select(F.col("id").alias(self.key), F.lit(0.0).alias("score")).limit(0)
        wanted = sorted(terms_of(tree))
        found = self.scores(wanted).groupBy("id").agg(F.collect_set("term").alias("has"), F.sum("score").alias("all_score"), F.map_from_entries(F.collect_list(F.struct("term", "score"))).alias("by"))
        keep = found.where(matches(tree, F.col("has")))
        positive = sorted(terms_of(tree, negated=False))
        score = sum((F.coalesce(F.element_at("by", F.lit(t)), F.lit(0.0)) for t in positive), F.lit(0.0))
        return keep.select(F.col("id").alias(self.key), score.alias("score")).orderBy(F.desc("score"), self.key).limit(max(0, top))


def has_operators(query: str) -> bool:
    """Whether a query is more than bare words."""
    return any(c in query for c in "():") or any(w in ("AND", "OR", "NOT") for w in query.split())


def parse_query(query: str):
    """A tree of ("term", t), ("and", [..]), ("or", [..]), ("not", x), or None for an empty query.

    Bare words are joined by OR; with operators, words side by side are joined by AND.
    """
    if not has_operators(query):
        words = query.lower().split()
        return ("or", [("term", w) for w in dict.fromkeys(words)]) if words else None
    parts = re.findall(r"[()]|[^\s()]+", query)
    at = 0

    def either():
        nonlocal at
        sides = [every()]
        while at < len(parts) and parts[at] == "OR":
            at += 1
            sides.append(every())
        sides = [s for s in sides if s]
        return None if not sides else sides[0] if len(sides) == 1 else ("or", sides)

    def every():
        nonlocal at
        sides = []
        while at < len(parts) and parts[at] not in (")", "OR"):
            if parts[at] == "AND":
                at += 1
                continue
            sides.append(single())
        sides = [s for s in sides if s]
        return None if not sides else sides[0] if len(sides) == 1 else ("and", sides)

    def single():
        nonlocal at
        word = parts[at]
        at += 1
        if word == "NOT":
            inner = single() if at < len(parts) and parts[at] != ")" else None
            return ("not", inner) if inner else None
        if word == "(":
            inner = either()
            at += at < len(parts)
            return inner
        return ("term", word.rpartition(":")[2].lower())

    found = []
    while at < len(parts):
        if (part := either()) is not None:
            found.append(part)
        if at < len(parts):
            at += 1
    return None if not found else found[0] if len(found) == 1 else ("and", found)


def terms_of(tree, negated: bool = True) -> set[str]:
    kind, rest = tree
    if kind == "term":
        return {rest}
    if kind == "not":
        return terms_of(rest) if negated else set()
    return set().union(*(terms_of(x, negated) for x in rest))


def matches(tree, has: Column) -> Column:
    kind, rest = tree
    if kind == "term":
        return F.array_contains(has, rest)
    if kind == "not":
        return ~matches(rest, has)
    out = matches(rest[0], has)
    for x in rest[1:]:
        out = (out & matches(x, has)) if kind == "and" else (out | matches(x, has))
    return out


def lane_ranks(lane: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key, rank) of a short lane (key, score): 1-based places."""
    return lane.select(key, F.row_number().over(Window.orderBy(F.desc("score"), key)).alias("rank"))


def reciprocal_rank_fusion(lanes: dict[str, DataFrame], key: str = "chunk_id", k: int = RRF_K) -> DataFrame:
    """(key, rrf, <lane>...): the sum of 1 / (k + rank) over lanes and each lane's own score. Lanes are short top lists."""
    out = None
    for name, lane in lanes.items():
        ranked = lane_ranks(lane, key).join(lane, key).select(key, (1.0 / (k + F.col("rank"))).alias("part"), *[(F.col("score") if n == name else F.lit(None).cast("double")).alias(n) for n in lanes])
        out = ranked if out is None else out.unionByName(ranked)
    return out.groupBy(key).agg(F.sum("part").alias("rrf"), *[F.max(n).alias(n) for n in lanes])


def hybrid_recall(vectors: DataFrame | VectorSource, index: Bm25Index, chunks: DataFrame, query_vector: list[float], query: str, top: int, dim: int | None = None) -> DataFrame:
    """(chunk_id, content, source, rrf, similarity, lexical): the best chunks by both lanes, each lane's score if it has one.

    vectors: (chunk_id, embedding), or a function that gives the candidates of a query vector.
    """
    pool = max(top, 5) * 4
    near = vector_top_k(vectors, query_vector, pool, dim) if isinstance(vectors, DataFrame) else vectors(query_vector, pool)
    lanes = {"similarity": near, "lexical": index.search(query, pool)}
    fused = reciprocal_rank_fusion(lanes).orderBy(F.desc("rrf"), "chunk_id").limit(top)
    return chunks.select(F.col("id").alias("chunk_id"), "content", "source").join(F.broadcast(fused), "chunk_id").orderBy(F.desc("rrf"), "chunk_id")


def global_contexts(communities: DataFrame, members: DataFrame, relations: DataFrame, chunk_entities: DataFrame, chunks: DataFrame, min_entities: int = 2, max_communities: int | None = None, sample_chars: int = 500) -> DataFrame:
    """(store, level, community_id, summary, names, relation_texts, samples) of communities with at least min_entities members.

    members: (community_id, id, name). Relations with both ends inside. Samples:
    the first chunk of the first members by name, three at most, cut by characters.
    """
    sizes = members.groupBy("community_id").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("name")).alias("names")).where(F.col("size") >= min_entities)
    kept = communities.join(sizes, communities.id == sizes.community_id)
    if max_communities is not None and max_communities >= 0:
        kept = kept.orderBy("level", "id").limit(max_communities)
    ids = kept.select("community_id")
    inside = members.join(ids, "community_id", "left_semi")
    heads = inside.select("community_id", F.col("id").alias("head_id"), F.col("name").alias("head"))
    tails = inside.select("community_id", F.col("id").alias("tail_id"), F.col("name").alias("tail"))
    texts = relations.join(heads, "head_id").join(tails, ["tail_id", "community_id"]).select("community_id", F.concat(F.col("head"), F.lit(" -["), F.col("relation"), F.lit("]-> "), F.col("tail")).alias("text"))
    texts = texts.groupBy("community_id").agg(F.array_sort(F.collect_set("text")).alias("relation_texts"))
    first = chunk_entities.groupBy("entity_id").agg(F.min("chunk_id").alias("chunk_id"))
    order = Window.partitionBy("community_id").orderBy("name", "entity_id")
    linked = inside.select("community_id", F.col("id").alias("entity_id"), "name").join(first, "entity_id")
    picked = linked.withColumn("k", F.row_number().over(order)).where("k <= 3")
    cut = F.when(F.length("content") > sample_chars, F.concat(F.substring("content", 1, sample_chars), F.lit("..."))).otherwise(F.col("content"))
    samples = picked.join(chunks.select(F.col("id").alias("chunk_id"), "content"), "chunk_id").select("community_id", "k", cut.alias("sample"))
    samples = samples.groupBy("community_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "sample"))), lambda x: x["sample"]).alias("samples"))
    none = F.array().cast("array<string>")
    out = kept.join(texts, "community_id", "left").join(samples, "community_id", "left")
    return out.select("store", "level", "community_id", "summary", "names", F.coalesce("relation_texts", none).alias("relation_texts"), F.coalesce("samples", none).alias("samples"))
