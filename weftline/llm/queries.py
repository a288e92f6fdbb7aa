"""Queries of this package's operators over the shared tables, and the SQL some of them can be checked by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import canonical_values, ivfpq, name_variants, pair_defects, rank_fusion, sentences, size_split, source_mix, token_encode
from weftline.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranking = rank_fusion.median_rank(table(spark, sf_dir, "hits"))
    return rank_fusion.top_of_groups(ranking, table(spark, sf_dir, "search_queries")).select("query_id", "chunk_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_defects.pair_defects(table(spark, sf_dir, "work_units"), table(spark, sf_dir, "replies"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = size_split.split_spans(table(spark, sf_dir, "chunk_spans"), table(spark, sf_dir, "chunker_configs"), with_text=False)
    return size_split.oversized(split)


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = size_split.split_spans(table(spark, sf_dir, "chunk_spans"), table(spark, sf_dir, "chunker_configs"))
    return size_split.pieces_of(split)


def p3_rejoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(span_id, text, fits, overlaps): the pieces without their overlaps are the text, none is too long, each repeats the end of the one before."""
    configs = table(spark, sf_dir, "chunker_configs")
    split = size_split.split_spans(table(spark, sf_dir, "chunk_spans"), configs).dropDuplicates(["span_id"])
    sized = split.join(table(spark, sf_dir, "chunk_spans").select("span_id", "config_id").distinct(), "span_id").join(configs.select("config_id", F.least(F.coalesce("overlap", F.lit(0)), F.col("chunk_size")).alias("overlap")), "config_id")
    text = F.expr("array_join(transform(pieces, p -> substring(p.text, p.core_start - p.start + 1)), '')")
    fits = F.expr("forall(pieces, p -> length(p.text) <= chunk_size)")
    overlaps = F.expr("forall(pieces, p -> p.piece = 0 or (p.core_start - p.start = least(overlap, p.core_start) and pieces[p.piece - 1].end = p.core_start))")
    return sized.select("span_id", F.sha2(text, 256).alias("text"), fits.alias("fits"), overlaps.alias("overlaps"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ivfpq.usable_vectors(table(spark, sf_dir, "chunk_embeddings"), table(spark, sf_dir, "stores"))
    return ivfpq.similar_pairs(ivfpq.neighbours(vectors, ivfpq.IvfPqConfig(k=5, min_cosine=0.9, recall=0.995)), 0.9)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = table(spark, sf_dir, "vocab")
    sources = [("relation", table(spark, sf_dir, "relations"), "id", "relation"), ("entity_type", table(spark, sf_dir, "entities"), "id", "entity_type")]
    return canonical_values.map_values(canonical_values.value_records(sources, vocab), vocab)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    triples = table(spark, sf_dir, "triples")
    names = name_variants.distinct_names([(table(spark, sf_dir, "entities"), "name"), (triples, "head"), (triples, "tail")])
    return name_variants.variant_pairs(name_variants.link_names(names))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_encode.encode_corpus(table(spark, sf_dir, "documents"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.col("shape").isin("prose", "markdown"))
    return sentences.sentence_units(docs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (p1_found, p2_found, p3_found, p3_pieces, p3_rejoin, p5_found, p6_found, p7_found, p8_ids, p9_mix, p9_shares, p10_found)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": """
            WITH items AS (
                SELECT query_id, chunk_id, max(CASE WHEN isnan(rrf) THEN NULL ELSE rrf END) AS rrf,
                       max(CASE WHEN isnan(similarity) THEN NULL ELSE similarity END) AS similarity,
                       max(CASE WHEN isnan(lexical) THEN NULL ELSE lexical END) AS lexical
                FROM hits WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL GROUP BY ALL),
            lanes AS (
                SELECT query_id, chunk_id,
                    CASE WHEN rrf IS NULL THEN n ELSE r1 + (t1 - 1) / 2.0 END AS a,
                    CASE WHEN similarity IS NULL THEN n ELSE r2 + (t2 - 1) / 2.0 END AS b,
                    CASE WHEN lexical IS NULL THEN n ELSE r3 + (t3 - 1) / 2.0 END AS c
                FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n,
                    rank() OVER (PARTITION BY query_id ORDER BY rrf DESC NULLS LAST) AS r1,
                    count(*) OVER (PARTITION BY query_id, rrf) AS t1,
                    rank() OVER (PARTITION BY query_id ORDER BY similarity DESC NULLS LAST) AS r2,
                    count(*) OVER (PARTITION BY query_id, similarity) AS t2,
                    rank() OVER (PARTITION BY query_id ORDER BY lexical DESC NULLS LAST) AS r3,
                    count(*) OVER (PARTITION BY query_id, lexical) AS t3 FROM items)),
            placed AS (
                SELECT query_id, chunk_id, row_number() OVER (
                    PARTITION BY query_id ORDER BY list_sort([a, b, c])[2], (a + b + c) / 3, chunk_id) AS place
                FROM lanes)
            SELECT p.query_id, p.chunk_id FROM placed p
            JOIN (SELECT query_id, max(top_n) AS top_n FROM search_queries GROUP BY 1) s USING (query_id) WHERE place <= top_n""",
        "p3_found": r"""
            SELECT span_id, max(CASE WHEN coalesce(list_max(list_transform(
                regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda r: length(r))), 0) > chunk_size THEN 1 ELSE 0 END)::INT AS forced
            FROM chunk_spans JOIN chunker_configs USING (config_id)
            WHERE length(text) > chunk_size GROUP BY span_id""",
        "p3_rejoin": "SELECT DISTINCT span_id, sha256(text) AS text, true AS fits, true AS overlaps FROM chunk_spans JOIN chunker_configs USING (config_id) WHERE text IS NOT NULL",
        "p5_found": """
            WITH v AS (
                SELECT DISTINCT e.store, e.chunk_id AS id, e.embedding::DOUBLE[] AS x FROM chunk_embeddings e
                JOIN stores s ON e.store = s.name
                WHERE len(e.embedding) = s.dim AND len(list_filter(e.embedding, lambda t: t IS NULL OR isnan(t) OR isinf(t))) = 0
                  AND len(list_filter(e.embedding, lambda t: t <> 0)) > 0),
            near AS (
                SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.x, b.x) AS c,
                       row_number() OVER (PARTITION BY a.store, a.id ORDER BY list_cosine_similarity(a.x, b.x) DESC, b.id) AS k
                FROM v a JOIN v b ON a.store = b.store AND a.id <> b.id)
            SELECT DISTINCT least(a, b) AS chunk_a, greatest(a, b) AS chunk_b FROM near WHERE k <= 5 AND c >= 0.9""",
    }
