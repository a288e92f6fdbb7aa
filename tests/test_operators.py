"""Core operators on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import parsing, vectors
from weftline.functions.hashing import fingerprint_text
from weftline.functions.text import fold_key, looks_like_markdown
from weftline.operators import aggregates, capsules, graph, hierarchy, joins, leiden, listing, numbering, pipeline, resolve, retrieval, similarity
from weftline.operators.components import connected_components
from weftline.schema import migrate
from weftline.sources import ingest
from weftline.sources.catalog import Catalog, ConcurrentWrite, DimensionMismatch, StoreExists, StoreNotFound
from weftline.sources.jsonl import export_lines, read_replies
from weftline.streaming.apply import apply_batch, start_apply


def brute_hierarchy(rows):
    parent = {}
    for i, p in rows:
        if i is not None:
            key = (p is not None, p or 0)
            parent[i] = min(parent.get(i, key), key)
    parent = {i: (p if has else None) for i, (has, p) in parent.items()}
    out = {}
    for i in parent:
        seen, at = [i], i
        while True:
            p = parent[at]
            if p is None or p not in parent:
                out[i] = ("root" if parent[i] is None else "missing_parent" if parent[i] not in parent else "child", seen[::-1])
                break
            if p in seen:
                out[i] = ("on_cycle" if p == i else "below_cycle", None)
                break
            seen.append(p)
            at = p
    return out


@pytest.mark.parametrize("base", [200_000, 10])
def test_hierarchy(spark, base):
    rng = random.Random(base)
    n = 120
    rows = [(i, None if rng.random() < 0.03 else rng.randint(max(1, i - 3), i - 1) if i > 1 and rng.random() < 0.9 else rng.choice([i, n + 9, rng.randint(1, n)])) for i in range(1, n + 1)]
    rows += [(200 + i, 5) for i in range(40)] + [(300, 301), (301, 302), (302, 300), (303, 302), (None, 1)] + rows[:9]
    table = spark.createDataFrame(rows, "id long, parent_id long").withColumn("path", F.lit("clash"))
    resolved = hierarchy.resolve_hierarchy(table, base_nodes=base, hot_children=10)
    got = {r.id: (r.status, r.path) for r in resolved.collect()}
    assert got == brute_hierarchy(rows)
    lean = hierarchy.resolve_hierarchy(table, base_nodes=base, hot_children=10, paths=False)
    assert {(r.id, r.status, r.root, r.depth) for r in lean.collect()} == {(i, s, p and p[0], p and len(p) - 1) for i, (s, p) in got.items()} and "path" not in lean.columns
    assert hierarchy.resolve_hierarchy(table.limit(0)).count() == 0
    if base > 10:
        want = {(a, i, len(p) - 1 - k) for i, (_, p) in got.items() if p for k, a in enumerate(p[:-1])}
        assert {tuple(r) for r in hierarchy.descendants(resolved).collect()} == want


def test_long_chains_and_cycles_over_fragments(spark):
    far = 1 << 60  # ids that a float does not hold
    rows = [(far + i, far + i - 1 if i else None) for i in range(1200)] + [(10_000 + i, 10_000 + (i + 1) % 400) for i in range(400)] + [(20_000 + i, 10_003 if i % 9 == 0 else 20_000 + i - 1) for i in range(90)]
    found = hierarchy.resolve_hierarchy(spark.createDataFrame(rows, "id long, parent_id long"), base_nodes=200, paths=False)
    got = {r.id: (r.status, r.root, r.depth) for r in found.collect()}
    assert all(got[far + i] == ("child" if i else "root", far, i) for i in range(1200))
    assert all(got[10_000 + i] == ("on_cycle", None, None) for i in range(400)) and all(got[20_000 + i] == ("below_cycle", None, None) for i in range(90))


@pytest.mark.parametrize("small", [200_000, 0])
def test_components(spark, small):
    rng = random.Random(1)
    pairs = [(rng.randint(1, 60), rng.randint(1, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(25)] + [(None, 1), (7, 7)]
    least = {}

    def top(x):
        while least.setdefault(x, x) != x:
            x = least[x]
        return x

    for a, b in pairs:
        if a and b and a != b:
            x, y = top(a), top(b)
            least[max(x, y)] = min(x, y)
    pairs += [(1000, 1001 + i) for i in range(30)]
    least |= {1000 + i: 1000 for i in range(31)}
    found = connected_components(spark.createDataFrame(pairs, "src long, dst long"), small_edges=small, hot_rows=8)
    assert {r.node: r.component for r in found.collect()} == {n: top(n) for n in least}


def test_catalog(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path))
    cat.create_store("a", 3)
    cat.create_store("b", 2)
    with pytest.raises(StoreExists):
        cat.create_store("a", 3)
    with pytest.raises(StoreNotFound):
        cat.get_store("none")
    assert [r.name for r in cat.list_stores().collect()] == ["a", "b"]
    fresh = cat.add_chunks("a", spark.createDataFrame([("one", 1), ("two", 2)], "content string, seq long"))
    assert sorted((r.content, r.id) for r in fresh.collect()) == [("one", 1), ("two", 2)]
    cat.add_chunks("b", spark.createDataFrame([("three", 1)], "content string, seq long"))
    assert cat.read("chunks").agg(F.max("id")).first()[0] == 3
    cat.set_embeddings("chunk_embeddings", "chunk_id", spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "chunk_id long, embedding array<float>"), 3)
    with pytest.raises(DimensionMismatch):
        cat.set_embeddings("chunk_embeddings", "chunk_id", spark.createDataFrame([(1, [1.0])], "chunk_id long, embedding array<float>"), 3)
    cat.delete_store("a")
    assert [r.content for r in cat.read("chunks").collect()] == ["three"] and cat.read("chunk_embeddings").count() == 0
    assert set(cat.info()["tables"]) >= {"stores", "capsules"}
    assert migrate(spark.range(1), "communities").columns[3] == "parent_id"


def test_ids_are_dense_when_written(spark, tmp_path):
    wide = spark.range(2_000_000, numPartitions=16).select((F.col("id") * 7919 % 2_000_003).alias("seq"), F.sha2(F.col("id").cast("string"), 256).alias("content"))
    numbering.with_ids(wide, spark.createDataFrame([(5,)], "id long"), "seq").write.parquet(str(tmp_path / "w"))
    found = spark.read.parquet(str(tmp_path / "w"))
    assert found.agg(F.min("id"), F.max("id"), F.count_distinct("id")).first()[:] == (6, 2_000_005, 2_000_000)
    assert [r.seq for r in found.where("id < 60000").orderBy("id").select("seq").collect()] == [r.seq for r in wide.orderBy("seq").limit(59994).select("seq").collect()]
    assert numbering.numbered(wide.limit(0), "seq").count() == 0
    ties = numbering.numbered(spark.createDataFrame([(1,)] * 5 + [(None,)], "seq int"), "seq")
    assert sorted(r.id for r in ties.collect()) == [1, 2, 3, 4, 5, 6]


def test_commits(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path))
    row = lambda n: spark.createDataFrame([(n, 2)], "name string, dim int")
    for n in "abc":
        cat.append("stores", row(n))
    assert cat.info()["tables"]["stores"] == 3 and cat.state()[0] == 3
    # a writer that dies before its commit leaves the state as it was
    claim = cat._claim
    cat._claim = lambda number, tables: (_ for _ in ()).throw(OSError("gone"))
    with pytest.raises(OSError):
        cat.write("stores", row("x"))
    cat._claim = claim
    assert {r.name for r in cat.read("stores").collect()} == {"a", "b", "c"}
    # a commit between reading and replacing is noticed, appending goes on after it
    since = cat.state()[0]
    other = Catalog(spark, str(tmp_path))
    other.append("stores", row("d"))
    with pytest.raises(ConcurrentWrite):
        cat.commit(replace={"stores": row("y")}, since=since)
    assert not cat._claim(4, {}) and cat.state()[0] == 4
    cat._claim = lambda number, tables: (setattr(cat, "_claim", claim), other.append("stores", row("e")), claim(number, tables))[2]
    cat.append("stores", row("f"))
    assert {r.name for r in cat.read("stores").collect()} == set("abcdef")
    cat.write("stores", row("z"))
    assert cat.vacuum(1) == 8 and [r.name for r in cat.read("stores").collect()] == ["z"] and cat.vacuum(1) == 0


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, [0.9, 0.1])], "chunk_id long, embedding array<float>")
    assert [r.chunk_id for r in retrieval.vector_top_k(rows, [1.0, 0.0], 3).collect()] == [1, 2, 5]
    assert retrieval.vector_top_k(rows, [1.0, 0.0], 0).count() == 0
    assert {r.chunk_id: r.score for r in retrieval.vector_top_k(rows, [1.0, 0.0], 9).collect()}[4] == 0.0
    with pytest.raises(retrieval.DimensionMismatch):
        retrieval.vector_top_k(rows, [1.0], 3, dim=2)
    back = rows.select(vectors.from_blob(vectors.to_blob("embedding")).alias("v")).first().v
    assert back == [1.0, 0.0]
    pooled = vectors.mean_pool(rows.withColumn("k", F.lit(1)), "k", "embedding").first().embedding
    assert abs(sum(x * x for x in pooled) - 1) < 1e-9
    vectors.register(spark)
    row = spark.sql("SELECT cosine(array(1D, 0D), array(1D, 1D)) AS c, cosine(array(0D), array(1D)) AS z, fold_key('  ÄB ') AS k, fingerprint('') AS f").first()
    assert abs(row.c - 0.5**0.5) < 1e-9 and row.z == 0.0 and row.k == "Äb" and row.f == "xxh3:2d06800538d394c2"


def test_similar_pairs_are_exact(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    base = rng.normal(size=(60, 8))
    rows = [("s", i, [float(x) for x in base[i % 40] + 0.2 * rng.normal(size=8)]) for i in range(120)] + [("s", 500 + i, [1.0] * 8) for i in range(5)] + [("t", 900, [1.0] * 8)]
    table = spark.createDataFrame(rows, "store string, id long, embedding array<float>")
    pairs, members = similarity.similar_pairs(table, 0.8)
    got = {(r.a, r.b) for r in pairs.collect()}
    unit = {i: np.float32(v).astype(float) / np.linalg.norm(np.float32(v).astype(float)) for s, i, v in rows if s == "s" and not 500 < i < 505}
    want = {(a, b) for a in unit for b in unit if a < b and unit[a] @ unit[b] >= 0.8}
    assert got == want and {r.id for r in members.where("rep = 500").collect()} == {500, 501, 502, 503, 504}


def test_merge_candidates_hold_all_pairs_of_copies(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 4))
    rows = [("s", i, [float(x) for x in base[i % 12]]) for i in range(30)] + [("s", 100 + i, [0.0] * 4) for i in range(3)] + [("t", 200 + i, [1.0] * 4) for i in range(12)] + [("t", 300, [1.0, 1.0, 1.0, 0.9])]
    got = [tuple(r) for r in similarity.merge_candidates(spark.createDataFrame(rows, "store string, id long, embedding array<float>"), 0.5).select("store", "a", "b").collect()]
    unit = {(s, i): np.float32(v).astype(float) / (np.linalg.norm(np.float32(v).astype(float)) or 1) for s, i, v in rows}
    want = {(s, a, b) for s, a in unit for t, b in unit if s == t and a < b and unit[s, a] @ unit[s, b] >= 0.5}
    assert len(got) == len(set(got)) and set(got) == want and len([g for g in got if g[0] == "t"]) == 13 * 12 // 2


def test_merge_candidates_are_not_sent_once_copies_are_listed(spark, monkeypatch):
    monkeypatch.setattr(similarity, "PART", 8)
    groups = {"s": (range(0, 40), [1.0, 0.0]), "t": (range(100, 103), [1.0, 0.0]), "u": (range(200, 205), [0.0, 0.0])}
    rows = [("s", i, [1.0, 0.1]) for i in range(50, 53)] + [(s, i, v) for s, (ids, v) in groups.items() for i in ids]
    names = spark.createDataFrame([(i, f"n{i}") for s, i, v in rows if i != 7], "id long, name string")
    found = similarity.merge_candidates(spark.createDataFrame(rows, "store string, id long, embedding array<float>"), 0.85, names)
    got = [tuple(r) for r in found.select("store", "a", "b", "name_a", "name_b").collect()]
    name = lambda i: None if i == 7 else f"n{i}"
    want = {(s, a, b, name(a), name(b)) for s, a, v in rows for t, b, w in rows if s == t != "u" and a < b}
    assert len(got) == len(set(got)) and set(got) == want
    # what comes after the rows of single pairs neither joins nor shuffles them
    made = found._jdf.queryExecution().executedPlan().toString().split("Generate")[0]
    assert "Join" not in made and "Exchange" not in made and "Sort" not in made


def test_bm25(spark, tmp_path):
    docs = spark.createDataFrame([(1, "rust rust rust"), (2, "rust and safe-push"), (3, "other words here")], "chunk_id long, content string")
    index = retrieval.Bm25Index(docs)
    kept = retrieval.Bm25Index.load(spark, str(tmp_path)) if retrieval.Bm25Index(docs).save(str(tmp_path)) else None
    for query in ("rust", "safe-push other", "(rust OR other) NOT safe-push", "none", ""):
        assert [tuple(r) for r in kept.search(query, 5).collect()] == [tuple(r) for r in index.search(query, 5).collect()]
    assert {(r.term, r.df) for r in kept.frequencies.collect()} >= {("rust", 2), ("words", 1)}
    source = lambda vector, k: spark.createDataFrame([(2, 0.5)], "chunk_id long, score double")
    mixed = retrieval.hybrid_recall(source, kept, docs.selectExpr("chunk_id as id", "content", "'s' as source"), [1.0], "other", 5).collect()
    assert {(r.chunk_id, r.similarity is None, r.lexical is None) for r in mixed} == {(2, False, True), (3, True, False)}
    assert [r.chunk_id for r in index.search("rust", 5).collect()] == [1, 2]
    assert [r.chunk_id for r in index.search("safe-push other", 5).collect()] == [3, 2] or {r.chunk_id for r in index.search("safe-push other", 5).collect()} == {2, 3}
    assert [r.chunk_id for r in index.search("rust AND safe-push", 5).collect()] == [2]
    assert [r.chunk_id for r in index.search("rust NOT safe-push", 5).collect()] == [1]
    assert index.search("", 5).count() == 0 and index.search("missing", 5).count() == 0
    assert retrieval.Bm25Index(docs.limit(0)).search("rust", 5).count() == 0


def test_resolution(spark):
    rows = [("s", 1, "Leiden algorithm", "method", None), ("s", 2, " leiden ALGORITHM ", None, "p"), ("s", 3, "Louvain", None, None), ("t", 4, "leiden algorithm", "x", None), ("s", 5, "Leiden Algorithm", "tool", None), ("s", 6, None, "a", None), ("s", 7, " ", "a", None)]
    found = resolve.resolve_entities(spark.createDataFrame(rows, "store string, seq long, name string, entity_type string, properties string"))
    got = {(r.store, r.id): (r.name, r.entity_type, r.properties) for r in found.collect()}
    assert got == {("s", 1): ("Leiden algorithm", "tool", "p"), ("s", 3): ("Louvain", None, None), ("t", 4): ("leiden algorithm", "x", None)}


def test_merge_chains(spark):
    ents = spark.createDataFrame([(i, "s", f"e{i}") for i in range(1, 7)], "id long, store string, name string")
    rel = spark.createDataFrame([(1, 3, 4), (2, 2, 5)], "id long, head_id long, tail_id long")
    links = spark.createDataFrame([(10, 1), (10, 3), (11, 2)], "chunk_id long, entity_id long")
    merges = spark.createDataFrame([(2, 3), (1, 2), (5, 5), (4, 99)], "target long, source long")
    out = resolve.merge_entities({"entities": ents, "relations": rel, "chunk_entities": links}, merges)
    assert {r.id for r in out["entities"].collect()} == {1, 4, 5, 6}
    assert {(r.id, r.head_id, r.tail_id) for r in out["relations"].collect()} == {(1, 1, 4), (2, 1, 5)}
    assert {tuple(r) for r in out["chunk_entities"].collect()} == {(10, 1), (11, 1)}
    assert {r.merged_entity_name for r in out["entity_merges"].collect()} == {"e2", "e3"}
    with pytest.raises(resolve.MergeError):
        resolve.check_merge(ents, 1, 1)
    with pytest.raises(resolve.MergeError):
        resolve.check_merge(ents, 1, 77)


def test_parsing(spark):
    replies = spark.createDataFrame(
        [(1, "Alice (Person) -[uses]-> Graph DB (v2) (Software)\n\n# note\n%%% bad\nExample: x"), (2, '```json\n{"entities":[{"head":"a","head_type":"b","relation":"c","tail":"d","tail_type":"e"}]}\n```'), (3, '{"entities": [{"head": "a"'), (4, "{}"), (5, None), (6, '{"entities":[{"head":"a"}]}')],
        "seq long, response string",
    )
    got = {r.seq: ([(t.head, t.head_type, t.relation, t.tail, t.tail_type) for t in r.triples], r.malformed) for r in parsing.parse_replies(replies).collect()}
    assert got == {1: ([("Alice", "Person", "uses", "Graph DB (v2)", "Software")], 1), 2: ([("a", "b", "c", "d", "e")], 0), 3: ([], 1), 4: ([], 0), 5: ([], 0), 6: ([], 1)}


def test_apply_and_status(spark):
    chunks = spark.createDataFrame([(1, "s", "c1", "x"), (2, "s", "c2", None), (3, "s", "c3", None)], "id long, store string, content string, source string")
    none = spark.createDataFrame([], "chunk_id long, model string, triple_count long")
    syn = spark.createDataFrame([("uses", "used")], "raw string, canonical string")
    assert [r.unit_id for r in pipeline.plan_extract(chunks, none, "m", 2).collect()] == ["extract:chunk:1", "extract:chunk:2"]
    replies = spark.createDataFrame([(2, 2, "m", "Alice (P) -[uses]-> B (S)"), (1, 1, "m", "alice (Q) -[knows]-> C (S)\n%%%"), (3, 3, "m", "")], "seq long, chunk_id long, model string, response string")
    out = pipeline.apply_extract(replies, chunks, none, syn)
    assert {r.chunk_id: r.triple_count for r in out["extractions"].collect()} == {1: 1, 2: 1, 3: 0}
    assert {r.name for r in out["entities"].collect()} == {"alice", "B", "C"} and out["relations"].count() == 2
    assert pipeline.plan_extract(chunks, out["extractions"], "m").count() == 0
    assert pipeline.apply_extract(replies, chunks, out["extractions"], syn, skip_done=True)["relations"].count() == 0
    tree = spark.createDataFrame([(1, "s", 1, None, None, 0.1), (2, "s", 0, 1, None, 0.1), (3, "s", 0, 1, "", 0.1)], "id long, store string, level int, parent_id long, summary string, modularity double")
    assert [r.id for r in joins.pending_communities(tree).collect()] == [2]
    done = pipeline.apply_summarize(tree, spark.createDataFrame([(1, 2, "  "), (2, 9, "x")], "seq long, community_id long, response string"))
    assert {r.id: r.summary for r in done.collect()} == {1: None, 2: "", 3: ""} and [r.id for r in joins.pending_communities(done).collect()] == [1]
    stores = spark.createDataFrame([("s", 3), ("t", 3)], "name string, dim int")
    links = spark.createDataFrame([], "entity_id long, community_id long")
    status = pipeline.pipeline_status(chunks, out["extractions"], out["entities"], links.select("entity_id"), links, done, stores)
    got = {(r.store, r.phase): (r.total, r.done, r.pending, r.blocked) for r in status.collect()}
    assert got["s", "extract"] == (3, 3, 0, 0) and got["s", "embed"] == (3, 0, 3, 0) and got["s", "summarize"] == (3, 2, 1, 0) and got["t", "extract"] == (0, 0, 0, 0)
    assert {r.store: r.next for r in pipeline.next_step(status).collect()} == {"s": "3 entities to embed", "t": "nothing is pending"}


def test_graph_and_upward_tree(spark):
    names = {i: f"n{i}" for i in range(1, 10)}
    pairs = [(1, 2), (2, 3), (1, 3), (3, 4), (4, 1), (4, 5), (5, 6), (6, 7), (5, 7), (7, 8), (8, 5), (1, 2), (9, 9)]
    rel = spark.createDataFrame([(i, "s", a, b, "relates_to") for i, (a, b) in enumerate(pairs)], "id long, store string, head_id long, tail_id long, relation string")
    ents = spark.createDataFrame([(i, "s", n) for i, n in names.items()], "id long, store string, name string")
    edges = graph.fold_edges(rel)
    assert {(r.src, r.dst): r.weight for r in edges.collect()}[(1, 2)] == 2.0 and edges.count() == 11
    nodes = ents.select("store", F.col("id").alias("node"))
    assert {r.node: r.degree for r in graph.degrees(edges, nodes).collect()}[9] == 0.0
    found = leiden.detect(edges, nodes)
    assert {r.node for r in found.collect()} == set(names)
    kernel = leiden.leiden_kernel(list(range(1, 9)), [tuple(r) for r in edges.select("src", "dst", "weight").collect()])
    assert {r.node: r.community for r in found.where("node < 9").collect()} == kernel
    spread = leiden.detect(edges, nodes, part_edges=2)
    assert {r.node for r in spread.collect()} == set(names)
    tree = leiden.build_upward(rel, ents).collect()
    assert sum(r.level == 0 for r in tree) == 1 and all(r.parent is not None for r in tree if r.level)
    deep = leiden.detect_hierarchy(edges, nodes, min_size=3)
    assert deep.where("level = 0").select("node").distinct().count() == 9


def test_communities_of_large_components(spark):
    # planted groups, one store in one component; a hub with an edge to everyone in it
    rng = random.Random(3)
    pairs = {tuple(sorted((30 * g + rng.randint(1, 30), 30 * (g if rng.random() < 0.9 else rng.randint(0, 4)) + rng.randint(1, 30)))) for g in range(5) for _ in range(150)} | {(0, i) for i in range(1, 151, 3)}
    edges = spark.createDataFrame([("s", a, b, float(rng.randint(1, 3))) for a, b in pairs if a != b] + [("t", 1001, 1002, 1.0), ("t", 1002, 1003, 1.0)], "store string, src long, dst long, weight double")
    nodes = spark.createDataFrame([("s", i) for i in range(151)] + [("t", i) for i in range(1001, 1005)], "store string, node long")
    qualities = {}
    for limit in (10**6, 60):
        found = leiden.detect(edges, nodes, part_edges=limit)
        rows = {(r.store, r.node): r.community for r in found.collect()}
        assert len(rows) == 155 and all(c == min(n for (_, n), d in rows.items() if d == c) for c in rows.values())
        inside = graph.induced_subgraph(edges, found.select("node", "community"))
        parts = {r.node: r.component for r in connected_components(inside).collect()}
        assert all(parts.get(n, n) == c for (_, n), c in rows.items())
        qualities[limit] = {r.store: r.q for r in graph.newman_modularity(edges, found.select("node", "community")).collect()}
    assert all(q["s"] >= 0.9 * qualities[10**6]["s"] > 0.3 and q["t"] == qualities[10**6]["t"] for q in qualities.values()), qualities


def test_expansion(spark):
    rel = spark.createDataFrame([(1, 1, 2), (2, 3, 2), (3, 3, 4)], "id long, head_id long, tail_id long")
    links = spark.createDataFrame([(10, 1), (11, 2), (12, 3), (13, 4), (14, 1)], "chunk_id long, entity_id long")
    seeds = spark.createDataFrame([(10, 0.5)], "chunk_id long, score double")
    one = graph.expand_breadth_first(rel, links, seeds, 1)
    assert {(r.chunk_id, r.from_graph, r.score) for r in one["chunks"].collect()} == {(10, False, 0.5), (11, True, None)}
    far = graph.expand_breadth_first(rel, links, seeds, 9)
    assert {(r.entity_id, r.hop) for r in far["entities"].collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    assert {r.chunk_id for r in graph.expand_comention(links, seeds).collect()} == {14}


def capsule(**change):
    base = dict(
        schema_version=1, capsule_id="c-1", project=dict(project_id="p", display_name="P", repository=None, locations=[]), purpose="why \u001f", verified_state=[dict(statement="s", evidence=["e1"])], decisions=[],
        open_threads=[], commitments=[], next_segment=dict(title="t", entry_point="e", first_action="a"), evidence=[dict(evidence_id="e1", uri="u", observed_at="2026-08-06T22:00:00Z", fingerprint=None)],
        freshness=dict(generated_at="2026-08-06T22:00:00+01:00", source_fingerprint="sha256:" + "a" * 64, stale_after=None, input_fingerprints=[]),
    )
    return base | change


def test_capsules(spark):
    rows = [
        capsule(), capsule(schema_version=2), capsule(capsule_id="a b"), capsule(purpose=" "), capsule(verified_state=[dict(statement="s", evidence=[])]), capsule(verified_state=[dict(statement="s", evidence=["e2"])]),
        capsule(evidence=[capsule()["evidence"][0]] * 2), capsule(freshness=capsule()["freshness"] | dict(generated_at="2026-13-01T00:00:00Z")), capsule(freshness=capsule()["freshness"] | dict(source_fingerprint="sha256:A")),
    ]
    table = spark.createDataFrame(rows, capsules.CAPSULE)
    errors = [r[0] for r in table.select(capsules.capsule_error()).collect()]
    assert errors == [None, "unsupported_version:schema_version", "invalid_id:capsule_id", "empty_text:purpose", "missing_citation:verified_state", "dangling_evidence:verified_state", "duplicate_evidence:evidence", "invalid_timestamp:freshness.generated_at", "invalid_fingerprint:freshness.source_fingerprint"]
    ref = capsules.capsule_references(table).collect()
    assert len(ref) == 1 and ref[0].uri == "weftline://capsules/v1/project/c-1" and "\\u001f" in ref[0].body and '"repository"' not in ref[0].body and '"locations":[]' in ref[0].body
    stored = capsules.capsule_references(table).withColumn("id", F.lit(1).cast("long")).select("id", "capsule_id", "project_id", "kind", "content_fingerprint", "generated_at", "body")
    assert capsules.put_capsules(stored, stored).count() == 1 and capsules.verified_capsules(stored).count() == 1
    with pytest.raises(Exception, match="corrupt"):
        capsules.verified_capsules(stored.withColumn("body", F.lit("x"))).collect()
    assert capsules.latest_capsules(stored.union(stored.withColumn("id", F.lit(2).cast("long")))).first().id == 2


def test_sources(spark, tmp_path):
    lines = tmp_path / "r.jsonl"
    lines.write_text('\n{"chunk_id": 1, "model": "m", "response": "x"}\n\n')
    assert read_replies(spark, str(lines), "chunk_id long, model string, response string").collect()[0].chunk_id == 1
    lines.write_text('{"chunk_id": 1}\nnot json\n')
    with pytest.raises(Exception, match="not JSON"):
        read_replies(spark, str(lines), "chunk_id long").collect()
    embedder = ingest.HashEmbedder(8)
    chunks = spark.createDataFrame([(1, "a b"), (2, "word " * 2000), (3, None)], "id long, content string")
    found = {r.chunk_id: r.embedding for r in ingest.backfill_embeddings(chunks, embedder).collect()}
    assert set(found) == {1, 2} and all(abs(sum(x * x for x in v) - 1) < 1e-5 for v in found.values())
    records = spark.createDataFrame([(1, "c", [1.0, 2.0], [("n", "t")])], "seq long, content string, embedding array<float>, entities array<struct<name:string,entity_type:string>>")
    assert ingest.ingest_records(records, 2)[1].first().name == "n"
    with pytest.raises(Exception, match="dimensions"):
        ingest.ingest_records(records, 3)[0].collect()
    docs = spark.createDataFrame([(1, "a " * 3000, "f"), (2, "b", "g")], "doc_id long, text string, source string")
    assert {r.source for r in ingest.document_chunks(docs).collect()} >= {"f#chunk1", "f#chunk2", "g"}
    tables = {"store": spark.createDataFrame([("s", 2)], "name string, dim int"), "chunk": spark.createDataFrame([(1, "s", "c")], "id long, store string, content string"), "entity": spark.createDataFrame([(1, "s", "n")], "id long, store string, name string"), "relation": spark.createDataFrame([(1, "s", 1, 1, "r")], "id long, store string, head_id long, tail_id long, relation string"), "community": spark.createDataFrame([(1, "s", 0)], "id long, store string, level int")}
    found = [r.json for r in export_lines(tables, "s").orderBy("ord", "id").collect()]
    assert [x.split('"')[3] for x in found] == ["store", "chunk", "entity", "relation", "community"] and "embedding" not in "".join(found)


def test_stream_applies_once(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path / "db"))
    cat.create_store("s", 2)
    cat.write("chunks", spark.createDataFrame([(1, "s", "one"), (2, "s", "two")], "id long, store string, content string"))
    cat.write("relation_synonyms", spark.createDataFrame([("uses", "used")], "raw string, canonical string"))
    schema = "chunk_id long, model string, response string, received_at timestamp"
    source = str(tmp_path / "in")

    def send(rows):
        spark.createDataFrame(rows, "chunk_id long, model string, response string").withColumn("received_at", F.current_timestamp()).write.mode("append").parquet(source)

    send([(2, "m", "Alice (P) -[uses]-> B (S)")])
    run = lambda: start_apply(spark.readStream.schema(schema).parquet(source), cat, str(tmp_path / "ck"), availableNow=True).awaitTermination()
    run()
    send([(2, "m", "Alice (P) -[uses]-> B (S)"), (1, "m", "alice (P) -[knows]-> C (S)")])
    run()
    assert {r.chunk_id for r in cat.read("extractions").collect()} == {1, 2}
    assert cat.read("relations").count() == 2 and {r.name for r in cat.read("entities").collect()} == {"Alice", "B", "C"}
    assert cat.read("chunk_entities").count() == 4


def test_apply_again_and_again(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path))
    cat.create_store("s", 2)
    cat.write("chunks", spark.createDataFrame([(i, "s", "text") for i in range(1, 6)], "id long, store string, content string"))
    cat.write("relation_synonyms", spark.createDataFrame([("knows", "known")], "raw string, canonical string"))

    def apply(*rows, batch=0):
        frame = spark.createDataFrame(list(rows), "chunk_id long, model string, response string").withColumn("received_at", F.current_timestamp())
        return apply_batch(cat, frame, batch)

    a = "A (Person) -[knows]-> B (Person)"
    # parts of the work, out of order
    assert apply((4, "m", a), (2, "m", a)) == 2
    assert [r.chunk_id for r in pipeline.plan_extract(cat.read("chunks"), cat.read("extractions"), "m").orderBy("chunk_id").collect()] == [1, 3, 5]
    # again: nothing doubles
    assert apply((4, "m", a), (2, "m", a), batch=1_000_000) == 0 and cat.read("entities").count() == 2 and cat.read("relations").count() == 2
    assert apply((1, "m", "a -[likes]-> C (Thing)\n%%%"), (3, "m", "%%% no triple"), batch=2_000_000_000_000) == 1
    assert apply((5, "m", "D (X) -[knows]-> c (Tool)"), batch=7) == 1
    ents = {r.name: (r.id, r.entity_type) for r in cat.read("entities").collect()}
    assert set(ents) == {"A", "B", "C", "D"} and sorted(i for i, _ in ents.values()) == [1, 2, 3, 4] and ents["C"][1] == "Tool" and ents["A"][1] == "Person"
    assert sorted(r.id for r in cat.read("relations").collect()) == [1, 2, 3, 4] and cat.read("extractions").count() == 5
    assert {(r.chunk_id, r.triple_count) for r in cat.read("extractions").collect()} == {(1, 1), (2, 1), (3, 0), (4, 1), (5, 1)}


def test_listing(spark):
    chunks = spark.createDataFrame([(i, "s", f"c{i}", "f") for i in range(5)], "id long, store string, content string, source string")
    assert [r.id for r in listing.list_recent_chunks(chunks, "s", 2).collect()] == [4, 3] and listing.list_recent_chunks(chunks, "s", -1).count() == 5
    with pytest.raises(listing.NotFound):
        listing.entity_by_id(chunks, 99)
    rel = spark.createDataFrame([(1, "s", 1, 1), (2, "s", 1, 2)], "id long, store string, head_id long, tail_id long")
    assert sorted((r.entity_id, r.id) for r in listing.relations_of(rel, spark.createDataFrame([(1,), (2,)], "id long")).collect()) == [(1, 1), (1, 2), (2, 2)]
    row = spark.createDataFrame([("# x", "  Ä B "), (None, None)], "t string, n string").select(looks_like_markdown(F.col("t")).alias("m"), fold_key(F.col("n")).alias("k")).collect()
    assert row[0] == (True, "Ä b") and row[1] == (False, None)
    assert fingerprint_text("a") != fingerprint_text("b")
    assert aggregates.latest_per_group(rel, "head_id").first().id == 2
