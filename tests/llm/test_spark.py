"""Operators on small tables: nulls, repeats, ties, empty tables, extra columns, hot groups."""

import datetime as dt
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import canonical_values as cv
from weftline.llm import ivfpq
from weftline.llm import name_variants as nv
from weftline.llm import pair_defects as pdef
from weftline.llm import rank_fusion as rf
from weftline.llm import sentences as sn
from weftline.llm import size_split as sp
from weftline.llm import source_mix as sm
from weftline.llm import token_encode as te

HITS = "query_id long, chunk_id long, rrf double, similarity float, lexical double, n_items string"


def rank_by_hand(rows):
    best = {}
    for q, c, *s in rows:
        if q is None or c is None:
            continue
        old = best.setdefault((q, c), [None] * 3)
        for i, x in enumerate(s[:3]):
            if x is not None and not math.isnan(x) and (old[i] is None or x > old[i]):
                old[i] = x
    out = {}
    for q in {q for q, _ in best}:
        items = {c: s for (g, c), s in best.items() if g == q}
        ranks = {c: [] for c in items}
        for i in range(3):
            for c, s in items.items():
                if s[i] is None:
                    ranks[c].append(float(len(items)))
                else:
                    above = sum(1 for t in items.values() if t[i] is not None and t[i] > s[i])
                    ties = sum(1 for t in items.values() if t[i] == s[i])
                    ranks[c].append(above + (ties + 1) / 2)
        out[q] = sorted(items, key=lambda c: (statistics.median(ranks[c]), sum(ranks[c]) / 3, c))
    return out


def random_hits(seed):
    rng = random.Random(seed)
    value = lambda: rng.choice([None, float("nan"), float("inf"), -float("inf"), 0.0, -0.0, 0.5, 0.5, rng.random(), rng.random() * 1e6])
    rows = [(rng.choice([1, 1, 1, 2, None]), rng.choice([None, *range(1, 40)]), value(), value(), value(), "x") for _ in range(150)]
    return rows + rows[:20]


@pytest.mark.parametrize("hot", [200_000, 5])
def test_median_rank(spark, hot):
    rows = random_hits(hot)
    clean = [(q, c, a, None if b is None else float(np.float32(b)), x, n) for q, c, a, b, x, n in rows]
    found = rf.median_rank(spark.createDataFrame(rows, HITS), hot_rows=hot)
    want = rank_by_hand(clean)
    top = rf.top_of_groups(found, spark.createDataFrame([(1, 7), (2, 100), (3, 5), (None, 2)], "query_id long, top_n int"), slices=3)
    got = {}
    for r in top.orderBy("query_id", "place").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    assert got == {1: want[1][:7], 2: want[2]}
    assert rf.median_rank(spark.createDataFrame([], HITS)).count() == 0


def test_weighted_median(spark):
    row = spark.range(1).select(rf.weighted_median([F.lit(1.0), F.lit(9.0), F.lit(5.0)], [3.0, 1.0, 1.0]).alias("a"), rf.weighted_median([F.lit(1.0), F.lit(9.0)], [1.0, 1.0]).alias("b")).first()
    assert (row.a, row.b) == (1.0, 5.0)


def test_pair_defects(spark):
    units = spark.createDataFrame(
        [("u1", "extract", 1, None, "List the facts:\n\nThe indexer keeps the tree and the list of names."), ("u1", "extract", 1, None, "List the facts:\n\nThe indexer keeps the tree and the list of names."), ("u2", "summarize", 0, 5, "Say what joins the group:\nAnna (person)"), ("u3", "extract", None, None, "x")],
        "unit_id string, kind string, chunk_id long, community_id long, user_prompt string",
    )
    rows = [(1, "extract", 1, None, "The indexer (software) -[keeps]-> the tree (concept)"), (2, "extract", 1, None, None), (2, "extract", 1, None, None), (3, "extract", 1, None, "The indexer keeps the tree and the list of names."), (4, "summarize", None, 5, "I must decline to answer this."), (5, "extract", None, None, "ok."), (6, "extract", 99, None, "")]
    replies = spark.createDataFrame(rows, "reply_id long, kind string, chunk_id long, community_id long, response string").withColumn("key", F.lit(1)).withColumn("ends", F.lit(2))
    assert {(r.reply_id, r.defect) for r in pdef.pair_defects(units, replies).collect()} == {(2, "empty"), (3, "copy"), (4, "refusal"), (6, "empty")}
    assert pdef.pair_defects(units.limit(0), replies.limit(0)).count() == 0
    # a unit of very many replies is paired in parts, with the same result
    many = spark.createDataFrame([(100 + i, "extract", 1, None, f"The indexer (software) -[keeps]-> tree {i}") for i in range(60)], "reply_id long, kind string, chunk_id long, community_id long, response string")
    parts = [{tuple(r) for r in pdef.pair_replies(units, many.unionByName(replies.select(many.columns)), hot).collect()} for hot in (5, 10_000)]
    assert parts[0] == parts[1] and len(parts[0]) == 66
    thai = units.limit(1).withColumn("user_prompt", F.lit("ส่งกลับ: ดัชนีสร้างรายการชื่อเสมอ ระบบเก็บข้อความไว้"))
    said = spark.createDataFrame([(1, "extract", 1, None, "ระบบสร้างรายการชื่อเสมอ\n"), (2, "extract", 1, None, "ระบบสร้างรายการชื่")], "reply_id long, kind string, chunk_id long, community_id long, response string")
    assert {tuple(r) for r in pdef.pair_defects(thai, said).collect()} == {(2, "truncated")}


def test_split_spans(spark):
    spans = spark.createDataFrame([(1, 1, "aaa bbb ccc ddd"), (1, 1, "aaa bbb ccc ddd"), (2, 1, None), (3, 1, ""), (4, 9, "x" * 50), (5, 1, "x" * 30), (6, None, "y"), (7, 2, "a b c d e f")], "span_id long, config_id long, text string").withColumn("chunk_size", F.lit("clash"))
    configs = spark.createDataFrame([(1, 8, None), (2, 6, 2), (3, 0, 0), (None, 5, 1)], "config_id long, chunk_size int, overlap int")
    split = sp.split_spans(spans, configs)
    assert {(r.span_id, r.forced) for r in sp.oversized(split).collect()} == {(1, 0), (5, 1), (7, 0)}
    pieces = sp.pieces_of(split).where("span_id = 7").orderBy("piece").collect()
    assert all(len(p.text) <= 6 for p in pieces) and all(b.text.startswith(a.text[-2:]) for a, b in zip(pieces, pieces[1:]))
    assert sp.oversized(sp.split_spans(spans.limit(0), configs.limit(0))).count() == 0


def vectors(seed, groups=40, size=4, dim=16):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        centre = rng.normal(size=dim)
        for _ in range(size):
            out.append(centre + 0.15 * rng.normal(size=dim))
    return [np.asarray(v, dtype=np.float32) for v in out]


def brute_neighbours(rows, k, least):
    out = set()
    for s in {s for s, _, _ in rows}:
        own = sorted((i, v.astype(float) / np.linalg.norm(v.astype(float))) for t, i, v in rows if t == s)
        for i, v in own:
            near = sorted((-round(float(v @ w), 9), j) for j, w in own if j != i)[:k]
            out |= {(s, i, j) for c, j in near if -c >= least}
    return out


def test_neighbours_recall_and_cases(spark):
    at = dt.datetime(2026, 1, 1)
    vs = vectors(3)
    rows = [("a" if i % 3 else "b", i, v) for i, v in enumerate(vs)]
    rows += [("a", 1000 + i, vs[1]) for i in range(12)]  # exact copies
    table = [(s, i, [float(x) for x in v], at) for s, i, v in rows]
    table += table[:5]
    table += [("a", 2000, [0.0] * 16, at), ("a", 2001, [1.0] * 15, at), ("a", 2002, [float("nan")] + [1.0] * 15, at), ("a", 2003, None, at), (None, 2004, [1.0] * 16, at), ("zz", 2005, [1.0] * 16, at), ("a", None, [1.0] * 16, at), ("a", 2006, [], at)]
    emb = spark.createDataFrame(table, "store string, chunk_id long, embedding array<float>, embedded_at timestamp").withColumn("dim", F.lit(3))
    stores = spark.createDataFrame([("a", 16), ("b", 16), ("c", 8)], "name string, dim int")
    use = ivfpq.usable_vectors(emb, stores)
    assert use.count() == len(rows)
    config = ivfpq.IvfPqConfig(k=5, list_root=2.0, code_block=16, query_block=32, sample=400)
    got = {(r.store, r.id, r.neighbour) for r in ivfpq.neighbours(use, config).collect()}
    want = brute_neighbours(rows, 5, -1.0)
    assert len(got & want) >= 0.9 * len(want) and len(got) <= len(want)
    close = ivfpq.IvfPqConfig(k=5, min_cosine=0.9, list_root=2.0, code_block=16, query_block=32)
    got = {(r.chunk_a, r.chunk_b) for r in ivfpq.similar_pairs(ivfpq.neighbours(use, close)).collect()}
    want = {(min(i, j), max(i, j)) for _, i, j in brute_neighbours(rows, 5, 0.9)}
    assert len(got & want) >= 0.97 * len(want) and got <= want
    assert ivfpq.neighbours(ivfpq.usable_vectors(emb.limit(0), stores), config).count() == 0


def test_map_values(spark):
    vocab = spark.createDataFrame([(1, "relation", "depends_on", "depends_on"), (2, "relation", "needs", "depends_on"), (3, "relation", "mentions", "mentions"), (4, "entity_type", "person", "person"), (5, "relation", None, "x")], "entry_id long, kind string, label string, canonical string")
    rel = spark.createDataFrame([(1, "depends_on"), (2, "Depends On"), (2, "Depends On"), (3, None), (4, " "), (5, "kumquat"), (6, "needs"), (7, "mentoins"), (None, "needs"), (8, "​")], "id long, relation string").withColumn("canonical", F.lit("clash"))
    ent = spark.createDataFrame([(1, "a person"), (2, "person"), (3, "depends_on")], "id long, entity_type string")
    records = cv.value_records([("relation", rel, "id", "relation"), ("entity_type", ent, "id", "entity_type")], vocab)
    want = {("relation", 2, "depends_on"), ("relation", 5, "unmatched"), ("relation", 6, "depends_on"), ("relation", 7, "mentions"), ("entity_type", 1, "person"), ("entity_type", 3, "unmatched")}
    for limit in (50_000, 1):
        assert {tuple(r) for r in cv.map_values(records, vocab, limit).collect()} == want
    assert cv.map_values(records.limit(0), vocab).count() == 0
    # very long labels and values give the same either way
    long = "".join(random.Random(1).choice("abcdefghij") for _ in range(230))
    words = vocab.unionByName(spark.createDataFrame([(9, "relation", long, long)], vocab.schema))
    typed = spark.createDataFrame([(1, long[:100] + "x" + long[100:]), (2, long + "yzw"), (3, long * 5)], "id long, relation string")
    cases = cv.value_records([("relation", typed, "id", "relation")], words)
    for limit in (50_000, 1):
        assert {tuple(r) for r in cv.map_values(cases, words, limit).collect()} == {("relation", 1, long), ("relation", 2, "unmatched"), ("relation", 3, "unmatched")}
    assert {r.canonical for r in cv.map_values(records, vocab.limit(0)).collect()} == {"unmatched"}


@pytest.mark.parametrize("common", [64, 3])
def test_link_names(spark, common):
    groups = [
        ["Katherine Vileziketis", "Kate Vileziketis", "K. Vileziketis", "Kathreine Vileziketis", "Vileziketis, Katherine"],
        ["Teodor Zanivolas"], ["Theodore Zanivolas", "Ted Zanivolas"],
        ["Pohipelasis 3", "pohipelasis-3", "Pohipelassi 3"], ["Pohipelasis 4", "POHIPELASIS_4"],
        ["Rolezavifas Foundation", "Foundation of Rolezavifas", "Rolezavifas Fdn."], ["Rolezavifas Institute"], ["!!"],
    ]
    # an initial that two people share stands for none of them
    groups.append(["T. Zanivolas"])
    # many names with one ending make an overly common suffix
    letters = "bdfghjklmnprstvz"
    groups += [[f"{a}o{b}iletapon 7"] for a, b in zip(letters, letters[1:] + letters[:1])]
    names = spark.createDataFrame([(n,) for g in groups for n in g * 2] + [(None,), (" ",)], "head string")
    linked = nv.link_names(nv.distinct_names([(names, "head")]), common)
    got = {(r.name_a, r.name_b) for r in nv.variant_pairs(linked).collect()}
    want = {(a, b) for g in groups for a in g for b in g if a < b}
    assert got == want
    assert nv.variant_pairs(nv.link_names(nv.distinct_names([(names.limit(0), "head")]))).count() == 0


def test_encode_and_decode(spark):
    docs = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (4, "日本語 text\n" * 50)], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    out = te.encode_corpus(docs)
    got = {r.doc_id: r.ids for r in out.collect()}
    assert got[1] == [15496, 995] and got[2] == [] and got[3] == []
    assert {r.doc_id: r.text for r in te.decode_corpus(out).collect()}[4] == "日本語 text\n" * 50
    assert te.encode_corpus(docs.limit(0)).count() == 0
    # a vocabulary that lies on the driver only is sent along
    assert te.shipped(docs, te.vocabulary_path()) == te.vocabulary_path()
    names = spark.range(1).mapInPandas(lambda bs: (b.assign(id=len(te.load(te.found_path("/nowhere/byte_bpe_50k.tiktoken")).tokens)) for b in bs), "id long")
    assert names.first().id > 50_000


def test_mix(spark):
    rng = random.Random(1)
    docs = [(i, f"s{i % 3}", "word " * rng.randint(1, 60)) for i in range(600)] + [(1000, None, "x"), (1001, "s0", None), (1002, "s9", "none"), (1003, "s1", "")]
    docs += docs[:7]
    table = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("copies", F.lit(1))
    targets = spark.createDataFrame([("s0", 0.6, 1), ("s1", 0.2, 2), ("s2", 0.2, None), ("s3", 0.0, 4), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    rows, report = sm.mix_sources(table, targets, block_tokens=64, shards=3)
    found = {r.source: r for r in report.collect()}
    assert abs(sum(r.actual_share for r in found.values()) - 1) < 1e-9
    for s, share in (("s0", 0.6), ("s1", 0.2), ("s2", 0.2)):
        assert abs(found[s].actual_share - share) < 0.03
    assert found["s3"].tokens == 0
    kept = rows.collect()
    assert len({(r.doc_id, r.copy) for r in kept}) == len(kept) and max(r.copy for r in kept if r.source == "s0") == 0
    again = {(r.doc_id, r.copy, r.block, r.shard) for r in sm.mix_sources(table.repartition(7), targets, block_tokens=64, shards=3)[0].collect()}
    assert again == {(r.doc_id, r.copy, r.block, r.shard) for r in kept}
    large, big = sm.mix_sources(table, targets, block_tokens=64, shards=3, total_tokens=10**9)
    assert large.where("source = 's1'").agg(F.max("copy")).first()[0] == 1
    assert sm.mix_sources(table.limit(0), targets)[0].count() == 0


def test_sentence_units(spark):
    docs = spark.createDataFrame([(1, "One ends. Two ends.", "prose"), (1, "One ends. Two ends.", "prose"), (2, None, "prose"), (3, " \n", "markdown"), (4, "- a. b\n- c", "markdown"), (5, "1. x. Y z.", "prose"), (None, "lost.", None)], "doc_id long, text string, shape string").withColumn("word", F.lit("clash"))
    want = {(1, 0, 9), (1, 10, 19), (4, 0, 6), (4, 7, 10)}
    for limit in (100_000, -1):
        got = {tuple(r) for r in sn.sentence_units(docs, sent_words=limit).collect()}
        assert {x for x in got if x[0] != 5} == want and {x for x in got if x[0] == 5}
    assert sn.sentence_units(docs.limit(0)).count() == 0


def test_sentence_units_do_not_depend_on_the_words_sent(spark):
    rows = [(i, f"Wir bleiben bis 4. März {i} und bzgl. der Reise.") for i in range(40)] + [(100, "Es war am 3./4. März so. Wir fragten bzgl.Haus und Hof.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sent, joined = ({tuple(r) for r in sn.sentence_units(docs, sent_words=limit).collect()} for limit in (100_000, -1))
    assert sent == joined and (100, 0, 24) in sent


def test_overly_common_blocks_lose_no_pair(spark):
    # 26 tools and 26 families that share their suffix, first letters, version and given name, and one initial
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = [f"Kube{c}rnetes 2" for c in letters] + ["Kubernetes 2"] + [f"Katherine Smi{c}hardson" for c in letters] + ["Katherine Smihardson", "K. Smihardson", "Lubernetes 2"]
    table = spark.createDataFrame([(n,) for n in names], "name string")
    by_size = [{tuple(r) for r in nv.variant_pairs(nv.link_names(table, common)).collect()} for common in (2, 1000)]
    assert by_size[0] == by_size[1] and len(by_size[0]) == 28 * 27 // 2 * 2


@pytest.mark.parametrize("common", [2, 64])
def test_names_link_as_by_brute_force(spark, common):
    rng = random.Random(common)
    syllables = [a + b for a in "bdkmnrst" for b in "aeio"]
    word = lambda n: "".join(rng.choice(syllables) for _ in range(n))
    givens, families, tools = [word(rng.randint(2, 4)) for _ in range(4)], [word(rng.randint(2, 6)) for _ in range(25)], [word(rng.randint(3, 6)) for _ in range(40)]

    def typo(w):
        i, kind = rng.randrange(len(w)), rng.randrange(4)
        return w[:i] + w[i + 1 :] if kind == 0 else w[:i] + rng.choice("bdkaeio") + w[i + (kind == 1) :] if kind < 3 else w[:i] + w[i + 1 : i + 2] + w[i] + w[i + 2 :]

    names = set()
    for _ in range(900):
        f, g, t = (rng.choice(x) for x in (families, givens, tools))
        names.add(rng.choice([f"{g} {f}", f"{typo(g)} {f}", f"{g} {typo(f)}", f"{g[0]}. {f}", f"{g[0]}. {typo(f)}", t, typo(t), f"{t} {rng.randint(1, 2)}", f"{typo(t)} {rng.randint(1, 2)}.1", f"{typo(t)} Foundation", f"{t} Fdn."]))
    parts = {"|".join(nv.parse(n)): nv.parse(n) for n in names}
    top = {k: k for k in parts}

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for a in sorted(parts):
        for b in parts:
            if a < b and nv.same_entity(parts[a], parts[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    of = {}
    for a, p in parts.items():
        people = {find(b) for b, q in parts.items() if p[0] == "I" and q[0] == "P" and nv.stands_for(p, q)}
        of[a] = people.pop() if len(people) == 1 else find(a)
    table = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r.name: r.entity for r in nv.link_names(table, common).collect()}
    assert got == {n: of["|".join(nv.parse(n))] for n in names}


def test_blocks_of_any_size_keep_all_pairs(spark):
    # one class of very many variants and 5 000 names with a common ending
    rng = random.Random(4)
    stems = {"".join(rng.choice("bcdfghklmnprstvz") for _ in range(7)) for _ in range(5000)}
    names = [f"{s}iletapon" for s in sorted(stems)]
    table = spark.createDataFrame([(n,) for n in names], "name string")
    got = {(r.name_a, r.name_b) for r in nv.variant_pairs(nv.link_names(table), part=2).collect()}
    by = {}
    for s in stems:
        for d in nv.deletions(s):
            by.setdefault(d, set()).add(s)
    near = {tuple(sorted((a, b))) for group in by.values() for a in group for b in group if a < b and nv.alike(f"{a}iletapon", f"{b}iletapon")}
    assert {(f"{a}iletapon", f"{b}iletapon") for a, b in near} <= got and len(got) < 20 * len(near) + 10


def test_search_effort_is_measured():
    # tight groups need few lists, noise needs many
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 24))
    unit = lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    tight, noise = unit(np.repeat(centres, 20, axis=0) + 0.02 * rng.normal(size=(1200, 24))), unit(rng.normal(size=(1200, 24)))
    stores = np.zeros(1200, dtype=int)
    config = ivfpq.IvfPqConfig(k=5, least_probes=2)
    few, many = (ivfpq.fit(x, stores, 64, config) for x in (tight, noise))
    assert few.searched.shape[1] < 12 < many.searched.shape[1] <= 64
    for q, x in ((few, tight), (many, noise)):
        filed = q.nearest(x)
        codes = q.codes(x, filed)
        hit = 0
        for i in range(0, 1200, 12):
            exact = (x @ x[i]).astype(float)
            exact[i] = -9
            top = set(np.argsort(-exact)[:5].tolist())
            near = np.flatnonzero(np.isin(filed, q.searched[filed[i]]))
            said = q.scores(x[i : i + 1], filed[near], codes[near])[0]
            hit += len(top & set(near[np.argsort(-said)[: q.shortlist + 1]].tolist()))
        assert hit >= 0.94 * 500
        assert all(h in lists for at, homes in enumerate(q.homes) for h in homes for lists in [range(len(q.searched))] if at in q.searched[h])
