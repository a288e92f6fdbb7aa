"""Core kernels without Spark."""

import random

import numpy as np

from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.functions import hashing, spans, vocabulary
from weftline.operators import leiden
from weftline.operators.hierarchy import chain, follow
from weftline.operators.retrieval import has_operators, parse_query, terms_of


def test_fingerprints():
    assert hashing.fingerprint_text("") == "xxh3:2d06800538d394c2"
    assert hashing.fingerprint_text_wide("").startswith("xxh3-128:") and len(hashing.fingerprint_text_wide("x")) == 9 + 32


def test_vocabulary():
    assert len(vocabulary.pairs(vocabulary.RELATION_SYNONYMS)) == 68 and len(vocabulary.canonical_relations()) == 24
    types = dict(vocabulary.pairs(vocabulary.TYPE_SYNONYMS))
    assert len(types) == 86 and types["publication"] == "document" and types["release"] == "version"
    assert len(vocabulary.canonical_entity_types()) == 14


TEXT = st.text(alphabet="ab .\n!é中`#", max_size=400)


@settings(max_examples=80, deadline=None)
@given(TEXT, st.integers(1, 80), st.integers(0, 60), st.booleans())
def test_text_spans_are_exact_ordered_and_small(text, size, slack, markdown):
    data = text.encode()
    found = spans.chunk_spans(text, size, slack, markdown)
    assert found == spans.chunk_spans(text, size, slack, markdown)
    last = 0
    for i, s in enumerate(found):
        assert s["index"] == i and s["start"] >= last and data[s["start"] : s["end"]].decode() == s["text"] and len(s["text"]) <= size
        assert s["line_start"] == 1 + data[: s["start"]].count(b"\n") and s["line_end"] == s["line_start"] + s["text"].count("\n")
        assert spans.verify_span(s, hashing.fingerprint_text(s["text"])) == "ok" and spans.verify_span(s, "xxh3:0") == "fingerprint_mismatch"
        last = s["end"]
    assert bool(found) == bool(text.strip()) and spans.verify_span(None, "") == "out_of_range"
    assert "".join("".join(s["text"] for s in found).split()) == "".join(text.split())


@settings(max_examples=80, deadline=None)
@given(TEXT, st.integers(0, 60))
def test_line_spans_lose_nothing(text, budget):
    found = spans.line_spans(text, budget)
    assert "".join(s["text"] for s in found) == text
    assert all(len(s["text"].encode()) <= max(1, budget) or s["text"].rstrip("\n").count("\n") == 0 for s in found)
    for s in found:
        wide = spans.resize_span(text, s, 1, 1)
        assert wide["text"] and s["text"] in wide["text"] and spans.resize_span(text, s, -99, -99)["text"]


def test_code_spans():
    source = "import os\n\n\ndef f(x):\n    return x\n\n\nclass A:\n    def g(self):\n        return 1\n"
    strategy, found = spans.code_spans_auto(source, "a/b.py", 30)
    assert strategy == "code:python" and "".join(s["text"] for s in found) == source and found[1]["text"].startswith("def f")
    assert spans.code_spans_auto("def (:\n", "x.py", 40)[0] == "lines" and spans.code_spans_auto("a\n", "x.unknown", 40)[0] == "lines"
    rust = "use a;\n\n/// doc\nfn one() {\n    let x = 1;\n}\n\nstruct S {\n    a: i32,\n}\n"
    strategy, found = spans.code_spans_auto(rust, "x.rs", 30)
    assert strategy == "code:rust" and "".join(s["text"] for s in found) == rust
    assert any(s["text"].startswith("/// doc") for s in found)


def test_windows():
    text = "One two. " * 40
    parts = spans.split_with_overlap(text, 50)
    assert all(len(p) <= 50 for p in parts) and parts[0].endswith(".")


def clique(names, weight=1.0):
    return [(a, b, weight) for i, a in enumerate(names) for b in names[i + 1 :]]


def test_leiden_toys():
    edges = clique([1, 2, 3]) + clique([4, 5, 6]) + [(3, 4, 0.1)]
    labels = leiden.leiden_kernel([1, 2, 3, 4, 5, 6, 99], edges)
    # the triangles are never mixed, and a node without edges stays alone
    assert set(labels) == {1, 2, 3, 4, 5, 6, 99} and labels[99] == 99
    assert not {labels[n] for n in (1, 2, 3)} & {labels[n] for n in (4, 5, 6)}
    assert leiden.leiden_kernel([1, 2], []) == {1: 1, 2: 2} and leiden.leiden_kernel([], []) == {}
    groups = [list(range(a, a + 5)) for a in (0, 10, 20)]
    edges = sum((clique(g) for g in groups), []) + [(0, 10, 0.1), (10, 20, 0.1)]
    labels = leiden.leiden_kernel(sum(groups, []), edges)
    assert all(len({labels[n] for n in g} & {labels[n] for h in groups if h is not g for n in h}) == 0 for g in groups)


def test_leiden_parts_are_connected_and_quality_holds():
    rng = random.Random(3)
    for _ in range(30):
        nodes = list(range(rng.randint(2, 25)))
        edges = list({(min(a, b), max(a, b)): (min(a, b), max(a, b), 1.0) for a, b in ((rng.choice(nodes), rng.choice(nodes)) for _ in range(40)) if a != b}.values())
        labels = leiden.leiden_kernel(nodes, edges)
        near = {n: {b for a, b, _ in edges if a == n} | {a for a, b, _ in edges if b == n} for n in nodes}
        assert leiden.connected_parts(labels, near) == labels and set(labels) == set(nodes)
        degree = {n: float(len(near[n])) for n in nodes}
        assert leiden.quality(labels, edges, degree, float(len(edges))) >= 0


def test_follow():
    ids, parents, has = np.array([10, 20, 30, 40, 50, 60, 70]), np.array([0, 10, 99, 30, 60, 50, 60]), np.array([False, True, True, True, True, True, True])
    up, states, exits, far = follow(ids, parents, has, np.array([1, 1, 5, 2, 1, 1, 1]))
    assert list(states) == ["root", "root", "open", "open", "cycle", "cycle", "below"] and list(ids[exits][:4]) == [10, 10, 30, 30] and list(far) == [0, 1, 0, 2, 0, 0, 0]
    assert chain(3, up.tolist(), ids.tolist(), [[], [], [8], [35, 36], [], [], []]) == [30, 35, 36, 40] and chain(1, up.tolist(), ids.tolist(), None) == [10, 20]
    assert all(len(x) == 0 for x in follow(np.array([], dtype=int), np.array([], dtype=int), np.array([], dtype=bool), np.array([], dtype=int)))


def test_query_parsing():
    assert not has_operators("plain words") and has_operators("a AND b") and has_operators("title:x")
    assert parse_query("") is None and parse_query("Rust rust") == ("or", [("term", "rust")])
    assert parse_query("a AND (b OR c) NOT d") == ("and", [("term", "a"), ("or", [("term", "b"), ("term", "c")]), ("not", ("term", "d"))])
    assert terms_of(parse_query("a NOT b"), negated=False) == {"a"}
    assert parse_query("a OR") == ("term", "a") and parse_query("(") is None
