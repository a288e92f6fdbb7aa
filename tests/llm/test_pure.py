"""Kernels against brute force, without Spark."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import canonical_values as cv
from weftline.llm import name_variants as nv
from weftline.llm import pair_defects as pd_
from weftline.llm import sentences as sn
from weftline.llm import size_split as sp
from weftline.llm import source_mix as sm
from weftline.llm import token_encode as te

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def bpe():
    return te.load(te.vocabulary_path())


@pytest.fixture(scope="module")
def reference(bpe):
    return tiktoken.Encoding("own", pat_str=te.SPLIT_PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.tokens)}, special_tokens={})


def test_encoder_equals_merging_by_rank(bpe, reference):
    rng = random.Random(5)
    alphabet = "abcdenrst  \n.,'0123äß中文字ไทย🙂é<|>"
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80)))
        assert bpe.encode(text) == reference.encode_ordinary(text)
        assert bpe.decode(bpe.encode(text)) == text


def test_encoder_null_empty_special_and_long(bpe, reference):
    assert bpe.encode(None) == [] and bpe.encode("") == []
    assert bpe.encode("<|endoftext|>") == reference.encode_ordinary("<|endoftext|>")
    for text in ("a" * 20_000, " " * 5_000, "中" * 3_000, "ab" * 4_000):
        assert bpe.encode(text) == reference.encode_ordinary(text)
    with pytest.raises(ValueError):
        bpe.decode([len(bpe.tokens)])


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=400), st.integers(1, 60), st.integers(-1, 80))
def test_split_is_lossless_and_within_size(text, size, overlap):
    pieces = sp.split_text(text, size, overlap)
    used = overlap if 0 <= overlap < size else size // 2 if overlap >= size else 0
    assert "".join(text[c:b] for _, c, b, _ in pieces) == text
    assert all(b - a <= size for a, _, b, _ in pieces)
    for (_, _, end, _), (start, core, _, _) in zip(pieces, pieces[1:]):
        assert core == end and start == max(0, core - used)


def test_split_prefers_strong_boundaries():
    text = "one two. three four\n\nfive six, seven eight"
    kinds = [k for _, _, _, k in sp.split_text(text, 25)]
    assert kinds[:2] == ["start", "paragraph"]
    assert [k for _, _, _, k in sp.split_text("x" * 50, 20)].count("forced") == 3
    assert sp.longest_run("ab-cde fghij") == 5


def seats_by_hand(shares, seats, caps):
    got = [0] * len(shares)
    for _ in range(seats):
        best = max((i for i in range(len(shares)) if shares[i] > 0 and got[i] < caps[i]), key=lambda i: (shares[i] / (2 * got[i] + 1), -i), default=None)
        if best is None:
            break
        got[best] += 1
    return got


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 200)), min_size=1, max_size=8), st.integers(0, 300))
def test_sainte_lague_equals_seat_by_seat(parties, seats):
    shares, caps = [float(a) for a, _ in parties], [b for _, b in parties]
    assert sm.sainte_lague(shares, seats, caps) == seats_by_hand(shares, seats, caps)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=1, max_size=8), st.integers(1, 12))
def test_shards_have_the_shares_of_the_mixture(quotas, shards):
    rows = sm.shard_quotas(quotas, shards)
    assert [sum(r[i] for r in rows) for i in range(len(quotas))] == quotas and min(min(r) for r in rows) >= 0
    assert max(map(sum, rows)) - min(map(sum, rows)) <= 1
    for r in rows:
        assert all(abs(q - sum(r) * quotas[i] / max(1, sum(quotas))) <= len(quotas) for i, q in enumerate(r))


def test_shard_quotas_are_whole_and_even():
    rows = sm.shard_quotas([10, 3, 0], 4)
    assert [sum(r[i] for r in rows) for i in range(3)] == [10, 3, 0]
    assert all(max(r[i] for r in rows) - min(r[i] for r in rows) <= 1 for i in range(3))


def brute_edits(a, b):
    d = {(-1, -1): 0}
    for i in range(len(a)):
        d[i, -1] = i + 1
    for j in range(len(b)):
        d[-1, j] = j + 1
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


@settings(max_examples=100, deadline=None)
@given(st.text("abcdefgh", min_size=5, max_size=11), st.integers(0, 11), st.integers(0, 3))
def test_words_one_letter_apart_share_an_end(word, at, kind):
    at %= len(word)
    other = (word[:at] + word[at + 1 :], word[:at] + "x" + word[at:], word[:at] + "x" + word[at + 1 :], word[:at] + word[at + 1 : at + 2] + word[at] + word[at + 2 :])[kind]
    assert len(other) < 5 or nv.alike(word, other, 0.0) and set(nv.ends(word)) & set(nv.ends(other))


@settings(max_examples=2000, deadline=None)
@given(st.text("abc", max_size=6), st.text("abc", max_size=6))
def test_alike_is_one_edit(a, b):
    assert nv.alike(a, b, 0.0) == (brute_edits(a, b) <= 1)


@settings(max_examples=100, deadline=None)
@given(st.text("abcd", max_size=7), st.text("abcd", max_size=7))
def test_weighted_distance_and_one_edit(a, b):
    edits, weight = cv.weighted_distance(a, b)
    assert edits == brute_edits(a, b) and weight <= edits + 1e-9
    assert nv.alike(a, b, 0.0) == (edits <= 1)
    assert edits > 1 or nv.deletions(a) & nv.deletions(b)
    assert edits > 1 or min(len(a), len(b)) < 5 or set(nv.ends(a)) & set(nv.ends(b))
    assert edits > 1 or min(len(a), len(b)) < 3 or a[0] == b[0] or a[-1] == b[-1]


@settings(max_examples=100, deadline=None)
@given(st.text("abc", min_size=1, max_size=8), st.text("abc", min_size=1, max_size=8))
def test_lcs_ratio(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    assert abs(nv.lcs_ratio(a, b) - 2 * t[-1][-1] / (len(a) + len(b))) < 1e-9


def test_symmetric_deletes_find_all_within_two_edits():
    rng = random.Random(2)
    labels = ["".join(rng.choice("abcde") for _ in range(rng.randint(5, 9))) for _ in range(40)]
    words = cv.Dictionary([(x, x, 0) for x in labels])
    for _ in range(200):
        value = list(rng.choice(labels))
        for _ in range(rng.randint(0, 4)):
            value[rng.randrange(len(value))] = rng.choice("abcdef")
        value = "".join(value)
        near = min(brute_edits(value, x) for x in labels)
        assert (words.lookup(value) == cv.UNMATCHED) == (near > 2)


def test_folding_of_typed_values():
    words = cv.Dictionary([("depends_on", "depends_on", 5), ("relies_on", "depends_on", 1), ("write-up", "report", 0), ("idea", "concept", 0)])
    for value in ("Depends On", "dependsOn", ' "depends_on"', "rel:depends_on", "also_depends_on", "is_depends_on", "DEPENDT_ON", "edsends_on", "depends__on.", "reliesOn"):
        assert words.lookup(value) == "depends_on", value
    assert words.lookup("a write-up (other)") == "report" and words.lookup("type: idea") == "concept"
    for value in ("n/a", "kiwi", "?", "holiday plan", "x" * 10_000):
        assert words.lookup(value) == cv.UNMATCHED, value


def test_name_parts():
    same = [
        ["Katherine Vileziketis", "Kate Vileziketis", "Vileziketis, Katherine H.", "Prof. KATHERINE  Vileziketis, PhD", '"Vileziketis Katherine"'],
        ["Rolezavifas Foundation", "Foundation of Rolezavifas", "Rolezavifas Fdn.", "ROLEZAVIFASFOUNDATION", "The Rolezavifas Foundation (RF)", "RolezavifasFoundation", "Rolezavifas_Foundation"],
        ["Pohipelasis 3", "POHIPELASIS_3", "pohipelasis-3.", "Pohipelasis version 3", "Pohipelasis v3", "Pohipelasis3", "Pohipélasis 3"],
    ]
    for names in same:
        assert len({nv.parse(n) for n in names}) == 1, [nv.parse(n) for n in names]
    a, b, c = nv.parse("Teodor Zanivolas"), nv.parse("Theodore Zanivolas"), nv.parse("Teoodr Zanivolas")
    assert not nv.same_entity(a, b) and nv.same_entity(a, c)
    assert not nv.same_entity(nv.parse("Pohipelasis 3"), nv.parse("Pohipelasis 4"))
    assert nv.parse("Graphdb 2.1") == nv.parse("graphdb-v2.1") == nv.parse("GraphDB2.1") == ("T", "graphdb", "2.1") and nv.parse("Graphdb 3.1")[2] == "3.1"
    for x, y in (("Kubernetes", "Kuberntes"), ("Elasticsearch", "Elasticsaerch"), ("Postgres", "Postgrse"), ("Postgres", "Opstgres"), ("Redisy", "Reidsy")):
        assert nv.same_entity(nv.parse(x), nv.parse(y)) and {k for k, *_ in nv.block_keys(nv.parse(x))} & {k for k, *_ in nv.block_keys(nv.parse(y))}
    assert nv.stands_for(nv.parse("T. Zanivolas"), a) and not nv.stands_for(nv.parse("K. Zanivolas"), a)


def brute_covered(text, source, least):
    marked = [False] * len(text)
    for i in range(len(text)):
        for j in range(i + least, len(text) + 1):
            if text[i:j] in source:
                marked[i:j] = [True] * (j - i)
    return sum(marked)


@settings(max_examples=80, deadline=None)
@given(st.text("abc ", max_size=30), st.text("abc ", min_size=1, max_size=30))
def test_suffix_automaton_coverage(text, source):
    assert pd_.covered(text, source, 3) == brute_covered(text, source, 3)


PROMPT = "List the facts stated in this passage:\n\nThe indexer logs the community tree. Our team drops the ranking scores after a failed import."


@pytest.mark.parametrize(
    "response,defect",
    [
        (None, "empty"), ("", "empty"), (" ​\n", "empty"), ("```\n```", "empty"), ('""', "empty"),
        ("I'm sorry, but I can't help with that request.", "refusal"), ("Hello. I must decline to answer this. The indexer logs it.", "refusal"), ("抱歉，我无法处理这个请求。", "refusal"),
        ("Readers are unable to see drafts until review ends.", None), ('"Sorry, no capacity," was the note the scheduler left.', None),
        (PROMPT, "copy"), (PROMPT.split("\n\n")[1], "copy"), (PROMPT.split("\n\n")[1].upper(), "copy"), ("> " + PROMPT.split("\n\n")[1][:85], "copy"),
        ("The indexer (software) -[logs]-> the community tree (concept)", None), ("El indexador registra el árbol de grupos y la lista de los pasajes.", "wrong_language"),
        ("Anna Berg (person) -[knows]-> список синонимов без предупреждения (concept)", "wrong_language"),
        ("The indexer (software) -[logs]-> the comm", "truncated"), ('{"entities": [{"head": "The indexer", "rel', "truncated"), ('```json\n{"entities": []}\n```', None), ("# facts\nThe indexer (software) -[logs]-> it (concept)", None),
        ("The indexer keeps a list. Our team only half under", "truncated"), ("Yes", None), ("The indexer keeps a list. Our team only half under...", "truncated"), ("The indexer keeps a list of na…", "truncated"), ('The note said "wait..." and the indexer waits.', None),
    ],
)
def test_defects(response, defect):
    assert pd_.judge(PROMPT, response, pd_.seed_words()) == (defect, None)


def test_thai_endings_do_not_depend_on_white_space():
    assert pd_.judge(None, "ดัชนีสร้างรายการชื่อเสมอ", {}) == pd_.judge(None, "ดัชนีสร้างรายการชื่อเสมอ\n\u00a0", {}) == ("truncated", "ดัชนีสร้างรายการชื่อเสมอ"[-6:])


def test_defects_without_prompt_and_long():
    assert pd_.judge(None, "Short answer.", pd_.seed_words()) == (None, None)
    long = "The indexer logs odd ranges. " * 3_000
    assert pd_.judge("Tell:\n" + long, long, pd_.seed_words()) == ("copy", None)


@pytest.mark.parametrize(
    "text,units",
    [
        ("", []), (" \n\t ", []), (None, []),
        ("Dr. Smith logs it. See No. 4 vs. No. 5 at 9 p.m. The page stays.", ["Dr. Smith logs it.", "See No. 4 vs. No. 5 at 9 p.m.", "The page stays."]),
        ("He said: \"Stop. Now!\" The end.", ['He said: "Stop. Now!"', "The end."]),
        ("“Wait? Go!” was all he left. Next.", ["“Wait? Go!” was all he left.", "Next."]),
        ("It ends here.The next begins! ok... and then on", ["It ends here.", "The next begins!", "ok... and then on"]),
        ("# A heading. With dots\n- item one. still\ntext goes\non here.\n\nNew one", ["# A heading. With dots", "- item one. still", "text goes\non here.", "New one"]),
        ("检查了树（见图7.2。）。他说：“好。等！”然后停了。", ["检查了树（见图7.2。）。", "他说：“好。等！”然后停了。"]),
        ("「終わった。次だ！」と彼は言った。なぜ？", ["「終わった。次だ！」と彼は言った。", "なぜ？"]),
        ("वह गया। क्या वह आया? प्रो. सारवे आए।", ["वह गया।", "क्या वह आया?", "प्रो. सारवे आए।"]),
        ("รุ่นนี้ข้าม ทีมค้นหา", ["รุ่นนี้ข้าม", "ทีมค้นหา"]),
        ("Stand 4. März: es läuft. Siehe Nr. 7. Der Lauf endet.", ["Stand 4. März: es läuft.", "Siehe Nr. 7.", "Der Lauf endet."]),
        ("« Fini. Au suivant ! » écrit M. Dupont. Voilà !", ["« Fini. Au suivant ! » écrit M. Dupont.", "Voilà !"]),
        ("Das ist, z. B. Nr. 5, gut. Ende.", ["Das ist, z. B. Nr. 5, gut.", "Ende."]),
    ],
)
def test_sentence_units(text, units):
    found = sn.sentences(text, {"März": "noun", "#März": "noun"})
    assert [text[a:b] for a, b in found] == units


def test_the_document_decides_before_the_corpus():
    kind = lambda counts, given: sn.Judge({"Abt": counts}, {"Abt": given} if given else {}).kind("Abt")
    assert kind([0, 3, 3, 2], "abbr") == kind([0, 3, 3, 2], "last") == kind([0, 0, 1, 1], "abbr") == "word"
    assert kind([3, 0, 2, 0], "abbr") == kind([3, 0, 0, 0], "last") == "last" and kind([2, 1, 0, 0], None) == "abbr"
    # silent, or at odds with itself
    assert kind([0, 3, 0, 0], "abbr") == kind([2, 0, 1, 3], "abbr") == "abbr"
    text = "We open the Sekt.\n\nThe Sekt is cold. Pour the Sekt. Then drink.\n\nMore Sekt."
    units = [text[a:b] for a, b in sn.sentences(text, {"Sekt": "abbr"})]
    assert units == ["We open the Sekt.", "The Sekt is cold.", "Pour the Sekt.", "Then drink.", "More Sekt."]


def test_all_words_that_are_looked_up_are_asked_for():
    class Known(dict):
        def get(self, word, default=None):
            looked.add(word)
            return "noun" if word.startswith("#") else rng.choice(["abbr", "last", None])

    rng = random.Random(5)
    found = 0
    for _ in range(2000):
        text = "".join(rng.choice(["ab", "B", "Cd", ". ", ".", "!", '"', "(", ")", "\n", "\n\n", " ", "»", "«", "3", "4.", "/", "…", "¿", "- "]) for _ in range(rng.randint(0, 40)))
        looked = set()
        sn.sentences(text, Known({"x": "abbr"}))
        assert looked <= sn.asked_words(text)
        found += len(looked)
    assert found > 100 and {"bzgl", "#März"} <= sn.asked_words("Am 3./4. März bzgl.Haus und")


def test_sentences_cover_everything_but_blanks():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["a", "B", ". ", ".", "!", '"', "(", ")", "\n", "\n\n", " ", "。", "”", "“", "ก", "1", "…"]) for _ in range(rng.randint(0, 40)))
        spans = sn.sentences(text)
        assert all(a < b and not text[a].isspace() and not text[b - 1].isspace() for a, b in spans)
        assert all(x[1] <= y[0] and not text[x[1] : y[0]].strip() for x, y in zip(spans, spans[1:]))
        assert sum(len(text[a:b].split()) and len("".join(text[a:b].split())) for a, b in spans) == len("".join(text.split()))
