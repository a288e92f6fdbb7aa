"""The store's calls, the command line, strategies, formatting and capsules."""

import json

import pytest
from pyspark.sql import functions as F

from weftline import cli
from weftline.api import Store
from weftline.functions import parsing, spans
from weftline.operators import capsules, formatting, listing, pipeline, strategies
from weftline.sources import ingest, jsonl
from weftline.sources.catalog import Catalog, InvalidCapsule, StoreNotFound

from .test_operators import capsule

LINE = "Alice (Person) -[uses]-> GraphDB (Software)"


class Script:
    """A model that answers by what the prompt holds."""

    def __init__(self, rules):
        self.rules = rules

    def chat(self, system, user):
        for part, answer in self.rules:
            if part in user:
                if answer is None:
                    raise OSError("down")
                return answer
        return ""


def test_strategies(spark):
    assert strategies.strategy_for("NVIDIA/Nemotron-x").name == "json" and strategies.strategy_for("qwen").name == strategies.strategy_for(None).name == "lines"
    chunks = spark.createDataFrame([(3, "t", "c3"), (1, "s", "c1"), (2, "s", "c2"), (9, None, "c9")], "id long, store string, content string")
    none = spark.createDataFrame([], "chunk_id long, model string, triple_count long")
    units = {r.chunk_id: r for r in pipeline.plan_extract(chunks, none, "nemotron").collect()}
    assert units[2].user_prompt == "Passage 2 of 2:\n\nc2" and units[3].user_prompt == "Passage 1 of 1:\n\nc3" and units[9].user_prompt.startswith("Passage 1 of 1")
    assert json.loads(units[1].format)["required"] == ["entities"] and pipeline.plan_extract(chunks, none, "m").first().format is None
    assert pipeline.plan_extract(chunks, none, "m", strategy=strategies.JSON).first().format
    body = strategies.chat_request("m", "s", "u", strategies.JSON)
    assert body["messages"][0]["role"] == "system" and body["format"]["type"] == "object" and "format" not in strategies.chat_request("m", None, "u", strategies.LINES)
    row = chunks.select(strategies.by_model(F.lit("nemotron"), lambda s: s.name).alias("a"), strategies.by_model(F.lit(None).cast("string"), lambda s: s.format).alias("b")).first()
    assert row.a == "json" and row.b is None
    # a reply is read in the form of the strategy, or of its row's model
    replies = spark.createDataFrame([(1, 1, "nemotron", LINE), (2, 2, "m", LINE), (3, 3, "nemotron", '{"entities": [{"head": "a", "relation": "b", "tail": "c"}]}')], "seq long, chunk_id long, model string, response string")
    synonyms = spark.createDataFrame([], "raw string, canonical string")
    got = lambda strategy: {r.chunk_id: r.triple_count for r in pipeline.apply_extract(replies, chunks, none, synonyms, strategy=strategy)["extractions"].collect()}
    assert got("model") == {1: 0, 2: 1, 3: 1} and got(strategies.LINES) == {1: 1, 2: 1, 3: 0} and got(None) == {1: 1, 2: 1, 3: 1}


def test_python_parsing_is_the_same(spark):
    texts = [LINE, "", None, "# remark\n%%%\n" + LINE + "\nExample: x", "a -[b]-> c", "Graph DB (v2) (Tool) -[ is ]-> x ()", " -[b]-> c", '{"entities": [{"head": "a", "relation": "b", "tail": "c", "tail_type": null}]}', '{"entities": []}', "{}", '{"entities": [{"head": "a"}]}', '{"entities": [{', '```json\n{"entities": [{"head": "a", "relation": "b", "tail": "c"}]}\n```', "[1]"]
    for as_json in (True, False):
        rows = spark.createDataFrame(list(enumerate(texts)), "i int, response string")
        for r in parsing.parse_replies(rows, F.lit(as_json)).collect():
            assert ([tuple(t) for t in r.triples], r.malformed) == parsing.python_triples(texts[r.i], as_json), (texts[r.i], as_json)


def test_reflection(spark):
    units = spark.createDataFrame([(f"extract:chunk:{i}", "extract", i, m, "sys", f"Passage {i} of 4:\n\n{t}") for i, m, t in [(1, "m", "one"), (2, "m", "two"), (3, "m", "three"), (4, "nemotron", "four")]], "unit_id string, kind string, chunk_id long, model string, system_prompt string, user_prompt string")
    client = Script([
        ("Known already: Alice, GraphDB, Bob, Carol", "nothing more"), ("Known already: Alice, GraphDB", "Bob -[knows]-> Carol"), ("Passage:\n\none", "Yes, some."),
        ("Passage 1", LINE), ("Passage 2", "nothing"), ("Passage 3", None), ("Passage:\n\nfour", "no"), ("Passage 4", '{"entities": [{"head": "a", "relation": "b", "tail": "c"}]}'),
    ])
    got = {r.chunk_id: r.response for r in ingest.extract_with_reflection(units, client).collect()}
    assert set(got) == {1, 2, 4} and got[1] == LINE + "\nBob -[knows]-> Carol" and got[2] == "nothing" and json.loads(got[4])["entities"][0]["tail"] == "c"
    assert {r.chunk_id: r.response for r in ingest.ask_models(units, client).collect()}[1] == LINE


def test_store_surface(spark, tmp_path):
    store = Store(Catalog(spark, str(tmp_path)), "s")
    store.add_documents(spark.createDataFrame([(1, "Alice uses GraphDB.", "a"), (2, "Bob is out.", "b"), (3, "Carol knows Alice.", None)], "doc_id long, text string, source string"))
    client = Script([("Summarise", " a group "), ("Alice uses", LINE), ("Bob", None), ("Carol", "Carol (Person) -[knows]-> Alice (Person)")])
    assert store.extract_all(client, "m") == 2 and store.plan("extract").count() == 1
    # the chunk about which the model failed is still to be done, and nothing is done twice
    assert store.extract_all(Script([("Bob", "")]), "m") == 0 and store.plan("extract").count() == 0 and store.entities().count() == 3
    seen = store.preview_communities().collect()
    assert sum(r.size for r in seen) == 3 and store.communities().count() == 0 and sorted(seen[0].names)[0] == "Alice"
    store.detect_communities(hierarchical=True)
    first = store.communities().first()
    detail = store.community(first.id)
    assert detail["entity_count"] == len(detail["entities"]) == first["size"] and detail["children"] == [] and {e["type"] for e in detail["entities"]} <= {"Person", "Software"}
    with pytest.raises(listing.NotFound):
        store.community(999)
    text = {r.community_id: r.text for r in store.community_contexts().collect()}[first.id]
    assert text.startswith("Entities in this community:\n- Alice (Person)\n  -> ")
    assert store.summarize_all(client) == 1 and store.community(first.id)["summary"] == "a group"
    shown = store.search_text("Carol", 2)
    assert shown.index("Carol knows") > 0 and "(score: 0." in shown
    again = Store(Catalog(spark, str(tmp_path)), "s", create=False)
    assert [r.chunk_id for r in again.search("Carol", 1).collect()] == [r.chunk_id for r in store.search("Carol", 1).collect()]
    injected = Store(store.catalog, "s", vector_source=lambda q, k: spark.createDataFrame([(2, 0.9)], "chunk_id long, score double"))
    assert {r.chunk_id for r in injected.search("zzz", 3).collect()} == {2}
    assert store.catalog.info()["tables"]["chunks"] == 1


def test_add_code(spark, tmp_path):
    store = Store(Catalog(spark, str(tmp_path)), "s")
    source = "def f():\n    return 1\n\n\ndef g():\n    return 2\n"
    rows = spark.createDataFrame([(1, source, "a/b.py"), (2, "no code (", "c.py")], "doc_id long, text string, source string")
    assert {(r.source, r.id) for r in store.add_code(rows, max_bytes=25).collect()} == {("a/b.py#chunk1", 1), ("a/b.py#chunk2", 2), ("c.py", 3)}
    with pytest.raises(spans.ChunkError, match="notes.txt"):
        store.add_code(rows.withColumn("source", F.lit("notes.txt")))
    assert store.add_code(rows.where("doc_id = 1").withColumn("source", F.lit("script")), "Python", 25).count() == 2


def test_formatting(spark):
    hits = spark.createDataFrame([(7, "b text", None, 0.25), (3, "a text", "src", 0.5), (9, "grown", "g", None)], "chunk_id long, content string, source string, rrf double")
    assert [r.text.split("\n")[0] for r in formatting.format_hits(hits).orderBy("place").collect()] == ["### [src] (score: 0.500)", "### [unknown] (score: 0.250)", "### [g]"]
    members = spark.createDataFrame([(1, 1, "B", None), (1, 2, "A", "T"), (2, 3, "C", "T")], "community_id long, id long, name string, entity_type string")
    rel = spark.createDataFrame([(1, 2, "r"), (2, 3, "out"), (1, 1, "self")], "head_id long, tail_id long, relation string")
    assert {r.community_id: r.text for r in formatting.community_contexts(members, rel).collect()} == {1: "Entities in this community:\n- A (T)\n  -> r -> B\n- B (unknown)\n  -> r -> A\n  -> self -> B", 2: "Entities in this community:\n- C (T)"}


def test_cut_source():
    text = "alpha one\nbeta two\ngamma three\n"
    assert [s["text"] for s in spans.cut_source(text, size=10, lines=True, code=True)] == ["alpha one\n", "beta two\n", "gamma three\n"]
    one = spans.cut_source(text, size=10, lines=True, nth=1, expand=1)
    assert [s["text"] for s in one] == [text] and spans.cut_source(text, size=10, lines=True, nth=1, expand=-5)[0]["text"]
    source = "def f():\n    return 1\n\n\ndef g():\n    return 2\n"
    assert len(spans.cut_source(source, "x.py", 30, code=True)) == len(spans.cut_source(source, "x", 30, language="Python")) == 2
    for bad in (dict(language="cobol"), dict(nth=99), dict(language="py", code=True, text="def (:\n")):
        with pytest.raises(spans.ChunkError):
            spans.cut_source(**({"text": source, "size": 30} | bad))
    assert spans.cut_source("# a\n\nb", "x.md") and "⏎" in formatting.review_spans(spans.cut_source(text, size=100)) and spans.cut_source("") == []


def test_capsule_store(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path))
    table = lambda *rows: spark.createDataFrame(list(rows), capsules.CAPSULE)
    ref = cat.put_capsules(table(capsule())).first()
    assert ref.uri.endswith("/c-1") and cat.put_capsules(table(capsule())).first().content_fingerprint == ref.content_fingerprint and cat.read("capsules").count() == 1
    with pytest.raises(InvalidCapsule, match="c-1: empty_text:purpose"):
        cat.put_capsules(table(capsule(), capsule(purpose=" ")))
    cat.put_capsules(table(capsule(purpose="other"), capsule(capsule_id="c-2", project=capsule()["project"] | {"project_id": "q"})))
    assert json.loads(cat.capsule_body("c-1"))["purpose"] == "other" and json.loads(cat.capsule_body("c-1", ref.content_fingerprint))["purpose"].startswith("why")
    assert cat.capsule_body("none") is None and cat.capsule_body("c-1", "sha256:0") is None
    assert [r.id for r in cat.capsule_history("c-1").collect()] == sorted([r.id for r in cat.capsule_history("c-1").collect()], reverse=True) and cat.capsule_history("c-1").count() == 2
    assert [r.capsule_id for r in cat.list_capsules().collect()] == ["c-1", "c-2"] and [r.capsule_id for r in cat.list_capsules("q").collect()] == ["c-2"]


def test_command_line(spark, tmp_path, capsys):
    def run(*argv):
        code = cli.main(["--data", str(tmp_path / "db"), *argv], spark)
        out = capsys.readouterr()
        return code, out.out.strip(), out.err.strip()

    # unknown stores fail, and are not made by asking
    for argv in (["ask", "x"], ["plan", "extract"], ["status"], ["export"], ["log"], ["enrich"]):
        code, out, err = run(*argv)
        assert code == 1 and out == "" and "no store default" in err
    assert run("note", "Alice uses GraphDB.", "--source", "me")[:2] == (0, "1") and run("note", "Bob rests.")[1] == "2"
    unit = json.loads(run("plan", "extract", "--limit", "1")[1])
    assert unit["unit_id"] == "extract:chunk:1" and unit["system_prompt"]
    replies = tmp_path / "r.jsonl"
    replies.write_text("\n" + json.dumps({"chunk_id": 1, "model": "m", "response": LINE}) + "\n\n")
    assert run("apply", "extract", str(replies))[1] == "1" and run("apply", "extract", str(replies))[1] == "0"
    assert json.loads(run("plan", "extract")[1])["chunk_id"] == 2 and run("embed")[1] == "2" and run("enrich")[1] == "1"
    assert "Alice uses" in run("ask", "Alice")[1] and run("log", "--limit", "1")[1].endswith("Bob rests.")
    assert json.loads(run("status", "--json")[1].split("\n")[0])["phase"] == "extract" and "1/2" in run("status")[1]
    assert [json.loads(x)["record"] for x in run("export")[1].split("\n")] == ["store", "chunk", "chunk", "entity", "entity", "relation", "community"]
    assert json.loads(run("stores")[1])["name"] == "default" and json.loads(run("info")[1])["commit"] > 3
    assert run("backfill-embeddings")[0] == 0
    bad = tmp_path / "bad.jsonl"
    bad.write_text("no json\n")
    with pytest.raises(Exception, match="not JSON"):
        run("apply", "extract", str(bad))
    file = tmp_path / "x.py"
    file.write_text("def f():\n    return 1\n")
    assert run("chunk", str(file), "--code")[1].split("\n")[1].startswith("0\t0\t22\t1\t2\t22\txxh3:") and json.loads(run("chunk", str(file), "--format", "json", "--nth", "0")[1])["text"].startswith("def f")
    assert run("chunk", str(file), "--nth", "5")[0] == 1 and run("chunk", str(tmp_path / "none"))[0] == 1 and "lines" in run("chunk", str(file), "--format", "review")[1]


def test_unknown_store_and_files(spark, tmp_path):
    with pytest.raises(StoreNotFound):
        Store(Catalog(spark, str(tmp_path / "db")), "none", create=False)
    units = spark.createDataFrame([("u", 1)], "unit_id string, chunk_id long")
    jsonl.write_units(units, str(tmp_path / "units"))
    assert jsonl.read_replies(spark, str(tmp_path / "units"), "unit_id string, chunk_id long").first().unit_id == "u"
    lines = spark.createDataFrame([(1, 2, "b"), (0, 1, "a")], "ord int, id long, json string")
    jsonl.write_lines(lines, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["a", "b"]
    (tmp_path / "t.txt").write_text("one\ntwo\n")
    assert jsonl.read_texts(spark, str(tmp_path / "t.txt")).first().text == "one\ntwo\n"
