"""A store from notes to communities."""

from pyspark.sql import functions as F

from weftline.api import Store
from weftline.sources.catalog import Catalog


def test_store_end_to_end(spark, tmp_path):
    store = Store(Catalog(spark, str(tmp_path)), "notes")
    store.note("Alice works with Bob on weaving.")
    store.add_documents(spark.createDataFrame([(1, "Carol tests the loom.", "d"), (2, "Bob repairs the loom.", "e")], "doc_id long, text string, source string"))
    assert store.stats()["chunks"] == 3 and store.stats()["pending_extract"] == 3
    assert store.search("loom", 2).count() == 2
    ids = {r.content.split()[0]: r.id for r in store.catalog.read("chunks").collect()}
    replies = [(ids["Alice"], "m", "Alice (P) -[works_with]-> Bob (P)\nBob (P) -[employs]-> Alice (P)"), (ids["Carol"], "m", "Carol (P) -[tests]-> Loom (T)"), (ids["Bob"], "m", "bob (P) -[repairs]-> loom (T)")]
    store.apply("extract", spark.createDataFrame(replies, "chunk_id long, model string, response string").withColumn("received_at", F.current_timestamp()))
    assert store.plan("extract").count() == 0 and store.entities().count() == 4 and store.triples().count() == 4
    assert {r.canonical_relation for r in store.catalog.read("relations").collect()} == {None, "uses"}
    store.embed_entities()
    assert store.plan("embed").count() == 0 and store.find_merge_candidates(0.99).count() == 0
    store.detect_communities()
    assert store.communities().agg(F.sum("size")).first()[0] == 4 and store.plan("summarize").count() == store.communities().count()
    first = store.plan("summarize").first().community_id
    store.update_summary(first, "a group")
    assert store.status().where("phase = 'summarize'").first().done == 1
    assert store.query_global(1).count() == store.communities().count()
    grown = store.search("Alice", 1, expand=2)
    assert grown.where("rrf is null").count() >= 1
    names = {r.name: r.id for r in store.catalog.read("entities").collect()}
    store.merge(names["Alice"], names["Carol"])
    assert store.entities().count() == 3 and store.relations("Alice").count() == 3
    store.add_synonym("repairs", "fixes")
    assert store.refresh_canonical() == 2
    store.add_entities(spark.createDataFrame([(1, " ALICE ", None, "{}"), (2, "Dora", "p", None)], "seq long, name string, entity_type string, properties string"))
    assert store.entities().count() == 4
    assert store.export().where("ord = 2").count() == 4
    assert store.log(2).count() == 2
    store.catalog.delete_store("notes")
    assert store.catalog.read("entity_communities").count() == 0
