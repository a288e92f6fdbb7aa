"""Queries over planning, applying, status and capsules."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import capsules, pipeline
from weftline.operators.aggregates import history
from weftline.operators.joins import members_of_communities
from weftline.plans.tables import _FOLD
from weftline.plans.texts import _LINES
from weftline.plans.views import Views, with_views


def _capsule_rows(v):
    """A capsule table made of documents: one capsule a source, each document a version."""
    body = F.to_json(F.struct(F.col("doc_id").alias("id"), F.col("shape")))
    return v.t("documents").where("source is not null").select(
        F.col("doc_id").alias("id"), F.col("source").alias("capsule_id"), F.col("store").alias("project_id"), F.lit("project").alias("kind"),
        F.concat(F.lit("sha256:"), F.sha2(body, 256)).alias("content_fingerprint"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("generated_at"), body.alias("body"),
    )


def _capsules(v):
    """Capsules built from communities; those without a summary have no purpose and are faulty."""
    c = v.communities
    evidence = F.array(F.struct(F.concat(F.lit("ev-"), F.col("id").cast("string")).alias("evidence_id"), F.lit("file://facts").alias("uri"), F.lit("2026-01-01T00:00:00Z").alias("observed_at"), F.lit(None).cast("string").alias("fingerprint")))
    ids = F.array(F.concat(F.lit("ev-"), F.coalesce("parent_id", "id").cast("string")))
    step = F.lit("next")
    return c.select(
        F.lit(1).alias("schema_version"), F.concat(F.lit("community-"), F.col("id").cast("string")).alias("capsule_id"),
        F.struct(F.col("store").alias("project_id"), F.col("store").alias("display_name"), F.lit(None).cast("string").alias("repository"), F.array().cast("array<string>").alias("locations")).alias("project"),
        F.coalesce("summary", F.lit(" ")).alias("purpose"),
        F.array(F.struct(F.lit("it is so").alias("statement"), ids.alias("evidence"))).alias("verified_state"),
        F.array().cast(capsules.CAPSULE["decisions"].dataType).alias("decisions"), F.array().cast(capsules.CAPSULE["open_threads"].dataType).alias("open_threads"),
        F.array().cast(capsules.CAPSULE["commitments"].dataType).alias("commitments"), F.struct(step.alias("title"), step.alias("entry_point"), step.alias("first_action")).alias("next_segment"),
        evidence.alias("evidence"),
        F.struct(F.lit("2026-01-01T00:00:00Z").alias("generated_at"), F.concat(F.lit("sha256:"), F.sha2(F.col("store"), 256)).alias("source_fingerprint"), F.lit(None).cast("string").alias("stale_after"), F.array().cast("array<string>").alias("input_fingerprints")).alias("freshness"),
    )


def queries():
    q = {}

    def add(f):
        q[f.__name__] = lambda spark, root: f(Views(spark, root))
        return f

    @add
    def plan_extract_units(v):
        return pipeline.plan_extract(v.chunks, v.extractions, "m").select("unit_id", "chunk_id", "model", F.sha2("user_prompt", 256).alias("prompt"))

    @add
    def apply_extract(v):
        replies = v.replies.where("kind = 'extract' and chunk_id is not null")
        none = v.extractions.limit(0).select("chunk_id", F.lit(None).cast("string").alias("model"), F.lit(None).cast("bigint").alias("triple_count"))
        return pipeline.apply_extract(replies, v.chunks, none, v.synonyms)["extractions"].select("chunk_id", "model", "triple_count")

    @add
    def apply_extract_entities(v):
        replies = v.replies.where("kind = 'extract' and chunk_id is not null")
        none = v.extractions.limit(0).select("chunk_id", F.lit(None).cast("string").alias("model"), F.lit(None).cast("bigint").alias("triple_count"))
        return pipeline.apply_extract(replies, v.chunks, none, v.synonyms)["entities"]

    @add
    def plan_summarize_units(v):
        members = members_of_communities(v.entities, v.entity_communities).where("name is not null").select("community_id", "name", "entity_type")
        return pipeline.plan_summarize(v.communities, members, "m").select("unit_id", "community_id", F.sha2("user_prompt", 256).alias("prompt"))

    @add
    def apply_summarize(v):
        replies = v.replies.where("kind = 'summarize'")
        return pipeline.apply_summarize(v.communities, replies).select("id", "summary")

    @add
    def plan_embed(v):
        return pipeline.plan_embed(v.entities, v.entity_embeddings)

    @add
    def pipeline_status(v):
        status = pipeline.pipeline_status(v.chunks, v.extractions, v.entities, v.entity_embeddings, v.entity_communities, v.communities, v.stores)
        return status.select("store", "phase", "total", "done", "pending", "blocked", "ready", "blocked_by", "guidance")

    @add
    def next_step(v):
        return pipeline.next_step(pipeline.pipeline_status(v.chunks, v.extractions, v.entities, v.entity_embeddings, v.entity_communities, v.communities, v.stores))

    @add
    def capsule_latest(v):
        return capsules.latest_capsules(_capsule_rows(v)).select("capsule_id", "id", "content_fingerprint")

    @add
    def capsule_history(v):
        return history(_capsule_rows(v), "capsule_id", "wiki_pages").select("id", "content_fingerprint")

    @add
    def capsule_dedupe_put(v):
        rows = _capsule_rows(v)
        body = F.to_json(F.struct("shape"))
        fresh = rows.drop("body", "content_fingerprint").join(v.t("documents").select(F.col("doc_id").alias("id"), "shape"), "id").withColumn("body", body).withColumn("content_fingerprint", F.concat(F.lit("sha256:"), F.sha2("body", 256)))
        return capsules.put_capsules(rows.limit(0), fresh.select(*rows.columns)).select("id", "capsule_id", "content_fingerprint")

    @add
    def capsule_verified(v):
        return capsules.verified_capsules(_capsule_rows(v)).select("id", "body")

    @add
    def capsule_validate(v):
        return _capsules(v).select("capsule_id", capsules.capsule_error().alias("error"))

    @add
    def capsule_fingerprint(v):
        return capsules.capsule_references(_capsules(v)).select("capsule_id", "uri", "content_fingerprint")

    return q


_BODY = "('{\"id\":' || doc_id || ',\"shape\":\"' || shape || '\"}')"
_SHAPE = "('{\"shape\":\"' || shape || '\"}')"


_STATUS = """
            WITH s AS (SELECT name AS store,
                (SELECT count(*) FROM v_chunks WHERE store = st.name) AS c, (SELECT count(*) FROM v_chunks WHERE store = st.name AND id NOT IN (SELECT chunk_id FROM v_extractions)) AS todo,
                (SELECT count(*) FROM v_entities WHERE store = st.name) AS e, (SELECT count(*) FROM v_entities WHERE store = st.name AND id NOT IN (SELECT entity_id FROM v_entity_embeddings)) AS bare,
                (SELECT count(*) FROM v_entities WHERE store = st.name AND id NOT IN (SELECT entity_id FROM v_entity_communities)) AS loose,
                (SELECT count(*) FROM v_communities WHERE store = st.name) AS g, (SELECT count(*) FROM v_communities WHERE store = st.name AND summary IS NOT NULL) AS w,
                (SELECT count(*) FROM v_communities c WHERE store = st.name AND summary IS NULL AND id NOT IN (SELECT parent_id FROM v_communities WHERE summary IS NULL AND parent_id IS NOT NULL)) AS nx
                FROM stores st)
"""


_TRIM = "regexp_replace({0}, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g')"
#: The triples of each extraction reply: lines, or the objects of a JSON reply of which all are whole.
_REPLIES = f"""{_LINES},
    b AS (SELECT seq, chunk_id, regexp_matches(trim(coalesce(response, '')), '^(```|\\{{)') AS isj, trim(regexp_replace(regexp_replace(trim(response), '^```(?:json)?\\s*', ''), '\\s*```$', '')) AS j
          FROM v_replies WHERE kind = 'extract' AND chunk_id IS NOT NULL),
    o AS (SELECT seq, j, coalesce(json_array_length(j, '$.entities'), 0)::BIGINT AS n FROM b WHERE isj AND starts_with(j, '{{') AND json_valid(j)),
    items AS (SELECT seq, i AS pos, json_extract(j, '$.entities[' || i || ']') AS t FROM (SELECT seq, j, unnest(range(n)) AS i FROM o)),
    whole AS (SELECT seq FROM items GROUP BY 1 HAVING bool_and(coalesce(t->>'head', t->>'relation', t->>'tail') IS NOT NULL AND t->>'head' IS NOT NULL AND t->>'relation' IS NOT NULL AND t->>'tail' IS NOT NULL)),
    found AS (
        SELECT seq AS rseq, pos, head, head_type, relation, tail, tail_type FROM e WHERE head <> '' AND relation <> '' AND tail <> '' AND seq IN (SELECT seq FROM b WHERE NOT isj) UNION ALL
        SELECT seq, pos, t->>'head', t->>'head_type', t->>'relation', t->>'tail', t->>'tail_type' FROM items WHERE seq IN (SELECT seq FROM whole))"""


def oracle_sql() -> dict[str, str]:
    raw = {
        "plan_extract_units": """
            WITH p AS (SELECT * FROM v_chunks WHERE id NOT IN (SELECT chunk_id FROM v_extractions))
            SELECT 'extract:chunk:' || id AS unit_id, id AS chunk_id, 'm' AS model,
                sha256('Passage ' || row_number() OVER (PARTITION BY store ORDER BY id) || ' of ' || count(*) OVER (PARTITION BY store) || ':' || chr(10) || chr(10) || content) AS prompt FROM p""",
        "apply_extract": f"""
            WITH {_REPLIES}, n AS (SELECT rseq, count(*) AS n FROM found GROUP BY 1),
            last AS (SELECT chunk_id, max(seq) AS seq FROM v_replies WHERE kind = 'extract' AND chunk_id IS NOT NULL GROUP BY 1)
            SELECT r.chunk_id, r.model, coalesce(n, 0) AS triple_count FROM v_replies r JOIN last USING (chunk_id, seq) LEFT JOIN n ON rseq = r.seq WHERE r.kind = 'extract'""",
        "apply_extract_entities": f"""
            WITH {_REPLIES},
            placed AS (SELECT c.store, f.*, row_number() OVER (ORDER BY rseq, pos) AS place FROM found f JOIN v_replies r ON r.seq = rseq JOIN v_chunks c ON c.id = r.chunk_id),
            w AS (SELECT * FROM placed WHERE trim(head) <> '' AND trim(tail) <> '' AND trim(relation) <> ''),
            m AS (SELECT store, place * 2 AS seq, head AS name, head_type AS t FROM w UNION ALL SELECT store, place * 2 + 1, tail, tail_type FROM w)
            SELECT min(seq) AS id, store, arg_min({_TRIM.format('name')}, seq) AS name, arg_max(t, CASE WHEN t IS NOT NULL THEN seq END) AS entity_type, NULL::VARCHAR AS properties
            FROM m WHERE {_FOLD.format('name')} <> '' GROUP BY store, {_FOLD.format('name')}""",
        "plan_summarize_units": """
            WITH ready AS (SELECT * FROM v_communities c WHERE summary IS NULL AND NOT EXISTS (SELECT 1 FROM v_communities k WHERE k.parent_id = c.id AND k.summary IS NULL)),
            n AS (SELECT community_id, string_agg(CASE WHEN coalesce(entity_type, '') = '' THEN name ELSE name || ' (' || entity_type || ')' END, chr(10)
                  ORDER BY CASE WHEN coalesce(entity_type, '') = '' THEN name ELSE name || ' (' || entity_type || ')' END) AS lines
                  FROM v_entity_communities JOIN v_entities ON entity_id = id WHERE name IS NOT NULL GROUP BY 1),
            b AS (SELECT parent_id, string_agg('- ' || summary, chr(10) ORDER BY id) AS below FROM v_communities WHERE parent_id IS NOT NULL AND summary IS NOT NULL GROUP BY 1)
            SELECT 'summarize:community:' || id AS unit_id, id AS community_id, sha256('Summarise what joins this group:' || chr(10) ||
                CASE WHEN id IN (SELECT parent_id FROM v_communities WHERE parent_id IS NOT NULL) THEN coalesce(below, '') ELSE coalesce(lines, '') END) AS prompt
            FROM ready LEFT JOIN n ON n.community_id = id LEFT JOIN b ON b.parent_id = id""",
        "apply_summarize": r"""
            WITH r AS (SELECT community_id, arg_max(regexp_replace(response, '^[\s\pZ]+|[\s\pZ]+$', '', 'g'), seq) AS s FROM v_replies WHERE kind = 'summarize' AND community_id IS NOT NULL AND response IS NOT NULL GROUP BY 1)
            SELECT id, coalesce(s, summary) AS summary FROM v_communities LEFT JOIN r ON community_id = id""",
        "plan_embed": "SELECT id AS entity_id, CASE WHEN coalesce(entity_type, '') = '' THEN name ELSE name || ' (' || entity_type || ')' END AS text FROM v_entities WHERE id NOT IN (SELECT entity_id FROM v_entity_embeddings)",
        "pipeline_status": _STATUS + """
            SELECT store, 'extract' AS phase, c AS total, c - todo AS done, todo AS pending, 0::BIGINT AS blocked, todo > 0 AS ready, NULL AS blocked_by,
                CASE WHEN c = 0 THEN 'no chunks: add documents' WHEN todo > 0 THEN todo || ' chunks to extract' ELSE 'every chunk is extracted' END AS guidance FROM s UNION ALL
            SELECT store, 'embed', e, e - bare, bare, 0, bare > 0, CASE WHEN e = 0 THEN 'extract' END,
                CASE WHEN e = 0 THEN 'no entities: extract first' WHEN bare > 0 THEN bare || ' entities to embed' ELSE 'every entity is embedded' END FROM s UNION ALL
            SELECT store, 'communities', e, e - loose, loose, 0, loose > 0, CASE WHEN e = 0 THEN 'extract' END,
                CASE WHEN e = 0 THEN 'no entities: extract first' WHEN loose > 0 THEN loose || ' entities in no community' ELSE 'every entity is in a community' END FROM s UNION ALL
            SELECT store, 'summarize', g, w, nx, g - w - nx, nx > 0, CASE WHEN g = 0 THEN 'communities' END,
                CASE WHEN g = 0 THEN 'no communities: detect them first' WHEN nx > 0 THEN nx || ' communities to summarise' WHEN g - w > 0 THEN (g - w) || ' communities wait for their children'
                ELSE 'every community is summarised' END FROM s""",
        "next_step": _STATUS + """
            SELECT store, CASE WHEN todo > 0 THEN todo || ' chunks to extract' WHEN bare > 0 THEN bare || ' entities to embed' WHEN loose > 0 THEN loose || ' entities in no community'
                WHEN nx > 0 THEN nx || ' communities to summarise' ELSE 'nothing is pending' END AS next FROM s""",
        "capsule_latest": f"SELECT source AS capsule_id, max(doc_id) AS id, arg_max('sha256:' || sha256({_BODY}), doc_id) AS content_fingerprint FROM documents WHERE source IS NOT NULL GROUP BY 1",
        "capsule_history": f"SELECT doc_id AS id, 'sha256:' || sha256({_BODY}) AS content_fingerprint FROM documents WHERE source = 'wiki_pages'",
        "capsule_dedupe_put": f"SELECT min(doc_id) AS id, source AS capsule_id, 'sha256:' || sha256({_SHAPE}) AS content_fingerprint FROM documents WHERE source IS NOT NULL GROUP BY 2, 3",
        "capsule_verified": f"SELECT doc_id AS id, {_BODY} AS body FROM documents WHERE source IS NOT NULL",
        "capsule_validate": r"""
            SELECT 'community-' || id AS capsule_id, CASE WHEN NOT regexp_matches(coalesce(summary, ' '), '[^\s\pZ]') THEN 'empty_text:purpose'
                WHEN parent_id IS NOT NULL AND parent_id <> id THEN 'dangling_evidence:verified_state' END AS error FROM v_communities""",
        "capsule_fingerprint": r"""
            SELECT 'community-' || id AS capsule_id, 'weftline://capsules/v1/project/community-' || id AS uri, 'sha256:' || sha256(
                '{"schema_version":1,"capsule_id":"community-' || id || '","project":{"project_id":"' || store || '","display_name":"' || store || '","locations":[]},"purpose":' || to_json(summary)::VARCHAR ||
                ',"verified_state":[{"statement":"it is so","evidence":["ev-' || id || '"]}],"decisions":[],"open_threads":[],"commitments":[],"next_segment":{"title":"next","entry_point":"next","first_action":"next"},' ||
                '"evidence":[{"evidence_id":"ev-' || id || '","uri":"file://facts","observed_at":"2026-01-01T00:00:00Z"}],"freshness":{"generated_at":"2026-01-01T00:00:00Z","source_fingerprint":"sha256:' || sha256(store) ||
                '","input_fingerprints":[]}}') AS content_fingerprint FROM v_communities
            WHERE regexp_matches(coalesce(summary, ' '), '[^\s\pZ]') AND (parent_id IS NULL OR parent_id = id)""",
    }
    return {name: with_views(body) for name, body in raw.items()}
