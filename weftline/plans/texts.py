"""Queries over text functions, spans and parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import hashing, parsing, spans, text
from weftline.plans.views import Views, with_views


#: White space as both regular expression languages have it.
_WHITE = r"[\t\n\x{0B}\f\r\x{1C}-\x{1F}\x{85}\p{Z}]+"


def _joined(text: str):
    """Hash of a source's spans put together in order."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", text))), lambda x: x[text]), ""), 256)


def queries():
    q = {}

    def add(f):
        q[f.__name__] = lambda spark, root: f(Views(spark, root))
        return f

    @add
    def parse_triples(v):
        lines = v.replies.where("kind = 'extract'").select("seq", F.posexplode(parsing.triple_lines(F.col("response"))).alias("pos", "line"))
        parsed = lines.select("seq", "pos", parsing.parse_triple_line(F.col("line")).alias("t")).where("t is not null")
        return parsed.select("seq", "t.*")

    @add
    def parse_malformed_counts(v):
        parsed = parsing.parse_replies(v.replies.where("kind = 'extract'"))
        return parsed.select("seq", F.size("triples").cast("bigint").alias("n_triples"), F.col("malformed").cast("bigint").alias("malformed"))

    @add
    def parse_json_reply(v):
        return v.replies.where("kind = 'extract'").select("seq", F.coalesce(F.size(parsing.json_reply(F.col("response"))), F.lit(-1)).cast("bigint").alias("n"))

    @add
    def strategy_route(v):
        return v.replies.select("seq", F.when(parsing.wants_json(F.col("model")), "json").otherwise("lines").alias("strategy"))

    @add
    def lang_detect(v):
        return v.t("documents").select("doc_id", text.language_of_path(F.col("origin_path")).alias("language"))

    @add
    def markdown_sniff(v):
        return v.chunks.select("id", text.looks_like_markdown(F.col("content")).alias("markdown"))

    @add
    def source_labels(v):
        s = v.t("chunk_spans").select("span_id", "source", "span_index").distinct()
        total = s.where("source is not null").groupBy("source").agg(F.count("*").alias("total"))
        return s.join(total, "source", "left").select("span_id", text.source_label(F.col("source"), F.col("span_index"), F.coalesce("total", F.lit(1))).alias("label"))

    @add
    def previews(v):
        return v.chunks.select("id", text.preview(F.col("content"), 48).alias("preview"))

    @add
    def json_values(v):
        value = text.json_value(F.col("properties"))
        return v.entities.select("id", value.isNotNull().alias("is_json"), F.try_variant_get(value, "$.note", "string").alias("note"), F.try_variant_get(value, "$.weight", "double").alias("weight"))

    @add
    def sha256_fingerprint(v):
        return v.chunks.select("id", hashing.sha256_fingerprint(F.col("content")).alias("fingerprint"))

    @add
    def xxh3_fingerprint(v):
        return v.chunks.select("id", hashing.fingerprint(F.col("content")).alias("fingerprint"), hashing.fingerprint_wide(F.col("content")).alias("wide"))

    @add
    def line_spans(v):
        # nothing is lost: the spans put together are the source
        found = spans.line_span_documents(v.t("documents"), max_bytes=500)
        return found.groupBy("doc_id").agg(_joined("text").alias("text"), F.max("line_end").cast("bigint").alias("lines"))

    @add
    def line_span_rows(v):
        found = spans.line_span_documents(v.t("documents"), max_bytes=500)
        return found.select("doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("index", "start", "end", "line_start", "line_end")])

    @add
    def text_spans(v):
        return spans.chunk_documents(v.t("documents"))

    @add
    def text_span_cover(v):
        # the spans put together are the text but for white space
        found = spans.chunk_documents(v.t("documents"))
        whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", "text"))), lambda x: x["text"]), "")
        return found.groupBy("doc_id").agg(F.sha2(F.regexp_replace(whole, _WHITE, ""), 256).alias("text"))

    @add
    def code_span_cover(v):
        return spans.code_span_documents(v.t("documents").where("shape = 'code'")).groupBy("doc_id").agg(_joined("text").alias("text"))

    @add
    def window_spans(v):
        # every window stands in its text and is within the limit; the first begins it
        found = spans.window_documents(v.t("documents"), most=500).join(v.t("documents").select("doc_id", F.col("text").alias("whole")), "doc_id")
        good = F.col("whole").contains(F.col("text")) & (F.length("text") <= 500) & ((F.col("index") > 0) | F.startswith("whole", "text"))
        return found.groupBy("doc_id").agg(F.bool_and(good).alias("good"))

    @add
    def code_spans(v):
        return spans.code_span_documents(v.t("documents").where("shape = 'code'"))

    @add
    def verified_chunk(v):
        # a stale fingerprint in the table shows as a mismatch
        s = v.t("chunk_spans").select("span_id", "text", "fingerprint").distinct()
        return s.select("span_id", spans.span_status(F.col("text"), F.col("fingerprint"), hashing.sha256_fingerprint(F.col("text"))).alias("status"))

    @add
    def sed_ranges(v):
        return v.t("chunk_spans").select("span_id", spans.sed_range(F.col("line_start"), F.col("line_end")).alias("range")).distinct()

    return q


_LINES = r"""
    l AS (SELECT seq, row_number() OVER () AS pos, regexp_replace(line, '^[\s\pZ]+|[\s\pZ]+$', '', 'g') AS line FROM (SELECT seq, unnest(string_split(coalesce(response, ''), chr(10))) AS line FROM v_replies WHERE kind = 'extract')),
    k AS (SELECT * FROM l WHERE line <> '' AND NOT starts_with(line, '#') AND NOT starts_with(line, '//') AND NOT starts_with(line, 'Example')),
    c AS (SELECT seq, pos, line, CASE WHEN instr(line, ']->') > 0 THEN substr(line, 1, instr(line, ']->') - 1) END AS a,
                 CASE WHEN instr(line, ']->') > 0 THEN trim(substr(line, instr(line, ']->') + 3)) END AS b FROM k),
    d AS (SELECT seq, pos, CASE WHEN instr(a, '-[') > 0 THEN trim(substr(a, 1, instr(a, '-[') - 1)) END AS h, CASE WHEN instr(a, '-[') > 0 THEN trim(substr(a, instr(a, '-[') + 2)) END AS relation, b AS t FROM c),
    e AS (SELECT seq, pos, relation,
        CASE WHEN h LIKE '%(%)' THEN trim(regexp_extract(h, '^((?s).*)\(', 1)) ELSE h END AS head, CASE WHEN h LIKE '%(%)' THEN nullif(trim(regexp_extract(h, '^(?s).*\((.*)\)$', 1)), '') END AS head_type,
        CASE WHEN t LIKE '%(%)' THEN trim(regexp_extract(t, '^((?s).*)\(', 1)) ELSE t END AS tail, CASE WHEN t LIKE '%(%)' THEN nullif(trim(regexp_extract(t, '^(?s).*\((.*)\)$', 1)), '') END AS tail_type FROM d)"""


def oracle_sql() -> dict[str, str]:
    raw = {
        "parse_triples": f"WITH {_LINES} SELECT seq, head, head_type, relation, tail, tail_type FROM e WHERE head <> '' AND relation <> '' AND tail <> ''",
        "parse_json_reply": r"""
            WITH b AS (SELECT seq, trim(regexp_replace(regexp_replace(trim(response), '^```(?:json)?\s*', ''), '\s*```$', '')) AS j FROM v_replies WHERE kind = 'extract')
            SELECT seq, CASE WHEN j IS NOT NULL AND starts_with(j, '{') AND json_valid(j) THEN coalesce(json_array_length(j, '$.entities'), 0) ELSE -1 END::BIGINT AS n FROM b""",
        "parse_malformed_counts": f"""
            WITH {_LINES}, g AS (SELECT seq, count(*) FILTER (WHERE head <> '' AND relation <> '' AND tail <> '') AS n, count(*) AS total FROM e GROUP BY 1),
            r AS (SELECT seq, regexp_matches(trim(coalesce(response, '')), '^(```|\\{{)') AS isj,
                trim(regexp_replace(regexp_replace(trim(response), '^```(?:json)?\\s*', ''), '\\s*```$', '')) AS j FROM v_replies WHERE kind = 'extract'),
            o AS (SELECT seq, isj, coalesce(json_valid(j) AND starts_with(j, '{{'), false) AS valid, CASE WHEN json_valid(j) THEN j ELSE '{{}}' END AS j FROM r),
            m AS (SELECT seq, isj, coalesce(json_array_length(j, '$.entities'), 0) AS n_items, valid AND len(json_extract(j, '$.entities[*].head')) = coalesce(json_array_length(j, '$.entities'), 0)
                AND len(json_extract(j, '$.entities[*].relation')) = coalesce(json_array_length(j, '$.entities'), 0) AND len(json_extract(j, '$.entities[*].tail')) = coalesce(json_array_length(j, '$.entities'), 0) AS ok FROM o)
            SELECT m.seq, (CASE WHEN isj THEN CASE WHEN ok THEN n_items ELSE 0 END ELSE coalesce(n, 0) END)::BIGINT AS n_triples,
                (CASE WHEN isj THEN CASE WHEN ok THEN 0 ELSE 1 END ELSE coalesce(total - n, 0) END)::BIGINT AS malformed FROM m LEFT JOIN g ON g.seq = m.seq""",
        "json_values": """
            SELECT id, coalesce(json_valid(properties), false) AS is_json, CASE WHEN json_valid(properties) THEN json_extract_string(properties, '$.note') END AS note,
                CASE WHEN json_valid(properties) THEN try_cast(json_extract_string(properties, '$.weight') AS DOUBLE) END AS weight FROM v_entities""",
        "strategy_route": "SELECT seq, CASE WHEN lower(coalesce(model, '')) LIKE '%nemotron%' THEN 'json' ELSE 'lines' END AS strategy FROM v_replies",
        "lang_detect": """
            SELECT doc_id, CASE lower(list_last(string_split(origin_path, '.'))) WHEN 'rs' THEN 'rust' WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'mjs' THEN 'javascript' WHEN 'cjs' THEN 'javascript'
                WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'go' THEN 'go' WHEN 'c' THEN 'c' WHEN 'h' THEN 'c' WHEN 'cpp' THEN 'cpp' WHEN 'cc' THEN 'cpp' WHEN 'cxx' THEN 'cpp'
                WHEN 'hpp' THEN 'cpp' WHEN 'hxx' THEN 'cpp' END AS language FROM documents""",
        "markdown_sniff": "SELECT id, contains(content, '# ') OR contains(content, '## ') OR contains(content, '```') AS markdown FROM v_chunks",
        "source_labels": """
            WITH s AS (SELECT DISTINCT span_id, source, span_index FROM chunk_spans)
            SELECT span_id, CASE WHEN count(*) OVER (PARTITION BY source) > 1 THEN source || '#chunk' || (span_index + 1) ELSE source END AS label FROM s""",
        "previews": "SELECT id, replace(substr(content, 1, 48), chr(10), '\\n') AS preview FROM v_chunks",
        "sha256_fingerprint": "SELECT id, 'sha256:' || sha256(content) AS fingerprint FROM v_chunks",
        "line_spans": "SELECT doc_id, sha256(text) AS text, (length(text) - length(replace(text, chr(10), '')) + CASE WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END)::BIGINT AS lines FROM documents WHERE text IS NOT NULL AND text <> ''",
        "line_span_rows": """
            WITH RECURSIVE parts AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text <> ''),
            lines AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS i, len(x) AS n_lines, unnest(x) AS line FROM parts),
            l AS (SELECT doc_id, i, strlen(line) + CASE WHEN i < n_lines THEN 1 ELSE 0 END AS n FROM lines WHERE i < n_lines OR line <> ''),
            r AS (SELECT doc_id, i, 0::BIGINT AS span, n AS size, n FROM l WHERE i = 1 UNION ALL
                SELECT l.doc_id, l.i, CASE WHEN r.size + l.n > 500 THEN r.span + 1 ELSE r.span END, CASE WHEN r.size + l.n > 500 THEN l.n ELSE r.size + l.n END, l.n
                FROM r JOIN l ON l.doc_id = r.doc_id AND l.i = r.i + 1),
            g AS (SELECT doc_id, span, sum(n)::BIGINT AS bytes, min(i) AS line_start, max(i) AS line_end FROM r GROUP BY 1, 2)
            SELECT doc_id, span AS index, (sum(bytes) OVER w - bytes)::BIGINT AS start, (sum(bytes) OVER w)::BIGINT AS end, line_start, line_end FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY span)""",
        "text_span_cover": f"SELECT doc_id, sha256(regexp_replace(text, '{_WHITE.replace(chr(92) + 'p{Z}', chr(92) + 'pZ')}', '', 'g')) AS text FROM documents WHERE regexp_replace(text, '{_WHITE.replace(chr(92) + 'p{Z}', chr(92) + 'pZ')}', '', 'g') <> ''",
        "code_span_cover": "SELECT doc_id, sha256(text) AS text FROM documents WHERE shape = 'code' AND text <> ''",
        "window_spans": f"SELECT doc_id, true AS good FROM documents WHERE regexp_replace(text, '{_WHITE.replace(chr(92) + 'p{Z}', chr(92) + 'pZ')}', '', 'g') <> ''",
        "verified_chunk": "SELECT DISTINCT span_id, CASE WHEN text IS NULL THEN 'out_of_range' WHEN 'sha256:' || sha256(text) = fingerprint THEN 'ok' ELSE 'fingerprint_mismatch' END AS status FROM chunk_spans",
        "sed_ranges": "SELECT DISTINCT span_id, line_start || ',' || line_end || 'p' AS range FROM chunk_spans",
    }
    return {name: with_views(body) for name, body in raw.items()}
