"""Project capsules: validation, references, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType



def _fields(text: str, **nested) -> StructType:
    """A struct of string fields, some of them nested."""
    return StructType([StructField(n, nested.get(n, StringType())) for n in text.split()])


_STRINGS = ArrayType(StringType())
_THREAD = "title status owner next_action"
#: The capsule, fields in the order in which its JSON has them.
CAPSULE = _fields(
    "schema_version capsule_id project purpose verified_state decisions open_threads commitments next_segment evidence freshness",
    schema_version=IntegerType(),
    project=_fields("project_id display_name repository locations", locations=_STRINGS),
    verified_state=ArrayType(_fields("statement evidence", evidence=_STRINGS)),
    decisions=ArrayType(_fields("decision rationale evidence", evidence=_STRINGS)),
    open_threads=ArrayType(_fields(f"thread_id {_THREAD}")),
    commitments=ArrayType(_fields(f"commitment_id {_THREAD} external_waiting", external_waiting=BooleanType())),
    next_segment=_fields("title entry_point first_action"),
    evidence=ArrayType(_fields("evidence_id uri observed_at fingerprint")),
    freshness=_fields("generated_at source_fingerprint stale_after input_fingerprints", input_fingerprints=_STRINGS),
)

#: Scheme of capsule addresses unless a caller names another.
SCHEME = "weftline"


def valid_id(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\A[A-Za-z0-9._-]{1,128}\z"), F.lit(False))


def valid_text(c: Column) -> Column:
    return F.coalesce(c.rlike(r"[^\s\p{Z}]"), F.lit(False))


def valid_fingerprint(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\Asha256:[0-9a-f]{64}\z"), F.lit(False))


def valid_timestamp(c: Column) -> Column:
    """RFC 3339 by shape and range."""
    return F.coalesce(
        c.rlike(r"\A\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])[Tt]([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?([Zz]|[+-]([01]\d|2[0-3]):[0-5]\d)\z"), F.lit(False)
    )


def capsule_error(c: Column | None = None) -> Column:
    """The first failing check of a capsule as `code:field`, or null; c is a struct, without it the row's own columns."""
    f = (lambda name: F.col(name)) if c is None else (lambda name: c[name] if "." not in name else _deep(c, name))
    ids = F.transform(f("evidence"), lambda e: e["evidence_id"])

    def check(good: Column, code: str, field: str) -> Column:
        return F.when(~good, F.lit(f"{code}:{field}"))

    def each(array: str, tests: list[tuple[str, str]]) -> list[Column]:
        # the first failing field of the first failing element
        rule = {"id": valid_id, "text": valid_text, "time": valid_timestamp, "fp": lambda x: x.isNull() | valid_fingerprint(x)}
        code = {"id": "invalid_id", "text": "empty_text", "time": "invalid_timestamp", "fp": "invalid_fingerprint"}

        def fault(e: Column) -> Column:
            parts = [check(rule[kind](e[name]), code[kind], f"{array}.{name}") for kind, name in tests if kind != "cite"]
            if any(kind == "cite" for kind, _ in tests):
                parts.append(F.when(F.coalesce(F.size(e["evidence"]), F.lit(0)) <= 0, F.lit(f"missing_citation:{array}")))
                parts.append(F.when(F.exists(e["evidence"], lambda i: ~F.coalesce(F.array_contains(ids, i), F.lit(False))), F.lit(f"dangling_evidence:{array}")))
            return F.coalesce(*parts)

        return [F.try_element_at(F.filter(F.transform(f(array), fault), lambda x: x.isNotNull()), F.lit(1))]

    checks = [
        check(f("schema_version") == 1, "unsupported_version", "schema_version"),
        check(valid_id(f("capsule_id")), "invalid_id", "capsule_id"),
        check(valid_id(f("project.project_id")), "invalid_id", "project.project_id"),
        check(valid_text(f("project.display_name")), "empty_text", "project.display_name"),
        check(valid_text(f("purpose")), "empty_text", "purpose"),
        *[check(valid_text(f(f"next_segment.{x}")), "empty_text", f"next_segment.{x}") for x in ("title", "entry_point", "first_action")],
        *each("evidence", [("id", "evidence_id"), ("text", "uri"), ("time", "observed_at"), ("fp", "fingerprint")]),
        F.when(F.size(F.array_distinct(ids)) != F.size(ids), F.lit("duplicate_evidence:evidence")),
        *each("verified_state", [("text", "statement"), ("cite", "")]),
        *each("decisions", [("text", "decision"), ("text", "rationale"), ("cite", "")]),
        *each("open_threads", [("id", "thread_id"), ("text", "title"), ("text", "status"), ("text", "owner"), ("text", "next_action")]),
        *each("commitments", [("id", "commitment_id"), ("text", "title"), ("text", "status"), ("text", "owner"), ("text", "next_action")]),
        check(valid_timestamp(f("freshness.generated_at")), "invalid_timestamp", "freshness.generated_at"),
        check(valid_fingerprint(f("freshness.source_fingerprint")), "invalid_fingerprint", "freshness.source_fingerprint"),
        F.when(f("freshness.stale_after").isNotNull() & ~valid_timestamp(f("freshness.stale_after")), F.lit("invalid_timestamp:freshness.stale_after")),
        F.when(F.exists(f("freshness.input_fingerprints"), lambda x: ~valid_fingerprint(x)), F.lit("invalid_fingerprint:freshness.input_fingerprints")),
    ]
    return F.coalesce(*checks)


def _deep(c: Column, name: str) -> Column:
    for part in name.split("."):
        c = c[part]
    return c


def capsule_json(columns: list[str] | None = None) -> Column:
    """The capsule's JSON: fields in order, absent optional ones left out, control characters in lower-case hexadecimal."""
    text = F.to_json(F.struct(*(columns or CAPSULE.fieldNames())))
    # \u001F and \u001f are one character; the lower-case form is the one that is hashed
    for digit in "ABCDEF":
        for lead in "01":
            text = F.replace(text, F.lit(f"\\u00{lead}{digit}"), F.lit(f"\\u00{lead}{digit.lower()}"))
    return text


def capsule_uri(kind: Column, capsule_id: Column, scheme: str = SCHEME) -> Column:
    return F.concat(F.lit(f"{scheme}://capsules/v1/"), kind, F.lit("/"), capsule_id)


def capsule_references(capsules: DataFrame, scheme: str = SCHEME) -> DataFrame:
    """(uri, kind, capsule_id, project_id, content_fingerprint, generated_at, body) of valid capsules."""
    body = capsules.where(capsule_error().isNull()).withColumn("body", capsule_json())
    kind = F.lit("project")
    return body.select(capsule_uri(kind, F.col("capsule_id"), scheme).alias("uri"), kind.alias("kind"), "capsule_id", F.col("project.project_id").alias("project_id"), F.concat(F.lit("sha256:"), F.sha2("body", 256)).alias("content_fingerprint"), F.col("freshness.generated_at").alias("generated_at"), "body")


def put_capsules(table: DataFrame, fresh: DataFrame) -> DataFrame:
    """The table with fresh rows (capsule table columns) whose (capsule_id, fingerprint) it lacks; an older body put again does not become latest."""
    keys = ["capsule_id", "content_fingerprint"]
    once = fresh.groupBy(*keys).agg(F.min(F.struct("id", *[c for c in fresh.columns if c not in ("id", *keys)])).alias("r")).select(*keys, "r.*").select(*fresh.columns)
    return table.unionByName(once.join(table.select(*keys), keys, "left_anti").select(*table.columns))


def verified_capsules(table: DataFrame) -> DataFrame:
    """The table, failing on a body whose hash is not its fingerprint or on an unknown kind."""
    bad = F.concat(F.lit("sha256:"), F.sha2("body", 256)) != F.col("content_fingerprint")
    return table.withColumn("body", F.when(bad, F.raise_error(F.lit("a stored capsule is corrupt"))).when(F.col("kind") != "project", F.raise_error(F.lit("unknown capsule kind"))).otherwise(F.col("body")))


def latest_capsules(table: DataFrame, project: str | None = None) -> DataFrame:
    """The newest row of each capsule, of one project or of all."""
    from weftline.operators.aggregates import latest_per_group

    rows = table if project is None else table.where(F.col("project_id") == project)
    return latest_per_group(rows, "capsule_id")
