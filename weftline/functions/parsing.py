"""Parsing of model replies: triple lines and JSON."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import trim_unicode

#: A reply in JSON.
REPLY = "struct<entities:array<struct<head:string,head_type:string,relation:string,tail:string,tail_type:string,properties:string>>>"
TRIPLE = "struct<head:string,head_type:string,relation:string,tail:string,tail_type:string>"


def _after(text: Column, mark: str) -> Column:
    """What follows the first mark, or null."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substring(text, at + len(mark), F.length(text)))


def _before(text: Column, mark: str) -> Column:
    at = F.instr(text, mark)
    return F.when(at > 0, F.substring(text, F.lit(1), at - 1))


def split_node(text: Column) -> tuple[Column, Column]:
    """(name, type) of `name (type)`; the type is what the last bracket holds, or null."""
    text = trim_unicode(text)
    typed = text.endswith(")") & text.contains("(")
    name = F.when(typed, F.trim(F.regexp_extract(text, r"(?s)^(.*)\(", 1))).otherwise(text)
    kind = F.when(typed, F.trim(F.regexp_extract(text, r"(?s)^.*\((.*)\)$", 1)))
    return name, F.when(kind != "", kind)


def parse_triple_line(line: Column) -> Column:
    """The triple of `head (type) -[relation]-> tail (type)`, or null if it is malformed."""
    left, right = _before(line, "]->"), _after(line, "]->")
    head, head_type = split_node(_before(left, "-["))
    relation = F.trim(_after(left, "-["))
    tail, tail_type = split_node(right)
    whole = F.coalesce((head != "") & (relation != "") & (tail != ""), F.lit(False))
    return F.when(whole, F.struct(head.alias("head"), head_type.alias("head_type"), relation.alias("relation"), tail.alias("tail"), tail_type.alias("tail_type")))


def triple_lines(response: Column) -> Column:
    """The lines of a reply that should be triples: not blank, no remark, no example."""
    lines = F.transform(F.split(F.coalesce(response, F.lit("")), "\n"), lambda x: trim_unicode(x))
    return F.filter(lines, lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("//") & ~x.startswith("Example"))


def json_reply(response: Column) -> Column:
    """The reply without a fence, parsed; null if it is no JSON of the expected shape."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(response), r"^```(?:json)?\s*", ""), r"\s*```$", ""))
    parsed = F.from_json(bare, REPLY)
    # a reply without the key gives no triples; what is no object is malformed
    good = F.try_parse_json(bare).isNotNull() & bare.startswith("{")
    return F.when(good, F.coalesce(parsed["entities"], F.array().cast("array<struct<head:string,head_type:string,relation:string,tail:string,tail_type:string,properties:string>>")))


#: Parts of the names of models that answer better in JSON.
JSON_MODELS = ("nemotron",)


def wants_json(model: Column) -> Column:
    """Whether replies of a model come as JSON rather than as triple lines."""
    name = F.lower(F.coalesce(model, F.lit("")))
    return reduce(lambda a, b: a | b, [name.contains(part) for part in JSON_MODELS])


def python_triples(response: str | None, as_json: bool) -> tuple[list[tuple], int]:
    """parse_replies for one reply in Python: ((head, head_type, relation, tail, tail_type) of each triple, how many were malformed)."""
    text = response or ""
    if as_json:
        bare = re.sub(r"\s*```$", "", re.sub(r"^```(?:json)?\s*", "", text.strip(" ")))
        try:
            found = json.loads(bare)
            items = found.get("entities") or [] if isinstance(found, dict) else None
            rows = [tuple(None if item.get(k) is None else str(item[k]) for k in ("head", "head_type", "relation", "tail", "tail_type")) for item in items]
        except (ValueError, TypeError, AttributeError):
            return [], 1
        return ([], 1) if any(None in (r[0], r[2], r[3]) for r in rows) else (rows, 0)
    rows, malformed = [], 0
    for line in (x.strip() for x in text.split("\n")):
        if not line or line.startswith(("#", "//", "Example")):
            continue
        left, arrow, right = line.partition("]->")
        head, mark, relation = left.partition("-[")
        (head, head_type), (tail, tail_type) = _node(head), _node(right)
        if arrow and mark and head and relation.strip(" ") and tail:
            rows.append((head, head_type, relation.strip(" "), tail, tail_type))
        else:
            malformed += 1
    return rows, malformed


def _node(text: str) -> tuple[str, str | None]:
    text = text.strip()
    if text.endswith(")") and "(" in text:
        name, _, kind = text[:-1].rpartition("(")
        return name.strip(" "), kind.strip(" ") or None
    return text, None


def parse_replies(replies: DataFrame, as_json: Column | None = None) -> DataFrame:
    """replies with triples array<struct> and malformed int; as_json tells the form of each row.

    Without as_json the form is told by the reply: an object or a fence is JSON.
    """
    response = F.col("response")
    if as_json is None:
        as_json = F.trim(F.coalesce(response, F.lit(""))).rlike(r"^(```|\{)")
    lines = F.transform(triple_lines(response), parse_triple_line)
    objects = json_reply(response)
    strict = lambda t: t["head"].isNotNull() & t["relation"].isNotNull() & t["tail"].isNotNull()
    whole = F.when(objects.isNull() | ~F.forall(objects, strict), None).otherwise(
        F.transform(objects, lambda t: F.struct(t["head"].alias("head"), t["head_type"].alias("head_type"), t["relation"].alias("relation"), t["tail"].alias("tail"), t["tail_type"].alias("tail_type")))
    )
    none = F.array().cast(f"array<{TRIPLE}>")
    return (
        replies.withColumn("_json", as_json)
        .withColumn("_lines", F.when(~F.col("_json"), lines))
        .withColumn("_objects", F.when(F.col("_json"), whole))
        .withColumn("triples", F.when(F.col("_json"), F.coalesce("_objects", none)).otherwise(F.filter("_lines", lambda t: t.isNotNull())))
        .withColumn("malformed", F.when(F.col("_json"), F.col("_objects").isNull().cast("int")).otherwise(F.size(F.filter("_lines", lambda t: t.isNull()))))
        .drop("_json", "_lines", "_objects")
    )
