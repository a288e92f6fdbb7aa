"""Scalar text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: File extensions and names of the code languages.
EXTENSIONS = {
    "rs": "rust", "py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go",
    "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp",
}
LANGUAGE_NAMES = {
    "rust": "rust", "rs": "rust", "python": "python", "py": "python", "javascript": "javascript", "js": "javascript", "typescript": "typescript", "ts": "typescript",
    "go": "go", "golang": "go", "c": "c", "cpp": "cpp", "c++": "cpp", "cxx": "cpp",
}


def ascii_lower(c: Column) -> Column:
    """Lower case of ASCII letters only."""
    return F.translate(c, _UPPER, _LOWER)


def trim_unicode(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$", "")


def fold_key(name: Column) -> Column:
    """What two spellings of one entity share: trimmed, ASCII letters in lower case."""
    return ascii_lower(trim_unicode(name))


def looks_like_markdown(text: Column) -> Column:
    return F.coalesce(text.contains("# ") | text.contains("## ") | text.contains("```"), F.lit(False))


def source_label(source: Column, index: Column, total: Column) -> Column:
    """The source with #chunk<n> if there are several chunks; a null source stays null."""
    return F.when(total > 1, F.concat(source, F.lit("#chunk"), (index + 1).cast("string"))).otherwise(source)


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def language_of_path(path: Column) -> Column:
    """Code language by the text after the last period, or null."""
    return _lookup(EXTENSIONS, F.lower(F.element_at(F.split(path, r"\."), -1)))


def language_of_name(name: Column) -> Column:
    return _lookup(LANGUAGE_NAMES, F.lower(name))


def preview(text: Column, n: int) -> Column:
    """The first n characters with line breaks shown."""
    return F.replace(F.substring(text, 1, n), F.lit("\n"), F.lit("\\n"))


def embed_text(name: Column, entity_type: Column) -> Column:
    """What is embedded for an entity: name (type), or the name alone."""
    return F.when(F.coalesce(entity_type, F.lit("")) == "", name).otherwise(F.concat(name, F.lit(" ("), entity_type, F.lit(")")))


def json_value(text: Column) -> Column:
    """JSON text as a typed value; bad JSON is null."""
    return F.try_parse_json(text)


def normalize_type(entity_type: Column, canonical: Column) -> Column:
    """The canonical type if there is one, else the type in lower case."""
    return F.coalesce(canonical, F.lower(entity_type))
