"""Mapping freely typed values to the entries of a reference list.

Method: a symmetric-delete dictionary. Each label of the list is filed under
every string that up to two deletions make of it; a typed value looks up its
own deletions there, which finds all labels within two edits without comparing
it with each. What is found is ranked by a weighted Damerau-Levenshtein
distance (a swap of neighbours, a doubled or undoubled letter and a vowel for a
vowel weigh less than other edits), then by how often the label is used in the
records, then by the label. A value within no label's bound is reported as
`unmatched`.

Before that a value is folded: case, accents, camel case, separators, quotes,
a trailing mark, a leading tag (`rel:`, `type:`) or article, a leading `also`
or `is`, a trailing remark in brackets. A value that folds to a label is that
label; a value that is still a label before a word is taken away keeps it.

Scale: the dictionary is sent to all tasks while the list has at most
`broadcast_entries` labels; the records are then mapped where they lie, so
frequent values cause no skew, and only what was found is sent on, to count
repeated rows once. With a longer list the different values and the labels are
joined on their deletions instead, with the same results.

Defined results: null and blank values and null ids are no cases; a value that
is byte-equal to a canonical entry needs no mapping and is no case; repeated
rows count once. Labels with a null part are left out; a label with several
canonical entries takes the least. With an empty list every value is
unmatched. Extra columns are dropped. Very long values fold like others but
are looked up only if their length is within the bound of a label.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.session import stage, unchunked

UNMATCHED = "unmatched"

#: Most edits between a value and a label.
MAX_EDITS = 2

#: Labels of up to this many letters allow one edit only.
SHORT_LABEL = 4

#: Longest list that is sent to all tasks.
BROADCAST_ENTRIES = 50_000

_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_BETWEEN = re.compile(r"[\W_]+")
_REMARK = re.compile(r"\s*\([^()]*\)\s*$")
_TAG = re.compile(r"^\w{1,12}:\s*(?=\S)")
#: Words that may stand before a value without changing it.
_LEADING = ("a", "an", "the", "is", "are", "also")
_VOWELS = frozenset("aeiouy")


def fold(value: str) -> str:
    """The letters and digits of a value in one case, words parted by one blank."""
    text = unicodedata.normalize("NFKC", value)
    if not text.isupper():
        text = _CAMEL.sub(" ", text)
    text = "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))
    return _BETWEEN.sub(" ", text).strip()


def readings(value: str) -> list[str]:
    """The folded value, then with tag and remark taken away, then without leading words."""
    bare = _TAG.sub("", _REMARK.sub("", value.strip().strip("\"'“”„«»`").strip()))
    found = [fold(value), fold(bare)]
    words = found[-1].split()
    while len(words) > 1 and words[0] in _LEADING:
        words = words[1:]
        found.append(" ".join(words))
    return [r for r in dict.fromkeys(found) if r]


def deletions(text: str, most: int = MAX_EDITS) -> set[str]:
    """The text and all that up to `most` deletions make of it."""
    layer, out = {text}, {text}
    for _ in range(most):
        layer = {t[:i] + t[i + 1 :] for t in layer for i in range(len(t))}
        out |= layer
    return out


def weighted_distance(a: str, b: str) -> tuple[int, float]:
    """Edits and weight of the lightest way from a to b (restricted Damerau-Levenshtein)."""
    rows = [[(j, float(j)) for j in range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row = [(i, float(i))]
        for j, y in enumerate(b, 1):
            drop = 0.6 if i > 1 and a[i - 2] == x else 1.0
            add = 0.6 if j > 1 and b[j - 2] == y else 1.0
            swap = 0.0 if x == y else 0.8 if x in _VOWELS and y in _VOWELS else 1.0
            best = min(
                (rows[i - 1][j][0] + 1, rows[i - 1][j][1] + drop),
                (row[j - 1][0] + 1, row[j - 1][1] + add),
                (rows[i - 1][j - 1][0] + (x != y), rows[i - 1][j - 1][1] + swap),
            )
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, (rows[i - 2][j - 2][0] + 1, rows[i - 2][j - 2][1] + 0.7))
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


def allowed(label: str) -> int:
    return 1 if len(label) <= SHORT_LABEL else MAX_EDITS


class Dictionary:
    """Labels of one kind, filed under their deletions."""

    def __init__(self, entries: Iterable[tuple[str, str, int]]):
        """entries: label, canonical entry, uses in the records."""
        self.canonical: dict[str, str] = {}
        self.uses: dict[str, int] = {}
        self.exact: set[str] = set()
        for label, canonical, uses in sorted(entries):
            key = fold(label)
            if not key:
                continue
            self.exact.add(canonical)
            self.canonical[key] = min(self.canonical.get(key, canonical), canonical)
            self.uses[key] = self.uses.get(key, 0) + uses
        self.filed: dict[str, list[str]] = {}
        for key in self.canonical:
            for text in deletions(key):
                self.filed.setdefault(text, []).append(key)
        self.longest = max(map(len, self.canonical), default=0) + MAX_EDITS
        self._known: dict[str, str] = {}

    def lookup(self, value: str) -> str:
        """The canonical entry meant, or UNMATCHED."""
        hit = self._known.get(value)
        if hit is None:
            if len(self._known) > 100_000:
                self._known.clear()
            hit = self._known[value] = self._search(value)
        return hit

    def _search(self, value: str) -> str:
        ways = readings(value)
        for way in ways:
            if way in self.canonical:
                return self.canonical[way]
        best: tuple | None = None
        for way in ways:
            if len(way) > self.longest:
                continue
            for label in {x for text in deletions(way) for x in self.filed.get(text, ())}:
                edits, weight = weighted_distance(way, label)
                if edits <= allowed(label):
                    best = min(best or (9, 9.0, 0, ""), (edits, weight, -self.uses[label], label))
        return self.canonical[best[3]] if best else UNMATCHED


@lru_cache(maxsize=8)
def _dictionary(entries: tuple[tuple[str, str, int], ...]) -> Dictionary:
    return Dictionary(entries)


def value_records(sources: list[tuple[str, DataFrame, str, str]], vocab: DataFrame) -> DataFrame:
    """(field_name, record_id, value) to be mapped: sources are (kind, table, id column, value column)."""
    out = None
    for kind, rows, key, value in sources:
        part = rows.select(F.lit(kind).alias("field_name"), F.col(key).cast("bigint").alias("record_id"), F.col(value).alias("value"))
        out = part if out is None else out.unionByName(part)
    out = out.where(r"record_id is not null and value rlike '[^\\s\\p{Z}\\p{Cf}]'")
    return out


def map_values(records: DataFrame, vocab: DataFrame, broadcast_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """(field_name, record_id, canonical) of each record that is no canonical entry itself."""
    spark = records.sparkSession
    entries = vocab.select("kind", "label", "canonical").where("kind is not null and label is not null and canonical is not null").distinct()
    canonical = entries.select(F.col("kind").alias("field_name"), F.col("canonical").alias("value")).distinct()
    few = entries.limit(broadcast_entries + 1).collect()
    if len(few) > broadcast_entries:
        return _map_joined(records.join(canonical, ["field_name", "value"], "left_anti"), entries, records)
    names = entries.select(F.col("kind").alias("field_name"), F.col("label").alias("value"))
    used = {(r["field_name"], r["value"]): r["n"] for r in records.join(F.broadcast(names), ["field_name", "value"], "left_semi").groupBy("field_name", "value").agg(F.count("*").alias("n")).collect()}
    kinds: dict[str, list] = {}
    for r in few:
        kinds.setdefault(r["kind"], []).append((r["label"], r["canonical"], used.get((r["kind"], r["label"]), 0)))
    sent = spark.sparkContext.broadcast({k: tuple(sorted(v)) for k, v in kinds.items()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = {k: _dictionary(v) for k, v in sent.value.items()}
        for batch in batches:
            found = []
            for field, key, value in zip(batch["field_name"], batch["record_id"], batch["value"]):
                words = of.get(field)
                if words is not None and value in words.exact:
                    continue
                found.append((field, key, words.lookup(value) if words else UNMATCHED))
            yield pd.DataFrame(found, columns=["field_name", "record_id", "canonical"])

    return records.mapInPandas(run, "field_name string, record_id bigint, canonical string").distinct()


def _map_joined(cases: DataFrame, entries: DataFrame, records: DataFrame) -> DataFrame:
    """The same by joins on deletions, for a list too long to be sent."""
    uses = records.groupBy("field_name", "value").agg(F.count("*").alias("uses"))
    labels = entries.withColumnRenamed("kind", "field_name").join(uses.withColumnRenamed("value", "label"), ["field_name", "label"], "left").fillna({"uses": 0})

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for field, label, canonical, uses_ in batch.itertuples(index=False):
                key = fold(label)
                out += [(field, text, key, canonical, uses_) for text in (deletions(key) if key else ())]
            yield pd.DataFrame(out, columns=["field_name", "text", "label", "canonical", "uses"])

    filed = labels.select("field_name", "label", "canonical", "uses").mapInPandas(file, "field_name string, text string, label string, canonical string, uses bigint")
    filed = stage(filed.groupBy("field_name", "text", "label").agg(F.min("canonical").alias("canonical"), F.sum("uses").alias("uses")))
    longest = filed.agg(F.coalesce(F.max(F.length("label")), F.lit(0))).first()[0]

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for field, value in batch.itertuples(index=False):
                for n, way in enumerate(readings(value)):
                    # a reading two letters longer than any label can be none of them
                    out += [(field, value, text, way, n) for text in (deletions(way) if len(way) <= longest + 2 else ())]
            yield pd.DataFrame(out, columns=["field_name", "value", "text", "way", "n"])

    values = cases.select("field_name", "value").distinct()
    asked = values.mapInPandas(ask, "field_name string, value string, text string, way string, n int")
    pairs = asked.join(filed, ["field_name", "text"]).select("field_name", "value", "way", "n", "label", "canonical", "uses").distinct()

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            both = [weighted_distance(a, b) for a, b in zip(batch["way"], batch["label"])]
            batch["edits"] = pd.Series([e for e, _ in both], index=batch.index, dtype="int32")
            batch["weight"] = pd.Series([w for _, w in both], index=batch.index, dtype="float64")
            yield unchunked(batch[[e <= allowed(x) for e, x in zip(batch["edits"], batch["label"])]])

    weighed = pairs.mapInPandas(weigh, "field_name string, value string, way string, n int, label string, canonical string, uses bigint, edits int, weight double")
    # an exact label counts by the reading that gives it first, others by distance
    order = [F.when(F.col("edits") == 0, F.col("n")).otherwise(1000), "edits", "weight", F.desc("uses"), "label"]
    best = weighed.withColumn("k", F.row_number().over(Window.partitionBy("field_name", "value").orderBy(*order))).where("k = 1")
    found = cases.join(best.select("field_name", "value", "canonical"), ["field_name", "value"], "left")
    return found.select("field_name", "record_id", F.coalesce("canonical", F.lit(UNMATCHED)).alias("canonical")).distinct()
