"""Linking the spellings of one person, organisation or tool.

Method: suffix blocking. A spelling is parsed into a kind and parts: the stem
with a version (tool), with a word for the kind of organisation, or with given
name or initial (person); case, accents, blanks, marks, titles, legal forms,
nicknames and abbreviations fold away, and spellings with equal parts are one
class. Every class is filed under suffixes of its words above a least length,
and under their beginnings for what differs near the end. Pairs inside a block
are compared by the ratio of their longest common subsequence: it must be as
large as it is when one letter of the longer word has no counterpart in the
other (one letter more, less, another, or swapped with its neighbour), and what
is not compared must be equal. A block that is overly common is not dropped: it is refined with the
other part; where that does not make it rarer, only those classes are compared
that share a deletion of at most one letter, which all such pairs do.

No pair that would be linked is missed. Two words of at least nine letters with
one letter's difference share their last five or their first three letters;
shorter ones share the last three, the first two, or the first and the last two.
Persons differ in one part only, so they share the other as a whole, and the
first or last letter of the part that differs.

An initial is linked to the one person of its family it can stand for, and to
none if there are several. Classes that are linked are one entity.

Defined results: null and blank names are left out; repeated names count once;
names are compared exactly, blanks and case included. A name that parses to
nothing but marks stands alone. Tools with different versions, organisations of
different kinds and people with different given names are never linked directly.
Empty tables give an empty result. Very long names are compared like others.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.components import connected_components
from weftline.session import frame, stage

#: Letters of the suffix and of the beginning under which words are filed, and length up to which both are shorter.
LEAST_SUFFIX, HEAD, SHORT = 5, 3, 8

#: Classes in a block from which its suffix is overly common.
COMMON = 64

#: Least ratio of the longest common subsequence to the mean length; and for a part beside an equal one.
LEAST_RATIO, LEAST_PART_RATIO = 0.8, 0.7

#: Names of one entity that meet those of another part of it in one task.
PART = 1_024

#: Words for kinds of organisation and their abbreviations.
ORG_WORDS = {
    "university": "university", "univ": "university", "corporation": "corporation", "corp": "corporation", "systems": "systems", "sys": "systems", "institute": "institute", "inst": "institute",
    "laboratories": "laboratories", "labs": "laboratories", "laboratory": "laboratories", "lab": "laboratories", "technologies": "technologies", "tech": "technologies", "technology": "technologies",
    "foundation": "foundation", "fdn": "foundation", "research": "research", "res": "research", "group": "group", "grp": "group", "company": "company", "co": "company", "association": "association",
    "assoc": "association", "college": "college", "coll": "college", "department": "department", "dept": "department", "society": "society", "soc": "society", "international": "international",
    "intl": "international", "association's": "association", "industries": "industries", "ind": "industries", "services": "services", "svcs": "services", "solutions": "solutions", "partners": "partners",
    "holdings": "holdings", "agency": "agency", "center": "centre", "centre": "centre", "ctr": "centre", "committee": "committee", "council": "council", "ministry": "ministry", "bank": "bank",
}
#: Legal forms and small words that do not tell organisations apart.
LEGAL = frozenset("inc llc ltd gmbh plc ag sa bv co limited incorporated the of and for".split())
#: Titles and degrees.
TITLES = frozenset("mr mrs ms miss dr prof professor sir phd md msc bsc ph jr sr".split())
#: Short forms of given names.
NICKNAMES = {
    "kate": "katherine", "katie": "katherine", "kathy": "katherine", "liz": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "lizzie": "elizabeth", "zach": "zachary", "zack": "zachary",
    "len": "leonard", "lenny": "leonard", "trish": "patricia", "pat": "patricia", "patty": "patricia", "dot": "dorothy", "dottie": "dorothy", "peggy": "margaret", "maggie": "margaret", "meg": "margaret",
    "sue": "susan", "susie": "susan", "vicky": "victoria", "tori": "victoria", "livvy": "olivia", "liv": "olivia", "chuck": "charles", "charlie": "charles", "bill": "william", "will": "william",
    "billy": "william", "sam": "samantha", "nate": "nathaniel", "nat": "nathaniel", "bella": "isabella", "izzy": "isabella", "dick": "richard", "rick": "richard", "rich": "richard", "ned": "edward",
    "ed": "edward", "eddie": "edward", "jim": "james", "jimmy": "james", "jamie": "james", "bob": "robert", "rob": "robert", "bobby": "robert", "fritz": "frederick", "fred": "frederick",
    "freddie": "frederick", "tony": "anthony", "mike": "michael", "mick": "michael", "etta": "henrietta", "hettie": "henrietta", "ted": "theodore", "teddy": "theodore", "theo": "theodore",
    "sasha": "alexander", "alex": "alexander", "sandy": "alexander", "gabe": "gabriel", "joe": "joseph", "jack": "john", "johnny": "john", "tom": "thomas", "tim": "timothy", "dan": "daniel",
    "dave": "david", "steve": "stephen", "ben": "benjamin", "matt": "matthew", "chris": "christopher", "greg": "gregory", "andy": "andrew", "nick": "nicholas", "harry": "henry", "hank": "henry",
    "jenny": "jennifer", "becky": "rebecca", "debbie": "deborah", "cindy": "cynthia", "mandy": "amanda", "abby": "abigail", "ellie": "eleanor", "nell": "eleanor", "molly": "mary", "polly": "mary",
}

_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_BRACKETED = re.compile(r"\([^()]*\)|\[[^\[\]]*\]")
_VERSION = re.compile(r"(?:v|ver|vers|version)?\.?(\d+(?:\.\d+)*)$")
_ENDING = re.compile(r"^([a-z]{4,}[a-z0-9]*[a-z])(?:v?(\d+(?:\.\d+)*))$")
#: A word that ends in a version with dots, which are no ends of abbreviations.
_DOTTED = re.compile(r"(?:[^\W\d]\w*?)?\d+(?:\.\d+)+")


def lcs_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths, by bit rows."""
    if not a or not b:
        return 0.0
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return 2 * (len(a) - row.bit_count()) / (len(a) + len(b))


def alike(a: str, b: str, least: float = LEAST_RATIO) -> bool:
    """Whether the ratio of the longest common subsequence is at least `least`, and leaves at most one letter of the longer word without a counterpart.

    A letter that has its counterpart elsewhere must have moved by one place only.
    """
    if a == b:
        return True
    short, longer = sorted((len(a), len(b)))
    if longer - short > 1 or lcs_ratio(a, b) < max(least, 1 - 1 / longer) - 1e-9:
        return False
    same = 0
    while same < short and a[same] == b[same]:
        same += 1
    end = 0
    while end < short - same and a[-1 - end] == b[-1 - end]:
        end += 1
    odd = longer - same - end
    return odd <= 1 or (odd == 2 and a[same : same + 2] == b[same : same + 2][::-1])


@lru_cache(100_000)
def _org_word(token: str) -> str | None:
    hit = ORG_WORDS.get(token)
    if hit is None and len(token) >= 5:
        hit = next((v for k, v in ORG_WORDS.items() if len(k) >= 5 and alike(k, token)), None)
    return hit


def _unjoined(token: str) -> list[str]:
    """A word written together with an organisation's words, parted."""
    tail: list[str] = []
    while word := next((w for w in ORG_WORDS if len(w) >= 5 and token.endswith(w) and len(token) > len(w) + 3), None):
        tail.insert(0, word)
        token = token[: -len(word)]
    return [token, *tail]


def parse(name: str) -> tuple[str, str, str]:
    """(kind, stem, other) of a spelling.

    Kinds: T tool (other: version), O organisation (other: its kind), P person
    (stem: family or the later, other: given or the earlier of two words), I
    person by initial, X anything else.
    """
    text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", name))
    text = "".join(c for c in text if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    text = re.sub(r"\bPh\.?\s?D\b\.?", " ", _BRACKETED.sub(" ", text))
    raw = [t for t in re.split(r"[^\w'.]+|_+", text) if t.strip("'.")]
    tokens: list[str] = []
    for t in raw:
        t = t.replace("'", "").strip(".")
        for piece in [t] if _DOTTED.fullmatch(t) else t.split("."):
            if not piece:
                continue
            parts = _CAMEL.split(piece) if not piece.isupper() else [piece]
            # inner capitals part a name only where an organisation's word follows
            if len(parts) > 1 and _org_word(parts[-1].lower()):
                tokens += [p.lower() for p in parts]
            else:
                tokens.append(piece.lower())
    comma = re.match(r"\W*(\w[\w'-]*)\s*,\s*\w", text)
    tokens = [t for t in tokens if t not in TITLES] or tokens
    # tool: a version at the end
    if len(tokens) > 1 and (m := _VERSION.match(tokens[-1])):
        body = [t for t in tokens[:-1] if t not in ("v", "ver", "vers", "version")]
        if body and any(len(t) > 2 for t in body):
            return "T", "".join(body), m[1]
    if len(tokens) == 1 and (m := _ENDING.match(tokens[0])):
        return "T", m[1], m[2]
    if len(tokens) == 1:
        tokens = _unjoined(tokens[0])
    kinds = [w for t in tokens if (w := _org_word(t))]
    if kinds:
        stem = [t for t in tokens if t not in LEGAL and not _org_word(t)]
        if stem:
            return "O", "".join(stem), " ".join(sorted(set(kinds)))
    words = [t for t in tokens if t not in LEGAL or len(tokens) <= 2]
    full = [t for t in words if len(t) > 1]
    initials = [t for t in words if len(t) == 1]
    if len(full) == 2:
        given, family = (full[1], full[0]) if comma else (full[0], full[1])
        if family in NICKNAMES and given not in NICKNAMES:
            given, family = family, given
        a, b = sorted((NICKNAMES.get(given, given), family))
        # the longer word is the stem more often than not; equal parts give equal classes either way
        return "P", *((b, a) if (len(b), b) >= (len(a), a) else (a, b))
    if len(full) == 1 and initials:
        return "I", full[0], initials[0]
    return "X", "".join(words), ""


def class_key(parts: tuple[str, str, str]) -> str:
    return "|".join(parts)


def same_entity(a: tuple[str, str, str], b: tuple[str, str, str]) -> bool:
    """Whether two classes may be one entity: one part alike by its common subsequence, the others equal."""
    if a[0] != b[0]:
        return False
    kind = a[0]
    if kind in "TO":
        return a[2] == b[2] and alike(a[1], b[1])
    if kind == "P":
        for first, second in (((a[1], b[1]), (a[2], b[2])), ((a[1], b[2]), (a[2], b[1]))):
            if first[0] != first[1] and second[0] != second[1]:
                continue
            x, y = first if first[0] != first[1] else second
            if min(len(x), len(y)) >= 3 and alike(x, y, LEAST_PART_RATIO):
                return True
        return False
    if kind == "I":
        return a[2] == b[2] and min(len(a[1]), len(b[1])) >= LEAST_SUFFIX and alike(a[1], b[1])
    return min(len(a[1]), len(b[1])) >= LEAST_SUFFIX and alike(a[1], b[1])


def stands_for(initial: tuple[str, str, str], person: tuple[str, str, str]) -> bool:
    """Whether an initial with a family name can stand for a person."""
    _, family, letter = initial
    return any(given[0] == letter and name != given and (family == name or (min(len(family), len(name)) >= LEAST_SUFFIX and alike(family, name))) for name, given in (person[1:], person[:0:-1]))


def ends(word: str) -> Iterator[str]:
    """Keys of which words share one that differ by one letter."""
    if len(word) > SHORT:
        yield f"~{word[-LEAST_SUFFIX:]}"
        yield f"^{word[:HEAD]}"
    if len(word) <= SHORT + 1:
        yield f"~{word[-3:]}"
        yield f"^{word[:2]}"
        yield f"^{word[:1]}~{word[-2:]}"


def block_keys(parts: tuple[str, str, str]) -> Iterator[tuple[str, list[str], str, bool]]:
    """(block, refinements, word that may differ, whether it asks) of a class.

    Classes that may be linked share a block and one of its refinements. Persons
    are filed where initials look for them, but ask there for no other person.
    """
    kind, stem, other = parts
    if kind == "I":
        for end in ends(stem):
            yield f"I{other}{end}", [""], stem, True
    elif kind == "P":
        for word, rest in ((stem, other), (other, stem)):
            yield f"P={word}", [f"<{rest[:1]}", f">{rest[-1:]}"], rest, True
            if len(word) > LEAST_SUFFIX:
                yield f"P~{word[-LEAST_SUFFIX:]}", [rest], word, True
            for end in ends(word):
                yield f"I{rest[:1]}{end}", [""], word, False
    else:
        for end in ends(stem):
            yield f"{kind}{end}", [other], stem, True


def deletions(word: str) -> set[str]:
    """word, and word without one letter; words that are alike share one."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


def distinct_names(sources: list[tuple[DataFrame, str]]) -> DataFrame:
    """(name): the different names of the given columns that are not blank."""
    out = None
    for rows, column in sources:
        part = rows.select(F.col(column).cast("string").alias("name"))
        out = part if out is None else out.unionByName(part)
    return out.where(r"name is not null and name rlike '[^\\s\\p{Z}\\p{Cf}]'").distinct()


def link_names(names: DataFrame, common: int = COMMON) -> DataFrame:
    """(name, entity) of every name; entity is the least class of the linked ones."""

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = [class_key(parse(n)) for n in batch["name"]]
            yield frame(name=batch["name"], key=[n if k == "X||" else k for n, k in zip(batch["name"], keys)])

    classed = stage(names.mapInPandas(parsed, "name string, key string"))

    def filed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *b) for k in batch["key"] if k.count("|") == 2 for b in block_keys(tuple(k.split("|")))]
            yield pd.DataFrame(rows, columns=["key", "block", "fines", "word", "asks"])

    rows = stage(classed.select("key").distinct().mapInPandas(filed, "key string, block string, fines array<string>, word string, asks boolean"))

    def linked(pairs: Iterable[tuple]) -> set[tuple[str, str, bool]]:
        found = set()
        for (ka, a), (kb, b) in pairs:
            if a[0] == "I" and b[0] == "P":
                if stands_for(a, b):
                    found.add((ka, kb, True))
            elif same_entity(a, b):
                found.add((ka, kb, False))
        return found

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = set()
            for asking, others in zip(batch["asking"], batch["others"]):
                asking = [(k, tuple(k.split("|"))) for k in sorted(set(asking))]
                found |= linked(combinations(asking, 2))
                found |= linked((a, (k, tuple(k.split("|")))) for a in asking for k in set(others))
            yield pd.DataFrame(sorted(found), columns=["a", "b", "initial"])

    def compare_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = linked(((a, tuple(a.split("|"))), (b, tuple(b.split("|")))) for a, b in zip(batch["a"], batch["b"]))
            yield pd.DataFrame(sorted(found), columns=["a", "b", "initial"])

    def by_edits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(*row, e) for row in batch[["key", "block", "fine", "asks", "word"]].itertuples(index=False, name=None) for e in deletions(row[-1])]
            yield pd.DataFrame(out, columns=["key", "block", "fine", "asks", "word", "edit"]).drop(columns="word")

    pairs = None
    for by in (["block"], ["block", "fine"]):
        # blocks in which at least two classes meet and one asks
        sizes = rows.groupBy(*by).agg(F.count("*").alias("n"), F.max("asks").alias("some")).where("n > 1 and some")
        small = rows.join(sizes.where(F.col("n") <= common), by, "left_semi").groupBy(*by).agg(F.collect_list(F.when(F.col("asks"), F.col("key"))).alias("asking"), F.collect_list(F.when(~F.col("asks"), F.col("key"))).alias("others"))
        part = small.select("asking", "others").mapInPandas(compare, "a string, b string, initial boolean")
        pairs = part if pairs is None else pairs.unionByName(part)
        rows = rows.join(sizes.where(F.col("n") > common), by, "left_semi")
        rows = stage(rows.withColumn("fine", F.explode("fines")).drop("fines") if by == ["block"] else rows)
        if rows.isEmpty():
            break
    else:
        # what the refinement makes no rarer
        edits = stage(rows.mapInPandas(by_edits, "key string, block string, fine string, asks boolean, edit string"))
        others = edits.select("block", "fine", "edit", F.col("key").alias("b"), F.col("asks").alias("too"))
        met = edits.where("asks").join(others, ["block", "fine", "edit"]).where("not too or key < b").select(F.col("key").alias("a"), "b").distinct()
        pairs = pairs.unionByName(met.mapInPandas(compare_pairs, "a string, b string, initial boolean"))
    pairs = stage(pairs.distinct())
    joined = connected_components(pairs.where("not initial"), "a", "b")
    joined = stage(joined)
    # an initial stands for the only person it can stand for
    people = pairs.where("initial").join(joined.select(F.col("node").alias("b"), "component"), "b", "left").select("a", F.coalesce("component", "b").alias("entity"))
    ones = people.groupBy("a").agg(F.min("entity").alias("entity"), F.max("entity").alias("other")).where("entity = other").select("a", "entity")
    whole = classed.join(ones.withColumnRenamed("a", "key"), "key", "left").join(joined.select(F.col("node").alias("key"), "component"), "key", "left")
    return whole.select("name", F.coalesce("entity", "component", "key").alias("entity"))


def variant_pairs(linked: DataFrame, part: int = PART) -> DataFrame:
    """(name_a, name_b), name_a before name_b, of all names of one entity.

    An entity of very many names meets itself in parts, each pair of parts a key of its own.
    """
    linked = stage(linked)
    sizes = linked.groupBy("entity").agg(F.count("*").alias("n")).where("n > 1").select("entity", F.ceil(F.col("n") / part).cast("int").alias("parts"))
    cut = linked.join(sizes, "entity").withColumn("own", F.pmod(F.xxhash64("name"), "parts"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    left = cut.select("entity", F.col("own").alias("i"), every.alias("j"), F.col("name").alias("name_a"))
    right = cut.select("entity", every.alias("i"), F.col("own").alias("j"), F.col("name").alias("name_b"))
    return left.join(right, ["entity", "i", "j"]).where("name_a < name_b").select("name_a", "name_b")
