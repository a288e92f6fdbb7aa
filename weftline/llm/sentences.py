"""Sentence units of documents in many languages and scripts, with their places.

Method: document-centred disambiguation. Whether a period ends a sentence is
decided from what the word before it does elsewhere in the same document, at
places that are clear: a word whose period stands before a lower-case word, a
digit or a comma is an abbreviation; one that also stands without a period is
an ordinary word; one whose period ends a paragraph may end a sentence. Words
the document is silent or at odds with itself about are decided by the counts of
the whole corpus, rare words by a short list of known abbreviations. In the same way a word that
is capital inside paragraphs and never begins one is a name or a noun,
which tells an ordinal (`4. März`) from a sentence end. Each script has its own
end marks; Thai sentences are parted by blanks.

Units: a heading line and a list item line are one unit each; an empty line
ends a unit, a single line break does not. Marks inside quotes and brackets end
a unit only where the quote or bracket closes and a new sentence follows.
Commas, semicolons, colons and ellipses end none. Places count Unicode code
points, from 0, end exclusive, without surrounding white space.

Defined results: null, empty and blank texts give no units; null ids are left
out; repeated rows count once. Texts of any length are read whole; of a word of
more than 200 letters the last 200 tell what it is. An empty table gives no units. Extra columns are dropped.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import frame, stage, unchunked

#: Abbreviations that are known without any evidence, without their last period.
KNOWN = frozenset(
    "Mr Mrs Ms Dr Prof St Sr Jr No Nos Fig Figs Eq Sec Ch Tab vol vols vs pp p ca cf viz al etc approx vers ed eds est dept Inc Ltd Corp Co Bros Rev Gen Col Capt Lt "
    "Nr Hr Fr Abb bzw ca vgl usw ff evtl ggf Str Tel Kap Bd Jh "
    "art env fig ex Mme Mlle av chap "
    "núm pág aprox ej Sra Srta Dra Ud Uds EE UU "
    "рис стр см тыс млн млрд г гг им ул т д е пр др "
    "प्रो डॉ श्री".split()
)
#: Known abbreviations that often end a sentence.
KNOWN_LAST = frozenset("etc al usw Inc Ltd Corp Co Bros Jr p.m a.m P.M A.M U.S U.K т.д т.п др д".split())

#: Known titles, which stand before a name and end no sentence.
TITLES = frozenset("Mr Mrs Ms Dr Prof St Rev Gen Col Capt Lt Hr Fr Mme Mlle Sr Sra Srta Dra प्रो डॉ श्री".split())

#: Clear places of a document that decide on a word, if none speaks against it.
CLEAR = 2

#: Occurrences in the corpus from which its counts are believed.
ENOUGH = 8

_LIST = regex.compile(r"[^\S\n]*(?:[-*+•‣◦]|\d{1,3}[.)])[^\S\n]+\S")
_HEADING = regex.compile(r"[^\S\n]{0,3}#{1,6}(?:[^\S\n]+\S|$)")
_OPENERS = {"(": ")", "[": "]", "{": "}", "«": "»", "“": "”", "„": "“”", "‘": "’", "「": "」", "『": "』", "（": "）", "【": "】", "《": "》", "〈": "〉"}
_CLOSERS = frozenset("".join(_OPENERS.values()) + '"')
_HARD = frozenset("。！？｡।؟۔॥")
_SOFT = frozenset(".!?")
_MARKS = _HARD | _SOFT
_ELLIPSIS = regex.compile(r"\.(?:[^\S\n]?\.)+|…+|⋯+")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:[.'’_-][\p{L}\p{M}\p{N}]+)*")
# the word before a period, matched backwards from it
_DOTTED = regex.compile(r"(?r)(?<![\p{L}\p{M}\p{N}.])[\p{L}\p{M}]+(?:\.[\p{L}\p{M}]+){0,40}")
_GAP = regex.compile(r"[\s\"'”’»)\]]*")
_ORDINAL = regex.compile(r"(?<!\S)\d{1,3}\.\s+(\p{Lu}[\p{L}\p{M}]*)")
_ALNUM = regex.compile(r"[\p{L}\p{M}\p{N}]")
# what makes a word go on after its end, or begin before its begin
_JOINED = regex.compile(r"[.'’_-]?[\p{L}\p{M}\p{N}]")
_JOINED_BEFORE = regex.compile(r"(?r)[\p{L}\p{M}\p{N}][.'’_-]?")
_TAIL = regex.compile(r"(?r)[\p{L}\p{M}\p{N}][\p{L}\p{M}\p{N}.'’_-]{0,199}")
_PLACE = regex.compile(r"[.!?。！？｡।؟۔॥]+")
_THAI_PLACE = regex.compile(r"[.!?。！？｡।؟۔॥]+|(?<=[฀-๿])\s+(?=[฀-๿])")
_SPACE = regex.compile(r"\s*")
_PAIRED = regex.compile(r"[\"(\[{«“„‘「『（【《〈)\]}»”’」』）】》〉]")
_CAMEL = regex.compile(r"\p{Ll}+\p{Lu}")
_THAI = regex.compile(r"[฀-๿]")
_CONTINUES = regex.compile(r"[^\S\n]*(?:と|って|という|とか|は|が|を|に|の|然后|接着|并|地|[—–-])")


def _is_upper(text: str, at: int) -> bool:
    """Whether a word that may begin a sentence begins here: capital, or a name like pgGraph."""
    if at >= len(text):
        return False
    c = text[at]
    return bool(_CAMEL.match(text, at)) if c.islower() else c.isupper() or c.istitle()


def _is_lower(text: str, at: int) -> bool:
    return at < len(text) and text[at].islower() and not _CAMEL.match(text, at)


def blocks(text: str, markdown: bool = True) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whole) of paragraphs and of lines that are one unit each."""
    at, begin = 0, None
    while at <= len(text):
        end = text.find("\n", at)
        end = len(text) if end == -1 else end
        blank = not text[at:end].strip()
        single = not blank and markdown and (_HEADING.match(text, at, end) or _LIST.match(text, at, end))
        if (blank or single) and begin is not None:
            yield begin, at, False
            begin = None
        if single:
            yield at, end, True
        elif not blank and begin is None:
            begin = at
        at = end + 1
    if begin is not None:
        yield begin, len(text), False


def evidence(text: str, markdown: bool = True, spans: list[tuple[int, int, bool]] | None = None) -> dict[str, list[int]]:
    """What the clear places of a document say of each word that stands before a period.

    word -> [before a lower-case word, digit or comma; before another, outside
    quotes; at the end of a paragraph; without a period]. Words that follow
    `<number>.` are counted under `#word`: [0, inside paragraphs, at the begin
    of one, 0].
    """
    found: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
    if "." not in text:
        return {}
    ordinals = set(_ORDINAL.findall(text))
    spans = list(blocks(text, markdown)) if spans is None else spans
    for a, b, whole in spans:
        part = text[a:b].rstrip()
        if "." not in part:
            continue
        quotes, at, size = None, part.find("."), len(part)
        while at >= 0:
            here, at = at, part.find(".", at + 1)
            follows = part[here + 1] if here + 1 < size else ""
            if follows == "." or follows.isalnum():
                continue
            m = _DOTTED.match(part, 0, here)
            if m is None:
                continue
            word, head = m[0], _GAP.match(part, here + 1).end()
            if head == size:
                found[word][2] += not whole
            elif _is_lower(part, head) or part[head].isdigit() or part[head] in ",;:،、":
                found[word][0] += 1
            else:
                if quotes is None:
                    quotes = [(x, y) for x, y in _closing(part).items() if part[x] not in "([{（【"]
                if not any(x < m.start() < y for x, y in quotes):
                    found[word][1] += 1
    if found:
        total = Counter(text.split())
        for word, slot in found.items():
            slot[3] = total[word]
    if ordinals:
        begins = [a for a, _, _ in spans]
        for word in ordinals:
            slot = found["#" + word]
            at = text.find(word)
            while at >= 0:
                end = at + len(word)
                if not _JOINED.match(text, end) and not _JOINED_BEFORE.match(text, 0, at):
                    first = begins[max(0, bisect_right(begins, at) - 1)]
                    slot[1 if _ALNUM.search(text, first, at) else 2] += 1
                at = text.find(word, end)
    return dict(found)


def verdict(counts: list[int], word: str) -> str:
    """`word`, `abbr` (ends no sentence) or `last` (an abbreviation that may end one)."""
    low, other, end, bare = counts
    total = low + other + end
    initials = "." in word
    if total < ENOUGH and not initials:
        if word in KNOWN or word in KNOWN_LAST:
            return "last" if word in KNOWN_LAST and word not in TITLES else "abbr"
        if len(word) == 1 and word.isupper():
            return "abbr"
        if bare or end or not low:
            return "word" if len(word) > 1 or bare else "abbr"
        return "abbr"
    cased = any(c.isupper() or c.islower() for c in word)
    often_low = low >= 0.2 * total
    never_last = end <= 0.01 * total
    if initials:
        return "last" if end > 0.02 * total or (total < ENOUGH and word in KNOWN_LAST) else "abbr"
    if len(word) == 1 and (word.isupper() or not cased):
        return "abbr" if never_last or end < 0.05 * total else "last"
    if not cased:
        return "abbr" if len(word) <= 5 and never_last and bare <= 0.1 * total else "word"
    if word in TITLES and never_last:
        return "abbr"
    if bare > 2 * total and not (word in KNOWN and often_low):
        return "word"
    if often_low or (never_last and bare <= 0.05 * total and total >= 4 * ENOUGH) or word in KNOWN:
        return "abbr" if never_last else "last"
    if len(word) == 1 or word in KNOWN_LAST:
        return "last"
    return "word"


class Judge:
    """Decides on words with the counts of one document and, where it is silent or at odds with itself, of the corpus."""

    def __init__(self, own: dict[str, list[int]], corpus: dict[str, str]):
        self.own, self.corpus = own, corpus
        self.known: dict[str, str] = {}

    def kind(self, word: str) -> str:
        found = self.known.get(word)
        if found is None:
            found = self.known[word] = self._kind(word)
        return found

    def _kind(self, word: str) -> str:
        counts = self.own.get(word, [0, 0, 0, 0])
        low, other, end, bare = counts
        given = self.corpus.get(word)
        if low >= CLEAR and not bare and low > other:
            # without a paragraph end the document is silent on whether it may be the last word
            return "last" if end or given == "last" else "abbr"
        # initials are never ordinary words
        if not low and end and bare and end + bare >= CLEAR and "." not in word and len(word) > 1:
            return "word"
        if given is None:
            # the corpus holds only what is no ordinary word
            return verdict(counts, word) if low + other + end >= ENOUGH or word in KNOWN or word in KNOWN_LAST or "." in word or len(word) == 1 else "word"
        if given == "abbr" and bare > 2 * (low + other + end) and not low and word not in KNOWN:
            return "word"
        return given

    def is_noun(self, word: str) -> bool:
        """Whether a capital word after a number stands inside sentences, not at their begin."""
        _, inside, begins, _ = self.own.get("#" + word, [0, 0, 0, 0])
        if begins:
            return False
        given = self.corpus.get("#" + word)
        return given == "noun" if given is not None else inside > 1


def _closing(text: str) -> dict[int, int]:
    """Place of each opening quote or bracket of a paragraph -> place of its end."""
    stack: list[tuple[str, int]] = []
    pairs: dict[int, int] = {}
    straight = None
    for m in _PAIRED.finditer(text):
        c, i = m[0], m.start()
        if c == '"':
            if straight is None:
                straight = i
            else:
                pairs[straight] = i
                straight = None
        elif stack and c in _OPENERS[stack[-1][0]]:
            pairs[stack.pop()[1]] = i
        elif c in _OPENERS:
            stack.append((c, i))
        else:
            for k in range(len(stack) - 1, -1, -1):
                if c in _OPENERS[stack[k][0]]:
                    pairs[stack[k][1]] = i
                    del stack[k:]
                    break
    return pairs


class _Around:
    """The outermost quotes and brackets of a paragraph."""

    def __init__(self, text: str):
        self.begins: list[int] = []
        self.ends: list[int] = []
        pairs = _closing(text)
        for a in sorted(pairs):
            if not self.ends or a > self.ends[-1]:
                self.begins.append(a)
                self.ends.append(pairs[a])

    def end(self, at: int) -> int:
        """The end of the pair around a place, its marks included, or -1."""
        k = bisect_right(self.begins, at) - 1
        return self.ends[k] if k >= 0 and at <= self.ends[k] else -1


def _ends(text: str, judge: Judge) -> list[int]:
    """Ends of the sentences inside a paragraph, without the last."""
    around = _Around(text)
    dots = [m.span() for m in _ELLIPSIS.finditer(text)]
    out: list[int] = []
    begin = done = 0
    size = len(text)
    for m in (_THAI_PLACE if _THAI.search(text) else _PLACE).finditer(text):
        first, stop = m.span()
        if first < done:
            continue
        if text[first].isspace():
            out.append(first)
            begin = stop
            continue
        inside = [b for a, b in dots if a < stop and first < b] if dots else None
        if inside:
            # marks after the dots of an ellipsis may still end
            first = max(inside)
            if first >= stop:
                continue
        marks = text[first:stop]
        closed = None
        # the run of closers after the marks, with a French space before a guillemet
        k = stop
        while k < size:
            j = k
            while j < size and text[j] in " \u00a0\u202f\u2009":
                j += 1
            if j < size and text[j] in _CLOSERS and (j == k or text[j] == "»") and _is_close(text, j, around):
                closed = text[j]
                k = j + 1
            else:
                break
        stop = done = k
        if around.end(first) >= stop:
            continue
        if stop < size and text[stop] in _MARKS:
            continue
        after = _SPACE.match(text, stop).end()
        if after >= size:
            break
        if _is_end(text, judge, begin, first, marks, stop, after, closed):
            out.append(stop)
            begin = after
    return out


def _is_close(text: str, at: int, around: _Around) -> bool:
    """Whether a quote or bracket here ends what is open, rather than opening anew."""
    end = around.end(at)
    return end >= 0 and (text[at] != '"' or end == at or (at > 0 and around.end(at - 1) == end))


def _is_end(text: str, judge: Judge, begin: int, first: int, marks: str, stop: int, after: int, closed: str | None) -> bool:
    gap = after > stop
    head = after
    while head < len(text) and (text[head] in _OPENERS or text[head] in '"¿¡—–-') and text[head] not in "—–-":
        head += 1
    opened = head > after
    upper = _is_upper(text, head)
    lower = not upper and head < len(text) and text[head].islower()
    if text[after] in "—–-,;:،؛、，；：":
        return False
    # once the speech or bracket is over, a new sentence must follow
    if closed is not None and (lower or _CONTINUES.match(text, stop)):
        return False
    if not _HARD.isdisjoint(marks):
        return True
    if marks != ".":
        if lower and (closed is not None or not gap):
            return False
        return gap or upper or opened or not text[after].isascii()
    m = _before(text, first)
    if m is None:
        return gap and not lower
    word = m[0]
    if not gap and not (upper and head + 1 < len(text) and (text[head + 1].islower() or text[head + 1].isspace()) or opened):
        return False
    if not gap and (len(word) < 2 or "/" in text[max(begin, m.start() - 20) : first].split()[-1]):
        return False
    if word.isdigit():
        return _number_ends(text, judge, begin, m.start(), word, head, upper, lower, opened)
    if word[-1].isdigit():
        return not lower
    kind = judge.kind(word)
    if kind == "word":
        return not (lower and judge.own.get(word, [0])[0] > 1)
    if lower or (text[head].isdigit() if head < len(text) else False):
        return False
    if kind == "abbr":
        return False
    # an abbreviation that may end a sentence, but not one of only a few words
    words = _WORD.findall(text, begin, first)
    return len(words) > 3 or opened and len(words) > 2


def _before(text: str, at: int):
    """The word that ends at a place, with inner periods; of one of more than 200 letters the last 200."""
    return _TAIL.match(text, 0, at)


def _number_ends(text: str, judge: Judge, begin: int, start: int, word: str, head: int, upper: bool, lower: bool, opened: bool) -> bool:
    if lower or head >= len(text):
        return False
    before = text[begin:start].rstrip()
    if before.endswith(".") or len(word) > 3 or not upper:
        return not text[head].isdigit()
    m = _WORD.match(text, head)
    return opened or m is None or not judge.is_noun(m[0])


def sentences(text: str | None, corpus: dict[str, str] | None = None, markdown: bool = True) -> list[tuple[int, int]]:
    """(start, end) of each unit of a document."""
    if not text or not text.strip():
        return []
    spans = list(blocks(text, markdown))
    judge = Judge(evidence(text, markdown, spans), corpus or {})
    out: list[tuple[int, int]] = []
    for a, b, whole in spans:
        part = text[a:b]
        at = 0
        for end in [*([] if whole else _ends(part, judge)), len(part)]:
            piece = part[at:end]
            left = len(piece) - len(piece.lstrip())
            right = len(piece.rstrip())
            if right > left:
                out.append((a + at + left, a + at + right))
            at = end
    return out


def asked_words(text: str, markdown: bool = True) -> set[str]:
    """All words that the splitter may look up in the corpus for a document."""
    out: set[str] = set()
    for a, b, whole in blocks(text, markdown):
        part = text[a:b]
        at = -1 if whole else part.find(".")
        while at >= 0:
            m = _before(part, at)
            if m is not None and m[0].isdigit():
                # only marks, closers, blanks and openers lie between the period and the word looked up
                follows = _WORD.search(part, at)
                if follows is not None:
                    out.add("#" + follows[0])
            elif m is not None:
                out.add(m[0])
            at = part.find(".", at + 1)
    return out


def corpus_evidence(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, kind) for all words that the corpus knows to be no ordinary words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            total: Counter = Counter()
            for value, shape in zip(batch["text"], batch["shape"]):
                for word, counts in evidence(value, shape != "prose").items():
                    for k, n in enumerate(counts):
                        if n:
                            total[word, k] += n
            yield pd.DataFrame([(w, k, n) for (w, k), n in total.items()], columns=["word", "slot", "n"])

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kinds = []
            for word, *counts in batch[["word", "n0", "n1", "n2", "n3"]].itertuples(index=False):
                if word.startswith("#"):
                    kinds.append("noun" if counts[1] >= 3 and counts[2] <= 0.02 * counts[1] else "start")
                else:
                    kinds.append(verdict([int(c) for c in counts], word))
            out = frame(word=batch["word"], kind=kinds)
            yield unchunked(out[(out["kind"] != "word") & (out["kind"] != "start")])

    slots = docs.select(F.col(text).alias("text"), "shape").where("text is not null").mapInPandas(run, "word string, slot int, n bigint")
    sums = slots.groupBy("word").agg(*[F.sum(F.when(F.col("slot") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(4)])
    return sums.mapInPandas(decide, "word string, kind string")


#: Words the corpus decides on that are sent to all tasks; with more they are joined to the documents.
SENT_WORDS = 100_000


def sentence_units(docs: DataFrame, key: str = "doc_id", text: str = "text", sent_words: int = SENT_WORDS) -> DataFrame:
    """(key, start_char, end_char) of each unit; docs may have a column shape, whose value prose means no markup."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col("shape") if "shape" in docs.columns else F.lit(None).cast("string").alias("shape"))
    rows = rows.where("id is not null and text is not null")
    known = stage(corpus_evidence(rows))
    few = known.limit(sent_words + 1).collect()
    if len(few) <= sent_words:
        sent = spark.sparkContext.broadcast({r["word"]: r["kind"] for r in few})
        rows = rows.select("id", "text", "shape", F.lit(None).cast("map<string,string>").alias("words"))
    else:
        sent = spark.sparkContext.broadcast({})

        def words_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                pairs = [(i, w) for i, t, s in zip(batch["id"], batch["text"], batch["shape"]) for w in asked_words(t, s != "prose")]
                yield pd.DataFrame(pairs, columns=["id", "word"])

        key_ddl = rows.schema["id"].dataType.simpleString()
        own = rows.mapInPandas(words_of, f"id {key_ddl}, word string").join(known, "word").groupBy("id").agg(F.map_from_entries(F.collect_set(F.struct("word", "kind"))).alias("words"))
        rows = rows.join(own, "id", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            units = []
            for value, shape, words in zip(batch["text"], batch["shape"], batch["words"]):
                units.append(sentences(value, sent.value if words is None else dict(words), shape != "prose"))
            places = np.array([p for found in units for p in found], dtype=np.int32).reshape(-1, 2)
            yield pd.DataFrame({key: batch["id"].repeat([len(found) for found in units]), "start_char": places[:, 0], "end_char": places[:, 1]})

    return rows.mapInPandas(run, f"`{key}` {rows.schema['id'].dataType.simpleString()}, start_char int, end_char int").distinct()
