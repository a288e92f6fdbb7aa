"""Defective prompt and response pairs, each with the type of its defect.

Types, of which the first that fits holds: `empty`, `refusal`, `copy`,
`wrong_language`, `truncated`.

* empty: nothing but blanks, invisible characters, quotes or an empty fence.
* refusal: an automaton of refusal phrases of ten languages runs over the
  opening sentences; text in quotes does not count.
* copy: a suffix automaton of the prompt reads the response and finds its
  longest stretches that stand in the prompt. A copy is a response that such
  stretches cover almost wholly and that covers most of the passage (the prompt
  without its first line) in turn, so that a quotation of a part is none.
* wrong_language: every statement votes for a language by its script or by its
  stopwords; the prompt votes likewise. Names, types, relation labels and keys
  of JSON do not vote. The stopwords are the most frequent words of each
  language in all prompts, found by a first vote of short seed lists; at most
  `STOPWORDS` of each language.
* truncated: a stack of delimiters and quotes is not empty at the end, the
  last triple line is not whole, or prose stops without an end mark or with
  dots in place of its rest. For Thai,
  which has none, the last letters must end a sentence of some prompt.

Defined results: a null response is empty. A reply without a unit has no
prompt and is judged by its response alone. Repeated rows of a reply count
once; of several units of one key the least unit_id counts; a null key joins no
unit. Empty tables give an empty result. Long texts are read whole.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.session import frame, parallelism, stage

#: Stopwords kept of each language, at most.
STOPWORDS = 2_000

#: Shortest stretch of the prompt, in characters, that counts as copied.
LEAST_STRETCH = 12

#: Shares of the response and of the passage that must be covered in a copy.
COPIED_OF_RESPONSE, COPIED_OF_PASSAGE = 0.85, 0.6

#: Letters at the end of a Thai sentence that are compared.
THAI_ENDING = 6

#: Replies of a unit from which they, and its prompt, go to several partitions.
HOT_REPLIES = 10_000

#: Phrases by which a writer declines a task, in lower case without accents.
REFUSALS = (
    "i can't help", "i cannot help", "i can not help", "i can't assist", "i cannot assist", "i can't comply", "i cannot comply", "i can't do that", "i cannot do that",
    "i can't answer", "i cannot answer", "i can't provide", "i cannot provide", "i can't process", "i cannot process", "i can't fulfill", "i cannot fulfill",
    "i must decline", "i have to decline", "i decline to", "i must refuse", "i refuse to", "i won't be able", "i will not be able", "i won't help", "i'm not able to", "i am not able to",
    "i am unable", "i'm unable", "not possible for me", "impossible for me", "against my guidelines", "against my policy", "no answer will be given", "i'm sorry, but i", "i am sorry, but i", "sorry, i can",
    "kann ich nicht helfen", "kann ich leider nicht", "kann dabei nicht helfen", "muss ich leider ablehnen", "muss ich ablehnen", "diese anfrage ablehnen", "ich kann diese anfrage nicht", "ich kann nicht helfen",
    "je ne peux pas", "je ne suis pas en mesure", "je dois refuser", "je dois decliner", "je refuse de", "je suis dans l'impossibilite",
    "no puedo ayudar", "no puedo responder", "no puedo procesar", "no puedo cumplir", "debo rechazar", "tengo que rechazar", "me niego a", "no me es posible",
    "я не могу", "не могу помочь", "вынужден отказаться", "вынуждена отказаться", "должен отказаться", "отказываюсь отвечать",
    "我不能", "我无法", "我無法", "抱歉，我", "抱歉,我", "我必须拒绝", "我拒绝",
    "お答えできません", "お手伝いできません", "処理できかねます", "対応できません", "お断りします", "応じられません", "できかねます",
    "मैं इसमें मदद नहीं", "मैं मदद नहीं", "मदद नहीं कर सकता", "मदद नहीं कर सकती", "अनुरोध अस्वीकार", "उत्तर नहीं दे सकता",
    "لا أستطيع المساعدة", "لا يمكنني", "لا أستطيع الإجابة", "لا أستطيع", "علي أن أرفض", "يجب أن أرفض", "أرفض الإجابة",
    "ฉันไม่สามารถ", "ไม่สามารถช่วย", "ฉันต้องปฏิเสธ", "ขอปฏิเสธ", "ผมไม่สามารถ",
)

#: Words that name the language of a text in Latin letters.
SEEDS = {
    "en": "the a an of and or in on at to is are was were this that these with for from by it its who what whose whether each every while when until because without not no our their",
    "de": "der die das den dem des ein eine einen einem einer und oder ist sind war diese dieser dieses wer was ob wie auf nach vor mit ohne trotz seit jede jeder nicht auch im vom zum unser",
    "fr": "le la les un une des du de et ou est sont ce cette ces qui que quoi dans sur avec sans pour par au aux malgré depuis chaque après avant dès notre nous ne pas",
    "es": "el la los las un una unas unos del de y o es son este esta estos estas que quien por para con sin en al desde cada tras antes cuando nuestro nuestra no qué",
}

_SCRIPTS = (
    ("ja", regex.compile(r"[\p{Hiragana}\p{Katakana}]")),
    ("zh", regex.compile(r"\p{Han}")),
    ("ru", regex.compile(r"\p{Cyrillic}")),
    ("hi", regex.compile(r"\p{Devanagari}")),
    ("ar", regex.compile(r"\p{Arabic}")),
    ("th", regex.compile(r"\p{Thai}")),
    ("ko", regex.compile(r"\p{Hangul}")),
    ("el", regex.compile(r"\p{Greek}")),
    ("he", regex.compile(r"\p{Hebrew}")),
)
_SENTENCE_END = re.compile(r"[.!?](?=\s)|[。！？।؟]|\n")
_ACCENTS = re.compile("[\u0300-\u036f]")
_LATIN = regex.compile(r"\p{Latin}[\p{Latin}\p{M}]*")
_FENCE = re.compile(r"^\s*```\w*\s*$", re.M)
_SOMETHING = regex.compile(r"[^\s\p{Z}\p{C}\"'`“”„«»]")
_TRIPLE = re.compile(r"^\s*(?P<head>.+?)\s*(?:\([^()]*\))?\s*-\[(?P<relation>[^\]]*)\]->\s*(?P<tail>.+?)\s*(?:\([^()]*\))?\s*$")
_WHOLE_TRIPLE = re.compile(r"^\s*\S.*\([^()]+\)\s*-\[[^\]]+\]->\s*\S.*\([^()]+\)\s*$")
_REMARK = re.compile(r"^\s*(?:#|//|>)")
_TYPED = re.compile(r"\s*\([\w\s-]*\)\s*$")
_QUOTED = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|„[^“\n]*“|«[^»\n]*»|「[^」\n]*」")
_ENDED = regex.compile(r"[.!?…。！？｡।؟۔]['\"”’»“›)\]」』）】`*_]*$")
_TRAILING_OFF = regex.compile(r"[\p{L}\p{M}\p{N}](?:\.{3,}|…+)$")
_OPEN, _CLOSE = "([{（【「『“«„", ")]}）】」』”»“"


def plain(text: str) -> str:
    """Lower case, without accents, one kind of apostrophe, single blanks."""
    text = text.replace("’", "'").casefold()
    if not text.isascii():
        text = _ACCENTS.sub("", unicodedata.normalize("NFKD", text))
    return " ".join(text.split())


def is_empty(response: str | None) -> bool:
    return response is None or _SOMETHING.search(without_fences(response)) is None


def without_fences(text: str) -> str:
    return _FENCE.sub("", text) if "```" in text else text


@lru_cache(maxsize=1)
def _refusal_automaton() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for phrase in REFUSALS:
        machine.add_word(plain(phrase), phrase)
    machine.make_automaton()
    return machine


def is_refusal(response: str, sentences: int = 2) -> bool:
    """Whether one of the opening sentences declines, outside quotes."""
    head = _QUOTED.sub(" ", response.lstrip())
    ends = [m.end() for m in islice(_SENTENCE_END.finditer(head), sentences)]
    opening = head[: ends[sentences - 1]] if len(ends) >= sentences else head
    if "]->" in opening or opening.lstrip().startswith(("{", "[")):
        return False
    return next(_refusal_automaton().iter(plain(opening)), None) is not None


class SuffixAutomaton:
    """All substrings of a text, in linear time and space."""

    def __init__(self, text: str):
        self.link, self.length, self.next = [-1], [0], [{}]
        last = 0
        for c in text:
            new = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            at = last
            while at != -1 and c not in self.next[at]:
                self.next[at][c] = new
                at = self.link[at]
            if at != -1:
                to = self.next[at][c]
                if self.length[to] == self.length[at] + 1:
                    self.link[new] = to
                else:
                    twin = len(self.next)
                    self.next.append(dict(self.next[to]))
                    self.length.append(self.length[at] + 1)
                    self.link.append(self.link[to])
                    while at != -1 and self.next[at].get(c) == to:
                        self.next[at][c] = twin
                        at = self.link[at]
                    self.link[to] = self.link[new] = twin
            last = new

    def matches(self, text: str) -> list[int]:
        """For each place of text the length of the longest stretch ending there that occurs."""
        at, size, out = 0, 0, []
        for c in text:
            while at and c not in self.next[at]:
                at = self.link[at]
                size = self.length[at]
            if c in self.next[at]:
                at = self.next[at][c]
                size += 1
            out.append(size)
        return out


def covered(text: str, source: str, least: int = LEAST_STRETCH) -> int:
    """Characters of text that lie in stretches of at least `least` characters which source holds."""
    done, total = len(text), 0
    lengths = SuffixAutomaton(source).matches(text)
    for end in range(len(text), 0, -1):
        if lengths[end - 1] >= least:
            begin, stop = end - lengths[end - 1], min(end, done)
            if begin < stop:
                total += stop - begin
                done = begin
    return total


def passage_of(prompt: str) -> str:
    """The prompt without its first line."""
    return prompt.split("\n", 1)[1] if "\n" in prompt else prompt


def _letters(text: str) -> str:
    """What a copy is compared by: folded letters and digits, without line marks."""
    return re.sub(r"[\W_]+", " ", plain(re.sub(r"(?m)^\s*[>*#-]+\s*", "", text))).strip()


def is_copy(prompt: str, response: str) -> bool:
    if ("]->" in response and "]->" not in prompt) or ('"head"' in response and '"head"' not in prompt):
        # an answer in the form that was asked for gives back no passage
        return False
    text, passage = _letters(response), _letters(passage_of(prompt))
    if not text or not passage:
        return False
    if text == passage or text == _letters(prompt):
        return True
    least = min(LEAST_STRETCH, max(4, len(passage) // 3))
    if len(text) < COPIED_OF_PASSAGE * len(passage):
        return False
    source = _letters(prompt)
    # every covered stretch holds a piece of `least` characters of the prompt: too few of these, and no automaton is needed
    parts = {source[i : i + least] for i in range(len(source) - least + 1)}
    hits = sum(text[i : i + least] in parts for i in range(len(text) - least + 1))
    if hits * least < COPIED_OF_RESPONSE * len(text):
        return False
    if covered(text, source, least) < COPIED_OF_RESPONSE * len(text):
        return False
    return covered(passage, text, least) >= COPIED_OF_PASSAGE * len(passage)


@lru_cache(maxsize=200_000)
def _script_of(c: str) -> str | None:
    """The language whose script a character is of, if only one has it."""
    return next((language for language, script in _SCRIPTS if script.match(c)), None)


def votes(text: str, words: dict[str, str], latin: list[str] | None = None) -> Counter:
    """Votes of a text for languages: letters of scripts, stopwords in Latin letters (latin, folded, if they are known)."""
    found: dict[str, int] = {}
    if not text.isascii():
        for c, n in Counter(text).items():
            if c > "\x7f" and (language := _script_of(c)):
                found[language] = found.get(language, 0) + n
        if han := found.pop("zh", 0):
            language = "ja" if found.get("ja", 0) * 20 > han else "zh"
            found[language] = found.get(language, 0) + han
    get = words.get
    for word in _LATIN.findall(text.casefold()) if latin is None else latin:
        if language := get(word):
            found[language] = found.get(language, 0) + (4 if len(word) > 1 else 1)
    return Counter(found)


@lru_cache(maxsize=1)
def seed_words() -> dict[str, str]:
    """Seed words that name one language only."""
    count = Counter(w for text in SEEDS.values() for w in set(text.split()))
    return {w: language for language, text in SEEDS.items() for w in text.split() if count[w] == 1}


def main_language(found: Counter) -> str | None:
    return max(found, key=lambda k: (found[k], k)) if found else None


def statements(response: str) -> str:
    """The text of a response that states something: values of JSON, ends of triples, prose."""
    out: list[str] = []
    body = without_fences(response)
    if '"head"' in body or '"entities"' in body:
        out += re.findall(r'"(?:head|tail)"\s*:\s*"((?:[^"\\]|\\.)*)"?', body)
        try:
            out = [json.loads(f'"{x}"') for x in out]
        except ValueError:
            pass
    else:
        for line in body.split("\n"):
            if _REMARK.match(line) and not line.lstrip().startswith(">"):
                continue
            if m := _TRIPLE.match(line):
                out += [m["head"], m["tail"]]
            elif "-[" in line:
                out.append(_TYPED.sub("", line.split("-[")[0]))
            else:
                out.append(line)
    return "\n".join(out)


def is_wrong_language(prompt: str, response: str, words: dict[str, str]) -> bool:
    asked = main_language(votes(prompt_words(prompt), words))
    said = votes(statements(response), words)
    if not asked or not said:
        return False
    total = sum(said.values())
    return said[asked] < 0.3 * total and total >= 4


def prompt_words(prompt: str) -> str:
    """The prompt without lines that only name a member and its type."""
    return "\n".join(line for line in prompt.split("\n") if not _TYPED.search(line))


def _open_at_end(text: str) -> bool:
    """Whether a bracket, a JSON string or a fence is open at the end of structured text."""
    stack: list[str] = []
    quoted = escaped = False
    for c in text:
        if quoted:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append(c)
        elif c in "}]" and stack:
            stack.pop()
    return quoted or bool(stack)


def thai_ending(text: str) -> str | None:
    """The last letters of a text that ends in Thai script."""
    text = text.rstrip()
    return text[-THAI_ENDING:] if text and "฀" <= text[-1] <= "๿" else None


def is_truncated(response: str) -> bool | str:
    """Whether a response stops inside something; for Thai prose its last letters, if these decide on it."""
    text = response.rstrip()
    if text.count("```") % 2:
        return True
    body = without_fences(text).strip()
    if body.startswith(("{", "[")) or '"entities"' in body:
        return _open_at_end(body)
    lines = [x for x in body.split("\n") if x.strip() and not _REMARK.match(x)]
    if not lines:
        lines = [x for x in body.split("\n") if x.strip()]
        if not lines:
            return False
    if any("]->" in x for x in lines) or ("-[" in lines[-1]):
        return not _WHOLE_TRIPLE.match(lines[-1])
    last = lines[-1].rstrip()
    if _TRAILING_OFF.search(last):
        return True
    if _ENDED.search(last):
        return False
    if (ending := thai_ending(last)) is not None:
        return ending
    if re.match(r"^\S.*\([\w -]+\)$", last):
        # a typed name or the head of a triple line
        return False
    # short answers of one or two words need no end mark
    return len(body) > 24 or _cut_short(body)


def _cut_short(body: str) -> bool:
    return "(" in body and ")" not in body or body.rstrip().endswith(("-", ",", "(", "["))


def prompt_facts(prompts: DataFrame) -> DataFrame:
    """(language, word, n): how often words of each seed language occur in all prompts; and the endings of Thai sentences, language `ending`."""
    seeds = seed_words()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            count: Counter = Counter()
            by_language: dict[str, Counter] = defaultdict(Counter)
            for prompt in batch["user_prompt"]:
                text = prompt_words(prompt)
                latin = _LATIN.findall(text)
                language = main_language(votes(text, seeds, [w.casefold() for w in latin]))
                if language in SEEDS:
                    # words within a sentence only: capitals may be names
                    by_language[language].update(latin)
                if not prompt.isascii():
                    count.update(("ending", e) for x in prompt.split() if (e := thai_ending(x)))
            count.update({(a, w): n for a, words in by_language.items() for w, n in words.items() if w == w.casefold()})
            yield pd.DataFrame([(a, b, n) for (a, b), n in count.items()], columns=["language", "word", "n"])

    return prompts.select("user_prompt").where("user_prompt is not null").mapInPandas(run, "language string, word string, n bigint").groupBy("language", "word").agg(F.sum("n").alias("n"))


def learned_words(facts: DataFrame, most: int = STOPWORDS) -> dict[str, str]:
    """Word -> language for the most frequent words of each seed language in all prompts."""
    counts = facts.where("language <> 'ending'")
    share = counts.withColumn("all", F.sum("n").over(Window.partitionBy("word"))).where((F.col("n") >= 0.9 * F.col("all")) & (F.col("n") >= 3))
    rank = F.row_number().over(Window.partitionBy("language").orderBy(F.desc("n"), "word"))
    rows = share.withColumn("k", rank).where(F.col("k") <= most).select("word", "language").collect()
    return seed_words() | {r["word"]: r["language"] for r in rows}


def pair_replies(units: DataFrame, replies: DataFrame, hot_replies: int = HOT_REPLIES) -> DataFrame:
    """(reply_id, user_prompt, response) of each reply, with the prompt of its unit if it has one.

    Both texts are sent once, to as many partitions as there are places to work.
    A unit of very many replies is sent to several of them; there are a thousand
    such units at most. Replies without a key stay where they are.
    """
    width = parallelism(units.sparkSession)
    key = F.when(F.col("kind") == "extract", F.col("chunk_id")).when(F.col("kind") == "summarize", F.col("community_id"))
    given = replies.select("reply_id", "kind", key.alias("key"), "response").where("reply_id is not null")
    counts = stage(given.where("key is not null").groupBy("kind", "key").count())
    limit = max(hot_replies, (counts.agg(F.sum("count")).first()[0] or 0) // 1000)
    hot = F.broadcast(counts.where(F.col("count") > limit).select("kind", "key", F.lit(True).alias("hot")))
    asked = units.select("kind", key.alias("key"), "unit_id", "user_prompt").where("key is not null").join(hot, ["kind", "key"], "left")
    asked = asked.withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(width - 1))).otherwise(F.array(F.lit(0)))))
    asked = asked.repartition(width, "kind", "key", "salt").groupBy("kind", "key", "salt").agg(F.min_by("user_prompt", "unit_id").alias("user_prompt"))
    keyed = given.where("key is not null").join(hot, ["kind", "key"], "left")
    keyed = keyed.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("reply_id"), F.lit(width)).cast("int")).otherwise(F.lit(0)))
    paired = keyed.repartition(width, "kind", "key", "salt").join(asked, ["kind", "key", "salt"], "left").select("reply_id", "user_prompt", "response")
    return paired.unionByName(given.where("key is null").select("reply_id", F.lit(None).cast("string").alias("user_prompt"), "response"))


def judge(prompt: str | None, response: str | None, words: dict[str, str]) -> tuple[str | None, str | None]:
    """(defect or None, ending): with an ending, the defect `truncated` holds only if no sentence of a prompt ends so."""
    if is_empty(response):
        return "empty", None
    if is_refusal(response):
        return "refusal", None
    if prompt:
        if is_copy(prompt, response):
            return "copy", None
        if is_wrong_language(prompt, response, words):
            return "wrong_language", None
    cut = is_truncated(response)
    return ("truncated" if cut else None), (cut if isinstance(cut, str) else None)


def pair_defects(units: DataFrame, replies: DataFrame) -> DataFrame:
    """(reply_id, defect) of each defective reply."""
    spark = units.sparkSession
    facts = stage(prompt_facts(units))
    sent = spark.sparkContext.broadcast(learned_words(facts))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = sent.value
        for batch in batches:
            found = [(i, *judge(p, r, words)) for i, p, r in zip(batch["reply_id"], batch["user_prompt"], batch["response"])]
            found = [f for f in found if f[1]]
            yield frame(reply_id=[f[0] for f in found], defect=[f[1] for f in found], ending=[f[2] for f in found])

    found = stage(pair_replies(units, replies).mapInPandas(run, "reply_id bigint, defect string, ending string"))
    # only Thai endings and the ids of their replies are sent to be looked up
    seen = facts.where("language = 'ending'").select(F.col("word").alias("ending"))
    cut = found.where("ending is not null").join(seen, "ending", "left_anti").select("reply_id", "defect")
    found = found.where("ending is null").select("reply_id", "defect").unionByName(cut)
    # replies with one id are repeats; should they differ, the defect that is named first holds
    order = F.expr("array_position(array('empty', 'refusal', 'copy', 'wrong_language', 'truncated'), defect)")
    return found.groupBy("reply_id").agg(F.min_by("defect", order).alias("defect"))
