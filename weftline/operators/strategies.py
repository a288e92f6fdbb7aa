"""How a model is asked for triples, and how its replies are read."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.parsing import python_triples, wants_json

#: The types that a model answering in JSON may name.
TYPES = ("Person", "Software", "Concept", "Organization", "Location", "Other")

_TYPE = {"type": ["string", "null"], "enum": [*TYPES, None]}
_TEXT = {"type": "string"}
#: The schema that a model answering in JSON is held to.
JSON_FORMAT = {
    "type": "object",
    "additionalProperties": False,
    "required": ["entities"],
    "properties": {
        "entities": {
            "type": "array",
            "items": {
                "type": "object",
                "additionalProperties": False,
                "required": ["head", "relation", "tail"],
                "properties": {"head": _TEXT, "head_type": _TYPE, "relation": _TEXT, "tail": _TEXT, "tail_type": _TYPE},
            },
        }
    },
}


@dataclass(frozen=True)
class Strategy:
    """A system prompt, the form of the replies, and the schema they are held to, if any."""

    name: str
    system: str
    as_json: bool
    format: str | None = None

    def user_prompt(self, content: Column, place: Column, total: Column) -> Column:
        """The prompt for the passage that is number place of total."""
        return F.concat(F.lit("Passage "), place.cast("string"), F.lit(" of "), total.cast("string"), F.lit(":\n\n"), content)

    def parse(self, response: str) -> list[tuple]:
        """(head, head_type, relation, tail, tail_type) of a reply, where no DataFrame is at hand."""
        return python_triples(response, self.as_json)[0]


LINES = Strategy("lines", "Extract facts from the passage as lines of the form: head (type) -[relation]-> tail (type).", False)
JSON = Strategy("json", "Extract facts from the passage as one JSON object with the key entities: a list of objects with head, head_type, relation, tail and tail_type. Write nothing else.", True, json.dumps(JSON_FORMAT))


def strategy_for(model: str | None) -> Strategy:
    """The strategy that suits a model by its name."""
    return JSON if "nemotron" in (model or "").lower() else LINES


def by_model(model: Column, value) -> Column:
    """value(strategy), a literal or column, chosen by each row's model."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v).cast("string")
    return F.when(wants_json(model), as_column(value(JSON))).otherwise(as_column(value(LINES)))


def shown(triples: list[tuple]) -> str:
    """Triples as a model is shown them."""
    return "\n".join(f"{t[0]} -[{t[2]}]-> {t[3]}" for t in triples)


def reflection_prompt(content: str, triples: list[tuple]) -> tuple[str, str]:
    """(system, user): whether something was missed."""
    return "You check what was extracted from a passage. Answer yes or no, nothing else.", f"Passage:\n\n{content}\n\nExtracted:\n{shown(triples)}\n\nWas anything important missed? Answer yes or no."


def continuation_prompt(content: str, triples: list[tuple], strategy: Strategy) -> tuple[str, str]:
    """(system, user): what else there is, given the names already found."""
    names = ", ".join(dict.fromkeys(n for t in triples for n in (t[0], t[3])))
    return strategy.system, f"Known already: {names}\n\nExtract only what is missing from the passage:\n\n{content}"


def chat_request(model: str, system: str | None, user: str, strategy: Strategy, max_tokens: int = 1000) -> dict:
    """The body of a chat request in the common form: messages, and the schema if the strategy has one."""
    messages = ([{"role": "system", "content": system}] if system else []) + [{"role": "user", "content": user}]
    body = {"model": model, "stream": False, "messages": messages, "options": {"num_predict": max_tokens}}
    return body | ({"format": json.loads(strategy.format)} if strategy.format else {})
