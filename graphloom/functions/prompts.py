"""Prompts as column expressions: extraction from a chunk, and an answer from a context."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The entity types that are offered, and the type of what fits none.
ENTITY_TYPES = ("Person", "Creature", "Organization", "Location", "Event", "Concept", "Method", "Content", "Data", "Artifact", "NaturalObject")
OTHER_TYPE = "Other"
# Entities and relations that are asked for at most, and the form of an answer.
MOST_ENTITIES, MOST_RELATIONS = 50, 20
RESPONSE_TYPE = "Multiple Paragraphs"

_SHAPE = {
    "entities": [{"name": "", "type": "", "description": ""}],
    "relationships": [{"source": "", "target": "", "keywords": "", "description": ""}],
}

EXTRACTION = (
    "List the entities that the text names and the relationships it states between them.\n"
    "Types of entities: {types}; {other} where none fits.\n"
    "Give at most {entities} entities and {relations} relationships, each once, with a short description from the text.\n"
    "Answer with one JSON object of this shape and nothing else:\n{shape}\n{examples}"
    "Text:\n{text}"
)
ANSWER = (
    "Answer the question from the context only. Say so where the context does not hold the answer.\n"
    "Form of the answer: {response_type}\n\nContext:\n{context}\n\nQuestion: {query}"
)


def _filled(template: str, columns: dict[str, Column], **values: object) -> Column:
    """``template`` with columns and literals in place of their names in braces; other braces mean nothing."""
    names = "|".join([*columns, *values])
    parts = re.split(rf"\{{({names})\}}", template)
    return F.concat(*[
        F.lit(x) if not i % 2 else F.coalesce(columns[x], F.lit("")) if x in columns else F.lit(str(values[x])) for i, x in enumerate(parts)
    ])


def extraction_prompt(text: Column, examples: list[str] | None = None, template: str = EXTRACTION) -> Column:
    """The prompt for one chunk. The limits are asked for; what comes back is not cut to them."""
    shown = "".join(f"Example:\n{e}\n" for e in examples or [])
    return _filled(
        template, {"text": text}, types=", ".join(ENTITY_TYPES), other=OTHER_TYPE, entities=MOST_ENTITIES, relations=MOST_RELATIONS, shape=json.dumps(_SHAPE), examples=shown
    )


def answer_prompt(question: Column, context: Column, response_type: str = RESPONSE_TYPE, template: str = ANSWER) -> Column:
    return _filled(template, {"context": context, "query": question}, response_type=response_type)
