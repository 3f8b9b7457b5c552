"""The plain sentence rule of the graph pipeline: a sentence ends at . ! or ? before white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.arrays import running_sums
from graphloom.functions.let import let
from graphloom.functions.text import WHITE_SPACE, strip

_BREAK = f"(?<=[.!?])[{WHITE_SPACE}]+"


def split_sentences(text: Column) -> Column:
    """Trimmed sentences, without empty ones; null gives null."""
    return F.filter(F.transform(F.split(text, _BREAK), strip), lambda s: F.length(s) > 0)


def sentence_spans(text: Column) -> Column:
    """Array of (start, end, sentence), 0-based half-open code points, trimmed."""
    raw = F.regexp_extract_all(text, F.lit(rf"(?s).*?(?:[.!?](?=[{WHITE_SPACE}])|\z)"), F.lit(0))

    def spans(parts: Column) -> Column:
        def one(part: Column, at: Column) -> Column:
            lead = F.length(part) - F.length(F.regexp_replace(part, f"^[{WHITE_SPACE}]+", ""))
            return let(strip(part), lambda body: F.struct((at + lead).alias("start"), (at + lead + F.length(body)).alias("end"), body.alias("sentence")))

        every = let(running_sums(F.transform(parts, F.length)), lambda at: F.transform(parts, lambda part, i: one(part, at[i])))
        return F.filter(every, lambda s: s["end"] > s["start"])

    return let(raw, spans)
