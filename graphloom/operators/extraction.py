"""From model responses to raw entities and relations.

A response is free text that should hold one JSON object. It is parsed as a VARIANT, so that one malformed
element costs only itself. Broken JSON, and only that, passes through a small repair function.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.let import let
from graphloom.functions.text import strip

# Attempts at a model call, and the seconds waited before the second and later ones.
ATTEMPTS = 5
WAITS = (5, 10, 20, 40)


def json_span(response: Column) -> Column:
    """From the first { to the last }; empty when there is none."""
    return F.regexp_extract(response, r"(?s)\{.*\}", 0)


def repair(text: str | None) -> str | None:
    """JSON from nearly JSON: trailing commas, single quotes, bare Python words, missing closing marks. None
    when that does not help, or when the outcome is not an object."""
    if not text:
        return None
    for candidate in (text, re.sub(r",\s*([}\]])", r"\1", text)):
        for words in ({}, {"None": "null", "True": "true", "False": "false"}):
            for quotes in (False, True):
                t = candidate
                for a, b in words.items():
                    t = re.sub(rf"\b{a}\b", b, t)
                if quotes:
                    t = re.sub(r"(?<=[\[{,:\s])'|'(?=\s*[\]},:])", '"', t)
                t = re.sub(r",\s*$", "", t)
                open_ = []
                inside = skip = False
                for ch in t:
                    if skip:
                        skip = False
                    elif ch == "\\":
                        skip = inside
                    elif ch == '"':
                        inside = not inside
                    elif not inside and ch in "{[":
                        open_.append("}" if ch == "{" else "]")
                    elif not inside and ch in "}]" and open_:
                        open_.pop()
                try:
                    value = json.loads(t + '"' * inside + "".join(reversed(open_)))
                except ValueError:
                    continue
                return json.dumps(value, ensure_ascii=False) if isinstance(value, dict) else None
    return None


@F.pandas_udf(T.StringType())
def _repaired(texts: pd.Series) -> pd.Series:
    return texts.map(repair)


def parsed(responses: DataFrame) -> DataFrame:
    """Adds ``v``, the response's object as VARIANT; null when there is none."""
    span = json_span(F.col("response"))
    rows = responses.withColumn("_j", F.when(F.length(span) > 0, span)).withColumn("_v", F.try_parse_json("_j"))
    broken = F.col("_j").isNotNull() & F.col("_v").isNull()
    rows = rows.withColumn("_v", F.coalesce("_v", F.try_parse_json(_repaired(F.when(broken, F.col("_j"))))))
    is_object = F.schema_of_variant("_v").startswith("OBJECT")
    return rows.withColumn("v", F.when(is_object, F.col("_v"))).drop("_j", "_v")


def _elements(rows: DataFrame, path: str) -> DataFrame:
    """The elements of an array that are objects, with their position."""
    rows = rows.withColumn("_a", F.try_variant_get("v", path, "array<variant>"))
    out = rows.select("*", F.posexplode("_a").alias("item", "e")).drop("_a", "v")
    return out.where(F.schema_of_variant("e").startswith("OBJECT"))


def _text(path: str) -> Column:
    return F.coalesce(F.try_variant_get("e", path, "string"), F.lit(""))


def entities_of(responses: DataFrame) -> DataFrame:
    """(file_id, chunk_id) responses -> raw entities; elements without a name are skipped."""
    rows = _elements(parsed(responses), "$.entities")
    out = rows.select(
        "file_id", "chunk_id", "item", _text("$.name").alias("name"), _text("$.type").alias("type"),
        _text("$.description").alias("description"), F.array("chunk_id").alias("source_id"),
    )
    return out.where(F.length("name") > 0)


def keyword_list(e: Column) -> Column:
    """A list as it is, a string cut at commas, anything else none; stripped, without blanks."""
    kind = F.schema_of_variant(e)
    items = F.when(kind.startswith("ARRAY"), F.try_variant_get(e, "$", "array<string>")).when(
        kind == "STRING", F.split(F.try_variant_get(e, "$", "string"), ",", -1)
    )
    none = F.array().cast("array<string>")
    return F.filter(F.transform(F.coalesce(items, none), lambda k: strip(F.coalesce(k, F.lit("")))), lambda k: F.length(k) > 0)


def relations_of(responses: DataFrame) -> DataFrame:
    """Raw relations; elements without both endpoints are skipped."""
    rows = _elements(parsed(responses), "$.relationships")
    out = rows.select(
        "file_id", "chunk_id", "item", _text("$.source").alias("source"), _text("$.target").alias("target"),
        keyword_list(F.try_variant_get("e", "$.keywords", "variant")).alias("keywords"),
        _text("$.description").alias("description"), F.array("chunk_id").alias("source_id"),
    )
    return out.where((F.length("source") > 0) & (F.length("target") > 0))


def rule_response(text: Column) -> Column:
    """The default extractor: runs of capitalised words are entities; neighbours in the text are related.
    Gives the JSON that a model is asked for."""

    def response(names: Column) -> Column:
        entities = F.transform(names, lambda n: F.struct(n.alias("name"), F.lit("Other").alias("type"), F.lit("").alias("description")))
        pairs = F.when(F.size(names) > 1, F.sequence(F.lit(0), F.size(names) - 2)).otherwise(F.expr("CAST(array() AS ARRAY<INT>)"))
        relations = F.transform(
            pairs,
            lambda i: F.struct(names[i].alias("source"), names[i + 1].alias("target"), F.lit("near, beside").alias("keywords"), F.lit("").alias("description")),
        )
        return F.to_json(F.struct(entities.alias("entities"), relations.alias("relationships")))

    return let(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b[A-Z][a-z]+(?: [A-Z][a-z]+)+\b"), F.lit(0))), response)


def call_model(
    chunks: DataFrame, model: Callable[[str], str], parallel: int, attempts: int = ATTEMPTS, waits: tuple[float, ...] = WAITS
) -> DataFrame:
    """(file_id, chunk_id, text) -> with response, status (ok or failed) and error. An empty response or an error
    is tried again after a wait; a chunk whose attempts are used up is kept, as failed. ``parallel`` partitions are
    that many calls at a time."""
    schema = "file_id string, chunk_id string, response string, status string, error string"

    def one(text: str) -> tuple[str | None, str, str | None]:
        error = None
        for attempt in range(attempts):
            try:
                response = model(text)
                if response:
                    return response, "ok", None
                error = "empty response"
            except Exception as e:  # noqa: BLE001 - whatever the backend raises
                error = f"{type(e).__name__}: {e}"
            if attempt < attempts - 1:
                time.sleep(waits[min(attempt, len(waits) - 1)])
        return None, "failed", error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(f, c, *one(t)) for f, c, t in zip(batch["file_id"], batch["chunk_id"], batch["text"], strict=True)]
            yield pd.DataFrame(rows, columns=["file_id", "chunk_id", "response", "status", "error"])

    return chunks.select("file_id", "chunk_id", "text").repartition(parallel).mapInPandas(run, schema)
