"""Model backends over HTTP. None is needed: every operator has a default that is a column expression."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _post(url: str, payload: dict, headers: dict[str, str], timeout: float) -> dict:
    body = json.dumps(payload).encode()
    request = urllib.request.Request(url, body, {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.load(answer)


def generate_call(url: str, model: str, system: str = "", timeout: float = 600) -> Callable[[str], str]:
    """A local generation endpoint, asked for the whole answer at once."""

    def call(prompt: str) -> str:
        answer = _post(url, {"model": model, "system": system, "prompt": prompt, "stream": False}, {}, timeout)
        return answer.get("response") or ""

    return call


def chat_call(url: str, model: str, key: str, system: str = "", timeout: float = 600, max_tokens: int = 4096) -> Callable[[str], str]:
    """A chat completion endpoint; an answer without content is an empty string."""

    def call(prompt: str) -> str:
        messages = [{"role": "system", "content": system}] if system else []
        messages.append({"role": "user", "content": prompt})
        answer = _post(url, {"model": model, "messages": messages, "max_tokens": max_tokens}, {"Authorization": f"Bearer {key}"}, timeout)
        return (answer.get("choices") or [{}])[0].get("message", {}).get("content") or ""

    return call


def backend(kind: str | None = None, **settings) -> Callable[[str], str]:
    """By name, or by the environment variable LLM_BACKEND."""
    kind = kind or os.environ.get("LLM_BACKEND", "ollama")
    if kind == "ollama":
        return generate_call(**settings)
    if kind == "api":
        return chat_call(**settings)
    raise ValueError(f"unknown backend: {kind}")


def embedder(url: str, model: str, timeout: float = 600) -> Callable[[Column], Column]:
    """An embedding endpoint that takes a list of texts: one request per Arrow batch."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            answer = _post(url, {"model": model, "input": texts.fillna("").tolist()}, {}, timeout)
            yield pd.Series(answer["embeddings"])

    return embed


def reranker(predict: Callable[[list[tuple[str, str]]], list[float]]) -> Callable[[Column, Column], Column]:
    """A cross-encoder's predict as a column function over (question, text)."""

    @F.pandas_udf(T.DoubleType())
    def score(questions: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series(predict(list(zip(questions, texts, strict=True))), dtype="float64")

    return score


def generator(call: Callable[[str], str], template: str) -> Callable[[Column, Column], Column]:
    """Answers from (question, context) through a prompt template with {query} and {context}."""

    @F.pandas_udf(T.StringType())
    def answer(questions: pd.Series, contexts: pd.Series) -> pd.Series:
        return pd.Series([call(template.format(query=q, context=c)) for q, c in zip(questions, contexts, strict=True)])

    return answer
