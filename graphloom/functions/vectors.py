"""Vector expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.let import let

ALPHABET = "abcdefghijklmnopqrstuvwxyz"


def dot(a: Column, b: Column) -> Column:
    """Over the shorter length, as a zip would."""
    n = F.least(F.size(a), F.size(b))
    both = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(both, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 when either length is 0."""
    return cosine_of(dot(a, b), norm(a), norm(b))


def cosine_of(product: Column, norm_a: Column, norm_b: Column) -> Column:
    return F.when((norm_a == 0) | (norm_b == 0), F.lit(0.0)).otherwise(product / (norm_a * norm_b))


def letter_frequencies(text: Column) -> Column:
    """The default embedding: how often each of the 26 letters occurs. Whole numbers, so sums are exact."""

    def counts(low: Column) -> Column:
        return F.array(*[(F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("double") for c in ALPHABET])

    return let(F.lower(text), counts)


def tokens(text: Column) -> Column:
    """Distinct ASCII words in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """The default reranking score: common words among all words."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)
