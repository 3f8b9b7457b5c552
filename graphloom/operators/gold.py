"""Gold evidence: spans from sentence ranges, guards, and normal forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.sentences import sentence_spans
from graphloom.functions.text import collapse_space, strip

PREVIEW = 240


def evidence(documents: DataFrame, ranges: DataFrame) -> DataFrame:
    """documents (file_id, text), ranges (file_id, qid, number, first, last; sentences from 1, inclusive) ->
    (qid, evidence_id, file_id, char_start, char_end, text_sha256, text_preview). Ranges outside the text are
    left out; ``bad_ranges`` finds them."""
    rows = ranges.join(documents.select("file_id", "text", sentence_spans(F.col("text")).alias("s")), "file_id")
    rows = rows.where((F.col("first") >= 1) & (F.col("last") >= F.col("first")) & (F.col("last") <= F.size("s")))
    start, end = F.col("s")[F.col("first") - 1]["start"], F.col("s")[F.col("last") - 1]["end"]
    body = F.substring(F.col("text"), start + 1, end - start)
    return rows.select(
        "qid", F.concat("qid", F.lit("_e"), F.lpad(F.col("number").cast("string"), 2, "0")).alias("evidence_id"), "file_id",
        start.alias("char_start"), end.alias("char_end"), F.sha2(body, 256).alias("text_sha256"),
        F.substring(collapse_space(body), 1, PREVIEW).alias("text_preview"),
    )


def guards(questions: DataFrame) -> DataFrame:
    """Per question: answer points, spans, spans with a bad range, supports outside the points, points that no
    span supports, and whether all is well."""
    n = F.coalesce(F.size("gold_answer_points"), F.lit(0))
    spans = F.col("gold_evidence_spans")
    supports = F.flatten(F.transform(spans, lambda s: s["supports_answer_points"]))
    bad = F.size(F.filter(spans, lambda s: (s["sentence_start"] < 1) | (s["sentence_end"] < s["sentence_start"]) | (s["char_end"] <= s["char_start"])))
    outside = F.size(F.filter(supports, lambda p: (p < 1) | (p > n)))
    points = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.expr("CAST(array() AS ARRAY<INT>)"))
    missing = F.size(F.array_except(points, supports))
    return questions.select(
        "id", n.cast("bigint").alias("answer_points"), F.size(spans).cast("bigint").alias("spans"), bad.cast("bigint").alias("bad_ranges"),
        outside.cast("bigint").alias("bad_supports"), missing.cast("bigint").alias("unsupported"),
        ((F.size(spans) > 0) & (bad == 0) & (outside == 0) & (missing == 0)).alias("ok"),
    )


def unmatched(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Keys of one side that the other lacks, with the side."""
    left = a.select(key).distinct().join(b, key, "left_anti").select(key, F.lit("first").alias("side"))
    return left.unionByName(b.select(key).distinct().join(a, key, "left_anti").select(key, F.lit("second").alias("side")))


def relation_pair(pair: Column) -> Column:
    """a||b with stripped parts in code-point order; null unless there are exactly two."""
    parts = F.transform(F.split(pair, r"\|\|", -1), strip)
    return F.when(F.size(parts) == 2, F.array_join(F.array_sort(parts), "||"))


def relation_pairs(pairs: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(pairs, relation_pair), lambda p: p.isNotNull())))
