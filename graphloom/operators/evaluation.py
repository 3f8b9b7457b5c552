"""Retrieval scored against gold: one row per mode and question, and one summary per mode.

The key of a row is (mode, qid); inside, the metrics see both as one string, so all modes are scored in one plan.
Defined cases: questions without text are left out; null or empty gold lists count as none; a stored map from chunk
to evidence takes the place of the computed one for its question; evidence that no span of the question has is
dropped, but its chunks stay on the list; repeated rows of a trace count once; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators import metrics
from graphloom.operators.retrieval import Index

_SEP = "\x1f"


def _key() -> Column:
    return F.concat("mode", F.lit(_SEP), "qid")


def gold_spans(questions: DataFrame, files: DataFrame) -> DataFrame:
    """(qid, evidence_id, file_id, char_start, char_end): the spans of every question in its ``files`` (qid, file_id)."""
    spans = questions.select("qid", F.explode("gold_evidence_spans").alias("s"))
    return spans.join(files.select("qid", "file_id").distinct(), "qid").select("qid", "s.evidence_id", "file_id", "s.char_start", "s.char_end")


def chunk_evidence(questions: DataFrame, computed: DataFrame) -> DataFrame:
    """(qid, chunk_id, evidence_id): what chunks show of a question's spans; ``evidence_id`` is null for chunks that are
    on the list without any. ``computed`` (qid, chunk_id, evidence_id) gives way to a column ``gold_chunk_evidence``, a
    map from chunk to evidence, where ``questions`` has one that is not empty."""
    known = questions.select("qid", F.explode("gold_evidence_spans").alias("s")).select("qid", F.col("s.evidence_id").alias("evidence_id"), F.lit(True).alias("_known")).distinct()
    rows = computed.select("qid", "chunk_id", "evidence_id")
    if "gold_chunk_evidence" in questions.columns:
        stored = questions.where(F.size("gold_chunk_evidence") > 0)
        own = stored.select("qid", F.explode("gold_chunk_evidence").alias("chunk_id", "e")).select("qid", "chunk_id", F.explode_outer("e").alias("evidence_id"))
        rows = rows.join(stored.select("qid"), "qid", "left_anti").unionByName(own)
    rows = rows.join(known, ["qid", "evidence_id"], "left")
    return rows.select("qid", "chunk_id", F.when(F.col("_known"), F.col("evidence_id")).alias("evidence_id")).distinct()


def evaluate(questions: DataFrame, trace: DataFrame, index: Index, names: DataFrame, evidence: DataFrame, modes: list[str]) -> DataFrame:
    """questions (qid, question, gold_entities, gold_relations, gold_answer_points, gold_evidence_spans), a trace of
    ``modes``, the table of ``metrics.name_table``, and ``chunk_evidence`` -> per mode and question the set metrics of
    entities and relations (entity_*, relation_*) and the metrics of chunks (``metrics.evidence_report``)."""
    asked = questions.where(F.length("question") > 0)
    every = asked.withColumn("mode", F.explode(F.array(*[F.lit(m) for m in dict.fromkeys(modes)])))
    base = every.select(_key().alias("qid"), F.coalesce(F.size("gold_answer_points"), F.lit(0)).alias("answer_points"))
    base = base.withColumn("answer_points", F.greatest("answer_points", F.lit(0)))

    def gold(field: str) -> DataFrame:
        return every.select(_key().alias("qid"), F.explode(field).alias("name"))

    def found(kind: str, table: DataFrame, column: str) -> DataFrame:
        rows = trace.where(F.col("kind") == kind).select(_key().alias("qid"), "id")
        return rows.join(table.select("id", F.col(column).alias("name")), "id").select("qid", "name").distinct()

    def prefixed(rows: DataFrame, prefix: str) -> DataFrame:
        return rows.select("qid", *[F.col(c).alias(f"{prefix}_{c}") for c in rows.columns if c != "qid"])

    def sides(kind: str, field: str, table: DataFrame, column: str, normalise) -> DataFrame:
        both = [normalise(rows, "name", names, "item") for rows in (gold(field), found(kind, table, column))]
        return prefixed(metrics.set_metrics(*both, base), kind)

    entity = sides("entity", "gold_entities", index.entities, "name", metrics.normalise_names)
    relation = sides("relation", "gold_relations", index.relations, "rel_key", metrics.normalise_pairs)
    chunks = trace.where(F.col("kind") == "chunk").select(_key().alias("qid"), F.col("id").alias("chunk_id"), "rank")
    shown = every.select("qid", "mode").join(evidence, "qid").select(_key().alias("qid"), "chunk_id", "evidence_id")
    points = every.select(_key().alias("qid"), F.explode("gold_evidence_spans").alias("s"))
    points = points.select("qid", F.col("s.evidence_id").alias("evidence_id"), F.explode_outer("s.supports_answer_points").alias("point")).distinct()
    chunk = metrics.evidence_report(metrics.evidence_metrics(chunks, shown, points, base))
    rows = entity.join(relation, "qid").join(chunk, "qid")
    parts = F.split(F.col("qid"), _SEP, 2)
    return rows.select(parts[0].alias("mode"), parts[1].alias("qid"), *[c for c in rows.columns if c != "qid"])
