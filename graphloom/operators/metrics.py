"""Scores of retrieval against gold: sets, evidence coverage, ranks, redundancy, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import casefold, collapse_space
from graphloom.operators.merge import first_by


def ratio(a: Column, b: Column) -> Column:
    """0 for an empty denominator."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def harmonic(a: Column, b: Column) -> Column:
    return F.when(a + b == 0, F.lit(0.0)).otherwise(2 * a * b / (a + b))


def bare_name(name: Column) -> Column:
    """White space collapsed, quotation marks cut off the ends."""
    return F.regexp_replace(collapse_space(name), "^[\"']+|[\"']+$", "")


def name_table(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(folded, canonical): listed names (name) and, above them, aliases (alias, name); the least of several."""
    own = names.select(casefold(bare_name(F.col("name"))).alias("folded"), F.lit(1).alias("o"), bare_name(F.col("name")).alias("canonical"))
    other = aliases.select(casefold(bare_name(F.col("alias"))).alias("folded"), F.lit(0).alias("o"), bare_name(F.col("name")).alias("canonical"))
    return first_by(own.unionByName(other), ["folded"], ["o", "canonical"]).select("folded", "canonical")


def normalise_names(df: DataFrame, column: str, table: DataFrame, out: str) -> DataFrame:
    """Adds ``out``: the canonical name, one hop, or the cleaned name where none is known."""
    t = table.select(F.col("folded").alias("_f"), F.col("canonical").alias("_c"))
    rows = df.withColumn("_b", bare_name(F.col(column))).withColumn("_k", casefold(F.col("_b")))
    return rows.join(t, F.col("_k") == F.col("_f"), "left").withColumn(out, F.coalesce("_c", "_b")).drop("_b", "_k", "_f", "_c")


def normalise_pairs(df: DataFrame, column: str, table: DataFrame, out: str) -> DataFrame:
    """Adds ``out`` for a||b keys: both ends normalised, in the order of their folded forms; anything else gets its
    white space collapsed."""
    parts = F.split(F.col(column), r"\|\|", -1)
    rows = df.withColumn("_n", F.size(parts)).withColumn("_x", parts[0]).withColumn("_y", F.when(F.size(parts) == 2, parts[1]))
    rows = normalise_names(normalise_names(rows, "_x", table, "_a"), "_y", table, "_z")
    a, z = F.col("_a"), F.col("_z")
    pair = F.when(casefold(a) <= casefold(z), F.concat(a, F.lit("||"), z)).otherwise(F.concat(z, F.lit("||"), a))
    return rows.withColumn(out, F.when(F.col("_n") == 2, pair).otherwise(collapse_space(F.col(column)))).drop("_n", "_x", "_y", "_a", "_z")


def set_metrics(gold: DataFrame, retrieved: DataFrame, questions: DataFrame) -> DataFrame:
    """gold and retrieved (qid, item) as sets, per question of ``questions`` (qid); ``matched`` lists the common items."""
    sides = gold.where(F.length("item") >= 0).select("qid", "item", F.lit(1).alias("g"), F.lit(0).alias("r")).unionByName(
        retrieved.where(F.length("item") >= 0).select("qid", "item", F.lit(0).alias("g"), F.lit(1).alias("r"))
    )
    items = sides.groupBy("qid", "item").agg(F.max("g").alias("g"), F.max("r").alias("r"))
    counts = items.groupBy("qid").agg(
        F.array_sort(F.collect_list(F.when(F.col("g") * F.col("r") == 1, F.col("item")))).alias("matched"),
        F.sum(F.col("g") * F.col("r")).alias("matched_count"), F.sum("g").alias("gold_count"), F.sum("r").alias("retrieved_count")
    )
    rows = questions.select("qid").distinct().join(counts, "qid", "left").fillna(0, ["matched_count", "gold_count", "retrieved_count"])
    rows = rows.withColumn("matched", F.coalesce("matched", F.array().cast("array<string>")))
    rows = rows.withColumn("recall", ratio(F.col("matched_count"), F.col("gold_count")))
    rows = rows.withColumn("precision", ratio(F.col("matched_count"), F.col("retrieved_count")))
    return rows.withColumn("f1", harmonic(F.col("recall"), F.col("precision"))).withColumn("hit", F.col("matched_count") > 0)


LISTS = ("relevant_chunk_ids", "novel_relevant_chunk_ids", "matched_evidence_ids", "matched_answer_point_indices")


def _by_rank(chosen: Column) -> Column:
    """The chunk ids of the chosen rows of a question, in rank order."""
    return F.transform(F.array_sort(F.collect_list(F.when(chosen, F.struct("rank", "chunk_id")))), lambda s: s["chunk_id"])


def evidence_metrics(retrieved: DataFrame, chunk_evidence: DataFrame, evidence_points: DataFrame, questions: DataFrame) -> DataFrame:
    """retrieved (qid, chunk_id, rank); chunk_evidence (qid, chunk_id, evidence_id or null for a chunk without);
    evidence_points (qid, evidence_id, point or null); questions (qid, answer_points). One row per question.

    A chunk is relevant when it has evidence; it is novel when it is the first to show some of it."""
    runs = first_by(retrieved, ["qid", "chunk_id"], ["rank"])
    runs = runs.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))
    listed = chunk_evidence.groupBy("qid", "chunk_id").agg(F.count("evidence_id").alias("n"))
    known = evidence_points.select("qid", "evidence_id").distinct()
    covers = chunk_evidence.where(F.col("evidence_id").isNotNull()).join(known, ["qid", "evidence_id"], "left_semi")
    seen = runs.select("qid", "chunk_id", "rank").join(covers, ["qid", "chunk_id"])
    first_rank = seen.groupBy("qid", "evidence_id").agg(F.min("rank").alias("rank"))
    novel = first_rank.select("qid", "rank").distinct().withColumn("novel", F.lit(1))
    per_chunk = runs.join(listed, ["qid", "chunk_id"], "left").join(novel, ["qid", "rank"], "left")
    relevant = (F.coalesce("n", F.lit(0)) > 0).cast("int")
    per_chunk = per_chunk.withColumn("relevant", relevant)
    ranks = per_chunk.groupBy("qid").agg(
        F.count(F.lit(1)).alias("retrieved_chunks"),
        F.sum("relevant").alias("relevant_chunks"),
        F.sum(F.coalesce("novel", F.lit(0))).cast("bigint").alias("novel_chunks"),
        F.min(F.when(F.col("relevant") == 1, F.col("rank"))).alias("first_relevant_rank"),
        F.sum(F.when(F.col("relevant") == 1, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
        _by_rank(F.col("relevant") == 1).alias("relevant_chunk_ids"),
        _by_rank(F.col("novel") == 1).alias("novel_relevant_chunk_ids"),
    )
    ideal_size = listed.groupBy("qid").agg(F.count(F.lit(1)).alias("listed_chunks"))
    matched = first_rank.groupBy("qid").agg(F.count(F.lit(1)).alias("matched_evidence"), F.array_sort(F.collect_list("evidence_id")).alias("matched_evidence_ids"))
    gold = known.groupBy("qid").agg(F.count(F.lit(1)).alias("gold_evidence"))
    points = first_rank.join(evidence_points, ["qid", "evidence_id"]).where(F.col("point").isNotNull())
    points = points.select("qid", "point").distinct().groupBy("qid").agg(
        F.count(F.lit(1)).alias("matched_points"), F.array_sort(F.collect_list("point")).alias("matched_answer_point_indices")
    )
    rows = questions.select("qid", F.col("answer_points").cast("bigint").alias("answer_points"))
    for part in (ranks, ideal_size, matched, gold, points):
        rows = rows.join(part, "qid", "left")
    counts = ["retrieved_chunks", "relevant_chunks", "novel_chunks", "listed_chunks", "matched_evidence", "gold_evidence", "matched_points", "answer_points"]
    rows = rows.fillna(0, counts).fillna(0.0, ["dcg"])
    for name in LISTS:
        kind = "array<int>" if name == "matched_answer_point_indices" else "array<string>"
        rows = rows.withColumn(name, F.coalesce(F.col(name).cast(kind), F.array().cast(kind)))
    best = F.least("retrieved_chunks", "listed_chunks").cast("int")
    ideal = F.when(best > 0, F.aggregate(F.sequence(F.lit(1), best), F.lit(0.0), lambda acc, i: acc + 1 / F.log2(i + 1))).otherwise(0.0)
    rows = rows.withColumn("chunk_precision", ratio(F.col("relevant_chunks"), F.col("retrieved_chunks")))
    rows = rows.withColumn("evidence_recall", ratio(F.col("matched_evidence"), F.col("gold_evidence")))
    rows = rows.withColumn("answer_point_recall", ratio(F.col("matched_points"), F.col("answer_points")))
    rows = rows.withColumn("coverage_f1", harmonic(F.col("chunk_precision"), F.col("evidence_recall")))
    rows = rows.withColumn("ndcg", F.when(ideal == 0, 0.0).otherwise(F.col("dcg") / ideal))
    rows = rows.withColumn("reciprocal_rank", F.coalesce(F.lit(1.0) / F.col("first_relevant_rank"), F.lit(0.0)))
    redundant = F.col("relevant_chunks") - F.col("novel_chunks")
    rows = rows.withColumn("redundant_chunks", redundant).withColumn("redundancy_rate", ratio(redundant, F.col("relevant_chunks")))
    return rows.withColumn("novelty_rate", ratio(F.col("novel_chunks"), F.col("relevant_chunks"))).withColumn("chunk_hit", F.col("relevant_chunks") > 0).drop("dcg")


def summary(rows: DataFrame) -> DataFrame:
    """Per mode: macro averages over questions and micro ratios over all."""
    macro = ["chunk_precision", "evidence_recall", "answer_point_recall", "coverage_f1", "ndcg", "reciprocal_rank", "redundancy_rate", "novelty_rate"]
    out = rows.groupBy("mode").agg(
        F.count(F.lit(1)).alias("questions"),
        *[F.avg(F.coalesce(c, F.lit(0.0))).alias(f"macro_{c}") for c in macro],
        F.avg(F.col("chunk_hit").cast("double")).alias("macro_chunk_hit"),
        *[F.sum(c).alias(c) for c in ("relevant_chunks", "retrieved_chunks", "matched_evidence", "gold_evidence", "matched_points", "answer_points")],
    )
    out = out.withColumn("micro_precision", ratio(F.col("relevant_chunks"), F.col("retrieved_chunks")))
    out = out.withColumn("micro_evidence_recall", ratio(F.col("matched_evidence"), F.col("gold_evidence")))
    out = out.withColumn("micro_f1", harmonic(F.col("micro_precision"), F.col("micro_evidence_recall")))
    out = out.withColumn("micro_answer_point_recall", ratio(F.col("matched_points"), F.col("answer_points")))
    return out.drop("relevant_chunks", "retrieved_chunks", "matched_evidence", "gold_evidence", "matched_points", "answer_points")


# The names under which the evidence metrics are published, each with the column that has it.
REPORT = {
    "chunk_precision": "chunk_precision", "evidence_recall": "evidence_recall", "coverage_f1": "coverage_f1",
    "answer_point_recall": "answer_point_recall", "chunk_hit": "chunk_hit", "k": "retrieved_chunks", "precision_at_k": "chunk_precision",
    "evidence_recall_at_k": "evidence_recall", "answer_point_recall_at_k": "answer_point_recall", "reciprocal_rank": "reciprocal_rank",
    "ndcg_at_k": "ndcg", "first_relevant_rank": "first_relevant_rank", "redundancy_rate": "redundancy_rate",
    "retrieved_count": "retrieved_chunks", "relevant_retrieved_count": "relevant_chunks", "novel_relevant_count": "novel_chunks",
    "redundant_relevant_count": "redundant_chunks", "gold_evidence_count": "gold_evidence", "matched_evidence_count": "matched_evidence",
    "gold_answer_point_count": "answer_points", "matched_answer_point_count": "matched_points", **{name: name for name in LISTS},
}

# The averages of a summary, each with the column it is the mean of, and its micro ratios.
AVERAGES = {
    **{f"avg_{kind}_{m}": f"{kind}_{m}" for kind in ("entity", "relation") for m in ("recall", "precision", "f1")},
    "avg_chunk_precision": "chunk_precision", "avg_evidence_recall": "evidence_recall", "avg_answer_point_recall": "answer_point_recall",
    "avg_coverage_f1": "coverage_f1", "mean_reciprocal_rank": "reciprocal_rank", "avg_ndcg_at_k": "ndcg_at_k",
    "avg_chunk_redundancy_rate": "redundancy_rate", "entity_hit_rate": "entity_hit", "relation_hit_rate": "relation_hit", "chunk_hit_rate": "chunk_hit",
}
PROTOCOL = "canonical evidence coverage"


def evidence_report(rows: DataFrame) -> DataFrame:
    """The rows of ``evidence_metrics`` under their published names."""
    return rows.select("qid", *[F.col(column).alias(name) for name, column in REPORT.items()])


def evaluation_summary(rows: DataFrame) -> DataFrame:
    """Per mode of ``evaluation.evaluate``: the number of questions, the macro averages, and the micro ratios."""
    totals = ("retrieved_count", "relevant_retrieved_count", "gold_evidence_count", "matched_evidence_count", "gold_answer_point_count", "matched_answer_point_count")
    out = rows.groupBy("mode").agg(
        F.count(F.lit(1)).alias("count"),
        *[F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(name) for name, c in AVERAGES.items()],
        *[F.sum(c).alias(c) for c in totals],
    )
    out = out.withColumn("metric_protocol", F.lit(PROTOCOL))
    out = out.withColumn("micro_chunk_precision", ratio(F.col("relevant_retrieved_count"), F.col("retrieved_count")))
    out = out.withColumn("micro_evidence_recall", ratio(F.col("matched_evidence_count"), F.col("gold_evidence_count")))
    out = out.withColumn("micro_coverage_f1", harmonic(F.col("micro_chunk_precision"), F.col("micro_evidence_recall")))
    out = out.withColumn("micro_answer_point_recall", ratio(F.col("matched_answer_point_count"), F.col("gold_answer_point_count")))
    return out.drop(*totals)
