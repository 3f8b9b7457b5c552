"""Merging repeated entities and relations, and other first-occurrence operators.

Order is explicit: every merge takes the columns that order the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def relation_key(source: Column, target: Column) -> Column:
    """The endpoints in code-point order, joined by ||; empty when an endpoint is null or empty."""
    some = (F.length(F.coalesce(source, F.lit(""))) > 0) & (F.length(F.coalesce(target, F.lit(""))) > 0)
    return F.when(some, F.array_join(F.array_sort(F.array(source, target)), "||")).otherwise(F.lit(""))


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of every key. Which row survives matters, so this is not dropDuplicates; the rank limit
    is applied before the shuffle as well."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def latest_by(df: DataFrame, key: str, version: str) -> DataFrame:
    """Upsert: the last version of every key, as a key-value store would hold it."""
    return first_by(df, [key], [F.col(version).desc_nulls_last()])


def _ordered(values: Column, order: Column) -> Column:
    """Values of a group in order; (order, value) pairs are sorted inside the aggregate's result."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), values.alias("v")))), lambda s: s["v"])


def _joined(text: Column, order: Column) -> Column:
    kept = F.filter(_ordered(text, order), lambda t: F.length(F.coalesce(t, F.lit(""))) > 0)
    return F.array_join(kept, " | ")


def merge_entities(entities: DataFrame, order: str = "row_id") -> DataFrame:
    """One row per (file_id, name): the first type, the non-empty descriptions joined by " | ", and the ordered
    distinct sources. Names without characters, and rows without a file, are left out. A file is one document, so a group
    is bounded by it."""
    o = F.col(order)
    rows = entities.where((F.length("name") > 0) & F.col("file_id").isNotNull())
    return rows.groupBy("file_id", "name").agg(
        F.coalesce(F.min_by("type", o), F.lit("")).alias("type"),
        _joined(F.col("description"), o).alias("description"),
        F.array_distinct(F.flatten(_ordered(F.coalesce("source_id", F.array().cast("array<string>")), o))).alias("source_id"),
    )


def merge_relations(relations: DataFrame, order: str = "row_id") -> DataFrame:
    """One row per (file_id, undirected endpoints): the first orientation, keywords and sources in ordered
    distinct form, descriptions as for entities. ``first_seen`` is the order of the first row. Rows without a file are
    left out."""
    o = F.col(order)
    rows = relations.withColumn("rel_key", relation_key(F.col("source"), F.col("target"))).where((F.col("rel_key") != "") & F.col("file_id").isNotNull())
    lists = F.array().cast("array<string>")
    return rows.groupBy("file_id", "rel_key").agg(
        F.min_by("source", o).alias("source"),
        F.min_by("target", o).alias("target"),
        F.array_distinct(F.flatten(_ordered(F.coalesce("keywords", lists), o))).alias("keywords"),
        _joined(F.col("description"), o).alias("description"),
        F.array_distinct(F.flatten(_ordered(F.coalesce("source_id", lists), o))).alias("source_id"),
        F.min(o).alias("first_seen"),
    )


def entity_text(name: Column, description: Column) -> Column:
    return F.concat(name, F.lit(" "), F.coalesce(description, F.lit("")))


def relation_text(keywords: Column, description: Column) -> Column:
    return F.concat(F.array_join(keywords, " "), F.lit(" "), F.coalesce(description, F.lit("")))


def relation_line(source: Column, target: Column, keywords: Column, description: Column) -> Column:
    """The form in which a relation is reranked."""
    return F.concat(
        F.lit("source: "), source, F.lit("; target: "), target, F.lit("; keywords: "), F.array_join(keywords, ", "),
        F.lit("; description: "), F.coalesce(description, F.lit("")),
    )
