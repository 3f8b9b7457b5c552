"""The undirected graph of merged entities and relations, per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.merge import first_by, relation_key

# Colours of entity types; any other type is grey.
COLOURS = {
    "Artifact": "#d73027", "Person": "#fc8d59", "Concept": "#fee090", "Location": "#4575b4", "NaturalObject": "#91bfdb",
    "Content": "#ac667e", "Creature": "#8e44ad", "Event": "#f9ae78", "Organization": "#12685d", "Method": "#00a391",
    "Data": "#63bbb0",
}
GREY = "#999999"


def edges(relations: DataFrame) -> DataFrame:
    """(file_id, node, neighbour, rel_key, first_seen): each edge from both ends; a loop from one."""
    there = relations.select("file_id", F.col("source").alias("node"), F.col("target").alias("neighbour"), "rel_key", "first_seen")
    back = relations.where(F.col("source") != F.col("target")).select(
        "file_id", F.col("target").alias("node"), F.col("source").alias("neighbour"), "rel_key", "first_seen"
    )
    return there.unionByName(back)


def vertices(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Every entity and every endpoint; ``known`` is false for endpoints without an entity."""
    ends = relations.select("file_id", F.explode(F.array("source", "target")).alias("name")).distinct()
    marked = entities.select("file_id", "name", "type", "description", "source_id", F.lit(True).alias("known"))
    return ends.join(marked, ["file_id", "name"], "full").withColumn("known", F.coalesce("known", F.lit(False)))


def get_node(keys: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Vertices by key (file_id, name). ``found`` is false where the graph has none; an endpoint without an entity is
    found, with nulls for what an entity would have."""
    rows = vertices(entities, relations).withColumn("found", F.lit(True))
    return keys.select("file_id", "name").join(rows, ["file_id", "name"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def get_edge(keys: DataFrame, relations: DataFrame) -> DataFrame:
    """Edges by key (file_id, source, target), whichever way round; null where there is none."""
    rows = relations.select("file_id", "rel_key", "keywords", "description", "source_id", F.lit(True).alias("found"))
    asked = keys.select("file_id", "source", "target", relation_key(F.col("source"), F.col("target")).alias("rel_key"))
    return asked.join(rows, ["file_id", "rel_key"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def dangling(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Endpoints that no entity has."""
    ends = relations.select("file_id", F.explode(F.array("source", "target")).alias("name")).distinct()
    return ends.join(entities, ["file_id", "name"], "left_anti")


def degrees(relations: DataFrame) -> DataFrame:
    """A loop counts twice."""
    ends = relations.select("file_id", F.explode(F.array("source", "target")).alias("name"))
    return ends.groupBy("file_id", "name").agg(F.count(F.lit(1)).alias("degree"))


def colour(kind: Column) -> Column:
    out = F.when(F.lit(False), F.lit(GREY))
    for name, value in COLOURS.items():
        out = out.when(kind == name, F.lit(value))
    return out.otherwise(F.lit(GREY))


def node_style(entities: DataFrame, relations: DataFrame) -> DataFrame:
    v = vertices(entities, relations).join(degrees(relations), ["file_id", "name"], "left")
    degree = F.coalesce("degree", F.lit(0)).cast("bigint")
    chunks = F.coalesce(F.size("source_id"), F.lit(0))
    return v.select(
        "file_id", "name", degree.alias("degree"), (F.lit(10.0) + F.sqrt(degree.cast("double")) * 4).alias("size"),
        colour(F.col("type")).alias("colour"), F.when(F.col("known"), chunks).otherwise(0).cast("bigint").alias("chunks"),
    )


def edge_style(relations: DataFrame) -> DataFrame:
    return relations.select("file_id", "rel_key", (F.size("keywords") + 1).cast("bigint").alias("width"), F.col("description").alias("title"))


def one_hop(seeds: DataFrame, relations: DataFrame) -> DataFrame:
    """(qid, file_id, rel_key, place): the relations next to the seeds (qid, file_id, name, rank), each once, in the
    order of the seed's rank and then of first sight."""
    e = edges(relations).select(F.col("file_id").alias("e_file"), "node", "rel_key", "first_seen")
    near = seeds.join(e, (F.col("file_id") == F.col("e_file")) & (F.col("name") == F.col("node")))
    near = near.select("qid", "file_id", "rel_key", F.struct("rank", "first_seen", "rel_key").alias("place"))
    return first_by(near, ["qid", "file_id", "rel_key"], ["place"])
