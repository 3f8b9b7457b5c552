"""Best representative of each group of duplicate entity rows.

Groups are rows of one file with names alike. A row is measured by how many of type, description and
source_id are filled, by extracted_at, and by the trust of its run.

* All rows of a group are peeled into dominance layers (Pareto over completeness, recency, trust). Their distinct
  measures lie sorted by group and time over range partitions, and a group may reach over many: what a stretch of a
  group does to the layers after it is a small matrix, so stretches are worked on apart and their matrices chained.
* Of the rows with the same filled fields and trust the latest (of several the smallest row_id) stands in the lowest
  layer, so only these can give a value: at most 8 filled sets times the number of ranks, however large the group.
  They are found by an aggregation that combines before the shuffle.
* Policy: the survivor is the first layer's row with the most filled fields, then the latest, then the most
  trusted, then the smallest row_id. Its unfilled fields come from the next rows in the order of layer, then
  of the same policy.

Defined cases: blank names and null file_id make no group; a null extracted_at is older than any other; a
run without a trust_rank, or null, is below every rank; a placeholder, blank, null or empty list is not
filled (a list is filled when it has an element that is not blank); ties go to the smallest row_id; a row_id
that is repeated makes no second row of a group, though ``size`` counts it; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.text import alike_key, is_blank, strip
from graphloom.session import cut, task_count

# Strings that stand for no value, in folded form without punctuation around them.
PLACEHOLDERS = (
    "n/a", "na", "n.a", "n a", "none", "null", "nil", "nan", "unknown", "unk", "undefined", "unspecified",
    "not available", "not applicable", "missing", "empty", "tbd", "tba", "tbc", "todo",
)


def filled_text(c: Column) -> Column:
    """Neither null nor blank nor a placeholder: something is left when punctuation is cut off its ends, and
    it is not one of PLACEHOLDERS. Never null."""
    core = F.lower(F.regexp_replace(c, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return ~is_blank(c) & F.coalesce((core != "") & ~core.isin(*PLACEHOLDERS), F.lit(False))


def filled_list(c: Column) -> Column:
    return F.coalesce(F.exists(c, lambda x: F.coalesce(F.length(strip(x)) > 0, F.lit(False))), F.lit(False))


def measured(entities: DataFrame, runs: DataFrame) -> DataFrame:
    """The rows that belong to a group, with their measures. ``runs`` is joined as it is sized: a small
    table is broadcast by the planner, a large one is not."""
    rank = runs.where(F.col("run_id").isNotNull()).groupBy("run_id").agg(F.max("trust_rank").alias("trust"))
    rows = entities.where(F.col("file_id").isNotNull() & ~is_blank(F.col("name"))).select(
        "file_id",
        alike_key(F.col("name")).alias("name_key"),
        "row_id",
        "run_id",
        "extracted_at",
        F.when(filled_text(F.col("type")), F.col("type")).alias("type"),
        F.when(filled_text(F.col("description")), F.col("description")).alias("description"),
        F.when(filled_list(F.col("source_id")), F.col("source_id")).alias("source_id"),
    )
    rows = rows.join(rank, "run_id", "left").drop("run_id")
    bits = [F.col(c).isNotNull().cast("int") for c in ("type", "description", "source_id")]
    rows = rows.withColumn("filled", bits[0] + 2 * bits[1] + 4 * bits[2]).withColumn("complete", sum(bits[1:], bits[0]))
    at = F.coalesce(F.unix_micros(F.col("extracted_at").cast("timestamp")), F.lit(-(2**62)))
    return rows.withColumn("at", at).withColumn("trust", F.coalesce(F.col("trust").cast("bigint"), F.lit(-(2**62))))


Cell = tuple[int, int]  # completeness, trust


Point = tuple[int, int, int, int]  # filled fields, completeness, trust, time


def chain(points: Iterable[Point], state: dict[Cell, int]) -> Iterator[int]:
    """The layer of each point, latest, then fullest, then most trusted first; ``state`` has the deepest layer of each
    cell so far, and is kept up to date. A layer is one more than the deepest that dominates it; points of one
    measure share theirs."""
    before, layer = None, 0
    for _, complete, trust, at in points:
        if (complete, trust, at) != before:
            layer = 1 + max((v for (c, t), v in state.items() if c >= complete and t >= trust), default=0)
            state[complete, trust] = layer
            before = (complete, trust, at)
        yield layer


def transfer(points: Iterable[Point]) -> dict[Cell, dict[Cell, int]]:
    """What a stretch of points does to later ones: for each of its cells the longest chain that ends there, by the
    cell it begins below."""
    rows: dict[Cell, dict[Cell, int]] = {}
    before = None
    for _, complete, trust, at in points:
        if (complete, trust, at) == before:
            continue
        before = (complete, trust, at)
        row = {(complete, trust): 0}
        for (c, t), other in rows.items():
            if c >= complete and t >= trust:
                for cell, length in other.items():
                    row[cell] = max(row.get(cell, 0), length)
        rows[complete, trust] = {cell: length + 1 for cell, length in row.items()}
    return rows


def carried(state: dict[Cell, int], stretch: dict[Cell, dict[Cell, int]]) -> dict[Cell, int]:
    """The state after a stretch."""
    entry = {cell: max((v for (c, t), v in state.items() if c >= cell[0] and t >= cell[1]), default=0) for cell in stretch}
    return state | {cell: max(entry[begin] + length for begin, length in row.items()) for cell, row in stretch.items()}


_GROUP = ["file_id", "name_key"]
_EDGES = T.StructType([T.StructField("place", T.IntegerType()), *[T.StructField(g, T.StringType()) for g in _GROUP], T.StructField("stretch", T.BinaryType())])
_LAYERS = T.StructType(
    [
        *[T.StructField(g, T.StringType()) for g in _GROUP],
        T.StructField("filled", T.IntegerType()),
        T.StructField("trust", T.LongType()),
        T.StructField("layer", T.IntegerType()),
    ]
)


def _stretches(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, list, bool]]:
    """(place, file, name), its points and whether it is the last of its partition; one group at a time."""
    key, points = None, []
    for batch in batches:
        for row in zip(*[batch[c] for c in ("place", *_GROUP, "filled", "complete", "trust", "at")], strict=True):
            if row[:3] != key:
                if key:
                    yield key, points, False
                key, points = row[:3], []
            points.append(row[3:])
    if key:
        yield key, points, True


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The first and the last group of a partition, which may go on elsewhere."""
    first = True
    for key, points, last in _stretches(batches):
        if first or last:
            yield pd.DataFrame([(*key, pickle.dumps(transfer(points)))], columns=_EDGES.names)
        first = False


def _starts(rows: pd.DataFrame) -> pd.DataFrame:
    """For one group: the state that each of its stretches but the first begins with."""
    rows = rows.sort_values("place")
    state: dict[Cell, int] = {}
    out = []
    for row in rows.itertuples(index=False):
        if state:
            out.append((*row[:3], pickle.dumps(state)))
        state = carried(state, pickle.loads(row[3]))
    return pd.DataFrame(out, columns=_EDGES.names)


def layers(rows: DataFrame) -> DataFrame:
    """(file_id, name_key, filled, trust, layer): the lowest layer of each filled set and trust in a group, and under
    filled -1 the number of the group's layers. Groups with one measure only are left out."""
    spark = rows.sparkSession
    order = [*_GROUP, F.desc("at"), F.desc("complete"), F.desc("trust")]  # rows of one measure stay together
    points = rows.select(*_GROUP, "filled", "complete", "trust", "at").distinct()
    points = points.repartitionByRange(task_count(spark), *order).sortWithinPartitions(*order)
    points = cut(points.withColumn("place", F.spark_partition_id()))
    # At most one state per partition, of as many numbers as a group has cells.
    starts = points.mapInPandas(_edges, _EDGES).groupBy(*_GROUP).applyInPandas(_starts, _EDGES).collect()
    shared = spark.sparkContext.broadcast({(r["place"], r["file_id"], r["name_key"]): bytes(r["stretch"]) for r in starts})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for key, points, last in _stretches(batches):
            held = shared.value.get(key)
            if len(points) == 1 and not held and not last:
                continue
            state = pickle.loads(held) if held else {}
            seen: dict[Cell, int] = {}
            for (filled, _, trust, _), layer in zip(points, chain(points, state), strict=True):
                seen.setdefault((filled, trust), layer)
            out.extend((*key[1:], f, t, layer) for (f, t), layer in seen.items())
            out.append((*key[1:], -1, 0, max(state.values())))
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=_LAYERS.names)
                out = []
        yield pd.DataFrame(out, columns=_LAYERS.names)

    found = points.mapInPandas(run, _LAYERS)
    least = F.when(F.col("filled") < 0, F.max("layer")).otherwise(F.min("layer"))
    return found.groupBy(*_GROUP, "filled", "trust").agg(least.alias("layer"))



def candidates(rows: DataFrame) -> DataFrame:
    """One row per group of two rows or more: ``size``, ``first_id``, ``layers`` and the array ``order`` of its
    candidates, by layer and then policy."""
    best = F.max(F.struct("at", (-F.col("row_id")).alias("minus_id"), "type", "description", "source_id"))
    cells = rows.groupBy(*_GROUP, "filled", "complete", "trust").agg(
        best.alias("b"), F.count(F.lit(1)).alias("n"), F.min("row_id").alias("low"), F.max("row_id").alias("high")
    )
    found = layers(rows)
    deepest = found.where(F.col("filled") < 0).select(*_GROUP, F.col("layer").alias("layers"))
    cells = cells.join(found, [*_GROUP, "filled", "trust"], "left")
    one = F.struct(
        F.coalesce("layer", F.lit(1)).alias("layer"),
        (-F.col("complete")).alias("minus_complete"),
        (-F.col("b.at")).alias("minus_at"),
        (-F.col("trust")).alias("minus_trust"),
        (-F.col("b.minus_id")).alias("row_id"),
        F.col("b.type").alias("type"),
        F.col("b.description").alias("description"),
        F.col("b.source_id").alias("source_id"),
    )
    groups = cells.groupBy(*_GROUP).agg(
        F.sum("n").alias("size"), F.min("low").alias("first_id"), F.max("high").alias("last_id"), F.array_sort(F.collect_list(one)).alias("order")
    )
    groups = groups.where(F.col("first_id") < F.col("last_id")).drop("last_id")
    return groups.join(deepest, _GROUP, "left").withColumn("layers", F.coalesce("layers", F.lit(1)))


def survivors(entities: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per group of two rows or more: (file_id, first_id, size, row_id, type, description, source_id,
    layers, ideal). ``ideal`` says that the survivor is behind no row of its group in any respect."""

    def first_filled(field: str) -> Column:
        kept = F.filter("order", lambda d: d[field].isNotNull())
        return F.when(F.size(kept) > 0, kept[0][field])

    top = F.col("order")[0]
    ahead = ("minus_complete", "minus_at", "minus_trust")
    # Read for the layers and for the candidates, so it is written out once.
    return candidates(cut(measured(entities, runs))).select(
        "file_id",
        "first_id",
        "size",
        top["row_id"].alias("row_id"),
        first_filled("type").alias("type"),
        first_filled("description").alias("description"),
        first_filled("source_id").alias("source_id"),
        "layers",
        F.forall("order", lambda r: (r[ahead[0]] >= top[ahead[0]]) & (r[ahead[1]] >= top[ahead[1]]) & (r[ahead[2]] >= top[ahead[2]])).alias("ideal"),
    )
