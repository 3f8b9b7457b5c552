"""Joins that survive a key holding a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import task_count

#: So many of the heaviest keys are salted. Any other key has, by counting, less than one part in HOT_KEYS of all
#: rows, so no reduce task can be swamped by a single key.
HOT_KEYS = 1024
#: Places that the rows of a heavy key are spread over, at most.
SALTS = 256


def heaviest(rows: DataFrame, keys: list[str], hot_keys: int = HOT_KEYS) -> DataFrame:
    """(keys, n) of the heaviest keys; counted with map-side combine. Nulls are no key."""
    full = rows.dropna("any", subset=keys)
    return full.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), *keys).limit(hot_keys)


def lookup(
    rows: DataFrame,
    table: DataFrame,
    keys: list[str],
    values: list[str],
    spread: Column,
    weights: DataFrame | None = None,
    hot_keys: int = HOT_KEYS,
) -> DataFrame:
    """Left join ``rows`` to ``table`` (unique on ``keys``), adding ``values``, safe under skew.

    ``weights`` has ``keys`` and ``n``, the rows of each key; it is counted when not given. The heaviest keys, at most
    ``hot_keys`` whatever the data, are broadcast to mark them: a row of one goes to one of up to ``SALTS`` places (by
    ``spread``), and its table row to all of them. Null keys match nothing and are spread likewise. Both inputs are
    read once, and meet in one shuffle join.
    """
    salts = max(2, min(SALTS, task_count(rows.sparkSession)))
    if weights is None:
        hot = heaviest(rows, keys, hot_keys)
    else:
        hot = weights.dropna("any", subset=keys).orderBy(F.desc("n"), *keys).limit(hot_keys)
    hot = F.broadcast(hot.select(*keys, F.lit(True).alias("_hot")))
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    salt = F.when(F.col("_hot") | null, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    left = rows.join(hot, keys, "left").withColumn("_salt", salt).drop("_hot")
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = table.join(hot, keys, "left").select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.explode(every).alias("_s"), *[F.col(v).alias(f"_v_{v}") for v in values])
    on = F.col("_salt") == F.col("_s")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_k_{k}"))
    out = left.join(right, on, "left")
    kept = [c for c in rows.columns if c not in values]
    return out.select(*kept, *[F.col(f"_v_{v}").alias(v) for v in values])
