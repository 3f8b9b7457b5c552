"""Exact nearest neighbours by cosine: a stated set of queries against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.vectors import cosine_of, dot, norm

#: Queries that are broadcast at once: 4096 of 1024 doubles are 32 MB.
QUERY_BLOCK = 4096

_HITS = T.StructType(
    [
        T.StructField("qid", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _local(blocks: list, k: int):
    """The best k of every batch for every query; ties are kept, so that the id decides among all rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sides = [shared.value for shared in blocks]
        width = sides[0][1].shape[1]
        for batch in batches:
            batch = batch[batch["vec"].map(len).to_numpy() == width]
            if not len(batch):
                continue
            x = np.stack(batch["vec"].to_numpy()).astype(np.float64)
            length = np.sqrt((x * x).sum(axis=1))
            x, ids, length = x[length > 0], batch["id"].to_numpy()[length > 0], length[length > 0]
            if not len(x):
                continue
            take = min(k, len(x))
            for qids, matrix, norms in sides:
                for start in range(0, len(qids), 256):
                    score = (matrix[start : start + 256] @ x.T) / (norms[start : start + 256, None] * length[None, :])
                    least = -np.partition(-score, take - 1, axis=1)[:, take - 1 : take]
                    q, r = np.nonzero(score >= least)
                    yield pd.DataFrame({"qid": [qids[start + i] for i in q], "id": ids[r], "score": score[q, r]})

    return run


def top_k(queries: DataFrame, vectors: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """queries (qid, vec) x vectors (id, vec) -> (qid, id, score, rank). Null and zero vectors, and those of another
    length than the queries', have no score and are left out; ties go to the smaller id. The queries, which are a stated
    set, are counted first and broadcast in blocks; the vectors are read once for all of them."""
    spark = vectors.sparkSession
    queries = queries.select(F.col("qid").cast("string").alias("qid"), "vec").where(norm(F.col("vec")) > 0)
    rows = vectors.select(F.col("id").cast("string").alias("id"), "vec").where(F.size("vec") > 0)
    blocks = max(1, -(-queries.count() // block))
    shared = []
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).orderBy("qid").toPandas()
        if len(part):
            matrix = np.stack(part["vec"].to_numpy()).astype(np.float64)
            shared.append(spark.sparkContext.broadcast((list(part["qid"]), matrix, np.sqrt((matrix * matrix).sum(axis=1)))))
    if not shared:
        return spark.createDataFrame([], "qid string, id string, score double, rank int")
    return _ranked(rows.mapInPandas(_local(shared, k), _HITS), k)


def top_k_within(queries: DataFrame, candidates: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The same among given candidates (qid, id) only: joins by key, no query meets all rows."""
    q = queries.select("qid", F.col("vec").alias("_q"), norm(F.col("vec")).alias("_qn"))
    v = vectors.select("id", F.col("vec").alias("_v"), norm(F.col("vec")).alias("_vn"))
    pairs = candidates.select("qid", "id").distinct().join(q, "qid").join(v, "id").where((F.col("_qn") > 0) & (F.col("_vn") > 0))
    scored = pairs.select("qid", "id", cosine_of(dot(F.col("_q"), F.col("_v")), F.col("_qn"), F.col("_vn")).alias("score"))
    return _ranked(scored, k)


def get_vector(vectors: DataFrame, keys: DataFrame) -> DataFrame:
    """Vectors by id; ids without one have null."""
    return keys.select("id").join(vectors.select("id", "vec"), "id", "left")
