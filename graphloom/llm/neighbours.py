"""The k most similar vectors of every vector, by cosine.

An inverted file with product-quantised residuals. Coarse centroids and residual codebooks are fitted on a bounded
sample; every vector is indexed, in the cell of its nearest centroid, and every vector asks the ``PROBES`` nearest
cells. In a cell an asymmetric table per query (query part times codeword) scores all members, and the best
``SHORTLIST`` of them are scored again with the stored vectors in double precision.

Their number is the root of the number of vectors. Up to ``CENTROIDS`` are fitted; past that, every cell is divided by
second centroids that all cells share and that are fitted on what the first leave, so cells go on growing with the
root and the sample stays bounded. Cells of neighbouring centroids form a region, which one task works on: the cells
that a vector asks lie in few regions, and it travels once to each.

Vectors of one direction are indexed once and expanded afterwards, at most ``k + 1`` ids per place of a list, so a
direction shared by a third of all ids costs one row. Regions with many members or many questions are cut into
blocks: every question still meets every member of the cells it asks.

Recall against brute force with the settings below is given in the README.

Defined cases: vectors that are null, all zero, not of the given length, or hold a null, NaN or infinite value take
no part, and neither do null ids; repeated rows of an id count once (the least valid vector if they differ);
directions that agree to 12 decimals are equal; equal scores go to the smaller id; fewer than k others give fewer; one
vector alone and an empty table give nothing; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from graphloom.operators.skew import lookup
from graphloom.session import cut, task_count

#: Vectors that the centroids and codebooks are fitted on.
SAMPLE = 32_768
#: Coarse centroids, at most: each has eight vectors of the sample.
CENTROIDS = 4096
PROBES = 10
SHORTLIST = 128
PARTS = 32
CODEWORDS = 256
#: Members and questions of one block of a region.
BLOCK_MEMBERS = 32_768
BLOCK_QUERIES = 32_768


@dataclass
class Codec:
    """Coarse centroids (coarse, size), second ones (second, size), which are one zero where cells are not divided, and
    residual codebooks (PARTS, CODEWORDS, size / PARTS). Cell c is coarse c // second and second c % second; ``regions``
    has the region of each coarse centroid."""

    coarse: np.ndarray
    second: np.ndarray
    books: np.ndarray
    regions: np.ndarray

    def centre(self, cell: np.ndarray) -> np.ndarray:
        return self.coarse[cell // len(self.second)] + self.second[cell % len(self.second)]

    def own(self, x: np.ndarray) -> np.ndarray:
        """The cell of each vector: its nearest coarse centroid, and what is nearest to the rest."""
        first = np.argmax(x @ self.coarse.T, axis=1)
        if len(self.second) == 1:
            return first
        rest = x - self.coarse[first]
        return first * len(self.second) + np.argmax(2 * rest @ self.second.T - (self.second * self.second).sum(axis=1), axis=1)

    def asked(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The cells whose centres have the highest products, among those of the ``probes`` nearest coarse ones."""
        score = x @ self.coarse.T
        take = min(probes, score.shape[1])
        first = np.argpartition(-score, take - 1, axis=1)[:, :take]
        if len(self.second) == 1:
            return first
        both = np.take_along_axis(score, first, 1)[:, :, None] + (x @ self.second.T)[:, None, :]
        cells = (first[:, :, None] * len(self.second) + np.arange(len(self.second))).reshape(len(x), -1)
        take = min(probes, cells.shape[1])
        best = np.argpartition(-both.reshape(len(x), -1), take - 1, axis=1)[:, :take]
        return np.take_along_axis(cells, best, 1)

    def encode(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = x - self.centre(cell)
        parts, words, width = self.books.shape
        codes = np.empty((len(x), parts), dtype=np.uint8)
        for p in range(parts):
            piece, book = rest[:, p * width : (p + 1) * width], self.books[p]
            codes[:, p] = np.argmin((book * book).sum(axis=1) - 2 * piece @ book.T, axis=1)
        return codes


def _lloyd(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, unit: bool) -> np.ndarray:
    """k-means; with ``unit`` the centres are kept at length one. Empty centres take points at random."""
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        score = x @ centres.T if unit else 2 * x @ centres.T - (centres * centres).sum(axis=1)
        own = np.argmax(score, axis=1)
        count = np.bincount(own, minlength=k)
        order = np.argsort(own, kind="stable")
        total = np.zeros_like(centres)
        filled = np.flatnonzero(count)
        total[filled] = np.add.reduceat(x[order], np.concatenate(([0], np.cumsum(count)))[filled], axis=0)
        centres[filled] = total[filled] / count[filled, None]
        if unit:
            centres[filled] /= np.maximum(np.linalg.norm(centres[filled], axis=1), 1e-12)[:, None]
        empty = np.flatnonzero(count == 0)
        if len(empty):
            centres[empty] = x[rng.choice(len(x), len(empty))]
    return centres


def fit(sample: np.ndarray, total: int, cells: int | None = None, most: int = CENTROIDS, regions: int = 1, seed: int = 7) -> Codec:
    rng = np.random.default_rng(seed)
    x = (sample / np.linalg.norm(sample, axis=1)[:, None]).astype(np.float32)
    wanted = cells or max(1, round(total**0.5))
    coarse = _lloyd(x, int(max(1, min(wanted, most, len(x) // 8))), 10, rng, True)
    rest = x - coarse[np.argmax(x @ coarse.T, axis=1)]
    split = int(min(-(-wanted // len(coarse)), max(1, len(x) // 8))) if wanted > most else 1
    second = _lloyd(rest, split, 10, rng, False) if split > 1 else np.zeros((1, x.shape[1]), dtype=np.float32)
    apart = min(len(coarse), max(regions, total // BLOCK_MEMBERS))
    codec = Codec(coarse, second, np.empty(0), np.argmax(coarse @ _lloyd(coarse, apart, 10, rng, True).T, axis=1))
    rest = x - codec.centre(codec.own(x))
    width = x.shape[1] // PARTS
    rest = rest[rng.permutation(len(rest))[:16_384]]
    codec.books = np.stack([_lloyd(rest[:, p * width : (p + 1) * width].copy(), CODEWORDS, 6, rng, False) for p in range(PARTS)])
    return codec


def valid(vectors: DataFrame, size: int) -> DataFrame:
    """(id, vec), one row per id."""
    sound = ~F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = F.col("id").isNotNull() & (F.size("vec") == size) & F.coalesce(sound, F.lit(False)) & F.exists("vec", lambda v: v != 0)
    return vectors.select("id", "vec").where(good).groupBy("id").agg(F.min("vec").alias("vec"))


_ASSIGNED = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("raw", T.BinaryType()),
        T.StructField("codes", T.BinaryType()),
        T.StructField("cell", T.IntegerType()),
        T.StructField("region", T.IntegerType()),
        T.StructField("regions", T.ArrayType(T.IntegerType())),
        T.StructField("asked", T.ArrayType(T.ArrayType(T.IntegerType()))),
    ]
)
_BEST = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField(
            "best",
            T.ArrayType(T.StructType([T.StructField("minus", T.DoubleType()), T.StructField("other", T.StringType())])),
        ),
    ]
)


def _assigner(shared, probes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec: Codec = shared.value
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["vec"].to_numpy()).astype(np.float32)
            unit = x / np.linalg.norm(x.astype(np.float64), axis=1)[:, None].astype(np.float32)
            own = codec.own(unit)
            codes = codec.encode(unit, own)
            home = codec.regions[own // len(codec.second)]
            near = codec.asked(unit, probes)
            near[~(near == own[:, None]).any(axis=1), -1] = own[~(near == own[:, None]).any(axis=1)]  # the own cell is asked too
            where = codec.regions[near // len(codec.second)]
            order = np.argsort(where, axis=1, kind="stable")
            regions, asked = [], []
            for places, cells in zip(np.take_along_axis(where, order, 1).tolist(), np.take_along_axis(near, order, 1).tolist(), strict=True):
                heads = [i for i in range(len(places)) if not i or places[i] != places[i - 1]]
                regions.append([places[i] for i in heads])
                asked.append([cells[i:j] for i, j in zip(heads, [*heads[1:], None], strict=True)])
            yield pd.DataFrame(
                {"id": batch["id"], "raw": [r.tobytes() for r in x], "codes": [c.tobytes() for c in codes], "cell": own.astype(np.int32), "region": home.astype(np.int32), "regions": regions, "asked": asked}
            )

    return run


def _in_cell(codec: Codec, cell: int, codes: np.ndarray, stored: np.ndarray, q: np.ndarray, shortlist: int) -> tuple[np.ndarray, np.ndarray]:
    """(members, exact scores), each a row per query: the shortlists of the members of a cell by asymmetric tables."""
    parts, _, width = codec.books.shape
    take = min(shortlist, len(stored))
    if take == len(stored):
        return np.tile(np.arange(take), (len(q), 1)), q @ stored.T
    q32 = q.astype(np.float32)
    # Tables (part, codeword, query): a member's scores are sums of rows.
    tables = np.matmul(codec.books, q32.reshape(len(q), parts, width).transpose(1, 2, 0))
    score = np.repeat((q32 @ codec.centre(np.array([cell]))[0])[None, :], len(stored), axis=0)
    part = np.empty_like(score)
    for p in range(parts):
        np.take(tables[p], codes[p], axis=0, out=part, mode="clip")
        score += part
    near = np.argpartition(-score.T, take - 1, axis=1)[:, :take]
    return near, np.einsum("qsw,qw->qs", stored[near], q)


def _searcher(shared, k: int, shortlist: int):
    def run(_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        codec: Codec = shared.value
        rows = rows.sort_values("id", kind="stable")  # of equal scores the first has the smaller id
        ids = rows["id"].to_numpy()
        exact = np.frombuffer(b"".join(rows["raw"]), dtype=np.float32).reshape(len(rows), -1).astype(np.float64)
        exact /= np.linalg.norm(exact, axis=1)[:, None]
        held = np.flatnonzero(rows["codes"].notna().to_numpy())
        own = rows["cell"].to_numpy()[held]
        asked = rows["asked"].to_numpy()
        counts = np.array([0 if a is None else len(a) for a in asked])
        if not len(held) or not counts.sum():
            return pd.DataFrame({"id": [], "best": []})
        codes = np.frombuffer(b"".join(rows["codes"].to_numpy()[held]), dtype=np.uint8).reshape(len(held), -1)
        asker = np.repeat(np.arange(len(rows)), counts)
        wanted = np.concatenate([a for a in asked if a is not None and len(a)])
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for cell in np.unique(own):
            members, queries = held[own == cell], asker[wanted == cell]
            part = np.ascontiguousarray(codes[own == cell].T).astype(np.intp)
            for start in range(0, len(queries), 128):
                who = queries[start : start + 128]
                near, true = _in_cell(codec, int(cell), part, exact[members], exact[who], shortlist)
                near = members[near]
                true[near == who[:, None]] = -np.inf
                if true.shape[1] > k:
                    # All that are no worse than the k-th, so that ties are decided among all.
                    least = -np.partition(-true, k - 1, axis=1)[:, k - 1 : k]
                    i, j = np.nonzero((true >= least) & (true > -np.inf))
                else:
                    i, j = np.nonzero(true > -np.inf)
                found.append((who[i], true[i, j], near[i, j]))
        if not found:
            return pd.DataFrame({"id": [], "best": []})
        who, score, other = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((other, -score, who))
        who, score, other = who[order], score[order], other[order]
        heads = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
        rank = np.arange(len(who)) - np.repeat(heads, np.diff(np.append(heads, len(who))))
        who, score, other = who[rank < k], score[rank < k], other[rank < k]
        heads = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
        hits = [{"minus": -m, "other": o} for m, o in zip(score.tolist(), ids[other].tolist(), strict=True)]
        best = [hits[a:b] for a, b in zip(heads, [*heads[1:], len(hits)], strict=True)]
        return pd.DataFrame({"id": ids[who[heads]], "best": best})

    return run


def _lists(distinct: DataFrame, k: int, probes: int, shortlist: int, sample: int, cells: int | None, most: int) -> DataFrame:
    """(id, best): for each of the distinct vectors its k best others, nearest first."""
    spark = distinct.sparkSession
    total = distinct.count()
    chosen = distinct.orderBy(F.xxhash64("id"), "id").limit(sample).select("vec").toPandas()
    if total < 2:
        return spark.createDataFrame([], _BEST)
    tasks = task_count(spark) * 2
    codec = spark.sparkContext.broadcast(fit(np.stack(chosen["vec"].to_numpy()).astype(np.float64), total, cells, most, tasks))
    assigned = cut(distinct.repartition(task_count(spark)).mapInPandas(_assigner(codec, probes), _ASSIGNED))
    # At most one row per centroid.
    held = assigned.groupBy("region").agg(F.count(F.lit(1)).alias("members"), F.lit(0).cast("bigint").alias("queries"))
    asked = assigned.select(F.explode("regions").alias("region")).groupBy("region").agg(F.lit(0).cast("bigint").alias("members"), F.count(F.lit(1)).alias("queries"))
    load = held.unionByName(asked).groupBy("region").agg(F.sum("members").alias("members"), F.sum("queries").alias("queries"))
    blocks = load.select(
        "region",
        F.ceil(F.greatest("members", F.lit(1)) / BLOCK_MEMBERS).cast("int").alias("mb"),
        F.ceil(F.greatest("queries", F.lit(1)) / BLOCK_QUERIES).cast("int").alias("qb"),
    )
    # A member stands in its own member block before every question block; a question in its own question block
    # before every member block. A row that is both in one block is sent once. The own region is always asked.
    sent = assigned.select("id", "raw", "codes", "cell", F.col("region").alias("home"), F.explode(F.arrays_zip("regions", "asked")).alias("r"))
    sent = sent.select("id", "raw", "codes", "cell", "home", F.col("r.regions").alias("region"), F.col("r.asked").alias("asked")).join(F.broadcast(blocks), "region")
    own = F.col("home") == F.col("region")
    h = F.xxhash64("id")
    mine, turn = F.pmod(h, F.col("mb")), F.pmod(h, F.col("qb"))
    every_q = F.transform(F.sequence(F.lit(0), F.col("qb") - 1), lambda q: F.struct(mine.cast("int").alias("m"), q.alias("q"), (q == turn).alias("asks"), own.alias("held")))
    every_m = F.transform(F.sequence(F.lit(0), F.col("mb") - 1), lambda m: F.struct(m.alias("m"), turn.cast("int").alias("q"), F.lit(True).alias("asks"), (own & (m == mine)).alias("held")))
    spots = F.when(own, F.concat(every_q, F.filter(every_m, lambda s: s["m"] != mine))).otherwise(every_m)
    placed = sent.select("region", "id", "raw", "codes", "cell", "asked", F.explode(spots).alias("s")).select(
        "region", F.col("s.m").alias("m"), F.col("s.q").alias("q"), "id", "raw", "cell", F.when(F.col("s.held"), F.col("codes")).alias("codes"), F.when(F.col("s.asks"), F.col("asked")).alias("asked")
    )
    placed = placed.repartition(tasks, "region", "m", "q")
    found = placed.groupBy("region", "m", "q").applyInPandas(_searcher(codec, k, shortlist), _BEST)
    merged = found.groupBy("id").agg(F.flatten(F.collect_list("best")).alias("best"))
    return merged.select("id", F.slice(F.array_sort("best"), 1, k).alias("best"))


def nearest(
    vectors: DataFrame, k: int = 5, size: int = 64, probes: int = PROBES, shortlist: int = SHORTLIST, sample: int = SAMPLE,
    cells: int | None = None, most: int = CENTROIDS,
) -> DataFrame:
    """(id, rank, other, score), rank from 1. ``cells`` is their number where it is not to follow from that of the vectors."""
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double")))
    found = valid(vectors, size).withColumn("length", length)
    unit = F.transform("vec", lambda v: F.rint(v / F.col("length") * 1e12) + 0.0)
    # A direction is told by 128 bits of hashes.
    found = found.select("id", "vec", unit.alias("unit")).select("id", "vec", F.xxhash64("unit").alias("h1"), F.xxhash64(F.reverse("unit")).alias("h2"))
    rows = cut(found)
    # Ids of one direction: the least id stands for them. Windows that keep k + 1 ids prune before the shuffle.
    groups = rows.groupBy("h1", "h2").agg(F.min(F.struct("id", "vec")).alias("rep"), F.count(F.lit(1)).alias("n"))
    shared = groups.where(F.col("n") > 1).select("h1", "h2", F.col("rep.id").alias("rep"), "n")
    lists = _lists(groups.select("rep.id", "rep.vec"), k, probes, shortlist, sample, cells, most)
    several = cut(lookup(rows.select("id", "h1", "h2"), shared, ["h1", "h2"], ["rep"], F.xxhash64("id"), shared).where(F.col("rep").isNotNull()).select("rep", "id"))
    ranked = several.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("r") <= k + 1)
    firsts = ranked.groupBy("rep").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    edges = lists.select(F.col("id").alias("rep"), F.explode("best").alias("b")).select("rep", F.col("b.minus").alias("minus"), F.col("b.other").alias("other"))
    edges = edges.unionByName(firsts.select("rep", F.lit(-1.0).alias("minus"), F.col("rep").alias("other")))
    wide = edges.join(firsts.select(F.col("rep").alias("other"), "ids"), "other", "left")
    wide = wide.select("rep", "minus", F.explode(F.coalesce("ids", F.array("other"))).alias("other"))
    # Own equals come first: nothing is nearer than an equal direction.
    best = wide.groupBy("rep").agg(F.slice(F.array_sort(F.collect_list(F.struct("minus", "other"))), 1, k + 1).alias("best"))
    alone = best.join(firsts.select("rep"), "rep", "left_anti").select(F.col("rep").alias("id"), "best")
    grouped = lookup(several, best, ["rep"], ["best"], F.xxhash64("id")).select("id", "best")
    both = alone.unionByName(grouped).select("id", F.slice(F.filter("best", lambda b: b["other"] != F.col("id")), 1, k).alias("best"))
    out = both.select("id", F.posexplode("best").alias("pos", "b"))
    return out.select("id", (F.col("pos") + 1).alias("rank"), F.col("b.other").alias("other"), (-F.col("b.minus")).alias("score"))


def pairs(lists: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: the pairs in which one is in the list of the other."""
    return lists.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
