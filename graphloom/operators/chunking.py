"""Splitting documents into chunks: fixed size, sentence windows, semantic boundaries.

Each takes (file_id, text) rows and gives (chunk_id, file_id, pos, text), with pos from 1. All of it is narrow:
no strategy shuffles. Null and empty texts give no chunk.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.config import ChunkConfig
from graphloom.functions.let import let
from graphloom.functions.sentences import split_sentences
from graphloom.functions.vectors import cosine_of, dot, letter_frequencies, norm

Embedder = Callable[[Column], Column]


def numbered(df: DataFrame, parts: Column) -> DataFrame:
    """One row per element of ``parts``, with the chunk key."""
    rows = df.select("file_id", F.posexplode(parts).alias("_i", "text"))
    pos = F.col("_i") + 1
    return rows.select(F.concat("file_id", F.lit("_chunk_"), pos.cast("string")).alias("chunk_id"), "file_id", pos.alias("pos"), "text")


#: Windows of a section: a long text is cut into sections first, as a window is looked for from where its text begins.
SECTION_WINDOWS = 16


def fixed_parts(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` at every ``size - overlap``; the last may lie within the one before."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))
    short = F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size)))
    room = step * SECTION_WINDOWS
    over = -(-overlap // room)  # sections that the last window of one reaches into

    def windows(sections: Column) -> Column:
        def one(i: Column) -> Column:
            section = F.floor(i / room).cast("int")
            return F.substring(F.array_join(F.slice(sections, section + 1, F.lit(over + 1)), ""), i - section * room + 1, F.lit(size))

        return F.transform(starts, one)

    long = let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{room}}}"), F.lit(0)), windows)
    return F.when(F.length(text) > room, long).when(F.length(text) > 0, short)


def window_parts(sentences: Column, size: int, overlap: int) -> Column:
    """Windows of sentences; a last one is aligned with the end when the steps do not reach it."""

    def windows(s: Column) -> Column:
        n = F.size(s)
        starts = F.array_distinct(F.concat(F.sequence(F.lit(0), n - size, F.lit(size - overlap)), F.array(n - size)))
        many = F.transform(starts, lambda i: F.array_join(F.slice(s, i + 1, F.lit(size)), " "))
        return F.when(n > size, many).when(n > 0, F.array(F.array_join(s, " ")))

    return let(sentences, windows)


def context(sentences: Column, buffer: int) -> Column:
    """Each sentence with its neighbours, clipped at the ends."""

    def around(s: Column) -> Column:
        n = F.size(s)

        def one(_: Column, i: Column) -> Column:
            first = F.greatest(i - buffer, F.lit(0))
            return F.array_join(F.slice(s, first + 1, F.least(i + buffer, n - 1) - first + 1), " ")

        return F.transform(s, one)

    return let(sentences, around)


def with_sentences(df: DataFrame) -> DataFrame:
    return df.select("file_id", split_sentences(F.col("text")).alias("sentences")).where(F.size("sentences") > 0)


def with_distances(df: DataFrame, buffer: int, embed: Embedder = letter_frequencies) -> DataFrame:
    """Adds ``distances``: 1 - cosine of the contexts of neighbouring sentences. Needs ``sentences``."""

    def distances(e: Column, n: Column) -> Column:
        pairs = F.sequence(F.lit(0), F.size(e) - 2)
        far = F.transform(pairs, lambda i: F.lit(1.0) - cosine_of(dot(e[i], e[i + 1]), n[i], n[i + 1]))
        return F.when(F.size(e) > 1, far).otherwise(F.expr("CAST(array() AS ARRAY<DOUBLE>)"))

    embedded = F.transform(context(F.col("sentences"), buffer), embed)
    return df.withColumn("distances", let(embedded, lambda e: let(F.transform(e, norm), lambda n: distances(e, n))))


def percentile(values: Column, p: float) -> Column:
    """Linear interpolation at (n - 1) p / 100 of the sorted values; 0 for none."""

    def at(s: Column) -> Column:
        rank = (F.size(s) - 1) * F.lit(float(p)) / F.lit(100.0)
        low = F.floor(rank).cast("int")
        w = rank - low
        high = F.least(low + 1, F.size(s) - 1)
        return F.when(F.size(s) > 0, s[low] * (F.lit(1.0) - w) + s[high] * w).otherwise(F.lit(0.0))

    return let(F.array_sort(values), at)


def boundaries(distances: Column, threshold: Column, n: Column, least: int, most: int) -> Column:
    """The last sentence of each chunk: cut after i when the chunk has ``least`` and its distance reaches the
    threshold, or when it has ``most``; a tail under ``least`` joins the chunk before. The three columns have to be
    bound (``let``) by the caller."""
    zero = F.struct(F.lit(0).alias("start"), F.expr("CAST(array() AS ARRAY<INT>)").alias("ends"))

    def step(acc: Column, i: Column) -> Column:
        c = i - acc["start"] + 1
        cut = ((c >= least) & (distances[i] >= threshold)) | (c >= most)
        return F.struct(
            F.when(cut, i + 1).otherwise(acc["start"]).alias("start"),
            F.when(cut, F.array_append(acc["ends"], i)).otherwise(acc["ends"]).alias("ends"),
        )

    def finish(acc: Column) -> Column:
        joins = (F.size(acc["ends"]) > 0) & (n - acc["start"] < least)
        kept = F.when(joins, F.slice(acc["ends"], 1, F.greatest(F.size(acc["ends"]) - 1, F.lit(0)))).otherwise(acc["ends"])
        return F.array_append(kept, n - 1)

    return F.aggregate(F.sequence(F.lit(0), n - 2), zero, step, finish)


def semantic_chunks(df: DataFrame, config: ChunkConfig, embed: Embedder = letter_frequencies) -> DataFrame:
    """Documents within max_sentences are one chunk, and are never embedded: the two kinds part before it."""
    rows = with_sentences(df)
    n = F.size("sentences")
    short = numbered(rows.where(n <= config.max_sentences), F.array(F.array_join("sentences", " ")))
    long = with_distances(rows.where(n > config.max_sentences), config.buffer, embed)

    def parts(sentences: Column, ends: Column) -> Column:
        def part(end: Column, i: Column) -> Column:
            start = F.when(i == 0, F.lit(0)).otherwise(ends[i - 1] + 1)
            return F.array_join(F.slice(sentences, start + 1, end - start + 1), " ")

        return F.transform(ends, part)

    def scanned(s: Column, d: Column) -> Column:
        threshold = percentile(d, config.percentile)
        ends = let(threshold, lambda t: boundaries(d, t, F.size(s), config.min_sentences, config.max_sentences))
        return let(ends, lambda e: parts(s, e))

    cut = let(F.col("sentences"), lambda s: let(F.col("distances"), lambda d: scanned(s, d)))
    return short.unionByName(numbered(long, cut))


def chunk(df: DataFrame, config: ChunkConfig, embed: Embedder | None = None) -> DataFrame:
    """By the strategy of ``config``. ``semantic`` needs an embedder."""
    strategy = config.strategy.lower()
    if strategy == "fixed":
        return numbered(df, fixed_parts(F.col("text"), config.fixed_size, config.fixed_overlap))
    if strategy == "sentence_window":
        return numbered(with_sentences(df), window_parts(F.col("sentences"), config.window_size, config.window_overlap))
    if embed is None:
        raise ValueError("the semantic strategy needs an embedder")
    return semantic_chunks(df, config, embed)
