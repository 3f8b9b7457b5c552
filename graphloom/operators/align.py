"""Finding chunks in their source text, and the evidence that they overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.let import let
from graphloom.functions.text import WHITE_SPACE, collapse_space


def _source_offset(runs: Column, flat: Column, at: Column) -> Column:
    """The source offset of position ``at`` of the collapsed text ``flat``, which is not white space. ``runs`` are the
    source's runs of white space and of other characters, in turn; words before ``at`` tell the run."""

    def of(before: Column) -> Column:
        words = F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit("")))
        lead = F.when(runs[0].rlike(f"^[{WHITE_SPACE}]"), 1).otherwise(0)
        start = F.length(F.array_join(F.slice(runs, F.lit(1), 2 * words + lead), ""))
        return start + F.length(F.substring_index(before, " ", -1))  # what the same word has before ``at``

    return let(flat.substr(F.lit(1), at), of)


def locate(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(chunk_id, file_id, status, char_start, char_end): where a chunk stands in its document, white space aside.
    status is ok, missing, or ambiguous when a second, possibly overlapping, place exists; blank chunks and
    chunks without a document are missing. Offsets are null unless ok.

    A document meets the list of its chunks, so its text travels once, and is collapsed and cut into runs once; those
    without chunks are left out before. A file is one document, so the list is bounded by its text."""
    rows = chunks.select("chunk_id", "file_id", collapse_space(F.col("text")).alias("sub"))
    known = F.col("file_id").isNotNull()
    lists = rows.where(known).groupBy("file_id").agg(F.collect_list(F.struct("chunk_id", "sub")).alias("_subs"))
    both = lists.join(documents.where(known).select("file_id", F.col("text").alias("_source")), "file_id", "left")
    runs = F.regexp_extract_all(F.col("_source"), F.lit(f"[{WHITE_SPACE}]+|[^{WHITE_SPACE}]+"), F.lit(0))

    def placed(flat: Column, r: Column, s: Column) -> Column:
        def of(first: Column) -> Column:
            again = F.when(first > 0, F.call_function("locate", s["sub"], flat, first + 1))
            status = F.when(first == 0, "missing").when(again > 0, "ambiguous").otherwise("ok")
            start = _source_offset(r, flat, first - 1)
            end = _source_offset(r, flat, first - 2 + F.length(s["sub"])) + 1
            found = let(status, lambda t: F.struct(t.alias("status"), F.when(t == "ok", start).alias("start"), F.when(t == "ok", end).alias("end")))
            return F.struct(s["chunk_id"].alias("chunk_id"), found.alias("found"))

        return let(F.coalesce(F.when(F.length(s["sub"]) > 0, F.instr(flat, s["sub"])), F.lit(0)), of)

    every = let(collapse_space(F.col("_source")), lambda flat: let(runs, lambda r: F.transform("_subs", lambda s: placed(flat, r, s))))
    found = both.select("file_id", F.explode(every).alias("p"))
    found = found.select(
        "p.chunk_id", "file_id", F.col("p.found.status").alias("status"), F.col("p.found.start").alias("char_start"), F.col("p.found.end").alias("char_end")
    )
    none = F.lit(None).cast("int")
    return found.unionByName(rows.where(~known).select("chunk_id", "file_id", F.lit("missing").alias("status"), none.alias("char_start"), none.alias("char_end")))


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Half-open; touching is not overlapping, and an empty span overlaps nothing."""
    return F.greatest(a_start, b_start) < F.least(a_end, b_end)


def evidence_chunks(located: DataFrame, evidence: DataFrame) -> DataFrame:
    """(qid, chunk_id, evidence_id): joined by file, so a hash join with the overlap as residual."""
    spans = evidence.select("qid", "evidence_id", F.col("file_id").alias("_f"), F.col("char_start").alias("_s"), F.col("char_end").alias("_e"))
    ok = located.where(F.col("status") == "ok")
    on = (F.col("file_id") == F.col("_f")) & overlaps(F.col("char_start"), F.col("char_end"), F.col("_s"), F.col("_e"))
    return ok.join(spans, on).select("qid", "chunk_id", "evidence_id").distinct()
