"""The queries of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import copies, leaks, names, neighbours, packing, pieces, sentences, subjects, survivor
from graphloom.llm.sql import SQL  # noqa: F401
from graphloom.llm.tables import table


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return copies.canonical(table(spark, folder, "entities"), table(spark, folder, "relations"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    records = _records(spark, folder)
    return copies.copy_rows(records, copies.collapse(records))


def p3_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    """Every record once, with its copies."""
    groups = copies.collapse(_records(spark, folder))
    kind = F.when(F.col("record").startswith("e"), "entities").otherwise("relations")
    return groups.select(kind.alias("record_table"), "first_id", "copies")


def p7_survivors(spark: SparkSession, folder: str) -> DataFrame:
    return survivor.survivors(table(spark, folder, "entities"), table(spark, folder, "extract_runs")).select(
        "first_id", "size", "row_id", "type", "description", F.array_join("source_id", ",").alias("source_id"), "layers", "ideal"
    )


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    found = survivor.survivors(table(spark, folder, "entities"), table(spark, folder, "extract_runs"))
    return found.where("ideal").select("first_id", "row_id")


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "chunks").select("chunk_id", "config_id", "text", "loaded_at")
    return pieces.pieces(chunks, table(spark, folder, "chunk_configs"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks that had to be cut."""
    return _pieces(spark, folder).where(F.col("piece_pos") == 1).select("chunk_id").distinct()


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder).select("chunk_id", "loaded_at", "piece_pos", "char_start", "char_end", "piece")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return names.map_names(table(spark, folder, "entities"), table(spark, folder, "carol_canonical"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.sentences(table(spark, folder, "chunks"))


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).select("doc_id", "item_id").distinct()


def p9_removals(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.removals(_leaks(spark, folder))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    found = [
        neighbours.pairs(neighbours.nearest(table(spark, folder, t))).select(F.lit(t).alias("vector_table"), "id_a", "id_b")
        for t in ("entity_vectors", "chunk_vectors")
    ]
    return found[0].unionByName(found[1])


def _subjects(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.subject_areas(*[table(spark, folder, t) for t in ("documents", "doc_labels", "subject_list")])


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return _subjects(spark, folder).select("doc_id", "subject").distinct()


def p10_composition(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus by source and subject: documents and characters (a document of two subjects counts in both)."""
    docs = table(spark, folder, "documents").select("doc_id", "source", F.length("text").cast("bigint").alias("chars"))
    found = _subjects(spark, folder).select("doc_id", "subject").distinct()
    both = docs.join(found, "doc_id", "left").withColumn("subject", F.coalesce("subject", F.lit("(none)")))
    return both.groupBy("source", "subject").agg(F.count(F.lit(1)).alias("documents"), F.sum("chars").alias("chars"))


def p8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), table(spark, folder, "container_specs"))


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill(p8_packing(spark, folder), table(spark, folder, "container_specs"))


def p8_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Per spec: what is packed, containers over capacity, documents that are not whole, and whether the unused
    space is under two parts in a hundred and one container."""
    docs, specs = table(spark, folder, "documents"), table(spark, folder, "container_specs")
    packed = packing.pack(docs, specs).where(F.col("container").isNotNull())
    capacity = specs.select(F.col("spec_id").cast("bigint").alias("spec_id"), F.col("capacity_tokens").cast("bigint").alias("capacity"))
    boxes = packed.groupBy("spec_id", "container").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).join(F.broadcast(capacity), "spec_id")
    size = docs.where(F.col("text").isNotNull()).select("doc_id", (F.octet_length("text") + 1).cast("bigint").alias("size"))
    whole = packed.groupBy("spec_id", "doc_id").agg(F.sum("tokens").alias("t")).join(size, "doc_id")
    whole = whole.groupBy("spec_id").agg(F.count(F.lit(1)).alias("documents"), F.sum((F.col("t") != F.col("size")).cast("bigint")).alias("not_whole"))
    per = boxes.groupBy("spec_id", "capacity").agg(
        F.sum("n").alias("parts"), F.sum("t").alias("tokens"), F.sum((F.col("t") > F.col("capacity")).cast("bigint")).alias("over"), F.count(F.lit(1)).alias("boxes")
    )
    tight = F.col("boxes") * F.col("capacity") <= F.col("tokens") * 1.02 + F.col("capacity")
    return per.join(whole, "spec_id").select("spec_id", "parts", "tokens", "over", "documents", "not_whole", tight.alias("tight"))


QUERIES = {
    "p8_checks": p8_checks,
    "p8_packing": p8_packing,
    "p8_fill": p8_fill,
    "p10_found": p10_found,
    "p10_composition": p10_composition,
    "p6_found": p6_found,
    "p9_found": p9_found,
    "p9_removals": p9_removals,
    "p4_found": p4_found,
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p3_found": p3_found,
    "p3_collapsed": p3_collapsed,
    "p7_found": p7_found,
    "p7_survivors": p7_survivors,
}
