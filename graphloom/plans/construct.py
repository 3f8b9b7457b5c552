"""Building a store from documents in one call."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.config import ChunkConfig, fingerprint
from graphloom.functions.vectors import letter_frequencies
from graphloom.operators import extraction, graph
from graphloom.operators.chunking import chunk
from graphloom.operators.merge import merge_entities, merge_relations
from graphloom.operators.retrieval import Index, build_index
from graphloom.session import cut
from graphloom.sources.files import Store

Extractor = Callable[[DataFrame], DataFrame]


def by_rule(chunks: DataFrame) -> DataFrame:
    """(file_id, chunk_id, response) by the default extractor."""
    return chunks.select("file_id", "chunk_id", extraction.rule_response(F.col("text")).alias("response"))


def ordinal() -> Column:
    """The place of a raw record in its file: the number of its chunk, then its own."""
    return F.substring_index("chunk_id", "_", -1).cast("bigint") * F.lit(1 << 24) + F.col("item")


def construct(
    documents: DataFrame, store: Store, config: ChunkConfig | None = None, extract: Extractor = by_rule, embed: Callable[[Column], Column] = letter_frequencies
) -> bool:
    """documents (file_id, text) -> chunks, responses, merged entities and relations, vectors and graph in ``store``.

    False, and nothing done, when the store was built with the same settings; other settings are an error. The
    settings are written last, so a build that broke off is done again. ``extract`` gives (file_id, chunk_id, response)
    of chunks, as ``extraction.call_model`` over ``prompts.extraction_prompt`` does; it is asked once per chunk."""
    config = config or ChunkConfig()
    if store.has("settings"):
        return store.claim(fingerprint(config))
    chunks = cut(chunk(documents, config, embed))
    responses = cut(extract(chunks).select("file_id", "chunk_id", "response"))
    entities = cut(merge_entities(extraction.entities_of(responses).withColumn("row_id", ordinal())))
    relations = cut(merge_relations(extraction.relations_of(responses).withColumn("row_id", ordinal())))
    index = build_index(chunks, entities, relations, embed)
    vertices, edges = graph.vertices(entities, relations), graph.edges(relations)
    store.save_all(
        {
            "chunks": chunks,
            "entities": entities,
            "relations": relations,
            "chunk_vectors": index.chunks.select(F.col("chunk_id").alias("id"), "vec"),
            "entity_vectors": index.entities.select("id", "vec"),
            "relation_vectors": index.relations.select("id", "vec"),
            "vertices": vertices,
            "edges": edges,
        }
    )
    return store.claim(fingerprint(config))


def stored_index(store: Store) -> Index:
    """The index of a store's tables, with the vectors that were saved."""
    t = store.load_all()
    entities = t["entities"].withColumn("id", F.concat_ws(":", "file_id", "name"))
    relations = t["relations"].withColumn("id", F.concat_ws(":", "file_id", "rel_key"))
    return Index(
        t["chunks"].join(t["chunk_vectors"].withColumnRenamed("id", "chunk_id"), "chunk_id").select("chunk_id", "text", "vec"),
        entities.join(t["entity_vectors"], "id").select("id", "file_id", "name", "type", "description", "source_id", "vec"),
        relations.join(t["relation_vectors"], "id").select("id", "file_id", "rel_key", "source", "target", "keywords", "description", "source_id", "first_seen", "vec"),
    )
