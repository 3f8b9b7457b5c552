"""Retrieval in four modes, for all queries at once, as a long trace (qid, mode, kind, rank, id).

Ids: a chunk's chunk_id; an entity's file_id:name; a relation's file_id:rel_key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.config import RetrievalConfig
from graphloom.functions.vectors import jaccard, letter_frequencies, tokens
from graphloom.operators.graph import one_hop
from graphloom.operators.merge import entity_text, first_by, relation_line, relation_text
from graphloom.operators.topk import top_k, top_k_within

Embedder = Callable[[Column], Column]
Reranker = Callable[[Column, Column], Column]


def token_overlap(question: Column, text: Column) -> Column:
    """The default reranker."""
    return jaccard(tokens(question), tokens(text))


@dataclass
class Index:
    """The tables that retrieval reads, with vectors beside their rows."""

    chunks: DataFrame  # chunk_id, text, vec
    entities: DataFrame  # id, file_id, name, type, description, source_id, vec
    relations: DataFrame  # id, file_id, rel_key, source, target, keywords, description, source_id, first_seen, vec


def build_index(chunks: DataFrame, entities: DataFrame, relations: DataFrame, embed: Embedder = letter_frequencies) -> Index:
    """``entities`` and ``relations`` merged; the embedding runs where the rows are."""
    return Index(
        chunks.select("chunk_id", "text", embed(F.col("text")).alias("vec")),
        entities.select(
            F.concat_ws(":", "file_id", "name").alias("id"), "file_id", "name", "type", "description", "source_id",
            embed(entity_text(F.col("name"), F.col("description"))).alias("vec"),
        ),
        relations.select(
            F.concat_ws(":", "file_id", "rel_key").alias("id"), "file_id", "rel_key", "source", "target", "keywords",
            "description", "source_id", "first_seen", embed(relation_text(F.col("keywords"), F.col("description"))).alias("vec"),
        ),
    )


def embed_queries(questions: DataFrame, embed: Embedder = letter_frequencies) -> DataFrame:
    """(qid, question) -> with vec; questions without text are left out."""
    return questions.where(F.length("question") > 0).select("qid", "question", embed(F.col("question")).alias("vec"))


def _ranks(df: DataFrame, order: str = "place") -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(order)))


def chunks_of(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, place, source_id) -> (qid, chunk_id, rank): the existing chunks, each once, in first order."""
    flat = sources.select("qid", "place", F.posexplode("source_id").alias("_p", "chunk_id"))
    flat = flat.select("qid", "chunk_id", F.struct("place", "_p").alias("place"))
    firsts = first_by(flat, ["qid", "chunk_id"], ["place"])
    return _ranks(firsts.join(chunks.select("chunk_id"), "chunk_id", "left_semi")).select("qid", "chunk_id", "rank")


def endpoints(ranked: DataFrame, index: Index) -> DataFrame:
    """The existing entities at the ends of ranked relations, source before target, each once."""
    rel = ranked.join(index.relations.select("id", "file_id", "source", "target"), "id")
    ends = rel.select("qid", "rank", "file_id", F.posexplode(F.array("source", "target")).alias("_p", "name"))
    ends = ends.select("qid", F.concat_ws(":", "file_id", "name").alias("id"), F.struct("rank", "_p").alias("place"))
    firsts = first_by(ends, ["qid", "id"], ["place"])
    return _ranks(firsts.join(index.entities.select("id"), "id", "left_semi")).select("qid", "id", "rank")


def rerank_relations(
    queries: DataFrame, candidates: DataFrame, index: Index, config: RetrievalConfig, score: Reranker = token_overlap
) -> DataFrame:
    """Two stages: the nearest candidates by vector, then the best of them by the reranker; equal scores keep
    the order of the first stage. The reranker sees the short list only."""
    dense = top_k_within(queries, candidates, index.relations, config.relation_candidates)
    text = index.relations.select("id", relation_line(*[F.col(c) for c in ("source", "target", "keywords", "description")]).alias("line"))
    pairs = dense.select("qid", "id", F.col("rank").alias("r1")).join(text, "id").join(queries.select("qid", "question"), "qid")
    pairs = pairs.withColumn("rerank", score(F.col("question"), F.col("line")))
    w = Window.partitionBy("qid").orderBy(F.desc("rerank"), "r1")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= config.relations).select("qid", "id", "rank", "r1", "rerank")


def _sources(ranked: DataFrame, table: DataFrame, stage: int) -> DataFrame:
    rows = ranked.select("qid", "id", "rank").join(table.select("id", "source_id"), "id")
    return rows.select("qid", F.struct(F.lit(stage).alias("stage"), "rank").alias("place"), "source_id")


def _trace(df: DataFrame, mode: str, kind: str, key: str = "id") -> DataFrame:
    return df.select("qid", F.lit(mode).alias("mode"), F.lit(kind).alias("kind"), "rank", F.col(key).alias("id"))


def naive(queries: DataFrame, index: Index, config: RetrievalConfig) -> DataFrame:
    hits = top_k(queries, index.chunks.select(F.col("chunk_id").alias("id"), "vec"), config.chunks)
    return _trace(hits, "naive", "chunk")


def local(queries: DataFrame, index: Index, config: RetrievalConfig) -> DataFrame:
    """Entities first, then the relations next to them, then the chunks of both."""
    found = top_k(queries, index.entities.select("id", "vec"), config.entities).select("qid", "id", "rank")
    seeds = found.join(index.entities.select("id", "file_id", "name"), "id").select("qid", "file_id", "name", "rank")
    near = one_hop(seeds, index.relations).select("qid", F.concat_ws(":", "file_id", "rel_key").alias("id"))
    rel = rerank_relations(queries, near, index, config)
    chunks = chunks_of(_sources(found, index.entities, 0).unionByName(_sources(rel, index.relations, 1)), index.chunks)
    return _trace(found, "local", "entity").unionByName(_trace(rel, "local", "relation")).unionByName(
        _trace(chunks, "local", "chunk", "chunk_id")
    )


def global_(queries: DataFrame, index: Index, config: RetrievalConfig) -> DataFrame:
    """Relations first, then the entities at their ends, and the chunks of the relations."""
    rel = top_k(queries, index.relations.select("id", "vec"), config.relations).select("qid", "id", "rank")
    ends = endpoints(rel, index)
    chunks = chunks_of(_sources(rel, index.relations, 0), index.chunks)
    return _trace(ends, "global", "entity").unionByName(_trace(rel, "global", "relation")).unionByName(
        _trace(chunks, "global", "chunk", "chunk_id")
    )


def hybrid(local_trace: DataFrame, global_trace: DataFrame, index: Index) -> DataFrame:
    """Local before global. Entities and relations are told apart by id, chunks by their text."""
    both = local_trace.select("*", F.lit(0).alias("branch")).unionByName(global_trace.select("*", F.lit(1).alias("branch")))
    both = both.withColumn("place", F.struct("branch", "rank"))
    text = index.chunks.select(F.col("chunk_id").alias("id"), F.sha2("text", 256).alias("_text"))
    marked = both.where(F.col("kind") == "chunk").join(text, "id").withColumn("_same", F.col("_text")).drop("_text")
    marked = marked.unionByName(both.where(F.col("kind") != "chunk").withColumn("_same", F.col("id")))
    firsts = first_by(marked, ["qid", "kind", "_same"], ["place"])
    w = Window.partitionBy("qid", "kind").orderBy("place")
    return firsts.select("qid", F.lit("hybrid").alias("mode"), "kind", F.row_number().over(w).alias("rank"), "id")


def retrieve(questions: DataFrame, index: Index, modes: list[str], config: RetrievalConfig | None = None) -> DataFrame:
    config = config or RetrievalConfig()
    queries = embed_queries(questions)
    local_trace = local(queries, index, config) if {"local", "hybrid"} & set(modes) else None
    global_trace = global_(queries, index, config) if {"global", "hybrid"} & set(modes) else None
    out = None
    for mode in modes:
        if mode == "naive":
            one = naive(queries, index, config)
        elif mode == "local":
            one = local_trace
        elif mode == "global":
            one = global_trace
        elif mode == "hybrid":
            one = hybrid(local_trace, global_trace, index)
        else:
            raise ValueError(f"unknown mode: {mode}")
        out = one if out is None else out.unionByName(one)
    return out


def context_lines(trace: DataFrame, index: Index) -> DataFrame:
    """(qid, mode, kind, rank, line): the payload of every retrieved thing, as a JSON line."""
    kind, key = F.col("kind"), ["id"]
    t = trace.select("qid", "mode", "kind", "rank", "id")
    ent = t.where(kind == "entity").join(index.entities.select("id", F.to_json(F.struct("name", "type", "description")).alias("line")), key)
    rel = t.where(kind == "relation").join(
        index.relations.select("id", F.to_json(F.struct("source", "target", "keywords", "description")).alias("line")), key
    )
    chk = t.where(kind == "chunk").join(
        index.chunks.select(F.col("chunk_id").alias("id"), F.to_json(F.struct(F.col("text").alias("content"))).alias("line")), key
    )
    return ent.unionByName(rel).unionByName(chk).select("qid", "mode", "kind", "rank", "line")


def contexts(lines: DataFrame) -> DataFrame:
    """(qid, mode, context): the sections Entities, Relations and Chunks, those that have a line."""
    rows = lines.groupBy("qid", "mode", "kind").agg(F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("l"))
    body = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    title = F.when(F.col("kind") == "entity", "Entities").when(F.col("kind") == "relation", "Relations").otherwise("Chunks")
    order = F.when(F.col("kind") == "entity", 0).when(F.col("kind") == "relation", 1).otherwise(2)
    section = F.concat(F.lit("-----"), title, F.lit("-----\n"), body)
    rows = rows.select("qid", "mode", F.struct(order.alias("o"), section.alias("s")).alias("x"))
    return rows.groupBy("qid", "mode").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), "\n\n").alias("context"))


def answers(questions: DataFrame, context: DataFrame, generate: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(qid, mode, answer) through a generator over (question, context); the default gives the context back."""
    rows = context.join(questions.select("qid", "question"), "qid")
    answer = generate(F.col("question"), F.col("context")) if generate else F.col("context")
    return rows.select("qid", "mode", answer.alias("answer"))
