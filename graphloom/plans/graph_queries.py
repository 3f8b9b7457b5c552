"""Queries of the chunking, merging, graph, vector, retrieval, alignment and evaluation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.config import MODES, ChunkConfig, RetrievalConfig
from graphloom.functions.sentences import sentence_spans, split_sentences
from graphloom.functions.text import collapse_space
from graphloom.operators import align, chunking, evaluation, extraction, gold, graph, merge, metrics, retrieval, topk
from graphloom.plans.tables import table
from graphloom.session import cut

CONFIG = ChunkConfig()
RETRIEVAL = RetrievalConfig()


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("file_id"), "text")


def chunk_fixed(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.chunk(_documents(spark, folder), CONFIG)


def chunk_fixed_stats(spark: SparkSession, folder: str) -> DataFrame:
    rows = chunk_fixed(spark, folder)
    return rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).cast("bigint").alias("chars"))


def sentences(spark: SparkSession, folder: str) -> DataFrame:
    rows = _documents(spark, folder).select("file_id", F.posexplode(split_sentences(F.col("text"))).alias("pos", "sentence"))
    return rows


def sentence_offsets(spark: SparkSession, folder: str) -> DataFrame:
    rows = _documents(spark, folder).select("file_id", F.posexplode(sentence_spans(F.col("text"))).alias("pos", "s"))
    return rows.select("file_id", "pos", F.col("s.start").alias("char_start"), F.col("s.end").alias("char_end"), F.col("s.sentence").alias("sentence"))


def chunk_sentence_window(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.chunk(_documents(spark, folder), ChunkConfig(strategy="sentence_window"))


def sentence_context(spark: SparkSession, folder: str) -> DataFrame:
    rows = chunking.with_sentences(_documents(spark, folder))
    return rows.select("file_id", F.posexplode(chunking.context(F.col("sentences"), CONFIG.buffer)).alias("pos", "context"))


def _long(spark: SparkSession, folder: str) -> DataFrame:
    rows = chunking.with_sentences(_documents(spark, folder))
    return chunking.with_distances(rows.where(F.size("sentences") > CONFIG.max_sentences), CONFIG.buffer)


def semantic_distances(spark: SparkSession, folder: str) -> DataFrame:
    rows = _long(spark, folder).select("file_id", F.posexplode("distances").alias("pos", "d"))
    return rows.select("file_id", "pos", F.round("d", 9).alias("distance"))


def semantic_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return _long(spark, folder).select("file_id", F.round(chunking.percentile(F.col("distances"), CONFIG.percentile), 9).alias("threshold"))


def chunk_semantic(spark: SparkSession, folder: str) -> DataFrame:
    from graphloom.functions.vectors import letter_frequencies

    return chunking.chunk(_documents(spark, folder), ChunkConfig(strategy="semantic"), letter_frequencies)


def ws_normalize(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("file_id", collapse_space(F.col("text")).alias("normal"))


def doc_sha256(spark: SparkSession, folder: str) -> DataFrame:
    return _documents(spark, folder).select("file_id", F.sha2("text", 256).alias("sha256"))


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The store's view of the chunks: the last version of each, unless it is deleted."""
    rows = merge.latest_by(table(spark, folder, "chunks"), "chunk_id", "loaded_at")
    return rows.where(~F.coalesce("is_deleted", F.lit(False))).select("chunk_id", "file_id", "pos", "text")


def kv_latest(spark: SparkSession, folder: str) -> DataFrame:
    return _chunks(spark, folder)


def _located(spark: SparkSession, folder: str) -> DataFrame:
    return align.locate(_chunks(spark, folder), _documents(spark, folder))


def locate_passages(spark: SparkSession, folder: str) -> DataFrame:
    return _located(spark, folder)


def _evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Two ranges of sentences of every document stand for annotated evidence."""
    docs = _documents(spark, folder)
    ranges = docs.select(
        "file_id", F.concat(F.lit("q"), "file_id").alias("qid"),
        F.explode(F.array(*[F.struct(F.lit(n).alias("number"), F.lit(a).alias("first"), F.lit(b).alias("last")) for n, a, b in ((1, 1, 3), (2, 5, 6))])).alias("r"),
    ).select("file_id", "qid", "r.*")
    return gold.evidence(docs, ranges)


def evidence_spans(spark: SparkSession, folder: str) -> DataFrame:
    return _evidence(spark, folder)


def evidence_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return align.evidence_chunks(_located(spark, folder), _evidence(spark, folder))


def evidence_guards(spark: SparkSession, folder: str) -> DataFrame:
    return gold.guards(table(spark, folder, "gold_questions"))


def gold_relation_pairs(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "gold_questions")
    return rows.select("id", F.array_join(gold.relation_pairs(F.col("gold_relations")), ";").alias("relations"))


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vec"), "label")


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    """The query set of searches: every vector whose id is divisible by 50."""
    return _vectors(spark, folder).where(F.col("id").cast("bigint") % 50 == 0).withColumnRenamed("id", "qid")


def knn_topk(spark: SparkSession, folder: str) -> DataFrame:
    hits = topk.top_k(_asked(spark, folder), _vectors(spark, folder), 5)
    return hits.select("qid", "id", "rank", F.round("score", 6).alias("score"))


def knn_topk_restricted(spark: SparkSession, folder: str) -> DataFrame:
    """Among the vectors of the query's own label."""
    asked, vectors = _asked(spark, folder), _vectors(spark, folder)
    near = asked.select("qid", "label").join(vectors.select("id", "label"), "label")
    hits = topk.top_k_within(asked, near, vectors, 5)
    return hits.select("qid", "id", "rank", F.round("score", 6).alias("score"))


def vector_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """The query set's vectors, and an id that has none."""
    keys = _asked(spark, folder).select(F.col("qid").alias("id")).union(spark.createDataFrame([("no such id",)], "id string"))
    found = topk.get_vector(_vectors(spark, folder), keys)
    return found.select("id", F.coalesce(F.size("vec"), F.lit(0)).alias("size"), F.round(F.col("vec")[0].cast("double"), 6).alias("head"))


def _entities(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "entities").where(~F.coalesce("is_deleted", F.lit(False)))
    return merge.merge_entities(rows)


def _relations(spark: SparkSession, folder: str) -> DataFrame:
    return merge.merge_relations(table(spark, folder, "relations"))


def _csv(name: str) -> F.Column:
    return F.array_join(name, ",").alias(name)


def entity_merge(spark: SparkSession, folder: str) -> DataFrame:
    return _entities(spark, folder).select("file_id", "name", "type", "description", _csv("source_id"))


def relation_merge(spark: SparkSession, folder: str) -> DataFrame:
    return _relations(spark, folder).select("file_id", "rel_key", "source", "target", _csv("keywords"), "description", _csv("source_id"))


def ordered_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """The first row of every entity name of a file."""
    rows = table(spark, folder, "entities").where(F.length("name") > 0).select("file_id", "name", "row_id")
    return merge.first_by(rows, ["file_id", "name"], ["row_id"])


def graph_vertices(spark: SparkSession, folder: str) -> DataFrame:
    return graph.vertices(_entities(spark, folder), _relations(spark, folder)).select("file_id", "name", "known")


def dangling_endpoints(spark: SparkSession, folder: str) -> DataFrame:
    return graph.dangling(_entities(spark, folder), _relations(spark, folder))


def node_style(spark: SparkSession, folder: str) -> DataFrame:
    rows = graph.node_style(_entities(spark, folder), _relations(spark, folder))
    return rows.withColumn("size", F.round("size", 6))


def edge_style(spark: SparkSession, folder: str) -> DataFrame:
    return graph.edge_style(_relations(spark, folder))


def graph_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return graph.edges(_relations(spark, folder)).select("file_id", "node", "neighbour")


def graph_one_hop(spark: SparkSession, folder: str) -> DataFrame:
    """From every gold entity, as a seed in each file that has it."""
    names = table(spark, folder, "gold_questions").select(F.col("id").alias("qid"), F.posexplode("gold_entities").alias("rank", "name"))
    files = _entities(spark, folder).select("file_id", "name")
    seeds = merge.first_by(names, ["qid", "name"], ["rank"]).join(files, "name")
    return graph.one_hop(seeds, _relations(spark, folder)).select("qid", "file_id", "rel_key")


def _index(spark: SparkSession, folder: str) -> retrieval.Index:
    return retrieval.build_index(_chunks(spark, folder), _entities(spark, folder), _relations(spark, folder))


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "gold_questions").select(F.col("id").alias("qid"), "question")


def _mode(mode: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return retrieval.retrieve(_questions(spark, folder), _index(spark, folder), [mode], RETRIEVAL)

    return query


def rerank_two_stage(spark: SparkSession, folder: str) -> DataFrame:
    """Every relation of the files of a question's nearest entities, in two stages."""
    index, queries = _index(spark, folder), retrieval.embed_queries(_questions(spark, folder))
    found = topk.top_k(queries, index.entities.select("id", "vec"), RETRIEVAL.entities)
    files = found.join(index.entities.select("id", "file_id"), "id").select("qid", "file_id").distinct()
    near = files.join(index.relations.select("file_id", "id"), "file_id").select("qid", "id")
    out = retrieval.rerank_relations(queries, near, index, RETRIEVAL)
    return out.select("qid", "id", "rank", "r1", F.round("rerank", 6).alias("rerank"))


def context_lines(spark: SparkSession, folder: str) -> DataFrame:
    index = _index(spark, folder)
    trace = retrieval.retrieve(_questions(spark, folder), index, ["global"], RETRIEVAL)
    return retrieval.context_lines(trace, index).select("qid", "kind", "rank", "line")


def json_extract_props(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select("event_id", F.try_parse_json("props").alias("v"))
    return rows.select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"))


def _responses(spark: SparkSession, folder: str) -> DataFrame:
    return _chunks(spark, folder).select("file_id", "chunk_id", extraction.rule_response(F.col("text")).alias("response"))


def parse_entities(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.entities_of(_responses(spark, folder)).select("chunk_id", "item", "name", "type", _csv("source_id"))


def parse_relations(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.relations_of(_responses(spark, folder)).select("chunk_id", "item", "source", "target", _csv("keywords"))


def _name_table(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "carol_canonical")
    names = c.select(F.explode("gold_entities").alias("name")).distinct()
    return metrics.name_table(names, c.select(F.explode("entity_aliases").alias("alias", "name")).distinct())


def entity_normalize(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "entities").where(F.length("name") > 0).select("row_id", "name")
    return metrics.normalise_names(rows, "name", _name_table(spark, folder), "canonical").select("row_id", "canonical")


def relation_key_normalize(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "relations").select("row_id", "rel_key").where(F.col("rel_key").isNotNull())
    return metrics.normalise_pairs(rows, "rel_key", _name_table(spark, folder), "canonical").select("row_id", "canonical")


def set_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Entities that global retrieval finds against the gold entities of the question."""
    q = table(spark, folder, "gold_questions").select(F.col("id").alias("qid"), "question", "gold_entities")
    index, names = _index(spark, folder), _name_table(spark, folder)
    trace = retrieval.retrieve(q.select("qid", "question"), index, ["global"], RETRIEVAL).where(F.col("kind") == "entity")
    found = trace.join(index.entities.select("id", "name"), "id").select("qid", "name")
    wanted = q.select("qid", F.explode("gold_entities").alias("name"))
    return metrics.set_metrics(
        metrics.normalise_names(wanted, "name", names, "item"), metrics.normalise_names(found, "name", names, "item"), q
    ).withColumns({c: F.round(c, 6) for c in ("recall", "precision", "f1")}).withColumn("matched", F.array_join("matched", ";"))


def _evaluated(spark: SparkSession, folder: str) -> DataFrame:
    """Nearest vectors as retrieved chunks; a vector of the query's label shows one of three pieces of evidence."""
    asked, vectors = _asked(spark, folder), _vectors(spark, folder)
    hits = topk.top_k(asked, vectors, 10).select("qid", F.col("id").alias("chunk_id"), "rank")
    piece = F.concat(F.lit("e"), F.col("label").cast("string"), F.lit("_"), (F.col("chunk_id").cast("bigint") % 3).cast("string"))
    labelled = vectors.select(F.col("id").alias("chunk_id"), "label")
    same = asked.select("qid", "label").join(labelled, "label").select("qid", "chunk_id", piece.alias("evidence_id"))
    others = hits.join(same, ["qid", "chunk_id"], "left_anti").select("qid", "chunk_id", F.lit(None).cast("string").alias("evidence_id"))
    shows = same.unionByName(others)
    known = same.select("qid", "evidence_id").distinct()
    points = known.withColumn("point", F.substring_index("evidence_id", "_", -1).cast("int") + 1)
    questions = asked.select("qid", F.lit(3).alias("answer_points"))
    out = None
    for mode, k in (("top5", 5), ("top10", 10)):
        one = metrics.evidence_metrics(hits.where(F.col("rank") <= k), shows, points, questions).withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out


def evidence_metrics(spark: SparkSession, folder: str) -> DataFrame:
    rows = _evaluated(spark, folder).drop(*metrics.LISTS)
    return rows.withColumns({f: F.round(f, 6) for f, kind in rows.dtypes if kind == "double"})


def summary_macro_micro(spark: SparkSession, folder: str) -> DataFrame:
    rows = metrics.summary(_evaluated(spark, folder))
    return rows.withColumns({f: F.round(f, 6) for f, kind in rows.dtypes if kind == "double"})


def _evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """All questions in all modes against their gold lists. The gold texts are not among the tables, so a question's
    spans are taken to lie in every file that has one of its gold entities."""
    questions = table(spark, folder, "gold_questions").withColumnRenamed("id", "qid")
    index, modes = _index(spark, folder), list(MODES)
    trace = cut(retrieval.retrieve(questions.select("qid", "question"), index, modes, RETRIEVAL))
    named = questions.select("qid", F.explode("gold_entities").alias("name")).join(index.entities.select("file_id", "name"), "name")
    spans = evaluation.gold_spans(questions, named)
    shown = evaluation.chunk_evidence(questions, align.evidence_chunks(_located(spark, folder), spans))
    return evaluation.evaluate(questions, trace, index, _name_table(spark, folder), shown, modes)


def evaluation_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = _evaluation(spark, folder)
    lists = {f: F.array_join(F.col(f).cast("array<string>"), ";") for f, kind in rows.dtypes if kind.startswith("array")}
    return rows.withColumns(lists | {f: F.round(f, 6) for f, kind in rows.dtypes if kind == "double"})


def evaluation_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = metrics.evaluation_summary(_evaluation(spark, folder))
    return rows.withColumns({f: F.round(f, 6) for f, kind in rows.dtypes if kind == "double"})


QUERIES = {
    f.__name__: f
    for f in (
        chunk_fixed, chunk_fixed_stats, sentences, sentence_offsets, chunk_sentence_window, sentence_context,
        semantic_distances, semantic_threshold, chunk_semantic, ws_normalize, doc_sha256, kv_latest, locate_passages,
        evidence_spans, evidence_overlap, evidence_guards, gold_relation_pairs, knn_topk, knn_topk_restricted,
        vector_lookup, entity_merge, relation_merge, ordered_distinct, graph_vertices, dangling_endpoints, node_style,
        edge_style, graph_neighbours, graph_one_hop, rerank_two_stage, context_lines, json_extract_props,
        parse_entities, parse_relations, entity_normalize, relation_key_normalize, set_metrics, evidence_metrics,
        summary_macro_micro, evaluation_rows, evaluation_summary,
    )
} | {f"retrieve_{m}": _mode(m) for m in ("naive", "local", "global", "hybrid")}

from graphloom.plans.graph_sql import SQL  # noqa: E402, F401
