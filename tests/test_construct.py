import pytest
from pyspark.sql import functions as F

from graphloom.config import ChunkConfig, RetrievalConfig, fingerprint
from graphloom.functions.arrays import running_sums
from graphloom.functions.prompts import answer_prompt, extraction_prompt
from graphloom.operators import chunking, evaluation, extraction, graph, metrics, retrieval, topk
from graphloom.plans.construct import by_rule, construct, stored_index
from graphloom.sources.files import TABLES, Store, read_gold, write_gold

DOCS = [("a", "Orla Quill met Ivo Umber. Ivo Umber left Gran Ode."), ("b", "Orla Quill slept."), ("c", None), ("d", "")]


def test_settings_from_the_environment():
    assert ChunkConfig.from_env({}) == ChunkConfig() and RetrievalConfig.from_env({}) == RetrievalConfig()
    env = {"CHUNKING_STRATEGY": "semantic", "FIXED_WINDOW_SIZE": "100", "FIXED_WINDOW_OVERLAP": "7", "SEMANTIC_BREAKPOINT_PERCENTILE": "92", "CHUNK_TOP_K": "3", "ENTITY_TOP_K": ""}
    assert ChunkConfig.from_env(env) == ChunkConfig(strategy="semantic", fixed_size=100, fixed_overlap=7, percentile=92.0)
    assert RetrievalConfig.from_env(env) == RetrievalConfig(chunks=3)
    with pytest.raises(ValueError):
        ChunkConfig.from_env({"FIXED_WINDOW_SIZE": "5"})


def test_construct_builds_once(spark, tmp_path):
    docs, store = spark.createDataFrame(DOCS, "file_id string, text string"), Store(spark, f"file://{tmp_path}/s")
    asked = []

    def extract(chunks):
        asked.append(1)
        return by_rule(chunks)

    assert construct(docs, store, extract=extract) is True
    assert construct(docs, store, extract=extract) is False and len(asked) == 1
    with pytest.raises(ValueError):
        construct(docs, store, ChunkConfig(fixed_size=300))
    tables = store.load_all()
    assert set(tables) == set(TABLES)
    assert {tuple(r) for r in tables["entities"].select("file_id", "name").collect()} == {("a", "Orla Quill"), ("a", "Ivo Umber"), ("a", "Gran Ode"), ("b", "Orla Quill")}
    assert {r["rel_key"] for r in tables["relations"].collect()} == {"Ivo Umber||Orla Quill", "Gran Ode||Ivo Umber"}
    index = stored_index(store)
    q = spark.createDataFrame([("q", "Who met Orla Quill?")], "qid string, question string")
    trace = retrieval.retrieve(q, index, ["naive", "hybrid"]).collect()
    assert {r["kind"] for r in trace if r["mode"] == "hybrid"} == {"entity", "relation", "chunk"}
    store.append("chunk_vectors", spark.createDataFrame([("new", [1.0] * 26)], "id string, vec array<double>"))
    found = topk.get_vector(store.load("chunk_vectors", ""), spark.createDataFrame([("new",), ("none",)], "id string"))
    assert {r["id"]: r["vec"] is not None for r in found.collect()} == {"new": True, "none": False}
    node = {r["name"]: (r["found"], r["known"]) for r in graph.get_node(spark.createDataFrame([("a", "Ivo Umber"), ("a", "Nobody")], "file_id string, name string"), tables["entities"], tables["relations"]).collect()}
    assert node == {"Ivo Umber": (True, True), "Nobody": (False, None)}
    keys = spark.createDataFrame([("a", "Orla Quill", "Ivo Umber"), ("a", "Orla Quill", "Gran Ode"), ("a", None, "x")], "file_id string, source string, target string")
    assert [r["found"] for r in graph.get_edge(keys, tables["relations"]).orderBy(F.desc("target")).collect()] == [False, True, False]


def test_store_keeps_a_table_that_cannot_be_replaced(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    one = spark.createDataFrame([(1,)], "x int")
    store.save("t", one)
    store.save("t", one.union(one))
    assert store.load("t", "x int").count() == 2 and not store.has("t.old") and not store.has("t.new")
    with pytest.raises(ValueError):
        store.save_all({"chunks": one})


def test_prompts(spark):
    df = spark.createDataFrame([("text with {braces}", "Why?"), (None, None)], "t string, q string")
    rows = df.select(extraction_prompt(F.col("t"), ["{x}"]).alias("p"), answer_prompt(F.col("q"), F.col("t")).alias("a")).collect()
    assert "text with {braces}" in rows[0]["p"] and '{"entities"' in rows[0]["p"] and "Example:\n{x}" in rows[0]["p"] and "NaturalObject" in rows[0]["p"]
    assert rows[0]["a"].endswith("Question: Why?") and "Multiple Paragraphs" in rows[0]["a"] and rows[1]["p"].endswith("Text:\n")
    told = extraction.call_model(df.limit(1).select(F.lit("f").alias("file_id"), F.lit("c").alias("chunk_id"), extraction_prompt(F.col("t")).alias("text")), lambda p: p[-8:], 1)
    assert told.first()["response"] == "{braces}"


def test_gold_files_are_read_back(spark, tmp_path):
    from graphloom.schema import GOLD_DDL

    span = ("e1", 1, 1, 0, 5, [1], "h", "p")
    question = ("q", "easy", "t", "Why?", ["A"], [], ["x"], [["k"]], [span])
    rows = [("1", d, ("p", "h", 1, 1), {}, (True,), {"a": "A"}, [question]) for d in ("d1", "d2")]
    gold = spark.createDataFrame(rows, GOLD_DDL)
    write_gold(gold, f"{tmp_path}/gold")
    assert {r["dataset"] for r in read_gold(spark, f"{tmp_path}/gold").collect()} == {"d1", "d2"}


def test_running_sums_and_long_windows(spark):
    values = [[], [5], list(range(700))]
    got = spark.createDataFrame([(v,) for v in values], "v array<int>").select(running_sums(F.col("v")).alias("s")).collect()
    assert [r["s"] for r in got] == [[sum(v[:i]) for i in range(len(v))] for v in values]
    text = "".join(chr(97 + i % 26) for i in range(5000))
    for size, overlap in ((10, 3), (100, 99), (7, 0)):
        parts = spark.createDataFrame([(text,)], "t string").select(chunking.fixed_parts(F.col("t"), size, overlap).alias("p")).first()["p"]
        assert parts == [text[i : i + size] for i in range(0, len(text), size - overlap)]


def test_queries_in_blocks_read_the_vectors_once(spark):
    vectors = spark.createDataFrame([(str(i), [float(i), 1.0]) for i in range(30)], "id string, vec array<double>")
    queries = vectors.withColumnRenamed("id", "qid")
    one, many = [sorted(map(tuple, topk.top_k(queries, vectors, 3, block).collect())) for block in (4096, 4)]
    assert one == many and len(one) == 90


def test_evaluation_with_stored_evidence(spark):
    span = lambda e, a, b, p: (e, 1, 1, a, b, p, "", "")
    rows = [
        ("q1", "Why?", ["Ann"], ["Ann||Bo"], ["x", "y"], [span("e1", 0, 5, [1]), span("e2", 5, 9, [2])], None),
        ("q2", "How?", None, [], [], [span("e1", 0, 5, [])], {"c9": ["e1", "other"], "c8": []}),
        ("q3", "", ["Ann"], [], ["x"], [span("e1", 0, 5, [1])], None),
    ]
    ddl = "qid string, question string, gold_entities array<string>, gold_relations array<string>, gold_answer_points array<string>, gold_evidence_spans array<struct<evidence_id:string,sentence_start:int,sentence_end:int,char_start:int,char_end:int,supports_answer_points:array<int>,text_sha256:string,text_preview:string>>, gold_chunk_evidence map<string,array<string>>"
    q = spark.createDataFrame(rows, ddl)
    computed = spark.createDataFrame([("q1", "c1", "e1"), ("q1", "c2", "e1"), ("q2", "c1", "e1")], "qid string, chunk_id string, evidence_id string")
    shown = evaluation.chunk_evidence(q, computed)
    assert {tuple(r) for r in shown.collect()} == {("q1", "c1", "e1"), ("q1", "c2", "e1"), ("q2", "c9", "e1"), ("q2", "c9", None), ("q2", "c8", None)}
    ent = spark.createDataFrame([("f:Ann", "f", "Ann", "", "", [], [1.0])], "id string, file_id string, name string, type string, description string, source_id array<string>, vec array<double>")
    rel = spark.createDataFrame([("f:Ann||Bo", "f", "Ann||Bo", "Ann", "Bo", [], "", [], 1, [1.0])], "id string, file_id string, rel_key string, source string, target string, keywords array<string>, description string, source_id array<string>, first_seen long, vec array<double>")
    index = retrieval.Index(spark.createDataFrame([], "chunk_id string, text string, vec array<double>"), ent, rel)
    trace = [("q1", "local", "entity", 1, "f:Ann"), ("q1", "local", "relation", 1, "f:Ann||Bo"), ("q1", "local", "chunk", 1, "c1"), ("q1", "local", "chunk", 2, "c2"), ("q2", "local", "chunk", 1, "c9")]
    names = metrics.name_table(spark.createDataFrame([("Ann",)], "name string"), spark.createDataFrame([], "alias string, name string"))
    out = {(r["mode"], r["qid"]): r for r in evaluation.evaluate(q, spark.createDataFrame(trace, "qid string, mode string, kind string, rank int, id string"), index, names, shown, ["local", "naive"]).collect()}
    assert set(out) == {(m, i) for m in ("local", "naive") for i in ("q1", "q2")}
    one = out["local", "q1"]
    assert (one["entity_f1"], one["entity_matched"], one["relation_f1"], one["evidence_recall_at_k"], one["redundancy_rate"], one["k"]) == (1.0, ["Ann"], 1.0, 0.5, 0.5, 2)
    assert one["relevant_chunk_ids"] == ["c1", "c2"] and one["novel_relevant_chunk_ids"] == ["c1"] and one["matched_evidence_ids"] == ["e1"] and one["matched_answer_point_indices"] == [1]
    assert out["local", "q2"]["evidence_recall"] == 1.0 and out["naive", "q1"]["k"] == 0 and out["naive", "q1"]["first_relevant_rank"] is None
    summary = metrics.evaluation_summary(spark.createDataFrame(list(out.values()))).collect()
    assert {r["mode"]: (r["count"], r["micro_evidence_recall"]) for r in summary} == {"local": (2, 2 / 3), "naive": (2, 0.0)}
    assert len(fingerprint(ChunkConfig())) == 64
