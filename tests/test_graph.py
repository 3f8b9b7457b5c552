import json
import math

import pytest
from pyspark.sql import functions as F

from graphloom.config import RetrievalConfig
from graphloom.models.backends import backend
from graphloom.operators import align, extraction, gold, graph, merge, metrics, retrieval, topk
from graphloom.schema import GOLD_DDL
from graphloom.sources.files import Store, check_source, derived_map, read_chunk_store, read_gold, read_texts

ENT = "row_id long, file_id string, name string, type string, description string, source_id array<string>"
REL = "row_id long, file_id string, source string, target string, keywords array<string>, description string, source_id array<string>"


def test_merge(spark):
    e = spark.createDataFrame(
        [(2, "f", "A", "L", "d", ["c2", "c1"]), (1, "f", "A", "P", "", ["c1"]), (3, "f", "A", None, "d", None), (4, "f", "", "P", "x", []), (5, "f", None, "P", "x", [])], ENT
    )
    (row,) = merge.merge_entities(e).collect()
    assert (row["name"], row["type"], row["description"], row["source_id"]) == ("A", "P", "d | d", ["c1", "c2"])
    r = spark.createDataFrame([(1, "f", "B", "A", ["k"], None, ["c1"]), (2, "f", "A", "B", ["j", "k"], "t", ["c2"]), (3, "f", "A", None, None, None, None)], REL)
    (row,) = merge.merge_relations(r).collect()
    assert (row["rel_key"], row["source"], row["keywords"], row["description"], row["source_id"]) == ("A||B", "B", ["k", "j"], "t", ["c1", "c2"])
    assert merge.merge_entities(e.limit(0)).count() == 0 and merge.merge_relations(r.limit(0)).count() == 0


def test_graph(spark):
    e = merge.merge_entities(spark.createDataFrame([(1, "f", "A", "Person", "", ["c"]), (2, "f", "Z", "Odd", "", [])], ENT))
    r = merge.merge_relations(spark.createDataFrame([(1, "f", "A", "B", ["k"], "", []), (2, "f", "A", "A", [], "", [])], REL))
    assert {(x["name"], x["known"]) for x in graph.vertices(e, r).collect()} == {("A", True), ("B", False), ("Z", True)}
    assert [x["name"] for x in graph.dangling(e, r).collect()] == ["B"]
    style = {x["name"]: x for x in graph.node_style(e, r).collect()}
    assert style["A"]["degree"] == 3 and math.isclose(style["A"]["size"], 10 + 4 * 3**0.5) and style["A"]["colour"] == "#fc8d59"
    assert style["Z"]["colour"] == graph.GREY and style["B"]["chunks"] == 0
    seeds = spark.createDataFrame([("q", "f", "B", 1), ("q", "f", "nobody", 2)], "qid string, file_id string, name string, rank int")
    assert [x["rel_key"] for x in graph.one_hop(seeds, r).collect()] == ["A||B"]


def test_topk_zero_null_ties(spark):
    v = spark.createDataFrame([("z", [0.0, 0.0]), ("n", None), ("b", [2.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0]), ("s", [1.0])], "id string, vec array<float>")
    q = spark.createDataFrame([("q", [1.0, 0.0]), ("zero", [0.0, 0.0])], "qid string, vec array<float>")
    got = [(r["qid"], r["id"], r["rank"]) for r in topk.top_k(q, v, 2).orderBy("rank").collect()]
    assert got == [("q", "a", 1), ("q", "b", 2)]
    assert [(r["qid"], r["id"]) for r in topk.top_k(q, v, 1, block=1).collect()] == [("q", "a")]
    cand = spark.createDataFrame([("q", "c"), ("q", "b"), ("q", "z")], "qid string, id string")
    assert [r["id"] for r in topk.top_k_within(q, cand, v, 5).orderBy("rank").collect()] == ["b", "c"]
    assert topk.top_k(q.limit(0), v, 2).count() == 0 and topk.top_k(q, v.limit(0), 2).count() == 0


def test_extraction(spark):
    responses = [
        'x {"entities":[{"name":"A"},5,{"name":null}],"relationships":[{"source":"A","target":"B","keywords":"a, b ,,c"},{"source":"A"}]} y',
        "hello", "", None, '{"entities": [{"name": "C", "type": "T",}', "[1]", '{"entities": null}',
        '{"relationships":[{"source":"A","target":"B","keywords":[" x ",""]},{"source":"A","target":"C","keywords":7}]}',
    ]
    df = spark.createDataFrame([("f", f"c{i}", r) for i, r in enumerate(responses)], "file_id string, chunk_id string, response string")
    assert {(r["chunk_id"], r["name"], r["type"]) for r in extraction.entities_of(df).collect()} == {("c0", "A", ""), ("c4", "C", "T")}
    assert {(r["target"], tuple(r["keywords"])) for r in extraction.relations_of(df).collect()} == {("B", ("a", "b", "c")), ("B", ("x",)), ("C", ())}


def test_model_calls_are_retried_and_failures_kept(spark):
    def model(text):
        if text == "bad":
            raise ValueError("no")
        return "" if text == "empty" else text.upper()

    df = spark.createDataFrame([("f", t, t) for t in ("ok", "bad", "empty")], "file_id string, chunk_id string, text string")
    got = {r["chunk_id"]: (r["response"], r["status"]) for r in extraction.call_model(df, model, 2, attempts=2, waits=(0,)).collect()}
    assert got == {"ok": ("OK", "ok"), "bad": (None, "failed"), "empty": (None, "failed")}
    with pytest.raises(ValueError):
        backend("other")


def test_locate_and_overlap(spark):
    docs = spark.createDataFrame([("f", "one  two\n three two one"), ("g", "aaa")], "file_id string, text string")
    rows = [("c1", "f", "two three"), ("c2", "f", "two"), ("c3", "f", "four"), ("c4", "g", "aa"), ("c5", "f", " "), ("c6", "h", "one"), ("c7", "f", " one two ")]
    chunks = spark.createDataFrame(rows, "chunk_id string, file_id string, text string")
    located = align.locate(chunks, docs)
    got = {r["chunk_id"]: (r["status"], r["char_start"], r["char_end"]) for r in located.collect()}
    assert got == {
        "c1": ("ok", 5, 15), "c2": ("ambiguous", None, None), "c3": ("missing", None, None), "c4": ("ambiguous", None, None),
        "c5": ("missing", None, None), "c6": ("missing", None, None), "c7": ("ok", 0, 8),
    }
    ev = spark.createDataFrame([("q", "e1", "f", 7, 9), ("q", "e2", "f", 15, 20), ("q", "e3", "f", 6, 6)], "qid string, evidence_id string, file_id string, char_start int, char_end int")
    pairs = align.evidence_chunks(located, ev)
    assert {(r["chunk_id"], r["evidence_id"]) for r in pairs.collect()} == {("c1", "e1"), ("c7", "e1")}
    (row,) = derived_map(pairs).collect()
    assert row["gold_chunk_evidence"] == {"c1": ["e1"], "c7": ["e1"]}


def metric_input(spark, order):
    shows = spark.createDataFrame([("q", "c1", "e1"), ("q", "c2", "e1"), ("q", "c3", "e2"), ("q", "c4", None)], "qid string, chunk_id string, evidence_id string")
    points = spark.createDataFrame([("q", "e1", 1), ("q", "e2", 2), ("q", "e2", 3)], "qid string, evidence_id string, point int")
    questions = spark.createDataFrame([("q", 3), ("none", 0)], "qid string, answer_points int")
    got = spark.createDataFrame([("q", c, i + 1) for i, c in enumerate(order)], "qid string, chunk_id string, rank int")
    return {r["qid"]: r for r in metrics.evidence_metrics(got, shows, points, questions).collect()}


def test_golden_metrics(spark):
    m = metric_input(spark, ["c1", "c2"])["q"]
    assert (m["chunk_precision"], m["evidence_recall"], m["redundancy_rate"], m["ndcg"]) == (1.0, 0.5, 0.5, 1.0)
    assert math.isclose(m["answer_point_recall"], 1 / 3) and m["novel_chunks"] + m["redundant_chunks"] == m["relevant_chunks"]
    rows = metric_input(spark, ["c4", "c1", "c3"])
    m = rows["q"]
    assert math.isclose(m["chunk_precision"], 2 / 3) and m["evidence_recall"] == 1.0 and m["answer_point_recall"] == 1.0
    assert m["reciprocal_rank"] == 0.5 and m["first_relevant_rank"] == 2 and round(m["ndcg"], 6) == 0.530721
    assert rows["none"]["ndcg"] == 0.0 and rows["none"]["first_relevant_rank"] is None and rows["none"]["reciprocal_rank"] == 0.0


def test_alias_normalisation(spark):
    names = spark.createDataFrame([("Scrooge",), ("Jacob Marley",)], "name string")
    aliases = spark.createDataFrame([("Ebenezer Scrooge", "Scrooge"), ("marley", "Jacob Marley")], "alias string, name string")
    t = metrics.name_table(names, aliases)
    q = spark.createDataFrame([("q",)], "qid string")
    found = spark.createDataFrame([("q", ' "Marley" '), ("q", "Ebenezer  Scrooge")], "qid string, name string")
    want = spark.createDataFrame([("q", "Jacob Marley"), ("q", "Scrooge")], "qid string, name string")
    m = metrics.set_metrics(metrics.normalise_names(want, "name", t, "item"), metrics.normalise_names(found, "name", t, "item"), q).first()
    assert m["f1"] == 1.0 and m["hit"]
    keys = spark.createDataFrame([("Ebenezer Scrooge||Marley",), ("only  one",)], "k string")
    assert [r["o"] for r in metrics.normalise_pairs(keys, "k", t, "o").orderBy("k").collect()] == ["Jacob Marley||Scrooge", "only one"]


def test_gold_tools(spark, tmp_path):
    docs = spark.createDataFrame([("f", "One. Two  two. Three.")], "file_id string, text string")
    ranges = spark.createDataFrame([("f", "q", 1, 1, 2), ("f", "q", 2, 3, 9)], "file_id string, qid string, number int, first int, last int")
    (row,) = gold.evidence(docs, ranges).collect()
    assert (row["evidence_id"], row["char_start"], row["char_end"], row["text_preview"]) == ("q_e01", 0, 14, "One. Two two.")
    assert gold.unmatched(docs.select(F.col("file_id").alias("id")), docs.select(F.lit("g").alias("id"))).count() == 2
    envelope = {"dataset": "d", "annotation": {"chunk_independent": True}, "questions": [{"id": "q", "gold_evidence_spans": [{"evidence_id": "e"}]}]}
    (tmp_path / "gold.json").write_text(json.dumps(envelope))
    (tmp_path / "bad.json").write_text(json.dumps(envelope | {"annotation": {}}))
    assert read_gold(spark, str(tmp_path / "gold.json")).first()["dataset"] == "d"
    with pytest.raises(Exception, match="not usable"):
        read_gold(spark, str(tmp_path / "bad.json")).collect()
    assert GOLD_DDL


def test_sources_and_store(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\ny")
    assert read_texts(spark, str(tmp_path / "a.txt")).first()["text"] == "x\ny"
    (tmp_path / "d.json").write_text('{"c1": {"text": "t"}}')
    (tmp_path / "l.json").write_text('[["c1", {"text": "t"}]]')
    for name in ("d.json", "l.json"):
        assert [r["chunk_id"] for r in read_chunk_store(spark, str(tmp_path / name)).collect()] == ["c1"]
    store = Store(spark, f"{tmp_path}/store")
    assert store.load("kv", "k string, v int, t int").count() == 0
    store.upsert("kv", spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "k string, v int, t int"), "k", "t")
    store.upsert("kv", spark.createDataFrame([("a", 2, 2)], "k string, v int, t int"), "k", "t")
    keys = spark.createDataFrame([("a",), ("z",)], "k string")
    assert {(r["k"], r["v"]) for r in store.get("kv", keys, "k").collect()} == {("a", 2), ("z", None)}
    assert store.claim("one") and not store.claim("one")
    with pytest.raises(ValueError):
        store.claim("two")
    docs = spark.createDataFrame([("f", "x"), ("g", "y"), ("h", "z")], "file_id string, text string")
    import hashlib

    want = spark.createDataFrame([("f", hashlib.sha256(b"x").hexdigest()), ("g", "00")], "file_id string, sha256 string")
    assert {r["file_id"]: r["status"] for r in check_source(docs, want).collect()} == {"f": "ok", "g": "different", "h": "missing hash"}


def test_modes_agree(spark):
    chunks = spark.createDataFrame([("f_chunk_1", "ab"), ("f_chunk_2", "ab"), ("f_chunk_3", "zz")], "chunk_id string, text string")
    e = merge.merge_entities(spark.createDataFrame([(1, "f", "abba", "", "", ["f_chunk_1"]), (2, "f", "zz", "", "", ["f_chunk_3", "gone"])], ENT))
    r = merge.merge_relations(spark.createDataFrame([(1, "f", "abba", "zz", ["ab"], "b", ["f_chunk_2"])], REL))
    index = retrieval.build_index(chunks, e, r)
    q = spark.createDataFrame([("q", "ab b"), ("empty", "")], "qid string, question string")
    rows = retrieval.retrieve(q, index, ["naive", "local", "global", "hybrid"], RetrievalConfig(chunks=2, entities=1)).collect()
    by = {}
    for x in sorted(rows, key=lambda x: x["rank"]):
        by.setdefault((x["mode"], x["kind"]), []).append(x["id"])
    assert by[("naive", "chunk")] == ["f_chunk_1", "f_chunk_2"]
    assert by[("local", "chunk")] == ["f_chunk_1", "f_chunk_2"] and by[("hybrid", "chunk")] == ["f_chunk_1"]
    assert set(by[("global", "entity")]) <= set(by[("hybrid", "entity")]) == {"f:abba", "f:zz"}
    trace = retrieval.retrieve(q, index, ["hybrid"])
    context = retrieval.contexts(retrieval.context_lines(trace, index))
    text = retrieval.answers(q, context).first()["answer"]
    assert text.startswith("-----Entities-----") and "-----Chunks-----" in text
    with pytest.raises(ValueError):
        retrieval.retrieve(q, index, ["other"])


def test_incremental_build(spark, tmp_path):
    from graphloom.config import ChunkConfig
    from graphloom.streaming.incremental import build_incrementally

    schema = "file_id string, text string"
    for i in range(2):
        spark.createDataFrame([(str(i), f"Ann Lee met Bob Ray {i}.")], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    store = Store(spark, f"{tmp_path}/out")
    build_incrementally(stream, store, ChunkConfig(), f"{tmp_path}/check").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out/chunks").count() == 2
    assert {r["name"] for r in spark.read.parquet(f"{tmp_path}/out/raw_entities").collect()} == {"Ann Lee", "Bob Ray"}
