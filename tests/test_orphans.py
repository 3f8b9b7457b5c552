import datetime
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import orphans as O

DAY = datetime.datetime(2024, 1, 1)


def at(n):
    return None if n is None else DAY + datetime.timedelta(days=n)


def frames(spark, parents, refs):
    p = spark.createDataFrame([(k, at(t), live, i) for i, (k, t, live) in enumerate(parents)], O.PARENTS)
    r = spark.createDataFrame([("t", "f", i, k or "null", k, at(t)) for i, k, t in refs], O.REFS)
    return p, r


def expected(parents, refs):
    out = {}
    for i, k, t in refs:
        live = [a for key, a, ok in parents if key == k and k is not None and ok and a is not None]
        orphan = t is None or not any(a <= t for a in live)
        if orphan:
            seen = [1 for key, _, _ in parents if key == k and k is not None]
            out[i] = "late" if live else "deleted" if seen else "missing"
    return out


def standing(state):
    return {r["row_id"]: r["cause"] for r in O.orphans(state).collect()}


def data(seed, n=120):
    rng = random.Random(seed)
    keys = ["hot"] * 6 + [f"k{i}" for i in range(12)] + [None]
    parents = [(rng.choice(keys), rng.choice([None, *range(100)]), rng.random() < 0.7) for _ in range(n // 3)]
    refs = [(i, rng.choice(keys), rng.choice([None, *range(100)])) for i in range(n)]
    return parents, refs


def test_one_step_matches_brute_force(spark):
    parents, refs = data(1)
    assert standing(O.advance(None, *frames(spark, parents, refs))) == expected(parents, refs)


@pytest.mark.parametrize("steps", [1, 2, 4])
def test_replay_by_periods_matches_brute_force(spark, steps):
    parents, refs = data(4)
    seen = []
    state = O.replay(*frames(spark, parents, refs), steps, lambda n, s: seen.append(n))
    assert standing(state) == expected(parents, refs) and seen == list(range(steps))
    # Snapshots count every reference once, whatever it went through.
    counts = O.snapshots(state).collect()
    assert sum(r["refs"] for r in counts) == len(refs) and sum(r["orphans"] for r in counts) == len(expected(parents, refs))


def test_steps_in_any_order_give_the_same(spark):
    """Versions that are deleted arrive live, and their deletions before, with or after them."""
    parents, refs = data(2, 60)
    parents = [p for p in parents if p[0] is not None]
    for seed in range(2):
        rng = random.Random(seed)
        steps = [([], [], []) for _ in range(3)]
        for i, (k, t, live) in enumerate(parents):
            steps[rng.randrange(3)][0].append((k, at(t), True, i))
            if not live:
                steps[rng.randrange(3)][1].append((k, at(t), i))
        for ref in refs:
            steps[rng.randrange(3)][2].append(ref)
        state = None
        for p, d, r in steps:
            state = O.advance(state, spark.createDataFrame(p, O.PARENTS), frames(spark, [], r)[1], spark.createDataFrame(d, O.GONE))
        assert standing(state) == expected(parents, refs)


@pytest.mark.parametrize("when", ["before", "with", "after"])
def test_a_deletion_holds_whenever_it_comes(spark, when):
    none = frames(spark, [], [])
    gone = spark.createDataFrame([("a", at(5), 0)], O.GONE)
    state = O.advance(None, none[0], none[1], gone if when == "before" else None)
    state = O.advance(state, *frames(spark, [("a", 5, True)], [(1, "a", 10)]), gone if when == "with" else None)
    state = O.advance(state, *none, gone if when == "after" else None)
    assert standing(state) == {1: "deleted"}
    # The version is delivered again, and another one at the same time: only the other serves.
    state = O.advance(state, *frames(spark, [("a", 5, True)], []))
    assert standing(state) == {1: "deleted"}
    state = O.advance(state, spark.createDataFrame([("a", at(5), True, 9)], O.PARENTS), none[1])
    assert standing(state) == {} and state.served.count() >= 1


def test_arrival_resolves_and_deletion_reopens(spark):
    state = O.advance(O.OrphanState.empty(spark), *frames(spark, [], [(1, "a", 10)]))
    assert standing(state) == {1: "missing"}
    state = O.advance(state, *frames(spark, [("a", 5, True)], []))
    assert standing(state) == {}
    gone = spark.createDataFrame([("a", at(5), 0)], O.GONE)
    state = O.advance(state, *frames(spark, [], []), deletions=gone)
    assert standing(state) == {1: "deleted"}
    assert [r["refs"] for r in O.snapshots(state).collect()] == [1]


def test_snapshots_count_what_waits(spark):
    parents, refs = [("a", 40, True)], [(1, "a", 1), (2, "b", 1), (3, "a", 50)]
    rows = {r["period"]: r.asDict() for r in O.snapshots(O.advance(None, *frames(spark, parents, refs))).collect()}
    assert rows["2024-01"]["orphans"] == 2 and rows["2024-01"]["waiting"] == 2
    assert rows["2024-02"]["resolved"] == 1 and rows["2024-02"]["waiting"] == 1


@pytest.mark.parametrize("empty", [True, False])
def test_graph_tables_with_dirt(spark, empty):
    ddl_e = "row_id long, file_id string, name string, source_id array<string>, loaded_at timestamp_ntz, is_deleted boolean, key string"
    ddl_r = "row_id long, file_id string, source string, target string, loaded_at timestamp_ntz, value int"
    ddl_c = "chunk_id string, loaded_at timestamp_ntz, is_deleted boolean, live int"
    e = [] if empty else [
        (1, "f", "Ann Lee", ["c1", "c2", None], at(1), None, "x"), (2, "f", None, None, at(1), False, "x"), (3, "f", "Bo", [], at(1), True, "x")
    ]
    r = [] if empty else [(7, "f", "LEE, ann", " ", at(2), 1), (8, "f", "Bo", "Cy", at(2), 1), (9, None, "Ann Lee", None, at(2), 1)]
    c = [] if empty else [("c1", at(1), None, 1), ("c1", at(1), None, 1)]
    parents, refs = O.reference_keys(spark.createDataFrame(e, ddl_e), spark.createDataFrame(r, ddl_r), spark.createDataFrame(c, ddl_c))
    got = {(x["ref_field"], x["row_id"], x["ref_key"]) for x in O.orphans(O.replay(parents, refs)).collect()}
    assert got == (set() if empty else {("source_id", 1, "c2"), ("source", 8, "Bo"), ("target", 8, "Cy"), ("source", 9, "Ann Lee")})


def test_streaming_state_equals_batch(spark, tmp_path):
    from graphloom.streaming.incremental import track_orphans

    schema = "kind string, row_id long, key string, loaded_at timestamp_ntz"
    rows = [("r", 1, "a", at(3)), ("p", 0, "a", at(1)), ("r", 2, "b", at(3))]
    for i, row in enumerate(rows):
        spark.createDataFrame([row], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")

    def split(batch):
        p = batch.where("kind = 'p'").select("key", "loaded_at", F.lit(True).alias("live"))
        r = batch.where("kind = 'r'").select(F.lit("t").alias("ref_table"), F.lit("f").alias("ref_field"), "row_id", F.col("key").alias("ref_key"), "key", "loaded_at")
        return p, r

    seen = []
    query, held = track_orphans(stream, split, lambda snap, n: seen.append(snap.count()), f"{tmp_path}/check")
    query.awaitTermination(120)
    assert standing(held[0]) == {2: "missing"} and len(seen) >= 1


def test_streaming_state_outlives_a_run_and_takes_deletions(spark, tmp_path):
    from graphloom.streaming.incremental import track_orphans

    schema = "kind string, row_id long, key string, loaded_at timestamp_ntz"

    def split(batch):
        p = batch.where("kind = 'p'").select("key", "loaded_at", F.lit(True).alias("live"))
        r = batch.where("kind = 'r'").select(F.lit("t").alias("ref_table"), F.lit("f").alias("ref_field"), "row_id", F.col("key").alias("ref_key"), "key", "loaded_at")
        return p, r, batch.where("kind = 'd'").select("key", "loaded_at")

    def run(name, rows):
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        counts = []
        query, held = track_orphans(stream, split, lambda snap, n: counts.extend(r["refs"] for r in snap.collect()), f"{tmp_path}/check")
        query.awaitTermination(120)
        return standing(held[0]), counts

    assert run("a", [("p", 0, "a", at(1)), ("r", 1, "b", at(3))]) == ({1: "missing"}, [1])
    # A parent of an earlier run serves, an orphan of an earlier run is resolved, and snapshots count all runs.
    assert run("b", [("r", 2, "a", at(3)), ("p", 0, "b", at(2))]) == ({}, [2])
    assert run("c", [("d", 0, "a", at(1)), ("d", 0, "c", at(1)), ("p", 0, "c", at(1)), ("r", 3, "c", at(4))]) == ({2: "deleted", 3: "deleted"}, [3])
    # Nothing new: the state of the earlier runs is there all the same. A withdrawn version may be delivered again.
    assert run("d", [])[0] == {2: "deleted", 3: "deleted"}
    assert run("e", [("p", 0, "a", at(1))]) == ({2: "deleted", 3: "deleted"}, [3])
