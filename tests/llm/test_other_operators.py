import datetime
import random

import numpy as np
import pytest

from graphloom.llm import leaks, neighbours, packing, subjects, survivor

# --- most similar vectors ---------------------------------------------------------------------------------


def brute_lists(vectors, k):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], dtype=np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T
    np.fill_diagonal(s, -9)
    return {i: [ids[j] for j in np.argsort(-s[n], kind="stable")[:k]] for n, i in enumerate(ids)}


def test_neighbours_recall_and_dirt(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 64))
    good = {f"v{i}": (centres[i % 12] + 0.4 * rng.normal(size=64)).tolist() for i in range(600)}
    rows = [(i, v, "x") for i, v in good.items()] + [(i, v, "y") for i, v in list(good.items())[:50]]
    nan = [float("nan")] + [1.0] * 63
    rows += [("null", None, "x"), ("zero", [0.0] * 64, "x"), ("short", [1.0], "x"), ("nan", nan, "x"), ("hole", [None] + [1.0] * 63, "x"), (None, [1.0] * 64, "x")]
    df = spark.createDataFrame(rows, "id string, vec array<float>, score string")
    got = {}
    for r in neighbours.nearest(df).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["other"])
    want = brute_lists(good, 5)
    assert set(got) == set(want) and all(len(v) == 5 and len(set(v)) == 5 for v in got.values())
    assert sum(len(set(got[i]) & set(want[i])) for i in want) / (5 * len(want)) >= 0.98


def test_equal_vectors_and_small_tables(spark):
    rng = np.random.default_rng(2)
    base = {f"u{i}": rng.normal(size=64).tolist() for i in range(20)}
    same = {f"s{i:02d}": [1.0] * 64 for i in range(30)}  # more equal ids than places
    df = spark.createDataFrame(list({**base, **same}.items()), "id string, vec array<float>")
    got = {}
    for r in neighbours.nearest(df).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["other"])
    assert got["s00"] == ["s01", "s02", "s03", "s04", "s05"] and got["s29"] == ["s00", "s01", "s02", "s03", "s04"]
    assert len(got) == 50 and all(len(v) == 5 for v in got.values())
    assert neighbours.nearest(df.limit(0)).count() == 0
    assert neighbours.nearest(df.where("id = 'u1'")).count() == 0
    two = neighbours.pairs(neighbours.nearest(df.where("id in ('u1', 'u2')"))).collect()
    assert [tuple(r) for r in two] == [("u1", "u2")]


def test_multiples_of_a_vector_and_ties(spark):
    rng = np.random.default_rng(4)
    one = np.round(rng.normal(size=64) * 8)
    rows = {f"a{n:02d}": (one * (n + 1)).tolist() for n in range(12)} | {f"u{n}": rng.normal(size=64).tolist() for n in range(9)}
    # 200 vectors at one distance from z.
    base = np.zeros(64)
    base[0] = 1
    rows["z"] = base.tolist()
    for n in range(63):
        v = base.copy()
        v[n + 1] = 1
        rows[f"t{n:02d}"] = v.tolist()
    got = {}
    df = spark.createDataFrame(list(rows.items()), "id string, vec array<float>")
    for r in neighbours.nearest(df).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["other"])
    assert got["a11"] == ["a00", "a01", "a02", "a03", "a04"] and got["a00"] == ["a01", "a02", "a03", "a04", "a05"]
    assert got["z"] == ["t00", "t01", "t02", "t03", "t04"]


def test_second_centroids_divide_cells(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 64))
    good = {f"v{i}": (centres[i % 12] + 0.4 * rng.normal(size=64)).tolist() for i in range(600)}
    df = spark.createDataFrame(list(good.items()), "id string, vec array<float>")
    codec = neighbours.fit(np.array(list(good.values())), 600, cells=40, most=4)
    assert len(codec.coarse) == 4 and len(codec.second) == 10
    x = np.array(list(good.values()), dtype=np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert len(set(codec.own(x).tolist())) >= 12
    got = {(r["id"], r["other"]) for r in neighbours.nearest(df, cells=40, most=4, probes=8).collect()}
    want = {(i, o) for i, os in brute_lists(good, 5).items() for o in os}
    assert len(got & want) / len(want) >= 0.9


def test_blocks_of_a_heavy_cell_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_MEMBERS", 16)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 32)
    rng = np.random.default_rng(3)
    one = rng.normal(size=64)
    good = {f"v{i}": (one + 0.05 * rng.normal(size=64)).tolist() for i in range(200)}
    df = spark.createDataFrame(list(good.items()), "id string, vec array<float>")
    got = {(r["id"], r["other"]) for r in neighbours.nearest(df, probes=99).collect()}
    want = {(i, o) for i, os in brute_lists(good, 5).items() for o in os}
    assert got == want


# --- survivors --------------------------------------------------------------------------------------------

ENT = "row_id long, file_id string, name string, type string, description string, source_id array<string>, run_id int, extracted_at timestamp_ntz, layers int"
RUN = "run_id int, trust_rank int"


def day(n):
    return None if n is None else datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)


def test_survivor_layers_and_policy(spark):
    rows = [
        (5, "f", "Ann", "Person", "-", None, 1, day(9), 0),  # latest, least filled
        (6, "f", "ann", "N/A", "old text", ["c1"], 2, day(1), 0),  # trusted, two filled
        (7, "f", "ANN", None, " ", ["c2"], 1, day(3), 0),  # behind 5 and 6
        (8, "f", "Bo", "T", "d", ["c"], 2, day(2), 0), (9, "f", "bo", "T", "d", ["c"], 2, day(2), 0), (4, "f", "BO", "T", "", ["c"], None, None, 0),
        (1, "f", "Cy", "T", "d", [], 1, day(1), 0), (2, "f", None, "T", "d", [], 1, day(1), 0), (3, None, "Cy", "T", "d", [], 1, day(1), 0),
        (10, "g", "Di", "T", "d", [], 1, day(1), 0), (10, "g", "Di", "T", "d", [], 1, day(1), 0),
    ]
    runs = spark.createDataFrame([(1, 1), (2, 5), (2, 4), (None, 9)], RUN)
    got = {r["first_id"]: r for r in survivor.survivors(spark.createDataFrame(rows, ENT), runs).collect()}
    assert set(got) == {5, 4}
    ann, bo = got[5], got[4]
    assert (ann["row_id"], ann["type"], ann["description"], ann["source_id"], ann["ideal"]) == (6, "Person", "old text", ["c1"], False)
    assert (bo["row_id"], bo["ideal"], bo["size"]) == (8, True, 3)
    empty = spark.createDataFrame([], ENT)
    assert survivor.survivors(empty, runs).count() == 0 and survivor.survivors(empty, runs.limit(0)).count() == 0


def test_ideal_rows_match_brute_force(spark):
    rng = random.Random(5)
    rows = [
        (i, "f", f"n{rng.randint(0, 40)}", rng.choice(["P", "?", None]), rng.choice(["d", "TBD", ""]), rng.choice([["c"], [], None, [" "]]), rng.choice([1, 2, 3, None]), day(rng.randint(0, 3)), 0)
        for i in range(300)
    ]
    trust = {1: 1, 2: 2, 3: 2}
    groups = {}
    for r in rows:
        key = ((r[3] == "P") + (r[4] == "d") + (r[5] == ["c"]), r[7], trust.get(r[6], -1))
        groups.setdefault(r[2], []).append((r[0], key))
    want = set()
    for g in groups.values():
        best = [i for i, k in g if all(k[d] == max(x[1][d] for x in g) for d in range(3))]
        if len(g) > 1 and best:
            want.add((min(i for i, _ in g), min(best)))
    found = survivor.survivors(spark.createDataFrame(rows, ENT), spark.createDataFrame(list(trust.items()), RUN))
    assert {(r["first_id"], r["row_id"]) for r in found.where("ideal").collect()} == want


def test_layers_are_those_of_the_whole_group(spark):
    rows = [
        (1, "f", "Ann", "P", "d", None, 1, day(10), 0), (2, "f", "Ann", "P", "d", None, 1, day(9), 0),
        (3, "f", "Ann", "P", None, ["x"], 1, day(8), 0), (4, "f", "Ann", None, None, ["y"], 1, day(9.5), 0),
    ]
    got = survivor.survivors(spark.createDataFrame(rows, ENT), spark.createDataFrame([(1, 1)], RUN)).collect()[0]
    assert (got["row_id"], got["source_id"], got["layers"]) == (1, ["y"], 3)


@pytest.mark.parametrize("tasks", [4, 40])
def test_survivors_match_brute_force(spark, monkeypatch, tasks):
    """Also where a group reaches over many partitions."""
    monkeypatch.setattr(survivor, "task_count", lambda spark: tasks)
    rng = random.Random(12)
    rows = [
        (i, "f", f"n{min(rng.randint(0, 9), rng.randint(0, 9))}", rng.choice([f"P{i}", None]), rng.choice([f"d{i}", ""]), rng.choice([[f"c{i}"], []]), rng.randint(1, 4), day(rng.choice([None, *range(60)])), 0)
        for i in range(250)
    ]
    groups = {}
    for i, _, name, *fields, run, at, _ in rows:
        kept = [f or None for f in fields]
        groups.setdefault(name, []).append((i, kept, (sum(f is not None for f in kept), at or datetime.datetime.min, run)))
    want = {}
    for g in groups.values():
        above = {m: {o for _, _, o in g if o != m and all(x >= y for x, y in zip(o, m))} for _, _, m in g}
        depth = {}
        for m in sorted(above, key=lambda m: len(above[m])):
            depth[m] = 1 + max((depth[o] for o in above[m]), default=0)
        order = sorted(g, key=lambda r: (depth[r[2]], -r[2][0], datetime.datetime.max - r[2][1], -r[2][2], r[0]))
        values = [next((r[1][n] for r in order if r[1][n]), None) for n in range(3)]
        if len(g) > 1:
            want[min(r[0] for r in g)] = (len(g), order[0][0], *values, max(depth.values()), all(a >= b for r in g for a, b in zip(order[0][2], r[2])))
    got = survivor.survivors(spark.createDataFrame(rows, ENT), spark.createDataFrame([(n, n) for n in range(1, 5)], RUN)).collect()
    assert {r["first_id"]: (r["size"], r["row_id"], r["type"], r["description"], r["source_id"], r["layers"], r["ideal"]) for r in got} == want


# --- packing ----------------------------------------------------------------------------------------------


def test_place_makes_the_sum_of_squares_smallest():
    rng = random.Random(6)
    packer, gaps = packing.SumOfSquares(20), []
    for _ in range(200):
        size = rng.randint(1, 19)
        before = sorted(gaps)

        def total(g):
            return sum(g.count(x) ** 2 for x in set(g) if x)

        options = [total([*before[:i], before[i] - size, *before[i + 1 :]]) for i, g in enumerate(before) if g >= size]
        options.append(total([*before, 20 - size]))
        packer.place(size)
        gaps = [g for g in range(1, 21) for _ in range(int(packer.count[g]))]
        assert total(gaps) == min(options)
        assert sorted(gaps) == sorted(g for g, boxes in enumerate(packer.open) for _ in boxes)


def test_packing_is_complete_and_fits(spark):
    rng = random.Random(7)
    docs = [(i, "é" * rng.randint(0, 90), 1) for i in range(400)] + [(900, None, 1), (901, "", 1), (902, "x" * 1000, 1), (903, "x" * 99, 1), (5, "again", 1)]
    specs = spark.createDataFrame([(1, 100), (2, 400), (1, 100), (None, 7), (3, 0)], "spec_id int, capacity_tokens int")
    df = spark.createDataFrame(docs, "doc_id long, text string, tokens int")
    packed = packing.pack(df, specs, group_items=100)
    rows = packed.collect()
    assert [tuple(r) for r in rows if r["container"] is None] == [(None, None, 900, 0, 0)]
    for spec, capacity in ((1, 100), (2, 400)):
        own = [r for r in rows if r["spec_id"] == spec]
        loads, sizes = {}, {}
        for r in own:
            loads[r["container"]] = loads.get(r["container"], 0) + r["tokens"]
            sizes.setdefault(r["doc_id"], []).append(r["tokens"])
        assert max(loads.values()) <= capacity
        want = {}
        for i, t, _ in docs:
            if t is not None:
                want.setdefault(i, []).append(len(t.encode()) + 1)
        assert {i: sum(s) for i, s in sizes.items()} == {i: sum(s) for i, s in want.items()}
        assert all(len(sizes[i]) == sum(-(-s // capacity) for s in w) for i, w in want.items())
        total = sum(sum(w) for w in want.values())
        assert len(loads) <= 1.06 * total / capacity + 1
    assert packing.pack(df.limit(0), specs).count() == 0
    assert {r["spec_id"] for r in packing.fill(packed, specs).collect()} == {1, 2}


def test_rows_under_one_id_or_none_keep_their_own_containers(spark):
    rows = [(1, "x" * 1000)] * 3 + [(None, "y" * 1000)] * 3 + [(None, "z" * 30)] * 40
    df = spark.createDataFrame(rows, "doc_id long, text string")
    specs = spark.createDataFrame([(n, 100 + n) for n in range(130)], "spec_id int, capacity_tokens int")
    packed = packing.pack(df, specs, group_items=7).groupBy("spec_id", "container").agg({"tokens": "sum"}).collect()
    loads = {}
    for r in packed:
        assert r["sum(tokens)"] <= 100 + r["spec_id"]
        loads[r["spec_id"]] = loads.get(r["spec_id"], 0) + r["sum(tokens)"]
    assert loads == {n: 6 * 1001 + 40 * 31 for n in range(130)}


# --- leaks ------------------------------------------------------------------------------------------------


def test_suffix_array_and_search():
    rng = np.random.default_rng(8)
    sections = [rng.integers(1, 4, size=n) for n in (0, 1, 5, 40, 40, 60)]
    sections.append(sections[3].copy())
    index = leaks.FMIndex(sections, 3)
    patterns = np.array([[a, b, c] for a in (1, 2, 3) for b in (1, 2, 3) for c in (0, 1, 2, 3)])
    which, low, high = index.search(patterns)
    found = {}
    for w, a, b in zip(which, low, high, strict=True):
        found[tuple(patterns[w])] = sorted(index.locate(np.arange(a, b)).tolist())
    want = {}
    for s, at in zip(sections, index.starts, strict=True):
        for i in range(len(s) - 2):
            want.setdefault(tuple(s[i : i + 3]), []).append(int(at) + i)
    assert found == {k: sorted(v) for k, v in want.items()}


@pytest.mark.parametrize(("shard", "block"), [(400_000, 20_000), (40, 200)])
def test_leaks_match_brute_force(spark, shard, block):
    rng = random.Random(9)
    vocabulary = ["ann", "Bo's", "cy", "Straße", "d-e", "x1", "ΣΑΣ"]
    items = [(i, "en", " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 30)))) for i in range(8)]
    han = "灰石渡口的奖杯真旧啊他写道奖杯还在旧钟楼然后睡了青螺娘不说话队服就在手边"
    items += [(20, "zh", han), (21, "zh-XX", "短"), (22, None, None), (23, "en", "")]
    docs = []
    for i in range(40):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 50)))
        if i % 3 == 0:
            words = items[rng.randrange(8)][2].split()
            cut = rng.randint(0, 6)
            text += ", " + ";\n".join(w.upper() for w in words[cut : cut + rng.randint(8, 20)]) + " " + text[:30]
        docs.append((i, text, 0))
    docs += [(100, "，".join(han[3:24]), 0), (101, "前" + han[5:24], 0), (102, None, 0), (103, "", 0), (0, docs[0][1], 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    it = spark.createDataFrame(items, "item_id long, lang string, text string")
    spans = leaks.leaks(df, it, shard, block).collect()
    got = {(r["doc_id"], r["item_id"]) for r in spans}
    want = set()
    for d, t, _ in docs:
        for i, lang, text in items:
            if not t or not text:
                continue
            signs = leaks.is_chinese(lang, text)
            n = 20 if signs else 12
            a, b = leaks.tokens(t, signs), leaks.tokens(text, signs)
            windows = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)}
            if any(tuple(a[k : k + n]) in windows for k in range(len(a) - n + 1)):
                want.add((d, i))
    assert got == want and (100, 20) in got and (101, 20) not in got
    by = {d: t for d, t, _ in docs}
    assert all(len(leaks.tokens(by[r["doc_id"]][r["char_start"] : r["char_end"]], r["item_id"] == 20)) >= 12 for r in spans)
    assert leaks.leaks(df.limit(0), it).count() == 0 and leaks.leaks(df, it.limit(0)).count() == 0
    merged = leaks.removals(leaks.leaks(df, it, shard, block)).collect()
    for d in {r["doc_id"] for r in merged}:
        own = sorted((r["char_start"], r["char_end"]) for r in merged if r["doc_id"] == d)
        assert all(a[1] < b[0] for a, b in zip(own, own[1:]))


# --- subjects ---------------------------------------------------------------------------------------------


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(10)
    packed = subjects.pack([["ann", "bo"], ["cy"], ["bo", "bo", "漢字"]], [np.array([1.0, 0]), np.array([0, 1.0]), np.array([1.0, 1])], [1.0, 2.0, 1.0])
    params = subjects.Params.start(2)
    grads, _ = subjects.gradient(params, packed)
    for which, array in enumerate(params.arrays()):
        for _ in range(6):
            at = tuple(int(rng.integers(n)) for n in array.shape)
            if which == 0:
                at = (int(rng.choice(packed["gram"])), at[1])
            kept = array[at]
            losses = []
            for e in (0.01, -0.01):
                array[at] = kept + e
                losses.append(subjects.gradient(params, packed)[1])
            array[at] = kept
            assert abs((losses[0] - losses[1]) / 0.02 - grads[which][at]) < 2e-3


def made_up(rng, topic, n):
    own = {"law": ["court", "judge", "clause"], "food": ["onion", "butter", "stew"]}
    plain = ["door", "gate", "bell", "road", "lamp"]
    out = []
    for k in range(n):
        words = [rng.choice(plain) for _ in range(5)]
        if topic and k % 2 == 0:
            words[2] = rng.choice(own[topic])
        out.append("The " + " ".join(words) + ".")
    return " ".join(out)


def test_subjects_on_held_out_documents(spark):
    rng = random.Random(11)
    topics = [rng.choice(["law", "food", None]) for _ in range(700)]
    docs = [(i, made_up(rng, t, rng.randint(4, 9)), "x") for i, t in enumerate(topics)] + [(900, None, "x"), (901, "", "x"), (902, "...", "x")]
    labels = [(i, f" {t.upper()} " if rng.random() < 0.9 else "FOOD", "r") for i, t in enumerate(topics[:350]) if t]
    labels += labels[:20] + [(5000, "law", "r"), (1, None, "r"), (2, "nonsense", "r"), (None, "law", "r")]
    df = spark.createDataFrame(docs, "doc_id long, text string, subject string")
    lb = spark.createDataFrame(labels, "doc_id long, subject string, text string")
    names = spark.createDataFrame([("law", ""), ("food", ""), (None, "")], "subject string, scope_note string")
    got = {}
    for r in subjects.subject_areas(df, lb, names).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    right = sum(got.get(i, set()) == ({t} if t else set()) for i, t in enumerate(topics) if i >= 350)
    assert right / 350 >= 0.9 and not {900, 901, 902} & set(got)
    assert subjects.subject_areas(df, lb.limit(0), names).count() == 0
    assert subjects.subject_areas(df, lb, names.limit(0)).count() == 0
    assert subjects.subject_areas(df.limit(0), lb, names).count() == 0
