import random

import numpy as np
import pytest
from graphloom.functions.text import fold_words
from graphloom.llm import copies, names, pieces


def plain_distance(a, b):
    """Unrestricted Damerau-Levenshtein, straight from its recurrence."""
    far = len(a) + len(b)
    d = {(-1, -1): far}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = far, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = far, j
    last = {}
    for i in range(1, len(a) + 1):
        match = 0
        for j in range(1, len(b) + 1):
            k, l = last.get(b[j - 1], 0), match
            cost = 1
            if a[i - 1] == b[j - 1]:
                cost, match = 0, j
            d[i, j] = min(d[i - 1, j - 1] + cost, d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, l - 1] + (i - k - 1) + 1 + (j - l - 1))
        last[a[i - 1]] = i
    return d[len(a), len(b)]


def words(rng, n, letters="abcd "):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(n)]


def test_distances_and_metric():
    rng = random.Random(3)
    forms = words(rng, 60)
    alphabet = names.alphabet_of(forms)
    codes, lengths = names.encoded(forms, alphabet)
    i, j = (x.ravel() for x in np.indices((60, 60)))
    table = names.distances(codes[i], lengths[i], codes[j], lengths[j], len(alphabet) + 2).reshape(60, 60)
    assert table.tolist() == [[plain_distance(a, b) for b in forms] for a in forms]
    assert (table == table.T).all()
    for a in range(20):
        for b in range(20):
            assert (table[a] <= table[a, b] + table[b]).all()
    other, length = names.encoded(["zz"], alphabet)
    assert names.distances(other, length, codes[:1], lengths[:1], len(alphabet) + 2)[0] == plain_distance("zz", forms[0])


def test_tree_returns_every_entry_within():
    rng = random.Random(4)
    entries = sorted(set(words(rng, 150)))
    tree = names.BKTree([(e, e.upper()) for e in entries])
    asked = words(rng, 80) + ["qqqqqqqqqqq"]
    most = [rng.randint(0, 3) for _ in asked]
    for form, limit, found in zip(asked, most, tree.within(asked, most), strict=True):
        want = {(plain_distance(form, e), e, e.upper()) for e in entries if plain_distance(form, e) <= limit}
        assert set(found) == want
    assert names.BKTree([]).within(["a"], [2]) == [[]]


CANON = "dataset string, entity_aliases map<string,string>, gold_entities array<string>, name string"
GOLD = ["Orla Quillfeather", "Guild of Lumronen Clerks", "Semvarimir Quay", "Ivo Umberhart", "Zomifamir-on-Weir Straße", "Fête of Gradonemir"]
CASES = {
    "QUILLFEATHER, orla": "Orla Quillfeather", "Orla Qiullfether": "Orla Quillfeather", "Dr Orla Quillfeather": "Orla Quillfeather",
    "O. Quillfeather": "Orla Quillfeather", "Quillfeather, O.": "Orla Quillfeather", "Orla Quillfeather (pilot)": "Orla Quillfeather",
    "«Orla  Quillfeather's»": "Orla Quillfeather", "Vremor Quillfeather": "(none)", "X. Quillfeather": "(none)", "the Semvarimir Quay": "Semvarimir Quay",
    "Guild Lumronen Clerks": "Guild of Lumronen Clerks", "ZOMIFAMIR ON WEIR STRASSE": "Zomifamir-on-Weir Straße", "Fete of Gradonemri": "Fête of Gradonemir",
    "The Lame Tanner": "Orla Quillfeather", "lame tanner": "Orla Quillfeather", "石雁桥": "(none)", "?!": "(none)", "x" * 5000: "(none)", "Ivo": "(none)",
}


@pytest.mark.parametrize(("shard", "block"), [(1000, 20_000), (3, 20_000), (2, 3)])
def test_names_are_led_to_the_list(spark, monkeypatch, shard, block):
    monkeypatch.setattr(names, "BLOCK_NAMES", block)
    canon = spark.createDataFrame([("d", {"The Lame Tanner": "Orla Quillfeather", "Ghost": "Nobody", "": "Ivo Umberhart"}, GOLD, "x"), ("e", None, GOLD[:1] + [None], "x")], CANON)
    entered = [*CASES, "Orla Quillfeather", "Orla Quillfeather", None, " ", chr(0xA0), "Ghost"]
    rows = spark.createDataFrame([(i, n, "c") for i, n in enumerate(entered)], "row_id long, name string, canonical string")
    got = {r["row_id"]: r["canonical"] for r in names.map_names(rows, canon, shard).collect()}
    want = {i: CASES.get(n, n if n in GOLD else "(none)") for i, n in enumerate(entered) if n is not None and n.strip()}
    assert got == want


def test_names_on_empty_tables(spark):
    none = spark.createDataFrame([], CANON)
    rows = spark.createDataFrame([(1, "Ann")], "row_id long, name string")
    assert [tuple(r) for r in names.map_names(rows, none).collect()] == [(1, "(none)")]
    assert names.map_names(rows.limit(0), none).count() == 0


CONFIG = "config_id int, strategy string, fixed_size int, fixed_overlap int, sentence_window_overlap int, is_default boolean, size int"


def test_pieces_fit_cover_and_overlap(spark):
    rng = random.Random(5)
    marks = ["a", "b", "é", "漢", "ก", "้", " ", " ", ". ", "! ", "\n\n", ", ", "。", "”", "𝄞"]
    texts = ["", None, "x" * 30_000, "no end " * 3] + ["".join(rng.choice(marks) for _ in range(rng.randint(0, 400))) for _ in range(60)]
    kinds = [1, 2, 3, None, 99]
    rows = spark.createDataFrame([(f"c{i}", kinds[i % 5], t, 0) for i, t in enumerate(texts)], "chunk_id string, config_id int, text string, size int")
    listed = [(1, "fixed", 60, 9, 1, True, 0), (2, "sentence_window", 50, 9, 2, False, 0), (3, "fixed", 20, 50, None, None, 0), (None, "fixed", 5, 1, 1, False, 0)]
    configs = spark.createDataFrame(listed, CONFIG)
    by = {}
    for r in pieces.pieces(rows, configs).collect():
        by.setdefault(r["chunk_id"], []).append(r)
    for i, t in enumerate(texts):
        found = sorted(by.get(f"c{i}", []), key=lambda r: r["piece_pos"])
        if not t:
            assert not found
            continue
        k = kinds[i % 5] if kinds[i % 5] in (1, 2, 3) else 1
        size, overlap = {1: (60, 9), 2: (50, None), 3: (20, 19)}[k]
        assert found[0]["char_start"] == 0 and found[-1]["char_end"] == len(t)
        assert (len(found) > 1) == (len(t) > size)
        for r in found:
            assert t[r["char_start"] : r["char_end"]] == r["piece"] and 0 < len(r["piece"]) <= size
        for a, b in zip(found, found[1:]):
            shared = a["char_end"] - b["char_start"]
            assert 0 < shared and a["char_end"] < b["char_end"] and a["char_start"] <= b["char_start"]
            if overlap is not None:
                assert shared == min(overlap, a["char_end"])
    assert pieces.pieces(rows.limit(0), configs).count() == 0
    with pytest.raises(ValueError):
        pieces.pieces(rows, configs.limit(0))


def test_pieces_cut_at_the_strongest_boundary(spark):
    configs = spark.createDataFrame([(1, "fixed", 40, 0, 0, True, 0), (2, "sentence_window", 40, 0, 1, False, 0)], CONFIG)
    text = "First one here.\n\nNext one. Third is, well, longer than that."
    rows = spark.createDataFrame([("f", 1, text), ("w", 2, "One two. Three four. Five six. Seven eight. Nine.")], "chunk_id string, config_id int, text string")
    by = {}
    for r in pieces.pieces(rows, configs).orderBy("piece_pos").collect():
        by.setdefault(r["chunk_id"], []).append(r["piece"])
    assert by["f"] == ["First one here.\n\nNext one. ", "Third is, well, longer than that."]
    assert by["w"] == ["One two. Three four. Five six. ", "Five six. Seven eight. Nine."]


def test_sentences_within_the_size_stay_whole(spark):
    configs = spark.createDataFrame([(1, "sentence_window", 40, 0, 1, True, 0), (2, "sentence_window", 40, 0, 2, False, 0)], CONFIG)
    texts = {
        "a": (1, "One two. Three four five six seven eight. Nine. Ten eleven twelve thirteen."),
        "b": (2, "One is not two. Three is not four. Five is not six. Seven."),
        "c": (1, "甲" * 29 + "。" + "乙" * 29 + "。"), "d": (1, "One. " + "x" * 38 + ". Two."),
    }
    rows = spark.createDataFrame([(k, c, t) for k, (c, t) in texts.items()], "chunk_id string, config_id int, text string")
    by = {}
    for r in pieces.pieces(rows, configs).orderBy("piece_pos").collect():
        by.setdefault(r["chunk_id"], []).append(r["piece"])
    assert by["a"] == ["One two. ", "two. Three four five six seven eight. ", "Three four five six seven eight. Nine. ", "Nine. Ten eleven twelve thirteen."]
    assert by["b"] == ["One is not two. Three is not four. ", "Three is not four. Five is not six. ", "Five is not six. Seven."]
    assert by["c"] == ["甲" * 29 + "。", "甲" * 9 + "。" + "乙" * 29 + "。"]
    assert by["d"] == ["One. ", "x" * 38 + ". ", "x" * 34 + ". Two."]


def test_trie_counts():
    rng = random.Random(6)
    keys = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 6))).encode() for _ in range(400)]
    trie = copies.Trie()
    for i, k in enumerate(keys):
        trie.add(k, 2, i)
    want = sorted((k, 2 * keys.count(k), keys.index(k)) for k in set(keys))
    assert list(trie.items()) == want and trie.keys == len(want)


def entity_rows(rng, n):
    pool = ["Ann Lee", "LEE, ann", "Ann  Lee'", "ann-lee", "Bo", "bo!", "Straße", "STRASSE", "", " ", None, "?", "—", "Ann Lee Lee"]
    return [(i, rng.choice(["f", "f", "g", None]), "Ann Lee" if rng.random() < 0.3 else rng.choice(pool), "x") for i in range(n)]


@pytest.mark.parametrize("limit", [3, 100_000])
def test_copies_match_brute_force(spark, limit):
    rng = random.Random(7)
    e = entity_rows(rng, 200)
    r = [(i, f, n, e[(i * 7) % 200][2], "x") for i, f, n, _ in e]
    records = copies.canonical(
        spark.createDataFrame(e, "row_id long, file_id string, name string, record string"),
        spark.createDataFrame(r, "row_id long, file_id string, source string, target string, copies string"),
    )
    groups = {}
    for i, f, n, _ in e:
        if f and n and n.strip():
            groups.setdefault(("entities", f, tuple(sorted(fold_words(n)))), []).append(i)
    for i, f, a, b, _ in r:
        if f and a and b and a.strip() and b.strip():
            groups.setdefault(("relations", f, tuple(sorted([tuple(sorted(fold_words(a))), tuple(sorted(fold_words(b)))]))), []).append(i)
    counted = copies.collapse(records, limit, 1)
    assert sorted((x["first_id"], x["copies"]) for x in counted.collect()) == sorted((min(g), len(g)) for g in groups.values())
    got = {tuple(x) for x in copies.copy_rows(records, counted).collect()}
    assert got == {(k[0], min(g), i) for k, g in groups.items() for i in g if i != min(g)}


def test_copies_on_empty_tables(spark):
    e = spark.createDataFrame([], "row_id long, file_id string, name string")
    r = spark.createDataFrame([], "row_id long, file_id string, source string, target string")
    records = copies.canonical(e, r)
    assert copies.copy_rows(records, copies.collapse(records)).count() == 0


def test_very_long_names(spark):
    long = "word " * 40_000
    e = spark.createDataFrame([(1, "f", long), (2, "f", long.upper())], "row_id long, file_id string, name string")
    records = copies.canonical(e, spark.createDataFrame([], "row_id long, file_id string, source string, target string"))
    assert [tuple(x) for x in copies.copy_rows(records, copies.collapse(records, 1, 3000)).collect()] == [("entities", 1, 2)]


def test_long_runs_are_not_cut_where_a_boundary_comes_before_them(spark):
    configs = spark.createDataFrame([(1, "fixed", 40, 0, 0, True, 0)], CONFIG)
    texts = {"a": "Short one. " + "x" * 35 + " and more.", "b": "Ab, cd " + "x" * 38, "c": "y" * 50}
    rows = spark.createDataFrame([(k, 1, t) for k, t in texts.items()], "chunk_id string, config_id int, text string")
    by = {}
    for r in pieces.pieces(rows, configs).orderBy("piece_pos").collect():
        by.setdefault(r["chunk_id"], []).append(r["piece"])
    assert by == {"a": ["Short one. ", "x" * 35 + " and ", "more."], "b": ["Ab, ", "cd ", "x" * 38], "c": ["y" * 40, "y" * 10]}
