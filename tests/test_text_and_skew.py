import random

from pyspark.sql import functions as F

from graphloom.functions.text import alike_key, casefold, collapse_space, fold_words, is_blank
from graphloom.operators.skew import lookup


def test_alike_key_and_folding_match_python(spark):
    rng = random.Random(1)
    letters = "aAbB zZ'’-_.\t é ß Σς İ ﬁ 漢字 ที่ x9 "
    names = ["", " ", None, "Straße", "STRASSE", "d'Été", "O’Neil, Ann", "a a b", "—"]
    names += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(300)]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    got = rows.select("i", alike_key(F.col("n")).alias("k"), casefold(F.col("n")).alias("f")).collect()
    for r in got:
        n = names[r["i"]]
        assert r["k"] == (None if n is None else " ".join(sorted(fold_words(n)))), repr(n)
        assert r["f"] == (None if n is None else n.casefold()), repr(n)


def test_blank_and_space(spark):
    nbsp, wide = chr(0xA0), chr(0x3000)
    rows = spark.createDataFrame([(None,), ("",), (f" \t{nbsp}{wide}\n",), (f" a{nbsp} b ",)], "t string")
    got = rows.select(is_blank(F.col("t")).alias("b"), collapse_space(F.col("t")).alias("c")).collect()
    assert [r["b"] for r in got] == [True, True, True, False]
    assert [r["c"] for r in got] == [None, "", "", "a b"]


def test_lookup_under_skew(spark):
    keys = ["hot"] * 500 + [f"k{i % 7}" for i in range(60)] + [None] * 20 + ["absent"] * 5
    rows = spark.createDataFrame([(i, k, "x") for i, k in enumerate(keys)], "row_id long, key string, v2 string")
    table = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i + 10) for i in range(7)] + [(None, 99)], "key string, v int")
    for hot in (1, 1024):
        got = lookup(rows, table, ["key"], ["v"], F.col("row_id"), hot_keys=hot).collect()
        assert len(got) == len(keys)
        want = {"hot": 1, **{f"k{i}": i + 10 for i in range(7)}}
        assert all(r["v"] == want.get(r["key"]) for r in got)


def test_lookup_on_empty_tables(spark):
    rows = spark.createDataFrame([], "row_id long, key string")
    table = spark.createDataFrame([], "key string, v int")
    assert lookup(rows, table, ["key"], ["v"], F.col("row_id")).count() == 0
    one = spark.createDataFrame([(1, "a")], "row_id long, key string")
    assert lookup(one, table, ["key"], ["v"], F.col("row_id")).collect()[0]["v"] is None
