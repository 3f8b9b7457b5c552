import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.config import ChunkConfig, fingerprint, parse_modes
from graphloom.functions.sentences import sentence_spans, split_sentences
from graphloom.functions.vectors import letter_frequencies
from graphloom.operators import chunking as C

QUICK = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
TEXT = st.text(alphabet="ab.!? \n", max_size=80)


def docs(spark, texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "file_id string, text string")


def chunks(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["pos"]):
        out.setdefault(r["file_id"], []).append(r["text"])
    return out


def plain_sentences(t):
    return [s.strip() for s in re.split(r"(?<=[.!?])\s+", t) if s.strip()]


def plain_windows(s, w, o):
    if len(s) <= w:
        return [" ".join(s)] if s else []
    starts = list(range(0, len(s) - w + 1, w - o))
    if starts[-1] != len(s) - w:
        starts.append(len(s) - w)
    return [" ".join(s[a : a + w]) for a in starts]


def test_fixed_examples(spark):
    got = chunks(C.chunk(docs(spark, ["abcdefghij", "", None]), ChunkConfig(fixed_size=4, fixed_overlap=1)))
    assert got == {"0": ["abcd", "defg", "ghij", "j"]}


@QUICK
@given(st.lists(TEXT, min_size=1, max_size=8), st.integers(1, 9), st.data())
def test_fixed_and_windows_match_python(spark, texts, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    got = chunks(C.chunk(docs(spark, texts), ChunkConfig(fixed_size=size, fixed_overlap=overlap)))
    want = {str(i): [t[a : a + size] for a in range(0, len(t), size - overlap)] for i, t in enumerate(texts) if t}
    assert got == want
    config = ChunkConfig(strategy="sentence_window", window_size=size, window_overlap=overlap)
    got = chunks(C.chunk(docs(spark, texts), config))
    want = {str(i): w for i, t in enumerate(texts) if (w := plain_windows(plain_sentences(t), size, overlap))}
    assert got == want


@QUICK
@given(st.lists(TEXT, min_size=1, max_size=8))
def test_sentences_and_offsets(spark, texts):
    rows = docs(spark, texts).select("file_id", split_sentences(F.col("text")).alias("s"), sentence_spans(F.col("text")).alias("o")).collect()
    for r in rows:
        t = texts[int(r["file_id"])]
        assert list(r["s"]) == plain_sentences(t)
        assert [o["sentence"] for o in r["o"]] == plain_sentences(t)
        assert all(t[o["start"] : o["end"]] == o["sentence"] for o in r["o"])


def plain_semantic(s, least, most, p):
    n = len(s)
    if n <= most:
        return [" ".join(s)] if s else []
    ctx = [" ".join(s[max(0, i - 1) : i + 2]) for i in range(n)]
    e = [[c.lower().count(chr(97 + k)) for k in range(26)] for c in ctx]

    def cos(a, b):
        na, nb = sum(x * x for x in a) ** 0.5, sum(x * x for x in b) ** 0.5
        return 0.0 if na == 0 or nb == 0 else sum(x * y for x, y in zip(a, b, strict=True)) / (na * nb)

    d = [1.0 - cos(e[i], e[i + 1]) for i in range(n - 1)]
    o = sorted(d)
    rank = (len(o) - 1) * p / 100
    lo, w = int(rank), rank - int(rank)
    t = o[lo] * (1 - w) + o[min(lo + 1, len(o) - 1)] * w
    ends, start = [], 0
    for i in range(n - 1):
        c = i - start + 1
        if (c >= least and d[i] >= t) or c >= most:
            ends.append(i)
            start = i + 1
    if ends and n - start < least:
        ends[-1] = n - 1
    else:
        ends.append(n - 1)
    return [" ".join(s[(ends[k - 1] + 1 if k else 0) : x + 1]) for k, x in enumerate(ends)]


def test_semantic_matches_python(spark):
    import random

    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcxyz ") for _ in range(6)).strip() + "." for _ in range(rng.randint(0, 40))) for _ in range(30)]
    config = ChunkConfig(strategy="semantic", min_sentences=3, max_sentences=7, percentile=80)
    got = chunks(C.chunk(docs(spark, texts), config, letter_frequencies))
    want = {str(i): w for i, t in enumerate(texts) if (w := plain_semantic(plain_sentences(t), 3, 7, 80))}
    assert got == want


def test_percentile(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0, 8.0],), ([],)], "v array<double>")
    assert [round(r[0], 9) for r in df.select(C.percentile(F.col("v"), 90)).collect()] == [6.8, 0.0]


@pytest.mark.parametrize(
    "bad",
    [
        {"fixed_size": 0}, {"fixed_overlap": -1}, {"fixed_size": 5, "fixed_overlap": 5}, {"window_size": 2, "window_overlap": 2},
        {"percentile": 101}, {"min_sentences": 0}, {"min_sentences": 9, "max_sentences": 8}, {"buffer": -1}, {"strategy": "other"},
    ],
)
def test_bad_settings(bad):
    with pytest.raises(ValueError):
        ChunkConfig(**bad)


def test_dispatch_and_modes(spark):
    with pytest.raises(ValueError):
        C.chunk(docs(spark, ["a"]), ChunkConfig(strategy="semantic"))
    assert parse_modes(" naive, ,hybrid,naive") == ["naive", "hybrid", "naive"]
    with pytest.raises(ValueError):
        parse_modes("naive,other")
    assert fingerprint(ChunkConfig()) != fingerprint(ChunkConfig(fixed_size=100, fixed_overlap=1))
