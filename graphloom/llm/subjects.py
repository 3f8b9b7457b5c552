"""Subject areas of documents.

The model is an average of word and subword embeddings with one independent logistic output per subject. It is
trained on sentences of labelled documents, in rounds: every partition sums the gradients of its rows, the
sums are added up, and one step is taken with them, so the outcome does not depend on the partitioning. Every
sentence of every document is then scored, and a document is about the subjects that a substantial part of
its sentences is about.

A sentence takes over the labels of its document. Words that occur with any subject then earn no weight, wrong
labels average out, and rounds end before single documents are learnt by heart (``ROUNDS``). A sentence is
about a subject when its output is more than half-way from the subject's rate among training sentences to
certainty; a document, when at least ``SHARE`` of its sentences are and
there are two of them, or half of them are.

Training takes at most ``LABELLED`` labelled documents, chosen by a hash of doc_id. Held-out agreement is given in the
README.

Defined cases: null, empty and wordless texts have no subject; labels are compared without case and outer
blanks, and those not on the list (or null) are ignored; repeated labels of a document count once; labels of
unknown documents are ignored; without usable labels no document gets a subject; a doc_id that occurs with
several texts gets the subjects of each; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.sentences import sentence_spans
from graphloom.session import cut

#: Buckets that words and subwords are hashed to, and the width of an embedding.
BUCKETS = 1 << 16
WIDTH = 16

# A word: letters and digits with the marks that belong to them. Scripts without spaces give long runs.
_WORD = re.compile(r"[^\W_](?:[^\W_]|[̀-ͯऀ-ॿ฀-๿])*")
_RUN = re.compile("[฀-๿຀-໿ក-៿က-႟぀-ヿ㐀-䶿一-鿿豈-﫿]")


def features(word: str) -> list[int]:
    """Buckets of a word: itself and its character 3- to 5-grams with its ends marked; of a run in a script
    without spaces, its 2- to 4-grams."""
    run = bool(_RUN.search(word))
    text = word if run else f"<{word}>"
    low, high = (2, 4) if run else (3, 5)
    grams = [text[i : i + n] for n in range(low, high + 1) for i in range(len(text) - n + 1)]
    if not run or not grams:
        grams.append(text)
    return [zlib.crc32(g.encode()) % BUCKETS for g in grams]


def words(text: str) -> list[str]:
    return _WORD.findall(text.casefold())


def units(text: str | None) -> list[list[str]]:
    """The words of each sentence unit that has any."""
    return [w for w in (words(text[a:b]) for a, b in sentence_spans(text)) if w]


@dataclass
class Params:
    """Embeddings (BUCKETS, WIDTH), outputs (WIDTH, subjects), biases, and the subjects' rates in training."""

    embed: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    rates: np.ndarray

    @classmethod
    def start(cls, subjects: int, seed: int = 3) -> Params:
        rng = np.random.default_rng(seed)
        return cls(
            rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32),
            rng.normal(0, 0.3, (WIDTH, subjects)).astype(np.float32),
            np.full(subjects, -2.0, dtype=np.float32),
            np.zeros(subjects, dtype=np.float32),
        )

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, self.out, self.bias]


class Adam:
    """Steps whose size follows the running moments of the gradients."""

    def __init__(self, params: Params, rate: float) -> None:
        self.rate, self.round = rate, 0
        self.first = [np.zeros_like(p) for p in params.arrays()]
        self.second = [np.zeros_like(p) for p in params.arrays()]

    def step(self, params: Params, gradients: list[np.ndarray]) -> None:
        self.round += 1
        for p, g, m, v in zip(params.arrays(), gradients, self.first, self.second, strict=True):
            m += 0.1 * (g - m)
            v += 0.02 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.round)) / (np.sqrt(v / (1 - 0.98**self.round)) + 1e-8)


def _offsets(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)


def pack(sentences: list[list[str]], labels: list[np.ndarray], weights: list[float]) -> dict[str, np.ndarray]:
    """Training rows as arrays: words are numbered, and a word's buckets are listed once. The way back, from sentences
    to words and from words to buckets, is sorted once: ``word_row`` has the sentences of every word in turn,
    ``gram_word`` the words of every bucket of ``gram_key``."""
    vocabulary: dict[str, int] = {}
    word = np.array([vocabulary.setdefault(w, len(vocabulary)) for s in sentences for w in s], dtype=np.int32)
    every = [features(w) for w in vocabulary]
    gram = np.array([g for gs in every for g in gs], dtype=np.int32)
    words = np.array([len(s) for s in sentences], dtype=np.int32)
    grams = np.array([len(g) for g in every], dtype=np.int32)
    key, count = np.unique(gram, return_counts=True)
    return {
        "word": word,
        "words": words,
        "gram": gram,
        "grams": grams,
        "word_row": np.repeat(np.arange(len(words), dtype=np.int32), words)[np.argsort(word, kind="stable")],
        "word_count": np.bincount(word, minlength=len(grams)).astype(np.int32),
        "gram_word": np.repeat(np.arange(len(grams), dtype=np.int32), grams)[np.argsort(gram, kind="stable")],
        "gram_key": key.astype(np.int32),
        "gram_count": count.astype(np.int32),
        "label": np.array(labels, dtype=np.float32),
        "weight": np.array(weights, dtype=np.float32),
    }


def _averages(embed: np.ndarray, p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    per_word = np.add.reduceat(embed[p["gram"]], _offsets(p["grams"]), axis=0)
    counts = np.add.reduceat(p["grams"][p["word"]], _offsets(p["words"])).astype(np.float32)
    return np.add.reduceat(per_word[p["word"]], _offsets(p["words"]), axis=0) / counts[:, None], counts


def logits(params: Params, p: dict[str, np.ndarray]) -> np.ndarray:
    return _averages(params.embed, p)[0] @ params.out + params.bias


def gradient(params: Params, p: dict[str, np.ndarray]) -> tuple[list[np.ndarray], float]:
    """Summed gradients of the weighted logistic losses of all rows, and the summed loss."""
    mean, counts = _averages(params.embed, p)
    z = mean @ params.out + params.bias
    prob = 1 / (1 + np.exp(-z))
    y, w = p["label"], p["weight"][:, None]
    loss = float((w * (np.logaddexp(0, z) - y * z)).sum())
    g = ((prob - y) * w).astype(np.float32)
    back = (g @ params.out.T) / counts[:, None]
    per_word = np.add.reduceat(back[p["word_row"]], _offsets(p["word_count"]), axis=0)
    per_gram = np.zeros((BUCKETS, WIDTH), dtype=np.float32)
    per_gram[p["gram_key"]] = np.add.reduceat(per_word[p["gram_word"]], _offsets(p["gram_count"]), axis=0)
    return [per_gram, mean.T @ g, g.sum(axis=0)], loss


#: Labelled documents that the model is fitted on, at most, and the words of one pack of their sentences.
LABELLED = 20_000
PACK_WORDS = 200_000
ROUNDS = 22
RATE = 0.1
SHARE = 0.18
#: Words whose scores a scoring task keeps at hand.
KNOWN_WORDS = 200_000

_FIELDS = ("word", "words", "gram", "grams", "word_row", "word_count", "gram_word", "gram_key", "gram_count", "label", "weight")
_PACKED = T.StructType([T.StructField(f, T.BinaryType()) for f in _FIELDS])
_SUMS = T.StructType(
    [
        T.StructField("slice", T.IntegerType()),
        T.StructField("sums", T.BinaryType()),
        T.StructField("rows", T.LongType()),
    ]
)
#: Slices in which the partitions' sums are added up, on the executors, before the driver sees them.
SLICES = 8


def training_rows(documents: DataFrame, labels: DataFrame, subjects: list[str], most: int = LABELLED) -> DataFrame:
    """(doc_id, text, subjects) of the labelled documents that are trained on. The labels' side is bounded by
    ``most``, so it is broadcast and the texts stay where they are."""
    known = {s.casefold().strip(): i for i, s in enumerate(subjects)}
    tag = F.lower(F.trim("subject"))
    number = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[tag] if known else F.lit(None).cast("int")
    usable = labels.where(F.col("doc_id").isNotNull()).select("doc_id", number.alias("number")).where(F.col("number").isNotNull())
    per_doc = usable.groupBy("doc_id").agg(F.collect_set("number").alias("subjects"))  # a set of listed subjects
    chosen = per_doc.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return documents.select("doc_id", "text").where(F.length("text") > 0).join(F.broadcast(chosen), "doc_id")


def _packer(subjects: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sentences, labels, size = [], [], 0

        def packed() -> pd.DataFrame:
            arrays = pack(sentences, labels, [1.0] * len(sentences))
            return pd.DataFrame({f: [arrays[f].tobytes()] for f in _FIELDS})

        for batch in batches:
            for text, numbers in zip(batch["text"], batch["subjects"], strict=True):
                label = np.zeros(subjects, dtype=np.float32)
                label[list(numbers)] = 1
                for unit in units(text):
                    sentences.append(unit)
                    labels.append(label)
                    size += len(unit)
                    if size >= PACK_WORDS:
                        yield packed()
                        sentences, labels, size = [], [], 0
        if sentences:
            yield packed()

    return run


def _unpacked(row: pd.Series, subjects: int) -> dict[str, np.ndarray]:
    kinds = {"label": np.float32, "weight": np.float32}
    out = {f: np.frombuffer(row[f], dtype=kinds.get(f, np.int32)) for f in _FIELDS}
    return out | {"label": out["label"].reshape(-1, subjects)}


def _summer(shared, subjects: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, rows = None, 0
        for batch in batches:
            for _, row in batch.iterrows():
                packed = _unpacked(row, subjects)
                grads = gradient(shared.value, packed)[0]
                flat = np.concatenate([*[g.ravel() for g in grads], packed["label"].sum(axis=0)])
                total = flat if total is None else total + flat
                rows += len(packed["words"])
        if total is not None:
            parts = np.array_split(total, SLICES)
            yield pd.DataFrame({"slice": range(SLICES), "sums": [p.tobytes() for p in parts], "rows": rows})

    return run


def _add_up(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(b, dtype=np.float32) for b in rows["sums"])
    return pd.DataFrame({"slice": rows["slice"].iloc[:1], "sums": [total.tobytes()], "rows": [rows["rows"].sum()]})


def train(rows: DataFrame, subjects: int, rounds: int = ROUNDS) -> Params | None:
    """The fitted model; None without training rows. A round brings one sum of the size of the model to the
    driver, whatever the data; the partitions' sums are added up before, slice by slice."""
    spark = rows.sparkSession
    packed = cut(rows.repartition(spark.sparkContext.defaultParallelism).mapInPandas(_packer(subjects), _PACKED))
    params = Params.start(subjects)
    adam = Adam(params, RATE)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(params)
        sums = packed.mapInPandas(_summer(shared, subjects), _SUMS).groupBy("slice").applyInPandas(_add_up, _SUMS).collect()
        if not sums:
            return None
        flat = np.concatenate([np.frombuffer(s["sums"], dtype=np.float32) for s in sorted(sums, key=lambda s: s["slice"])])
        del sums[1:]
        flat = flat / sums[0]["rows"]
        ends = np.cumsum([p.size for p in params.arrays()])[:-1]
        flat, params.rates = flat[:-subjects], flat[-subjects:]
        adam.step(params, [g.reshape(p.shape) for g, p in zip(np.split(flat, ends), params.arrays(), strict=True)])
        shared.destroy()
    return params


class Scorer:
    """Scores of sentences; the buckets' contributions to the outputs are multiplied out beforehand."""

    def __init__(self, params: Params) -> None:
        self.bucket = params.embed @ params.out
        self.bias = params.bias
        sure = (1 + params.rates.clip(0, 0.999)) / 2
        self.least = np.log(sure / (1 - sure))
        self.known: dict[str, int] = {}
        self.table = np.empty((1024, len(self.bias) + 1), dtype=np.float32)

    def _add(self, word: str) -> int:
        number = self.known[word] = len(self.known)
        if number == len(self.table):
            self.table = np.concatenate((self.table, np.empty_like(self.table)))
        grams = features(word)
        self.table[number, :-1] = self.bucket[grams].sum(axis=0)
        self.table[number, -1] = len(grams)
        return number

    def shares(self, text: str) -> tuple[np.ndarray, int]:
        """(sentences about each subject, sentences)."""
        sentences = units(text)
        if not sentences:
            return np.zeros(len(self.bias), dtype=np.int64), 0
        if len(self.known) > KNOWN_WORDS:
            self.known = {}
        get, add = self.known.get, self._add
        numbers = [n if (n := get(w)) is not None else add(w) for s in sentences for w in s]
        sums = np.add.reduceat(self.table[numbers], _offsets(np.array([len(s) for s in sentences])), axis=0)
        z = sums[:, :-1] / sums[:, -1:] + self.bias
        return (z > self.least).sum(axis=0), len(sentences)


def about(counts: np.ndarray, sentences: int) -> np.ndarray:
    """Numbers of the subjects that a document is about."""
    share = counts / max(sentences, 1)
    return np.flatnonzero(((share >= SHARE) & (counts >= 2)) | ((share >= 0.5) & (counts > 0)))


_SUBJECTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("subject", T.StringType()),
        T.StructField("about", T.LongType()),
        T.StructField("sentences", T.LongType()),
    ]
)


def score(documents: DataFrame, params: Params, subjects: list[str]) -> DataFrame:
    """(doc_id, subject, about, sentences) for every document and subject it is about; one narrow pass."""
    shared = documents.sparkSession.sparkContext.broadcast(params)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                counts, n = scorer.shares(text)
                rows.extend((doc_id, subjects[i], int(counts[i]), n) for i in about(counts, n))
            yield pd.DataFrame(rows, columns=_SUBJECTS.names)

    return documents.select("doc_id", "text").where(F.length("text") > 0).mapInPandas(run, _SUBJECTS)


def subject_areas(documents: DataFrame, labels: DataFrame, subject_list: DataFrame) -> DataFrame:
    """Train on the labelled documents and score all. The list of subjects names the outputs of the model, so
    it is read by the driver; it may have at most a thousand entries."""
    subjects = sorted({r["subject"] for r in subject_list.select("subject").distinct().limit(1001).collect() if r["subject"]})
    if len(subjects) > 1000:
        raise ValueError("more than 1000 subjects")
    params = train(training_rows(documents, labels, subjects), len(subjects)) if subjects else None
    if params is None:
        return documents.sparkSession.createDataFrame([], _SUBJECTS)
    return score(documents, params, subjects)
