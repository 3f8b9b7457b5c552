"""Evaluation passages that turn up in training documents.

Documents are gathered, task by task and without a shuffle, into shards of bounded size. Each shard gets an
FM-index over its words: suffix array by prefix doubling, Burrows-Wheeler transform, wavelet matrix for ranks,
and suffix positions sampled at every ``SAMPLE``-th word and at document starts. All windows of ``WORDS``
consecutive words of all items are searched backwards together; the rows that remain are located by walking to
a sampled position. Overlapping windows of one item are merged into removal spans.

Words are case-folded runs of letters and digits. For items in Chinese a window is ``SIGNS`` consecutive
letters or digits instead; a second index over single signs holds the documents with Han characters (or all,
should a Chinese item have a window without any).

The items are the stated query set. Their length is summed first, and they are broadcast, as numbers of words, in
blocks of about ``ITEM_CHARS``; a shard is indexed once, and every block is searched in it.

Defined cases: null or empty texts match nothing; an item shorter than a window cannot leak; copies of a
document and repeated items all count; a document longer than a shard is indexed in sections that share
window - 1 words, so nothing is lost; null ids are carried as null; extra columns are ignored; empty tables
give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORDS = 12
SIGNS = 20
#: Words (or signs) of one shard; its index takes some 100 bytes each.
SHARD_WORDS = 400_000
SAMPLE = 16
#: Characters of the items that are gathered and broadcast at once; their words take four bytes each in a task.
ITEM_CHARS = 20_000_000

_WORD = re.compile(r"[^\W_]+")
_SIGN = re.compile(r"[^\W_]")
_HAN = re.compile("[㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff]")
_KANA = re.compile("[぀-ヿ]")


def suffix_array(x: np.ndarray) -> np.ndarray:
    """Of a sequence whose suffixes all differ (every section ends with a symbol of its own). Groups of equal
    prefixes keep their slots while they are refined, so each round sorts only what is still undecided."""
    n = len(x)
    sa = np.argsort(x, kind="stable")
    ordered = x[sa]
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    rank = np.empty(n, dtype=np.int64)
    rank[sa] = np.repeat(starts, np.diff(np.append(starts, n)))
    slots = np.arange(n)
    step = 1
    while True:
        held = sa[slots]
        r = rank[held]
        same = r[1:] == r[:-1]
        open_ = np.concatenate((same, [False])) | np.concatenate(([False], same))
        slots, held, r = slots[open_], held[open_], r[open_]
        if not len(slots):
            return sa
        ahead = np.minimum(held + step, n)
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        order = np.lexsort((second, r))
        held, r, second = held[order], r[order], second[order]
        sa[slots] = held
        fresh = np.concatenate(([True], (r[1:] != r[:-1]) | (second[1:] != second[:-1])))
        heads = np.flatnonzero(fresh)
        rank[held] = np.repeat(slots[heads], np.diff(np.append(heads, len(slots))))
        step *= 2


class WaveletMatrix:
    """Ranks of symbols, one bit level at a time."""

    def __init__(self, symbols: np.ndarray, size: int) -> None:
        self.bits = max(1, int(size - 1).bit_length())
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        level = symbols
        for b in range(self.bits - 1, -1, -1):
            bit = (level >> b) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))).astype(np.int32))
            self.zeros.append(len(level) - int(self.ones[-1][-1]))
            level = np.concatenate((level[bit == 0], level[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of symbol before position at."""
        begin = np.zeros_like(at)
        for i, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            set_ = ((symbol >> (self.bits - 1 - i)) & 1).astype(bool)
            a, b = ones[at], ones[begin]
            at = np.where(set_, zeros + a, at - a)
            begin = np.where(set_, zeros + b, begin - b)
        return at - begin


class FMIndex:
    """Over sections of symbols numbered from 1; 0 stands for the end of a section."""

    def __init__(self, sections: list[np.ndarray], symbols: int) -> None:
        lengths = np.array([len(s) + 1 for s in sections], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        n, k = int(lengths.sum()), len(sections)
        text = np.zeros(n, dtype=np.int64)
        for s, at in zip(sections, self.starts, strict=True):
            text[at : at + len(s)] = s
        ends = self.starts + lengths - 1
        distinct = text + (k - 1)  # the ends become 0 .. k-1, below every symbol
        distinct[ends] = np.arange(k)
        sa = suffix_array(distinct)
        self.bwt = text[sa - 1]
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=symbols + 1))))[:-1]
        self.wavelet = WaveletMatrix(self.bwt, symbols + 1)
        chosen = sa % SAMPLE == 0
        first = np.zeros(n, dtype=bool)
        first[self.starts] = True
        chosen |= first[sa]
        self.chosen = chosen
        self.chosen_rank = np.cumsum(chosen) - 1
        self.positions = sa[chosen]
        self.rows = n

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, first row, row after the last) of the patterns that occur."""
        which = np.flatnonzero((patterns > 0).all(axis=1))
        low = np.zeros(len(which), dtype=np.int64)
        high = np.full(len(which), self.rows, dtype=np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[which, j]
            both = self.wavelet.rank(np.concatenate((symbol, symbol)), np.concatenate((low, high)))
            low = self.before[symbol] + both[: len(which)]
            high = self.before[symbol] + both[len(which) :]
            alive = low < high
            which, low, high = which[alive], low[alive], high[alive]
        return which, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The positions of suffix rows, by walking back to a sampled one."""
        out = np.empty(len(rows), dtype=np.int64)
        left, walked = np.arange(len(rows)), 0
        while len(left):
            done = self.chosen[rows]
            out[left[done]] = self.positions[self.chosen_rank[rows[done]]] + walked
            left, rows = left[~done], rows[~done]
            symbol = self.bwt[rows]
            rows = self.before[symbol] + self.wavelet.rank(symbol, rows)
            walked += 1
        return out


def tokens(text: str, signs: bool) -> list[str]:
    return [w.casefold() for w in (_SIGN if signs else _WORD).findall(text)]


def is_chinese(lang: str | None, text: str) -> bool:
    tag = re.split(r"[-_]", (lang or "").strip().casefold())[0]
    if tag in ("zh", "zho", "chi", "cmn"):
        return True
    return tag in ("", "und") and bool(_HAN.search(text)) and not _KANA.search(text)


@dataclass
class Items:
    """The items of one block and kind: the words they have, their numbers (from 1) item after item, and of every window
    its start and its item's id."""

    words: list[str]
    text: np.ndarray
    starts: np.ndarray
    ids: list
    size: int

    @classmethod
    def of(cls, items: list[tuple[int, str | None, str | None]], signs: bool) -> Items:
        size, known = SIGNS if signs else WORDS, {}
        text: list[int] = []
        starts: list[int] = []
        ids: list = []
        for item_id, lang, body in items:
            if body and is_chinese(lang, body) == signs:
                found = [known.setdefault(w, len(known) + 1) for w in tokens(body, signs)]
                many = max(0, len(found) - size + 1)
                starts.extend(range(len(text), len(text) + many))
                ids.extend([item_id] * many)
                if many:
                    text.extend(found)
        return cls(list(known), np.array(text, dtype=np.int32), np.array(starts, dtype=np.int64), ids, size)

    def patterns(self, numbers: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """(window, its words by ``numbers``) of the windows whose words all have one."""
        get = numbers.get
        own = np.array([0, *[get(w, 0) for w in self.words]], dtype=np.int64)[self.text]
        lacking = np.concatenate(([0], np.cumsum(own == 0)))
        kept = np.flatnonzero(lacking[self.starts + self.size] == lacking[self.starts])
        return kept, own[self.starts[kept][:, None] + np.arange(self.size)]

    @property
    def without_han(self) -> bool:
        """Whether some window has no Han character."""
        han = np.array([0, *[bool(_HAN.search(w)) for w in self.words]], dtype=np.int64)[self.text]
        total = np.concatenate(([0], np.cumsum(han)))
        return bool((total[self.starts + self.size] == total[self.starts]).any())


class _Shard:
    """Documents of one index, up to ``limit`` words."""

    def __init__(self, wanted: list[Items], signs: bool, limit: int) -> None:
        self.signs, self.size, self.limit = signs, SIGNS if signs else WORDS, limit
        self.wanted = [items for items in wanted if len(items.starts)]
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.sections: list[np.ndarray] = []
        self.origin: list[tuple[int, int]] = []  # document, its first word
        self.docs: list[tuple[int, str]] = []
        self.words = 0

    def add(self, doc_id: int, text: str) -> Iterator[tuple[int, int, int, int]]:
        found = tokens(text, self.signs)
        if len(found) < self.size:
            return
        if self.words and self.words + len(found) > self.limit:
            yield from self.flush()
        held = (doc_id, text)
        for at in range(0, len(found) - self.size + 1, self.limit - self.size + 1):
            part = found[at : at + self.limit]
            ids = self.ids
            numbers = np.array([ids.setdefault(w, len(ids) + 1) for w in part], dtype=np.int64)
            if not self.docs or self.docs[-1] is not held:
                self.docs.append(held)
            self.origin.append((len(self.docs) - 1, at))
            self.sections.append(numbers)
            self.words += len(part)
            if self.words >= self.limit:
                yield from self.flush()

    def flush(self) -> Iterator[tuple[int, int, int, int]]:
        """(document, item, char start, char end), merged; the shard is empty afterwards."""
        index = None
        for items in self.wanted if self.sections else []:
            # A window with a word that the shard lacks cannot occur: only the others are searched.
            windows, patterns = items.patterns(self.ids)
            if len(windows):
                index = index or FMIndex(self.sections, len(self.ids))
                yield from self._search(index, items, windows, patterns)
        self.clear()

    def _search(self, index: FMIndex, items: Items, windows: np.ndarray, patterns: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        which, low, high = index.search(patterns)
        if not len(which):
            return
        counts = high - low
        owner = np.repeat(windows[which], counts)
        offset = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        at = index.locate(np.repeat(low, counts) + offset)
        section = np.searchsorted(index.starts, at, side="right") - 1
        hits: dict[tuple[int, int], list[int]] = {}
        for o, s, p in zip(owner.tolist(), section.tolist(), at.tolist(), strict=True):
            doc, begin = self.origin[s]
            word = begin + p - int(index.starts[s])
            hits.setdefault((doc, items.ids[o]), []).append(word)
        spots: dict[int, list[tuple[int, int]]] = {}
        pattern = _SIGN if self.signs else _WORD
        for (doc, item), begins in hits.items():
            doc_id, text = self.docs[doc]
            if doc not in spots:
                spots[doc] = [m.span() for m in pattern.finditer(text)]
            span = spots[doc]
            begins = sorted(set(begins))
            first = last = begins[0]
            for b in begins[1:] + [None]:
                if b is None or b > last + self.size:
                    yield doc_id, item, span[first][0], span[last + self.size - 1][1]
                    first = b
                last = b


SPANS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("char_start", T.IntegerType()),
        T.StructField("char_end", T.IntegerType()),
    ]
)


def _searcher(blocks: list, limit: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = [shared.value for shared in blocks]
        by_word, by_sign = _Shard([b[0] for b in both], False, limit), _Shard([b[1] for b in both], True, limit)
        all_signs = any(items.without_han for items in by_sign.wanted)
        for batch in batches:
            rows: list[tuple[int, int, int, int]] = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                if by_word.wanted:
                    rows.extend(by_word.add(doc_id, text))
                if by_sign.wanted and (all_signs or _HAN.search(text)):
                    rows.extend(by_sign.add(doc_id, text))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "char_start", "char_end"])
        yield pd.DataFrame([*by_word.flush(), *by_sign.flush()], columns=["doc_id", "item_id", "char_start", "char_end"])

    return run


def leaks(documents: DataFrame, items: DataFrame, shard_words: int = SHARD_WORDS, item_chars: int = ITEM_CHARS) -> DataFrame:
    """(doc_id, item_id, char_start, char_end): the spans of documents that repeat an item. One pass over the documents."""
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text").where(F.length("text") > 0)
    items = items.select("item_id", "lang", "text").where(F.length("text") > 0)
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = max(1, -(-chars // item_chars))
    blocks = []
    for block in range(count):
        part = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == block).collect()]
        blocks.append(spark.sparkContext.broadcast((Items.of(part, False), Items.of(part, True))))
    return docs.mapInPandas(_searcher(blocks, shard_words), SPANS)


def removals(spans: DataFrame) -> DataFrame:
    """The union of all items' spans in a document, as spans that do not touch."""
    order = Window.partitionBy("doc_id").orderBy("char_start", "char_end")
    reach = F.max("char_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.select("doc_id", "char_start", "char_end").distinct()
    marked = marked.withColumn("fresh", F.coalesce((F.col("char_start") > reach).cast("int"), F.lit(1)))
    marked = marked.withColumn("run", F.sum("fresh").over(order))
    return marked.groupBy("doc_id", "run").agg(F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end")).drop("run")
