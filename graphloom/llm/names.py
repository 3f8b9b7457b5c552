"""Mapping freely entered names to a reference list.

Every reference entry (listed names, and aliases that lead to one) is put into BK-trees, one for each length, under
the unrestricted Damerau-Levenshtein distance, which is a true metric, so the triangle inequality may prune. The
entries are cut into shards of bounded size, whose trees are built once; each distinct entered name probes every shard,
each shard returns every entry within the threshold, and the nearest entry of all shards wins. Names that have the
words of an entry in any order are found by the same trees, with the words sorted, at distance 0.

An entered name is compared in normal form: full case folding, accents and apostrophes dropped, words of
letters and digits, titles and bracketed notes set aside. Its rotations stand for "Surname, First" and the
like. Words that carry no name (the, of, ...) are compared both with and without. A shortened first name
("F. Surname", "Fer. Surname") matches when exactly one listed name goes with it.

Rules that decide: the same words win, then the same words but for notes and titles, then the nearer; at equal
distance between entries of different names there is no match; the threshold is 2 edits, but 1 for forms of under 9
characters and 0 under 5.

Defined cases: blank names (null, white space) get no row; names without letters or digits are reported as
``(none)``, and so are names too long for any entry to be within the threshold; an alias
whose target is not listed is ignored; an alias with several targets takes the smallest; empty tables give
empty results, an empty list gives ``(none)`` for all; extra columns are ignored.
"""

from __future__ import annotations

import pickle
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.text import fold_words, is_blank
from graphloom.operators.skew import lookup
from graphloom.session import cut, task_count

NONE = "(none)"
#: Entries of one shard. A reference list within it is one shard; a longer one becomes several.
SHARD_ENTRIES = 20_000
THRESHOLD = 2
#: Forms that walk the trees together, and forms times entries of one walk; both bound its memory.
BLOCK = 4096
BLOCK_CELLS = 8_000_000
#: Pairs that are measured at once.
PAIRS = 4096
#: Names that meet a shard at once.
BLOCK_NAMES = 20_000

# Words set aside before comparing.
TITLES = {
    "mr", "mrs", "ms", "miss", "dr", "prof", "professor", "sir", "dame", "lady", "lord", "old", "rev", "capt",
    "captain", "st", "hon", "messrs", "monsieur", "madame", "mme", "mlle", "herr", "frau", "sr", "sra", "don",
}
FILLERS = {"the", "of", "a", "an", "and", "de", "la", "le", "der", "die", "das"}

_BRACKETS = {"(": ")", "[": "]", "{": "}", "（": "）", "【": "】"}


def without_notes(name: str) -> str:
    """``name`` without bracketed parts, unless nothing else has a letter or digit."""
    out, closing = [], []
    for ch in name:
        if closing:
            if ch == closing[-1]:
                closing.pop()
            elif ch in _BRACKETS:
                closing.append(_BRACKETS[ch])
        elif ch in _BRACKETS:
            closing.append(_BRACKETS[ch])
            out.append(" ")
        else:
            out.append(ch)
    left = "".join(out)
    return left if any(c.isalnum() for c in left) else name


def words(name: str) -> list[str]:
    """Words in normal form. ``ß`` and ``ss`` become one letter, as one slip may hit either."""
    plain = unicodedata.normalize("NFKD", name)
    plain = "".join(c for c in plain if not unicodedata.combining(c))
    return [w.replace("ss", "ß") for w in fold_words(plain)]


def _letters(forms: list[str], code: Callable[[str], int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lengths, row of each letter, code of each letter) of all forms, one after the other."""
    lengths = np.array([len(f) for f in forms], dtype=np.int64)
    points = np.frombuffer("".join(forms).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds, which = np.unique(points, return_inverse=True)
    return lengths, np.repeat(np.arange(len(forms)), lengths), np.array([code(chr(k)) for k in kinds], dtype=np.int64)[which]


def encoded(forms: list[str], alphabet: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, lengths): one row of letter codes per form, 0 beyond its end; letters outside share the last code."""
    lengths, rows, flat = _letters(forms, lambda c: alphabet.get(c, len(alphabet) + 1))
    codes = np.zeros((len(forms), int(lengths.max(initial=0))), dtype=np.int64)
    codes[rows, np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return codes, lengths


def alphabet_of(forms: list[str]) -> dict[str, int]:
    return {c: i for i, c in enumerate(sorted(set("".join(forms))), 1)}


def distances(a: np.ndarray, a_len: np.ndarray, b: np.ndarray, b_len: np.ndarray, letters: int) -> np.ndarray:
    """Unrestricted Damerau-Levenshtein distances (insert, delete, substitute, transpose; a metric) of many pairs at
    once: row i of ``a`` and row i of ``b``, as ``encoded`` gives them. ``letters`` is over every code."""
    out = np.empty(len(a), dtype=np.int64)
    order = np.lexsort((a_len, b_len))
    for start in range(0, len(order), PAIRS):
        part = order[start : start + PAIRS]
        n, m = int(a_len[part].max()), int(b_len[part].max())
        k, at = len(part), np.arange(len(part))
        left = np.ascontiguousarray(a[part, :n].T)
        right = np.ascontiguousarray(b[part, :m].T)
        spots = right * k + at
        d = np.full((n + 2, m + 2, k), n + m, dtype=np.int16)
        d[1:, 1] = np.arange(n + 1, dtype=np.int16)[:, None]
        d[1, 1:] = np.arange(m + 1, dtype=np.int16)[:, None]
        flat = d.reshape(-1)
        last = np.zeros(letters * k, dtype=np.int64)  # the last row of each letter and pair; zero while there is none
        for i in range(1, n + 1):
            code = left[i - 1]
            match = np.zeros(k, dtype=np.int64)
            for j in range(1, m + 1):
                same = right[j - 1] == code
                best = np.minimum(d[i + 1, j], d[i, j + 1])
                best += 1
                np.minimum(best, d[i, j] + ~same, out=best)
                row = last[spots[j - 1]]
                swap = flat[(row * (m + 2) + match) * k + at] + (i + j - 1 - row - match)
                np.minimum(best, swap, out=d[i + 1, j + 1], casting="unsafe")
                match[same] = j
            last[code * k + at] = i
        out[part] = d[a_len[part] + 1, b_len[part] + 1, at]
    return out


_LETTERS = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789ß ")}
_REPEATS = 6


def letter_bags(forms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter counts in unary, so that a product of rows counts the common letters; and for each form the
    letters beyond what is counted so. Letters that are not listed share one place."""
    kinds = len(_LETTERS) + 1
    _, rows, flat = _letters(forms, lambda c: _LETTERS.get(c, kinds - 1))
    counts = np.bincount(rows * kinds + flat, minlength=len(forms) * kinds).reshape(len(forms), kinds)
    unary = counts[:, :, None] > np.arange(_REPEATS)
    return unary.reshape(len(forms), kinds * _REPEATS).astype(np.float32), np.maximum(counts - _REPEATS, 0).sum(axis=1)


class BKTree:
    """Entries by their distances, a tree for each length: every entry below edge e of a node is at distance e from
    the node. Nodes are numbered in preorder, shorter trees first, so a subtree is a range."""

    def __init__(self, entries: list[tuple[str, str]]) -> None:
        held: dict[str, set[str]] = {}
        for form, name in entries:
            held.setdefault(form, set()).add(name)
        forms = list(held)
        self.alphabet = alphabet_of(forms)
        codes, lengths = encoded(forms, self.alphabet)
        below: list[list[tuple[int, int]]] = [[] for _ in forms]
        heads: dict[int, int] = {}
        for i, n in enumerate(lengths.tolist()):
            heads.setdefault(n, i)
        members = np.array([i for i, n in enumerate(lengths.tolist()) if heads[n] != i], dtype=np.int64)
        above = np.array([heads[int(lengths[i])] for i in members], dtype=np.int64)
        while len(members):  # one level of all trees at a time
            far = distances(codes[members], lengths[members], codes[above], lengths[above], len(self.alphabet) + 2)
            order = np.lexsort((members, far, above))
            members, above, far = members[order], above[order], far[order]
            first = np.concatenate(([True], (above[1:] != above[:-1]) | (far[1:] != far[:-1])))
            for node, edge, child in zip(above[first].tolist(), far[first].tolist(), members[first].tolist(), strict=True):
                below[node].append((edge, child))
            head = members[first][np.cumsum(first) - 1]
            members, above = members[~first], head[~first]
        order: list[int] = []
        number, after = [0] * len(forms), [0] * len(forms)
        for n in sorted(heads):
            stack = [(heads[n], False)]
            while stack:
                node, left = stack.pop()
                if left:
                    after[node] = len(order)
                    continue
                number[node] = len(order)
                order.append(node)
                stack.append((node, True))
                stack.extend((child, False) for _, child in below[node])
        self.roots = np.array([number[heads[n]] for n in sorted(heads)], dtype=np.int64)
        self.forms = [forms[i] for i in order]
        self.names = [sorted(held[f]) for f in self.forms]
        self.codes, self.sizes = codes[order], lengths[order]
        self.after = np.array([after[i] for i in order], dtype=np.int64)
        counts = np.array([len(below[i]) for i in order], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(counts)))
        self.edges = np.array([e for i in order for e, _ in below[i]], dtype=np.int64)
        self.children = np.array([number[c] for i in order for _, c in below[i]], dtype=np.int64)
        self.bags, self.spare = letter_bags(self.forms)

    def _possible(self, forms: list[str], limit: np.ndarray, low: int, high: int) -> np.ndarray:
        """For each form, how many of the entries from ``low`` on, before each place up to ``high``, it may be near. An
        edit changes at most one letter, so the larger length less the common letters bounds the distance from below."""
        bags, spare = letter_bags(forms)
        common = bags @ self.bags[low:high].T + np.minimum(spare[:, None], self.spare[None, low:high])
        sizes = np.array([len(f) for f in forms], dtype=np.int64)
        near = np.maximum(sizes[:, None], self.sizes[None, low:high]) - common <= limit[:, None]
        return np.concatenate((np.zeros((len(forms), 1), dtype=np.int32), np.cumsum(near, axis=1, dtype=np.int32)), axis=1)

    def within(self, forms: list[str], most: list[int]) -> list[list[tuple[int, str, str]]]:
        """For each form every (distance, entry, name) within its threshold. All forms walk the trees together, level by
        level: a node is measured with those forms that the triangle inequality leaves to it, and that some entry below
        it may be near by its letters; only trees of a near length are entered. All three tests lose nothing."""
        found: list[list[tuple[int, str, str]]] = [[] for _ in forms]
        if not len(self.roots):
            return found
        order = sorted(range(len(forms)), key=lambda i: len(forms[i]))
        size = max(64, min(BLOCK, BLOCK_CELLS // len(self.sizes)))
        for start in range(0, len(order), size):
            block = order[start : start + size]
            asked, limit = [forms[i] for i in block], np.array([most[i] for i in block])
            low = int(np.searchsorted(self.sizes, len(asked[0]) - limit.max(), "left"))
            high = int(np.searchsorted(self.sizes, len(asked[-1]) + limit.max(), "right"))
            if low >= high:
                continue
            before = self._possible(asked, limit, low, high)
            codes, lengths = encoded(asked, self.alphabet)
            roots = self.roots[(self.roots >= low) & (self.roots < high)]
            who, node = np.repeat(np.arange(len(asked)), len(roots)), np.tile(roots, len(asked))
            close = np.abs(lengths[who] - self.sizes[node]) <= limit[who]
            who, node = who[close], node[close]
            while len(who):
                some = before[who, self.after[node] - low] > before[who, node - low]
                who, node = who[some], node[some]
                if not len(who):
                    break
                far = distances(codes[who], lengths[who], self.codes[node], self.sizes[node], len(self.alphabet) + 2)
                for x in np.flatnonzero(far <= limit[who]):
                    form = self.forms[node[x]]
                    found[block[who[x]]].extend((int(far[x]), form, name) for name in self.names[node[x]])
                counts = self.starts[node + 1] - self.starts[node]
                spot = np.repeat(self.starts[node], counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
                who, far = np.repeat(who, counts), np.repeat(far, counts)
                left = np.abs(far - self.edges[spot]) <= limit[who]
                who, node = who[left], self.children[spot[left]]
        return found


def _forms(parts: list[str]) -> set[str]:
    kept = [w for w in parts if w not in FILLERS]
    return {" ".join(p) for p in (parts, kept) if p}


def _rotations(parts: list[str]) -> set[str]:
    return {f for i in range(len(parts)) for f in _forms(parts[i:] + parts[:i])}


def allowed(form: str) -> int:
    n = len(form)
    return 0 if n < 5 else 1 if n < 9 else THRESHOLD


class Matcher:
    """The reference entries of one shard, in trees."""

    def __init__(self, entries: list[tuple[str, str]]) -> None:
        self.shortened: dict[str, list[tuple[str, str]]] = {}
        forms: list[tuple[str, str]] = []
        whole: list[tuple[str, str]] = []
        for spelling, name in entries:
            parts = words(spelling)
            if parts:
                whole.append((" ".join(sorted(parts)), name))
            forms.extend((form, name) for form in sorted(_forms(parts)))
            if len(parts) == 2:
                self.shortened.setdefault(parts[1], []).append((parts[0], name))
        self.longest = max((len(form) for form, _ in forms), default=0)
        self.surnames = BKTree([(s, s) for s in sorted(self.shortened)])
        self.whole, self.tree = BKTree(whole), BKTree(forms)

    def _same_words(self, entered: dict[int, list[str]], found: list[list[tuple[float, str]]], rank: float) -> None:
        """Adds the entries with the same words, at ``rank``."""
        probes: dict[str, list[int]] = {}
        for i, parts in entered.items():
            form = " ".join(sorted(parts))
            if parts and len(form) <= self.longest:
                probes.setdefault(form, []).append(i)
        for form, hits in zip(probes, self.whole.within(list(probes), [0] * len(probes)), strict=True):
            for i in probes[form]:
                found[i].extend((rank, n) for _, _, n in hits)

    def candidates(self, entered: list[str]) -> list[list[tuple[float, str]]]:
        """For each name every (distance, listed name) within the threshold; the same words count as less than 0."""
        found: list[list[tuple[float, str]]] = [[] for _ in entered]
        every = {i: words(name) for i, name in enumerate(entered)}
        self._same_words(every, found, -2.0)
        bare: dict[int, list[str]] = {}
        for i, name in enumerate(entered):
            if not found[i]:
                rest = words(without_notes(name))
                while len(rest) > 2 and rest[0] in TITLES:
                    rest = rest[1:]
                bare[i] = rest
        self._same_words(bare, found, -1.0)
        probes: dict[str, list[int]] = {}
        short: dict[str, list[tuple[int, str]]] = {}
        for i, rest in bare.items():
            if found[i]:
                continue
            for form in _rotations(rest) | _rotations(every[i]):
                if len(form) <= self.longest + allowed(form):
                    probes.setdefault(form, []).append(i)
            if len(rest) == 2:
                for first, last in (rest, rest[::-1]):
                    if len(first) <= 3 and len(last) >= 4:
                        short.setdefault(last, []).append((i, first))
        forms = list(probes)
        for form, hits in zip(forms, self.tree.within(forms, [allowed(f) for f in forms]), strict=True):
            for i in probes[form]:
                found[i].extend((float(far), n) for far, _, n in hits)
        lasts = list(short)
        for last, hits in zip(lasts, self.surnames.within(lasts, [1 if len(x) < 9 else 2 for x in lasts]), strict=True):
            for i, first in short[last]:
                for far, surname, _ in hits:
                    for given, name in self.shortened[surname]:
                        if given.startswith(first) and given != first:
                            found[i].append((far + 0.5, name))
        return found


def nearest(found: list[tuple[float, str]]) -> str:
    if not found:
        return NONE
    least = min(found)[0]
    names = {n for far, n in found if far == least}
    return names.pop() if len(names) == 1 else NONE


def reference_entries(canonical: DataFrame) -> DataFrame:
    """(spelling, name): the listed names, and the aliases that lead to them."""
    listed = canonical.select(F.explode("gold_entities").alias("name")).where(~is_blank(F.col("name"))).distinct()
    aliases = canonical.select(F.explode("entity_aliases").alias("spelling", "name"))
    aliases = aliases.where(~is_blank(F.col("spelling"))).join(listed, "name", "left_semi")
    aliases = aliases.groupBy("spelling").agg(F.min("name").alias("name"))
    return listed.select(F.col("name").alias("spelling"), "name").unionByName(aliases.select("spelling", "name")).distinct()


_FOUND = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("far", T.DoubleType()),
        T.StructField("canonical", T.StringType()),
    ]
)


def match_names(names: DataFrame, entries: DataFrame, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """(name) -> (name, canonical) for distinct names. The list is counted first: within ``shard_entries`` its trees are
    built once and broadcast; a longer list becomes shards, whose trees are built once each and meet the names in
    blocks of about ``BLOCK_NAMES``."""
    size = entries.count()
    shards = max(1, -(-size // shard_entries))
    spark = names.sparkSession
    if shards == 1:
        local = spark.sparkContext.broadcast(Matcher([tuple(r) for r in entries.orderBy("spelling", "name").collect()]))

        def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"name": batch["name"], "canonical": [nearest(f) for f in local.value.candidates(list(batch["name"]))]})

        return names.repartition(task_count(spark)).mapInPandas(probe, "name string, canonical string")

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        matcher = Matcher(sorted(zip(rows["spelling"], rows["name"], strict=True)))
        return pd.DataFrame({"shard": [key[0]], "trees": [pickle.dumps(matcher)]})

    listed = entries.withColumn("shard", F.pmod(F.xxhash64("spelling"), F.lit(shards)).cast("int"))
    built = cut(listed.groupBy("shard").applyInPandas(build, "shard int, trees binary"))
    # Names meet a shard in blocks, so that no task holds more than one shard's trees and one block's names.
    blocks = max(task_count(spark), -(-names.count() // BLOCK_NAMES))
    probes = names.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    probes = probes.withColumn("block", F.pmod(F.xxhash64("name"), F.lit(blocks)))
    built = built.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))))

    def probe_shard(_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame([], columns=_FOUND.names)
        entered = list(left["name"])
        found = pickle.loads(right["trees"].iloc[0]).candidates(entered)
        return pd.DataFrame([(n, far, c) for n, hits in zip(entered, found, strict=True) for far, c in hits], columns=_FOUND.names)

    found = probes.groupBy("shard", "block").cogroup(built.groupBy("shard", "block")).applyInPandas(probe_shard, _FOUND)
    best = found.groupBy("name").agg(F.min("far").alias("far"))
    won = found.join(best, ["name", "far"]).groupBy("name").agg(
        F.when(F.min("canonical") == F.max("canonical"), F.min("canonical")).alias("canonical")
    )
    return names.join(won, "name", "left").select("name", F.coalesce("canonical", F.lit(NONE)).alias("canonical"))


def map_names(entities: DataFrame, canonical: DataFrame, shard_entries: int = SHARD_ENTRIES) -> DataFrame:
    """(row_id, canonical) of every row with a name that is not blank. Each spelling is looked up once."""
    rows = entities.select("row_id", "name").where(~is_blank(F.col("name")))
    weights = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    # One row per spelling, written out: it is read for the heavy spellings and for the rest.
    matched = cut(match_names(weights.select("name"), reference_entries(canonical), shard_entries))
    return lookup(rows, matched, ["name"], ["canonical"], F.col("row_id"), weights).select("row_id", "canonical").distinct()
