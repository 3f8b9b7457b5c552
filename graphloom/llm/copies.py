"""Duplicates hidden by formatting differences.

Records are brought to canonical bytes: record table, file, and the alike key of the name (entities) or the
two alike keys in order (relations). Equal bytes mean the same record.

1. Every input partition counts its own records in a path-compressed trie with terminal counters, so a
   record that fills a third of the table leaves each partition as one row before anything is shuffled.
2. The partial counts are split by radix: buckets are the first bytes of the canonical bytes, and a bucket
   over ``bucket_rows`` is split by further bytes, until each fits or its bytes are used up. Bytes that are
   used up mean one single record, which has at most one row per trie of step 1.
3. Each bucket is counted by one trie, whose terminals hold the copies and the smallest id.

Defined cases: a blank name or endpoint (null or white space) or a null file_id makes no record; names
without letters or digits are alike among themselves; rows repeated under one row_id count as often as they
occur in ``copies`` (``row_id`` is unique in these tables); empty tables give empty results; columns beyond
those named here are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.text import alike_key, is_blank
from graphloom.operators.skew import lookup
from graphloom.session import cut, task_count

#: Rows of partial counts that one bucket may hold: a trie of so many keys takes some 60 MB.
BUCKET_ROWS = 100_000
#: Keys that the trie of an input partition holds before it is emptied.
TRIE_KEYS = 100_000
#: Bytes of a bucket's first prefix; each split doubles them.
STRIDE = 4

COUNTS = T.StructType(
    [
        T.StructField("record", T.StringType()),
        T.StructField("copies", T.LongType()),
        T.StructField("first_id", T.LongType()),
    ]
)


class Trie:
    """A path-compressed byte trie whose terminals count copies and keep the smallest id.

    A node is [label, children by first byte, copies, first id]; copies 0 means no terminal.
    """

    def __init__(self) -> None:
        self.root: list = [b"", {}, 0, None]
        self.keys = 0

    def add(self, key: bytes, copies: int, first: int) -> None:
        node, at, n = self.root, 0, len(key)
        while at < n:
            child = node[1].get(key[at])
            if child is None:
                node[1][key[at]] = [key[at:], {}, copies, first]
                self.keys += 1
                return
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            same, most = 1, min(len(label), n - at)
            while same < most and label[same] == key[at + same]:
                same += 1
            middle = [label[:same], {label[same]: child}, 0, None]
            child[0] = label[same:]
            node[1][key[at]] = middle
            node, at = middle, at + same
        if node[2]:
            node[2] += copies
            node[3] = min(node[3], first)
        else:
            self.keys += 1
            node[2], node[3] = copies, first

    def items(self) -> Iterator[tuple[bytes, int, int]]:
        """(key, copies, first id) in the order of the bytes."""
        stack = [(b"", self.root)]
        while stack:
            prefix, node = stack.pop()
            key = prefix + node[0]
            if node[2]:
                yield key, node[2], node[3]
            stack.extend((key, node[1][b]) for b in sorted(node[1], reverse=True))


def _frames(trie: Trie, rows: int = 20_000) -> Iterator[pd.DataFrame]:
    batch: list[tuple[str, int, int]] = []
    for key, copies, first in trie.items():
        batch.append((key.decode(), copies, first))
        if len(batch) == rows:
            yield pd.DataFrame(batch, columns=COUNTS.names)
            batch = []
    if batch:
        yield pd.DataFrame(batch, columns=COUNTS.names)


def _count_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    trie = Trie()
    for batch in batches:
        for record, copies, first in zip(batch["record"], batch["copies"], batch["first_id"], strict=True):
            trie.add(record.encode(), copies, first)
            if trie.keys >= TRIE_KEYS:
                yield from _frames(trie)
                trie = Trie()
    yield from _frames(trie)


def _count_buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One trie per bucket; the rows come sorted by bucket."""
    trie, bucket = Trie(), None
    for batch in batches:
        for b, record, copies, first in zip(
            batch["bucket"], batch["record"], batch["copies"], batch["first_id"], strict=True
        ):
            if b != bucket:
                yield from _frames(trie)
                trie, bucket = Trie(), b
            trie.add(record.encode(), copies, first)
    yield from _frames(trie)


def radix_buckets(partial: DataFrame, bucket_rows: int = BUCKET_ROWS, stride: int = STRIDE) -> DataFrame:
    """``partial`` with a column ``bucket``: the shortest prefix of ``record``, of ``stride`` bytes or twice as many
    each time, that at most ``bucket_rows`` rows share, or all of ``record`` where that is shorter.

    Only counts per prefix are shuffled; the driver learns nothing but whether a level has any bucket to
    split. The oversized prefixes of a level number at most rows / bucket_rows. Rows of buckets that fit leave;
    the others are written out before they are split further, so plans stay short.
    """
    open_, settled, depth = partial, None, stride
    while True:
        rows = open_.withColumn("bucket", F.substring(F.encode("record", "UTF-8"), 1, depth))
        longer = F.octet_length("record") > depth
        counts = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"), F.max(longer).alias("_longer"))
        big = cut(counts.where((F.col("_n") > bucket_rows) & F.col("_longer")).select("bucket"))
        last = big.isEmpty()
        done = rows if last else rows.join(big, "bucket", "left_anti")
        done = done.select("record", "copies", "first_id", "bucket")
        settled = done if settled is None else settled.unionByName(done)
        if last:
            return settled
        open_ = cut(rows.join(big, "bucket", "left_semi").select("record", "copies", "first_id"))
        depth *= 2


def collapse(records: DataFrame, bucket_rows: int = BUCKET_ROWS, stride: int = STRIDE) -> DataFrame:
    """(record, row_id) -> (record, copies, first_id), one row per record."""
    single = records.select("record", F.lit(1).cast("bigint").alias("copies"), F.col("row_id").alias("first_id"))
    partial = cut(single.mapInPandas(_count_partition, COUNTS))
    spread = radix_buckets(partial, bucket_rows, stride)
    spread = spread.repartition(task_count(spread.sparkSession), "bucket").sortWithinPartitions("bucket")
    return spread.mapInPandas(_count_buckets, COUNTS)


def _filled(*names: str) -> Column:
    out = F.col("file_id").isNotNull()
    for n in names:
        out = out & ~is_blank(F.col(n))
    return out


def canonical(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(record_table, row_id, record) of both tables; the unit separator parts the fields."""
    sep = F.lit("\x1f")
    ent = entities.where(_filled("name")).select(
        F.lit("entities").alias("record_table"),
        "row_id",
        F.concat(F.lit("e"), "file_id", sep, alike_key(F.col("name"))).alias("record"),
    )
    rel = relations.where(_filled("source", "target")).select(
        "row_id", "file_id", alike_key(F.col("source")).alias("a"), alike_key(F.col("target")).alias("b")
    )
    rel = rel.select(
        F.lit("relations").alias("record_table"),
        "row_id",
        F.concat(F.lit("r"), "file_id", sep, F.least("a", "b"), sep, F.greatest("a", "b")).alias("record"),
    )
    return ent.unionByName(rel)


def copy_rows(records: DataFrame, groups: DataFrame) -> DataFrame:
    """(record_table, first_id, row_id) of every row that is not the first of its record."""
    several = cut(groups.where(F.col("copies") > 1))
    weights = several.select("record", F.col("copies").alias("n"))
    out = lookup(records, several, ["record"], ["first_id"], F.col("row_id"), weights)
    return out.where(F.col("first_id") < F.col("row_id")).select("record_table", "first_id", "row_id").distinct()
