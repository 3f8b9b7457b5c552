"""Filling containers of fixed capacity with documents.

Sizes are tokens of a public byte-level tokenizer: one per UTF-8 byte and one end token. Sum-of-squares
packing: an item goes where the squared counts of open containers per residual gap become smallest, counting
an opened container like any other gap and a full one as none. A document larger than the capacity is divided:
its leading parts fill whole containers, what is left is an item.

Every row of documents gets a number of its own, by which its parts are spread over groups of about ``GROUP_ITEMS``
items, each packed on its own, largest first, so no task holds more than a group. What a group leaves open is packed again with what other groups left
(``ROUNDS`` times): the containers under ``FULL`` of their capacity are dissolved into their items, which form
new groups. The number of containers of one spec that stay under ``FULL`` is then about that of one group.

Defined cases: an empty text is one item of one end token; a document with a null text is reported with a null
container and no tokens; specs with a null id or a capacity under one are ignored; repeated specs count once;
rows repeated under one doc_id, and those under null, are items of their own; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.session import cut, task_count

#: Items of a group: its state is a few numbers per item.
GROUP_ITEMS = 10_000
#: A container filled to this part of its capacity stays closed after a round.
FULL = 0.98
ROUNDS = 2
#: Container specs that one part of the plan names; more specs make more parts.
SPEC_BLOCK = 100


class SumOfSquares:
    """Open containers by residual gap, for one capacity."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]  # containers by gap
        self.count = np.zeros(capacity + 1, dtype=np.int64)
        self.used = 0

    def place(self, size: int) -> int:
        """The container that an item of 1 to capacity tokens goes to."""
        c, n = self.capacity, self.count
        # Moving a container from gap g to g - size changes the sum of squares by
        # 2 (n[g - size] - n[g] + 1); a container that becomes full only takes 2 n[g] - 1 away.
        change = 2 * (n[: c - size + 1] - n[size : c + 1] + 1)
        change[0] = 1 - 2 * n[size]
        change[n[size : c + 1] == 0] = np.iinfo(np.int64).max
        # An opened container adds gap c - size: 2 n + 1, or nothing if it is filled at once.
        fresh = 2 * n[c - size] + 1 if size < c else 0
        best = int(np.argmin(change[:c - size])) if size < c else 0
        if size < c and change[best] <= fresh and n[best + size]:
            gap = best + size
            box = self.open[gap].pop()
            n[gap] -= 1
        else:
            gap, box = c, self.used
            self.used += 1
        if gap > size:
            self.open[gap - size].append(box)
            n[gap - size] += 1
        return box


def pack_sizes(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item, largest first; ties keep their order."""
    packer = SumOfSquares(capacity)
    out = np.empty(len(sizes), dtype=np.int64)
    for i in np.argsort(-sizes, kind="stable"):
        out[i] = packer.place(int(sizes[i]))
    return out


_ITEMS = T.StructType(
    [
        T.StructField("spec_id", T.LongType()),
        T.StructField("capacity", T.LongType()),
        T.StructField("container", T.StringType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("item", T.LongType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("tokens", T.LongType()),
        T.StructField("filled", T.LongType()),
    ]
)


def _packer(round_: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        spec, group = key
        rows = rows.sort_values(["tokens", "item", "part"], ascending=[False, True, True], kind="stable")
        sizes = rows["tokens"].to_numpy(dtype=np.int64)
        box = pack_sizes(sizes, int(rows["capacity"].iloc[0]))
        filled = np.bincount(box, weights=sizes).astype(np.int64)
        names = [f"{spec}-{round_}-{group}-{b}" for b in box]
        return rows.assign(container=names, filled=filled[box])[_ITEMS.names]

    return run


def _packed(items: DataFrame, round_: int, group_items: int) -> DataFrame:
    """One round: items by spec in groups of bounded size."""
    load = items.groupBy("spec_id").agg(F.ceil(F.count(F.lit(1)) / group_items).cast("int").alias("groups"))
    group = F.pmod(F.xxhash64("item", "part", F.lit(round_)), F.col("groups"))
    rows = items.join(F.broadcast(load), "spec_id").withColumn("group", group)
    rows = rows.repartition(task_count(items.sparkSession), "spec_id", "group")
    return rows.groupBy("spec_id", "group").applyInPandas(_packer(round_), _ITEMS)


def numbered(documents: DataFrame) -> DataFrame:
    """(doc_id, item, size) of the documents with a text. The numbers are written out, so they hold for good."""
    sized = documents.where(F.col("text").isNotNull()).select("doc_id", (F.octet_length("text") + 1).cast("bigint").alias("size"))
    return cut(sized.withColumn("item", F.monotonically_increasing_id()))


def items_of(sized: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, capacity, doc_id, item, part, tokens): every document's parts for every spec. The specs, each of which
    takes up the whole corpus, become literals of the plan, ``SPEC_BLOCK`` at a time."""
    listed = specs.where(F.col("spec_id").isNotNull() & (F.col("capacity_tokens") > 0)).groupBy("spec_id").agg(F.max("capacity_tokens").alias("capacity"))
    found = listed.orderBy("spec_id").collect()
    kind, out = "ARRAY<STRUCT<spec_id:BIGINT,capacity:BIGINT>>", None
    for at in range(0, max(len(found), 1), SPEC_BLOCK):
        block = [F.struct(F.lit(int(r["spec_id"])).alias("spec_id"), F.lit(int(r["capacity"])).alias("capacity")) for r in found[at : at + SPEC_BLOCK]]
        rows = sized.select("doc_id", "item", "size", F.explode(F.array(*block).cast(kind)).alias("s"))
        out = rows if out is None else out.unionByName(rows)
    rows = out.select("doc_id", "item", "size", "s.spec_id", "s.capacity")
    parts = F.sequence(F.lit(0), (F.ceil(F.col("size") / F.col("capacity")) - 1).cast("int"))
    rows = rows.select("*", F.explode(parts).alias("part"))
    return rows.select(
        "spec_id", "capacity", "doc_id", "item", "part", F.least(F.col("capacity"), F.col("size") - F.col("part") * F.col("capacity")).alias("tokens")
    )


def pack(documents: DataFrame, specs: DataFrame, group_items: int = GROUP_ITEMS, rounds: int = ROUNDS) -> DataFrame:
    """(spec_id, container, doc_id, part, tokens): every part of every document once per spec."""
    items = items_of(numbered(documents), specs)
    whole = items.where(F.col("tokens") == F.col("capacity"))
    name = F.concat_ws("-", F.col("spec_id").cast("string"), F.lit("w"), F.col("item").cast("string"), F.col("part").cast("string"))
    done = whole.withColumn("container", name)
    left = items.where(F.col("tokens") < F.col("capacity"))
    columns = ["spec_id", "container", "doc_id", "part", "tokens"]
    out = done.select(*columns)
    for round_ in range(rounds + 1):
        found = cut(_packed(left, round_, group_items))
        last = round_ == rounds
        closed = F.lit(True) if last else F.col("filled") >= F.ceil(F.col("capacity") * FULL)
        out = out.unionByName(found.where(closed).select(*columns))
        if last:
            break
        left = found.where(~closed).drop("container", "filled")
    none = documents.where(F.col("text").isNull()).select(
        F.lit(None).cast("bigint").alias("spec_id"), F.lit(None).cast("string").alias("container"), F.col("doc_id"), F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("tokens")
    )
    return out.unionByName(none)


def fill(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """Per spec: items, containers, tokens, unused tokens and their part of all capacity."""
    capacity = specs.groupBy(F.col("spec_id").cast("bigint").alias("spec_id")).agg(F.max("capacity_tokens").cast("bigint").alias("capacity"))
    boxes = packed.where(F.col("container").isNotNull()).groupBy("spec_id", "container").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    per = boxes.groupBy("spec_id").agg(
        F.sum("n").alias("items"), F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest")
    )
    return per.join(F.broadcast(capacity), "spec_id").withColumn("unused", F.col("containers") * F.col("capacity") - F.col("tokens")).withColumn(
        "unused_share", F.round(F.col("unused") / (F.col("containers") * F.col("capacity")), 6)
    )
