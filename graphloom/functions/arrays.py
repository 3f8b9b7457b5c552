"""Array expressions that Spark has no function for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.let import let

#: Elements that are summed one by one; the blocks before are summed whole.
BLOCK = 256


def running_sums(values: Column) -> Column:
    """For each element the sum of those before it, as int. A fold that appends to an array would copy it for every
    element; here an element costs at most its block and the number of blocks."""

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda acc, x: acc + x)

    def sums(v: Column) -> Column:
        last = F.floor((F.size(v) - 1) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: total(F.slice(v, b * BLOCK + 1, F.lit(BLOCK))))
        heads = let(blocks, lambda bs: F.transform(bs, lambda _, i: total(F.slice(bs, F.lit(1), i))))

        def each(hs: Column) -> Column:
            def one(_: Column, i: Column) -> Column:
                block = F.floor(i / BLOCK).cast("int")
                return hs[block] + total(F.slice(v, block * BLOCK + 1, i - block * BLOCK))

            return F.transform(v, one)

        return F.when(F.size(v) > 0, let(heads, each)).otherwise(F.expr("CAST(array() AS ARRAY<INT>)"))

    return let(values, sums)
