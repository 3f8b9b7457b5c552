"""References to records that do not exist: pending-orphan state, kept incrementally.

The state is four keyed tables. ``parents`` has every parent version that was delivered, and ``gone`` the versions
that deletions withdrew: both only grow, step by step, so a withdrawn version stays withdrawn when it is delivered in
the same step, later, or again. ``orphans`` has the references that wait: it is what a step rewrites. ``served`` is a
log of the references that found a parent; it only grows, and is read again only for keys that a deletion hits.

A step (``take``) brings new parents, new references and deletions. New references probe the parent index, arriving
parents resolve the references that wait for them, and deletions reopen references that lose their last early enough
parent. Steps may cut the input anywhere and come in any order: the standing after the last is the same.
``replay`` takes whole tables through such steps, period by period of loaded_at.

A reference is an *orphan* when no live parent of its key was loaded no later than the reference. One whose first
parent was loaded after it (cause ``late``) no longer waits, but stays an orphan, as it was one when it was loaded.

* A version is told by (key, loaded_at, version); deletions name it so. One that arrives with ``live`` false never
  serves, and withdraws no other; only deletions do. Inputs without the column ``version`` have it null.
* Null keys match nothing: such a reference is an orphan. Null ``is_deleted`` counts as live.
* A reference without ``loaded_at`` is an orphan; a parent without ``loaded_at`` serves nobody.
* Repeated references and parents count once. Empty tables give empty results.
* Extra columns are ignored; only the columns named here are read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions.text import alike_key, is_blank
from graphloom.operators.skew import heaviest, lookup
from graphloom.session import cut

#: Steps that ``replay`` cuts the time between the first and the last load into, at whole months.
STEPS = 3

PARENTS = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("loaded_at", T.TimestampNTZType()),
        T.StructField("live", T.BooleanType()),
        T.StructField("version", T.LongType()),
    ]
)
REFS = T.StructType(
    [
        T.StructField("ref_table", T.StringType()),
        T.StructField("ref_field", T.StringType()),
        T.StructField("row_id", T.LongType()),
        T.StructField("ref_key", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("loaded_at", T.TimestampNTZType()),
    ]
)
STANDING = T.StructType(
    [
        *REFS.fields,
        T.StructField("first_live", T.TimestampNTZType()),
        T.StructField("known", T.BooleanType()),
    ]
)
GONE = T.StructType([f for f in PARENTS.fields if f.name != "live"])


@dataclass
class OrphanState:
    """``parents`` (see PARENTS), ``gone`` (see GONE), ``orphans`` and ``served`` (see STANDING)."""

    parents: DataFrame
    gone: DataFrame
    orphans: DataFrame
    served: DataFrame
    new: bool = False

    @classmethod
    def empty(cls, spark: SparkSession) -> OrphanState:
        return cls(*[spark.createDataFrame([], schema) for schema in (PARENTS, GONE, STANDING, STANDING)], new=True)

    def plus(self, new: OrphanState) -> OrphanState:
        """The state after a step that gave ``new``: its orphans take the place of the old ones, the rest is added."""
        if self.new:
            return new
        return OrphanState(
            self.parents.unionByName(new.parents), self.gone.unionByName(new.gone), new.orphans, self.served.unionByName(new.served)
        )


def _shaped(df: DataFrame, schema: T.StructType) -> DataFrame:
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def _index(parents: DataFrame, gone: DataFrame) -> DataFrame:
    """The parent index: the first load of each key that still serves. Both aggregates combine before the shuffle."""
    rows = parents.withColumn("gone", F.lit(False)).unionByName(gone.withColumn("gone", F.lit(True)), allowMissingColumns=True)
    versions = rows.where(F.col("key").isNotNull()).groupBy("key", "loaded_at", "version").agg(F.max("live").alias("live"), F.max("gone").alias("gone"))
    serves = F.col("live") & ~F.col("gone")
    known = F.max(F.col("live").isNotNull())
    index = versions.groupBy("key").agg(F.min(F.when(serves, F.col("loaded_at"))).alias("first_live"), known.alias("known"))
    return index.where("known")


def _spread() -> F.Column:
    return F.xxhash64("ref_field", "row_id", "ref_key")


def take(
    state: OrphanState, parents: DataFrame, refs: DataFrame, deletions: DataFrame | None = None, weights: DataFrame | None = None
) -> OrphanState:
    """One step: what it adds to ``state``, and the orphans after it (see ``OrphanState.plus``).

    ``parents`` and ``deletions`` (key, loaded_at, version) become part of the state as they are given, so they have
    to be durable; the standing of the references that the step touches is written out. ``weights`` (key, n) has the
    references of the heaviest keys, where that is known beforehand.
    """
    parents = _shaped(parents, PARENTS)
    gone = _shaped(deletions, GONE) if deletions is not None else state.gone.limit(0)
    touched = _shaped(refs, REFS)
    touched = (touched if state.new else touched.unionByName(state.orphans.select(*REFS.names))).withColumn("logged", F.lit(False))
    if deletions is not None and not state.new:
        hit = gone.where(F.col("key").isNotNull()).groupBy("key").agg(F.lit(True).alias("hit"))
        reopened = lookup(state.served.select(*REFS.names), hit, ["key"], ["hit"], _spread(), weights).where("hit")
        touched = touched.unionByName(reopened.select(*REFS.names, F.lit(True).alias("logged")))
    index = _index(parents, gone) if state.new else _index(state.parents.unionByName(parents), state.gone.unionByName(gone))
    probed = cut(lookup(touched, index, ["key"], ["first_live", "known"], _spread(), weights).select(*STANDING.names, "logged"))
    orphans, served = probed.where(is_orphan()), probed.where(~is_orphan() & ~F.col("logged"))
    return OrphanState(parents, gone, orphans.select(*STANDING.names).distinct(), served.select(*STANDING.names))


def advance(
    state: OrphanState | None, parents: DataFrame, refs: DataFrame, deletions: DataFrame | None = None, weights: DataFrame | None = None
) -> OrphanState:
    """The state after one step; ``state`` None is the empty state."""
    state = state or OrphanState.empty(parents.sparkSession)
    return state.plus(take(state, parents, refs, deletions, weights))


def replay(
    parents: DataFrame, refs: DataFrame, steps: int = STEPS, report: Callable[[int, OrphanState], None] | None = None
) -> OrphanState:
    """The tables taken through the state by periods of loaded_at, at most ``steps`` of whole months each. The rows
    of a period arrive together; a parent row that is marked deleted (``live`` false) arrives live, and its deletion
    comes with the next period, in the last one with the row. Rows without loaded_at arrive first."""
    month = F.year("loaded_at") * 12 + F.month("loaded_at")
    parents = cut(_shaped(parents, PARENTS).withColumn("month", month))
    refs = cut(_shaped(refs, REFS).distinct().withColumn("month", month))
    ends = parents.select("month").union(refs.select("month")).agg(F.min("month").alias("a"), F.max("month").alias("b")).first()
    first, last = (ends["a"], ends["b"]) if ends["a"] is not None else (0, 0)
    width = -(-(last - first + 1) // steps)
    count = -(-(last - first + 1) // width)

    def within(a: int, b: int) -> F.Column:
        """Rows of the periods from a to b; those without a month belong to the first."""
        return F.coalesce("month", F.lit(first)).between(first + a * width, first + (b + 1) * width - 1)

    weights = cut(heaviest(refs, ["key"]))
    state = None
    for n in range(count):
        due = within(max(n - 1, 0), n if n == count - 1 else n - 1)
        arrived = parents.where(within(n, n)).withColumn("live", F.lit(True))
        deleted = parents.where(due & ~F.col("live")) if n or count == 1 else None
        state = advance(state, arrived, refs.where(within(n, n)), deleted, weights)
        if report:
            report(n, state)
    return state


def is_orphan() -> F.Column:
    """The condition over a standing row; never null."""
    return ~F.coalesce(F.col("first_live") <= F.col("loaded_at"), F.lit(False))


def orphans(state: OrphanState) -> DataFrame:
    """The orphan references, with their cause: ``missing``, ``deleted`` or ``late``."""
    cause = F.when(F.col("first_live").isNotNull(), "late").when(F.col("known"), "deleted").otherwise("missing")
    return state.orphans.withColumn("cause", cause)


def snapshots(state: OrphanState) -> DataFrame:
    """Per table and month of loaded_at: references, orphans by cause, and orphans still waiting at its end.

    The counts are made before anything is ordered; the running sum is over one row per table and month.
    """
    # What a deletion reopened is an orphan, whatever the log of the served says.
    every = state.orphans.withColumn("open", F.lit(1)).unionByName(state.served.withColumn("open", F.lit(0)))
    every = every.groupBy(*REFS.names).agg(F.max(F.struct("open", "first_live", "known")).alias("s")).select(*REFS.names, "s.first_live", "s.known")
    refs = every.withColumn("orphan", is_orphan()).withColumn("period", F.date_format("loaded_at", "yyyy-MM"))
    cause = F.when(F.col("first_live").isNotNull(), "late").when(F.col("known"), "deleted").otherwise("missing")
    opened = refs.groupBy("ref_table", "period").agg(
        F.count(F.lit(1)).alias("refs"),
        F.sum(F.col("orphan").cast("bigint")).alias("orphans"),
        *[F.sum((F.col("orphan") & (cause == c)).cast("bigint")).alias(c) for c in ("missing", "deleted", "late")],
    )
    closed = (
        refs.where(F.col("orphan") & F.col("first_live").isNotNull())
        .withColumn("period", F.date_format("first_live", "yyyy-MM"))
        .groupBy("ref_table", "period")
        .agg(F.count(F.lit(1)).alias("resolved"))
    )
    both = opened.join(closed, ["ref_table", "period"], "full").fillna(0)
    run = Window.partitionBy("ref_table").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("waiting", F.sum(F.col("orphans") - F.col("resolved")).over(run))


def reference_keys(entities: DataFrame, relations: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The parents and references of the graph tables.

    Relation endpoints point to entities of the same file with a name alike; elements of
    entities.source_id point to chunks by chunk_id. Blank endpoints and null elements refer to nothing.
    """
    live = ~F.coalesce(F.col("is_deleted"), F.lit(False))

    def scoped(kind: str, key: F.Column) -> F.Column:  # null when any part is null
        return F.concat(F.lit(kind + "\x1f"), F.col("file_id"), F.lit("\x1f"), key)

    named = entities.where(~is_blank(F.col("name")))
    parents = named.select(
        scoped("entity", alike_key(F.col("name"))).alias("key"), "loaded_at", live.alias("live"), F.col("row_id").alias("version")
    )
    # A chunk's rows have no number: what tells them apart is their standing.
    parents = parents.union(
        chunks.select(F.concat(F.lit("chunk\x1f"), F.col("chunk_id")).alias("key"), "loaded_at", live.alias("live"), live.cast("bigint").alias("version"))
    )
    ends = F.array(
        F.struct(F.lit("source").alias("ref_field"), F.col("source").alias("ref_key")),
        F.struct(F.lit("target").alias("ref_field"), F.col("target").alias("ref_key")),
    )
    rel = relations.select("row_id", "file_id", "loaded_at", F.explode(ends).alias("e")).select(
        "row_id", "file_id", "loaded_at", "e.ref_field", "e.ref_key"
    )
    rel = rel.where(~is_blank(F.col("ref_key"))).select(
        F.lit("relations").alias("ref_table"),
        "ref_field",
        "row_id",
        "ref_key",
        scoped("entity", alike_key(F.col("ref_key"))).alias("key"),
        "loaded_at",
    )
    ent = entities.select("row_id", "loaded_at", F.explode("source_id").alias("ref_key"))
    ent = ent.where(F.col("ref_key").isNotNull()).select(
        F.lit("entities").alias("ref_table"),
        F.lit("source_id").alias("ref_field"),
        "row_id",
        "ref_key",
        F.concat(F.lit("chunk\x1f"), F.col("ref_key")).alias("key"),
        "loaded_at",
    )
    return parents, rel.unionByName(ent)
