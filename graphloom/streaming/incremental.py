"""Incremental runs over Structured Streaming: building the graph tables, and keeping orphan state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from graphloom.config import ChunkConfig
from graphloom.operators.chunking import chunk
from graphloom.operators.extraction import entities_of, relations_of, rule_response
from graphloom.operators.orphans import GONE, PARENTS, STANDING, OrphanState, snapshots, take
from graphloom.sources.files import Store


def graph_batch(documents: DataFrame, config: ChunkConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (file_id, text) -> chunks, raw entities, raw relations. Everything is narrow."""
    chunks = chunk(documents, config)
    responses = chunks.select("file_id", "chunk_id", rule_response(chunks["text"]).alias("response"))
    return chunks, entities_of(responses), relations_of(responses)


def build_incrementally(stream: DataFrame, store: Store, config: ChunkConfig, checkpoint: str) -> StreamingQuery:
    """Chunks and raw records of new documents are added per micro-batch, under the batch's number, so a batch
    that is run again replaces what it wrote. Merging is done when the tables are read: it depends on ordinals
    only, so many batches give what one would."""

    def write(batch: DataFrame, number: int) -> None:
        for name, df in zip(("chunks", "raw_entities", "raw_relations"), graph_batch(batch, config), strict=True):
            df.write.mode("overwrite").parquet(f"{store.folder}/{name}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class KeptState:
    """Orphan state in a folder, by the number of the step. What a step adds lies beside what earlier steps added;
    ``orphans`` is written anew, and last: a step that has it is whole."""

    GROWS = {"parents": PARENTS, "gone": GONE, "served": STANDING}

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.store = spark, Store(spark, folder)

    def save(self, new: OrphanState, number: int) -> None:
        """Writes what the step ``number`` added, and drops the orphans before the last: a step that is run again
        starts from the one before it and replaces what it wrote."""
        for name, schema in self.GROWS.items():
            self.store.save(f"{name}/{number}", getattr(new, name).select(*schema.names))
        self.store.save(f"orphans/{number}", new.orphans.select(*STANDING.names))
        fs, folder = self.store._fs(f"{self.store.folder}/orphans")
        for old in fs.listStatus(folder):
            if old.getPath().getName().isdigit() and int(old.getPath().getName()) < number - 1:
                fs.delete(old.getPath(), True)

    def load(self, number: int) -> OrphanState:
        """The state after the step ``number``; before step 0 it is empty. One that is not held is an error, as
        going on without it would lose what earlier steps brought."""
        if number < 0:
            return OrphanState.empty(self.spark)
        if not self.store.has(f"orphans/{number}"):
            raise ValueError(f"the orphan state after step {number} is not in {self.store.folder}")

        def grown(name: str, schema: StructType) -> DataFrame:
            return self.spark.read.schema(schema).parquet(*[f"{self.store.folder}/{name}/{n}" for n in range(number + 1)])

        parts = {name: grown(name, schema) for name, schema in self.GROWS.items()}
        return OrphanState(orphans=self.spark.read.schema(STANDING).parquet(f"{self.store.folder}/orphans/{number}"), **parts)

    def last(self) -> OrphanState | None:
        fs, folder = self.store._fs(f"{self.store.folder}/orphans")
        numbers = [int(x.getPath().getName()) for x in fs.listStatus(folder) if x.getPath().getName().isdigit()] if fs.exists(folder) else []
        return self.load(max(numbers)) if numbers else None


def track_orphans(
    stream: DataFrame, split: Callable[[DataFrame], tuple[DataFrame, ...]], report: Callable[[DataFrame, int], None], checkpoint: str
) -> tuple[StreamingQuery, list[OrphanState]]:
    """Each micro-batch takes its new parents, references and, where ``split`` returns a third table, deletions
    (key, loaded_at and, where parents have it, version) through the state; a snapshot is reported after each. The
    state lies under the checkpoint by batch number: a later run, or one after a failure, goes on from it, and a batch
    that is run again starts from the state before it. The list holds the last state, that of earlier runs to begin
    with."""
    folder = f"{checkpoint}/orphans"
    last = KeptState(stream.sparkSession, folder).last()
    held: list[OrphanState] = [last] if last else []

    def step(batch: DataFrame, number: int) -> None:
        parents, refs, *deletions = split(batch)
        kept = KeptState(batch.sparkSession, folder)
        kept.save(take(kept.load(number - 1), parents, refs, *deletions), number)
        held[:] = [kept.load(number)]
        report(snapshots(held[0]), number)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(), held
