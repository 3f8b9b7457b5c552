"""Files and stores: text and gold sources, guards, a Parquet store of the pipeline's tables, and sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.merge import latest_by
from graphloom.schema import CHUNK_DDL, ENTITY_DDL, GOLD_DDL, RELATION_DDL

#: The tables of a store, in the order they are saved in, with their columns.
TABLES = {
    "chunks": CHUNK_DDL,
    "entities": ENTITY_DDL,
    "relations": RELATION_DDL + ", first_seen bigint",
    "chunk_vectors": "id string, vec array<double>",
    "entity_vectors": "id string, vec array<double>",
    "relation_vectors": "id string, vec array<double>",
    "vertices": ENTITY_DDL + ", known boolean",
    "edges": "file_id string, node string, neighbour string, rel_key string, first_seen bigint",
}


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): every file whole."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold envelopes by an explicit schema; one that is not chunk independent, or has a question without
    evidence, is an error when it is read."""
    gold = spark.read.schema(GOLD_DDL).json(path, multiLine=True)
    bare = F.exists("questions", lambda q: F.coalesce(F.size(q["gold_evidence_spans"]), F.lit(0)) == 0)
    wrong = ~F.coalesce(F.col("annotation.chunk_independent"), F.lit(False)) | F.coalesce(bare, F.lit(True))
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("gold file is not usable: "), F.coalesce("dataset", F.lit("?")))).cast("string"))
    return gold.withColumn("dataset", F.coalesce(checked, "dataset"))


def read_chunk_store(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_id, chunk) from a JSON object by id, or from a list of [id, chunk] pairs; chunk is a VARIANT."""
    raw = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    items = raw.select(F.try_variant_get("v", "$", "map<string,variant>").alias("m"), F.try_variant_get("v", "$", "array<variant>").alias("a"))
    by_key = items.where(F.col("m").isNotNull()).select(F.explode("m").alias("chunk_id", "chunk"))
    pairs = items.where(F.col("a").isNotNull()).select(F.explode("a").alias("p"))
    listed = pairs.select(F.try_variant_get("p", "$[0]", "string").alias("chunk_id"), F.try_variant_get("p", "$[1]", "variant").alias("chunk"))
    return by_key.unionByName(listed)


def check_source(documents: DataFrame, expected: DataFrame, strict: bool = True) -> DataFrame:
    """documents (file_id, text), expected (file_id, sha256) -> (file_id, status): ok, different, or unknown where
    no hash is given. Strict makes unknown a failure of its own name."""
    rows = documents.join(expected, "file_id", "left")
    unknown = "missing hash" if strict else "unknown"
    status = F.when(F.col("sha256").isNull(), unknown).when(F.sha2("text", 256) == F.lower("sha256"), "ok").otherwise("different")
    return rows.select("file_id", status.alias("status"))


class Store:
    """A folder of Parquet tables with the fingerprint of the settings that built them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def has(self, name: str) -> bool:
        fs, p = self._fs(f"{self.folder}/{name}")
        return fs.exists(p)

    def save(self, name: str, df: DataFrame) -> None:
        """Written beside and moved into place, so readers never see half a table; the old one goes when the new one
        stands, and comes back when it cannot be put there."""
        path = f"{self.folder}/{name}"
        df.write.mode("overwrite").parquet(path + ".new")
        fs, p = self._fs(path)
        new, old = self._fs(path + ".new")[1], self._fs(path + ".old")[1]
        if fs.exists(p):
            fs.delete(old, True)
            if not fs.rename(p, old):
                raise OSError(f"{path} cannot be moved aside")
        if not fs.rename(new, p):
            fs.rename(old, p)
            raise OSError(f"{path}.new cannot be moved into place")
        fs.delete(old, True)

    def append(self, name: str, df: DataFrame) -> None:
        """Adds rows, such as further vectors, to a table; key and vector are columns of one row."""
        df.write.mode("append").parquet(f"{self.folder}/{name}")

    def save_all(self, tables: dict[str, DataFrame]) -> None:
        """Every table of TABLES, in their order; one that is missing is an error before anything is written."""
        missing = [name for name in TABLES if name not in tables]
        if missing:
            raise ValueError(f"missing tables: {', '.join(missing)}")
        for name in TABLES:
            self.save(name, tables[name])

    def load_all(self) -> dict[str, DataFrame]:
        return {name: self.load(name, ddl) for name, ddl in TABLES.items()}

    def load(self, name: str, ddl: str) -> DataFrame:
        """The table, or an empty one where it was never saved."""
        return self.spark.read.parquet(f"{self.folder}/{name}") if self.has(name) else self.spark.createDataFrame([], ddl)

    def get(self, name: str, keys: DataFrame, key: str) -> DataFrame:
        """Rows by key; a key that is not held has nulls."""
        return keys.join(self.spark.read.parquet(f"{self.folder}/{name}"), key, "left")

    def upsert(self, name: str, rows: DataFrame, key: str, version: str) -> None:
        """The last version of every key stays."""
        old = self.load(name, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema))
        self.save(name, latest_by(old.unionByName(rows), key, version))

    def claim(self, fingerprint: str) -> bool:
        """True when the store is new and has to be built; False when it was built with the same settings. Other
        settings are an error."""
        if not self.has("settings"):
            self.save("settings", self.spark.createDataFrame([(fingerprint,)], "fingerprint string"))
            return True
        held = self.spark.read.parquet(f"{self.folder}/settings").first()["fingerprint"]
        if held != fingerprint:
            raise ValueError("the store was built with other settings")
        return False


def write_results(rows: DataFrame, summaries: DataFrame, folder: str) -> None:
    """Rows by mode, and summaries, as JSON."""
    rows.write.mode("overwrite").partitionBy("mode").json(f"{folder}/rows")
    summaries.write.mode("overwrite").json(f"{folder}/summaries")


def derived_map(chunk_evidence: DataFrame) -> DataFrame:
    """(qid, gold_chunk_evidence): a map from chunk to its evidence, per question."""
    lists = chunk_evidence.groupBy("qid", "chunk_id").agg(F.array_sort(F.collect_set("evidence_id")).alias("e"))
    return lists.groupBy("qid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("chunk_id", "e")))).alias("gold_chunk_evidence"))


def gold_json(gold: dict) -> str:
    """The text form of a gold file: UTF-8, two blanks of indent."""
    return json.dumps(gold, ensure_ascii=False, indent=2)


def write_gold(gold: DataFrame, folder: str) -> None:
    """Gold envelopes (see GOLD_DDL), one JSON object a line; ``read_gold`` takes single objects, so one file each."""
    gold.repartition("dataset").write.mode("overwrite").option("maxRecordsPerFile", 1).json(folder)
