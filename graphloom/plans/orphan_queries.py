"""Queries of the orphan operator, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.operators import orphans as O
from graphloom.plans.tables import table


def _state(spark: SparkSession, folder: str) -> O.OrphanState:
    parents, refs = O.reference_keys(*[table(spark, folder, t) for t in ("entities", "relations", "chunks")])
    return O.replay(parents, refs)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return O.orphans(_state(spark, folder)).select("ref_table", "ref_field", "row_id", "ref_key").distinct()


def p5_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    return O.snapshots(_state(spark, folder))


QUERIES = {"p5_found": p5_found, "p5_snapshots": p5_snapshots}

# White space and apostrophes as in graphloom.functions.text, for RE2.
_SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_QUOTES = r"['`\x{b4}\x{2b9}\x{2bb}-\x{2bd}\x{2c8}\x{2ca}\x{2cb}\x{2018}\x{2019}\x{201b}\x{2032}\x{2035}\x{ff07}]"


def sql_key(c: str) -> str:
    """The alike key in DuckDB (lower, with the two foldings that lower lacks and names use)."""
    folded = f"replace(replace(lower({c}), 'ß', 'ss'), 'ς', 'σ')"
    bare = f"regexp_replace({folded}, '{_QUOTES.replace(chr(39), chr(39) * 2)}', '', 'g')"
    return f"array_to_string(list_sort(regexp_extract_all({bare}, '[\\p{{L}}\\p{{N}}]+')), ' ')"


def sql_filled(c: str) -> str:
    return f"({c} IS NOT NULL AND regexp_replace({c}, '{_SPACE}', '', 'g') <> '')"


_STANDING = f"""
WITH parents AS (
  SELECT 'e' AS kind, file_id AS scope, {sql_key('name')} AS k, loaded_at, NOT coalesce(is_deleted, false) AS live
  FROM entities WHERE {sql_filled('name')}
  UNION ALL SELECT 'c', '', chunk_id, loaded_at, NOT coalesce(is_deleted, false) FROM chunks
), idx AS (SELECT kind, scope, k, min(loaded_at) FILTER (WHERE live) AS first_live FROM parents GROUP BY ALL),
refs AS (
  SELECT DISTINCT * FROM (
    SELECT 'relations' AS ref_table, 'source' AS ref_field, row_id, source AS ref_key, 'e' AS kind, file_id AS scope,
           {sql_key('source')} AS k, loaded_at FROM relations WHERE {sql_filled('source')}
    UNION ALL SELECT 'relations', 'target', row_id, target, 'e', file_id, {sql_key('target')}, loaded_at
    FROM relations WHERE {sql_filled('target')}
    UNION ALL SELECT 'entities', 'source_id', row_id, s, 'c', '', s, loaded_at
    FROM (SELECT row_id, loaded_at, unnest(source_id) AS s FROM entities) WHERE s IS NOT NULL)
), standing AS (
  SELECT r.*, i.first_live, i.k IS NOT NULL AS known, NOT coalesce(i.first_live <= r.loaded_at, false) AS orphan
  FROM refs r LEFT JOIN idx i USING (kind, scope, k))
"""

SQL = {
    "p5_found": _STANDING + "SELECT DISTINCT ref_table, ref_field, row_id, ref_key FROM standing WHERE orphan",
    "p5_snapshots": _STANDING
    + """, opened AS (
  SELECT ref_table, strftime(loaded_at, '%Y-%m') AS period, count(*) AS refs,
    count(*) FILTER (WHERE orphan) AS orphans,
    count(*) FILTER (WHERE orphan AND first_live IS NULL AND NOT known) AS missing,
    count(*) FILTER (WHERE orphan AND first_live IS NULL AND known) AS deleted,
    count(*) FILTER (WHERE orphan AND first_live IS NOT NULL) AS late
  FROM standing GROUP BY ALL
), closed AS (
  SELECT ref_table, strftime(first_live, '%Y-%m') AS period, count(*) AS resolved
  FROM standing WHERE orphan AND first_live IS NOT NULL GROUP BY ALL
), both_ AS (
  SELECT ref_table, period, coalesce(refs, 0) AS refs, coalesce(orphans, 0) AS orphans, coalesce(missing, 0) AS missing,
    coalesce(deleted, 0) AS deleted, coalesce(late, 0) AS late, coalesce(resolved, 0) AS resolved
  FROM opened FULL JOIN closed USING (ref_table, period))
SELECT *, CAST(sum(orphans - resolved) OVER (PARTITION BY ref_table ORDER BY period) AS BIGINT) AS waiting FROM both_""",
}
