"""Problem 7: keys that hold many of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwork.functions.keys import canonical_key, canonical_term
from rungwork.operators.skew import CHUNK_ROWS, distinct_per_key, keys_by_share
from rungwork.session import table

SHARE = 0.05


def key_pairs(segments: DataFrame, cells: DataFrame) -> DataFrame:
    """``field_name, key_value, item``: a row per key held by a segment or cell; NULL and blank keys are left out.

    A NULL segment or cell id makes no row. Repeated rows and repeated values stay, as the counts are of distinct items.
    """

    def of(df: DataFrame, field: str, item: str, values: str, key) -> DataFrame:
        return df.filter(F.col(item).isNotNull()).select(F.lit(field).alias("field_name"), F.explode(values).alias("_v"), F.col(item).alias("item")).select("field_name", key(F.col("_v")).alias("key_value"), "item").filter(F.col("key_value").isNotNull())

    a = of(segments, "segments.narrators", "segment_id", "narrators", canonical_key)
    b = of(segments, "segments.topics", "segment_id", "topics", lambda v: canonical_term(v["term"]))
    c = of(cells, "cells.members", "cid", "members", canonical_key)
    return a.unionByName(b).unionByName(c)


def p7_key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct segments or cells of every key."""
    pairs = key_pairs(table(spark, sf_dir, "segments"), table(spark, sf_dir, "cells"))
    return distinct_per_key(pairs, ["field_name", "key_value"], "item").select("field_name", "key_value", "n_rows", "n_distinct")


def p7_found(spark: SparkSession, sf_dir: str, share: float = SHARE, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Keys held by at least ``share`` of the distinct segments or cells."""
    segments, cells = table(spark, sf_dir, "segments"), table(spark, sf_dir, "cells")
    n_segments = segments.agg(F.count_distinct("segment_id").alias("n_total"))
    totals = n_segments.select(F.explode(F.array(F.lit("segments.narrators"), F.lit("segments.topics"))).alias("field_name"), "n_total").unionByName(cells.agg(F.count_distinct("cid").alias("n_total")).select(F.lit("cells.members").alias("field_name"), "n_total"))
    return keys_by_share(key_pairs(segments, cells), ["field_name", "key_value"], "item", totals, share, chunk_rows).select("field_name", "key_value")


_PAIRS_SQL = r"""
pairs AS (
  SELECT 'segments.narrators' AS field_name, nullif(lower(trim(regexp_replace(v, '[\s\x{00A0}]+', ' ', 'g'))), '') AS key_value, segment_id AS item
  FROM (SELECT segment_id, unnest(narrators) AS v FROM segments)
  UNION ALL
  SELECT 'segments.topics', nullif(array_to_string(list_filter(list_transform(string_split(v.term, '--'), lambda p: trim(regexp_replace(p, '[\s\x{00A0}]+', ' ', 'g'))), lambda p: p <> ''), ' -- '), ''), segment_id
  FROM (SELECT segment_id, unnest(topics) AS v FROM segments)
  UNION ALL
  SELECT 'cells.members', nullif(lower(trim(regexp_replace(v, '[\s\x{00A0}]+', ' ', 'g'))), ''), cid
  FROM (SELECT cid, unnest(members) AS v FROM cells))
"""

QUERIES = {"p7_found": p7_found, "p7_key_counts": p7_key_counts}

ORACLE = {
    "p7_key_counts": f"WITH {_PAIRS_SQL} SELECT field_name, key_value, count(*) AS n_rows, count(DISTINCT item) AS n_distinct FROM pairs WHERE key_value IS NOT NULL AND item IS NOT NULL GROUP BY 1, 2",
    "p7_found": f"""WITH {_PAIRS_SQL}, totals AS (
      SELECT 'segments.narrators' AS field_name, count(DISTINCT segment_id) AS n FROM segments UNION ALL
      SELECT 'segments.topics', count(DISTINCT segment_id) FROM segments UNION ALL
      SELECT 'cells.members', count(DISTINCT cid) FROM cells)
    SELECT p.field_name, p.key_value FROM pairs p JOIN totals t USING (field_name)
    WHERE key_value IS NOT NULL AND item IS NOT NULL GROUP BY 1, 2, t.n HAVING count(DISTINCT item) >= {SHARE} * t.n""",
}
