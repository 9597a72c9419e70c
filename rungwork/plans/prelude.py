"""Shared loading of the domain tables and the SQL that builds the same base relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwork.operators.complexes import Complex, complex_from_supports, complex_supports
from rungwork.operators.corpus import clean_segments, rank_maps, topic_terms
from rungwork.session import kept, table


def segments(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned segments, written once an application."""
    return kept(spark, d, "segments", lambda: clean_segments(table(spark, d, "segments"), table(spark, d, "interviews")))


def maps(spark: SparkSession, d: str) -> DataFrame:
    """All rank maps over the terms in use, written once an application."""
    return kept(spark, d, "maps", lambda: rank_maps(topic_terms(segments(spark, d)), table(spark, d, "term_labels")))


def complex_of(spark: SparkSession, d: str, map_name: str = "R-B") -> tuple[DataFrame, Complex]:
    """Cleaned segments and their complex under one rank map.

    Its parts are written once an application, by granularity and rank, so a query reads only what it asks for.
    """
    seg, by = segments(spark, d), ("granularity", "cell_rank")
    plain: list[Complex] = []

    def made() -> Complex:
        if not plain:
            supports = kept(spark, d, f"supports {map_name}", lambda: complex_supports(seg, maps(spark, d).filter(F.col("map_name") == map_name)), *by)
            plain.append(complex_from_supports(seg, supports))
        return plain[0]

    parts = {name: kept(spark, d, f"{name} {map_name}", lambda name=name: getattr(made(), name), *by) for name in ("cells", "members", "supports")}
    ground = kept(spark, d, "ground", lambda: made().ground)
    return seg, Complex(parts["cells"], parts["members"], parts["supports"].select("granularity", "cell_rank", "cid", "segment_id"), ground)


def sizes_of(spark: SparkSession, d: str, map_name: str = "R-B") -> DataFrame:
    """The cells of the complex with their sizes, written once an application."""
    return kept(spark, d, f"sizes {map_name}", lambda: complex_of(spark, d, map_name)[1].sizes(), "granularity", "cell_rank")


def sq(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\x{{00A0}}]+', ' ', 'g'))"


def key(x: str) -> str:
    return f"nullif(lower({sq(x)}), '')"


def keys(x: str) -> str:
    return f"list_sort(list_distinct(list_filter(list_transform(coalesce({x}, []), lambda v: {key('v')}), lambda v: v IS NOT NULL)))"


def term(x: str) -> str:
    return f"nullif(array_to_string(list_filter(list_transform(string_split({x}, '--'), lambda p: {sq('p')}), lambda p: p <> ''), ' -- '), '')"


SEG = f"""
seg AS (
  SELECT s.segment_id, s.interview_id, s.collection_id, CASE WHEN len(own) > 0 THEN own ELSE coalesce(lent, []) END AS narrators, interviewers, terms, place, title, description
  FROM (SELECT DISTINCT ON (segment_id) segment_id, interview_id, collection_id, title, description, {keys('narrators')} AS own, {keys('interviewers')} AS interviewers,
      list_sort(list_distinct(list_filter(list_transform(coalesce(topics, []), lambda t: {term('t.term')}), lambda v: v IS NOT NULL))) AS terms,
      coalesce(list_filter(list_transform(coalesce(geography, []), lambda g: nullif({sq('g.term')}, '')), lambda v: v IS NOT NULL)[1], 'UNSPECIFIED') AS place
    FROM segments WHERE segment_id IS NOT NULL) s
  LEFT JOIN (SELECT interview_id, max({keys('narrators')}) AS lent FROM interviews WHERE interview_id IS NOT NULL GROUP BY 1) i ON i.interview_id = s.interview_id),
mention AS (SELECT segment_id, place, unnest(terms) AS term FROM seg),
voice AS (SELECT segment_id, unnest(narrators) AS narrator FROM seg),
ground AS (SELECT DISTINCT narrator FROM voice),
terms AS (SELECT term, len(string_split(term, ' -- ')) AS depth, count(DISTINCT segment_id) AS n_segments FROM mention GROUP BY 1, 2)
"""

CX = (
    SEG
    + """,
said AS (SELECT m.*, CASE WHEN len(string_split(term, ' -- ')) <= 2 THEN 3 ELSE 2 END AS cell_rank, string_split(term, ' -- ') AS p FROM mention m WHERE segment_id IN (SELECT segment_id FROM voice)),
g AS (SELECT unnest(['coarse', 'mid', 'fine']) AS granularity),
ev AS (SELECT DISTINCT granularity, 2 AS cell_rank, 'r2:' || k AS cid, b AS base_term, segment_id FROM (
  SELECT granularity, segment_id,
    CASE granularity WHEN 'coarse' THEN (CASE WHEN len(p) > 1 THEN array_to_string(p[1:len(p) - 1], ' -- ') ELSE term END) WHEN 'mid' THEN term ELSE term || ' @ ' || place END AS k,
    CASE granularity WHEN 'coarse' THEN (CASE WHEN len(p) > 1 THEN array_to_string(p[1:len(p) - 1], ' -- ') ELSE term END) ELSE term END AS b
  FROM said, g WHERE cell_rank = 2)),
ep AS (SELECT DISTINCT granularity, term AS base_term, segment_id FROM said, g WHERE cell_rank = 3),
sup AS (
  SELECT granularity, 1 AS cell_rank, segment_id AS cid, NULL AS base_term, segment_id FROM (SELECT DISTINCT segment_id FROM voice), g
  UNION ALL SELECT * FROM ev
  UNION ALL SELECT granularity, 3, 'r3:' || base_term, base_term, segment_id FROM (
    SELECT * FROM ep UNION SELECT ev.granularity, e.base_term, ev.segment_id FROM ev JOIN (SELECT DISTINCT granularity, base_term FROM ep) e ON e.granularity = ev.granularity AND starts_with(ev.base_term, e.base_term || ' -- '))),
mem AS (SELECT DISTINCT granularity, cell_rank, cid, narrator FROM sup JOIN voice USING (segment_id)),
cells_ AS (SELECT DISTINCT granularity, cell_rank, cid, base_term FROM sup),
sizes AS (SELECT c.*, size, n_segments FROM cells_ c JOIN (SELECT granularity, cell_rank, cid, count(*) AS size FROM mem GROUP BY ALL) USING (granularity, cell_rank, cid)
  JOIN (SELECT granularity, cell_rank, cid, count(DISTINCT segment_id) AS n_segments FROM sup GROUP BY ALL) USING (granularity, cell_rank, cid))
"""
)

MID = CX + ", m2 AS (SELECT cid, narrator FROM mem WHERE granularity = 'mid' AND cell_rank = 2), s2 AS (SELECT * FROM sizes WHERE granularity = 'mid' AND cell_rank = 2)"
