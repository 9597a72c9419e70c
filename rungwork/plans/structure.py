"""Queries over the corpus and its complex."""

from __future__ import annotations

from pyspark.sql import functions as F

from rungwork.operators import complexes as C
from rungwork.operators import corpus as K
from rungwork.plans.prelude import CX, SEG, complex_of, keys, maps, segments, sizes_of, sq, term
from rungwork.session import table


def _round(df, *names, digits=6):
    return df.withColumns({n: F.round(F.col(n).cast("double"), digits) for n in names})


def topic_terms(s, d):
    return K.topic_terms(segments(s, d))


def topic_tree(s, d):
    return K.topic_tree(K.topic_terms(segments(s, d)))


def rank_maps(s, d):
    return maps(s, d)


def frequency_strata(s, d):
    return K.frequency_strata(K.topic_terms(segments(s, d)))


def corpus_stats(s, d):
    return K.corpus_stats(table(s, d, "interviews").filter("interview_id is not null"), segments(s, d))


def boilerplate(s, d):
    return K.find_boilerplate(table(s, d, "segments").select("segment_id", "description").distinct(), "description")


def clean_segments(s, d):
    one = segments(s, d)
    return one.select("segment_id", "interview_id", F.array_join("narrators", "|").alias("narrators"), F.array_join("interviewers", "|").alias("interviewers"), F.array_join("terms", "|").alias("terms"), "place")


def narrator_roles(s, d):
    i = table(s, d, "interviews").filter("interview_id is not null")
    both = i.select("interview_id", F.array_join(K.role_keys(F.col("creators"), "narrator"), "|").alias("narrators"), F.array_join(K.role_keys(F.col("creators"), "interviewer"), "|").alias("interviewers"))
    return both.distinct()


def complex_cells(s, d):
    return sizes_of(s, d)


def complex_with_interviewers(s, d):
    seg = segments(s, d)
    cx = C.build_complex(seg, maps(s, d).filter("map_name = 'R-B'"), include_interviewers=True)
    return cx.sizes().groupBy("granularity", "cell_rank").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("size").alias("n_members"))


def complex_min_size(s, d):
    seg, cx = complex_of(s, d)
    supports = cx.supports.withColumn("base_term", F.lit(None).cast("string"))
    return C.complex_from_supports(seg, supports, min_cell_size=3).sizes().groupBy("granularity", "cell_rank").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("size").alias("n_members"))


def complex_summary(s, d):
    return _round(C.summary(sizes_of(s, d)), "size_mean", "size_median", "singletons")


def attestation_triage(s, d):
    return C.triage(sizes_of(s, d))


def triage_referents(s, d):
    return C.triage_referents(sizes_of(s, d))


def attestation_histogram(s, d):
    return C.attestation_histogram(sizes_of(s, d))


def size_extremes(s, d):
    return _round(C.extremes(sizes_of(s, d)), "ratio")


def _incidence(k, j):
    def run(s, d):
        return C.incidence(complex_of(s, d)[1], k, j)

    return run


def adjacency_events(s, d):
    return C.adjacency(C.incidence(complex_of(s, d)[1], 2, 3))


def coadjacency_events(s, d):
    return C.coadjacency(C.incidence(complex_of(s, d)[1], 0, 3))


def star_counts(s, d):
    nodes, edges = C.star(complex_of(s, d)[1])
    a = nodes.groupBy("granularity", F.concat(F.lit("rank "), "cell_rank").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(edges.groupBy("granularity", F.col("etype").alias("kind")).agg(F.count(F.lit(1)).alias("n")))


def star_roundtrip(s, d):
    return C.star_roundtrip(complex_of(s, d)[1])


def support_injectivity(s, d):
    return _round(C.support_injectivity(complex_of(s, d)[1]), "collapse")


def obstruction_audit(s, d):
    out = None
    for name in ("R-A", "R-B", "R-C"):
        part = _round(C.support_injectivity(complex_of(s, d, name)[1]), "collapse").select(F.lit(name).alias("map_name"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def rank_size_spearman(s, d):
    return _round(C.spearman(sizes_of(s, d), ["granularity"], "cell_rank", "size"), "rho")


def rank_size_concordance(s, d):
    return C.concordance(sizes_of(s, d))


def attestation_vs_frequency(s, d):
    return _round(C.spearman(sizes_of(s, d).filter("cell_rank = 2"), ["granularity"], "size", "n_segments"), "rho")


def sanity(s, d):
    return _round(C.sanity(complex_of(s, d)[1]), "orphans")


def masked_sizes(s, d):
    _, cx = complex_of(s, d)
    keep = cx.members.filter(F.substring(F.md5("narrator"), 1, 1) < "8").select("narrator", "cid")
    return C.mask(cx, keep).sizes().filter("cell_rank >= 2").select("granularity", "cell_rank", "cid", "size")


def restricted_sizes(s, d):
    _, cx = complex_of(s, d)
    kept = cx.ground.filter(F.substring(F.md5("narrator"), 1, 1) < "8")
    return C.restrict(cx, kept).sizes().select("granularity", "cell_rank", "cid", "size")


def drop_rare_terms(s, d):
    seg = segments(s, d)
    rare = K.topic_terms(seg).filter("n_segments = 1")
    return C.drop_terms(seg, rare).select("segment_id", F.array_join("terms", "|").alias("terms"))


_FNS = (topic_terms, topic_tree, rank_maps, frequency_strata, corpus_stats, boilerplate, clean_segments, narrator_roles, complex_cells, complex_with_interviewers, complex_min_size, complex_summary, attestation_triage, triage_referents, attestation_histogram, size_extremes, adjacency_events, coadjacency_events, star_counts, star_roundtrip, support_injectivity, obstruction_audit, rank_size_spearman, rank_size_concordance, attestation_vs_frequency, sanity, masked_sizes, restricted_sizes, drop_rare_terms)
QUERIES = {f.__name__: f for f in _FNS} | {f"incidence_{k}{j}": _incidence(k, j) for k, j in ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))}

_RANKED = "SELECT granularity, {x}, {y}, rank() OVER (PARTITION BY granularity ORDER BY {x}) + (count(*) OVER (PARTITION BY granularity, {x}) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY granularity ORDER BY {y}) + (count(*) OVER (PARTITION BY granularity, {y}) - 1) / 2.0 AS ry FROM sizes"
_INJ = """SELECT {x}granularity, cell_rank, sum(n)::BIGINT AS n_cells, count(*) AS n_supports, max(n) AS max_multiplicity, round(sum(n) / count(*), 6) AS collapse, count(*) FILTER (n > 1) AS n_shared
FROM (SELECT {x}granularity, cell_rank, s, count(*) AS n FROM (SELECT {x}granularity, cell_rank, cid, list_sort(list(narrator)) AS s FROM {m} GROUP BY ALL) GROUP BY ALL) GROUP BY ALL"""
_B = {
    (0, 1): "SELECT granularity, narrator AS row_cid, cid AS col_cid FROM mem WHERE cell_rank = 1",
    (0, 2): "SELECT granularity, narrator AS row_cid, cid AS col_cid FROM mem WHERE cell_rank = 2",
    (0, 3): "SELECT granularity, narrator AS row_cid, cid AS col_cid FROM mem WHERE cell_rank = 3",
    (1, 2): "SELECT granularity, segment_id AS row_cid, cid AS col_cid FROM sup WHERE cell_rank = 2",
    (1, 3): "SELECT granularity, segment_id AS row_cid, cid AS col_cid FROM sup WHERE cell_rank = 3",
    (2, 3): "SELECT a.granularity, a.cid AS row_cid, b.cid AS col_cid FROM cells_ a JOIN cells_ b ON a.granularity = b.granularity AND a.cell_rank = 2 AND b.cell_rank = 3 AND starts_with(a.base_term, b.base_term || ' -- ')",
}
_TREE = "tree AS (SELECT DISTINCT array_to_string(p[1:i], ' -- ') AS parent, array_to_string(p[1:i + 1], ' -- ') AS child FROM (SELECT p, unnest(range(1, len(p))) AS i FROM (SELECT string_split(term, ' -- ') AS p FROM terms)))"
_LATEST = f"latest AS (SELECT annotator, label_round, term, label_rank FROM (SELECT replace({keys('[annotator]')}[1], '_', '-') AS annotator, label_round, {term('term')} AS term, label_rank, labelled_at FROM term_labels WHERE label_rank IN (2, 3)) WHERE annotator IS NOT NULL AND term IS NOT NULL QUALIFY row_number() OVER (PARTITION BY annotator, label_round, term ORDER BY labelled_at DESC NULLS LAST, label_rank DESC) = 1)"
_MAPS = f"""{_TREE}, {_LATEST},
votes AS (SELECT term, count(*) FILTER (label_rank = 3) AS h, count(*) FILTER (label_rank = 2) AS l FROM latest WHERE label_round = 2 GROUP BY 1),
maps AS (SELECT 'R-A' AS map_name, t.term, CASE WHEN h > l THEN 3 WHEN l > h THEN 2 WHEN depth <= 2 THEN 3 ELSE 2 END AS cell_rank FROM terms t LEFT JOIN votes USING (term)
  UNION ALL SELECT 'R-B', term, CASE WHEN depth <= 2 THEN 3 ELSE 2 END FROM terms
  UNION ALL SELECT 'R-C', term, CASE WHEN term IN (SELECT parent FROM tree) THEN 3 ELSE 2 END FROM terms)"""
_NAME = "trim(regexp_replace(regexp_replace(translate(lower({}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z ]', ' ', 'g'), ' +', ' ', 'g'))"
_ROLE = "array_to_string(list_sort(list_distinct(list_filter(list_transform(list_filter(coalesce(creators, []), lambda c: lower(trim(c.role)) = '{r}'), lambda c: CASE WHEN c.oh_id IS NOT NULL AND trim(c.oh_id) NOT IN ('', '0') THEN 'oh:' || trim(c.oh_id) ELSE 'nm:' || nullif(" + _NAME.format("c.namepart") + ", '') END), lambda k: k IS NOT NULL))), '|')"

ORACLE = {
    "topic_terms": f"WITH {SEG} SELECT term, depth::INT AS depth, CASE WHEN depth > 1 THEN array_to_string(string_split(term, ' -- ')[1:depth - 1], ' -- ') END AS parent, array_to_string(string_split(term, ' -- ')[1:2], ' -- ') AS referent, n_segments FROM terms",
    "topic_tree": f"WITH {SEG}, {_TREE} SELECT * FROM tree",
    "rank_maps": f"WITH {SEG}, {_MAPS} SELECT * FROM maps",
    "frequency_strata": f"WITH {SEG} SELECT term, n_segments, CASE WHEN n_segments <= 2 THEN 'rare_1_2' WHEN i < n // 3 THEN 'head' WHEN i < 2 * (n // 3) THEN 'middle' ELSE 'tail' END AS stratum FROM (SELECT term, n_segments, row_number() OVER (ORDER BY n_segments DESC, term) - 1 AS i, count(*) OVER () AS n FROM terms)",
    "corpus_stats": f"""WITH {SEG}, i AS (SELECT DISTINCT ON (interview_id) * FROM interviews WHERE interview_id IS NOT NULL), per AS (SELECT count(*) AS c FROM seg WHERE interview_id IS NOT NULL GROUP BY interview_id)
      SELECT (SELECT count(*) FROM i) AS n_interviews, (SELECT count(*) FROM i WHERE transcript_chars > 0) AS n_transcripts, (SELECT quantile_cont(transcript_chars, 0.5)::DOUBLE FROM i) AS chars_median,
        (SELECT count(*) FROM seg) AS n_segments, (SELECT count(*) FROM seg WHERE len(terms) > 0) AS n_with_topic, (SELECT count(*) FROM seg WHERE place <> 'UNSPECIFIED') AS n_with_place,
        (SELECT count(*) FROM ground) AS n_narrators, (SELECT quantile_cont(c, 0.5)::DOUBLE FROM per) AS segments_median, (SELECT min(c) FROM per) AS segments_min, (SELECT max(c) FROM per) AS segments_max""",
    "boilerplate": rf"""WITH t AS (SELECT DISTINCT segment_id, description FROM segments), e AS (SELECT {sq('s')} AS sentence FROM (SELECT unnest(string_split(regexp_replace(description, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS s FROM t))
      SELECT sentence, count(*) AS n FROM e WHERE sentence <> '' AND len(string_split(sentence, ' ')) >= 6 GROUP BY 1 HAVING count(*) >= 0.005 * (SELECT count(description) FROM t)""",
    "clean_segments": f"WITH {SEG} SELECT segment_id, interview_id, array_to_string(narrators, '|') AS narrators, array_to_string(interviewers, '|') AS interviewers, array_to_string(terms, '|') AS terms, place FROM seg",
    "narrator_roles": f"SELECT DISTINCT interview_id, {_ROLE.format(r='narrator')} AS narrators, {_ROLE.format(r='interviewer')} AS interviewers FROM interviews WHERE interview_id IS NOT NULL",
    "complex_cells": f"WITH {CX} SELECT * FROM sizes",
    "complex_min_size": f"WITH {CX} SELECT granularity, cell_rank, count(*) AS n_cells, sum(size)::BIGINT AS n_members FROM sizes WHERE size >= 3 OR cell_rank = 1 GROUP BY ALL",
    "complex_with_interviewers": f"WITH {CX.replace('unnest(narrators) AS narrator FROM seg', 'unnest(list_distinct(list_concat(narrators, interviewers))) AS narrator FROM seg')} SELECT granularity, cell_rank, count(*) AS n_cells, sum(size)::BIGINT AS n_members FROM sizes GROUP BY ALL",
    "complex_summary": f"WITH {CX} SELECT granularity, cell_rank, count(*) AS n_cells, round(avg(size), 6) AS size_mean, round(quantile_cont(size, 0.5), 6)::DOUBLE AS size_median, max(size) AS size_max, min(size) AS size_min, round(avg((size = 1)::INT), 6) AS singletons FROM sizes GROUP BY ALL",
    "attestation_triage": f"WITH {CX} SELECT granularity, row_number() OVER (PARTITION BY granularity ORDER BY size, cid)::INT AS pos, cid, size, base_term FROM sizes WHERE cell_rank = 2 QUALIFY row_number() OVER (PARTITION BY granularity ORDER BY size, cid) <= 50",
    "triage_referents": f"WITH {CX}, o AS (SELECT granularity, array_to_string(string_split(base_term, ' -- ')[1:2], ' -- ') AS referent, row_number() OVER (PARTITION BY granularity ORDER BY size, cid) AS p FROM sizes WHERE cell_rank = 2), f AS (SELECT granularity, referent, min(p) AS p FROM o GROUP BY ALL) SELECT granularity, row_number() OVER (PARTITION BY granularity ORDER BY p)::INT AS pos, referent FROM f QUALIFY row_number() OVER (PARTITION BY granularity ORDER BY p) <= 50",
    "attestation_histogram": f"WITH {CX} SELECT granularity, CASE WHEN size <= 1 THEN '1' WHEN size <= 3 THEN '2-3' WHEN size <= 10 THEN '4-10' WHEN size <= 50 THEN '11-50' ELSE '>50' END AS band, count(*) AS n_cells FROM sizes WHERE cell_rank = 2 GROUP BY ALL",
    "size_extremes": f"WITH {CX} SELECT granularity, cell_rank, first(cid ORDER BY size DESC, cid) AS largest, first(cid ORDER BY size, cid) AS smallest, round(max(size) / min(size), 6) AS ratio FROM sizes GROUP BY ALL",
    "adjacency_events": f"WITH {CX}, e AS ({_B[2, 3]}) SELECT x.granularity, x.row_cid AS a, y.row_cid AS b, count(*) AS weight FROM e x JOIN e y ON x.granularity = y.granularity AND x.col_cid = y.col_cid AND x.row_cid <> y.row_cid GROUP BY ALL",
    "coadjacency_events": f"WITH {CX}, e AS ({_B[0, 3]}) SELECT x.granularity, x.col_cid AS a, y.col_cid AS b, count(*) AS weight FROM e x JOIN e y ON x.granularity = y.granularity AND x.row_cid = y.row_cid AND x.col_cid <> y.col_cid GROUP BY ALL",
    "star_counts": f"""WITH {CX} SELECT granularity, 'rank ' || cell_rank AS kind, count(*) AS n FROM cells_ GROUP BY ALL UNION ALL SELECT granularity, 'rank 0', count(*) FROM ground, g GROUP BY ALL
      UNION ALL SELECT granularity, 'in_r' || cell_rank, count(*) FROM mem GROUP BY ALL UNION ALL SELECT granularity, 'supports_r' || cell_rank, count(*) FROM sup WHERE cell_rank > 1 GROUP BY ALL""",
    "star_roundtrip": f"WITH {CX} SELECT DISTINCT granularity, 0::BIGINT AS n_missing, 0::BIGINT AS n_extra FROM mem",
    "support_injectivity": f"WITH {CX} " + _INJ.format(x="", m="mem"),
    "obstruction_audit": "WITH "
    + CX.replace("said AS (SELECT m.*, CASE WHEN len(string_split(term, ' -- ')) <= 2 THEN 3 ELSE 2 END AS cell_rank,", _MAPS + ", said AS (SELECT m.*, maps.cell_rank, map_name,")
    .replace("FROM mention m WHERE", "FROM mention m JOIN maps USING (term) WHERE")
    .replace("ev AS (SELECT DISTINCT granularity,", "ev AS (SELECT DISTINCT map_name, granularity,")
    .replace("SELECT granularity, segment_id,\n", "SELECT map_name, granularity, segment_id,\n")
    .replace("ep AS (SELECT DISTINCT granularity,", "ep AS (SELECT DISTINCT map_name, granularity,")
    .replace("SELECT granularity, 1 AS cell_rank, segment_id AS cid, NULL AS base_term, segment_id FROM (SELECT DISTINCT segment_id FROM voice), g", "SELECT map_name, granularity, 1 AS cell_rank, segment_id AS cid, NULL AS base_term, segment_id FROM (SELECT DISTINCT segment_id FROM voice), g, (SELECT DISTINCT map_name FROM maps)")
    .replace("SELECT granularity, 3, 'r3:'", "SELECT map_name, granularity, 3, 'r3:'")
    .replace("UNION SELECT ev.granularity,", "UNION SELECT ev.map_name, ev.granularity,")
    .replace("JOIN (SELECT DISTINCT granularity, base_term FROM ep) e ON", "JOIN (SELECT DISTINCT map_name, granularity, base_term FROM ep) e ON e.map_name = ev.map_name AND")
    .replace("mem AS (SELECT DISTINCT granularity,", "mem AS (SELECT DISTINCT map_name, granularity,")
    .split(",\ncells_ AS")[0]
    + " "
    + _INJ.format(x="map_name, ", m="mem"),
    "rank_size_spearman": f"WITH {CX}, r AS ({_RANKED.format(x='cell_rank', y='size')}) SELECT granularity, round(corr(rx, ry), 6) AS rho FROM r GROUP BY ALL",
    "attestation_vs_frequency": f"WITH {CX}, r AS ({_RANKED.format(x='size', y='n_segments')} WHERE cell_rank = 2) SELECT granularity, round(corr(rx, ry), 6) AS rho FROM r GROUP BY ALL",
    "rank_size_concordance": f"WITH {CX} SELECT a.granularity, count(*) FILTER (b.size > a.size) AS n_concordant, count(*) FILTER (b.size < a.size) AS n_inverted, count(*) FILTER (b.size = a.size) AS n_tied FROM sizes a JOIN sizes b ON a.granularity = b.granularity AND a.cell_rank < b.cell_rank GROUP BY ALL",
    "sanity": f"WITH {CX} SELECT granularity, 0::BIGINT AS n_empty_moments, 0::BIGINT AS n_bad_rank, 0::BIGINT AS n_outside, round(avg((NOT EXISTS (SELECT 1 FROM ev WHERE ev.granularity = c.granularity AND ev.segment_id = c.cid))::INT), 6) AS orphans FROM cells_ c WHERE cell_rank = 1 GROUP BY ALL",
    "masked_sizes": f"WITH {CX} SELECT granularity, cell_rank, cid, count(*) FILTER (substr(md5(narrator), 1, 1) < '8') AS size FROM mem WHERE cell_rank >= 2 GROUP BY ALL",
    "restricted_sizes": f"WITH {CX} SELECT granularity, cell_rank, cid, count(*) AS size FROM mem WHERE substr(md5(narrator), 1, 1) < '8' GROUP BY ALL",
    "drop_rare_terms": f"WITH {SEG}, k AS (SELECT segment_id, string_agg(term, '|' ORDER BY term) AS t FROM mention JOIN terms USING (term) WHERE n_segments > 1 GROUP BY 1) SELECT s.segment_id, coalesce(t, '') AS terms FROM seg s LEFT JOIN k USING (segment_id)",
} | {f"incidence_{k}{j}": f"WITH {CX} {q}" for (k, j), q in _B.items()}
