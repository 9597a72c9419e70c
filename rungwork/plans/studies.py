"""Queries over features, rank studies, claims, stochastic order, variance, negatives and perturbation grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from rungwork.functions import text as T
from rungwork.operators import claims as CL
from rungwork.operators import corpus as K
from rungwork.operators import features as FE
from rungwork.operators import graph as G
from rungwork.operators import negatives as NEG
from rungwork.operators import outcomes as O
from rungwork.operators import perturb as P
from rungwork.operators import rank_study as RS
from rungwork.operators import statistics as ST
from rungwork.plans.evaluation import _PLACE, _SC, _TURN, _mid, _poisson_sql, _scored, _vectors
from rungwork.plans.evaluation import ORACLE as _EVALUATED
from rungwork.plans.prelude import CX, MID, SEG, complex_of, maps, segments, sizes_of
from rungwork.plans.structure import _MAPS, _TREE, _round
from rungwork.session import kept, table
from rungwork.sources.readers import json_at

#: Words that speak for a place or occurrence, and for a programme, in the terms of these tables.
SITE = ("camp", "school", "hall", "mill", "cannery", "harbor", "strike", "fire", "flood", "hearing", "trial", "closure", "sale")
PROGRAMME = ("work", "life", "community", "family", "education", "relief", "labor", "trade", "religion", "politics", "war", "migration")


def _turns(s, d):
    return table(s, d, "turns").dropDuplicates(["turn_id"]).filter("raw is not null").select("turn_id", "interview_id", "narrator", "turn_no", "role_gold", "raw", F.length("raw").alias("v"))


# features


def _segment_vectors(s, d):
    """Each segment with the vector that its hash picks; there is no encoder here."""

    def build():
        v = _vectors(s, d)
        n = v.agg(F.count(F.lit(1)).alias("_n"))
        place = F.pmod(F.conv(F.substring(F.md5("segment_id"), 1, 8), 16, 10).cast("long"), F.col("_n"))
        return segments(s, d).select("segment_id").crossJoin(F.broadcast(n)).select("segment_id", place.alias("id")).join(v, "id").select("segment_id", "vec")

    return kept(s, d, "segment vectors", build)


def _told(df, *keys):
    """The first three numbers of a vector and its sum."""
    at = [(F.round(F.get("vec", F.lit(i)), 4) + 0).alias(f"x{i}") for i in range(3)]
    return df.select(*keys, *at, (F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 3) + 0).alias("total"))


def _allowed(s, d):
    return K.voices(segments(s, d)).filter(F.substring(F.md5(F.concat_ws("|", "segment_id", "narrator")), 1, 1) < "4")


def narrator_features(s, d):
    return _told(FE.narrator_vectors(K.voices(segments(s, d)), _segment_vectors(s, d)), "narrator", "n", "fallback")


def permitted_features(s, d):
    """Narrators' vectors from permitted segments alone, with the fallback to all of theirs."""
    return _told(FE.narrator_vectors(K.voices(segments(s, d)), _segment_vectors(s, d), _allowed(s, d)), "narrator", "n", "fallback")


def cell_text_features(s, d):
    return _told(FE.cell_text_vectors(_mid(s, d)[2], _segment_vectors(s, d)), "cid")


def complex_features(s, d):
    seg, cx = complex_of(s, d)
    who = FE.narrator_vectors(K.voices(seg), _segment_vectors(s, d))
    f = FE.cell_features(cx.members.filter("granularity = 'mid'"), who)
    return _told(f.withColumnRenamed("feature", "vec"), "cell_rank", "cid")


# rank study


def _terms(s, d):
    return kept(s, d, "terms", lambda: K.topic_terms(segments(s, d)))


def rank_study_labels(s, d):
    t, out = _terms(s, d), None
    for number, adjudicated in ((1, False), (2, True)):
        one = RS.label_all(t, list(SITE), list(PROGRAMME), adjudicated).select(F.lit(number).alias("label_round"), "annotator", F.col("item").alias("term"), F.col("label").alias("label_rank"))
        out = one if out is None else out.unionByName(one)
    return out


def _second(s, d):
    return rank_study_labels(s, d).filter("label_round = 2").select("annotator", F.col("term").alias("item"), F.col("label_rank").alias("label"))


def rank_study_consensus(s, d):
    return RS.consensus(_second(s, d), _terms(s, d))


def rank_study_alphas(s, d):
    return _round(RS.alphas(_second(s, d), K.frequency_strata(_terms(s, d)).select("term", "stratum")), "alpha")


def rank_study_sample(s, d):
    return RS.stratified_sample(K.frequency_strata(_terms(s, d)).select("term", "stratum"), 100)


def term_usage(s, d):
    return RS.sample_usage(K.mentions(segments(s, d)))


# claims


def traced_numbers(s, d):
    """Prices as parts quote them to a tenth, and whether a price paid for an item bears them out."""
    quotes = table(s, d, "part").select("p_partkey", F.round("p_retailprice", 1).alias("value"), F.lit(1).alias("places"))
    paid = table(s, d, "lineitem").filter("l_quantity > 0").select((F.col("l_extendedprice") / F.col("l_quantity")).alias("value"))
    return CL.traced(quotes, paid).select("p_partkey", "traced")


def event_payload(s, d):
    return json_at(table(s, d, "events"), "props", "k").select("event_id", F.col("value").try_cast("int").alias("k"))


def formatted_numbers(s, d):
    t = table(s, d, "interviews").filter("interview_id is not null and transcript_chars > 0").groupBy("interview_id").agg(F.max("transcript_chars").alias("c"), F.max("n_segments").alias("n"))
    return t.select("interview_id", T.grouped(F.col("c")).alias("chars"), T.percent(F.col("n") / 61).alias("share"), T.yes_no(F.col("n") > 10).alias("long"), T.fixed(F.col("n") / 4, 2).alias("quarter"))


def cleaned_speech(s, d):
    return _turns(s, d).select("turn_id", T.clean_speech(F.col("raw")).alias("clean"))


# statistics


def turn_length_bca(s, d):
    return _round(ST.bca_mean(_turns(s, d).filter("narrator is not null"), "narrator", "v"), "point", "lo", "hi", "z0", "a", digits=4)


def role_order(s, d):
    return _round(ST.stochastic_order(_turns(s, d), "role_gold", "v"), "ratio", "level")


def size_rank_information(s, d):
    return _round(ST.mutual_information(sizes_of(s, d).filter("granularity = 'mid'"), "size", "cell_rank"), "nats")


def turn_variance(s, d):
    t = _turns(s, d).filter("narrator is not null and interview_id is not null")
    return _round(ST.variance_components(t, "narrator", "interview_id", "v"), "mean", "sd", "observed", "within", "component", "share", digits=4)


def role_sign_flips(s, d):
    return ST.sign_flips(_turns(s, d).withColumn("x", F.col("v") - 150), "interview_id", "role_gold", "NARRATOR", "INTERVIEWER", "x")


def role_advantage(s, d):
    return _round(ST.paired_advantage(_turns(s, d).filter("narrator is not null"), "narrator", "role_gold", "NARRATOR", "INTERVIEWER", "v"), "advantage", digits=4)


def role_table(s, d):
    t = ST.run_table(_turns(s, d).filter("interview_id is not null"), ["interview_id"], "role_gold", ["NARRATOR", "INTERVIEWER"], "v")
    return t.select("interview_id", *[F.round(F.col(f"{r} {x}").cast("double"), 4).alias(f"{r.lower()}_{x}") for r in ("NARRATOR", "INTERVIEWER") for x in ("mean", "sd", "n")])


def role_length_interaction(s, d):
    t = _turns(s, d).filter("role_gold in ('NARRATOR', 'INTERVIEWER') and turn_no is not null").withColumn("f", (F.col("role_gold") == "NARRATOR").cast("double")).withColumn("x", F.log1p("turn_no"))
    return _round(ST.interaction(t, "v", "f", "x", "narrator"), "coefficient", "se", "lo", "hi", digits=4)


# negatives, topology, perturbation


def negatives_labelled(s, d):
    _, m, _, ground = _mid(s, d)
    return NEG.labelled(m, ground, "uniform", ratio=10).groupBy("cid", "label").agg(F.count(F.lit(1)).alias("n"))


def negatives_motif_or_uniform(s, d):
    _, m, _, ground = _mid(s, d)
    walked = NEG.motif(m, G.both_ways(G.cowitness(m)))
    return NEG.or_uniform(walked, m, m, ground)


def betti_permutation(s, d):
    return G.permutation_test(_mid(s, d)[1])


def betti_explanation(s, d):
    return _round(G.simpler_explanation(G.resampled_curves(_mid(s, d)[1])), "r2", digits=3)


def resampled_betti(s, d):
    return _round(G.resampled_curves(_mid(s, d)[1], draws=5), "size_mean", "size_sd", "singletons", digits=5).drop("n_edges", "n_nodes")


def narrator_encodings(s, d):
    _, m, _, ground = _mid(s, d)
    e = G.encodings(m, ground)
    n = F.size("block")
    return e.select("node", n.alias("width"), F.round(F.get("block", n - 4), 4).alias("degree"), F.round(F.get("block", n - 3), 4).alias("mean_size"))


def triage_grid(s, d):
    return _round(P.triage_grid(_mid(s, d)[1]), "overlap", "singletons", digits=4)


def false_singletons(s, d):
    return _round(P.false_singletons(_mid(s, d)[1], 0.05, 0.05), "share", digits=4)


# outcomes


def _outcomes(s, d):
    """Each vector and label with whether a score at or above the label's median goes with its own."""
    return O.outcomes(_scored(s, d), ["cell"], "y", "score")


def item_outcomes(s, d):
    return _outcomes(s, d).select("id", "cell", "y", "score", "correct")


def outcome_strata(s, d):
    x = _outcomes(s, d).withColumn("unit", F.col("id") % 97)
    return _round(O.stratified_means(x, ["y"], "unit", "correct"), "mean", "lo", "hi", digits=4)


def role_gap(s, d):
    return _round(O.gap_interval(_turns(s, d).filter("interview_id is not null"), "role_gold", "NARRATOR", "INTERVIEWER", "interview_id", "v"), "point", "lo", "hi", digits=4)


def _clusterings(s, d):
    seg = segments(s, d)
    gold = K.mentions(seg).groupBy(F.col("segment_id").alias("item")).agg(F.max("term").alias("gold_id"))
    system = K.mentions(seg).groupBy(F.col("segment_id").alias("item")).agg(F.max("place").alias("sys_id"))
    return gold, system, K.voices(seg).withColumnRenamed("segment_id", "item")


def cluster_tears(s, d):
    return _round(O.merges_and_splits(*_clusterings(s, d)), "split_rate", "size_mean", digits=5)


def cluster_merges(s, d):
    return O.merged_pairs(*_clusterings(s, d)[:2])


def changed_maps(s, d):
    """How many terms each rank has in a shuffled, a collapsed and a completed rank map."""
    m = maps(s, d)
    a, b = (m.filter(F.col("map_name") == x).select("term", "cell_rank") for x in ("R-A", "R-B"))
    some = a.filter(F.substring(F.md5("term"), 1, 1) < "8")
    out = None
    for name, x in (("shuffled", O.shuffled_map(a)), ("collapsed", O.collapsed_map(a)), ("completed", O.completed_map(some, b))):
        one = x.select(F.lit(name).alias("map_name"), "term", "cell_rank")
        out = one if out is None else out.unionByName(one)
    return out


def moment_spread(s, d):
    """How far the moments of one narrator differ, by shared and by their own vectors."""
    seg, cx = complex_of(s, d)
    members = cx.members.filter("granularity = 'mid' and cell_rank = 1")
    f = FE.cell_features(members, FE.narrator_vectors(K.voices(seg), _segment_vectors(s, d))).filter("cell_rank = 1")
    own = O.spread_within_narrators(O.own_vectors(f, _segment_vectors(s, d)), members)
    shared = O.spread_within_narrators(f, members).select("narrator", F.round("spread", 6).alias("shared"))
    return own.join(shared, "narrator").select("narrator", "n", "shared", F.round("spread", 4).alias("own"))


def transcript_turns(s, d):
    """Turns of each chunk of a transcript with their offsets in its plain text."""
    t = table(s, d, "transcripts").filter("interview_id is not null and html is not null").select("interview_id", "chunk_no", T.canonical_text(F.col("html")).alias("t")).distinct()
    t = t.groupBy(F.concat_ws("#", "interview_id", F.coalesce(F.col("chunk_no").cast("string"), F.lit(""))).alias("chunk")).agg(F.max("t").alias("t"))
    return O.cut_turns(t, "chunk", "t").select("chunk", "turn_no", "speaker_tag", "segment_no", "char_start", "char_end", F.md5("raw").alias("raw_md5"))


_FNS = (item_outcomes, outcome_strata, role_gap, cluster_tears, cluster_merges, changed_maps, moment_spread, transcript_turns, narrator_features, permitted_features, cell_text_features, complex_features, rank_study_labels, rank_study_consensus, rank_study_alphas, rank_study_sample, term_usage, traced_numbers, event_payload, formatted_numbers, cleaned_speech, turn_length_bca, role_order, size_rank_information, turn_variance, role_sign_flips, role_advantage, role_table, role_length_interaction, negatives_labelled, negatives_motif_or_uniform, betti_permutation, betti_explanation, resampled_betti, narrator_encodings, triage_grid, false_singletons)
QUERIES = {f.__name__: f for f in _FNS}

_VEC = "v AS (SELECT vec_id AS id, embedding AS vec FROM embeddings), sv AS (SELECT segment_id, vec FROM seg JOIN v ON v.id = ('0x' || substr(md5(segment_id), 1, 8))::BIGINT % (SELECT count(*) FROM v))"
_MEAN = "{n} AS (SELECT {k}, list(m ORDER BY pos) AS vec, max(c) AS n FROM (SELECT {k}, pos, avg(x) AS m, count(*) AS c FROM (SELECT {k}, unnest(vec) AS x, unnest(range(len(vec))) AS pos FROM {f}) GROUP BY ALL) GROUP BY ALL)"
_TOLD = "round(vec[1], 4) + 0 AS x0, round(vec[2], 4) + 0 AS x1, round(vec[3], 4) + 0 AS x2, round(list_sum(vec), 3) + 0 AS total"
_UNIT = "(SELECT {k}, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS vec FROM {n})"
_LEAF = "string_split(term, ' -- ')[-1]"
_LISTED = "len(list_intersect(list_distinct(regexp_extract_all(lower({leaf}), '[a-z]+')), [{names}]))"
_SITES = _LISTED.format(leaf=_LEAF, names=", ".join(f"'{w}'" for w in SITE)) + f" + regexp_matches({_LEAF}, '\\b(\\d{{2,4}}(st|nd|rd|th)\\b|[A-Z]{{3,}}\\b|\\b(19|20)\\d{{2}}\\b)')::INT"
_PROGRAMMES = _LISTED.format(leaf=_LEAF, names=", ".join(f"'{w}'" for w in PROGRAMME))
_PRACTICE = "CASE WHEN depth <= 2 THEN 3 ELSE 2 END"
_STUDY = f"""{_TREE}, base AS (SELECT term, depth, n_segments, term IN (SELECT parent FROM tree) AS broad, {_SITES} AS n_site, {_PROGRAMMES} AS n_prog FROM terms),
study AS (SELECT r AS label_round, 'structure' AS annotator, term, CASE WHEN broad OR (r = 2 AND depth <= 1) THEN 3 ELSE 2 END AS label_rank FROM base, (SELECT unnest([1, 2]) AS r)
  UNION ALL SELECT r, 'words', term, CASE WHEN n_site > n_prog THEN 2 WHEN n_prog > n_site THEN 3 ELSE {_PRACTICE} END FROM base, (SELECT unnest([1, 2]) AS r)
  UNION ALL SELECT r, 'usage', term, {_PRACTICE} FROM base, (SELECT unnest([1, 2]) AS r))"""
_STRATA = "strata AS (SELECT term, CASE WHEN n_segments <= 2 THEN 'rare_1_2' WHEN i < n // 3 THEN 'head' WHEN i < 2 * (n // 3) THEN 'middle' ELSE 'tail' END AS stratum FROM (SELECT term, n_segments, row_number() OVER (ORDER BY n_segments DESC, term) - 1 AS i, count(*) OVER () AS n FROM terms))"
_Q1000 = "quantile_cont(length(raw), list_transform(range(0, 1000), lambda i: i / 999.0))"
_HASH = "('0x' || substr(md5('{}|' || {}), 1, 12))::BIGINT"
_UNI = f"""nn AS (SELECT narrator, row_number() OVER (ORDER BY narrator) - 1 AS i FROM ground), nc AS (SELECT count(*) AS n FROM nn),
tried AS (SELECT cid, draw, t, {_HASH.format(0, "cid || '|' || draw || '|' || t")} % (SELECT n FROM nc) AS i FROM want, (SELECT unnest(range(8)) AS t)),
fnd AS (SELECT cid, draw, arg_min(narrator, t) AS negative FROM tried JOIN nn USING (i) WHERE NOT EXISTS (SELECT 1 FROM m2 WHERE m2.cid = tried.cid AND m2.narrator = nn.narrator) GROUP BY 1, 2),
rst AS (SELECT cid, draw FROM want EXCEPT SELECT cid, draw FROM fnd),
gaps AS (SELECT cid, i - (row_number() OVER (PARTITION BY cid ORDER BY i) - 1) AS before, count(*) OVER (PARTITION BY cid) AS s FROM (SELECT DISTINCT cid, i FROM m2 JOIN nn USING (narrator))),
aim AS (SELECT DISTINCT cid, draw, {_HASH.format(0, "cid || '|' || draw")} % ((SELECT n FROM nc) - s) AS g FROM rst JOIN gaps USING (cid) WHERE (SELECT n FROM nc) > s),
uni AS (SELECT * FROM fnd UNION ALL SELECT cid, draw, narrator FROM (SELECT cid, draw, g + count(*) FILTER (before <= g) AS i FROM aim JOIN gaps USING (cid) GROUP BY cid, draw, g) JOIN nn USING (i))"""
_WALK = """co AS (SELECT DISTINCT x.narrator AS a, y.narrator AS b FROM m2 x JOIN m2 y ON x.cid = y.cid AND x.narrator <> y.narrator),
w0 AS (SELECT cid, arg_min(narrator, md5('0|' || cid || '|' || narrator)) AS narrator FROM m2 GROUP BY 1),
w1 AS (SELECT cid, arg_min(b, md5('1|' || cid || '|' || b)) AS narrator FROM w0 JOIN co ON a = narrator GROUP BY 1),
w2 AS (SELECT cid, arg_min(b, md5('2|' || cid || '|' || b)) AS narrator FROM w1 JOIN co ON a = narrator GROUP BY 1),
w3 AS (SELECT cid, arg_min(b, md5('3|' || cid || '|' || b)) AS narrator FROM w2 JOIN co ON a = narrator GROUP BY 1),
walked AS (SELECT cid, narrator AS negative FROM w3 ANTI JOIN m2 USING (cid, narrator))"""
_ROLES = f"{_TURN}, u AS (SELECT * FROM t WHERE raw IS NOT NULL)"

_CLUSTERED = "gd AS (SELECT segment_id AS item, max(term) AS g FROM mention GROUP BY 1), sy AS (SELECT segment_id AS item, max(place) AS s FROM mention GROUP BY 1), o AS (SELECT g, s, count(*) AS n FROM gd JOIN sy USING (item) GROUP BY 1, 2)"
_CORRECT = f"{_SC}, oc AS (SELECT *, ((score >= quantile_cont(score, 0.5) OVER (PARTITION BY cell)) = (y = 1))::INT AS correct FROM sc)"

ORACLE = {
    "item_outcomes": f"WITH {_CORRECT} SELECT id, cell, y, score, correct FROM oc",
    "outcome_strata": f"""WITH {_CORRECT}, su AS (SELECT y, id % 97 AS unit, sum(correct)::DOUBLE AS s, count(*) AS n FROM oc GROUP BY ALL), sw AS (SELECT y, r, s, n, {_poisson_sql(_PLACE.format("'0|' || r || '|' || unit"))} AS w FROM su, (SELECT unnest(range(1, 2001)) AS r)),
      sm AS (SELECT y, r, sum(w * s) / nullif(sum(w * n), 0) AS m FROM sw GROUP BY 1, 2), sq AS (SELECT y, round(quantile_cont(m, 0.025), 4) AS lo, round(quantile_cont(m, 0.975), 4) AS hi FROM sm GROUP BY 1)
      SELECT y, round(sum(s) / sum(n), 4) AS mean, any_value(lo) AS lo, any_value(hi) AS hi, sum(n)::BIGINT AS n_rows, count(*) AS n_units FROM su JOIN sq USING (y) GROUP BY 1""",
    "role_gap": f"""WITH {_ROLES}, p AS (SELECT role_gold AS side, interview_id AS i, avg(length(raw)) AS v FROM u WHERE interview_id IS NOT NULL AND role_gold IN ('NARRATOR', 'INTERVIEWER') GROUP BY 1, 2),
      w AS (SELECT r, side, v, CASE WHEN r = 0 THEN 1 ELSE {_poisson_sql(_PLACE.format("'0|' || r || '|' || side || '|' || i"))} END AS w FROM p, (SELECT unnest(range(0, 10001)) AS r)),
      d AS (SELECT r, sum(w * v) FILTER (side = 'NARRATOR') / nullif(sum(w) FILTER (side = 'NARRATOR'), 0) - sum(w * v) FILTER (side = 'INTERVIEWER') / nullif(sum(w) FILTER (side = 'INTERVIEWER'), 0) AS d FROM w GROUP BY 1)
      SELECT round(max(d) FILTER (r = 0), 4) AS point, round(quantile_cont(d, 0.025) FILTER (r > 0), 4) AS lo, round(quantile_cont(d, 0.975) FILTER (r > 0), 4) AS hi, (SELECT min(c) FROM (SELECT count(*) AS c FROM p GROUP BY side)) AS n_replicates FROM d""",
    "cluster_tears": f"""WITH {SEG}, {_CLUSTERED}, k AS (SELECT g, count(*) AS k FROM o GROUP BY 1), a AS (SELECT g, count(DISTINCT narrator) AS a FROM gd JOIN voice ON segment_id = item GROUP BY 1), p AS (SELECT g, coalesce(k, 0) AS k, coalesce(a, 0) AS a FROM (SELECT DISTINCT g FROM gd) LEFT JOIN k USING (g) LEFT JOIN a USING (g))
      SELECT CASE WHEN a < 1 THEN '0' WHEN a <= 1 THEN '1' WHEN a <= 3 THEN '2-3' WHEN a <= 10 THEN '4-10' WHEN a <= 50 THEN '11-50' ELSE '51+' END AS band, count(*) AS n, round(avg((k >= 2)::INT), 5) AS split_rate, round(avg(a), 5) AS size_mean FROM p GROUP BY 1""",
    "cluster_merges": f"WITH {SEG}, {_CLUSTERED}, m AS (SELECT s, count(*) AS k FROM o GROUP BY 1) SELECT (SELECT coalesce(sum(k * (k - 1) // 2), 0) FROM m)::BIGINT AS n_merged, (SELECT count(DISTINCT g) * (count(DISTINCT g) - 1) // 2 FROM gd) AS n_comparable",
    "changed_maps": f"""WITH {SEG}, {_MAPS}, a AS (SELECT term, cell_rank FROM maps WHERE map_name = 'R-A'), b AS (SELECT term, cell_rank FROM maps WHERE map_name = 'R-B'), t AS (SELECT term, row_number() OVER (ORDER BY term) AS i FROM a), k AS (SELECT cell_rank, row_number() OVER (ORDER BY md5('0|' || term), term) AS i FROM a)
      SELECT 'shuffled' AS map_name, term, cell_rank FROM t JOIN k USING (i) UNION ALL SELECT 'collapsed', term, 2 FROM a UNION ALL SELECT 'completed', term, CASE WHEN substr(md5(term), 1, 1) < '8' THEN a.cell_rank ELSE b.cell_rank END FROM a JOIN b USING (term)""",
    "moment_spread": f"""WITH {CX}, {_VEC}, one AS (SELECT cid, max(narrator) AS narrator FROM mem WHERE granularity = 'mid' AND cell_rank = 1 GROUP BY 1 HAVING count(*) = 1), x AS (SELECT narrator, cid, unnest(vec) AS x, unnest(range(len(vec))) AS pos FROM one JOIN sv ON segment_id = cid)
      SELECT narrator, max(n) AS n, 0::DOUBLE AS shared, round(max(r), 4) AS own FROM (SELECT narrator, pos, max(x) - min(x) AS r, count(DISTINCT cid) AS n FROM x GROUP BY 1, 2) GROUP BY 1 HAVING max(n) > 1""",
    "narrator_features": f"WITH {SEG}, {_VEC}, x AS (SELECT narrator, vec FROM voice JOIN sv USING (segment_id)), {_MEAN.format(n='y', k='narrator', f='x')} SELECT narrator, n, false AS fallback, {_TOLD} FROM y",
    "permitted_features": f"""WITH {SEG}, {_VEC}, p AS (SELECT *, substr(md5(segment_id || '|' || narrator), 1, 1) < '4' AS ok FROM voice), q AS (SELECT *, NOT bool_or(ok) OVER (PARTITION BY narrator) AS fallback FROM p),
      x AS (SELECT narrator, fallback, vec FROM q JOIN sv USING (segment_id) WHERE ok OR fallback), {_MEAN.format(n='y', k='narrator, fallback', f='x')} SELECT narrator, n, fallback, {_TOLD} FROM y""",
    "cell_text_features": f"WITH {MID}, {_VEC}, x AS (SELECT cid, vec FROM (SELECT DISTINCT cid, segment_id FROM sup WHERE granularity = 'mid' AND cell_rank = 2) JOIN sv USING (segment_id)), {_MEAN.format(n='y', k='cid', f='x')} SELECT cid, {_TOLD} FROM {_UNIT.format(k='cid', n='y')}",
    "complex_features": f"""WITH {CX}, {_VEC}, x AS (SELECT narrator, vec FROM voice JOIN sv USING (segment_id)), {_MEAN.format(n='y', k='narrator', f='x')}, z AS (SELECT cell_rank, cid, vec FROM mem JOIN y USING (narrator) WHERE granularity = 'mid'), {_MEAN.format(n='c', k='cell_rank, cid', f='z')}
      SELECT cell_rank, cid, round(vec[1], 4) + 0 AS x0, round(vec[2], 4) + 0 AS x1, round(vec[3], 4) + 0 AS x2, round(list_sum(vec) + 1, 3) + 0 AS total FROM (SELECT cell_rank, cid, vec FROM c UNION ALL SELECT 0, narrator, vec FROM y)""",
    "rank_study_labels": f"WITH {SEG}, {_STUDY} SELECT * FROM study",
    "rank_study_consensus": f"""WITH {SEG}, {_STUDY}, c AS (SELECT term, n_segments, count(*) FILTER (label_rank = 3) AS h, count(*) AS n FROM study JOIN terms USING (term) WHERE label_round = 2 GROUP BY ALL),
      d AS (SELECT term, CASE WHEN 2 * h > n THEN 3 ELSE 2 END AS consensus, h > 0 AND h < n AS disputed, CASE WHEN h > 0 AND h < n THEN row_number() OVER (PARTITION BY h > 0 AND h < n ORDER BY n_segments DESC, term) END AS place FROM c)
      SELECT term, consensus, disputed, place, CASE WHEN place <= 20 THEN 5 - consensus ELSE consensus END AS adversarial FROM d""",
    "rank_study_sample": f"WITH {SEG}, {_STRATA} SELECT term, stratum FROM strata QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY md5('0|' || term), term) <= 100 // (SELECT count(DISTINCT stratum) FROM strata)",
    "term_usage": f"WITH {SEG} SELECT term, segment_id FROM (SELECT DISTINCT term, segment_id FROM mention) QUALIFY row_number() OVER (PARTITION BY term ORDER BY md5('0|' || term || '|' || segment_id), segment_id) <= 24",
    "traced_numbers": """WITH c AS (SELECT p_partkey, round(p_retailprice, 1) AS v FROM part), x AS (SELECT DISTINCT l_extendedprice / l_quantity AS x FROM lineitem WHERE l_quantity > 0), u AS (SELECT DISTINCT v FROM c),
      hit AS (SELECT DISTINCT v FROM u JOIN x ON x.x > v - 0.1 AND x.x < v + 0.1 WHERE abs(x.x - v) < 0.05 UNION SELECT v FROM u JOIN x ON x.x > v / 100 - 0.001 AND x.x < v / 100 + 0.001 WHERE abs(x.x - v / 100) < 0.0005) SELECT p_partkey, v IN (SELECT v FROM hit) AS traced FROM c""",
    "event_payload": "SELECT event_id, json_extract(props, '$.k')::INT AS k FROM events",
    "formatted_numbers": "SELECT interview_id, format('{:,}', max(transcript_chars)) AS chars, printf('%.1f', max(n_segments) / 61 * 100) || '%' AS share, CASE WHEN max(n_segments) > 10 THEN 'yes' WHEN max(n_segments) IS NULL THEN NULL ELSE 'no' END AS long, printf('%.2f', max(n_segments) / 4) AS quarter FROM interviews WHERE interview_id IS NOT NULL AND transcript_chars > 0 GROUP BY 1",
    "role_order": f"""WITH {_ROLES}, q AS (SELECT role_gold AS g, count(*) AS n, {_Q1000} AS qs FROM u WHERE role_gold IS NOT NULL GROUP BY 1), k AS (SELECT count(*) AS k FROM q),
      z AS (SELECT a.g AS a, b.g AS b, least(a.n, b.n) AS n, unnest(b.qs) - unnest(a.qs) AS d, unnest(range(0, 1000)) AS i FROM q a JOIN q b ON a.g <> b.g), w AS (SELECT *, CASE WHEN i IN (0, 999) THEN 0.5 ELSE 1 END AS w FROM z)
      SELECT a, b, CASE WHEN max(n) >= 2 THEN round(coalesce(coalesce(sum(w * d * d) FILTER (d > 0), 0) / nullif(sum(w * d * d), 0), 0.5), 6) END AS ratio, round(1 - 0.05 / (SELECT k * (k - 1) FROM k), 6) AS level FROM w GROUP BY 1, 2""",
    "size_rank_information": f"WITH {CX}, c AS (SELECT size, cell_rank, count(*)::DOUBLE AS c FROM sizes WHERE granularity = 'mid' GROUP BY ALL), w AS (SELECT *, sum(c) OVER (PARTITION BY size) AS a, sum(c) OVER (PARTITION BY cell_rank) AS b, sum(c) OVER () AS n FROM c) SELECT max(n)::BIGINT AS n, round(sum(c / n * ln(c * n / (a * b))), 6) AS nats FROM w",
    "turn_variance": f"""WITH {_ROLES}, p AS (SELECT narrator, avg(length(raw)) AS m, var_samp(length(raw)) AS v, count(DISTINCT interview_id) AS k FROM u WHERE narrator IS NOT NULL AND interview_id IS NOT NULL GROUP BY 1)
      SELECT count(*) AS n_partitions, round(avg(m), 4) AS mean, round(stddev_samp(m), 4) AS sd, min(m) AS least, max(m) AS most, count(*) FILTER (m < 0) AS n_negative, count(*) FILTER (m > 0) AS n_positive, round(var_samp(m), 4) AS observed, round(avg(v), 4) AS within,
        round(var_samp(m) - avg(v) / avg(k), 4) AS component, round((var_samp(m) - avg(v) / avg(k)) / var_samp(m), 4) AS share FROM p""",
    "role_sign_flips": f"WITH {_ROLES}, w AS (SELECT interview_id, avg(length(raw) - 150) FILTER (role_gold = 'NARRATOR') AS a, avg(length(raw) - 150) FILTER (role_gold = 'INTERVIEWER') AS b FROM u GROUP BY 1) SELECT count(*) AS n, count(*) FILTER ((a < 0) <> (b < 0)) AS n_flips FROM w WHERE a IS NOT NULL AND b IS NOT NULL",
    "role_advantage": f"WITH {_ROLES}, w AS (SELECT narrator, count(*) AS n_rows, avg(length(raw)) FILTER (role_gold = 'NARRATOR') AS a, avg(length(raw)) FILTER (role_gold = 'INTERVIEWER') AS b FROM u WHERE narrator IS NOT NULL AND role_gold IN ('NARRATOR', 'INTERVIEWER') GROUP BY 1) SELECT narrator, n_rows, round(a - b, 4) AS advantage FROM w WHERE a IS NOT NULL AND b IS NOT NULL",
    "role_table": f"WITH {_ROLES} SELECT interview_id, " + ", ".join(f"round(avg(length(raw)) FILTER (role_gold = '{r}'), 4) AS {r.lower()}_mean, round(stddev_samp(length(raw)) FILTER (role_gold = '{r}'), 4) AS {r.lower()}_sd, (count(*) FILTER (role_gold = '{r}'))::DOUBLE AS {r.lower()}_n" for r in ("NARRATOR", "INTERVIEWER")) + " FROM u WHERE interview_id IS NOT NULL GROUP BY 1",
    "negatives_labelled": f"WITH {MID}, want AS (SELECT cid, unnest(range(10 * count(*))) AS draw FROM m2 GROUP BY 1), {_UNI} SELECT cid, 1 AS label, count(*) AS n FROM m2 GROUP BY 1 UNION ALL SELECT cid, 0, count(*) FROM uni GROUP BY 1",
    "negatives_uniform": f"WITH {MID}, want AS (SELECT DISTINCT cid, unnest(range(2)) AS draw FROM m2), {_UNI} SELECT cid, draw, negative FROM uni",
    "negatives_size_matched": f"WITH {MID}, want AS (SELECT cid, unnest(range(count(*))) AS draw FROM m2 GROUP BY 1), {_UNI} SELECT cid, arg_min(negative, md5('0|' || cid || '|' || negative)) AS negative FROM uni GROUP BY 1",
    "negatives_motif": f"WITH {MID}, {_WALK} SELECT cid, negative FROM walked",
    "negatives_motif_or_uniform": f"WITH {MID}, {_WALK}, want AS (SELECT DISTINCT cid, 0 AS draw FROM m2 ANTI JOIN walked USING (cid)), {_UNI} SELECT cid, negative FROM walked UNION ALL SELECT cid, negative FROM uni",
    "betti_permutation": f"SELECT curve, area::DOUBLE AS observed, area::DOUBLE AS null_mean, 0::DOUBLE AS null_sd, 1::DOUBLE AS p_value, 1000 AS draws, true AS degenerate FROM ({_EVALUATED['persistence']})",
}
