"""Queries over splits, negatives, rankings, agreement, statistics, graphs, vectors and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from rungwork.functions import text as T
from rungwork.operators import agreement as A
from rungwork.operators import alignment as AL
from rungwork.operators import complexes as C
from rungwork.operators import corpus as K
from rungwork.operators import graph as G
from rungwork.operators import near_duplicates as N
from rungwork.operators import negatives as NEG
from rungwork.operators import perturb as P
from rungwork.operators import ranking as R
from rungwork.operators import splits as S
from rungwork.operators import statistics as ST
from rungwork.operators import vectors as V
from rungwork.operators.skew import last_in_blocks, number_rows, salted_join
from rungwork.plans.prelude import MID, SEG, complex_of, keys, segments, sizes_of, sq, term
from rungwork.plans.structure import _LATEST, _round
from rungwork.session import materialize, table
from rungwork.sources.readers import numbers_in_json


def _mid(s, d):
    seg, cx = complex_of(s, d)
    at = (F.col("granularity") == "mid") & (F.col("cell_rank") == 2)
    return seg, cx.members.filter(at).select("cid", "narrator"), cx.supports.filter(at).select("cid", "segment_id"), cx.ground


# splits


def make_split(s, d):
    return S.make_split(segments(s, d).select(F.col("segment_id").alias("unit")))


def stored_splits(s, d):
    t, out = table(s, d, "splits"), None
    for kind in ("random", "narrator-disjoint", "event-disjoint"):
        part = S.stored_split(t, kind).groupBy("bucket").agg(F.count(F.lit(1)).alias("n_units")).select(F.lit(kind).alias("split_kind"), "bucket", "n_units")
        out = part if out is None else out.unionByName(part)
    return out


def _pairs(s, d):
    return materialize(_mid(s, d)[1].withColumn("pair", F.concat_ws("|", "cid", "narrator")))


def _routed(pairs, unit):
    return S.partition_incidences(pairs, S.make_split(pairs.select(F.col(unit).alias("unit"))), unit)


def partition_incidences(s, d):
    return _routed(_pairs(s, d), "narrator").select("cid", "narrator", "bucket")


def split_straddle(s, d):
    """Straddling narrators where splits are by narrator, by cell and by incidence, all in one pass."""
    kinds = F.array(*[F.struct(F.lit(k).alias("unit"), F.col(c).alias("value")) for k, c in (("narrator", "narrator"), ("cid", "cid"), ("pair", "pair"))])
    stacked = materialize(_mid(s, d)[1].withColumn("pair", F.concat_ws("|", "cid", "narrator")).select("narrator", F.explode(kinds).alias("x")).select("narrator", "x.*"))
    split = S.make_split(stacked.select("unit", "value"), "value", by="unit")
    return _round(S.straddle(stacked.join(split, ["unit", "value"]), ("unit",)), "share")


def exposure_law(s, d):
    return _round(S.exposure_law(_mid(s, d)[1]), "k_mean", "k_one", "exposure", "exposure_two_folds")


def training_pairs(s, d):
    seg, m, sup, _ = _mid(s, d)
    routed = S.partition_incidences(m, S.make_split(m.select(F.col("cid").alias("unit"))), "cid")
    return S.training_pairs(routed.filter("bucket <> 'train'"), sup, K.voices(seg))


# negatives


def negatives_uniform(s, d):
    _, m, _, ground = _mid(s, d)
    return NEG.uniform(m, m, ground, draws=2)


def negatives_size_matched(s, d):
    _, m, _, ground = _mid(s, d)
    return NEG.size_matched(m, ground)


def negatives_motif(s, d):
    _, m, _, _ = _mid(s, d)
    return NEG.motif(m, G.both_ways(G.cowitness(m)))


def negatives_clique(s, d):
    _, m, _, _ = _mid(s, d)
    return NEG.clique(m)


def negatives_hard(s, d):
    _, m, _, _ = _mid(s, d)
    return NEG.hardest_by_company(m)


# retrieval


def _vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("vec"))


def retrieval_cosine(s, d):
    v = _vectors(s, d)
    return _round(R.retrieval_metrics(R.positive_places(v.filter("id % 50 = 0"), v)), "ap", "ndcg", "recall", "rr", digits=5)


def dense_pair_scores(s, d):
    v = _vectors(s, d)
    centre = V.mean_vectors(v, ["label"], "vec").select(F.col("label").alias("cell"), F.col("vec").alias("cell_vec"))
    q = v.filter("id % 50 = 0")
    return q.crossJoin(F.broadcast(centre)).select("id", "cell", F.round(V.dot(V.normalised(F.col("vec")), V.normalised(F.col("cell_vec"))), 5).alias("score"))


def _scored(s, d):
    v = _vectors(s, d)
    centre = V.mean_vectors(v, ["label"], "vec").select(F.col("label").alias("cell"), F.col("vec").alias("cv"))
    both = v.select("id", "label", "vec").crossJoin(F.broadcast(v.agg((F.max("label") + 1).alias("n")))).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    both = both.withColumn("cell", F.pmod(F.col("label") + F.col("k"), F.col("n")).cast("int"))
    return both.join(centre, "cell").select("id", "cell", (F.col("k") == 0).cast("int").alias("y"), F.round(V.dot(V.normalised(F.col("vec")), V.normalised(F.col("cv"))), 6).alias("score"))


def link_auc(s, d):
    return _round(R.auc(_scored(s, d), ["cell"], "y", "score"), "auc_roc", "auc_pr", digits=5)


def link_ranking(s, d):
    return _round(R.group_ranking(_scored(s, d), "id", "y", "score", "cell"), "mrr", "hits1", "hits5", "hits10", digits=5)


def cell_retrieval_queries(s, d):
    """Per segment with events: its first narrator, and how many other segments of its events share no narrator with it."""
    seg, _, sup, _ = _mid(s, d)
    who = seg.select("segment_id", "narrators")
    x = sup.join(who, "segment_id").select("cid", F.col("segment_id").alias("q"), F.col("narrators").alias("nq"))
    y = sup.join(who, "segment_id").select("cid", F.col("segment_id").alias("p"), F.col("narrators").alias("np"))
    pos = salted_join(x, y, "cid").filter((F.col("q") != F.col("p")) & ~F.arrays_overlap("nq", "np")).select("q", "p", "nq").distinct()
    return pos.groupBy("q").agg(F.first(F.get("nq", F.lit(0))).alias("narrator"), F.count(F.lit(1)).alias("n_positives"))


def _triage_lists(s, d):
    return materialize(C.triage_referents(sizes_of(s, d)).select(F.col("granularity").alias("list_id"), "pos", F.col("referent").alias("item")))


def rank_biased_overlap(s, d):
    lists, out = _triage_lists(s, d), None
    for p in (0.8, 0.9, 0.95):
        part = _round(R.rank_biased_overlap(lists, p), "rbo").withColumn("p", F.lit(p))
        out = part if out is None else out.unionByName(part)
    return out


def jaccard_at(s, d):
    lists, out = _triage_lists(s, d), None
    for k in (10, 25, 50):
        part = _round(R.jaccard_at(lists, k), "jaccard").withColumn("k", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


# agreement


def _labels(s, d):
    return K.latest_labels(table(s, d, "term_labels")).filter("label_round = 2").select("annotator", F.col("term").alias("item"), F.col("label_rank").alias("label"))


def label_confusion(s, d):
    return A.confusion(_labels(s, d))


def agreement_diagnostics(s, d):
    return _round(A.diagnostics(_labels(s, d)), "unanimity", "pairwise", "fleiss_kappa", "gwet_ac1", "skew")


def ordinal_alpha(s, d):
    both = K.latest_labels(table(s, d, "term_labels")).select("annotator", F.col("term").alias("item"), F.col("label_rank").alias("label"), "label_round")
    return _round(A.ordinal_alpha(both, ["label_round"]), "alpha")


def dispute_kinds(s, d):
    return A.dispute_kinds(_labels(s, d)).groupBy("kind").agg(F.count(F.lit(1)).alias("n_terms"))


# statistics


def design_effect(s, d):
    t = table(s, d, "turns").dropDuplicates(["turn_id"]).select("narrator", F.length("raw").alias("v"))
    return _round(ST.design_effect(t.filter("narrator is not null"), "narrator", "v"), "mean_size", "icc", "deff", digits=4)


def turn_length_bootstrap(s, d):
    t = table(s, d, "turns").dropDuplicates(["turn_id"]).select("narrator", F.length("raw").alias("v")).filter("narrator is not null")
    return _round(ST.bootstrap_mean(t, "narrator", "v"), "mean", "lo", "hi", "se", digits=4)


def singleton_interval(s, d):
    return _round(ST.subsample_singletons(_mid(s, d)[1]), "point", "se", "lo", "hi", digits=4)


def size_ks(s, d):
    sizes = sizes_of(s, d).filter("cell_rank = 2")
    return _round(ST.ks_distance(sizes.filter("granularity = 'mid'"), sizes.filter("granularity = 'fine'"), "size"), "ks")


def violation_ratio(s, d):
    t = table(s, d, "turns").dropDuplicates(["turn_id"]).select("role_gold", F.length("raw").alias("v"))
    return _round(ST.violation_ratio(t, "role_gold", "NARRATOR", "INTERVIEWER", "v"), "ratio")


def size_slope(s, d):
    sizes = sizes_of(s, d).filter("cell_rank = 2 and granularity = 'mid'").select(F.log1p("n_segments").alias("x"), F.col("size").cast("double").alias("y"))
    return _round(ST.slope_hc3(sizes, "x", "y"), "intercept", "slope", "se", digits=5)


def clustering_scores(s, d):
    seg = segments(s, d)
    gold = K.mentions(seg).groupBy(F.col("segment_id").alias("item")).agg(F.max("term").alias("gold_id"))
    system = K.mentions(seg).groupBy(F.col("segment_id").alias("item")).agg(F.max(K.referent(F.col("term"), 1)).alias("sys_id"))
    names = [f"{m}_{x}" for m in ("muc", "b3", "lea") for x in ("precision", "recall")]
    return _round(ST.clustering_scores(gold, system), *names)


def ceaf(s, d):
    seg = segments(s, d)
    gold = K.mentions(seg).groupBy(F.col("segment_id").alias("item")).agg(F.max("term").alias("gold_id"))
    system = K.mentions(seg).groupBy(F.col("segment_id").alias("item")).agg(F.max(K.referent(F.col("term"), 1)).alias("sys_id"))
    return _round(AL.ceaf(gold, system), "precision", "recall", "total")


def linkage_sweep(s, d):
    """Average-linkage clusters of all vectors at thirteen thresholds: clusters and the size of the largest."""
    v = _vectors(s, d).withColumn("_all", F.lit(1))
    found = AL.cluster_by_similarity(v, ["_all"], "id", "vec", [round(0.3 + 0.05 * i, 2) for i in range(13)])
    sizes = found.groupBy("threshold", "cluster").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("threshold").agg(F.count(F.lit(1)).alias("n_clusters"), F.max("n").alias("largest"))


def role_length_did(s, d):
    t = table(s, d, "turns").dropDuplicates(["turn_id"]).filter("narrator is not null and role_gold is not null")
    return _round(ST.difference_in_differences(t.select("narrator", "role_gold", F.length("raw").alias("a"), F.lit(0).alias("b")), "narrator", "role_gold", "NARRATOR", "a", "b"), "did", "lo", "hi", digits=4)


def anonymised_profile(s, d):
    """Segments of each narrator before and after the narrators are dealt anew."""
    v = K.voices(segments(s, d))
    after = P.anonymise(v).groupBy("narrator").agg(F.count(F.lit(1)).alias("n_after"))
    return v.groupBy("narrator").agg(F.count(F.lit(1)).alias("n_before")).join(after, "narrator", "full_outer")


def triage_stability(s, d):
    return _round(P.triage_stability(_mid(s, d)[1]), "share")


def stratified_sizes(s, d):
    sizes = sizes_of(s, d).filter("cell_rank = 2 and granularity = 'mid' and size >= 2")
    band = F.when(F.col("size") <= 3, "2-3").when(F.col("size") <= 10, "4-10").when(F.col("size") <= 50, "11-50").otherwise("51+")
    return _round(sizes.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.avg("n_segments").alias("segments_mean")), "segments_mean")


# graph


def cowitness_graph(s, d):
    return G.cowitness(_mid(s, d)[1])


def betti_curve(s, d):
    return G.filtration(_mid(s, d)[1])


def persistence(s, d):
    return G.persistence(G.filtration(_mid(s, d)[1]))


def degree_profile(s, d):
    _, m, _, ground = _mid(s, d)
    return _round(G.degree_profile(m, ground), "mean_size")


def forman_curvature(s, d):
    return _round(G.forman_curvature(G.cowitness(_mid(s, d)[1])), "curvature")


def hypergraph_laplacian(s, d):
    return _round(G.laplacian(_mid(s, d)[1]), "value")


def spectral_encoding(s, d):
    return _round(G.spectral_encoding(G.laplacian(_mid(s, d)[1])), "value", digits=4)


def error_rates(s, d):
    _, m, sup, _ = _mid(s, d)
    return _round(P.error_rates(m, sup), "merge_rate", "split_rate")


def perturbed_sizes(s, d):
    return P.perturb(_mid(s, d)[1], 0.05, 0.1).groupBy("cid").agg(F.count(F.lit(1)).alias("size"))


# vectors and learning


def label_centroids(s, d):
    m = V.mean_vectors(_vectors(s, d), ["label"], "vec")
    return m.select("label", "n", F.posexplode("vec").alias("pos", "value")).select("label", "n", "pos", F.round("value", 5).alias("value"))


def rank_features(s, d):
    m = V.mean_vectors(_vectors(s, d), ["label"], "vec").withColumn("cell_rank", F.lit(2))
    return V.rank_features(m, "vec", "cell_rank").select("label", F.size("feature").alias("width"), F.round(F.element_at("feature", -2), 3).alias("hot"), F.round(F.aggregate("feature", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


def message_passing(s, d):
    _, m, _, _ = _mid(s, d)
    names = m.select(F.col("narrator").alias("node")).distinct()
    h = names.select("node", F.array(F.lit(1.0), F.length("node").cast("double")).alias("vec")).unionByName(m.select(F.col("cid").alias("node")).distinct().select("node", F.array(F.lit(0.0), F.lit(0.0)).alias("vec")))
    out = V.propagate(h, m.select(F.col("narrator").alias("src"), F.col("cid").alias("dst")))
    return out.select("node", F.round(F.get("vec", F.lit(0)), 6).alias("x0"), F.round(F.get("vec", F.lit(1)), 6).alias("x1"))


def row_weights(s, d):
    _, m, _, _ = _mid(s, d)
    return _round(V.row_weights(m.select(F.col("narrator").alias("src"), F.col("cid").alias("dst"))), "w_fwd", "w_bwd")


def identity_probe(s, d):
    return _round(V.probe_accuracy(_vectors(s, d), "label", "vec", "id"), "accuracy", "chance", digits=4)


# texts


def clean_descriptions(s, d):
    rows = table(s, d, "segments").select("segment_id", "description").filter("segment_id is not null").distinct()
    stock = K.find_boilerplate(rows, "description").agg(F.array_sort(F.collect_list("sentence")).alias("_b"))
    return rows.crossJoin(F.broadcast(stock)).select("segment_id", T.without_sentences(T.strip_markup(F.col("description")), F.col("_b")).alias("clean"))


def turn_roles(s, d):
    t = table(s, d, "turns").dropDuplicates(["turn_id"]).filter("raw is not null")
    return _round(t.select("turn_id", T.turn_score(F.col("raw")).alias("score"), T.turn_role(F.col("raw")).alias("role")), "score")


def turn_role_evaluation(s, d):
    t = table(s, d, "turns").dropDuplicates(["turn_id"]).filter("raw is not null and role_gold in ('NARRATOR', 'INTERVIEWER')").select(F.col("role_gold").alias("g"), T.turn_role(F.col("raw")).alias("p"))
    tp, fp = F.count_if((F.col("g") == "INTERVIEWER") & (F.col("p") == "INTERVIEWER")), F.count_if((F.col("g") == "NARRATOR") & (F.col("p") == "INTERVIEWER"))
    fn, tn = F.count_if((F.col("g") == "INTERVIEWER") & (F.col("p") == "NARRATOR")), F.count_if((F.col("g") == "NARRATOR") & (F.col("p") == "NARRATOR"))
    c = t.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))
    return c.select("*", F.round((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")), 6).alias("accuracy"), F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 6).alias("recall"))


def transcript_headers(s, d):
    t = table(s, d, "transcripts").filter("chunk_no = 1").select("interview_id", T.canonical_text(F.col("html")).alias("t")).distinct()
    return t.select("interview_id", F.array_join(T.header_names(F.col("t"), "Narrator"), "|").alias("narrators"), F.array_join(T.header_names(F.col("t"), "Interviewer"), "|").alias("interviewers"), F.array_join(F.transform(T.header_names(F.col("t"), "Narrator"), T.initials), "|").alias("tags"))


def segment_marks_asof(s, d):
    """Per turn: the last segment number at or before it in its interview."""
    t = table(s, d, "turns").filter("interview_id is not null and turn_no is not null").select("interview_id", "turn_no", "segment_no").groupBy("interview_id", "turn_no").agg(F.max("segment_no").alias("segment_no"))
    return last_in_blocks(t, ["interview_id"], "turn_no", "segment_no", "segment_asof", 64).select("interview_id", "turn_no", "segment_asof")


def document_quality(s, d):
    t = table(s, d, "documents").filter("text is not null")
    return t.select("doc_id", F.size(K.split_sentences(F.col("text"))).alias("n_sentences"), F.size(T.paragraphs(F.col("text"))).alias("n_paragraphs"), F.size(T.quoted_numbers(F.col("text"))).alias("n_numbers"))


def phrase_counts(s, d):
    t = table(s, d, "documents").filter("text is not null")
    c = T.phrase_counts(F.col("text"), ["at the same time", "the same", "as a whole", "on the eve of the regatta"])
    return t.select("doc_id", c.alias("c")).agg(*[F.sum(F.get("c", F.lit(i))).alias(f"n{i}") for i in range(4)])


def near_duplicate_segments(s, d):
    t = table(s, d, "segments").filter("segment_id is not null").select("segment_id", "description")
    return N.near_duplicates(t, "segment_id", "description").select("segment_id", "n_copies", "n_links")


def near_duplicate_pairs(s, d):
    """Near-same descriptions of segments without a common narrator."""
    t = segments(s, d).select("segment_id", "narrators", "description")
    return _round(N.duplicate_pairs(t, "segment_id", "description", "narrators"), "jaccard")


def event_numbers(s, d):
    return numbers_in_json(table(s, d, "events"), "props").groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def term_ambiguity(s, d):
    """Per term a composite of z scores: rare, many siblings; the top tenth is flagged."""
    t = K.topic_terms(segments(s, d))
    sib = t.groupBy("parent").agg(F.count(F.lit(1)).alias("_c")).filter("parent is not null")
    x = t.join(sib, "parent", "left").select("term", F.log1p("n_segments").alias("f"), F.coalesce(F.col("_c") - 1, F.lit(0)).cast("double").alias("sib"))
    g = x.agg(F.avg("f").alias("fm"), F.stddev_pop("f").alias("fs"), F.avg("sib").alias("sm"), F.stddev_pop("sib").alias("ss"), F.count(F.lit(1)).alias("n"))
    z = x.crossJoin(F.broadcast(g)).select(F.lit(1).alias("_all"), "term", "n", F.round(-F.coalesce(F.try_divide(F.col("f") - F.col("fm"), F.col("fs")), F.lit(0.0)) + F.coalesce(F.try_divide(F.col("sib") - F.col("sm"), F.col("ss")), F.lit(0.0)), 6).alias("score"))
    placed = number_rows(z.withColumn("_below", -F.col("score")), ["_all"], ["_below", "term"])
    return placed.select("term", "score", (F.col("_pos") < F.greatest(F.lit(1), F.floor(F.col("n") / 10))).alias("flagged"))


def revenue_by_segment(s, d):
    """A star join of the commerce tables: filters and columns reach the scans, small sides are left to the optimizer."""
    c, o, li, n, r = (table(s, d, t) for t in ("customer", "orders", "lineitem", "nation", "region"))
    x = li.filter("l_returnflag = 'R'").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return x.groupBy("r_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


_FNS = (make_split, stored_splits, partition_incidences, split_straddle, exposure_law, training_pairs, negatives_uniform, negatives_size_matched, negatives_motif, negatives_clique, negatives_hard, retrieval_cosine, dense_pair_scores, link_auc, link_ranking, cell_retrieval_queries, rank_biased_overlap, jaccard_at, label_confusion, agreement_diagnostics, ordinal_alpha, dispute_kinds, design_effect, turn_length_bootstrap, singleton_interval, size_ks, violation_ratio, size_slope, clustering_scores, ceaf, linkage_sweep, role_length_did, anonymised_profile, triage_stability, stratified_sizes, cowitness_graph, betti_curve, persistence, degree_profile, forman_curvature, hypergraph_laplacian, spectral_encoding, error_rates, perturbed_sizes, label_centroids, rank_features, message_passing, row_weights, identity_probe, clean_descriptions, turn_roles, turn_role_evaluation, transcript_headers, segment_marks_asof, document_quality, phrase_counts, near_duplicate_segments, near_duplicate_pairs, event_numbers, term_ambiguity, revenue_by_segment)
QUERIES = {f.__name__: f for f in _FNS}

_SPLIT = "SELECT {u} AS unit, CASE WHEN i < floor(0.7 * n) THEN 'train' WHEN i < floor(0.7 * n) + floor(0.15 * n) THEN 'val' ELSE 'test' END AS bucket FROM (SELECT {u}, row_number() OVER (ORDER BY md5('0|' || {u}), {u}) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT {u} FROM {t}))"
_CW = "cw AS (SELECT x.narrator AS a, y.narrator AS b, count(*) AS weight, max(s.size) AS max_size FROM m2 x JOIN m2 y ON x.cid = y.cid AND x.narrator < y.narrator JOIN s2 s ON s.cid = x.cid GROUP BY 1, 2), cw2 AS (SELECT a, b FROM cw UNION ALL SELECT b, a FROM cw)"
_V = "v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS vec FROM embeddings), u AS (SELECT id, label, vec, sqrt(list_dot_product(vec, vec)) AS len FROM v)"
_CENT = "c0 AS (SELECT label AS cell, pos, avg(x) AS m FROM (SELECT label, unnest(vec) AS x, unnest(range(len(vec))) AS pos FROM v) GROUP BY 1, 2), c AS (SELECT cell, list(m ORDER BY pos) AS cv FROM c0 GROUP BY 1)"
_COS = "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"
_SC = f"{_V}, {_CENT}, sc AS (SELECT id, cell, (k = 0)::INT AS y, round({_COS.format(a='vec', b='cv')}, 6) AS score FROM (SELECT id, vec, k, (label + k) % (SELECT max(label) + 1 FROM v) AS cl FROM v, (SELECT unnest(range((SELECT max(label) + 1 FROM v))) AS k)) JOIN c ON c.cell = cl)"
_LAB = f"{_LATEST}, lab AS (SELECT annotator, term AS item, label_rank AS label FROM latest WHERE label_round = 2)"
_TURN = "t AS (SELECT DISTINCT ON (turn_id) * FROM turns)"
_LISTS = "o AS (SELECT granularity, array_to_string(string_split(base_term, ' -- ')[1:2], ' -- ') AS item, row_number() OVER (PARTITION BY granularity ORDER BY size, cid) AS p FROM sizes WHERE cell_rank = 2), f AS (SELECT granularity, item, min(p) AS p FROM o GROUP BY ALL), ls AS (SELECT granularity AS list_id, item, row_number() OVER (PARTITION BY granularity ORDER BY p) AS pos FROM f QUALIFY row_number() OVER (PARTITION BY granularity ORDER BY p) <= 50)"
_PLAIN = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace({}, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[\\s\\x{{00A0}}]+', ' ', 'g'))"
_WORDS = "greatest(len(list_filter(regexp_split_to_array(lower(raw), '\\s+'), lambda w: w <> '')), 1)"
_N = "len(regexp_extract_all(lower(raw), '\\b({})\\b'))"
_SCORE = f"2 * (contains(raw, '?'))::INT + 3.0 * {_N.format("you|your|yours|you''re|you''ve|did you|were you|do you")} / {_WORDS} - 3.0 * {_N.format("i|me|my|mine|we|us|our|i''m|i''ve|i''d")} / {_WORDS} + ({_WORDS} < 25)::INT - ({_WORDS} > 80)::INT"

ORACLE = {
    "make_split": f"WITH {SEG} {_SPLIT.format(u='segment_id', t='seg').replace('segment_id AS unit', 'segment_id AS unit')}",
    "stored_splits": "WITH s AS (SELECT split_kind, trim(unit) AS unit, CASE WHEN lower(trim(bucket)) IN ('validation', 'dev') THEN 'val' ELSE lower(trim(bucket)) END AS bucket FROM splits WHERE unit IS NOT NULL), o AS (SELECT split_kind, unit, min(bucket) AS bucket FROM s WHERE bucket IN ('train', 'val', 'test') GROUP BY 1, 2) SELECT split_kind, bucket, count(*) AS n_units FROM o GROUP BY 1, 2",
    "partition_incidences": f"WITH {MID}, sp AS ({_SPLIT.format(u='narrator', t='m2')}) SELECT cid, narrator, bucket FROM m2 JOIN sp ON unit = narrator",
    "split_straddle": f"WITH {MID}, p AS (SELECT *, cid || '|' || narrator AS pair FROM m2)"
    + " UNION ALL ".join(f" SELECT '{u}' AS unit, count(*) AS n_narrators, count(*) FILTER (k > 1) AS n_straddling, round(avg((k > 1)::INT), 6) AS share FROM (SELECT narrator, count(DISTINCT bucket) AS k FROM p JOIN ({_SPLIT.format(u=u, t='p')}) s ON s.unit = p.{u} GROUP BY 1)" for u in ("narrator", "cid", "pair")),
    "exposure_law": f"WITH {MID}, k AS (SELECT narrator, count(*) AS k FROM m2 GROUP BY 1) SELECT count(*) AS n_narrators, round(avg(k), 6) AS k_mean, round(avg((k = 1)::INT), 6) AS k_one, round(avg(1 - (pow(0.7, k) + pow(0.15, k) + pow(0.15, k))), 6) AS exposure, round(avg(1 - (pow(0.7, k) + pow(0.3, k))), 6) AS exposure_two_folds FROM k",
    "training_pairs": f"WITH {MID}, sp AS ({_SPLIT.format(u='cid', t='m2')}), held AS (SELECT narrator, cid FROM m2 JOIN sp ON unit = cid WHERE bucket <> 'train') SELECT DISTINCT narrator, segment_id FROM voice v WHERE NOT EXISTS (SELECT 1 FROM held h JOIN sup ON sup.cid = h.cid AND sup.granularity = 'mid' AND sup.cell_rank = 2 WHERE h.narrator = v.narrator AND sup.segment_id = v.segment_id)",
    "negatives_clique": f"""WITH {MID}, {_CW}, dr AS (SELECT cid, first(narrator ORDER BY md5('0|' || cid || '|' || narrator), narrator) AS dropped FROM m2 GROUP BY 1),
      met AS (SELECT m.cid, dr.dropped, g.b AS narrator, count(*) AS k FROM m2 m JOIN dr USING (cid) JOIN cw2 g ON g.a = m.narrator WHERE m.narrator <> dr.dropped GROUP BY ALL)
      SELECT cid, dropped, first(narrator ORDER BY md5('0|' || cid || '|' || narrator), narrator) AS negative FROM met JOIN s2 USING (cid) WHERE k = size - 1 AND size > 1 AND NOT EXISTS (SELECT 1 FROM m2 WHERE m2.cid = met.cid AND m2.narrator = met.narrator) GROUP BY ALL""",
    "negatives_hard": f"WITH {MID}, {_CW}, near AS (SELECT cid, b AS narrator, count(*) AS score FROM m2 JOIN cw2 ON a = narrator GROUP BY ALL) SELECT cid, first(narrator ORDER BY score DESC, narrator DESC) AS negative FROM near WHERE NOT EXISTS (SELECT 1 FROM m2 WHERE m2.cid = near.cid AND m2.narrator = near.narrator) GROUP BY 1",
    "retrieval_cosine": f"""WITH {_V}, s AS (SELECT q.id AS query, (q.label = i.label)::INT AS rel, row_number() OVER (PARTITION BY q.id ORDER BY round(list_dot_product(q.vec, i.vec) / (q.len * i.len), 10) DESC, i.id) AS pos FROM u q JOIN u i ON q.id <> i.id WHERE q.id % 50 = 0),
      h AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY pos) AS hits FROM s WHERE rel = 1)
      SELECT query, count(*) AS n_pos, round(sum(hits / pos) / count(*), 5) AS ap, round(coalesce(sum(1 / log2(pos + 1)) FILTER (pos <= 10), 0) / list_sum(list_transform(range(1, least(10, count(*)) + 1), lambda i: 1 / log2(i + 1))), 5) AS ndcg, round(count(*) FILTER (pos <= 50) / count(*), 5) AS recall, round(1 / min(pos), 5) AS rr FROM h GROUP BY 1""",
    "dense_pair_scores": f"WITH {_V}, {_CENT} SELECT id, cell, round({_COS.format(a='vec', b='cv')}, 5) AS score FROM v, c WHERE id % 50 = 0",
    "link_auc": f"""WITH {_SC}, r AS (SELECT cell, y, score, rank() OVER (PARTITION BY cell ORDER BY score) + (count(*) OVER (PARTITION BY cell, score) - 1) / 2.0 AS rk, sum(y) OVER (PARTITION BY cell ORDER BY score DESC) AS tp, count(*) OVER (PARTITION BY cell ORDER BY score DESC) AS n FROM sc)
      SELECT cell, round((sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 5) AS auc_roc, round(sum(y * tp / n) / sum(y), 5) AS auc_pr FROM r GROUP BY 1""",
    "link_ranking": f"WITH {_SC}, r AS (SELECT id, min(pos) FILTER (y = 1) AS f FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, cell) AS pos FROM sc) GROUP BY 1) SELECT count(*) AS n_groups, round(avg(1 / f), 5) AS mrr, round(avg((f <= 1)::INT), 5) AS hits1, round(avg((f <= 5)::INT), 5) AS hits5, round(avg((f <= 10)::INT), 5) AS hits10 FROM r",
    "cell_retrieval_queries": f"WITH {MID}, x AS (SELECT cid, s.segment_id, narrators FROM sup s JOIN seg USING (segment_id) WHERE granularity = 'mid' AND cell_rank = 2) SELECT q.segment_id AS q, any_value(q.narrators[1]) AS narrator, count(DISTINCT p.segment_id) AS n_positives FROM x q JOIN x p ON q.cid = p.cid AND q.segment_id <> p.segment_id WHERE NOT list_has_any(q.narrators, p.narrators) GROUP BY 1",
    "jaccard_at": f"WITH {MID}, {_LISTS}, l AS (SELECT k, list_id, list(item) AS s FROM ls, (SELECT unnest([10, 25, 50]) AS k) WHERE pos <= k GROUP BY ALL) SELECT a.list_id AS list_a, b.list_id AS list_b, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) AS jaccard, a.k FROM l a JOIN l b ON a.k = b.k AND a.list_id < b.list_id",
    "rank_biased_overlap": f"""WITH {MID}, {_LISTS}, n AS (SELECT list_id, max(pos) AS n FROM ls GROUP BY 1), dd AS (SELECT a.list_id AS la, b.list_id AS lb, unnest(range(1, greatest(a.n, b.n) + 1)) AS dp, greatest(a.n, b.n) AS k FROM n a JOIN n b ON a.list_id < b.list_id),
      x AS (SELECT la, lb, dp, k, (SELECT count(*) FROM ls p JOIN ls q ON p.item = q.item WHERE p.list_id = la AND q.list_id = lb AND p.pos <= dp AND q.pos <= dp) AS x FROM dd)
      SELECT la AS list_a, lb AS list_b, round(sum((1 - p) * pow(p, dp - 1) * x / dp) + max(CASE WHEN dp = k THEN pow(p, k) * x / k END), 6) AS rbo, p FROM x, (SELECT unnest([0.8, 0.9, 0.95]::DOUBLE[]) AS p) GROUP BY la, lb, p""",
    "label_confusion": f"WITH {_LAB} SELECT a.annotator AS annotator_a, b.annotator AS annotator_b, a.label AS label_a, b.label AS label_b, count(*) AS n FROM lab a JOIN lab b ON a.item = b.item AND a.annotator < b.annotator GROUP BY ALL",
    "agreement_diagnostics": f"""WITH {_LAB}, per AS (SELECT item, label, count(*) AS c FROM lab GROUP BY ALL), it AS (SELECT item, sum(c) AS m, sum(c * (c - 1)) AS s, count(*) AS k FROM per GROUP BY 1 HAVING sum(c) >= 2),
      a AS (SELECT count(*) AS n_items, avg((k = 1)::INT) AS un, avg(s / (m * (m - 1))) AS po, sum(m) AS m FROM it), c AS (SELECT label, sum(c) / (SELECT m FROM a) AS p FROM per WHERE item IN (SELECT item FROM it) GROUP BY 1),
      g AS (SELECT sum(p * p) AS pe, sum(p * (1 - p)) / (count(*) - 1) AS pg, max(p) AS skew FROM c)
      SELECT n_items, round(un, 6) AS unanimity, round(po, 6) AS pairwise, round((po - pe) / (1 - pe), 6) AS fleiss_kappa, round((po - pg) / (1 - pg), 6) AS gwet_ac1, round(skew, 6) AS skew, po > 0.7 AND skew > 0.6 AND (po - pe) / (1 - pe) < 0.2 AS paradox FROM a, g""",
    "ordinal_alpha": f"""WITH {_LATEST}, l AS (SELECT label_round, term, label_rank, annotator, count(*) OVER (PARTITION BY label_round, term) AS m FROM latest), k AS (SELECT * FROM l WHERE m >= 2),
      pr AS (SELECT a.label_round, a.label_rank AS x, b.label_rank AS y, sum(1.0 / (a.m - 1)) AS o FROM k a JOIN k b ON a.label_round = b.label_round AND a.term = b.term AND a.annotator <> b.annotator GROUP BY ALL),
      n AS (SELECT label_round, count(*) FILTER (label_rank = 2) AS n2, count(*) FILTER (label_rank = 3) AS n3 FROM k GROUP BY 1)
      SELECT n.label_round, round(1 - (n2 + n3 - 1) * (SELECT sum(o) FROM pr WHERE pr.label_round = n.label_round AND x <> y) / (2.0 * n2 * n3), 6) AS alpha FROM n""",
    "dispute_kinds": f"WITH {_LAB}, per AS (SELECT item, label, count(*) AS c FROM lab GROUP BY ALL), s AS (SELECT item, count(*) AS k, min(c) AS lo, max(c) AS hi FROM per GROUP BY 1) SELECT CASE WHEN k = 1 THEN 'unanimous' WHEN lo = 1 AND hi > 1 THEN 'lone dissent' WHEN lo = hi THEN 'even split' ELSE 'divided' END AS kind, count(*) AS n_terms FROM s GROUP BY 1",
    "design_effect": f"""WITH {_TURN}, c AS (SELECT narrator, count(raw) AS n, avg(length(raw)) AS m, var_pop(length(raw)) AS v FROM t WHERE narrator IS NOT NULL GROUP BY 1 HAVING count(raw) > 0),
      g AS (SELECT count(*) AS k, sum(n) AS t, sum(n * n) AS q, sum(n * m) AS s, sum(n * m * m) AS ss, sum(n * v) AS w FROM c), h AS (SELECT k, t, (ss - s * s / t) / (k - 1) AS msb, w / (t - k) AS msw, (t - q / t) / (k - 1) AS n0 FROM g),
      i AS (SELECT k, t, greatest(0, least(1, (msb - msw) / (msb + (n0 - 1) * msw))) AS icc FROM h) SELECT k AS n_clusters, round(t / k, 4) AS mean_size, round(icc, 4) AS icc, round(1 + (t / k - 1) * icc, 4) AS deff FROM i""",
    "singleton_interval": f"""WITH {MID}, w AS (SELECT DISTINCT narrator FROM m2), n AS (SELECT count(*) AS n FROM w), kept AS (SELECT r, narrator FROM (SELECT r, narrator, row_number() OVER (PARTITION BY r ORDER BY md5('0|' || r || '|' || narrator), narrator) AS i FROM w, (SELECT unnest(range(1, 2001)) AS r)) WHERE i <= round(0.632 * (SELECT n FROM n))),
      st AS (SELECT r, avg((s = 1)::INT) AS v FROM (SELECT r, cid, count(*) AS s FROM m2 JOIN kept USING (narrator) GROUP BY 1, 2) GROUP BY 1), x AS (SELECT (SELECT avg((size = 1)::INT) FROM s2) AS p, stddev_samp(v) * sqrt(round(0.632 * any_value(n)) / any_value(n)) AS se FROM st, n)
      SELECT round(p, 4) AS point, round(se, 4) AS se, round(p - 1.96 * se, 4) AS lo, round(p + 1.96 * se, 4) AS hi FROM x""",
    "size_ks": f"WITH {MID}, p AS (SELECT granularity, size FROM sizes WHERE cell_rank = 2 AND granularity IN ('mid', 'fine')), v AS (SELECT DISTINCT size AS x FROM p) SELECT round(max(abs((SELECT avg((size <= x)::INT) FROM p WHERE granularity = 'mid') - (SELECT avg((size <= x)::INT) FROM p WHERE granularity = 'fine'))), 6) AS ks FROM v",
    "violation_ratio": f"WITH {_TURN}, a AS (SELECT quantile_cont(length(raw), list_transform(range(0, 1000), lambda i: i / 999.0)) AS qs FROM t WHERE role_gold = 'NARRATOR'), b AS (SELECT quantile_cont(length(raw), list_transform(range(0, 1000), lambda i: i / 999.0)) AS qs FROM t WHERE role_gold = 'INTERVIEWER'), z AS (SELECT unnest(b.qs) - unnest(a.qs) AS d, unnest(range(0, 1000)) AS i FROM a, b), w AS (SELECT d, CASE WHEN i IN (0, 999) THEN 0.5 ELSE 1 END AS w FROM z) SELECT round(coalesce(coalesce(sum(w * d * d) FILTER (d > 0), 0) / nullif(sum(w * d * d), 0), 0.5), 6) AS ratio FROM w",
    "size_slope": f"WITH {MID}, p AS (SELECT ln(1 + n_segments) AS x, size::DOUBLE AS y FROM s2), f AS (SELECT count(*) AS n, avg(x) AS mx, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_sxx(y, x) AS sxx FROM p) SELECT n, round(a, 5) AS intercept, round(b, 5) AS slope, round(sqrt(sum(pow((x - mx) * (y - a - b * x) / (1 - 1.0 / n - pow(x - mx, 2) / sxx), 2))) / any_value(sxx), 5) AS se FROM p, f GROUP BY n, a, b",
    "clustering_scores": f"""WITH {SEG}, i AS (SELECT segment_id, max(term) AS g, max(string_split(term, ' -- ')[1]) AS s FROM mention GROUP BY 1), o AS (SELECT g, s, count(*) AS n FROM i GROUP BY 1, 2), gs AS (SELECT g, count(*) AS c FROM i GROUP BY 1), ss AS (SELECT s, count(*) AS c FROM i GROUP BY 1),
      r AS (SELECT g, any_value(gs.c) AS c, count(*) AS parts, sum(n * (n - 1) / 2) AS links, sum(n * n) AS sq, max((ss.c = 1)::INT) AS alone FROM o JOIN gs USING (g) JOIN ss USING (s) GROUP BY 1),
      p AS (SELECT s, any_value(ss.c) AS c, count(*) AS parts, sum(n * (n - 1) / 2) AS links, sum(n * n) AS sq, max((gs.c = 1)::INT) AS alone FROM o JOIN ss USING (s) JOIN gs USING (g) GROUP BY 1)
      SELECT """
    + ", ".join(f"(SELECT round(sum(c - parts) FILTER (c > 1) / sum(c - 1) FILTER (c > 1), 6) FROM {t}) AS muc_{x}, (SELECT round(sum(sq / c) / sum(c), 6) FROM {t}) AS b3_{x}, (SELECT round(sum(c * CASE WHEN c = 1 THEN alone ELSE links / (c * (c - 1) / 2) END) / sum(c), 6) FROM {t}) AS lea_{x}" for t, x in (("r", "recall"), ("p", "precision"))),
    "anonymised_profile": f"WITH {SEG} SELECT narrator, count(*) AS n_before, count(*) AS n_after FROM voice GROUP BY 1",
    "stratified_sizes": f"WITH {MID} SELECT CASE WHEN size <= 3 THEN '2-3' WHEN size <= 10 THEN '4-10' WHEN size <= 50 THEN '11-50' ELSE '51+' END AS band, count(*) AS n, round(avg(n_segments), 6) AS segments_mean FROM s2 WHERE size >= 2 GROUP BY 1",
    "cowitness_graph": f"WITH {MID}, {_CW} SELECT * FROM cw",
    "betti_curve": f"""WITH RECURSIVE {MID}, {_CW}, top AS (SELECT least(25, max(size)) AS t FROM s2), ks AS (SELECT unnest(range(1, t + 1)) AS k FROM top), al AS (SELECT k, a, b FROM cw, ks WHERE max_size >= k), al2 AS (SELECT k, a, b FROM al UNION SELECT k, b, a FROM al),
      reach(k, x, r) AS (SELECT k, a, a FROM al2 UNION SELECT reach.k, reach.x, al2.b FROM reach JOIN al2 ON al2.k = reach.k AND al2.a = reach.r), comp AS (SELECT k, x, min(r) AS c FROM reach GROUP BY 1, 2)
      SELECT k::INT AS k, (SELECT count(*) FROM s2 WHERE size >= k) AS n_cells, (SELECT count(DISTINCT c) FROM comp WHERE comp.k = ks.k) AS beta0, greatest(0, (SELECT count(*) FROM al WHERE al.k = ks.k) - (SELECT count(*) FROM comp WHERE comp.k = ks.k) + (SELECT count(DISTINCT c) FROM comp WHERE comp.k = ks.k)) AS beta1 FROM ks""",
    "degree_profile": f"WITH {MID}, p AS (SELECT narrator, count(*) AS degree, avg(size) AS m, max(size) AS x, min(size) AS n FROM m2 JOIN s2 USING (cid) GROUP BY 1) SELECT narrator, coalesce(degree, 0) AS degree, round(coalesce(m, 0), 6) AS mean_size, coalesce(x, 0) AS max_size, coalesce(n, 0) AS min_size FROM ground LEFT JOIN p USING (narrator)",
    "forman_curvature": f"WITH {MID}, {_CW}, dg AS (SELECT a, count(*) AS d FROM cw2 GROUP BY 1) SELECT cw2.a AS narrator, round(avg(4 - x.d - y.d), 6) AS curvature FROM cw2 JOIN dg x ON x.a = cw2.a JOIN dg y ON y.a = cw2.b GROUP BY 1",
    "hypergraph_laplacian": f"WITH {MID}, dv AS (SELECT narrator, count(*) AS v FROM m2 GROUP BY 1) SELECT x.narrator AS a, y.narrator AS b, round((x.narrator = y.narrator)::INT - sum(1 / (sqrt(p.v * q.v) * size)), 6) AS value FROM m2 x JOIN m2 y ON x.cid = y.cid JOIN s2 s ON s.cid = x.cid JOIN dv p ON p.narrator = x.narrator JOIN dv q ON q.narrator = y.narrator GROUP BY x.narrator, y.narrator",
    "error_rates": f"WITH {MID}, l AS (SELECT cid, list(narrator) AS s FROM m2 GROUP BY 1), p AS (SELECT count(*) AS n, count(*) FILTER (len(list_intersect(a.s, b.s)) >= 0.8 * len(list_distinct(list_concat(a.s, b.s)))) AS k FROM l a JOIN l b ON a.cid < b.cid) SELECT n AS n_pairs, k AS n_alike, round(k / n, 6) AS merge_rate, (SELECT round(avg((size >= 4 AND n_segments > 2 * size)::INT), 6) FROM s2) AS split_rate FROM p",
    "label_centroids": f"WITH {_V}, {_CENT} SELECT cell AS label, (SELECT count(*) FROM v WHERE label = cell) AS n, pos::INT AS pos, round(m, 5) AS value FROM c0",
    "rank_features": f"WITH {_V}, {_CENT} SELECT cell AS label, (len(cv) + 4)::INT AS width, 1.0::DOUBLE AS hot, round(list_sum(cv) + 1, 4) AS total FROM c",
    "message_passing": f"WITH {MID} SELECT narrator AS node, 1.0::DOUBLE AS x0, length(narrator)::DOUBLE AS x1 FROM (SELECT DISTINCT narrator FROM m2) UNION ALL SELECT cid, 0.5::DOUBLE, round(0.5 * avg(length(narrator)), 6) FROM m2 GROUP BY 1",
    "row_weights": f"WITH {MID} SELECT narrator AS src, cid AS dst, round(1 / count(*) OVER (PARTITION BY narrator), 6) AS w_fwd, round(1 / count(*) OVER (PARTITION BY cid), 6) AS w_bwd FROM m2",
    "turn_roles": f"WITH {_TURN} SELECT turn_id, round({_SCORE}, 6)::DOUBLE AS score, CASE WHEN {_SCORE} > 1 THEN 'INTERVIEWER' ELSE 'NARRATOR' END AS role FROM t WHERE raw IS NOT NULL",
    "turn_role_evaluation": f"WITH {_TURN}, x AS (SELECT role_gold AS g, CASE WHEN {_SCORE} > 1 THEN 'INTERVIEWER' ELSE 'NARRATOR' END AS p FROM t WHERE raw IS NOT NULL AND role_gold IN ('NARRATOR', 'INTERVIEWER')), c AS (SELECT count(*) FILTER (g = 'INTERVIEWER' AND p = g) AS tp, count(*) FILTER (g = 'NARRATOR' AND p <> g) AS fp, count(*) FILTER (g = 'INTERVIEWER' AND p <> g) AS fn, count(*) FILTER (g = 'NARRATOR' AND p = g) AS tn FROM x) SELECT *, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall FROM c",
    "segment_marks_asof": "WITH o AS (SELECT interview_id, turn_no, max(segment_no) AS s FROM turns WHERE interview_id IS NOT NULL AND turn_no IS NOT NULL GROUP BY 1, 2) SELECT interview_id, turn_no, last_value(s IGNORE NULLS) OVER (PARTITION BY interview_id ORDER BY turn_no) AS segment_asof FROM o",
    "document_quality": rf"""WITH t AS (SELECT doc_id, text, regexp_replace(regexp_replace(text, '\d{{1,2}}:\d{{2}}(:\d{{2}})?|\d{{4}}-\d{{2}}-\d{{2}}|\b(1[89]|20)\d{{2}}\b', ' ', 'g'), '(\d),(\d{{3}})', '\1\2', 'g') AS p FROM documents WHERE text IS NOT NULL)
      SELECT doc_id, len(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: {sq('s')}), lambda s: s <> ''))::INT AS n_sentences, len(list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda s: length(trim(s)) > 80))::INT AS n_paragraphs, len(regexp_extract_all(p, '\d+\.\d+|\d{{3,}}'))::INT AS n_numbers FROM t""",
    "near_duplicate_segments": rf"""WITH t AS (SELECT DISTINCT segment_id, list_filter(string_split(regexp_replace(lower(description), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM segments WHERE segment_id IS NOT NULL AND description IS NOT NULL),
      h AS (SELECT segment_id, list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) AS sh FROM t WHERE len(w) >= 8), c AS (SELECT sh, count(*) AS n, min(segment_id) AS id FROM h GROUP BY 1),
      g AS (SELECT id, unnest(sh) AS x, len(sh) AS m FROM c), p AS (SELECT a.id AS a, b.id AS b, count(*) AS k, any_value(a.m) AS ma, any_value(b.m) AS mb FROM g a JOIN g b ON a.x = b.x AND a.id <> b.id GROUP BY 1, 2), l AS (SELECT a, count(*) AS n_links FROM p WHERE k >= 0.8 * (ma + mb - k) GROUP BY 1)
      SELECT h.segment_id, c.n AS n_copies, coalesce(n_links, 0) AS n_links FROM h JOIN c USING (sh) LEFT JOIN l ON l.a = c.id""",
    "near_duplicate_pairs": rf"""WITH {SEG}, t AS (SELECT segment_id, narrators, list_filter(string_split(regexp_replace(lower(description), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '') AS w FROM seg WHERE description IS NOT NULL),
      h AS (SELECT segment_id, narrators, list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) AS sh FROM t WHERE len(w) >= 8),
      u AS (SELECT min(segment_id) AS id, narrators AS own, sh FROM h GROUP BY CASE WHEN len(narrators) > 0 THEN array_to_string(narrators, '|') ELSE segment_id END, narrators, sh),
      g AS (SELECT id, unnest(sh) AS x, len(sh) AS m FROM u), p AS (SELECT a.id AS a, b.id AS b, count(*) / (any_value(a.m) + any_value(b.m) - count(*)) AS j FROM g a JOIN g b ON a.x = b.x AND a.id < b.id GROUP BY 1, 2)
      SELECT a AS key_a, b AS key_b, round(j, 6) AS jaccard FROM p JOIN u x ON x.id = a JOIN u y ON y.id = b WHERE j >= 0.8 AND NOT list_has_any(x.own, y.own)""",
    "event_numbers": "SELECT 'k' AS path, count(*) AS n, sum(json_extract(props, '$.k')::DOUBLE) AS total FROM events WHERE json_extract(props, '$.k') IS NOT NULL",
    "term_ambiguity": f"""WITH {SEG}, t AS (SELECT term, n_segments, CASE WHEN depth > 1 THEN array_to_string(string_split(term, ' -- ')[1:depth - 1], ' -- ') END AS parent FROM terms), x AS (SELECT term, ln(1 + n_segments) AS f, CASE WHEN parent IS NULL THEN 0 ELSE count(*) OVER (PARTITION BY parent) - 1 END::DOUBLE AS sib FROM t),
      z AS (SELECT term, round(-coalesce((f - avg(f) OVER ()) / nullif(stddev_pop(f) OVER (), 0), 0) + coalesce((sib - avg(sib) OVER ()) / nullif(stddev_pop(sib) OVER (), 0), 0), 6) AS score FROM x) SELECT term, score, row_number() OVER (ORDER BY score DESC, term) <= greatest(1, count(*) OVER () // 10) AS flagged FROM z""",
    "revenue_by_segment": "SELECT r_name, c_mktsegment, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE l_returnflag = 'R' GROUP BY 1, 2",
}

_CURVE_WITH, _CURVE = ORACLE["betti_curve"].rsplit("\n      SELECT", 1)
ORACLE["persistence"] = f"{_CURVE_WITH.rstrip()}, curve_ AS (SELECT{_CURVE}) " + " UNION ALL ".join(f"SELECT '{b}' AS curve, coalesce(sum(abs(v - p)), 0)::BIGINT AS variation, max(v) AS largest, coalesce(sum((v + p) / 2), 0)::DOUBLE AS area FROM (SELECT {b} AS v, lag({b}) OVER (ORDER BY k) AS p FROM curve_)" for b in ("beta0", "beta1"))


def _phrases_sql() -> str:
    phrases, left, counts = ("at the same time", "the same", "as a whole", "on the eve of the regatta"), "lower(text)", {}
    for i in sorted(range(4), key=lambda i: -len(phrases[i])):
        counts[i] = f"(length({left}) - length(replace({left}, '{phrases[i]}', ''))) // {len(phrases[i])}"
        left = f"replace({left}, '{phrases[i]}', chr(1))"
    return "SELECT " + ", ".join(f"sum({counts[i]})::BIGINT AS n{i}" for i in range(4)) + " FROM documents WHERE text IS NOT NULL"


_NODES = r"""list_filter(list_transform(string_split(regexp_replace(html, '<[a-zA-Z/][^>]*>', chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[\s\x{00A0}]+', ' ', 'g'))), lambda x: x <> '')"""
_HEAD = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_extract(t, '(?m)^%ss?:\s*(.+)$', 1), '\((primary|secondary|tertiary)\)', '', 'g'), '\s*,\s*|\s+and\s+'), lambda x: trim(x)), lambda x: x <> '')"
_INITIALS = r"upper(array_to_string(list_transform(list_filter(regexp_split_to_array(x, '[\s.]+'), lambda w: w <> '')[1:3], lambda w: w[1]), ''))"
_PLACE = "(('0x' || substr(md5({}), 1, 12))::BIGINT::DOUBLE / 281474976710656.0)"


def _poisson_sql(place: str) -> str:
    import math

    out, cum = "CASE", 0.0
    for k in range(8):
        cum += math.exp(-1) / math.factorial(k)
        out += f" WHEN {place} < {cum!r} THEN {k}"
    return out + " ELSE 8 END"


ORACLE |= {
    "phrase_counts": _phrases_sql(),
    "transcript_headers": f"WITH x AS (SELECT DISTINCT interview_id, array_to_string({_NODES}, chr(10)) AS t FROM transcripts WHERE chunk_no = 1), h AS (SELECT interview_id, {_HEAD % 'Narrator'} AS n, {_HEAD % 'Interviewer'} AS i FROM x) SELECT interview_id, array_to_string(n, '|') AS narrators, array_to_string(i, '|') AS interviewers, array_to_string(list_transform(n, lambda x: {_INITIALS}), '|') AS tags FROM h",
    "turn_length_bootstrap": f"""WITH {_TURN}, u AS (SELECT narrator, sum(length(raw)) AS s, count(raw) AS n FROM t WHERE narrator IS NOT NULL AND raw IS NOT NULL GROUP BY 1),
      w AS (SELECT r, s, n, {_poisson_sql(_PLACE.format("'0|' || r || '|' || narrator"))} AS w FROM u, (SELECT unnest(range(1, 10001)) AS r)), m AS (SELECT r, sum(w * s) / nullif(sum(w * n), 0) AS m FROM w GROUP BY 1)
      SELECT (SELECT round(sum(s) / sum(n), 4) FROM u) AS mean, round(quantile_cont(m, 0.025), 4) AS lo, round(quantile_cont(m, 0.975), 4) AS hi, round(stddev_samp(m), 4) AS se FROM m""",
    "perturbed_sizes": f"""WITH {MID}, c AS (SELECT cid, row_number() OVER (ORDER BY md5('0|' || cid), cid) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT cid FROM m2)), gg AS (SELECT cid, CASE WHEN i < 2 * floor(0.05 * n + 0.5) THEN i // 2 END AS g FROM c),
      nm AS (SELECT cid, CASE WHEN g IS NULL THEN cid ELSE min(cid) OVER (PARTITION BY g) END AS new FROM gg), af AS (SELECT DISTINCT new AS cid, narrator FROM m2 JOIN nm USING (cid)), sz AS (SELECT cid, count(*) AS s FROM af GROUP BY 1),
      ct AS (SELECT cid FROM (SELECT cid, row_number() OVER (ORDER BY md5('1|' || cid), cid) AS j FROM sz WHERE s >= 2) WHERE j <= floor(0.1 * (SELECT count(*) FROM sz) + 0.5)),
      k AS (SELECT af.cid, ct.cid IS NOT NULL AS cut, row_number() OVER (PARTITION BY af.cid ORDER BY md5('2|' || af.cid || '|' || narrator), narrator) AS k, count(*) OVER (PARTITION BY af.cid) AS s FROM af LEFT JOIN ct ON ct.cid = af.cid)
      SELECT CASE WHEN cut AND 2 * k > s THEN cid || '#2' ELSE cid END AS cid, count(*) AS size FROM k GROUP BY 1""",
    "role_length_did": f"""WITH {_TURN}, u AS (SELECT narrator, sum(length(raw)) FILTER (role_gold = 'NARRATOR') AS s1, count(raw) FILTER (role_gold = 'NARRATOR') AS n1, sum(length(raw)) FILTER (role_gold <> 'NARRATOR') AS s0, count(raw) FILTER (role_gold <> 'NARRATOR') AS n0 FROM t WHERE narrator IS NOT NULL AND role_gold IS NOT NULL AND raw IS NOT NULL GROUP BY 1),
      w AS (SELECT r, u.*, CASE WHEN r = 0 THEN 1 ELSE {_poisson_sql(_PLACE.format("'0|' || r || '|' || narrator"))} END AS w FROM u, (SELECT unnest(range(0, 10001)) AS r)),
      d AS (SELECT r, sum(w * coalesce(s1, 0)) / nullif(sum(w * n1), 0) - sum(w * coalesce(s0, 0)) / nullif(sum(w * n0), 0) AS d FROM w GROUP BY 1)
      SELECT round(max(d) FILTER (r = 0), 4) AS did, round(quantile_cont(d, 0.025) FILTER (r > 0), 4) AS lo, round(quantile_cont(d, 0.975) FILTER (r > 0), 4) AS hi FROM d""",
}
