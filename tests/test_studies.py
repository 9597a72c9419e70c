import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rungwork.functions import text as T
from rungwork.operators import alignment as AL
from rungwork.operators import claims as CL
from rungwork.operators import features as FE
from rungwork.operators import graph as G
from rungwork.operators import near_duplicates as N
from rungwork.operators import negatives as NEG
from rungwork.operators import outcomes as O
from rungwork.operators import perturb as P
from rungwork.operators import rank_study as RS
from rungwork.operators import statistics as ST
from rungwork.operators import vectors as V
from rungwork.session import forget, kept
from rungwork.sources.readers import json_at, numbers_in_json
from tests.conftest import rows

RNG = random.Random(12)
VOICES = "segment_id string, narrator string, vec string"


def test_features_with_permission_and_fallback(spark):
    vectors = spark.createDataFrame([("s1", [1.0, 0.0]), ("s2", [3.0, 0.0]), ("s3", [0.0, 5.0])], "segment_id string, vec array<double>")
    voices = spark.createDataFrame([("s1", "n1", "x"), ("s2", "n1", "x"), ("s2", "n1", "y"), ("s3", "n2", "x"), ("s9", "n3", "x"), (None, "n1", "x")], VOICES)
    got = {r["narrator"]: (list(r["vec"]), r["fallback"]) for r in FE.narrator_vectors(voices, vectors).collect()}
    assert got == {"n1": ([2.0, 0.0], False), "n2": ([0.0, 5.0], False)}
    allowed = voices.filter("segment_id = 's1'")
    got = {r["narrator"]: (list(r["vec"]), r["fallback"]) for r in FE.narrator_vectors(voices, vectors, allowed).collect()}
    assert got == {"n1": ([1.0, 0.0], False), "n2": ([0.0, 5.0], True)}
    assert {r["narrator"]: list(r["vec"]) for r in FE.narrator_text_vectors(voices, vectors).collect()} == {"n1": [1.0, 0.0], "n2": [0.0, 1.0]}
    cells = spark.createDataFrame([(2, "c", "n1"), (2, "c", "n2"), (3, "e", "gone")], "cell_rank int, cid string, narrator string")
    f = {(r["cell_rank"], r["cid"]): list(r["feature"]) for r in FE.cell_features(cells, FE.narrator_vectors(voices, vectors)).collect()}
    assert f == {(0, "n1"): [2, 0, 1, 0, 0, 0], (0, "n2"): [0, 5, 1, 0, 0, 0], (2, "c"): [1, 2.5, 0, 0, 1, 0]}
    assert FE.narrator_vectors(voices.filter("false"), vectors).count() == 0


def test_pairs_leave_owners_repeats_out(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    data = [("a", ["x"], text), ("b", ["y"], text), ("c", ["x"], text + " fifteen"), ("d", None, text), ("e", ["z"], "too short"), ("f", ["x"], None), (None, ["q"], text), ("a", ["x"], text)]
    df = spark.createDataFrame(data, "id string, who array<string>, t string")
    got = {(a, b) for a, b, _ in rows(N.duplicate_pairs(df, "id", "t", "who"))}
    assert got == {("a", "b"), ("a", "d"), ("b", "d"), ("b", "c"), ("c", "d")}
    assert N.duplicate_pairs(df.filter("false"), "id", "t", "who").count() == 0
    other = [(f"s{i}", [f"o{i}"], " ".join(RNG.choice("abcdefghij") * 3 + str(RNG.randrange(99)) for _ in range(20))) for i in range(60)]
    assert N.duplicate_pairs(spark.createDataFrame(other, "id string, who array<string>, t string"), "id", "t", "who").count() == 0


def test_numbers_nested_without_limit_and_paths(spark):
    deep = "1"
    for _ in range(12):
        deep = '{"a.b": [' + deep + "]}"
    df = spark.createDataFrame([(deep,), ("[1, {\"x\": 2.5, \"y\": true}]",), ("{torn",), (None,)], "j string")
    got = rows(numbers_in_json(df, "j"))
    assert got == sorted([("/".join(["a.b", "0"] * 12), 1.0), ("0", 1.0), ("1/x", 2.5)], key=repr)
    assert numbers_in_json(df.filter("false"), "j").count() == 0
    assert [r["value"] for r in json_at(df, "j", "1/x").collect()] == [None, "2.5", None, None]
    assert json_at(spark.createDataFrame([('{"a.b": [7]}',)], "j string"), "j", "a.b/0").first()["value"] == "7"


def test_claims_are_traced_within_their_decimals(spark):
    text = "We saw 77.7% of 1,234 on 1999-01-02 at 10:30, 0.777 then 150 and 3.14159."
    q = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(F.explode(CL.quoted(F.col("t"))).alias("q")).select("q.*")
    assert rows(q.select("literal", "places")) == sorted([("77.7", 1), ("1234", 0), ("0.777", 3), ("150", 0), ("3.14159", 5)], key=repr)
    pool = spark.createDataFrame([(0.7771,), (1234.4,), (151.0,), (3.1415901,), (None,)], "value double")
    assert {r["literal"]: r["traced"] for r in CL.traced(q, pool).collect()} == {"77.7": True, "1234": True, "0.777": True, "150": False, "3.14159": True}
    assert {r["traced"] for r in CL.traced(q, pool.filter("false")).collect()} == {False}
    values = [(float(RNG.randrange(2000)) / 100, RNG.choice([0, 1, 2])) for _ in range(200)]
    pools = [RNG.randrange(200000) / 10000 for _ in range(300)]
    got = {(v, p): t for v, p, t in CL.traced(spark.createDataFrame(values, "value double, places int"), spark.createDataFrame([(x,) for x in pools], "value double")).collect()}
    for v, p in values:
        assert got[v, p] == any(abs(x - v) < 0.5 * 10.0**-p or abs(x - v / 100) < 0.5 * 10.0 ** -(p + 2) for x in pools)


def test_bca_of_skewed_units_and_edges(spark):
    data = [(f"u{i}", float(RNG.expovariate(1.0))) for i in range(120)] + [(None, None)]
    df = spark.createDataFrame(data, "u string, v double")
    r = ST.bca_mean(df, "u", "v", draws=2000).first()
    mean = np.mean([v for _, v in data if v is not None])
    assert r["lo"] < r["point"] < r["hi"] and abs(r["point"] - mean) < 1e-9 and r["a"] > 0 and abs(r["z0"]) < 0.3
    assert ST.bca_mean(df.filter("false"), "u", "v", draws=50).first()["point"] is None
    one = ST.bca_mean(df.filter("u = 'u1'"), "u", "v", draws=50).first()
    assert one["lo"] == one["hi"] == one["point"]


def test_interaction_against_numpy(spark):
    data = []
    for c in range(30):
        shift = RNG.gauss(0, 1)
        for _ in range(12):
            f, x = RNG.randrange(2), RNG.random() * 3
            data.append((f"c{c}", float(f), x, 1 + 0.5 * f + 2 * x + 0.7 * f * x + shift + RNG.gauss(0, 0.3)))
    r = ST.interaction(spark.createDataFrame(data, "c string, f double, x double, y double"), "y", "f", "x", "c").first()
    m = np.array([[1, f, x, f * x] for _, f, x, _ in data])
    y = np.array([v[3] for v in data])
    beta, inv = np.linalg.lstsq(m, y, rcond=None)[0], np.linalg.inv(m.T @ m)
    e = y - m @ beta
    meat = sum(np.outer(u, u) for c in range(30) for u in [m[[i for i, v in enumerate(data) if v[0] == f"c{c}"]].T @ e[[i for i, v in enumerate(data) if v[0] == f"c{c}"]]])
    se = np.sqrt((inv @ meat @ inv)[3, 3] * 30 / 29 * (len(y) - 1) / (len(y) - 4))
    assert abs(r["coefficient"] - beta[3]) < 1e-8 and abs(r["se"] - se) < 1e-8 and r["lo"] < 0.7 < r["hi"]
    flat = spark.createDataFrame([("a", 1.0, 1.0, 1.0)] * 6, "c string, f double, x double, y double")
    assert ST.interaction(flat, "y", "f", "x", "c").first()["coefficient"] is None


def test_stochastic_order_and_information(spark):
    data = [("strong", 0.8 + 0.001 * i) for i in range(50)] + [("weak", 0.1 + 0.001 * i) for i in range(50)] + [("one", 1.0), (None, 1.0), ("weak", None)]
    got = {(r["a"], r["b"]): r["ratio"] for r in ST.stochastic_order(spark.createDataFrame(data, "m string, v double"), "m", "v").collect()}
    assert got["strong", "weak"] == 0.0 and got["weak", "strong"] == 1.0 and got["one", "weak"] is None and len(got) == 6
    same = spark.createDataFrame([(i % 2, i % 2, i % 3) for i in range(60)], "x int, y int, z int")
    assert abs(ST.mutual_information(same, "x", "y").first()["nats"] - np.log(2)) < 1e-9 and ST.mutual_information(same, "x", "z").first()["nats"] < 1e-9
    assert tuple(ST.mutual_information(same.filter("false"), "x", "y").first()) == (0, 0.0)


def test_variance_flips_and_tables(spark):
    runs = [(p, s, 10.0 * p + s) for p in range(4) for s in range(5)]
    r = ST.variance_components(spark.createDataFrame(runs, "p int, s int, v double"), "p", "s", "v").first()
    assert abs(r["within"] - 2.5) < 1e-9 and abs(r["component"] - (r["observed"] - 0.5)) < 1e-9 and r["n_negative"] == 0
    d = spark.createDataFrame([(1, "a", -1.0), (1, "b", 2.0), (2, "a", 1.0), (2, "b", 2.0), (3, "a", 1.0)], "k int, side string, v double")
    assert tuple(ST.sign_flips(d, "k", "side", "a", "b", "v").first()) == (2, 1)
    assert rows(ST.paired_advantage(d, "k", "side", "a", "b", "v")) == [(1, 2, -3.0), (2, 2, -1.0)]
    t = {r["k"]: r for r in ST.run_table(d, ["k"], "side", ["a", "b"], "v").collect()}
    assert t[3]["a mean"] == 1.0 and t[3]["b mean"] is None and t[3]["b n"] == 0 and t[3]["a sd"] is None


M = "cid string, narrator string"


def test_negatives_of_nearly_full_cells_are_exact(spark):
    ground = spark.createDataFrame([(f"n{i:03d}",) for i in range(200)], "narrator string")
    data = [("most", f"n{i:03d}") for i in range(200) if i not in (17, 142)] + [("all", f"n{i:03d}") for i in range(200)] + [("few", "n001"), ("few", "n002")]
    members = spark.createDataFrame(data, M)
    got = rows(NEG.uniform(members, members, ground, draws=40, tries=2))
    by = {c: {n for x, _, n in got if x == c} for c in ("most", "all", "few")}
    assert by["most"] == {"n017", "n142"} and by["all"] == set() and not by["few"] & {"n001", "n002"} and len([1 for c, _, _ in got if c == "few"]) == 40
    assert {c for c, _ in rows(NEG.size_matched(members, ground))} == {"most", "few"}
    assert NEG.uniform(members.filter("false"), members, ground).count() == 0


@pytest.mark.parametrize("regime", NEG.REGIMES)
def test_labelled_negatives_have_the_ratio(spark, regime):
    ground = spark.createDataFrame([(f"n{i}",) for i in range(30)], "narrator string")
    members = spark.createDataFrame([("x", f"n{i}") for i in range(8)] + [("y", f"n{i}") for i in (*range(7), 8, 9, 10)] + [("lone", "n20")], M)
    got = NEG.labelled(members, ground, regime, ratio=3)
    n = {(r["cid"], r["label"]): r["count"] for r in got.groupBy("cid", "label").count().collect()}
    assert n == {("x", 1): 8, ("x", 0): 24, ("y", 1): 10, ("y", 0): 30, ("lone", 1): 1, ("lone", 0): 3}
    ours = set(rows(members))
    assert not ours & {(c, w) for c, w, label, _ in rows(got) if label == 0}
    with pytest.raises(ValueError):
        NEG.labelled(members, ground, "other")


def test_replicates_of_a_plan_are_those_made_alone(spark):
    members = spark.createDataFrame([(f"c{i:02d}", f"n{j}") for i in range(30) for j in range(1 + i % 6)], M)
    plan = P.grid([0.0, 0.2], [0.0, 0.3], 2, seed=5)
    many = P.perturb_many(members, spark.createDataFrame(plan, P.PLAN)).persist()
    for r, merge, split, seed in plan:
        assert rows(many.filter(F.col("replicate") == r).select("cid", "narrator")) == rows(P.perturb(members, merge, split, seed))
    g = {(r["merge_rate"], r["split_rate"]): r for r in P.triage_grid(members, [0.0, 0.3], [0.0, 0.3], draws=3, k=8).collect()}
    assert g[0.0, 0.0]["overlap"] == 1.0 and g[0.3, 0.3]["overlap"] < 1.0 and len(g) == 4
    share = {r["cid"]: r["share"] for r in P.triage_stability(members, [0.0, 0.2], [0.0], draws=2, k=5).collect()}
    assert max(share.values()) <= 1.0 and sum(share.values()) == 5
    assert all(0 <= r["share"] <= 1 and r["size"] > 1 for r in P.false_singletons(members, 0.1, 0.5, draws=5, k=10).collect())


def test_iterated_spectrum_is_the_solved_one(spark):
    members = spark.createDataFrame([(f"c{i:02d}", f"n{RNG.randrange(40):02d}") for i in range(60) for _ in range(3)], M).distinct()
    lap = G.laplacian(members).persist()
    a, b = (np.zeros((40, 3)) for _ in range(2))
    for out, df in ((a, G.spectral_encoding(lap, 3)), (b, G.spectral_encoding(lap, 3, most=5))):
        for r in df.collect():
            out[int(r["node"][1:]), r["pos"]] = r["value"]
    assert np.abs(a - b).max() < 1e-2 and np.abs(np.linalg.norm(b, axis=0) - 1).max() < 1e-6
    e = G.encodings(members, members.select("narrator").distinct(), 3).collect()
    m = np.array([r["block"] for r in e])
    assert m.shape[1] == 8 and np.abs(m.mean(axis=0)).max() < 1e-9


def test_dealing_sets_anew_changes_no_curve(spark):
    members = spark.createDataFrame([(f"c{i}", f"n{RNG.randrange(9)}") for i in range(12) for _ in range(3)], M).distinct().persist()
    names = [f"c{i}" for i in range(12)]
    other = dict(zip(names, RNG.sample(names, 12), strict=True))
    dealt = spark.createDataFrame([(other[c], n) for c, n in rows(members)], M)
    assert rows(G.filtration(members)) == rows(G.filtration(dealt)) and {r["p_value"] for r in G.permutation_test(members).collect()} == {1.0}


def test_rank_study(spark):
    names = ["W", "W -- Camp 442nd", "W -- Life", "W -- Life -- Work", "Food -- Places -- 1942", "Odd"]
    terms = spark.createDataFrame([(t, i + 1) for i, t in enumerate(names)], "term string, n_segments long")
    one, two = (dict(rows(RS.by_structure(terms, x))) for x in (False, True))
    assert one["W"] == 3 and one["Odd"] == 2 and two["Odd"] == 3 and two["W -- Life"] == 3 and two["W -- Life -- Work"] == 2
    words = dict(rows(RS.by_words(terms, ["camp"], ["life", "work"])))
    assert words["W -- Camp 442nd"] == 2 and words["W -- Life -- Work"] == 3 and words["Food -- Places -- 1942"] == 2
    labels = RS.label_all(terms, ["camp"], ["life", "work"], True)
    got = {r["term"]: r for r in RS.consensus(labels, terms, flips=1).collect()}
    disputed = [t for t in got if got[t]["disputed"]]
    first = max(disputed, key=lambda t: names.index(t))
    assert got[first]["place"] == 1 and got[first]["adversarial"] == 5 - got[first]["consensus"] and all(got[t]["adversarial"] == got[t]["consensus"] for t in got if t != first)
    parts = {r["part"] for r in RS.alphas(labels, terms.select("term", F.lit("all").alias("stratum"))).collect()}
    assert {"overall", "all", "structure and words"} <= parts
    strata = spark.createDataFrame([(f"t{i}", "a" if i < 50 else "b") for i in range(60)], "term string, stratum string")
    n = {r["stratum"]: r["count"] for r in RS.stratified_sample(strata, 40).groupBy("stratum").count().collect()}
    assert n == {"a": 20, "b": 10}
    use = spark.createDataFrame([("t", f"s{i}") for i in range(100)] + [("u", "s1"), ("u", "s1")], "term string, segment_id string")
    assert {r["term"]: r["count"] for r in RS.sample_usage(use).groupBy("term").count().collect()} == {"t": 24, "u": 1}


def test_text_functions(spark):
    def of(column, value, kind="string"):
        return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]

    assert of(T.clean_speech, "uh, We we [inaudible] went [laughs] um home") == "We <INAUD> went home" and of(T.clean_speech, None) is None
    assert of(T.turn_score, "It is mine. I'm here") < of(T.turn_score, "It is there. He is here")
    assert of(T.plain_of_latex, "\\section{One} A \\emph{good} result~\\cite{x} $a+b$ % no\nend") == "One A good result end"
    assert [(s["title"], s["body"]) for s in of(T.sections, "# A\nx y\n\\subsection{B} z")] == [("A", "x y"), ("B", "z")]
    assert [of(T.scientific, v, "double") for v in (0.00012345, 123456.0, 0.0, -9.99e-5, None)] == ["1.2 x 10^-4", "1.2 x 10^5", "0", "-1.0 x 10^-4", None]
    assert of(T.percent, 0.1234, "double") == "12.3%" and of(T.grouped, 1234567, "long") == "1,234,567" and of(T.yes_no, True, "boolean") == "yes" and of(T.yes_no, None, "boolean") is None


def test_kept_tables_are_built_once_until_files_change(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(len(built))

    (tmp_path / "a.parquet").write_text("x")
    assert [kept(spark, str(tmp_path), "n", build).count() for _ in range(3)] == [1, 1, 1]
    (tmp_path / "a.parquet").write_text("other")
    assert kept(spark, str(tmp_path), "n", build).count() == 2
    forget()
    assert kept(spark, str(tmp_path), "n", build).count() == 3


def test_turns_are_cut_with_offsets_and_segments(spark):
    text = "Title: x\n<Begin Segment 1>\nNarrator: A B\nCF: Where?\nAB: At\nhome.\n<Begin Segment 2>\nCF: And\nab: no tag"
    df = spark.createDataFrame([("i", text), ("j", "none here"), ("k", None), (None, text), ("l", "")], "id string, t string")
    got = O.cut_turns(df, "id", "t").orderBy("id", "turn_no").collect()
    assert [(r["id"], r["speaker_tag"], r["segment_no"]) for r in got] == [("i", "CF", 1), ("i", "AB", 1), ("i", "CF", 2)]
    assert all(text[r["char_start"] : r["char_end"]] == r["raw"] for r in got) and got[-1]["char_end"] == len(text)
    assert O.cut_turns(df.filter("false"), "id", "t").count() == 0


def test_outcomes_strata_and_gaps(spark):
    scored = spark.createDataFrame([("g", i, int(i > 4), float(i)) for i in range(10)], "g string, i int, label int, score double")
    assert rows(O.outcomes(scored, ["g"]).agg(F.sum("correct"), F.count("*"))) == [(10, 10)]
    r = O.stratified_means(scored, ["g"], "i", "score", draws=400).first()
    assert r["mean"] == 4.5 and r["lo"] < 4.5 < r["hi"] and (r["n_rows"], r["n_units"]) == (10, 10)
    gap = O.gap_interval(scored.withColumn("s", F.when(F.col("label") == 1, "a").otherwise("b")), "s", "a", "b", "i", "score", draws=400).first()
    assert gap["point"] == 5.0 and gap["lo"] <= 5.0 <= gap["hi"] and gap["n_replicates"] == 5
    assert O.stratified_means(scored.filter("false"), ["g"], "i", "score", draws=9).count() == 0


def test_merges_splits_and_maps(spark):
    gold = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c")], "item int, gold_id string")
    system = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y"), (4, "y")], "item int, sys_id string")
    voices = spark.createDataFrame([(1, "n"), (2, "m"), (2, "m"), (3, "n")], "item int, narrator string")
    assert rows(O.merges_and_splits(gold, system, voices)) == sorted([("0", 1, 0.0, 0.0), ("1", 1, 0.0, 1.0), ("2-3", 1, 1.0, 2.0)], key=repr)
    assert tuple(O.merged_pairs(gold, system).first()) == (3, 3) and tuple(O.merged_pairs(gold.filter("false"), system).first()) == (0, 0)
    m = spark.createDataFrame([(f"t{i}", 2 + (i < 30)) for i in range(100)], "term string, cell_rank int")
    s = dict(rows(O.shuffled_map(m)))
    assert sorted(s) == sorted(f"t{i}" for i in range(100)) and sum(v == 3 for v in s.values()) == 30 and s != dict(rows(m))
    other = spark.createDataFrame([("t0", 9), ("new", 3)], "term string, cell_rank int")
    done = dict(rows(O.completed_map(m, other)))
    assert done["t0"] == 3 and done["new"] == 3 and len(done) == 101 and set(dict(rows(O.collapsed_map(m))).values()) == {2}


def test_own_vectors_tell_moments_apart(spark):
    f = spark.createDataFrame([(1, "s1", [1.0, 0.0, 1.0, 0.0, 0.0]), (1, "s2", [1.0, 0.0, 1.0, 0.0, 0.0]), (2, "c", [5.0, 0.0, 0.0, 1.0, 0.0])], "cell_rank int, cid string, feature array<double>")
    v = spark.createDataFrame([("s1", [7.0])], "segment_id string, vec array<double>")
    members = spark.createDataFrame([(1, "s1", "n"), (1, "s2", "n"), (2, "c", "n")], "cell_rank int, cid string, narrator string")
    own = O.own_vectors(f, v)
    assert {r["cid"]: list(r["feature"]) for r in own.collect()} == {"s1": [7, 0, 1, 0, 0], "s2": [1, 0, 1, 0, 0], "c": [5, 0, 0, 1, 0]}
    assert rows(O.spread_within_narrators(f, members)) == [("n", 2, 0.0)] and rows(O.spread_within_narrators(own, members)) == [("n", 2, 6.0)]


def test_null_vectors_make_no_clusters_and_no_probe(spark):
    df = spark.createDataFrame([(1, "a", None), (None, "a", [1.0]), (2, "a", None)], "id long, g string, vec array<double>")
    assert AL.cluster_by_similarity(df, ["g"], "id", "vec", [0.5]).count() == 0
    assert tuple(V.probe_accuracy(df, "g", "vec", "id").first()) == (None, 0, None)


def test_resampled_curves_are_those_of_the_restricted_complex(spark):
    members = spark.createDataFrame([(f"c{i}", f"n{RNG.randrange(14):02d}") for i in range(25) for _ in range(1 + i % 5)], M).distinct().persist()
    got = {r["replicate"]: r for r in G.resampled_curves(members, draws=4, seed=3).collect()}
    assert len(got) == 4
    from rungwork.operators.splits import hash_order

    who = members.select("narrator").distinct()
    for i, r in got.items():
        names = [x["narrator"] for x in who.withColumn("replicate", F.lit(i)).orderBy(hash_order(3, "replicate", "narrator")).limit(int(0.8 * who.count())).collect()]
        sub = members.filter(F.col("narrator").isin(names))
        area = {x["curve"]: x["area"] for x in G.persistence(G.filtration(sub)).collect()}
        sizes = [x["count"] for x in sub.groupBy("cid").count().collect()]
        assert (r["area0"], r["area1"]) == (area["beta0"], area["beta1"]) and r["n_cells"] == len(sizes) and r["size_max"] == max(sizes) and r["n_edges"] == G.cowitness(sub).count()


def test_an_area_that_sizes_explain_is_redundant(spark):
    data = [(i, *[float(RNG.random()) for _ in G.PLAIN]) for i in range(40)]
    df = spark.createDataFrame([(*r, 3 * r[1] - r[4], 5.0) for r in data], "replicate int, " + ", ".join(f"{c} double" for c in G.PLAIN) + ", area0 double, area1 double")
    got = {r["curve"]: r for r in G.simpler_explanation(df).collect()}
    assert got["area0"]["r2"] > 0.999 and got["area0"]["redundant"] and got["area1"]["constant"] and got["area1"]["r2"] is None
    assert {r["r2"] for r in G.simpler_explanation(df.limit(5)).collect()} == {None} and {r["n"] for r in G.simpler_explanation(df.filter("false")).collect()} == {0}


def test_replicates_share_the_rows_of_a_pair(spark, monkeypatch):
    members = spark.createDataFrame([(f"c{i:02d}", f"n{RNG.randrange(12):02d}") for i in range(25) for _ in range(4)], M).distinct().persist()
    written = []

    def counted(df, *by):
        out = G_materialize(df, *by)
        written.append(out.count())
        return out

    G_materialize = G.materialize
    monkeypatch.setattr(G, "materialize", counted)
    got = {r["replicate"]: r for r in G.resampled_curves(members, draws=20, share=0.7).collect()}
    assert max(written) <= members.count() + 20 * 25
    keep = int(0.7 * members.select("narrator").distinct().count())
    names = sorted({n for _, n in rows(members)})
    for r in (0, 7, 19):
        kept = sorted(names, key=lambda n: hashlib.md5(f"0|{r}|{n}".encode()).hexdigest())[:keep]
        sub = members.filter(F.col("narrator").isin(kept))
        curve = G.filtration(sub).orderBy("k").collect()
        assert got[r]["n_cells"] == sub.select("cid").distinct().count() and got[r]["n_edges"] == G.cowitness(sub).count()
        for i in "01":
            values = [c[f"beta{i}"] for c in curve]
            assert got[r][f"area{i}"] == sum((a + b) / 2 for a, b in zip(values, values[1:]))


def _company(members):
    """Members of each cell, all narrators, and who shares a cell with whom."""
    cells, near = {}, {}
    for c, n in members:
        cells.setdefault(c, set()).add(n)
    for inside in cells.values():
        for n in inside:
            near.setdefault(n, set()).update(inside - {n})
    return cells, sorted(near), near


def _hot_members(spark):
    """Cells of which many hold one narrator, and many narrators who know few."""
    held = {(f"c{i:02d}", n) for i in range(40) for n in (["hot"] if i % 4 else []) + [f"n{i * 3 + j:03d}" for j in range(i % 5)]} | {(f"c{i:02d}", f"n{i * 5:03d}") for i in range(20)}
    return held, spark.createDataFrame(sorted(held), M)


def test_hard_negatives_count_company_in_blocks(spark):
    held, members = _hot_members(spark)
    cells, names, near = _company(held)
    want = set()
    for c, inside in cells.items():
        scored = [(len(near[b] & inside), b) for b in names if b not in inside and near[b] & inside]
        want |= {(c, max(scored)[1])} if scored else set()
    got = NEG.company(members, NEG._most_known, block=7)
    assert set(rows(got)) == want and rows(NEG.hardest_by_company(members)) == sorted(want)
    assert NEG.hardest_by_company(members.filter("false")).count() == 0


def test_large_spectra_are_iterated_in_one_task(spark, monkeypatch):
    held = [(f"c{i:03d}", f"n{RNG.randrange(90):03d}") for i in range(150) for _ in range(4)] + [("d0", "z0"), ("d0", "z1"), ("e0", "z2")]
    lap = G.laplacian(spark.createDataFrame(held, M).distinct()).persist()
    dense = {(r["a"], r["b"]): r["value"] for r in lap.collect()}
    names = sorted({a for a, _ in dense})
    m = np.array([[dense.get((a, b), 0.0) for b in names] for a in names])
    monkeypatch.setattr(G, "spectral_by_iteration", None)
    got = G.spectral_encoding(lap, 6, most=5).collect()
    v = np.zeros((len(names), 6))
    for r in got:
        v[names.index(r["node"]), r["pos"]] = r["value"]
    least = np.linalg.eigvalsh(m)[:7]
    assert np.abs(least[:3]).max() < 1e-9  # three components: the eigenvalue 0 thrice
    assert np.abs(v.T @ v - np.eye(6)).max() < 1e-6 and np.abs(m @ v - v * least[1:]).max() < 1e-6


def test_encodings_solve_the_spectrum_once(spark, monkeypatch):
    _, members = _hot_members(spark)
    solved = spark.sparkContext.accumulator(0)
    spectral_encoding = G.spectral_encoding

    def counted(entries, k):
        def seen(pdfs):
            solved.add(1)
            yield from pdfs

        return spectral_encoding(entries, k).coalesce(1).mapInPandas(seen, "node string, pos long, value double")

    monkeypatch.setattr(G, "spectral_encoding", counted)
    assert len(G.encodings(members, members.select("narrator").distinct(), 3).collect()[0]["block"]) == 8
    assert solved.value == 1


def test_cliques_count_company_in_blocks(spark):
    held, members = _hot_members(spark)
    cells, names, near = _company(held)
    md5 = lambda c, n: (hashlib.md5(f"0|{c}|{n}".encode()).hexdigest(), n)
    want = set()
    for c, inside in cells.items():
        dropped = min(inside, key=lambda n: md5(c, n))
        met = [n for n in names if n not in inside and len(inside) > 1 and inside - {dropped} <= near[n]]
        want |= {(c, dropped, min(met, key=lambda n: md5(c, n)))} if met else set()
    assert want and set(rows(NEG.clique(members))) == want
