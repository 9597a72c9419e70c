import math

from pyspark.sql import functions as F

from rungwork.functions import text as T
from rungwork.operators import agreement as A
from rungwork.operators import graph as G
from rungwork.operators import near_duplicates as N
from rungwork.operators import negatives as NEG
from rungwork.operators import perturb as P
from rungwork.operators import ranking as R
from rungwork.operators import splits as S
from rungwork.operators import statistics as ST
from rungwork.operators import vectors as V
from tests.conftest import rows


def test_ranking_metrics(spark):
    df = spark.createDataFrame([("q", 1, 1), ("q", 2, 0), ("q", 3, 1)], "query string, pos long, rel int")
    r = R.retrieval_metrics(df).first()
    assert math.isclose(r["ap"], (1 + 2 / 3) / 2) and r["recall"] == 1 and r["rr"] == 1
    one = spark.createDataFrame([("q", 2, 1)], "query string, pos long, rel int")
    assert math.isclose(R.retrieval_metrics(one).first()["ndcg"], 1 / math.log2(3))


def test_auc_of_perfect_reversed_tied_and_single_class(spark):
    data = [("p", 1, 0.9), ("p", 0, 0.1), ("r", 1, 0.1), ("r", 0, 0.9), ("t", 1, 0.5), ("t", 0, 0.5), ("s", 1, 0.3)]
    got = {x["g"]: x["auc_roc"] for x in R.auc(spark.createDataFrame(data, "g string, y int, s double"), ["g"], "y", "s").collect()}
    assert got == {"p": 1.0, "r": 0.0, "t": 0.5, "s": None}


def test_list_overlap_of_equal_and_disjoint_lists(spark):
    data = [("a", i + 1, x) for i, x in enumerate("abcde")] + [("b", i + 1, x) for i, x in enumerate("abcde")] + [("c", i + 1, x) for i, x in enumerate("vwxyz")]
    lists = spark.createDataFrame(data, "list_id string, pos int, item string")
    got = {(r["list_a"], r["list_b"]): round(r["rbo"], 9) for r in R.rank_biased_overlap(lists).collect()}
    assert got == {("a", "b"): 1.0, ("a", "c"): 0.0, ("b", "c"): 0.0}
    assert {(r["list_a"], r["list_b"]): r["jaccard"] for r in R.jaccard_at(lists, 3).collect()}[("a", "b")] == 1.0


def test_split_is_proportional_and_repeatable(spark):
    units = spark.range(1000).select(F.col("id").cast("string").alias("unit"))
    a, b = S.make_split(units), S.make_split(units.repartition(7))
    assert rows(a) == rows(b)
    assert {r["bucket"]: r["count"] for r in a.groupBy("bucket").count().collect()} == {"train": 700, "val": 150, "test": 150}
    assert S.make_split(units.filter("false")).count() == 0


def test_agreement(spark):
    same = spark.createDataFrame([(a, f"t{i}", 2 + i % 2) for a in "xyz" for i in range(6)], "annotator string, item string, label int")
    d = A.diagnostics(same).first()
    assert d["unanimity"] == 1 and math.isclose(d["fleiss_kappa"], 1) and math.isclose(A.ordinal_alpha(same.withColumn("g", F.lit(1)), ["g"]).first()["alpha"], 1)
    flat = same.withColumn("label", F.lit(2))
    assert A.ordinal_alpha(flat.withColumn("g", F.lit(1)), ["g"]).first()["alpha"] is None


def test_statistics(spark):
    data = [(c, c * 10.0 + i % 2) for c in range(40) for i in range(20)]
    assert ST.design_effect(spark.createDataFrame(data, "c int, v double"), "c", "v").first()["deff"] > 5
    x = spark.createDataFrame([(float(i),) for i in range(10)], "v double")
    assert ST.ks_distance(x, x, "v").first()["ks"] == 0 and ST.ks_distance(x, x.filter("v > 8"), "v").first()["ks"] is None
    ab = x.select(F.lit("a").alias("g"), "v").unionByName(x.select(F.lit("b").alias("g"), (F.col("v") - 100).alias("v")))
    assert ST.violation_ratio(ab, "g", "a", "b", "v").first()["ratio"] == 0
    b = ST.bootstrap_mean(x.select(F.monotonically_increasing_id().alias("u"), "v"), "u", "v", 100).first()
    assert b["lo"] < b["mean"] < b["hi"]
    same = spark.createDataFrame([(i, i % 3) for i in range(9)], "item int, gold_id int")
    s = ST.clustering_scores(same, same.select("item", F.col("gold_id").alias("sys_id"))).first()
    assert all(math.isclose(v, 1) for v in s)
    line = x.select("v", (2 * F.col("v") + 1).alias("y"))
    fit = ST.slope_hc3(line, "v", "y").first()
    assert math.isclose(fit["slope"], 2) and abs(fit["se"]) < 1e-9


MEMBERS = [("x", "a"), ("x", "b"), ("x", "c"), ("y", "b"), ("y", "c"), ("z", "d")]


def test_graph(spark):
    m = spark.createDataFrame(MEMBERS, "cid string, narrator string")
    assert rows(G.cowitness(m).select("a", "b", "weight")) == [("a", "b", 1), ("a", "c", 1), ("b", "c", 2)]
    assert rows(G.filtration(m)) == [(1, 3, 1, 1), (2, 2, 1, 1), (3, 1, 1, 1)]
    ground = spark.createDataFrame([("a",), ("q",)], "narrator string")
    assert rows(G.degree_profile(m, ground)) == [("a", 1, 3.0, 3, 3), ("q", 0, 0.0, 0, 0)]
    v = G.spectral_encoding(G.laplacian(m), 2)
    assert v.count() == 8


def test_negatives_are_no_members(spark):
    m = spark.createDataFrame(MEMBERS, "cid string, narrator string")
    ground = m.select("narrator").distinct()
    inside = {tuple(r) for r in m.collect()}
    got = NEG.uniform(m, m, ground, draws=3).collect()
    assert len(got) == 9 and not any((r["cid"], r["negative"]) in inside for r in got)
    whole = spark.createDataFrame([("w", n) for n in "abcd"], "cid string, narrator string")
    assert NEG.uniform(whole, whole, ground).count() == 0
    g = G.both_ways(G.cowitness(m))
    assert {(r["cid"], r["negative"]) for r in NEG.clique(m, g).collect()} <= {("y", "a")}
    assert not any((r["cid"], r["negative"]) in inside for r in NEG.motif(m, g).collect())


def test_perturbation_keeps_members(spark):
    m = spark.createDataFrame([(f"c{i}", f"n{j}") for i in range(20) for j in range(i % 5 + 1)], "cid string, narrator string")
    assert rows(P.perturb(m, 0, 0).select("cid", "narrator")) == rows(m)
    merged = P.perturb(m, 0.25, 0)
    assert merged.select("cid").distinct().count() == 15 and {r[0] for r in merged.select("narrator").collect()} == {f"n{j}" for j in range(5)}


def test_near_duplicates_against_brute_force(spark):
    base = [f"w{i}" for i in range(60)]
    texts = {"a": base, "b": [*base[:59], "zz"], "c": base, "d": [f"v{i}" for i in range(60)], "e": base[:5], "f": None}
    df = spark.createDataFrame([(k, " ".join(v) if v else None) for k, v in texts.items()], "id string, t string")
    assert rows(N.near_duplicates(df, "id", "t").select("id", "n_copies", "n_links")) == [("a", 2, 1), ("b", 1, 1), ("c", 2, 1), ("d", 1, 0)]
    assert N.near_duplicates(df.filter("false"), "id", "t").count() == 0


def test_vectors(spark):
    v = spark.createDataFrame([("n1", [1.0, 0.0]), ("n1", [3.0, 0.0]), ("n2", [0.0, 5.0])], "id string, vec array<double>")
    assert {r["id"]: r["vec"] for r in V.mean_vectors(v, ["id"], "vec").collect()} == {"n1": [2.0, 0.0], "n2": [0.0, 5.0]}
    assert v.select(V.normalised(F.array(F.lit(0.0), F.lit(0.0))).alias("z")).first()["z"] == [0.0, 0.0]


def test_texts(spark):
    df = spark.createDataFrame([("<p>A &amp; <b>b</b></p>", "Narrators: Ann Lee (primary), Bo Ray and Cy\nInterviewer: Di Fox", "It was 12.5 in 1944, then 1,200 and 7 at 10:30.")], "a string, b string, c string")
    r = df.select(T.strip_markup(F.col("a")).alias("a"), T.header_names(F.col("b"), "Narrator").alias("b"), T.quoted_numbers(F.col("c")).alias("c"), T.tidy_author(F.lit("Lee, Ann")).alias("d"), T.phrase_counts(F.lit("the same time, the same"), ["same", "the same time"]).alias("e"), T.fixed(F.lit(1.25), 1).alias("f")).first()
    assert r["a"] == "A & b" and r["b"] == ["Ann Lee", "Bo Ray", "Cy"] and r["c"] == [12.5, 1200.0] and r["d"] == "Ann Lee" and r["e"] == [1, 1]
