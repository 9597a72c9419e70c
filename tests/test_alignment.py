import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from rungwork.operators import alignment as AL
from rungwork.operators import perturb as P
from rungwork.operators import statistics as ST


def test_assignment_is_best_by_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n, m = rng.integers(1, 6, 2)
        g = np.round(rng.random((n, m)), 2)
        small, large = (g, m) if n <= m else (g.T, n)
        best = max(sum(small[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(large), len(small)))
        got = AL.assign(g)
        assert len({i for i, _ in got}) == len({j for _, j in got}) == min(n, m) and math.isclose(sum(g[i, j] for i, j in got), best)


def test_ceaf_of_equal_and_of_merged_clusterings(spark):
    gold = spark.createDataFrame([(i, i % 3) for i in range(9)], "item int, gold_id int")
    same = AL.ceaf(gold, gold.select("item", F.col("gold_id").alias("sys_id"))).first()
    assert math.isclose(same["precision"], 1) and math.isclose(same["recall"], 1)
    one = AL.ceaf(gold, gold.select("item", F.lit(0).alias("sys_id"))).first()
    assert math.isclose(one["precision"], 0.5) and math.isclose(one["recall"], 0.5 / 3)


def test_average_linkage_against_the_plain_algorithm():
    rng = np.random.default_rng(4)
    for t in (0.2, 0.6, 1.1):
        x = rng.normal(size=(14, 3))
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        d = 1 - u @ u.T
        groups = [[i] for i in range(len(x))]
        while len(groups) > 1:
            v, a, b = min((np.mean([d[i, j] for i in p for j in q]), a, b) for a, p in enumerate(groups) for b, q in enumerate(groups) if a < b)
            if v >= t:
                break
            groups[a] += groups.pop(b)
        of = AL.average_linkage(x, t)
        assert {frozenset(np.nonzero(of == c)[0]) for c in set(of)} == {frozenset(g) for g in groups}


def test_anonymise_keeps_slots_and_did_is_exact(spark):
    v = spark.createDataFrame([(f"s{i}", f"n{i % 4}") for i in range(40)], "segment_id string, narrator string")
    got = P.anonymise(v)
    assert got.groupBy("narrator").count().filter("count <> 10").count() == 0 and got.select("segment_id").distinct().count() == 40
    df = spark.createDataFrame([(u, g, 5.0 if g == "x" else 2.0, 1.0) for u in range(30) for g in "xy"], "u int, g string, a double, b double")
    r = ST.difference_in_differences(df, "u", "g", "x", "a", "b", 20).first()
    assert (r["did"], r["lo"], r["hi"]) == (3.0, 3.0, 3.0)
    assert spark.range(1).select(AL.title_similarity(F.lit("abc"), F.lit("abd")).alias("r")).first()["r"] > 0.6


def test_large_groups_are_clustered_as_small_ones(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 4))
    x[60:] = x[0]  # a third are copies
    df = spark.createDataFrame([(i, i % 2 if i < 60 else 0, [float(v) for v in r]) for i, r in enumerate(x)], "id int, label int, vec array<double>")
    want = rows_of(AL.cluster_by_similarity(df, ["label"], "id", "vec", [0.1, 0.4, 0.9]))
    assert rows_of(AL.cluster_by_similarity(df, ["label"], "id", "vec", [0.1, 0.4, 0.9], most=12)) == want and len(want) == 270


def test_many_clusters_are_aligned_by_component(spark):
    rng = np.random.default_rng(6)
    for _ in range(60):
        g = np.round(rng.random(rng.integers(1, 7, 2)), 2)
        g[rng.random(g.shape) < 0.5] = 0
        pairs = [(int(i), int(j), float(g[i, j])) for i, j in np.argwhere(g > 0)]
        assert math.isclose(AL.sparse_total(pairs), sum(g[i, j] for i, j in AL.assign(g)), abs_tol=1e-9)
    both = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(rng.integers(0, 12, (60, 2)))], "item int, gold_id int, sys_id int")
    want = AL.ceaf(both.select("item", "gold_id"), both.select("item", "sys_id")).first()
    got = AL.ceaf(both.select("item", "gold_id"), both.select("item", "sys_id"), most=3).first()
    assert math.isclose(got["total"], want["total"]) and math.isclose(got["recall"], want["recall"])


def rows_of(df):
    return sorted(map(tuple, df.collect()))
