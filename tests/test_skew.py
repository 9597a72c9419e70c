import random
from collections import defaultdict

from pyspark.sql import functions as F

from rungwork.operators import skew
from rungwork.operators.components import connected_components
from rungwork.plans.heavy import key_pairs
from tests.conftest import rows


def pairs(spark, data):
    return spark.createDataFrame(data, "k string, item string")


def test_distinct_per_key_matches_brute_force(spark):
    rng = random.Random(3)
    data = [("hot" if rng.random() < 0.5 else f"k{rng.randrange(30)}", f"i{rng.randrange(200)}") for _ in range(4000)]
    want = defaultdict(set)
    n = defaultdict(int)
    for k, i in data:
        want[k].add(i)
        n[k] += 1
    got = rows(skew.distinct_per_key(pairs(spark, data), ["k"], "item", chunk_rows=37))
    assert got == sorted(((k, n[k], len(v)) for k, v in want.items()), key=repr)


def test_positions_are_exact_and_ties_neighbours(spark):
    data = [("a", "x"), ("a", "x"), ("a", "y"), (None, "z"), ("b", None)]
    got = rows(skew.number_rows(pairs(spark, data), ["k"], ["item"]))
    assert got == sorted([("a", "x", 0), ("a", "x", 1), ("a", "y", 2), (None, "z", 0), ("b", None, 0)], key=repr)


def test_empty_and_null_items(spark):
    assert rows(skew.distinct_per_key(pairs(spark, []), ["k"], "item")) == []
    assert rows(skew.distinct_per_key(pairs(spark, [("a", None), ("a", None)]), ["k"], "item", 1)) == [("a", 2, 0)]


def test_last_and_sum_over_blocks(spark):
    data = [("a", i, v) for i, v in enumerate(["p", None, None, "q", None, None, None])]
    df = spark.createDataFrame(data, "k string, at long, v string")
    got = [r["o"] for r in skew.last_in_blocks(df, ["k"], "at", "v", "o", 2).orderBy("at").collect()]
    assert got == ["p", "p", "p", "q", "q", "q", "q"]
    strict = [r["o"] for r in skew.last_in_blocks(df, ["k"], "at", "v", "o", 2, strict=True).orderBy("at").collect()]
    assert strict == [None, "p", "p", "p", "q", "q", "q"]
    s = skew.running_sum_in_blocks(df.withColumn("n", F.lit(2)), ["k"], "at", "n", "o", 3).orderBy("at")
    assert [r["o"] for r in s.collect()] == [2, 4, 6, 8, 10, 12, 14]


def test_salted_join_on_a_hot_key(spark):
    build = spark.range(6000).select(F.when(F.col("id") < 5000, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("b"))
    probe = spark.createDataFrame([(1, "x"), (1, "y"), (5500, "z"), (None, "n")], "k long, p string")
    got = skew.salted_join(probe, build, "k")
    assert got.count() == 10001 and got.filter("p = 'z'").count() == 1


def test_components_match_brute_force(spark):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(300):03d}", f"n{rng.randrange(300):03d}") for _ in range(220)] + [("hub", f"n{i:03d}") for i in range(40)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    want = sorted((x, find(x)) for x in parent)
    df = spark.createDataFrame([*edges, *edges[:5], (None, "n1")], "a string, b string")
    assert [tuple(r) for r in connected_components(df).orderBy("node").collect()] == want


def test_components_of_nothing_and_of_a_chain(spark):
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0
    chain = spark.range(60).select(F.format_string("%03d", "id").alias("a"), F.format_string("%03d", F.col("id") + 1).alias("b"))
    assert {r["component"] for r in connected_components(chain).collect()} == {"000"}


SEGMENTS = "segment_id string, narrators array<string>, topics array<struct<term string, id string>>, item string, _n int"
CELLS = "cid string, members array<string>, field_name string"


def test_key_pairs_with_nulls_spellings_and_clashing_columns(spark):
    s = spark.createDataFrame(
        [("s1", ["OH:1 ", "oh:1", None, " "], [("A--  B", None), (None, None), ("--", None)], "x", 1), ("s2", None, None, None, None), (None, ["oh:9"], [], None, None)],
        SEGMENTS,
    )
    c = spark.createDataFrame([("c1", ["nm:a  b"], "f"), ("c2", [], None)], CELLS)
    assert rows(key_pairs(s, c).distinct()) == sorted([("segments.narrators", "oh:1", "s1"), ("segments.topics", "A -- B", "s1"), ("cells.members", "nm:a b", "c1")], key=repr)


def test_heavy_keys_over_empty_tables(spark):
    empty = key_pairs(spark.createDataFrame([], SEGMENTS), spark.createDataFrame([], CELLS))
    assert skew.distinct_per_key(empty, ["field_name", "key_value"], "item").count() == 0
