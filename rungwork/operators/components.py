"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rungwork.operators.skew import salted_join
from rungwork.session import materialize

MAX_ROUNDS = 60


def _large_star(e: DataFrame, n: int) -> DataFrame:
    both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return salted_join(least, both.filter(F.col("v") > F.col("u")), "u", build_rows=2 * n).select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(e: DataFrame, n: int) -> DataFrame:
    least = e.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = salted_join(least, e, "hi", build_rows=n).filter(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """``node, component``: every node of ``edges`` with the smallest node of its component.

    Each round is one large-star and one small-star step and is written to the shared folder; minima are pre-aggregated
    and the edges of a node with many neighbours are salted. The loop ends when the edges no longer change, and raises
    after ``max_rounds``. Edges with a NULL end are ignored; a self-loop makes its node a component of its own;
    repeated and reversed edges count once; an empty input gives an empty result.
    """
    known = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
    known = materialize(known.distinct())
    nodes = known.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    e = known.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    e, mark = materialize(e), None
    for _ in range(max_rounds):
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
        # a large star has at most as many edges as it is given
        e = materialize(_small_star(_large_star(e, now[0]), now[0]))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return nodes.join(e, F.col("node") == F.col("hi"), "left").select("node", F.coalesce("lo", "node").alias("component"))
