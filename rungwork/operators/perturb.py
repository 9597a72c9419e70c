"""Perturbed complexes: merged and split cells at given rates, chosen by hash, and how stable a triage stays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rungwork.operators.skew import number_rows, salted_join
from rungwork.operators.splits import hash_order
from rungwork.session import materialize

#: Rates of merged and of split cells of the grid.
RATES = (0.0, 0.025, 0.05, 0.1, 0.2)


def perturb(members: DataFrame, merge_rate: float, split_rate: float, seed: int = 0) -> DataFrame:
    """``cid, narrator`` after merging and then splitting cells: :func:`perturb_many` for one pair of rates."""
    plan = members.sparkSession.createDataFrame([(0, float(merge_rate), float(split_rate), seed)], PLAN)
    return perturb_many(members, plan).select("cid", "narrator")


#: Columns of the replicates to make.
PLAN = "replicate int, merge_rate double, split_rate double, seed int"


def grid(merge_rates: Sequence[float], split_rates: Sequence[float], draws: int, seed: int = 0) -> list[tuple[int, float, float, int]]:
    """Rows of a plan: ``draws`` replicates for each pair of rates."""
    pairs = [(m, s) for m in merge_rates for s in split_rates]
    return [(i * draws + j, float(m), float(s), seed + 100 * i + j) for i, (m, s) in enumerate(pairs) for j in range(draws)]


def perturb_many(members: DataFrame, plan: DataFrame) -> DataFrame:
    """``replicate, cid, narrator``: for each replicate of the plan, the members after merging and then splitting cells.

    Cells are put in hash order; the first ``2 * round(merge_rate * n)`` are merged two by two, so merges never chain.
    Of the cells left, ``round(split_rate * n)`` with at least two members, in hash order, are cut into halves by hash.
    All depends on seed and keys only. Replicates are rows of one plan, and places are numbered exactly over ranges, so
    no task orders a whole replicate. ``plan`` has the columns of ``PLAN`` and is small.
    """
    h = lambda shift, *cols: F.md5(F.concat_ws("|", (F.col("seed") + shift).cast("string"), *cols))
    cells = members.select("cid").distinct()
    n = cells.count()
    dealt = cells.crossJoin(F.broadcast(plan)).select("replicate", "seed", "merge_rate", "split_rate", "cid", h(0, "cid").alias("_h"))
    placed = number_rows(dealt, ["replicate"], ["_h", "cid"])
    paired = F.when(F.col("_pos") < 2 * F.floor(F.col("merge_rate") * n + 0.5), F.floor(F.col("_pos") / 2))
    placed = placed.withColumn("_g", paired)
    heads = placed.filter("_g is not null").groupBy("replicate", "_g").agg(F.min("cid").alias("_new"))
    named = placed.join(heads, ["replicate", "_g"], "left").select("replicate", "seed", "split_rate", "cid", F.coalesce("_new", "cid").alias("new"))
    after = materialize(members.select("cid", "narrator").distinct().join(named, "cid").select("replicate", "seed", "split_rate", F.col("new").alias("cid"), "narrator").distinct())
    sizes = after.groupBy("replicate", "seed", "split_rate", "cid").agg(F.count(F.lit(1)).alias("_s"))
    m = sizes.groupBy("replicate").agg(F.count(F.lit(1)).alias("_m"))
    ranked = number_rows(sizes.filter("_s >= 2").select("replicate", "split_rate", "cid", "_s", h(1, "cid").alias("_h")), ["replicate"], ["_h", "cid"])
    cut = ranked.join(F.broadcast(m), "replicate").filter(F.col("_pos") < F.floor(F.col("split_rate") * F.col("_m") + 0.5)).select("replicate", "cid", "_s")
    torn = after.join(cut, ["replicate", "cid"]).select("replicate", "cid", "_s", "narrator", h(2, "cid", "narrator").alias("_h"))
    halves = number_rows(torn, ["replicate", "cid"], ["_h", "narrator"]).select("replicate", F.when(2 * (F.col("_pos") + 1) > F.col("_s"), F.concat("cid", F.lit("#2"))).otherwise(F.col("cid")).alias("cid"), "narrator")
    return after.join(cut, ["replicate", "cid"], "left_anti").select("replicate", "cid", "narrator").unionByName(halves)


def error_rates(members: DataFrame, supports: DataFrame, threshold: float = 0.8) -> DataFrame:
    """One row ``n_pairs, n_alike, merge_rate, split_rate`` estimated from a complex's events.

    ``merge_rate`` is the share of pairs of cells with a similarity of at least ``threshold``; only pairs that share a
    narrator are formed, by an inverted index. ``split_rate`` is the share of cells of four members or more that have
    more than twice as many segments as members.
    """
    size = members.groupBy("cid").agg(F.count(F.lit(1)).alias("n"))
    x, y = (members.select("narrator", F.col("cid").alias(z)) for z in "ab")
    both = salted_join(x, y, "narrator").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"))
    sim = both.join(size.select(F.col("cid").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("cid").alias("b"), F.col("n").alias("nb")), "b").filter(F.col("k") >= threshold * (F.col("na") + F.col("nb") - F.col("k"))).agg(F.count(F.lit(1)).alias("n_alike"))
    n = size.agg((F.count(F.lit(1)) * (F.count(F.lit(1)) - 1) / 2).cast("long").alias("n_pairs"))
    segs = supports.groupBy("cid").agg(F.count_distinct("segment_id").alias("s"))
    split = size.join(segs, "cid").agg(F.avg(((F.col("n") >= 4) & (F.col("s") > 2 * F.col("n"))).cast("double")).alias("split_rate"))
    return n.crossJoin(sim).crossJoin(split).select("n_pairs", "n_alike", F.try_divide("n_alike", F.col("n_pairs")).alias("merge_rate"), "split_rate")


def anonymise(voices: DataFrame, seed: int = 0) -> DataFrame:
    """``segment_id, narrator`` with the narrators dealt anew over all slots: how often each speaks stays as it was.

    Slots and labels are numbered exactly in two orders, by key and by hash, and joined by number.
    """
    slots = voices.select(F.lit(1).alias("_all"), "segment_id", "narrator")
    a = number_rows(slots, ["_all"], ["segment_id", "narrator"]).select("segment_id", "_pos")
    dealt = slots.select("_all", "narrator", hash_order(seed, "segment_id", "narrator").alias("_h"))
    b = number_rows(dealt, ["_all"], ["_h", "narrator"]).select("narrator", "_pos")
    return a.join(b, "_pos").select("segment_id", "narrator")


def _smallest(sizes: DataFrame, k: int) -> DataFrame:
    """The ``k`` smallest cells of each replicate; the limit is applied before rows are shuffled."""
    pos = F.row_number().over(W.partitionBy("replicate").orderBy("size", "cid"))
    return sizes.withColumn("_i", pos).filter(F.col("_i") <= k).select("replicate", "cid", "size")


def triage_stability(members: DataFrame, merge_rates: Sequence[float] = RATES, split_rates: Sequence[float] = RATES, draws: int = 20, k: int = 50, seed: int = 0) -> DataFrame:
    """``cid, share``: in which share of all perturbed complexes a cell is among the ``k`` smallest."""
    rows = grid(merge_rates, split_rates, draws, seed)
    sizes = perturb_many(members, members.sparkSession.createDataFrame(rows, PLAN)).groupBy("replicate", "cid").agg(F.count(F.lit(1)).alias("size"))
    return _smallest(sizes, k).groupBy("cid").agg((F.count(F.lit(1)) / len(rows)).alias("share"))


def triage_grid(members: DataFrame, merge_rates: Sequence[float] = RATES, split_rates: Sequence[float] = RATES, draws: int = 20, k: int = 50, seed: int = 0) -> DataFrame:
    """``merge_rate, split_rate, overlap, singletons``: of each pair of rates, means over its draws.

    ``overlap`` is the Jaccard similarity of the ``k`` smallest cells with those of the complex itself, ``singletons``
    the share of cells with one member.
    """
    spark = members.sparkSession
    plan = spark.createDataFrame(grid(merge_rates, split_rates, draws, seed), PLAN)
    sizes = materialize(perturb_many(members, plan).groupBy("replicate", "cid").agg(F.count(F.lit(1)).alias("size")))
    own = _smallest(members.select("cid", "narrator").distinct().groupBy("cid").agg(F.count(F.lit(1)).alias("size")).withColumn("replicate", F.lit(-1)), k).select("cid", F.lit(1).alias("_own"))
    n_own = own.count()
    top = _smallest(sizes, k).join(F.broadcast(own), "cid", "left").groupBy("replicate").agg(F.count("_own").alias("_both"), F.count(F.lit(1)).alias("_n"))
    ones = sizes.groupBy("replicate").agg(F.avg((F.col("size") == 1).cast("double")).alias("_ones"))
    per = plan.join(top, "replicate").join(ones, "replicate")
    return per.groupBy("merge_rate", "split_rate").agg(F.avg(F.col("_both") / (F.col("_n") + n_own - F.col("_both"))).alias("overlap"), F.avg("_ones").alias("singletons"))


def false_singletons(members: DataFrame, merge_rate: float, split_rate: float, draws: int = 40, k: int = 50, seed: int = 11) -> DataFrame:
    """``cid, size, share``: of the ``k`` smallest cells with two members or more, in how many draws each seems single.

    What an error in telling cells apart would cost: a cell that several attest is taken for one that a single does.
    """
    plan = members.sparkSession.createDataFrame(grid([merge_rate], [split_rate], draws, seed), PLAN)
    sizes = perturb_many(members, plan).groupBy("replicate", "cid").agg(F.count(F.lit(1)).alias("size"))
    own = _smallest(members.select("cid", "narrator").distinct().groupBy("cid").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").withColumn("replicate", F.lit(-1)), k).select("cid", "size")
    hits = sizes.filter("size = 1").groupBy("cid").agg(F.count(F.lit(1)).alias("_c"))
    return own.join(hits, "cid", "left").select("cid", "size", (F.coalesce("_c", F.lit(0)) / draws).alias("share"))
