"""Outcomes of models by item and stratum, merged and split clusters, changed rank maps and turns with offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rungwork.operators.skew import last_in_blocks, number_rows, running_sum_in_blocks
from rungwork.operators.splits import hash_order
from rungwork.operators.statistics import clusters_overlap, poisson_count, uniform_hash


def outcomes(scored: DataFrame, by: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """``scored`` with ``correct``: whether a score at or above the median of its group goes with label 1."""
    middle = scored.groupBy(*by).agg(F.expr(f"percentile({score}, 0.5)").alias("_t"))
    return scored.join(middle, by).withColumn("correct", ((F.col(score) >= F.col("_t")) == (F.col(label) == 1)).cast("int")).drop("_t")


def stratified_means(df: DataFrame, by: list[str], unit: str, value: str, draws: int = 2_000, seed: int = 0) -> DataFrame:
    """``by, mean, lo, hi, n_rows, n_units`` of each stratum; percentile intervals over resampled units.

    Units are reduced to sums and counts per stratum first; draws of all strata are rows of one plan.
    """
    u = df.filter(F.col(value).isNotNull() & F.col(unit).isNotNull()).groupBy(*by, unit).agg(F.sum(value).cast("double").alias("_s"), F.count(F.lit(1)).alias("_n"))
    point = u.groupBy(*by).agg((F.sum("_s") / F.sum("_n")).alias("mean"), F.sum("_n").alias("n_rows"), F.count(F.lit(1)).alias("n_units"))
    r = u.withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("_w", poisson_count(uniform_hash(seed, F.col("_r"), F.col(unit))))
    means = r.groupBy(*by, "_r").agg(F.try_divide(F.sum(F.col("_w") * F.col("_s")), F.sum(F.col("_w") * F.col("_n"))).alias("_m"))
    spread = means.groupBy(*by).agg(F.expr("percentile(_m, 0.025)").alias("lo"), F.expr("percentile(_m, 0.975)").alias("hi"))
    return point.join(spread, by).select(*by, "mean", "lo", "hi", "n_rows", "n_units")


def gap_interval(df: DataFrame, side: str, a: str, b: str, replicate: str, value: str, draws: int = 10_000, seed: int = 0) -> DataFrame:
    """One row ``point, lo, hi, n_replicates``: mean under ``a`` less that under ``b``, replicates resampled in each.

    The interval tells the noise of the replicates alone. A draw without any replicate of a side counts for nothing.
    """
    u = df.filter(F.col(side).isin(a, b) & F.col(value).isNotNull()).groupBy(F.col(side).alias("_side"), replicate).agg(F.avg(value).alias("_v"))
    r = u.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(draws)))).withColumn("_w", F.when(F.col("_r") == 0, 1).otherwise(poisson_count(uniform_hash(seed, F.col("_r"), F.col("_side"), F.col(replicate)))))
    of = lambda s: F.try_divide(F.sum(F.when(F.col("_side") == s, F.col("_w") * F.col("_v"))), F.sum(F.when(F.col("_side") == s, F.col("_w"))))
    d = r.groupBy("_r").agg((of(a) - of(b)).alias("_d"))
    n = u.groupBy("_side").agg(F.count(F.lit(1)).alias("_c")).agg(F.min("_c").alias("n_replicates"))
    gap = d.agg(F.max(F.when(F.col("_r") == 0, F.col("_d"))).alias("point"), F.expr("percentile(_d, 0.025) FILTER (WHERE _r > 0)").alias("lo"), F.expr("percentile(_d, 0.975) FILTER (WHERE _r > 0)").alias("hi"))
    return gap.crossJoin(n)


def merges_and_splits(gold: DataFrame, system: DataFrame, voices: DataFrame) -> DataFrame:
    """``band, n, split_rate, size_mean``: gold clusters by the narrators that attest them, and how many are torn apart.

    ``gold`` and ``system`` have ``item`` and their id, ``voices`` ``item, narrator``. A gold cluster is torn if its items
    lie in two system clusters or more.
    """
    parts = clusters_overlap(gold, system).groupBy("gold_id").agg(F.count(F.lit(1)).alias("_k"))
    who = gold.join(voices.select("item", "narrator").distinct(), "item").groupBy("gold_id").agg(F.count_distinct("narrator").alias("_a"))
    per = gold.select("gold_id").distinct().join(parts, "gold_id", "left").join(who, "gold_id", "left").withColumn("_a", F.coalesce("_a", F.lit(0)))
    band = F.when(F.col("_a") < 1, "0").when(F.col("_a") <= 1, "1").when(F.col("_a") <= 3, "2-3").when(F.col("_a") <= 10, "4-10").when(F.col("_a") <= 50, "11-50").otherwise("51+")
    return per.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.coalesce("_k", F.lit(0)) >= 2).cast("double")).alias("split_rate"), F.avg("_a").alias("size_mean"))


def merged_pairs(gold: DataFrame, system: DataFrame) -> DataFrame:
    """One row ``n_merged, n_comparable``: pairs of gold clusters that a system cluster throws together, and all pairs."""
    g = clusters_overlap(gold, system).groupBy("sys_id").agg(F.count(F.lit(1)).alias("_g"))
    n = gold.agg(F.count_distinct("gold_id").alias("_n"))
    return g.agg(F.coalesce(F.sum(F.col("_g") * (F.col("_g") - 1) / 2), F.lit(0.0)).cast("long").alias("n_merged")).crossJoin(n).select("n_merged", (F.col("_n") * (F.col("_n") - 1) / 2).cast("long").alias("n_comparable"))


def shuffled_map(rank_map: DataFrame, seed: int = 0) -> DataFrame:
    """``term, cell_rank`` with the ranks dealt anew: as many of each as before. Terms and ranks meet by number."""
    one = rank_map.select(F.lit(1).alias("_all"), "term", "cell_rank").withColumn("_h", hash_order(seed, "term"))
    terms = number_rows(one.select("_all", "term"), ["_all"], ["term"]).select("_pos", "term")
    ranks = number_rows(one.select("_all", "_h", "term", "cell_rank"), ["_all"], ["_h", "term"]).select("_pos", "cell_rank")
    return terms.join(ranks, "_pos").select("term", "cell_rank")


def collapsed_map(rank_map: DataFrame, rank: int = 2) -> DataFrame:
    """``term, cell_rank`` with one rank for all terms."""
    return rank_map.select("term", F.lit(rank).alias("cell_rank"))


def completed_map(first: DataFrame, other: DataFrame) -> DataFrame:
    """``term, cell_rank`` of the first map, and of the other for terms that the first doesn't know."""
    a, b = first.select("term", F.col("cell_rank").alias("_a")), other.select("term", F.col("cell_rank").alias("_b"))
    return a.join(b, "term", "full_outer").select("term", F.coalesce("_a", "_b").alias("cell_rank"))


def own_vectors(features: DataFrame, vectors: DataFrame) -> DataFrame:
    """Features of moments with the segment's own vector in place of the mean, where it has one; the rank flags stay.

    ``features`` has ``cell_rank, cid, feature``, ``vectors`` ``segment_id, vec``; a moment's ``cid`` is its segment.
    """
    v = vectors.select(F.lit(1).alias("cell_rank"), F.col("segment_id").alias("cid"), F.transform("vec", lambda x: x.cast("double")).alias("_v"))
    flags = F.slice("feature", F.size("feature") - 3, F.lit(4))
    return features.join(v, ["cell_rank", "cid"], "left").select("cell_rank", "cid", F.when(F.col("_v").isNull(), F.col("feature")).otherwise(F.concat("_v", flags)).alias("feature"))


def spread_within_narrators(features: DataFrame, members: DataFrame) -> DataFrame:
    """``narrator, n, spread``: widest range of any feature over the moments of which a narrator is the only member."""
    alone = members.filter("cell_rank = 1").groupBy("cid").agg(F.max("narrator").alias("narrator"), F.count(F.lit(1)).alias("_n")).filter("_n = 1").select("cid", "narrator")
    long = features.filter("cell_rank = 1").join(alone, "cid").select("narrator", "cid", F.posexplode("feature").alias("_i", "_x"))
    per = long.groupBy("narrator", "_i").agg((F.max("_x") - F.min("_x")).alias("_r"), F.count_distinct("cid").alias("_n"))
    return per.groupBy("narrator").agg(F.max("_n").alias("n"), F.max("_r").alias("spread")).filter("n > 1")


#: A turn's tag at the start of a line, and the mark of a segment.
TURN, SEGMENT = r"(?m)^\s*[A-Z][A-Za-z]?[A-Z]?\s*:\s", r"(?i)<Begin Segment (\d+)>"


def cut_turns(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, turn_no, speaker_tag, segment_no, char_start, char_end, raw`` of the turns of each text.

    A turn runs from behind its tag to the next tag or the end; offsets count characters of the text. The segment is the
    last one marked before the tag. What stands before the first tag is no turn. Offsets are prefix sums in blocks.
    """
    parts = texts.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, F.split(text, TURN, -1).alias("_b"), F.regexp_extract_all(text, F.lit(TURN), F.lit(0)).alias("_t"))
    rows = parts.select(key, F.posexplode(F.arrays_zip(F.concat(F.array(F.lit("")), "_t").alias("tag"), F.col("_b").alias("body"))).alias("turn_no", "p")).select(key, F.col("turn_no").cast("long").alias("turn_no"), "p.tag", "p.body")
    sized = rows.withColumn("_n", F.length("tag") + F.length("body"))
    summed = running_sum_in_blocks(sized, [key], "turn_no", "_n", "_end")
    marks = F.regexp_extract_all("body", F.lit(SEGMENT), F.lit(1))
    marked = summed.withColumn("_m", F.when(F.size(marks) > 0, F.element_at(marks, -1).cast("int")))
    known = last_in_blocks(marked, [key], "turn_no", "_m", "segment_no", strict=True).filter("turn_no > 0")
    tag = F.upper(F.regexp_extract("tag", r"([A-Za-z]+)", 1))
    return known.select(key, F.col("turn_no").cast("int").alias("turn_no"), tag.alias("speaker_tag"), "segment_no", (F.col("_end") - F.length("body")).cast("int").alias("char_start"), F.col("_end").cast("int").alias("char_end"), F.col("body").alias("raw"))
