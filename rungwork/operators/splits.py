"""Splits of units, routed incidences, exposure of narrators to more than one fold, and text left for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungwork.functions.keys import canonical_key
from rungwork.operators.skew import number_rows

FRACTIONS = (0.7, 0.15, 0.15)


def hash_order(seed: int, *parts: str) -> Column:
    """A place that depends on seed and unit only: the same on every engine with MD5."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts]))


def make_split(units: DataFrame, unit: str = "unit", seed: int = 0, fractions: tuple[float, float, float] = FRACTIONS, by: str | None = None) -> DataFrame:
    """``unit, bucket``: units in hash order, the first 70 % (rounded down) train, the next 15 % val, the rest test.

    With ``by``, the units of each of its values are split by themselves, in one pass. Places are numbered over ranges
    of the hash, so no task orders more than its share of the units.
    """
    key = F.col(by) if by else F.lit(1)
    u = units.select(key.alias("_by"), unit).distinct().select("_by", unit, hash_order(seed, unit).alias("_h"))
    placed = number_rows(u, ["_by"], ["_h", unit])
    total = placed.groupBy("_by").agg(F.count(F.lit(1)).alias("_total"))
    train, val = F.floor(F.lit(fractions[0]) * F.col("_total")), F.floor(F.lit(fractions[1]) * F.col("_total"))
    return placed.join(F.broadcast(total), "_by").select(*([F.col("_by").alias(by)] if by else []), unit, F.when(F.col("_pos") < train, "train").when(F.col("_pos") < train + val, "val").otherwise("test").alias("bucket"))


def stored_split(splits: DataFrame, kind: str) -> DataFrame:
    """``unit, bucket`` of a stored split with bucket names made one; the smaller name if a unit has several."""
    b = F.lower(F.trim("bucket"))
    named = F.when(b.isin("validation", "dev"), "val").otherwise(b)
    return splits.filter((F.col("split_kind") == kind) & F.col("unit").isNotNull()).select(F.trim("unit").alias("unit"), named.alias("bucket")).filter(F.col("bucket").isin("train", "val", "test")).groupBy("unit").agg(F.min("bucket").alias("bucket"))


def partition_incidences(pairs: DataFrame, split: DataFrame, unit: str) -> DataFrame:
    """``pairs`` with the bucket of their unit; a unit that the split doesn't know is in test."""
    s = split.select(F.col("unit").alias("_u"), "bucket")
    return pairs.join(s, F.col(unit) == F.col("_u"), "left").select(*pairs.columns, F.coalesce("bucket", F.lit("test")).alias("bucket"))


def straddle(routed: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row, or one for each value of ``by``: narrators, those in more than one bucket and their share."""
    per = routed.groupBy(*by, "narrator").agg(F.count_distinct("bucket").alias("_k"))
    return per.groupBy(*by).agg(F.count(F.lit(1)).alias("n_narrators"), F.count_if(F.col("_k") > 1).alias("n_straddling"), F.avg((F.col("_k") > 1).cast("double")).alias("share"))


def exposure_law(pairs: DataFrame, fractions: tuple[float, ...] = FRACTIONS) -> DataFrame:
    """One row: the share of narrators expected in more than one fold if every pair were drawn by itself."""
    per = pairs.groupBy("narrator").agg(F.count(F.lit(1)).alias("k"))
    one = sum((F.pow(F.lit(p), F.col("k")) for p in fractions[1:]), F.pow(F.lit(fractions[0]), F.col("k")))
    two = F.pow(F.lit(fractions[0]), F.col("k")) + F.pow(F.lit(1 - fractions[0]), F.col("k"))
    return per.agg(F.count(F.lit(1)).alias("n_narrators"), F.avg("k").alias("k_mean"), F.avg((F.col("k") == 1).cast("double")).alias("k_one"), F.avg(1 - one).alias("exposure"), F.avg(1 - two).alias("exposure_two_folds"))


def training_pairs(held: DataFrame, supports: DataFrame, voices: DataFrame) -> DataFrame:
    """``narrator, segment_id`` pairs without a held-out incidence through that segment.

    ``held`` has the held-out ``narrator, cid``; a pair is dropped if the segment supports such a cell of its narrator.
    """
    through = held.join(supports.select("cid", "segment_id").distinct(), "cid").select("narrator", "segment_id").distinct()
    return voices.select("narrator", "segment_id").distinct().join(through, ["narrator", "segment_id"], "left_anti")


def canonical_units(splits: DataFrame, kind: str) -> DataFrame:
    """:func:`stored_split` with units as canonical keys."""
    return stored_split(splits, kind).select(canonical_key(F.col("unit")).alias("unit"), "bucket").groupBy("unit").agg(F.min("bucket").alias("bucket"))
