"""Features of a ranked complex from vectors of its segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rungwork.operators.skew import salted_join
from rungwork.operators.vectors import mean_vectors, normalised, rank_features


def narrator_vectors(voices: DataFrame, vectors: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """``narrator, vec, n, fallback``: mean of the vectors of each narrator's segments.

    ``voices`` has ``segment_id, narrator`` and ``vectors`` ``segment_id, vec``. With ``allowed`` (pairs of the same
    columns) only a narrator's permitted segments count; permission belongs to the pair, so a segment may count for one
    of its narrators only. A narrator without a permitted segment falls back to all of theirs, which ``fallback`` tells.
    """
    pairs = voices.select("segment_id", "narrator").distinct()
    if allowed is None:
        kept = pairs.withColumn("fallback", F.lit(False))
    else:
        flagged = pairs.join(allowed.select("segment_id", "narrator").distinct().withColumn("_ok", F.lit(True)), ["segment_id", "narrator"], "left")
        some = flagged.groupBy("narrator").agg(F.coalesce(F.bool_or("_ok"), F.lit(False)).alias("_some"))
        kept = flagged.join(some, "narrator").filter(~F.col("_some") | F.col("_ok")).select("segment_id", "narrator", (~F.col("_some")).alias("fallback"))
    met = salted_join(vectors.select("segment_id", "vec"), kept, "segment_id")
    return mean_vectors(met, ["narrator", "fallback"], "vec").select("narrator", "vec", "n", "fallback")


def narrator_text_vectors(voices: DataFrame, vectors: DataFrame) -> DataFrame:
    """``narrator, vec``: mean vectors scaled to length 1."""
    return narrator_vectors(voices, vectors).select("narrator", normalised(F.col("vec")).alias("vec"))


def cell_text_vectors(supports: DataFrame, vectors: DataFrame) -> DataFrame:
    """``cid, vec``: mean over the vectors of the segments that support a cell, scaled to length 1.

    A cell whose segments have no vector has no row.
    """
    met = salted_join(vectors.select("segment_id", "vec"), supports.select("segment_id", "cid").distinct(), "segment_id")
    return mean_vectors(met, ["cid"], "vec").select("cid", normalised(F.col("vec")).alias("vec"))


def cell_features(members: DataFrame, narrators: DataFrame) -> DataFrame:
    """``cell_rank, cid, feature``: mean of a cell's members' vectors, with the one-hot of its rank.

    ``members`` has ``cell_rank, cid, narrator`` for ranks from 1; narrators themselves are rank 0.
    """
    base = narrators.select(F.lit(0).alias("cell_rank"), F.col("narrator").alias("cid"), "vec")
    met = salted_join(narrators.select("narrator", "vec"), members.select("cell_rank", "cid", "narrator"), "narrator")
    upper = mean_vectors(met, ["cell_rank", "cid"], "vec").select("cell_rank", "cid", "vec")
    return rank_features(base.unionByName(upper), "vec", "cell_rank").select("cell_rank", "cid", "feature")
