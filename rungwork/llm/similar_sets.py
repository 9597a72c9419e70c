"""Problem 5: all similar pairs between set-valued records, by multi-index binary sketches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwork.functions.keys import distinct_keys
from rungwork.operators.skew import salted_join
from rungwork.session import materialize, spread, table

THRESHOLD, LEAST = 0.8, 4
#: Wanted recall at the threshold, of the join of segments and of the Hamming filter each.
RECALL = 0.9999
#: Bits of a code's beginning that the Hamming filter compares, and the bounds of a segment's width.
NEAR_BITS, LEAST_WIDTH, MOST_WIDTH = 64, 8, 60


def hamming_radius(bits: int, threshold: float, recall: float = RECALL) -> int:
    """Smallest radius that holds a pair of the threshold similarity with the given probability.

    One-bit minhashes of two sets agree with probability (1 + J) / 2, so their distance is binomial.
    """
    p, below, r = (1 - threshold) / 2, 0.0, -1
    while below < recall and r < bits:
        r += 1
        below += math.comb(bits, r) * p**r * (1 - p) ** (bits - r)
    return r


def segment_width(n: int) -> int:
    """Bits of a segment for ``n`` sets: as many as number them, so unlike sets meet about once a segment and set."""
    return max(LEAST_WIDTH, min(MOST_WIDTH, math.ceil(math.log2(max(2, n)))))


def segments_needed(width: int, threshold: float, recall: float = RECALL) -> int:
    """Fewest segments by which two sets of the threshold similarity share one with the given probability.

    Codes that differ in fewer bits than there are segments share one for certain, by the pigeonhole principle; for
    others each segment is equal with probability ``((1 + J) / 2) ** width``.
    """
    equal = ((1 + threshold) / 2) ** width
    return 1 if equal >= 1 else max(-(-NEAR_BITS // width), math.ceil(math.log(1 - recall) / math.log1p(-equal)))


def sketch(values: pd.Series, bits: int, seed: int = 7) -> np.ndarray:
    """Rows of one-bit minhashes of arrays of 64-bit hashes."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 63, bits, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 1 << 63, bits, dtype=np.uint64)
    flat = np.concatenate(values.to_numpy()).astype(np.int64).view(np.uint64)
    starts = np.concatenate([[0], np.cumsum([len(v) for v in values])[:-1]]).astype(np.int64)
    out = np.empty((len(values), bits), dtype=np.uint8)
    with np.errstate(over="ignore"):
        flat = flat ^ (flat >> np.uint64(31))
        for i in range(bits):
            h = (flat + b[i]) * a[i]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            out[:, i] = (np.minimum.reduceat(h, starts) >> np.uint64(7)) & np.uint64(1)
    return out


def _codes(width: int, segments: int):
    """Batches ``id, n, s, h`` to ``id, n, near, keys``: a key for each segment of the code of ``h`` on side ``s``."""
    weights = np.uint64(1) << np.arange(width, dtype=np.uint64)
    salts = np.random.default_rng(3).integers(1, 1 << 63, segments, dtype=np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            if not len(df):
                continue
            bits = sketch(df["h"], width * segments)
            near = np.packbits(bits[:, :NEAR_BITS], axis=1).view(np.int64).ravel()
            parts = (bits.reshape(len(df), segments, width).astype(np.uint64) * weights).sum(axis=2, dtype=np.uint64)
            with np.errstate(over="ignore"):
                keys = ((parts + salts) * np.uint64(0x9E3779B97F4A7C15)) ^ df["s"].to_numpy(dtype=np.int64).view(np.uint64)[:, None]
                keys = (keys ^ (keys >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
            yield pd.DataFrame({"id": df["id"], "n": df["n"], "near": near, "keys": list(keys.view(np.int64))})

    return run


def set_classes(rows: DataFrame) -> DataFrame:
    """``side, vals, rep, cid``: records grouped by equal sets, with the smallest id of each group.

    ``rows`` has ``side, cid, vals`` with sorted distinct values; a record delivered again counts once.
    """
    rows = materialize(rows.select("side", "cid", "vals").distinct().withColumn("_set", F.md5(F.to_json(F.struct("side", "vals")))))
    reps = rows.groupBy("_set").agg(F.min("cid").alias("rep"))
    return salted_join(reps, rows, "_set").select("side", "vals", "cid", "rep")


def similar_class_pairs(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``side, rep_a, rep_b``: pairs of different sets whose Jaccard similarity reaches the threshold; ``rep_a < rep_b``.

    One-bit minhashes are packed into codes and these cut into segments, whose width follows from the number of sets.
    Sets that share a segment, are of fitting size and lie within the calibrated radius on the first bits of their codes
    are compared exactly.
    """
    sets = materialize(classes.filter(F.col("cid") == F.col("rep")).select(F.monotonically_increasing_id().alias("id"), "side", "rep", "vals", F.size("vals").alias("n")))
    width = segment_width(sets.count())
    hashed = sets.select("id", "n", F.xxhash64("side").alias("s"), F.transform("vals", lambda v: F.xxhash64(v)).alias("h"))
    codes = materialize(spread(hashed).mapInPandas(_codes(width, segments_needed(width, threshold)), "id long, n int, near long, keys array<long>"))
    left = codes.select(F.explode("keys").alias("key"), F.col("id").alias("a"), F.col("n").alias("n_a"), F.col("near").alias("near_a"))
    right = codes.select(F.explode("keys").alias("key"), F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("near").alias("near_b"))
    fits = (F.col("a") < F.col("b")) & (F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9) & (F.bit_count(F.col("near_a").bitwiseXOR(F.col("near_b"))) <= hamming_radius(NEAR_BITS, threshold))
    pairs = salted_join(left, right, "key").filter(fits).select("a", "b").distinct()
    va = sets.select(F.col("id").alias("a"), "side", F.col("rep").alias("_ra"), F.col("vals").alias("_a"))
    vb = sets.select(F.col("id").alias("b"), F.col("side").alias("_side"), F.col("rep").alias("_rb"), F.col("vals").alias("_b"))
    both = F.size(F.array_intersect("_a", "_b"))
    met = pairs.join(va, "a").join(vb, "b").filter((F.col("side") == F.col("_side")) & (both >= threshold * (F.size("_a") + F.size("_b") - both) - 1e-9))
    return met.select("side", F.least("_ra", "_rb").alias("rep_a"), F.greatest("_ra", "_rb").alias("rep_b"))


def expand(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``side, cid_a, cid_b``: all pairs of records, of equal sets and of the given pairs of sets; the smaller id first.

    The records of a set with many copies are spread over several tasks.
    """
    name = lambda c: F.concat("side", F.lit("|"), c)
    a = classes.select(name("rep").alias("_ka"), F.col("cid").alias("_x"))
    b = classes.select(name("rep").alias("_kb"), F.col("cid").alias("_y"))
    same = classes.select("side", F.col("rep").alias("rep_a"), F.col("rep").alias("rep_b")).distinct()
    both = pairs.unionByName(same).withColumn("_ka", name("rep_a")).withColumn("_kb", name("rep_b"))
    met = salted_join(salted_join(both, a, "_ka"), b, "_kb").filter((F.col("rep_a") != F.col("rep_b")) | (F.col("_x") < F.col("_y")))
    return met.select("side", F.least("_x", "_y").alias("cid_a"), F.greatest("_x", "_y").alias("cid_b"))


def cell_sets(cells: DataFrame) -> DataFrame:
    """``side, cid, vals`` of cells of rank 2 with at least four distinct values on that side.

    Values are lower case with white space trimmed and squeezed; NULLs and blanks are no values; a NULL array is empty.
    """
    two = cells.filter((F.col("cell_rank") == 2) & F.col("cid").isNotNull())
    sides = [two.select(F.lit(side).alias("side"), "cid", distinct_keys(F.col(side)).alias("vals")) for side in ("members", "segments")]
    return sides[0].unionByName(sides[1]).filter(F.size("vals") >= LEAST)


def _pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    classes = materialize(set_classes(cell_sets(table(spark, sf_dir, "cells"))))
    return classes, similar_class_pairs(classes)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of similar cells."""
    return expand(*_pairs(spark, sf_dir))


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per cell and side: its class of equal sets, the copies in it and its links to other classes."""
    classes, pairs = _pairs(spark, sf_dir)
    ends = pairs.select("side", F.explode(F.array("rep_a", "rep_b")).alias("rep")).groupBy("side", "rep").agg(F.count(F.lit(1)).alias("n_links"))
    sizes = classes.groupBy("side", "rep").agg(F.count(F.lit(1)).alias("n_copies"))
    return classes.join(sizes.join(ends, ["side", "rep"], "left"), ["side", "rep"]).select("side", "cid", F.col("rep").alias("class_id"), "n_copies", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


_SETS_SQL = r"""
sets AS (
  SELECT DISTINCT side, cid, list_sort(list_distinct(list_filter(list_transform(v, lambda x: nullif(lower(trim(regexp_replace(x, '[\s\x{00A0}]+', ' ', 'g'))), '')), lambda x: x IS NOT NULL))) AS s
  FROM (SELECT 'members' AS side, cid, members AS v FROM cells WHERE cell_rank = 2 UNION ALL SELECT 'segments', cid, segments FROM cells WHERE cell_rank = 2) WHERE cid IS NOT NULL AND v IS NOT NULL),
big AS (SELECT * FROM sets WHERE len(s) >= 4)
"""

QUERIES = {"p5_found": p5_found, "p5_classes": p5_classes}

ORACLE = {
    "p5_found": f"""WITH {_SETS_SQL}
    SELECT a.side, a.cid AS cid_a, b.cid AS cid_b FROM big a JOIN big b ON a.side = b.side AND a.cid < b.cid
    WHERE len(list_intersect(a.s, b.s)) >= 0.8 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) - 1e-9""",
    "p5_classes": f"""WITH {_SETS_SQL}, c AS (SELECT side, cid, s, min(cid) OVER (PARTITION BY side, s) AS class_id, count(*) OVER (PARTITION BY side, s) AS n_copies FROM big),
    r AS (SELECT * FROM c WHERE cid = class_id),
    l AS (SELECT a.side, a.cid, count(*) AS n_links FROM r a JOIN r b ON a.side = b.side AND a.cid <> b.cid
      WHERE len(list_intersect(a.s, b.s)) >= 0.8 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) - 1e-9 GROUP BY 1, 2)
    SELECT c.side, c.cid, class_id, n_copies, coalesce(n_links, 0) AS n_links FROM c LEFT JOIN l ON l.side = c.side AND l.cid = c.class_id""",
}
