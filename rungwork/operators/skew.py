"""Per-key work without imbalance: exact offset chunking, block-wise running state and joins on hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rungwork.session import materialize

#: Rows of one key that one chunk may hold.
CHUNK_ROWS = 100_000
#: A key is hot when it holds more than one part in so many of all rows, so at most so many keys are hot.
HOT_PARTS = 1_000
#: Rows of a join side below which no key can hold more than a task's worth, so nothing is salted.
SMALL_ROWS = 1_000_000


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Add ``_pos``, the exact position (from 0) of each row among the rows of its key in the given order.

    Rows are laid out by range over key and order, so a heavy key spreads over as many partitions as its share asks
    for; keys are counted per partition, a prefix sum over the partitions gives each its offset, and a row's position is
    that offset plus its place in the partition. The layout is written once, as range bounds are sampled anew each time.
    Rows equal in key and order get neighbouring positions in no defined order. Keys may be NULL; NULL is one key.
    """
    laid = df.repartitionByRange(_parts(df), *keys, *order).sortWithinPartitions(*keys, *order)
    laid = materialize(laid.withColumn("_rid", F.monotonically_increasing_id()))
    laid = laid.withColumn("_pid", F.shiftright("_rid", 33))
    counts = laid.groupBy(*keys, "_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_rid").alias("_first"))
    before = W.partitionBy(*keys).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_pid").alias("_p"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    same = (F.col("_pid") == F.col("_p")) & _all([F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return laid.join(offsets, same).select(*df.columns, (F.col("_off") + F.col("_rid") - F.col("_first")).alias("_pos"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def distinct_per_key(df: DataFrame, keys: Sequence[str], item: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``keys, n_rows, n_distinct``: rows and distinct non-NULL items of each key, computed in equal-sized key chunks.

    Chunks of a key hold consecutive items, so merging is exact: the sum of the chunks' distinct counts, less one for
    each boundary at which the same item ends one chunk and begins the next. A key whose items are all NULL has 0.
    An empty input gives an empty result.
    """
    numbered = number_rows(df.select(*keys, item), keys, [item])
    chunks = numbered.withColumn("_chunk", F.floor(F.col("_pos") / chunk_rows))
    per_item = chunks.groupBy(*keys, "_chunk", item).agg(F.count(F.lit(1)).alias("_n"))
    states = per_item.groupBy(*keys, "_chunk").agg(F.sum("_n").alias("_n"), F.count(item).alias("_d"), F.min(item).alias("_lo"), F.max(item).alias("_hi"))
    in_order = W.partitionBy(*keys).orderBy("_chunk")
    joint = states.withColumn("_dup", (F.col("_lo") == F.lag("_hi").over(in_order)).cast("long"))
    return joint.groupBy(*keys).agg(F.sum("_n").alias("n_rows"), (F.sum("_d") - F.coalesce(F.sum("_dup"), F.lit(0))).alias("n_distinct"))


def keys_by_share(pairs: DataFrame, keys: Sequence[str], item: str, totals: DataFrame, share: float, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Keys held by at least ``share`` of the distinct items; ``totals`` has the first key column and ``n_total``."""
    counts = distinct_per_key(pairs, keys, item, chunk_rows)
    return counts.join(F.broadcast(totals), keys[0]).filter(F.col("n_distinct") >= share * F.col("n_total"))


def last_in_blocks(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, block: int = 4096, strict: bool = False) -> DataFrame:
    """Add ``out``, the last non-NULL ``value`` at or (``strict``) before each row, in blocks of consecutive ``order``.

    ``order`` is an integer, unique within a key. One task holds one block; only one row a block is ordered per key.
    """
    b = df.withColumn("_b", F.floor(F.col(order) / block))
    frame = W.partitionBy(*keys, "_b").orderBy(order).rowsBetween(W.unboundedPreceding, -1 if strict else 0)
    b = b.withColumn("_in", F.last(value, ignorenulls=True).over(frame))
    ends = df.withColumn("_b", F.floor(F.col(order) / block)).filter(F.col(value).isNotNull()).groupBy(*keys, "_b").agg(F.max_by(value, order).alias("_end"))
    blocks = df.withColumn("_b", F.floor(F.col(order) / block)).select(*keys, "_b").distinct().join(ends, [*keys, "_b"], "left")
    upto = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carry = blocks.select(*keys, "_b", F.last("_end", ignorenulls=True).over(upto).alias("_carry"))
    return b.join(carry, [*keys, "_b"], "left").withColumn(out, F.coalesce("_in", "_carry")).drop("_b", "_in", "_carry")


def running_sum_in_blocks(df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, block: int = 4096) -> DataFrame:
    """Add ``out``, the running sum of ``value`` up to and with each row, in blocks as :func:`last_in_blocks`."""
    b = df.withColumn("_b", F.floor(F.col(order) / block))
    frame = W.partitionBy(*keys, "_b").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    sums = b.groupBy(*keys, "_b").agg(F.sum(value).alias("_s"))
    upto = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carry = sums.select(*keys, "_b", F.coalesce(F.sum("_s").over(upto), F.lit(0)).alias("_carry"))
    return b.withColumn("_in", F.sum(value).over(frame)).join(carry, [*keys, "_b"], "left").withColumn(out, F.coalesce("_in", F.lit(0)) + F.coalesce("_carry", F.lit(0))).drop("_b", "_in", "_carry")


def salted_join(probe: DataFrame, build: DataFrame, key: str, how: str = "inner", hot_parts: int = HOT_PARTS, build_rows: int | None = None) -> DataFrame:
    """Equi-join on ``key`` in which the rows of a key that is hot in ``build`` are spread over several tasks.

    Keys with more than one part in ``hot_parts`` of the build rows are hot, so their list has at most ``hot_parts``
    entries and may be broadcast. Their build rows get a hash salt and their probe rows are repeated once a salt.
    NULL keys match nothing. ``how`` is ``inner``. A caller that knows the build side to be small says so by
    ``build_rows``; then it is joined as it is.
    """
    if how != "inner":
        raise ValueError("only inner joins")
    if build_rows is not None and build_rows <= SMALL_ROWS:
        return probe.join(build, key)
    n = _parts(build)
    counts = build.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_c"))
    total = counts.agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("_total"))
    hot = counts.join(F.broadcast(total), F.col("_c") > F.greatest(F.col("_total") / hot_parts, F.lit(1000)))
    hot = F.broadcast(hot.select(key, F.least(F.ceil(F.col("_c") * n / F.col("_total")), F.lit(n)).cast("int").alias("_salts")))
    rest = [c for c in build.columns if c != key]
    b = build.join(hot, key, "left").withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*rest) if rest else F.xxhash64(key), F.col("_salts")).cast("int"))).drop("_salts")
    p = probe.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts") - 1, F.lit(0))))).drop("_salts")
    return p.join(b, [key, "_salt"]).drop("_salt")
