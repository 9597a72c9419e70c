"""Ranked retrieval: cosine scores in blocks, average precision, nDCG, recall, reciprocal rank, AUC and list similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rungwork.operators.skew import number_rows
from rungwork.session import materialize

#: Queries that are held by a task at once.
QUERY_BLOCK = 2_000
#: Bins of a query's scores; a block's table of them is of fixed size.
BINS = 4_096


def retrieval_metrics(ranked: DataFrame, at_ndcg: int = 10, at_recall: int = 50) -> DataFrame:
    """Per query ``ap, ndcg, recall, rr`` of ``query, pos, rel`` (pos from 1, rel 0 or 1, all positives listed)."""
    hits = F.sum("rel").over(W.partitionBy("query").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    r = ranked.filter("rel = 1").withColumn("_hits", hits)
    s = r.groupBy("query").agg(
        F.count(F.lit(1)).alias("n_pos"),
        F.sum(F.col("_hits") / F.col("pos")).alias("_ap"),
        F.sum(F.when(F.col("pos") <= at_ndcg, 1 / F.log2(F.col("pos") + 1))).alias("_dcg"),
        F.count_if(F.col("pos") <= at_recall).alias("_in"),
        F.min("pos").alias("_first"),
    )
    ideal = F.expr(f"aggregate(sequence(1, cast(least({at_ndcg}, n_pos) as int)), 0D, (a, i) -> a + 1 / log2(i + 1))")
    return s.select("query", "n_pos", (F.col("_ap") / F.col("n_pos")).alias("ap"), (F.coalesce("_dcg", F.lit(0.0)) / ideal).alias("ndcg"), (F.col("_in") / F.col("n_pos")).alias("recall"), (1 / F.col("_first")).alias("rr"))


def _norm(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _bins(below: np.ndarray) -> np.ndarray:
    return np.clip(((below + 1) * (BINS / 2)).astype(np.int64), 0, BINS - 1)


def _counted(q):
    """Batches of items to the positives of each query (``item, below``) and counts of all items by query and bin."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, labels, m = q.value
        total = np.zeros((len(ids), BINS), dtype=np.int64)
        for df in batches:
            if not len(df):
                continue
            item, below = df["id"].to_numpy(), -np.round(m @ _norm(np.stack(df["vec"].to_numpy()).astype(np.float64)).T, 10)
            other, at = ids[:, None] != item[None, :], _bins(below)
            i, j = np.nonzero(other)
            np.add.at(total, (i, at[i, j]), 1)
            i, j = np.nonzero(other & (labels[:, None] == df["label"].to_numpy()[None, :]))
            yield pd.DataFrame({"query": ids[i], "bin": at[i, j], "n": 0, "item": pd.array(item[j], dtype="Int64"), "below": below[i, j]})
        i, j = np.nonzero(total)
        yield pd.DataFrame({"query": ids[i], "bin": j, "n": total[i, j], "item": pd.array([None] * len(i), dtype="Int64"), "below": np.nan})

    return run


def _beside(q):
    """Batches of items to those that are no positives but share a bin with one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (ids, labels, m), wanted = q.value
        for df in batches:
            if not len(df):
                continue
            item, below = df["id"].to_numpy(), -np.round(m @ _norm(np.stack(df["vec"].to_numpy()).astype(np.float64)).T, 10)
            at = _bins(below)
            near = wanted[np.arange(len(ids))[:, None], at] & (ids[:, None] != item[None, :]) & (labels[:, None] != df["label"].to_numpy()[None, :])
            i, j = np.nonzero(near)
            yield pd.DataFrame({"query": ids[i], "bin": at[i, j], "item": item[j], "below": below[i, j], "rel": 0})

    return run


def positive_places(queries: DataFrame, items: DataFrame) -> DataFrame:
    """``query, pos, rel``: the places of the positives of each query among all items by cosine, the query itself left out.

    ``queries`` and ``items`` have ``id, label, vec``; items of the query's label are its positives, ties go by id.
    Queries are a stated set and taken in blocks, each sent to the tasks that scan the items. A first scan keeps the
    positives and counts all items by bins of the score, a second the items that share a bin with a positive; a place is
    the number of items in the bins above and, exactly, before it in its own. So what is shuffled grows with the
    positives and their neighbours and not with queries times items.
    """
    spark = items.sparkSession
    n_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    out = None
    for b in range(n_blocks):
        rows = queries.filter(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == b).orderBy("id").collect()
        if not rows:
            continue
        block = (np.array([r["id"] for r in rows]), np.array([r["label"] for r in rows]), _norm(np.array([r["vec"] for r in rows], dtype=np.float64)))
        first = materialize(items.mapInPandas(_counted(spark.sparkContext.broadcast(block)), "query long, bin long, n long, item long, below double"))
        positives = first.filter("item is not null").select("query", "bin", "item", "below", F.lit(1).alias("rel"))
        words = positives.groupBy("query", F.shiftright("bin", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(bin & 63 as int)))").alias("bits")).collect()
        wanted, at = np.zeros((len(rows), BINS // 64), dtype=np.int64), {int(q): i for i, q in enumerate(block[0])}
        for r in words:
            wanted[at[r["query"]], r["w"]] = r["bits"]
        wanted = np.unpackbits(wanted.view(np.uint8), axis=1, bitorder="little").astype(bool)
        near = items.mapInPandas(_beside(spark.sparkContext.broadcast((block, wanted))), "query long, bin long, item long, below double, rel int")
        within = number_rows(positives.unionByName(near), ["query", "bin"], ["below", "item"]).filter("rel = 1").select("query", "bin", F.col("_pos"))
        upto = W.partitionBy("query").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
        above = first.filter("item is null").groupBy("query", "bin").agg(F.sum("n").alias("_n")).select("query", "bin", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_above"))
        part = within.join(above, ["query", "bin"]).select("query", (F.col("_above") + F.col("_pos") + 1).alias("pos"), F.lit(1).alias("rel"))
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "query long, pos long, rel int") if out is None else out


def auc(df: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    """``by, auc_roc, auc_pr`` of 0/1 labels by score, from a histogram of the scores; NULL with a single class.

    Average precision adds precision at each distinct score, so ties count together.
    """
    h = df.groupBy(*by, score).agg(F.sum(F.col(label).cast("long")).alias("_p"), F.count(F.lit(1)).alias("_n"))
    below = W.partitionBy(*by).orderBy(score).rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(W.unboundedPreceding, 0)
    neg = F.col("_n") - F.col("_p")
    r = h.withColumn("_u", F.col("_p") * (F.coalesce(F.sum(neg).over(below), F.lit(0)) + neg / 2)).withColumn("_ap", F.col("_p") * F.sum("_p").over(upto) / F.sum("_n").over(upto))
    s = r.groupBy(*by).agg(F.sum("_u").alias("_u"), F.sum("_p").alias("_p"), F.sum(neg).alias("_q"), F.sum("_ap").alias("_ap"))
    both = (F.col("_p") > 0) & (F.col("_q") > 0)
    return s.select(*by, F.when(both, F.col("_u") / (F.col("_p") * F.col("_q"))).alias("auc_roc"), F.when(both, F.col("_ap") / F.col("_p")).alias("auc_pr"))


def group_ranking(df: DataFrame, group: str, label: str, score: str, order: str) -> DataFrame:
    """One row ``mrr, hits1, hits5, hits10`` over groups with a positive: where its first positive stands by score."""
    pos = F.row_number().over(W.partitionBy(group).orderBy(F.desc(score), order))
    first = df.withColumn("_pos", pos).filter(F.col(label) == 1).groupBy(group).agg(F.min("_pos").alias("_f"))
    hit = lambda k: F.avg((F.col("_f") <= k).cast("double"))
    return first.agg(F.count(F.lit(1)).alias("n_groups"), F.avg(1 / F.col("_f")).alias("mrr"), hit(1).alias("hits1"), hit(5).alias("hits5"), hit(10).alias("hits10"))


def list_overlap(lists: DataFrame) -> DataFrame:
    """``list_a, list_b, depth, x``: items common to the first ``depth`` of two lists, for all depths of the longer.

    ``lists`` has ``list_id, pos`` (from 1) and ``item``; a repeated item stands at its first place.
    """
    first = lists.groupBy("list_id", "item").agg(F.min("pos").alias("pos"))
    n = lists.groupBy("list_id").agg(F.max("pos").alias("_n"))
    a, b = (n.select(F.col("list_id").alias(f"list_{x}"), F.col("_n").alias(f"_n{x}")) for x in "ab")
    pairs = a.join(b, F.col("list_a") < F.col("list_b"))
    depths = pairs.withColumn("depth", F.explode(F.sequence(F.lit(1), F.greatest("_na", "_nb"))))
    fa, fb = (first.select(F.col("list_id").alias(f"list_{x}"), "item", F.col("pos").alias(f"_p{x}")) for x in "ab")
    met = fa.join(fb, "item").filter("list_a < list_b").groupBy("list_a", "list_b", F.greatest("_pa", "_pb").alias("depth")).agg(F.count(F.lit(1)).alias("_k"))
    run = F.sum(F.coalesce("_k", F.lit(0))).over(W.partitionBy("list_a", "list_b").orderBy("depth").rowsBetween(W.unboundedPreceding, 0))
    return depths.join(met, ["list_a", "list_b", "depth"], "left").select("list_a", "list_b", "depth", run.alias("x"), "_na", "_nb")


def rank_biased_overlap(lists: DataFrame, p: float = 0.9) -> DataFrame:
    """``list_a, list_b, rbo``: extrapolated rank-biased overlap to the depth of the longer list."""
    o = list_overlap(lists)
    s = o.groupBy("list_a", "list_b").agg(F.sum((1 - p) * F.pow(F.lit(p), F.col("depth") - 1) * F.col("x") / F.col("depth")).alias("_s"), F.max_by("x", "depth").alias("_x"), F.max("depth").alias("_k"))
    return s.select("list_a", "list_b", (F.col("_s") + F.pow(F.lit(p), F.col("_k")) * F.col("_x") / F.col("_k")).alias("rbo"))


def jaccard_at(lists: DataFrame, k: int) -> DataFrame:
    """``list_a, list_b, jaccard`` of the first ``k`` items of every two lists."""
    sets = lists.filter(F.col("pos") <= k).groupBy("list_id").agg(F.collect_set("item").alias("_s"))
    a, b = (sets.select(F.col("list_id").alias(f"list_{x}"), F.col("_s").alias(f"_s{x}")) for x in "ab")
    both, either = F.size(F.array_intersect("_sa", "_sb")), F.size(F.array_union("_sa", "_sb"))
    return a.join(b, F.col("list_a") < F.col("list_b")).select("list_a", "list_b", F.when(either == 0, 1.0).otherwise(both / either).alias("jaccard"))
