"""Negative samples of incidences: uniform, size-matched, by motif walk, by clique and hard ones."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungwork.operators.skew import number_rows
from rungwork.operators.splits import hash_order
from rungwork.session import materialize

#: Cells whose company is counted in one task.
BLOCK_CELLS = 1_024


def _first(df: DataFrame, keys: list[str], seed: int, *parts: str) -> DataFrame:
    """One narrator per key: the first in hash order. An aggregate, so no group is ordered."""
    return df.groupBy(*keys).agg(F.min(F.struct(hash_order(seed, *parts).alias("h"), "narrator"))["narrator"].alias("negative"))


def uniform(cells: DataFrame, members: DataFrame, ground: DataFrame, draws: int = 1, seed: int = 0, tries: int = 8) -> DataFrame:
    """``cid, draw, negative``: a narrator outside the cell for each draw; none where all are inside.

    ``cells`` has ``cid`` and, if cells want different numbers of draws, ``draws``. Rejection sampling by rank:
    ``tries`` hashed places among the numbered narrators are tried, which finds nearly all. Where all of them are
    members, a hashed place among the non-members is taken: their ranks are the gaps in those of the members, so it is
    found by counting the members before it, and no cell is compared with all narrators.
    """
    whole = ground.select(F.lit(1).alias("_all"), "narrator").distinct()
    numbered = number_rows(whole, ["_all"], ["narrator"]).select("narrator", F.col("_pos").alias("_i"))
    n = numbered.agg(F.count(F.lit(1)).alias("_n"))
    wanted = F.col("draws") if "draws" in cells.columns else F.lit(draws)
    want = cells.groupBy("cid").agg(F.max(wanted).cast("int").alias("_d")).filter("_d > 0").select("cid", F.explode(F.sequence(F.lit(0), F.col("_d") - 1)).alias("draw"))
    tried = want.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(tries - 1)))).join(F.broadcast(n))
    tried = tried.withColumn("_i", F.pmod(_hashed(seed, "cid", "draw", "_t"), F.col("_n"))).join(numbered, "_i")
    ok = tried.join(members.select("cid", "narrator"), ["cid", "narrator"], "left_anti")
    found = materialize(ok.groupBy("cid", "draw").agg(F.min_by("narrator", "_t").alias("negative")))
    rest = want.join(found, ["cid", "draw"], "left_anti")
    inside = members.select("cid", "narrator").distinct().join(rest.select("cid").distinct(), "cid", "left_semi").join(numbered, "narrator")
    inside = number_rows(inside.select("cid", "_i"), ["cid"], ["_i"]).select("cid", (F.col("_i") - F.col("_pos")).alias("_before"))
    size = inside.groupBy("cid").agg(F.count(F.lit(1)).alias("_s"))
    aim = rest.join(size, "cid").join(F.broadcast(n)).filter("_n > _s").select("cid", "draw", F.pmod(_hashed(seed, "cid", "draw"), F.col("_n") - F.col("_s")).alias("_g"))
    rank = aim.join(inside, "cid").groupBy("cid", "draw", "_g").agg(F.count_if(F.col("_before") <= F.col("_g")).alias("_k"))
    late = rank.select("cid", "draw", (F.col("_g") + F.col("_k")).alias("_i")).join(numbered, "_i").select("cid", "draw", F.col("narrator").alias("negative"))
    return found.unionByName(late)


def _hashed(seed: int, *parts: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts])), 1, 12), 16, 10).cast("long")


def sizes_as_draws(members: DataFrame, ratio: int = 1) -> DataFrame:
    """``cid, draws``: as many draws as a cell has members, times ``ratio``."""
    return members.groupBy("cid").agg((F.count(F.lit(1)) * ratio).cast("int").alias("draws"))


def size_matched(members: DataFrame, ground: DataFrame, seed: int = 0) -> DataFrame:
    """``cid, negative``: of as many uniform draws as the cell has members, one picked by hash."""
    pool = uniform(sizes_as_draws(members), members, ground, seed=seed).select("cid", F.col("negative").alias("narrator")).distinct()
    return _first(pool, ["cid"], seed, "cid", "narrator")


def or_uniform(negatives: DataFrame, cells: DataFrame, members: DataFrame, ground: DataFrame, seed: int = 0) -> DataFrame:
    """``cid, negative`` with a uniform negative for the cells that have none."""
    rest = cells.select("cid").distinct().join(negatives.select("cid"), "cid", "left_anti")
    return negatives.select("cid", "negative").unionByName(uniform(rest, members, ground, seed=seed).select("cid", "negative"))


#: How negatives may be drawn.
REGIMES = ("uniform", "size_matched", "motif", "clique", "hard")


def labelled(members: DataFrame, ground: DataFrame, regime: str, ratio: int = 10, seed: int = 0, similar: DataFrame | None = None) -> DataFrame:
    """``cid, narrator, label, draw``: each incidence with label 1 and ``ratio`` negatives of the regime with label 0.

    Motif walks and cliques that find none, and hard negatives without ``similar``, fall back: hard to clique, clique to
    motif, motif to uniform. A cell that holds everyone has no negatives. Regimes but the uniform one find one negative a
    cell and repetition: repetitions are as many as the ratio, and its incidences share them.
    """
    if regime not in REGIMES:
        raise ValueError(f"no regime {regime}")
    ours = members.select("cid", "narrator").distinct()
    positives = ours.select("cid", "narrator", F.lit(1).alias("label"), F.lit(0).alias("draw"))
    if regime == "uniform":
        got = uniform(sizes_as_draws(ours, ratio), ours, ground, seed=seed).select("cid", F.col("negative").alias("narrator"), F.lit(0).alias("label"), "draw")
        return positives.unionByName(got)
    from rungwork.operators.graph import both_ways, cowitness

    graph = materialize(both_ways(cowitness(ours))) if regime in ("motif", "clique", "hard") else None
    cells, drawn = ours.select("cid").distinct(), None
    hardest = hard(cells, ours, similar) if regime == "hard" and similar is not None else None
    for r in range(ratio):
        at = seed + 101 * r
        if regime == "size_matched":
            one = size_matched(ours, ground, at)
        else:
            one = motif(ours, graph, seed=at).select("cid", "negative")
            if regime in ("clique", "hard"):
                best = clique(ours, graph, seed=at).select("cid", "negative")
                one = best.unionByName(one.join(best, "cid", "left_anti"))
            if hardest is not None:
                one = hardest.unionByName(one.join(hardest, "cid", "left_anti"))
        one = or_uniform(one, cells, ours, ground, at).withColumn("_r", F.lit(r))
        drawn = one if drawn is None else drawn.unionByName(one)
    got = ours.select("cid").join(materialize(drawn), "cid").select("cid", F.col("negative").alias("narrator"), F.lit(0).alias("label"), F.col("_r").alias("draw"))
    return positives.unionByName(got)


def motif(members: DataFrame, graph: DataFrame, steps: int = 3, seed: int = 0) -> DataFrame:
    """``cid, negative``: where a walk of three steps on the co-witness graph from a member of the cell ends.

    ``graph`` has ``a, b`` both ways. A walk that gets stuck or ends inside the cell gives no row; see
    :func:`or_uniform`.
    """
    at = _first(members, ["cid"], seed, "cid", "narrator").withColumnRenamed("negative", "narrator")
    for i in range(steps):
        nexts = at.join(graph.select(F.col("a").alias("narrator"), "b"), "narrator").select("cid", F.col("b").alias("narrator"))
        at = _first(nexts, ["cid"], seed + i + 1, "cid", "narrator").withColumnRenamed("negative", "narrator")
    return at.join(members.select("cid", "narrator"), ["cid", "narrator"], "left_anti").select("cid", F.col("narrator").alias("negative"))


def company(members: DataFrame, pick: Callable[[np.ndarray, np.ndarray], np.ndarray], without: DataFrame | None = None, block: int = BLOCK_CELLS) -> DataFrame:
    """``cid, narrator``: those picked outside each cell by how many of its members they share some cell with.

    ``pick(counts, n)`` gets the counts of all narrators in name order, with -1 for the members of the cell, and the
    number of members that were counted; ``without`` has ``cid, narrator`` of members that don't count. Cells come in
    blocks: neighbours are sent once a block, not once a member, and the counts of a cell are one array.
    """
    ours = members.select("cid", "narrator").distinct()
    who = materialize(number_rows(ours.select(F.lit(1).alias("_all"), "narrator").distinct(), ["_all"], ["narrator"]).select("narrator", F.col("_pos").cast("int").alias("_i")))
    cells = materialize(number_rows(ours.select(F.lit(1).alias("_all"), "cid").distinct(), ["_all"], ["cid"]).select("cid", F.col("_pos").alias("_c")))
    m = ours.withColumn("_on", F.lit(True)) if without is None else ours.join(without.select("cid", "narrator", F.lit(False).alias("_on")), ["cid", "narrator"], "left").withColumn("_on", F.coalesce("_on", F.lit(True)))
    m = materialize(m.join(who, "narrator").join(cells, "cid").select("_c", "_i", "_on"))
    x, y = (m.select("_c", F.col("_i").alias(c)) for c in "ab")
    near = materialize(x.join(y, "_c").filter("a <> b").groupBy("a").agg(F.collect_set("b").alias("_near")))
    within = m.groupBy(F.floor(F.col("_c") / block).alias("_block"), "_i").agg(F.collect_list(F.struct("_c", "_on")).alias("_x"))
    within = within.join(near.withColumnRenamed("a", "_i"), "_i", "left").select("_block", "_i", "_x._c", "_x._on", F.coalesce("_near", F.array().cast("array<int>")).alias("_near"))
    total = who.count()

    def picked(pdf: pd.DataFrame) -> pd.DataFrame:
        near = [np.asarray(x, dtype=np.int64) for x in pdf["_near"]]
        held: dict[int, list[tuple[int, bool]]] = {}
        for k, (cs, on) in enumerate(zip(pdf["_c"], pdf["_on"], strict=True)):
            for c, o in zip(cs, on, strict=True):
                held.setdefault(int(c), []).append((k, bool(o)))
        ids, dense, out = pdf["_i"].to_numpy(), {}, []
        for c, inside in held.items():
            counts, n = np.zeros(total, dtype=np.int32), 0
            for k, on in inside:
                if not on:
                    continue
                n += 1
                if 16 * len(near[k]) < total:
                    counts[near[k]] += 1
                else:
                    if k not in dense:
                        dense[k] = np.zeros(total, dtype=np.int8)
                        dense[k][near[k]] = 1
                    counts += dense[k]
            counts[ids[[k for k, _ in inside]]] = -1
            out.append((c, pick(counts, n).tolist()))
        return pd.DataFrame(out, columns=["_c", "_picked"])

    got = within.groupBy("_block").applyInPandas(picked, "_c long, _picked array<int>")
    return got.select("_c", F.explode("_picked").alias("_i")).join(who, "_i").join(cells, "_c").select("cid", "narrator")


def _all_known(counts: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(counts == n) if n else np.empty(0, dtype=int)


def _most_known(counts: np.ndarray, n: int) -> np.ndarray:
    if counts.max(initial=0) <= 0:
        return np.empty(0, dtype=int)
    return np.array([len(counts) - 1 - counts[::-1].argmax()])


def clique(members: DataFrame, graph: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """``cid, dropped, negative``: one member is dropped; who knows all the others and isn't a member takes its place.

    Who knows whom are ``a, b`` of ``graph`` both ways; without it, those who share a cell, counted by :func:`company`.
    Cells of one member give no row.
    """
    drop = _first(members, ["cid"], seed, "cid", "narrator").withColumnRenamed("negative", "dropped")
    if graph is None:
        drop = materialize(drop)
        met = company(members, _all_known, drop.select("cid", F.col("dropped").alias("narrator"))).join(drop, "cid")
        return _first(met, ["cid", "dropped"], seed, "cid", "narrator")
    sizes = members.groupBy("cid").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    kept = members.select("cid", "narrator").join(drop, "cid").filter("narrator <> dropped").join(sizes, "cid")
    met = kept.join(graph.select(F.col("a").alias("narrator"), "b"), "narrator").groupBy("cid", "dropped", F.col("b").alias("narrator"), "_n").agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") == F.col("_n") - 1)
    return _first(met.join(members.select("cid", "narrator"), ["cid", "narrator"], "left_anti"), ["cid", "dropped"], seed, "cid", "narrator")


def hardest_by_company(members: DataFrame) -> DataFrame:
    """``cid, negative``: the non-member who shares a cell with most members, then the last by name."""
    return company(members, _most_known).select("cid", F.col("narrator").alias("negative"))


def hard(cells: DataFrame, members: DataFrame, similar: DataFrame) -> DataFrame:
    """``cid, negative``: the non-member most similar to the cell; ``similar`` has scored ``cid, narrator, score``."""
    out = similar.join(cells.select("cid"), "cid", "left_semi").join(members.select("cid", "narrator"), ["cid", "narrator"], "left_anti")
    return out.groupBy("cid").agg(F.max(F.struct("score", "narrator"))["narrator"].alias("negative"))
