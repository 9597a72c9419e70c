"""Bounded numeric kernels over small matrices: optimal cluster alignment, average linkage, title similarity."""

from __future__ import annotations

import difflib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from rungwork.operators.components import connected_components
from rungwork.operators.statistics import clusters_overlap
from rungwork.session import materialize

#: Most clusters on a side of an alignment, and items of a linkage, whose whole matrix one task holds.
MOST_CLUSTERS, MOST_ITEMS = 3_000, 5_000
#: Vectors of a block where the nearest ones of a larger group are sought.
BLOCK = 1_024


def assign(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows and columns with the largest total gain, one of each at most, by shortest augmenting paths."""
    if gain.shape[0] > gain.shape[1]:
        return [(j, i) for i, j in assign(gain.T)]
    n, m = gain.shape
    cost = gain.max(initial=0.0) - gain
    u, v, owner = np.zeros(n), np.zeros(m), np.full(m, -1)
    for row in range(n):
        dist, prev, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, dtype=bool)
        i, j_from, base = row, -1, 0.0
        while True:
            new = base + cost[i] - u[i] - v
            better = ~done & (new < dist - 1e-12)
            dist[better], prev[better] = new[better], j_from
            open_ = np.where(done, np.inf, dist)
            j = int(open_.argmin())
            base = float(open_[j])
            done[j] = True
            if owner[j] < 0:
                break
            i, j_from = int(owner[j]), j
        last = base
        for k in np.nonzero(done)[0]:
            if k != j and owner[k] >= 0:
                u[owner[k]] += last - dist[k]
            v[k] -= last - dist[k]
        u[row] += last
        while j >= 0:
            p = int(prev[j])
            owner[j] = row if p < 0 else owner[p]
            j = p
    return [(int(i), j) for j, i in enumerate(owner) if i >= 0]


def sparse_total(pairs: list[tuple[int, int, float]]) -> float:
    """Largest total gain of :func:`assign` over the pairs ``row, column, gain`` alone, in memory of their number.

    Each row may also stay alone, for no gain, so the shortest augmenting paths go over gains above zero only.
    """
    top = max((g for _, _, g in pairs), default=0.0)
    edges: dict[int, list[tuple[int, float]]] = {}
    gain = {}
    for i, j, g in pairs:
        edges.setdefault(i, [(-1 - i, top)]).append((j, top - g))
        gain[i, j] = g
    u, v, owner = dict.fromkeys(edges, 0.0), {}, {}
    for row in edges:
        dist, prev, done, heap = {}, {}, set(), []
        i, j_from, base = row, None, 0.0
        while True:
            for j, c in edges[i]:
                new = base + c - u[i] - v.get(j, 0.0)
                if j not in done and new < dist.get(j, np.inf):
                    dist[j], prev[j] = new, j_from
                    heapq.heappush(heap, (new, j))
            base, j = heapq.heappop(heap)
            while j in done:
                base, j = heapq.heappop(heap)
            if j not in owner:
                break
            done.add(j)
            i, j_from = owner[j], j
        for k in done:
            u[owner[k]] += base - dist[k]
            v[k] = v.get(k, 0.0) - (base - dist[k])
        u[row] += base
        while j is not None:
            p = prev[j]
            owner[j] = row if p is None else owner[p]
            j = p
    return float(sum(gain[i, j] for j, i in owner.items() if j >= 0))


def ceaf(gold: DataFrame, system: DataFrame, most: int = MOST_CLUSTERS) -> DataFrame:
    """One row ``precision, recall, total``: CEAF with the entity similarity, over the best one-to-one alignment.

    The overlap table is made in Spark. Of more than ``most`` clusters a side, each connected component of the overlaps
    is aligned by itself, and a component that is still larger over its overlaps alone. An empty side gives zeros.
    """
    gs = gold.groupBy("gold_id").agg(F.count(F.lit(1)).alias("_g"))
    ss = system.groupBy("sys_id").agg(F.count(F.lit(1)).alias("_s"))
    n_gold, n_sys = gs.count(), ss.count()
    o = clusters_overlap(gold, system).join(gs, "gold_id").join(ss, "sys_id").select(F.col("gold_id").cast("string").alias("g"), F.col("sys_id").cast("string").alias("s"), (2 * F.col("n") / (F.col("_g") + F.col("_s"))).alias("phi"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        g, s = ({x: i for i, x in enumerate(sorted(set(pdf[c])))} for c in "gs")
        if max(len(g), len(s)) > most:
            return pd.DataFrame({"total": [sparse_total(list(zip(pdf["g"].map(g).tolist(), pdf["s"].map(s).tolist(), pdf["phi"].tolist(), strict=True)))]})
        m = np.zeros((len(g), len(s)))
        m[pdf["g"].map(g), pdf["s"].map(s)] = pdf["phi"]
        return pd.DataFrame({"total": [float(sum(m[i, j] for i, j in assign(m)))]})

    if max(n_gold, n_sys) > most:
        o = materialize(o)
        found = connected_components(o.select(F.concat(F.lit("g"), "g").alias("a"), F.concat(F.lit("s"), "s").alias("b")))
        o = o.join(found, F.concat(F.lit("g"), "g") == F.col("node")).withColumnRenamed("component", "_one")
    else:
        o = o.withColumn("_one", F.lit(1))
    best = o.groupBy("_one").applyInPandas(solve, "total double").agg(F.coalesce(F.sum("total"), F.lit(0.0)).alias("total"))
    return best.select(F.coalesce(F.try_divide("total", F.lit(n_sys)), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide("total", F.lit(n_gold)), F.lit(0.0)).alias("recall"), "total")


def merges(x: np.ndarray, size: np.ndarray, threshold: float) -> Iterator[tuple[int, int, float]]:
    """``into, from, distance`` of the merges of average linkage on cosine distance below a threshold.

    Rows of ``x`` are means of unit vectors, ``size`` of them each.
    """
    d = 1 - x @ x.T
    np.fill_diagonal(d, np.inf)
    n, size = len(x), size.astype(np.float64)
    alive = np.ones(n, dtype=bool)
    near = d.argmin(axis=1) if n > 1 else np.zeros(n, dtype=int)
    while alive.sum() > 1:
        best = np.where(alive, d[np.arange(n), near], np.inf)
        i = int(best.argmin())
        if best[i] >= threshold:
            break
        height = float(best[i])
        j = int(near[i])
        i, j = min(i, j), max(i, j)
        row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        row[~alive] = np.inf
        row[[i, j]] = np.inf
        d[i], d[:, i], d[j], d[:, j] = row, row, np.inf, np.inf
        alive[j] = False
        size[i] += size[j]
        yield i, j, height
        for k in np.nonzero(alive & ((near == i) | (near == j)))[0]:
            near[k] = d[k].argmin()
        near[i] = d[i].argmin()
        for k in np.nonzero(alive)[0]:
            if d[k, i] < d[k, near[k]]:
                near[k] = i


def average_linkage(vectors: np.ndarray, threshold: float) -> np.ndarray:
    """Cluster numbers of rows by average linkage on cosine distance, merged while the least distance is below a threshold."""
    x = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    of = np.arange(len(x))
    for i, j, _ in merges(x, np.ones(len(x)), threshold):
        of[of == j] = i
    return of


def _nearest(active: DataFrame, key: str, kind: str) -> DataFrame:
    """``_g, key, _d, _lo, _hi``: of each cluster the nearest other one of its group; equal distances go by keys."""
    n = active.groupBy("_g").agg(F.count(F.lit(1)).alias("_k"))
    blocks = active.join(n, "_g").withColumn("_b", F.pmod(F.xxhash64(key), F.ceil(F.col("_k") / BLOCK))).groupBy("_g", "_b").agg(F.collect_list(F.struct(F.col(key).alias("k"), F.col("_m").alias("m"))).alias("_x"))
    blocks = materialize(blocks)
    pairs = blocks.join(blocks.select("_g", F.col("_b").alias("_c"), F.col("_x").alias("_y")), "_g").filter("_b <= _c")

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for g, b, c, x, y in zip(df["_g"], df["_b"], df["_c"], df["_x"], df["_y"], strict=True):
                x, y = (sorted(z, key=lambda r: r["k"]) for z in (x, y))
                kx, ky = (pd.Series([r["k"] for r in z]) for z in (x, y))
                mx, my = (np.array([r["m"] for r in z], dtype=np.float64) for z in (x, y))
                d = 1 - mx @ my.T
                if b == c:
                    d = np.triu(d, 1) + np.triu(d, 1).T
                    np.fill_diagonal(d, np.inf)
                for own, other, e in ((kx, ky, d),) if b == c else ((kx, ky, d), (ky, kx, d.T)):
                    at = e.argmin(axis=1)
                    out = pd.DataFrame({"_g": g, key: own, "_d": e[np.arange(len(own)), at], "_near": other.to_numpy()[at]})
                    yield out[np.isfinite(out["_d"])]

    # few rows of much work each: a pair of blocks to a row
    found = pairs.repartition(max(pairs.sparkSession.sparkContext.defaultParallelism, 16), "_g", "_b", "_c").mapInPandas(best, f"_g string, {key} {kind}, _d double, _near {kind}")
    least = found.groupBy("_g", key).agg(F.min(F.struct("_d", F.least(key, "_near").alias("_lo"), F.greatest(key, "_near").alias("_hi"))).alias("_z"))
    return least.select("_g", key, "_z.*")


def _merge_rounds(active: DataFrame, key: str, kind: str, threshold: float, most: int) -> DataFrame:
    """``_g, _lo, _hi, _d``: the merges of :func:`merges` of large groups ``_g, key, _m, _n``, by rounds over blocks.

    Clusters that are each other's nearest ones merge in any order under average linkage, so all of them merge in one
    round; a cluster with none below the threshold is done. What is left of a group goes to one task as soon as it has
    at most ``most`` clusters.
    """

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key).reset_index(drop=True)
        names = pdf[key].to_numpy()
        rows = list(merges(np.stack(pdf["_m"].to_numpy()).astype(np.float64), pdf["_n"].to_numpy(), threshold))
        return pd.DataFrame({"_g": pdf["_g"].iloc[0], "_lo": names[[r[0] for r in rows]], "_hi": names[[r[1] for r in rows]], "_d": np.array([r[2] for r in rows], dtype=np.float64)})

    schema = f"_g string, _lo {kind}, _hi {kind}, _d double"
    active, parts = materialize(active), []
    while True:
        size = active.groupBy("_g").agg(F.count(F.lit(1)).alias("_k"))
        parts.append(materialize(active.join(size.filter(F.col("_k") <= most), "_g", "left_semi").groupBy("_g").applyInPandas(finish, schema)))
        active = materialize(active.join(size.filter(F.col("_k") > most), "_g", "left_semi"))
        if active.isEmpty():
            break
        near = materialize(_nearest(active, key, kind).filter(F.col("_d") < threshold))
        pairs = materialize(near.groupBy("_g", "_lo", "_hi").agg(F.count(F.lit(1)).alias("_c"), F.first("_d").alias("_d")).filter("_c = 2").drop("_c"))
        parts.append(pairs.select("_g", "_lo", "_hi", "_d"))
        named = pairs.select("_g", F.explode(F.array("_lo", "_hi")).alias(key), F.col("_lo").alias("_to"))
        kept = active.join(near, ["_g", key], "left_semi").join(named, ["_g", key], "left").withColumn("_to", F.coalesce("_to", key))
        one = kept.groupBy("_g", "_to").agg(F.sort_array(F.collect_list(F.struct(key, "_m", "_n"))).alias("_p"))
        a, b = F.col("_p")[0], F.get("_p", F.lit(1))
        n = a["_n"] + F.coalesce(b["_n"], F.lit(0))
        both = F.zip_with(a["_m"], b["_m"], lambda p, q: (a["_n"] * p + b["_n"] * q) / n)
        active = materialize(one.select("_g", F.col("_to").alias(key), F.when(b.isNull(), a["_m"]).otherwise(both).alias("_m"), n.alias("_n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _large_groups(df: DataFrame, by: list[str], key: str, vector: str, thresholds: list[float], most: int) -> DataFrame:
    """:func:`cluster_by_similarity` of groups ``_g`` of more than ``most`` items."""
    kind = dict(df.dtypes)[key]
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    unit = F.transform(vector, lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-12)))
    # equal vectors, at no distance, are one from the start; zero ones have distance 1 from each other
    df = materialize(df.withColumn("_alone", F.when(norm == 0, F.col(key))))
    reps = materialize(df.groupBy("_g", vector, "_alone").agg(F.min(key).alias("_rep"), F.count(F.lit(1)).alias("_n")))
    found = materialize(_merge_rounds(reps.select("_g", F.col("_rep").alias(key), unit.alias("_m"), F.col("_n").cast("double").alias("_n")), key, kind, max(thresholds), most))
    ts = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    name = lambda c: F.to_json(F.struct("threshold", "_g", F.col(c).alias("k")))
    # by a threshold not above 0 even equal vectors stay apart
    item = df.join(reps.select("_g", vector, F.col("_alone").alias("_z"), "_rep"), ["_g", vector]).filter(F.col("_alone").eqNullSafe(F.col("_z")))
    item = item.select(*by, "_g", key, "_rep", ts).withColumn("_rep", F.when(F.col("threshold") > 0, F.col("_rep")).otherwise(F.col(key))).withColumn("_node", name("_rep"))
    item = materialize(item)
    joined = connected_components(found.select("*", ts).filter("_d < threshold and threshold > 0").select(name("_lo").alias("a"), name("_hi").alias("b")))
    item = item.join(joined, F.col("_node") == F.col("node"), "left").withColumn("_of", F.coalesce("component", "_node"))
    least = item.groupBy("_of").agg(F.min(key).alias("cluster"))
    return item.join(least, "_of").select(*by, "threshold", key, "cluster")


def cluster_by_similarity(df: DataFrame, by: list[str], key: str, vector: str, thresholds: list[float], most: int = MOST_ITEMS) -> DataFrame:
    """``by, threshold, key, cluster``: average-linkage clusters of the vectors of each group, named by smallest key.

    Groups of at most ``most`` items are clustered in a task each, larger ones in rounds over blocks, with equal
    results where no two distances are equal. ``key`` is unique in its group; rows with a NULL key or vector are left out.
    """
    df = df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull())
    kind = dict(df.dtypes)
    schema = ", ".join([*(f"{c} {kind[c]}" for c in by), "threshold double", f"{key} {kind[key]}", f"cluster {kind[key]}"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key).reset_index(drop=True)
        x, out = np.stack(pdf[vector].to_numpy()).astype(np.float64), []
        for t in thresholds:
            out.append(pdf[[*by, key]].assign(threshold=t, cluster=pdf[key].to_numpy()[average_linkage(x, t)]))
        return pd.concat(out)[[*by, "threshold", key, "cluster"]]

    own = df.select(*by, key, vector)
    named = own.withColumn("_g", F.to_json(F.struct(*by)))
    large = materialize(named.groupBy("_g").agg(F.count(F.lit(1)).alias("_k")).filter(F.col("_k") > most).select("_g"))
    if large.isEmpty():
        return own.groupBy(*by).applyInPandas(run, schema)
    small = named.join(large, "_g", "left_anti").drop("_g").groupBy(*by).applyInPandas(run, schema)
    return small.unionByName(_large_groups(named.join(large, "_g", "left_semi"), by, key, vector, thresholds, most))


def title_similarity(a: Column, b: Column) -> Column:
    """Ratio of matching characters of two strings, 0 to 1; NULL where either is NULL."""

    @pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else difflib.SequenceMatcher(None, p, q, False).ratio() for p, q in zip(x, y, strict=True)], dtype="float64")

    return ratio(a, b)
