"""Graph and topology of a complex: co-witness graph, filtration, degree profiles, curvature and Laplacian."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rungwork.operators.components import connected_components
from rungwork.operators.skew import number_rows
from rungwork.operators.splits import hash_order
from rungwork.session import materialize, spread

#: Most nodes whose spectrum is solved whole, and most entries of a matrix that one task iterates; more are iterated with joins.
SPECTRUM_NODES, SPECTRUM_ENTRIES = 3_000, 20_000_000


def cowitness(members: DataFrame, min_size: int = 1) -> DataFrame:
    """``a, b, weight, max_size``: narrators with cells in common, ``a < b``; from distinct ``cid, narrator``."""
    sizes = members.groupBy("cid").agg(F.count(F.lit(1)).alias("_s")).filter(F.col("_s") >= max(min_size, 2))
    m = members.join(sizes, "cid")
    x, y = (m.select("cid", F.col("narrator").alias(z), *(["_s"] if z == "a" else [])) for z in "ab")
    return x.join(y, "cid").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"), F.max("_s").alias("max_size"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges in both directions."""
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def filtration(members: DataFrame, levels: int = 25) -> DataFrame:
    """``k, n_cells, beta0, beta1``: components and cycles of the graph of cells with at least ``k`` members.

    An edge lives up to the size of the largest cell of its ends, so one edge list serves all levels. Components of all
    levels are found at once: nodes are named by level. Narrators without edges at a level aren't counted.
    """
    sizes = members.groupBy("cid").agg(F.count(F.lit(1)).alias("_s"))
    top = min(levels, sizes.agg(F.coalesce(F.max("_s"), F.lit(0))).first()[0])
    ks = members.sparkSession.range(1, top + 1).select(F.col("id").cast("int").alias("k"))
    cells = sizes.withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.col("_s"), F.lit(top)).cast("int")))).groupBy("k").agg(F.count(F.lit(1)).alias("n_cells"))
    alive = cowitness(members).withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.col("max_size"), F.lit(top)).cast("int"))))
    named = alive.select("k", F.concat_ws("|", "k", "a").alias("a"), F.concat_ws("|", "k", "b").alias("b"))
    found = connected_components(named).withColumn("k", F.substring_index("node", "|", 1).cast("int"))
    v = found.groupBy("k").agg(F.count(F.lit(1)).alias("_v"), F.count_distinct("component").alias("beta0"))
    e = alive.groupBy("k").agg(F.count(F.lit(1)).alias("_e"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return ks.join(cells, "k", "left").join(v, "k", "left").join(e, "k", "left").select("k", zero("n_cells").alias("n_cells"), zero("beta0").alias("beta0"), F.greatest(F.lit(0).cast("long"), zero("_e") - zero("_v") + zero("beta0")).alias("beta1"))


def persistence(curve: DataFrame) -> DataFrame:
    """One row for each Betti number: total variation, maximum and area of its curve."""
    from pyspark.sql import Window as W

    w = W.orderBy("k")
    out = None
    for name in ("beta0", "beta1"):
        s = curve.select("k", F.col(name).alias("v"), F.lag(name).over(w).alias("p")).agg(F.coalesce(F.sum(F.abs(F.col("v") - F.col("p"))), F.lit(0)).alias("variation"), F.max("v").alias("largest"), F.coalesce(F.sum((F.col("v") + F.col("p")) / 2), F.lit(0.0)).alias("area")).select(F.lit(name).alias("curve"), "variation", "largest", "area")
        out = s if out is None else out.unionByName(s)
    return out


def degree_profile(members: DataFrame, ground: DataFrame) -> DataFrame:
    """``narrator, degree, mean_size, max_size, min_size`` of the cells of each narrator; zeros without cells."""
    sizes = members.groupBy("cid").agg(F.count(F.lit(1)).alias("_s"))
    per = members.join(sizes, "cid").groupBy("narrator").agg(F.count(F.lit(1)).alias("d"), F.avg("_s").alias("m"), F.max("_s").alias("x"), F.min("_s").alias("n"))
    zero = lambda c, a: F.coalesce(F.col(c), F.lit(0)).alias(a)
    return ground.join(per, "narrator", "left").select("narrator", zero("d", "degree"), F.coalesce("m", F.lit(0.0)).alias("mean_size"), zero("x", "max_size"), zero("n", "min_size"))


def forman_curvature(edges: DataFrame) -> DataFrame:
    """``narrator, curvature``: mean over neighbours of ``4 - deg - deg``."""
    g = both_ways(edges)
    deg = g.groupBy("a").agg(F.count(F.lit(1)).alias("d"))
    both = g.join(deg.withColumnRenamed("d", "_da"), "a").join(deg.select(F.col("a").alias("b"), F.col("d").alias("_db")), "b")
    return both.groupBy(F.col("a").alias("narrator")).agg(F.avg(4 - F.col("_da") - F.col("_db")).alias("curvature"))


def laplacian(members: DataFrame) -> DataFrame:
    """``a, b, value``: entries of the normalised hypergraph Laplacian, the diagonal too."""
    de = members.groupBy("cid").agg(F.count(F.lit(1)).alias("_e"))
    dv = members.groupBy("narrator").agg(F.count(F.lit(1)).alias("_v"))
    m = members.join(de, "cid").join(dv, "narrator")
    x = m.select("cid", F.col("narrator").alias("a"), "_e", F.col("_v").alias("_va"))
    y = m.select("cid", F.col("narrator").alias("b"), F.col("_v").alias("_vb"))
    w = x.join(y, "cid").groupBy("a", "b").agg(F.sum(1 / (F.sqrt(F.col("_va") * F.col("_vb")) * F.col("_e"))).alias("w"))
    return w.select("a", "b", (F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.0) - F.col("w")).alias("value"))


def spectral_encoding(entries: DataFrame, k: int = 16, most: int = SPECTRUM_NODES, most_entries: int = SPECTRUM_ENTRIES) -> DataFrame:
    """``node, pos, value``: first ``k`` non-trivial eigenvectors of a Laplacian, signs fixed by the largest entry.

    A matrix of at most ``most`` nodes is solved whole in one task and one of at most ``most_entries`` entries by
    :func:`lowest_vectors` in one task, a larger one by :func:`spectral_by_iteration`.
    """
    entries = materialize(entries.select("a", "b", "value"))
    if entries.count() > most_entries:
        return spectral_by_iteration(entries, k)
    names = materialize(number_rows(entries.select(F.lit(1).alias("_all"), F.col("a").alias("node")).distinct(), ["_all"], ["node"]).select("node", F.col("_pos").cast("int").alias("_i")))
    n = names.count()
    placed = entries.join(names.select(F.col("node").alias("a"), F.col("_i").alias("i")), "a").join(names.select(F.col("node").alias("b"), F.col("_i").alias("j")), "b")

    def packed(pdfs):
        for pdf in pdfs:
            yield pd.DataFrame({c: [pdf[c].to_numpy(dtype=t).tobytes()] for c, t in (("i", np.int32), ("j", np.int32), ("value", np.float64))})

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j, value = (np.frombuffer(b"".join(pdf[c]), dtype=t) for c, t in (("i", np.int32), ("j", np.int32), ("value", np.float64)))
        if n <= most:
            m = np.zeros((n, n))
            m[i, j] = value
            v = np.linalg.eigh((m + m.T) / 2)[1][:, : k + 1]
        else:
            v = lowest_vectors(i, j, value, n, k + 1)
        v = v[:, 1:]
        v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])
        at, pos = np.indices(v.shape)
        return pd.DataFrame({"_i": at.ravel(), "pos": pos.ravel(), "value": v.ravel()})

    lists = placed.select("i", "j", "value").mapInPandas(packed, "i binary, j binary, value binary")
    return lists.groupBy(F.lit(1).alias("_g")).applyInPandas(solve, "_i int, pos long, value double").join(names, "_i").select("node", "pos", "value")


def lowest_vectors(i: np.ndarray, j: np.ndarray, value: np.ndarray, n: int, k: int, more: int = 8, degree: int = 16, rounds: int = 200, settled: float = 1e-8) -> np.ndarray:
    """Eigenvectors of the ``k`` least eigenvalues of a sparse symmetric matrix with eigenvalues from 0 to 1, in order.

    Subspace iteration with Chebyshev polynomials that are small from the largest kept eigenvalue to 1 and grow below
    it, until the residuals of all ``k`` settle. Equal eigenvalues are found as often as they occur, up to ``k + more``.
    Raises where the residuals don't settle.
    """
    order = np.lexsort((j, i))
    i, j, value = i[order], j[order], value[order]
    row, starts = np.unique(i, return_index=True)
    bounds, step = [*starts.tolist(), len(i)], 1 << 18
    cuts = [0]  # rows in pieces of about so many entries
    for r in range(1, len(row) + 1):
        if bounds[r] - bounds[cuts[-1]] >= step or r == len(row):
            cuts.append(r)

    def times(x: np.ndarray) -> np.ndarray:
        y = np.zeros_like(x)
        for p, q in zip(cuts, cuts[1:], strict=False):
            lo, hi = bounds[p], bounds[q]
            for c in range(x.shape[0]):
                y[c, row[p:q]] = np.add.reduceat(value[lo:hi] * x[c, j[lo:hi]], starts[p:q] - lo)
        return y

    width = min(n, k + more)
    v = np.linalg.qr(np.random.default_rng(0).standard_normal((n, width)))[0].T
    for _ in range(rounds):
        image = times(v)
        low, turn = np.linalg.eigh(v @ image.T)
        v, image = turn.T @ v, turn.T @ image
        if np.linalg.norm(image[:k] - low[:k, None] * v[:k], axis=1).max() < settled:
            return v[:k].T
        cut = min(max(low[-1], 1e-3), 0.999)
        half, centre = (1.001 - cut) / 2, (1.001 + cut) / 2
        before, now = v, (image - centre * v) / half
        for _step in range(degree - 1):
            before, now = now, 2 * (times(now) - centre * now) / half - before
        v = np.linalg.qr(now.T)[0].T
    raise RuntimeError("the eigenvectors did not settle")


def spectral_by_iteration(entries: DataFrame, k: int = 16, more: int = 8, rounds: int = 600, every: int = 4, settled: float = 1e-7) -> DataFrame:
    """:func:`spectral_encoding` by subspace iteration with sparse joins; only small Gram matrices come to the driver.

    ``2 - L`` is applied to ``k + 1 + more`` vectors at once, which are made orthonormal by the Cholesky factor of their
    products, until the wanted eigenvalues settle; a rotation in the subspace then gives the eigenvectors. Raises where
    they don't settle.
    """
    width = min(k + 1 + more, max(2, entries.select("a").distinct().count()))
    cols = [f"v{i}" for i in range(width)]
    moved = materialize(entries.select("a", "b", (F.when(F.col("a") == F.col("b"), 2.0).otherwise(0.0) - F.col("value")).alias("w")))
    start = [(F.pmod(F.xxhash64(F.lit(i), "a"), F.lit(1 << 20)) / float(1 << 20) - 0.5).alias(c) for i, c in enumerate(cols)]
    v = materialize(moved.select("a").distinct().select(F.col("a").alias("node"), *start))

    def products(x: DataFrame, left: list[str], right: list[str]) -> np.ndarray:
        row = x.agg(*[F.sum(F.col(p) * F.col(q)).alias(f"{i}_{j}") for i, p in enumerate(left) for j, q in enumerate(right)]).first()
        return np.array(row, dtype=float).reshape(len(left), len(right))

    def combined(x: DataFrame, m: np.ndarray) -> DataFrame:
        return x.select("node", *[sum((float(m[i, j]) * F.col(c) for i, c in enumerate(cols)), F.lit(0.0)).alias(cols[j]) for j in range(m.shape[1])])

    def applied(x: DataFrame) -> DataFrame:
        return moved.join(x, F.col("b") == F.col("node")).groupBy("a").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in cols]).withColumnRenamed("a", "node")

    old = None
    for _ in range(0, rounds, every):
        for _step in range(every):
            v = applied(v)
        v = materialize(v)
        factor = np.linalg.cholesky(products(v, cols, cols) + 1e-12 * np.eye(width))
        v = materialize(combined(v, np.linalg.inv(factor).T))
        image = applied(v).select("node", *[F.col(c).alias(f"y{i}") for i, c in enumerate(cols)])
        h = products(v.join(image, "node"), cols, [f"y{i}" for i in range(width)])
        values, turn = np.linalg.eigh((h + h.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        if old is not None and np.abs(values[: k + 1] - old[: k + 1]).max() < settled:
            break
        old = values
    else:
        raise RuntimeError("the eigenvalues did not settle")
    kept = combined(v, turn[:, 1 : k + 1])
    long = kept.select("node", F.posexplode(F.array(*cols[: min(k, width - 1)])).alias("pos", "value"))
    sign = long.groupBy("pos").agg(F.sign(F.max_by("value", F.abs("value"))).alias("_s"))
    return long.join(F.broadcast(sign), "pos").select("node", F.col("pos").cast("long").alias("pos"), (F.col("value") * F.col("_s")).alias("value"))


def encodings(members: DataFrame, ground: DataFrame, k: int = 16) -> DataFrame:
    """``node, block``: eigenvectors, curvature and degree profile of each narrator, every column standardised.

    Narrators outside the Laplacian have zeros for its vectors before that; a constant column becomes zeros.
    """
    spectral = materialize(spectral_encoding(laplacian(members), k).groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("_v")))
    curve = forman_curvature(cowitness(members)).select(F.col("narrator").alias("node"), "curvature")
    profile = degree_profile(members, ground).select(F.col("narrator").alias("node"), "degree", "mean_size", "max_size", "min_size")
    width = spectral.agg(F.max(F.size("_v"))).first()[0] or 0
    vec = [F.coalesce(F.get("_v", F.lit(i)), F.lit(0.0)).alias(f"c{i}") for i in range(width)]
    rest = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"c{width + i}") for i, c in enumerate(("curvature", "degree", "mean_size", "max_size", "min_size"))]
    flat = materialize(profile.join(spectral, "node", "left").join(curve, "node", "left").select("node", *vec, *rest))
    names = [c for c in flat.columns if c != "node"]
    stats = flat.agg(*[F.avg(c).alias(f"m_{c}") for c in names], *[F.stddev_pop(c).alias(f"s_{c}") for c in names])
    block = F.array(*[F.coalesce(F.try_divide(F.col(c) - F.col(f"m_{c}"), F.when(F.col(f"s_{c}") > 1e-12, F.col(f"s_{c}"))), F.lit(0.0)) for c in names])
    return flat.join(F.broadcast(stats)).select("node", block.alias("block"))


def permutation_test(members: DataFrame, draws: int = 1_000) -> DataFrame:
    """``curve, observed, null_mean, null_sd, p_value, degenerate``: areas of the Betti curves against shuffled cells.

    Dealing the member sets anew to the cells changes names only: the co-witness graph doesn't depend on them, so each of
    the ``draws`` gives the observed areas again. They are therefore not drawn; the null distribution is one point, p is
    1 by construction, and ``degenerate`` says so.
    """
    seen = persistence(filtration(members)).select("curve", F.col("area").cast("double").alias("observed"))
    return seen.select("curve", "observed", F.col("observed").alias("null_mean"), F.lit(0.0).alias("null_sd"), F.lit(1.0).alias("p_value"), F.lit(draws).alias("draws"), F.lit(True).alias("degenerate"))


#: What a curve's area is predicted from: moments of the cells' sizes and counts of the graph.
PLAIN = ("size_mean", "size_sd", "size_median", "size_max", "n_cells", "singletons", "n_edges", "n_nodes")


def _bits(masks: pd.Series, draws: int) -> np.ndarray:
    """Masks of packed bits as rows of 0 and 1."""
    packed = np.frombuffer(b"".join(masks), dtype=np.uint8).reshape(len(masks), -1)
    return np.unpackbits(packed, axis=1, count=draws)


def _forest(edges: pd.DataFrame, top: int) -> pd.DataFrame:
    """``replicate, k, n_nodes, beta0`` of one replicate from the joined lists of its edges ``u, v, level``."""
    u, v, level = (np.frombuffer(b"".join(edges[c]), dtype=np.int32) for c in ("u", "v", "level"))
    names, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = at[: len(u)], at[len(u) :]
    root, seen, out = np.arange(len(names)), np.zeros(len(names), dtype=bool), []
    for k in range(top, 0, -1):
        new = level == k
        x, y = u[new], v[new]
        seen[x] = seen[y] = True
        while True:  # hook the larger root on the smaller one, then point all at their roots
            x, y = root[x], root[y]
            apart = x != y
            if not apart.any():
                break
            x, y = x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root != (up := root[root])).any():
                root = up
        out.append((int(edges["replicate"].iloc[0]), k, int(seen.sum()), int((seen & (root == np.arange(len(names)))).sum())))
    return pd.DataFrame(out, columns=["replicate", "k", "n_nodes", "beta0"])


def resampled_curves(members: DataFrame, draws: int = 60, share: float = 0.8, levels: int = 25, seed: int = 0) -> DataFrame:
    """``replicate``, the columns of ``PLAIN``, ``area0, area1``: curves of complexes over a share of the narrators each.

    The first narrators in hash order are kept and emptied cells dropped. Which replicates keep a narrator is a row of
    bits, and the sizes of a cell in all of them one list, so a pair of narrators is one row for all replicates. A level
    has the components that its cells' members form; one task finds those of all levels of one replicate.
    """
    ours = members.select("cid", "narrator").distinct()
    who = materialize(number_rows(ours.select(F.lit(1).alias("_all"), "narrator").distinct(), ["_all"], ["narrator"]).select("narrator", F.col("_pos").cast("int").alias("_i")))
    keep = max(4, int(share * who.count()))
    dealt = who.select("narrator", "_i").withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_h", hash_order(seed, "replicate", "narrator"))
    kept = number_rows(dealt, ["replicate"], ["_h", "narrator"]).filter(F.col("_pos") < keep).groupBy("narrator", "_i").agg(F.collect_list("replicate").alias("_r"))

    def masked(pdfs):
        for pdf in pdfs:
            bits = np.zeros((len(pdf), draws), dtype=np.uint8)
            for i, r in enumerate(pdf["_r"]):
                bits[i, r] = 1
            yield pd.DataFrame({"narrator": pdf["narrator"], "_i": pdf["_i"], "_m": [x.tobytes() for x in np.packbits(bits, axis=1)]})

    m = materialize(ours.join(kept.mapInPandas(masked, "narrator string, _i int, _m binary"), "narrator").select("cid", "_i", "_m"))
    cells = materialize(m.groupBy("cid").agg(F.collect_list(F.struct("_i", "_m")).alias("_x")).select("cid", "_x._i", "_x._m"))

    def sized(pdfs):
        for pdf in pdfs:
            sizes = [_bits(x, draws).sum(axis=0, dtype=np.int32) for x in pdf["_m"]]
            yield pd.DataFrame({"cid": pdf["cid"], "_s": sizes, "_l": [np.minimum(x, levels).astype(np.uint8 if levels < 256 else np.int32).tobytes() for x in sizes]})

    def linked(pdfs):
        for pdf in pdfs:
            lists = [([], [], []) for _ in range(draws)]
            for ids, masks in zip(pdf["_i"], pdf["_m"], strict=True):
                bits, ids = _bits(masks, draws), np.asarray(ids, dtype=np.int32)
                for r in np.flatnonzero(bits.sum(axis=0, dtype=np.int64) > 1):
                    inside = ids[bits[:, r] == 1]
                    rest = np.full(len(inside) - 1, min(len(inside), levels), dtype=np.int32)
                    for to, x in zip(lists[r], (np.full(len(rest), inside[0], dtype=np.int32), inside[1:], rest), strict=True):
                        to.append(x)
            some = [(r, *(np.concatenate(x).tobytes() for x in lists[r])) for r in range(draws) if lists[r][0]]
            yield pd.DataFrame(some, columns=["replicate", "u", "v", "level"])

    def counted(pdfs):
        n = np.zeros(draws * (levels + 1), dtype=np.int64)
        for pdf in pdfs:
            if not len(pdf):
                continue
            lists = pdf["_l"].tolist()
            starts = np.cumsum([0, *map(len, lists)])[:-1]
            each = np.frombuffer(b"".join(b for x in lists for b in x), dtype=np.uint8 if levels < 256 else np.int32).reshape(-1, draws)
            best = np.maximum.reduceat(each, starts, axis=0).astype(np.int64) * (_bits(pdf["_ma"], draws) & _bits(pdf["_mb"], draws))
            n += np.bincount((best + np.arange(draws) * (levels + 1)).ravel(), minlength=len(n))
        at = np.flatnonzero(n)
        yield pd.DataFrame({"replicate": (at // (levels + 1)).astype(np.int32), "level": (at % (levels + 1)).astype(np.int32), "n": n[at]})

    sizes = materialize(spread(cells.select("cid", "_m")).mapInPandas(sized, "cid string, _s array<int>, _l binary"))
    each = sizes.select(F.posexplode("_s").alias("replicate", "_s")).filter("_s > 0")
    plain = each.groupBy("replicate").agg(F.avg("_s").alias("size_mean"), F.stddev_pop("_s").alias("size_sd"), F.expr("percentile(_s, 0.5)").alias("size_median"), F.max("_s").alias("size_max"), F.count(F.lit(1)).alias("n_cells"), F.avg((F.col("_s") == 1).cast("double")).alias("singletons"))
    plain = materialize(plain)
    found = spread(cells).mapInPandas(linked, "replicate int, u binary, v binary, level binary").groupBy("replicate").applyInPandas(lambda x: _forest(x, levels), "replicate int, k int, n_nodes long, beta0 long")
    found = materialize(found)
    nodes = found.filter("k = 1").select("replicate", "n_nodes")
    x, y = (m.select("cid", F.col("_i").alias(c), F.col("_m").alias(f"_m{c}")) for c in "ab")
    pairs = x.join(y, "cid").filter("a < b").join(sizes.select("cid", "_l"), "cid").groupBy("a", "b").agg(F.first("_ma").alias("_ma"), F.first("_mb").alias("_mb"), F.collect_list("_l").alias("_l"))
    alive = materialize(pairs.select("_ma", "_mb", "_l").mapInPandas(counted, "replicate int, level int, n long").groupBy("replicate", "level").agg(F.sum("n").alias("n")).filter("level > 0"))
    graph = alive.groupBy("replicate").agg(F.sum("n").alias("n_edges"))
    e = alive.select("replicate", "n", F.explode(F.sequence(F.lit(1), F.col("level"))).alias("k")).groupBy("replicate", "k").agg(F.sum("n").alias("_e"))
    v = found.select("replicate", "k", F.col("n_nodes").alias("_v"), F.col("beta0").alias("b0"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    ks = plain.select("replicate", F.least(F.col("size_max"), F.lit(levels)).cast("int").alias("_top")).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("_top"))))
    curve = ks.join(v, ["replicate", "k"], "left").join(e, ["replicate", "k"], "left").select("replicate", "_top", "k", zero("b0").alias("b0"), F.greatest(F.lit(0), zero("_e") - zero("_v") + zero("b0")).alias("b1"))
    # trapezoids: the ends count half, a curve of one level has no area
    w = F.when(F.col("_top") == 1, 0.0).when((F.col("k") == 1) | (F.col("k") == F.col("_top")), 0.5).otherwise(1.0)
    area = curve.groupBy("replicate").agg(F.sum(w * F.col("b0")).alias("area0"), F.sum(w * F.col("b1")).alias("area1"))
    return plain.join(graph, "replicate", "left").join(nodes, "replicate", "left").join(area, "replicate").select("replicate", *[zero(c).cast("double").alias(c) for c in PLAIN], "area0", "area1")


def simpler_explanation(curves: DataFrame, folds: int = 5, threshold: float = 0.9) -> DataFrame:
    """``curve, n, r2, constant, redundant``: how well sizes and counts alone predict the areas of the Betti curves.

    The mean of R squared over held-out folds of a least-squares fit; a few dozen replicates are fitted in the driver.
    NULL for a constant area and fewer than eight replicates. An area predicted above the threshold says nothing more.
    """
    rows = curves.orderBy(F.md5(F.col("replicate").cast("string"))).collect()
    out = []
    for name in ("area0", "area1"):
        y = np.array([float(r[name]) for r in rows])
        constant, r2 = bool(len(y) == 0 or y.std() == 0), None
        if len(y) >= 8 and not constant:
            x = np.array([[r[c] for c in PLAIN] for r in rows], dtype=float)
            x = (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
            x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
            fold, scores = np.arange(len(y)) % folds, []
            for f in range(folds):
                held = fold == f
                beta = np.linalg.lstsq(x[~held], y[~held], rcond=None)[0]
                spread = ((y[held] - y[held].mean()) ** 2).sum()
                if spread > 0:
                    scores.append(1 - ((y[held] - x[held] @ beta) ** 2).sum() / spread)
            r2 = float(np.mean(scores)) if scores else None
        out.append((name, len(y), r2, constant, bool(r2 is not None and r2 > threshold)))
    return curves.sparkSession.createDataFrame(out, "curve string, n int, r2 double, constant boolean, redundant boolean")
