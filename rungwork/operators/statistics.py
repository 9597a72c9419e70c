"""Cluster-aware statistics: subsampling and bootstrap intervals, design effect, distances of samples, clusterings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rungwork.operators.skew import number_rows
from rungwork.operators.splits import hash_order


def design_effect(df: DataFrame, cluster: str, value: str) -> DataFrame:
    """One row ``n_clusters, mean_size, icc, deff`` from sizes, means and variances of the clusters."""
    c = df.groupBy(cluster).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_pop(value), F.lit(0.0)).alias("v")).filter("n > 0")
    g = c.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("t"), F.sum(F.col("n") * F.col("n")).alias("q"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("ss"), F.sum(F.col("n") * F.col("v")).alias("w"))
    msb = F.try_divide(F.col("ss") - F.col("s") * F.col("s") / F.col("t"), F.col("k") - 1)
    msw = F.try_divide(F.col("w"), F.col("t") - F.col("k"))
    n0 = F.try_divide(F.col("t") - F.col("q") / F.col("t"), F.col("k") - 1)
    icc = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(msb - msw, msb + (n0 - 1) * msw), F.lit(0.0))))
    return g.select(F.col("k").alias("n_clusters"), (F.col("t") / F.col("k")).alias("mean_size"), icc.alias("icc"), (1 + (F.col("t") / F.col("k") - 1) * icc).alias("deff"))


def poisson_count(place: Column, most: int = 8) -> Column:
    """Poisson(1) count of a uniform place in [0, 1)."""
    import math

    out, cum = F.lit(most), 0.0
    bounds = []
    for k in range(most):
        cum += math.exp(-1) / math.factorial(k)
        bounds.append((cum, k))
    for cum, k in reversed(bounds):
        out = F.when(place < cum, k).otherwise(out)
    return out


def uniform_hash(seed: int, *parts: Column) -> Column:
    """A place in [0, 1) by MD5 of seed and parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])), 1, 12), 16, 10).cast("double") / float(1 << 48)


def resampled_means(units: DataFrame, unit: str, draws: int, seed: int) -> DataFrame:
    """``_r, _m``: the mean over all units, weighted by hashed Poisson counts, of each draw; ``units`` has ``_s, _n``."""
    r = units.withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("_w", poisson_count(uniform_hash(seed, F.col("_r"), F.col(unit))))
    return r.groupBy("_r").agg(F.try_divide(F.sum(F.col("_w") * F.col("_s")), F.sum(F.col("_w") * F.col("_n"))).alias("_m"))


def bootstrap_mean(df: DataFrame, unit: str, value: str, draws: int = 10_000, seed: int = 0) -> DataFrame:
    """One row ``mean, lo, hi, se``: percentile interval of the mean over resampled units.

    Units are reduced to their sum and count first; each draw weights them by hashed Poisson counts, so rows of values
    are never repeated.
    """
    u = df.filter(F.col(value).isNotNull()).groupBy(unit).agg(F.sum(value).alias("_s"), F.count(F.lit(1)).alias("_n"))
    means = resampled_means(u, unit, draws, seed)
    point = u.agg((F.sum("_s") / F.sum("_n")).alias("mean"))
    spread = means.agg(F.expr("percentile(_m, 0.025)").alias("lo"), F.expr("percentile(_m, 0.975)").alias("hi"), F.stddev_samp("_m").alias("se"))
    return point.crossJoin(spread)


def paired_bootstrap(df: DataFrame, unit: str, a: str, b: str, draws: int = 10_000, seed: int = 0) -> DataFrame:
    """:func:`bootstrap_mean` of the difference of two columns."""
    return bootstrap_mean(df.withColumn("_d", F.col(a) - F.col(b)), unit, "_d", draws, seed)


def difference_in_differences(df: DataFrame, unit: str, group: str, first: str, a: str, b: str, draws: int = 10_000, seed: int = 0) -> DataFrame:
    """One row ``did, lo, hi``: mean of ``a - b`` in group ``first`` less that in all others, resampled over units.

    A draw in which a side is empty counts for nothing.
    """
    d = F.col(a) - F.col(b)
    one = F.col(group) == first
    side = lambda c, f: F.sum(F.when(c, f))
    u = df.filter(d.isNotNull()).groupBy(unit).agg(side(one, d).alias("s1"), side(one, F.lit(1)).alias("n1"), side(~one, d).alias("s0"), side(~one, F.lit(1)).alias("n0"))
    r = u.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(draws)))).withColumn("_w", F.when(F.col("_r") == 0, 1).otherwise(poisson_count(uniform_hash(seed, F.col("_r"), F.col(unit)))))
    w = lambda c: F.sum(F.col("_w") * F.coalesce(F.col(c), F.lit(0)))
    t = r.groupBy("_r").agg((F.try_divide(w("s1"), w("n1")) - F.try_divide(w("s0"), w("n0"))).alias("_d"))
    return t.agg(F.max(F.when(F.col("_r") == 0, F.col("_d"))).alias("did"), F.expr("percentile(_d, 0.025) FILTER (WHERE _r > 0)").alias("lo"), F.expr("percentile(_d, 0.975) FILTER (WHERE _r > 0)").alias("hi"))


def subsample_singletons(members: DataFrame, draws: int = 2_000, fraction: float = 0.632, z: float = 1.96, seed: int = 0) -> DataFrame:
    """One row ``point, se, lo, hi``: the share of cells with one member, with an interval by subsampling narrators.

    Each draw keeps the first ``round(fraction * n)`` narrators in hash order without replacement and drops emptied
    cells; drawing with replacement would repeat members and hide singletons.
    """
    who = members.select("narrator").distinct()
    n = who.agg(F.count(F.lit(1)).alias("_n"))
    dealt = who.withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("_h", hash_order(seed, "_r", "narrator"))
    kept = number_rows(dealt, ["_r"], ["_h", "narrator"]).join(F.broadcast(n)).filter(F.col("_pos") < F.round(fraction * F.col("_n"))).select("_r", "narrator")
    one = lambda s: F.avg((F.col(s) == 1).cast("double"))
    stat = members.join(kept, "narrator").groupBy("_r", "cid").agg(F.count(F.lit(1)).alias("_s")).groupBy("_r").agg(one("_s").alias("_v"))
    sd = stat.agg(F.stddev_samp("_v").alias("_sd"))
    point = members.groupBy("cid").agg(F.count(F.lit(1)).alias("_s")).agg(one("_s").alias("point"))
    se = F.col("_sd") * F.sqrt(F.round(fraction * F.col("_n")) / F.col("_n"))
    return point.crossJoin(sd).crossJoin(n).select("point", se.alias("se"), (F.col("point") - z * se).alias("lo"), (F.col("point") + z * se).alias("hi"))


def ks_distance(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """One row ``ks``: largest distance of two samples' distribution functions; NULL below two values in either."""
    both = a.select(value, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(value, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    h = both.groupBy(value).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    upto = W.orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    n = h.agg(F.sum("_a").alias("_na"), F.sum("_b").alias("_nb"))
    d = h.select(F.sum("_a").over(upto).alias("_ca"), F.sum("_b").over(upto).alias("_cb")).join(F.broadcast(n))
    return d.agg(F.when((F.max("_na") >= 2) & (F.max("_nb") >= 2), F.max(F.abs(F.try_divide("_ca", F.col("_na")) - F.try_divide("_cb", F.col("_nb"))))).alias("ks"))


def _quantiles(df: DataFrame, by: str, value: str, points: int) -> DataFrame:
    """``g, n, q``: of each group the number of values and their quantiles at evenly spaced places from 0 to 1."""
    probs = ", ".join(repr(i / (points - 1)) for i in range(points))
    return df.filter(F.col(by).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(by).alias("g")).agg(F.count(F.lit(1)).alias("n"), F.expr(f"percentile({value}, array({probs}))").alias("q"))


def _violation(a: Column, b: Column, points: int) -> Column:
    """Share of the squared distance of two quantile functions, by trapezoids, at which ``a`` lies below ``b``."""
    d = F.zip_with(a, b, lambda x, y: y - x)
    weighed = F.transform(d, lambda x, i: F.struct(x.alias("d"), F.when((i == 0) | (i == points - 1), 0.5).otherwise(1.0).alias("w")))
    against = F.aggregate(weighed, F.lit(0.0), lambda s, x: s + F.when(x["d"] > 0, x["w"] * x["d"] * x["d"]).otherwise(0.0))
    total = F.aggregate(weighed, F.lit(0.0), lambda s, x: s + x["w"] * x["d"] * x["d"])
    return F.coalesce(F.try_divide(against, total), F.lit(0.5))


def violation_ratio(df: DataFrame, by: str, a: str, b: str, value: str, points: int = 1000) -> DataFrame:
    """One row ``ratio``: how much of the squared distance of two groups' quantiles speaks against ``a`` over ``b``."""
    q = _quantiles(df.filter(F.col(by).isin(a, b)), by, value, points)
    pair = q.agg(F.max(F.when(F.col("g") == a, F.col("q"))).alias("_a"), F.max(F.when(F.col("g") == b, F.col("q"))).alias("_b"))
    return pair.select(_violation(F.col("_a"), F.col("_b"), points).alias("ratio"))


def stochastic_order(df: DataFrame, by: str, value: str, points: int = 1000, confidence: float = 0.95) -> DataFrame:
    """``a, b, ratio, level``: the violation ratio of every ordered pair of groups; NULL below two values in either.

    0 is dominance of ``a``, below 0.5 almost so, 1 dominance of ``b``. ``level`` is the confidence with the doubt
    divided by the number of ordered pairs.
    """
    q = _quantiles(df, by, value, points)
    x, y = (q.select(F.col("g").alias(z), F.col("n").alias(f"_n{z}"), F.col("q").alias(f"_q{z}")) for z in "ab")
    n = q.agg((F.count(F.lit(1)) * (F.count(F.lit(1)) - 1)).alias("_pairs"))
    enough = (F.col("_na") >= 2) & (F.col("_nb") >= 2)
    met = x.join(F.broadcast(y), F.col("a") != F.col("b")).join(F.broadcast(n))
    return met.select("a", "b", F.when(enough, _violation(F.col("_qa"), F.col("_qb"), points)).alias("ratio"), (1 - (1 - confidence) / F.greatest("_pairs", F.lit(1))).alias("level"))


def mutual_information(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row ``n, nats``: mutual information of two discrete columns from their contingency counts."""
    cells = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count(F.lit(1)).alias("_c"))
    mx, my = (cells.groupBy(z).agg(F.sum("_c").alias(f"_m{i}")) for i, z in enumerate((x, y)))
    total = cells.agg(F.sum("_c").alias("_n"))
    both = cells.join(mx, x).join(my, y).join(F.broadcast(total))
    term = F.col("_c") / F.col("_n") * F.log(F.col("_c") * F.col("_n") / (F.col("_m0") * F.col("_m1")))
    return both.agg(F.coalesce(F.max("_n"), F.lit(0)).alias("n"), F.coalesce(F.greatest(F.lit(0.0), F.sum(term)), F.lit(0.0)).alias("nats"))


def variance_components(df: DataFrame, partition: str, replicate: str, value: str) -> DataFrame:
    """One row: how much of the variance of the partitions' means is the partitions' own.

    ``within`` is the mean variance of the replicates of a partition; the observed variance of the means carries a part
    of it, ``within`` over the replicates of a partition, and what is left is the partitions' component.
    """
    per = df.filter(F.col(value).isNotNull()).groupBy(partition).agg(F.avg(value).alias("_m"), F.var_samp(value).alias("_v"), F.count_distinct(replicate).alias("_k"))
    s = per.agg(F.count(F.lit(1)).alias("n_partitions"), F.avg("_m").alias("mean"), F.stddev_samp("_m").alias("sd"), F.min("_m").alias("least"), F.max("_m").alias("most"), F.count_if(F.col("_m") < 0).alias("n_negative"), F.count_if(F.col("_m") > 0).alias("n_positive"), F.var_samp("_m").alias("observed"), F.avg("_v").alias("within"), F.avg("_k").alias("_k"))
    own = F.col("observed") - F.col("within") / F.col("_k")
    return s.withColumn("component", own).withColumn("share", F.try_divide("component", F.col("observed"))).drop("_k")


def sign_flips(df: DataFrame, key: str, side: str, a: str, b: str, value: str) -> DataFrame:
    """One row ``n, n_flips``: keys whose mean value is below zero on one side and not on the other."""
    wide = df.filter(F.col(side).isin(a, b)).groupBy(key).agg(F.avg(F.when(F.col(side) == a, F.col(value))).alias("_a"), F.avg(F.when(F.col(side) == b, F.col(value))).alias("_b")).filter("_a is not null and _b is not null")
    return wide.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("_a") < 0) != (F.col("_b") < 0)).alias("n_flips"))


def paired_advantage(df: DataFrame, unit: str, model: str, first: str, second: str, value: str) -> DataFrame:
    """``unit, n_rows, advantage``: mean value under ``first`` less that under ``second``, for units that have both.

    Repeated runs of a unit are averaged first, so they don't count as units.
    """
    of = lambda m: F.avg(F.when(F.col(model) == m, F.col(value)))
    wide = df.filter(F.col(model).isin(first, second)).groupBy(unit).agg(F.count(F.lit(1)).alias("n_rows"), of(first).alias("_a"), of(second).alias("_b"))
    return wide.filter("_a is not null and _b is not null").select(unit, "n_rows", (F.col("_a") - F.col("_b")).alias("advantage"))


def run_table(df: DataFrame, rows: list[str], column: str, columns: list[str], value: str) -> DataFrame:
    """``rows`` with the mean, standard deviation and number of ``value`` under each of the named ``columns``.

    Columns are named, so the pivot needs no pass of its own; a cell without rows is NULL, its number 0.
    """
    parts = []
    for c in columns:
        v = F.when(F.col(column) == c, F.col(value))
        parts += [F.avg(v).alias(f"{c} mean"), F.stddev_samp(v).alias(f"{c} sd"), F.count(v).alias(f"{c} n")]
    return df.groupBy(*rows).agg(*parts)


def interaction(df: DataFrame, y: str, flag: str, x: str, cluster: str) -> DataFrame:
    """One row ``n, n_clusters, coefficient, se, lo, hi``: of ``flag * x`` in ``y ~ flag + x + flag * x``.

    Least squares from sums of products; the standard error allows for dependence within clusters. NULL where the
    columns are linearly dependent.
    """
    import numpy as np

    spark = df.sparkSession
    cols = [F.lit(1.0), F.col("_f"), F.col("_x"), F.col("_f") * F.col("_x")]
    d = df.select(F.col(y).cast("double").alias("_y"), F.col(flag).cast("double").alias("_f"), F.col(x).cast("double").alias("_x"), F.col(cluster).alias("_c")).filter("_y is not null and _f is not null and _x is not null and _c is not null")
    d = d.select("_c", "_y", *[c.alias(f"x{i}") for i, c in enumerate(cols)])
    sums = d.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_c").alias("k"), *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i in range(4) for j in range(i, 4)], *[F.sum(F.col(f"x{i}") * F.col("_y")).alias(f"t{i}") for i in range(4)]).first()
    out = "n long, n_clusters long, coefficient double, se double, lo double, hi double"
    g = np.array([[float(sums[f"s{min(i, j)}{max(i, j)}"] or 0.0) for j in range(4)] for i in range(4)])
    if sums["n"] <= 4 or np.linalg.matrix_rank(g) < 4:
        return spark.createDataFrame([(sums["n"], sums["k"], None, None, None, None)], out)
    inverse = np.linalg.inv(g)
    beta = inverse @ np.array([float(sums[f"t{i}"]) for i in range(4)])
    e = F.col("_y") - sum((float(beta[i]) * F.col(f"x{i}") for i in range(1, 4)), float(beta[0]) * F.col("x0"))
    scores = d.groupBy("_c").agg(*[F.sum(F.col(f"x{i}") * e).alias(f"u{i}") for i in range(4)])
    meat = scores.agg(*[F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"m{i}{j}") for i in range(4) for j in range(i, 4)]).first()
    m = np.array([[float(meat[f"m{min(i, j)}{max(i, j)}"]) for j in range(4)] for i in range(4)])
    n, k = sums["n"], sums["k"]
    fix = k / (k - 1) * (n - 1) / (n - 4) if k > 1 else 1.0
    se = float(np.sqrt(max(0.0, (inverse @ m @ inverse)[3, 3] * fix)))
    return spark.createDataFrame([(n, k, float(beta[3]), se, float(beta[3] - 1.96 * se), float(beta[3] + 1.96 * se))], out)


def bca_mean(df: DataFrame, unit: str, value: str, draws: int = 10_000, seed: int = 0) -> DataFrame:
    """One row ``point, lo, hi, z0, a``: bias-corrected and accelerated interval of the mean over resampled units.

    Draws are those of :func:`bootstrap_mean`; the acceleration comes from the means without each unit, in closed form.
    """
    from statistics import NormalDist

    norm = NormalDist()
    u = df.filter(F.col(value).isNotNull()).groupBy(unit).agg(F.sum(value).cast("double").alias("_s"), F.count(F.lit(1)).alias("_n"))
    spark = df.sparkSession
    t = u.agg(F.sum("_s").alias("s"), F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k")).first()
    schema = "point double, lo double, hi double, z0 double, a double"
    if not t["n"]:
        return spark.createDataFrame([(None,) * 5], schema)
    point = t["s"] / t["n"]
    means = resampled_means(u, unit, draws, seed)
    below = means.agg(F.avg((F.col("_m") < point).cast("double"))).first()[0] or 0.0
    z0 = norm.inv_cdf(min(max(below, 0.5 / draws), 1 - 0.5 / draws))
    without = u.filter(F.col("_n") < t["n"]).select(((t["s"] - F.col("_s")) / (t["n"] - F.col("_n"))).alias("_j"))
    centre = without.agg(F.avg("_j")).first()[0]
    a = 0.0
    if centre is not None:
        d = centre - F.col("_j")
        m = without.agg(F.sum(d * d * d).alias("c"), F.sum(d * d).alias("q")).first()
        a = m["c"] / (6 * m["q"] ** 1.5) if m["q"] else 0.0

    def level(p: float) -> float:
        z = z0 + norm.inv_cdf(p)
        return min(1.0, max(0.0, norm.cdf(z0 + z / max(1e-12, 1 - a * z))))

    lo, hi = means.agg(F.expr(f"percentile(_m, array({level(0.025)!r}D, {level(0.975)!r}D))")).first()[0] or (None, None)
    return spark.createDataFrame([(point, lo, hi, z0, a)], schema)


def clusters_overlap(gold: DataFrame, system: DataFrame) -> DataFrame:
    """``gold_id, sys_id, n``: items common to a gold and a system cluster; both have ``item`` and their id."""
    return gold.join(system, "item").groupBy("gold_id", "sys_id").agg(F.count(F.lit(1)).alias("n"))


def clustering_scores(gold: DataFrame, system: DataFrame) -> DataFrame:
    """One row of precision and recall: MUC, B-cubed and LEA, from the overlap counts of disjoint clusterings."""
    over = clusters_overlap(gold, system)
    gs = gold.groupBy("gold_id").agg(F.count(F.lit(1)).alias("_g"))
    ss = system.groupBy("sys_id").agg(F.count(F.lit(1)).alias("_s"))
    o = over.join(gs, "gold_id").join(ss, "sys_id")
    pairs = lambda n: n * (n - 1) / 2

    def side(key: str, size: str, other: str) -> DataFrame:
        mine = o.groupBy(key).agg(F.sum("n").alias("_in"), F.count(F.lit(1)).alias("_parts"), F.sum(pairs(F.col("n"))).alias("_links"), F.sum(F.col("n") * F.col("n")).alias("_sq"), F.max(F.when(F.col(other) == 1, 1).otherwise(0)).alias("_alone")).join(gs if key == "gold_id" else ss, key, "right")
        parts = F.coalesce("_parts", F.lit(0)) + F.col(size) - F.coalesce("_in", F.lit(0))
        lea = F.when(F.col(size) == 1, F.coalesce("_alone", F.lit(0)).cast("double")).otherwise(F.coalesce("_links", F.lit(0.0)) / pairs(F.col(size)))
        name = "recall" if key == "gold_id" else "precision"
        return mine.agg(
            F.try_divide(F.sum(F.when(F.col(size) > 1, F.col(size) - parts)), F.sum(F.when(F.col(size) > 1, F.col(size) - 1))).alias(f"muc_{name}"),
            F.try_divide(F.sum(F.coalesce("_sq", F.lit(0)) / F.col(size)), F.sum(F.coalesce("_in", F.lit(0)))).alias(f"b3_{name}"),
            F.try_divide(F.sum(F.col(size) * lea), F.sum(size)).alias(f"lea_{name}"),
        )

    return side("gold_id", "_g", "_s").crossJoin(side("sys_id", "_s", "_g"))


def slope_hc3(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row ``n, intercept, slope, se``: least squares with HC3 standard error of the slope, in two passes of sums."""
    s = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    fit = s.agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("_mx"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_sxx(y, x).alias("_sxx"))
    r = s.join(F.broadcast(fit)).select("n", "slope", "intercept", "_sxx", (F.col(x) - F.col("_mx")).alias("_d"), (F.col(y) - F.col("intercept") - F.col("slope") * F.col(x)).alias("_e"))
    lev = 1 / F.col("n") + F.try_divide(F.col("_d") * F.col("_d"), F.col("_sxx"))
    return r.groupBy("n", "intercept", "slope", "_sxx").agg(F.sum(F.pow(F.try_divide(F.col("_d") * F.col("_e"), 1 - lev), F.lit(2.0))).alias("_m")).select("n", "intercept", "slope", (F.sqrt("_m") / F.col("_sxx")).alias("se"))
