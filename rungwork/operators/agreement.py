"""Agreement of annotators: confusion, unanimity, Fleiss kappa, Gwet AC1, ordinal alpha and kinds of dispute."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def confusion(labels: DataFrame) -> DataFrame:
    """``annotator_a, annotator_b, label_a, label_b, n`` over items both labelled; ``annotator, item, label`` in."""
    a, b = (labels.select("item", F.col("annotator").alias(f"annotator_{x}"), F.col("label").alias(f"label_{x}")) for x in "ab")
    return a.join(b, "item").filter("annotator_a < annotator_b").groupBy("annotator_a", "annotator_b", "label_a", "label_b").agg(F.count(F.lit(1)).alias("n"))


def diagnostics(labels: DataFrame) -> DataFrame:
    """One row over items with two labels or more: unanimity, pairwise agreement, Fleiss kappa, AC1 and skew.

    Unequal numbers of labels are allowed. The paradox flag is set where agreement is above 0.7 and the largest
    category's share above 0.6 while kappa is below 0.2.
    """
    per = labels.groupBy("item", "label").agg(F.count(F.lit(1)).alias("c"))
    items = per.groupBy("item").agg(F.sum("c").alias("m"), F.sum(F.col("c") * (F.col("c") - 1)).alias("s"), F.count(F.lit(1)).alias("k")).filter("m >= 2")
    agree = items.agg(F.count(F.lit(1)).alias("n_items"), F.avg((F.col("k") == 1).cast("double")).alias("unanimity"), F.avg(F.col("s") / (F.col("m") * (F.col("m") - 1))).alias("po"), F.sum("m").alias("_m"))
    cats = per.join(items.select("item"), "item", "left_semi").groupBy("label").agg(F.sum("c").alias("_c")).join(F.broadcast(agree.select("_m"))).withColumn("_p", F.col("_c") / F.col("_m"))
    marg = cats.agg(F.sum(F.col("_p") * F.col("_p")).alias("_pe"), F.sum(F.col("_p") * (1 - F.col("_p"))).alias("_g"), F.count(F.lit(1)).alias("_q"), F.max("_p").alias("skew"))
    kappa = F.try_divide(F.col("po") - F.col("_pe"), 1 - F.col("_pe"))
    pg = F.try_divide(F.col("_g"), F.col("_q") - 1)
    return agree.join(F.broadcast(marg)).select("n_items", "unanimity", F.col("po").alias("pairwise"), kappa.alias("fleiss_kappa"), F.try_divide(F.col("po") - pg, 1 - pg).alias("gwet_ac1"), "skew", ((F.col("po") > 0.7) & (F.col("skew") > 0.6) & (kappa < 0.2)).alias("paradox"))


def ordinal_alpha(labels: DataFrame, by: list[str]) -> DataFrame:
    """``by, alpha``: Krippendorff's alpha with the ordinal metric; NULL where all labels are equal.

    Coincidences come from each item's counts of categories, not from pairs of labels.
    """
    per = labels.groupBy(*by, "item", "label").agg(F.count(F.lit(1)).alias("c"))
    m = per.groupBy(*by, "item").agg(F.sum("c").alias("m")).filter("m >= 2")
    per = per.join(m, [*by, "item"])
    x, y = (per.select(*by, "item", "m", F.col("label").alias(f"l{z}"), F.col("c").alias(f"c{z}")) for z in "ab")
    o = x.join(y.drop("m"), [*by, "item"]).groupBy(*by, "la", "lb").agg(F.sum(F.col("ca") * (F.col("cb") - (F.col("la") == F.col("lb")).cast("int")) / (F.col("m") - 1)).alias("o"))
    n = per.groupBy(*by, "label").agg(F.sum("c").alias("n"))
    order = W.partitionBy(*by).orderBy("label")
    cum = n.withColumn("_cum", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("n") / 2)
    p, q = (cum.select(*by, F.col("label").alias(f"l{z}"), F.col("n").alias(f"n{z}"), F.col("_cum").alias(f"u{z}")) for z in "ab")
    pairs = p.join(q, by).withColumn("_d", F.pow(F.col("ua") - F.col("ub"), F.lit(2.0)))
    total = n.groupBy(*by).agg(F.sum("n").alias("_t"))
    s = pairs.join(o, [*by, "la", "lb"], "left").groupBy(*by).agg(F.sum(F.coalesce("o", F.lit(0.0)) * F.col("_d")).alias("_o"), F.sum(F.col("na") * F.col("nb") * F.col("_d")).alias("_e"))
    return s.join(total, by).select(*by, (1 - F.try_divide(F.col("_o") * (F.col("_t") - 1), F.col("_e"))).alias("alpha"))


def dispute_kinds(labels: DataFrame) -> DataFrame:
    """``item, kind``: the first that fits of unanimous, lone dissent, even split and divided."""
    per = labels.groupBy("item", "label").agg(F.count(F.lit(1)).alias("c"))
    s = per.groupBy("item").agg(F.count(F.lit(1)).alias("k"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    return s.select("item", F.when(F.col("k") == 1, "unanimous").when((F.col("lo") == 1) & (F.col("hi") > 1), "lone dissent").when(F.col("lo") == F.col("hi"), "even split").otherwise("divided").alias("kind"))
