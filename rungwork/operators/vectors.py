"""Vectors: means by group, normal form, dot products, message passing over typed edges and a logistic probe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """An array scaled to length 1; a zero array stays."""
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def mean_vectors(df: DataFrame, by: list[str], vector: str) -> DataFrame:
    """``by, vec, n``: mean of the arrays of each group, by place and value, so partial sums are made before shuffling."""
    parts = df.select(*by, F.posexplode(vector).alias("_i", "_x")).groupBy(*by, "_i").agg(F.avg("_x").alias("_m"), F.count(F.lit(1)).alias("_n"))
    return parts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("vec"), F.max("_n").alias("n"))


def rank_features(cells: DataFrame, vec: str, rank: str) -> DataFrame:
    """Add ``feature``: the vector with the four-place one-hot of its rank."""
    hot = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (i == F.col(rank)).cast("double"))
    return cells.withColumn("feature", F.concat(F.transform(F.col(vec), lambda x: x.cast("double")), hot))


def row_weights(edges: DataFrame) -> DataFrame:
    """Edges ``src, dst`` with ``w_fwd`` and ``w_bwd``: one over the degree of either end."""
    out = edges.groupBy("src").agg((1 / F.count(F.lit(1))).alias("w_fwd"))
    back = edges.groupBy("dst").agg((1 / F.count(F.lit(1))).alias("w_bwd"))
    return edges.join(out, "src").join(back, "dst")


def propagate(features: DataFrame, edges: DataFrame, layers: int = 1, keep: float = 0.5) -> DataFrame:
    """``node, vec`` after ``layers`` rounds of mixing each node's vector with the mean over its in-edges.

    Parameter-free message passing; two hops over a lower rank are two rounds, never a product of matrices. A node
    without in-edges keeps its vector.
    """
    h = features.select("node", "vec")
    for _ in range(layers):
        sent = edges.select("src", "dst").join(h, F.col("src") == F.col("node")).select("dst", "vec")
        got = mean_vectors(sent, ["dst"], "vec").select(F.col("dst").alias("node"), F.col("vec").alias("_m"))
        mixed = F.zip_with("vec", "_m", lambda x, y: keep * x + (1 - keep) * y)
        h = h.join(got, "node", "left").select("node", F.when(F.col("_m").isNull(), F.transform("vec", lambda x: x.cast("double"))).otherwise(mixed).alias("vec"))
    return h


def probe_accuracy(df: DataFrame, label: str, vector: str, key: str, least: int = 4, iterations: int = 20) -> DataFrame:
    """One row ``accuracy, chance, n_test``: a multinomial logistic probe of classes of at least ``least`` rows.

    Three in ten rows of each class, by hash, are held out. NULL vectors and labels are left out; with fewer than two
    classes, or nothing held out, accuracy and chance are NULL.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, StringIndexer
    from pyspark.ml.functions import array_to_vector

    df = df.filter(F.col(label).isNotNull() & F.col(vector).isNotNull())
    kept = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least).select(label)
    rows = df.join(kept, label, "left_semi").select(F.col(label).cast("string").alias("name"), array_to_vector(F.col(vector).cast("array<double>")).alias("raw"), (F.pmod(F.xxhash64(key), F.lit(10)) < 3).alias("held"))
    seen = rows.groupBy("held").agg(F.count_distinct("name").alias("k")).collect()
    if {r["held"]: r["k"] for r in seen}.get(False, 0) < 2 or len(seen) < 2:
        return df.sparkSession.createDataFrame([(None, 0, None)], "accuracy double, n_test long, chance double")
    indexed = StringIndexer(inputCol="name", outputCol="label").fit(rows).transform(rows)
    train, test = indexed.filter("not held"), indexed.filter("held")
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(train)
    model = LogisticRegression(maxIter=iterations, regParam=1e-3, family="multinomial").fit(scaler.transform(train))
    got = model.transform(scaler.transform(test))
    chance = test.groupBy("label").agg(F.count(F.lit(1)).alias("_n")).agg((F.max("_n") / F.sum("_n")).alias("chance"))
    return got.agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n_test")).crossJoin(chance)
