"""Near-duplicate texts on word shingles: MinHash bands as an equi-join, verified on the shingles themselves."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from rungwork.operators.skew import salted_join
from rungwork.session import materialize, spread

SHINGLE, LEAST_WORDS, THRESHOLD = 5, 8, 0.8
#: Bands of rows: a pair of similarity 0.8 meets in a band with probability above 0.9999.
BANDS, ROWS = 22, 4


_WORD = re.compile(r"[^\W_]+")


def shingle_sets(texts: list[str | None], width: int = SHINGLE) -> list[np.ndarray | None]:
    """Sorted distinct hashes of ``width`` words in a row of each text; ``None`` for one of fewer than eight words."""
    lists = [_WORD.findall(t.lower()) if t else [] for t in texts]
    lists = [w if len(w) >= LEAST_WORDS else [] for w in lists]
    sizes = np.array([len(w) for w in lists], dtype=np.int64)
    flat = [w for ws in lists for w in ws]
    if not flat:
        return [None] * len(texts)
    codes, unique = pd.factorize(np.array(flat, dtype=object))
    h = pd.util.hash_array(np.asarray(unique, dtype=object), categorize=False)[codes]
    h = np.concatenate([h, np.zeros(width, dtype=np.uint64)])
    acc = np.zeros(len(flat), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            acc = (acc ^ h[j : j + len(flat)]) * np.uint64(0x9E3779B97F4A7C15)
            acc ^= acc >> np.uint64(32)
    doc = np.repeat(np.arange(len(lists)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))
    doc, acc = doc[left >= width], acc[left >= width].view(np.int64)
    order = np.lexsort((acc, doc))
    doc, acc = doc[order], acc[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (acc[1:] != acc[:-1])
    doc, acc = doc[new], acc[new]
    parts = np.split(acc, np.searchsorted(doc, np.arange(1, len(lists))))
    return [x if len(x) else None for x in parts]


def text_classes(df: DataFrame, key: str, text: str, owners: str | None = None) -> DataFrame:
    """``key, class_id, sh`` of texts that have shingles: texts with the same shingles are one class, named by a hash.

    A key delivered again with the same shingles counts once. ``owners`` names a column of arrays to keep beside it.
    """
    more = [owners] if owners else []
    rows = spread(df.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, *more, F.col(text).alias("_text")))
    kept_ = [f for f in rows.schema.fields if f.name != "_text"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            sets = shingle_sets(df["_text"].tolist())
            at = [i for i, x in enumerate(sets) if x is not None]
            out = {c: pd.Series([df[c].iloc[i] for i in at], dtype=object) for c in (key, *more)}
            yield pd.DataFrame(out | {"sh": pd.Series([sets[i] for i in at], dtype=object), "class_id": pd.Series([hashlib.md5(sets[i].tobytes()).hexdigest() for i in at], dtype=object)})

    schema = StructType([*kept_, StructField("sh", ArrayType(LongType())), StructField("class_id", StringType())])
    return rows.mapInPandas(run, schema).dropDuplicates([key, "class_id"])


def _band_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A key for each band of ``ROWS`` MinHash values of the shingles' hashes."""
    rng = np.random.default_rng(5)
    a, c = (rng.integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
    for df in batches:
        if not len(df):
            continue
        flat = np.concatenate(df["sh"].to_numpy()).astype(np.int64).view(np.uint64)
        starts = np.concatenate([[0], np.cumsum([len(v) for v in df["sh"]])[:-1]])
        keys = np.empty((len(df), BANDS), dtype=np.int64)
        with np.errstate(over="ignore"):
            for band in range(BANDS):
                acc = np.full(len(df), band + 1, dtype=np.uint64)
                for i in range(band * ROWS, (band + 1) * ROWS):
                    h = (flat ^ c[i]) * a[i]
                    acc = (acc ^ np.minimum.reduceat(h ^ (h >> np.uint64(31)), starts)) * np.uint64(0x9E3779B97F4A7C15)
                keys[:, band] = (acc ^ (acc >> np.uint64(29))).view(np.int64)
        yield pd.DataFrame({"class_id": df["class_id"], "n": [len(v) for v in df["sh"]], "keys": list(keys)})


def similar_classes(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``class_a, class_b, jaccard``: different classes whose shingles' similarity reaches the threshold, ``a < b``."""
    one = materialize(classes.groupBy("class_id").agg(F.first("sh").alias("sh")))
    keyed = materialize(spread(one).mapInPandas(_band_keys, "class_id string, n int, keys array<long>").select("class_id", "n", F.explode("keys").alias("key")))
    left = keyed.select("key", F.col("class_id").alias("class_a"), F.col("n").alias("_na"))
    right = keyed.select("key", F.col("class_id").alias("class_b"), F.col("n").alias("_nb"))
    fit = (F.col("class_a") < F.col("class_b")) & (F.least("_na", "_nb") >= threshold * F.greatest("_na", "_nb"))
    pairs = salted_join(left, right, "key").filter(fit).select("class_a", "class_b").distinct()
    met = pairs.join(one.select(F.col("class_id").alias("class_a"), F.col("sh").alias("_a")), "class_a").join(one.select(F.col("class_id").alias("class_b"), F.col("sh").alias("_b")), "class_b")
    both = F.size(F.array_intersect("_a", "_b"))
    sim = both / (F.size("_a") + F.size("_b") - both)
    return met.select("class_a", "class_b", sim.alias("jaccard")).filter(F.col("jaccard") >= threshold)


def near_duplicates(df: DataFrame, key: str, text: str, threshold: float = THRESHOLD) -> DataFrame:
    """``key, class_id, n_copies, n_links``: each text with its class and the class's links to other classes.

    Texts of fewer than eight words and NULL texts have no row; a key delivered again with the same text counts once.
    """
    classes = materialize(text_classes(df, key, text))
    links = similar_classes(classes, threshold)
    ends = links.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    sizes = classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_copies"))
    return classes.select(key, "class_id").join(sizes.join(ends, "class_id", "left"), "class_id").select(key, "class_id", "n_copies", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def duplicate_pairs(df: DataFrame, key: str, text: str, owners: str, threshold: float = THRESHOLD) -> DataFrame:
    """``key_a, key_b, jaccard``: texts of a similarity of ``threshold`` or more that share no owner; ``key_a < key_b``.

    An owner who repeats themselves is no leak, so pairs with a common element of ``owners`` (an array, NULL counts as
    empty) are left out. Copies of one text stand for each other: of each two classes, and within each class, texts with
    the same set of owners are one row with their smallest key, so a group of copies by one owner makes no pairs.
    """
    classes = materialize(text_classes(df, key, text, owners).withColumn("_own", F.sort_array(F.array_distinct(F.coalesce(owners, F.array().cast("array<string>"))))))
    links = similar_classes(classes.select("class_id", "sh"), threshold)
    # a text without owners is nobody's: it stays a text of its own
    who = F.when(F.size("_own") > 0, F.to_json("_own")).otherwise(F.col(key).cast("string"))
    heads = materialize(classes.groupBy("class_id", who.alias("_who")).agg(F.min(F.struct(F.col(key), F.col("_own"))).alias("_h")).select("class_id", F.col(f"_h.{key}").alias("_key"), "_h._own"))
    same = heads.groupBy("class_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col("class_id").alias("class_a"), F.col("class_id").alias("class_b"), F.lit(1.0).alias("jaccard"))
    a, b = (heads.select(F.col("class_id").alias(f"class_{x}"), F.col("_key").alias(f"key_{x}"), F.col("_own").alias(f"_own_{x}")) for x in "ab")
    met = salted_join(salted_join(links.unionByName(same), a, "class_a"), b, "class_b")
    met = met.filter(((F.col("class_a") != F.col("class_b")) | (F.col("key_a") < F.col("key_b"))) & ~F.arrays_overlap("_own_a", "_own_b"))
    return met.select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b"), "jaccard")
