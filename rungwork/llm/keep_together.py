"""Problem 3: splits that keep related records together, by connected components over shared entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwork.functions.keys import distinct_keys, squeeze
from rungwork.operators.components import connected_components
from rungwork.operators.skew import salted_join
from rungwork.session import materialize, table

SHARES = {"train": 0.8, "val": 0.1, "test": 0.1}
#: Node names begin with one of these, so the smallest node of a group is its smallest narrator, else interview.
NARRATOR, INTERVIEW, SEGMENT = "0", "1", "2"


def entities(segments: DataFrame, interviews: DataFrame) -> DataFrame:
    """``segment_id, nodes``: the entities of each delivered segment row.

    These are its narrators, or those of its interview where it has none, and its interview. A segment without either
    is an entity of its own. A NULL segment_id is no segment. NULL and blank narrators are no keys.
    """
    s = segments.filter(F.col("segment_id").isNotNull()).select("segment_id", F.nullif(squeeze(F.col("interview_id")), F.lit("")).alias("interview_id"), distinct_keys(F.col("narrators")).alias("keys"))
    i = interviews.select(F.nullif(squeeze(F.col("interview_id")), F.lit("")).alias("interview_id"), F.explode(distinct_keys(F.col("narrators"))).alias("_k")).groupBy("interview_id").agg(F.array_sort(F.collect_set("_k")).alias("_keys"))
    own = s.filter(F.size("keys") > 0)
    lent = s.filter(F.size("keys") == 0).distinct().drop("keys").join(i, "interview_id", "left").select("segment_id", "interview_id", F.coalesce("_keys", F.array().cast("array<string>")).alias("keys"))
    named = F.transform("keys", lambda k: F.concat(F.lit(NARRATOR), k))
    nodes = F.when(F.col("interview_id").isNull(), named).otherwise(F.concat(named, F.array(F.concat(F.lit(INTERVIEW), F.col("interview_id")))))
    all_ = own.unionByName(lent).withColumn("nodes", nodes)
    return all_.select("segment_id", F.when(F.size("nodes") > 0, F.col("nodes")).otherwise(F.array(F.concat(F.lit(SEGMENT), F.col("segment_id")))).alias("nodes"))


def groups(records: DataFrame) -> DataFrame:
    """``segment_id, group_key`` of records with ``nodes``; a record belongs to the component of any of its nodes."""
    rows = materialize(records.withColumn("_m", F.array_min("nodes")))
    links = rows.select(F.explode("nodes").alias("a"), F.col("_m").alias("b")).distinct()
    found = connected_components(links).select(F.col("node").alias("_m"), "component")
    return salted_join(found, rows.select("segment_id", "_m").distinct(), "_m").groupBy("segment_id").agg(F.substring(F.min("component"), 2, 1 << 30).alias("group_key"))


def bucket(key: Column, shares: dict[str, float] = SHARES, seed: int = 0) -> Column:
    """The split whose share of the hash range holds ``key``; the hash is the first 32 bits of an MD5, as any engine has."""
    place = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key)), 1, 8), 16, 10).cast("long") / float(1 << 32)
    out, upto, names = None, 0.0, list(shares)
    for name in names[:-1]:
        upto += shares[name]
        out = F.when(place < upto, name) if out is None else out.when(place < upto, name)
    return F.lit(names[-1]) if out is None else out.otherwise(names[-1])


def assign(found: DataFrame, shares: dict[str, float] = SHARES, seed: int = 0) -> DataFrame:
    """``segment_id, group_key, bucket`` of ``segment_id, group_key``: groups hashed into ranges of the given shares.

    A group that holds more of the rows than the smallest share would burst that split wherever it is hashed to, so it
    goes to the largest. There are fewer such groups than the inverse of the smallest share.
    """
    found = materialize(found)
    sizes = found.groupBy("group_key").agg(F.count(F.lit(1)).alias("_n"))
    total = found.count()
    giants = [r["group_key"] for r in sizes.filter(F.col("_n") > min(shares.values()) * total).select("group_key").collect()]
    largest = max(shares, key=shares.get)
    hashed = bucket(F.col("group_key"), shares, seed)
    return found.withColumn("bucket", F.when(F.col("group_key").isin(giants), largest).otherwise(hashed) if giants else hashed)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per segment with the group that may not be divided."""
    return groups(entities(table(spark, sf_dir, "segments"), table(spark, sf_dir, "interviews")))


def p3_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split itself: groups hashed into proportional ranges."""
    return assign(p3_found(spark, sf_dir))


def p3_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split: its share of the segments as wanted and as reached, its segments, groups and largest group."""
    split = p3_split(spark, sf_dir)
    per = split.groupBy("bucket", "group_key").agg(F.count(F.lit(1)).alias("_n")).groupBy("bucket").agg(F.sum("_n").alias("n_segments"), F.count(F.lit(1)).alias("n_groups"), F.max("_n").alias("largest_group"))
    want = spark.createDataFrame(list(SHARES.items()), "bucket string, target_share double")
    total = per.agg(F.sum("n_segments").alias("_t"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    met = F.broadcast(want).join(per, "bucket", "left").join(F.broadcast(total))
    return met.select("bucket", "target_share", F.round(F.coalesce(F.try_divide("n_segments", F.col("_t")), F.lit(0.0)), 6).alias("share"), zero("n_segments").alias("n_segments"), zero("n_groups").alias("n_groups"), zero("largest_group").alias("largest_group"))


_SQ = r"trim(regexp_replace({}, '[\s\x{{00A0}}]+', ' ', 'g'))"
_KEYS = "list_distinct(list_filter(list_transform(coalesce(narrators, []), lambda n: nullif(lower(" + _SQ.format("n") + "), '')), lambda n: n IS NOT NULL))"

QUERIES = {"p3_found": p3_found, "p3_split": p3_split, "p3_shares": p3_shares}

_GROUPS = f"""
s AS (SELECT DISTINCT segment_id, nullif({_SQ.format("interview_id")}, '') AS i, list_sort({_KEYS}) AS k FROM segments WHERE segment_id IS NOT NULL),
iv AS (SELECT nullif({_SQ.format("interview_id")}, '') AS i, list_sort(list_distinct(flatten(list({_KEYS})))) AS k FROM interviews GROUP BY 1),
e AS (SELECT segment_id, s.i, CASE WHEN len(s.k) > 0 THEN s.k ELSE coalesce(iv.k, []) END AS k FROM s LEFT JOIN iv ON s.i = iv.i),
n AS (SELECT DISTINCT segment_id, unnest(list_concat(list_transform(k, lambda x: '0' || x), CASE WHEN i IS NULL THEN (CASE WHEN len(k) = 0 THEN ['2' || segment_id] ELSE [] END) ELSE ['1' || i] END)) AS node FROM e),
l AS (SELECT DISTINCT a.node AS a, b.node AS b FROM n a JOIN n b USING (segment_id)),
reach(node, r) AS (SELECT a, b FROM l UNION SELECT reach.node, l.b FROM reach JOIN l ON reach.r = l.a),
found AS (SELECT segment_id, substr(min(r), 2) AS group_key FROM n JOIN reach USING (node) GROUP BY 1)"""
_PLACE = "(('0x' || substr(md5('0|' || group_key), 1, 8))::BIGINT / 4294967296.0)"
_SPLIT = f"""{_GROUPS},
split AS (SELECT segment_id, group_key, CASE WHEN count(*) OVER (PARTITION BY group_key) > 0.1 * count(*) OVER () THEN 'train' WHEN {_PLACE} < 0.8 THEN 'train' WHEN {_PLACE} < 0.9 THEN 'val' ELSE 'test' END AS bucket FROM found)"""

ORACLE = {
    "p3_found": f"WITH RECURSIVE {_GROUPS} SELECT * FROM found",
    "p3_split": f"WITH RECURSIVE {_SPLIT} SELECT * FROM split",
    "p3_shares": f"""WITH RECURSIVE {_SPLIT}, w(bucket, target_share) AS (VALUES ('train', 0.8::DOUBLE), ('val', 0.1::DOUBLE), ('test', 0.1::DOUBLE)),
    g AS (SELECT bucket, group_key, count(*) AS c FROM split GROUP BY 1, 2), p AS (SELECT bucket, sum(c)::BIGINT AS n_segments, count(*) AS n_groups, max(c) AS largest_group FROM g GROUP BY 1)
    SELECT bucket, target_share, round(coalesce(n_segments / (SELECT count(*) FROM split)::DOUBLE, 0), 6) AS share, coalesce(n_segments, 0) AS n_segments, coalesce(n_groups, 0) AS n_groups, coalesce(largest_group, 0) AS largest_group FROM w LEFT JOIN p USING (bucket)""",
}
