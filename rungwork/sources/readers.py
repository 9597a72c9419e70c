"""Sources and sinks: JSON lines with torn rows, split files, rank-map files, release tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TERM = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("id", T.StringType())]))
SEGMENT = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("segment_id", "interview_id", "collection_id", "title", "description", "location", "extent")]
    + [T.StructField("narrators", T.ArrayType(T.StringType())), T.StructField("interviewers", T.ArrayType(T.StringType())), T.StructField("topics", TERM), T.StructField("geography", TERM)]
)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines of a fixed schema; torn and invalid lines are dropped, a missing file is empty."""
    local = path.removeprefix("file://")
    if "://" not in local and not os.path.exists(local):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """``fold, unit`` of a JSON split file: its list-valued keys."""
    text = spark.read.text(path, wholetext=True)
    entries = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("fold", "v"))
    return entries.filter(F.trim("v").startswith("[")).select("fold", F.explode(F.from_json("v", "array<string>")).alias("unit"))


def read_rank_maps(spark: SparkSession, path: str) -> DataFrame:
    """``map_name, term, cell_rank`` of a JSON file that maps names to maps of terms."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,map<string,int>>")).alias("map_name", "m")).select("map_name", F.explode("m").alias("term", "cell_rank"))


def numbers_in_json(df: DataFrame, column: str) -> DataFrame:
    """``path, value``: every number in JSON documents, however deeply nested; booleans are no numbers.

    Documents are opened level by level until none has anything within; invalid JSON holds nothing.
    """
    spark, out = df.sparkSession, None
    level = df.select(F.lit("").alias("path"), F.try_parse_json(column).alias("_v")).filter(F.col("_v").isNotNull())
    kind = F.schema_of_variant("_v")
    while True:
        leaves = level.filter(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)")).select("path", F.try_variant_get("_v", "$", "double").alias("value"))
        out = leaves if out is None else out.unionByName(leaves)
        inner = level.filter(kind.rlike("^(OBJECT|ARRAY)"))
        opened = inner.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()).toDF("_pos", "_key", "_in"))
        name = F.coalesce("_key", F.col("_pos").cast("string"))
        level = opened.select(F.when(F.col("path") == "", name).otherwise(F.concat("path", F.lit("/"), name)).alias("path"), F.col("_in").alias("_v"))
        if level.isEmpty():
            return out


def json_at(df: DataFrame, column: str, path: str, out: str = "value") -> DataFrame:
    """Add ``out``, what stands at ``a/b/0/c`` in each JSON document as a string; NULL where nothing does.

    Parts are parted by ``/`` alone, as keys may hold dots; a part of digits is a place in an array, or a key.
    """
    quoted = [p.replace("\\", "\\\\").replace("'", "\\'") for p in path.split("/")]
    v = F.try_parse_json(column)
    ways = [""]
    for part in quoted:
        ways = [w + form for w in ways for form in ([f"[{int(part)}]", f"['{part}']"] if part.isdigit() else [f"['{part}']"])]
    return df.withColumn(out, F.coalesce(*[F.try_variant_get(v, "$" + w, "string") for w in ways]))


def write_release(cells: DataFrame, members: DataFrame, supports: DataFrame, segments: DataFrame, path: str) -> None:
    """Release tables: cells as JSON lines, members and supports as Parquet rows, stand-off segments as CSV."""
    cells.write.mode("overwrite").partitionBy("granularity").json(f"{path}/cells")
    members.write.mode("overwrite").partitionBy("granularity").parquet(f"{path}/members")
    supports.write.mode("overwrite").partitionBy("granularity").parquet(f"{path}/supports")
    segments.select("segment_id", "interview_id", F.array_join("narrators", "|").alias("narrators"), F.array_join("terms", "|").alias("terms")).write.mode("overwrite").option("header", True).csv(f"{path}/segments")


def reproduce_release(spark: SparkSession, path: str) -> DataFrame:
    """``measure, value`` counted from the release tables alone."""
    cells = spark.read.json(f"{path}/cells")
    s = spark.read.option("header", True).csv(f"{path}/segments")
    by_rank = cells.groupBy(F.concat_ws(" ", F.col("granularity"), F.lit("rank"), F.col("cell_rank")).alias("measure")).agg(F.count(F.lit(1)).alias("value"))
    n = s.agg(F.count(F.lit(1)).alias("value")).select(F.lit("segments").alias("measure"), "value")
    who = s.select(F.explode(F.split("narrators", r"\|")).alias("n")).filter("n <> ''").agg(F.count_distinct("n").alias("value")).select(F.lit("narrators").alias("measure"), "value")
    return by_rank.unionByName(n).unionByName(who)
