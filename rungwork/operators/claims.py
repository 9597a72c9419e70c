"""Numbers quoted in texts, traced to a pool of values by a range join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Decimals that are told apart; a number quoted with more is compared at so many.
MOST_PLACES = 6


def quoted(text: Column) -> Column:
    """``literal, value, places`` of the numbers of a text that :func:`rungwork.functions.text.quoted_numbers` takes."""
    plain = F.regexp_replace(F.regexp_replace(text, r"\d{1,2}:\d{2}(:\d{2})?|\d{4}-\d{2}-\d{2}|\b(1[89]|20)\d{2}\b", " "), r"(\d),(\d{3})", "$1$2")
    found = F.array_distinct(F.regexp_extract_all(plain, F.lit(r"\d+\.\d+|\d{3,}"), F.lit(0)))
    places = lambda x: F.when(F.contains(x, F.lit(".")), F.length(F.substring_index(x, ".", -1))).otherwise(0)
    return F.transform(found, lambda x: F.struct(x.alias("literal"), x.cast("double").alias("value"), F.least(places(x), F.lit(MOST_PLACES)).alias("places")))


def traced(claims: DataFrame, pool: DataFrame) -> DataFrame:
    """``claims`` with ``traced``: whether a value of the pool rounds to what is quoted, as it is or as a percentage.

    ``claims`` has ``value, places``, ``pool`` has ``value``. A value matches within half a unit of the last quoted
    decimal. The range join is an equi-join: both sides are laid on a grid of cells as wide as the tolerance, for each
    number of decimals that is quoted, and a claim looks into its own cell and both beside it; the pool's values are
    made distinct on each grid first, so a value that many rows hold is one.
    """
    columns = claims.columns
    ways = F.array(F.struct(F.col("value").alias("v"), F.col("places").alias("p")), F.struct((F.col("value") / 100).alias("v"), (F.col("places") + 2).alias("p")))
    asked = claims.select("value", "places").distinct().withColumn("_w", F.explode(ways)).select("value", "places", F.col("_w.v").alias("_v"), F.col("_w.p").alias("_p"))
    asked = asked.withColumn("_tol", 0.5 * F.pow(F.lit(10.0), -F.col("_p")))
    near = asked.withColumn("_g", F.explode(F.array(*[F.floor(F.col("_v") / F.col("_tol")) + d for d in (-1, 0, 1)])))
    grids = asked.select("_p").distinct()
    held = pool.filter(F.col("value").isNotNull()).select(F.col("value").alias("_x")).distinct().crossJoin(F.broadcast(grids))
    held = held.withColumn("_g", F.floor(F.col("_x") / (0.5 * F.pow(F.lit(10.0), -F.col("_p")))))
    hit = near.join(held, ["_p", "_g"]).filter(F.abs(F.col("_x") - F.col("_v")) < F.col("_tol")).select("value", "places").distinct().withColumn("_hit", F.lit(True))
    return claims.join(hit, ["value", "places"], "left").select(*columns, F.coalesce("_hit", F.lit(False)).alias("traced"))
