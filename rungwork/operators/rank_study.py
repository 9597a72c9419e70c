"""Labelling terms as events or episodes by three kinds of evidence, in two rounds, and how far these agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungwork.operators.agreement import ordinal_alpha
from rungwork.operators.corpus import RANK_EPISODE, RANK_EVENT, term_parts, topic_tree
from rungwork.operators.skew import number_rows
from rungwork.operators.splits import hash_order

#: A leaf that names something: an ordinal number, capitals, a year.
PROPER = r"\b(\d{2,4}(st|nd|rd|th)\b|[A-Z]{3,}\b|\b(19|20)\d{2}\b)"


def by_practice(term: Column) -> Column:
    """Rank by depth: shallow terms are headings that many events are filed under."""
    return F.when(F.size(term_parts(term)) <= 2, RANK_EPISODE).otherwise(RANK_EVENT)


def resolve(event: Column, episode: Column, term: Column) -> Column:
    """The rank that one kind of evidence alone speaks for; practice decides where both or neither do."""
    return F.when(event & ~episode, RANK_EVENT).when(episode & ~event, RANK_EPISODE).otherwise(by_practice(term))


def by_structure(terms: DataFrame, adjudicated: bool) -> DataFrame:
    """``term, cell_rank``: terms with narrower ones are episodes; once adjudicated, so are top-level terms without."""
    parents = topic_tree(terms).select(F.col("parent").alias("term")).distinct().withColumn("_p", F.lit(True))
    has = F.coalesce("_p", F.lit(False))
    has = has | (F.size(term_parts(F.col("term"))) <= 1) if adjudicated else has
    return terms.select("term").distinct().join(parents, "term", "left").select("term", resolve(~has, has, F.col("term")).alias("cell_rank"))


def by_words(terms: DataFrame, site: list[str], programme: list[str]) -> DataFrame:
    """``term, cell_rank``: whether the last part has more words for a place or occurrence, or for a programme."""
    leaf = F.element_at(term_parts(F.col("term")), -1)
    words = F.array_distinct(F.regexp_extract_all(F.lower(leaf), F.lit(r"[a-z]+"), F.lit(0)))
    count = lambda names: F.size(F.array_intersect(words, F.array(*map(F.lit, names)).cast("array<string>")))
    n_site = count(site) + F.rlike(leaf, F.lit(PROPER)).cast("int")
    n_programme = count(programme)
    return terms.select("term").distinct().select("term", resolve(n_site > n_programme, n_programme > n_site, F.col("term")).alias("cell_rank"))


def label_all(terms: DataFrame, site: list[str], programme: list[str], adjudicated: bool, usage: DataFrame | None = None) -> DataFrame:
    """``annotator, item, label`` of the three annotators. ``usage`` has ``term, cell_rank`` by the use of terms.

    Where no ranks by use are given, practice stands in for them.
    """
    third = (usage.select("term", "cell_rank") if usage is not None else terms.select("term").distinct().select("term", by_practice(F.col("term")).alias("cell_rank"))).withColumn("annotator", F.lit("usage"))
    parts = [by_structure(terms, adjudicated).withColumn("annotator", F.lit("structure")), by_words(terms, site, programme).withColumn("annotator", F.lit("words")), third]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p.select(*out.columns))
    return out.select("annotator", F.col("term").alias("item"), F.col("cell_rank").alias("label"))


def consensus(labels: DataFrame, terms: DataFrame, flips: int = 20) -> DataFrame:
    """``term, consensus, disputed, place, adversarial`` by majority; ``terms`` has ``term, n_segments``.

    Of disputed terms, ``place`` is that by falling frequency; the first ``flips`` get their minority label in
    ``adversarial``. With an even number of labels a tie gives the lower rank.
    """
    votes = labels.groupBy(F.col("item").alias("term")).agg(F.count_if(F.col("label") == RANK_EPISODE).alias("_h"), F.count(F.lit(1)).alias("_n"))
    major = F.when(2 * F.col("_h") > F.col("_n"), RANK_EPISODE).otherwise(RANK_EVENT)
    v = votes.join(terms.select("term", "n_segments"), "term").select("term", "n_segments", major.alias("consensus"), ((F.col("_h") > 0) & (F.col("_h") < F.col("_n"))).alias("disputed"))
    few = v.filter("disputed").select(F.lit(1).alias("_all"), "term", (-F.col("n_segments")).alias("_f"))
    placed = number_rows(few, ["_all"], ["_f", "term"]).select("term", (F.col("_pos") + 1).alias("place"))
    flipped = F.when(F.col("place") <= flips, RANK_EVENT + RANK_EPISODE - F.col("consensus")).otherwise(F.col("consensus"))
    return v.join(placed, "term", "left").select("term", "consensus", "disputed", "place", flipped.alias("adversarial"))


def stratified_sample(strata: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """``term, stratum``: of each stratum as many terms as its even share of ``size``, the first in hash order.

    ``strata`` has ``term, stratum``; a smaller stratum gives all it has.
    """
    names = strata.select("stratum").distinct().count()
    dealt = strata.select("stratum", "term", hash_order(seed, "term").alias("_h"))
    return number_rows(dealt, ["stratum"], ["_h", "term"]).filter(F.col("_pos") < size // max(1, names)).select("term", "stratum")


def sample_usage(mentions: DataFrame, most: int = 24, seed: int = 0) -> DataFrame:
    """``term, segment_id``: the segments that show a term's use, at most so many a term, the first in hash order."""
    dealt = mentions.select("term", "segment_id").distinct().withColumn("_h", hash_order(seed, "term", "segment_id"))
    return number_rows(dealt, ["term"], ["_h", "segment_id"]).filter(F.col("_pos") < most).select("term", "segment_id")


def alphas(labels: DataFrame, strata: DataFrame) -> DataFrame:
    """``part, alpha``: ordinal agreement over all terms, in each stratum, and of each two annotators."""
    every = ordinal_alpha(labels.withColumn("part", F.lit("overall")), ["part"])
    of = ordinal_alpha(labels.join(strata.select(F.col("term").alias("item"), F.col("stratum").alias("part")), "item"), ["part"])
    names = labels.select("annotator").distinct()
    pairs = names.join(names.withColumnRenamed("annotator", "_b"), F.col("annotator") < F.col("_b")).select(F.concat_ws(" and ", "annotator", "_b").alias("part"), F.explode(F.array("annotator", "_b")).alias("annotator"))
    two = ordinal_alpha(labels.join(F.broadcast(pairs), "annotator"), ["part"])
    return every.unionByName(of).unionByName(two)
