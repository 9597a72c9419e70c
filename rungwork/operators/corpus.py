"""The corpus: cleaned segments, narrator keys, topic terms, rank maps, corpus statistics and boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungwork.functions.keys import canonical_key, canonical_term, distinct_keys, squeeze
from rungwork.operators.skew import number_rows

UNSPECIFIED = "UNSPECIFIED"
RANK_EVENT, RANK_EPISODE = 2, 3


def narrator_key(oh_id: Column, name: Column) -> Column:
    """``oh:<id>`` of an id that is not missing (NULL, blank or 0), else ``nm:<normal name>``, else NULL."""
    i, n = F.trim(oh_id), F.nullif(normal_name(name), F.lit(""))
    return F.when(i.isNotNull() & ~i.isin("", "0"), F.concat(F.lit("oh:"), i)).otherwise(F.concat(F.lit("nm:"), n))


def normal_name(name: Column) -> Column:
    """A name without accents, in lower case, of letters and single blanks."""
    accents, plain = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
    return F.trim(F.regexp_replace(F.regexp_replace(F.translate(F.lower(name), accents, plain), "[^a-z ]", " "), " +", " "))


def role_keys(creators: Column, role: str) -> Column:
    """Sorted distinct keys of the creators that hold ``role``, whatever its case."""
    held = F.filter(creators, lambda c: F.lower(F.trim(c["role"])) == role)
    keys = F.filter(F.transform(held, lambda c: narrator_key(c["oh_id"], c["namepart"])), lambda k: k.isNotNull())
    return F.array_sort(F.array_distinct(F.coalesce(keys, F.array().cast("array<string>"))))


def clean_segments(segments: DataFrame, interviews: DataFrame) -> DataFrame:
    """One row per segment: ``segment_id, interview_id, collection_id, narrators, interviewers, terms, place, title, description``.

    A segment delivered again counts once. Keys and terms are canonical, distinct and sorted. A segment without
    narrators takes those of its interview. The place is its first geography term, ``UNSPECIFIED`` without one.
    """
    places = F.filter(F.transform("geography", lambda g: F.nullif(squeeze(g["term"]), F.lit(""))), lambda p: p.isNotNull())
    terms = F.filter(F.transform("topics", lambda t: canonical_term(t["term"])), lambda t: t.isNotNull())
    one = segments.filter(F.col("segment_id").isNotNull()).select(
        "segment_id",
        "interview_id",
        "collection_id",
        distinct_keys(F.col("narrators")).alias("own"),
        distinct_keys(F.col("interviewers")).alias("interviewers"),
        F.array_sort(F.array_distinct(F.coalesce(terms, F.array().cast("array<string>")))).alias("terms"),
        F.coalesce(F.get(places, F.lit(0)), F.lit(UNSPECIFIED)).alias("place"),
        "title",
        "description",
    )
    one = one.dropDuplicates(["segment_id"])
    lent = interviews.filter(F.col("interview_id").isNotNull()).groupBy("interview_id").agg(F.max(distinct_keys(F.col("narrators"))).alias("_lent"))
    joined = one.join(lent, "interview_id", "left")
    narrators = F.when(F.size("own") > 0, F.col("own")).otherwise(F.coalesce("_lent", F.array().cast("array<string>")))
    return joined.select("segment_id", "interview_id", "collection_id", narrators.alias("narrators"), "interviewers", "terms", "place", "title", "description")


def mentions(segments: DataFrame) -> DataFrame:
    """``segment_id, term, place`` of cleaned segments, a row per term."""
    return segments.select("segment_id", "place", F.explode("terms").alias("term"))


def voices(segments: DataFrame, include_interviewers: bool = False) -> DataFrame:
    """``segment_id, narrator``: who speaks in a segment, with the interviewers if asked."""
    who = F.array_union("narrators", "interviewers") if include_interviewers else F.col("narrators")
    return segments.select("segment_id", F.explode(who).alias("narrator"))


def term_parts(term: Column) -> Column:
    """Path of a canonical term."""
    return F.split(term, " -- ")


def referent(term: Column, depth: int = 2) -> Column:
    """First parts of a term's path."""
    return F.array_join(F.slice(term_parts(term), 1, depth), " -- ")


def topic_terms(segments: DataFrame) -> DataFrame:
    """``term, depth, parent, referent, n_segments`` of all terms in use; the parent of a single part is NULL."""
    counts = mentions(segments).groupBy("term").agg(F.count_distinct("segment_id").alias("n_segments"))
    path = term_parts(F.col("term"))
    parent = F.when(F.size(path) > 1, F.array_join(F.slice(path, F.lit(1), F.size(path) - 1), " -- "))
    return counts.select("term", F.size(path).alias("depth"), parent.alias("parent"), referent(F.col("term")).alias("referent"), "n_segments")


def topic_tree(terms: DataFrame) -> DataFrame:
    """``parent, child``: edges between consecutive prefixes of all terms."""
    path = term_parts(F.col("term"))
    at = F.when(F.size(path) > 1, F.sequence(F.lit(1), F.size(path) - 1))
    cut = terms.select(path.alias("p"), F.explode(at).alias("i"))
    return cut.select(F.array_join(F.slice("p", F.lit(1), F.col("i")), " -- ").alias("parent"), F.array_join(F.slice("p", F.lit(1), F.col("i") + 1), " -- ").alias("child")).distinct()


def latest_labels(labels: DataFrame) -> DataFrame:
    """``annotator, label_round, term, label_rank``: the last valid label of each annotator, round and term."""
    clean = labels.select(F.translate(canonical_key(F.col("annotator")), "_", "-").alias("annotator"), "label_round", canonical_term(F.col("term")).alias("term"), "label_rank", "labelled_at")
    clean = clean.filter(F.col("annotator").isNotNull() & F.col("term").isNotNull() & F.col("label_rank").isin(2, 3))
    return clean.groupBy("annotator", "label_round", "term").agg(F.max(F.struct("labelled_at", "label_rank"))["label_rank"].alias("label_rank"))


def rank_maps(terms: DataFrame, labels: DataFrame) -> DataFrame:
    """``map_name, term, cell_rank``: majority of round 2 (R-A), archive practice by depth (R-B), structure (R-C).

    A term without labels, or with as many for either rank, takes its rank in R-A from its depth. By practice a term of
    two parts or fewer is an episode; by structure one that has narrower terms is.
    """
    depth = F.when(F.size(term_parts(F.col("term"))) <= 2, RANK_EPISODE).otherwise(RANK_EVENT)
    votes = latest_labels(labels).filter("label_round = 2").groupBy("term").agg(F.count_if(F.col("label_rank") == 3).alias("_h"), F.count_if(F.col("label_rank") == 2).alias("_l"))
    base = terms.select("term").distinct()
    a = base.join(votes, "term", "left").select(F.lit("R-A").alias("map_name"), "term", F.when(F.col("_h") > F.col("_l"), RANK_EPISODE).when(F.col("_l") > F.col("_h"), RANK_EVENT).otherwise(depth).alias("cell_rank"))
    b = base.select(F.lit("R-B").alias("map_name"), "term", depth.alias("cell_rank"))
    parents = topic_tree(base).select(F.col("parent").alias("term")).distinct().withColumn("_p", F.lit(True))
    c = base.join(parents, "term", "left").select(F.lit("R-C").alias("map_name"), "term", F.when(F.col("_p"), RANK_EPISODE).otherwise(RANK_EVENT).alias("cell_rank"))
    return a.unionByName(b).unionByName(c)


def frequency_strata(terms: DataFrame) -> DataFrame:
    """``term, n_segments, stratum``: thirds of the terms by falling frequency, and those of one or two segments."""
    ordered = terms.select(F.lit(1).alias("_all"), "term", "n_segments", (-F.col("n_segments")).alias("_f"))
    placed = number_rows(ordered, ["_all"], ["_f", "term"]).withColumnRenamed("_pos", "_i").crossJoin(F.broadcast(terms.agg(F.count(F.lit(1)).alias("_n"))))
    third = F.floor(F.col("_n") / 3)
    return placed.select("term", "n_segments", F.when(F.col("n_segments") <= 2, "rare_1_2").when(F.col("_i") < third, "head").when(F.col("_i") < 2 * third, "middle").otherwise("tail").alias("stratum"))


def corpus_stats(interviews: DataFrame, segments: DataFrame) -> DataFrame:
    """One row of counts over interviews and cleaned segments."""
    i = interviews.dropDuplicates(["interview_id"]).agg(F.count(F.lit(1)).alias("n_interviews"), F.count_if(F.col("transcript_chars") > 0).alias("n_transcripts"), F.expr("percentile(transcript_chars, 0.5)").alias("chars_median"))
    s = segments.agg(F.count(F.lit(1)).alias("n_segments"), F.count_if(F.size("terms") > 0).alias("n_with_topic"), F.count_if(F.col("place") != UNSPECIFIED).alias("n_with_place"))
    v = voices(segments).agg(F.count_distinct("narrator").alias("n_narrators"))
    per = segments.filter("interview_id is not null").groupBy("interview_id").agg(F.count(F.lit(1)).alias("_c")).agg(F.expr("percentile(_c, 0.5)").alias("segments_median"), F.min("_c").alias("segments_min"), F.max("_c").alias("segments_max"))
    return i.crossJoin(s).crossJoin(v).crossJoin(per)


def split_sentences(text: Column) -> Column:
    """Sentences of a text: parted after ``.``, ``!`` or ``?`` and white space."""
    return F.filter(F.transform(F.split(F.regexp_replace(text, r"([.!?])\s+", "$1" + chr(1)), chr(1)), squeeze), lambda s: s != "")


def find_boilerplate(texts: DataFrame, column: str, min_share: float = 0.005, min_words: int = 6) -> DataFrame:
    """``sentence, n``: sentences of at least ``min_words`` words whose occurrences reach a share of the texts."""
    n = texts.agg(F.count(column).alias("_n"))
    each = texts.select(F.explode(split_sentences(F.col(column))).alias("sentence")).filter(F.size(F.split("sentence", " ")) >= min_words)
    return each.groupBy("sentence").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(n), F.col("n") >= min_share * F.col("_n")).select("sentence", "n")
