"""Problem 1: consensus from several annotators' labels by spectral reliability."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rungwork.functions.keys import canonical_key, canonical_term
from rungwork.operators.skew import salted_join
from rungwork.session import materialize, table

LOW, HIGH = 2, 3
#: Pairs of raters count as if so many more common items without agreement had been seen.
SHRINK = 4.0
#: Most rounds of the iteration, rounds between two looks at the change, and the change at which it ends.
ROUNDS, CUT_EVERY, SETTLED = 400, 5, 1e-5


def clean_labels(labels: DataFrame) -> DataFrame:
    """``rater, annotator, label_round, term, x``: the last valid label of each annotator, round and term, as 0 or 1.

    Spellings of annotators (case, blanks, ``_`` for ``-``) and terms are made one. Ranks other than 2 and 3 and rows
    without a term are no labels. A NULL annotator or round is a rater like any other. Of several labels the latest
    counts, of equally late ones the higher rank; extra columns are ignored.
    """
    named = labels.select(
        F.coalesce(F.translate(canonical_key("annotator"), "_", "-"), F.lit("")).alias("annotator"),
        F.coalesce(F.col("label_round"), F.lit(0)).alias("label_round"),
        canonical_term(F.col("term")).alias("term"),
        "label_rank",
        "labelled_at",
    ).filter(F.col("term").isNotNull() & F.col("label_rank").isin(LOW, HIGH))
    last = named.groupBy("annotator", "label_round", "term").agg(F.max(F.struct("labelled_at", "label_rank")).alias("_m"))
    return last.select(F.concat_ws("|", "annotator", "label_round").alias("rater"), "annotator", "label_round", "term", (F.col("_m.label_rank") - LOW).cast("double").alias("x"))


def agreement_matrix(labels: DataFrame) -> DataFrame:
    """``a, b, w``: chance-centred agreement of every two raters with common items, corrected for their number.

    A label is centred on its rater's own rate and scaled by that rate's spread, so a rater who always says the same
    agrees with nobody beyond chance. ``w`` is the mean product over common items, shrunk where these are few.
    """
    rates = labels.groupBy("rater").agg(F.avg("x").alias("_p"))
    z = labels.join(rates, "rater").select("rater", "term", F.coalesce(F.try_divide(F.col("x") - F.col("_p"), F.sqrt(F.col("_p") * (1 - F.col("_p")))), F.lit(0.0)).alias("z"))
    z = materialize(z)
    other = z.select("term", F.col("rater").alias("b"), F.col("z").alias("zb"))
    # a term that many raters label is spread over several tasks
    pairs = salted_join(z.withColumnRenamed("rater", "a"), other, "term").filter("a <> b")
    return pairs.groupBy("a", "b").agg((F.sum(F.col("z") * F.col("zb")) / (F.count(F.lit(1)) + SHRINK)).alias("w"))


def reliabilities(labels: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``rater, r, p, n``: estimated correlation ``r`` of each rater with the truth, rate ``p`` of rank 3, labels ``n``.

    ``r`` is the leading eigenvector of the agreement matrix, found by power iteration with sparse joins and scaled so
    that products of two entries fit the matrix. The iteration ends when the vector turns by less than ``SETTLED``
    between two looks; one that doesn't within ``rounds`` raises. The majority of raters by weight is taken to be right, so
    the sum of ``r`` is positive. A rater without common items has 0.
    """
    raters = materialize(labels.groupBy("rater").agg(F.avg("x").alias("p"), F.count(F.lit(1)).alias("n")))
    m = materialize(agreement_matrix(labels))
    # a part of the old vector, in units of the matrix: a negative eigenvalue of equal size can't make it swing
    shift = 0.1 * float(m.groupBy("a").agg(F.sum(F.abs("w")).alias("s")).agg(F.coalesce(F.max("s"), F.lit(0.0))).first()[0])
    v = raters.select("rater", F.lit(1.0).alias("v"))
    for _ in range(0, rounds, CUT_EVERY):
        old = v
        for _step in range(CUT_EVERY):
            y = m.join(v, m["b"] == v["rater"]).groupBy("a").agg(F.sum(F.col("w") * F.col("v")).alias("y"))
            v = v.join(y, v["rater"] == y["a"], "left").select("rater", (F.coalesce("y", F.lit(0.0)) + shift * F.col("v")).alias("v"))
        v = materialize(v)
        # one look at both: how long the new vector is and how far it has turned
        seen = v.join(old.withColumnRenamed("v", "_old"), "rater").agg(F.max(F.abs("v")).alias("norm"), F.sum(F.col("v") * F.col("_old")).alias("dot"), F.sum(F.col("v") * F.col("v")).alias("new"), F.sum(F.col("_old") * F.col("_old")).alias("old")).first()
        norm = seen["norm"] or 0.0
        v = v.select("rater", (F.col("v") / norm if norm > 0 else F.lit(0.0)).alias("v"))
        change = math.sqrt(max(0.0, 1 - seen["dot"] ** 2 / (seen["new"] * seen["old"]))) if norm > 0 else 0.0
        if change <= SETTLED:
            break
    else:
        raise RuntimeError(f"the power iteration still changes by {change:.2g} after {rounds} rounds")
    va, vb = v.select(F.col("rater").alias("a"), F.col("v").alias("va")), v.select(F.col("rater").alias("b"), F.col("v").alias("vb"))
    fit = m.join(va, "a").join(vb, "b").agg(F.try_divide(F.sum(F.col("w") * F.col("va") * F.col("vb")), F.sum(F.pow(F.col("va") * F.col("vb"), F.lit(2.0)))).alias("_s")).first()[0]
    total = v.agg(F.sum("v")).first()[0] or 0.0
    scale = max(0.0, fit or 0.0) ** 0.5 * (-1.0 if total < 0 else 1.0)
    return raters.join(v, "rater").select("rater", F.greatest(F.lit(-0.98), F.least(F.lit(0.98), F.col("v") * scale)).alias("r"), "p", "n")


def consensus(labels: DataFrame, reliability: DataFrame) -> DataFrame:
    """``term, label_rank, n_labels, log_odds``: the reliability-weighted vote of all labels of a term.

    A label's weight is the log likelihood ratio that follows from its rater's ``r`` and ``p`` and the prevalence of
    rank 3. Zero log odds give the lower rank.
    """
    trust = F.greatest("r", F.lit(0.0)) * F.col("n")
    prior = reliability.agg(F.coalesce(F.try_divide(F.sum(trust * F.col("p")), F.sum(trust)), F.lit(0.5))).first()[0]
    prior = max(0.05, min(0.95, prior))
    spread = F.col("r") * F.sqrt(F.col("p") * (1 - F.col("p")))
    bound = lambda c: F.greatest(F.lit(0.02), F.least(F.lit(0.98), c))
    rates = reliability.select("rater", bound(F.col("p") + spread * ((1 - prior) / prior) ** 0.5).alias("_t"), bound(F.col("p") - spread * (prior / (1 - prior)) ** 0.5).alias("_f"))
    weight = F.when(F.col("x") == 1, F.log(F.col("_t") / F.col("_f"))).otherwise(F.log((1 - F.col("_t")) / (1 - F.col("_f"))))
    votes = labels.join(rates, "rater").groupBy("term").agg((F.sum(weight) + math.log(prior / (1 - prior))).alias("log_odds"), F.count(F.lit(1)).alias("n_labels"))
    return votes.select("term", F.when(F.round("log_odds", 9) > 0, HIGH).otherwise(LOW).alias("label_rank"), "n_labels", "log_odds")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(clean_labels(table(spark, sf_dir, "term_labels")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per labelled term with its consensus rank."""
    labels = _labels(spark, sf_dir)
    return consensus(labels, reliabilities(labels)).select("term", "label_rank")


def p1_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliability of each annotator in each round."""
    labels = _labels(spark, sf_dir)
    who = labels.select("rater", "annotator", "label_round").distinct()
    return reliabilities(labels).join(who, "rater").select("annotator", "label_round", F.col("n").alias("n_labels"), F.round("r", 4).alias("reliability"))


def p1_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per round: terms, labels, disputed terms and nominal Krippendorff alpha over terms with two labels or more."""
    per = clean_labels(table(spark, sf_dir, "term_labels")).groupBy("label_round", "term").agg(F.sum("x").alias("k"), F.count(F.lit(1)).alias("m"))
    both = F.col("m") >= 2
    s = per.groupBy("label_round").agg(
        F.count(F.lit(1)).alias("n_terms"),
        F.sum("m").alias("n_labels"),
        F.count_if((F.col("k") > 0) & (F.col("k") < F.col("m"))).alias("n_disputed"),
        F.sum(F.when(both, 2 * F.col("k") * (F.col("m") - F.col("k")) / (F.col("m") - 1))).alias("_o"),
        F.sum(F.when(both, F.col("k"))).alias("_k"),
        F.sum(F.when(both, F.col("m"))).alias("_n"),
    )
    expected = 2 * F.col("_k") * (F.col("_n") - F.col("_k")) / (F.col("_n") - 1)
    return s.select("label_round", "n_terms", "n_labels", "n_disputed", F.round(1 - F.try_divide(F.col("_o"), expected), 6).alias("alpha"))


QUERIES = {"p1_found": p1_found, "p1_reliability": p1_reliability, "p1_agreement": p1_agreement}

ORACLE = {
    "p1_agreement": r"""
WITH named AS (
  SELECT replace(coalesce(nullif(lower(trim(regexp_replace(annotator, '[\s\x{00A0}]+', ' ', 'g'))), ''), ''), '_', '-') AS annotator, coalesce(label_round, 0) AS label_round,
    nullif(array_to_string(list_filter(list_transform(string_split(term, '--'), lambda p: trim(regexp_replace(p, '[\s\x{00A0}]+', ' ', 'g'))), lambda p: p <> ''), ' -- '), '') AS term, label_rank, labelled_at
  FROM term_labels WHERE label_rank IN (2, 3)),
last AS (
  SELECT annotator, label_round, term, label_rank - 2 AS x FROM named WHERE term IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY annotator, label_round, term ORDER BY labelled_at DESC NULLS LAST, label_rank DESC) = 1),
per AS (SELECT label_round, term, sum(x)::DOUBLE AS k, count(*)::DOUBLE AS m FROM last GROUP BY 1, 2),
s AS (SELECT label_round, count(*) AS n_terms, sum(m)::BIGINT AS n_labels, count(*) FILTER (k > 0 AND k < m) AS n_disputed,
  sum(2 * k * (m - k) / (m - 1)) FILTER (m >= 2) AS o, sum(k) FILTER (m >= 2) AS kk, sum(m) FILTER (m >= 2) AS n FROM per GROUP BY 1)
SELECT label_round, n_terms, n_labels, n_disputed, round(1 - o / nullif(2 * kk * (n - kk) / (n - 1), 0), 6) AS alpha FROM s"""
}
