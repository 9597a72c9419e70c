import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rungwork.llm import mixing as M
from rungwork.llm import reading as R
from tests.conftest import rows

TARGETS = {"a": (0.5, 1), "b": (0.3, 3), "gone": (0.2, 2)}


def test_raking_meets_shares_and_caps():
    cells = {("a", "en", "x"): 400.0, ("a", "es", "y"): 600.0, ("b", "en", "x"): 100.0, ("b", "en", "y"): 200.0, ("other", "en", "x"): 999.0}
    plan = M.rake(cells, TARGETS)
    got = {}
    for k, c in plan.copies.items():
        assert 0 <= c <= TARGETS[k[0]][1] + 1e-9
        got[k[0]] = got.get(k[0], 0) + c * cells[k]
    assert abs(got["a"] / sum(got.values()) - 0.625) < 1e-6 and abs(sum(got.values()) - plan.tokens) < 1e-6
    assert M.rake({}, TARGETS).copies == {}


def test_mixture_with_nulls_repeats_and_clashes(spark):
    docs = spark.createDataFrame([(i, "A_ " if i % 4 else "b", "EN" if i % 3 else None, "essay" if i % 2 else None, "some words here " * (i % 7 + 1), 5) for i in range(2000)] + [(3000, "zzz", "en", "e", "x", 1), (3001, "a", "en", "e", None, 1), (3002, None, "en", "e", "x", 1), (None, "a", "en", "e", "x", 1)], "doc_id long, source string, lang string, genre string, text string, copies int")
    targets = M.clean_targets(spark.createDataFrame([("a", 0.5, 1), ("B", 0.3, 3), ("gone", 0.2, 2), (None, 0.1, 1), ("c", None, 1)], "source string, target_share double, max_repeats int"))
    assert set(targets) == {"a", "b", "gone"}
    sized = M.sized_documents(docs.withColumn("source", F.translate("source", "_", ""))).persist()
    mixed = M.mixture(sized, targets)
    share = {r["source"]: r["t"] for r in mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("t")).collect()}
    # each source's tokens are the plan's to within a document
    have = {r["source"]: r["t"] for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    size = min(have[s] * targets[s][1] / t for s, t in (("a", 0.625), ("b", 0.375)))
    most = sized.agg(F.max("n_tokens")).first()[0]
    assert all(abs(share[s] - t * size) <= most for s, t in (("a", 0.625), ("b", 0.375)))
    assert mixed.agg(F.max(F.when(F.col("source") == "a", F.col("copies")))).first()[0] == 1
    assert rows(mixed) == rows(M.mixture(sized.repartition(3), targets))
    assert M.mixture(sized.filter("false"), targets).count() == 0 and M.mixture(sized, {"none": (1.0, 1)}).count() == 0


@pytest.mark.parametrize("n", [40, 3000])
def test_small_and_large_sources_hold_their_tokens(spark, n):
    sized = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.concat(F.lit("l"), F.col("id") % 2).alias("lang"), F.concat(F.lit("t"), F.col("id") % 7).alias("topic"), (F.pow(F.col("id") % 17 + 1, F.lit(2))).cast("long").alias("n_tokens")).persist()
    targets = {"s0": (0.7, 2), "s1": (0.2, 3), "s2": (0.1, 4)}
    got = {r["source"]: (r["t"], r["c"]) for r in M.mixture(sized, targets, languages={"l0": 0.6, "l1": 0.4}).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("t"), F.max("copies").alias("c")).collect()}
    have = {r["source"]: r["t"] for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    size = min(have[s] * m / t for s, (t, m) in targets.items())
    assert all(abs(got[s][0] - t * size) <= 289 and got[s][1] <= m for s, (t, m) in targets.items())


def test_fitting_tells_whether_it_settled():
    cells = {(s, l, t): (10.0 if s == "a" else 90.0) + len(l + t) for s in ("a", "b") for l in ("en", "es") for t in ("x", "y")}
    plan = M.rake(cells, {"a": (0.5, 2), "b": (0.5, 2)}, languages={"en": 0.7, "es": 0.3, "gone": 1.0})
    en = sum(c * cells[k] for k, c in plan.copies.items() if k[1] == "en")
    assert plan.converged and plan.rounds < M.ROUNDS and abs(en / plan.tokens - 0.7) < 1e-4
    assert not M.rake(cells, {"a": (0.5, 2), "b": (0.5, 2)}, rounds=1, languages={"en": 0.9, "es": 0.1}).converged


def test_tokens_round_trip():
    enc = M.encoder()
    text = "A text, with <|endoftext|> and ünïcode.\n"
    assert enc.decode(enc.encode_ordinary(text)) == text


EASY = "the cat sat on the mat and we had it in my hand . ".split()
HARD = "notwithstanding the administrative jurisprudence whereas institutional correspondence which consolidated bureaucratisation nevertheless complicated ".split()


def make(level, n, rng):
    return " ".join(rng.choice(HARD if rng.random() < level / 6 else EASY) for _ in range(n))


def test_levels_of_held_out_documents(spark):
    rng = random.Random(8)
    data = [(i, make(i % 5 + 1, 120, rng), "en") for i in range(400)] + [(900, "la casa de los niños y el perro que no se fue " * 9, "en"), (901, "the short text", "en"), (902, None, "en"), (903, "", None), (None, make(1, 99, rng), "en")]
    docs = spark.createDataFrame(data, "doc_id long, text string, x string")
    f = R.document_features(docs).persist()
    grades = spark.createDataFrame([(i, g, min(5, max(1, i % 5 + 1 + (rng.random() < 0.1)))) for i in range(0, 400, 2) for g in ("p", "q")] + [(1, None, None), (None, "p", 3), (3, "p", 9), (2, "p", 3)], "doc_id long, grader string, band int")
    got = {r["doc_id"]: r["band"] for r in R.reading_levels(f, R.fit_levels(f, grades)).collect()}
    assert len(got) == 400 and not {900, 901, 902, 903} & set(got)
    right = np.mean([abs(got[i] - (i % 5 + 1)) <= 0 for i in range(1, 400, 2)])
    assert right > 0.7 and np.mean([abs(got[i] - (i % 5 + 1)) <= 1 for i in range(1, 400, 2)]) > 0.97
    assert {r["band"] for r in R.reading_levels(f, R.fit_levels(f, grades.filter("false"))).collect()} == {3}
    assert R.reading_levels(R.document_features(docs.filter("false")), None).count() == 0


def test_empty_partitions_of_a_scan(spark, tmp_path):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "d"))
    read = spark.read.parquet(str(tmp_path / "d"))
    assert rows(R.document_features(read).select("doc_id", "n_words")) == [(1, 0), (2, 0)]
    assert R.document_features(read.filter("doc_id > 9")).count() == 0


def test_fitting_on_a_bounded_sample_of_many_graders(spark):
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, make(i % 5 + 1, 90, rng)) for i in range(300)], "doc_id long, text string")
    f = R.document_features(docs).persist()
    grades = spark.createDataFrame([(i, f"g{i}-{k}", i % 5 + 1) for i in range(0, 300, 2) for k in range(6)], "doc_id long, grader string, band int")
    model = R.fit_levels(f, grades, most=400)
    got = {r["doc_id"]: r["band"] for r in R.reading_levels(f, model).collect()}
    assert len(got) == 300 and np.mean([abs(got[i] - (i % 5 + 1)) <= 1 for i in range(1, 300, 2)]) > 0.9


@pytest.mark.parametrize(("text", "english"), [("we had the dog and it was in my house " * 3, True), ("der hund und die katze sind nicht in das haus " * 3, False)])
def test_language(text, english):
    assert R.Lexicon({}, 0).features(text)[1] is english
