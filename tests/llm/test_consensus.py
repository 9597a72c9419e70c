import math
import random

import numpy as np
import pytest

from rungwork.llm import consensus as C
from tests.conftest import rows

SCHEMA = "annotator string, label_round int, term string, label_rank int, labelled_at int, rater string, x double, v string"


def frame(spark, data):
    return spark.createDataFrame([(*r, "clash", 9.0, None) for r in data], SCHEMA)


def test_latest_valid_label_counts(spark):
    data = [("ANN_1 ", 2, "A --  B", 2, 1), ("ann-1", 2, "A--B", 3, 2), ("ann-1", 2, "A -- B", 23, 3), ("ann-1", 2, None, 2, 1), (None, 2, "A -- B", 2, None), ("ann-1", 2, "A -- B", 3, 2), ("ann-2", None, "A -- B", 2, 1)]
    got = rows(C.clean_labels(frame(spark, data)).select("rater", "term", "x"))
    assert got == [("ann-1|2", "A -- B", 1.0), ("ann-2|0", "A -- B", 0.0), ("|2", "A -- B", 0.0)]


def test_reliable_raters_outvote_careless_and_contrary_ones(spark):
    rng = random.Random(1)
    truth = {f"t{i:03d}": 2 + (rng.random() < 0.4) for i in range(150)}
    skill = {"good1": 0.93, "good2": 0.9, "good3": 0.88, "coin": 0.5, "against": 0.15, "always": None}
    data = []
    for a, p in skill.items():
        for t, r in truth.items():
            if rng.random() < 0.7:
                data.append((a, 2, t, 3 if p is None else r if rng.random() < p else 5 - r, 1))
    labels = C.clean_labels(frame(spark, data)).persist()
    rel = {r["rater"].split("|")[0]: r["r"] for r in C.reliabilities(labels).collect()}
    assert rel["good1"] > 0.6 and rel["against"] < -0.4 and abs(rel["coin"]) < 0.3 and abs(rel["always"]) < 1e-6
    got = {r["term"]: r["label_rank"] for r in C.consensus(labels, C.reliabilities(labels)).collect()}
    majority = {}
    for _, _, t, r, _ in data:
        majority.setdefault(t, []).append(r)
    right = sum(got[t] == truth[t] for t in got)
    weight = {a: 0.0 if p is None else math.log(p / (1 - p)) for a, p in skill.items()}
    score = dict.fromkeys(truth, math.log(0.4 / 0.6))
    for a, _, t, r, _ in data:
        score[t] += weight[a] * (1 if r == 3 else -1)
    best = sum((3 if score[t] > 0 else 2) == truth[t] for t in got)  # the vote with the true skills
    plain = sum((3 if sum(v) > 2.5 * len(v) else 2) == truth[t] for t, v in majority.items())
    assert right >= best - 3 and right > plain


def test_empty_and_single_label(spark):
    empty = C.clean_labels(frame(spark, []))
    assert C.consensus(empty, C.reliabilities(empty)).count() == 0
    one = C.clean_labels(frame(spark, [("a", 1, "T", 3, 1)]))
    assert [r["term"] for r in C.consensus(one, C.reliabilities(one)).collect()] == ["T"]


def test_the_vector_is_the_leading_one_or_raises(spark):
    rng = random.Random(3)
    data = [(f"a{i}", 2, f"t{j}", 2 + ((j % 3 == 0) ^ (rng.random() < 0.1 + 0.04 * i)), 1) for i in range(9) for j in range(80) if rng.random() < 0.6]
    labels = C.clean_labels(frame(spark, data)).persist()
    names = sorted({a + "|2" for a, *_ in data})
    m = np.zeros((len(names), len(names)))
    for r in C.agreement_matrix(labels).collect():
        m[names.index(r["a"]), names.index(r["b"])] = r["w"]
    values, vectors = np.linalg.eigh(m)
    want = vectors[:, -1] * np.sign(vectors[:, -1].sum())
    got = {r["rater"]: r["r"] for r in C.reliabilities(labels).collect()}
    got = np.array([got[n] for n in names])
    assert np.allclose(got / np.linalg.norm(got), want, atol=1e-3)
    with pytest.raises(RuntimeError):
        C.reliabilities(labels, C.CUT_EVERY - 1)
