import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rungwork.llm import keep_together as K
from rungwork.llm import similar_sets as S
from tests.conftest import rows

SEG = "segment_id string, interview_id string, narrators array<string>, nodes string, component string, _m int"
INT = "interview_id string, narrators array<string>, keys int"


def test_groups_through_narrators_interviews_and_lent_narrators(spark):
    seg = spark.createDataFrame(
        [
            ("s1", "i1", ["OH:2 ", None], "c", "c", 1),
            ("s2", "i1", ["oh:1"], None, None, 1),
            ("s3", "i2", ["oh:2"], None, None, 1),
            ("s4", "i3", [" "], None, None, 1),
            ("s4", "i3", [" "], None, None, 2),
            ("s5", None, ["oh:9"], None, None, 1),
            ("s6", None, None, None, None, 1),
            ("s7", "i4", [], None, None, 1),
            (None, "i1", ["oh:1"], None, None, 1),
        ],
        SEG,
    )
    interviews = spark.createDataFrame([("i3", ["oh:9"], 1), ("i3", ["oh:9"], 2), (None, ["oh:1"], 1), ("i4", None, 1)], INT)
    got = dict(rows(K.groups(K.entities(seg, interviews))))
    assert got == {"s1": "oh:1", "s2": "oh:1", "s3": "oh:1", "s4": "oh:9", "s5": "oh:9", "s6": "s6", "s7": "i4"}
    assert K.groups(K.entities(seg.filter("false"), interviews)).count() == 0


def test_buckets_follow_shares(spark):
    df = spark.range(20000).select(K.bucket(F.col("id").cast("string"), {"train": 0.7, "val": 0.1, "test": 0.2}).alias("b"))
    n = {r["b"]: r["count"] / 20000 for r in df.groupBy("b").count().collect()}
    assert abs(n["train"] - 0.7) < 0.02 and abs(n["test"] - 0.2) < 0.02


def test_a_giant_group_goes_to_the_largest_split(spark):
    rows_ = [(f"g{i}", "giant") for i in range(400)] + [(f"s{i}", f"k{i}") for i in range(600)]
    got = K.assign(spark.createDataFrame(rows_, "segment_id string, group_key string"), {"test": 0.1, "train": 0.9})
    n = {r["bucket"]: r["count"] for r in got.groupBy("bucket").count().collect()}
    assert {r["bucket"] for r in got.filter("group_key = 'giant'").collect()} == {"train"} and 30 <= n["test"] <= 95
    assert K.assign(got.drop("bucket").filter("false")).count() == 0


def test_similar_sets_match_brute_force(spark):
    rng = random.Random(4)
    sets = {}
    for c in range(60):
        base = rng.sample(range(500), rng.randrange(4, 30))
        for k in range(5):
            cut = set(base) - set(rng.sample(base, min(k // 2, len(base) - 4)))
            sets[f"c{c:02d}-{k}"] = sorted(f"v{x}" for x in cut | ({1000 + k} if k == 4 else set()))
    df = spark.createDataFrame([("members", c, v) for c, v in sets.items()], "side string, cid string, vals array<string>")
    classes = S.set_classes(df).persist()
    got = {(a, b) for _, a, b in rows(S.expand(classes, S.similar_class_pairs(classes)))}
    names = sorted(sets)
    want = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if len({*sets[a]} & {*sets[b]}) >= 0.8 * len({*sets[a]} | {*sets[b]}) - 1e-9}
    assert got == want


def test_recall_is_calibrated():
    assert [S.segment_width(n) for n in (0, 1, 1000, 10**6, 1 << 70)] == [8, 8, 10, 20, 60] and S.segments_needed(10, 1.0) == 1
    for width in (8, 16, 24, 40):
        m = S.segments_needed(width, 0.8)
        assert 1 - (1 - 0.9**width) ** m >= 0.9999 and m * width >= S.NEAR_BITS
    assert S.hamming_radius(64, 0.8) < 24 and S.hamming_radius(64, 1.0) == 0


@pytest.mark.parametrize("width", [8, 14, 20])
def test_pairs_at_the_threshold_share_a_segment(width):
    sets = [[rng.randrange(1 << 60) for _ in range(18)] for rng in map(random.Random, range(150))]
    near = [[*s[:16], 1 + i, 2 + i] for i, s in enumerate(sets)]  # 16 of 20 in common
    df = pd.DataFrame({"id": range(300), "n": 18, "s": 5, "h": [*sets, *near]})
    keys = next(S._codes(width, S.segments_needed(width, 0.8))([df]))["keys"]
    assert all(set(keys[i]) & set(keys[150 + i]) for i in range(150))


def test_cell_sets_with_nulls_ties_and_clashes(spark):
    cells = spark.createDataFrame(
        [("a", 2, ["A", "b ", "B", "c", "d", None, ""], None, "x"), ("b", 2, ["a", "b", "c", "d"], [], "x"), ("b", 2, ["a", "b", "c", "d"], [], "y"), ("c", 3, ["a", "b", "c", "d"], None, None), (None, 2, ["a", "b", "c", "d"], None, None), ("d", 2, ["a", "b", "c"], None, None)],
        "cid string, cell_rank int, members array<string>, segments array<string>, side string",
    )
    classes = S.set_classes(S.cell_sets(cells))
    assert rows(classes.select("cid", "rep")) == [("a", "a"), ("b", "a")]
    assert rows(S.expand(classes, S.similar_class_pairs(classes))) == [("members", "a", "b")]
    empty = S.set_classes(S.cell_sets(cells.filter("false")))
    assert S.expand(empty, S.similar_class_pairs(empty)).count() == 0
