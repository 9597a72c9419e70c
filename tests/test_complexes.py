import pytest
from pyspark.sql import functions as F

from rungwork.operators import complexes as C
from rungwork.operators import corpus as K
from tests.conftest import rows

SCHEMA = "segment_id string, interview_id string, collection_id string, narrators array<string>, interviewers array<string>, topics array<struct<term: string, id: string>>, geography array<struct<term: string>>, title string, description string"
INTERVIEWS = "interview_id string, narrators array<string>"
RANKS = [("W -- Camps -- Food", 2), ("W -- Camps -- School", 2), ("W -- Propaganda", 2), ("W", 3)]


def toy(spark, data=None):
    data = data or [
        ("s1", "i1", "c", ["n1"], ["v1"], [("W -- Camps -- Food", None)], [("Seattle",)], None, None),
        ("s2", "i2", "c", ["n2"], [], [("W -- Camps -- Food", None)], [("Portland",)], None, None),
        ("s3", "i3", "c", ["n3"], [], [("W -- Camps -- School", None)], [("Seattle",)], None, None),
        ("s4", "i4", "c", ["n4"], [], [("W -- Propaganda", None)], [("Seattle",)], None, None),
        ("s4", "i4", "c", ["n4"], [], [("W -- Propaganda", None)], [("Seattle",)], None, None),
    ]
    return K.clean_segments(spark.createDataFrame(data, SCHEMA), spark.createDataFrame([("i9", ["n9"])], INTERVIEWS))


def ranks(spark):
    return spark.createDataFrame(RANKS, "term string, cell_rank int")


def test_granularity_changes_only_the_event_key(spark):
    sizes = C.build_complex(toy(spark), ranks(spark)).sizes().filter("cell_rank = 2")
    got = {g: sorted(r["size"] for r in sizes.filter(F.col("granularity") == g).collect()) for g in C.GRANULARITIES}
    assert got == {"coarse": [1, 3], "mid": [1, 1, 2], "fine": [1, 1, 1, 1]}


def test_repeated_mentions_count_once_and_interviewers_on_request(spark):
    data = [("s1", "i1", "c", ["n1"], ["v1", "v2"], [("A -- B", None)], None, None, None), ("s2", "i1", "c", ["n1"], ["v1"], [("A -- B", None)], None, None, None)]
    rank = spark.createDataFrame([("A -- B", 2)], "term string, cell_rank int")
    size = lambda **k: [r["size"] for r in C.build_complex(toy(spark, data), rank, **k).sizes().filter("cell_rank = 2 and granularity = 'mid'").collect()]
    assert size() == [1] and size(include_interviewers=True) == [3]


def test_episode_takes_in_strict_descendants(spark):
    data = [("s1", "i1", "c", ["n1"], None, [("W", None)], None, None, None), ("s2", "i2", "c", ["n2"], None, [("W -- Propaganda", None)], None, None, None), ("s3", "i3", "c", ["n3"], None, [("Ware -- X", None)], None, None, None)]
    cx = C.build_complex(toy(spark, data), ranks(spark))
    assert rows(cx.sizes().filter("cell_rank = 3 and granularity = 'mid'").select("cid", "size", "n_segments")) == [("r3:W", 2, 2)]
    assert rows(C.incidence(cx, 2, 3).filter("granularity = 'mid'").select("row_cid", "col_cid")) == [("r2:W -- Propaganda", "r3:W")]


def test_segment_without_narrators_inherits_and_without_any_is_no_moment(spark):
    data = [("s1", "i9", "c", None, None, None, None, None, None), ("s2", "i8", "c", [], None, None, None, None, None)]
    seg = toy(spark, data)
    assert {r["segment_id"]: r["narrators"] for r in seg.collect()} == {"s1": ["n9"], "s2": []}
    cx = C.build_complex(seg, ranks(spark))
    assert cx.cells.filter("granularity = 'mid'").count() == 1


def test_star_roundtrip_sanity_and_injectivity(spark):
    cx = C.build_complex(toy(spark), ranks(spark))
    assert {(r["n_missing"], r["n_extra"]) for r in C.star_roundtrip(cx).collect()} == {(0, 0)}
    assert {(r["n_empty_moments"], r["n_bad_rank"], r["n_outside"]) for r in C.sanity(cx).collect()} == {(0, 0, 0)}
    data = [(f"s{i}", f"i{i}", "c", [n], None, None, None, None, None) for i, n in enumerate(["a", "a", "b"])]
    r = C.support_injectivity(C.build_complex(toy(spark, data), ranks(spark))).filter("granularity = 'mid'").first()
    assert (r["n_cells"], r["n_supports"], r["max_multiplicity"], r["collapse"]) == (3, 2, 2, 1.5)


def test_mask_keeps_emptied_cells_and_restrict_drops_them(spark):
    cx = C.build_complex(toy(spark), ranks(spark))
    none = cx.members.filter("false").select("narrator", "cid")
    masked = C.mask(cx, none).sizes().filter("granularity = 'mid' and cell_rank = 2")
    assert [r["size"] for r in masked.collect()] == [0, 0, 0]
    kept = spark.createDataFrame([("n1",)], "narrator string")
    assert rows(C.restrict(cx, kept).sizes().filter("granularity = 'mid' and cell_rank = 2").select("cid", "size")) == [("r2:W -- Camps -- Food", 1)]


def test_concordance_and_unknown_incidence(spark):
    sizes = spark.createDataFrame([("mid", 2, "a", 3), ("mid", 3, "b", 1), ("mid", 3, "c", 3)], "granularity string, cell_rank int, cid string, size long")
    assert rows(C.concordance(sizes)) == [("mid", 0, 1, 1)]
    with pytest.raises(ValueError):
        C.incidence(C.build_complex(toy(spark), ranks(spark)), 2, 1)


def test_empty_corpus(spark):
    seg = toy(spark).filter("false")
    assert C.build_complex(seg, ranks(spark)).sizes().count() == 0


def test_adjacency_pairs_rows_after_all_aggregation(spark, monkeypatch):
    monkeypatch.setattr(C, "LISTED_ROWS", 4)
    held = [("mid", f"r{i:02d}", c) for i in range(30) for c in ("x", "y", "z")[: i % 3 + 1]] + [("fine", "r00", "x"), ("fine", "r01", "x"), ("fine", "r01", "x"), ("fine", None, "x"), ("fine", "r02", None)]
    edges = spark.createDataFrame(held, "granularity string, row_cid string, col_cid string")
    want = {}
    for g, a, x in held:
        for h, b, y in held:
            if g == h and a and b and a != b and x == y and x:
                want[g, a, b] = want.get((g, a, b), 0) + 1
    got = C.adjacency(edges)
    assert rows(got) == sorted((*k, n) for k, n in want.items())
    assert C.adjacency(edges.filter("false")).count() == 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and "Aggregate" not in plan.split("Generate")[0]
