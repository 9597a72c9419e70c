import json

from rungwork.operators.complexes import build_complex
from rungwork.operators.corpus import clean_segments
from rungwork.sources import readers
from rungwork.streaming import append
from tests.conftest import rows
from tests.test_complexes import ranks, toy


def test_torn_lines_are_dropped_and_a_missing_file_is_empty(spark, tmp_path):
    p = tmp_path / "s.jsonl"
    p.write_text(json.dumps({"segment_id": "s1", "narrators": ["a"]}) + '\n{"segment_id": "s2", "narr')
    got = readers.read_jsonl(spark, str(p), readers.SEGMENT)
    assert [r["segment_id"] for r in got.collect()] == ["s1"]
    assert readers.read_jsonl(spark, str(tmp_path / "none"), readers.SEGMENT).count() == 0


def test_split_and_rank_map_files(spark, tmp_path):
    (tmp_path / "split.json").write_text(json.dumps({"kind": "random", "train": ["a", "b"], "test": ["c"]}))
    assert rows(readers.read_split(spark, str(tmp_path / "split.json"))) == [("test", "c"), ("train", "a"), ("train", "b")]
    (tmp_path / "maps.json").write_text(json.dumps({"R-A": {"X": 2}, "R-B": {"X": 3}}))
    assert rows(readers.read_rank_maps(spark, str(tmp_path / "maps.json"))) == [("R-A", "X", 2), ("R-B", "X", 3)]


def test_numbers_in_nested_json(spark):
    df = spark.createDataFrame([('{"a": 1, "b": {"c": [2.5, true]}}',), ("torn {",), (None,)], "j string")
    assert rows(readers.numbers_in_json(df, "j")) == [("a", 1.0), ("b/c/0", 2.5)]


def test_release_reproduces(spark, tmp_path):
    seg = toy(spark)
    cx = build_complex(seg, ranks(spark))
    readers.write_release(cx.cells, cx.members, cx.supports, seg, str(tmp_path))
    got = {r["measure"]: r["value"] for r in readers.reproduce_release(spark, str(tmp_path)).collect()}
    assert got["segments"] == 4 and got["narrators"] == 4 and got["mid rank 2"] == 3 and got["fine rank 2"] == 4


def test_stream_of_segments_appends_each_once(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/segments.parquet")
    src.write.parquet(str(tmp_path / "in"))
    stream = append.segment_stream(spark, str(tmp_path / "in"), src.schema)
    append.append_parquet(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == src.select("segment_id").distinct().count()
    assert clean_segments(out, spark.read.parquet("/root/testdata/sf0.001/interviews.parquet")).count() == out.count()
