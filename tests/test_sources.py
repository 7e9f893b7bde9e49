import json

import pytest

from millrace import sources


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1"}\n\n{bad\n{"id": "2"}\n')
    df = sources.read_json_lines(spark, str(tmp_path / "a.jsonl"), "id STRING").persist()
    assert df.count() == 3 and df.where("_corrupt_record IS NOT NULL").count() == 1
    with pytest.raises(Exception):  # noqa: B017
        sources.read_json_lines(spark, str(tmp_path / "a.jsonl"), "id STRING", fail_fast=True).collect()


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", 0.5), (2, None, None)], "id long, s string, x double")
    sources.write_parquet(df, f"{tmp_path}/p")
    assert sorted(map(tuple, sources.read_columns(spark, f"{tmp_path}/p", "id", "s").collect())) == [(1, "a,b"), (2, None)]
    sources.write_csv(df, f"{tmp_path}/c", one_file=True)
    assert sorted(map(tuple, sources.read_csv(spark, f"{tmp_path}/c", "id long, s string, x double").collect())) == [(1, "a,b", 0.5), (2, None, None)]
    assert sources.manifest(spark, {"p": f"{tmp_path}/p"}) == [("p", 2, 3)]


def test_single_json_and_report(spark, tmp_path):
    df = spark.createDataFrame([(1, "</script>", float("nan"))], "id long, s string, x double")
    sources.write_single_json(df, f"{tmp_path}/a.json")
    text = (tmp_path / "a.json").read_text()
    assert "</" not in text and json.loads(text) == [{"id": 1, "s": "</script>", "x": None}]
    with pytest.raises(ValueError):
        sources.write_single_json(spark.range(5).toDF("id"), f"{tmp_path}/b.json", most=2)
    sources.write_report({"T": df}, f"{tmp_path}/r.md")
    assert "| 1 | </script> | nan |" in (tmp_path / "r.md").read_text()


def test_stream(spark, tmp_path):
    from millrace.streaming import flatten_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.jsonl").write_text('{"id": 1, "notes": {"flat": [{"name": "a"}, 5]}}\nbroken\n')
    q = flatten_stream(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state", "note")
    q.awaitTermination(120)
    assert [(r.place, r.pos, r.name) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [("notes.flat", 0, "a")]


def test_cached_vectors(spark, tmp_path):
    import numpy as np

    at, built = str(tmp_path / "cache"), []

    def build(n=3):
        built.append(n)
        return np.arange(6.0).reshape(3, 2)

    spark.range(3).write.parquet(str(tmp_path / "in.parquet"))
    ask = lambda names: sources.cached_vectors(spark, at, names, [str(tmp_path / "in.parquet")], build)
    for _ in range(2):
        assert ask(["a", "b", "c"]).tolist() == [[0, 1], [2, 3], [4, 5]]
    assert len(built) == 1
    ask(["a", "c", "b"])  # another vocabulary
    spark.range(4).write.mode("overwrite").parquet(str(tmp_path / "in.parquet"))
    ask(["a", "b", "c"])  # other data
    assert len(built) == 3
