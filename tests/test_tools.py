"""Searches, models kept, functions of one's own, and small files."""

import json

import pytest
from pyspark.sql import functions as F

from tripleflow.operators import maps, triples, tuning
from tripleflow.plans.workflow import Workflow, orchestrate
from tripleflow.sources import files


def test_search_goes_on_after_failures_and_resumes(spark):
    tried = []

    def objective(a, b):
        tried.append((a, b))
        return a / b

    runs = tuning.search(spark, objective, tuning.grid({"a": [1, 2], "b": [0, 2]}))
    assert [(r.value, r.state) for r in runs.orderBy("trial").collect()] == [(None, "FAIL"), (0.5, "COMPLETE"), (None, "FAIL"), (1.0, "COMPLETE")]
    assert tuning.best(runs) == {"a": 2, "b": 2} and tuning.best(runs, maximize=False) == {"a": 1, "b": 2} and tuning.best(runs.limit(0)) is None
    tried.clear()
    tuning.search(spark, objective, [{"a": 1, "b": 2}, {"a": 9, "b": 3}], runs)
    assert tried == [(9, 3)]
    assert tuning.sampled({"x": [1, 2], "y": (0.0, 1.0), "z": (1, 5)}, 4) == tuning.sampled({"x": [1, 2], "y": (0.0, 1.0), "z": (1, 5)}, 4)
    assert tuning.overridden({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 9}, "e": 4}) == {"a": {"b": 9, "c": 2}, "d": 3, "e": 4}


def test_models_are_kept_and_read_again(spark, tmp_path):
    vectors = spark.createDataFrame([("entity", 0, [1.0]), ("relation", 0, [2.0])], "kind string, id long, v array<double>")
    maps_ = [spark.createDataFrame([(0, x)], "id long, label string") for x in ("a", "r")]
    tuning.save_model(vectors, *maps_, f"file://{tmp_path}/m", {"dim": 1})
    e, r, settings = tuning.load_model(spark, f"file://{tmp_path}/m")
    assert [tuple(x) for x in e.collect()] == [(0, "a", [1.0])] and [tuple(x) for x in r.collect()] == [(0, "r", [2.0])] and settings == {"dim": 1}


def test_ingestion(spark):
    docs = spark.createDataFrame([(1, "55", 1, '{"a": {"b": 1}, "c": null}'), (2, "55", 2, '{"a": "x"}'), (3, "56", 1, "cut")], "id long, msisdn string, at int, data string")
    none = spark.createDataFrame([], "s string, p string, o string, confidence double")
    kept, facts, counts = tuning.ingested(docs.limit(0), none, docs, "msisdn", ["at"], "id", "data")
    assert {r.id for r in kept.collect()} == {2, 3} and {(r.s, r.p, r.o) for r in facts.collect()} == {("1/entity_0", "a.b", "1"), ("2/entity_0", "a", "x")}
    assert {(r.tab, r.n) for r in counts.collect()} == {("documents", 2), ("triples", 2)}


def test_own_functions(spark):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, None)], "k int, v string")
    got = maps.mapped(df, ["k"], lambda row: row["v"].upper()).orderBy("place").collect()
    assert [(r.place, r.result) for r in got] == [(0, "A"), (1, None), (2, "C")] and "AttributeError" in got[1].error
    best = maps.best_of(df, "k", {"one": lambda row: row["v"], "two": lambda row: row["v"] * 2, "three": lambda row: 1 // 0}, len).collect()
    assert {(r.k, r.name, r.result) for r in best} == {(3, "two", "cc"), (1, "two", "aa"), (2, None, None)}
    assert maps.mapped(df.limit(0), ["k"], len, "int").count() == 0


def test_manifests_go_on_after_failures(spark):
    flow = Workflow(spark, {"s": [{"method": "f", "args": {"x": "{{ x }}"}, "save_as": "result", "set": "result", "value": "never"}]}, {"f": lambda x: 10 // x})
    got = orchestrate(spark, {"execution_id": 7, "tasks": [{"msisdn": i, "sequence": "s", "payload": {"x": x}} for i, x in enumerate((2, 0, 5))]}, flow).collect()
    assert [(r.execution_id, r.msisdn, r.ok, r.result if r.ok else None) for r in got] == [("7", "0", True, "5"), ("7", "1", False, None), ("7", "2", True, "2")]


def test_small_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "é"), (2, None)], "k long, v string")
    files.write(df, f"file://{tmp_path}/x.json", files=1)
    (name,) = (tmp_path / "x.json").glob("part-*")
    assert json.loads(name.read_text()) == [{"k": 1, "v": "é"}, {"k": 2, "v": None}]
    (tmp_path / "y.json").write_text('{\n "a": 1\n}')
    assert json.loads(files.read(spark, f"file://{tmp_path}/y.json").first().data) == {"a": 1}
    assert [tuple(r) for r in files.read_bytes(spark, "a;b\n1;é\n2\n".encode("latin-1"), ".csv").collect()] == [("1", "é"), ("2", None)]
    assert files.read_bytes(spark, b"", ".tsv").count() == 0 and files.read_bytes(spark, b"", ".jsonl").count() == 0
    assert files.read_bytes(spark, b"x\ty\n", ".tsv").first().asDict() == {"column_1": "x", "column_2": "y"}
    files.append_observations(df, f"file://{tmp_path}/obs")
    files.append_observations(df, f"file://{tmp_path}/obs")
    assert spark.read.json(f"file://{tmp_path}/obs").count() == 4
    with pytest.raises(ValueError, match="lacks o"):
        files.read_triples(spark, _written(spark, tmp_path))
    with pytest.raises(FileNotFoundError):
        files.read_splits(spark, f"file://{tmp_path}/nowhere")


def _written(spark, tmp_path):
    path = f"file://{tmp_path}/t.parquet"
    spark.createDataFrame([("a", "b")], "s string, p string").write.parquet(path)
    return path


def test_flattened_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, '{"a": 1}'), (2, None)], "id long, data string")
    first = triples.ensured(docs, "id", "data", f"file://{tmp_path}/flat")
    assert first.count() == 1 and len(list((tmp_path / "flat").iterdir())) == 1
    triples.ensured(docs, "id", "data", f"file://{tmp_path}/flat")
    assert len(list((tmp_path / "flat").iterdir())) == 1
    triples.ensured(docs.where("id = 1").withColumn("data", F.lit('{"b": 1}')), "id", "data", f"file://{tmp_path}/flat")
    assert len(list((tmp_path / "flat").iterdir())) == 2


def test_log_lines(spark):
    lines = [('{"text": "hi  ", "record": {"thread": {"name": "T"}, "extra": {"task_id": "9"}}}',), ("a | b | c | [55] Thread-3 d",), ("# head",), (None,), ("plain",), ("a|b|c|d",)]
    got = [(r.thread, r.msisdn, r.message) for r in files.log_parts(spark.createDataFrame(lines, "l string"), "l").collect()]
    assert got[0] == ("T", "9", "hi") and got[1][:2] == ("Thread-3", "55") and got[2] == ("_meta", None, "# head") and got[3] == ("_meta", None, None) and got[4][0] == "_meta" and got[5][:2] == ("MainThread", None)
