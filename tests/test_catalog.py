"""Sources, sinks, vocabulary builds and tables of results: round trips and failures."""

import json
import math

import pytest
from pyspark.sql import functions as F

from chronoline import catalog
from chronoline.operators import results, vocab
from chronoline.sources import readers
from chronoline.streaming import streams

ENTRY = "entry_idx int, code string, type string, unit string, range_start double, range_end double, categories array<string>, description string, stats array<struct<type:string,dataset:string,split:string,count:bigint,model:string,ppl:double>>"
ROWS = [(0, "A", "code", None, None, None, None, "text of A", [("count_occurrences", "d", "train", 5, None, None)]), (1, "A", "numerical_range", "mg", -math.inf, 2.5, None, None, []), (2, "A", "numerical_range", "mg", 2.5, math.inf, None, None, None), (3, "B", "categorical", None, None, None, ["x", "y"], None, [])]


def test_token_configuration_round_trip(spark, tmp_path):
    path = str(tmp_path / "config")
    readers.write_token_config(spark.createDataFrame(ROWS, ENTRY).repartition(3), path)
    got = [tuple(r) for r in readers.read_token_config(spark, path).orderBy("entry_idx").collect()]
    plain = lambda r: (r[0], r[1], r[2], r[7], r[3], r[4], r[5], r[6], [tuple(s) for s in r[8]] if r[8] is not None else None)
    assert [(*r[:8], [tuple(s) for s in r[8]] if r[8] is not None else None) for r in got] == [plain(r) for r in ROWS]
    (tmp_path / "bad.json").write_text(json.dumps({"tokens": [{"code": "A", "type": "other"}]}))
    with pytest.raises(Exception, match="unknown token type"):
        readers.read_token_config(spark, str(tmp_path / "bad.json")).collect()


def test_code_dictionary(spark, tmp_path):
    rows = [{"code_string": "A", "type": "numeric", "val_start": 1.0, "val_end": 2.0, "weight": 0.5}, {"code_string": "B", "type": 0}, {"code_string": "C", "type": "unused"}, {"code_string": "D", "type": 2, "text_string": "x"}]
    (tmp_path / "d.json").write_text(json.dumps({"regular": rows}))
    got = [(r["entry_idx"], r["code"], r["type"], r["categories"]) for r in readers.read_code_dictionary(spark, str(tmp_path / "d.json")).orderBy("entry_idx").collect()]
    assert got == [(0, "A", "numerical_range", None), (1, "B", "code", None), (3, "D", "categorical", ["x"])]
    (tmp_path / "e.json").write_text(json.dumps({"regular": [{"code_string": "A", "type": 9}]}))
    with pytest.raises(Exception, match="unknown type"):
        readers.read_code_dictionary(spark, str(tmp_path / "e.json")).collect()


def test_extract_and_events(spark, tmp_path):
    rows = [(1, "a", "2020-01-02", 0.0, "t"), (1, "b", "2020-01-01", 2.0, "u"), (2, "c", "2020-01-01", None, "v"), (3, "d", "2020-01-01", 1.0, None)]
    data = spark.createDataFrame(rows, "subject_id long, code string, time string, numeric_value double, text_value string").withColumn("time", F.col("time").cast("timestamp"))
    data.coalesce(1).write.parquet(str(tmp_path / "data"))
    spark.createDataFrame([("train", 1), ("train", 2), ("held_out", 3)], "split string, subject_id long").coalesce(1).write.parquet(str(tmp_path / "metadata/subject_splits.parquet"))
    got = [(r["pid"], r["event_idx"], r["code"], r["value_num"], r["value_str"]) for r in readers.read_meds(spark, str(tmp_path), "train").orderBy("pid", "event_idx").collect()]
    assert got == [(1, 0, "b", 2.0, None), (1, 1, "a", None, "t"), (2, 0, "c", None, "v")]
    assert readers.read_meds(spark, str(tmp_path), zero_is_missing=False).where("code = 'a'").first()["value_num"] == 0.0
    readers.write_table(readers.read_meds(spark, str(tmp_path)), str(tmp_path / "events"), by=["pid"])
    splits = spark.createDataFrame([(1, "train"), (3, "test")], "pid long, split string")
    some = readers.read_events(spark, str(tmp_path / "events"), splits, "test", ["pid", "code"])
    assert [tuple(r) for r in some.collect()] == [(3, "d")]


def test_results_folders(spark, tmp_path):
    for task, model, value in (("t1", "m-1", 0.5), ("t1", "m-2", 0.25), ("t2", "m-1", 1.0)):
        folder = tmp_path / task / model
        folder.mkdir(parents=True)
        (folder / "all__512.csv").write_text(f'k,value,hparams\n-1,{value},"{{""lr"": {value}}}"\n')
    got = readers.read_results(spark, str(tmp_path), "k int, value double, hparams string", ["task", "model"], ["lr"]).orderBy("task", "model").collect()
    assert [(r["task"], r["model"], r["value"], r["lr"]) for r in got] == [("t1", "m-1", 0.5, "0.5"), ("t1", "m-2", 0.25, "0.25"), ("t2", "m-1", 1.0, "1.0")]
    paths = spark.createDataFrame([("/x/gpt__512__death.csv",), ("/x/val-ppl-gpt-base-200.parquet",), ("/x/other",)], "p string")
    names = [tuple(r) for r in paths.select(*(c.alias(k) for k, c in readers.name_columns(F.col("p"), ["model", "context", "task"]).items())).collect()]
    assert names[0] == ("gpt", "512", "death")
    files = [tuple(r) for r in paths.select(*(c.alias(k) for k, c in readers.score_file_columns(F.col("p")).items())).collect()]
    assert files[1:] == [("gpt-base", 200), (None, None)]


def test_small_sources_and_sinks(spark, tmp_path):
    log = spark.createDataFrame([(1, 0.5, None), (2, None, 3.0), (9, 1.0, 1.0)], "_step long, loss double, ppl double")
    assert [tuple(r) for r in readers.history(log, 2).orderBy("step").collect()] == [(1, '{"_step":1,"loss":0.5}'), (2, '{"_step":2,"ppl":3.0}')]
    (tmp_path / "c.json").write_text('{"name": "x", "metadata": null}')
    assert readers.read_config(str(tmp_path / "c.json")) == {"name": "x", "metadata": {}}
    (tmp_path / "d.json").write_text("{}")
    with pytest.raises(KeyError):
        readers.read_config(str(tmp_path / "d.json"))
    import datetime

    import numpy as np

    arrays = {"patient_ids": [4], "labeling_time": [datetime.datetime(2020, 1, 1)], "data_matrix": np.array([[1.0, 2.0]]), "label_values": [1]}
    assert readers.vectors_of(arrays, spark).first()["features"] == [1.0, 2.0]
    parts = [("one", spark.range(3)), ("two", spark.range(5))]
    assert readers.write_parts(parts, str(tmp_path / "parts")) == ["one", "two"] and readers.write_parts(parts, str(tmp_path / "parts")) == []
    readers.write_vocabulary(spark.range(2), spark.range(4), str(tmp_path / "voc"))
    assert spark.read.parquet(str(tmp_path / "voc/entries")).count() == 4
    readers.write_labels(spark.createDataFrame([(1, "a,b")], "pid long, label string"), str(tmp_path / "labels"))
    assert readers.read_csv(spark, str(tmp_path / "labels"), "pid long, label string").first()["label"] == "a,b"
    spark.createDataFrame([("x",), ("  ",), (None,)], "text string").write.parquet(str(tmp_path / "texts"))
    assert readers.read_texts(spark, str(tmp_path / "texts")).count() == 1


def test_build_steps_and_versions(spark, tmp_path):
    done = []
    manifest = catalog.Manifest(str(tmp_path / "m.json"))
    assert manifest.run("codes", lambda: done.append(1)) and not manifest.run("codes", lambda: done.append(2)) and done == [1]
    with pytest.raises(ZeroDivisionError):
        manifest.run("broken", lambda: 1 / 0)
    assert manifest.run("broken", lambda: done.append(3))
    a, known = catalog.version_dir(str(tmp_path), {"path_to_extract": "/a/extract_v8", "n": 1, "is_already_run": {"x": True}})
    assert not known and catalog.version_dir(str(tmp_path), {"n": 1, "path_to_extract": "/b/extract_v8/"}) == (a, True)
    assert catalog.version_dir(str(tmp_path), {"n": 2, "path_to_extract": "/a/extract_v8"})[0] != a
    built = []
    build = lambda: built.append(1) or spark.range(4)
    assert [catalog.cached(spark, str(tmp_path / "lengths"), build).count() for _ in range(2)] == [4, 4] and built == [1]


def test_checks_of_a_vocabulary(spark):
    catalog.check(spark.createDataFrame(ROWS, ENTRY))
    bad = [*ROWS, (4, "", "code", None, None, None, None, None, []), (5, "C", "categorical", None, None, None, [], None, []), (6, "D", "numerical_range", None, 3.0, 1.0, None, None, []), (7, "X/1", "code", None, None, None, None, None, [])]
    found = {r["problem"]: r["n"] for r in catalog.problems(spark.createDataFrame(bad, ENTRY), ["x"], counts=True).collect()}
    assert found == {"no code": 1, "no categories": 1, "no range": 1, "no count": 7, "excluded vocabulary": 1}
    with pytest.raises(ValueError, match="upside|no range"):
        catalog.check(spark.createDataFrame(bad, ENTRY))
    with pytest.raises(Exception, match="no id of token"):
        vocab.ids_of(spark.createDataFrame([("q",)], "token string"), spark.createDataFrame([("a", 7)], "token string, token_id int")).collect()


def test_lookups_that_must_hit(spark):
    df, values = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a", 1.0)], "k string, v double")
    assert sorted(r["v"] or 0 for r in results.lookup(df, "k", values, "v").collect()) == [0, 1.0]
    with pytest.raises(Exception, match="no value of b"):
        results.lookup(df, "k", values, "v", required=True).collect()
    with pytest.raises(Exception, match="more than once"):
        results.with_metrics(df, values.union(values), ["k"]).collect()


def test_streams_by_their_own_functions(spark, tmp_path):
    rows = [(i % 3, f"c{i % 2}", f"2024-01-0{1 + i % 9} 00:0{i % 6}:00") for i in range(60)]
    events = spark.createDataFrame(rows, "pid long, code string, start string").withColumn("start", F.col("start").cast("timestamp"))
    events.coalesce(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for name, make in (("weekly", streams.weekly_counts), ("sessions", streams.sessions)):
        query = make(stream).writeStream.format("memory").queryName(name).outputMode("append" if name == "sessions" else "update").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    assert spark.table("weekly").count() > 0
