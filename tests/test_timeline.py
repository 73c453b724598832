"""Golden vectors and edge cases of the timeline operators."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from chronoline.functions import expressions as X
from chronoline.operators import evaluation, sequence, timeline, vocab
from chronoline.queries import ORACLE_SQL, QUERIES
from chronoline.schema import timelines

SF = "/root/testdata/sf0.001"
LENGTHS = [4, 4, 5, 5, 6, 7, 10, 13, 14, 14, 14, 15, 20, 22, 29, 30]


def test_batches_by_tokens(spark):
    rows = [("train", i, n) for i, n in enumerate(sorted(LENGTHS, reverse=True))]
    out = sequence.batches(spark.createDataFrame(rows, "split string, rank long, length long"), 30, 30)
    sizes = [r["count"] for r in out.groupBy("batch_idx").count().orderBy("batch_idx").collect()]
    assert sizes == [1, 1, 1, 1, 2, 2, 2, 4, 2]
    counts = [r["count"] for r in sequence.replicas(out, 2).groupBy("replica").count().orderBy("replica").collect()]
    assert counts == [4, 10]
    with pytest.raises(ValueError):
        sequence.batches(out, 10, 30)


@pytest.mark.parametrize("x", [0.0, 26.3, 28.899999618530273, 1e7, 123456789.0, -3.0, 1.7976931348623157e308, -1.7976931348623157e308, math.inf, -math.inf, 1e16, 1.5e15, 1e-4, 2.5e-4, 1e-5, -1.25e-7, 1e22])
def test_floats_read_as_in_python(spark, x):
    assert spark.range(1).select(X.py_float_str(F.lit(x))).first()[0] == repr(x)


VOCAB = [("A", "numerical_range", None, 0, -math.inf, 2.0, "A1", None), ("A", "numerical_range", None, 1, 2.0, 5.0, "A2", None), ("A", "numerical_range", None, 2, 5.0, math.inf, "A3", None), ("A", "code", None, 3, None, None, "A", None), ("B", "code", None, 4, None, None, "B", None), ("C", "categorical", None, 5, None, None, "C || x", ["x"]), ("C", "code", None, 6, None, None, "C", None), ("U", "numerical_range", "mg", 7, 0.0, 9.0, "U1", None), ("U", "code", None, 8, None, None, "U", None)]


@pytest.mark.parametrize("mode,event,token", [("ignore", ("A", 2.0, None, None), "A1"), ("ignore", ("A", 5.5, None, None), "A3"), ("ignore", ("A", None, None, None), "A"), ("ignore", ("B", 3.0, None, None), "B"), ("ignore", ("C", None, "x", None), "C || x"), ("ignore", ("C", None, "y", None), None), ("ignore", ("C", None, "", None), "C"), ("ignore", ("Z", 1.0, None, None), None), ("strict", ("U", 3.0, None, "g"), None), ("strict", ("U", 3.0, None, "mg"), "U1"), ("strict", ("A", 2.0, None, None), None), ("ignore", ("A", math.nan, None, None), None)])
def test_event_to_token(spark, mode, event, token):
    v = spark.createDataFrame(VOCAB, "code string, type string, unit string, entry_idx int, range_start double, range_end double, token string, categories array<string>")
    e = spark.createDataFrame([event], "code string, value_num double, value_str string, unit string")
    assert vocab.tokenize(e, v, mode).first()["token"] == token


def visits(spark, rows, **flags):
    day = 86400
    data = [(1, i, v, s * day, None if t is None else t * day, name) for i, (v, s, t, name) in enumerate(rows)]
    df = spark.createDataFrame(data, "pid long, event_idx int, is_visit boolean, start long, end long, token string").withColumns({"start": F.timestamp_seconds("start"), "end": F.timestamp_seconds("end")})
    return [r["token"] for r in vocab.visit_tokens(df, **flags).orderBy("pos").collect()]


def test_visits(spark):
    rows = [(True, 0, 2, "V1"), (False, 1, None, "e"), (False, 5, None, "f"), (True, 9, 10, "V2")]
    assert visits(spark, rows, days=False) == ["[VISIT START]", "V1", "e", "[VISIT END]", "f", "[WEEK 1]", "[VISIT START]", "V2", "[VISIT END]"]
    assert visits(spark, rows) == ["[VISIT START]", "V1", "e", "[VISIT END]", "f", "[DAY 7]", "[VISIT START]", "V2", "[VISIT END]"]
    assert visits(spark, [(True, 0, 2, "a"), (True, 2, 3, "b")], days=False)[3] == "[DAY 6]"
    assert visits(spark, [(True, 3, 3, "a")]) == []
    assert visits(spark, [(True, 0, 5, "a"), (True, 1, 6, "b")]) == ["[VISIT START]", "a", "[VISIT END]", "[VISIT START]", "b", "[VISIT END]"]


def test_longest_repeat(spark):
    rows = [(1, i, c) for i, c in enumerate("abcabcab")] + [(2, 0, "x")] + [(3, i, "z") for i in range(4)]
    out = {r["pid"]: (r["length"], r["start_idx"]) for r in timeline.longest_repeat(spark.createDataFrame(rows, "pid long, event_idx int, code string")).collect()}
    assert out == {1: (5, 0), 2: (0, 0), 3: (3, 0)}


def test_quartiles_refuse_heavy_ties(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(9)] + [(9, 2.0)], "pid long, value double")
    with pytest.raises(Exception, match="unique"):
        timeline.quartiles(df, "value").collect()


def test_student_tail():
    assert evaluation.student_tail(-2.0, 10) == pytest.approx(0.036694017385370196, rel=1e-9)
    assert evaluation.student_tail(-0.5, 3.3) == pytest.approx(0.3243, abs=2e-3)


def test_streams_equal_batches(spark, tmp_path):
    from chronoline.schema import timelines
    from chronoline.streaming import streams

    e = timelines(spark, "/root/testdata/sf0.001").select("pid", "code", "start")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streams.event_stream(spark, str(tmp_path / "in"), e.schema.simpleString()[7:-1].replace(":", " "))
    counted = stream.groupBy(F.window("start", "7 days"), "code").count().select(F.col("window.start").alias("week"), "code", F.col("count").alias("n"))
    q = counted.writeStream.outputMode("complete").format("memory").queryName("weekly").start()
    q.processAllAvailable()
    q.stop()
    batch = e.groupBy(F.window("start", "7 days"), "code").count().select(F.col("window.start").alias("week"), "code", F.col("count").alias("n"))
    assert sorted(map(tuple, spark.table("weekly").collect())) == sorted(map(tuple, batch.collect()))


def test_longest_repeat_reads_whole_timelines(spark):
    codes = {}
    for r in timelines(spark, SF).select("pid", "event_idx", "code").orderBy("pid", "event_idx").collect():
        codes.setdefault(r["pid"], []).append(r["code"])
    codes = {k: codes[k] for k in sorted(codes)[:40]}
    expected = {}
    for pid, c in codes.items():
        best = (0, 0)
        for i in range(len(c)):
            for j in range(i + 1, len(c)):
                n = 0
                while j + n < len(c) and c[i + n] == c[j + n]:
                    n += 1
                best = max(best, (n, -i))
        expected[pid] = (best[0], -best[1])
    got = {r["pid"]: (r["length"], r["start_idx"]) for r in QUERIES["longest_repeat"](spark, SF).collect() if r["pid"] in codes}
    assert max(map(len, codes.values())) > 40 and got == expected


def batches_by_rule(lengths, max_tokens, context, max_examples, mult):
    """The greedy fold written anew: sizes of the batches."""
    out, held = [], []
    for n in lengths:
        n = min(n, context)
        while held and (len(held) + 1) * max([*held, n]) > max_tokens:
            keep = max(1, len(held) // mult * mult)
            out.append(held[:keep])
            held = held[keep:]
        held.append(n)
        if len(held) == max_examples:
            out.append(held)
            held = []
    return [len(b) for b in [*out, held] if b]


@pytest.mark.parametrize("mult,most", [(1, 99), (4, 99), (2, 5), (3, 2)])
def test_batches_with_multiples(spark, mult, most):
    rows = [("train", i, n) for i, n in enumerate(sorted(LENGTHS * 3, reverse=True))]
    df = spark.createDataFrame(rows, "split string, rank long, length long")
    out = sequence.batches(df, 60, 30, most, mult)
    sizes = [r["count"] for r in out.groupBy("batch_idx").count().orderBy("batch_idx").collect()]
    assert sizes == batches_by_rule([r[2] for r in rows], 60, 30, most, mult)
    assert max(sizes) <= most and all((n % mult == 0 or n < mult or n == most) for n in sizes[:-1])
    late = sequence.batches(df, 60, 30, most, mult, start=len(sizes) - 1).count()
    assert late == sizes[-1] and (most < 99 or sequence.batches(df, 60, 30, most, mult, start=10**6).count() >= 1)


def test_loader(spark):
    rows = [(i, 5 + i * 37 % 90) for i in range(300)]
    df = spark.createDataFrame(rows, "pid long, length long")
    train = sequence.loader(df, "train", 400, 100, 16).orderBy("rank").collect()
    plain = sequence.loader(df, "val", 400, 100, 16).orderBy("rank").collect()
    assert sorted(r["pid"] for r in train) == sorted(r["pid"] for r in plain) == list(range(300)) and [r["rank"] for r in train] == list(range(300))
    assert [r["length"] for r in plain] == sorted((n for _, n in rows), reverse=True) and [r["length"] for r in train] != [r["length"] for r in plain]
    assert sequence.accumulation(16_384) == 4
    with pytest.raises(ValueError):
        sequence.accumulation(10_000)


def test_visits_of_the_other_variant(spark):
    rows = [(True, 0, 2, "a"), (False, 1, None, "e"), (True, 3, 3, "z"), (False, 4, None, "f"), (True, 9, 12, "b"), (False, 10, None, "g")]
    assert visits(spark, rows, close_on_visit_only=True) == ["a", "e", "[VISIT END]", "[DAY 1]", "z", "[VISIT END]", "f", "[DAY 6]", "b", "g"]
    with pytest.raises(Exception, match="before the end"):
        visits(spark, [(True, 0, 5, "a"), (True, 1, 6, "b")], close_on_visit_only=True)


def test_one_death_a_patient(spark):
    a = spark.createDataFrame([(1, "2020-01-01", "2020-01-09")], "pid long, start string, end string")
    dead = lambda *t: spark.createDataFrame([(1, x) for x in t], "pid long, death string")
    assert [r["label"] for r in timeline.in_hospital_mortality(a, dead("2020-01-05", "2020-01-05")).collect()] == [True]
    with pytest.raises(Exception, match="more than one death"):
        timeline.in_hospital_mortality(a, dead("2020-01-05", "2020-02-05")).collect()


def test_exact_join_fails_where_times_differ(spark):
    f = spark.createDataFrame([(1, 10, 0.5)], "pid long, time long, value double")
    at = lambda t: spark.createDataFrame([(1, t)], "pid long, label_time long")
    assert timeline.asof_join(f, at(10), exact=True).first()["value"] == 0.5
    with pytest.raises(Exception, match="no feature"):
        timeline.asof_join(f, at(11), exact=True).collect()


def test_equal_best_values_give_the_first_key(spark, tmp_path):
    rows = [(7, 1, 5.0), (3, 1, 9.0), (4, 1, 9.0), (9, 1, 9.0), (None, 1, 9.0), (1, 2, None), (2, 2, 1.0), (5, 3, None)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double")
    orders.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    con.execute(f"set threads = 1; create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    expected = sorted(con.execute(ORACLE_SQL["max_checkpoint"]).fetchall())
    assert sorted(map(tuple, QUERIES["max_checkpoint"](spark, str(tmp_path)).collect())) == expected == [(1, 9.0, 3), (2, 1.0, 2), (3, None, None)]
