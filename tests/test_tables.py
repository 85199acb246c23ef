"""Operators on small tables (a file name of its own, so that both test folders can be collected): merges, sources, history frames, streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fieldlab.operators.history import History, exponential_mean, with_history
from fieldlab.operators.merge import classify, deactivate_absent, upsert
from fieldlab.sources import exports
from fieldlab.sources.shared import with_position
from fieldlab.streaming import feeds


def test_merge_classes_and_idempotence(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 1.0), (3, "c", 2.0)], "id int, name string, x double")
    new = spark.createDataFrame([(1, "a", None), (2, "z", 1.0), (4, "d", 3.0)], "id int, name string, x double")
    got = {r.id: (r.action, r.changed) for r in classify(old, new, ["id"]).collect()}
    assert got == {1: ("unchanged", []), 2: ("updated", ["name"]), 3: ("absent", []), 4: ("created", [])}
    once = upsert(old, new, ["id"])
    assert sorted(map(tuple, upsert(once, new, ["id"]).collect()), key=str) == sorted(map(tuple, once.collect()), key=str)
    assert {r.id: r.is_active for r in deactivate_absent(old, new, ["id"]).collect()} == {1: True, 2: True, 3: False}


def test_ties_do_not_leak(spark):
    rows = [(1, 1, 1, 5), (1, 2, 2, 7), (1, 2, 3, 9), (1, 3, 4, 1)]
    log = spark.createDataFrame(rows, "e int, t int, k int, x int")
    h = History("e", "t", "k")
    got = {r.k: (r.s, r.m) for r in with_history(log, {"s": h.last(2, F.sum("x")), "m": h.last(None, F.max("x"))}, h).collect()}
    assert got == {1: (None, None), 2: (5, 5), 3: (5, 5), 4: (16, 9)}


def test_exponential_mean(spark):
    xs, a = [3.0, 1.0, 4.0], 1 - 0.5 ** (1 / 3)
    want = xs[0]
    for x in xs[1:]:
        want = want * (1 - a) + x * a
    row = spark.createDataFrame([(xs,), ([],)], "x array<double>").select(exponential_mean(F.col("x"), 3).alias("m")).collect()
    assert row[0].m == pytest.approx(want, abs=1e-12) and row[1].m is None


def test_positions_are_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(5)
    got = with_position(df, ["v"], "p").collect()
    assert len(got) == 1000 and all(r.p == r.v for r in got)


def test_csv_scan_and_types(spark, tmp_path):
    (tmp_path / "exit_velocity.csv").write_text('﻿Name,Hard Hit %,PA,\nAda,45%,"1,200",x\nBo,n/a,--,y\n', encoding="utf-8")
    rows = exports.scan_csv(spark, [str(tmp_path)])
    assert rows.columns == ["Name", "Hard Hit %", "PA", "source_file"]
    got = exports.typed_load(rows, {"name": (["player", "name"], "text"), "rate": (["hard_hit_%"], "rate"), "pa": (["pa"], "int")}).orderBy("name").collect()
    assert [(r.name, r.rate, r.pa) for r in got] == [("Ada", 0.45, 1200), ("Bo", None, None)]
    best = exports.classify_files(spark, [str(tmp_path)], {"exit": (["exit_velocity"], ["pa"]), "tempo": (["tempo"], [])}).first()
    assert (best.category, best.score, best.rows_seen, best.confidence) == ("exit", 110, 2, "high")


def test_upsert_stream(spark, tmp_path):
    for k, rows in enumerate(([(1, "a"), (2, "b")], [(2, "c"), (3, "d")])):
        spark.createDataFrame(rows, "id int, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("id int, v string").parquet(str(tmp_path / "in"))
        feeds.upsert_feed(stream, str(tmp_path / "out"), ["id"], str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(map(tuple, feeds.read_feed(spark, str(tmp_path / "out")).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    fresh = spark.createDataFrame([(3, "a", 9), (3, "z", 1)], "id int, v string, at int")
    assert {r.id: r.v for r in upsert(spark.createDataFrame([(3, "q")], "id int, v string"), fresh, ["id"], ["at"]).collect()} == {3: "a"}


def test_conversation_stream(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [(1, 0, at(0), "x", False), (1, 1, at(1), None, False), (1, 2, at(30), None, False), (2, 0, at(0), "y", False), (2, 1, at(1), None, True)]
    spark.createDataFrame(rows, "conv_id long, turn long, ts timestamp, entity string, reset boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("conv_id long, turn long, ts timestamp, entity string, reset boolean").parquet(str(tmp_path / "in"))
    out = feeds.carry_entities(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    out.awaitTermination(90)
    got = sorted((r.conv_id, r.turn, r.entity) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, 0, "x"), (1, 1, "x"), (1, 2, None), (2, 0, "y"), (2, 1, None)]


def test_upsert_keeps_what_the_source_lacks(spark):
    old = spark.createDataFrame([(1, "a", 5, True), (None, "n", 6, False)], "id int, name string, x int, is_active boolean")
    new = spark.createDataFrame([(1, "b"), (None, "m"), (7, "c")], "id int, name string")
    assert sorted(map(tuple, upsert(old, new, ["id"]).collect()), key=str) == sorted([(1, "b", 5, True), (None, "m", 6, False), (7, "c", None, None)], key=str)
    assert {r.id: r.action for r in classify(old, new, ["id"]).collect()} == {1: "updated", None: "updated", 7: "created"}
    assert {r.id: r.is_active for r in deactivate_absent(old, new.where("id is not null"), ["id"]).collect()} == {1: True, None: False}
    assert {r.id: r.is_active for r in deactivate_absent(old, new, ["id"]).collect()} == {1: True, None: False}


def test_csv_files_of_three_headers(spark, tmp_path):
    (tmp_path / "percentile_rankings_2024.csv").write_text("player_id,player_name,xwoba,xba\n1,Ada,90,80\n,Bo,1,2\n")
    (tmp_path / "pitch_tempo.csv").write_text("name,id,total_pitches\nCy,3,10\n")
    (tmp_path / "other.csv").write_text("xba,player_name\n7,Di\n")
    rows = exports.scan_csv(spark, [str(tmp_path)])
    got = {r.source_file: r for r in rows.where("coalesce(player_name, name) <> 'Bo'").collect()}
    assert (got["pitch_tempo.csv"].id, got["pitch_tempo.csv"]["name"], got["other.csv"].xba, got["other.csv"].player_name) == ("3", "Cy", "7", "Di")
    rules = {"percentiles": (["percentile_rankings"], ["xwoba", "xba"]), "tempo": (["pitch_tempo", "tempo"], ["total_pitches"])}
    found = {r.source_file: r for r in exports.preflight(spark, [str(tmp_path)], rules).collect()}
    assert {k: (r.category, r.rows_seen, r.columns) for k, r in found.items()} == {"percentile_rankings_2024.csv": ("percentiles", 2, 4), "pitch_tempo.csv": ("tempo", 1, 3), "other.csv": ("percentiles", 1, 2)}
    assert found["percentile_rankings_2024.csv"].score == 240 and found["percentile_rankings_2024.csv"].gap == 240 and found["other.csv"].confidence == "low"
    good, bad, log = exports.load_with_log(rows, exports.METRIC_TABLES["percentiles"], ["player_id"])
    assert [(r.player_id, r.name, r.xwoba) for r in good.where("name = 'Ada'").collect()] == [(1, "Ada", 90)]
    assert {r.source_file: (r.rows_seen, r.rows_inserted, r.rows_skipped, r.status) for r in log.collect()} == {"percentile_rankings_2024.csv": (2, 1, 1, "completed"), "pitch_tempo.csv": (1, 1, 0, "completed"), "other.csv": (1, 0, 1, "failed")}
    assert {tuple(r.lacks) for r in bad.collect()} == {("player_id",)}
    for name, mapping in exports.METRIC_TABLES.items():
        assert exports.typed_load(rows, mapping).columns == [*mapping, "raw_json"], name


def test_late_records(spark):
    rows = spark.createDataFrame([(1, dt.datetime(2024, 1, 1)), (2, dt.datetime(2024, 2, 1)), (3, None)], "id int, ts timestamp")
    as_of = F.lit(dt.datetime(2024, 2, 1))
    kept, late = feeds.split_late(rows, as_of, "warn")
    assert {r.id for r in kept.collect()} == {1, 3} and [(r.id, r.warning) for r in late.collect()] == [(2, True)]
    with pytest.raises(ValueError):
        feeds.split_late(rows, as_of, "error")


def test_feedback_stream(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    spark.createDataFrame([(at(5), "a", 1.0), (at(20), "a", 3.0), (at(70), "b", 5.0)], "ts timestamp, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    feeds.feedback_metrics(stream).writeStream.outputMode("complete").format("memory").queryName("feedback").trigger(availableNow=True).start().awaitTermination(90)
    assert sorted((r.event_type, r.n, r["mean"]) for r in spark.table("feedback").collect()) == [("a", 2, 2.0), ("b", 1, 5.0)]


def test_tasks_grow_with_the_rows(spark, monkeypatch):
    """Features, splits and reports over more tasks than the session's partitions where a task's rows ask for them, with the same rows."""
    from fieldlab.plans import training
    from fieldlab.sources import shared

    data = "/root/testdata/sf0.001"
    names = ("feature_table", "quality_report", "robust_scale")
    plain = {name: sorted(map(tuple, training.QUERIES[name](spark, data).collect())) for name in names}
    monkeypatch.setattr(shared, "ROWS", 100)
    found = training.QUERIES["feature_table"](spark, data)
    assert found.rdd.getNumPartitions() == -(-len(plain["feature_table"]) // 100) > 4
    assert {name: sorted(map(tuple, training.QUERIES[name](spark, data).collect())) for name in names} == plain


def test_folds_are_expanded_where_rows_lie(spark, monkeypatch):
    """As many tasks as the rows ask for expand them, not one for each team that has rows."""
    from fieldlab.plans import artifacts
    from fieldlab.sources import shared

    monkeypatch.setattr(shared, "ROWS", 100)
    assert artifacts.fold_expansion(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 4
