"""The fitted preparation, drift by tree, table functions and streamed resolution."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlab.functions import tables
from fieldlab.operators import drift
from fieldlab.operators.prepare import Prepared, Preparer
from fieldlab.sources import exports
from fieldlab.streaming import feeds

ROWS = [(1.0, 10, "a"), (3.0, None, "b"), (None, 30, "a"), (float("nan"), 50, None), (8.0, 10, "c"), (8.0, 10, "c"), (8.0, 10, "c")]


def vectors(df, name="features"):
    return np.array([r[name].toArray() for r in df.orderBy("k").collect()])


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(ROWS)], "k int, x double, y long, c string")


@pytest.mark.parametrize("impute", ["zero", "constant", "mean", "median", "preserve"])
@pytest.mark.parametrize("scale", ["standard", "robust", "min_max", "none"])
def test_numbers(rows, impute, scale):
    got = vectors(Preparer(numbers=["x", "y"], impute=impute, constant=5.0, scale=scale).fit(rows).transform(rows))
    for at in (0, 1):
        v = np.array([np.nan if r[at] is None else r[at] for r in ROWS], float)
        known = v[~np.isnan(v)]
        fill = {"zero": 0, "constant": 5, "mean": known.mean(), "median": np.median(known), "preserve": np.nan}[impute]
        v = np.where(np.isnan(v), fill, v)
        held = np.sort(v[~np.isnan(v)])
        n = len(held) - 1
        center, wide = {"none": (0, 1), "standard": (held.mean(), held.std()), "min_max": (held[0], held[-1] - held[0]), "robust": (np.median(held), held[int(n * 0.75)] - held[int(n * 0.25)])}[scale]
        assert np.allclose(got[:, at], (v - center) / (wide if abs(wide) > 1e-12 else 1), equal_nan=True)


def test_categories_and_unknown_ones(spark, rows):
    later = spark.createDataFrame([(0, 1.0, "b"), (1, 1.0, "new"), (2, 1.0, None)], "k int, x double, c string")
    fit = lambda **more: Preparer(categories=["c"], **more).fit(rows)
    assert vectors(fit().transform(later)).tolist() == [[2], [-1], [-1]]  # c, a, b by count and name
    wide = fit(encode="one_hot")
    assert wide.names() == ["c=c", "c=a", "c=b"] and vectors(wide.transform(later)).tolist() == [[0, 0, 1], [0, 0, 0], [0, 0, 0]]
    hashed = vectors(fit(encode="hash", buckets=5).transform(later))
    assert hashed[2] == -1 and (hashed[:2] >= 0).all() and (hashed < 5).all()
    with pytest.raises(Exception, match="unknown category (new|null)"):
        fit(unknown="error").transform(later).collect()
    with pytest.raises(ValueError):
        fit(most=2)
    with pytest.raises(ValueError):
        Preparer(impute="best")


def test_saved_and_read(spark, rows, tmp_path):
    made = Preparer(numbers=["x", "y"], categories=["c"], impute="median", encode="one_hot", output="v")
    fitted = made.fit(rows)
    fitted.write().overwrite().save(str(tmp_path / "model"))
    fitted.write().overwrite().save(str(tmp_path / "model"))
    made.save(str(tmp_path / "estimator"))
    again = Prepared.load(str(tmp_path / "model"))
    assert again.fitted == fitted.fitted and again.settings() == fitted.settings() and again.names() == fitted.names()
    assert np.allclose(vectors(again.transform(rows), "v"), vectors(fitted.transform(rows), "v"))
    assert np.allclose(vectors(Preparer.load(str(tmp_path / "estimator")).fit(rows).transform(rows), "v"), vectors(fitted.transform(rows), "v"))
    assert made.fit(rows.limit(0)).transform(rows.limit(0)).count() == 0


def test_drift_by_tree(spark):
    r = random.Random(1)
    old = [(k if k else None, f"n{k}", r.choice([None, 1.5, 2.5])) for k in range(800)] + [(5, "again", None)]
    new = [x for x in old if x[0] not in (7, 70)] + [(900, "new", None), (901, None, None)]
    new = [(a, "other" if a in (11, None) else b, c) for a, b, c in new if (a, b) != (5, "again")]
    a, b = (spark.createDataFrame(x, "id long, name string, v double") for x in (old, new))
    trees = [drift.digest_tree(x, ["id"], depth=8) for x in (a, b.repartition(3))]
    got = {(x.id, x.change) for x in drift.changed_keys(a, b, ["id"], *trees, depth=8).collect()}
    assert got == {(7, "missing"), (70, "missing"), (900, "added"), (901, "added"), (11, "changed"), (None, "changed"), (5, "changed")}
    ranges = drift.differing_ranges(*trees, 8).count()
    assert 1 <= ranges <= 7 and drift.differing_ranges(trees[0], drift.digest_tree(a.orderBy("v"), ["id"], depth=8), 8).count() == 0
    assert trees[0].where("level = 0").first().n == len(old) and drift.changed_keys(a.limit(0), a.limit(0), ["id"], *[drift.digest_tree(a.limit(0), ["id"], depth=8)] * 2, 8).count() == 0


def test_table_functions(spark):
    tables.register(spark)
    spark.range(50).select(F.col("id").alias("place"), (F.col("id") * 2).alias("v"), (F.col("id") % 3).alias("w")).createOrReplaceTempView("placed_rows")
    for expanding in (True, False):
        got = spark.sql(f"SELECT * FROM expand_folds(TABLE(SELECT * FROM placed_rows) PARTITION BY w ORDER BY (place), 'place', 50, 20, 5, 5, 7, {expanding})").collect()
        want = set()
        for k in range((50 - 30) // 7 + 1):
            for p in range(0 if expanding else 7 * k, 30 + 7 * k):
                want.add((p, 2 * p, p % 3, k, "train" if p < 20 + 7 * k else "validation" if p < 25 + 7 * k else "test"))
        assert set(map(tuple, got)) == want and len(got) == len(want)
    long = spark.sql("SELECT * FROM expand_values(TABLE(SELECT * FROM placed_rows WHERE place < 2), 'v,w')").collect()
    assert sorted(map(tuple, long)) == [(0, "v", 0.0), (0, "w", 0.0), (1, "v", 2.0), (1, "w", 1.0)]
    with pytest.raises(Exception, match="expand_values needs"):
        spark.sql("SELECT * FROM expand_values(TABLE(placed_rows), 'nothing')").collect()
    spark.catalog.dropTempView("placed_rows")


def test_streamed_resolution(spark, tmp_path):
    day = lambda d, h=0: dt.datetime(2024, 1, 1) + dt.timedelta(days=d, hours=h)
    forecasts = [(1, 7, "hit", 0.25, day(0)), (2, 7, "walk", 0.5, day(0)), (3, 8, "hit", 0.9, day(0)), (4, 9, "hit", 0.1, day(0))]
    outcomes = [(10, 7, "hit", True, day(1)), (11, 8, "hit", False, day(1)), (12, 9, "hit", True, day(5))]
    f_schema, o_schema = "forecast_id long, player_id long, outcome string, probability double, made_at timestamp", "outcome_id long, player_id long, outcome string, happened boolean, seen_at timestamp"
    add = lambda name, rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    add("f", forecasts, f_schema), add("o", outcomes[:2], o_schema)

    def run():
        streams = [spark.readStream.schema(s).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / n)) for n, s in (("f", f_schema), ("o", o_schema))]
        feeds.resolve_stream(*streams).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.forecast_id, r.label, r.weight, r.resolved) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = run()
    assert first == [(1, 1.0, 1.75, True), (3, 0.0, 1.9, True)]
    add("f", forecasts[:3], f_schema), add("o", outcomes[:2], o_schema)  # a replayed batch
    assert run() == first
    add("f", [(99, 1, "hit", 0.5, day(20))], f_schema), add("o", [*outcomes[2:], (98, 1, "walk", True, day(20))], o_schema)
    run()
    add("f", [(100, 1, "hit", 0.5, day(21))], f_schema), add("o", [(97, 1, "walk", True, day(21))], o_schema)
    assert run() == [(1, 1.0, 1.75, True), (2, None, None, False), (3, 0.0, 1.9, True), (4, None, None, False)]  # at expiry


def test_files_of_equal_names(spark, tmp_path):
    for folder, name, text in (("x", "a", 'id,"Last, First"\n1,"Lee, ""Al"" Ann"\n'), ("y", "a", "id,v\n2,b\n3,c\n"), ("y", "b", "id,v\n,d\n"), ("y", "c", "")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / f"{name}.csv").write_text(text)
    found = {r.path.split("/", 1)[1][-7:]: (r.source_file, r.columns, r.rows_seen) for r in exports.preflight(spark, [str(tmp_path)], {"a": (["a"], ["id"])}).collect()}
    assert found == {"x/a.csv": ("a.csv", 2, 1), "y/a.csv": ("a.csv", 2, 2), "y/b.csv": ("b.csv", 2, 1)}
    rows = exports.scan_csv(spark, [str(tmp_path)], by_path=True)
    assert rows.count() == 4 and rows.where("id = 1").first()["Last, First"] == 'Lee, "Al" Ann'
    target = spark.createDataFrame([(2, "b"), (3, "old")], "id long, v string")
    expected = spark.createDataFrame([("nowhere/d.csv",)], "source_file string")
    mapping = {"id": (["id"], "int"), "v": (["v"], "text")}
    good, bad, log = exports.load_with_log(rows, mapping, ["id"], target, ["id"], expected)
    got = {r.source_file[-7:]: tuple(r)[1:] for r in log.collect()}
    assert got == {"x/a.csv": (1, 1, 0, 0, 0, "completed"), "y/a.csv": (2, 0, 1, 1, 0, "completed"), "y/b.csv": (1, 0, 0, 0, 1, "failed"), "e/d.csv": (0, 0, 0, 0, 0, "missing")}
    assert good.count() == 3 and bad.first().lacks == ["id"] and "__state" not in good.columns
