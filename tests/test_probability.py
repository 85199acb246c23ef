"""Factors of games and rates of outcomes: code that the JVM compiles, and what is unknown is left out."""

import math
import re

import pytest

from fieldlab.plans import probability

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
@pytest.mark.parametrize("name", ["context_estimates", "outcome_rates", "plate_distribution"])
def test_code_is_short_enough_to_be_compiled(spark, capsys, name, broadcast):
    """The JVM leaves methods above 8000 bytes to its interpreter, and Spark drops code above 64 KB, which shows as no size."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        probability.QUERIES[name](spark, DATA).explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(-?\d+)", capsys.readouterr().out)]
    assert sizes and all(0 < x < 8000 for x in sizes), sizes


def test_unknown_measures_of_a_game_are_left_out(spark):
    types = "g int, pitcher_era double, pitcher_whip double, pitcher_k double, pitcher_bb double, pitcher_hr double, team_runs double, team_ops double"
    known, partly, none = (0, 5.0, 1.4, 0.25, 0.09, 0.03, 4.8, 0.75), (1, 5.0, None, 0.25, 0.09, None, None, 0.75), (2, *[None] * 7)
    found = {r.g: r for r in probability.opposing_factors(spark.createDataFrame([known, partly, none], types), ["g"]).collect()}
    columns = {o: probability.factor_columns(o) for o in probability.COUNTED}
    for g, row in ((0, known), (1, partly), (2, none)):
        values = dict(zip([x.split()[0] for x in types.split(", ")], row))
        for factor, parts, low, high in (("pitcher", probability.PITCHER_PARTS, 0.68, 1.38), ("team", probability.TEAM_PARTS, 0.72, 1.32)):
            for o in columns:
                of = [(min(max((values[m] - mean) * slope, -b), b), w) for names, m, mean, slope, b, w in parts if o in names and values[m] is not None]
                want = min(max(math.exp(sum(x * w for x, w in of) / sum(w for _, w in of)), low), high) if of else 1.0
                assert found[g][columns[o][factor]] == pytest.approx(want, abs=1e-12), (g, factor, o)


def test_unknown_surroundings_of_a_game(spark):
    types = "g int, park_factor double, home boolean, temperature double, wind_out double, humidity double, rest_days long, travel_miles long, zone_change long, slot int, platoon double"
    rows = [(0, 104.0, True, 90.0, 5.0, 40.0, 2, 900, -1, 3, 1.0), (1, 0.5, False, None, 5.0, 40.0, 0, 0, 0, 12, -1.0)]
    a, b = probability.place_factors(spark.createDataFrame(rows, types), ["g"]).orderBy("g").collect()
    assert (a.park, a.home, a.lineup, a.lineup_0, a.weather) == (1.04, 1.018, 1.025, 1.04, 1.0)
    assert a.weather_0 == pytest.approx(math.exp(0.0324 + 0.02 + 0.006)) and a.platoon_0 == pytest.approx(math.exp(-0.045))
    assert a.schedule == pytest.approx(math.exp(0.010 - math.log1p(900) / 450 - 0.008))
    assert (b.park, b.home, b.lineup, b.lineup_0, b.weather_0) == (0.75, 0.990, 0.95, 0.94, 1.0) and b.schedule == pytest.approx(math.exp(-0.025))


def test_sixth_is_six(spark):
    values = [(x,) for x in (0.0, 1e-7, 4.9999999e-7, 5e-7, 0.1234565, 0.9999995, 1 / 3, 2.0000005, 6.25, 123456.1234565)] + [(None,)]
    for r in spark.createDataFrame(values, "x double").select(probability.six("x").alias("a"), probability.sixth(probability.F.col("x")).alias("b")).collect():
        assert r.a == r.b
