"""Profiles and distributions by known values."""

import math

from pyspark.sql import functions as F

from fieldlab.functions import distributions as d
from fieldlab.operators import profiles


def test_profiles(spark):
    schema = "name string, plate_appearances long, at_bats long, hits long, doubles long, triples long, home_runs long, walks long, strikeouts long, rbi long, runs long, stolen_bases long, power string"
    rows = [("star", 600, 520, 160, 30, 2, 42, 78, 130, 112, 110, 30, "x"), ("new", 20, 18, 2, 0, 0, 0, 2, 9, 1, 1, 0, "x"), ("none", 0, None, 0, 0, 0, 0, 0, 0, 0, 0, 0, "x")]
    got = {r.name: r for r in profiles.hitter_profiles(spark.createDataFrame(rows, schema)).collect()}
    star, new, none = got["star"], got["new"], got["none"]
    assert (star["sample"], star.power, star.contact, star.discipline, star.strikeout, star.production, star.speed, star.ops) == ("strong", "Elite power profile", "Elite contact profile", "Strong plate discipline", "Average strikeout profile", "Elite run-production profile", "Aggressive stolen-base profile", "Elite OPS tier")
    assert (star.strength, star.risk, new["sample"], new.risk) == ("Power", "Strikeout Rate", "tiny", "Low Power")
    assert none["sample"] == "no_sample" and none.power == "No batting sample" and none.risk == "No usable hitting sample"


def test_team_runs(spark):
    c = lambda x: F.lit(x).cast("double")
    of = lambda **m: profiles.team_runs(*[c(m.get(k, v)) for k, v in (("scored", None), ("allowed", None), ("strength", 1), ("pitching", 1), ("park", 1), ("weather", 1))], F.lit(m.get("home", True)))
    row = spark.range(1).select(of().alias("plain"), of(home=False).alias("away"), of(scored=50, allowed=50).alias("most"), profiles.park_factor(c(130)).alias("park"), profiles.park_factor(c(None)).alias("no_park"), profiles.weather_factor(c(None), c(None), c(None)).alias("calm"), profiles.weather_factor(c(82), c(10), c(55)).alias("warm")).first()
    assert abs(row.plain - 4.4 * 1.035) < 1e-12 and abs(row.away - 4.4 * 0.985) < 1e-12 and row.most == 10.5
    assert row.park == 1.3 and row.no_park == 1 and row.calm == 1 and abs(row.warm - math.exp(0.018 + 0.04)) < 1e-12


def test_distributions(spark):
    cases = [(k, n, p) for n in (0, 1, 5, 30, 200) for k in (-1, 0, 1, 3, 29, 30, 201) for p in (0.0, 0.01, 0.3, 0.999)]
    df = spark.createDataFrame(cases, "k int, n int, p double")
    m = F.col("p") * 10
    got = df.select("k", "n", "p", d.binomial_pmf(df.k, df.n, df.p).alias("b"), d.binomial_cdf(df.k, df.n, df.p).alias("bc"), d.poisson_pmf(df.k, m).alias("q"), d.poisson_cdf(df.k, m).alias("qc"), d.negative_binomial_pmf(df.k, m, F.lit(2.5)).alias("nb"), d.at_least_one(df.p, df.n).alias("one")).collect()
    for r in got:
        p, x = min(max(r.p, 1e-12), 1 - 1e-12), r.p * 10
        mass = lambda i: math.comb(r.n, i) * p**i * (1 - p) ** (r.n - i) if 0 <= i <= r.n else 0.0  # noqa: B023, E731
        poisson = lambda i: 0.0 if i < 0 else (float(i == 0) if x <= 1e-12 else math.exp(i * math.log(x) - x - math.lgamma(i + 1)))  # noqa: B023, E731
        assert math.isclose(r.b, mass(r.k), rel_tol=1e-8, abs_tol=1e-12) and math.isclose(r.bc, 1.0 if r.k >= r.n and r.k >= 0 else sum(map(mass, range(r.k + 1))), rel_tol=1e-8, abs_tol=1e-12)
        assert math.isclose(r.q, poisson(r.k), rel_tol=1e-8, abs_tol=1e-12) and math.isclose(r.qc, min(1, sum(map(poisson, range(r.k + 1)))), rel_tol=1e-8, abs_tol=1e-12)
        want = 0.0 if r.k < 0 else float(r.k == 0) if x <= 1e-12 else math.exp(math.lgamma(r.k + 2.5) - math.lgamma(2.5) - math.lgamma(r.k + 1) + 2.5 * math.log(2.5 / (2.5 + x)) + r.k * math.log(x / (2.5 + x)))
        assert math.isclose(r.nb, want, rel_tol=1e-7, abs_tol=1e-12) and math.isclose(r.one, 1 - (1 - r.p) ** r.n, abs_tol=1e-12)
