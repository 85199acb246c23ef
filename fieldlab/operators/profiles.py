"""Profiles of stat lines: tiers, strength and risk of hitters, and runs that a team can expect.

Both take any table with the named columns and add columns; no shuffle. An unknown count is 0; a rate without a base is 0."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tiers from the highest down with their least value, the name below all; baselines; sample sizes.
POWER = ((0.065, "Elite power profile"), (0.045, "Strong power profile"), (0.030, "Average power profile"), (0.018, "Limited power profile")), "Low power profile"
CONTACT = ((0.300, "Elite contact profile"), (0.270, "Strong contact profile"), (0.245, "Average contact profile"), (0.220, "Below-average contact profile")), "Low contact profile"
DISCIPLINE = ((0.140, "Elite plate discipline"), (0.105, "Strong plate discipline"), (0.080, "Average plate discipline"), (0.055, "Aggressive/low-walk profile")), "Very low walk profile"
STRIKEOUTS = ((0.320, "High strikeout risk"), (0.250, "Elevated strikeout risk"), (0.180, "Average strikeout profile")), "Low strikeout profile"
PRODUCTION = ((0.185, "Elite run-production profile"), (0.150, "Strong run-production profile"), (0.115, "Average run-production profile"), (0.080, "Limited run-production profile")), "Low run-production profile"
SPEED = ((0.090, "Aggressive stolen-base profile"), (0.045, "Moderate stolen-base profile"), (0.015, "Limited stolen-base profile")), "Minimal stolen-base profile"
OPS = ((0.950, "Elite OPS tier"), (0.850, "Strong OPS tier"), (0.740, "Average OPS tier"), (0.650, "Below-average OPS tier")), "Low OPS tier"
SAMPLES = ((350, "strong"), (150, "moderate"), (50, "weak"), (1, "tiny")), "no_sample"
BASELINES = {"home_run": 0.032, "hit": 0.245, "walk": 0.086, "strikeout": 0.220, "rbi": 0.135, "total_bases": 0.360}
RISK_BASE = {"strikeout": 0.22, "hit": 0.245, "home_run": 0.032}
NO_SAMPLE = "No batting sample"
TEAM_RUNS, TEAM_OPS, HOME, AWAY = 4.4, 0.720, 1.035, 0.985


def tier(value: Column, tiers: tuple[Sequence[tuple[float, str]], str]) -> Column:
    """The name of the first tier whose least value is reached."""
    steps, below = tiers
    return reduce(lambda w, s: w.when(value >= s[0], s[1]), steps[1:], F.when(value >= steps[0][0], steps[0][1])).otherwise(below)


def _largest(named: Sequence[tuple[str, Column]]) -> Column:
    """The name of the largest; ties go to the one named first."""
    best = F.greatest(*[x for _, x in named])
    return F.coalesce(*[F.when(x == best, F.lit(n)) for n, x in named])


def hitter_profiles(lines: DataFrame) -> DataFrame:
    """lines (plate_appearances, at_bats, hits, doubles, triples, home_runs, walks, strikeouts, rbi, runs, stolen_bases) with
    sample, power, contact, discipline, strikeout, production, speed, ops, strength and risk."""
    c = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("double")
    per = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    pa, ab = c("plate_appearances"), c("at_bats")
    bases = c("hits") + c("doubles") + 2 * c("triples") + 3 * c("home_runs")
    on = c("hits") + c("walks")
    rate = {"hr": per(c("home_runs"), pa), "hit": per(c("hits"), ab), "bb": per(c("walks"), pa), "k": per(c("strikeouts"), pa), "rbi": per(c("rbi"), pa), "run": per(c("runs"), pa), "tb": per(bases, ab), "iso": per(bases - c("hits"), ab), "obp": per(on, pa), "sb": per(c("stolen_bases"), F.greatest(on, F.lit(1.0)))}
    rows = lines.withColumns({"__n": F.greatest(pa, ab), "__r": F.struct(*[v.alias(k) for k, v in rate.items()])})
    r = lambda k: F.col(f"__r.{k}")
    made = F.greatest(r("rbi"), r("run"))
    sample = tier(F.col("__n"), SAMPLES)
    found = {
        "power": tier(F.greatest(r("hr"), r("iso") / 5), POWER), "contact": tier(r("hit"), CONTACT), "discipline": tier(r("bb"), DISCIPLINE), "strikeout": tier(r("k"), STRIKEOUTS),
        "production": tier(made, PRODUCTION), "speed": tier(r("sb"), SPEED), "ops": tier(r("obp") + r("tb"), OPS),
    }
    strength = _largest([("Power", r("hr") / BASELINES["home_run"]), ("Contact", r("hit") / BASELINES["hit"]), ("Plate Discipline", r("bb") / BASELINES["walk"]), ("Run Production", made / BASELINES["rbi"]), ("Total Bases", r("tb") / BASELINES["total_bases"])])
    least = lambda x: F.greatest(x, F.lit(0.001))
    risk = _largest([("Small Sample", sample.isin("weak", "tiny").cast("double")), ("Strikeout Rate", r("k") / RISK_BASE["strikeout"]), ("Low Contact", RISK_BASE["hit"] / least(r("hit"))), ("Low Power", RISK_BASE["home_run"] / least(r("hr")))])
    none = F.col("__n") <= 0
    out = {k: F.when(none, NO_SAMPLE).otherwise(v) for k, v in found.items()} | {"strength": F.when(none, "Unavailable").otherwise(strength), "risk": F.when(none, "No usable hitting sample").otherwise(risk)}
    return rows.select(*[x for x in lines.columns if x not in {*out, "sample"}], sample.alias("sample"), *[v.alias(k) for k, v in out.items()])


def _held(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def park_factor(factor: Column) -> Column:
    """A factor, or a percentage above 10, from .75 to 1.30; 1 where unknown."""
    return F.coalesce(F.when(factor.isNotNull(), _held(F.when(factor > 10, factor / 100).otherwise(factor), 0.75, 1.30)), F.lit(1.0))


def weather_factor(temperature: Column, wind_out: Column, humidity: Column) -> Column:
    """What the weather does to runs, from .85 to 1.16; what is unknown does nothing."""
    parts = [_held((temperature - 72.0) * 0.0018, -0.055, 0.065), _held(wind_out * 0.0040, -0.075, 0.075), _held((humidity - 55.0) * -0.0004, -0.020, 0.020)]
    known = [F.when(x.isNotNull(), p).otherwise(0.0) for x, p in zip((temperature, wind_out, humidity), parts)]
    return _held(F.exp(known[0] + known[1] + known[2]), 0.85, 1.16)


def team_runs(scored: Column, allowed: Column, strength: Column, pitching: Column, park: Column, weather: Column, home: Column) -> Column:
    """Runs of a team: the geometric mean of what it scores and what the other allows (4.4 where unknown), its strength, park,
    weather, the side, and the other's pitching, from 1.2 to 10.5."""
    known = lambda x: F.greatest(F.coalesce(x, F.lit(TEAM_RUNS)), F.lit(0.1))
    base = F.sqrt(known(scored) * known(allowed)) * F.exp((strength - 1) * 0.18)
    return _held(base * park * weather * F.when(home, HOME).otherwise(AWAY) * pitching, 1.2, 10.5)
