"""Probabilities of outcomes: base, recent and tracking rates, distributions, context factors, estimates of players and
teams. Operators take a table of profiles (one row a player); a measure that a profile lacks is null and is left out.

The SQL that the queries are held against is written out by hand, not made from the expressions here."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlab.operators.profiles import park_factor, team_runs, weather_factor
from fieldlab.sources.tables import GAME_LOG_SQL, game_log

# fixed values: league means of the outcomes, and the range that a rate is held to
PRIORS = {
    "hit": 0.245, "single": 0.150, "double": 0.045, "triple": 0.004, "home_run": 0.032, "walk": 0.083, "strikeout": 0.225,
    "rbi": 0.110, "run": 0.115, "reach_base": 0.325, "extra_base_hit": 0.081, "total_bases": 0.325,
}
BOUNDS = {
    "hit": (0.040, 0.500), "single": (0.020, 0.360), "double": (0.002, 0.160), "triple": (0.0002, 0.050), "home_run": (0.001, 0.220),
    "walk": (0.010, 0.300), "strikeout": (0.025, 0.550), "rbi": (0.015, 0.400), "run": (0.015, 0.400), "reach_base": (0.080, 0.650),
    "extra_base_hit": (0.005, 0.300), "total_bases": (0.030, 0.700),
}
STRENGTH, RECENT_STRENGTH, TEAM_RUNS, OPPORTUNITIES, Z = 120.0, 35.0, 4.40, 4.2, 1.959964
SAMPLE_WEIGHTS = [(600, 0.90), (500, 0.88), (350, 0.82), (150, 0.68), (50, 0.45), (1, 0.25)]
SLOTS = [1.045, 1.035, 1.025, 1.020, 1.005, 0.990, 0.975, 0.960, 0.950]
RBI_SLOTS = [0.96, 0.99, 1.04, 1.07, 1.04, 1.01, 0.98, 0.96, 0.94]
FACTOR_WEIGHTS = {"park": 1.0, "pitcher": 1.0, "team": 0.75, "home": 0.55, "weather": 0.70, "schedule": 0.50, "lineup": 0.65, "platoon": 0.70}


def six(x: Column | str) -> Column:
    """Rounded to six places; what lies on the edge between two goes up, in every engine."""
    return F.round((F.col(x) if isinstance(x, str) else x) + 1e-10, 6)


def sixth(x: Column) -> Column:
    """six for positive values below a billion, in doubles alone: round goes by way of decimal numbers, at about a microsecond
    a value."""
    return F.rint((x + 1e-10) * 1e6) / 1e6


def held(x: Column, low: float, high: float) -> Column:
    """x in a range; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def within(name: str, low: float, high: float) -> Column:
    """held for a column: short code, which names the column three times."""
    x = F.col(name)
    return F.when(x < low, low).when(x > high, high).otherwise(x)


def part(x: Column) -> Column:
    """A rate: above 1 and up to 100 is a percentage."""
    return F.when((x > 1) & (x <= 100), x / 100).otherwise(x)


def mean_of(parts: list[tuple[Column, float]]) -> Column:
    """Weighted mean of the parts that are known; null without any."""
    total = reduce(lambda a, b: a + b, [F.when(x.isNotNull(), F.lit(w)).otherwise(0.0) for x, w in parts])
    value = reduce(lambda a, b: a + b, [F.coalesce(x * w, F.lit(0.0)) for x, w in parts])
    return F.try_divide(value, total)


def logit(p: Column) -> Column:
    q = held(p, 1e-12, 1 - 1e-12)
    return F.log(q / (1 - q))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


#: What an outcome's successes and trials are counted by, and its successes in the last ten games.
COUNTED = {
    "hit": ("hits", "at_bats", "recent_hits"), "single": ("hits - (doubles + triples + home_runs)", "at_bats", None), "double": ("doubles", "at_bats", None), "triple": ("triples", "at_bats", None),
    "home_run": ("home_runs", "plate_appearances", "recent_home_runs"), "walk": ("walks", "plate_appearances", "recent_walks"), "strikeout": ("strikeouts", "plate_appearances", "recent_strikeouts"), "rbi": ("rbi", "plate_appearances", None),
    "run": ("runs", "plate_appearances", None), "extra_base_hit": ("doubles + triples + home_runs", "at_bats", None), "reach_base": ("hits + walks", "plate_appearances", None), "total_bases": ("total_bases", "plate_appearances", None),
}


MEASURES = ("xba", "barrel_rate", "hard_hit_rate", "xslg", "xwoba")
#: What base rates need of the measures; bounded parts of the measures: the part, its rate's slope and mean, bounds.
KEPT = ["_xba", "_barrel", "_hard", "_slg", "recent_pa"]
BOUNDED = {
    "_barrel": ("barrel_rate", 0.42, 0.0, 0.002, 0.180), "_hard": ("hard_hit_rate", 0.13, 0.20, 0.002, 0.120), "_slg": ("xslg", 0.10, 0.250, 0.002, 0.150),
    "_barrel_alone": ("barrel_rate", 0.42, 0.0, 0.002, 0.20), "_hard_alone": ("hard_hit_rate", 0.16, 0.18, 0.002, 0.20), "_homers": ("xslg", 0.10, 0.250, 0.002, 0.18),
    "_slug": ("xslg", 1.0, 0.0, 0.05, 0.80), "_woba": ("xwoba", 1.0, 0.0, 0.10, 0.60),
}
#: outcome: what tracking measures alone say of it; nothing of the others
TRACKED = {"hit": "_xba", "home_run": "_power_homers", "extra_base_hit": "_power_slug", "total_bases": "_power_slug", "reach_base": "_woba"}


def tracked(profiles: DataFrame, keep: list[str]) -> DataFrame:
    """keep, KEPT and the columns of TRACKED, once a profile. Each step's values are columns of the next, so that no step's
    code holds another's."""
    c, counts = F.col, [x for x in keep if x not in KEPT] + ["recent_pa"]
    parts = profiles.select(*counts, *[part(c(m)).alias(m) for m in MEASURES])
    raw = parts.select(*counts, c("xba").alias("_xba"), *[((c(m) - mean) * slope).alias(k) for k, (m, slope, mean, _, _) in BOUNDED.items()])
    held_ = raw.select(*counts, "_xba", *[within(k, low, high).alias(k) for k, (*_, low, high) in BOUNDED.items()])
    power = lambda k: mean_of([(c("_barrel_alone"), 0.45), (c("_hard_alone"), 0.25), (c(k), 0.30)])
    mixed = held_.select(*counts, *KEPT[:-1], "_woba", power("_homers").alias("_power_homers"), power("_slug").alias("_power_slug"))
    return mixed.select(*counts, *KEPT[:-1], *[within(k, 0.0, 1.0).alias(f"_tracked{k}") for k in dict.fromkeys(TRACKED.values())])


def counted_outcomes(profiles: DataFrame, keep: list[str]) -> DataFrame:
    """A row for each profile and outcome: seen, of (trials), lately, what tracking says, the prior and the bounds of the outcome;
    and KEPT. Counts come first and rates after, so that no row has twelve rates' code at once."""
    prior, low, high = (F.create_map(*[x for k in COUNTED for x in (F.lit(k), F.lit(float(v(k))))]) for v in (PRIORS.get, lambda k: BOUNDS[k][0], lambda k: BOUNDS[k][1]))
    counts = ["plate_appearances", "at_bats", "walks", "hits", "doubles", "triples", "home_runs", "strikeouts", "rbi", "runs", "total_bases", "recent_hits", "recent_home_runs", "recent_walks", "recent_strikeouts"]
    whole = lambda e: F.expr(e or "NULL").cast("double")
    said = lambda k: F.col(f"_tracked{TRACKED[k]}") if k in TRACKED else F.lit(None).cast("double")
    rows = F.array(*[F.struct(F.lit(k).alias("outcome"), whole(s).alias("seen"), whole(n).alias("of"), whole(r).alias("lately"), said(k).alias("tracking")) for k, (s, n, r) in COUNTED.items()])
    found = tracked(profiles, list(dict.fromkeys([*keep, *counts])))
    long = found.select(*keep, *KEPT, F.explode(rows).alias("x")).select(*keep, *KEPT, "x.*")
    return long.withColumns({"_prior": prior[F.col("outcome")], "_low": low[F.col("outcome")], "_high": high[F.col("outcome")]})


def _bounded(x: Column) -> Column:
    return F.least(F.greatest(x, F.col("_low")), F.col("_high"))


def _posterior(seen: Column, of: Column, strength: float) -> Column:
    n = F.greatest(of, F.lit(0))
    return _bounded((F.col("_prior") * strength + F.least(F.greatest(seen, F.lit(0)), n)) / (strength + n))


def base_rate() -> Column:
    """The rate of a counted outcome, and of its tracking measures where they are known."""
    c, is_ = F.col, (lambda k: F.col("outcome") == k)
    hit = F.when(c("_xba").isNotNull(), logistic(0.78 * logit(c("_rate")) + 0.22 * logit(c("_xba")))).otherwise(c("_rate"))
    homer = mean_of([(c("_rate"), 0.72), (c("_barrel"), 0.16), (c("_hard"), 0.07), (c("_slg"), 0.05)])
    bases = F.when(c("of") > 0, c("seen") / c("of")).otherwise(c("_prior"))
    return F.when(is_("hit"), hit).when(is_("home_run"), homer).when(is_("total_bases"), bases).otherwise(c("_rate"))


def outcome_table(profiles: DataFrame, keep: list[str]) -> DataFrame:
    """keep, outcome, base, recent, tracking and their blend by log-odds (1, 0.20, 0.18), a row for each of the twelve."""
    long = counted_outcomes(profiles, keep).withColumn("_rate", _posterior(F.col("seen"), F.col("of"), STRENGTH))
    lately = F.when(F.col("lately").isNotNull() & (F.col("recent_pa") > 0), _posterior(F.col("lately"), F.col("recent_pa"), RECENT_STRENGTH))
    long = long.select(*keep, "outcome", "_low", "_high", base_rate().cast("double").alias("_base"), lately.alias("recent"), "tracking")
    long = long.select(*keep, "outcome", _bounded(F.col("_base")).alias("base"), "recent", "tracking")
    blend = logistic(mean_of([(logit(F.col("base")), 1.0), (logit(F.col("recent")), 0.20), (logit(F.col("tracking")), 0.18)]))
    return long.withColumn("blended", blend)


def profiles(log: DataFrame) -> DataFrame:
    """One row a player: career counts, the last ten games, and tracking measures that stand on them."""
    latest = Window.partitionBy("player_id").orderBy(F.desc("game_date"), F.desc("game_id"))
    bases = F.col("hits") + F.col("doubles") + 2 * F.col("triples") + 3 * F.col("home_runs")
    rows = log.withColumns({"back": F.row_number().over(latest), "total_bases": bases})
    counts = ["plate_appearances", "at_bats", "walks", "hits", "doubles", "triples", "home_runs", "strikeouts", "rbi", "runs", "total_bases"]
    late = lambda name, c: F.sum(F.when(F.col("back") <= 10, F.col(c))).alias(name)
    found = rows.groupBy("player_id").agg(
        F.count(F.lit(1)).alias("games"), F.max_by("team_id", F.struct("game_date", "game_id")).alias("team_id"), *[F.sum(c).alias(c) for c in counts],
        late("recent_pa", "plate_appearances"), late("recent_ab", "at_bats"), late("recent_hits", "hits"), late("recent_home_runs", "home_runs"),
        late("recent_walks", "walks"), late("recent_strikeouts", "strikeouts"), late("recent_bases", "total_bases"),
    )
    rate = lambda a, b: F.try_divide(a, b)
    c = F.col
    single = c("hits") - c("doubles") - c("triples") - c("home_runs")
    return found.withColumns({
        "xba": rate(c("recent_hits"), c("recent_ab")), "xslg": rate(c("recent_bases"), c("recent_ab")),
        "barrel_rate": rate(c("triples") + c("home_runs"), c("hits")), "hard_hit_rate": rate(c("doubles") + c("triples") + c("home_runs"), c("hits")),
        "xwoba": rate(0.69 * c("walks") + 0.89 * single + 1.27 * c("doubles") + 1.62 * c("triples") + 2.1 * c("home_runs"), c("plate_appearances")),
    })


def outcome_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve outcomes of every player: base, recent-form and tracking rates and their blend."""
    rows = outcome_table(profiles(game_log(spark, sf_dir)), ["player_id"])
    return rows.select("player_id", "outcome", *[six(c).alias(c) for c in ("base", "recent", "tracking", "blended")])


def plate_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the seven ways that a plate appearance ends, expected bases, chance to get on base, entropy in bits."""
    names = ["single", "double", "triple", "home_run", "walk", "strikeout"]
    rates = outcome_table(profiles(game_log(spark, sf_dir)), ["player_id"]).where(F.col("outcome").isin(names))
    rows = rates.groupBy("player_id").agg(*[F.max(F.when(F.col("outcome") == k, F.col("base"))).alias(k) for k in names])
    rows = rows.select("player_id", F.array(*names).alias("p"))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    rows = rows.withColumn("p", F.array_append("p", F.greatest(1 - total(F.col("p")), F.lit(0.01))))
    rows = rows.withColumn("p", F.transform("p", lambda x: x / total(F.col("p"))))
    at = lambda k: F.get("p", F.lit(k))
    return rows.select(
        "player_id",
        *[six(at(k)).alias(n) for k, n in enumerate([*names, "other_out"])],
        six(at(0) + 2 * at(1) + 3 * at(2) + 4 * at(3)).alias("expected_bases"),
        six(at(0) + at(1) + at(2) + at(3) + at(4)).alias("on_base"),
        six(total(F.transform("p", lambda x: -x * F.log2(x)))).alias("entropy"),
    )


# --- context


def game_context(log: DataFrame) -> DataFrame:
    """A game's surroundings, from its own keys: what the tables lack is a fixed function of them."""
    k = F.col("game_id")
    return log.select(
        "player_id", "game_id", "team_id", (F.col("home_away") == "home").alias("home"),
        (0.85 + F.col("team_id") * 0.015).alias("park_factor"), (3.0 + k % 7 * 0.4).alias("pitcher_era"), (1.0 + k % 11 * 0.05).alias("pitcher_whip"),
        (0.15 + k % 13 * 0.012).alias("pitcher_k"), (0.06 + k % 5 * 0.01).alias("pitcher_bb"), (0.02 + k % 3 * 0.01).alias("pitcher_hr"),
        (50.0 + k % 45).alias("temperature"), (k % 21 - 10.0).alias("wind_out"), (30.0 + k % 60).alias("humidity"), (k % 4).alias("rest_days"),
        (k % 2000).alias("travel_miles"), (k % 4 - 1).alias("zone_change"), (k % 9 + 1).cast("int").alias("slot"),
        F.when((F.col("pitcher_throws") == "L") == (F.col("player_id") % 2 == 0), 1.0).otherwise(-1.0).alias("platoon"),
        (3.6 + F.col("team_id") * 0.06).alias("team_runs"), (0.66 + F.col("team_id") * 0.005).alias("team_ops"),
    )


_BATTED = ("hit", "single", "double", "triple", "home_run", "rbi", "run", "total_bases")
#: Parts of the pitcher's and the team's factor: outcomes, measure, its mean, slope and bound, weight.
PITCHER_PARTS = [
    (_BATTED, "pitcher_era", 4.20, 0.045, 0.22, 0.28), (("hit", "walk", "rbi", "run", "reach_base"), "pitcher_whip", 1.28, 0.24, 0.20, 0.24),
    (("strikeout",), "pitcher_k", 0.225, 1.80, 0.30, 0.32), (("hit", "home_run", "total_bases"), "pitcher_k", 0.225, -0.80, 0.16, 0.20),
    (("walk", "reach_base", "run"), "pitcher_bb", 0.083, 1.50, 0.18, 0.20), (("home_run",), "pitcher_hr", 0.032, 3.50, 0.20, 0.25),
]
TEAM_PARTS = [(("rbi", "run"), "team_runs", 4.40, 0.055, 0.20, 0.35), (("hit", "home_run", "total_bases", "rbi", "run"), "team_ops", 0.720, 0.75, 0.16, 0.25)]
WEATHERED = ("hit", "double", "triple", "home_run", "rbi", "run", "total_bases")


def _parts_of(outcome: str, parts: list[tuple]) -> tuple[int, ...]:
    return tuple(i for i, x in enumerate(parts) if outcome in x[0])


def factor_columns(outcome: str) -> dict[str, str]:
    """The columns of game_factors that hold an outcome's eight factors. Outcomes with the same parts have the same column."""
    name = lambda factor, parts: "_".join([factor, *map(str, _parts_of(outcome, parts))])
    return {
        "park": "park", "pitcher": name("pitcher", PITCHER_PARTS), "team": name("team", TEAM_PARTS), "home": "home", "weather": "weather_0" if outcome in WEATHERED else "weather",
        "schedule": "schedule", "lineup": "lineup_0" if outcome == "rbi" else "lineup", "platoon": "platoon_0" if outcome == "strikeout" else "platoon",
    }


#: What place_factors needs of a game's surroundings.
PLACE = ["park_factor", "home", "temperature", "wind_out", "humidity", "rest_days", "travel_miles", "zone_change", "slot", "platoon"]


def opposing_factors(context: DataFrame, keep: list[str]) -> DataFrame:
    """keep, and the factors of pitcher and team of all outcomes (factor_columns), once a game and not once an outcome. Each
    step's values are columns of the next, so that no step's code holds another's."""
    split = {"pitcher": PITCHER_PARTS, "team": TEAM_PARTS}
    bounds = {f"_{f}_{i}": x[4] for f, parts in split.items() for i, x in enumerate(parts)}
    raw = context.select(*keep, *[((F.col(m) - mean) * slope).alias(f"_{f}_{i}") for f, parts in split.items() for i, (_, m, mean, slope, _, _) in enumerate(parts)])
    scaled = raw.select(*keep, *[within(k, -b, b).alias(k) for k, b in bounds.items()])
    named = {factor_columns(o)[f]: (f, _parts_of(o, parts)) for o in COUNTED for f, parts in split.items()}
    sums = {k: F.exp(mean_of([(F.col(f"_{f}_{i}"), split[f][i][5]) for i in of])) if of else F.lit(1.0) for k, (f, of) in named.items()}
    limits = {"pitcher": (0.68, 1.38), "team": (0.72, 1.32)}
    return scaled.select(*keep, *[x.alias(k) for k, x in sums.items()]).select(*keep, *[F.coalesce(within(k, *limits[f]), F.lit(1.0)).alias(k) for k, (f, _) in named.items()])


def place_factors(context: DataFrame, keep: list[str]) -> DataFrame:
    """keep, and the other six factors (factor_columns), by the same steps."""
    c = F.col
    slot = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), F.least(F.greatest(c("slot"), F.lit(1)), F.lit(9)))
    straight = {"home": F.when(c("home"), 1.018).otherwise(0.990), "lineup": slot(SLOTS), "lineup_0": slot(RBI_SLOTS)}
    raw = context.select(
        *keep, *[x.alias(k) for k, x in straight.items()], ((c("temperature") - 72) * 0.0018).alias("_warm"), (c("wind_out") * 0.004).alias("_wind"), ((c("humidity") - 55) * -0.0004).alias("_humid"),
        (F.log1p(F.greatest(c("travel_miles"), F.lit(0))) / 450).alias("_miles"), (F.abs("zone_change") * 0.008).alias("_zones"),
        F.when(c("park_factor") > 10, c("park_factor") / 100).otherwise(c("park_factor")).alias("park"),
        F.when(c("rest_days") <= 0, -0.025).when(c("rest_days") >= 2, 0.010).otherwise(0.0).alias("_rest"), "platoon",
    )
    bounds = {"_warm": (-0.055, 0.065), "_wind": (-0.075, 0.075), "_humid": (-0.02, 0.02), "_miles": (0.0, 0.025), "_zones": (0.0, 0.030), "park": (0.75, 1.30)}
    scaled = raw.select(*keep, *straight, "_rest", "platoon", *[within(k, *b).alias(k) for k, b in bounds.items()])
    sums = {"weather_0": c("_warm") + c("_wind") + c("_humid"), "schedule": c("_rest") - (c("_miles") + c("_zones")), "platoon": c("platoon") * 0.06, "platoon_0": c("platoon") * -0.045}
    return scaled.select(*keep, *straight, "park", *[F.exp(x).alias(k) for k, x in sums.items()]).select(
        *keep, *straight, "park", F.lit(1.0).alias("weather"), F.coalesce(within("weather_0", 0.85, 1.16), F.lit(1.0)).alias("weather_0"), within("schedule", 0.90, 1.08).alias("schedule"),
        *[within(k, 0.90, 1.10).alias(k) for k in ("platoon", "platoon_0")],
    )


def context_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each game and outcome: the eight factors, and the player's blended rate after them by log-odds, for one plate
    appearance and for the game. Players' rates, a row each, are joined to their games, so a shuffle on the player is all; a
    game's factors, their rounded forms and their logarithms are made once and dealt to its twelve outcomes."""
    log = game_log(spark, sf_dir)
    rates = outcome_table(profiles(log), ["player_id", "games", "plate_appearances"]).withColumn("odds", logit(F.col("blended")))
    n = F.least(F.greatest(F.col("plate_appearances") / F.col("games"), F.lit(1.0)), F.lit(7.0))
    players = rates.groupBy("player_id", "games", "plate_appearances").agg(*[F.max(F.when(F.col("outcome") == k, F.col("odds"))).alias(k) for k in COUNTED])
    players = players.select("player_id", n.alias("n"), F.array(*COUNTED).alias("odds"))
    games = opposing_factors(game_context(log), ["player_id", "game_id", *PLACE])
    opposing = [x for x in games.columns if x not in {"player_id", "game_id", *PLACE}]
    games = place_factors(games.join(players, "player_id"), ["player_id", "game_id", "n", "odds", *opposing])
    made = games.columns[4:]
    weight = lambda k: FACTOR_WEIGHTS[k.split("_")[0]]
    factors = games.select("player_id", "game_id", "n", "odds", *[sixth(F.col(k)).alias(k) for k in made], *[(F.log(k) * weight(k)).alias(f"ln_{k}") for k in made])
    same = [f for f in FACTOR_WEIGHTS if len({factor_columns(o)[f] for o in COUNTED}) == 1]
    own = [f for f in FACTOR_WEIGHTS if f not in same]
    cells = F.array(*[
        F.struct(F.lit(o).alias("outcome"), F.get("odds", F.lit(i)).alias("odds"), *[F.col(p + factor_columns(o)[f]).alias(p + f) for f in own for p in ("", "ln_")])
        for i, o in enumerate(COUNTED)
    ])
    rows = factors.select("player_id", "game_id", "n", *same, *[f"ln_{f}" for f in same], F.explode(cells).alias("x"))
    at = lambda f, p="": F.col(p + f if f in same else f"x.{p}{f}")
    delta = reduce(lambda a, b: a + b, [at(f, "ln_") for f in FACTOR_WEIGHTS])
    rows = rows.select("player_id", "game_id", "x.outcome", "n", *[at(f).alias(f) for f in FACTOR_WEIGHTS], logistic(F.col("x.odds") + delta).alias("p"))
    rows = rows.withColumn("p", held(F.col("p"), 0.0001, 0.9999))
    return rows.select(
        "player_id", "game_id", "outcome", *FACTOR_WEIGHTS, sixth(F.col("p")).alias("p"),
        sixth(1 - F.pow(1 - F.col("p"), F.col("n"))).alias("game_p"), sixth(F.col("p") * F.col("n")).alias("expected"),
        sixth(F.col("n") * F.col("p") * (1 - F.col("p"))).alias("variance"),
    )


def expected_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that each team can expect at home against the next team by number, and away: the geometric mean of what it
    scores and what the other allows, its strength, the park and the weather of the place (fixed functions of the home team's
    number, for the tables have neither), and the other side's pitching."""
    log = game_log(spark, sf_dir)
    teams = log.groupBy("team_id").agg((F.sum("runs") / F.count(F.lit(1)) * 2).alias("scored"), (F.sum("rbi") / F.count(F.lit(1)) * 2).alias("allowed"), (F.sum("hits") / F.sum("at_bats") * 2).alias("ops"))
    away = teams.select((F.col("team_id") - 1).alias("team_id"), F.col("team_id").alias("opponent_id"), F.col("allowed").alias("other_allowed"))
    rows = teams.join(away, "team_id")
    strength = held(mean_of([(F.col("scored") / TEAM_RUNS, 0.45), (F.col("ops") / 0.720, 0.30)]), 0.65, 1.45)
    pitching = held(F.col("other_allowed") / TEAM_RUNS, 0.72, 1.35)

    def runs(home: bool) -> Column:
        place = F.col("team_id") if home else F.col("opponent_id")
        park = park_factor((85 + place * 2).cast("double"))
        weather = weather_factor((50 + place * 2).cast("double"), (place % 11 - 5).cast("double"), F.when(place % 3 > 0, 40 + place).cast("double"))
        return six(team_runs(F.col("scored"), F.col("other_allowed"), strength, pitching, park, weather, F.lit(home)))

    return rows.select("team_id", "opponent_id", six(strength).alias("strength"), runs(True).alias("home_runs"), runs(False).alias("away_runs"))


# --- the workbench


_SINGLES = "(hits - doubles - triples - home_runs)"
_RATES = {
    "hit_per_ab": ("hits", "at_bats"), "single_per_ab": (_SINGLES, "at_bats"), "double_per_ab": ("doubles", "at_bats"), "triple_per_ab": ("triples", "at_bats"),
    "hr_per_ab": ("home_runs", "at_bats"), "hr_per_pa": ("home_runs", "plate_appearances"), "hit_per_pa": ("hits", "plate_appearances"),
    "bb_per_pa": ("walks", "plate_appearances"), "k_per_pa": ("strikeouts", "plate_appearances"), "k_per_ab": ("strikeouts", "at_bats"),
    "rbi_per_pa": ("rbi", "plate_appearances"), "run_per_pa": ("runs", "plate_appearances"), "tb_per_ab": ("total_bases", "at_bats"),
    "tb_per_pa": ("total_bases", "plate_appearances"), "xbh_per_pa": ("(doubles + triples + home_runs)", "plate_appearances"),
    "xbh_per_hit": ("(doubles + triples + home_runs)", "hits"), "times_on_base_per_pa": ("(hits + walks)", "plate_appearances"),
    "bb_per_k": ("walks", "strikeouts"), "iso": ("(total_bases - hits)", "at_bats"), "hr_per_hit": ("home_runs", "hits"),
}
#: outcome of the workbench: the observed rate that it stands on
BENCH = {
    "home_run": "hr_per_pa", "hit": "hit_per_ab", "single": "single_per_ab", "double": "double_per_ab", "triple": "triple_per_ab", "walk": "bb_per_pa",
    "strikeout": "k_per_pa", "rbi": "rbi_per_pa", "run": "run_per_pa", "total_bases": "tb_per_ab", "extra_base_hit": "xbh_per_pa", "reach_base": "times_on_base_per_pa",
}


def _observed(name: str) -> Column:
    num, den = _RATES[name]
    return six(F.coalesce(F.try_divide(F.expr(num), F.expr(den)), F.lit(0.0)))


def observed_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty observed rates of every player, a row each; 0 without a denominator."""
    rows = profiles(game_log(spark, sf_dir)).select("player_id", *[_observed(k).alias(k) for k in _RATES])
    return rows.unpivot("player_id", list(_RATES), "rate", "value")


def workbench(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each player and outcome: the observed rate weighted by sample against the league's, held to the outcome's range; its
    interval (Wilson, sample + 120), the chance in a game, the expected count and a band of confidence. Players without
    a sample get a twentieth of the league's rate."""
    log = profiles(game_log(spark, sf_dir))
    sample = F.greatest("plate_appearances", "at_bats")
    cells = F.array(*[
        F.struct(F.lit(k).alias("outcome"), _observed(r).alias("observed"), F.lit(PRIORS[k]).alias("baseline"), F.lit(BOUNDS[k][0]).alias("low"), F.lit(BOUNDS[k][1]).alias("high"))
        for k, r in BENCH.items()
    ])
    rows = log.select("player_id", sample.alias("sample"), F.explode(cells).alias("x")).select("player_id", "sample", "x.*")
    weight = reduce(lambda w, step: w.when(F.col("sample") >= step[0], step[1]), SAMPLE_WEIGHTS[1:], F.when(F.col("sample") >= SAMPLE_WEIGHTS[0][0], SAMPLE_WEIGHTS[0][1])).otherwise(0.0)
    raw = F.when(F.col("sample") > 0, F.col("observed") * weight + F.col("baseline") * (1 - weight)).otherwise(F.col("baseline") * 0.05)
    rows = rows.withColumns({"weight": weight, "p": F.least(F.greatest(raw, "low"), F.col("high"))})
    n, p, z2 = F.col("sample") + STRENGTH, F.col("p"), Z * Z
    middle = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    score = 30 + 38 * (1 - F.exp(-F.col("sample") / 260))
    return rows.select(
        "player_id", "outcome", "observed", "weight", six("p").alias("p"), six(held(middle - half, 0.0, 1.0)).alias("lower"),
        six(held(middle + half, 0.0, 1.0)).alias("upper"), six(1 - F.pow(1 - p, F.lit(OPPORTUNITIES))).alias("game_p"), six(p * OPPORTUNITIES).alias("expected"),
        F.when(score >= 85, "very_high").when(score >= 70, "high").when(score >= 52, "moderate").otherwise("low").alias("band"),
    )


def count_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a player's next four plate appearances (binomial), home runs of the next game (Poisson), walks before the
    third strikeout (negative binomial), and the bases of a game (normal): masses, sums and tails."""
    rows = profiles(game_log(spark, sf_dir)).where("plate_appearances > 0")
    rows = rows.select("player_id", (F.col("hits") / F.col("plate_appearances")).alias("p"), (F.col("home_runs") / F.col("games")).alias("rate"),
        (F.col("total_bases") / F.col("games")).alias("mean"), ((F.col("strikeouts") + 1) / (F.col("strikeouts") + F.col("walks") + 2)).alias("q"))
    p, rate, q = F.col("p"), F.col("rate"), F.col("q")
    choose = [1, 4, 6, 4, 1]
    binomial = [choose[k] * F.pow(p, F.lit(k)) * F.pow(1 - p, F.lit(4 - k)) for k in range(5)]
    poisson = [F.exp(-rate) * F.pow(rate, F.lit(k)) / f for k, f in ((0, 1), (1, 1), (2, 2))]
    negative = [w * F.pow(q, F.lit(3)) * F.pow(1 - q, F.lit(k)) for k, w in ((0, 1), (1, 3), (2, 6))]  # (k + 2 over k)
    x = (F.lit(4.0) - F.col("mean")) / F.sqrt(F.col("mean") + 1)
    t = 1 / (1 + 0.2316419 * F.abs(x))
    density = F.exp(-x * x / 2) / (2 * F.pi()) ** 0.5
    tail = density * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    total = lambda xs: reduce(lambda a, b: a + b, xs)
    return rows.select(
        "player_id", six(binomial[1]).alias("one_hit"), six(total(binomial[:3])).alias("two_hits_at_most"), six(poisson[1]).alias("one_homer"),
        six(total(poisson)).alias("two_homers_at_most"), six(1 - poisson[0]).alias("a_homer"), six(total(negative)).alias("two_walks_at_most"),
        six(density).alias("normal_density"), six(F.when(x >= 0, 1 - tail).otherwise(tail)).alias("normal_below"),
    )


QUERIES = {f.__name__: f for f in (outcome_rates, plate_distribution, context_estimates, expected_runs, observed_rates, workbench, count_distributions)}

_PROFILE = f"""WITH {GAME_LOG_SQL}, numbered AS (SELECT *, hits + doubles + 2 * triples + 3 * home_runs AS tb, row_number() OVER (PARTITION BY player_id ORDER BY game_date DESC, game_id DESC) AS back FROM log),
    s AS (SELECT player_id, count(*) AS games, sum(plate_appearances)::DOUBLE AS pa, sum(at_bats)::DOUBLE AS ab, sum(walks)::DOUBLE AS bb, sum(hits)::DOUBLE AS h, sum(doubles)::DOUBLE AS d2, sum(triples)::DOUBLE AS d3,
        sum(home_runs)::DOUBLE AS hr, sum(strikeouts)::DOUBLE AS k, sum(rbi)::DOUBLE AS rbi, sum(runs)::DOUBLE AS runs, sum(tb)::DOUBLE AS tb, sum(plate_appearances) FILTER (back <= 10)::DOUBLE AS rpa,
        sum(at_bats) FILTER (back <= 10)::DOUBLE AS rab, sum(hits) FILTER (back <= 10)::DOUBLE AS rh, sum(home_runs) FILTER (back <= 10)::DOUBLE AS rhr, sum(walks) FILTER (back <= 10)::DOUBLE AS rbb,
        sum(strikeouts) FILTER (back <= 10)::DOUBLE AS rk, sum(tb) FILTER (back <= 10)::DOUBLE AS rtb FROM numbered GROUP BY 1),
    m AS (SELECT *, rh / nullif(rab, 0) AS xba, CASE WHEN rtb / nullif(rab, 0) > 1 THEN rtb / nullif(rab, 0) / 100 ELSE rtb / nullif(rab, 0) END AS xslg, (d3 + hr) / nullif(h, 0) AS barrel, (d2 + d3 + hr) / nullif(h, 0) AS hard,
        (0.69e0 * bb + 0.89e0 * (h - d2 - d3 - hr) + 1.27e0 * d2 + 1.62e0 * d3 + 2.1e0 * hr) / nullif(pa, 0) AS raw_woba FROM s),
    w AS (SELECT *, CASE WHEN raw_woba > 1 THEN raw_woba / 100 ELSE raw_woba END AS xwoba FROM m)"""
_BASE = """b0 AS (SELECT *, least(greatest((29.4e0 + least(h, ab)) / (120 + ab), 0.04), 0.5) AS hit0, least(greatest((3.84e0 + least(hr, pa)) / (120 + pa), 0.001), 0.22) AS hr0 FROM w),
    b AS (SELECT *, least(greatest(CASE WHEN xba IS NULL THEN hit0 ELSE 1 / (1 + exp(-(0.78e0 * ln(hit0 / (1 - hit0)) + 0.22e0 * ln(greatest(least(xba, 1 - 1e-12), 1e-12) / (1 - greatest(least(xba, 1 - 1e-12), 1e-12)))))) END, 0.04), 0.5) AS r_hit,
        least(greatest((18e0 + greatest(least(h - d2 - d3 - hr, ab), 0)) / (120 + ab), 0.02), 0.36) AS r_single, least(greatest((5.4e0 + least(d2, ab)) / (120 + ab), 0.002), 0.16) AS r_double,
        least(greatest((0.48e0 + least(d3, ab)) / (120 + ab), 0.0002), 0.05) AS r_triple,
        least(greatest((0.72e0 * hr0 + CASE WHEN barrel IS NULL THEN 0 ELSE 0.16e0 * least(greatest(barrel * 0.42e0, 0.002), 0.18) + 0.07e0 * least(greatest((hard - 0.2e0) * 0.13e0, 0.002), 0.12) END
            + coalesce(CASE WHEN xslg IS NOT NULL THEN 0.05e0 * least(greatest((xslg - 0.25e0) * 0.1e0, 0.002), 0.15) END, 0))
            / (0.72e0 + CASE WHEN barrel IS NULL THEN 0 ELSE 0.23e0 END + CASE WHEN xslg IS NULL THEN 0 ELSE 0.05e0 END), 0.001), 0.22) AS r_home_run,
        least(greatest((9.96e0 + least(bb, pa)) / (120 + pa), 0.01), 0.3) AS r_walk, least(greatest((27e0 + least(k, pa)) / (120 + pa), 0.025), 0.55) AS r_strikeout,
        least(greatest((13.2e0 + least(rbi, pa)) / (120 + pa), 0.015), 0.4) AS r_rbi, least(greatest((13.8e0 + least(runs, pa)) / (120 + pa), 0.015), 0.4) AS r_run,
        least(greatest((9.72e0 + least(d2 + d3 + hr, ab)) / (120 + ab), 0.005), 0.3) AS r_extra_base_hit, least(greatest((39e0 + least(h + bb, pa)) / (120 + pa), 0.08), 0.65) AS r_reach_base,
        least(greatest(CASE WHEN pa > 0 THEN tb / pa ELSE 0.325 END, 0.03), 0.7) AS r_total_bases FROM b0)"""
_LONG = """t AS (SELECT *, CASE WHEN barrel IS NOT NULL THEN 0.45e0 * least(greatest(barrel * 0.42e0, 0.002), 0.2) + 0.25e0 * least(greatest((hard - 0.18e0) * 0.16e0, 0.002), 0.2) END AS power FROM b),
    cells AS (SELECT player_id, games, pa, unnest([
        {'outcome': 'hit', 'base': r_hit, 'recent': CASE WHEN rpa > 0 THEN least(greatest((8.575e0 + least(rh, rpa)) / (35 + rpa), 0.04), 0.5) END, 'tracking': xba},
        {'outcome': 'single', 'base': r_single, 'recent': NULL::DOUBLE, 'tracking': NULL::DOUBLE}, {'outcome': 'double', 'base': r_double, 'recent': NULL::DOUBLE, 'tracking': NULL::DOUBLE},
        {'outcome': 'triple', 'base': r_triple, 'recent': NULL::DOUBLE, 'tracking': NULL::DOUBLE},
        {'outcome': 'home_run', 'base': r_home_run, 'recent': CASE WHEN rpa > 0 THEN least(greatest((1.12e0 + least(rhr, rpa)) / (35 + rpa), 0.001), 0.22) END,
         'tracking': CASE WHEN xslg IS NULL THEN power / 0.7e0 ELSE (coalesce(power, 0) + 0.3e0 * least(greatest((xslg - 0.25e0) * 0.1e0, 0.002), 0.18)) / (CASE WHEN power IS NULL THEN 0.3e0 ELSE 1e0 END) END},
        {'outcome': 'walk', 'base': r_walk, 'recent': CASE WHEN rpa > 0 THEN least(greatest((2.905e0 + least(rbb, rpa)) / (35 + rpa), 0.01), 0.3) END, 'tracking': NULL::DOUBLE},
        {'outcome': 'strikeout', 'base': r_strikeout, 'recent': CASE WHEN rpa > 0 THEN least(greatest((7.875e0 + least(rk, rpa)) / (35 + rpa), 0.025), 0.55) END, 'tracking': NULL::DOUBLE},
        {'outcome': 'rbi', 'base': r_rbi, 'recent': NULL::DOUBLE, 'tracking': NULL::DOUBLE}, {'outcome': 'run', 'base': r_run, 'recent': NULL::DOUBLE, 'tracking': NULL::DOUBLE},
        {'outcome': 'extra_base_hit', 'base': r_extra_base_hit, 'recent': NULL::DOUBLE, 'tracking': CASE WHEN xslg IS NULL THEN power / 0.7e0 ELSE (coalesce(power, 0) + 0.3e0 * least(greatest(xslg, 0.05), 0.8)) / (CASE WHEN power IS NULL THEN 0.3e0 ELSE 1e0 END) END},
        {'outcome': 'reach_base', 'base': r_reach_base, 'recent': NULL::DOUBLE, 'tracking': CASE WHEN xwoba IS NOT NULL THEN least(greatest(xwoba, 0.1), 0.6) END},
        {'outcome': 'total_bases', 'base': r_total_bases, 'recent': NULL::DOUBLE, 'tracking': CASE WHEN xslg IS NULL THEN power / 0.7e0 ELSE (coalesce(power, 0) + 0.3e0 * least(greatest(xslg, 0.05), 0.8)) / (CASE WHEN power IS NULL THEN 0.3e0 ELSE 1e0 END) END}
        ], recursive := true) FROM t),
    o AS (SELECT *, least(greatest(recent, 1e-12), 1 - 1e-12) AS rq, CASE WHEN tracking IS NOT NULL THEN least(greatest(tracking, 1e-12), 1 - 1e-12) END AS tq FROM cells),
    rated AS (SELECT player_id, games, pa, outcome, base, recent, tracking, 1 / (1 + exp(-(ln(base / (1 - base)) + CASE WHEN recent IS NULL THEN 0 ELSE 0.2e0 * ln(rq / (1 - rq)) END + CASE WHEN tracking IS NULL THEN 0 ELSE 0.18e0 * ln(tq / (1 - tq)) END)
        / (1e0 + CASE WHEN recent IS NULL THEN 0 ELSE 0.2e0 END + CASE WHEN tracking IS NULL THEN 0 ELSE 0.18e0 END))) AS blended FROM o)"""
_CONTEXT = """c AS (SELECT player_id, game_id, home_away = 'home' AS home, 0.85e0 + team_id * 0.015e0 AS pf, 3e0 + game_id % 7 * 0.4e0 AS era, 1e0 + game_id % 11 * 0.05e0 AS whip, 0.15e0 + game_id % 13 * 0.012e0 AS pk,
        0.06e0 + game_id % 5 * 0.01e0 AS pbb, 0.02e0 + game_id % 3 * 0.01e0 AS phr, 50e0 + game_id % 45 AS temp, game_id % 21 - 10e0 AS wind, 30e0 + game_id % 60 AS hum, game_id % 4 AS rest, game_id % 2000 AS miles, game_id % 4 - 1 AS zone,
        (game_id % 9 + 1)::INT AS slot, CASE WHEN (pitcher_throws = 'L') = (player_id % 2 = 0) THEN 1e0 ELSE -1e0 END AS plat, 3.6e0 + team_id * 0.06e0 AS tr, 0.66e0 + team_id * 0.005e0 AS ops FROM log),
    d AS (SELECT c.*, outcome, blended, least(greatest(pa / games, 1), 7) AS n, least(greatest((era - 4.2e0) * 0.045e0, -0.22), 0.22) AS x1, least(greatest((whip - 1.28e0) * 0.24e0, -0.2), 0.2) AS x2,
        least(greatest((pk - 0.225e0) * 1.8e0, -0.3), 0.3) AS x3, least(greatest((0.225e0 - pk) * 0.8e0, -0.16), 0.16) AS x4, least(greatest((pbb - 0.083e0) * 1.5e0, -0.18), 0.18) AS x5,
        least(greatest((phr - 0.032e0) * 3.5e0, -0.2), 0.2) AS x6, least(greatest((tr - 4.4e0) * 0.055e0, -0.2), 0.2) AS y1, least(greatest((ops - 0.72e0) * 0.75e0, -0.16), 0.16) AS y2 FROM c JOIN rated USING (player_id)),
    f AS (SELECT *, least(greatest(pf, 0.75), 1.3) AS park,
        least(greatest(exp(CASE outcome WHEN 'hit' THEN (0.28e0 * x1 + 0.24e0 * x2 + 0.2e0 * x4) / 0.72e0 WHEN 'single' THEN x1 WHEN 'double' THEN x1 WHEN 'triple' THEN x1
            WHEN 'home_run' THEN (0.28e0 * x1 + 0.2e0 * x4 + 0.25e0 * x6) / 0.73e0 WHEN 'rbi' THEN (0.28e0 * x1 + 0.24e0 * x2) / 0.52e0 WHEN 'run' THEN (0.28e0 * x1 + 0.24e0 * x2 + 0.2e0 * x5) / 0.72e0
            WHEN 'total_bases' THEN (0.28e0 * x1 + 0.2e0 * x4) / 0.48e0 WHEN 'walk' THEN (0.24e0 * x2 + 0.2e0 * x5) / 0.44e0 WHEN 'reach_base' THEN (0.24e0 * x2 + 0.2e0 * x5) / 0.44e0 WHEN 'strikeout' THEN x3 ELSE 0 END), 0.68), 1.38) AS pitcher,
        least(greatest(exp(CASE WHEN outcome IN ('rbi', 'run') THEN (0.35e0 * y1 + 0.25e0 * y2) / 0.6e0 WHEN outcome IN ('hit', 'home_run', 'total_bases') THEN y2 ELSE 0 END), 0.72), 1.32) AS team,
        CASE WHEN home THEN 1.018e0 ELSE 0.99e0 END AS homef,
        CASE WHEN outcome IN ('hit', 'double', 'triple', 'home_run', 'rbi', 'run', 'total_bases') THEN least(greatest(exp(least(greatest((temp - 72) * 0.0018e0, -0.055), 0.065) + least(greatest(wind * 0.004e0, -0.075), 0.075)
            + least(greatest((hum - 55) * -0.0004e0, -0.02), 0.02)), 0.85), 1.16) ELSE 1e0 END AS weather,
        least(greatest(exp((CASE WHEN rest <= 0 THEN -0.025e0 WHEN rest >= 2 THEN 0.01e0 ELSE 0 END) - least(ln(1 + miles) / 450, 0.025) - least(abs(zone) * 0.008e0, 0.03)), 0.9), 1.08) AS schedule,
        (CASE WHEN outcome = 'rbi' THEN [0.96e0, 0.99e0, 1.04e0, 1.07e0, 1.04e0, 1.01e0, 0.98e0, 0.96e0, 0.94e0] ELSE [1.045e0, 1.035e0, 1.025e0, 1.02e0, 1.005e0, 0.99e0, 0.975e0, 0.96e0, 0.95e0] END)[slot] AS lineup,
        least(greatest(exp(plat * CASE WHEN outcome = 'strikeout' THEN -0.045e0 ELSE 0.06e0 END), 0.9), 1.1) AS platoon FROM d),
    g AS (SELECT *, least(greatest(1 / (1 + exp(-(ln(blended / (1 - blended)) + ln(park) + ln(pitcher) + 0.75e0 * ln(team) + 0.55e0 * ln(homef) + 0.7e0 * ln(weather) + 0.5e0 * ln(schedule) + 0.65e0 * ln(lineup) + 0.7e0 * ln(platoon)))), 0.0001), 0.9999) AS p FROM f)"""
_OBSERVED = {k: f"round(coalesce(({n.replace('home_runs', 'hr').replace('total_bases', 'tb').replace('doubles', 'd2').replace('triples', 'd3').replace('walks', 'bb').replace('hits', 'h').replace('strikeouts', 'k')}) / nullif({d.replace('plate_appearances', 'pa').replace('at_bats', 'ab').replace('strikeouts', 'k').replace('hits', 'h')}, 0), 0) + 1e-10, 6)" for k, (n, d) in _RATES.items()}
ORACLE_SQL = {
    "outcome_rates": f"{_PROFILE}, {_BASE}, {_LONG} SELECT player_id, outcome, round(base + 1e-10, 6) AS base, round(recent + 1e-10, 6) AS recent, round(tracking + 1e-10, 6) AS tracking, round(blended + 1e-10, 6) AS blended FROM rated",
    "plate_distribution": f"""{_PROFILE}, {_BASE}, q AS (SELECT *, greatest(1 - (r_single + r_double + r_triple + r_home_run + r_walk + r_strikeout), 0.01) AS other FROM b),
        z AS (SELECT *, r_single + r_double + r_triple + r_home_run + r_walk + r_strikeout + other AS total FROM q),
        n AS (SELECT player_id, r_single / total AS s1, r_double / total AS s2, r_triple / total AS s3, r_home_run / total AS s4, r_walk / total AS s5, r_strikeout / total AS s6, other / total AS s7 FROM z)
        SELECT player_id, round(s1 + 1e-10, 6) AS single, round(s2 + 1e-10, 6) AS double, round(s3 + 1e-10, 6) AS triple, round(s4 + 1e-10, 6) AS home_run, round(s5 + 1e-10, 6) AS walk, round(s6 + 1e-10, 6) AS strikeout, round(s7 + 1e-10, 6) AS other_out,
        round(s1 + 2 * s2 + 3 * s3 + 4 * s4 + 1e-10, 6) AS expected_bases, round(s1 + s2 + s3 + s4 + s5 + 1e-10, 6) AS on_base,
        round(-(s1 * log2(s1) + s2 * log2(s2) + s3 * log2(s3) + s4 * log2(s4) + s5 * log2(s5) + s6 * log2(s6) + s7 * log2(s7)) + 1e-10, 6) AS entropy FROM n""",
    "context_estimates": f"""{_PROFILE}, {_BASE}, {_LONG}, {_CONTEXT} SELECT player_id, game_id, outcome, round(park + 1e-10, 6) AS park, round(pitcher + 1e-10, 6) AS pitcher, round(team + 1e-10, 6) AS team, round(homef + 1e-10, 6) AS home, round(weather + 1e-10, 6) AS weather,
        round(schedule + 1e-10, 6) AS schedule, round(lineup + 1e-10, 6) AS lineup, round(platoon + 1e-10, 6) AS platoon, round(p + 1e-10, 6) AS p, round(1 - pow(1 - p, n) + 1e-10, 6) AS game_p, round(p * n + 1e-10, 6) AS expected, round(n * p * (1 - p) + 1e-10, 6) AS variance FROM g""",
    "expected_runs": f"""WITH {GAME_LOG_SQL}, t AS (SELECT team_id, sum(runs) * 2e0 / count(*) AS scored, sum(rbi) * 2e0 / count(*) AS allowed, sum(hits) * 2e0 / sum(at_bats) AS ops FROM log GROUP BY 1),
        x AS (SELECT a.team_id, b.team_id AS opponent_id, a.scored, b.allowed, least(greatest((0.45e0 * a.scored / 4.4e0 + 0.3e0 * a.ops / 0.72e0) / 0.75e0, 0.65), 1.45) AS strength FROM t a JOIN t b ON b.team_id = a.team_id + 1),
        y AS (SELECT *, sqrt(greatest(scored, 0.1e0) * greatest(allowed, 0.1e0)) * exp((strength - 1) * 0.18e0) * least(greatest(allowed / 4.4e0, 0.72), 1.35) AS base FROM x),
        z AS (SELECT *, unnest([team_id, opponent_id]) AS place, unnest([1.035e0, 0.985e0]) AS side FROM y),
        w AS (SELECT *, least(greatest((85 + place * 2) / 100e0, 0.75), 1.3) AS park, least(greatest(exp(least(greatest((place * 2 - 22) * 0.0018e0, -0.055), 0.065) + least(greatest((place % 11 - 5) * 0.004e0, -0.075), 0.075) + CASE WHEN place % 3 > 0 THEN least(greatest((place - 15) * -0.0004e0, -0.02), 0.02) ELSE 0 END), 0.85), 1.16) AS weather FROM z),
        v AS (SELECT *, least(greatest(base * side * park * weather, 1.2), 10.5) AS runs FROM w)
        SELECT team_id, opponent_id, round(strength + 1e-10, 6) AS strength, round(max(runs) FILTER (side > 1) + 1e-10, 6) AS home_runs, round(max(runs) FILTER (side < 1) + 1e-10, 6) AS away_runs FROM v GROUP BY ALL""",
    "observed_rates": f"{_PROFILE}, r AS (SELECT player_id, {', '.join(f'{v} AS {k}' for k, v in _OBSERVED.items())} FROM w) UNPIVOT r ON {', '.join(_RATES)} INTO NAME rate VALUE value",
    "workbench": f"""{_PROFILE}, e AS (SELECT player_id, greatest(pa, ab) AS n, unnest([{', '.join(f"{{'outcome': '{k}', 'observed': {_OBSERVED[r]}, 'baseline': {PRIORS[k]}::DOUBLE, 'lo': {BOUNDS[k][0]}::DOUBLE, 'hi': {BOUNDS[k][1]}::DOUBLE}}" for k, r in BENCH.items())}], recursive := true) FROM w),
        v AS (SELECT *, CASE WHEN n >= 600 THEN 0.9e0 WHEN n >= 500 THEN 0.88e0 WHEN n >= 350 THEN 0.82e0 WHEN n >= 150 THEN 0.68e0 WHEN n >= 50 THEN 0.45e0 WHEN n > 0 THEN 0.25e0 ELSE 0e0 END AS weight FROM e),
        u AS (SELECT *, least(greatest(CASE WHEN n > 0 THEN observed * weight + baseline * (1 - weight) ELSE baseline * 0.05e0 END, lo), hi) AS p, n + 120e0 AS eff, 1.959964e0 * 1.959964e0 AS z2 FROM v)
        SELECT player_id, outcome, observed, weight, round(p + 1e-10, 6) AS p, round(greatest(((p + z2 / (2 * eff)) - 1.959964e0 * sqrt(p * (1 - p) / eff + z2 / (4 * eff * eff))) / (1 + z2 / eff), 0) + 1e-10, 6) AS lower,
        round(least(((p + z2 / (2 * eff)) + 1.959964e0 * sqrt(p * (1 - p) / eff + z2 / (4 * eff * eff))) / (1 + z2 / eff), 1) + 1e-10, 6) AS upper, round(1 - pow(1 - p, 4.2e0) + 1e-10, 6) AS game_p, round(p * 4.2e0 + 1e-10, 6) AS expected,
        CASE WHEN 30 + 38 * (1 - exp(-n / 260)) >= 52 THEN 'moderate' ELSE 'low' END AS band FROM u""",
    "count_distributions": f"""{_PROFILE}, x AS (SELECT player_id, h / pa AS p, hr / games AS r, tb / games AS mean, (k + 1) / (k + bb + 2) AS q, (4 - tb / games) / sqrt(tb / games + 1) AS z FROM w WHERE pa > 0),
        y AS (SELECT *, 1 / (1 + 0.2316419e0 * abs(z)) AS t, exp(-z * z / 2) / sqrt(2 * pi()) AS dens FROM x),
        v AS (SELECT *, dens * (0.319381530e0 * t - 0.356563782e0 * t ** 2 + 1.781477937e0 * t ** 3 - 1.821255978e0 * t ** 4 + 1.330274429e0 * t ** 5) AS tail FROM y)
        SELECT player_id, round(4 * p * (1 - p) ** 3 + 1e-10, 6) AS one_hit, round((1 - p) ** 4 + 4 * p * (1 - p) ** 3 + 6 * p ** 2 * (1 - p) ** 2 + 1e-10, 6) AS two_hits_at_most, round(r * exp(-r) + 1e-10, 6) AS one_homer,
        round(exp(-r) * (1 + r + r * r / 2) + 1e-10, 6) AS two_homers_at_most, round(1 - exp(-r) + 1e-10, 6) AS a_homer, round(q ** 3 * (1 + 3 * (1 - q) + 6 * (1 - q) ** 2) + 1e-10, 6) AS two_walks_at_most,
        round(dens + 1e-10, 6) AS normal_density, round(CASE WHEN z >= 0 THEN 1 - tail ELSE tail END + 1e-10, 6) AS normal_below FROM v""",
}
