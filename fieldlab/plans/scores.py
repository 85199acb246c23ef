"""Probability and scoring queries over player and team totals."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlab.functions.rates import BASES, COUNTS, blend_log_odds, clamp, ladder, logistic, logit, posterior, rates, ratio, wilson
from fieldlab.sources.tables import GAME_LOG_SQL, game_log

#: Prior means and strengths of the outcomes, as fixed values.
PRIORS = {"hits": (0.23, 120.0), "home_runs": (0.031, 170.0), "walks": (0.085, 120.0), "strikeouts": (0.225, 100.0)}
_SUMS = ", ".join(f"sum({c})::BIGINT AS {c}" for c in COUNTS)
SAMPLE = [(350, "strong"), (150, "usable"), (50, "limited"), (1, "small")]
BANDS = [(85, "very_high"), (70, "high"), (52, "medium")]
_P = {k: f"(({m * s} + {k}) / ({s} + plate_appearances))" for k, (m, s) in PRIORS.items()}
_DIST = {
    "home_run": _P["home_runs"], "walk": _P["walks"], "strikeout": _P["strikeouts"],
    "single": f"({_P['hits']} * 0.65)", "double": f"({_P['hits']} * 0.20)", "triple": f"({_P['hits']} * 0.02)",
}
_OTHER = "greatest(1 - (" + " + ".join(_DIST.values()) + "), 0.01)"
_SUM = "(" + " + ".join([*_DIST.values(), _OTHER]) + ")"

#: What a query adds to player totals, as SQL of either engine.
FORMULAS: dict[str, dict[str, str]] = {
    "beta_posterior": posterior("hits", "plate_appearances", *PRIORS["hits"]),
    "blended_rate": {
        "log_odds": f"round({blend_log_odds({_P['hits']: 1.0, '(hits / (plate_appearances + 0.0))': 0.2, '0.23': 0.18})}, 6)",
        "weighted": f"round((1.0 * {_P['hits']} + 0.2 * hits / plate_appearances + 0.18 * 0.23) / 1.38, 6)",
        "geometric": f"round(exp((1.0 * ln({_P['hits']}) + 0.38 * ln(0.23)) / 1.38), 6)",
    },
    "wilson_interval": {"p": f"round({_P['hits']}, 6)", **wilson(_P["hits"], "(plate_appearances + 120.0)")},
    "pa_distribution": {
        **{f"p_{k}": f"round({v} / {_SUM}, 6)" for k, v in _DIST.items()},
        "p_other": f"round({_OTHER} / {_SUM}, 6)",
        "expected_bases": f"round(({_DIST['single']} + 2 * {_DIST['double']} + 3 * {_DIST['triple']} + 4 * {_DIST['home_run']}) / {_SUM}, 6)",
    },
    "confidence_score": {
        "confidence": "round(30 + 38 * (1 - exp(-plate_appearances / 260.0)) + 14 + 11 * 0.5 + 7, 4)",
        "band": ladder("(30 + 38 * (1 - exp(-plate_appearances / 260.0)) + 14 + 11 * 0.5 + 7)", BANDS, "low"),
        "sample": ladder("plate_appearances", SAMPLE, "none"),
    },
    "feature_scores": {
        "power": f"round({clamp(f'({BASES} - hits) / greatest(at_bats, 1) / 0.30 * 100.0', 0, 100)}, 2)",
        "contact": f"round({clamp('(1 - strikeouts / (plate_appearances + 0.0)) * 100.0', 0, 100)}, 2)",
        "discipline": f"round({clamp('walks / (plate_appearances + 0.0) / 0.15 * 100.0', 0, 100)}, 2)",
        "archetype": f"case when {BASES} - hits >= 0.225 * at_bats then 'power' when walks >= 0.3 * plate_appearances then 'patient' else 'balanced' end",
    },
}
_CONTEXT = {
    "home": "0.035 * (case when home_away = 'home' then 1 else -1 end)",
    "platoon": "0.05 * (case when pitcher_throws = 'L' then 1 else -1 end)",
    "time": "0.01 * (case when day_night = 'day' then 1 else -1 end)",
}
_ADJUSTED = logistic(f"{logit(_P['hits'])} + " + " + ".join(_CONTEXT.values()))
_OPPORTUNITIES = clamp("plate_appearances / (games + 0.0)", 1, 7)
ESTIMATE = {
    "base": f"round({_P['hits']}, 6)",
    "probability": f"round({clamp(_ADJUSTED, 0.0001, 0.9999)}, 6)",
    "opportunities": f"round({_OPPORTUNITIES}, 6)",
    "game_probability": f"round(1 - pow(1 - {clamp(_ADJUSTED, 0.0001, 0.9999)}, {_OPPORTUNITIES}), 6)",
    "expected": f"round({_ADJUSTED} * {_OPPORTUNITIES}, 6)",
}
_OUTCOMES = list(PRIORS)


_DECIMAL = re.compile(r"(?<![\w.])(\d+\.\d+)(?![\w.])")


def _expr(text: str) -> Column:
    """The formula with its decimal literals as doubles, for Spark."""
    return F.expr(_DECIMAL.sub(r"\1D", text))


def totals(spark: SparkSession, sf_dir: str, *keys: str) -> DataFrame:
    return game_log(spark, sf_dir).groupBy(*(keys or ("player_id",))).agg(F.count(F.lit(1)).alias("games"), *[F.sum(c).alias(c) for c in COUNTS])


def _formula_query(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return totals(spark, sf_dir).select("player_id", *[_expr(text).alias(k) for k, text in FORMULAS[name].items()])

    run.__name__ = name
    return run


def player_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit probabilities of a player in each context met: shrunk rate, log-odds adjustments, game probability."""
    keys = ("player_id", "home_away", "pitcher_throws", "day_night")
    return totals(spark, sf_dir, *keys).select(*keys, *[_expr(text).alias(k) for k, text in ESTIMATE.items()])


def all_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four outcomes (PRIORS) of every player: observed rate, shrunk probability, sample weight and mixed probability."""
    rows = totals(spark, sf_dir).select(
        "player_id",
        "plate_appearances",
        F.expr("stack({}, {}) as (outcome, seen, prior, strength)".format(len(PRIORS), ", ".join(f"'{k}', {k}, double({m}), double({s})" for k, (m, s) in PRIORS.items()))),
    )
    weight = F.expr("case when plate_appearances >= 350 then 0.90D when plate_appearances >= 150 then 0.82D when plate_appearances >= 50 then 0.68D else 0.45D end")
    observed = F.col("seen") / F.col("plate_appearances")
    return rows.select(
        "player_id",
        "outcome",
        F.round(observed, 6).alias("observed"),
        F.round((F.col("prior") * F.col("strength") + F.col("seen")) / (F.col("strength") + F.col("plate_appearances")), 6).alias("shrunk"),
        F.round(observed * weight + F.col("prior") * (1 - weight), 6).alias("mixed"),
    )


def team_win_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance that each team beats the next one (by number), from independent Poisson runs 0..20, ties 54% to the home
    side: the two distributions are arrays on the row of the game, so no pair of scores is a row."""
    teams = totals(spark, sf_dir, "team_id").select("team_id", F.least(F.greatest(F.col("runs") / F.col("games") * 2, F.lit(1.2)), F.lit(10.5)).alias("rate"))
    away = teams.select((F.col("team_id") - 1).alias("home_id"), F.col("team_id").alias("away_id"), F.col("rate").alias("away_rate"))
    games = teams.withColumnRenamed("team_id", "home_id").join(away, "home_id")

    def mass(rate: str):
        first = F.array(F.exp(-F.col(rate)))
        return F.aggregate(F.sequence(F.lit(1), F.lit(20)), first, lambda held, k: F.array_append(held, F.element_at(held, -1) * F.col(rate) / k))

    games = games.withColumns({"h": mass("rate"), "a": mass("away_rate")})
    win = F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.lit(0.0), lambda s, k: s + F.get("h", k) * F.aggregate(F.slice("a", 1, k), F.lit(0.0), lambda t, x: t + x))
    tie = F.aggregate(F.zip_with("h", "a", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return games.select("home_id", "away_id", F.round("rate", 6).alias("home_runs"), F.round(F.least(F.greatest(win + 0.54 * tie, F.lit(0.01)), F.lit(0.99)), 6).alias("win"))


QUERIES = {name: _formula_query(name) for name in FORMULAS} | {f.__name__: f for f in (player_estimates, all_outcomes, team_win_matrix)}

_TOTAL = f"WITH {GAME_LOG_SQL}, t AS (SELECT player_id, count(*) AS games, {_SUMS} FROM log GROUP BY 1)"


def _duck(text: str) -> str:
    """The formula with its decimal literals as doubles, for DuckDB."""
    return _DECIMAL.sub(r"\1::DOUBLE", text)


ORACLE_SQL = {name: f"{_TOTAL} SELECT player_id, {', '.join(f'{_duck(t)} AS {k}' for k, t in found.items())} FROM t" for name, found in FORMULAS.items()} | {
    "player_estimates": f"""WITH {GAME_LOG_SQL}, t AS (SELECT player_id, home_away, pitcher_throws, day_night, count(*) AS games, {_SUMS} FROM log GROUP BY 1, 2, 3, 4)
        SELECT player_id, home_away, pitcher_throws, day_night, {', '.join(f'{_duck(t)} AS {k}' for k, t in ESTIMATE.items())} FROM t""",
    "all_outcomes": _TOTAL + " UNION ALL ".join(
        f""" SELECT player_id, '{k}' AS outcome, round({k} / plate_appearances::DOUBLE, 6) AS observed, round(({m}::DOUBLE * {s} + {k}) / ({s}::DOUBLE + plate_appearances), 6) AS shrunk,
        round({k} / plate_appearances::DOUBLE * w + {m}::DOUBLE * (1 - w), 6) AS mixed FROM (SELECT *, CASE WHEN plate_appearances >= 350 THEN 0.90 WHEN plate_appearances >= 150 THEN 0.82
        WHEN plate_appearances >= 50 THEN 0.68 ELSE 0.45 END::DOUBLE AS w FROM t)""" for k, (m, s) in PRIORS.items()
    ),
    "team_win_matrix": f"""WITH {GAME_LOG_SQL}, t AS (SELECT team_id, least(greatest(sum(runs)::DOUBLE / count(*) * 2, 1.2), 10.5)::DOUBLE AS rate FROM log GROUP BY 1),
        m AS (SELECT team_id, rate, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM t, (SELECT unnest(range(21)) AS k)),
        w AS (SELECT h.team_id AS home_id, a.team_id AS away_id, any_value(h.rate) AS rate, sum(h.p * a.p) FILTER (h.k > a.k) + 0.54 * sum(h.p * a.p) FILTER (h.k = a.k) AS win
        FROM m h JOIN m a ON a.team_id = h.team_id + 1 GROUP BY 1, 2)
        SELECT home_id, away_id, round(rate, 6) AS home_runs, round(least(greatest(win, 0.01), 0.99), 6) AS win FROM w""",
}
