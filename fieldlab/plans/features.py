"""Feature queries over the game log and the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlab.functions.rates import COUNTS, RATES, rate_columns, rates, ratio
from fieldlab.operators.history import GAME, exponential_means, with_history
from fieldlab.sources.tables import GAME_LOG_SQL, game_log, table

LASTS = (3, 5, 10)
_SUMS = ", ".join(f"sum({c})::BIGINT AS {c}" for c in COUNTS)
_RATE_SQL = ", ".join(f"{text} AS {name}" for name, text in rates().items())


def _totals(log: DataFrame, *keys: str) -> DataFrame:
    return log.groupBy(*keys).agg(F.count(F.lit(1)).alias("games"), *[F.sum(c).alias(c) for c in COUNTS])


def career_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _totals(game_log(spark, sf_dir), "player_id").select("player_id", "games", *COUNTS, *rate_columns())


def rolling_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum, mean and population deviation of hits and the sum of home runs over the last 3, 5 and 10 earlier games."""
    columns = {}
    for n in LASTS:
        columns |= {
            f"hits_sum_{n}": GAME.last(n, F.sum("hits")),
            f"hits_mean_{n}": GAME.last(n, F.avg("hits")),
            f"hits_std_{n}": GAME.last(n, F.stddev_pop("hits")),
            f"home_runs_sum_{n}": GAME.last(n, F.sum("home_runs")),
        }
    found = with_history(game_log(spark, sf_dir), columns)
    return found.select("player_id", "game_id", *[F.round(F.coalesce(c, F.lit(0)), 6).cast("double").alias(c) for c in columns])


def rolling_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = ("avg", "obp", "slg", "k_rate", "hr_rate")
    columns = {f"{side}_{name}_{n}": GAME.last(n, F.sum(F.expr(RATES[name][k]))) for n in (5, 10) for name in used for k, side in enumerate(("n", "d"))}
    found = with_history(game_log(spark, sf_dir), columns)
    return found.select("player_id", "game_id", *[F.expr(ratio(f"n_{name}_{n}", f"d_{name}_{n}")).alias(f"{name}_{n}") for n in (5, 10) for name in used])


def rolling_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least-squares slope of plate appearances over the last 10 earlier games."""
    log = game_log(spark, sf_dir).withColumn("at", F.row_number().over(GAME.order))
    found = with_history(log, {"trend": GAME.last(10, F.regr_slope("plate_appearances", "at"))})
    return found.select("player_id", "game_id", (F.round(F.coalesce("trend", F.lit(0.0)), 6) + 0.0).alias("trend"))


def ewm_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponential means of hits over all earlier games, for three half-lives; 0 without an earlier game."""
    found = exponential_means(game_log(spark, sf_dir), "hits", [3, 7, 14])
    return found.select("player_id", "game_id", *[F.round(F.coalesce(f"ewm_{h}", F.lit(0.0)), 6).alias(f"ewm_{h}") for h in (3, 7, 14)])


def history_expanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = {
        "games": GAME.last(None, F.count("game_id")),
        "pa": GAME.last(None, F.sum("plate_appearances")),
        "spread": GAME.last(None, F.stddev_pop("hits")),
    }
    pa = F.coalesce("pa", F.lit(0))
    return with_history(game_log(spark, sf_dir), columns).select(
        "player_id",
        "game_id",
        F.col("games").alias("prior_games"),
        pa.alias("prior_pa"),
        F.round(F.log1p(pa), 6).alias("log_pa"),
        (pa >= 50).alias("sufficient"),
        F.round(1 - F.exp(-pa / 100), 6).alias("certainty"),
        F.round(F.coalesce("spread", F.lit(0.0)), 6).alias("volatility"),
    )


def calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.dayofyear("o_orderdate")
    turn = lambda x, n: 2 * F.lit(3.141592653589793) * x / n
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.year("o_orderdate").alias("year"),
        F.month("o_orderdate").alias("month"),
        F.weekday("o_orderdate").alias("weekday"),
        day.alias("day_of_year"),
        (F.weekday("o_orderdate") >= 5).alias("weekend"),
        F.round(F.sin(turn(F.month("o_orderdate"), 12)), 6).alias("month_sin"),
        F.round(F.cos(turn(day, 366)), 6).alias("day_cos"),
        F.round(F.least(F.greatest((day - 80) / 210, F.lit(0.0)), F.lit(1.0)), 6).alias("season_progress"),
    )


_SPLITS = {"home": "home_away = 'home'", "away": "home_away = 'away'", "vs_left": "pitcher_throws = 'L'", "vs_right": "pitcher_throws = 'R'", "day": "day_night = 'day'", "night": "day_night = 'night'"}


def split_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of a player at home and away, against either hand, by day and night, in one pass."""
    sums = [F.expr(f"sum(case when {when} then {c} else 0 end)").alias(f"{c}_{s}") for s, when in _SPLITS.items() for c in ("hits", "at_bats", "home_runs", "strikeouts", "plate_appearances")]
    games = [F.expr(f"count(case when {when} then 1 end)").alias(f"games_{s}") for s, when in _SPLITS.items()]
    found = game_log(spark, sf_dir).groupBy("player_id").agg(*games, *sums)
    out = [F.expr(ratio(f"{a}_{s}", f"{b}_{s}")).alias(f"{name}_{s}") for s in _SPLITS for name, a, b in (("avg", "hits", "at_bats"), ("hr", "home_runs", "plate_appearances"), ("k", "strikeouts", "plate_appearances"))]
    return found.select("player_id", *[f"games_{s}" for s in _SPLITS], *out)


def team_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs for and against (here rbi), their difference and the Pythagorean share, for each team."""
    found = _totals(game_log(spark, sf_dir), "team_id")
    power = lambda c: F.pow(F.col(c), 1.83)
    return found.select(
        "team_id",
        "games",
        F.expr(ratio("runs", "games")).alias("runs_per_game"),
        F.expr(ratio("rbi", "games")).alias("allowed_per_game"),
        (F.col("runs") - F.col("rbi")).alias("difference"),
        F.round(F.coalesce(power("runs") / F.nullif(power("runs") + power("rbi"), F.lit(0.0)), F.lit(0.5)), 6).alias("pythagorean"),
    )


def recent_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 10 games of each player summed up."""
    latest = Window.partitionBy("player_id").orderBy(F.desc("game_date"), F.desc("game_id"))
    rows = game_log(spark, sf_dir).withColumn("at", F.row_number().over(latest)).where("at <= 10")
    found = rows.groupBy("player_id").agg(
        F.count(F.lit(1)).alias("games"),
        *[F.sum(c).alias(c) for c in COUNTS],
        F.round(F.avg((F.col("hits") > 0).cast("double")), 6).alias("hit_game_rate"),
        F.round(F.avg((F.col("home_runs") > 0).cast("double")), 6).alias("hr_game_rate"),
        F.min("game_date").alias("window_start"),
        F.max("game_date").alias("window_end"),
    )
    return found.select("player_id", "games", *rate_columns(["avg", "obp", "slg"]), "hit_game_rate", "hr_game_rate", "window_start", "window_end")


def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten players of each rate among those with 40 plate appearances; unpivoted, ranked by rate."""
    found = _totals(game_log(spark, sf_dir), "player_id").where("plate_appearances >= 40")
    used = ["avg", "obp", "slg", "hr_rate"]
    long = found.select("player_id", *rate_columns(used)).unpivot("player_id", used, "category", "value")
    best = Window.partitionBy("category").orderBy(F.desc("value"))
    return long.withColumn("place", F.rank().over(best)).where("place <= 10")


def standings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wins and losses of teams (nations) by division (region): a game with more runs than rbi is won."""
    log = game_log(spark, sf_dir)
    won = log.groupBy("team_id").agg(F.count_if(F.col("runs") > F.col("rbi")).alias("wins"), F.count_if(F.col("runs") < F.col("rbi")).alias("losses"))
    teams = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("team_id"), F.col("n_regionkey").alias("division"))
    place = Window.partitionBy("division").orderBy(F.desc("pct"), "team_id")
    return won.join(teams, "team_id").withColumn("pct", F.expr(ratio("wins", "(wins + losses)"))).withColumn("place", F.row_number().over(place))


def point_in_time_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each event of a user, the orders of that customer before it: how many, their sum, the last price. Both tables
    lie on one time line, so there is no range join."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts"), F.lit(None).cast("long").alias("event_id"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("key")
    )
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.lit(None).cast("double").alias("price"), F.lit(None).cast("long").alias("key"))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    line = orders.unionByName(events).withColumn("at", micros)
    before = Window.partitionBy("user_id").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    last = F.max(F.when(F.col("key").isNotNull(), F.struct("at", "key", "price"))).over(before)
    found = line.withColumns({"orders_before": F.count("key").over(before), "spent": F.sum("price").over(before), "last": last})
    return found.where(F.col("event_id").isNotNull()).select(
        "event_id", "user_id", "orders_before", F.round(F.coalesce("spent", F.lit(0.0)), 2).alias("spent"), F.col("last.price").alias("last_price")
    )


QUERIES = {f.__name__: f for f in (career_rates, rolling_last_n, rolling_rates, rolling_trend, ewm_features, history_expanding, calendar_features, split_rates, team_rates, recent_form, leaderboard, standings, point_in_time_join)}

_LOG = f"WITH {GAME_LOG_SQL}"
_TOTAL = f"{_LOG}, total AS (SELECT player_id, count(*) AS games, {_SUMS} FROM log GROUP BY player_id)"
# earlier games of a game, newest first
_PAST = f"""{_LOG}, past AS (
SELECT c.player_id, c.game_id AS game, h.*, row_number() OVER (PARTITION BY c.game_id ORDER BY h.game_date DESC, h.game_id DESC) AS back
FROM log c LEFT JOIN log h ON h.player_id = c.player_id AND h.game_date < c.game_date)"""


def _upto(n: int, text: str) -> str:
    return text.replace("@", f"FILTER (back <= {n})")


ORACLE_SQL = {
    "career_rates": f"{_TOTAL} SELECT player_id, games, {', '.join(COUNTS)}, {_RATE_SQL} FROM total",
    "rolling_last_n": f"""{_PAST} SELECT player_id, game AS game_id, {', '.join(_upto(n, f'''coalesce(sum(hits) @, 0)::DOUBLE AS hits_sum_{n},
        round(coalesce(avg(hits) @, 0), 6) AS hits_mean_{n}, round(coalesce(stddev_pop(hits) @, 0), 6) AS hits_std_{n},
        coalesce(sum(home_runs) @, 0)::DOUBLE AS home_runs_sum_{n}''') for n in LASTS)} FROM past GROUP BY 1, 2""",
    "rolling_rates": f"""{_PAST} SELECT player_id, game AS game_id, {', '.join(_upto(n, f"{ratio(f'(sum({RATES[r][0]}) @)', f'(sum({RATES[r][1]}) @)')} AS {r}_{n}") for n in (5, 10) for r in ('avg', 'obp', 'slg', 'k_rate', 'hr_rate'))} FROM past GROUP BY 1, 2""",
    "rolling_trend": f"""{_PAST} SELECT player_id, game AS game_id, round(CASE WHEN count(back) FILTER (back <= 10 AND game_id IS NOT NULL) < 2 THEN 0 ELSE coalesce(regr_slope(plate_appearances, -back) FILTER (back <= 10), 0) END, 6) + 0 AS trend FROM past GROUP BY 1, 2""",
    "ewm_features": f"""{_PAST}, lists AS (SELECT player_id, game, list(hits::DOUBLE ORDER BY back DESC) FILTER (hits IS NOT NULL) AS xs FROM past GROUP BY 1, 2)
        SELECT player_id, game AS game_id, {', '.join(f"round(coalesce(CASE WHEN len(xs) > 0 THEN list_reduce(xs, lambda m, x: m * {0.5 ** (1 / h)!r} + x * {1 - 0.5 ** (1 / h)!r}) END, 0), 6) AS ewm_{h}" for h in (3, 7, 14))} FROM lists""",
    "history_expanding": f"""{_PAST}, sums AS (SELECT player_id, game, count(game_id) AS n, coalesce(sum(plate_appearances), 0)::BIGINT AS pa, stddev_pop(hits) AS sd FROM past GROUP BY 1, 2)
        SELECT player_id, game AS game_id, n AS prior_games, pa AS prior_pa, round(ln(1 + pa), 6) AS log_pa, pa >= 50 AS sufficient,
        round(1 - exp(-pa / 100.0::DOUBLE), 6) AS certainty, round(coalesce(sd, 0), 6) AS volatility FROM sums""",
    "calendar_features": """SELECT o_orderkey, year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, (isodow(o_orderdate) - 1)::INT AS weekday,
        dayofyear(o_orderdate)::INT AS day_of_year, isodow(o_orderdate) >= 6 AS weekend, round(sin(2 * pi() * month(o_orderdate) / 12), 6) + 0 AS month_sin,
        round(cos(2 * pi() * dayofyear(o_orderdate) / 366), 6) + 0 AS day_cos,
        round(least(greatest((dayofyear(o_orderdate) - 80) / 210.0::DOUBLE, 0), 1), 6) AS season_progress FROM orders""",
    "split_rates": f"""{_LOG} SELECT player_id, {', '.join(f"count(*) FILTER ({w}) AS games_{s}" for s, w in _SPLITS.items())},
        {', '.join(f"{ratio(f'(sum({a}) FILTER ({w}))', f'(sum({b}) FILTER ({w}))')} AS {n}_{s}" for s, w in _SPLITS.items() for n, a, b in (('avg', 'hits', 'at_bats'), ('hr', 'home_runs', 'plate_appearances'), ('k', 'strikeouts', 'plate_appearances')))}
        FROM log GROUP BY player_id""",
    "team_rates": f"""{_LOG}, t AS (SELECT team_id, count(*) AS games, sum(runs)::BIGINT AS runs, sum(rbi)::BIGINT AS rbi FROM log GROUP BY 1)
        SELECT team_id, games, {ratio('runs', 'games')} AS runs_per_game, {ratio('rbi', 'games')} AS allowed_per_game, runs - rbi AS difference,
        round(coalesce(pow(runs, 1.83) / nullif(pow(runs, 1.83) + pow(rbi, 1.83), 0), 0.5), 6) AS pythagorean FROM t""",
    "recent_form": f"""{_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY game_date DESC, game_id DESC) AS back FROM log),
        s AS (SELECT player_id, count(*) AS games, {_SUMS}, round(avg((hits > 0)::INT), 6) AS hit_game_rate, round(avg((home_runs > 0)::INT), 6) AS hr_game_rate,
        min(game_date) AS window_start, max(game_date) AS window_end FROM r WHERE back <= 10 GROUP BY 1)
        SELECT player_id, games, {', '.join(f'{t} AS {n}' for n, t in rates(['avg', 'obp', 'slg']).items())}, hit_game_rate, hr_game_rate, window_start, window_end FROM s""",
    "leaderboard": f"""{_TOTAL}, r AS (SELECT player_id, {', '.join(f'{t} AS {n}' for n, t in rates(['avg', 'obp', 'slg', 'hr_rate']).items())} FROM total WHERE plate_appearances >= 40),
        u AS (UNPIVOT r ON avg, obp, slg, hr_rate INTO NAME category VALUE value)
        SELECT * FROM (SELECT player_id, category, value, rank() OVER (PARTITION BY category ORDER BY value DESC)::INT AS place FROM u) WHERE place <= 10""",
    "standings": f"""{_LOG}, w AS (SELECT team_id, count(*) FILTER (runs > rbi) AS wins, count(*) FILTER (runs < rbi) AS losses FROM log GROUP BY 1),
        p AS (SELECT w.*, n_regionkey AS division, {ratio('wins', '(wins + losses)')} AS pct FROM w JOIN nation ON n_nationkey = team_id)
        SELECT *, row_number() OVER (PARTITION BY division ORDER BY pct DESC, team_id)::INT AS place FROM p""",
    "point_in_time_join": """SELECT e.event_id, e.user_id, count(o.o_orderkey) AS orders_before, round(coalesce(sum(o.o_totalprice), 0), 2) AS spent,
        arg_max(o.o_totalprice, (o.o_orderdate, o.o_orderkey)) AS last_price
        FROM events e LEFT JOIN orders o ON o.o_custkey = e.user_id AND o.o_orderdate < e.ts GROUP BY 1, 2""",
}
