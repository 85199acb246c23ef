"""Marts and resolution queries: fan-in of latest rows, ordered keys, predictions against outcomes, validation, masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlab.functions.rates import COUNTS, rate_columns, rates, ratio
from fieldlab.sources.tables import GAME_LOG_SQL, game_log, table


def player_mart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity, career rates, latest game, latest event and readiness of every player; sides are one row a player before
    they are joined, so each join is one shuffle on the player."""
    log = game_log(spark, sf_dir)
    career = log.groupBy("player_id").agg(F.count(F.lit(1)).alias("games"), *[F.sum(c).alias(c) for c in COUNTS], F.max(F.struct("game_date", "game_id")).alias("latest"))
    events = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("player_id")).agg(F.count(F.lit(1)).alias("events"), F.max("ts").alias("last_event"))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("player_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("team_id"))
    teams = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("team_id"), F.col("n_name").alias("team"))
    mart = people.join(teams, "team_id", "left").join(career, "player_id", "left").join(events, "player_id", "left")
    ready = F.round(0.2 + 0.3 * F.col("games").isNotNull().cast("double") + 0.25 * (F.coalesce("plate_appearances", F.lit(0)) >= 25).cast("double") + 0.25 * F.col("events").isNotNull().cast("double"), 2)
    return mart.select("player_id", "name", "team", F.coalesce("games", F.lit(0)).alias("games"), *rate_columns(["avg", "obp", "slg"]), F.col("latest.game_id").alias("latest_game"), F.coalesce("events", F.lit(0)).alias("events"), "last_event", ready.alias("readiness"))


def opponent_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each game with what the player's own team had batted against opponents of that hand before its date: two time lines
    joined by running sums, settled on the last row of each date."""
    log = game_log(spark, sf_dir)
    daily = log.groupBy("team_id", "pitcher_throws", "game_date").agg(F.sum("hits").alias("hits"), F.sum("at_bats").alias("at_bats"))
    before = Window.partitionBy("team_id", "pitcher_throws").orderBy("game_date").rowsBetween(Window.unboundedPreceding, -1)
    past = daily.select("team_id", "pitcher_throws", "game_date", F.sum("hits").over(before).alias("h"), F.sum("at_bats").over(before).alias("ab"))
    return log.select("player_id", "game_id", "team_id", "pitcher_throws", "game_date").join(past, ["team_id", "pitcher_throws", "game_date"]).select("player_id", "game_id", F.expr(ratio("h", "ab")).alias("team_avg_vs_hand"))


def ordered_key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of all events, found by number, else by name: a union of equi joins with a priority instead of an OR.
    `ordered_key_lookup_all` looks them up by nation too."""
    asked = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key")).withColumn("name", F.concat(F.lit("Customer#"), F.lpad(F.col("event_id").cast("string"), 9, "0")))
    people = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    by_key = asked.join(people, F.col("key") == F.col("c_custkey")).select("event_id", F.lit(1).alias("priority"), "c_custkey")
    by_name = asked.join(people, F.col("name") == F.col("c_name")).select("event_id", F.lit(2).alias("priority"), "c_custkey")
    best = by_key.unionByName(by_name).groupBy("event_id").agg(F.min(F.struct("priority", "c_custkey")).alias("x"))
    return asked.select("event_id").join(best, "event_id", "left").select("event_id", "x.priority", "x.c_custkey")


def lookup_keys(events: DataFrame, customers: DataFrame) -> DataFrame:
    """The customer of each event whose number is user_id, else whose name holds event_id, else the first of the nation
    whose number is user_id; events without one stay, with nulls."""
    asked = events.select("event_id", F.col("user_id").alias("key"), F.concat(F.lit("Customer#"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("name"))
    people = customers.select("c_custkey", "c_name")
    nations = customers.groupBy(F.col("c_nationkey").cast("long").alias("key")).agg(F.min("c_custkey").alias("c_custkey"))
    by_key = asked.join(people, F.col("key") == F.col("c_custkey")).select("event_id", F.lit(1).alias("priority"), "c_custkey")
    by_name = asked.join(people, F.col("name") == F.col("c_name")).select("event_id", F.lit(2).alias("priority"), "c_custkey")
    by_nation = asked.join(nations, "key").select("event_id", F.lit(3).alias("priority"), "c_custkey")
    best = by_key.unionByName(by_name).unionByName(by_nation).groupBy("event_id").agg(F.min(F.struct("priority", "c_custkey")).alias("x"))
    return asked.select("event_id").join(best, "event_id", "left").select("event_id", "x.priority", "x.c_custkey")


def ordered_key_lookup_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of all events by number, else by name, else by nation."""
    return lookup_keys(table(spark, sf_dir, "events"), table(spark, sf_dir, "customer"))


def prediction_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hit forecast from the career before each game against the game: error, correctness and training weight."""
    log = game_log(spark, sf_dir)
    order, tied = Window.partitionBy("player_id").orderBy("game_date", "game_id"), Window.partitionBy("player_id", "game_date").orderBy("game_date", "game_id")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = log.withColumns({"h": F.sum("hits").over(past), "pa": F.sum("plate_appearances").over(past)})
    rows = rows.withColumns({"h": F.first("h").over(tied), "pa": F.first("pa").over(tied)})
    p = (27.6 + F.coalesce("h", F.lit(0))) / (120 + F.coalesce("pa", F.lit(0)))
    y = (F.col("hits") > 0).cast("double")
    rows = rows.withColumns({"p": 1 - F.pow(1 - p, F.col("plate_appearances")), "y": y})
    error = F.abs(F.col("p") - F.col("y"))
    weight = F.when(error >= 0.75, 1.75).when(error >= 0.5, 1.35).when(error <= 0.1, 0.75).otherwise(1.0)
    return rows.select("player_id", "game_id", F.round("p", 6).alias("probability"), F.round(error, 6).alias("error"), ((F.col("p") >= 0.5) == (F.col("y") == 1)).alias("was_correct"), weight.alias("weight"))


def feedback_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts by weight: how many, how many right, mean error."""
    return prediction_resolution(spark, sf_dir).groupBy("weight").agg(F.count(F.lit(1)).alias("n"), F.count_if("was_correct").alias("correct"), F.round(F.avg("error"), 5).alias("mean_error"))


def validation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names of the rules that a line breaks; lines that break none are left out."""
    rules = {"quantity_high": "l_quantity > 48", "discount_range": "l_discount < 0.01", "tax_range": "l_tax > 0.075", "ships_late": "l_shipdate >= timestamp_ntz'2001-01-01'"}
    errors = F.array_compact(F.array(*[F.when(F.expr(when), F.lit(name)) for name, when in rules.items()]))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", errors.alias("e")).where("size(e) > 0").select("l_orderkey", "l_linenumber", F.array_join("e", ",").alias("errors"))


def privacy_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as addresses with all but the first character of the local part masked; stat tiers of balances."""
    local = F.regexp_replace(F.lower("c_name"), "#", ".")
    tier = F.when(F.col("c_acctbal") >= 7500, "high").when(F.col("c_acctbal") >= 2500, "middle").otherwise("low")
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.regexp_replace(local, "(?<=.).", "*"), F.lit("@"), F.lower("c_mktsegment")).alias("masked"), tier.alias("tier"))


QUERIES = {f.__name__: f for f in (player_mart, opponent_history, ordered_key_lookup, ordered_key_lookup_all, prediction_resolution, feedback_summary, validation_rules, privacy_mask)}

_SUMS = ", ".join(f"sum({c})::BIGINT AS {c}" for c in COUNTS)
_RESOLVED = f"""WITH {GAME_LOG_SQL}, s AS (SELECT c.player_id, c.game_id, any_value(c.hits) AS hits, any_value(c.plate_appearances) AS n, (27.6::DOUBLE + coalesce(sum(h.hits), 0)) / (120 + coalesce(sum(h.plate_appearances), 0)) AS rate
    FROM log c LEFT JOIN log h ON h.player_id = c.player_id AND h.game_date < c.game_date GROUP BY 1, 2), p AS (SELECT player_id, game_id, 1 - pow(1 - rate, n) AS p, (hits > 0)::INT::DOUBLE AS y FROM s),
    r AS (SELECT player_id, game_id, p, abs(p - y) AS e, (p >= 0.5) = (y = 1) AS was_correct FROM p),
    f AS (SELECT player_id, game_id, round(p, 6) AS probability, round(e, 6) AS error, was_correct, CASE WHEN e >= 0.75 THEN 1.75 WHEN e >= 0.5 THEN 1.35 WHEN e <= 0.1 THEN 0.75 ELSE 1.0 END::DOUBLE AS weight FROM r)"""
ORACLE_SQL = {
    "player_mart": f"""WITH {GAME_LOG_SQL}, c AS (SELECT player_id, count(*) AS games, {_SUMS}, arg_max(game_id, (game_date, game_id)) AS latest_game FROM log GROUP BY 1),
        e AS (SELECT user_id AS player_id, count(*) AS events, max(ts) AS last_event FROM events GROUP BY 1)
        SELECT c_custkey AS player_id, c_name AS name, n_name AS team, coalesce(games, 0) AS games, {', '.join(f'{t} AS {n}' for n, t in rates(['avg', 'obp', 'slg']).items())}, latest_game, coalesce(events, 0) AS events, last_event,
        round(0.2 + 0.3 * (games IS NOT NULL)::INT + 0.25 * (coalesce(plate_appearances, 0) >= 25)::INT + 0.25 * (events IS NOT NULL)::INT, 2)::DOUBLE AS readiness
        FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN c ON c.player_id = c_custkey LEFT JOIN e ON e.player_id = c_custkey""",
    "opponent_history": f"""WITH {GAME_LOG_SQL}, d AS (SELECT team_id, pitcher_throws, game_date, sum(hits) AS hits, sum(at_bats) AS at_bats FROM log GROUP BY 1, 2, 3),
        p AS (SELECT team_id, pitcher_throws, game_date, sum(hits) OVER w AS h, sum(at_bats) OVER w AS ab FROM d WINDOW w AS (PARTITION BY team_id, pitcher_throws ORDER BY game_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT player_id, game_id, {ratio('h', 'ab')} AS team_avg_vs_hand FROM log JOIN p USING (team_id, pitcher_throws, game_date)""",
    "ordered_key_lookup": """SELECT e.event_id, CASE WHEN k.c_custkey IS NOT NULL THEN 1 WHEN n.c_custkey IS NOT NULL THEN 2 END::INT AS priority, coalesce(k.c_custkey, n.c_custkey) AS c_custkey
        FROM events e LEFT JOIN customer k ON k.c_custkey = e.user_id LEFT JOIN customer n ON n.c_name = 'Customer#' || lpad(e.event_id::VARCHAR, 9, '0')""",
    "ordered_key_lookup_all": """WITH f AS (SELECT c_nationkey, min(c_custkey) AS first FROM customer GROUP BY 1)
        SELECT e.event_id, CASE WHEN k.c_custkey IS NOT NULL THEN 1 WHEN n.c_custkey IS NOT NULL THEN 2 WHEN f.first IS NOT NULL THEN 3 END::INT AS priority, coalesce(k.c_custkey, n.c_custkey, f.first) AS c_custkey
        FROM events e LEFT JOIN customer k ON k.c_custkey = e.user_id LEFT JOIN customer n ON n.c_name = 'Customer#' || lpad(e.event_id::VARCHAR, 9, '0') LEFT JOIN f ON f.c_nationkey = e.user_id""",
    "prediction_resolution": f"{_RESOLVED} SELECT * FROM f",
    "feedback_summary": f"{_RESOLVED} SELECT weight, count(*) AS n, count(*) FILTER (was_correct) AS correct, round(avg(error), 5) AS mean_error FROM f GROUP BY 1",
    "validation_rules": """SELECT * FROM (SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_quantity > 48 THEN 'quantity_high' END, CASE WHEN l_discount < 0.01 THEN 'discount_range' END, CASE WHEN l_tax > 0.075 THEN 'tax_range' END,
        CASE WHEN l_shipdate >= TIMESTAMP '2001-01-01' THEN 'ships_late' END) AS errors FROM lineitem) WHERE errors <> ''""",
    "privacy_mask": """SELECT c_custkey, substr(lower(c_name), 1, 1) || repeat('*', length(c_name) - 1) || '@' || lower(c_mktsegment) AS masked, CASE WHEN c_acctbal >= 7500 THEN 'high' WHEN c_acctbal >= 2500 THEN 'middle' ELSE 'low' END AS tier FROM customer""",
}
