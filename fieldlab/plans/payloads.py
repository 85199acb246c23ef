"""Nested payloads of a league's interface taken apart: schedules, people, rosters and line-ups; loads by layer and by window.

The payloads are made of the tables as JSON text, in the shape that the interface has, and read back with a schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlab.operators.memory import append_records
from fieldlab.operators.merge import classify
from fieldlab.sources.tables import GAME_LOG_SQL, game_log, table

_SIDE = "struct<team:struct<id:int>,score:int,probablePitcher:struct<id:bigint>>"
SCHEDULE = f"struct<dates:array<struct<date:string,games:array<struct<gamePk:bigint,status:struct<detailedState:string,abstractGameState:string>,venue:struct<name:string>,teams:struct<home:{_SIDE},away:{_SIDE}>>>>>>"
PERSON = "struct<person:struct<id:bigint,fullName:string,firstName:string,currentTeam:struct<id:int>>,team:struct<id:int>,entry:struct<fullName:string,teamId:int>>"
LINEUP = "struct<gamePk:bigint,home:struct<battingOrder:array<struct<id:bigint,position:string>>,pitcher:bigint>,away:struct<battingOrder:array<struct<id:bigint,position:string>>,pitcher:bigint>>"


def schedule_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's schedule document taken apart into a row a game: sides, scores, pitchers, and whether it is final (its detailed
    state), completed (its abstract state), postponed."""
    k = F.col("o_orderkey")
    state = F.element_at(F.array(*[F.lit(x) for x in ("Final", "Game Over", "Postponed: Rain", "In Progress", "Completed Early", "Scheduled")]), (k % 6 + 1).cast("int"))
    side = lambda n, who: F.struct(F.struct(((k + n) % 30).cast("int").alias("id")).alias("team"), F.when(k % 6 != 5, (k % (7 + n)).cast("int")).alias("score"), F.struct(who.alias("id")).alias("probablePitcher"))
    game = F.struct(
        k.alias("gamePk"), F.struct(state.alias("detailedState"), F.when(k % 6 == 5, "Preview").when(k % 6 == 3, "Live").otherwise("Final").alias("abstractGameState")).alias("status"),
        F.struct(F.concat(F.lit("Park "), k % 17).alias("name")).alias("venue"), F.struct(side(0, F.col("o_custkey")).alias("home"), side(7, F.when(k % 4 == 0, k)).alias("away")).alias("teams"),
    )
    days = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), (k % 50).alias("page")).agg(F.collect_list(game).alias("games"))  # a page of a day
    documents = days.select(F.to_json(F.struct(F.array(F.struct("date", "games")).alias("dates"))).alias("payload"))
    read = documents.select(F.from_json("payload", SCHEDULE).alias("d")).select(F.explode_outer("d.dates").alias("day")).select("day.date", F.explode_outer("day.games").alias("g"))
    detailed = F.lower("g.status.detailedState")
    return read.select(
        F.col("g.gamePk").alias("game_id"), "date", F.col("g.teams.home.team.id").alias("home_id"), F.col("g.teams.away.team.id").alias("away_id"), F.col("g.teams.home.score").alias("home_score"), F.col("g.teams.away.score").alias("away_score"),
        F.col("g.teams.away.probablePitcher.id").alias("away_pitcher"), F.col("g.venue.name").alias("venue"), detailed.isin("final", "game over", "completed early").alias("is_final"),
        (F.col("g.status.abstractGameState") == "Final").alias("is_completed"), F.contains(detailed, F.lit("postponed")).alias("is_postponed"),
    )


def roster_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons of a roster: what the full record knows wins over the roster's entry; the team of the payload, else the
    current one, else the entry's; first and last name from the whole where both lack."""
    k = F.col("c_custkey")
    payload = F.to_json(F.struct(
        F.struct(k.alias("id"), F.when(k % 4 != 0, F.concat(F.lit("Ann "), F.col("c_mktsegment"), F.lit(" Smith"))).alias("fullName"), F.when(k % 8 == 1, "Given").alias("firstName"), F.struct(F.when(k % 3 == 0, F.col("c_nationkey")).alias("id")).alias("currentTeam")).alias("person"),
        F.struct(F.when(k % 5 == 0, F.lit(99)).alias("id")).alias("team"), F.struct(F.col("c_name").alias("fullName"), F.lit(7).alias("teamId")).alias("entry"),
    ))
    p = table(spark, sf_dir, "customer").select(F.from_json(payload, PERSON).alias("p"))
    name = F.coalesce("p.person.fullName", "p.entry.fullName")
    words = F.split(name, " ")
    return p.select(
        F.col("p.person.id").alias("player_id"), name.alias("full_name"), F.coalesce("p.person.firstName", F.get(words, F.lit(0))).alias("first_name"),
        F.when(F.col("p.person.firstName").isNull() & (F.size(words) > 1), F.element_at(words, -1)).alias("last_name"), F.coalesce("p.team.id", "p.person.currentTeam.id", "p.entry.teamId").alias("team_id"),
    )


def lineups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batting orders of both sides with place and position, and each side's pitcher: an order's lines are its order, by side."""
    line = F.struct(F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"), F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("position"))
    side = lambda even: F.transform(F.array_sort(F.filter(F.collect_list(line), lambda x: (x["id"] % 2 == 0) == F.lit(even))), lambda x: F.struct(x["id"].alias("id"), x["position"].alias("position")))
    games = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("gamePk")).agg(side(True).alias("h"), side(False).alias("a"))  # a game's lines are few
    payload = F.to_json(F.struct("gamePk", F.struct(F.col("h").alias("battingOrder"), F.col("gamePk").alias("pitcher")).alias("home"), F.struct(F.col("a").alias("battingOrder"), F.lit(None).cast("bigint").alias("pitcher")).alias("away")))
    read = games.select(F.from_json(payload, LINEUP).alias("g"))
    rows = [read.select("g.gamePk", F.lit(s).alias("side"), F.col(f"g.{s}.pitcher").alias("pitcher"), F.posexplode_outer(f"g.{s}.battingOrder").alias("at", "x")) for s in ("home", "away")]
    return rows[0].unionByName(rows[1]).select(F.col("gamePk").alias("game_id"), "side", "pitcher", (F.col("at") + 1).alias("slot"), F.col("x.id").alias("player_id"), F.col("x.position").alias("position"))


def layered_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second load of each layer (season lines, games, splits) would change, by action: one merge a layer over all
    players at once. The second load holds a hit more where the game's key ends in 7, and lacks those that end in 9."""
    log = game_log(spark, sf_dir)
    later = log.where("game_id % 10 <> 9").withColumn("hits", F.col("hits") + (F.col("game_id") % 10 == 7).cast("int"))
    layers = {"season": ["player_id", "season"], "game_log": ["player_id", "game_id"], "split": ["player_id", "home_away"]}
    total = lambda df, keys: df.groupBy(*keys).agg(F.sum("hits").alias("hits"), F.sum("walks").alias("walks"))
    parts = [classify(total(log, keys), total(later, keys), keys).groupBy("action").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("layer"), "action", "n") for name, keys in layers.items()]
    return reduce(DataFrame.unionByName, parts)


def schedule_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games of a date window by month: seen, final, skipped; a filter on the date reaches the scan."""
    rows = table(spark, sf_dir, "orders").where((F.col("o_orderdate") >= F.lit("1996-03-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1996-11-01").cast("timestamp_ntz")))
    return rows.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("window")).agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("o_orderstatus") == "F").alias("created"), F.count_if(F.col("o_orderstatus") != "F").alias("skipped"))


def interaction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The append-only log: each user turn with the reply after it, importance and a JSON context."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumns({"reply": F.lead("text").over(order), "speaker": F.lead("role").over(order)})
    rows = rows.where("role = 'user'")
    known = F.when(F.col("text").rlike("[0-9]"), 10).otherwise(0) + F.when(F.col("speaker") == "assistant", 10).otherwise(0)
    return rows.select("conv_id", "turn", F.sha2(F.coalesce("text", F.lit("")), 256).alias("message_sha256"), F.length(F.when(F.col("speaker") == "assistant", F.col("reply"))).alias("reply_chars"), F.least(35 + known, F.lit(95)).alias("importance"), F.to_json(F.struct("conv_id", "turn")).alias("context"))


def append_interactions(spark: SparkSession, sf_dir: str, path: str, batch: str = "0") -> None:
    """interaction_log appended to a Parquet log as the part `batch`; the same batch again replaces its part."""
    append_records(interaction_log(spark, sf_dir), path, batch)


# --- stat lines, packets and feedback


def stat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Season lines with rates filled in where they are 0 or less (told here: a third of them), and the sample."""
    c = F.col
    t = game_log(spark, sf_dir).groupBy("player_id", "season").agg(*[F.sum(x).alias(x) for x in ("plate_appearances", "at_bats", "hits", "doubles", "triples", "home_runs", "walks")])
    per = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)
    bases = c("hits") + c("doubles") + 2 * c("triples") + 3 * c("home_runs")
    told = F.when(c("player_id") % 3 == 0, 0.3).otherwise(0.0)
    fill = lambda said, real: F.when(said <= 0, real).otherwise(said)
    t = t.withColumns({"avg": fill(told, per(c("hits"), c("at_bats"))), "obp": fill(told, per(c("hits") + c("walks"), c("plate_appearances"))), "slg": fill(told, per(bases, c("at_bats")))})
    return t.select("player_id", "season", "avg", "obp", "slg", F.round(c("obp") + c("slg"), 6).alias("ops"), F.round(c("slg") - c("avg"), 6).alias("iso"), F.greatest("plate_appearances", "at_bats").alias("sample"))


def feature_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One packet a player: the newest stat line of the warehouse, else what the request says, else none; with the source, the
    share of fields that are known, and a profile."""
    best = stat_lines(spark, sf_dir).groupBy("player_id").agg(F.max_by(F.struct("season", "avg", "slg", "sample"), "season").alias("line"))
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("player_id"), F.when(F.col("c_acctbal") > 5000, 0.25).alias("asked_avg"))
    rows = asked.join(best.where("line.sample >= 20"), "player_id", "left")
    source = F.when(F.col("line").isNotNull(), "database").when(F.col("asked_avg").isNotNull(), "request").otherwise("none")
    avg = F.coalesce("line.avg", "asked_avg")
    known = F.col("line").isNotNull().cast("int") * 2 + avg.isNotNull().cast("int") + 1
    return rows.select("player_id", source.alias("source"), avg.alias("avg"), F.coalesce("line.sample", F.lit(0)).alias("sample"), F.round(known / 4, 4).alias("coverage"), F.when(avg >= 0.3, "contact").when(avg.isNull(), "unknown").otherwise("balanced").alias("profile"))


def feedback_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved forecasts as feedback: label, error and training weight, one for each forecast however often it is told (told
    twice here), with its state."""
    p = F.least(F.col("o_totalprice") / 5000, F.lit(100.0))
    told = table(spark, sf_dir, "orders").select("o_orderkey", p.alias("p"), F.when(F.col("o_orderstatus") != "P", (F.col("o_orderstatus") == "F").cast("double")).alias("y"), (F.col("o_orderkey") % 4).alias("state"))
    rows = told.unionByName(told.where("o_orderkey % 3 = 0")).where("y is not null").dropDuplicates(["o_orderkey"])
    error = F.abs(F.when(F.col("p") > 1, F.col("p") / 100).otherwise(F.col("p")) - F.col("y"))
    weight = F.when(error >= 0.75, 1.75).when(error >= 0.5, 1.35).when(error <= 0.1, 0.75).otherwise(1.0)
    return rows.select("o_orderkey", "y", F.round(error + 1e-10, 6).alias("error"), weight.alias("weight"), (F.col("state") == 0).alias("approved"), ((F.col("state") == 0) & (F.col("o_orderkey") % 8 == 0)).alias("used"))


def feedback_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback over all, by version of the model and by outcome, in one pass of grouping sets."""
    rows = feedback_events(spark, sf_dir).withColumns({"version": F.concat(F.lit("v"), F.col("o_orderkey") % 3), "outcome": F.when(F.col("y") == 1, "hit").otherwise("out")})
    return rows.groupingSets([["version"], ["outcome"], []], "version", "outcome").agg(
        F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("events"), F.count_if("approved").alias("approved"), F.count_if("used").alias("used"), F.round(F.avg("error"), 6).alias("mean_error")
    )


def overall_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power, contact, discipline, form, tracking and sample scores (0 to 100, unknown ones left out without new weights),
    their sum by weight, and readiness for three outcomes: the mean of the scores that matter, ready at 55."""
    c = F.col
    t = game_log(spark, sf_dir).groupBy("player_id").agg(*[F.sum(x).alias(x) for x in ("plate_appearances", "at_bats", "hits", "doubles", "triples", "home_runs", "walks", "strikeouts")])
    scaled = lambda x, low, high: F.least(F.greatest((x - low) / (high - low) * 100, F.lit(0.0)), F.lit(100.0))
    per = lambda a, b: F.try_divide(a, b)
    score = {
        "power": scaled(per(c("doubles") + 2 * c("triples") + 3 * c("home_runs"), c("at_bats")), 0.05, 0.60), "contact": scaled(per(c("strikeouts"), c("plate_appearances")), 0.50, 0.05), "discipline": scaled(per(c("walks"), c("plate_appearances")), 0.02, 0.50),
        "batted": F.when(c("hits") >= 5, scaled(per(c("doubles") + c("triples") + c("home_runs"), c("hits")), 0.2, 0.8)), "average": scaled(per(c("hits"), c("at_bats")), 0.15, 0.70), "sample": scaled(c("plate_appearances"), 0.0, 100.0),
    }
    weights = {"power": 0.25, "contact": 0.18, "discipline": 0.14, "batted": 0.18, "average": 0.15, "sample": 0.10}
    rows = t.select("player_id", *[F.round(v + 1e-9, 2).alias(k) for k, v in score.items()])
    overall = reduce(lambda a, b: a + b, [F.coalesce(c(k) * w, F.lit(0.0)) for k, w in weights.items()])
    mean = lambda *ks: reduce(lambda a, b: a + b, [F.coalesce(k, F.lit(0.0)) for k in ks]) / reduce(lambda a, b: a + b, [c(k).isNotNull().cast("int") for k in ks])
    return rows.select("player_id", *score, F.round(overall + 1e-9, 2).alias("overall"), (mean("power", "batted") >= 55).alias("home_run_ready"), (mean("contact", "average", "batted") >= 55).alias("hit_ready"), (mean("discipline", "contact") >= 55).alias("walk_ready"))


QUERIES = {f.__name__: f for f in (schedule_games, roster_people, lineups, layered_load, schedule_windows, interaction_log, stat_lines, feature_packets, feedback_events, feedback_breakdown, overall_scores)}

_LOG = f"WITH {GAME_LOG_SQL}"
_LINES = f"""{_LOG}, t AS (SELECT player_id, year(game_date)::INT AS season, sum(plate_appearances) AS pa, sum(at_bats) AS ab, sum(hits) AS h, sum(walks) AS w, sum(hits + doubles + 2 * triples + 3 * home_runs) AS tb FROM log GROUP BY 1, 2),
    s AS (SELECT player_id, season, CASE WHEN player_id % 3 = 0 THEN 0.3e0 ELSE round(coalesce(h / nullif(ab, 0), 0), 6) END AS avg, CASE WHEN player_id % 3 = 0 THEN 0.3e0 ELSE round((h + w) / pa, 6) END AS obp, CASE WHEN player_id % 3 = 0 THEN 0.3e0 ELSE round(coalesce(tb / nullif(ab, 0), 0), 6) END AS slg, greatest(pa, ab)::BIGINT AS sample FROM t),
    lines AS (SELECT player_id, season, avg, obp, slg, round(obp + slg, 6) AS ops, round(slg - avg, 6) AS iso, sample FROM s)"""
_FEEDBACK = """f0 AS (SELECT o_orderkey, CASE WHEN least(o_totalprice / 5000, 100) > 1 THEN least(o_totalprice / 5000, 100) / 100 ELSE o_totalprice / 5000 END AS p, (o_orderstatus = 'F')::INT::DOUBLE AS y FROM orders WHERE o_orderstatus <> 'P'), f1 AS (SELECT *, abs(p - y) AS e FROM f0),
    fb AS (SELECT o_orderkey, y, round(e + 1e-10, 6) AS error, CASE WHEN e >= 0.75 THEN 1.75e0 WHEN e >= 0.5 THEN 1.35e0 WHEN e <= 0.1 THEN 0.75e0 ELSE 1e0 END AS weight, o_orderkey % 4 = 0 AS approved, o_orderkey % 8 = 0 AS used FROM f1)"""


def _layer(name: str, keys: str) -> str:
    a, b = (f"SELECT {keys}, sum(hits{more}) AS h, sum(walks) AS w FROM log {where} GROUP BY {keys}" for more, where in (("", ""), (" + (game_id % 10 = 7)::INT", "WHERE game_id % 10 <> 9")))
    return f"SELECT '{name}' AS layer, CASE WHEN b.h IS NULL THEN 'absent' WHEN a.h IS NULL THEN 'created' WHEN a.h <> b.h OR a.w <> b.w THEN 'updated' ELSE 'unchanged' END AS action, count(*) AS n FROM ({a}) a FULL JOIN ({b}) b USING ({keys}) GROUP BY 2"


ORACLE_SQL = {
    "schedule_games": """SELECT o_orderkey AS game_id, strftime(o_orderdate, '%Y-%m-%d') AS date, (o_orderkey % 30)::INT AS home_id, ((o_orderkey + 7) % 30)::INT AS away_id, CASE WHEN o_orderkey % 6 <> 5 THEN o_orderkey % 7 END::INT AS home_score, CASE WHEN o_orderkey % 6 <> 5 THEN o_orderkey % 14 END::INT AS away_score,
        CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey END AS away_pitcher, 'Park ' || o_orderkey % 17 AS venue, o_orderkey % 6 IN (0, 1, 4) AS is_final, o_orderkey % 6 NOT IN (3, 5) AS is_completed, o_orderkey % 6 = 2 AS is_postponed FROM orders""",
    "roster_people": """WITH x AS (SELECT c_custkey AS player_id, CASE WHEN c_custkey % 4 <> 0 THEN 'Ann ' || c_mktsegment || ' Smith' ELSE c_name END AS full_name, c_custkey % 8 = 1 AS given, CASE WHEN c_custkey % 5 = 0 THEN 99 WHEN c_custkey % 3 = 0 THEN c_nationkey ELSE 7 END::INT AS team_id FROM customer)
        SELECT player_id, full_name, CASE WHEN given THEN 'Given' ELSE string_split(full_name, ' ')[1] END AS first_name, CASE WHEN NOT given AND contains(full_name, ' ') THEN string_split(full_name, ' ')[-1] END AS last_name, team_id FROM x""",
    "lineups": """WITH x AS (SELECT l_orderkey AS game_id, CASE WHEN l_partkey % 2 = 0 THEN 'home' ELSE 'away' END AS side, l_partkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey, l_partkey % 2 ORDER BY l_linenumber, l_quantity, l_partkey, l_returnflag) AS slot FROM lineitem),
        g AS (SELECT DISTINCT l_orderkey AS game_id, unnest(['home', 'away']) AS side FROM lineitem) SELECT game_id, side, CASE WHEN side = 'home' THEN game_id END AS pitcher, slot::INT AS slot, l_partkey AS player_id, l_returnflag AS position FROM g LEFT JOIN x USING (game_id, side)""",
    "layered_load": f"{_LOG} {_layer('season', 'player_id, season')} UNION ALL {_layer('game_log', 'player_id, game_id')} UNION ALL {_layer('split', 'player_id, home_away')}",
    "schedule_windows": "SELECT strftime(o_orderdate, '%Y-%m') AS window, count(*) AS seen, count(*) FILTER (o_orderstatus = 'F') AS created, count(*) FILTER (o_orderstatus <> 'F') AS skipped FROM orders WHERE o_orderdate >= '1996-03-01' AND o_orderdate < '1996-11-01' GROUP BY 1",
    "interaction_log": """WITH x AS (SELECT *, lead(text) OVER w AS reply, lead(role) OVER w AS speaker FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, sha256(coalesce(text, '')) AS message_sha256, CASE WHEN speaker = 'assistant' THEN length(reply) END AS reply_chars,
        (35 + CASE WHEN regexp_matches(text, '[0-9]') THEN 10 ELSE 0 END + CASE WHEN speaker = 'assistant' THEN 10 ELSE 0 END)::INT AS importance, '{"conv_id":' || conv_id || ',"turn":' || turn || '}' AS context FROM x WHERE role = 'user'""",
    "stat_lines": f"{_LINES} SELECT * FROM lines",
    "feature_packets": f"""{_LINES}, b AS (SELECT player_id, arg_max(avg, season) AS a, arg_max(sample, season) AS n FROM lines GROUP BY 1), x AS (SELECT c_custkey AS player_id, CASE WHEN n >= 20 THEN a END AS a, CASE WHEN n >= 20 THEN n END AS n, CASE WHEN c_acctbal > 5000 THEN 0.25e0 END AS q FROM customer LEFT JOIN b ON player_id = c_custkey)
        SELECT player_id, CASE WHEN n IS NOT NULL THEN 'database' WHEN q IS NOT NULL THEN 'request' ELSE 'none' END AS source, coalesce(a, q) AS avg, coalesce(n, 0) AS sample, round((1 + 2 * (n IS NOT NULL)::INT + (coalesce(a, q) IS NOT NULL)::INT) / 4e0, 4) AS coverage,
        CASE WHEN coalesce(a, q) >= 0.3 THEN 'contact' WHEN coalesce(a, q) IS NULL THEN 'unknown' ELSE 'balanced' END AS profile FROM x""",
    "feedback_events": f"WITH {_FEEDBACK} SELECT * FROM fb",
    "feedback_breakdown": f"""WITH {_FEEDBACK}, v AS (SELECT *, 'v' || o_orderkey % 3 AS version, CASE WHEN y = 1 THEN 'hit' ELSE 'out' END AS outcome FROM fb) SELECT version, outcome, grouping_id(version, outcome)::INT AS level, count(*) AS events, count(*) FILTER (approved) AS approved, count(*) FILTER (used) AS used,
        round(avg(error), 6) AS mean_error FROM v GROUP BY GROUPING SETS ((version), (outcome), ())""",
    "overall_scores": f"""{_LOG}, t AS (SELECT player_id, sum(plate_appearances)::DOUBLE AS pa, nullif(sum(at_bats), 0)::DOUBLE AS ab, sum(hits)::DOUBLE AS h, sum(doubles)::DOUBLE AS d, sum(triples)::DOUBLE AS t3, sum(home_runs)::DOUBLE AS hr, sum(walks)::DOUBLE AS w, sum(strikeouts)::DOUBLE AS k FROM log GROUP BY 1),
        s AS (SELECT player_id, CASE WHEN ab IS NULL THEN 0 ELSE round(least(greatest(((d + 2 * t3 + 3 * hr) / ab - 0.05e0) / 0.55e0 * 100, 0), 100) + 1e-9, 2) END AS power, round(least(greatest((0.5e0 - k / pa) / 0.45e0 * 100, 0), 100) + 1e-9, 2) AS contact, round(least(greatest((w / pa - 0.02e0) / 0.48e0 * 100, 0), 100) + 1e-9, 2) AS discipline,
        CASE WHEN h >= 5 THEN round(least(greatest(((d + t3 + hr) / h - 0.2e0) / 0.6e0 * 100, 0), 100) + 1e-9, 2) END AS batted, CASE WHEN ab IS NULL THEN 0 ELSE round(least(greatest((h / ab - 0.15e0) / 0.55e0 * 100, 0), 100) + 1e-9, 2) END AS average, round(least(pa, 100) + 1e-9, 2) AS sample FROM t)
        SELECT *, round(0.25e0 * power + 0.18e0 * contact + 0.14e0 * discipline + coalesce(0.18e0 * batted, 0) + 0.15e0 * average + 0.1e0 * sample + 1e-9, 2) AS overall, list_avg([power, batted]) >= 55 AS home_run_ready, list_avg([contact, average, batted]) >= 55 AS hit_ready, list_avg([discipline, contact]) >= 55 AS walk_ready FROM s""",
}
