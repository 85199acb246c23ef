"""Queries over the audits, comparisons within teams and the log of interactions, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlab.operators import audits, coverage, memory
from fieldlab.operators.dialogue import understand
from fieldlab.operators.ranks import places
from fieldlab.plans import dialogues
from fieldlab.plans.ladders import SUSPICIOUS
from fieldlab.plans.rosters import _profile_parts
from fieldlab.plans.understanding import fuzzy_decisions, requests
from fieldlab.sources.shared import stage
from fieldlab.sources.tables import GAME_LOG_SQL, game_log, table

c = F.col


# --- integrity: customers are players, nations teams, orders roster entries, events statistics


def _warehouse(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rich customers are told with the next one's source id, poor ones without activity; a team of orders may be unknown."""
    players = table(spark, sf_dir, "customer").select(
        c("c_custkey").alias("player_id"), F.when(c("c_acctbal") > 9500, c("c_custkey") + 1).otherwise(c("c_custkey")).alias("source_id"), c("c_name").alias("name"), c("c_nationkey").alias("team_id"), c("c_mktsegment").alias("position"),
        F.when(c("c_acctbal") > -900, "yes").otherwise("").alias("active"),
    )
    rosters = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("entry_id"), F.when(c("o_totalprice") > 2000, c("o_custkey")).alias("player_id"), (c("o_custkey") % 26).alias("team_id"))
    statistics = table(spark, sf_dir, "events").select(c("event_id").alias("stat_id"), c("user_id").alias("player_id"))
    return players, table(spark, sf_dir, "nation").select(c("n_nationkey").alias("team_id")), rosters, statistics


def integrity_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row that fails a check of the warehouse."""
    return audits.integrity_failures(*_warehouse(spark, sf_dir))


def integrity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eleven checks of the warehouse, of 25 teams."""
    return audits.integrity_report(*_warehouse(spark, sf_dir), expected=25)


# --- rosters: what customers and orders say, against a state that lacks, repeats and moves some


ROSTER_QUERY_FIELDS = ("player_id", "name", "position", "team_id")


def _rosters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    people = table(spark, sf_dir, "customer").withColumn("name", F.concat("c_mktsegment", F.lit(" No. "), F.floor(c("c_acctbal") / 10).cast("string")))
    source = people.select(c("c_custkey").alias("player_id"), "name", c("c_nationkey").alias("team_id"), F.lit("told").alias("observed_at"))
    moved = F.when((c("c_acctbal") < 0) & (c("c_mktsegment") == "MACHINERY"), c("c_nationkey") + 1).otherwise(c("c_nationkey"))
    position = F.when(c("c_acctbal").between(1000, 1200), "").otherwise(c("c_mktsegment"))
    held = people.where("c_acctbal > -900").select(c("c_custkey").alias("player_id"), "name", position.alias("position"), moved.alias("team_id"), "c_acctbal")
    players = held.unionByName(held.where("c_acctbal > 9800")).drop("c_acctbal")
    orders = table(spark, sf_dir, "orders")
    entries = orders.select(F.year("o_orderdate").alias("season"), c("o_orderpriority").alias("kind"), (c("o_custkey") % 26).cast("int").alias("team_id"), c("o_custkey").alias("player_id"), "o_orderstatus")
    rosters = entries.where("o_orderstatus <> 'P'").drop("o_orderstatus")
    return source, entries.drop("o_orderstatus"), players, table(spark, sf_dir, "nation").select(c("n_nationkey").alias("team_id")), rosters


def roster_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the held rosters fail of the told ones, by the seven checks, every failure a row."""
    return audits.roster_failures(*_rosters(spark, sf_dir), fields=ROSTER_QUERY_FIELDS)


def roster_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine checks of the rosters' gate, of 25 teams."""
    return audits.roster_gate(roster_failures(spark, sf_dir), _rosters(spark, sf_dir)[0], 25)


# --- inventories


def inventory_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers against a held inventory that lacks poor ones, repeats some, has rich ones under new keys and another nation
    for others; names differ by case alone."""
    source = table(spark, sf_dir, "supplier")
    held = source.where("s_acctbal > -500").withColumns({"s_name": F.lower("s_name"), "s_nationkey": F.when(c("s_acctbal") < 1000, F.lit(None)).otherwise(c("s_nationkey"))})
    more = held.where("s_acctbal > 9000").withColumn("s_suppkey", -1 - c("s_suppkey"))
    return audits.inventory_differences(source, held.unionByName(more).unionByName(held.where("s_acctbal BETWEEN 5000 AND 6000")), "s_suppkey", ("s_name", "s_nationkey", "s_acctbal"), ("s_name",))


def inventory_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as an inventory of 25 teams in five leagues of their regions; divisions are those of an even and an odd key."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), c("n_regionkey") == c("r_regionkey"))
    records = rows.select(c("n_nationkey").alias("team_id"), c("n_name").alias("name"), F.substring("n_name", 1, 3).alias("abbreviation"), c("r_name").alias("league"), (c("n_nationkey") % 2).cast("string").alias("division"))
    return audits.inventory_balance(records, 25, 5, 5, ("name", "abbreviation", "league", "division"))


def roster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's roster entries and players, and what they serve."""
    players, teams, rosters, _ = _warehouse(spark, sf_dir)
    return audits.roster_sizes(teams, players, rosters)


def load_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each region as a load of five teams, 60 players and 600 roster entries: how far it has come."""
    nations = table(spark, sf_dir, "nation").select(c("n_nationkey").alias("team_id"), "n_regionkey")
    rows = roster_sizes(spark, sf_dir).join(nations, "team_id").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("teams"), F.sum("players").alias("players"), F.sum("entries").alias("entries"))
    return rows.withColumn("state", audits.load_status(c("teams"), c("players"), c("entries"), 5, 60, 600))


# --- leaks, copies of names, comparisons


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = game_log(spark, sf_dir).select("player_id", c("game_date").alias("at"))
    return audits.future_records(log, log.groupBy("player_id").agg(F.date_trunc("year", F.max("at")).cast("timestamp_ntz").alias("as_of")), ["player_id"])


def feature_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature sets as of the start of each player's last season that were made of the player's whole log: how many of their games
    lie at or after that moment."""
    day = lambda name: F.date_format(name, "yyyy-MM-dd").alias(name)
    return _history(spark, sf_dir).select("player_id", day("as_of"), "records", "future", day("first_future"))


def leak_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of these sets and of the names of their features, one of which tells the result."""
    return audits.leak_report(_history(spark, sf_dir), ["hits_mean_5", "Post-Game rate", "walk_rate_15", "target_hit"], SUSPICIOUS)


def shared_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose name another part has too: a row for each, with the name."""
    return audits.sharing(table(spark, sf_dir, "part"), "p_partkey", c("p_name"), "name")


def _overall() -> Column:
    return F.when(c("ab") >= 20, F.round(c("h") / c("ab") * 100, 4))


def team_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All players of a team side by side by their overall score (unknown as 0): place, and what the winner has more. A team may
    be of any size."""
    rows = game_log(spark, sf_dir).groupBy("team_id", "player_id").agg(F.sum("hits").alias("h"), F.sum("at_bats").alias("ab"))
    scored = stage(rows.select("team_id", "player_id", F.coalesce(_overall(), F.lit(0.0)).alias("score")), "scored")
    best = scored.groupBy("team_id").agg(F.max_by(F.struct("player_id", "score"), F.struct("score", -c("player_id"))).alias("winner"))
    placed = places(scored, ["team_id"], [F.desc("score"), F.asc("player_id")]).join(stage(best, "winners"), "team_id")
    return placed.select("team_id", "player_id", "score", "place", c("winner.player_id").alias("winner"), F.round(c("winner.score") - c("score"), 4).alias("behind"))


# --- interactions


def interaction_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations' messages as records of the log, with the assistant's reply after them."""
    turns = dialogues.dialogue_turns(spark, sf_dir)
    replies = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", "text")
    return memory.interaction_records(turns.select("conv_id", "turn", "text"), understand(turns, dialogues.catalogue(spark, sf_dir)), replies)


def unsaid_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that messages mean without saying them, by the phrases that stand for them."""
    return memory.unsaid_names(interaction_memory(spark, sf_dir))


def corrected_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was said and accepted for another name, by the score's decision alone."""
    return memory.corrected_aliases(requests(spark, sf_dir).select("said"), fuzzy_decisions(spark, sf_dir))


# --- coverage and readiness


def metric_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seasons of the game log as metrics of hitting and (against a left hand) pitching, taken at the season's end: what they
    cover of the customers. Home runs of none are unknown; lines of many games are told again."""
    group = F.when(c("pitcher_throws") == "L", "pitching").otherwise("hitting")
    log = game_log(spark, sf_dir).groupBy("season", group.alias("group"), "player_id").agg(F.sum("plate_appearances").alias("sample"), F.max("game_date").alias("updated_at"), F.sum("hits").alias("hits"), F.sum("home_runs").alias("hr"), F.count(F.lit(1)).alias("games"))
    end = F.make_timestamp_ntz(c("season"), F.lit(12), F.lit(31), F.lit(0), F.lit(0), F.lit(0))
    rows = stage(log.select("season", "group", "player_id", "sample", "updated_at", end.alias("retrieved_at"), "hits", F.when(c("hr") > 0, c("hr")).alias("hr"), "games"), "metrics")
    people = table(spark, sf_dir, "customer").select(c("c_custkey").alias("player_id"), F.explode(F.array(F.lit("hitting"), F.lit("pitching"))).alias("group"))
    return coverage.metric_coverage(people, rows.unionByName(rows.where("games >= 8")).drop("games"), ["hits", "hr"])


def profile_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's profile by the states of its parts: identity, season, form, and tracking, which is stale with two kinds of
    events and less."""
    rows = _profile_parts(spark, sf_dir)
    kinds = F.coalesce("kinds", F.lit(0))
    states = {
        "identity": F.when(c("c_name").isNotNull() & (c("c_acctbal") > 0), "ready").otherwise("partial"), "season": F.when(c("games") > 0, "ready").otherwise("missing"),
        "form": F.when(c("recent") > 0, "ready").otherwise("missing"), "tracking": F.when(kinds > 2, "ready").when(kinds > 0, "stale").otherwise("missing"),
    }
    score, overall = coverage.profile_state(states)
    return rows.select("player_id", *[s.alias(k) for k, s in states.items()], score.alias("score"), overall.alias("overall"))


QUERIES = {f.__name__: f for f in (
    metric_coverage, profile_states, integrity_failures, integrity_report, roster_failures, roster_gate, inventory_differences, inventory_balance, roster_sizes, load_states, feature_leaks, leak_report, shared_names, team_places, interaction_memory, unsaid_names,
    corrected_aliases,
)}

_GATE = "tot AS (SELECT count(*) AS total, count(*) FILTER (failures = 0) AS good FROM rep) SELECT \"check\", failures, failures = 0 AS passed, round(good * 100 / total, 1) AS percent, CASE WHEN good = total THEN 'ready' ELSE 'partial' END AS status FROM rep, tot"
_WAREHOUSE = """players AS (SELECT c_custkey AS player_id, CASE WHEN c_acctbal > 9500 THEN c_custkey + 1 ELSE c_custkey END AS source_id, c_name AS name, c_nationkey AS team_id, c_mktsegment AS position, CASE WHEN c_acctbal > -900 THEN 'yes' ELSE '' END AS active FROM customer),
    rosters AS (SELECT o_orderkey AS entry_id, CASE WHEN o_totalprice > 2000 THEN o_custkey END AS player_id, o_custkey % 26 AS team_id FROM orders), teams AS (SELECT n_nationkey AS team_id FROM nation), stats AS (SELECT event_id AS stat_id, user_id AS player_id FROM events)"""
_INTEGRITY = f"""{_WAREHOUSE}, fails AS (SELECT 'player_fields' AS "check", player_id::VARCHAR AS "key", f AS detail FROM (SELECT player_id, unnest(['source_id', 'name', 'team_id', 'position', 'active']) AS f, unnest([source_id::VARCHAR, name, team_id::VARCHAR, position, active]) AS v FROM players) WHERE coalesce(v, '') = ''
    UNION ALL SELECT 'player_source_ids', source_id::VARCHAR, count(*)::VARCHAR FROM players WHERE source_id IS NOT NULL GROUP BY source_id HAVING count(*) > 1
    UNION ALL SELECT 'roster_players', entry_id::VARCHAR, player_id::VARCHAR FROM rosters r WHERE NOT EXISTS (SELECT 1 FROM players p WHERE p.player_id = r.player_id)
    UNION ALL SELECT 'roster_teams', entry_id::VARCHAR, team_id::VARCHAR FROM rosters r WHERE NOT EXISTS (SELECT 1 FROM teams t WHERE t.team_id = r.team_id)
    UNION ALL SELECT 'statistic_players', stat_id::VARCHAR, player_id::VARCHAR FROM stats s WHERE NOT EXISTS (SELECT 1 FROM players p WHERE p.player_id = s.player_id))"""
_ROSTERS = """people AS (SELECT *, c_mktsegment || ' No. ' || floor(c_acctbal / 10)::BIGINT AS name FROM customer), source AS (SELECT c_custkey AS player_id, name, c_nationkey AS team_id FROM people),
    held AS (SELECT c_custkey AS player_id, name, CASE WHEN c_acctbal BETWEEN 1000 AND 1200 THEN '' ELSE c_mktsegment END AS position, c_nationkey + CASE WHEN c_acctbal < 0 AND c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END AS team_id, c_acctbal FROM people WHERE c_acctbal > -900),
    players AS (SELECT * FROM held UNION ALL SELECT * FROM held WHERE c_acctbal > 9800), teams AS (SELECT n_nationkey AS team_id FROM nation),
    due AS (SELECT year(o_orderdate) AS season, o_orderpriority AS kind, o_custkey % 26 AS team_id, o_custkey AS player_id, o_orderstatus FROM orders), rosters AS (SELECT * EXCLUDE o_orderstatus FROM due WHERE o_orderstatus <> 'P'),
    low AS (SELECT player_id, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS name FROM source),
    state AS (SELECT DISTINCT season, kind, team_id, player_id, EXISTS (SELECT 1 FROM players p WHERE p.player_id = d.player_id) AND EXISTS (SELECT 1 FROM teams t WHERE t.team_id = d.team_id) AS known FROM due d),
    fails AS (SELECT 'missing_player' AS "check", player_id::VARCHAR AS "key", NULL::VARCHAR AS detail FROM source s WHERE NOT EXISTS (SELECT 1 FROM players p WHERE p.player_id = s.player_id)
    UNION ALL SELECT 'duplicate_player', player_id::VARCHAR, count(*)::VARCHAR FROM players GROUP BY player_id HAVING count(*) > 1
    UNION ALL SELECT 'incomplete_player', player_id::VARCHAR, 'position' FROM players WHERE position = ''
    UNION ALL SELECT 'wrong_team', player_id::VARCHAR, team_id::VARCHAR FROM source s WHERE EXISTS (SELECT 1 FROM players p WHERE p.player_id = s.player_id) AND NOT EXISTS (SELECT 1 FROM players p JOIN teams t ON t.team_id = p.team_id WHERE p.player_id = s.player_id AND p.team_id = s.team_id)
    UNION ALL SELECT 'missing_membership', concat_ws('|', season, kind, team_id, player_id), CASE WHEN NOT known THEN 'player_or_team_missing' END FROM state s
        WHERE NOT known OR NOT EXISTS (SELECT 1 FROM rosters r WHERE r.season = s.season AND r.kind = s.kind AND r.team_id = s.team_id AND r.player_id = s.player_id)
    UNION ALL SELECT 'duplicate_membership', concat_ws('|', season, kind, team_id, player_id), count(*)::VARCHAR FROM rosters GROUP BY season, kind, team_id, player_id HAVING count(*) > 1
    UNION ALL SELECT 'identical_name', player_id::VARCHAR, name FROM low WHERE name IN (SELECT name FROM low GROUP BY 1 HAVING count(*) > 1))"""
_COUNTED = lambda names: "counted AS (SELECT \"check\", count(*) AS n FROM fails GROUP BY 1), rep0 AS (SELECT x AS \"check\", coalesce(n, 0) AS failures FROM (SELECT unnest([" + ", ".join(f"'{n}'" for n in names) + "]) AS x) LEFT JOIN counted ON counted.\"check\" = x)"
_SIZES = f"""{_WAREHOUSE}, e AS (SELECT team_id, count(*) AS n FROM rosters GROUP BY 1), p AS (SELECT team_id, count(*) AS n FROM players GROUP BY 1), sizes AS (SELECT t.team_id, coalesce(e.n, 0) AS entries, coalesce(p.n, 0) AS players FROM teams t LEFT JOIN e ON e.team_id = t.team_id LEFT JOIN p ON p.team_id = t.team_id)"""
_LEAKS = f"""{GAME_LOG_SQL}, m AS (SELECT player_id, date_trunc('year', max(game_date)) AS as_of FROM log GROUP BY 1),
    leaks AS (SELECT player_id, as_of, count(*) AS records, count(*) FILTER (game_date >= as_of) AS future, min(game_date) FILTER (game_date >= as_of) AS first_future FROM log JOIN m USING (player_id) GROUP BY ALL)"""
_LOW = "trim(regexp_replace(lower(coalesce({}, '')), '[^a-z0-9]+', ' ', 'g'))"


def _memory_sql() -> str:
    """The records, after the SQL of what is understood, which has the messages as x."""
    head, found, last = dialogues.ORACLE_SQL["batch_understanding"].rpartition("SELECT conv_id, turn, kind")
    known = " || ".join(f"CASE WHEN coalesce({k}, '') <> '' THEN ' | {title}: ' || {k} ELSE '' END" for k, title in memory.TITLES.items())
    ten = " + ".join(f"CASE WHEN coalesce({k}, '') <> '' THEN 10 ELSE 0 END" for k in memory.TITLES)
    return f"""{head}, understood AS ({found}{last}), said AS (SELECT conv_id, turn, trim(coalesce(text, '')) AS message FROM x), answers AS (SELECT conv_id, turn - 1 AS turn, trim(coalesce(text, '')) AS reply FROM conversations WHERE role = 'assistant'),
    records AS (SELECT sha256(concat_ws('|', conv_id, turn, message)) AS record_id, conv_id, turn, 'chat' AS category, message, coalesce(reply, '') AS reply, intent, player, team, outcome, CASE WHEN {known} = '' THEN '{memory.GENERAL}' ELSE substr({known}, 4) END AS summary,
        least(95, 35 + {ten} + CASE WHEN intent IN ('compare_players', 'compare_teams') THEN 5 ELSE 0 END) AS importance, json_object('conv_id', conv_id, 'turn', turn, 'kind', kind)::VARCHAR AS context
        FROM said LEFT JOIN answers USING (conv_id, turn) LEFT JOIN understood USING (conv_id, turn))"""


ORACLE_SQL = {
    "metric_coverage": f"""WITH {GAME_LOG_SQL}, g AS (SELECT season, CASE WHEN pitcher_throws = 'L' THEN 'pitching' ELSE 'hitting' END AS grp, player_id, sum(plate_appearances) AS sample, max(game_date) AS told, sum(home_runs) AS hr, count(*) AS games FROM log GROUP BY ALL),
        x AS (SELECT *, date_diff('hour', told, make_timestamp(season, 12, 31, 0, 0, 0.0)) AS age, CASE grp WHEN 'pitching' THEN 500 ELSE 100 END AS least FROM g), n AS (SELECT count(*) AS n FROM customer)
        SELECT season, grp AS "group", n AS eligible, n - count(*) FILTER (player_id IN (SELECT c_custkey FROM customer)) AS missing, count(*) AS covered, count(*) FILTER (games >= 8) AS repeated, count(*) FILTER (hr = 0) AS incomplete, count(*) FILTER (sample >= least) AS usable,
        count(*) FILTER (age <= 36) AS fresh, count(*) FILTER (age > 108) AS stale, count(*) FILTER (games >= 8) = 0 AND count(*) FILTER (sample >= least) > 0 AND count(*) FILTER (age <= 36 OR age > 108) > 0 AS open FROM x, n GROUP BY season, grp, n""",
    "profile_states": f"""WITH {GAME_LOG_SQL}, g AS (SELECT player_id, count(*) AS games FROM log GROUP BY 1), k AS (SELECT user_id, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1),
        s AS (SELECT c_custkey AS player_id, CASE WHEN c_name IS NOT NULL AND c_acctbal > 0 THEN 'ready' ELSE 'partial' END AS identity, CASE WHEN games > 0 THEN 'ready' ELSE 'missing' END AS season, CASE WHEN games > 0 THEN 'ready' ELSE 'missing' END AS form,
        CASE WHEN kinds > 2 THEN 'ready' WHEN kinds > 0 THEN 'stale' ELSE 'missing' END AS tracking FROM customer LEFT JOIN g ON g.player_id = c_custkey LEFT JOIN k ON k.user_id = c_custkey),
        v AS (SELECT *, round(100 * ((CASE identity WHEN 'ready' THEN 0.25e0 ELSE 0.125e0 END) + (CASE season WHEN 'ready' THEN 0.3e0 ELSE 0 END) + (CASE form WHEN 'ready' THEN 0.2e0 ELSE 0 END) + (CASE tracking WHEN 'ready' THEN 0.25e0 WHEN 'stale' THEN 0.125e0 ELSE 0 END)), 1) AS score FROM s)
        SELECT *, CASE WHEN score >= 95 THEN 'ready' WHEN score >= 50 THEN 'partial' ELSE 'missing' END AS overall FROM v""",
    "integrity_failures": f"WITH {_INTEGRITY} SELECT * FROM fails",
    "integrity_report": f"""WITH {_INTEGRITY}, {_COUNTED(("player_fields", "player_source_ids", "roster_players", "roster_teams", "statistic_players"))}, rep AS (FROM rep0 UNION ALL SELECT 'team_count', abs(count(*) - 25) FROM teams UNION ALL SELECT 'players_present', (count(*) = 0)::INT FROM players
        UNION ALL SELECT 'rosters_present', (count(*) = 0)::INT FROM rosters UNION ALL SELECT 'players_of_all_teams', greatest(25 - count(DISTINCT team_id), 0) FROM players UNION ALL SELECT 'from_the_warehouse', 0 UNION ALL SELECT 'no_made_up_zeros', 0), {_GATE}""",
    "roster_failures": f"WITH {_ROSTERS} SELECT * FROM fails",
    "roster_gate": f"WITH {_ROSTERS}, {_COUNTED(audits.CLOSING)}, rep AS (FROM rep0 UNION ALL SELECT 'source_teams', abs(count(DISTINCT team_id) - 25) FROM source UNION ALL SELECT 'source_players', (count(*) = 0)::INT FROM source UNION ALL SELECT 'source_times', 0), {_GATE}",
    "inventory_differences": """WITH h AS (SELECT s_suppkey, upper(s_name) AS s_name, CASE WHEN s_acctbal >= 1000 THEN s_nationkey END AS s_nationkey, s_acctbal FROM supplier WHERE s_acctbal > -500), held AS (FROM h UNION ALL SELECT -1 - s_suppkey, s_name, s_nationkey, s_acctbal FROM h WHERE s_acctbal > 9000)
        SELECT 'missing' AS "check", s_suppkey::VARCHAR AS "key", NULL::VARCHAR AS field, NULL::VARCHAR AS source, NULL::VARCHAR AS held FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM held) UNION ALL SELECT 'unexpected', s_suppkey::VARCHAR, NULL, NULL, NULL FROM held WHERE s_suppkey < 0
        UNION ALL SELECT 'repeated_held', s_suppkey::VARCHAR, NULL, NULL, '2' FROM h WHERE s_acctbal BETWEEN 5000 AND 6000 UNION ALL SELECT 'differs', s.s_suppkey::VARCHAR, 's_nationkey', s.s_nationkey::VARCHAR, NULL FROM supplier s JOIN h ON h.s_suppkey = s.s_suppkey WHERE h.s_nationkey IS DISTINCT FROM s.s_nationkey""",
    "inventory_balance": f"""WITH r AS (SELECT n_nationkey AS team_id, n_name, upper(substr(n_name, 1, 3)) AS a, r_name AS league, n_nationkey % 2 AS division FROM nation JOIN region ON n_regionkey = r_regionkey), rep AS (SELECT 'size' AS "check", abs(count(*) - 25) AS failures FROM r
        UNION ALL SELECT 'repeated_ids', count(*) FROM (SELECT team_id FROM r GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'repeated_abbreviations', count(*) FROM (SELECT a FROM r GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'incomplete_records', count(*) FROM r WHERE coalesce(n_name, '') = ''
        UNION ALL SELECT 'league_balance', abs(count(*) - 5) + count(*) FILTER (n <> 5) FROM (SELECT count(*) AS n FROM r GROUP BY league) UNION ALL SELECT 'division_balance', abs(count(*) - 5) + count(*) FILTER (n <> 5) FROM (SELECT count(*) AS n FROM r GROUP BY division)), {_GATE}""",
    "roster_sizes": f"WITH {_SIZES} SELECT *, entries > 0 AS for_browser, players > 0 AS for_lookup, entries > 0 AND players > 0 AS for_features FROM sizes",
    "load_states": f"""WITH {_SIZES}, l AS (SELECT n_regionkey, count(*) AS teams, sum(players) AS players, sum(entries) AS entries FROM sizes JOIN nation ON n_nationkey = team_id GROUP BY 1)
        SELECT *, CASE WHEN teams <= 0 THEN 'failed' WHEN teams >= 5 AND players >= 60 AND entries >= 600 THEN 'ready' WHEN teams >= 5 AND players > 0 AND entries > 0 THEN 'partial' ELSE 'not_ready' END AS state FROM l""",
    "feature_leaks": f"WITH {_LEAKS} SELECT player_id, strftime(as_of, '%Y-%m-%d') AS as_of, records, future, strftime(first_future, '%Y-%m-%d') AS first_future FROM leaks",
    "leak_report": f"WITH {_LEAKS} SELECT count(*) AS sets, count(*) FILTER (future > 0) AS unsafe_sets, coalesce(sum(future), 0) AS future_records, 'Post-Game rate,target_hit' AS suspicious, false AS safe FROM leaks",
    "shared_names": """SELECT 'name' AS "check", p_partkey::VARCHAR AS "key", p_name AS detail FROM (SELECT *, count(*) OVER (PARTITION BY p_name) AS n FROM part WHERE p_name <> '') WHERE n > 1""",
    "team_places": f"""WITH {GAME_LOG_SQL}, s AS (SELECT team_id, player_id, coalesce(CASE WHEN sum(at_bats) >= 20 THEN round(sum(hits) / sum(at_bats) * 100, 4) END, 0) AS score FROM log GROUP BY 1, 2),
        w AS (SELECT *, row_number() OVER t AS place, first_value(player_id) OVER t AS winner, max(score) OVER (PARTITION BY team_id) AS most FROM s WINDOW t AS (PARTITION BY team_id ORDER BY score DESC, player_id)) SELECT team_id, player_id, score, place, winner, round(most - score, 4) AS behind FROM w""",
    "interaction_memory": f"{_memory_sql()} SELECT * FROM records",
    "unsaid_names": f"""{_memory_sql()}, meant AS (SELECT conv_id, {_LOW.format("message")} AS phrase, 'player' AS entity_type, player AS canonical FROM records UNION ALL SELECT conv_id, {_LOW.format("message")}, 'team', team FROM records)
        SELECT entity_type, canonical, phrase, count(*) AS used, count(DISTINCT conv_id) AS conversations FROM meant WHERE phrase <> '' AND {_LOW.format("canonical")} <> '' AND NOT contains(phrase, {_LOW.format("canonical")}) GROUP BY 1, 2, 3""",
}
