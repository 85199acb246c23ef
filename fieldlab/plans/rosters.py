"""Rosters, imports and audits: coverage and readiness, reconciliation, duplicates, gates, and set operations on schemas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlab.sources.tables import GAME_LOG_SQL, game_log, table

#: Import categories that are expected (one of them is never seen), and groups of features with what they need.
CATEGORIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NONE"]
GROUPS = {"core": ["1-URGENT", "2-HIGH"], "tracking": ["3-MEDIUM", "4-NOT SPECIFIED", "6-NONE"], "tempo": ["5-LOW"]}
#: Tables and fields of a profile, for availability.
COMPONENTS = {"identity": 0.20, "season": 0.30, "form": 0.25, "tracking": 0.25}


def import_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as import files: files by status, rows written, and whether a category is loaded; absent ones are 0."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    orders = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")
    found = orders.groupBy(F.col("o_orderpriority").alias("category")).agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("completed"), F.count_if(F.col("o_orderstatus") == "O").alias("failed"), F.count_if(F.col("o_orderstatus") == "P").alias("skipped"),
        F.sum(F.when(F.col("o_orderstatus") == "F", F.coalesce("n", F.lit(0))).otherwise(0)).alias("affected"),
    )
    names = spark.createDataFrame([(c,) for c in CATEGORIES], "category string")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("completed", "failed", "skipped", "affected")]
    return names.join(found, "category", "left").select("category", *zero).withColumn("loaded", (F.col("completed") > 0) & (F.col("affected") > 0))


def group_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature groups by the categories that they need: how many are loaded, files and rows, and readiness (all loaded,
    three files, a hundred rows)."""
    cover = import_coverage(spark, sf_dir)
    needs = spark.createDataFrame([(g, c) for g, cs in GROUPS.items() for c in cs], "feature_group string, category string")
    found = needs.join(cover, "category", "left").groupBy("feature_group").agg(
        F.count(F.lit(1)).alias("required"), F.count_if("loaded").alias("loaded"), F.sum("completed").alias("files"), F.sum("affected").alias("rows"), F.bool_and("loaded").alias("whole")
    )
    ready = F.col("whole") & (F.col("files") >= 3) & (F.col("rows") >= 100)
    return found.select("feature_group", F.round(F.col("loaded") / F.col("required"), 4).alias("coverage"), "files", "rows", ready.alias("ready"))


def roster_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teams with players, their share in percent, and the least, most and mean roster."""
    sizes = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    rows = table(spark, sf_dir, "nation").join(sizes, "n_nationkey", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return rows.agg(
        F.count(F.lit(1)).alias("teams"), F.count_if(F.col("n") > 0).alias("with_players"), F.round(F.count_if(F.col("n") > 0) * 100 / F.count(F.lit(1)), 2).alias("percent"),
        F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 2).alias("mean"),
    )


def changed_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each brand the sorted list of sizes that it has and that it lacks; a size is one of fifty, so lists are short."""
    rows = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sort_array(F.collect_set("p_size")).alias("has"))
    every = F.sequence(F.lit(1), F.lit(50))
    text = lambda xs: F.array_join(F.transform(xs, lambda x: x.cast("string")), ",")
    return rows.select("p_brand", text("has").alias("has"), text(F.array_except(every, F.col("has"))).alias("lacks"))


def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns by role: how many fell back (no question word), asked back, and their shares."""
    text = F.lower(F.coalesce("text", F.lit("")))
    rows = table(spark, sf_dir, "conversations").select("role", (~text.rlike(r"\b(what|who|that|der)\b")).alias("fell"), text.rlike(r"\?").alias("asked"))
    share = lambda c: F.round(F.count_if(c) / F.count(F.lit(1)), 6)
    return rows.groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.count_if("fell").alias("fallbacks"), share("fell").alias("fallback_rate"), share("asked").alias("clarification_rate"))


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known cells of all cells of events, by type; small values and short props count as unknown."""
    fields = [F.when(F.col("value") > 20, 1), F.when(F.length("props") > 7, 1), F.when(F.col("user_id").isNotNull(), 1)]
    known = reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0)) for x in fields])
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.sum(known) / (F.count(F.lit(1)) * len(fields)), 6).alias("completeness"))


_PRIORITY = [("1-URGENT", 400), ("2-HIGH", 300), ("3-MEDIUM", 200), ("4-NOT SPECIFIED", 100)]


def current_team(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The team of each player by its memberships: the roster kind first, then the latest, then the highest key."""
    rank = reduce(lambda w, s: w.when(F.col("o_orderpriority") == s[0], s[1]), _PRIORITY[1:], F.when(F.col("o_orderpriority") == _PRIORITY[0][0], _PRIORITY[0][1])).otherwise(0)
    rows = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 30).alias("team"), rank.alias("rank"), "o_orderdate", "o_orderkey")
    best = rows.groupBy("o_custkey").agg(F.max(F.struct("rank", "o_orderdate", "o_orderkey", "team")).alias("x"), F.count_distinct("team").alias("teams"))
    return best.select("o_custkey", "x.team", "x.rank", "teams")


def roster_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts on several suppliers' lists: the first list by name keeps it; how many more there are, and whether flags differ."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey")
    found = rows.groupBy("l_partkey").agg(F.min("s_name").alias("kept"), (F.count(F.lit(1)) - 1).alias("duplicates"), (F.count_distinct("l_returnflag") > 1).alias("conflict"))
    return found


def newest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inventory report: the hundred newest orders, newest first."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(100)


def best_of_team(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best player of each team for each outcome by shrunk probability, with how many it was chosen from."""
    rows = game_log(spark, sf_dir).groupBy("team_id", "player_id").agg(*[F.sum(c).alias(c) for c in ("plate_appearances", "hits", "home_runs", "walks")])
    long = rows.unpivot(["team_id", "player_id", "plate_appearances"], ["hits", "home_runs", "walks"], "outcome", "seen")
    prior = F.create_map(F.lit("hits"), F.lit(0.23), F.lit("home_runs"), F.lit(0.031), F.lit("walks"), F.lit(0.085))
    p = (prior[F.col("outcome")] * 120 + F.col("seen")) / (120 + F.col("plate_appearances"))
    best = F.max_by(F.struct("player_id", "p"), F.struct("p", -F.col("player_id")))  # combined within each task, no window over a team
    found = long.withColumn("p", F.round(p, 9)).groupBy("team_id", "outcome").agg(best.alias("best"), F.count(F.lit(1)).alias("of"))
    return found.select("team_id", "outcome", F.col("best.player_id").alias("player_id"), F.round("best.p", 6).alias("p"), "of")


def player_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each player beside the next one of its team by number: overall scores (unknown as 0) and the winner."""
    rows = game_log(spark, sf_dir).groupBy("team_id", "player_id").agg(F.sum("hits").alias("h"), F.sum("at_bats").alias("ab"))
    score = F.when(F.col("ab") >= 20, F.round(F.col("h") / F.col("ab") * 100, 4))
    order = Window.partitionBy("team_id").orderBy("player_id")
    pairs = rows.select("team_id", "player_id", F.coalesce(score, F.lit(0.0)).alias("score")).withColumns({"other_id": F.lead("player_id").over(order), "other_score": F.lead("score").over(order)})
    winner = F.when(F.col("other_score") > F.col("score"), F.col("other_id")).otherwise(F.col("player_id"))
    return pairs.where("other_id is not null").withColumn("winner", winner)


def aligned_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two feature tables under the union of their names; what a table lacks is 0."""
    events = table(spark, sf_dir, "events").select(F.concat(F.lit("e"), "event_id").alias("id"), "value", F.length("props").cast("double").alias("props_size"))
    orders = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_custkey").cast("double").alias("value"))
    return events.unionByName(orders, allowMissingColumns=True).fillna(0.0)


def merged_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of a user from four sources in order of trust: the first known kind, and all kinds in that order
    without repeats (there are but a few kinds)."""
    events = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_event"), F.max_by("event_type", F.struct("value", "event_id")).alias("top_event"))
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("last_order"))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment")
    rows = people.join(events, "id", "left").join(orders, "id", "left")
    kinds = F.array_distinct(F.array_compact(F.array("last_event", "top_event", "last_order", "c_mktsegment")))
    return rows.select("id", F.get(kinds, F.lit(0)).alias("first"), F.array_join(kinds, "|").alias("kinds"))


def rostered_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that have an order of the highest priority, each once: a semi join."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(urgent, "c_custkey", "left_semi").select("c_custkey", "c_name")


def context_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games with the context that is known of (customer, day): of several the last one holds."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("o_custkey"), F.dayofmonth("ts").alias("day"), "ts", "event_id", "value")
    last = events.groupBy("o_custkey", "day").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.dayofmonth("o_orderdate").alias("day"))
    return orders.join(last, ["o_custkey", "day"], "left").select("o_orderkey", "value")


def with_opponents(log: DataFrame) -> DataFrame:
    """The log with each game's opponent: the team so many numbers on as the game's key says."""
    return log.withColumn("opponent_id", ((F.col("team_id") + 1 + F.col("game_id") % 24) % 25).cast("int"))


def _before(rows: DataFrame, keys: list[str], sums: dict[str, str]) -> DataFrame:
    """keys, game_date, and sums over all rows of the keys at strictly earlier dates: summed up by date first."""
    daily = rows.groupBy(*keys, "game_date").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    past = Window.partitionBy(*keys).orderBy("game_date").rowsBetween(Window.unboundedPreceding, -1)
    return daily.select(*keys, "game_date", *[F.sum(n).over(past).alias(n) for n in sums])


def opponent_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each game with what the opponent's games before its date came to. Days without games of the opponent are put on its
    time line, so a running sum answers every question; there is no range join."""
    log = with_opponents(game_log(spark, sf_dir))
    asked = log.select(F.col("opponent_id").alias("team_id"), "game_date").distinct()
    zero = asked.select("team_id", "game_date", *[F.lit(0).cast("long").alias(c) for c in ("hits", "at_bats", "home_runs", "plate_appearances", "runs", "n")])
    seen = log.select("team_id", "game_date", "hits", "at_bats", "home_runs", "plate_appearances", "runs", F.lit(1).cast("long").alias("n"))
    past = _before(seen.unionByName(zero), ["team_id"], {c: c for c in ("hits", "at_bats", "home_runs", "plate_appearances", "runs", "n")})
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)) + 1e-10, 6)
    c = F.col
    found = past.select(c("team_id").alias("opponent_id"), "game_date", rate(c("hits"), c("at_bats")).alias("opponent_avg"), rate(c("home_runs"), c("plate_appearances")).alias("opponent_hr_rate"), rate(c("runs"), c("n")).alias("opponent_runs"))
    return log.select("player_id", "game_id", "opponent_id", "game_date").join(found, ["opponent_id", "game_date"]).select("player_id", "game_id", "opponent_id", "opponent_avg", "opponent_hr_rate", "opponent_runs")


def matchup_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each game with the player's and the pitcher's earlier games and their earlier meetings; the pitcher is the opponent
    team's one of that hand."""
    log = with_opponents(game_log(spark, sf_dir)).withColumn("pitcher_id", F.concat_ws("-", "opponent_id", "pitcher_throws"))
    rows = log.select("player_id", "pitcher_id", "game_id", "game_date", "hits", "at_bats", "home_runs", "plate_appearances")
    sums = {"h": "hits", "ab": "at_bats", "hr": "home_runs", "pa": "plate_appearances"}
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)) + 1e-10, 6)

    def part(keys: list[str], prefix: str) -> DataFrame:
        past = _before(rows, keys, sums)
        return past.select(*keys, "game_date", rate(F.col("h"), F.col("ab")).alias(f"{prefix}_avg"), rate(F.col("hr"), F.col("pa")).alias(f"{prefix}_hr_rate"))

    met = _before(rows, ["player_id", "pitcher_id"], sums).select("player_id", "pitcher_id", "game_date", F.coalesce("pa", F.lit(0)).alias("matchup_pa"), F.coalesce("h", F.lit(0)).alias("matchup_hits"))
    out = rows.join(part(["player_id"], "batter"), ["player_id", "game_date"]).join(part(["pitcher_id"], "pitcher"), ["pitcher_id", "game_date"]).join(met, ["player_id", "pitcher_id", "game_date"])
    return out.select("player_id", "game_id", "pitcher_id", "batter_avg", "batter_hr_rate", "pitcher_avg", "pitcher_hr_rate", "matchup_pa", "matchup_hits")


# --- audits and gates


def roster_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of what is wrong with the roster, and whether the gate opens: customers without orders, orders without a
    customer, names held by several ids, rows without a balance, customers without a nation."""
    people, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    keys = orders.select(F.col("o_custkey").alias("c_custkey")).distinct()
    names = people.groupBy(F.lower(F.trim("c_mktsegment")).alias("name"), F.round("c_acctbal", -3).alias("about")).agg(F.count_distinct("c_custkey").alias("n")).where("n > 1")
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("check"), "n")
    checks = [
        one(people.join(keys, "c_custkey", "left_anti"), "without_orders"), one(keys.join(people, "c_custkey", "left_anti"), "orphaned_orders"), one(names, "same_name_groups"),
        one(people.where("c_acctbal <= -900"), "incomplete"), one(people.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left_anti"), "without_team"),
    ]
    found = reduce(DataFrame.unionByName, checks)
    return found.withColumn("gate", F.when((F.col("n") > 0) & F.col("check").isin("orphaned_orders", "without_team", "incomplete"), "closed").otherwise("open"))


def structure_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teams by division against the five expected, and members by division."""
    people = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("players"))
    rows = table(spark, sf_dir, "nation").join(people, "n_nationkey", "left").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("teams"), F.count_distinct("n_name").alias("names"), F.sum(F.coalesce("players", F.lit(0))).alias("players"))
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name").join(rows, "n_regionkey", "left").select(
        "r_name", F.coalesce("teams", F.lit(0)).alias("teams"), F.coalesce("players", F.lit(0)).alias("players"), (F.coalesce(F.col("teams") == 5, F.lit(False)) & (F.col("teams") == F.col("names"))).alias("balanced")
    )


def warehouse_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of the warehouse by category: expected, there with rows, and percent; tables that can't be read are absent."""
    expected = {"core": ["region", "nation", "customer", "supplier"], "facts": ["orders", "lineitem", "events"], "texts": ["documents", "pages", "conversations", "labels"], "models": ["predictions"]}
    known = {"region", "nation", "customer", "supplier", "orders", "lineitem", "events", "documents", "pages", "conversations", "labels"}
    counts = [table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n") for ts in expected.values() for t in ts if t in known]
    names = spark.createDataFrame([(c, t) for c, ts in expected.items() for t in ts], "category string, name string")
    rows = names.join(reduce(DataFrame.unionByName, counts), "name", "left")
    return rows.groupBy("category").agg(F.count(F.lit(1)).alias("expected"), F.count_if(F.coalesce(F.col("n") > 0, F.lit(False))).alias("present")).withColumn("percent", F.round(F.col("present") * 100 / F.col("expected"), 2))


def _profile_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = game_log(spark, sf_dir)
    latest = Window.partitionBy("player_id").orderBy(F.desc("game_date"), F.desc("game_id"))
    games = log.groupBy("player_id").agg(F.count(F.lit(1)).alias("games"), F.sum("plate_appearances").alias("pa"), F.sum("hits").alias("hits"), F.sum("home_runs").alias("home_runs"))
    form = log.withColumn("at", F.row_number().over(latest)).where("at <= 10").groupBy("player_id").agg(F.count(F.lit(1)).alias("recent"))
    events = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("player_id")).agg(F.count(F.lit(1)).alias("events"), F.count_distinct("event_type").alias("kinds"))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("player_id"), "c_name", "c_acctbal")
    return people.join(games, "player_id", "left").join(form, "player_id", "left").join(events, "player_id", "left")


def profile_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ready parts of each profile and the weighted score (.20 identity, .30 season, .25 form, .25 tracking): a part is ready
    from nine tenths of its fields; the whole at 90, partial at 50."""
    rows = _profile_parts(spark, sf_dir)
    known = lambda *cs: reduce(lambda a, b: a + b, [F.when(c, 1.0).otherwise(0.0) for c in cs]) / len(cs)
    c = F.col
    parts = {
        "identity": known(c("c_name").isNotNull(), c("c_acctbal") > 0), "season": known(c("games").isNotNull(), c("pa") >= 50, c("home_runs") > 0),
        "form": F.least(F.coalesce("recent", F.lit(0)) / 10, F.lit(1.0)), "tracking": F.least(F.coalesce("kinds", F.lit(0)) / 5, F.lit(1.0)),
    }
    score = reduce(lambda a, b: a + b, [parts[k] * w for k, w in COMPONENTS.items()]) * 100
    ready = reduce(lambda a, b: a + b, [(p >= 0.9).cast("int") for p in parts.values()])
    status = F.when(F.round(score, 6) >= 90, "ready").when(F.round(score, 6) >= 50, "partial").otherwise("not_ready")
    return rows.select("player_id", ready.alias("ready_parts"), F.round(score, 4).alias("score"), status.alias("status"))


def dataset_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of datasets that hold anything of a player; ready at 0.65."""
    rows = _profile_parts(spark, sf_dir)
    sets = [F.col("c_name").isNotNull(), F.col("games").isNotNull(), F.coalesce(F.col("recent") >= 5, F.lit(False)), F.col("events").isNotNull()]
    share = reduce(lambda a, b: a + b, [s.cast("int") for s in sets]) / len(sets)
    return rows.select("player_id", F.round(share, 4).alias("share"), (share >= 0.65).alias("ready"))


def metric_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Displayed metrics of each player: available with its sample or pending, and the percent available; ready at 50."""
    rows = _profile_parts(spark, sf_dir)
    some = lambda c, least: F.when(F.col(c) >= least, F.col(c).cast("double")).alias(c)
    long = rows.select("player_id", some("games", 1), some("pa", 25), some("hits", 10), some("home_runs", 5), some("events", 1)).unpivot("player_id", ["games", "pa", "hits", "home_runs", "events"], "metric", "value")
    found = long.groupBy("player_id").agg(F.count("value").alias("available"), F.count(F.lit(1)).alias("total"), F.sort_array(F.collect_list(F.when(F.col("value").isNull(), F.col("metric")))).alias("p"))
    percent = F.round(F.col("available") * 100 / F.col("total"), 2)
    return found.select("player_id", "available", percent.alias("percent"), F.array_join("p", ",").alias("pending"), (percent >= 50).alias("ready"))


def data_truth_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of five layers, the requirements that they miss, and coverage (15, 20, 25, 15, 25); the gate opens at 65."""
    need = [("teams", "nation", 25, 15), ("players", "customer", 100, 20), ("games", "orders", 1000, 25), ("signals", "events", 5000, 15), ("lines", "lineitem", 5000, 25)]
    one = [table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("layer"), "n", F.lit(least).alias("least"), F.lit(w).alias("weight")) for k, t, least, w in need]
    rows = reduce(DataFrame.unionByName, one)
    met = F.col("n") >= F.col("least")
    score = F.sum(F.when(met, F.col("weight")).otherwise(0))
    return rows.agg(score.alias("score"), F.count_if(~met).alias("missing"), F.array_join(F.sort_array(F.collect_list(F.when(~met, F.col("layer")))), ",").alias("layers"), (score >= 65).alias("open"))


def load_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Teams by the size of their roster against what a load should bring: ready, partial, not ready or failed."""
    sizes = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("active"))
    rows = table(spark, sf_dir, "nation").join(sizes, "n_nationkey", "left")
    n, active = F.coalesce("n", F.lit(0)), F.coalesce("active", F.lit(0))
    status = F.when(n == 0, "failed").when((n >= 8) & (active >= 6), "ready").when(n >= 4, "partial").otherwise("not_ready")
    return rows.select("n_nationkey", n.alias("players"), active.alias("active"), status.alias("status"))


QUERIES = {f.__name__: f for f in (
    import_coverage, group_readiness, roster_coverage, changed_lists, run_metrics, completeness, current_team, roster_dedupe, newest_orders, best_of_team, player_comparison, aligned_union, merged_entities,
    rostered_players, context_join, opponent_features, matchup_features, roster_audit, structure_balance, warehouse_status, profile_readiness, dataset_availability, metric_availability, data_truth_gate, load_readiness,
)}

_LOG = f"WITH {GAME_LOG_SQL}"
_COVER = """n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), f AS (SELECT o_orderpriority AS category, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus = 'O') AS failed,
    count(*) FILTER (o_orderstatus = 'P') AS skipped, coalesce(sum(n) FILTER (o_orderstatus = 'F'), 0)::BIGINT AS affected FROM orders LEFT JOIN n ON l_orderkey = o_orderkey GROUP BY 1),
    cover AS (SELECT category, coalesce(completed, 0) AS completed, coalesce(failed, 0) AS failed, coalesce(skipped, 0) AS skipped, coalesce(affected, 0) AS affected, coalesce(completed > 0 AND affected > 0, false) AS loaded
    FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW'), ('6-NONE')) v(category) LEFT JOIN f USING (category))"""
_PARTS = f"""{_LOG}, g AS (SELECT player_id, count(*) AS games, sum(plate_appearances) AS pa, sum(hits) AS hits, sum(home_runs) AS home_runs FROM log GROUP BY 1), e AS (SELECT user_id, count(*) AS events, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1),
    p AS (SELECT c_custkey AS player_id, c_acctbal, games, pa, hits, home_runs, least(games, 10) AS recent, events, kinds FROM customer LEFT JOIN g ON g.player_id = c_custkey LEFT JOIN e ON user_id = c_custkey)"""
ORACLE_SQL = {
    "import_coverage": f"WITH {_COVER} SELECT * FROM cover",
    "group_readiness": f"""WITH {_COVER}, q(feature_group, category) AS (VALUES ('core', '1-URGENT'), ('core', '2-HIGH'), ('tracking', '3-MEDIUM'), ('tracking', '4-NOT SPECIFIED'), ('tracking', '6-NONE'), ('tempo', '5-LOW'))
        SELECT feature_group, round(count(*) FILTER (loaded) / count(*), 4) AS coverage, sum(completed)::BIGINT AS files, sum(affected)::BIGINT AS rows, bool_and(loaded) AND sum(completed) >= 3 AND sum(affected) >= 100 AS ready FROM q JOIN cover USING (category) GROUP BY 1""",
    "roster_coverage": """WITH x AS (SELECT n_nationkey, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1) SELECT count(*) AS teams, count(*) FILTER (n > 0) AS with_players, round(100.0::DOUBLE * count(*) FILTER (n > 0) / count(*), 2) AS percent,
        min(n) AS least, max(n) AS most, round(avg(n), 2) AS mean FROM x""",
    "changed_lists": """SELECT p_brand, string_agg(DISTINCT p_size, ',' ORDER BY p_size) AS has, array_to_string(list_filter(range(1, 51), lambda k: NOT list_contains(list(p_size::BIGINT), k)), ',') AS lacks FROM part GROUP BY 1""",
    "run_metrics": """SELECT role, count(*) AS turns, count(*) FILTER (NOT f) AS fallbacks, round(count(*) FILTER (NOT f) / count(*), 6) AS fallback_rate, round(count(*) FILTER (contains(text, '?')) / count(*), 6) AS clarification_rate
        FROM (SELECT role, text, regexp_matches(lower(coalesce(text, '')), '\\b(what|who|that|der)\\b') AS f FROM conversations) GROUP BY 1""",
    "completeness": "SELECT event_type, round(avg((value > 20)::INT + (length(props) > 7)::INT + (user_id IS NOT NULL)::INT) / 3, 6) AS completeness FROM events GROUP BY 1",
    "current_team": """WITH x AS (SELECT o_custkey, o_orderkey % 30 AS team, CASE o_orderpriority WHEN '1-URGENT' THEN 400 WHEN '2-HIGH' THEN 300 WHEN '3-MEDIUM' THEN 200 WHEN '4-NOT SPECIFIED' THEN 100 ELSE 0 END AS rank, o_orderdate, o_orderkey FROM orders)
        SELECT o_custkey, arg_max(team, (rank, o_orderdate, o_orderkey)) AS team, max(rank) AS rank, count(DISTINCT team) AS teams FROM x GROUP BY 1""",
    "roster_dedupe": "SELECT l_partkey, min(s_name) AS kept, count(*) - 1 AS duplicates, min(l_returnflag) <> max(l_returnflag) AS conflict FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1",
    "newest_orders": "SELECT o_orderkey, o_orderdate, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100",
    "best_of_team": f"""{_LOG}, s AS (SELECT team_id, player_id, sum(plate_appearances) AS n, sum(hits) AS h, sum(home_runs) AS hr, sum(walks) AS w FROM log GROUP BY 1, 2),
        u AS (SELECT team_id, player_id, 'hits' AS outcome, round((27.6e0 + h) / (120 + n), 9) AS p FROM s UNION ALL SELECT team_id, player_id, 'home_runs', round((3.72e0 + hr) / (120 + n), 9) FROM s UNION ALL SELECT team_id, player_id, 'walks', round((10.2e0 + w) / (120 + n), 9) FROM s)
        SELECT team_id, outcome, first(player_id ORDER BY p DESC, player_id) AS player_id, round(max(p), 6) AS p, count(*) AS of FROM u GROUP BY 1, 2""",
    "player_comparison": f"""{_LOG}, s AS (SELECT team_id, player_id, CASE WHEN sum(at_bats) >= 20 THEN round(100e0 * sum(hits) / sum(at_bats), 4) ELSE 0 END AS score FROM log GROUP BY 1, 2),
        p AS (SELECT *, lead(player_id) OVER w AS other_id, lead(score) OVER w AS other_score FROM s WINDOW w AS (PARTITION BY team_id ORDER BY player_id)) SELECT *, CASE WHEN other_score > score THEN other_id ELSE player_id END AS winner FROM p WHERE other_id IS NOT NULL""",
    "aligned_union": "SELECT 'e' || event_id AS id, value, length(props)::DOUBLE AS props_size, 0e0 AS price FROM events UNION ALL SELECT 'o' || o_orderkey, o_custkey::DOUBLE, 0, o_totalprice FROM orders",
    "merged_entities": """WITH e AS (SELECT user_id AS id, arg_max(event_type, (ts, event_id)) AS a, arg_max(event_type, (value, event_id)) AS b FROM events GROUP BY 1), o AS (SELECT o_custkey AS id, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS c FROM orders GROUP BY 1)
        SELECT c_custkey AS id, coalesce(a, b, c, c_mktsegment) AS first, concat_ws('|', a, CASE WHEN b <> a THEN b END, c, c_mktsegment) AS kinds FROM customer LEFT JOIN e ON e.id = c_custkey LEFT JOIN o ON o.id = c_custkey""",
    "rostered_players": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "context_join": """WITH l AS (SELECT user_id, day(ts) AS d, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2) SELECT o_orderkey, value FROM orders LEFT JOIN l ON user_id = o_custkey AND d = day(o_orderdate)""",
    "opponent_features": f"""{_LOG}, x AS (SELECT *, ((team_id + 1 + game_id % 24) % 25)::INT AS opponent_id FROM log), d AS (SELECT team_id, game_date, sum(hits) AS h, sum(at_bats) AS ab, sum(home_runs) AS hr, sum(plate_appearances) AS pa, sum(runs) AS r, count(*) AS n FROM log GROUP BY 1, 2)
        SELECT x.player_id, x.game_id, x.opponent_id, round(coalesce(sum(d.h) / nullif(sum(d.ab), 0), 0) + 1e-10, 6) AS opponent_avg, round(coalesce(sum(d.hr) / nullif(sum(d.pa), 0), 0) + 1e-10, 6) AS opponent_hr_rate, round(coalesce(sum(d.r) / nullif(sum(d.n), 0), 0) + 1e-10, 6) AS opponent_runs
        FROM x LEFT JOIN d ON d.team_id = x.opponent_id AND d.game_date < x.game_date GROUP BY 1, 2, 3""",
    "matchup_features": f"""{_LOG}, x AS (SELECT *, ((team_id + 1 + game_id % 24) % 25)::INT || '-' || pitcher_throws AS pitcher_id FROM log),
        p AS (SELECT pitcher_id, game_date, sum(hits) AS h, sum(at_bats) AS ab, sum(home_runs) AS hr, sum(plate_appearances) AS pa FROM x GROUP BY 1, 2),
        b AS (SELECT c.game_id, sum(o.hits) / nullif(sum(o.at_bats), 0) AS ba, sum(o.home_runs) / nullif(sum(o.plate_appearances), 0) AS bh, coalesce(sum(o.plate_appearances) FILTER (o.pitcher_id = c.pitcher_id), 0)::BIGINT AS mp,
            coalesce(sum(o.hits) FILTER (o.pitcher_id = c.pitcher_id), 0)::BIGINT AS mh FROM x c LEFT JOIN x o ON o.player_id = c.player_id AND o.game_date < c.game_date GROUP BY 1),
        q AS (SELECT c.game_id, sum(h) / nullif(sum(ab), 0) AS pa, sum(hr) / nullif(sum(p.pa), 0) AS ph FROM x c LEFT JOIN p ON p.pitcher_id = c.pitcher_id AND p.game_date < c.game_date GROUP BY 1)
        SELECT player_id, game_id, pitcher_id, round(coalesce(ba, 0) + 1e-10, 6) AS batter_avg, round(coalesce(bh, 0) + 1e-10, 6) AS batter_hr_rate, round(coalesce(q.pa, 0) + 1e-10, 6) AS pitcher_avg, round(coalesce(ph, 0) + 1e-10, 6) AS pitcher_hr_rate, mp AS matchup_pa, mh AS matchup_hits
        FROM x JOIN b USING (game_id) JOIN q USING (game_id)""",
    "roster_audit": """WITH c("check", n) AS (SELECT 'without_orders', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'orphaned_orders', count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
        UNION ALL SELECT 'same_name_groups', count(*) FROM (SELECT lower(c_mktsegment), round(c_acctbal, -3) FROM customer GROUP BY 1, 2 HAVING count(*) > 1) UNION ALL SELECT 'incomplete', count(*) FROM customer WHERE c_acctbal <= -900
        UNION ALL SELECT 'without_team', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)) SELECT *, CASE WHEN n > 0 AND "check" IN ('orphaned_orders', 'without_team', 'incomplete') THEN 'closed' ELSE 'open' END AS gate FROM c""",
    "structure_balance": """SELECT r_name, count(DISTINCT n_nationkey) AS teams, count(c_custkey) AS players, count(DISTINCT n_nationkey) = 5 AND count(DISTINCT n_name) = 5 AS balanced FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1""",
    "warehouse_status": """WITH t(category, n) AS (SELECT 'core', count(*) FROM region UNION ALL SELECT 'core', count(*) FROM nation UNION ALL SELECT 'core', count(*) FROM customer UNION ALL SELECT 'core', count(*) FROM supplier UNION ALL SELECT 'facts', count(*) FROM orders UNION ALL
        SELECT 'facts', count(*) FROM lineitem UNION ALL SELECT 'facts', count(*) FROM events UNION ALL SELECT 'texts', count(*) FROM documents UNION ALL SELECT 'texts', count(*) FROM pages UNION ALL SELECT 'texts', count(*) FROM conversations UNION ALL SELECT 'texts', count(*) FROM labels
        UNION ALL SELECT 'models', 0) SELECT category, count(*) AS expected, count(*) FILTER (n > 0) AS present, round(100e0 * count(*) FILTER (n > 0) / count(*), 2) AS percent FROM t GROUP BY 1""",
    "profile_readiness": f"""{_PARTS}, q AS (SELECT player_id, (1 + (c_acctbal > 0)::INT) / 2e0 AS i, ((games IS NOT NULL)::INT + coalesce(pa >= 50, false)::INT + coalesce(home_runs > 0, false)::INT) / 3e0 AS s, least(coalesce(games, 0), 10) / 10e0 AS f, coalesce(kinds, 0) / 5e0 AS t FROM p),
        z AS (SELECT *, 20 * i + 30 * s + 25 * f + 25 * t AS score FROM q) SELECT player_id, ((i >= 0.9)::INT + (s >= 0.9)::INT + (f >= 0.9)::INT + (t >= 0.9)::INT)::INT AS ready_parts, round(score, 4) AS score,
        CASE WHEN round(score, 6) >= 90 THEN 'ready' WHEN round(score, 6) >= 50 THEN 'partial' ELSE 'not_ready' END AS status FROM z""",
    "dataset_availability": f"""{_PARTS}, q AS (SELECT player_id, (1 + (games IS NOT NULL)::INT + coalesce(games >= 5, false)::INT + (events IS NOT NULL)::INT) / 4e0 AS s FROM p) SELECT player_id, round(s, 4) AS share, s >= 0.65 AS ready FROM q""",
    "metric_availability": f"""{_PARTS}, q AS (SELECT player_id, concat_ws(',', CASE WHEN events IS NULL THEN 'events' END, CASE WHEN games IS NULL THEN 'games' END, CASE WHEN coalesce(hits, 0) < 10 THEN 'hits' END, CASE WHEN coalesce(home_runs, 0) < 5 THEN 'home_runs' END,
        CASE WHEN coalesce(pa, 0) < 25 THEN 'pa' END) AS pending FROM p), r AS (SELECT *, 5 - len(list_filter(string_split(pending, ','), lambda x: x <> '')) AS available FROM q) SELECT player_id, available, available * 20e0 AS percent, pending, available * 20 >= 50 AS ready FROM r""",
    "data_truth_gate": """WITH c(layer, n, least, w) AS (SELECT 'teams', count(*), 25, 15 FROM nation UNION ALL SELECT 'players', count(*), 100, 20 FROM customer UNION ALL SELECT 'games', count(*), 1000, 25 FROM orders UNION ALL SELECT 'signals', count(*), 5000, 15 FROM events
        UNION ALL SELECT 'lines', count(*), 5000, 25 FROM lineitem) SELECT coalesce(sum(w) FILTER (n >= least), 0)::BIGINT AS score, count(*) FILTER (n < least) AS missing, coalesce(string_agg(layer, ',' ORDER BY layer) FILTER (n < least), '') AS layers, coalesce(sum(w) FILTER (n >= least), 0) >= 65 AS open FROM c""",
    "load_readiness": """WITH x AS (SELECT n_nationkey, count(c_custkey) AS players, count(c_custkey) FILTER (c_acctbal > 0) AS active FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)
        SELECT *, CASE WHEN players = 0 THEN 'failed' WHEN players >= 8 AND active >= 6 THEN 'ready' WHEN players >= 4 THEN 'partial' ELSE 'not_ready' END AS status FROM x""",
}
