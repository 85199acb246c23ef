"""Projections, predicates and ladders: filters, search, statuses, flags, targets, names, times and small features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlab.operators import profiles
from fieldlab.operators.profiles import hitter_profiles
from fieldlab.sources.tables import GAME_LOG_SQL, game_log, table

# fixed values
INJURED = ("injured", "il10", "il15", "il60", "day-to-day", "rehab")
SUSPICIOUS = ("final_", "result_", "actual_", "postgame_", "post_game_", "target_", "winner", "outcome_")
OUTCOME_NAMES = {"hr": "home_run", "homer": "home_run", "homerun": "home_run", "k": "strikeout", "so": "strikeout", "bb": "walk", "h": "hit", "1b": "single", "2b": "double", "3b": "triple", "tb": "total_bases", "r": "run"}
RESOLVED = ("resolved", "scored", "training_ready", "final", "complete", "completed")


def ladder(x: Column, steps: list[tuple[object, str]], default: str | None = None) -> Column:
    """The name of the first step at or below x; null for a null x."""
    out = reduce(lambda w, s: w.when(x >= s[0], s[1]), steps, F.when(x.isNull(), None))
    return out.otherwise(default)


def with_filters(df: DataFrame, **wanted: object) -> DataFrame:
    """df where every given column equals its value; those given as None don't filter."""
    return reduce(lambda d, kv: d if kv[1] is None else d.where(F.col(kv[0]) == F.lit(kv[1])), wanted.items(), df)


def any_word(text: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words]), F.lit(False))


# --- projections and predicates


def strict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Singles and a rate that are null where a part is: small values count as missing; nothing is made up as 0."""
    c = F.col
    some = lambda name, gap: F.when(c(name) > gap, c(name)).alias(name)
    rows = game_log(spark, sf_dir).select("game_id", some("hits", -1), some("doubles", 0), "triples", "home_runs", some("at_bats", 1))
    single = F.when(c("hits").isNotNull() & c("doubles").isNotNull(), F.greatest(c("hits") - c("doubles") - c("triples") - c("home_runs"), F.lit(0)))
    return rows.select("game_id", single.alias("singles"), F.round(F.try_divide("hits", "at_bats"), 6).alias("avg"))


def season_team_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games of one season of the teams of one hand; a filter that isn't given doesn't filter."""
    rows = with_filters(game_log(spark, sf_dir), season=1996, team_id=None, pitcher_throws="L")
    return rows.select("player_id", "game_id", "team_id")


def name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that match "Large bolt" by the ladder equal 100, equal without blanks 98, containing 90, without blanks 86, all
    words 78, one word 70."""
    asked = "large bolt"
    low, tight = F.lower("p_name"), F.regexp_replace(F.lower("p_name"), "[^a-z0-9]", "")
    words = asked.split()
    found = lambda all_: reduce((lambda a, b: a & b) if all_ else (lambda a, b: a | b), [F.contains(low, F.lit(w)) for w in words])
    together = asked.replace(" ", "")
    score = (
        F.when(low == asked, 100).when(tight == together, 98).when(F.contains(low, F.lit(asked)), 90)
        .when(F.contains(tight, F.lit(together)), 86).when(found(True), 78).when(found(False), 70)
    )
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", score.alias("score")).where("score is not null")


def history_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of one role whose text or conversation number holds what is asked, in any case."""
    rows = table(spark, sf_dir, "conversations")
    hit = F.col("text").ilike("%that%") | F.col("conv_id").cast("string").ilike("%7%")
    return rows.where((F.col("role") == "user") & hit).select("conv_id", "turn")


def resolved_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as forecasts: resolved if their value is known (high), or by the word of their status."""
    status = F.when(F.col("o_orderstatus") == "F", "final").when(F.col("o_orderstatus") == "P", "pending").otherwise("scored")
    actual = F.when(F.col("o_totalprice") > 300_000, F.col("o_totalprice"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", status.alias("status"), actual.alias("actual"))
    return rows.select("o_orderkey", (F.col("actual").isNotNull() | F.col("status").isin(*RESOLVED)).alias("resolved"))


def risk_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each player's chance of a home run, in percent, by the first rung that fits."""
    rows = game_log(spark, sf_dir).groupBy("player_id").agg(F.sum("plate_appearances").alias("n"), (F.sum("home_runs") / F.sum("plate_appearances") * 100).alias("pct"))
    live = F.col("player_id") % 10 == 0
    profile = F.when(F.col("n") <= 0, "no_sample").when(live, "live_sample").when(F.col("n") < 50, "small_sample").when(F.col("pct") >= 50, "high_probability").when(F.col("pct") <= 4, "low_probability").otherwise("normal")
    return rows.select("player_id", F.round("pct", 4).alias("pct"), profile.alias("profile"))


def hitter_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample, seven tiers, strength and risk of every player over all games."""
    names = ("plate_appearances", "at_bats", "hits", "doubles", "triples", "home_runs", "walks", "strikeouts", "rbi", "runs")
    lines = game_log(spark, sf_dir).groupBy("player_id").agg(*[F.sum(c).alias(c) for c in names], F.sum(F.least("rbi", "walks")).alias("stolen_bases"))
    return hitter_profiles(lines).select("player_id", "sample", "power", "contact", "discipline", "strikeout", "production", "speed", "ops", "strength", "risk")


def row_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an event row is of hitting or pitching: what its type says, else its role, else the signals it has (pitching
    only if it has more of them)."""
    hitting, pitching = ["click", "view", "purchase"], ["error", "signup", "view"]
    signs = F.array(F.col("event_type"), F.when(F.col("value") > 50, "view"), F.when(F.col("value") > 100, "error"))
    count = lambda names: F.size(F.array_intersect(F.array_compact(signs), F.array(*[F.lit(n) for n in names])))
    explicit = F.when(F.col("event_type") == "purchase", "hitting").when(F.contains(F.concat(F.lit("x"), F.col("event_type")), F.lit("xsign")), "pitching")
    group = F.coalesce(explicit, F.when(count(pitching) > count(hitting), "pitching").otherwise("hitting"))
    return table(spark, sf_dir, "events").select("event_id", group.alias("stat_group"))


def sample_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insufficient, limited, usable or strong samples of hitters (25, 100, 250) and pitchers (100, 500, 1500)."""
    rows = game_log(spark, sf_dir).groupBy("player_id", "pitcher_throws").agg(F.sum("plate_appearances").alias("n"))
    names = ["strong", "usable", "limited"]
    by = lambda cuts: ladder(F.col("n"), list(zip(cuts, names)), "insufficient")
    status = F.when(F.col("pitcher_throws") == "L", by([1500, 500, 100])).otherwise(by([250, 100, 25]))
    return rows.select("player_id", "pitcher_throws", "n", status.alias("status"))


def freshness_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How fresh each user's last event of a type is at the end of January 2024: up to 36 hours fresh, 120 aging, else
    stale; times after that count as now, none is unknown."""
    last = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max(F.when(F.col("value") > 5, F.col("ts"))).alias("last"))
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    hours = F.greatest((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))) / 3.6e9, F.lit(0.0))
    hours = F.when(F.col("last").isNotNull(), hours)
    status = F.when(hours.isNull(), "unknown").when(hours <= 36, "fresh").when(hours <= 120, "aging").otherwise("stale")
    return last.select("user_id", "event_type", F.round(hours, 4).alias("age_hours"), status.alias("status"))


def player_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Injured by the words of code, description and roster; two-way by position."""
    c = F.col
    code = F.when(c("c_custkey") % 9 == 0, "IL10").when(c("c_custkey") % 9 == 1, "D7").otherwise("A")
    says = F.when(c("c_custkey") % 7 == 0, "On Rehab assignment").when(c("c_custkey") % 7 == 1, None).otherwise(c("c_mktsegment"))
    place = F.when(c("c_acctbal") > 9000, "TWP").when(c("c_acctbal") > 8000, "Two-Way Player").otherwise("OF")
    rows = table(spark, sf_dir, "customer").select("c_custkey", code.alias("code"), says.alias("says"), place.alias("place"))
    return rows.select("c_custkey", any_word(F.lower(F.concat_ws(" ", "code", "says")), INJURED).alias("injured"), F.lower("place").isin("twp", "two-way player").alias("two_way"))


#: target: kind, field, and the least value of a binary one (user targets are added to a copy of this)
TARGETS: dict[str, tuple[str, str, float | None]] = {
    "target_hit": ("binary", "hits", 1), "target_single": ("binary", "singles", 1), "target_double": ("binary", "doubles", 1), "target_triple": ("binary", "triples", 1),
    "target_home_run": ("binary", "home_runs", 1), "target_walk": ("binary", "walks", 1), "target_strikeout": ("binary", "strikeouts", 1), "target_rbi": ("binary", "rbi", 1),
    "target_run": ("binary", "runs", 1), "target_total_bases": ("count", "total_bases", None), "target_hits_count": ("count", "hits", None), "target_home_runs_count": ("count", "home_runs", None),
    "target_pitcher_strikeouts": ("count", "pitcher_strikeouts", None), "target_pitcher_walks": ("count", "pitcher_walks", None), "target_pitcher_earned_runs": ("count", "earned_runs", None),
    "target_team_win": ("binary", "team_win", 1), "target_team_runs": ("count", "team_runs", None), "target_game_total_runs": ("count", "game_total_runs", None),
}


def target_columns(targets: dict[str, tuple[str, str, float | None]]) -> list[Column]:
    """Labels by their definitions; a null source gives a null label."""
    out = []
    for name, (kind, field, least) in targets.items():
        x = F.col(field)
        if kind == "binary":
            y = F.when(x.isNotNull(), (x >= least).cast("double"))
        elif kind == "count":
            y = F.when(x.isNotNull(), F.greatest(x.cast("long"), F.lit(0)).cast("double"))
        elif kind == "continuous":
            y = x.cast("double")
        else:
            raise ValueError(f"no target of kind {kind}")
        out.append(y.alias(name))
    return out


def game_outcomes(log: DataFrame) -> DataFrame:
    """The log with the fields that targets stand on; pitching fields are known where the pitcher throws left."""
    c = F.col
    left = lambda name: F.when(c("pitcher_throws") == "L", c(name))
    return log.withColumns({
        "singles": F.greatest(c("hits") - c("doubles") - c("triples") - c("home_runs"), F.lit(0)), "total_bases": c("hits") + c("doubles") + 2 * c("triples") + 3 * c("home_runs"),
        "pitcher_strikeouts": left("strikeouts"), "pitcher_walks": left("walks"), "earned_runs": left("rbi"), "team_win": (c("runs") > c("rbi")).cast("int"),
        "team_runs": c("runs"), "game_total_runs": c("runs") + c("rbi"),
    })


def all_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eighteen registered targets and one of the caller's own (three times on base) for every game."""
    own = TARGETS | {"target_on_base_thrice": ("binary", "on_base", 3), "target_bases_share": ("continuous", "share", None)}
    rows = game_outcomes(game_log(spark, sf_dir)).withColumns({"on_base": F.col("hits") + F.col("walks"), "share": F.round(F.col("total_bases") / F.col("plate_appearances"), 6)})
    return rows.select("player_id", "game_id", *target_columns(own))


def extracted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that rows bring with them (where home), else from their counts."""
    c = F.col
    given = F.when(c("home_away") == "home", (c("hits") > 1).cast("double"))
    return game_log(spark, sf_dir).select("game_id", F.coalesce(given, (c("hits") > 0).cast("double")).alias("target_hit"), (c("home_runs") > 0).cast("double").alias("target_home_run"), (c("hits") + c("doubles") + 2 * c("triples") + 3 * c("home_runs")).cast("double").alias("target_total_bases"))


def suspicious_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature names that tell of the result: every part name and type as a name, with the mark it holds."""
    name = F.concat_ws("_", F.when(F.col("p_size") > 40, "final").when(F.col("p_size") < 5, "target"), F.lower(F.regexp_replace("p_name", " ", "_")), F.when(F.col("p_partkey") % 17 == 0, "winner"))
    marks = F.array_compact(F.array(*[F.when(F.contains(name, F.lit(s)), F.lit(s)) for s in SUSPICIOUS]))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("feature"), F.array_join(marks, ",").alias("marks")).where("marks <> ''")


def outcome_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes in one spelling: lower case, blanks and hyphens as underscores, short names resolved, else as they are."""
    short = F.create_map(*[F.lit(x) for kv in OUTCOME_NAMES.items() for x in kv])
    said = F.element_at(F.array(*[F.lit(x) for x in (" HR", "home-run", "K", "Total Bases", "bb ", "walk", "stolen base")]), (F.col("event_id") % 7 + 1).cast("int"))
    plain = F.regexp_replace(F.lower(F.trim(said)), "[- ]", "_")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(short[plain], plain).alias("outcome"))


def stat_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Season lines by their short names, and whether they hold a hitting sample at all."""
    c = F.col
    rows = game_log(spark, sf_dir).groupBy("player_id", "season").agg(*[F.sum(a).alias(b) for a, b in (("plate_appearances", "pa"), ("at_bats", "ab"), ("hits", "h"), ("doubles", "d"), ("triples", "t"), ("home_runs", "hr"), ("walks", "bb"), ("strikeouts", "k"))])
    return rows.select("player_id", "season", "pa", "ab", "h", "hr", "bb", "k", (c("h") + c("d") + 2 * c("t") + 3 * c("hr")).alias("tb"), ((c("pa") > 0) | (c("ab") > 0) | (c("h") > 0) | (c("hr") > 0)).alias("has_hitting_sample"))


# --- scalars


def parsed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times back from the forms that exports have: ISO with Z, date, US date, epoch seconds, and what is none of them."""
    at = F.col("o_orderdate")
    form = F.element_at(
        F.array(
            F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")), F.date_format(at, "yyyy-MM-dd"), F.date_format(at, "MM/dd/yyyy"),
            F.unix_seconds(at.cast("timestamp")).cast("string"), F.lit("no date"), F.date_format(at, "yyyy-MM-dd HH:mm:ss"),
        ),
        (F.col("o_orderkey") % 6 + 1).cast("int"),
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", form.alias("said"))
    parse = [F.try_to_timestamp("said", F.lit(p)) for p in ("yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy")]
    epoch = F.when(F.col("said").rlike("^[0-9]+$"), F.timestamp_seconds(F.col("said").try_cast("long")))
    return rows.select("o_orderkey", F.unix_seconds(F.coalesce(epoch, *parse)).alias("seconds"))


def days_to_ship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days from order to shipping, as a fraction; -1 without an order."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    days = (micros("l_shipdate") - micros("o_orderdate")) / 8.64e10
    return lines.join(orders, "l_orderkey", "left").select("l_orderkey", "l_linenumber", F.round(F.coalesce(days, F.lit(-1.0)), 6).alias("days"))


def inferred_season(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The season that a page's text column says, else the year in its address, else 2024."""
    said = F.regexp_extract(F.coalesce("html", F.lit("")), "season=([0-9]{4})", 1).try_cast("int")
    named = F.regexp_extract(F.coalesce("url", F.lit("")), "(20[0-9]{2})", 1).try_cast("int")
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(said, named, F.lit(2024)).alias("season"))


def sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features as they are stored: truth values as numbers, clipped at 10^8, ten decimals, no infinities, dates as text."""
    c = F.col
    wild = F.when(c("o_orderkey") % 50 == 0, F.lit(float("inf"))).when(c("o_orderkey") % 50 == 1, c("o_totalprice") * 1e6).otherwise(c("o_totalprice") / 3)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (c("o_orderstatus") == "F").alias("closed"), wild.alias("x"), "o_orderdate")
    x = F.when(F.isnan("x") | c("x").isin(float("inf"), float("-inf")), 0.0).otherwise(F.least(F.greatest("x", F.lit(-1e8)), F.lit(1e8)))
    return rows.select("o_orderkey", c("closed").cast("double").alias("closed"), F.round(x, 10).alias("x"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


def context_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wind parts by direction, home and day flags, what the context overrides, and interactions: platoon, park, rest."""
    c = F.col
    rows = game_log(spark, sf_dir).withColumns({"degrees": c("game_id") % 360, "speed": c("game_id") % 25, "own_park": 0.9 + c("team_id") * 0.01, "told_park": F.when(c("game_id") % 4 == 0, 1.1), "rest": c("game_id") % 5})
    angle = F.radians("degrees")
    park = F.coalesce("told_park", "own_park")
    platoon = F.when((c("pitcher_throws") == "L") == (c("player_id") % 2 == 0), 1.0).otherwise(-1.0)
    return rows.select(
        "player_id", "game_id", (F.round(c("speed") * F.cos(angle), 6) + 0.0).alias("wind_out"), (F.round(c("speed") * F.sin(angle), 6) + 0.0).alias("wind_cross"),
        (c("home_away") == "home").cast("double").alias("is_home"), (c("day_night") == "day").cast("double").alias("is_day"), F.round(park, 6).alias("park"),
        platoon.alias("platoon"), F.round(c("hits") * park, 6).alias("hits_park"), (F.round(c("rest") * platoon, 6) + 0.0).alias("rest_platoon"), F.round(F.log1p(c("degrees")) / (1 + c("rest")), 6).alias("travel_fatigue"),
    )


def identifier_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the entity and game, the time as seconds, and earlier counts of the game itself only when asked for (they
    hold the label, so training leaves them out)."""
    with_current = False
    rows = game_log(spark, sf_dir)
    current = [F.col(c).cast("double").alias(f"current_{c}") for c in ("hits", "home_runs")] if with_current else []
    return rows.select("player_id", "game_id", F.unix_seconds(F.col("game_date").cast("timestamp")).alias("as_of"), F.col("team_id").cast("double").alias("team"), *current)


def mean_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of those scores of a line that are known; null if none is."""
    c = F.col
    scores = F.array(F.when(c("l_discount") > 0.05, c("l_discount") * 1000), F.when(c("l_tax") > 0.04, c("l_tax") * 1000), F.when(c("l_quantity") > 40, c("l_quantity")))
    known = F.filter(scores, lambda x: x.isNotNull())
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(mean, 6).alias("score"))


def weighted_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted arithmetic and geometric means of prices by customer: weights below 0 count as 0, without weight the
    default."""
    w = F.greatest((F.col("o_orderkey") % 7 - 2).cast("double"), F.lit(0.0))
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", w.alias("w"))
    found = rows.groupBy("o_custkey").agg(F.sum("w").alias("total"), F.sum(F.col("w") * F.col("o_totalprice")).alias("wx"), F.sum(F.col("w") * F.log(F.greatest("o_totalprice", F.lit(1e-12)))).alias("wl"))
    held = lambda x: F.when(F.col("total") > 1e-12, x).otherwise(0.0)
    return found.select("o_custkey", F.round(held(F.col("wx") / F.col("total")) + 1e-6, 2).alias("weighted"), F.round(held(F.exp(F.col("wl") / F.col("total"))) + 1e-6, 2).alias("geometric"))


def phrase_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole words and phrases that messages hold, with no letter or digit beside them."""
    low = F.lower(F.coalesce("text", F.lit("")))
    hits = F.array_compact(F.array(*[F.when(low.rlike(f"(^|[^a-z0-9]){p}([^a-z0-9]|$)"), F.lit(p)) for p in ("that", "the", "in the", "an", "der")]))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(hits).alias("phrase"))


def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct windows of one to seven words of each message, by size: how many, and the first in order."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("w"), F.explode(F.sequence(F.lit(7), F.lit(1), F.lit(-1))).alias("size"))
    windows = F.when(F.size("w") >= F.col("size"), F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1), lambda k: F.array_join(F.slice("w", k, F.col("size")), " "))))
    rows = rows.withColumn("windows", windows).where("windows is not null")
    return rows.select("conv_id", "turn", "size", F.size("windows").alias("n"), F.array_min("windows").alias("first"))


def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names and brands in the forms that matching uses: spaced, tight, without hash and hyphen, with words for
    signs, initials, sorted words, and as a column name."""
    raw = F.concat_ws(" ", "p_name", "p_brand", F.lit("&"), "p_type")
    low = F.trim(F.regexp_replace(F.lower(raw), " +", " "))
    words = F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0))
    return table(spark, sf_dir, "part").select(
        "p_partkey", low.alias("spaced"), F.regexp_replace(low, "[^a-z0-9]", "").alias("tight"), F.trim(F.regexp_replace(low, "[^a-z0-9]+", " ")).alias("plain"),
        F.regexp_replace(low, "&", "and").alias("worded"), F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "").alias("initials"),
        F.array_join(F.array_sort(words), " ").alias("sorted"), F.regexp_replace(F.regexp_replace(low, "[- .]", "_"), "__", "_").alias("column_name"),
    )


def phonetic_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose names sound alike: a key of letters without later vowels and runs, and how many share it."""
    from fieldlab.plans.messages import phonetic_key

    rows = table(spark, sf_dir, "part").select("p_partkey", phonetic_key(F.col("p_name")).alias("key"))
    n = rows.groupBy("key").agg(F.count(F.lit(1)).alias("alike"))
    return rows.join(n, "key").select("p_partkey", "key", "alike")


def follow_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Follows of users by kind: the last toggle of a pair decides, an unfollow keeps the row and clears its flag."""
    latest = Window.partitionBy("user_id", "kind").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = table(spark, sf_dir, "events").select("user_id", (F.col("event_id") % 3).alias("kind"), "ts", "event_id", F.col("event_type").isin("signup", "purchase", "click").alias("is_active"))
    return rows.withColumn("at", F.row_number().over(latest)).where("at = 1").select("user_id", "kind", "is_active", F.col("event_id").alias("last_event"))


QUERIES = {f.__name__: f for f in (
    strict_counts, season_team_filter, name_search, history_search, resolved_predictions, risk_profile, hitter_profile, row_group, sample_status, freshness_status, player_flags, all_targets, extracted_labels,
    suspicious_names, outcome_names, stat_contract, parsed_times, days_to_ship, inferred_season, sanitised, context_features, identifier_features, mean_available, weighted_means, phrase_matches, token_windows,
    normal_forms, phonetic_groups, follow_states,
)}

_LOG = f"WITH {GAME_LOG_SQL}"
_W = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"
def _tier(value: str, tiers) -> str:
    return f"CASE WHEN n <= 0 THEN '{profiles.NO_SAMPLE}' " + " ".join(f"WHEN {value} >= {least}::DOUBLE THEN '{name}'" for least, name in tiers[0]) + f" ELSE '{tiers[1]}' END"


ORACLE_SQL = {
    "strict_counts": f"""{_LOG}, x AS (SELECT game_id, hits, nullif(doubles, 0) AS d, triples, home_runs, CASE WHEN at_bats > 1 THEN at_bats END AS ab FROM log)
        SELECT game_id, CASE WHEN d IS NOT NULL THEN greatest(hits - d - triples - home_runs, 0) END AS singles, round(hits / ab, 6) AS avg FROM x""",
    "season_team_filter": f"{_LOG} SELECT player_id, game_id, team_id FROM log WHERE year(game_date) = 1996 AND game_id % 3 = 0",
    "name_search": """WITH x AS (SELECT p_partkey, p_name, CASE WHEN lower(p_name) = 'large bolt' THEN 100 WHEN regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') = 'largebolt' THEN 98 WHEN p_name ILIKE '%large bolt%' THEN 90
        WHEN regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') LIKE '%largebolt%' THEN 86 WHEN p_name ILIKE '%large%' AND p_name ILIKE '%bolt%' THEN 78 WHEN p_name ILIKE '%large%' OR p_name ILIKE '%bolt%' THEN 70 END::INT AS score FROM part)
        SELECT * FROM x WHERE score IS NOT NULL""",
    "history_search": "SELECT conv_id, turn FROM conversations WHERE role = 'user' AND (lower(coalesce(text, '')) LIKE '%that%' OR conv_id::VARCHAR LIKE '%7%')",
    "resolved_predictions": "SELECT o_orderkey, o_totalprice > 300000 OR o_orderstatus <> 'P' AS resolved FROM orders",
    "risk_profile": f"""{_LOG}, x AS (SELECT player_id, sum(plate_appearances) AS n, 100.0::DOUBLE * sum(home_runs) / sum(plate_appearances) AS pct FROM log GROUP BY 1)
        SELECT player_id, round(pct, 4) AS pct, CASE WHEN player_id % 10 = 0 THEN 'live_sample' WHEN n < 50 THEN 'small_sample' WHEN pct >= 50 THEN 'high_probability' WHEN pct <= 4 THEN 'low_probability' ELSE 'normal' END AS profile FROM x""",
    "hitter_profile": f"""{_LOG}, s AS (SELECT player_id, sum(plate_appearances)::DOUBLE AS pa, sum(at_bats)::DOUBLE AS ab, sum(hits)::DOUBLE AS h, sum(walks)::DOUBLE AS w, sum(strikeouts)::DOUBLE AS so, sum(home_runs)::DOUBLE AS homers, sum(rbi)::DOUBLE AS rbi, sum(runs)::DOUBLE AS runs,
        sum(least(rbi, walks))::DOUBLE AS sb, sum(doubles + 2 * triples + 3 * home_runs)::DOUBLE AS extra FROM log GROUP BY 1),
        r AS (SELECT player_id, greatest(pa, ab) AS n, coalesce(homers / nullif(pa, 0), 0) AS hr, coalesce(h / nullif(ab, 0), 0) AS hit, coalesce(w / nullif(pa, 0), 0) AS bb, coalesce(so / nullif(pa, 0), 0) AS k, greatest(coalesce(rbi / nullif(pa, 0), 0), coalesce(runs / nullif(pa, 0), 0)) AS made,
          coalesce((h + extra) / nullif(ab, 0), 0) AS tb, coalesce(extra / nullif(ab, 0), 0) AS iso, coalesce((h + w) / nullif(pa, 0), 0) AS obp, sb / greatest(h + w, 1) AS steals FROM s),
        v AS (SELECT *, hr / 0.032e0 AS s1, hit / 0.245e0 AS s2, bb / 0.086e0 AS s3, made / 0.135e0 AS s4, tb / 0.36e0 AS s5, CASE WHEN n BETWEEN 1 AND 149 THEN 1e0 ELSE 0e0 END AS k1, k / 0.22e0 AS k2, 0.245e0 / greatest(hit, 0.001e0) AS k3, 0.032e0 / greatest(hr, 0.001e0) AS k4 FROM r)
        SELECT player_id, CASE WHEN n >= 350 THEN 'strong' WHEN n >= 150 THEN 'moderate' WHEN n >= 50 THEN 'weak' WHEN n > 0 THEN 'tiny' ELSE 'no_sample' END AS sample,
        {_tier("greatest(hr, iso / 5)", profiles.POWER)} AS power, {_tier("hit", profiles.CONTACT)} AS contact, {_tier("bb", profiles.DISCIPLINE)} AS discipline, {_tier("k", profiles.STRIKEOUTS)} AS strikeout, {_tier("made", profiles.PRODUCTION)} AS production,
        {_tier("steals", profiles.SPEED)} AS speed, {_tier("obp + tb", profiles.OPS)} AS ops,
        CASE WHEN n <= 0 THEN 'Unavailable' WHEN s1 = greatest(s1, s2, s3, s4, s5) THEN 'Power' WHEN s2 = greatest(s2, s3, s4, s5) THEN 'Contact' WHEN s3 = greatest(s3, s4, s5) THEN 'Plate Discipline' WHEN s4 >= s5 THEN 'Run Production' ELSE 'Total Bases' END AS strength,
        CASE WHEN n <= 0 THEN 'No usable hitting sample' WHEN k1 = greatest(k1, k2, k3, k4) THEN 'Small Sample' WHEN k2 = greatest(k2, k3, k4) THEN 'Strikeout Rate' WHEN k3 >= k4 THEN 'Low Contact' ELSE 'Low Power' END AS risk FROM v""",
    "row_group": """WITH x AS (SELECT event_id, event_type, list_distinct(list_filter([event_type, CASE WHEN value > 50 THEN 'view' END, CASE WHEN value > 100 THEN 'error' END], lambda s: s IS NOT NULL)) AS signs FROM events)
        SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'hitting' WHEN event_type LIKE 'sign%' THEN 'pitching' WHEN len(list_filter(signs, lambda s: s IN ('error', 'signup', 'view'))) > len(list_filter(signs, lambda s: s IN ('click', 'view', 'purchase'))) THEN 'pitching' ELSE 'hitting' END AS stat_group FROM x""",
    "sample_status": f"""{_LOG}, x AS (SELECT player_id, pitcher_throws, sum(plate_appearances)::BIGINT AS n FROM log GROUP BY 1, 2) SELECT *, CASE WHEN pitcher_throws = 'L' THEN CASE WHEN n < 100 THEN 'insufficient' WHEN n < 500 THEN 'limited' WHEN n < 1500 THEN 'usable' ELSE 'strong' END
        ELSE CASE WHEN n < 25 THEN 'insufficient' WHEN n < 100 THEN 'limited' WHEN n < 250 THEN 'usable' ELSE 'strong' END END AS status FROM x""",
    "freshness_status": """WITH x AS (SELECT user_id, event_type, max(ts) FILTER (value > 5) AS last FROM events GROUP BY 1, 2), y AS (SELECT *, greatest(date_diff('microsecond', last, TIMESTAMP '2024-01-31') / 3.6e9, CASE WHEN last IS NOT NULL THEN 0 END) AS h FROM x)
        SELECT user_id, event_type, round(h, 4) AS age_hours, CASE WHEN last IS NULL THEN 'unknown' WHEN h <= 36 THEN 'fresh' WHEN h <= 120 THEN 'aging' ELSE 'stale' END AS status FROM y""",
    "player_flags": """SELECT c_custkey, c_custkey % 9 = 0 OR c_custkey % 7 = 0 AS injured, c_acctbal > 8000 AS two_way FROM customer""",
    "all_targets": f"""{_LOG}, x AS (SELECT *, hits - doubles - triples - home_runs AS s, hits + doubles + 2 * triples + 3 * home_runs AS tb, game_id % 3 = 0 AS l FROM log)
        SELECT player_id, game_id, (hits > 0)::INT::DOUBLE AS target_hit, (s > 0)::INT::DOUBLE AS target_single, (doubles > 0)::INT::DOUBLE AS target_double, (triples > 0)::INT::DOUBLE AS target_triple, (home_runs > 0)::INT::DOUBLE AS target_home_run,
        (walks > 0)::INT::DOUBLE AS target_walk, (strikeouts > 0)::INT::DOUBLE AS target_strikeout, (rbi > 0)::INT::DOUBLE AS target_rbi, (runs > 0)::INT::DOUBLE AS target_run, tb::DOUBLE AS target_total_bases, hits::DOUBLE AS target_hits_count,
        home_runs::DOUBLE AS target_home_runs_count, CASE WHEN l THEN strikeouts::DOUBLE END AS target_pitcher_strikeouts, CASE WHEN l THEN walks::DOUBLE END AS target_pitcher_walks, CASE WHEN l THEN rbi::DOUBLE END AS target_pitcher_earned_runs,
        (runs > rbi)::INT::DOUBLE AS target_team_win, runs::DOUBLE AS target_team_runs, (runs + rbi)::DOUBLE AS target_game_total_runs, (hits + walks >= 3)::INT::DOUBLE AS target_on_base_thrice, round(tb / plate_appearances::DOUBLE, 6) AS target_bases_share FROM x""",
    "extracted_labels": f"""{_LOG} SELECT game_id, (hits > CASE WHEN game_id % 2 = 0 THEN 1 ELSE 0 END)::INT::DOUBLE AS target_hit, (home_runs >= 1)::INT::DOUBLE AS target_home_run, (hits + doubles + 2 * triples + 3 * home_runs)::DOUBLE AS target_total_bases FROM log""",
    "suspicious_names": """WITH x AS (SELECT p_partkey, concat_ws('_', CASE WHEN p_size > 40 THEN 'final' WHEN p_size < 5 THEN 'target' END, lower(replace(p_name, ' ', '_')), CASE WHEN p_partkey % 17 = 0 THEN 'winner' END) AS feature FROM part),
        y AS (SELECT *, concat_ws(',', CASE WHEN feature LIKE 'final!_%' ESCAPE '!' THEN 'final_' END, CASE WHEN feature LIKE 'target!_%' ESCAPE '!' THEN 'target_' END, CASE WHEN feature LIKE '%winner%' THEN 'winner' END) AS marks FROM x) SELECT * FROM y WHERE marks <> ''""",
    "outcome_names": "SELECT event_id, ['home_run', 'home_run', 'strikeout', 'total_bases', 'walk', 'walk', 'stolen_base'][event_id % 7 + 1] AS outcome FROM events",
    "stat_contract": f"""{_LOG} SELECT player_id, year(game_date)::INT AS season, sum(plate_appearances)::BIGINT AS pa, sum(at_bats)::BIGINT AS ab, sum(hits)::BIGINT AS h, sum(home_runs)::BIGINT AS hr, sum(walks)::BIGINT AS bb, sum(strikeouts)::BIGINT AS k,
        sum(hits + doubles + 2 * triples + 3 * home_runs)::BIGINT AS tb, sum(plate_appearances) > 0 AS has_hitting_sample FROM log GROUP BY 1, 2""",
    "parsed_times": "SELECT o_orderkey, CASE WHEN o_orderkey % 6 <> 4 THEN epoch(CASE WHEN o_orderkey % 6 IN (1, 2) THEN date_trunc('day', o_orderdate) ELSE o_orderdate END)::BIGINT END AS seconds FROM orders",
    "days_to_ship": "SELECT l_orderkey, l_linenumber, round(coalesce(date_diff('microsecond', o_orderdate, l_shipdate) / 8.64e10, -1), 6) AS days FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey",
    "inferred_season": "SELECT page_id, coalesce(nullif(regexp_extract(html, 'season=([0-9]{4})', 1), ''), nullif(regexp_extract(url, '(20[0-9]{2})', 1), ''), '2024')::INT AS season FROM pages",
    "sanitised": """SELECT o_orderkey, (o_orderstatus = 'F')::INT::DOUBLE AS closed, round(CASE o_orderkey % 50 WHEN 0 THEN 0 WHEN 1 THEN least(o_totalprice * 1e6, 1e8) ELSE o_totalprice / 3 END, 10) AS x, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""",
    "context_features": f"""{_LOG}, x AS (SELECT *, CASE WHEN game_id % 4 = 0 THEN 1.1e0 ELSE 0.9e0 + team_id * 0.01e0 END AS pk, CASE WHEN (game_id % 3 = 0) = (player_id % 2 = 0) THEN 1e0 ELSE -1e0 END AS pl FROM log)
        SELECT player_id, game_id, round((game_id % 25) * cos(radians(game_id % 360)), 6) + 0 AS wind_out, round((game_id % 25) * sin(radians(game_id % 360)), 6) + 0 AS wind_cross, (game_id % 2 = 0)::INT::DOUBLE AS is_home, (game_id % 5 < 2)::INT::DOUBLE AS is_day,
        round(pk, 6) AS park, pl AS platoon, round(hits * pk, 6) AS hits_park, round((game_id % 5) * pl, 6) + 0 AS rest_platoon, round(ln(1 + game_id % 360) / (1 + game_id % 5), 6) AS travel_fatigue FROM x""",
    "identifier_features": f"{_LOG} SELECT player_id, game_id, epoch(game_date)::BIGINT AS as_of, team_id::DOUBLE AS team FROM log",
    "mean_available": """SELECT l_orderkey, l_linenumber, round(list_avg([CASE WHEN l_discount > 0.05 THEN l_discount * 1000 END, CASE WHEN l_tax > 0.04 THEN l_tax * 1000 END, CASE WHEN l_quantity > 40 THEN l_quantity END]), 6) AS score FROM lineitem""",
    "weighted_means": """WITH x AS (SELECT o_custkey, o_totalprice AS p, greatest(o_orderkey % 7 - 2, 0)::DOUBLE AS w FROM orders)
        SELECT o_custkey, round(coalesce(sum(w * p) / nullif(sum(w), 0), 0) + 1e-6, 2) AS weighted, round(coalesce(exp(sum(w * ln(p)) / nullif(sum(w), 0)), 0) + 1e-6, 2) AS geometric FROM x GROUP BY 1""",
    "phrase_matches": """SELECT conv_id, turn, phrase FROM conversations, (VALUES ('that'), ('the'), ('in the'), ('an'), ('der')) v(phrase) WHERE regexp_matches(lower(text), '\\b' || phrase || '\\b') AND regexp_matches(lower(text), '(^|[^a-z0-9])' || phrase || '([^a-z0-9]|$)')""",
    "token_windows": f"""WITH x AS (SELECT conv_id, turn, {_W} AS w FROM conversations), s AS (SELECT *, unnest([7, 6, 5, 4, 3, 2, 1])::INT AS size FROM x),
        p AS (SELECT conv_id, turn, size, unnest(list_transform(range(1, len(w) - size + 2), lambda k: array_to_string(w[k:k + size - 1], ' '))) AS t FROM s WHERE len(w) >= size) SELECT conv_id, turn, size, count(DISTINCT t)::INT AS n, min(t) AS first FROM p GROUP BY 1, 2, 3""",
    "normal_forms": """WITH x AS (SELECT p_partkey, lower(p_name || ' ' || p_brand || ' & ' || p_type) AS s FROM part) SELECT p_partkey, s AS spaced, regexp_replace(s, '[^a-z0-9]', '', 'g') AS tight, trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g')) AS plain, replace(s, '&', 'and') AS worded,
        array_to_string(list_transform(regexp_extract_all(s, '[a-z0-9]+'), lambda w: w[1]), '') AS initials, array_to_string(list_sort(regexp_extract_all(s, '[a-z0-9]+')), ' ') AS sorted, replace(replace(replace(replace(s, ' ', '_'), '-', '_'), '.', '_'), '__', '_') AS column_name FROM x""",
    "phonetic_groups": """WITH a AS (SELECT p_partkey, regexp_replace(replace(replace(replace(regexp_replace(lower(p_name), '[^a-z]', '', 'g'), 'ph', 'f'), 'ck', 'k'), 'q', 'k'), '[xz]', 's', 'g') AS k FROM part),
        b AS (SELECT p_partkey, string_split(substr(k, 1, 1) || regexp_replace(substr(k, 2), '[aeiouy]', '', 'g'), '') AS c FROM a), d AS (SELECT p_partkey, array_to_string(list_filter(c, lambda x, i: i = 1 OR x <> c[i - 1]), '') AS key FROM b) SELECT p_partkey, key, count(*) OVER (PARTITION BY key) AS alike FROM d""",
    "follow_states": """SELECT user_id, event_id % 3 AS kind, arg_max(event_type NOT IN ('view', 'error'), (ts, event_id)) AS is_active, arg_max(event_id, (ts, event_id)) AS last_event FROM events GROUP BY 1, 2""",
}
