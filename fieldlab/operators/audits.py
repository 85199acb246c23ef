"""Audits of a warehouse: integrity, rosters, inventories, a load's readiness, and leaks of a feature set.

What fails is a row (check, key, detail), and every failure is one; reports count those rows. Rows meet by semi and anti
joins on their keys, which AQE can split where a key is hot, and groups are counted within tasks first: no group is
gathered. A null key has no partner; an empty text counts as missing; repeated rows fail `repeated` alone and count once
elsewhere, but in `required` and `orphans`, which look at rows. Empty tables give no failures, and reports of them say so.
Other columns of a table are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlab.operators.dialogue import normalized
from fieldlab.sources.shared import stage

# Required fields, sizes of a full inventory, least sizes of a load, fields that inventories are compared on.
PLAYER_FIELDS = ("source_id", "name", "team_id", "position", "active")
ROSTER_FIELDS = ("player_id", "name", "position", "bats", "throws", "active", "team_id", "updated_at")
TEAMS, LEAGUES, DIVISIONS = 30, 2, 6
LEAST_PLAYERS, LEAST_ROSTERS = 500, 500
TEAM_FIELDS = ("name", "abbreviation", "league", "league_id", "division", "division_id", "venue", "venue_id", "is_active")
TEAM_REQUIRED = ("name", "abbreviation", "league", "league_id", "division", "division_id", "venue", "venue_id")
#: Failures that close the gate of a roster; equal names do not.
CLOSING = ("missing_player", "duplicate_player", "incomplete_player", "wrong_team", "missing_membership", "duplicate_membership")


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _text(names: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(_c(n).cast("string"), F.lit("")) for n in names])


def _failure(df: DataFrame, check: str, key: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), key.alias("key"), detail.cast("string").alias("detail"))


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# --- what a table may fail


def required(df: DataFrame, key: str, fields: Sequence[str], check: str = "required") -> DataFrame:
    """A failure for each field that a row lacks (null or empty text); detail is the field."""
    lacks = F.filter(F.array(*[F.when(F.coalesce(_c(f).cast("string"), F.lit("")) == "", F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    rows = df.select(_text([key]).alias("key"), F.explode(lacks).alias("field"))
    return _failure(rows, check, F.col("key"), F.col("field"))


def repeated(df: DataFrame, keys: Sequence[str], check: str = "repeated") -> DataFrame:
    """A failure for each key that several rows have; detail is how many. Keys that hold a null are no key."""
    counted = df.select(*[_c(k).alias(f"k{i}") for i, k in enumerate(keys)]).dropna().groupBy(*[f"k{i}" for i in range(len(keys))]).agg(F.count(F.lit(1)).alias("n"))
    return _failure(counted.where("n > 1"), check, _text([f"k{i}" for i in range(len(keys))]), F.col("n"))


def orphans(df: DataFrame, key: str, reference: str, parents: DataFrame, parent_key: str, check: str = "orphan") -> DataFrame:
    """A failure for each row whose reference is null or held by no parent; detail is the reference."""
    rows = df.select(_text([key]).alias("key"), _c(reference).alias("reference"))
    return _failure(rows.join(parents.select(_c(parent_key).alias("reference")), "reference", "left_anti"), check, F.col("key"), F.col("reference"))


def sharing(df: DataFrame, key: str, value: Column, check: str = "shared") -> DataFrame:
    """A failure for each key whose value (null and empty text are none) another key has too; detail is the value. A group
    is as many rows as it has keys, never a list."""
    rows = stage(df.select(_c(key).alias("key"), value.alias("value")).where("value <> ''").dropna().distinct(), "values")
    counted = stage(rows.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("value"), "shared")
    return _failure(rows.join(counted, "value"), check, F.col("key").cast("string"), F.col("value"))


def report(failures: DataFrame, checks: Sequence[str]) -> DataFrame:
    """check, failures for each of the checks, those without failures too."""
    names = failures.sparkSession.createDataFrame([(c,) for c in checks], "check string")
    counted = failures.groupBy("check").agg(F.count(F.lit(1)).alias("n"))
    return names.join(counted, "check", "left").select("check", F.coalesce("n", F.lit(0)).alias("failures"))


def with_gate(checks: DataFrame) -> DataFrame:
    """checks (check, failures) with passed, and over all of them percent (one decimal) and status."""
    total = checks.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("failures") == 0).alias("good"))
    rows = checks.crossJoin(F.broadcast(total)).withColumn("passed", F.col("failures") == 0)  # total is one row
    percent = F.round(F.col("good") * 100 / F.col("total"), 1)
    return rows.select("check", "failures", "passed", percent.alias("percent"), F.when(F.col("good") == F.col("total"), "ready").otherwise("partial").alias("status"))


# --- integrity of a warehouse


def integrity_failures(players: DataFrame, teams: DataFrame, rosters: DataFrame, statistics: DataFrame, fields: Sequence[str] = PLAYER_FIELDS) -> DataFrame:
    """What fails the five checks of rows. players (player_id, source_id and `fields`), teams (team_id), rosters (entry_id,
    player_id, team_id), statistics (stat_id, player_id)."""
    return _union([
        required(players, "player_id", fields, "player_fields"), repeated(players, ["source_id"], "player_source_ids"),
        orphans(rosters, "entry_id", "player_id", players, "player_id", "roster_players"), orphans(rosters, "entry_id", "team_id", teams, "team_id", "roster_teams"),
        orphans(statistics, "stat_id", "player_id", players, "player_id", "statistic_players"),
    ])


def integrity_report(players: DataFrame, teams: DataFrame, rosters: DataFrame, statistics: DataFrame, expected: int = TEAMS, fields: Sequence[str] = PLAYER_FIELDS) -> DataFrame:
    """Eleven checks with their failures, percent passed and status: the five of rows; how far the count of teams is from
    the expected one; whether players and roster entries are there; how many teams lack for the players' teams to be all;
    and two that hold of every table that is read (it comes from the warehouse; unknown values are null, not made up)."""
    failures = report(integrity_failures(players, teams, rosters, statistics, fields), ("player_fields", "player_source_ids", "roster_players", "roster_teams", "statistic_players"))
    one = lambda df, check, value: df.agg(value.cast("long").alias("failures")).select(F.lit(check).alias("check"), "failures")
    n, none = F.count(F.lit(1)), lambda: (F.count(F.lit(1)) == 0).cast("long")
    sizes = [
        one(teams, "team_count", F.abs(n - expected)), one(players, "players_present", none()), one(rosters, "rosters_present", none()),
        one(players, "players_of_all_teams", F.greatest(expected - F.count_distinct("team_id"), F.lit(0))),
    ]
    held = failures.sparkSession.createDataFrame([("from_the_warehouse", 0), ("no_made_up_zeros", 0)], "check string, failures long")
    return with_gate(_union([failures, *sizes, held]))


# --- rosters against their source


def roster_failures(source: DataFrame, memberships: DataFrame, players: DataFrame, teams: DataFrame, rosters: DataFrame, fields: Sequence[str] = ROSTER_FIELDS) -> DataFrame:
    """What a held roster fails of its source, seven checks.

    source (player_id, name, team_id) and memberships (season, kind, team_id, player_id) are what should be; players
    (player_id, `fields`), teams (team_id) and rosters (as memberships) what is held. A player of the source is missing;
    held twice; lacks a field; is held, with the source's team known, but no row of it has that team, or no such team is held; a
    membership has no roster row, or its player or team is not held; a roster row is there twice; several ids of the source
    have one name (lower case, words of letters and digits; a row for each id)."""
    place = ["season", "kind", "team_id", "player_id"]
    asked, held, known = source.select("player_id").dropna().distinct(), players.select("player_id"), teams.select("team_id")
    told = source.select("player_id", "team_id").dropna().distinct().join(held, "player_id", "left_semi")
    right = players.select("player_id", "team_id").join(known, "team_id", "left_semi")
    due = memberships.select(*place).distinct()
    there = due.join(held, "player_id", "left_semi")
    unknown = due.join(held, "player_id", "left_anti").unionByName(there.join(known, "team_id", "left_anti"))
    absent = there.join(known, "team_id", "left_semi").join(rosters.select(*place), place, "left_anti")
    key = F.col("player_id").cast("string")
    return _union([
        _failure(asked.join(held, "player_id", "left_anti"), "missing_player", key, F.lit(None)), repeated(players, ["player_id"], "duplicate_player"),
        required(players.join(asked, "player_id", "left_semi"), "player_id", fields, "incomplete_player"), _failure(told.join(right, ["player_id", "team_id"], "left_anti"), "wrong_team", key, F.col("team_id")),
        _failure(unknown, "missing_membership", _text(place), F.lit("player_or_team_missing")), _failure(absent, "missing_membership", _text(place), F.lit(None)),
        repeated(rosters, place, "duplicate_membership"), sharing(source, "player_id", normalized(F.col("name")), "identical_name"),
    ])


def roster_gate(failures: DataFrame, source: DataFrame, expected: int = TEAMS) -> DataFrame:
    """Nine checks of roster_failures' rows and its source (which has an observed_at), with percent and status: the six that
    close the gate, the source's teams and players, and rows of it without a time. Equal names are no check."""
    one = lambda check, value: source.agg(value.cast("long").alias("failures")).select(F.lit(check).alias("check"), "failures")
    sizes = [one("source_teams", F.abs(F.count_distinct("team_id") - expected)), one("source_players", (F.count("player_id") == 0)), one("source_times", F.count_if(F.col("observed_at").isNull()))]
    return with_gate(_union([report(failures, CLOSING), *sizes]))


# --- inventories


def inventory_differences(source: DataFrame, held: DataFrame, key: str, fields: Sequence[str] = TEAM_FIELDS, folded: Sequence[str] = ("abbreviation",)) -> DataFrame:
    """check, key, field, source, held: keys that are missing or unexpected, repeated on a side, and every field whose
    values differ (as texts; null differs from all but null; `folded` ones in upper case). Of repeated keys the largest row
    is compared; null keys are left out."""
    value = lambda f: F.upper(_c(f).cast("string")) if f in folded else _c(f).cast("string")

    def one(df: DataFrame, side: str) -> DataFrame:
        row = F.struct(*[value(f).alias(f"f{i}") for i, f in enumerate(fields)])
        return df.select(_c(key).alias("key"), row.alias(side)).where("key is not null").groupBy("key").agg(F.max(side).alias(side), F.count(F.lit(1)).alias(f"{side}_n"))

    both = one(source, "s").join(one(held, "h"), "key", "full_outer")
    text = lambda x: F.lit(x).cast("string")
    found = lambda when, check, field, s, h: F.when(when, F.struct(F.lit(check).alias("check"), text(field).alias("field"), s.cast("string").alias("source"), h.cast("string").alias("held")))
    none, col = text(None), F.col
    marks = [
        found(col("h").isNull(), "missing", None, none, none), found(col("s").isNull(), "unexpected", None, none, none),
        found(col("s_n") > 1, "repeated_source", None, col("s_n"), none), found(col("h_n") > 1, "repeated_held", None, none, col("h_n")),
        *[found(col("s").isNotNull() & col("h").isNotNull() & ~col("s")[f"f{i}"].eqNullSafe(col("h")[f"f{i}"]), "differs", f, col("s")[f"f{i}"], col("h")[f"f{i}"]) for i, f in enumerate(fields)],
    ]
    rows = both.select(col("key").cast("string").alias("key"), F.explode(F.filter(F.array(*marks), lambda m: m.isNotNull())).alias("m"))
    return rows.select("m.check", "key", "m.field", "m.source", "m.held")


def inventory_balance(records: DataFrame, expected: int = TEAMS, leagues: int = LEAGUES, divisions: int = DIVISIONS, fields: Sequence[str] = TEAM_REQUIRED) -> DataFrame:
    """Six checks of an inventory (team_id, abbreviation, league, division, `fields`) with percent and status: its size,
    repeated ids and abbreviations (in upper case), fields that lack, and groups of a league or division that are too many,
    too few or of a wrong size."""

    def uneven(column: str, groups: int) -> DataFrame:
        sizes = records.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
        wrong = F.abs(F.count(F.lit(1)) - groups) + F.count_if(F.col("n") != expected // groups)
        return sizes.agg(wrong.cast("long").alias("failures")).select(F.lit(f"{column}_balance").alias("check"), "failures")

    upper = records.select(F.upper("abbreviation").alias("abbreviation")).where("abbreviation <> ''")
    failures = _union([repeated(records, ["team_id"], "repeated_ids"), repeated(upper, ["abbreviation"], "repeated_abbreviations"), required(records, "team_id", ("team_id", *fields), "incomplete_records")])
    size = records.agg(F.abs(F.count(F.lit(1)) - expected).cast("long").alias("failures")).select(F.lit("size").alias("check"), "failures")
    return with_gate(_union([report(failures, ("repeated_ids", "repeated_abbreviations", "incomplete_records")), size, uneven("league", leagues), uneven("division", divisions)]))


# --- readiness of a load


def load_status(teams: Column, players: Column, rosters: Column, expected: int = TEAMS, players_least: int = LEAST_PLAYERS, rosters_least: int = LEAST_ROSTERS, with_rosters: bool = True) -> Column:
    """failed without teams; ready with all that was expected; partial with all teams and some of the rest (without
    rosters: with some teams); else not_ready. Null counts are 0."""
    t, p, r = (F.coalesce(c, F.lit(0)) for c in (teams, players, rosters))
    failed = F.when(t <= 0, "failed")
    if not with_rosters:
        return failed.when(t >= expected, "ready").otherwise("partial")
    return failed.when((t >= expected) & (p >= players_least) & (r >= rosters_least), "ready").when((t >= expected) & (p > 0) & (r > 0), "partial").otherwise("not_ready")


def roster_sizes(teams: DataFrame, players: DataFrame, rosters: DataFrame) -> DataFrame:
    """Each team (team_id) with its roster entries and players, none being 0, and whether it serves a roster browser, a
    lookup of players' teams, and features."""
    count = lambda df, name: df.where("team_id is not null").groupBy("team_id").agg(F.count(F.lit(1)).alias(name))
    rows = teams.select("team_id").distinct().join(count(rosters, "entries"), "team_id", "left").join(count(players, "players"), "team_id", "left")
    rows = rows.select("team_id", F.coalesce("entries", F.lit(0)).alias("entries"), F.coalesce("players", F.lit(0)).alias("players"))
    return rows.withColumns({"for_browser": F.col("entries") > 0, "for_lookup": F.col("players") > 0, "for_features": (F.col("entries") > 0) & (F.col("players") > 0)})


# --- leaks of a feature set


def future_records(records: DataFrame, moments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, as_of, records, future, first_future: how many of the records (keys, at) that a feature set was made of are not strictly
    before its moment (keys, as_of). A moment told twice counts as the earliest; one without records has none; records
    without a time are no future ones; null keys and moments are left out."""
    keys = list(keys)
    when = stage(moments.groupBy(*keys).agg(F.min("as_of").alias("as_of")).dropna(), "moments")
    late = F.col("at") >= F.col("as_of")
    met = records.select(*keys, "at").join(when, keys)
    counted = met.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(late).alias("late"), F.min(F.when(late, F.col("at"))).alias("first_future"))
    return when.join(counted, keys, "left").select(*keys, "as_of", F.coalesce("n", F.lit(0)).alias("records"), F.coalesce("late", F.lit(0)).alias("future"), "first_future")


def leak_report(found: DataFrame, names: Sequence[str], marks: Sequence[str]) -> DataFrame:
    """One row on future_records' rows and the names of the features: sets, those with future records, these records,
    the suspicious names in order, and whether all is safe."""
    odd = sorted(n for n in names if any(m in n.strip().lower().replace(" ", "_").replace("-", "_") for m in marks))
    rows = found.agg(F.count(F.lit(1)).alias("sets"), F.count_if(F.col("future") > 0).alias("unsafe_sets"), F.coalesce(F.sum("future"), F.lit(0)).alias("future_records"))
    return rows.withColumns({"suspicious": F.lit(",".join(odd)), "safe": (F.col("unsafe_sets") == 0) & F.lit(not odd)})
