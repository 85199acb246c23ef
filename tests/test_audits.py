"""Audits, places within groups, and the log of interactions, against plain loops and planted cases."""

import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fieldlab.operators import audits, coverage, memory
from fieldlab.operators.ranks import places

PLAYERS = "player_id long, source_id long, name string, team_id int, position string, active string, check string"
ROSTERS = "entry_id long, player_id long, team_id int, key string"


def failed(df):
    return Counter((r.check, r.key, r.detail) for r in df.collect())


def test_required_repeated_orphans_sharing(spark):
    """Nulls, empty texts, repeated rows, and columns that are called as the results are."""
    rng = random.Random(3)
    people = [(rng.choice([None, *range(40)]), rng.choice([None, "", "a", "b c", "B  c"]), rng.choice([None, 1, 2, 3, 9]), "x") for _ in range(200)]
    df = spark.createDataFrame(people, "key long, detail string, team int, check string")
    parents = spark.createDataFrame([(1,), (1,), (2,), (None,)], "team int")
    text = lambda x: "" if x is None else str(x)
    want = Counter(("required", text(k), f) for k, n, t, _ in people for f, v in (("detail", n), ("team", t)) if v in (None, ""))
    assert failed(audits.required(df, "key", ["detail", "team"])) == want
    keys = Counter((k, n) for k, n, *_ in people if k is not None and n is not None)
    assert failed(audits.repeated(df, ["key", "detail"])) == Counter({("repeated", f"{k}|{n}", str(m)): 1 for (k, n), m in keys.items() if m > 1})
    assert failed(audits.orphans(df, "key", "team", parents, "team")) == Counter(("orphan", text(k), None if t is None else str(t)) for k, _, t, _ in people if t not in (1, 2))
    groups = defaultdict(set)
    for k, n, *_ in people:
        if k is not None and n:
            groups[n].add(k)
    assert failed(audits.sharing(df, "key", F.col("detail"))) == Counter(("shared", str(k), n) for n, ks in groups.items() if len(ks) > 1 for k in ks)


def test_sharing_of_a_hot_value(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") < 2500, "one").otherwise(F.col("id").cast("string")).alias("v"))
    assert audits.sharing(df.unionByName(df), "id", F.col("v")).count() == 2500


def test_integrity(spark):
    teams = spark.createDataFrame([(1,), (2,)], "team_id int")
    people = [(1, 10, "A", 1, "P", "yes", ""), (2, 10, "B", 2, "", "yes", ""), (3, 11, None, 1, "C", "yes", "")]
    entries = [(1, 1, 1, ""), (2, 9, 1, ""), (3, 2, 7, ""), (4, None, None, "")]
    stats = spark.createDataFrame([(1, 1), (2, 8), (3, None)], "stat_id long, player_id long")
    args = (spark.createDataFrame(people, PLAYERS), teams, spark.createDataFrame(entries, ROSTERS), stats)
    assert failed(audits.integrity_failures(*args)) == Counter({
        ("player_fields", "2", "position"): 1, ("player_fields", "3", "name"): 1, ("player_source_ids", "10", "2"): 1, ("roster_players", "2", "9"): 1, ("roster_players", "4", None): 1,
        ("roster_teams", "3", "7"): 1, ("roster_teams", "4", None): 1, ("statistic_players", "2", "8"): 1, ("statistic_players", "3", None): 1,
    })
    got = audits.integrity_report(*args, expected=2).collect()
    assert len(got) == 11 and {r.check for r in got if not r.passed} == {"player_fields", "player_source_ids", "roster_players", "roster_teams", "statistic_players"}
    assert {(r.percent, r.status) for r in got} == {(54.5, "partial")}
    clean = [df.limit(1) for df in (args[0], teams, args[2], stats)]
    assert {(r.percent, r.status) for r in audits.integrity_report(*clean, expected=1).collect()} == {(100.0, "ready")}
    empty = [df.limit(0) for df in args]
    assert {r.check: r.failures for r in audits.integrity_report(*empty, expected=2).collect() if not r.passed} == {"team_count": 2, "players_present": 1, "rosters_present": 1, "players_of_all_teams": 2}


def roster_case(rng):
    ids, ts = range(12), [1, 2, 3, 4, None]
    source = [(i, rng.choice(["Ann Lee", "ann-lee", "Bo", "Cy", "", None]), rng.choice(ts)) for i in ids if rng.random() < 0.8] + [(3, "Bo", 2), (None, "Bo", 2)]
    due = [(rng.choice([2023, 2024]), rng.choice(["active", "forty"]), rng.choice(ts[:4]), rng.choice(ids)) for _ in range(30)]
    players = [(i, rng.choice(["Ann", "", None]), rng.choice(ts)) for i in ids if rng.random() < 0.8] + [(5, "Bo", 3)]
    rosters = [m for m in due if rng.random() < 0.7] + due[:3]
    return source, due, players, [(1,), (2,), (3,)], rosters


@pytest.mark.parametrize("seed", range(4))
def test_rosters(spark, seed):
    source, due, players, teams, rosters = roster_case(random.Random(seed))
    held, known = defaultdict(list), {t for (t,) in teams}
    for i, name, team in players:
        held[i].append((name, team))
    want = Counter()
    for i in {s[0] for s in source if s[0] is not None}:
        want["missing_player", str(i), None] += i not in held
        for name, team in held.get(i, []):
            want["incomplete_player", str(i), "name"] += not name
            want["incomplete_player", str(i), "team_id"] += team is None
    for i, rows in held.items():
        want["duplicate_player", str(i), str(len(rows))] += len(rows) > 1
    for i, team in {(i, t) for i, _, t in source if i in held and t is not None}:
        want["wrong_team", str(i), str(team)] += team not in known or team not in {t for _, t in held[i]}
    for m in set(due):
        key, there = "|".join(map(str, m)), m[3] in held and m[2] in known
        want["missing_membership", key, None if there else "player_or_team_missing"] += not there or m not in rosters
    for m, n in Counter(rosters).items():
        want["duplicate_membership", "|".join(map(str, m)), str(n)] += n > 1
    names = defaultdict(set)
    for i, name, _ in source:
        if i is not None and name:
            names[name.lower().replace("-", " ")].add(i)
    for name, ids in names.items():
        for i in ids:
            want["identical_name", str(i), name] += len(ids) > 1
    member = "season int, kind string, team_id int, player_id int"
    told = spark.createDataFrame(source, "player_id int, name string, team_id int").withColumn("observed_at", F.lit(None))
    args = (told, spark.createDataFrame(due, member), spark.createDataFrame(players, "player_id int, name string, team_id int"), spark.createDataFrame(teams, "team_id int"), spark.createDataFrame(rosters, member))
    found = audits.roster_failures(*args, fields=("player_id", "name", "team_id"))
    assert failed(found) == +want
    gate = {r.check: r.failures for r in audits.roster_gate(found, told, 4).collect()}
    assert len(gate) == 9 and gate["source_times"] == len(source) and all(gate[k] == sum(n for (c, *_), n in want.items() if c == k) for k in audits.CLOSING)
    assert failed(audits.roster_failures(*[df.limit(0) for df in args], fields=("name",))) == Counter()


def test_inventory(spark):
    schema = "team_id int, name string, abbreviation string, held int"
    source = spark.createDataFrame([(1, "A", "aa", 1), (2, "B", None, 1), (3, "C", "cc", 1), (3, "C", "cc", 1), (None, "N", "nn", 1)], schema)
    held = spark.createDataFrame([(1, "A", "AA", 2), (2, "B", "bb", 1), (2, "B", "bb", 1), (9, "Z", "zz", 1)], schema)
    got = {tuple(r) for r in audits.inventory_differences(source, held, "team_id", ("name", "abbreviation", "held")).collect()}
    assert got == {
        ("differs", "1", "held", "1", "2"), ("differs", "2", "abbreviation", None, "BB"), ("repeated_held", "2", None, None, "2"), ("missing", "3", None, None, None), ("repeated_source", "3", None, "2", None), ("unexpected", "9", None, None, None),
    }
    rows = [(i, f"T{i}", f"a{i}", f"L{i % 2}", f"D{i % 6}") for i in range(30)]
    names = "team_id int, name string, abbreviation string, league string, division string"
    fields = ("name", "abbreviation", "league", "division")
    assert {(r.passed, r.percent, r.status) for r in audits.inventory_balance(spark.createDataFrame(rows, names), fields=fields).collect()} == {(True, 100.0, "ready")}
    rows[0], rows[1] = (0, "", "A2", "L1", "D0"), (2, "T1", "a1", "L1", "D1")
    got = {r.check: r.failures for r in audits.inventory_balance(spark.createDataFrame(rows[:-1], names), fields=fields).collect()}
    assert got == {"size": 1, "repeated_ids": 1, "repeated_abbreviations": 1, "incomplete_records": 1, "league_balance": 1, "division_balance": 1}


def test_load_status(spark):
    cases = [((0, 900, 900), "failed", "failed"), ((None, 1, 1), "failed", "failed"), ((30, 500, 500), "ready", "ready"), ((30, 499, 500), "partial", "ready"), ((30, 0, 500), "not_ready", "ready"), ((29, 900, 900), "not_ready", "partial")]
    df = spark.createDataFrame([c[0] for c in cases], "t int, p int, r int")
    got = df.select(*[audits.load_status(F.col("t"), F.col("p"), F.col("r"), with_rosters=w) for w in (True, False)]).collect()
    assert [tuple(r) for r in got] == [c[1:] for c in cases]


def test_leaks(spark):
    records = spark.createDataFrame([("a", 1), ("a", 5), ("a", 6), ("a", None), ("b", 1), (None, 9), ("c", 2)], "who string, at int")
    moments = spark.createDataFrame([("a", 7), ("a", 5), ("b", 2), ("d", 1), (None, 1), ("c", None)], "who string, as_of int")
    found = audits.future_records(records, moments, ["who"])
    assert {tuple(r) for r in found.collect()} == {("a", 5, 4, 2, 5), ("b", 2, 1, 0, None), ("d", 1, 0, 0, None)}
    marks = ("target_", "post_game_")
    assert tuple(audits.leak_report(found, ["hits", "Post-Game x", "target_y"], marks).first()) == (3, 1, 2, "Post-Game x,target_y", False)
    assert tuple(audits.leak_report(found.where("who = 'b'"), ["hits"], marks).first()) == (1, 0, 0, "", True)
    assert tuple(audits.leak_report(found.limit(0), [], marks).first()) == (0, 0, 0, "", True)


def test_places(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 8 + ["b", None]), rng.choice([1.0, 2.0, None]), i) for i in range(800)]
    got = places(spark.createDataFrame(rows, "g string, score double, id int").repartition(7), ["g"], [F.desc_nulls_last("score"), F.asc("id")]).collect()
    want = {}
    for g in {r[0] for r in rows}:
        of = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        want |= {r[2]: k + 1 for k, r in enumerate(of)}
    assert len(got) == len(rows) and {r.id: r.place for r in got} == want
    assert places(spark.createDataFrame([], "g string, id int"), ["g"], ["id"]).count() == 0


MEANT = "conv_id long, turn long, intent string, player string, team string, outcome string, kind string"


@pytest.fixture(scope="module")
def records(spark):
    messages = spark.createDataFrame([(1, 1, " What of Red Bolt? "), (1, 3, "and his homers"), (1, 3, "zzz"), (2, 1, None), (2, 2, "he he")], "conv_id long, turn long, text string")
    meant = spark.createDataFrame([(1, 1, "player_info", "Red Bolt", None, None, "none"), (1, 3, "compare_players", "Red Bolt", "Reds", "home_run", "pronoun"), (2, 2, "general", "Red Bolt", "", None, "pronoun")], MEANT)
    replies = spark.createDataFrame([(1, 2, "Fine.\n"), (1, 4, None), (2, 9, "late")], "conv_id long, turn long, text string")
    return memory.interaction_records(messages, meant, replies)


def test_records(records):
    got = {(r.conv_id, r.turn): r for r in records.collect()}
    assert len(got) == records.count() == 4
    first, second, none = got[1, 1], got[1, 3], got[2, 1]
    assert (first.message, first.reply, first.importance, first.summary) == ("What of Red Bolt?", "Fine.", 55, "Intent: player_info | Player: Red Bolt")
    assert (second.message, second.reply, second.importance) == ("and his homers", "", 80)
    assert (none.message, none.reply, none.importance, none.summary) == ("", "", 35, memory.GENERAL)
    assert json.loads(second.context) == {"conv_id": 1, "turn": 3, "kind": "pronoun"} and json.loads(none.context)["kind"] is None


def test_importance(spark):
    lit = F.lit
    row = spark.range(1).select(memory.importance(*[lit("x")] * 4, lit(True), lit(True)), memory.importance(*[lit("x")] * 4, blocked=lit(True)), memory.importance(lit(None), lit(""), lit(None), lit(None)))
    assert tuple(row.first()) == (85, 20, 35)


def test_unsaid_names(records):
    got = {tuple(r) for r in memory.unsaid_names(records).collect()}
    assert got == {("player", "Red Bolt", "and his homers", 1, 1), ("team", "Reds", "and his homers", 1, 1), ("player", "Red Bolt", "he he", 1, 1)}


def test_append_is_idempotent(spark, records, tmp_path):
    path = str(tmp_path / "log")
    memory.append_records(records.where("conv_id = 1"), path, "0")
    memory.append_records(records.where("conv_id = 2"), path, "1")
    memory.append_records(records.where("conv_id = 2"), path, "1")
    log = spark.read.parquet(path)
    assert log.count() == log.select("record_id").distinct().count() == 4


def test_corrected_aliases(spark):
    decisions = spark.createDataFrame([("jugde", "judge", 0.9, 0.3, "accepted"), ("judge", "judge", 1.0, 0.3, "accepted"), ("jdg", "judge", 0.5, 0.1, "rejected"), ("jude", "judge", 0.9, 0.0, "ambiguous")], "asked string, name string, score double, margin double, decision string")
    said = spark.createDataFrame([("jugde",), ("jugde",), ("judge",), ("jdg",), (None,), ("",)], "said string")
    assert [tuple(r) for r in memory.corrected_aliases(said, decisions).collect()] == [("jugde", "judge", 0.9, 2)]


def test_sample_and_freshness(spark):
    df = spark.createDataFrame([(24, "hitting"), (25, "hitting"), (100, "hitting"), (250, "hitting"), (99, "pitching"), (100, "pitching"), (500, "pitching"), (1500, "pitching"), (None, "hitting"), (9, "x"), (9, None)], "n int, g string")
    got = [r[0] for r in df.select(coverage.sample_state(F.col("n"), F.col("g"))).collect()]
    assert got == ["insufficient", "limited", "usable", "strong"] * 2 + ["unknown"] * 3
    hours = spark.createDataFrame([(0,), (36,), (37,), (108,), (109,), (-5,), (None,)], "h int")
    now = F.lit("2024-03-01 00:00:00").cast("timestamp_ntz")
    at = F.expr("timestamp_ntz'2024-03-01 00:00:00' - make_interval(0, 0, 0, 0, h, 0, 0)")
    assert [r[0] for r in hours.select(coverage.freshness(at, now)).collect()] == ["fresh", "fresh", "aging", "aging", "stale", "fresh", "unknown"]


def test_metric_coverage(spark):
    rows = [(2023, "hitting", 1, 300, 0, 5.0), (2023, "hitting", 1, 10, 200, None), (2023, "hitting", 2, 99, 50, 1.0), (2023, "hitting", 9, 100, 1, 1.0), (2024, "hitting", 1, None, None, 1.0), (2023, "pitching", 3, 600, 0, 1.0), (2023, "hitting", None, 1, 1, 1.0)]
    metrics = spark.createDataFrame(rows, "season int, `group` string, player_id int, sample int, h int, speed double").withColumns({"retrieved_at": F.expr("timestamp_ntz'2024-03-01 00:00:00'"), "updated_at": F.expr("timestamp_ntz'2024-03-01 00:00:00' - make_interval(0, 0, 0, 0, h, 0, 0)")})
    eligible = spark.createDataFrame([("hitting", i) for i in (1, 1, 2, 4, None)] + [("pitching", 3)], "`group` string, player_id int")
    got = {(r.season, r.group): tuple(r)[2:] for r in coverage.metric_coverage(eligible, metrics, ["speed"]).collect()}
    assert got == {(2023, "hitting"): (3, 1, 3, 1, 0, 2, 2, 0, False), (2024, "hitting"): (3, 2, 1, 0, 0, 0, 0, 0, False), (2023, "pitching"): (1, 0, 1, 0, 0, 1, 1, 0, True)}
    assert coverage.metric_coverage(eligible, metrics.limit(0), ["speed"]).count() == 0


def test_profile_state(spark):
    df = spark.createDataFrame([("ready", "ready", "ready", "ready"), ("ready", "ready", "ready", "stale"), ("partial", "missing", "ready", "error"), (None, "ready", "ready", "x")], "a string, b string, c string, d string")
    states = dict(zip(coverage.WEIGHTS, (F.col(x) for x in "abcd")))
    assert [tuple(r) for r in df.select(*coverage.profile_state(states)).collect()] == [(100.0, "ready"), (87.5, "partial"), (32.5, "missing"), (50.0, "partial")]
