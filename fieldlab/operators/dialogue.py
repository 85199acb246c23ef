"""Understanding of conversations: what each message says, and what it takes from the messages before it.

A message's own features (whole phrases, vocabulary, weighted rules, follow-up words) are expressions of its row; names
come from an equi join of its word windows with a catalogue. What a conversation carries on is a small memory for each
conversation, advanced message by message: `understand` runs it over tables, `fieldlab.streaming.dialogue` over streams.

The memory: what is said wins. A pronoun takes the player, team or game that the memory has; a message that begins as a
continuation and brings a statistic or outcome takes the player, else the team; a reset, or `ttl` without an understood
message, forgets everything. A message that needs clarification leaves the memory as it is. A new player clears the
game; a new team clears the player.

Null and empty texts need clarification; rows of one conversation with equal time and turn are taken in the order of
their texts; a null conversation is a conversation. Rows without a time keep the time of the row before.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that refer to what was said before.
PLAYER_PRONOUNS = ("he", "him", "his", "that player", "this player", "the player", "that hitter", "this hitter", "the hitter", "that pitcher", "this pitcher", "the pitcher")
TEAM_PRONOUNS = ("they", "them", "their", "that team", "this team", "the team", "that club", "this club", "the club")
GAME_PRONOUNS = ("that game", "this game", "the game", "that matchup", "this matchup", "the matchup")
STATISTIC_PRONOUNS = ("that stat", "this stat", "the stat", "same stat", "that number", "this number", "the number", "it")
OUTCOME_PRONOUNS = ("that outcome", "this outcome", "the outcome", "same outcome", "again", "do it again")
ELLIPTICAL = ("what about ", "how about ", "and ", "also ", "then ", "now ", "same for ", "what if ")
CORRECTIONS = ("no ", "not ", "i meant ", "actually ", "instead ", "correction ")
RESETS = ("new question", "forget that", "forget the previous question", "clear context", "clear memory", "reset context", "reset chat", "start over", "new topic")
CONTINUATIONS = ("same player", "same team", "same game", "same matchup", "same one")
#: Confidence of a value taken from the memory, by how it is referred to; a value that is said has SAID.
SAID, TAKEN = 0.90, {"player_pronoun": 0.88, "team_pronoun": 0.86, "game_pronoun": 0.84, "player_ellipsis": 0.80, "team_ellipsis": 0.78, "statistic": 0.76, "outcome": 0.74}

STATISTICS = tuple((a, c) for c, names in {
    "ops": ("ops", "on base plus slugging"), "obp": ("obp", "on base percentage"), "slg": ("slg", "slugging"), "avg": ("avg", "batting average"), "era": ("era", "earned run average"),
    "home_runs": ("home runs", "homers"), "strikeouts": ("strikeouts",), "walks": ("walks",), "hits": ("hits",), "rbi": ("rbi", "rbis"), "stolen_bases": ("stolen bases", "steals"),
}.items() for a in names)
OUTCOMES = tuple((a, c) for c, names in {
    "home_run": ("home run", "homer"), "hit": ("hit", "base hit"), "walk": ("walk",), "strikeout": ("strikeout", "strike out"), "double": ("double",), "triple": ("triple",), "total_bases": ("total bases",),
}.items() for a in names)


@dataclass(frozen=True)
class Rule:
    """Evidence for an intent: a phrase or word that stands whole, all words of a set, a prefix, or a pattern."""

    intent: str
    mode: str
    pattern: str
    weight: float


RULES = (
    Rule("help", "phrase", "what can you do", 8.0), Rule("help", "phrase", "what can i ask", 8.0), Rule("help", "prefix", "help", 6.0),
    Rule("database_status", "phrase", "database connected", 8.0), Rule("database_status", "set", "database status", 7.0), Rule("database_status", "word", "database", 3.0),
    Rule("explain_model", "phrase", "how was that calculated", 7.0), Rule("explain_model", "prefix", "explain", 4.0), Rule("explain_model", "prefix", "why", 3.0),
    Rule("player_probability", "phrase", "player probability", 7.0), Rule("team_probability", "phrase", "team probability", 7.0),
    Rule("general_probability", "word", "predict", 4.0), Rule("general_probability", "phrase", "how likely", 5.0), Rule("general_probability", "word", "chance", 3.0), Rule("general_probability", "word", "odds", 3.0), Rule("general_probability", "regex", "will .* (hit|homer|walk)", 3.0),
    Rule("schedule_lookup", "phrase", "play next", 6.5), Rule("schedule_lookup", "word", "schedule", 6.0), Rule("schedule_lookup", "prefix", "when", 2.0),
    Rule("roster_lookup", "word", "roster", 6.5), Rule("roster_lookup", "phrase", "who plays for", 6.0),
    Rule("game_lookup", "phrase", "who won", 6.0), Rule("game_lookup", "phrase", "who wins", 6.0), Rule("game_lookup", "word", "score", 3.0),
    Rule("stat_request", "word", "stats", 5.0), Rule("stat_request", "word", "numbers", 2.0), Rule("stat_request", "prefix", "what is", 1.0), Rule("stat_request", "set", "this season", 1.0),
    Rule("compare_players", "word", "compare", 4.0), Rule("compare_teams", "set", "compare teams", 6.0),
    Rule("general_probability", "phrase", "last year", -2.0), Rule("stat_request", "word", "predict", -3.0),
)
#: Intents in the order that ties are decided in; those that, from this weight on, are taken before any other, in turn.
ORDER = ("help", "database_status", "explain_model", "player_probability", "team_probability", "general_probability", "schedule_lookup", "game_lookup", "roster_lookup", "player_stat_request", "team_stat_request", "stat_request", "compare_players", "compare_teams", "player_info", "team_info", "general")
FIRM = (("help", 6.0), ("database_status", 6.0), ("@players", 0.0), ("@teams", 0.0), ("explain_model", 5.0), ("player_probability", 6.0), ("team_probability", 6.0), ("schedule_lookup", 6.0), ("game_lookup", 6.0), ("roster_lookup", 6.0), ("@stat", 4.0))
SYSTEM = ("help", "database_status")
#: What the things that are named count for: the named, the intent, its weight.
NAMED = (("player", "player_info", 2.0), ("team", "team_info", 2.0), ("players", "compare_players", 8.5), ("teams", "compare_teams", 8.5), ("player+outcome", "player_probability", 9.0), ("team+outcome", "team_probability", 7.5), ("statistic", "stat_request", 4.0))
#: What an intent can't do without, in the order it is asked for ("who": a player or a team).
NEEDS = {
    "player_stat_request": ("statistic",), "team_stat_request": ("statistic",), "stat_request": ("who", "statistic"), "player_probability": ("player", "outcome"), "team_probability": ("team", "outcome"),
    "general_probability": ("who", "outcome"), "schedule_lookup": ("team",), "roster_lookup": ("team",),
}
CARRIED = ("player", "team", "game", "statistic", "outcome", "date", "season")


# --- what a message says by itself: expressions of its row


def normalized(text: Column) -> Column:
    """Lower-case words of a-z and 0-9 with one blank between; empty for null."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def says(low: Column, phrase: str) -> Column:
    return F.contains(F.concat(F.lit(" "), low, F.lit(" ")), F.lit(f" {phrase} "))


def says_any(low: Column, phrases: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [says(low, p) for p in phrases])


def begins(low: Column, prefixes: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [low.startswith(p) for p in prefixes])


def vocabulary_hit(low: Column, vocabulary: Sequence[tuple[str, str]]) -> Column:
    """alias and canonical of the longest alias that stands whole in the message (ties: the last by name); null for none."""
    hits = [F.when(says(low, a), F.struct(F.lit(len(a)).alias("size"), F.lit(a).alias("alias"), F.lit(c).alias("canonical"))) for a, c in vocabulary]
    return F.array_max(F.array_compact(F.array(*hits)))


def rule_met(low: Column, rule: Rule) -> Column:
    if rule.mode in ("phrase", "word"):
        return says(low, rule.pattern)
    if rule.mode == "set":
        return reduce(lambda a, b: a & b, [says(low, w) for w in rule.pattern.split()])
    return low.startswith(rule.pattern) if rule.mode == "prefix" else low.rlike(rule.pattern)


def evidence(low: Column, rules: Sequence[Rule] = RULES) -> Column:
    """Array of (intent, net weight, rules met for it) of the intents that a message has evidence for, by one pass over its
    own row."""
    out = []
    for intent in dict.fromkeys(r.intent for r in rules):
        own = [(rule_met(low, r).cast("int"), r.weight) for r in rules if r.intent == intent]
        net = reduce(lambda a, b: a + b, [met * F.lit(w) for met, w in own])
        met = reduce(lambda a, b: a + b, [m for m, _ in own])
        good = reduce(lambda a, b: a + b, [m for m, w in own if w > 0])
        out.append(F.when(met > 0, F.struct(F.lit(intent).alias("intent"), net.alias("net"), good.alias("met"))))
    return F.array_compact(F.array(*out))


def features(messages: DataFrame, rules: Sequence[Rule] = RULES, statistics: Sequence[tuple[str, str]] = STATISTICS, outcomes: Sequence[tuple[str, str]] = OUTCOMES) -> DataFrame:
    """conv_id, turn, ts, low and what a message says by itself; no shuffle, on streams too."""
    row = F.expr("uuid()") if messages.isStreaming else F.monotonically_increasing_id()  # parts repeated rows
    rows = messages.select("conv_id", "turn", "ts", normalized(F.col("text")).alias("low"), row.alias("row"))
    rows = rows.withColumn("tie", F.xxhash64("low"))
    low = F.col("low")
    return rows.withColumns({
        "statistic": vocabulary_hit(low, statistics)["canonical"], "outcome": vocabulary_hit(low, outcomes)["canonical"],
        "date": F.nullif(F.regexp_extract(low, r"\b(today|tonight|tomorrow|yesterday)\b", 1), F.lit("")), "season": F.nullif(F.regexp_extract(low, r"\b((?:19|20)[0-9]{2})\b", 1), F.lit("")),
        "versus": says_any(low, ("vs", "versus", "against", "at")), "reset": says_any(low, RESETS), "correction": begins(low, CORRECTIONS), "elliptical": begins(low, ELLIPTICAL), "continuation": says_any(low, CONTINUATIONS),
        "of_player": says_any(low, PLAYER_PRONOUNS), "of_team": says_any(low, TEAM_PRONOUNS), "of_game": says_any(low, GAME_PRONOUNS), "of_statistic": says_any(low, STATISTIC_PRONOUNS), "of_outcome": says_any(low, OUTCOME_PRONOUNS),
        "nets": evidence(low, rules),
    })


def with_mentions(rows: DataFrame, catalog: DataFrame, most_words: int, few: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """rows of `features` as one row of (conv_id, turn, ts, row, tie and `keep`) with the features in a struct `says`, and
    beside it a small row for each name of the catalogue (kind: player or team, alias in normalised words, name) that
    stands in them, with kind, name and the hit's place and size. Windows of up to most_words words meet the aliases by an
    equi join; of a window's row only its message's key and its words are shuffled. `few`: the catalogue has been counted
    small."""
    words = F.col("words")  # a column of its own: inside the lambdas a text would be split again for every window
    starts = lambda n: F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1)))
    window = lambda k, n: F.struct(k.alias("at"), n.alias("size"), F.array_join(F.slice(words, k, n), " ").alias("said"))
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(max(1, most_words))), lambda n: F.transform(starts(n), lambda k: window(k, n))))
    message = F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("size"), F.lit(None).cast("string").alias("said")))
    key = ["conv_id", "turn", "ts", "row", "tie", *keep]
    known = catalog.select(F.col("alias").alias("said"), "kind", "name")
    each = rows.withColumn("words", F.split("low", " ")).withColumn("span", F.explode(F.concat(message, spans)))
    says = F.when(F.col("span.at") == 0, F.struct(*[c for c in rows.columns if c not in key])).alias("says")
    met = each.select(*key, says, "span.*").join(F.broadcast(known) if few else known, "said", "left")
    return met.where(F.col("name").isNotNull() | (F.col("at") == 0)).drop("said")


# --- what a conversation carries on


@dataclass(frozen=True)
class Memory:
    """What is held of a conversation; microseconds of the last understood message and of the last one of any kind."""

    held: dict[str, str] = field(default_factory=dict)
    turns: int = 0
    updated: int | None = None
    seen: int | None = None

    def late(self, at: int | None, ttl: int) -> bool:
        since = self.seen if self.updated is None else self.updated
        return since is not None and at is not None and at - since >= ttl

    def text(self) -> str:
        return json.dumps([self.held, self.turns, self.updated, self.seen], ensure_ascii=False, sort_keys=True)


def read_memory(text: str | None) -> Memory:
    return Memory(*json.loads(text)) if text else Memory()


def names_of(hits: Sequence[tuple[str | None, str | None, int, int]]) -> tuple[list[str], list[str]]:
    """Players and teams of (kind, name, at, size) in the order of their places; a hit inside a longer one doesn't count."""
    found: dict[str, dict[str, None]] = {"player": {}, "team": {}}
    end, last = 0, (0, 0)
    for kind, name, at, size in sorted((h for h in hits if h[1] is not None), key=lambda h: (h[2], -h[3], h[1])):
        if (at, size) == last or at + size > end:  # else it lies within one that begins before it or is longer
            found[kind][name] = None
            end, last = at + size, (at, size)
    return list(found["player"]), list(found["team"])


def choose(nets: Sequence[tuple[str, float, int]], players: Sequence[str], teams: Sequence[str], statistic: str | None, outcome: str | None) -> tuple[str, float]:
    """The intent and its confidence: .30 + .48 of its saturated weight + .18 of its lead + .025 a rule (.14 at most) + .05
    where it was taken before others, at most .99; .30 without evidence."""
    there = {"player": players, "team": teams, "players": players[1:], "teams": teams[1:], "statistic": statistic, "outcome": outcome}
    net, met = {i: w for i, w, _ in nets}, {i: n for i, _, n in nets}
    for needs, intent, weight in NAMED:
        if all(there[x] for x in needs.split("+")):
            net[intent], met[intent] = net.get(intent, 0.0) + weight, met.get(intent, 0) + 1
    whose = "player_stat_request" if players else "team_stat_request" if teams else None
    named = {"@players": ("compare_players", bool(players[1:])), "@teams": ("compare_teams", bool(teams[1:])), "@stat": (whose, whose and max(net.get(i, 0.0) for i in ("stat_request", "player_stat_request", "team_stat_request")) >= FIRM[-1][1])}
    ranked = sorted((i for i in net if net[i] > 0), key=lambda i: (-net[i], ORDER.index(i)))
    firm = next((named[i][0] if i in named else i for i, least in FIRM if (named[i][1] if i in named else net.get(i, 0.0) >= least)), None)
    intent = firm or (ranked[0] if ranked else "general")
    if intent not in SYSTEM:
        upgrades = {
            "compare_players": players[1:], "compare_teams": teams[1:], "player_probability": players and (outcome or intent == "general_probability"), "team_probability": teams and (outcome or intent == "general_probability"),
            "player_info": players and intent == "general", "team_info": teams and intent == "general",
        }
        intent = next((i for i, when in upgrades.items() if when), intent)
    if net.get(intent, 0.0) <= 0:
        return intent, 0.30
    lift = lambda i: 1 - math.exp(-net[i] / 10)
    rest = next((lift(i) for i in ranked if i != intent), 0.0)
    lead = max(0.0, lift(intent) - rest)
    return intent, min(0.99, 0.30 + 0.48 * lift(intent) + 0.18 * lead + min(0.14, 0.025 * met[intent]) + (0.05 if firm else 0.0))


def follow_up(turn: dict, players: Sequence[str], teams: Sequence[str], game: str | None) -> str:
    refers = (turn["of_player"] and not players) or (turn["of_team"] and not teams) or (turn["of_game"] and not game)
    kinds = (("reset", turn["reset"]), ("correction", turn["correction"]), ("pronoun", refers), ("elliptical", turn["elliptical"]), ("continuation", turn["continuation"]))
    return next((k for k, met in kinds if met), "none") if turn["low"] else "none"


def advance(memory: Memory, turn: dict, hits: Sequence[tuple], ttl: int) -> tuple[Memory, dict]:
    """The memory after a message, and what the message means."""
    at = memory.seen if turn["ts"] is None else turn["ts"]
    begun = "reset" if turn["reset"] else "expired" if memory.late(at, ttl) else ""
    memory = Memory(seen=at) if begun else replace(memory, seen=at)
    players, teams = names_of(hits)
    game = f"{teams[0]} vs {teams[1]}" if turn["versus"] and teams[1:] else None
    intent, sure = choose(turn["nets"], players, teams, turn["statistic"], turn["outcome"])
    said = {"player": next(iter(players), None), "team": next(iter(teams), None), "game": game, **{k: turn[k] for k in CARRIED[3:]}}
    meant, taken = {k: v for k, v in said.items() if v is not None}, {}

    def take(what: str, how: str, when: object) -> None:
        if when and what not in meant and what in memory.held:
            meant[what], taken[what] = memory.held[what], TAKEN[how]

    for what in ("player", "team", "game"):
        take(what, f"{what}_pronoun", turn[f"of_{what}"])
    alone = turn["elliptical"] and "player" not in meant and "team" not in meant
    take("player", "player_ellipsis", alone and ("statistic" in meant or "outcome" in meant))
    take("team", "team_ellipsis", alone and "player" not in meant and "statistic" in meant)
    take("statistic", "statistic", turn["of_statistic"])
    take("outcome", "outcome", turn["of_outcome"])
    lacks = {"who": not ("player" in meant or "team" in meant), **{k: k not in meant for k in CARRIED}}
    asks = "message" if not turn["low"] else next((k for k in NEEDS.get(intent, ()) if lacks[k]), "")
    out = {
        "kind": follow_up(turn, players, teams, game), "intent": intent, **{k: meant.get(k) for k in CARRIED}, "taken": ",".join(k for k in CARRIED if k in taken), "asks": "player" if asks == "who" else asks, "begun": begun,
        "confidence": min(0.99, 0.30 + (0.15 if intent != "general" else 0.0) + sum(0.10 * taken.get(k, SAID) for k in meant) + 0.18 * sure + (0.03 if taken else 0.0) - (0.08 if begun == "expired" else 0.0)),
    }
    if asks:
        return memory, out | {"turns": memory.turns}
    held = {**memory.held, **meant}
    if "player" in said and said["player"] is not None and game is None:
        held.pop("game", None)
    if said["team"] is not None:
        held.pop("player", None)
    return replace(memory, held=held, turns=memory.turns + 1, updated=at), out | {"turns": memory.turns + 1}


RESULT = "conv_id long, turn long, kind string, intent string, player string, team string, game string, statistic string, outcome string, date string, season string, taken string, asks string, begun string, confidence double, turns long, at long, memory string"
COLUMNS = [c.split()[0] for c in RESULT.split(", ")]
DAY = 24 * 3600 * 1_000_000


def turns_of(batches: Iterable[pd.DataFrame]) -> Iterator[list[tuple[dict, list[tuple]]]]:
    """The messages of sorted batches of `with_mentions`, each with its hits: for every batch those that it completes."""
    turn, hits = None, []
    for batch in batches:
        done = []
        for row in tidy(batch).to_dict("records"):
            if row["says"] is None:
                hits.append((row["kind"], row["name"], row["at"], row["size"]))
                continue
            if turn is not None:
                done.append((turn, hits))
            turn, hits = {**row, **row["says"]}, []
        yield done
    if turn is not None:
        yield [(turn, hits)]


def tidy(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows with plain values: None for what is missing, times as microseconds, nets as tuples."""
    rows = rows.astype(object).where(rows.notna(), None)
    rows["ts"] = pd.Series([None if t is None else pd.Timestamp(t).value // 1000 for t in rows["ts"]], index=rows.index, dtype=object)
    nets = lambda says: [(x["intent"], float(x["net"]), int(x["met"])) for x in (() if says["nets"] is None else says["nets"])]
    rows["says"] = [None if x is None else {**(x if isinstance(x, dict) else x.asDict()), "nets": nets(x)} for x in rows["says"]]
    return rows


#: The order in which a conversation's rows are taken.
SORTED = ["ts", "turn", "tie", "row", "at", "size", "name"]


def understand(messages: DataFrame, catalog: DataFrame, ttl: int = DAY, rules: Sequence[Rule] = RULES) -> DataFrame:
    """messages (conv_id, turn, ts, text) with what each means, RESULT's columns.

    Conversations are cut where nothing is carried on (a reset, `ttl` between two messages), so that a long one is several
    pieces; rows are dealt out by piece and sorted, and a task holds one Arrow batch and one memory, however long a piece."""
    sizes = catalog.agg(F.max(F.size(F.split("alias", " "))).alias("words"), F.count(F.lit(1)).alias("n")).first()
    rows = features(messages, rules)
    order = Window.partitionBy("conv_id").orderBy(F.col("ts").asc_nulls_first(), "turn", "tie")
    ends = F.col("reset") | F.coalesce(F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(order) >= ttl, F.lit(False))
    rows = rows.withColumn("ends", ends.cast("int")).withColumn("piece", F.sum("ends").over(order)).withColumn("after", F.lag(F.lit(1)).over(order)).drop("ends")
    named = with_mentions(rows, catalog.select("alias", "kind", "name"), sizes.words or 1, sizes.n <= 100_000, ["piece", "after"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: object = None
        memory = Memory()

        def told(groups: list[tuple[dict, list[tuple]]]) -> pd.DataFrame:
            nonlocal at, memory
            out = []
            for turn, hits in groups:
                piece = (turn["conv_id"], turn["piece"])
                if piece != at:  # what lies before a later piece is forgotten, whatever it was
                    at, memory = piece, Memory(seen=turn["ts"] - ttl) if turn["after"] and turn["ts"] is not None else Memory()
                memory, meant = advance(memory, turn, hits, ttl)
                out.append({"conv_id": turn["conv_id"], "turn": turn["turn"], **meant, "at": memory.seen, "memory": memory.text()})
            return pd.DataFrame(out, columns=COLUMNS)

        return map(told, turns_of(batches))

    dealt = named.repartition("conv_id", "piece").sortWithinPartitions("conv_id", "piece", F.col("ts").asc_nulls_first(), *SORTED[1:])
    return dealt.mapInPandas(run, RESULT)


def last_memories(understood: DataFrame) -> DataFrame:
    """conv_id, memory after the last message of each conversation: what a later job or stream begins with."""
    return understood.groupBy("conv_id").agg(F.max_by("memory", F.struct("at", "turn")).alias("memory"))
