"""Interactions as records of a log, and the aliases that they teach.

A record is of one message: the reply, what was understood, a summary, its importance and a JSON context. Null texts are
empty; a message or reply told twice counts once (the smallest text); a message without a reply has none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlab.operators.dialogue import normalized

# Importance of a record by what is known of it, its bound, and that of a blocked message.
BASE, KNOWN, SEVERAL, MOST, BLOCKED = 35, 10, 5, 95, 20
GENERAL = "General chat interaction"
#: What is understood, by the column's name: its title in a summary.
TITLES = {"intent": "Intent", "team": "Team", "player": "Player", "outcome": "Outcome"}


def clean(text: Column) -> Column:
    """Without white space around; empty for null."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def importance(intent: Column, team: Column, player: Column, outcome: Column, players: Column | None = None, teams: Column | None = None, blocked: Column | None = None) -> Column:
    """35, 10 for each of the four that is known, 5 for several players and for several teams, 95 at most; 20 where blocked."""
    no = F.lit(False)
    add = lambda c, n: F.when(c, n).otherwise(0)
    score = reduce(lambda a, b: a + b, [add(F.coalesce(c, F.lit("")) != "", KNOWN) for c in (intent, team, player, outcome)], F.lit(BASE))
    score = score + add(no if players is None else players, SEVERAL) + add(no if teams is None else teams, SEVERAL)
    return F.when(no if blocked is None else blocked, BLOCKED).otherwise(F.least(score, F.lit(MOST)))


def summary(**known: Column) -> Column:
    """What is known, titled, with bars between; a fixed text where nothing is."""
    said = F.concat_ws(" | ", *[F.when(F.coalesce(known[k], F.lit("")) != "", F.concat(F.lit(f"{title}: "), known[k])) for k, title in TITLES.items() if k in known])
    return F.when(said == "", GENERAL).otherwise(said)


def interaction_records(messages: DataFrame, understood: DataFrame, replies: DataFrame, category: str = "chat") -> DataFrame:
    """A record for each message (conv_id, turn, text) with what `understood` says of it (conv_id, turn, intent, player,
    team, outcome, kind) and the reply (conv_id, turn, text) that has the next number. Joins are by conversation and turn,
    so a long conversation lies in all tasks. record_id is a digest of conversation, turn and message."""
    one = lambda df, name: df.groupBy("conv_id", "turn").agg(F.min(clean(F.col("text"))).alias(name))
    answers = one(replies, "reply").withColumn("turn", F.col("turn") - 1)
    means = understood.select("conv_id", "turn", "intent", "player", "team", "outcome", "kind").dropDuplicates(["conv_id", "turn"])
    rows = one(messages, "message").join(answers, ["conv_id", "turn"], "left").join(means, ["conv_id", "turn"], "left")
    c = F.col
    weight = importance(c("intent"), c("team"), c("player"), c("outcome"), c("intent").eqNullSafe("compare_players"), c("intent").eqNullSafe("compare_teams"))
    context = F.to_json(F.struct("conv_id", "turn", "kind"), {"ignoreNullFields": "false"})
    return rows.select(
        F.sha2(F.concat_ws("|", c("conv_id").cast("string"), c("turn").cast("string"), c("message")), 256).alias("record_id"), "conv_id", "turn", F.lit(category).alias("category"), "message", F.coalesce("reply", F.lit("")).alias("reply"),
        "intent", "player", "team", "outcome", summary(intent=c("intent"), team=c("team"), player=c("player"), outcome=c("outcome")).alias("summary"), weight.alias("importance"), context.alias("context"),
    )


def append_records(records: DataFrame, path: str, batch: str) -> None:
    """records appended to the Parquet log as the part `batch`. A batch that is written again, after a lost driver or a retry,
    replaces its own part and no other, so nothing is there twice. Also a foreachBatch step, with the batch's number."""
    records.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def unsaid_names(records: DataFrame, kinds: tuple[str, ...] = ("player", "team")) -> DataFrame:
    """entity_type, canonical, phrase, used, conversations: names that a message was understood to mean, and that do not
    stand in it, with the phrase (lower-case words) that stood for them. Empty messages and names teach nothing."""
    known = F.explode(F.array(*[F.struct(F.lit(k).alias("entity_type"), F.col(k).cast("string").alias("canonical")) for k in kinds]))
    rows = records.select("conv_id", normalized(F.col("message")).alias("phrase"), known.alias("e")).select("conv_id", "phrase", "e.*")
    low = normalized(F.col("canonical"))
    rows = rows.where((F.col("phrase") != "") & (low != "") & ~F.contains(F.col("phrase"), low))
    return rows.groupBy("entity_type", "canonical", "phrase").agg(F.count(F.lit(1)).alias("used"), F.count_distinct("conv_id").alias("conversations"))


def corrected_aliases(said: DataFrame, decisions: DataFrame) -> DataFrame:
    """alias, canonical, confidence, used: what was said (a row for each use, column said) and accepted for another name,
    by the decisions of `matching.decide`."""
    taken = decisions.where((F.col("decision") == "accepted") & (F.col("asked") != F.col("name"))).select(F.col("asked").alias("alias"), F.col("name").alias("canonical"), F.col("score").alias("confidence"))
    counted = said.where("said <> ''").groupBy(F.col("said").alias("alias")).agg(F.count(F.lit(1)).alias("used"))
    return taken.join(counted, "alias").select("alias", "canonical", "confidence", "used")
