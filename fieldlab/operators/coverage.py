"""Coverage of players by metrics, and readiness of profiles.

Null counts and times are unknown ones. A player is one row for each season and group; of repeated rows the latest one counts,
by time, then sample, and the repetition is told. Tables without rows give no coverage."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlab.sources.shared import stage

# Least samples of the three upper states by group, hours that are fresh, weights and scores of a profile's parts.
SAMPLES = {"hitting": (25, 100, 250), "pitching": (100, 500, 1500)}
STATES = ("limited", "usable", "strong")
FRESH_HOURS, AGING_TIMES = 36.0, 3.0
WEIGHTS = {"identity": 0.25, "season": 0.30, "form": 0.20, "tracking": 0.25}
STATE_SCORES = {"ready": 1.0, "partial": 0.5, "stale": 0.5, "missing": 0.0, "error": 0.0}
READY, PARTIAL = 95.0, 50.0


def sample_state(sample: Column, group: Column, least: dict[str, Sequence[int]] = SAMPLES) -> Column:
    """insufficient, limited, usable or strong by the group's least samples; unknown for null, and for an unknown group."""
    of = lambda cuts: reduce(lambda w, s: w.when(sample >= s[0], s[1]), list(zip(cuts, STATES))[-2::-1], F.when(sample >= cuts[-1], STATES[-1])).otherwise("insufficient")
    known = reduce(lambda w, kv: w.when((group == kv[0]) & sample.isNotNull(), of(kv[1])), list(least.items())[1:], F.when((group == next(iter(least))) & sample.isNotNull(), of(next(iter(least.values())))))
    return known.otherwise("unknown")


def freshness(updated_at: Column, as_of: Column, fresh_hours: float = FRESH_HOURS, aging_hours: float | None = None) -> Column:
    """fresh up to the hours, aging up to three times as many (or aging_hours), else stale; a time after as_of is new; unknown for null."""
    seconds = lambda x: F.unix_micros(x.cast("timestamp"))
    age = F.greatest((seconds(as_of) - seconds(updated_at)) / 3.6e9, F.lit(0.0))
    aging = AGING_TIMES * fresh_hours if aging_hours is None else aging_hours
    return F.when(updated_at.isNull() | as_of.isNull(), "unknown").when(age <= fresh_hours, "fresh").when(age <= aging, "aging").otherwise("stale")


def metric_coverage(eligible: DataFrame, metrics: DataFrame, fields: Sequence[str], fresh_hours: float = FRESH_HOURS) -> DataFrame:
    """season, group: eligible players (group, player_id), how many of them lack metrics, players covered, repeated (in
    several rows), incomplete (a field is null), usable (a usable or strong sample), fresh and stale; and whether the gate
    opens: there are players, none repeated, some usable, some with a time. metrics: season, group, player_id, sample,
    updated_at, retrieved_at, `fields`."""
    key = ["season", "group", "player_id"]
    row = F.struct("updated_at", "sample", "retrieved_at", *fields)
    latest = stage(metrics.groupBy(*key).agg(F.max(row).alias("m"), F.count(F.lit(1)).alias("n")).where("player_id is not null"), "latest")
    lacks = reduce(lambda a, b: a | b, [F.col(f"m.{f}").isNull() for f in fields], F.lit(False))
    state, age = sample_state(F.col("m.sample"), F.col("group")), freshness(F.col("m.updated_at"), F.col("m.retrieved_at"), fresh_hours)
    found = latest.groupBy("season", "group").agg(
        F.count(F.lit(1)).alias("covered"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(lacks).alias("incomplete"), F.count_if(state.isin(*STATES[1:])).alias("usable"), F.count_if(age == "fresh").alias("fresh"), F.count_if(age == "stale").alias("stale"),
    )
    asked = stage(eligible.select("group", "player_id").dropna().distinct(), "eligible")
    wanted = asked.groupBy("group").agg(F.count(F.lit(1)).alias("eligible"))
    here = latest.select("season", "group", "player_id").join(asked, ["group", "player_id"], "left_semi").groupBy("season", "group").agg(F.count(F.lit(1)).alias("here"))
    rows = found.join(wanted, "group", "left").join(here, ["season", "group"], "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    gate = (F.col("covered") > 0) & (F.col("repeated") == 0) & (F.col("usable") > 0) & (F.col("fresh") + F.col("stale") > 0)
    return rows.select("season", "group", n("eligible").alias("eligible"), (n("eligible") - n("here")).alias("missing"), "covered", "repeated", "incomplete", "usable", "fresh", "stale", gate.alias("open"))


def profile_state(states: dict[str, Column], weights: dict[str, float] = WEIGHTS, ready: float = READY, partial: float = PARTIAL) -> tuple[Column, Column]:
    """The score of a profile from 0 to 100 by the states of its parts (one decimal), and what it comes to: ready, partial or
    missing. An unknown state counts 0."""
    value = F.create_map(*[F.lit(x) for kv in STATE_SCORES.items() for x in kv])
    score = F.round(reduce(lambda a, b: a + b, [F.coalesce(value[s], F.lit(0.0)) * weights[k] for k, s in states.items()]) * 100, 1)
    return score, F.when(score >= ready, "ready").when(score >= partial, "partial").otherwise("missing")
