"""Streams: conversation state with expiry, idempotent upserts, and running feedback metrics."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fieldlab.operators.merge import one_per_key, upsert

EXPIRY = pd.Timedelta(hours=24)


def carry_entities(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, ts, entity, reset) with the last entity said in the conversation: an entity of the turn
    wins, a reset or 24 hours of silence forget it. State is one row for each conversation and expires by event time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, last, turns = state.get if state.exists else (None, None, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "turn"])
        out = []
        for row in rows.itertuples(index=False):
            if row.reset or (last is not None and row.ts - pd.Timestamp(last, unit="us") > EXPIRY):
                held, turns = None, 0
            held = held if pd.isna(row.entity) else row.entity
            last, turns = int(row.ts.value // 1000), turns + 1
            out.append((key[0], row.turn, held, turns))
        state.update((held, last, turns))
        state.setTimeoutTimestamp(max(last // 1000 + int(EXPIRY.total_seconds() * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["conv_id", "turn", "entity", "turns"])

    marked = messages.withWatermark("ts", "1 hour")
    return marked.groupBy("conv_id").applyInPandasWithState(
        step, "conv_id long, turn long, entity string, turns int", "entity string, last long, turns int", "append", GroupStateTimeout.EventTimeTimeout
    )


def upsert_feed(updates: DataFrame, target_path: str, keys: list[str], checkpoint: str, last: list[str] | None = None, parts: int = 16) -> StreamingQuery:
    """Merges every batch into a Parquet table at target_path/v<batch>, in `parts` partitions of the key's hash. Only
    partitions that a batch touches are written; the others are named by the version's list of where each lies, so a batch
    costs what it touches. A batch that runs again writes its version anew, with the same rows; the version before it is
    the newest that is complete, whatever its number. Of several rows of one key the one that `last` orders highest
    counts. The driver keeps a list of `parts` short paths; files that no version names any more are the caller's to clear."""
    slot = lambda df: df.withColumn("__part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        places = _places(spark, target_path, number)
        fresh = slot(batch).persist()
        try:
            for k in sorted(r["__part"] for r in fresh.select("__part").distinct().collect()):
                rows = one_per_key(fresh.where(F.col("__part") == k).drop("__part"), keys, last)
                if k in places:
                    rows = upsert(spark.read.parquet(places[k]), rows, keys, last)
                path = f"{target_path}/data/v{number}-{k}"
                rows.write.mode("overwrite").parquet(path)
                places[k] = path
        finally:
            fresh.unpersist()
        spark.createDataFrame(sorted(places.items()), "part int, path string").coalesce(1).write.mode("overwrite").parquet(f"{target_path}/versions/v{number}")

    return updates.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _places(spark: SparkSession, target_path: str, before: int) -> dict[int, str]:
    """Where each partition of the newest version before `before` lies; a version is one file, moved into place at its end."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    try:
        done = files.load(f"{target_path}/versions").select(F.regexp_extract("path", r"/v(\d+)/", 1).cast("int").alias("v")).where(F.col("v") < before).agg(F.max("v")).first()[0]
    except AnalysisException:  # no version yet
        return {}
    return {} if done is None else {r.part: r.path for r in spark.read.parquet(f"{target_path}/versions/v{done}").collect()}


def read_feed(spark: SparkSession, target_path: str) -> DataFrame:
    """The newest complete version of a table that upsert_feed writes."""
    return spark.read.parquet(*_places(spark, target_path, 1 << 31).values())


def split_late(records: DataFrame, as_of: Column, policy: str = "drop") -> tuple[DataFrame, DataFrame]:
    """(kept, late): records of strictly earlier times and the others. Policies: "drop" and "warn" give both tables (the
    second marks them for a side output), "error" raises where there is a late one. Null times are kept."""
    if policy not in ("drop", "warn", "error"):
        raise ValueError(f"no policy {policy}")
    late = F.coalesce(F.col("ts") >= as_of, F.lit(False))
    if policy == "error" and records.where(late).take(1):
        raise ValueError("records at or after their time of use")
    return records.where(~late), records.where(late).withColumn("warning", F.lit(policy == "warn"))


def feedback_metrics(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and mean value by window and type; works on streams (late rows within the watermark count) and tables."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean")).select(
        F.col("w.start").alias("start"), "event_type", "n", "mean"
    )


def resolve_stream(forecasts: DataFrame, outcomes: DataFrame, within: str = "2 days", delay: str = "1 hour") -> DataFrame:
    """forecasts (forecast_id, player_id, outcome, probability, made_at) with what came of them (outcomes: outcome_id,
    player_id, outcome, happened, seen_at): the label, and a training weight 1 + |error|, at most 2. A forecast meets
    the outcomes of its player and kind that are seen after it and within `within`; one that meets none comes out, without a label,
    when the outcomes' watermark has passed. Rows of one id that come again within the watermark count once, so a replayed batch
    adds nothing; rows later than `delay` are left out. Append output, for streams."""
    f = forecasts.withWatermark("made_at", delay).dropDuplicatesWithinWatermark(["forecast_id"]).alias("f")
    o = outcomes.withWatermark("seen_at", delay).dropDuplicatesWithinWatermark(["outcome_id"]).alias("o")
    same = (F.col("f.player_id") == F.col("o.player_id")) & (F.col("f.outcome") == F.col("o.outcome"))
    soon = (F.col("seen_at") >= F.col("made_at")) & (F.col("seen_at") <= F.col("made_at") + F.expr(f"INTERVAL {within}"))
    error = F.abs(F.col("happened").cast("double") - F.col("probability"))
    return f.join(o, same & soon, "left_outer").select(
        "forecast_id", F.col("f.player_id").alias("player_id"), F.col("f.outcome").alias("outcome"), "probability", "made_at", "outcome_id",
        F.col("happened").cast("double").alias("label"), F.when(F.col("outcome_id").isNotNull(), F.least(1 + error, F.lit(2.0))).alias("weight"), F.col("outcome_id").isNotNull().alias("resolved"),
    )
