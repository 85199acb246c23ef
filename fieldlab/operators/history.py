"""Point-in-time features: only rows of strictly earlier time count.

Rows of one time see the same history: a frame ends before the first of them, and they take over its value. Both windows
share one partitioning and one sort. Times of an entity may repeat; a null time is not history and has none."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


class History:
    def __init__(self, entity: str, time: str, tie: str):
        self.entity, self.time, self.tie = entity, time, tie

    @property
    def order(self) -> WindowSpec:
        return Window.partitionBy(self.entity).orderBy(self.time, self.tie)

    @property
    def tied(self) -> WindowSpec:
        return Window.partitionBy(self.entity, self.time).orderBy(self.time, self.tie)

    def last(self, n: int | None, value: Column) -> Column:
        """An aggregate over the n rows before (all if None)."""
        frame = self.order.rowsBetween(Window.unboundedPreceding if n is None else -n, -1)
        return value.over(frame)

    def settle(self, df: DataFrame, columns: list[str]) -> DataFrame:
        """Tied rows take the first one's values."""
        return df.withColumns({c: F.first(c).over(self.tied) for c in columns})


GAME = History("player_id", "game_date", "game_id")


def with_history(log: DataFrame, columns: dict[str, Column], history: History = GAME) -> DataFrame:
    """log with aggregates over frames of history.last, settled for ties."""
    return history.settle(log.withColumns(columns), list(columns))


def exponential_means(log: DataFrame, value: str, half_lives: list[float], history: History = GAME, keep: Sequence[str] = ()) -> DataFrame:
    """entity, time, tie, the columns to keep, and ewm_<h> for each half-life: the fold of `exponential_mean` over all rows of strictly earlier
    time that have a value; null without one, and on rows without a time.

    With columns to keep, an entity's rows are to be in one partition of the log already. One pass over each entity's rows in order, which carries one number for each half-life: an entity of any size takes
    linear time and no memory."""
    weights = [1 - 0.5 ** (1 / h) for h in half_lives]
    keys = [history.entity, history.time, history.tie]
    names = [f"ewm_{h:g}" for h in half_lives]
    kept = [*keys, *[c for c in keep if c not in keys]]
    rows = log.select(*kept, F.col(value).cast("double").alias("__x"))
    rows = (rows if keep else rows.repartition(history.entity)).sortWithinPartitions(*keys)
    schema = rows.select(*kept).schema
    for name in names:
        schema = schema.add(name, "double")

    def run(batches):
        entity = time = None
        begun, known, means = False, [None] * len(weights), [None] * len(weights)  # known: before the rows of this time
        for batch in batches:
            who, when, xs = batch.column(0).to_pylist(), batch.column(1).cast(pa.int64()).to_pylist(), batch.column(len(kept)).to_pylist()
            out = [[] for _ in weights]
            for e, t, x in zip(who, when, xs):
                if not begun or e != entity:
                    begun, entity, time, known, means = True, e, t, [None] * len(weights), [None] * len(weights)
                elif t != time:
                    time, known = t, list(means)
                for k, a in enumerate(weights):
                    out[k].append(None if t is None else known[k])
                    if x is not None and t is not None:
                        means[k] = x if means[k] is None else means[k] * (1 - a) + x * a
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *[pa.array(c, pa.float64()) for c in out]], names=[*kept, *names])

    return rows.mapInArrow(run, schema)


def exponential_mean(values: Column, half_life: float) -> Column:
    """The fold m = a x + (1 - a) m over an array from its first value, a = 1 - 0.5^(1/half_life); null if empty."""
    a = 1 - 0.5 ** (1 / half_life)
    return F.aggregate(
        F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.get(values, F.lit(0)), lambda m, x: m * (1 - a) + x * a
    )
