"""Keyed merges: what a batch of source rows would change in a target, and the target afterwards.

Keys may be null: null matches null. A key that occurs more than once in the source counts once, with the row that `last`
orders highest (or an arbitrary but fixed one, the largest by value, without it)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def same_keys(keys: list[str], a: str, b: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.`{k}`").eqNullSafe(F.col(f"{b}.`{k}`")) for k in keys])


def one_per_key(rows: DataFrame, keys: list[str], last: list[str] | None = None) -> DataFrame:
    """The row of each key that `last`, then all columns, order highest; one aggregation, combined within each task."""
    rest = [c for c in rows.columns if c not in keys]
    order = F.struct(*[F.col(c) for c in last or []], F.struct(*[F.col(c) for c in rest]))
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__best"))
    return best.select(*keys, *[F.col(f"__best.`{c}`").alias(c) for c in rest])


def classify(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """keys, action (created, updated, unchanged, absent) and the sorted names of changed fields. Fields that only one
    side has are ignored. Nulls are equal to nulls. One shuffle join on the keys."""
    fields = sorted(c for c in target.columns if c in source.columns and c not in keys)
    pack = lambda df: df.select(*keys, F.struct(F.lit(1).alias("__there"), *fields).alias("__row"))
    both = pack(target).alias("o").join(one_per_key(pack(source), keys).alias("n"), same_keys(keys, "o", "n"), "full_outer")
    old, new = F.col("o.__row"), F.col("n.__row")
    changed = F.array_compact(F.array(*[F.when(~old.getField(c).eqNullSafe(new.getField(c)), F.lit(c)) for c in fields]))
    action = F.when(old.isNull(), "created").when(new.isNull(), "absent").when(F.size(changed) > 0, "updated").otherwise("unchanged")
    known = F.when(old.isNotNull() & new.isNotNull(), changed).otherwise(F.array().cast("array<string>"))
    named = [F.when(old.isNotNull(), F.col(f"o.`{k}`")).otherwise(F.col(f"n.`{k}`")).alias(k) for k in keys]
    return both.select(*named, action.alias("action"), known.alias("changed"))


def upsert(target: DataFrame, source: DataFrame, keys: list[str], last: list[str] | None = None) -> DataFrame:
    """target with the values of source on rows of equal key, and new rows added. Columns are the target's; those that the
    source lacks keep their values (null on new rows)."""
    fields = [c for c in target.columns if c in source.columns and c not in keys]
    one = one_per_key(source.select(*keys, *{*fields, *(last or [])}), keys, last).select(*keys, F.struct(F.lit(1).alias("__there"), *fields).alias("__row"))
    both = target.alias("o").join(one.alias("n"), same_keys(keys, "o", "n"), "full_outer")
    there = F.col("n.__row").isNotNull()
    out = [F.when(there, F.col("n.__row").getField(c) if c in fields else F.col(f"n.`{c}`") if c in keys else F.col(f"o.`{c}`")).otherwise(F.col(f"o.`{c}`")) for c in target.columns]
    return both.select(*[x.cast(target.schema[c].dataType).alias(c) for x, c in zip(out, target.columns)])


def deactivate_absent(target: DataFrame, source: DataFrame, keys: list[str], flag: str = "is_active") -> DataFrame:
    """target with the flag cleared on rows whose key the source lacks; rows that it has keep theirs (set where there was
    none)."""
    seen = source.select(*keys).distinct().withColumn("__seen", F.lit(True))
    both = target.alias("o").join(seen.alias("n"), same_keys(keys, "o", "n"), "left")
    held = F.coalesce(F.col(f"o.`{flag}`"), F.lit(True)) if flag in target.columns else F.lit(True)
    kept = [F.col(f"o.`{c}`") for c in target.columns if c != flag]
    return both.select(*kept, (F.col("n.__seen").isNotNull() & held).alias(flag))
