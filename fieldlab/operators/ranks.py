"""Places of values in a sorted column, for medians, quartiles and bins of groups of any size.

Equal values are counted first, within each task, so a column of few values is a few rows. What is left is dealt out by
ranges; a value's place is the rows of the group in earlier ranges, by a sum for each range, and those before it in its
own. Neither the driver nor one task sees a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlab.sources.shared import stage


def value_places(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, n, before (rows of smaller values in the group), total, of the non-null values."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    dealt = stage(counted.repartitionByRange(*keys, value).withColumn("__range", F.spark_partition_id()), "values")
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    earlier = group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*keys, "__range").agg(F.sum("n").alias("__n"))
    sums = sums.select(*keys, "__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"), F.sum("__n").over(group).alias("total"))
    inside = Window.partitionBy(*keys, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("__inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(sums, [*keys, "__range"])
    return placed.select(*keys, value, "n", (F.col("__before") + F.col("__inside")).alias("before"), "total")


def value_at(value: str, place: Column) -> Column:
    """The value at a place (from 0) of the sorted group, as an aggregate over value_places."""
    return F.min(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("n")), F.col(value)))


def medians(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """keys, median: the middle value of each group, or the mean of the two in the middle."""
    last = F.col("total") - 1
    low, high = value_at(value, F.floor(last / 2)), value_at(value, F.ceil(last / 2))
    return value_places(df, keys, value).groupBy(*keys).agg(((low + high) / 2).alias(name))


def places(df: DataFrame, keys: list[str], order: list, name: str = "place") -> DataFrame:
    """df with each row's place from 1 in its group by the order, whatever the group's size: rows are dealt out by ranges of
    group and order, and a row's place is the group's rows in earlier ranges and those before it in its own. Null keys are
    a group. The order must tell rows apart, else ties are placed anyhow."""
    dealt = stage(df.repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id()), "dealt")
    sums = dealt.groupBy(*keys, "__range").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sums = sums.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__range").alias("__of"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "__range").orderBy(*order))
    met = dealt.withColumn("__inside", inside).join(sums, [F.col("__range") == F.col("__of"), *[F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]])
    return met.select(*df.columns, (F.col("__before") + F.col("__inside")).alias(name))
