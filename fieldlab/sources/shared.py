"""Tables staged in the folder that driver and executors share, and positions in a total order."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a folder of this machine only where none is named and all
    of Spark runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that the cluster shares")
        named = os.path.join(tempfile.gettempdir(), "checkpoints", uuid.uuid4().hex)
        spark.sparkContext.setCheckpointDir(named)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return named


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: later readers neither recompute it nor depend on
    an executor's disk. The folder is the caller's to clear after the job."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/fieldlab-{uuid.uuid4().hex}/{name}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a counted table that a task holds, about.
ROWS = 100_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df by keys over so many tasks that one of them holds about ROWS of `rows` rows, whatever the session's number of
    partitions; df as it is where that number will do."""
    parts = _parts(df.sparkSession, rows)
    return df if parts is None else df.repartition(parts, *keys)


def _parts(spark: SparkSession, rows: int) -> int | None:
    parts = -(-rows // ROWS)
    return parts if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def with_position(df: DataFrame, order: Sequence, name: str, rows: int = 0) -> DataFrame:
    """df with its rows' positions from 0 in the given order, without bringing all rows into one task: rows are dealt
    out by ranges, staged, and numbered within a range; the driver sees one count for each range. `rows`, where the caller has counted them, gives as
    many ranges as `dealt` gives tasks."""
    spark = df.sparkSession
    parts = _parts(spark, rows)
    ranged = df.repartitionByRange(*order) if parts is None else df.repartitionByRange(parts, *order)
    ranges = stage(ranged.withColumn("__range", F.spark_partition_id()), "ranges")
    counts = sorted((r["__range"], r["n"]) for r in ranges.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    offsets = F.broadcast(spark.createDataFrame(starts, "__range int, __start long"))  # a row for each range
    number = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return dealt(ranges, rows, "__range").join(offsets, "__range").withColumn(name, F.col("__start") + number).drop("__range", "__start")
