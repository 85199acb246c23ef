"""Exact duplicates by a stateful stream, in DataFrame functions only.

Files of a folder are read as a stream; every text is reduced to its digest, and a streaming aggregation keeps for each
digest, in RocksDB state on disk without watermark or expiry: how many rows had it, the stable identifier of the row that
stays (the largest doc_id) and where its content lies (file and row within the file). The state's checkpoint lies in the
shared folder, so a lost executor loads it again, and a later call over the same state folder reads new files only and
meets what earlier calls saw. Texts are never shuffled by the stream, and no text lies in the state.

Hits, digests of more than one row, are checked by full bytes: in each task the texts of one digest are reduced to the
smallest and the largest, then over all tasks; where these two are the same bytes, all are. Digests that hold different
texts (none, with sha256) are parted by their texts and counted anew.

Null texts count as empty. Rows of one text and one doc_id are ordered by where they lie, so that of repeated rows one
stays; a null doc_id is below every other. A text in one row has a group of one. An empty table gives an empty one. Only
doc_id and text are read, so other columns, of whatever names, don't matter. Files must not change once they are read.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlab.llm.common import shared_dir, stage

#: Bytes of files in a micro-batch; digests of hits that are sent to all tasks at most, beyond it they are joined.
BATCH_BYTES, SMALL_ROWS = 256 << 30, 100_000
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else every small store reserves megabytes of disk
}
Step = Callable[[Column], Column]


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def unchanged(text: Column) -> Column:
    return text


@contextlib.contextmanager
def _settings(spark: SparkSession, held: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def new_state(spark: SparkSession) -> str:
    """A state folder of its own in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/fieldlab-{uuid.uuid4().hex}/seen"


def located(docs: DataFrame, digest: Step = sha256, normalise: Step = unchanged) -> DataFrame:
    """doc_id, text (normalised), digest, file and at of every row of docs, which must be read from files."""
    lies = docs.metadataColumn("_metadata")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        normalise(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"),
        lies["file_path"].alias("file"),
        lies["row_index"].alias("at"),
    ).select("doc_id", "text", digest(F.col("text")).alias("digest"), "file", "at")


def ingest(spark: SparkSession, path: str, state: str, digest: Step = sha256, normalise: Step = unchanged, batch_bytes: int = BATCH_BYTES) -> None:
    """Takes the files of the Parquet table at path that the state has not seen into the state."""
    path = path.rstrip("/")
    at = f"{path[:-1]}[{path[-1]}]"  # as a pattern it may be a file or a folder
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxBytesPerTrigger", batch_bytes).option("maxFileAge", "36500d")
    seen = located(reader.parquet(at), digest, normalise).groupBy("digest")
    kept = seen.agg(F.max(F.struct("doc_id", "file", "at")).alias("keep"), F.count(F.lit(1)).alias("rows"))
    with _settings(spark, STATE):
        query = kept.writeStream.format("noop").outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()


def groups(spark: SparkSession, state: str) -> DataFrame:
    """digest, keep (doc_id, file, at), rows of every digest in the state."""
    held = spark.read.format("statestore").load(state)
    return held.select(F.col("key.digest").alias("digest"), F.col("value.max").alias("keep"), F.col("value.count").alias("rows"))


def _where(rows: DataFrame, digests: DataFrame, n: int) -> DataFrame:
    """The rows that have one of n digests. Few digests go to all tasks, so that other texts are dropped where they are read."""
    return rows.join(F.broadcast(digests) if n <= SMALL_ROWS else digests, "digest", "left_semi")


def collisions(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Digests of found, of more than one row, whose rows hold different bytes."""
    hits = found.where(F.col("rows") > 1).select("digest")
    least, most = F.min("text"), F.max("text")
    compared = _where(rows, hits, hits.count()).groupBy("digest").agg(least.alias("least"), most.alias("most"))
    return compared.where(F.col("least") != F.col("most")).select("digest")


def deduplicate(spark: SparkSession, path: str, state: str | None = None, digest: Step = sha256, normalise: Step = unchanged, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of the Parquet table at path. With a state of earlier
    calls, over other files, keep_id and group_size are those of all files, and a row that gives way to one of another
    file is not kept. That needs all files to lie below path, or digests that do not collide."""
    state = state or new_state(spark)
    ingest(spark, path, state, digest, normalise, batch_bytes)
    found = stage(groups(spark, state), "groups")
    rows = located(spark.read.parquet(path), digest, normalise)
    bad = stage(collisions(rows, found), "collisions")
    sha = (F.col("digest") if digest is sha256 else sha256(F.col("text"))).alias("sha")
    where = ["doc_id", "file", "at"]
    if not (n := bad.count()):
        joined = rows.select(*where, "digest", sha).join(found, "digest")
    else:
        clean = rows.select(*where, "digest", sha).join(F.broadcast(bad) if n <= SMALL_ROWS else bad, "digest", "left_anti")
        mixed = _where(rows, bad, n)
        parted = mixed.groupBy("digest", "text").agg(F.max(F.struct(*where)).alias("keep"), F.count(F.lit(1)).alias("rows"))
        joined = clean.join(found, "digest").unionByName(mixed.join(parted, ["digest", "text"]).select(*where, "digest", sha, "keep", "rows"))
    kept = (F.col("file") == F.col("keep.file")) & (F.col("at") == F.col("keep.at"))
    return joined.select("doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("rows").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"))


def op11_stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deduplicate over the table `documents` with a state of its own: a row for every row of the table, nulls, ties and
    repeated rows as the module says."""
    return deduplicate(spark, f"{sf_dir}/documents.parquet")


OP11_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
