"""What the operators share: tables, staged tables in the shared folder, and text columns computed in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from fieldlab.sources.shared import shared_dir, stage, with_position
from fieldlab.sources.tables import table

__all__ = ["bounded_batches", "filter_by_text", "shared_dir", "stage", "steps", "table", "with_position", "with_text_columns"]

#: Rows and text bytes that one Python step holds at a time; a single longer text makes a step of its own.
BATCH_ROWS, STEP_CHARS = 1000, 4_000_000


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches small enough, in rows and in bytes, that long texts fit a Python worker; smaller settings of the
    session stay."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(rows, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)
    if spark.conf.get(size, "64m") in ("64m", "67108864b", "67108864"):
        spark.conf.set(size, "16m")


def steps(texts: Sequence[str], limit: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` characters at most, one text at least."""
    start = held = 0
    for k, text in enumerate(texts):
        if k > start and held + len(text) > limit:
            yield start, k
            start, held = k, 0
        held += len(text)
    if start < len(texts):
        yield start, len(texts)


def with_text_columns(
    docs: DataFrame,
    fields: Sequence[StructField],
    compute: Callable[[list[str]], dict[str, object]],
    keep: Sequence[str] | None = None,
    text: str = "text",
) -> DataFrame:
    """docs with columns that compute(texts) gives for the text column, no shuffle.

    A null text reaches compute as "". Rows stay as many and as they are, repeated ones too; an empty table gives an
    empty one. `keep` names the columns that stay (default all); a kept column whose name, in any case, is one of
    `fields` gives way to the new one."""
    new = {f.name.lower() for f in fields}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    schema = StructType([docs.schema[c] for c in kept] + list(fields))
    types = [to_arrow_type(f.dataType) for f in fields]
    read = "text_" + "_" * max((len(c) for c in kept), default=0)  # longer than any name that is kept
    needed = [F.col(f"`{c}`") for c in kept] + [F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias(read)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            lengths = texts.to_pylist()
            for a, b in steps(lengths):
                got = compute(lengths[a:b])
                columns = [batch.column(k).slice(a, b - a) for k in range(len(kept))]
                columns += [pa.array(got[f.name], type=t) for f, t in zip(fields, types)]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *(f.name for f in fields)])

    bounded_batches(docs.sparkSession)
    return docs.select(*needed).mapInArrow(run, schema)


def filter_by_text(docs: DataFrame, accept: Callable[[list[str]], object], text: str = "text") -> DataFrame:
    """The rows of docs whose text accept(texts) is true for, with all their columns; no shuffle, repeated rows stay."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(at).to_pylist()]
            for a, b in steps(texts):
                yield batch.slice(a, b - a).filter(pa.array(accept(texts[a:b]), pa.bool_()))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
