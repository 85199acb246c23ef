"""Mixing sources to target weights, in DataFrame functions only.

Targets: sources in code-point order, null last, have weights in turn and share the budget by weight; a source stops at
a multiple of its size, and what it can't take goes to the others by weight until none is above.

Filling: every document has a hash. A source takes whole rounds of all its documents, then those below a threshold of
the hash. The threshold comes from nested histograms: words by source and hash bucket; the bucket in which the budget
runs out is the boundary, and only its documents are summed again by the next bits of the hash, until all bits are
used. No document is sorted, and a hot source is summed in each task first. The document at the threshold gives the
words that are left; rows that are equal in doc_id and text share the threshold and what is left there evenly.

Sizes are words of `[^\\x20\\x09-\\x0D]+`; a null text has none. An empty table gives an empty one. `mix_sizes` reads
doc_id, source and text only; `mix_documents` carries all columns of the input in one struct, so no name clashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlab.llm.common import stage, table, with_position

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS, SHARE, STOP = (3, 1, 2), 1.5, 2
HASH_BITS, STEP_BITS, SMALL_ROWS = 60, 10, 100_000


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _hash(doc_id: Column, text: Column) -> Column:
    both = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(both), 1, HASH_BITS // 4), 16, 10).cast("long")


def _key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, stop: int = STOP) -> DataFrame:
    """sizes (source, source_size), staged, with weight and target. A few sums over the sources for each round of
    sharing reach the driver."""
    placed = stage(
        with_position(sizes, [F.col("source").asc_nulls_last()], "place").withColumn(
            "weight", F.get(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights)).cast("int"))
        ),
        "weights",
    )
    cap = F.col("source_size") * (2 * stop)  # in half words, so that sums are whole numbers
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    budget, level = round(2 * share * total), -1.0
    while True:
        full = cap / F.col("weight") < F.lit(level)
        capped, open_ = placed.agg(F.sum(F.when(full, cap).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        left, open_ = budget - (capped or 0), open_ or 1
        if left / open_ <= level:
            break
        level = left / open_
    even = F.col("weight") * F.lit(float(left)) / F.lit(float(2 * open_))
    return placed.select(
        "source", "source_size", "weight", F.when(full, F.col("source_size") * float(stop)).otherwise(even).alias("target")
    )


def _few(df: DataFrame, n: int) -> DataFrame:
    """Sent to all tasks only where it is known to be small."""
    return F.broadcast(df) if n <= SMALL_ROWS else df


def thresholds(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, stop: int = STOP) -> tuple[DataFrame, DataFrame]:
    """(rows, limits). rows: doc_id, source, key, size, hash of every document. limits, a row for each source: key,
    source_size, target, rounds (of all its documents), bound and what is left for documents with the hash `bound`."""
    rows = stage(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").alias("source"),
            _key(F.col("source")).alias("key"),
            words(F.col("text")).alias("size"),
            _hash(F.col("doc_id"), F.col("text")).alias("hash"),
        ),
        "sizes",
    )
    held = {"shift": HASH_BITS - STEP_BITS}

    def histogram(of: DataFrame) -> DataFrame:
        cell = F.shiftright("hash", held["shift"])
        return of.groupBy("key", cell.alias("cell")).agg(F.sum("size").alias("size"), F.first("source").alias("source"))

    first = stage(histogram(rows), "cells")
    sizes = stage(first.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size")), "sources")
    n = sizes.count()
    targets = source_targets(sizes.select("source", "source_size"), weights, share, stop).withColumn("key", _key(F.col("source")))
    rounds = F.when(F.col("source_size") == 0, 0).otherwise(F.floor(F.col("target") / F.greatest("source_size", F.lit(1))))
    goal = stage(
        targets.withColumn("rounds", rounds.cast("long"))
        .withColumn("rest", F.floor(F.col("target") - F.col("rounds") * F.col("source_size")).cast("long"))
        .select("key", "source_size", "target", "rounds", "rest"),
        "goals",
    )
    state, cells, inside = goal.select("key", "rest"), first, rows
    while True:
        upto = F.sum("size").over(Window.partitionBy("key").orderBy("cell"))
        state = stage(
            cells.withColumn("upto", upto)
            .join(_few(state.select("key", "rest"), n), "key")
            .where((F.col("upto") - F.col("size") <= F.col("rest")) & (F.col("rest") < F.col("upto")))
            .select("key", "cell", (F.col("rest") - F.col("upto") + F.col("size")).alias("rest"), F.col("size").alias("cell_size")),
            "boundary",
        )
        if held["shift"] == 0:
            break
        at = F.shiftright("hash", held["shift"])
        bounds = state.select(F.col("key"), F.col("cell").alias("edge"))
        inside = stage(inside.join(_few(bounds, n), "key").where(at == F.col("edge")).drop("edge"), "inside")
        held["shift"] -= STEP_BITS
        cells = histogram(inside)
    bound = state.select("key", F.col("cell").alias("bound"), F.col("rest").alias("left"), "cell_size")
    limits = stage(goal.drop("rest").join(_few(bound, n), "key", "left"), "limits")
    return rows, _few(limits, n)


def _taken() -> Column:
    """Words taken of a document. A source whose budget no bucket bounds has none for a further round."""
    left = F.expr("(size * left) div cell_size")
    extra = (
        F.when(F.col("bound").isNull(), 0)
        .when(F.col("hash") < F.col("bound"), F.col("size"))
        .when(F.col("hash") == F.col("bound"), left)
        .otherwise(0)
    )
    return (F.col("rounds") * F.col("size") + extra).cast("long")


def mix_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes, repeats counted) of every document."""
    rows, limits = thresholds(docs)
    return rows.join(limits, "key").select("doc_id", "size", "source_size", "target", _taken().alias("taken"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mix itself: docs as often as whole rounds take them, and the document at a source's threshold once more with
    the words that are left of it, in its own spacing. Columns are those of docs (a number `n_chars` follows the text);
    documents without words are not in the mix."""
    _, limits = thresholds(docs)
    hidden = {"size": words(F.col("text")), "hash": _hash(F.col("doc_id"), F.col("text")), "key": _key(F.col("source"))}
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    rows = docs.select(row, *[v.alias(k) for k, v in hidden.items()])
    taken = rows.join(limits, "key").withColumn("taken", _taken()).where(F.col("taken") > 0)
    copies = F.floor(F.col("taken") / F.col("size"))
    part = F.col("taken") - copies * F.col("size")
    whole = F.array_repeat(F.lit(0).cast("bigint"), copies.cast("int"))
    each = taken.withColumn("cut", F.explode(F.when(part > 0, F.array_append(whole, part)).otherwise(whole)))
    kept = F.array_join(F.slice(F.regexp_extract_all(F.col("__row.text"), F.lit("[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+"), 0), F.lit(1), F.col("cut").cast("int")), "")
    text = F.when(F.col("cut") > 0, kept).otherwise(F.col("__row.text"))
    out = [text.alias(c) if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in docs.columns]
    mixed = each.select(*out)
    if "n_chars" in docs.columns:
        mixed = mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return mixed


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix_sizes of the table `documents`."""
    return mix_sizes(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS hash
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM sources),
levels AS (
  SELECT *, source_size * 4 / weight::DOUBLE AS ratio,
         (SELECT 3 * sum(source_size)::BIGINT FROM weighted) AS budget,
         coalesce(sum(source_size * 4) OVER (ORDER BY source_size * 4 / weight::DOUBLE, source NULLS LAST
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
         sum(weight) OVER (ORDER BY source_size * 4 / weight::DOUBLE, source NULLS LAST
                  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS open
  FROM weighted),
level AS (
  SELECT arg_min(budget - before, ratio) AS rest, arg_min(open, ratio) AS open
  FROM levels WHERE ratio >= (budget - before) / open::DOUBLE),
targets AS (
  SELECT w.source, w.source_size,
         CASE WHEN w.source_size * 4 / w.weight::DOUBLE < l.rest / l.open::DOUBLE THEN w.source_size * 2.0::DOUBLE
              ELSE w.weight * l.rest::DOUBLE / (2 * l.open)::DOUBLE END AS target
  FROM weighted w, level l),
goals AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / greatest(source_size, 1)) END::BIGINT AS rounds FROM targets),
cumulated AS (
  SELECT s.doc_id, s.size, s.hash, g.source_size, g.target, g.rounds,
         floor(g.target - g.rounds * g.source_size)::BIGINT AS rest,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.hash)::BIGINT AS upto,
         sum(s.size) OVER (PARTITION BY s.source, s.hash)::BIGINT AS tied
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (rounds * size + CASE WHEN upto <= rest THEN size
                             WHEN upto - tied <= rest THEN size * (rest - upto + tied) // tied
                             ELSE 0 END)::BIGINT AS taken
FROM cumulated
"""
