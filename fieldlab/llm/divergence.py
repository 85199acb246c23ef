"""How far the sources of a language are apart in their words: a chi-square divergence of every ordered pair of sources,
and the words that set a source off most.

Terms are runs of letters and characters beyond ASCII, with A-Z in lower case. A language keeps the terms that at least
`min_docs` of its documents hold. Every source of the language, and the language as a whole, gives each kept term the
share p = 1 + floor(SCALE * (count + 1) / (N + V)), with N its count of kept terms and V their number. The divergence of
p from q is the sum of floor((p - q)^2 / q) over all kept terms, those without occurrences too. All is exact: shares in
decimals, differences in 64-bit integers (their squares stay below 1.1e18, and so does the sum over a pair).

The work is a cube of cells (block of sources, block of sources, block of terms). A slice, a source's shares in one block
of terms, is an array of places and shares; it is replicated to the cells of its block of sources, one for each other
block. A cell owns its two blocks' slices as two dense matrices and gives the partial divergences of all its pairs in
both directions; partial sums are reduced along the axis of terms. Cells are of bounded size whatever the number of
sources and terms, so a hot source or language is many cells. Counts are summed up within each task before they are
shuffled, and memory there is bounded by `HELD` distinct terms.

Null text, language and source count as ''. Groups without terms are groups; a language without kept terms (V = 0) has
pairs of value 0 and no terms; a language of one source has no pairs. Repeated rows count as often as they are there;
ties in value are ranked by the item's UTF-8 bytes. An empty table gives no rows. Only text, lang and source are read, so
other columns, of whatever names, don't matter; texts are read whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlab.llm.common import bounded_batches, stage, table

SCALE, MIN_DOCS, TOP = 1_000_000_000, 3, 200
#: Sources in a block and terms in a block, on average; distinct terms that a counting task holds before it passes them on.
SOURCE_BLOCK, TERM_BLOCK, HELD = 8, 2048, 600_000
#: In UTF-8 every byte of a character beyond ASCII is 0x80 or more.
_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
COUNTS = "lang string, source string, term binary, count long, docs long"
KEY = ["lang", "source"]


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, text (as bytes) to the counts of each term and of the documents that hold it, in parts; one row
    without a term for each group says that it is there."""
    counts: dict[tuple[str, str], Counter[bytes]] = {}
    docs: dict[tuple[str, str], Counter[bytes]] = {}
    told: set[tuple[str, str]] = set()

    def out() -> Iterator[pa.RecordBatch]:
        for group, of in counts.items():
            terms: list[bytes | None] = [] if group in told else [None]
            told.add(group)
            terms += of
            held = docs[group]
            for a in range(0, len(terms), 20_000):
                some = terms[a : a + 20_000]
                columns = [[group[0]] * len(some), [group[1]] * len(some), some, [of.get(t, 0) for t in some], [held.get(t, 0) for t in some]]
                kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "source", "term", "count", "docs"])
        counts.clear()
        docs.clear()

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            group = (lang, source)
            terms = _TERM.findall(text.lower())  # of bytes, A-Z only
            counts.setdefault(group, Counter()).update(terms)
            docs.setdefault(group, Counter()).update(set(terms))
        if sum(map(len, counts.values())) > HELD:
            yield from out()
    yield from out()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, count, docs: occurrences, and documents that hold the term; a null term for every group."""
    bounded_batches(docs.sparkSession)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    parts = docs.select(text("lang"), text("source"), text("text").cast("binary")).mapInArrow(count_terms, COUNTS)
    parts = parts.withColumn("term", F.col("term").cast("string"))
    return parts.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exactly: in 64 bits while the product fits, else in decimals."""
    base = F.greatest(total + terms, F.lit(1))
    long = F.call_function("div", F.lit(SCALE).cast("long") * (count + 1), base)
    wide = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)"), base.cast("decimal(19,0)"))
    return F.when(count < 9_000_000_000, long).otherwise(wide.cast("long")) + 1


def _block(of: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(of), blocks).cast("int")


def audited(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(groups, scored), staged. groups: lang, source, total, terms (V), blocks of sources and of terms, p0 (share of a term
    without occurrences). scored, for each kept term that a group has: lang, source, block (of terms), place in it, term, p,
    and q, the language's share."""
    counts = stage(term_counts(docs), "counts")
    known = counts.where(F.col("term").isNotNull())
    summed = known.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("all"))
    kept = stage(summed.where(F.col("docs") >= min_docs).select("lang", "term", "all"), "kept")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("all").alias("lang_total"))
    every = counts.where(F.col("term").isNull()).select(*KEY)
    many = every.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    langs = many.join(langs, "lang", "left").select(
        "lang",
        F.coalesce("terms", F.lit(0)).alias("terms"),
        F.coalesce("lang_total", F.lit(0)).alias("lang_total"),
        F.ceil(F.col("n") / SOURCE_BLOCK).cast("int").alias("source_blocks"),
        F.greatest(F.ceil(F.coalesce("terms", F.lit(0)) / TERM_BLOCK), F.lit(1)).cast("int").alias("term_blocks"),
    )
    langs = stage(langs, "langs")
    block = _block(F.col("term"), F.col("term_blocks"))
    order = F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")) - 1
    placed = kept.join(langs, "lang").withColumn("block", block).withColumn("place", order)
    placed = placed.withColumn("q", share(F.col("all"), F.col("lang_total"), F.col("terms")))
    of = stage(known.select(*KEY, "term", "count").join(placed.select("lang", "term", "block", "place", "q"), ["lang", "term"]), "counted")
    totals = of.groupBy(*KEY).agg(F.sum("count").alias("total"))
    groups = every.join(totals, KEY, "left").join(langs, "lang").withColumn("total", F.coalesce("total", F.lit(0)))
    groups = stage(groups.withColumn("p0", share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))), "groups")
    p = share(F.col("count"), F.col("total"), F.col("terms"))
    scored = of.join(groups.select(*KEY, "total", "terms"), KEY).select(*KEY, "block", "place", "term", p.alias("p"), "q")
    return groups, stage(scored, "scored")


def cell_divergences(cell: pa.Table) -> pa.Table:
    """The partial divergences of the pairs of one cell, both ways. Rows are slices: lang, source, side (0, 1 of its block
    of sources; both blocks the same: 0), width (kept terms in the block), p0, places, shares."""
    names, sides = cell["source"].to_pylist(), np.asarray(cell["side"])
    width = cell["width"][0].as_py()
    held = np.repeat(np.asarray(cell["p0"], np.int64)[:, None], width, axis=1)
    for row, places, shares in zip(held, cell["places"], cell["shares"]):
        if places.is_valid and len(places.values):
            row[places.values.to_numpy()] = shares.values.to_numpy()
    out: list[tuple[str, str, int]] = []
    first, second = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
    both_ways = cell["a"][0].as_py() != cell["b"][0].as_py()
    other = second if both_ways else first
    for i in first:
        squared = np.square(held[other] - held[i])
        from_i = (squared // held[other]).sum(axis=1)
        out += [(names[i], names[j], int(v)) for j, v in zip(other, from_i) if i != j]
        if both_ways:
            out += [(names[j], names[i], int(v)) for j, v in zip(other, (squared // held[i]).sum(axis=1))]
    lang = cell["lang"][0].as_py()
    columns = [[lang] * len(out), *([x[k] for x in out] for k in range(3))]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()))], names=["lang", "source", "item", "value"])


def pair_divergences(groups: DataFrame, scored: DataFrame) -> DataFrame:
    """lang, source, item (the other source), value of every ordered pair of a language's sources."""
    key = [*KEY, "block"]
    parts = F.sort_array(F.collect_list(F.struct("place", "p")))
    slices = scored.groupBy(*key).agg(parts.alias("parts"))
    widths = scored.select("lang", "block", "place").distinct().groupBy("lang", "block").agg(F.count(F.lit(1)).cast("int").alias("width"))
    at = _block(F.col("source"), F.col("source_blocks"))
    whole = groups.withColumns({"own": at, "block": F.explode(F.sequence(F.lit(0), F.col("term_blocks") - 1))})
    whole = whole.join(widths, ["lang", "block"], "left").join(slices, key, "left")
    dealt = whole.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("source_blocks") - 1))).select(
        *KEY, "block", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"),
        F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"),
        F.coalesce("width", F.lit(0)).alias("width"), "p0",
        F.transform("parts", lambda x: x["place"]).alias("places"), F.transform("parts", lambda x: x["p"]).alias("shares"),
    )
    partial = dealt.groupBy("lang", "a", "b", "block").applyInArrow(cell_divergences, "lang string, source string, item string, value long")
    return partial.groupBy(*KEY, "item").agg(F.sum("value").alias("value"))


def distinctive_terms(scored: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, item, value, rank of the terms whose share in a source is above the language's, the `top` first ones.
    They are cut within blocks of terms first, so that a source's terms never meet in one task."""
    gain = F.col("p") - F.col("q")
    rows = scored.where(gain > 0).select(*KEY, "block", F.col("term").alias("item"), F.call_function("div", gain * gain, F.col("q")).alias("value"))
    for within in ([*KEY, "block"], KEY):
        order = Window.partitionBy(*within).orderBy(F.col("value").desc(), "item")
        rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return rows.select(*KEY, "item", "value", "rank")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: part `pair` for all other sources of the language, part `term` for the first
    `top` terms; ranks from 1 by falling value, then by item."""
    groups, scored = audited(docs, min_docs)
    order = Window.partitionBy(*KEY).orderBy(F.col("value").desc(), "item")
    pairs = pair_divergences(groups, scored).withColumn("rank", F.row_number().over(order))
    columns = lambda df, part: df.select(*KEY, F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").unionByName(columns(distinctive_terms(scored, top), "term"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """audit of the table `documents`; nulls, ties and repeated rows as the module says."""
    return audit(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
tokens AS (
  SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (
  SELECT lang, term, count(*) AS n FROM tokens GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
langs AS (
  SELECT l.lang, count(k.term) AS v, coalesce(sum(k.n), 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN kept k ON k.lang = l.lang GROUP BY l.lang),
counted AS (
  SELECT t.lang, t.source, t.term, count(*) AS n FROM tokens t JOIN kept k ON k.lang = t.lang AND k.term = t.term GROUP BY ALL),
groups AS (
  SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + l.v) AS p,
         1 + (1000000000::HUGEINT * (k.n + 1)) // (l.total + l.v) AS q
  FROM groups g JOIN langs l ON l.lang = g.lang JOIN kept k ON k.lang = g.lang
  LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value
  FROM shares a JOIN shares b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 200
"""
