"""Canonical exact digests, in DataFrame functions only.

The canonical form of a text: lower case, every character beyond ASCII replaced by its compatibility decomposition with
case folded, combining marks in canonical order, runs of white space one space, none at the ends. Texts are grouped by
two xxhash64 values of it with different seeds (128 bits); inside a group of equal digests the canonical bytes are
compared, and a group with several byte strings is parted by a number at the end of the fingerprint. Null texts are
empty. Rows of one doc_id are ordered by a hash of their text, null doc_ids come first; repeated rows stay. An empty
table gives an empty one. Of the input only doc_id and text are read, so other columns, of whatever names, don't matter.
"""

from __future__ import annotations

import json
import unicodedata
from collections import Counter
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlab.llm.common import stage, table

#: Documents in a window's bucket are about rows / (BUCKETS_A_PARTITION x shuffle partitions); MAX_BUCKETS bounds what
#: the driver holds of them.
BUCKETS_A_PARTITION, MAX_BUCKETS, SMALL_ROWS = 4, 65_536, 100_000
#: The part of a bucket that holds the rows of no hot doc_id: after all parts of hot ones.
REST = 1 << 30
_HANGUL, _HANGUL_END = 0xAC00, 0xD7A3
#: A mark that case folding makes a letter: only after marks are in order.
_IOTA_MARK, _IOTA = "\u0345", "\u03b9"


def _fold(c: str) -> str:
    for _ in range(2):
        parts = unicodedata.normalize("NFKD", c)
        c = unicodedata.normalize("NFKD", "".join(x if x == _IOTA_MARK else x.casefold() for x in parts))
    return c


@lru_cache(maxsize=1)
def fold_pages() -> str:
    """JSON of an array of pages of 256 characters each: what a code point beyond ASCII becomes, or null."""
    pages: dict[int, list[str | None]] = {}
    for point in range(0x80, 0x110000):
        if _HANGUL <= point <= _HANGUL_END or 0xD800 <= point <= 0xDFFF:
            continue
        if (folded := _fold(chr(point))) != chr(point):
            page = pages.setdefault(point >> 8, [])
            page += [None] * ((point & 255) + 1 - len(page))
            page[point & 255] = folded
    return json.dumps([pages.get(k, []) for k in range(max(pages) + 1)], ensure_ascii=True)


@lru_cache(maxsize=1)
def mark_classes() -> tuple[str, str]:
    """A character class of all characters that canonical order may move, and JSON pages of their classes."""
    points = [p for p in range(0x80, 0x110000) if unicodedata.combining(chr(p))]
    ranges: list[list[int]] = []
    pages: dict[int, list[int | None]] = {}
    for p in points:
        if ranges and ranges[-1][1] == p - 1:
            ranges[-1][1] = p
        else:
            ranges.append([p, p])
        page = pages.setdefault(p >> 8, [])
        page += [None] * ((p & 255) + 1 - len(page))
        page[p & 255] = unicodedata.combining(chr(p))
    body = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)
    return body, json.dumps([pages.get(k, []) for k in range(max(pages) + 1)])


def _page(pages: Column, point: Column) -> Column:
    return F.get(F.get(pages, F.shiftright(point, 8)), point.bitwiseAND(255))


def _decomposed(text: Column) -> Column:
    pages = F.from_json(F.lit(fold_pages()), "array<array<string>>")
    lead = F.array(*[F.lit(chr(0x1100 + k)) for k in range(19)])
    vowel = F.array(*[F.lit(chr(0x1161 + k)) for k in range(21)])
    tail = F.array(F.lit(""), *[F.lit(chr(0x11A8 + k)) for k in range(27)])

    def one(part: Column) -> Column:
        point = F.ascii(part)
        s = point - _HANGUL
        hangul = F.concat(
            F.get(lead, (s / 588).cast("int")), F.get(vowel, (s % 588 / 28).cast("int")), F.get(tail, s % 28)
        )
        return (
            F.when(part < "\x80", part)
            .when(point.between(_HANGUL, _HANGUL_END), hangul)
            .otherwise(F.coalesce(_page(pages, point), part))
        )

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("[\\x00-\\x7f]+|[^\\x00-\\x7f]"), F.lit(0)), one), "")


def _ordered(text: Column) -> Column:
    """Marks after a starter sorted by class, marks of one class as they were."""
    body, classes = mark_classes()
    pages = F.from_json(F.lit(classes), "array<array<int>>")

    def sort(cluster: Column) -> Column:
        keyed = F.transform(
            F.split(cluster, ""), lambda c, k: F.struct(F.coalesce(_page(pages, F.ascii(c)), F.lit(0)).alias("class"), k.alias("at"), c.alias("c"))
        )
        return F.when(F.length(cluster) < 2, cluster).otherwise(F.array_join(F.transform(F.array_sort(keyed), lambda x: x["c"]), ""))

    parts = F.regexp_extract_all(text, F.lit(f"[^{body}][{body}]*|[{body}]+"), F.lit(0))
    # no mark lies below x300: that is asked first, for most characters need not be looked up in hundreds of ranges
    two = f"[\\x{{300}}-\\x{{10ffff}}&&[{body}]]{{2}}"
    return F.when(text.rlike(two), F.array_join(F.transform(parts, sort), "")).otherwise(text)


def canonical(text: Column) -> Column:
    """The canonical form of a non-null text. Plain ASCII takes only the last two steps."""
    low = F.lower(text)
    folded = F.when(low.rlike("[^\\x00-\\x7f]"), F.translate(_ordered(_decomposed(low)), _IOTA_MARK, _IOTA)).otherwise(low)
    return F.trim(F.regexp_replace(folded, "[\\s\\x{85}\\p{Z}]+", " "))


def digests(form: Column) -> tuple[Column, Column]:
    return F.xxhash64(form), F.xxhash64(F.lit("wide"), form)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def collisions(docs: DataFrame) -> DataFrame:
    """high, low, sha, variant of canonical texts that share their digest with a different one: no rows, in practice.

    Copies of a text meet first within each task and then by digest, so that a group of any size is a set of one byte
    string by the time it is shuffled."""
    form = canonical(F.col("text"))
    forms = _texts(docs).select(form.alias("form"))
    high, low = digests(F.col("form"))
    sets = forms.groupBy(high.alias("high"), low.alias("low")).agg(F.collect_set("form").alias("forms"))
    return (
        sets.where(F.size("forms") > 1)
        .select("high", "low", F.posexplode(F.array_sort("forms")).alias("variant", "form"))
        .select("high", "low", F.sha2("form", 256).alias("sha"), "variant")
    )


def _variants(rows: DataFrame, found: DataFrame, n: int, high: str, low: str, sha: str, name: str) -> DataFrame:
    if not n:
        return rows.withColumn(name, F.lit(0))
    side = found.select(F.col("high").alias("__h"), F.col("low").alias("__l"), F.col("sha").alias("__s"), F.col("variant").alias(name))
    side = F.broadcast(side) if n <= SMALL_ROWS else side
    on = (F.col(high) == F.col("__h")) & (F.col(low) == F.col("__l")) & (F.col(sha) == F.col("__s"))
    return rows.join(side, on, "left").drop("__h", "__l", "__s").withColumn(name, F.coalesce(name, F.lit(0)))


def _printed(high: str, low: str, variant: str) -> Column:
    wide = F.lower(F.concat(F.lpad(F.hex(F.col(high)), 16, "0"), F.lpad(F.hex(F.col(low)), 16, "0")))
    return F.when(F.col(variant) > 0, F.concat(wide, F.lit("-"), F.col(variant).cast("string"))).otherwise(wide)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every row of docs."""
    found = stage(collisions(docs), "collisions")
    form = canonical(F.col("text"))
    rows = _texts(docs).select("doc_id", form.alias("form"))
    high, low = digests(F.col("form"))
    rows = rows.select("doc_id", high.alias("high"), low.alias("low"), F.sha2("form", 256).alias("sha"))
    rows = _variants(rows, found, found.count(), "high", "low", "sha", "variant")
    return rows.select("doc_id", _printed("high", "low", "variant").alias("fingerprint"))


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, group_id, copies: rows of equal canonical text have the smallest doc_id of them as group_id. The groups
    are summed up before they are joined, and the join is on a key that AQE may split."""
    rows = stage(fingerprints(docs), "fingerprints")
    groups = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("copies"))
    return rows.join(groups, "fingerprint").select("doc_id", "group_id", "copies")


def _bucket(bounds: list[int]) -> Column:
    """How many bounds are at or below doc_id, by a coarse and a fine look-up."""
    if not bounds:
        return F.lit(0)
    width = max(1, int(len(bounds) ** 0.5))
    coarse = F.array(*[F.lit(x) for x in bounds[width - 1 :: width]])
    fine = F.array(*[F.array(*[F.lit(x) for x in bounds[k : k + width]]) for k in range(0, len(bounds), width)])
    below = lambda xs: F.size(F.filter(xs, lambda x: x <= F.col("doc_id")))
    at = below(coarse)
    rest = F.coalesce(F.get(fine, at), F.array().cast("array<bigint>"))
    return F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(at * width + below(rest))


def _part(hot: dict[int | None, int]) -> Column:
    """Parts of a hot doc_id's rows by ranges of their texts' hashes, in the order of the rows; REST for other rows. A
    hot doc_id is the lowest of its bucket, so its parts come before the rest."""
    shares = [F.lit(x) for v, k in hot.items() if v is not None for x in (v, k)]
    known = F.element_at(F.create_map(*shares), F.col("doc_id")) if shares else F.lit(None).cast("int")
    parts = F.when(F.col("doc_id").isNull(), F.lit(hot.get(None, 1))).otherwise(known)
    place = F.floor((F.col("raw") / float(1 << 64) + 0.5) * parts)
    return F.when(parts.isNull(), REST).otherwise(F.least(place, parts - 1)).cast("int")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Of every document its fingerprint and that of an edited text, whose last quarter is the start of the next document
    by doc_id (after the last: the first).

    Texts are shuffled once, into buckets of neighbouring doc_ids (bounds by approximate quantiles); a doc_id that fills
    several quantiles, or null, is dealt out further by hash. A bucket's last row takes the first row of the next bucket
    that has rows. The forms are computed here and for `collisions` anew: a stored second copy of all texts costs more."""
    spark = docs.sparkSession
    found = stage(collisions(docs), "collisions")
    n_found = found.count()
    texts = _texts(docs)
    n = min(MAX_BUCKETS, BUCKETS_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], 8 * n)
    found_cuts = texts.agg(spread.alias("cuts"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    cuts = Counter(found_cuts.cuts or [])
    hot = {v: k for v, k in cuts.items() if k > 2} | {None: max(1, n * found_cuts.nulls // max(1, found_cuts.rows))}
    form = canonical(F.col("text"))
    high, low = digests(F.col("form"))
    rows = texts.withColumns({"n_chars": F.length("text").cast("long"), "raw": F.xxhash64("text")})
    rows = rows.withColumns({"bucket": _bucket(sorted(cuts)), "part": _part(hot)})
    order = ["doc_id", "raw"]
    heads = rows.groupBy("bucket", "part").agg(F.min(F.struct(*order)).alias("head")).collect()  # a row for each bucket
    heads = sorted((r.bucket, r.part, r["head"].doc_id, r["head"].raw) for r in heads)
    serves = [(*heads[k - 1][:2], *heads[k][2:]) for k in range(len(heads))]
    side = spark.createDataFrame(serves, "s_bucket int, s_part int, h_doc long, h_raw long")
    head_texts = (
        texts.withColumn("raw", F.xxhash64("text"))
        .join(F.broadcast(side), (F.col("raw") == F.col("h_raw")) & F.col("doc_id").eqNullSafe(F.col("h_doc")))
        .dropDuplicates(["s_bucket", "s_part"])
        .select("s_bucket", "s_part", F.col("text").alias("head_text"))
    )
    keyed = rows.withColumn("form", form).select(*order, "n_chars", "bucket", "part", "text", high.alias("high"), low.alias("low"), F.sha2("form", 256).alias("sha"))
    within = Window.partitionBy("bucket", "part").orderBy(*order)
    led = keyed.withColumn("next", F.lead(F.struct("text", "high", "low")).over(within))
    last = (F.col("bucket") == F.col("s_bucket")) & (F.col("part") == F.col("s_part")) & F.col("next").isNull()
    ends = led.join(head_texts, last, "left")
    next_text = F.coalesce(F.col("next.text"), F.col("head_text"))
    cut = (F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - cast(n_chars / 4 as int) as int))"), F.substring(next_text, F.lit(1), cut))
    made = ends.withColumns({"next_text": next_text, "edited": edited}).withColumn("edited_form", canonical(F.col("edited")))
    e_high, e_low = digests(F.col("edited_form"))
    n_high, n_low = digests(canonical(F.col("head_text")))
    made = made.select(
        "doc_id", "n_chars", "text", "next_text", "edited_form", "high", "low", "sha",
        F.sha2("edited", 256).alias("edited_sha256"),
        e_high.alias("e_high"), e_low.alias("e_low"), F.sha2("edited_form", 256).alias("e_sha"),
        F.when(F.col("next").isNull(), n_high).otherwise(F.col("next.high")).alias("n_high"),
        F.when(F.col("next").isNull(), n_low).otherwise(F.col("next.low")).alias("n_low"),
    )

    def same(other_high: str, other_low: str, other_form: Column) -> Column:
        equal = (F.col("high") == F.col(other_high)) & (F.col("low") == F.col(other_low))
        return F.when(equal, (form == other_form).cast("double")).otherwise(F.lit(0.0))

    made = made.withColumns(
        {"near_edited": same("e_high", "e_low", F.col("edited_form")), "near_next": same("n_high", "n_low", canonical(F.col("next_text")))}
    ).drop("text", "next_text", "edited_form")
    made = _variants(made, found, n_found, "high", "low", "sha", "variant")
    made = _variants(made, found, n_found, "e_high", "e_low", "e_sha", "e_variant")
    return made.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        _printed("high", "low", "variant").alias("fingerprint"),
        _printed("e_high", "e_low", "e_variant").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op5_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edited_fingerprints of the table `documents`."""
    return edited_fingerprints(table(spark, sf_dir, "documents"))
