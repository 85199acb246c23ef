"""Similarity of two strings: kernels that Spark lacks as Arrow UDFs, and token measures as expressions. All are 0 to 1; two
empty strings are alike, an empty and a full one are not, a null on either side gives null."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from fieldlab.functions import kernels as k


def _each(one):
    """A kernel over the pairs of a batch that have both strings; the others are null."""

    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        there = (left.notna() & right.notna()).to_numpy()
        out = np.full(len(left), np.nan)
        if there.any():
            out[there] = one(left[there].tolist(), right[there].tolist())
        return pd.Series(out).astype(object).where(there, None).astype("Float64")

    return run


swap_similarity = F.pandas_udf(_each(lambda a, b: k.shares(k.swap_distances(a, b), a, b)), DoubleType())
keyboard_similarity = F.pandas_udf(_each(lambda a, b: k.shares(k.keyboard_distances(a, b), a, b)), DoubleType())
sequence_ratio = F.pandas_udf(_each(k.ratios), DoubleType())


def register(spark: SparkSession) -> None:
    """The kernels for SQL: swap_similarity, keyboard_similarity, sequence_ratio."""
    for name, kernel in (("swap_similarity", swap_similarity), ("keyboard_similarity", keyboard_similarity), ("sequence_ratio", sequence_ratio)):
        spark.udf.register(name, kernel)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), " "), lambda w: w != "")


def edit_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a.isNotNull() & b.isNotNull(), F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest))


def token_jaccard(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    both = F.size(F.array_union(x, y))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / both)


def token_overlap(a: Column, b: Column) -> Column:
    """Shared words by the fewer words."""
    x, y = F.array_distinct(words(a)), F.array_distinct(words(b))
    few = F.least(F.size(x), F.size(y))
    return F.when(few == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / few)


def token_set(a: Column, b: Column) -> Column:
    return 0.45 * token_jaccard(a, b) + 0.55 * token_overlap(a, b)


def token_sort(a: Column, b: Column) -> Column:
    """Edit similarity of the words in order."""
    tidy = lambda t: F.array_join(F.array_sort(words(t)), " ")
    return edit_similarity(tidy(a), tidy(b))


def prefix_share(a: Column, b: Column) -> Column:
    """The common beginning by the shorter length."""
    n = F.least(F.length(a), F.length(b))
    same = F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))
    return F.when(n == 0, 0.0).otherwise(same / n)


def initials_match(a: Column, b: Column) -> Column:
    first = lambda t: F.array_join(F.transform(words(t), lambda w: F.substring(w, 1, 1)), "")
    return (first(a) == first(b)).cast("double")


def length_share(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(F.least(F.length(a), F.length(b)) / longest)


def blended(a: Column, b: Column, ratio: Column) -> Column:
    return F.greatest(ratio, 0.68 * ratio + 0.25 * token_jaccard(a, b) + 0.07 * prefix_share(a, b))
