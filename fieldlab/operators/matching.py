"""Matching of what is said to names: candidate pairs by rare trigrams, a fuzzy score in thirteen parts, and decisions.

Null and empty texts meet no name. Ties of a score go to the first name. Repeated rows count once."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from fieldlab.functions import kernels as k

#: Share of the longer text that edits may change; letters of a gram; names of a gram that stay in one part.
EDITS, GRAM, HOT = 0.3, 3, 4096

# Weights of the thirteen parts, thresholds and guards of the score.
WEIGHTS = {
    "sequence": 0.14, "token_sort": 0.07, "token_set": 0.06, "partial": 0.05, "edit": 0.12, "damerau": 0.14, "phonetic": 0.07, "keyboard": 0.08, "prefix": 0.04, "initials": 0.02, "length": 0.04, "coverage": 0.08, "token_alignment": 0.09,
}
#: Bonuses: the parts that must reach a least value each, and what they add.
BONUSES = (({"phonetic": 0.92, "edit": 0.70}, 0.02), ({"keyboard": 0.90, "damerau": 0.72}, 0.025), ({"prefix": 0.90, "edit": 0.72}, 0.015))
SAME_WORDS = ({"coverage": 0.88, "token_alignment": 0.86}, 0.075)
ORDINARY, ORDINARY_PENALTY, SHORT_PENALTY = ("the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "with", "is", "are", "was", "what", "who", "how", "his", "her", "my", "me", "it", "he", "they", "show", "please", "compare"), 0.30, 0.18
SHORT_RISK = {1: 1.0, 2: 0.88}
SINGLE_SHORT, SINGLE, SEVERAL, THREE_SAID, THREE_NAMED, FLOOR = 0.95, 0.84, 0.72, 0.02, 0.015, 0.68


def _bucket(size: str) -> str:
    """Lengths by powers of 1.5: texts that may match, whose lengths differ by 1/0.7 at most, are in neighbouring ones."""
    return f"int(floor(ln({size}) / ln(1.5)))"


def similar_pairs(asked: DataFrame, names: DataFrame, hot: int = HOT) -> DataFrame:
    """All pairs of distinct (asked, name) whose edit distance is at most 0.3 of the longer one's length, with their score.

    Texts are cut into trigrams (the second one of a kind is another one), ordered from the rarest by their counts in both
    tables. d edits spoil 3 d trigrams at most, so two texts that match share one of the first 3 d + 1 of each; only those
    are keys: about as many as letters, for each of three buckets of partner lengths. A trigram of more than `hot` texts is
    parted by the names' hash. What meets is measured. The joins are by merging: Spark's estimates, by which it would send a
    side to all tasks, do not see how many rows an explode gives."""
    padded = "concat(repeat(chr(1), 2), text, repeat(chr(2), 2))"
    grams = F.expr(f"transform(sequence(1, length(text) + 2), i -> named_struct('at', i, 'gram', substring({padded}, i, {GRAM})))")
    one = lambda df, c, side: df.where(F.col(c) != "").select(F.col(c).alias("text")).distinct().withColumn("side", F.lit(side))
    texts = one(asked, "asked", "a").unionByName(one(names, "name", "n"))
    cut = texts.withColumn("g", F.explode(grams)).select("text", "side", "g.*")
    again = F.row_number().over(Window.partitionBy("text", "side", "gram").orderBy("at"))
    cut = cut.select("text", "side", F.concat("gram", again.cast("string")).alias("gram"))
    counted = cut.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rare = cut.join(counted.hint("merge"), "gram").groupBy("text", "side").agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("grams"))
    own, size = F.expr(_bucket("length(text)")), "length(text)"
    most = f"floor({EDITS} * least(greatest({size}, ceil(pow(1.5, other + 1))), ceil({size} / (1 - {EDITS}))))"
    keyed = (
        rare.withColumn("own", own).withColumn("other", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1))).where("other >= 0")
        .withColumn("most", F.expr(f"int({most})")).withColumn("g", F.explode(F.expr(f"slice(grams, 1, {GRAM} * most + 1)")))
        .select("text", "side", "own", "other", "most", "g.*").withColumn("parts", F.expr(f"int(ceil(n / {hot}))"))
    )
    left = keyed.where("side = 'a'").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    left = left.select(F.col("text").alias("asked"), "gram", "part", F.col("own").alias("x"), F.col("other").alias("y"))
    right = keyed.where("side = 'n'").withColumn("part", F.pmod(F.xxhash64("text"), F.col("parts")).cast("int"))
    right = right.select(F.col("text").alias("name"), "gram", "part", F.col("other").alias("x"), F.col("own").alias("y"))
    pairs = left.join(right.hint("merge"), ["gram", "part", "x", "y"]).select("asked", "name").distinct()
    longer = F.greatest(F.length("asked"), F.length("name"))
    return pairs.withColumn("d", F.levenshtein("asked", "name")).where(10 * F.col("d") <= 3 * longer).select("asked", "name", (1 - F.col("d") / longer).alias("score"))


# --- the score


def phonetic(text: str) -> str:
    """The key of `messages.phonetic_key`."""
    key = re.sub("[^a-z]", "", text.lower())
    for pattern, to in (("ph", "f"), ("ck", "k"), ("q", "k"), ("[xz]", "s")):
        key = re.sub(pattern, to, key)
    return re.sub(r"(.)\1+", r"\1", key[:1] + re.sub("[aeiouy]", "", key[1:]))


def _sounds(left: list[str], right: list[str]) -> np.ndarray:
    a, b = [phonetic(x) for x in left], [phonetic(x) for x in right]
    there = np.fromiter((bool(x and y) for x, y in zip(a, b)), bool, len(a))
    return np.where(there, k.ratios(a, b), 0.0)


def _best(left: list[str], right: list[str]) -> np.ndarray:
    """The largest of five measures of two words."""
    edits = [k.shares(d, left, right) for d in (k.keyboard_distances(left, right, 1.0), k.swap_distances(left, right), k.keyboard_distances(left, right))]
    return np.max([k.ratios(left, right), _sounds(left, right), *edits], axis=0)


def _partial(left: list[str], right: list[str]) -> np.ndarray:
    """The best ratio of the shorter text and as long a part of the longer one; parts that occur again are compared once."""
    number: dict[tuple[str, str], int] = {}
    own = []
    for a, b in zip(left, right):
        a, b = (a, b) if len(a) <= len(b) else (b, a)
        parts = {a} if a in b else {b[i : i + len(a)] for i in range(len(b) - len(a) + 1)}
        own.append([number.setdefault((a, p), len(number)) for p in parts])
    found = k.ratios([a for a, _ in number], [p for _, p in number])
    return np.array([found[x].max(initial=0) for x in own])


def measures(left: list[str], right: list[str]) -> dict[str, np.ndarray]:
    """The thirteen parts of every pair of a batch, by name."""
    x, y = [a.split() for a in left], [b.split() for b in right]
    first = lambda ws: "".join(w[0] for w in ws)
    n = np.fromiter((max(len(a), len(b), 1) for a, b in zip(x, y)), float, len(x))
    shared = [len(set(a) & set(b)) for a, b in zip(x, y)]
    sets = [0.45 * s / max(1, len(set(a) | set(b))) + 0.55 * s / max(1, min(len(set(a)), len(set(b)))) for s, a, b in zip(shared, x, y)]
    spelled = [len(b) > 1 and (first(a) == first(b) or len(a) == 1 and a[0] == first(b)) for a, b in zip(x, y)]
    coverage, alignment = k.token_measures(x, y, _best)
    return {
        "sequence": k.ratios(left, right), "token_sort": k.ratios([" ".join(sorted(a)) for a in x], [" ".join(sorted(b)) for b in y]), "token_set": np.array(sets), "partial": _partial(left, right),
        "edit": k.shares(k.keyboard_distances(left, right, 1.0), left, right), "damerau": k.shares(k.swap_distances(left, right), left, right), "phonetic": _sounds(left, right), "keyboard": k.shares(k.keyboard_distances(left, right), left, right),
        "prefix": np.array([sum(p.startswith(q) or q.startswith(p) for p, q in zip(a, b)) for a, b in zip(x, y)]) / n, "initials": np.where(spelled, 1.0, k.ratios([first(a) for a in x], [first(b) for b in y])),
        "length": np.array([min(len(a), len(b)) / max(len(a), len(b), 1) for a, b in zip(left, right)]), "coverage": coverage, "token_alignment": alignment,
    }


@F.pandas_udf(StructType([StructField(name, DoubleType()) for name in WEIGHTS]))
def _parts(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    a, b = left.fillna("").tolist(), right.fillna("").tolist()
    full = np.fromiter((bool(x.strip() and y.strip()) for x, y in zip(a, b)), bool, len(a))
    found = measures([x for x, f in zip(a, full) if f], [y for y, f in zip(b, full) if f]) if full.any() else {}
    return pd.DataFrame({name: _placed(found.get(name, np.zeros(0)), full) for name in WEIGHTS})


def _placed(values: np.ndarray, where: np.ndarray) -> np.ndarray:
    out = np.zeros(len(where))
    out[where] = values
    return out


def ordinary_risk(words: Column, ordinary: tuple[str, ...] = ORDINARY) -> Column:
    """The share of what is said that is ordinary words; 1 for nothing."""
    common = F.size(F.filter(words, lambda w: w.isin(*ordinary)))
    return F.when(F.size(words) == 0, 1.0).otherwise(common / F.size(words))


def short_risk(words: Column) -> Column:
    """How little a single short word says."""
    size = F.length(F.get(words, F.lit(0)))
    return F.when(F.size(words) == 0, 1.0).when(F.size(words) > 1, 0.0).otherwise(reduce(lambda w, r: w.when(size <= r[0], r[1]), list(SHORT_RISK.items())[1:], F.when(size <= 1, SHORT_RISK[1])).otherwise(0.0))


def fuzzy_scores(pairs: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """pairs (asked, name; lower case) with parts (a struct), composite (their weighted sum, 1 for equal texts) and score:
    with the bonuses of parts that agree, less the penalties for ordinary and short words unless the texts are equal, from 0
    to 1. Null for a null text, 0 for an empty one."""
    words = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), " "), lambda w: w != "")
    rows = pairs.withColumn("parts", _parts("asked", "name"))
    part = lambda name: F.col("parts")[name]
    equal = F.col("asked") == F.col("name")
    composite = F.when(equal & (F.col("asked") != ""), 1.0).otherwise(reduce(lambda a, b: a + b, [part(p) * w for p, w in weights.items()]))
    reached = lambda least: reduce(lambda a, b: a & b, [part(p) >= v for p, v in least.items()])
    said, named = F.size(words(F.col("asked"))), F.size(words(F.col("name")))
    bonus = reduce(lambda a, b: a + b, [F.when(reached(least), add).otherwise(0.0) for least, add in BONUSES]) + F.when((said == named) & (said >= 2) & reached(SAME_WORDS[0]), SAME_WORDS[1]).otherwise(0.0)
    penalty = F.when(equal, 0.0).otherwise(ORDINARY_PENALTY * ordinary_risk(words(F.col("asked"))) + SHORT_PENALTY * short_risk(words(F.col("asked"))))
    known = F.col("asked").isNotNull() & F.col("name").isNotNull()
    rows = rows.withColumn("composite", F.when(known, composite))
    return rows.withColumn("score", F.when(known, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("composite") + bonus - penalty))))


def threshold(asked: Column, name: Column) -> Column:
    """The least score: .95 for a word of up to three letters, .84 for one word, else .72, a little less for three words, never
    below .68."""
    words = lambda c: F.size(F.filter(F.split(c, " "), lambda w: w != ""))
    several = SEVERAL - F.when(words(asked) >= 3, THREE_SAID).otherwise(0.0) - F.when(words(name) >= 3, THREE_NAMED).otherwise(0.0)
    return F.when(words(asked) == 0, 1.0).when(words(asked) == 1, F.when(F.length(asked) <= 3, SINGLE_SHORT).otherwise(SINGLE)).otherwise(F.greatest(several, F.lit(FLOOR)))


def decide(scored: DataFrame) -> DataFrame:
    """The best name of each asked text with the margin to the next and the decision: accepted from its threshold on,
    ambiguous where the next name is as near as .02 (.05 below a score of .9), else rejected."""
    best = Window.partitionBy("asked").orderBy(F.desc("score"), "name")
    rows = scored.withColumns({"place": F.row_number().over(best), "margin": F.col("score") - F.lead("score").over(best)}).where("place = 1")
    wide = F.when(F.col("score") >= 0.9, 0.02).otherwise(0.05)
    decision = F.when(F.col("score") < threshold(F.col("asked"), F.col("name")), "rejected").when(F.coalesce(F.col("margin"), F.lit(1.0)) < wide, "ambiguous").otherwise("accepted")
    return rows.select("asked", "name", "score", "margin", decision.alias("decision"))
