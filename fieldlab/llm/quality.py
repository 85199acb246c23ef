"""Quality classifier: Bradley-Terry pairwise ranking.

Preference pairs join a document labelled 1 with one labelled 0. The score of a text is a weighted sum of its features,
and the weights make the logistic loss of the pairs' feature differences least (Newton steps with a small ridge). The
threshold is a quantile of the scores of the labelled texts, at the share of zeros among them; scores are mapped to
0..1 so that the threshold meets `CUT`.

Every learnable labelled document is learned from. They are dealt into blocks of about BLOCK documents; a block's pairs
are its own, each of the larger side in every round, and of a side too few for all blocks a document is in several. Tasks add
up a block's part of a Newton step, so one small matrix for each block reaches the driver. Everything else covers all rows. Null and empty texts have features of zero and a score
like any other. Without labels of both kinds, every text has the score 0.5. Equal texts have equal scores, repeated rows
stay, an empty table gives an empty one; of several labels of a document the smallest one is learned, and a kept column
that has the name of a new one gives way.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField

from fieldlab.llm.common import bounded_batches, stage, table, with_text_columns
from fieldlab.operators.ranks import value_at, value_places

BLOCK, PAIR_ROUNDS, RIDGE, CUT, FOLDS, SEED = 20_000, 8, 1e-3, 0.3, 5, 17
#: Documents of the smaller side that a block should have at least; labels that are sent to all tasks at most.
FEW, SENT = 64, 1_000_000
NAMES = (
    "upper", "digit", "space", "full_stop", "shout", "bar", "sign", "other", "repeat", "distinct", "word_chars",
    "line_repeat", "long_word", "log_words",
)
_UPPER, _LOWER, _DIGIT, _SPACE, _STOP, _SHOUT, _BAR, _SIGN, _OTHER = range(9)


def _classes() -> np.ndarray:
    out = np.full(256, _OTHER, np.uint8)
    out[128:] = _LOWER
    for first, last, kind in (("A", "Z", _UPPER), ("a", "z", _LOWER), ("0", "9", _DIGIT)):
        out[ord(first) : ord(last) + 1] = kind
    for signs, kind in ((" \t\r\n", _SPACE), (".,", _STOP), ("!?", _SHOUT), ("|", _BAR), ("#$%&*@^~_=+<>{}[]\\/", _SIGN)):
        out[[ord(c) for c in signs]] = kind
    return out


_CLASS = _classes()


def features(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    out = np.zeros(len(NAMES))
    if not len(data):
        return out
    share = np.bincount(_CLASS[data], minlength=9) / len(data)
    words = text.split()
    n = max(1, len(words))
    lines = [x for x in text.split("\n") if x]
    out[:8] = share[[_UPPER, _DIGIT, _SPACE, _STOP, _SHOUT, _BAR, _SIGN, _OTHER]]
    out[8] = sum(map(str.__eq__, words[1:], words)) / n
    out[9] = len(set(words)) / n**0.85
    out[10] = np.log1p(len(data) / n)
    out[11] = 1 - len(set(lines)) / max(1, len(lines))
    out[12] = max(map(len, words), default=0) > 40
    out[13] = np.log1p(n)
    return out


@dataclass(frozen=True)
class Ranking:
    """Weights of standardised features, and the raw score that the cut stands for."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    threshold: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ np.asarray(self.weights)

    def score(self, x: np.ndarray) -> np.ndarray:
        shift = np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.threshold + shift, -40, 40)))


def fit_ranking(x: DataFrame | np.ndarray, y: np.ndarray, rounds: int = PAIR_ROUNDS, seed: int = SEED) -> Ranking | None:
    """The ranking of labelled feature rows (arrays, or what `labelled_features` gives); None without labels of both kinds."""
    n_bad, n_good = y if isinstance(x, DataFrame) else (int((y == 0).sum()), int((y == 1).sum()))
    if not n_good or not n_bad:
        return None
    if isinstance(x, DataFrame):
        over, cut_of = (lambda work: _sum_over(x, work)), (lambda raw, q: _quantile_over(x, raw, q))
    else:
        sides = [np.hstack((x[y == k], np.ones((int((y == k).sum()), 1)))) for k in (1, 0)]
        over, cut_of = (lambda work: work(0, *sides)), (lambda raw, q: float(np.quantile(raw(np.vstack(sides)[:, :-1]), q)))
    n = n_good + n_bad
    own = lambda *sides: np.vstack([side[side[:, -1] == 1, :-1] for side in sides])
    mean = over(lambda _, *sides: own(*sides).sum(axis=0)) / n
    scale = np.sqrt(over(lambda _, *sides: ((own(*sides) - mean) ** 2).sum(axis=0)) / n)
    scale[scale < 1e-9] = 1
    w = np.zeros(len(mean))

    def part(block: int, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
        """Pairs, slope and curve of a block's pairs, in a row."""
        most = max(len(good), len(bad)) if len(good) and len(bad) else 0
        rng = np.random.default_rng(seed + block)
        deal = lambda z: z[np.concatenate([rng.permutation(np.resize(np.arange(len(z)), most)) for _ in range(rounds)])]
        diff = deal((good[:, :-1] - mean) / scale) - deal((bad[:, :-1] - mean) / scale)
        p = 1 / (1 + np.exp(np.clip(diff @ w, -40, 40)))  # chance that the pair is ranked the other way
        return np.concatenate(([len(diff)], diff.T @ p, ((diff.T * (p * (1 - p))) @ diff).ravel()))

    for _ in range(30):
        pairs, *sums = over(part)
        slope = np.array(sums[: len(w)]) / pairs - RIDGE * w
        curve = np.array(sums[len(w) :]).reshape(len(w), -1) / pairs + RIDGE * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w + step
        if np.abs(step).max() < 1e-7:
            break
    cut = cut_of(lambda rows: ((rows - mean) / scale) @ w, n_bad / n)
    return Ranking(tuple(mean), tuple(scale), tuple(w), cut)


def _blocks_of(batches):
    """block, good, bad (rows of features and whether it is a document's own block) of every row of blocks."""
    for batch in batches:
        for block, *sides in zip(*(c.to_pylist() for c in batch.columns)):
            yield block, *[np.frombuffer(side).reshape(-1, len(NAMES) + 1) for side in sides]


def _sum_over(blocks: DataFrame, work) -> np.ndarray:
    """The sum of work(block, good, bad) in the order of blocks; the driver gets one small array for each."""

    def run(batches):
        for block, *sides in _blocks_of(batches):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([work(block, *sides).tolist()], pa.list_(pa.float64()))], names=["block", "total"])

    found = sorted(blocks.mapInArrow(run, "block int, total array<double>").collect(), key=lambda r: r.block)
    return np.sum([r.total for r in found], axis=0)


def _quantile_over(blocks: DataFrame, raw, share: float) -> float:
    """The quantile of raw(features) of all labelled documents, between two scores in proportion."""

    def run(batches):
        for _, *sides in _blocks_of(batches):
            rows = np.vstack([side[side[:, -1] == 1, :-1] for side in sides])
            yield pa.RecordBatch.from_arrays([pa.array(raw(rows), pa.float64())], names=["score"])

    place = (F.col("total") - 1) * F.lit(float(share))
    low, high = value_at("score", F.floor(place)), value_at("score", F.ceil(place))
    found = value_places(blocks.mapInArrow(run, "score double"), [], "score").agg(low.alias("low"), high.alias("high"), F.first(place - F.floor(place)).alias("between")).first()
    return found.low + (found.high - found.low) * found.between


def labelled_features(docs: DataFrame, labels: DataFrame, block: int = BLOCK, sent: int = SENT) -> tuple[DataFrame, np.ndarray]:
    """Blocks of the features of all learnable labelled documents (a row each), and how many have the label 0 and 1. Conflicting
    labels of a document count as their smaller one, of rows with one doc_id the smaller features count.

    Up to `sent` labels go to all tasks; of more, the features of every text are made where it lies, and those meet the labels."""
    key = F.col("doc_id").cast("long")
    learn = labels.where(F.col("quality").isin(0, 1) & key.isNotNull() & (F.crc32(key.cast("string").cast("binary")) % FOLDS != 0))
    picked = stage(learn.groupBy(key.alias("doc_id")).agg(F.min("quality").alias("quality")), "labels")
    texts = docs.select(key.alias("doc_id"), "text")
    few = picked.count() <= sent
    texts = texts.join(F.broadcast(picked), "doc_id") if few else texts.where("doc_id is not null")
    field = StructField("x", ArrayType(DoubleType()))
    found = with_text_columns(texts, [field], lambda ts: {"x": [features(t) for t in ts]}, ["doc_id", "quality"] if few else ["doc_id"])
    found = found if few else found.join(picked.hint("merge"), "doc_id")
    rows = stage(found.groupBy("doc_id").agg(F.min("quality").alias("y"), F.min("x").alias("x")), "labelled")
    counts = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = np.array([counts.get(0, 0), counts.get(1, 0)])
    parts = max(1, -(-int(sizes.sum()) // block))
    least = int(sizes.argmin())
    copies = min(parts, -(-FEW * parts // max(1, int(sizes[least]))))
    times = F.when(F.col("y") == least, copies).otherwise(1)
    first = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(parts))
    dealt = rows.select("doc_id", "y", "x", first.alias("first"), F.explode(F.sequence(F.lit(0), times - 1)).alias("copy"))
    dealt = dealt.select("doc_id", "y", "x", F.pmod(F.col("first") + F.col("copy"), F.lit(parts)).cast("int").alias("block"), (F.col("copy") == 0).cast("double").alias("own"))

    def gather(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id")
        rows = np.hstack((np.stack(group.x.to_list()), group[["own"]].to_numpy()))
        sides = [np.ascontiguousarray(rows[(group.y == k).to_numpy()]).tobytes() for k in (1, 0)]
        return pd.DataFrame({"block": group.block.iloc[:1], "good": sides[:1], "bad": sides[1:]}, index=group.index[:1])

    bounded_batches(docs.sparkSession)
    return stage(dealt.groupBy("block").applyInPandas(gather, "block int, good binary, bad binary"), "blocks"), sizes


def quality_scores(docs: DataFrame, ranking: Ranking | None, keep: list[str] | None = None) -> DataFrame:
    """docs with `score` (0 to 1). No shuffle."""

    def compute(texts: list[str]) -> dict:
        if ranking is None:
            return {"score": np.full(len(texts), 0.5)}
        return {"score": ranking.score(np.array([features(t) for t in texts]))}

    return with_text_columns(docs, [StructField("score", DoubleType())], compute, keep)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every whole text of `documents`, learned from `labels`."""
    docs = table(spark, sf_dir, "documents")
    ranking = fit_ranking(*labelled_features(docs, table(spark, sf_dir, "labels")))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return quality_scores(docs, ranking, ["doc_id"]).select(
        "doc_id",
        (F.crc32(key.cast("binary")) % FOLDS == 0).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, ranking: Ranking | None) -> DataFrame:
    """The documents that the classifier accepts, with their own columns."""
    from fieldlab.llm.common import filter_by_text

    if ranking is None:
        return docs
    return filter_by_text(docs, lambda texts: ranking.score(np.array([features(t) for t in texts])) >= CUT)
