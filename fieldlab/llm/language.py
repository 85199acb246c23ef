"""Language identification with hyperdimensional profiles.

Every letter has a random vector of signs. An n-gram binds its letters: their vectors, each rolled by its distance to
the n-gram's end, multiplied. A text bundles its n-grams: the sum of their vectors. A language's prototype is the sum of
the unit vectors of its learned texts, less what all languages share. A text gets the language whose prototype has the
largest cosine with it.

Every text with a language is learned, but those held out; the number of languages is taken to be bounded (MAX_LANGUAGES;
more raise an error). Null texts and texts without a letter are `und` with score 0; so is
every text if there is nothing to learn from.

A text equally near to several languages gets the first of them by name; repeated rows stay, an empty table gives an
empty one, and a kept column that has the name of a new one gives way.

A filter by language rejects texts whose cosine is below the one that all but LOW_QUANTILE of the learned texts reach.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from fieldlab.llm.common import bounded_batches, filter_by_text, steps, table, with_text_columns
from fieldlab.operators.ranks import value_at, value_places

DIMENSIONS, GRAM, SEED, FOLDS, HELD_OUT = 1024, 3, 23, 4, 2
MAX_LANGUAGES, UNKNOWN = 1000, "und"
#: The share of learned texts (the shortest and oddest) that may lie below the threshold of rejection.
LOW_QUANTILE = 0.005


class Letters:
    """Vectors of letters, and bundles of texts."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed = dimensions, seed
        self.is_letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        self.number = np.zeros(0x110000, np.int64)
        self.held: dict[int, np.ndarray] = {}

    def vector(self, point: int) -> np.ndarray:
        if point not in self.held:
            rng = np.random.Generator(np.random.PCG64([self.seed, point]))
            self.held[point] = (rng.integers(0, 2, self.dimensions, np.int8) * 2 - 1).astype(np.int8)
        return self.held[point]

    def grams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct n-grams as rows of code points; then for every n-gram in the texts its number, and its text."""
        parts = [f" {t.lower()} " for t in texts]
        points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        owner = np.repeat(np.arange(len(parts)), np.fromiter(map(len, parts), np.int64, len(parts)))
        letter = self.is_letter[points]
        keep = letter | np.concatenate(([True], letter[:-1])) | np.concatenate(([True], owner[1:] != owner[:-1]))
        points, owner = np.where(letter, points, 32)[keep], owner[keep]
        found = np.zeros(0x110000, bool)
        found[points] = True
        used = np.flatnonzero(found)
        self.number[used] = np.arange(len(used))
        codes = self.number[points]
        size = len(used)
        code = (codes[:-2] * size + codes[1:-1]) * size + codes[2:]
        ok = (owner[:-2] == owner[2:]) & (points[1:-1] != 32)
        code, owner = code[ok], owner[:-2][ok]
        if size**GRAM <= 4_000_000:
            there = np.zeros(size**GRAM, bool)
            there[code] = True
            distinct = np.flatnonzero(there)
            place = np.empty(size**GRAM, np.int32)
            place[distinct] = np.arange(len(distinct))
            number = place[code]
        else:
            distinct, number = np.unique(code, return_inverse=True)
        return used[np.stack((distinct // size**2, distinct // size % size, distinct % size), axis=1)], number, owner

    def bundles(self, texts: list[str]) -> np.ndarray:
        """A unit vector for each text; zeros for texts without a letter."""
        out = np.zeros((len(texts), self.dimensions), np.float32)
        grams, number, owner = self.grams(texts)
        if not len(grams):
            return out
        points, at = np.unique(grams, return_inverse=True)
        at = at.reshape(grams.shape)
        plain = np.stack([self.vector(int(p)) for p in points])
        bound = np.roll(plain, 2, axis=1)[at[:, 0]]
        bound *= np.roll(plain, 1, axis=1)[at[:, 1]]
        bound *= plain[at[:, 2]]
        ends = np.searchsorted(owner, np.arange(len(texts) + 1))
        for k in range(len(texts)):
            own = number[ends[k] : ends[k + 1]]
            if len(own):
                count = np.bincount(own, minlength=len(grams))
                some = np.flatnonzero(count)
                out[k] = count[some].astype(np.float32) @ bound[some].astype(np.float32)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


_LETTERS: dict[tuple[int, int], Letters] = {}


def _letters(dimensions: int, seed: int) -> Letters:
    if (dimensions, seed) not in _LETTERS:
        _LETTERS[dimensions, seed] = Letters(dimensions, seed)
    return _LETTERS[dimensions, seed]


@dataclass(frozen=True)
class Profiles:
    languages: tuple[str, ...]
    prototypes: np.ndarray = field(repr=False)  # a unit row for each language
    seed: int = SEED

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        names, cosines = self.nearest(texts)
        return names, np.clip(cosines, 0, 1)

    def nearest(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Languages and their cosines, which may be negative."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        names: list[str] = []
        scores = np.zeros(len(texts))
        letters = _letters(self.prototypes.shape[1], self.seed)
        for a, b in steps(texts, 400_000):
            found = letters.bundles(texts[a:b])
            near = found @ self.prototypes.T
            best = near.argmax(axis=1)
            some = found.any(axis=1)
            scores[a:b] = np.where(some, near[np.arange(b - a), best], 0)
            names += [self.languages[k] if ok else UNKNOWN for k, ok in zip(best, some)]
        return names, scores


def learn_profiles(docs: DataFrame, dimensions: int = DIMENSIONS, seed: int = SEED) -> Profiles:
    """Prototypes of the non-null languages of docs, but of rows whose crc32 of doc_id mod 4 is 2.

    Tasks add up vectors by language, and the sums are added by language and place; one number for each of them reaches
    the driver."""
    counts, picked = _learned(docs)
    return _profiles(docs, counts, picked, dimensions, seed)


def learn_with_threshold(docs: DataFrame, quantile: float = LOW_QUANTILE) -> tuple[Profiles, float]:
    """As learn_profiles, and the cosine that all but `quantile` of the learned texts reach; -1 without a learned text."""
    counts, picked = _learned(docs)
    profiles = _profiles(docs, counts, picked, DIMENSIONS, SEED)
    if not profiles.languages:
        return profiles, -1.0
    held = docs.sparkSession.sparkContext.broadcast(profiles)

    def compute(texts: list[str]) -> dict:
        names, cosines = held.value.nearest(texts)
        return {"cosine": [None if name == UNKNOWN else x for name, x in zip(names, cosines.tolist())]}

    own = value_places(with_text_columns(picked, [StructField("cosine", DoubleType())], compute, []), [], "cosine")
    place = F.greatest(F.ceil(F.col("total") * F.lit(quantile)) - 1, F.lit(0))
    least = own.agg(value_at("cosine", place)).first()[0]
    return profiles, -1.0 if least is None else least - 1e-5  # sums of other batches differ in their last digits


def _learned(docs: DataFrame) -> tuple[dict[str, int], DataFrame | None]:
    """The number of texts that can be learned by language, and those that are."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    learn = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(key.cast("binary")) % FOLDS != HELD_OUT))
    counts = {r.lang: r.n for r in learn.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return counts, None
    return counts, learn.select("lang", "text")


def _profiles(docs: DataFrame, counts: dict[str, int], picked: DataFrame | None, dimensions: int, seed: int) -> Profiles:
    if picked is None:
        return Profiles((), np.zeros((0, dimensions), np.float32), seed)
    bounded_batches(docs.sparkSession)

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        letters = _letters(dimensions, seed)
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in steps(texts, 400_000):
                found = letters.bundles(texts[a:b])
                for k, lang in enumerate(langs[a:b]):
                    sums[lang] = sums.get(lang, 0) + found[k].astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([x.tolist() for x in sums.values()], pa.list_(pa.float64()))], names=["lang", "total"]
            )

    sums = (
        picked.mapInArrow(run, "lang string, total array<double>")
        .select("lang", F.posexplode("total").alias("place", "value"))
        .groupBy("lang", "place")
        .agg(F.sum("value").alias("value"))
    )
    languages = tuple(sorted(counts))
    found = np.zeros((len(languages), dimensions))
    for r in sums.collect():
        found[languages.index(r.lang), r.place] = r.value
    found /= np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)
    if len(languages) > 1:
        found -= 0.5 * found.mean(axis=0)
        found /= np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)
    return Profiles(languages, found.astype(np.float32), seed)


def identify(docs: DataFrame, profiles: Profiles, keep: list[str] | None = None) -> DataFrame:
    """docs with lang_pred and score. No shuffle; the prototypes are sent out (a few KB for each language)."""
    held = docs.sparkSession.sparkContext.broadcast(profiles)

    def compute(texts: list[str]) -> dict:
        names, scores = held.value.predict(texts)
        return {"lang_pred": names, "score": scores}

    return with_text_columns(docs, [StructField("lang_pred", StringType()), StructField("score", DoubleType())], compute, keep)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of `documents`, learned from the texts that are not held out."""
    docs = table(spark, sf_dir, "documents")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return identify(docs, learn_profiles(docs), ["doc_id"]).select(
        "doc_id", (F.crc32(key.cast("binary")) % FOLDS == HELD_OUT).alias("held_out"), "lang_pred", "score"
    )


def keep_known(docs: DataFrame, profiles: Profiles, least: float = -1.0) -> DataFrame:
    """The documents in one of the learned languages, with a cosine of at least `least`, with their own columns; all
    documents if no text with a letter was learned."""
    if not profiles.prototypes.any():
        return docs
    held = docs.sparkSession.sparkContext.broadcast(profiles)

    def accept(texts: list[str]) -> list[bool]:
        names, cosines = held.value.nearest(texts)
        return [name != UNKNOWN and cosine >= least for name, cosine in zip(names, cosines)]

    return filter_by_text(docs, accept)
