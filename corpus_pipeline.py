"""The corpus pipeline: five stages over documents, each written as Parquet and read again before the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldlab.llm import byte_bpe, language, mixing, near_dups, quality
from fieldlab.llm.common import stage, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from `labels`, accepts. A null text counts as empty and is scored like one; equal
    texts fare alike, repeated rows too; null doc_ids have no label; the empty table gives the empty one."""
    ranking = quality.fit_ranking(*quality.labelled_features(docs, table(spark, sf_dir, "labels")))
    return quality.keep_good(docs, ranking)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the kept documents are tagged with; texts without a letter go, and texts
    that are as unlike every language as few learned texts are. All stay where nothing can be learned. Null and empty texts have
    no letter; equal texts fare alike, repeated rows too."""
    return language.keep_known(docs, *language.learn_with_threshold(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: the one of the smallest doc_id, null first. Null and empty texts
    are copies of each other; of repeated rows one stays; the empty table gives the empty one."""
    return near_dups.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. Null and empty texts have no words and are not taken; rows equal in doc_id and
    text share what is left at a source's threshold; null is a source of its own; the empty table gives the empty one."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, and the digests of the ids of every document of the mix and of what they decode to; a row for each
    row, null texts as empty ones."""
    return byte_bpe.encoding_digests(docs, keep=("doc_id", "source"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_classifier),
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]
#: SQL has neither the learned stages nor the signatures; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, function) in enumerate(STAGES):
        docs = stage(function(spark, docs, sf_dir), f"{k}-{name.split()[0].lower()}")
    return docs
