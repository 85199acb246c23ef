"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Every match of the split pattern is encoded on its own, special strings are plain text. Texts over SPLIT_CHARS are cut
at safe boundaries first: before a single space with a non-space on either side, where no match of the pattern can
reach across. Decoding goes through raw bytes. Null and empty texts have no ids. Work is per row: nothing is shuffled,
repeated rows stay, an empty table gives an empty one, and a kept column that has the name of a new one gives way.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField

from fieldlab.llm.common import table, with_text_columns

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SPLIT_CHARS = 32_768
_SAFE = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str) -> tiktoken.Encoding:
    pairs = (line.split() for line in ranks.splitlines() if line)
    table_ = {base64.b64decode(piece): int(rank) for piece, rank in pairs}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table_, special_tokens={})


def safe_parts(text: str, size: int = SPLIT_CHARS) -> Iterator[str]:
    """text in parts of at least `size` characters (but the last), cut where no match of the pattern can cross."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if not cut:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def encode_text(encoding: tiktoken.Encoding, text: str) -> list[int]:
    if len(text) <= SPLIT_CHARS:
        return encoding.encode_ordinary(text)
    return [i for part in safe_parts(text) for i in encoding.encode_ordinary(part)]


def encode_documents(
    docs: DataFrame, ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN, keep: list[str] | None = None
) -> DataFrame:
    """docs with `ids` (array of int). The rank file is read on the driver and sent out (about 1 MB)."""
    held = docs.sparkSession.sparkContext.broadcast(open(ranks, "rb").read())

    def compute(texts: list[str]) -> dict:
        encoding = _encoding(held.value, pattern)
        return {"ids": [encode_text(encoding, t) for t in texts]}

    return with_text_columns(docs, [StructField("ids", ArrayType(IntegerType()))], compute, keep)


def decode_ids(encoded: DataFrame, ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """encoded with `bytes`, the raw bytes of `ids`; null ids give empty bytes."""
    import pyarrow as pa
    from pyspark.sql.types import StructType

    held = encoded.sparkSession.sparkContext.broadcast(open(ranks, "rb").read())
    kept = [c for c in encoded.columns if c.lower() != "bytes"]

    def run(batches):
        encoding = _encoding(held.value, pattern)
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            out = pa.array([encoding.decode_bytes(x or []) for x in ids], type=pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), out], names=[*kept, "bytes"])

    schema = StructType([*(encoded.schema[c] for c in kept), StructField("bytes", BinaryType())])
    return encoded.select(*kept).mapInArrow(run, schema)


def encoding_digests(
    docs: DataFrame, ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN, keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """doc_id, n_tokens, n_bytes, ids_sha256 of the ids as little-endian 32-bit words, decoded_sha256 of the bytes that
    the ids decode to: encoding and decoding in one pass, so ids never leave the worker."""
    held = docs.sparkSession.sparkContext.broadcast(open(ranks, "rb").read())

    def compute(texts: list[str]) -> dict:
        encoding = _encoding(held.value, pattern)
        out: dict[str, list] = {"n_tokens": [], "n_bytes": [], "ids_sha256": [], "decoded_sha256": []}
        for text in texts:
            ids = encode_text(encoding, text)
            back = encoding.decode_bytes(ids)
            out["n_tokens"].append(len(ids))
            out["n_bytes"].append(len(back))
            out["ids_sha256"].append(hashlib.sha256(np.asarray(ids, dtype="<u4").tobytes()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
        return out

    fields = [
        StructField("n_tokens", LongType()),
        StructField("n_bytes", LongType()),
        StructField("ids_sha256", StringType()),
        StructField("decoded_sha256", StringType()),
    ]
    return with_text_columns(docs, fields, compute, list(keep))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text of `documents`, and what they decode to, as digests."""
    return encoding_digests(table(spark, sf_dir, "documents"))
