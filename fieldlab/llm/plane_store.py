"""Token ids on disk as compressed planes.

The store is a Parquet table of segments, so that Spark's committer guards it against lost and repeated tasks on any
file system. A segment holds whole documents in ascending doc_id order, up to SEGMENT_IDS ids (one document at least),
as one container of bytes:

    magic "FLPS", plane kind (0 bytes, 1 bits), chunk size, chunk count, id count
    chunk index: for each chunk its offset, ids, crc32 of the ids, and the compressed length of each plane
    planes, one after the other

A chunk is a fixed-size block of ids (the last of a segment may be shorter) as 32-bit words, transposed into 4 byte
planes or 32 bit planes, each compressed by zstandard on its own: the high planes are nearly constant and shrink to
almost nothing. Documents may start inside a chunk. Where a segment starts within its part is stored with it; where a
part starts is the sum of the parts before it, a few numbers for the whole store.

Null and empty texts become the end id alone. Null doc_ids come first; rows of equal doc_id are ordered by text, and
repeated rows are stored as often as they occur. An empty table gives a store without segments. Of the input only doc_id
and text are read, so other columns, of whatever names, don't matter.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldlab.llm.common import bounded_batches, stage, steps, table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
CHUNK_IDS, SEGMENT_IDS, LEVEL = 65_536, 1_048_576, 3
CACHE_WORDS = 700_000
BYTES, BITS = 0, 1
_HEAD = struct.Struct("<4sBIIQ")
#: Characters that aren't plain: separators that only Python splits at, and all from dotted I and the letters beyond
#: Latin Extended-B on.
_ODD, _ODD_ASCII = re.compile("[^\x00-\x1b\x20-\u012f\u0131-\u024f]"), re.compile("[\x1c-\x1f]")
SEGMENTS = "part int, segment int, part_start long, n_ids long, doc_ids array<long>, lengths array<long>, content binary"


# --- planes


def to_planes(ids: np.ndarray, kind: int = BYTES) -> np.ndarray:
    """A row for each plane of the 32-bit ids."""
    words = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if kind == BYTES:
        return np.ascontiguousarray(words.T)
    return np.packbits(np.unpackbits(words, axis=1, bitorder="little").T, axis=1, bitorder="little")


def from_planes(planes: np.ndarray, n: int, kind: int = BYTES) -> np.ndarray:
    if kind == BYTES:
        return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)
    bits = np.unpackbits(planes, axis=1, count=n, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u4").reshape(-1)


def write_container(ids: np.ndarray, kind: int = BYTES, chunk: int = CHUNK_IDS, level: int = LEVEL) -> bytes:
    press = zstandard.ZstdCompressor(level=level)
    index, blobs, offset = [], [], 0
    for start in range(0, len(ids), chunk):
        block = np.ascontiguousarray(ids[start : start + chunk], dtype="<u4")
        planes = [press.compress(plane.tobytes()) for plane in to_planes(block, kind)]
        lengths = [len(p) for p in planes]
        index.append(struct.pack(f"<QII{len(planes)}I", offset, len(block), zlib.crc32(block.tobytes()), *lengths))
        blobs += planes
        offset += sum(lengths)
    return b"".join([_HEAD.pack(b"FLPS", kind, chunk, len(index), len(ids)), *index, *blobs])


class Container:
    """Reads any range of ids of a container through its chunk index."""

    def __init__(self, content: bytes):
        magic, self.kind, self.chunk, chunks, self.n_ids = _HEAD.unpack_from(content)
        if magic != b"FLPS":
            raise ValueError("not a plane container")
        self.planes = 4 if self.kind == BYTES else 32
        entry = struct.Struct(f"<QII{self.planes}I")
        self.index = [entry.unpack_from(content, _HEAD.size + k * entry.size) for k in range(chunks)]
        self.content, self.base = content, _HEAD.size + chunks * entry.size

    def chunk_ids(self, k: int) -> np.ndarray:
        offset, n, crc, *lengths = self.index[k]
        at, rows = self.base + offset, []
        for length in lengths:
            rows.append(zstandard.ZstdDecompressor().decompress(self.content[at : at + length]))
            at += length
        ids = from_planes(np.stack([np.frombuffer(r, np.uint8) for r in rows]), n, self.kind)
        if zlib.crc32(ids.tobytes()) != crc:
            raise ValueError(f"chunk {k} is damaged")
        return ids

    def ids(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        stop = self.n_ids if stop is None else min(stop, self.n_ids)
        if start >= stop:
            return np.empty(0, "<u4")
        first, last = start // self.chunk, (stop - 1) // self.chunk
        held = np.concatenate([self.chunk_ids(k) for k in range(first, last + 1)])
        return held[start - first * self.chunk : stop - first * self.chunk]


# --- ids of texts


class WordEncoder:
    """The library's ids of whole texts.

    The tokenizer lowers case, drops white space and never looks across it, so a plain text equals its words in lower
    case: the library encodes each distinct word while it is remembered, and the numbers of words are looked up in one
    array. A word of letters and a tail of signs is its letters and its tail. Texts with characters beyond the plain
    ranges (where composing or lowering depends on neighbours, or white space is judged otherwise) are handed to the
    library whole."""

    def __init__(self, vocabulary: bytes, end_id: int = END_ID):
        self.tokenizer = Tokenizer.from_buffer(vocabulary)
        names = self.tokenizer.get_vocab()
        self.last = np.zeros(max(names.values()) + 1, bool)  # ids that end a pre-token
        self.last[[k for name, k in names.items() if name.endswith("</w>")]] = True
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.end_id = end_id
        self._clear()

    def _clear(self) -> None:
        self.seen: dict[str | None, int] = {None: 0}
        self.pool = np.array([self.end_id], "<u4")
        self.starts, self.sizes = np.array([0]), np.array([1])

    def library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that are one pre-token each, end to end, and their sizes: many words go to the library as one
        text, and the ids that end a pre-token part them again."""
        flat, sizes = [], []
        for k in range(0, len(words), 128):
            some = words[k : k + 128]
            ids = np.asarray(self.library([" ".join(some)])[0], "<u4")
            ends = np.flatnonzero(self.last[ids])
            if len(ends) == len(some):
                sizes.append(np.diff(ends, prepend=-1))
            else:
                own = self.library(some)
                ids, ends = np.asarray([i for x in own for i in x], "<u4"), None
                sizes.append(np.fromiter(map(len, own), np.int64, len(own)))
            flat.append(ids)
        return np.concatenate(flat), np.concatenate(sizes)

    def _remember(self, words: list[str], flat: np.ndarray, sizes: np.ndarray) -> None:
        self.seen.update(zip(words, range(len(self.sizes), len(self.sizes) + len(words))))
        self.starts = np.concatenate((self.starts, len(self.pool) + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.pool = np.concatenate((self.pool, flat))

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the remembered words of these numbers, end to end, and their running total from 0."""
        sizes = self.sizes[at]
        total = np.concatenate(([0], np.cumsum(sizes)))
        return self.pool[np.repeat(self.starts[at] - total[:-1], sizes) + np.arange(total[-1])], total

    def _learn(self, words: set[str]) -> None:
        seen = self.seen
        letters, signs, tailed, others = set(), set(), [], []
        for word in words:
            core = word.rstrip(_SIGNS)
            if core.isalpha():
                if core not in seen:
                    letters.add(core)
                if len(core) < len(word):
                    tail = word[len(core) :]
                    tailed.append((word, core, tail))
                    if tail not in seen and tail not in words:
                        signs.add(tail)
            else:
                others.append(word)
        if letters:
            new = list(letters)
            self._remember(new, *self._letters(new))
        others += signs
        if others:
            own = self.library(others)
            sizes = np.fromiter(map(len, own), np.int64, len(own))
            self._remember(others, np.asarray([i for x in own for i in x], "<u4"), sizes)
        if tailed:
            pairs = (seen[part] for _, core, tail in tailed for part in (core, tail))
            flat, total = self._gather(np.fromiter(pairs, np.int64, 2 * len(tailed)))
            self._remember([w for w, _, _ in tailed], flat, np.diff(total[::2]))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, the end id after each text, and how many each text has."""
        words: list[str | None] = []
        each = np.zeros(len(texts), np.int64)
        whole = []
        for k, text in enumerate(texts):
            if (_ODD_ASCII if text.isascii() else _ODD).search(text) or any(x in text for x in self.specials):
                whole.append(k)
                own = []
            else:
                own = text.lower().split()
            words += own
            words.append(None)
            each[k] = len(own) + 1
        at = np.fromiter(map(self.seen.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            names = [words[k] for k in missing.tolist()]
            self._learn(set(names))
            at[missing] = np.fromiter(map(self.seen.__getitem__, names), np.int64, len(names))
        flat, total = self._gather(at)
        bounds = total[np.concatenate(([0], np.cumsum(each)))]
        lengths = np.diff(bounds)
        if whole:
            parts = np.split(flat, bounds[1:-1])
            for k, ids in zip(whole, self.library([texts[k] for k in whole])):
                parts[k] = np.append(np.asarray(ids, "<u4"), np.uint32(self.end_id))
            flat, lengths = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        if len(self.seen) > CACHE_WORDS or len(self.pool) > 8 * CACHE_WORDS:
            self._clear()
        return flat, lengths


#: Signs of which a tail may consist; no apostrophe, which may belong to letters.
_SIGNS = ".,;:!?|%&*$#()[]{}+=-_/@\"\\<>~^`"


@lru_cache(maxsize=2)
def _encoder(vocabulary: bytes, end_id: int) -> WordEncoder:
    return WordEncoder(vocabulary, end_id)


# --- the store


def write_store(
    docs: DataFrame,
    vocabulary: str = VOCABULARY,
    end_id: int = END_ID,
    kind: int = BYTES,
    chunk: int = CHUNK_IDS,
    segment: int = SEGMENT_IDS,
) -> DataFrame:
    """Encodes docs (doc_id, text) and writes the store in the shared folder; returns its table of segments.

    One shuffle deals the texts out by ranges of doc_id; part k of the store holds range k. Encoding runs after it, so
    ids are written once and never shuffled."""
    spark = docs.sparkSession
    bounded_batches(spark)
    held = spark.sparkContext.broadcast(open(vocabulary, "rb").read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(held.value, end_id), TaskContext.get().partitionId()
        keys: list = []
        lengths: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        number = start = size = 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            row = [part, number, start, len(ids), keys, np.concatenate(lengths), write_container(ids, kind, chunk)]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=_NAMES)

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in steps(texts, 1_500_000):
                ids, each = encoder.encode(texts[a:b])
                keys += doc_ids[a:b]
                lengths.append(each)
                parts.append(ids)
                size += len(ids)
                if size >= segment:
                    yield close()
                    keys, lengths, parts, number, start, size = [], [], [], number + 1, start + size, 0
        if keys:
            yield close()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # the beginning of the text parts the rows of a doc_id that occurs very often
    ordered = texts.repartitionByRange(F.col("doc_id"), F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    return stage(ordered.mapInArrow(run, SEGMENTS), "segments", compression="none")


_NAMES = ["part", "segment", "part_start", "n_ids", "doc_ids", "lengths", "content"]


def part_starts(store: DataFrame) -> dict[int, int]:
    """Ids before each part. As many rows as parts, that is shuffle partitions of the writing job, reach the driver."""
    sums = sorted((r.part, r.n) for r in store.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    out, total = {}, 0
    for part, n in sums:
        out[part], total = total, total + n
    return out


def read_documents(store: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of every document, from the stored planes.
    A task reads segment by segment; no shuffle."""
    starts = part_starts(store)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = Container(row["content"]).ids()
                each = np.asarray(row["lengths"], np.int64)
                ends = np.cumsum(each)
                data = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                crcs = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), each.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(starts[row["part"]] + row["part_start"] + ends - each),
                        pa.array(each),
                        pa.array(crcs, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    bounded_batches(store.sparkSession)
    return store.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(store: DataFrame) -> DataFrame:
    """doc_id, ids of every document, from the stored planes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = Container(row["content"]).ids().astype(np.int32)
                offsets = np.concatenate(([0], np.cumsum(row["lengths"]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), lists], names=["doc_id", "ids"])

    bounded_batches(store.sparkSession)
    return store.mapInArrow(run, "doc_id long, ids array<int>")


def op1_plane_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store of every whole text of `documents`, written and read back."""
    return read_documents(write_store(table(spark, sf_dir, "documents")))
