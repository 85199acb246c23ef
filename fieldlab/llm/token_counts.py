"""Token counts of a sentencepiece BPE model by rank-synchronous array merging.

A text becomes pre-tokens (a run of word marks and what follows, since no piece has a mark inside), and the distinct
pre-tokens of a batch lie end to end in one ragged array of symbols; a long one is cut into sequences between characters
that no piece has side by side. Each round finds, for every sequence at once, its lowest-rank adjacent pair and joins it;
sequences without a pair left drop out. All places of the pair are joined in one round, up to the first one after which
a pair of the same or a lower rank stands beside it: that equals joining them one after the other. Surviving symbols are
counted; a character outside the vocabulary counts its UTF-8 bytes (byte fallback).

Runs of marks are counted by their length alone where the model's pieces of marks have one rank, after all others: there
the leftmost pair always goes first, so only what stands at the run's end and its length matter.

The model file is read for its pieces and settings only. Null and empty texts have no tokens; texts of any length are
counted whole; repeated rows stay, an empty table gives an empty one; a column that has the name of a new one gives way.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BooleanType, LongType, StructField

from fieldlab.llm.common import table, with_text_columns

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIMIT = 4096
#: Distinct pre-tokens that a worker remembers, and the longest of them.
CACHE_WORDS, CACHE_CHARS = 500_000, 48
#: Pre-tokens above this length are cut at seams.
SEAM_CHARS = 32
MARK = "▁"
_NONE = np.int32(2**31 - 1)


def _fields(data: bytes):
    """(number, value) of a protocol buffer message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[i]
            value |= (byte & 127) << shift
            i, shift = i + 1, shift + 7
            if byte < 128:
                return value, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        if tag & 7 == 0:
            value, i = varint(i)
        else:
            size = {1: 8, 5: 4}.get(tag & 7)
            if size is None:
                size, i = varint(i)
            value, i = data[i : i + size], i + size
        yield tag >> 3, value


class Merger:
    """Pieces, pair ranks and the counts of pre-tokens."""

    def __init__(self, model: bytes):
        pieces: list[tuple[str, float, int]] = []
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                score = float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0])
                pieces.append((piece[1].decode("utf-8"), score, piece.get(3, 1)))
            elif number == 2:
                trainer = dict(_fields(value))
                if trainer.get(3) != 2 or not trainer.get(35):
                    raise ValueError("only BPE models with byte fallback are counted here")
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(1) != b"identity" or spec.get(3, 1) != 1 or spec.get(4, 1) != 0 or spec.get(5, 1) != 1:
                    raise ValueError("only models that keep texts as they are, with a leading mark, are counted here")
        if any(kind in (4, 5) for _, _, kind in pieces):
            raise ValueError("models with user-defined or unused pieces are not counted here")
        normal = {text: k for k, (text, _, kind) in enumerate(pieces) if kind == 1}
        if any(MARK in text.lstrip(MARK) for text in normal):
            raise ValueError("a piece has a word mark inside, so pre-tokens can't be split at marks")
        scores = np.array([score for _, score, _ in pieces])
        order = np.unique(-scores, return_inverse=True)[1]  # equal scores share a rank, the leftmost place goes first
        self.unknown = len(pieces)
        self.single = np.full(0x110000, self.unknown, dtype=np.int32)
        keys, ranks, joined = [], [], []
        width = len(pieces) + 1
        eager = np.zeros(width, dtype=bool)  # joined pieces after which a pair of the same or a lower rank may appear
        for text, k in normal.items():
            if len(text) == 1:
                self.single[ord(text)] = k
            for cut in range(1, len(text)):
                left, right = normal.get(text[:cut]), normal.get(text[cut:])
                if left is not None and right is not None:
                    keys.append(left * width + right)
                    ranks.append(order[k])
                    joined.append(k)
                    for half in (left, right):
                        eager[half] |= order[k] <= order[half]
        by = np.argsort(np.array(keys, dtype=np.int64))
        self.keys = np.append(np.array(keys, dtype=np.int64)[by], np.iinfo(np.int64).max)
        self.ranks = np.append(np.array(ranks, dtype=np.int32)[by], _NONE)
        self.joined = np.append(np.array(joined, dtype=np.int32)[by], 0)
        self.width, self.eager = width, eager
        self.inside = np.unique(np.array([ord(x) << 21 | ord(y) for text in normal for x, y in zip(text, text[1:])], dtype=np.int64))
        self.mark = normal.get(MARK, self.unknown)
        lengths = {len(text): order[k] for text, k in normal.items() if not text.strip(MARK)}
        others = [order[k] for text, k in normal.items() if text.strip(MARK)]
        same = len({lengths[n] for n in lengths if n > 1}) <= 1 and min((lengths[n] for n in lengths if n > 1), default=1) > max(others)
        mixed = any(text.startswith(MARK * 2) and text.strip(MARK) for text in normal)
        self.runs = set(lengths) if same and not mixed and 1 in lengths else None
        self.run_counts: dict[int, int] = {0: 0}
        self.seen: dict[str, int] = {}

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and joined piece of each pair; _NONE where there is none."""
        key = left.astype(np.int64) * self.width + right
        at = np.searchsorted(self.keys, key)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], _NONE), self.joined[at]

    def run_tokens(self, n: int) -> int:
        """Tokens of n marks: the leftmost pair that is a piece is joined, until there is none."""
        longest = max(self.runs)
        if n > 3 * longest and self._run_parts(longest) == [longest]:
            many = n // longest - 2  # a piece of the longest kind joins nothing, so what follows it is a run by itself
            return many + self.run_tokens(n - many * longest)
        if n not in self.run_counts:
            self.run_counts[n] = len(self._run_parts(n))
        return self.run_counts[n]

    def _run_parts(self, n: int) -> list[int]:
        parts: list[int] = []
        while n:
            size = 1 if parts and parts[-1] + 1 in self.runs else 2 if n > 1 and 2 in self.runs else 1
            parts.append(size)
            n -= size
            while len(parts) > 1 and parts[-2] + parts[-1] in self.runs:
                last = parts.pop()
                parts[-1] += last
        return parts

    def _until_beside(self, at: np.ndarray, symbols: np.ndarray, seq: np.ndarray, rank: np.ndarray, join: np.ndarray) -> np.ndarray:
        """The places of `at` up to each sequence's first one whose joined piece has a pair of its rank or a lower one."""
        some = np.flatnonzero(self.eager[join[at]])
        if not len(some):
            return at
        p, last = at[some], len(symbols) - 1
        piece, own, limit = join[p], seq[p], rank[p]
        right = np.minimum(p + 2, last)  # not joined yet when p is
        beside = (p + 2 <= last) & (seq[right] == own) & (self._pairs(piece, symbols[right])[0] <= limit)
        left, before = np.maximum(p - 1, 0), at[np.maximum(some - 1, 0)]
        other = np.where((some > 0) & (before == p - 2), join[before], symbols[left])
        beside |= (p > 0) & (seq[left] == own) & (self._pairs(other, piece)[0] <= limit)
        stop = np.zeros(len(at), dtype=np.int64)
        stop[some] = beside
        earlier = np.cumsum(stop) - stop
        first = np.concatenate(([True], seq[at[1:]] != seq[at[:-1]]))
        return at[earlier == earlier[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]]

    def count(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each pre-token (never empty), and whether its first one is a mark by itself."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        symbols = self.single[points]
        size = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        extra = np.where(symbols == self.unknown, size - 1, 0)
        ends = np.cumsum(lengths)
        total = np.concatenate(([0], np.cumsum(extra)))
        counts = total[ends] - total[ends - lengths]
        alone = np.zeros(len(words), dtype=bool)
        begins = np.zeros(len(points), dtype=bool)
        begins[ends - lengths] = True
        heads = begins.copy()
        if len(lengths) and lengths.max() > SEAM_CHARS:
            after = np.flatnonzero(np.repeat(lengths > SEAM_CHARS, lengths)[1:]) + 1
            pair = points[after - 1] << 21 | points[after]
            found = self.inside[np.minimum(np.searchsorted(self.inside, pair), len(self.inside) - 1)]
            begins[after[found != pair]] = True
        seq = np.cumsum(begins) - 1
        owner = np.repeat(np.arange(len(words)), lengths)[begins]
        heads = heads[begins]
        rank = np.full(len(symbols), _NONE, dtype=np.int32)
        join = np.zeros(len(symbols), dtype=np.int32)
        if len(symbols) > 1:
            rank[:-1], join[:-1] = self._pairs(symbols[:-1], symbols[1:])
            rank[:-1][seq[:-1] != seq[1:]] = _NONE
        while len(symbols):
            starts = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            sizes = np.diff(np.append(starts, len(symbols)))
            least = np.minimum.reduceat(rank, starts)
            done = least == _NONE
            if done.any():
                ended = seq[starts[done]]
                np.add.at(counts, owner[ended], sizes[done])
                alone[owner[ended[heads[ended]]]] = (symbols[starts[done]] == self.mark)[heads[ended]]
                if done.all():
                    break
                live = np.repeat(~done, sizes)
                symbols, seq, rank, join = symbols[live], seq[live], rank[live], join[live]
                least, sizes = least[~done], sizes[~done]
            at = np.flatnonzero(rank == np.repeat(least, sizes))
            run = np.concatenate(([True], np.diff(at) != 1))  # overlapping places: every other one, from the left
            begin = np.maximum.accumulate(np.where(run, at, 0))
            at = self._until_beside(at[(at - begin) % 2 == 0], symbols, seq, rank, join)
            symbols[at] = join[at]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            new = at - np.arange(len(at))  # where they are once the right halves are gone
            symbols, seq, rank, join = symbols[keep], seq[keep], rank[keep], join[keep]
            stale = np.concatenate((new, new[new > 0] - 1))
            last = stale == len(symbols) - 1
            rank[stale[last]] = _NONE
            stale = stale[~last]
            ranks, pieces = self._pairs(symbols[stale], symbols[stale + 1])
            rank[stale] = np.where(seq[stale] == seq[stale + 1], ranks, _NONE)
            join[stale] = pieces
        return counts, alone

    def count_texts(self, texts: list[str]) -> np.ndarray:
        words: list[str] = []
        each = np.zeros(len(texts), dtype=np.int64)
        marks: list[tuple[int, int]] = []  # pre-tokens with more than one mark, and how many
        for k, text in enumerate(texts):
            if text:
                marked = MARK + text.replace(" ", MARK)
                if MARK * 2 not in marked and not marked.endswith(MARK):
                    own = marked[1:].split(MARK)  # without runs of marks, the marks are the only seams
                elif self.runs is None:
                    own = [m.group()[1:] for m in _RUNS.finditer(marked)]  # a leading mark is added again below
                else:
                    own = []
                    for m in _RUNS.finditer(marked):
                        if m.end(1) - m.start(1) > 1:
                            marks.append((len(words) + len(own), m.end(1) - m.start(1)))
                        own.append(m.group(2))
                words += own
                each[k] = len(own)
        if not words:
            return each
        seen = self.seen
        missing = list(set(words) - seen.keys())
        if missing:
            counted, alone = self.count([MARK + w for w in missing])
            seen.update(zip(missing, (2 * counted + alone).tolist()))
        got = np.fromiter(map(seen.__getitem__, words), dtype=np.int64, count=len(words))
        single, got = got & 1, got >> 1
        for k, n in marks:
            got[k] += self.run_tokens(n) - 1 if single[k] else self.run_tokens(n - 1)
        for w in missing:
            if len(w) > CACHE_CHARS:
                del seen[w]
        if len(seen) > CACHE_WORDS:
            seen.clear()
        ends = np.cumsum(each)
        total = np.concatenate(([0], np.cumsum(got)))
        return total[ends] - total[ends - each]


_RUNS = re.compile(f"({MARK}+)([^{MARK}]*)")


@lru_cache(maxsize=2)
def _merger(model: bytes) -> Merger:
    return Merger(model)


def count_tokens(
    docs: DataFrame, model: str = MODEL, limit: int = LIMIT, keep: tuple[str, ...] | None = ("doc_id",)
) -> DataFrame:
    """The kept columns of docs with n_bytes, n_tokens and over_limit. No shuffle; the model (0.5 MB) is sent out."""
    held = docs.sparkSession.sparkContext.broadcast(open(model, "rb").read())

    def compute(texts: list[str]) -> dict:
        tokens = _merger(held.value).count_texts(texts)
        return {"n_bytes": [len(t.encode()) for t in texts], "n_tokens": tokens, "over_limit": tokens > limit}

    fields = [
        StructField("n_bytes", LongType()),
        StructField("n_tokens", LongType()),
        StructField("over_limit", BooleanType()),
    ]
    return with_text_columns(docs, fields, compute, None if keep is None else list(keep))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every whole text of the table `documents`."""
    return count_tokens(table(spark, sf_dir, "documents"))
