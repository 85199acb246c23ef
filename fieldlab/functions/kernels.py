"""String kernels over whole Arrow batches: one numpy program for all pairs of a batch, whatever their letters.

`swap_distances` counts edits with swaps of neighbours as one (each letter in one edit): bits of a 64-bit word hold a row of
the table, longer strings take the row program of `keyboard_distances`. There a row of all pairs' tables is one array; the
least over insertions is a running minimum. `matched_letters` finds, round by round for all open stretches of all pairs
at once, the longest common run (the first in a, then in b), and goes on beside it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

#: Rows of a keyboard, as fixed values: letters beside each other in a row, or at most one place apart in the next, are neighbours.
KEYS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")
NEIGHBOUR = 0.35
#: Cells of a batch's table at a time.
CELLS = 4_000_000
_U = np.uint64


def letters(strings: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the strings, a row each, -1 behind their ends; lengths."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    out = np.full((len(strings), max(1, int(sizes.max(initial=0)))), -1, np.int32)
    flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.int32)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out, sizes


def in_parts(kernel: Callable[[list[str], list[str]], np.ndarray], left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """kernel over pairs by their size, so that short pairs share a table that no long one widens."""
    sizes = np.fromiter(((len(a) + 1) * (len(b) + 1) for a, b in zip(left, right)), np.int64, len(left))
    width = np.fromiter((max(len(a), len(b)) + 1 for a, b in zip(left, right)), np.int64, len(left))
    out = np.zeros(len(left))
    order, start = np.lexsort((sizes, width)), 0
    while start < len(order):
        n = max(1, min(len(order) - start, CELLS // int(width[order[start]]) ** 2))
        while n > 1 and int(width[order[start + n - 1]]) ** 2 * n > CELLS:
            n = n * 3 // 4
        some = order[start : start + n]
        out[some] = kernel([left[k] for k in some], [right[k] for k in some])
        start += n
    return out


_NEAR = np.zeros((128, 128), bool)
for _row, _keys in enumerate(KEYS):
    for _k, _c in enumerate(_keys):
        for _other in KEYS[max(0, _row - 1) : _row + 2]:
            for _d in _other[max(0, _k - 1) : _k + 2]:
                _NEAR[ord(_c), ord(_d)] = _c != _d


def _rows(left: list[str], right: list[str], near: float | None, swaps: bool) -> np.ndarray:
    a, n = letters(left)
    b, m = letters(right)
    columns = np.arange(b.shape[1] + 1)
    rows = [np.tile(columns.astype(float), (len(a), 1))]
    out = rows[0][np.arange(len(a)), m].copy()
    narrow = np.where((b >= 0) & (b < 128), b, 0)
    for i in range(a.shape[1]):
        cost = (a[:, i : i + 1] != b).astype(float)
        if near is not None:
            own = np.where((a[:, i] >= 0) & (a[:, i] < 128), a[:, i], 0)
            cost[_NEAR[own[:, None], narrow]] = near
        now = np.empty_like(rows[-1])
        now[:, 0] = i + 1
        now[:, 1:] = np.minimum(rows[-1][:, :-1] + cost, rows[-1][:, 1:] + 1)
        if swaps and i:
            crossed = (a[:, i : i + 1] == b[:, :-1]) & (a[:, i - 1 : i] == b[:, 1:])
            now[:, 2:] = np.where(crossed, np.minimum(now[:, 2:], rows[-2][:, :-2] + 1), now[:, 2:])
        now = np.minimum.accumulate(now - columns, axis=1) + columns
        rows = [rows[-1], now]
        done = n == i + 1
        out[done] = now[done, m[done]]
    return out


def keyboard_distances(left: Sequence[str], right: Sequence[str], near: float = NEIGHBOUR) -> np.ndarray:
    """Edits, where a letter for its neighbour on the keyboard costs `near`."""
    return in_parts(lambda a, b: _rows(a, b, near, False), left, right)


def _bits(left: list[str], right: list[str]) -> np.ndarray:
    a, n = letters(left)
    b, m = letters(right)
    known, codes = np.unique(a, return_inverse=True)
    codes = codes.reshape(a.shape)
    there = np.zeros((len(a), len(known) + 1), np.uint64)
    each = np.arange(len(a))
    for i in range(a.shape[1]):
        there[each, codes[:, i]] |= np.where(a[:, i] >= 0, _U(1) << _U(i), _U(0))
    of = np.searchsorted(known, b)
    of = np.where(known[np.minimum(of, len(known) - 1)] == b, of, len(known))
    top = _U(1) << np.maximum(n - 1, 0).astype(np.uint64)
    one = _U(1)
    more, less = np.full(len(a), ~_U(0)), np.zeros(len(a), np.uint64)
    diagonal, before, score = np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint64), n.copy()
    for j in range(b.shape[1]):
        same = np.where(b[:, j] >= 0, there[each, of[:, j]], _U(0))
        swapped = (((~diagonal) & same) << one) & before
        diagonal = (((same & more) + more) ^ more) | same | less | swapped
        up, down = less | ~(diagonal | more), diagonal & more
        live = j < m
        score += ((up & top) != 0) & live
        score -= ((down & top) != 0) & live
        up, down = (up << one) | one, down << one
        more, less, before = down | ~(diagonal | up), diagonal & up, same
    return np.where(n == 0, m, score)


def swap_distances(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """Edits, where two neighbours that changed places are one."""
    short = np.fromiter((len(a) <= 64 for a in left), bool, len(left))
    out = np.zeros(len(left))
    for kernel, some in ((_bits, np.flatnonzero(short)), (lambda a, b: _rows(a, b, None, True), np.flatnonzero(~short))):
        if len(some):
            out[some] = in_parts(kernel, [left[k] for k in some], [right[k] for k in some])
    return out


def _matched(left: list[str], right: list[str]) -> np.ndarray:
    a, n = letters(left)
    b, m = letters(right)
    total = np.zeros(len(a))
    pair, a0, a1, b0, b1 = np.arange(len(a)), np.zeros_like(n), n, np.zeros_like(m), m
    columns = np.arange(b.shape[1])
    while True:
        open_ = (a0 < a1) & (b0 < b1)
        pair, a0, a1, b0, b1 = (x[open_] for x in (pair, a0, a1, b0, b1))
        if not len(pair):
            return total
        inside = (columns >= b0[:, None]) & (columns < b1[:, None])
        run = np.zeros((len(pair), b.shape[1]), np.int32)
        best, end_a, end_b = np.zeros(len(pair), np.int64), np.zeros_like(a0), np.zeros_like(b0)
        for i in range(int(a0.min()), int(a1.max())):
            live = ((a0 <= i) & (i < a1))[:, None] & inside & (b[pair] == a[pair, i][:, None])
            run[:, 1:] = run[:, :-1] + 1
            run[:, 0] = 1
            run[~live] = 0
            at = run.argmax(axis=1)
            size = run[np.arange(len(pair)), at]
            longer = size > best
            best[longer], end_a[longer], end_b[longer] = size[longer], i + 1, at[longer] + 1
        np.add.at(total, pair, best)
        found = best > 0
        pair, a0, a1, b0, b1, best, end_a, end_b = (x[found] for x in (pair, a0, a1, b0, b1, best, end_a, end_b))
        pair, a0, a1, b0, b1 = np.tile(pair, 2), np.concatenate((a0, end_a)), np.concatenate((end_a - best, a1)), np.concatenate((b0, end_b)), np.concatenate((end_b - best, b1))


def matched_letters(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """Letters in the matching blocks of each pair."""
    return in_parts(_matched, left, right)


def shares(costs: np.ndarray, left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """1 less the cost by the longer length; two empty strings are alike."""
    longest = np.fromiter((max(len(a), len(b), 1) for a, b in zip(left, right)), float, len(left))
    return np.maximum(0, 1 - costs / longest)


def ratios(left: Sequence[str], right: Sequence[str]) -> np.ndarray:
    """Twice the matched letters by all letters; 1 for two empty strings."""
    both = np.fromiter((len(a) + len(b) for a, b in zip(left, right)), float, len(left))
    return np.where(both == 0, 1.0, 2 * matched_letters(left, right) / np.maximum(both, 1))


def token_measures(left: Sequence[Sequence[str]], right: Sequence[Sequence[str]], alike: Callable[[list[str], list[str]], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """coverage and alignment of word lists by `alike` (0 to 1) of words: every word of the left takes in turn the best free
    word of the right, the sum by the longer list; and the mean of words at equal places, 0 for lists of unequal length.
    Distinct pairs of words are compared once in a batch."""
    number: dict[tuple[str, str], int] = {}
    wide, high = max(map(len, right), default=0), max(map(len, left), default=0)
    at = np.full((len(left), max(1, high), max(1, wide)), -1, np.int64)
    for k, (a, b) in enumerate(zip(left, right)):
        at[k, : len(a), : len(b)] = [[number.setdefault((x, y), len(number)) for y in b] for x in a] if a and b else 0
        if not a or not b:
            at[k] = -1
    words = list(number)
    scores = np.append(alike([x for x, _ in words], [y for _, y in words]) if words else [], -1.0)
    table = scores[at]
    free, coverage = table.copy(), np.zeros(len(left))
    for i in range(table.shape[1]):
        best = free[:, i].argmax(axis=1)
        value = free[np.arange(len(left)), i, best]
        coverage += np.maximum(value, 0)
        taken = value > 0
        free[taken, :, best[taken]] = -1
    n, m = (np.fromiter(map(len, x), np.int64, len(left)) for x in (left, right))
    places = np.arange(min(table.shape[1:]))
    same = np.where(n == m, np.maximum(table[:, places, places], 0).sum(axis=1) / np.maximum(n, 1), 0.0)
    return coverage / np.maximum(np.maximum(n, m), 1), same
