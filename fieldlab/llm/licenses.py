"""License scans by patience alignment.

Text and template are compared as words. Anchors are words that occur once in the text's range and once in the
template's; the longest run of anchors that rises in both is kept, equal words next to an anchor join it, and the gaps
between anchors are aligned the same way; a gap without anchors is aligned by its longest common words, if it is of the
order of the template's gap (SPREAD + 1 times it and SLACK at most), else left alone. Coverage is the
share of the template's words that are aligned, density the share of the span's words that are aligned; the span runs from
the first to the last aligned word of the text.

Where a template is looked for:

* A notice of a few words names its license by one or two of them, so those (REQUIRED) must be aligned: every place of the
  first of them is an anchor, and what stands before and after it, up to SPREAD words for each word of the notice, is
  aligned to the notice's two sides.
* A longer template is found by its anchors: the words that stand once in it. Where at least ANCHORED of them stand close
  enough in the text, chains of anchors are formed that rise in both and whose steps in the text are at most SPREAD + 1
  times those in the template; the best chain (most anchors, less a little for foreign words in between) carries a hit,
  and what stands before and after it is searched again, so every copy gives a span. Only the gaps between two anchors
  of a chain, and as much beside its ends as the template has there, are aligned further.

Spans that overlap are one passage: the template with the most aligned words has it (then the higher coverage, the
shorter span, the name), so that a license whose words another one holds doesn't give a row beside it. A document without
a span of the least coverage gives no row. Null and empty texts have no rows; repeated rows have rows each; an empty table
gives an empty one. Of the input only doc_id and text are read, whatever other columns are named.
"""

from __future__ import annotations

import json
import pkgutil
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlab.llm.common import bounded_batches, steps, table

#: Least coverage; foreign words for each word of a template, and beside them, in a gap; the share of a longer template's
#: anchors that a hit must have; anchors that foreign words cost a chain, for each anchor's worth of them.
LEAST, SPREAD, SLACK, ANCHORED, FOREIGN = 0.8, 4, 8, 0.5, 0.05
#: Notices, as fixed values.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "BSD-notice": "Released under the BSD License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MPL-2.0-notice": "Licensed under the Mozilla Public License, version 2.0.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-2.1-notice": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0-notice": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-SA-4.0-notice": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0-notice": "Licensed under CC BY-NC-ND 4.0.",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "BSD-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met"
    ),
}
#: The words that tell a notice from others of its kind, the one to search by first.
REQUIRED = {
    "MIT-notice": ["mit"],
    "BSD-notice": ["bsd"],
    "Apache-2.0-notice": ["apache", "2", "0"],
    "MPL-2.0-notice": ["mozilla", "2", "0"],
    "GPL-2.0-notice": ["gnu", "2"],
    "GPL-3.0-notice": ["gnu", "3"],
    "LGPL-2.1-notice": ["lesser", "gnu", "2", "1"],
    "LGPL-3.0-notice": ["lesser", "gnu", "3"],
    "AGPL-3.0-notice": ["affero", "gnu", "3"],
    "CC-BY-4.0-notice": ["cc", "by", "4"],
    "CC-BY-SA-4.0-notice": ["cc", "by", "sa", "4"],
    "CC-BY-ND-4.0-notice": ["cc", "by", "nd", "4"],
    "CC-BY-NC-4.0-notice": ["cc", "by", "nc", "4"],
    "CC-BY-NC-SA-4.0-notice": ["cc", "by", "nc", "sa", "4"],
    "CC-BY-NC-ND-4.0-notice": ["cc", "by", "nc", "nd", "4"],
}
#: Whole texts and the standard headers of common licenses.
TEMPLATES |= json.loads(pkgutil.get_data(__package__, "licenses.json"))
#: Cells of the table of a gap that is aligned at once; larger ones are halved first.
CELLS = 200_000_000
_WORD = re.compile(r"[a-z0-9]+")


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by their first place, that rises in the second (patience piles)."""
    tops: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for k, (_, place) in enumerate(pairs):
        pile = bisect_left(tops, place)
        if pile == len(tops):
            tops.append(place)
            ends.append(k)
        else:
            tops[pile], ends[pile] = place, k
        before.append(ends[pile - 1] if pile else -1)
    out, k = [], ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """(place in text, place in template) of the aligned words, in order."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        places: dict[str, list[int]] = {}
        for side, (start, stop, words) in enumerate(((a, b, text), (c, d, template))):
            for k in range(start, stop):
                held = places.setdefault(words[k], [0, 0, 0, 0])
                held[side] += 1
                held[2 + side] = k
        anchors = sorted((x, y) for n, m, x, y in places.values() if n == m == 1)
        x, y = a, c
        if not anchors and b - a <= (SPREAD + 1) * (d - c) + SLACK:
            out += [(a + p, c + q) for p, q in common_words(text[a:b], template[c:d])]
        for p, q in [*_rising(anchors), (b, d)] if anchors else []:
            todo.append((x, p, y, q))
            if p < b and q < d:
                out.append((p, q))
            x, y = p + 1, q + 1
    return sorted(out)


def longest_common(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """As align, but the most words that rise in both: a row of bits for each word of the text, walked back."""
    bits: dict[str, int] = {}
    for k, word in enumerate(template):
        bits[word] = bits.get(word, 0) | 1 << k
    full = (1 << len(template)) - 1
    rows = [full]  # a bit of a row is 0 where one more word of the template is reached
    for word in text:
        row = rows[-1]
        same = row & bits.get(word, 0)
        rows.append(((row + same) | (row - same)) & full)
    out, k = [], len(template) - 1
    for x in range(len(text) - 1, -1, -1):
        while k >= 0 and rows[x + 1] >> k & 1:
            k -= 1
        if k < 0:
            break
        if rows[x] >> k & 1:
            out.append((x, k))
            k -= 1
    return out[::-1]


def common_words(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """longest_common in bounded memory: a large table is halved at the middle of the text, at the place of the template
    where both halves together reach the most words."""
    known = set(template)
    places = [k for k, word in enumerate(text) if word in known]
    words = [text[k] for k in places]
    if len(words) * len(template) <= CELLS or len(words) < 2:
        return [(places[x], y) for x, y in longest_common(words, template)]
    half, n = len(words) // 2, len(template)
    before = _reached(words[:half], template)
    after = _reached(words[half:][::-1], template[::-1])[::-1]
    cut = int(np.argmax(before + after))
    low = common_words(words[:half], template[:cut])
    high = common_words(words[half:], template[cut:n])
    return [(places[x], y) for x, y in low] + [(places[half + x], cut + y) for x, y in high]


def _reached(text: list[str], template: list[str]) -> np.ndarray:
    """The number of common words of the text and the template's first 0, 1, ... words."""
    bits: dict[str, int] = {}
    for k, word in enumerate(template):
        bits[word] = bits.get(word, 0) | 1 << k
    full = row = (1 << len(template)) - 1
    for word in text:
        same = row & bits.get(word, 0)
        row = ((row + same) | (row - same)) & full
    zeros = 1 - np.unpackbits(np.frombuffer(row.to_bytes(len(template) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(template)]
    return np.concatenate(([0], np.cumsum(zeros)))


def number_words(templates: dict[str, list[str]]) -> tuple[dict[str, int], np.ndarray]:
    """Numbers of the templates' words, and how often each template (a row) has each; the last column is of no word."""
    number: dict[str, int] = {}
    for template in templates.values():
        for word in template:
            number.setdefault(word, len(number))
    wanted = np.zeros((len(templates), len(number) + 1), np.int64)
    for row, template in zip(wanted, templates.values()):
        np.add.at(row, [number[w] for w in template], 1)
    return number, wanted


def _anchored(words: list[str], places: list[int], template: list[str], required: list[str], need: int) -> list[list[tuple[int, int]]]:
    """Alignments of a notice around each place of its first required word, with all required words."""
    at = template.index(required[0])
    out = []
    once = template.count(required[0]) == 1  # then the neighbouring places belong to other notices
    for k, p in enumerate(places):
        start, stop = max(0, p - SPREAD * at), min(len(words), p + 1 + SPREAD * (len(template) - at - 1))
        if once:
            start = max(start, places[k - 1] + 1 if k else 0)
            stop = min(stop, places[k + 1] if k + 1 < len(places) else len(words))
        before = _nearest(words[start:p], template[:at])
        after = _nearest(words[p + 1 : stop][::-1], template[at + 1 :][::-1])
        pairs = [(start + x, y) for x, y in before] + [(p, at)] + [(stop - 1 - x, len(template) - 1 - y) for x, y in after[::-1]]
        if len(pairs) >= need and {template[y] for _, y in pairs}.issuperset(required):
            out.append(pairs)
    return out


def _nearest(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """The alignment of a side of a notice: by anchors if they reach all of it, else its longest common words, the last ones."""
    pairs = align(text, template)
    return pairs if len(pairs) == len(template) else longest_common(text, template)


def _dense(places: list[int], marks: list[int], least: int, width: int) -> list[tuple[int, int]]:
    """Ranges of the anchors (indices) in which, within `width` words of the text, `least` different ones stand."""
    held: Counter[int] = Counter()
    out: list[list[int]] = []
    first = 0
    for k, mark in enumerate(marks):
        held[mark] += 1
        while places[k] - places[first] >= width:
            held[marks[first]] -= 1
            if not held[marks[first]]:
                del held[marks[first]]
            first += 1
        if len(held) >= least:
            if out and first < out[-1][1]:
                out[-1][1] = k + 1
            else:
                out.append([first, k + 1])
    return [(a, b) for a, b in out]


def _chain(places: np.ndarray, marks: np.ndarray, each: float) -> list[int]:
    """The best chain of anchors: indices. `each`: template words to an anchor."""
    n = len(places)
    score, before = np.ones(n), np.full(n, -1)
    starts = np.searchsorted(places, places - (SPREAD + 1) * marks - SLACK)  # no step is longer
    for k in range(n):
        a = starts[k]
        step, rise = places[k] - places[a:k], marks[k] - marks[a:k]
        fits = np.flatnonzero((rise > 0) & (step <= (SPREAD + 1) * rise + SLACK))
        if len(fits):
            reached = score[a:k][fits] - FOREIGN / each * np.maximum(step[fits] - rise[fits], 0)
            best = int(reached.argmax())
            if reached[best] > 0:
                score[k], before[k] = reached[best] + 1, a + fits[best]
    out, k = [], int(score.argmax()) if n else -1
    while k >= 0:
        out.append(k)
        k = int(before[k])
    return out[::-1]


def _filled(words: list[str], template: list[str], chain: list[tuple[int, int]], start: int, stop: int) -> list[tuple[int, int]]:
    """The chain's anchors with what is aligned between them and beside its ends, within the text's range."""
    out = list(chain)
    for (x, y), (u, v) in zip(chain, chain[1:]):
        out += [(x + 1 + p, y + 1 + q) for p, q in align(words[x + 1 : u], template[y + 1 : v])]
    (x, y), (u, v) = chain[0], chain[-1]
    a = max(start, x - (SPREAD + 1) * y - SLACK)
    out += [(a + p, q) for p, q in _nearest(words[a:x], template[:y])]
    rest = template[v + 1 :]
    b = min(stop, u + 1 + (SPREAD + 1) * len(rest) + SLACK)
    out += [(b - 1 - p, len(template) - 1 - q) for p, q in _nearest(words[u + 1 : b][::-1], rest[::-1])]
    return sorted(out)


def _copies(words: list[str], anchors: tuple[np.ndarray, np.ndarray], template: list[str], n_anchors: int, need: int) -> list[list[tuple[int, int]]]:
    """Alignments of a longer template; no two share a word of the text. anchors: their places in text and template."""
    least = max(1, int(np.ceil(ANCHORED * n_anchors)))
    places, marks = anchors
    width = (SPREAD + 1) * len(template) + SLACK
    out, todo = [], [(0, len(words), a, b) for a, b in _dense(places.tolist(), marks.tolist(), least, width)]
    while todo:
        start, stop, a, b = todo.pop()
        if b - a < least or len(np.unique(marks[a:b])) < least:
            continue
        found = [a + k for k in _chain(places[a:b], marks[a:b], len(template) / n_anchors)]
        if len(found) < least:
            continue
        pairs = _filled(words, template, [(int(places[k]), int(marks[k])) for k in found], start, stop)
        first, last = pairs[0][0], pairs[-1][0]
        if len(pairs) >= need and last - first < width:
            out.append(pairs)
        for low, high in ((start, first), (last + 1, stop)):
            c, d = np.searchsorted(places[a:b], [low, high]) + a
            todo.append((low, high, int(c), int(d)))
    return out


def scan(
    text: str,
    templates: dict[str, list[str]],
    least: float = LEAST,
    numbered: tuple[dict[str, int], np.ndarray] | None = None,
    required: dict[str, list[str]] = REQUIRED,
) -> list[tuple[str, float, int, int, float]]:
    """(license, coverage, first, end in characters, density) of every passage that a template covers by `least`, in order."""
    low = text.lower()
    number, wanted = numbered or number_words(templates)
    spans = [m.span() for m in _WORD.finditer(low)]
    words = [low[a:b] for a, b in spans]
    codes = np.fromiter((number.get(w, len(number)) for w in words), np.int64, len(words))
    there, often = np.unique(codes, return_counts=True)
    shared = np.minimum(wanted[:, there], often).sum(axis=1)
    found = []
    for row, (name, template) in enumerate(templates.items()):
        need = max(1, int(np.ceil(least * len(template) - 1e-9)))
        if shared[row] < need:
            continue
        if required.get(name):
            marks = [number[w] for w in required[name]]
            if not all((there == m).any() for m in marks):
                continue
            hits = _anchored(words, np.flatnonzero(codes == marks[0]).tolist(), template, required[name], need)
        else:
            once = wanted[row] == 1
            at = np.flatnonzero(once[codes])
            order = {number[w]: k for k, w in enumerate(template) if once[number[w]]}
            if (wanted[row][there] == 1).sum() < ANCHORED * len(order):
                continue
            hits = _copies(words, (at, np.fromiter((order[c] for c in codes[at].tolist()), np.int64, len(at))), template, len(order), need)
        found += [(-len(p), -len(p) / len(template), p[-1][0] - p[0][0], name, p[0][0], p[-1][0]) for p in hits]
    kept = [(name, -cover, spans[a][0], spans[b][1], -n / (b - a + 1)) for n, cover, _, name, a, b in _apart(found)]
    return sorted(kept, key=lambda x: x[2:])


def _apart(found: list[tuple]) -> list[tuple]:
    """The best of the spans, and of the others those that share no word with a better one."""
    kept: list[tuple] = []
    firsts: list[int] = []
    for hit in sorted(found):
        a, b = hit[4:]
        k = bisect_left(firsts, a)
        if (k == 0 or kept[k - 1][5] < a) and (k == len(kept) or kept[k][4] > b):
            kept.insert(k, hit)
            firsts.insert(k, a)
    return kept


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """doc_id, license, coverage, start, end, density of every passage of every row that a template covers. No shuffle."""
    split = {name: _WORD.findall(t.lower()) for name, t in (TEMPLATES if templates is None else templates).items()}
    numbered = number_words(split)
    bounded_batches(docs.sparkSession)
    names = ["doc_id", "license", "coverage", "start", "end", "density"]
    kinds = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.float64())

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = [(ids[k], *hit) for a, b in steps(texts) for k in range(a, b) for hit in scan(texts[k], split, least, numbered)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "doc_id long, license string, coverage double, start int, end int, density double")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of the whole texts of `documents` that a template covers: doc_id, license, coverage, start, end,
    density; nulls, repeats and empty tables as the module says."""
    return scan_licenses(table(spark, sf_dir, "documents"))
