"""Fuzzy matching and corrections against brute force."""

import random
import time
from difflib import SequenceMatcher

import numpy as np

from fieldlab.functions import kernels, similarity
from fieldlab.operators import matching
from fieldlab.plans import understanding

DATA = "/root/testdata/sf0.001"


def swaps(a, b):
    """The same cost by recursion over ends."""
    seen = {}

    def cost(i, j):
        if (i, j) not in seen:
            if not i or not j:
                seen[i, j] = i + j
            else:
                out = [cost(i - 1, j) + 1, cost(i, j - 1) + 1, cost(i - 1, j - 1) + (a[i - 1] != b[j - 1])]
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    out.append(cost(i - 2, j - 2) + 1)
                seen[i, j] = min(out)
        return seen[i, j]

    return cost(len(a), len(b))


def keyboard(a, b):
    """Plain rows of the table with a neighbour's cost."""
    row = [float(j) for j in range(len(b) + 1)]
    where = {c: (r, i) for r, keys in enumerate(kernels.KEYS) for i, c in enumerate(keys)}
    near = lambda x, y: x in where and y in where and abs(where[x][0] - where[y][0]) <= 1 and abs(where[x][1] - where[y][1]) <= 1
    for i, x in enumerate(a, 1):
        now = [float(i)]
        for j, y in enumerate(b, 1):
            cost = 0 if x == y else kernels.NEIGHBOUR if near(x, y) else 1
            now.append(min(now[-1] + 1, row[j] + 1, row[j - 1] + cost))
        row = now
    return row[-1]


def strings(n, seed, most):
    r = random.Random(seed)
    one = lambda: "".join(r.choice("abcdqwe é漢") for _ in range(r.randint(0, most)))
    return [one() for _ in range(n)], [one() for _ in range(n)]


def test_costs():
    a, b = strings(10_000, 9, 9)
    assert kernels.swap_distances(a, b).tolist() == [swaps(x, y) for x, y in zip(a, b)]
    assert np.allclose(kernels.keyboard_distances(a, b), [keyboard(x, y) for x, y in zip(a, b)])
    assert np.allclose(kernels.ratios(a, b), [SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b)])
    assert np.allclose(kernels.keyboard_distances(["cat", "cat"], ["vat", "pat"]), [0.35, 1])
    a, b = strings(60, 4, 150)  # longer than a word of bits, and of very unequal lengths
    a[0], b[1] = "", "x" * 3000
    assert kernels.swap_distances(a, b).tolist() == [swaps(x, y) if len(x) < 3000 > len(y) else kernels.keyboard_distances([x], [y], 1.0)[0] for x, y in zip(a, b)]
    assert np.allclose(kernels.ratios(a, b), [SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b)])
    assert kernels.ratios([], []).tolist() == []


def test_costs_take_a_batch_at_a_time():
    a, b = strings(3000, 2, 30)
    plain = time.perf_counter()
    for x, y in zip(a[:100], b[:100]):
        keyboard(x, y)
    plain = (time.perf_counter() - plain) * 30
    batch = time.perf_counter()
    kernels.swap_distances(a, b)
    assert time.perf_counter() - batch < plain / 5  # much more, on a machine at rest


def test_words():
    alike = lambda x, y: np.array([float(p == q) if p[0] != "z" else 0.5 for p, q in zip(x, y)])
    left, right = [["a", "b"], ["a", "a"], [], ["z", "a"], ["a"]], [["b", "a"], ["a", "c"], ["a"], ["a", "b"], ["b", "a"]]
    coverage, alignment = kernels.token_measures(left, right, alike)
    assert coverage.tolist() == [1.0, 0.5, 0.0, 0.25, 0.5] and alignment.tolist() == [0.0, 0.5, 0.0, 0.25, 0.0]


def test_kernels(spark):
    rows = spark.createDataFrame([("abcd", "abdc"), ("", ""), ("", "x"), (None, "x"), ("red ring", "ring red")], "a string, b string")
    similarity.register(spark)
    rows.createOrReplaceTempView("pairs_of_strings")
    got = {(r.a, r.b): tuple(r)[2:] for r in spark.sql("SELECT a, b, swap_similarity(a, b), keyboard_similarity(a, b), sequence_ratio(a, b) FROM pairs_of_strings").collect()}
    spark.catalog.dropTempView("pairs_of_strings")
    assert got["abcd", "abdc"][0] == 0.75 and got["", ""] == (1, 1, 1) and got["", "x"] == (0, 0, 0) and got[None, "x"] == (None,) * 3
    assert rows.where("a = 'red ring'").select(similarity.token_sort(rows.a, rows.b)).first()[0] == 1


def test_cover():
    segments = [(0, 1, 0.8, "a"), (0, 2, 0.95, "ab"), (1, 1, 0.9, "b"), (3, 1, 0.7, "d")]
    chosen = understanding.best_cover(segments, 5)
    best, most = None, -1e9
    for mask in range(16):
        some = [s for k, s in enumerate(segments) if mask >> k & 1]
        cells = [x for s in some for x in range(s[0], s[0] + s[1])]
        if len(cells) == len(set(cells)):
            value = sum(s[2] + min(0.08, 0.015 * s[1]) for s in some) - 0.015 * (5 - len(cells))
            best, most = (some, value) if value > most else (best, most)
    assert sorted(chosen) == sorted(best) and understanding.best_cover([], 3) == []


def test_similar_pairs_are_all_found(spark):
    r = random.Random(5)
    base = ["".join(r.choice("abcde ") for _ in range(r.randint(1, 40))) for _ in range(60)] + ["a", "ab", "aaaa", "aaaaaaaaaaaa", "é" * 9, "x" * 80]
    def edited(t):
        for _ in range(r.randint(0, 1 + len(t) // 3)):
            at = r.randrange(len(t) + 1)
            t = t[:at] + r.choice(["", "z", "a", "é"]) + t[at + r.randint(0, 1) :]
        return t
    asked = [edited(t) for t in base for _ in range(3)] + [None, ""]
    frames = spark.createDataFrame([(t,) for t in asked], "asked string"), spark.createDataFrame([(t,) for t in [*base, None, "", base[0]]], "name string")
    every = [(a, b) for a in set(asked) if a for b in set(base)]
    cost = kernels.keyboard_distances([a for a, _ in every], [b for _, b in every], 1.0)
    want = {(a, b) for (a, b), d in zip(every, cost) if 10 * d <= 3 * max(len(a), len(b))}
    for hot in (4096, 9):
        got = [(x.asked, x.name) for x in matching.similar_pairs(*frames, hot=hot).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_parts_of_the_score(spark):
    rows = [("corbin carroll", "corbin carroll"), ("corbin carol", "corbin carroll"), ("carroll corbin", "corbin carroll"), ("cc", "corbin carroll"), ("the", "theo"), ("", "x"), (None, "x")]
    got = {r.asked: r for r in matching.fuzzy_scores(spark.createDataFrame(rows, "asked string, name string")).collect()}
    assert abs(sum(matching.WEIGHTS.values()) - 1) < 1e-9 and got["corbin carroll"].score == 1
    assert got["corbin carol"].parts.token_alignment > 0.8 and got["corbin carol"].parts.coverage > 0.8 and got["corbin carol"].score > 0.85
    assert got["carroll corbin"].parts.token_sort == 1 and got["carroll corbin"].parts.coverage == 1
    assert got["cc"].parts.initials == 1 and got["the"].score < 0.6 and got[""].score == 0 and got[None].score is None
    plain = lambda a, b: SequenceMatcher(None, a, b, autojunk=False).ratio()
    partial = max(plain("corbin carol", "corbin carroll"[k : k + 12]) for k in range(3))
    assert abs(got["corbin carol"].parts.partial - partial) < 1e-9 and abs(got["corbin carol"].parts.sequence - plain("corbin carol", "corbin carroll")) < 1e-9


def test_decisions_and_corrections(spark):
    said = {r.msg_id: r for r in understanding.requests(spark, DATA).collect()}
    found = {r.asked: r for r in understanding.fuzzy_decisions(spark, DATA).collect()}
    names = {r.meant for r in said.values()}
    right = [found[r.said].name == r.meant for r in said.values() if r.said not in names]
    assert sum(right) >= 0.9 * len(right) and all(found[n].name == n and found[n].score == 1 for n in names & set(found))
    pairs = {(r.asked, r.name) for r in understanding.kernel_similarities(spark, DATA).select("asked", "name").collect()}
    assert {(r.said, r.meant) for r in said.values()} <= pairs  # blocking loses none
    texts = {r.msg_id: r.text for r in understanding.corrected_requests(spark, DATA).collect()}
    mended = [f"please compare {r.meant} of " in texts[k] for k, r in said.items()]
    changed = [m for m, (k, r) in zip(mended, said.items()) if texts[k] != f"please compare {r.said} of " + texts[k].split(" of ")[-1]]
    assert len(texts) == len(said) and sum(mended) >= 0.75 * len(mended) and sum(changed) >= 0.95 * len(changed)  # short or doubtful names stay


def test_windows_of_requests_are_not_sent_to_all_tasks(spark):
    """No side of an explode, whose rows no estimate counts, is broadcast: only the counted accepted texts are."""
    plan = understanding.corrected_requests(spark, DATA)._jdf.queryExecution().executedPlan().toString().split("\n")
    sent = [k for k, line in enumerate(plan) if "BroadcastExchange" in line]
    depth = lambda k: len(plan[k]) - len(plan[k].lstrip(" :+-"))
    for k in sent:
        below = [line for j, line in enumerate(plan[k + 1 :], k + 1) if all(depth(i) > depth(k) for i in range(k + 1, j + 1))]
        assert not any("Generate" in line for line in below)
    assert len(sent) == 1
