"""Edit similarity against brute force on a small fixture."""

import random

from fieldlab.plans import messages


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def test_similar_pairs(spark):
    r = random.Random(3)
    names = sorted({"".join(r.choice("abc ") for _ in range(r.randint(1, 16))) for _ in range(120)})
    asked = set(names[:10])
    for name in names:
        for _ in range(r.randint(1, 4)):
            k = r.choice([0, 1, r.randrange(len(name) + 1)])
            name = name[:k] + r.choice(["", "q", "qa"]) + name[k + r.randint(0, 1) :]
        asked.add(name)
    asked.discard("")
    want = {(a, b) for a in asked for b in names if 10 * _distance(a, b) <= 3 * max(len(a), len(b))}
    found = messages.similar_pairs(spark.createDataFrame([(a,) for a in asked], "asked string"), spark.createDataFrame([(b,) for b in names], "name string")).collect()
    assert len(found) == len(want) and {(x.asked, x.name) for x in found} == want
    assert any(a[0] != b[0] and a[1:2] != b[1:2] for a, b in want)
