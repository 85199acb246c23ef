"""The manifest against a plain tree, and its SQL."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from fieldlab.llm import manifest

DATA = "/root/testdata/sf0.001"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def value(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(nodes, arity):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k : k + arity]) for k in range(0, len(levels[-1]), arity)])
    return levels


def walk(levels, at, arity):
    out = []
    for level in levels[:-1]:
        first = at // arity * arity
        out.append((level[first:at], level[at + 1 : first + arity]))
        at //= arity
    return out


def brute(rows, arity=8):
    """rows: doc_id, source, lang, n_chars, text."""
    lower = str.maketrans(manifest.UPPER, manifest.LOWER)
    by = {}
    for r in rows:
        tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        shown = (*r[:4], r[4] and r[4].translate(lower)) if tampered else r
        leaf = H(*map(value, r))
        by.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf, H(*map(value, shown)), r[0]))
    groups = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(by[g])], arity) for g in groups}
    top = tree([trees[g][-1][0] for g in groups], arity)
    out = []
    for place, g in enumerate(groups):
        for rank, (_, _, leaf, shown, doc_id) in enumerate(sorted(by[g])):
            path = walk(trees[g], rank, arity) + walk(top, place, arity)
            node = shown
            for left, right in path:
                node = H(*left, node, *right)
            out.append((doc_id, leaf, trees[g][-1][0], top[-1][0], H(*(d for p in path for side in p for d in side)), node, node == top[-1][0]))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, digest string, rank long, place string, `group` string, path string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, "p", "g", "x") for r in rows], SCHEMA)


def query(spark, docs, monkeypatch):
    monkeypatch.setattr(manifest, "table", lambda *_: docs)
    return sorted(map(tuple, manifest.op12_manifest(spark, "").collect()), key=repr)


ODD = [(None, None, None, None, None), (None, None, None, None, None), (0, "", "", 0, ""), (1, "s", "en", 3, "Ab:C"), (1, "s", "en", 3, "Ab:C"), (1, "s", "en", 3, "other"), (2, "é", "é", 1, "É" * 60_000), (7, None, "zz", None, "ABC")]


@pytest.mark.parametrize("n, langs", [(0, 1), (1, 1), (8, 1), (9, 1), (65, 1), (600, 3), (40, 30), (300, 90)])
def test_sizes(spark, monkeypatch, n, langs):
    rows = [(k, f"s{k % 3}", None if k % langs == 2 else f"l{k % langs}", k, f"Text {k} ABC" if k % 5 else None) for k in range(n)]
    assert query(spark, frame(spark, rows), monkeypatch) == brute(rows)


@pytest.mark.parametrize("small", [0, manifest.SMALL_ROWS])
def test_odd_rows(spark, monkeypatch, small):
    monkeypatch.setattr(manifest, "SMALL_ROWS", small)
    rows = ODD + [(100 + k, "s", "en" if k % 3 else "de", k, f"T{k}") for k in range(200)]
    assert query(spark, frame(spark, rows), monkeypatch) == brute(rows)


def test_repeated_rows(spark, monkeypatch):
    rows = [(5, "s", "en", 1, "Same")] * 150 + [(k, "s", "de", 1, "x") for k in range(20)]
    assert query(spark, frame(spark, rows), monkeypatch) == brute(rows)


def test_requested_leaves_only(spark):
    rows = [(k, "s", f"l{k % 11}" if k % 2 else "hot", k, f"T{k}") for k in range(400)]
    held = manifest.build(manifest.leaves(frame(spark, rows)), arity=3)
    every = {(r.group, r.rank): r for r in manifest.prove(held).collect()}
    assert len(every) == 400
    asked = [("hot", 0), ("hot", 199), ("l1", 3), ("l9", 0), ("nowhere", 0), ("hot", 10_000)]
    got = manifest.prove(held, spark.createDataFrame(asked, "group string, rank int"))
    assert {(r.group, r.rank): r for r in got.collect()} == {k: every[k] for k in asked if k in every}
    assert manifest.prove(held).where(manifest.folded(F.col("leaf"), F.col("path")) != held.root).count() == 0


def test_query_equals_sql(spark):
    got = sorted(map(tuple, manifest.op12_manifest(spark, DATA).collect()))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    assert got == sorted(duck.sql(manifest.OP12_SQL).fetchall())
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text")
    assert got == brute(list(map(tuple, docs.collect())))
