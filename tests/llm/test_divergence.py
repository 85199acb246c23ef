"""The source audit against a plain double loop, and its SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from fieldlab.llm import divergence

DATA = "/root/testdata/sf0.001"
PATTERN = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=3, top=200):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = PATTERN.findall((text or "").translate(LOWER))
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in docs:
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        groups = {s: of for (k, s), of in counts.items() if k == lang}
        whole = sum(groups.values(), Counter())

        def shares(of, kept=kept):
            total = sum(of[t] for t in kept) + len(kept)
            return {t: 1 + divergence.SCALE * (of[t] + 1) // total for t in kept}

        q = shares(whole)
        p = {s: shares(of) for s, of in groups.items()}
        for s in groups:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode()) for o in groups if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -v, k) for k, (v, item) in enumerate(found, 1)]
    return sorted(out)


SCHEMA = "text string, lang string, source string, term string, `count` long, block int, p long, doc_id long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, 2, 3, 4) for r in rows], SCHEMA)


def got(df):
    return sorted(map(tuple, df.collect()))


def made(n, sources, seed=0):
    draw = random.Random(seed)
    words = [f"W{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyzéßцλ'[k // 100 % 10]}" for k in range(1000)]
    return [(" ".join(draw.choices(words[: 50 + 13 * (k % 70)], k=draw.randrange(40))), draw.choice(["en", "de", None]), f"s{k % sources}" if k % 3 else "hot") for k in range(n)]


ODD = [(None, None, None), (None, None, "x"), ("", "en", None), ("123 !!", "en", "a"), ("solo", "fr", "only"), ("rare words here", "fr", "two"), ("Ab aB É é", "xx", "a"), ("AB ab é É", "xx", "b"), ("ab É [ab] ab_ab", "xx", "c"), ("ab é", "xx", "c"), ("漢字 " * 40_000, "zh", "a"), ("漢字 語", "zh", "b"), ("漢字 語", "zh", "b"), ("漢字 語", "zh", "b")]


def test_odd_rows(spark):
    assert got(divergence.audit(frame(spark, ODD))) == brute(ODD)
    assert got(divergence.audit(frame(spark, []))) == []


@pytest.mark.parametrize("sizes", [(8, 2048, 300_000), (2, 16, 10), (1, 1000, 1)])
def test_cells(spark, monkeypatch, sizes):
    for name, value in zip(("SOURCE_BLOCK", "TERM_BLOCK", "HELD"), sizes):
        monkeypatch.setattr(divergence, name, value)
    rows = made(400, 9) + ODD
    assert got(divergence.audit(frame(spark, rows).repartition(5), top=7)) == brute(rows, top=7)


def test_large_counts_are_exact(spark):
    df = spark.createDataFrame([(9_000_000_000_000_000, 9_000_000_000_123_457, 77)], "c long, t long, v long")
    assert df.select(divergence.share(df.c, df.t, df.v)).first()[0] == 1 + divergence.SCALE * 9_000_000_000_000_001 // 9_000_000_000_123_534


def test_query_equals_sql(spark):
    rows = got(divergence.op13_divergence(spark, DATA))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    assert rows == sorted(duck.sql(divergence.OP13_SQL).fetchall())
    assert rows == brute([tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text", "lang", "source").collect()])
