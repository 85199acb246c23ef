"""What is taken from messages, against plain loops, and searches by words."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from fieldlab.functions import extract as x

PIECES = ["last 5", "top 900", "show 0", "last ten", "over 2.5", "at least 3", "exactly 7", "less than 10", "today", "last night", "2021", "1999", "2021", "vs", "who is better", "don't", "except", "; and then", "also", "but", "Áé ñ", "overdue", "K", "&", "A/B-c_d", "this season", "next game", "this evening", ",", "plus"]


def plain(text):
    bare = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c)).lower().replace("&", " and ")
    return " ".join(re.sub("[^a-z0-9+.]+", " ", bare).split())


def has(low, phrase):
    return re.search(rf"(?<![a-z0-9]){re.escape(re.sub('[^a-z0-9 ]', ' ', phrase))}(?![a-z0-9])", low) is not None


def wanted(text):
    low = plain(text)
    found = [re.search(rf"\b{w}\s+(\d{{1,3}})\b", low) for w in ("last", "top", "show")]
    told = next((int(m[1]) for m in found if m), None)
    limit = max(1, min(told, 200)) if told is not None else next((n for w, n in x.LIMIT_WORDS.items() if has(low, f"last {w}")), None)
    years = re.findall(r"\b(?:19|20)\d\d\b", low)
    times = [k for k, ws in x.TIMES.items() if any(has(low, w) for w in ws)] + [f"year:{y}" for y in dict.fromkeys(years)]
    bounds = [(name, float(v)) for w, name in x.BOUNDS.items() for v in re.findall(rf"\b{w}\s+([0-9]+(?:\.[0-9]+)?)\b", low)]
    whole = (text or "").strip(" ")
    parts = [p.strip(" ,") for p in re.split(x.CLAUSE_END, whole) if p.strip(" ,")]
    clauses = (parts or [whole]) if whole else []
    return (int(years[0]) if years else None, limit, times, bounds, any(has(low, p) for p in x.COMPARISONS), any(has(low, p) for p in x.NEGATIONS), clauses)


def test_messages(spark):
    rng = random.Random(5)
    texts = [None, "", " ", ",", "; but", "\t", "word " * 30_000 + "last 7", *[" ".join(rng.choices(PIECES, k=rng.randint(1, 9))) for _ in range(400)]]
    t, low = F.col("text"), F.col("low")
    got = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, text string").withColumn("low", x.plain(t)).select("i", x.season(low), x.row_limit(low), x.times(low), x.bounds(low), x.is_comparison(low), x.is_negated(low), x.clauses(t), "low").collect()
    assert len(got) == len(texts)
    for i, year, limit, times, bounds, compares, negates, clauses, low in got:
        assert (year, limit, times, [tuple(b) for b in bounds], compares, negates, clauses) == wanted(texts[i]), texts[i][:80]
        assert low == plain(texts[i])


@pytest.mark.parametrize("text,kind", [
    ("Why not?", "why_question"), ("How much is it", "quantity_question"), ("what’s the time", "what_question"), ("What time is it", "when_question"), ("what are the chances", "probability_question"), ("whatever", x.NO_QUESTION), ("", x.NO_QUESTION),
    (None, x.NO_QUESTION), ("who's there", "who_question"), ("ISLAND", x.NO_QUESTION), ("is", "yes_no_question"), ("List all", "command"),
])
def test_question_type(spark, text, kind):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(x.question_type(F.col("t"))).first()[0] == kind


def test_days_and_outcomes(spark):
    t = F.col("t")
    df = spark.createDataFrame([("tonight",), ("Tomorrow!",), ("yesterday or today",), ("never",), (None,)], "t string")
    assert [str(r[0]) for r in df.select(x.relative_day(x.plain(t), F.lit("2024-02-29").cast("date"))).collect()] == ["2024-02-29", "2024-03-01", "2024-02-29", "None", "None"]
    said = spark.createDataFrame([(" HR",), ("home-run",), ("Total Base",), ("runs",), ("",), (None,), ("odd thing",)], "t string")
    got = said.select(x.canonical_outcome(t), x.canonical_outcome(t, x.WORKBENCH_OUTCOMES, "home_run"), x.canonical_outcome(t, default="none", allowed=["home_run"])).collect()
    assert [r[0] for r in got] == ["home_run", "home_run", "total_bases", "runs", "hit", "hit", "odd_thing"]
    assert [r[1] for r in got] == ["home_run", "home_run", "total_bases", "run_scored", "home_run", "home_run", "odd_thing"]
    assert [r[2] for r in got] == ["home_run", "home_run"] + ["none"] * 5


def test_searches(spark):
    names = [(1, "Large Bolt"), (2, "largebolt"), (3, "a large bolt x"), (4, "xlarge-bolts"), (5, "bolt, large"), (6, "bolt"), (7, ""), (8, None)]
    df = spark.createDataFrame(names, "k int, n string")
    n = F.col("n")
    assert {r[0]: r[1] for r in df.select("k", x.match_score(n, "Large  bolt")).collect()} == {1: 100, 2: 98, 3: 90, 4: 90, 5: 78, 6: 70, 7: None, 8: None}
    keys = lambda asked: [r.k for r in df.where(x.found_by_words(asked, F.col("k"), [n])).orderBy("k").collect()]
    assert keys("show players Large bolt") == [1, 2, 3, 4, 5] and keys("7") == [7] and keys("players") == [] and len(keys("")) == 8
    assert x.search_words("Who is the best player who is here") == ["the", "best", "here"]
