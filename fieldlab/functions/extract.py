"""What a message says besides names, as expressions of its text: question type, season, limit, day, times, bounds, comparison,
negation, clauses; outcomes in one spelling; and searches by words. Null texts are empty ones: nothing is found in them.

Those that take `low` take the plain text as a column of its own (`withColumn("low", plain(text))`), so that it is made
once for a message and not for every pattern."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes of questions, times, bounds, words of comparison and negation, ends of clauses, short names of
# outcomes, and phrases that a search leaves out.
QUESTIONS = {
    "why": "why_question", "how many": "quantity_question", "how much": "quantity_question", "how likely": "probability_question", "what are the chances": "probability_question", "what is the chance": "probability_question",
    "will": "probability_question", "can": "probability_question", "does": "probability_question", "is": "yes_no_question", "are": "yes_no_question", "when": "when_question", "what time": "when_question", "where": "where_question",
    "which": "which_question", "who": "who_question", "what": "what_question", "show": "command", "list": "command", "compare": "comparison_command", "explain": "explanation_command", "predict": "prediction_command",
}
NO_QUESTION = "statement_or_command"
SHORT_FORMS = {"what's": "what is", "whats": "what is", "who's": "who is", "cant": "cannot", "won't": "will not", "wont": "will not", "n't": " not"}
TIMES = {
    "today": ("today", "tonight", "this evening"), "tomorrow": ("tomorrow", "tomorrow night"), "yesterday": ("yesterday", "last night"), "this_week": ("this week", "current week"), "next_week": ("next week",), "this_month": ("this month",),
    "this_season": ("this season", "current season"), "career": ("career", "all time"), "last_game": ("last game", "most recent game"), "next_game": ("next game", "upcoming game"),
}
DAYS = {"today": 0, "tonight": 0, "tomorrow": 1, "yesterday": -1}
BOUNDS = {"over": "over", "under": "under", "at least": "at_least", "at most": "at_most", "more than": "greater_than", "less than": "less_than", "exactly": "exactly"}
COMPARISONS = ("compare", "versus", "vs", "who is better", "who is more likely", "difference between", "which is better")
NEGATIONS = ("not", "dont", "don't", "do not", "without", "exclude", "excluding", "except")
CLAUSE_END = r"(?i)\s*(?:;|\band then\b|\bthen\b|\balso\b|\bplus\b|\bbut\b)\s*"
LIMITS, LIMIT_WORDS, MOST_ROWS = ("last", "top", "show"), {"five": 5, "ten": 10, "fifteen": 15, "twenty": 20, "thirty": 30}, 200
OUTCOMES = {
    "hr": "home_run", "homer": "home_run", "homerun": "home_run", "so": "strikeout", "k": "strikeout", "bb": "walk", "xbh": "extra_base_hit", "on_base": "reach_base", "total_base": "total_bases", "win": "team_win", "runs_scored": "team_runs",
}
#: The workbench's spelling: plurals too, and a run is one that is scored.
WORKBENCH_OUTCOMES = {
    "hr": "home_run", "homer": "home_run", "homerun": "home_run", "home_runs": "home_run", "hits": "hit", "singles": "single", "doubles": "double", "triples": "triple", "walks": "walk", "bb": "walk", "so": "strikeout", "k": "strikeout",
    "ks": "strikeout", "strikeouts": "strikeout", "runs": "run_scored", "run": "run_scored", "runs_scored": "run_scored", "tb": "total_bases", "total_base": "total_bases", "xbh": "extra_base_hit", "on_base": "reach_base",
}
LEFT_OUT = ("search for", "search", "look up", "lookup", "find", "show", "player", "players", "who is", "tell me about")
YEAR, NUMBER = r"\b((?:19|20)\d{2})\b", r"\s+([0-9]+(?:\.[0-9]+)?)\b"


def _latin() -> tuple[str, str]:
    """Latin letters with marks, and those without."""
    bare = {chr(k): unicodedata.normalize("NFKD", chr(k))[0] for k in range(0xC0, 0x250)}
    kept = {k: v for k, v in bare.items() if v.isascii() and v.isalpha() and all(unicodedata.combining(x) for x in unicodedata.normalize("NFKD", k)[1:])}
    return "".join(kept), "".join(kept.values())


def without_marks(text: Column) -> Column:
    """Latin letters without their accents; marks that stand by themselves are dropped."""
    return F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), *_latin()), r"\p{M}", "")


def plain(text: Column) -> Column:
    """Without accents, in lower case, & as and, words of letters, digits, + and . with one blank between."""
    low = F.regexp_replace(F.replace(F.lower(without_marks(text)), F.lit("&"), F.lit(" and ")), r"[^a-z0-9+.]+", " ")
    return F.trim(low)


def _words(phrase: str) -> str:
    return "".join(x if x.isalnum() or x == " " else " " for x in phrase.lower())


def has_any(low: Column, phrases: Sequence[str]) -> Column:
    """Whether one of the phrases stands in a plain text, no letter or digit beside it: one pattern for all."""
    return low.rlike(f"(^|[^a-z0-9])({'|'.join(map(_words, phrases))})([^a-z0-9]|$)")


def question_text(text: Column) -> Column:
    """The plain text with short forms written out."""
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("’"), F.lit("'")))
    return plain(reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), SHORT_FORMS.items(), low))


def question_type(text: Column, prefixes: dict[str, str] = QUESTIONS) -> Column:
    """By the longest prefix of whole words; short forms are written out first."""
    longest = sorted(prefixes, key=lambda p: (-len(p), p))
    found = F.regexp_extract(question_text(text), f"^({'|'.join(longest)})( |$)", 1)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in prefixes.items() for x in kv])[found], F.lit(NO_QUESTION))


def season(low: Column) -> Column:
    """The first year from 1900 to 2099, null without one."""
    return F.nullif(F.regexp_extract(low, YEAR, 1), F.lit("")).cast("int")


def row_limit(low: Column) -> Column:
    """How many are asked for: after last, top or show in this order, from 1 to 200; else a number word after last."""
    told = F.coalesce(*[F.nullif(F.regexp_extract(low, rf"\b{w}\s+(\d{{1,3}})\b", 1), F.lit("")).cast("int") for w in LIMITS])
    return F.coalesce(F.when(told > MOST_ROWS, MOST_ROWS).when(told < 1, 1).otherwise(told), *[F.when(has_any(low, [f"last {w}"]), n) for w, n in LIMIT_WORDS.items()])


def relative_day(low: Column, today: Column) -> Column:
    """The day that is meant from today's on, null without one."""
    return F.coalesce(*[F.when(has_any(low, [w]), F.date_add(today, n)) for w, n in DAYS.items()])


def times(low: Column) -> Column:
    """The times that are named, then every year once as year:2023."""
    named = F.array(*[F.when(has_any(low, ws), F.lit(k)) for k, ws in TIMES.items()])
    years = F.transform(F.array_distinct(F.regexp_extract_all(low, F.lit(YEAR), F.lit(1))), lambda y: F.concat(F.lit("year:"), y))
    return F.concat(F.array_compact(named), years)


def bounds(low: Column) -> Column:
    """Array of (operator, value) by the order of BOUNDS, then of the text."""
    one = lambda words, name: F.transform(F.regexp_extract_all(low, F.lit(rf"\b{words}{NUMBER}"), F.lit(1)), lambda v: F.struct(F.lit(name).alias("operator"), v.cast("double").alias("value")))
    return F.concat(*[one(words, name) for words, name in BOUNDS.items()])


def is_comparison(low: Column) -> Column:
    return has_any(low, COMPARISONS)


def is_negated(low: Column) -> Column:
    return has_any(low, NEGATIONS)


def clauses(text: Column) -> Column:
    """The clauses in order, blanks and commas around them taken off; the whole text where it has but ends; none of nothing."""
    whole = F.trim(F.coalesce(text, F.lit("")))
    parts = F.filter(F.transform(F.split(whole, CLAUSE_END), lambda p: F.btrim(p, F.lit(" ,"))), lambda p: p != "")
    return F.when(whole == "", F.array().cast("array<string>")).when(F.size(parts) == 0, F.array(whole)).otherwise(parts)


def canonical_outcome(said: Column, names: dict[str, str] = OUTCOMES, default: str = "hit", allowed: Sequence[str] | None = None) -> Column:
    """Lower case, hyphens and blanks as underscores, short names resolved; the default for nothing, and for what is not allowed."""
    key = F.regexp_replace(F.lower(F.trim(F.coalesce(said, F.lit("")))), "[- ]", "_")
    found = F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[key], key)
    known = found != "" if allowed is None else found.isin(*allowed)
    return F.when(known, found).otherwise(default)


def match_score(name: Column, asked: str) -> Column:
    """100 equal, 98 equal without blanks and marks, 90 containing, 86 so without blanks and marks, 78 all words, 70 any word; null
    for none, and for nothing asked."""
    low, words = plain(name), [w for w in asked.lower().split() if w]
    if not words:
        return F.lit(None).cast("int")
    tight = lambda x: F.regexp_replace(x, "[^a-z0-9]", "")
    whole, together = " ".join(words), "".join(x for x in asked.lower() if x.isascii() and x.isalnum())
    hits = [F.contains(low, F.lit(w)) for w in words]
    close = F.when(low == whole, 100).when((tight(low) == together) & F.lit(together != ""), 98).when(F.contains(low, F.lit(whole)), 90).when(F.contains(tight(low), F.lit(together)) & F.lit(together != ""), 86)
    return close.when(reduce(lambda a, b: a & b, hits), 78).when(reduce(lambda a, b: a | b, hits), 70)


def search_words(asked: str) -> list[str]:
    """The words of a search, without those phrases that only say that it is one."""
    low = f" {' '.join(asked.lower().split())} "
    for phrase in LEFT_OUT:
        while f" {phrase} " in low:
            low = low.replace(f" {phrase} ", " ")
    return low.split()


def found_by_words(asked: str, key: Column, fields: Sequence[Column]) -> Column:
    """Whether a row meets a search: a number is its key; else every word stands in one of the fields, in any case; where nothing
    but phrases is left, the whole search in the first field. An empty search meets all rows."""
    asked = " ".join(asked.split())
    if asked.removeprefix("-").isdigit():
        return F.coalesce(key == int(asked), F.lit(False))
    low = [F.lower(F.coalesce(f, F.lit(""))) for f in fields]
    words = search_words(asked)
    if not words:
        return F.contains(low[0], F.lit(asked.lower()))
    any_field = lambda w: reduce(lambda a, b: a | b, [F.contains(f, F.lit(w)) for f in low])
    return reduce(lambda a, b: a & b, [any_field(w) for w in words])
