"""Understanding of messages as batch jobs: catalogue, fuzzy matches and decisions, corrections, intents, follow-ups, learning.

Messages that name entities are requests made of the part table (`requests`): each names a part, with an edit where its key
says so, since the given conversations hold invented prose; intents and follow-ups run on the conversations."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlab.functions import similarity as s
from fieldlab.operators import matching
from fieldlab.sources.shared import stage
from fieldlab.sources.tables import table

#: Counted rows that are sent to all tasks at most.
SENT = 100_000
ALIAS_SCORES = {"name": 0.99, "alias": 0.94, "abbreviation": 0.86, "surname": 0.78}


def alias_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with the texts that stand for them: name, the name without blanks, its initials with the size of the entity,
    the last word. A text that stands for an entity twice counts by its best kind; an entity is a distinct name."""
    parts = table(spark, sf_dir, "part").groupBy("p_name").agg(F.min("p_partkey").alias("id"))
    low = F.lower(F.trim("p_name"))
    w = F.split(low, " ")
    kinds = [("name", low), ("alias", F.regexp_replace(low, " ", "")), ("abbreviation", F.concat(F.array_join(F.transform(w, lambda x: F.substring(x, 1, 1)), ""), F.length(low))), ("surname", F.element_at(w, -1))]
    rows = parts.select("id", F.explode(F.array(*[F.struct(a.alias("alias"), F.lit(k).alias("kind"), F.lit(ALIAS_SCORES[k]).alias("score")) for k, a in kinds])).alias("x")).select("id", "x.*")
    return rows.groupBy("id", "alias").agg(F.max_by("kind", "score").alias("kind"), F.max("score").alias("score"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """msg_id, text, said (the name as it is said): a request for each part; two of three names have an edit (a letter left
    out, two swapped), at a place that the key gives."""
    k, n = F.col("p_partkey"), F.col("p_name")
    at = (k % (F.length(n) - 1) + 1).cast("int")
    left = F.expr("concat(substring(p_name, 1, at - 1), substring(p_name, at + 1))")
    swapped = F.expr("concat(substring(p_name, 1, at - 1), substring(p_name, at + 1, 1), substring(p_name, at, 1), substring(p_name, at + 2))")
    rows = table(spark, sf_dir, "part").where("length(p_name) > 2").withColumn("at", at)
    said = F.lower(F.when(k % 3 == 1, left).when(k % 3 == 2, swapped).otherwise(n))
    return rows.select(k.alias("msg_id"), F.concat(F.lit("please compare "), said, F.lit(" of "), F.lower("p_brand")).alias("text"), said.alias("said"), F.lower("p_name").alias("meant"))


def exact_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue texts that stand whole in requests: windows of up to three words meet aliases by an equi join, the best kind
    of an entity counts."""
    w = F.split("text", " ")
    windows = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda k: F.array_join(F.slice(w, k, n), " "))))
    said = requests(spark, sf_dir).select("msg_id", F.explode(F.array_distinct(windows)).alias("alias"))
    found = said.join(alias_catalog(spark, sf_dir).where("kind <> 'surname'"), "alias")
    return found.groupBy("msg_id", "id").agg(F.max("score").alias("score"), F.max_by("kind", "score").alias("kind"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asked, name: what is said and the names within three tenths of edits of it, none left out."""
    asked = requests(spark, sf_dir).select(F.col("said").alias("asked"))
    names = table(spark, sf_dir, "part").select(F.lower("p_name").alias("name")).distinct()
    return matching.similar_pairs(asked, names).select("asked", "name")


def token_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of words and lengths for every pair of what is said and a name near it."""
    a, b = F.col("asked"), F.col("name")
    found = {"edit": s.edit_similarity(a, b), "jaccard": s.token_jaccard(a, b), "overlap": s.token_overlap(a, b), "token_set": s.token_set(a, b), "token_sort": s.token_sort(a, b), "prefix": s.prefix_share(a, b), "initials": s.initials_match(a, b), "length": s.length_share(a, b)}
    return _pairs(spark, sf_dir).select("asked", "name", *[F.round(v, 6).alias(k) for k, v in found.items()])


def kernel_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Arrow kernels (swaps as one edit, keyboard, matching blocks) and their blend for every such pair."""
    a, b = F.col("asked"), F.col("name")
    rows = _pairs(spark, sf_dir).withColumns({"swap": s.swap_similarity(a, b), "keyboard": s.keyboard_similarity(a, b), "ratio": s.sequence_ratio(a, b)})
    return rows.select("asked", "name", *[F.round(c, 6).alias(c) for c in ("swap", "keyboard", "ratio")], F.round(s.blended(a, b, F.col("ratio")), 6).alias("blended"))


def fuzzy_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each said name is taken for."""
    return _rounded(matching.decide(matching.fuzzy_scores(_pairs(spark, sf_dir))))


def _rounded(decisions: DataFrame) -> DataFrame:
    return decisions.withColumns({"score": F.round("score", 6), "margin": F.round("margin", 6)})


def best_cover(segments: list, n_tokens: int, most: int = 4) -> list:
    """The segments (start, length, score, name), none overlapping and at most `most`, with the largest sum of their score
    and 0.015 a word (0.08 at most), less 0.015 for each word that none covers."""
    table_: list[list[tuple[float, tuple]]] = [[(0.0, ())] for _ in range(n_tokens + 1)]
    ends: dict[int, list] = {}
    for seg in segments:
        ends.setdefault(seg[0] + seg[1], []).append(seg)
    table_[0] = [(0.0, ())] + [(float("-inf"), ())] * most
    for at in range(1, n_tokens + 1):
        row = [(v - 0.015, used) for v, used in table_[at - 1]]
        for seg in sorted(ends.get(at, []), key=lambda x: (x[0], x[3])):
            for k in range(1, most + 1):
                value, used = table_[seg[0]][k - 1]
                value += seg[2] + min(0.08, 0.015 * seg[1])
                if value > row[k][0]:
                    row[k] = (value, (*used, seg))
        table_[at] = row
    return list(max(table_[n_tokens], key=lambda x: x[0])[1])


def corrected_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with the accepted names in place of what was said: windows of one to three words that are near a name are
    scored, the best cover of the message is chosen, and its spans are rewritten from the right.

    Messages are dealt out once, by number, and their windows stay where they are: Spark's estimates do not see how many an
    explode gives, so no join is left to them. The accepted texts go to all tasks up to SENT of them, else they are joined."""
    rows = requests(spark, sf_dir).select("msg_id", F.split("text", " ").alias("w")).repartition("msg_id")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0))), lambda k: F.struct(k.alias("start"), n.alias("n"), F.array_join(F.slice("w", k + 1, n), " ").alias("asked")))))
    windows = rows.select("msg_id", F.explode(spans).alias("x")).select("msg_id", "x.*")
    names = table(spark, sf_dir, "part").select(F.lower("p_name").alias("name")).distinct()
    taken = matching.decide(matching.fuzzy_scores(matching.similar_pairs(windows.select("asked"), names).select("asked", "name"))).where("decision = 'accepted'")
    taken = stage(taken.select("asked", "name", "score"), "taken")
    taken = F.broadcast(taken) if taken.count() <= SENT else taken.hint("merge")
    hits = windows.join(taken, "asked").groupBy("msg_id").agg(F.collect_list(F.struct("start", "n", "score", "name")).alias("hits"))  # a few for each message

    @F.pandas_udf("string")
    def rewrite(words_: pd.Series, hits_: pd.Series) -> pd.Series:
        out = []
        for ws, hs in zip(words_, hits_):
            ws = list(ws)
            segments = [] if hs is None else [(h["start"], h["n"], h["score"], h["name"]) for h in hs]
            for start, n, _, name in sorted(best_cover(segments, len(ws)), reverse=True):
                ws[start : start + n] = [name]
            out.append(" ".join(ws))
        return pd.Series(out)

    return rows.join(hits.hint("merge"), "msg_id", "left").select("msg_id", rewrite("w", "hits").alias("text"))


# --- intents

#: kind, pattern, intent, weight: a phrase or word stands alone, a set needs all its words, a prefix begins the message.
RULES = [
    ("phrase", "in the", "locate", 4.0), ("phrase", "of the", "define", 3.0), ("word", "what", "ask", 3.0), ("word", "that", "define", 1.5), ("word", "with", "compare", 2.0), ("word", "was", "history", 2.5),
    ("set", "the and", "compare", 2.0), ("set", "for is", "locate", 1.5), ("prefix", "th", "define", 1.0), ("prefix", "was", "history", 2.0), ("regex", "[0-9]+", "count", 3.0), ("word", "not", "define", -2.0), ("word", "es", "locate", -1.0),
]
PRECEDENCE = ("count", "ask", "compare", "history", "locate", "define")


def _message(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+", " "))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", low.alias("low"), F.array_distinct(F.split(low, " ")).alias("w"))


def _rule_met(kind: str, pattern: str) -> Column:
    if kind in ("phrase", "word"):
        return F.contains(F.concat(F.lit(" "), "low", F.lit(" ")), F.lit(f" {pattern} "))
    if kind == "set":
        return F.size(F.array_intersect("w", F.array(*[F.lit(p) for p in pattern.split()]))) == len(pattern.split())
    return F.col("low").startswith(pattern) if kind == "prefix" else F.col("low").rlike(pattern)


def _nets() -> Column:
    """Array of (intent, net, rules) of the intents that a message has evidence for; all within its own row."""
    out = []
    for intent in PRECEDENCE:
        met = [(_rule_met(k, p).cast("int"), w) for k, p, i, w in RULES if i == intent]
        net, rules = reduce(lambda x, y: x + y, [m * F.lit(w) for m, w in met]), reduce(lambda x, y: x + y, [m for m, _ in met])
        out.append(F.when(rules > 0, F.struct(F.lit(intent).alias("intent"), net.alias("net"), rules.cast("long").alias("rules"))))
    return F.array_compact(F.array(*out))


def rule_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net weight of the rules by message and intent: all rules are tried in one pass over the message's row, no shuffle."""
    return _message(spark, sf_dir).select("conv_id", "turn", F.explode(_nets()).alias("x")).select("conv_id", "turn", "x.*")


def _with_intent(rows: DataFrame) -> DataFrame:
    """rows with the intent of each message, its score and confidence; null without evidence. No shuffle."""
    rank = lambda x: F.array_position(F.array(*[F.lit(p) for p in PRECEDENCE]), x["intent"])
    score = lambda net: 1 - F.exp(-F.greatest(net, F.lit(0.0)) / 10)
    ordered = F.array_sort(F.transform("nets", lambda x: F.struct((-x["net"]).alias("back"), rank(x).alias("rank"), x.alias("of"))))
    rows = rows.withColumn("nets", _nets()).withColumn("ranked", ordered)
    best, second = F.get("ranked", F.lit(0))["of"], F.get("ranked", F.lit(1))["of"]
    rows = rows.withColumns({"intent": best["intent"], "top": score(best["net"]), "next": F.coalesce(score(second["net"]), F.lit(0.0)), "met": best["rules"]})
    confidence = F.least(0.30 + 0.48 * F.col("top") + 0.18 * (F.col("top") - F.col("next")) + F.when(F.col("met") > 1, 0.05).otherwise(0.0), F.lit(0.99))
    known = F.col("intent").isNotNull()
    rows = rows.withColumns({"score": F.when(known, F.round("top", 6)), "confidence": F.when(known, F.round(confidence, 6))})
    return rows.drop("nets", "ranked", "top", "next", "met")


def intent_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The intent of each message: saturated net weights, ties by precedence; confidence .30 + .48 of the top, .18 of its
    margin, .05 with two rules, at most .99."""
    return _with_intent(_message(spark, sf_dir)).where("intent IS NOT NULL").select("conv_id", "turn", "intent", "score", "confidence")


def intent_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a message: length, words, flags, and the net weight of each intent (0 without evidence)."""
    of = lambda i: F.coalesce(F.get(F.filter("nets", lambda x: x["intent"] == i), F.lit(0))["net"], F.lit(0.0)).alias(i)
    rows = _message(spark, sf_dir).withColumn("nets", _nets())
    return rows.select("conv_id", "turn", F.length("low").alias("length"), F.size("w").alias("distinct_words"), F.col("low").rlike("[0-9]").cast("double").alias("has_number"), *[of(i) for i in PRECEDENCE])


def follow_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a turn leans on those before it: reset, correction, pronoun, elliptical (up to three words), continuation, or none;
    and the last number said that it can refer to, which a reset clears and an own number replaces."""
    low = F.col("low")
    has = lambda *ws: low.rlike(r"(^| )(" + "|".join(ws) + r")( |$)")
    kind = F.when(has("stop", "reset"), "reset").when(has("no", "not", "rather"), "correction").when(has("it", "he", "that", "sie", "elle"), "pronoun").when(F.size("w") <= 3, "elliptical").when(has("and", "also", "und", "et"), "continuation").otherwise("none")
    rows = _message(spark, sf_dir).withColumns({"kind": kind, "number": F.nullif(F.regexp_extract("low", r"([0-9]+)", 1), F.lit(""))})
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = rows.withColumn("segment", F.sum((F.col("kind") == "reset").cast("int")).over(order))
    held = F.last("number", ignorenulls=True).over(Window.partitionBy("conv_id", "segment").orderBy("turn"))
    needs = F.col("kind").isin("pronoun", "elliptical", "continuation") | F.col("number").isNotNull()
    return rows.select("conv_id", "turn", "kind", F.when(needs, held).alias("number"))


def fallback_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a message goes to the fallback route, by the first rule that fits, and a quality from 0 to 100."""
    rows = _with_intent(_message(spark, sf_dir))
    reason = (
        F.when(F.col("intent").isNull(), "no_primary").when(F.col("low").rlike("(^| )explain( |$)"), "explicit_request").when(F.col("intent").isin("compare") & (F.size("w") < 8), "missing_entity")
        .when(F.col("confidence") >= 0.45, "accepted").when(F.col("confidence") < 0.38, "low_confidence").otherwise("unresolved")
    )
    quality = F.round(F.coalesce("confidence", F.lit(0.0)) * 80 + F.least(F.size("w"), F.lit(20)), 2)
    return rows.select("conv_id", "turn", reason.alias("reason"), (~reason.isin("accepted")).alias("fallback"), quality.alias("quality"))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistic that a message speaks of: of all aliases that stand in it whole, the longest, then the first by name."""
    known = [("in the", "place"), ("the", "share"), ("that", "count"), ("of the", "part"), ("an", "rate"), ("und", "sum"), ("les", "plural"), ("de la", "origin")]
    hits = F.array_compact(F.array(*[F.when(F.contains(F.concat(F.lit(" "), "low", F.lit(" ")), F.lit(f" {a} ")), F.struct(F.lit(len(a)).alias("n"), F.lit(a).alias("alias"), F.lit(c).alias("statistic"))) for a, c in known]))
    best = F.array_max(hits)
    return _message(spark, sf_dir).select("conv_id", "turn", best["alias"].alias("alias"), best["statistic"].alias("statistic")).where("alias is not null")


def guard_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages cut at 2000 characters for the guard only, whether they are blocked, and the first of four reasons."""
    low = F.lower(F.substring(F.coalesce("text", F.lit("")), 1, 2000))
    reasons = [("credential", r"\b(password|token|api key|secret)\b"), ("injection", r"\b(ignore|override|system prompt)\b"), ("contact", r"[a-z0-9.]+@[a-z0-9.]+"), ("number", r"[0-9]{7,}")]
    reason = reduce(lambda w, r: w.when(low.rlike(r[1]), r[0]), reasons[1:], F.when(low.rlike(reasons[0][1]), reasons[0][0])).otherwise("clean")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", reason.alias("reason"), (reason != "clean").alias("blocked"), (F.length(F.coalesce("text", F.lit(""))) > 2000).alias("longer"))


def training_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as examples to learn from: quality, whether they need review (below 60), and every reason why they failed."""
    rows = _with_intent(_message(spark, sf_dir))
    c = F.col
    failed = F.array_compact(F.array(
        F.when(c("intent").isNull(), "no_intent"), F.when(c("confidence") < 0.4, "low_confidence"), F.when(F.size("w") < 3, "too_short"), F.when(F.size("w") > 60, "too_long"),
        F.when(~c("low").rlike("[a-z]"), "no_words"), F.when((c("role") != "user") & (c("intent") == "ask"), "wrong_speaker"),
    ))
    quality = F.least(35 + F.when(c("intent").isNotNull(), 10).otherwise(0) + F.when(F.size("w") > 20, 15).otherwise(5) + F.when(c("low").rlike("[0-9]"), 10).otherwise(0), F.lit(95))
    return rows.select("conv_id", "turn", quality.alias("quality"), (quality < 60).alias("review"), F.array_join(failed, ",").alias("failed"))


def alias_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that were said for a name and are not the name, with how often: what a catalogue may learn."""
    rows = requests(spark, sf_dir).where("said <> meant")
    return rows.groupBy(F.col("said").alias("alias"), F.col("meant").alias("canonical")).agg(F.count(F.lit(1)).alias("used"))


def request_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a request is about by what stands in it exactly (entity, brand, nothing), what is missing, and a confidence."""
    named = exact_mentions(spark, sf_dir).groupBy("msg_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("score"))
    rows = requests(spark, sf_dir).join(named, "msg_id", "left")
    n = F.coalesce("n", F.lit(0))
    scope = F.when(n > 1, "comparison").when(n == 1, "entity").when(F.contains("text", F.lit("brand#")), "brand").otherwise("none")
    missing = F.when(n == 0, "entity").when(n == 1, "second_entity").otherwise("")
    confidence = 0.30 + F.when(n > 0, 0.15).otherwise(0.0) + 0.10 * F.coalesce("score", F.lit(0.0)) + F.when(F.contains("text", F.lit("compare")), 0.20).otherwise(0.0)
    return rows.select("msg_id", scope.alias("scope"), missing.alias("missing"), F.floor(confidence * 100 + 1e-9).cast("int").alias("percent"))


QUERIES = {f.__name__: f for f in (
    alias_catalog, exact_mentions, token_similarities, kernel_similarities, fuzzy_decisions, corrected_requests, rule_evidence, intent_decisions, intent_vector, follow_ups, fallback_decisions, vocabulary, guard_classes,
    training_examples, alias_candidates, request_scopes,
)}

_CATALOG = """names AS (SELECT lower(p_name) AS low, min(p_partkey) AS id FROM part GROUP BY 1), cat0 AS (SELECT id, low AS alias, 'name' AS kind, 0.99e0 AS score FROM names UNION ALL SELECT id, replace(low, ' ', ''), 'alias', 0.94e0 FROM names
    UNION ALL SELECT id, array_to_string(list_transform(string_split(low, ' '), lambda x: x[1]), '') || length(low), 'abbreviation', 0.86e0 FROM names UNION ALL SELECT id, string_split(low, ' ')[-1], 'surname', 0.78e0 FROM names),
    cat AS (SELECT id, alias, arg_max(kind, score) AS kind, max(score) AS score FROM cat0 GROUP BY 1, 2)"""
_REQUESTS = """r0 AS (SELECT *, (p_partkey % (length(p_name) - 1) + 1)::INT AS p FROM part WHERE length(p_name) > 2), req AS (SELECT p_partkey AS msg_id, lower(p_name) AS meant, lower(CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN substr(p_name, 1, p - 1) || substr(p_name, p + 1)
    ELSE substr(p_name, 1, p - 1) || substr(p_name, p + 1, 1) || substr(p_name, p, 1) || substr(p_name, p + 2) END) AS said, lower(p_brand) AS brand FROM r0), msg AS (SELECT *, 'please compare ' || said || ' of ' || brand AS text FROM req)"""
_MENTIONS = f"""{_REQUESTS}, {_CATALOG}, win AS (SELECT DISTINCT msg_id, alias FROM (SELECT msg_id, unnest(w) AS alias FROM (SELECT msg_id, string_split(text, ' ') AS w FROM msg) UNION ALL SELECT msg_id, unnest(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) FROM (SELECT msg_id, string_split(text, ' ') AS w FROM msg)
    UNION ALL SELECT msg_id, unnest(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) FROM (SELECT msg_id, string_split(text, ' ') AS w FROM msg))),
    mention AS (SELECT msg_id, id, max(score) AS score, arg_max(kind, score) AS kind FROM win JOIN cat USING (alias) WHERE kind <> 'surname' GROUP BY 1, 2)"""
_LOW = "low0 AS (SELECT conv_id, turn, role, text, trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')) AS low FROM conversations), lows AS (SELECT *, ' ' || low || ' ' AS s, list_distinct(string_split(low, ' ')) AS w FROM low0)"
_RULES = f"""{_LOW}, ev0 AS (SELECT conv_id, turn, 'locate' AS intent, 4e0 AS weight FROM lows WHERE contains(s, ' in the ') UNION ALL SELECT conv_id, turn, 'define', 3 FROM lows WHERE contains(s, ' of the ') UNION ALL SELECT conv_id, turn, 'ask', 3 FROM lows WHERE contains(s, ' what ')
    UNION ALL SELECT conv_id, turn, 'define', 1.5 FROM lows WHERE contains(s, ' that ') UNION ALL SELECT conv_id, turn, 'compare', 2 FROM lows WHERE contains(s, ' with ') UNION ALL SELECT conv_id, turn, 'history', 2.5 FROM lows WHERE contains(s, ' was ')
    UNION ALL SELECT conv_id, turn, 'compare', 2 FROM lows WHERE contains(s, ' the ') AND contains(s, ' and ') UNION ALL SELECT conv_id, turn, 'locate', 1.5 FROM lows WHERE contains(s, ' for ') AND contains(s, ' is ') UNION ALL SELECT conv_id, turn, 'define', 1 FROM lows WHERE low LIKE 'th%'
    UNION ALL SELECT conv_id, turn, 'history', 2 FROM lows WHERE low LIKE 'was%' UNION ALL SELECT conv_id, turn, 'count', 3 FROM lows WHERE regexp_matches(low, '[0-9]') UNION ALL SELECT conv_id, turn, 'define', -2 FROM lows WHERE contains(s, ' not ') UNION ALL SELECT conv_id, turn, 'locate', -1 FROM lows WHERE contains(s, ' es ')),
    ev AS (SELECT conv_id, turn, intent, sum(weight) AS net, count(*) AS rules FROM ev0 GROUP BY 1, 2, 3)"""
_INTENT = f"""{_RULES}, sc AS (SELECT *, 1 - exp(-greatest(net, 0) / 10) AS score, list_position(['count', 'ask', 'compare', 'history', 'locate', 'define'], intent) AS rank FROM ev),
    pl AS (SELECT *, row_number() OVER t AS place, lead(score) OVER t AS next FROM sc WINDOW t AS (PARTITION BY conv_id, turn ORDER BY net DESC, rank)),
    dec AS (SELECT conv_id, turn, intent, round(score, 6) AS score, round(least(0.3e0 + 0.48e0 * score + 0.18e0 * (score - coalesce(next, 0)) + CASE WHEN rules > 1 THEN 0.05e0 ELSE 0 END, 0.99), 6) AS confidence FROM pl WHERE place = 1)"""
_J = "list_distinct(string_split(asked, ' '))", "list_distinct(string_split(name, ' '))"
ORACLE_SQL = {
    "alias_catalog": f"WITH {_CATALOG} SELECT * FROM cat",
    "exact_mentions": f"WITH {_MENTIONS} SELECT msg_id, id, score, kind FROM mention",
    "token_similarities": f"""WITH {_REQUESTS}, p AS (SELECT DISTINCT said AS asked, lower(p_name) AS name FROM req, part WHERE 10 * levenshtein(said, lower(p_name)) <= 3 * greatest(length(said), length(p_name))),
        q AS (SELECT *, {_J[0]} AS x, {_J[1]} AS y FROM p), z AS (SELECT *, len(list_intersect(x, y)) AS n, len(list_distinct(list_concat(x, y))) AS u, array_to_string(list_sort(list_filter(string_split(asked, ' '), lambda t: t <> '')), ' ') AS a, array_to_string(list_sort(string_split(name, ' ')), ' ') AS b FROM q)
        SELECT asked, name, round(1 - levenshtein(asked, name) / greatest(length(asked), length(name)), 6) AS edit, round(n / u, 6) AS jaccard, round(n / least(len(x), len(y)), 6) AS overlap, round(0.45e0 * n / u + 0.55e0 * n / least(len(x), len(y)), 6) AS token_set,
        round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) AS token_sort, round(len(list_filter(range(1, least(length(asked), length(name)) + 1), lambda k: asked[1:k] = name[1:k])) / least(length(asked), length(name)), 6) AS prefix,
        (array_to_string(list_transform(list_filter(string_split(asked, ' '), lambda t: t <> ''), lambda t: t[1]), '') = array_to_string(list_transform(string_split(name, ' '), lambda t: t[1]), ''))::INT::DOUBLE AS initials, round(least(length(asked), length(name)) / greatest(length(asked), length(name)), 6) AS length FROM z""",
    "rule_evidence": f"WITH {_RULES} SELECT * FROM ev",
    "intent_decisions": f"WITH {_INTENT} SELECT * FROM dec",
    "intent_vector": f"""WITH {_RULES} SELECT conv_id, turn, length(low) AS length, len(w)::INT AS distinct_words, regexp_matches(low, '[0-9]')::INT::DOUBLE AS has_number, {', '.join(f"coalesce((SELECT net FROM ev WHERE ev.conv_id = lows.conv_id AND ev.turn = lows.turn AND intent = '{i}'), 0) AS {i}" for i in PRECEDENCE)} FROM lows""",
    "follow_ups": f"""WITH {_LOW}, k AS (SELECT conv_id, turn, CASE WHEN regexp_matches(s, ' (stop|reset) ') THEN 'reset' WHEN regexp_matches(s, ' (no|not|rather) ') THEN 'correction' WHEN regexp_matches(s, ' (it|he|that|sie|elle) ') THEN 'pronoun' WHEN len(w) <= 3 THEN 'elliptical' WHEN regexp_matches(s, ' (and|also|und|et) ') THEN 'continuation' ELSE 'none' END AS kind,
        nullif(regexp_extract(low, '[0-9]+'), '') AS number FROM lows), g AS (SELECT *, sum((kind = 'reset')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS seg FROM k)
        SELECT conv_id, turn, kind, CASE WHEN number IS NOT NULL OR kind IN ('pronoun', 'elliptical', 'continuation') THEN last_value(number IGNORE NULLS) OVER (PARTITION BY conv_id, seg ORDER BY turn) END AS number FROM g""",
    "fallback_decisions": f"""WITH {_INTENT}, f AS (SELECT l.conv_id, l.turn, CASE WHEN intent IS NULL THEN 'no_primary' WHEN contains(s, ' explain ') THEN 'explicit_request' WHEN intent = 'compare' AND len(w) < 8 THEN 'missing_entity' WHEN confidence >= 0.45 THEN 'accepted' WHEN confidence < 0.38 THEN 'low_confidence' ELSE 'unresolved' END AS reason,
        round(coalesce(confidence, 0) * 80 + least(len(w), 20), 2) AS quality FROM lows l LEFT JOIN dec USING (conv_id, turn)) SELECT conv_id, turn, reason, reason <> 'accepted' AS fallback, quality FROM f""",
    "vocabulary": f"""WITH {_LOW}, v(alias, statistic) AS (VALUES ('in the', 'place'), ('the', 'share'), ('that', 'count'), ('of the', 'part'), ('an', 'rate'), ('und', 'sum'), ('les', 'plural'), ('de la', 'origin'))
        SELECT conv_id, turn, arg_max(alias, (length(alias), alias)) AS alias, arg_max(statistic, (length(alias), alias)) AS statistic FROM lows JOIN v ON contains(s, ' ' || alias || ' ') GROUP BY 1, 2""",
    "guard_classes": """WITH x AS (SELECT conv_id, turn, lower(substr(coalesce(text, ''), 1, 2000)) AS t, length(text) AS n FROM conversations), y AS (SELECT *, CASE WHEN regexp_matches(t, '\\b(password|token|api key|secret)\\b') THEN 'credential' WHEN regexp_matches(t, '\\b(ignore|override|system prompt)\\b') THEN 'injection'
        WHEN regexp_matches(t, '[a-z0-9.]@[a-z0-9.]') THEN 'contact' WHEN regexp_matches(t, '[0-9]{7}') THEN 'number' ELSE 'clean' END AS reason FROM x) SELECT conv_id, turn, reason, reason <> 'clean' AS blocked, coalesce(n, 0) > 2000 AS longer FROM y""",
    "training_examples": f"""WITH {_INTENT}, f AS (SELECT l.*, intent, confidence, least(35 + CASE WHEN intent IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN len(w) > 20 THEN 15 ELSE 5 END + CASE WHEN regexp_matches(low, '[0-9]') THEN 10 ELSE 0 END, 95)::INT AS quality FROM lows l LEFT JOIN dec USING (conv_id, turn))
        SELECT conv_id, turn, quality, quality < 60 AS review, concat_ws(',', CASE WHEN intent IS NULL THEN 'no_intent' END, CASE WHEN confidence < 0.4 THEN 'low_confidence' END, CASE WHEN len(w) < 3 THEN 'too_short' END, CASE WHEN len(w) > 60 THEN 'too_long' END, CASE WHEN NOT regexp_matches(low, '[a-z]') THEN 'no_words' END,
        CASE WHEN role <> 'user' AND intent = 'ask' THEN 'wrong_speaker' END) AS failed FROM f""",
    "alias_candidates": f"WITH {_REQUESTS} SELECT said AS alias, meant AS canonical, count(*) AS used FROM req WHERE said <> meant GROUP BY 1, 2",
    "request_scopes": f"""WITH {_MENTIONS}, n AS (SELECT msg_id, count(*) AS n, max(score) AS score FROM mention GROUP BY 1) SELECT msg_id, CASE WHEN n > 1 THEN 'comparison' WHEN n = 1 THEN 'entity' ELSE 'brand' END AS scope, CASE WHEN n > 1 THEN '' WHEN n = 1 THEN 'second_entity' ELSE 'entity' END AS missing,
        floor((0.5e0 + CASE WHEN n > 0 THEN 0.15e0 + 0.1e0 * score ELSE 0 END) * 100 + 1e-9)::INT AS percent FROM msg LEFT JOIN n USING (msg_id)""",
}
