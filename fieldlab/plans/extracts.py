"""Queries over what messages say besides names, and searches, and the SQL that gives the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlab.functions import extract as x
from fieldlab.sources.tables import table

#: How a turn begins, by its key, before its own text.
BEGIN = (
    "Who's better this season & last night, 2021 or 1999", "show me the last ten games, then top 250 but not over 2.5 runs", "Was it at least 3 or more than 1.5 tonight? Also exactly 4 plus 2", "How likely is a homer tomorrow", "explain 2021; and then list K", "What time; ,", "",
)
TODAY = "2024-05-31"
SEARCHES = ("show large bolt", "find RED", "12", "Who is ring small", "brand#2 economy", "players")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    begin = F.get(F.array(*[F.lit(b) for b in BEGIN]), ((F.col("conv_id") + F.col("turn")) % len(BEGIN)).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws("; ", begin, "text").alias("text"))


def message_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message with its question type, season, limit, day, times, bounds, and whether it compares or negates."""
    t, low = F.col("text"), F.col("low")
    held = F.array_join(F.transform(x.bounds(low), lambda b: F.concat(b["operator"], F.lit(":"), F.round(b["value"] * 100).cast("long").cast("string"))), ",")
    day = F.date_format(x.relative_day(low, F.lit(TODAY).cast("date")), "yyyy-MM-dd")
    rows = _turns(spark, sf_dir).withColumn("low", x.plain(t))
    return rows.select("conv_id", "turn", x.question_type(t).alias("question_type"), x.season(low).alias("season"), x.row_limit(low).alias("row_limit"), day.alias("day"), F.array_join(x.times(low), ",").alias("times"), held.alias("hundredths"), x.is_comparison(low).alias("compares"), x.is_negated(low).alias("negates"))


def message_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clauses of every message, each with its place, its words, its times, its flags, and its last word as an outcome."""
    rows = _turns(spark, sf_dir).select("conv_id", "turn", F.posexplode(x.clauses(F.col("text"))).alias("place", "clause"))
    rows, c = rows.withColumn("low", x.plain(F.col("clause"))), F.col("low")
    words = F.split(c, " ")
    return rows.select("conv_id", "turn", "place", "clause", F.size(F.filter(words, lambda w: w != "")).alias("words"), F.array_join(x.times(c), ",").alias("times"), x.is_comparison(c).alias("compares"), x.is_negated(c).alias("negates"), x.canonical_outcome(F.element_at(words, -1), x.WORKBENCH_OUTCOMES, "none").alias("outcome"))


def word_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that several searches meet by name, brand or kind, with the score of the name."""
    parts = table(spark, sf_dir, "part")
    fields = [F.col(n) for n in ("p_name", "p_brand", "p_type")]
    one = lambda s: F.when(x.found_by_words(s, F.col("p_partkey"), fields), F.struct(F.lit(s).alias("asked"), x.match_score(F.col("p_name"), " ".join(x.search_words(s))).alias("score")))
    hits = F.array_compact(F.array(*[one(s) for s in SEARCHES]))  # all searches in one pass over the table
    return parts.select("p_partkey", F.explode(hits).alias("hit")).select("p_partkey", "hit.asked", "hit.score")


QUERIES = {f.__name__: f for f in (message_parts, message_clauses, word_searches)}

_PLAIN = lambda t: f"trim(regexp_replace(replace(lower(strip_accents(coalesce({t}, ''))), '&', ' and '), '[^a-z0-9+.]+', ' ', 'g'))"
_ANY = lambda low, ps: "(" + " OR ".join(f"regexp_matches({low}, '(^|[^a-z0-9])" + p.replace("'", " ") + "([^a-z0-9]|$)')" for p in ps) + ")"
_begin = ", ".join("'" + b.replace("'", "''") + "'" for b in BEGIN)
_TURNS = f"t AS (SELECT conv_id, turn, concat_ws('; ', ([{_begin}])[((conv_id + turn) % {len(BEGIN)})::INT + 1], text) AS text FROM conversations)"
_times = lambda low: "array_to_string(list_concat(list_filter([" + ", ".join(f"CASE WHEN {_ANY(low, ws)} THEN '{k}' END" for k, ws in x.TIMES.items()) + f"], lambda z: z IS NOT NULL), (SELECT coalesce(list('year:' || y ORDER BY i), []) FROM (SELECT y, min(i) AS i FROM (SELECT unnest(regexp_extract_all({low}, '{x.YEAR}')) AS y, generate_subscripts(regexp_extract_all({low}, '{x.YEAR}'), 1) AS i) GROUP BY y))), ',')"
_written = reduce(lambda t, kv: f"replace({t}, '{kv[0].replace(chr(39), chr(39) * 2)}', '{kv[1]}')", x.SHORT_FORMS.items(), "lower(replace(text, '’', ''''))")
_question = " ".join(f"WHEN starts_with(q || ' ', '{p} ') THEN '{k}'" for p, k in sorted(x.QUESTIONS.items(), key=lambda v: -len(v[0])))
_told = "coalesce(" + ", ".join(rf"nullif(regexp_extract(low, '\b{w}\s+(\d{{1,3}})\b', 1), '')::INT" for w in x.LIMITS) + ")"
_bound = "list_concat(" + ", ".join(rf"list_transform(regexp_extract_all(low, '\b{w}{x.NUMBER}', 1), lambda v: '{n}:' || round(v::DOUBLE * 100)::BIGINT)" for w, n in x.BOUNDS.items()) + ")"
_hit = lambda w: f"(contains(lower(p_name), '{w}') OR contains(lower(p_brand), '{w}') OR contains(lower(p_type), '{w}'))"
ORACLE_SQL = {
    "message_parts": f"""WITH {_TURNS}, l AS (SELECT *, {_PLAIN("text")} AS low, {_PLAIN(_written)} AS q FROM t)
        SELECT conv_id, turn, CASE {_question} ELSE '{x.NO_QUESTION}' END AS question_type, nullif(regexp_extract(low, '{x.YEAR}', 1), '')::INT AS season,
        CASE WHEN {_told} IS NOT NULL THEN greatest(1, least({_told}, 200)) {" ".join(f"WHEN {_ANY('low', (f'last {w}',))} THEN {n}" for w, n in x.LIMIT_WORDS.items())} END AS row_limit,
        CASE {" ".join(f"WHEN {_ANY('low', (w,))} THEN strftime(DATE '{TODAY}' + {n}, '%Y-%m-%d')" for w, n in x.DAYS.items())} END AS day, {_times("low")} AS times, array_to_string({_bound}, ',') AS hundredths, {_ANY("low", x.COMPARISONS)} AS compares, {_ANY("low", x.NEGATIONS)} AS negates FROM l""",
    "message_clauses": f"""WITH {_TURNS}, s AS (SELECT conv_id, turn, trim(text) AS whole, list_filter(list_transform(regexp_split_to_array(trim(text), '{x.CLAUSE_END}'), lambda p: trim(p, ' ,')), lambda p: p <> '') AS ps FROM t),
        c AS (SELECT conv_id, turn, unnest(ps) AS clause, generate_subscripts(ps, 1) - 1 AS place FROM (SELECT conv_id, turn, CASE WHEN whole <> '' AND len(ps) = 0 THEN [whole] ELSE ps END AS ps FROM s)), l AS (SELECT *, {_PLAIN("clause")} AS low FROM c),
        o AS (SELECT *, regexp_extract(low, '[^ ]*$') AS o FROM l) SELECT conv_id, turn, place, clause, len(list_filter(string_split(low, ' '), lambda w: w <> '')) AS words, {_times("low")} AS times, {_ANY("low", x.COMPARISONS)} AS compares, {_ANY("low", x.NEGATIONS)} AS negates,
        CASE o {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in x.WORKBENCH_OUTCOMES.items())} WHEN '' THEN 'none' ELSE o END AS outcome FROM o""",
    "word_searches": f"""SELECT p_partkey, 'show large bolt' AS asked, CASE WHEN lower(p_name) = 'large bolt' THEN 100 WHEN contains(lower(p_name), 'large bolt') THEN 90 WHEN contains(lower(p_name), 'large') AND contains(lower(p_name), 'bolt') THEN 78 WHEN contains(lower(p_name), 'large') OR contains(lower(p_name), 'bolt') THEN 70 END AS score FROM part WHERE {_hit("large")} AND {_hit("bolt")}
        UNION ALL SELECT p_partkey, 'find RED', CASE WHEN lower(p_name) = 'red' THEN 100 WHEN contains(lower(p_name), 'red') THEN 90 END FROM part WHERE {_hit("red")} UNION ALL SELECT p_partkey, '12', CASE WHEN contains(p_name, '12') THEN 90 END FROM part WHERE p_partkey = 12
        UNION ALL SELECT p_partkey, 'Who is ring small', CASE WHEN contains(lower(p_name), 'ring small') THEN 90 WHEN contains(lower(p_name), 'ring') AND contains(lower(p_name), 'small') THEN 78 WHEN contains(lower(p_name), 'ring') OR contains(lower(p_name), 'small') THEN 70 END FROM part WHERE {_hit("ring")} AND {_hit("small")}
        UNION ALL SELECT p_partkey, 'brand#2 economy', CASE WHEN contains(lower(p_name), 'economy') THEN 70 END FROM part WHERE {_hit("brand#2")} AND {_hit("economy")} UNION ALL SELECT p_partkey, 'players', NULL FROM part WHERE contains(lower(p_name), 'players')""",
}
