"""Message and entity queries over conversations, parts and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlab.operators.matching import similar_pairs
from fieldlab.sources.tables import table

#: Whole words that stand for an intent, with weights, as fixed values of this demonstration catalogue.
RULES = [("the", "define", 2.0), ("what", "question", 3.0), ("that", "define", 1.0), ("for", "request", 2.0), ("with", "request", 1.5), ("are", "question", 1.0), ("les", "define", 2.0), ("der", "define", 2.0), ("dans", "request", 1.5)]
PRONOUNS = ("he", "it", "that", "il", "er", "elle")
BLOCKED = "(?i)(password|token|secret|api key)"
QUESTIONS = [("what", "what"), ("who", "who"), ("the", "statement"), ("of", "fragment")]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def phonetic_key(text: Column) -> Column:
    """Letters that sound alike made equal, vowels after the first letter dropped, runs made one."""
    key = F.regexp_replace(F.lower(text), "[^a-z]", "")
    for pattern, to in (("ph", "f"), ("ck", "k"), ("q", "k"), ("[xz]", "s")):
        key = F.regexp_replace(key, pattern, to)
    rest = F.regexp_replace(F.substring(key, 2, 1_000_000), "[aeiouy]", "")
    return F.regexp_replace(F.concat(F.substring(key, 1, 1), rest), r"(.)\1+", "$1")


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def message_extractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, first four-digit year, first number, question type by prefix, clauses, and whether a message is guarded."""
    text = F.coalesce("text", F.lit(""))
    low = F.lower(F.trim(text))
    kind = F.lit("other")
    for prefix, name in reversed(QUESTIONS):
        kind = F.when(low.startswith(prefix), name).otherwise(kind)
    return _messages(spark, sf_dir).select(
        "conv_id",
        "turn",
        F.size(tokens(F.col("text"))).alias("n_tokens"),
        F.nullif(F.regexp_extract(text, r"\b(20\d\d)\b", 1), F.lit("")).alias("year"),
        F.nullif(F.regexp_extract(text, r"(\d+)", 1), F.lit("")).alias("number"),
        kind.alias("question_type"),
        F.size(F.split(text, r"[.;\n]+")).alias("clauses"),
        text.rlike(BLOCKED).alias("guarded"),
    )


def intent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule weights summed by message and intent: tokens meet the rules by an equi join; score 1 - e^(-s/10), rank, and
    the margin to the next intent."""
    rules = F.broadcast(spark.createDataFrame(RULES, "token string, intent string, weight double"))
    words = _messages(spark, sf_dir).select("conv_id", "turn", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    summed = words.join(rules, "token").groupBy("conv_id", "turn", "intent").agg(F.sum("weight").alias("weight"))
    best = Window.partitionBy("conv_id", "turn").orderBy(F.desc("weight"), "intent")
    score = 1 - F.exp(-F.col("weight") / 10)
    return summed.select("conv_id", "turn", "intent", F.round(score, 6).alias("score"), F.row_number().over(best).alias("place"), F.round(score - F.lead(score).over(best), 6).alias("margin"))


def exact_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue entities that documents name. The catalogue is made of the tables: the first words of the benchmark's
    passages (names of six letters and more), and brands and kinds of parts; a name has the score .99. Words of whole texts
    and names meet by an equi join; the catalogue is sent out only where it has been counted small."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("token")).where("length(token) >= 6")
    parts = table(spark, sf_dir, "part").select(F.explode(F.array_distinct(tokens(F.concat_ws(" ", "p_brand", "p_type")))).alias("token"))
    names = words.unionByName(parts).groupBy("token").agg(F.count(F.lit(1)).alias("named"))
    names = F.broadcast(names) if names.count() <= 100_000 else names
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    return docs.join(names, "token").select("doc_id", "token", "named", F.lit(0.99).alias("score"))


def lev_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names without their third character back to catalogue names, as the query's SQL has it: blocked by the first
    two characters, scored by edit similarity, accepted at 0.7 with the best first. `lev_match_all` loses no pair."""
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    typo = F.concat(F.substring("p_name", 1, 2), F.substring("p_name", 4, 1000))
    asked = names.select(typo.alias("asked"), F.substring("p_name", 1, 2).alias("block")).distinct()
    pairs = asked.join(names.withColumn("block", F.substring("p_name", 1, 2)), "block")
    score = 1 - F.levenshtein("asked", "p_name") / F.greatest(F.length("asked"), F.length("p_name"))
    best = Window.partitionBy("asked").orderBy(F.desc("score"), "p_name")
    found = pairs.withColumn("score", score).withColumn("place", F.row_number().over(best)).withColumn("margin", F.col("score") - F.lead("score").over(best))
    return found.where("place = 1 and score >= 0.7").select("asked", "p_name", F.round("score", 6).alias("score"), F.round(F.coalesce("margin", F.lit(1.0)), 6).alias("margin"))


def lev_match_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with a character left out or replaced, at a place that the part's number gives, back to catalogue names:
    the best of all names at an edit similarity of 0.7 at least, with its margin to the next of those."""
    parts = table(spark, sf_dir, "part").where("p_name <> ''").select("p_name", F.expr("p_partkey % length(p_name)").cast("int").alias("at"), F.expr("p_partkey div length(p_name) % 2 = 0").alias("cut"))
    asked = parts.select(F.expr("concat(substring(p_name, 1, at), if(cut, '', 'q'), substring(p_name, at + 2))").alias("asked"))
    best = Window.partitionBy("asked").orderBy(F.desc("score"), "name")
    found = similar_pairs(asked, parts.select(F.col("p_name").alias("name")))
    found = found.withColumns({"place": F.row_number().over(best), "margin": F.col("score") - F.lead("score").over(best)})
    return found.where("place = 1").select("asked", F.col("name").alias("p_name"), F.round("score", 6).alias("score"), F.round(F.coalesce("margin", F.lit(1.0)), 6).alias("margin"))


def conversation_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last number and year said so far in a conversation, carried on through turns; a turn without tokens, or that says
    "stop", "reset" or "start over" as words, starts anew."""
    rows = message_extractors(spark, sf_dir)
    stops = _messages(spark, sf_dir).select("conv_id", "turn", F.lower(F.coalesce("text", F.lit(""))).rlike(r"\b(stop|reset|start over)\b").alias("stops"))
    rows = rows.join(stops, ["conv_id", "turn"])
    turn = Window.partitionBy("conv_id").orderBy("turn")
    segment = F.sum(F.when((F.col("n_tokens") == 0) | F.col("stops"), 1).otherwise(0)).over(turn)
    held = Window.partitionBy("conv_id", "segment").orderBy("turn")
    return rows.withColumn("segment", segment).select(
        "conv_id", "turn", F.last("number", ignorenulls=True).over(held).alias("number"), F.last("year", ignorenulls=True).over(held).alias("year"), F.row_number().over(held).alias("turns")
    )


def learning_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three signals of a message, exploded; importance 35 and 10 for each thing known, at most 95."""
    rows = message_extractors(spark, sf_dir)
    known = F.when(F.col("number").isNotNull(), 10).otherwise(0) + F.when(F.col("question_type") != "other", 10).otherwise(0) + F.when(F.col("n_tokens") > 20, 5).otherwise(0)
    importance = F.when(F.col("guarded"), 20).otherwise(F.least(35 + known, F.lit(95)))
    signals = F.array_compact(F.array(F.when(F.col("number").isNotNull(), "number"), F.when(F.col("question_type") != "other", "question"), F.when(F.col("guarded"), "guarded")))
    return rows.select("conv_id", "turn", importance.alias("importance"), F.explode(signals).alias("signal"))


QUERIES = {f.__name__: f for f in (message_extractors, intent_scores, exact_entities, lev_match, lev_match_all, conversation_state, learning_signals)}

_X = r"""x AS (SELECT conv_id, turn, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))::INT AS n_tokens,
    nullif(regexp_extract(coalesce(text, ''), '\b(20\d\d)\b', 1), '') AS year, nullif(regexp_extract(coalesce(text, ''), '(\d+)', 1), '') AS number,
    CASE WHEN starts_with(lower(trim(coalesce(text, ''))), 'what') THEN 'what' WHEN starts_with(lower(trim(coalesce(text, ''))), 'who') THEN 'who' WHEN starts_with(lower(trim(coalesce(text, ''))), 'the') THEN 'statement'
    WHEN starts_with(lower(trim(coalesce(text, ''))), 'of') THEN 'fragment' ELSE 'other' END AS question_type,
    len(regexp_split_to_array(coalesce(text, ''), '[.;\n]+'))::INT AS clauses, regexp_matches(coalesce(text, ''), '(?i)(password|token|secret|api key)') AS guarded FROM conversations)"""
ORACLE_SQL = {
    "message_extractors": f"WITH {_X} SELECT * FROM x",
    "intent_scores": f"""WITH r(token, intent, weight) AS (VALUES {', '.join(f"('{t}', '{i}', {w}::DOUBLE)" for t, i, w in RULES)}),
        w AS (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))) AS token FROM conversations),
        s AS (SELECT conv_id, turn, intent, sum(weight) AS weight FROM w JOIN r USING (token) GROUP BY 1, 2, 3), p AS (SELECT *, 1 - exp(-weight / 10) AS score FROM s)
        SELECT conv_id, turn, intent, round(score, 6) AS score, row_number() OVER t::INT AS place, round(score - lead(score) OVER t, 6) AS margin FROM p WINDOW t AS (PARTITION BY conv_id, turn ORDER BY weight DESC, intent)""",
    "exact_entities": """WITH p AS (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS token FROM benchmark), q AS (SELECT token FROM p WHERE length(token) >= 6 UNION ALL SELECT unnest(list_distinct(regexp_extract_all(lower(p_brand || ' ' || p_type), '[a-z0-9]+'))) FROM part),
        c AS (SELECT token, count(*) AS named FROM q GROUP BY 1), d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))) AS token FROM documents) SELECT doc_id, token, named, 0.99::DOUBLE AS score FROM d JOIN c USING (token)""",
    "lev_match": """WITH n AS (SELECT DISTINCT p_name FROM part), a AS (SELECT DISTINCT substr(p_name, 1, 2) || substr(p_name, 4, 1000) AS asked, substr(p_name, 1, 2) AS block FROM n),
        p AS (SELECT asked, p_name, 1 - levenshtein(asked, p_name) / greatest(length(asked), length(p_name)) AS score FROM a JOIN n ON substr(p_name, 1, 2) = block),
        r AS (SELECT *, row_number() OVER w AS place, score - lead(score) OVER w AS margin FROM p WINDOW w AS (PARTITION BY asked ORDER BY score DESC, p_name))
        SELECT asked, p_name, round(score, 6) AS score, round(coalesce(margin, 1), 6) AS margin FROM r WHERE place = 1 AND score >= 0.7""",
    "lev_match_all": """WITH n AS (SELECT DISTINCT p_name FROM part WHERE p_name <> ''), k AS (SELECT p_name, (p_partkey % length(p_name))::INT AS pos, p_partkey // length(p_name) % 2 = 0 AS cut FROM part WHERE p_name <> ''),
        a AS (SELECT DISTINCT substr(p_name, 1, pos) || CASE WHEN cut THEN '' ELSE 'q' END || substr(p_name, pos + 2) AS asked FROM k),
        p AS (SELECT asked, p_name, levenshtein(asked, p_name) AS d, greatest(length(asked), length(p_name)) AS longer FROM a CROSS JOIN n WHERE asked <> ''),
        r AS (SELECT asked, p_name, 1 - d / longer AS score FROM p WHERE 10 * d <= 3 * longer), o AS (SELECT *, row_number() OVER w AS place, score - lead(score) OVER w AS margin FROM r WINDOW w AS (PARTITION BY asked ORDER BY score DESC, p_name))
        SELECT asked, p_name, round(score, 6) AS score, round(coalesce(margin, 1), 6) AS margin FROM o WHERE place = 1""",
    "conversation_state": f"""WITH {_X}, y AS (SELECT conv_id, turn, regexp_matches(lower(coalesce(text, '')), '\\b(stop|reset|start over)\\b') AS stops FROM conversations), g AS (SELECT *, sum((n_tokens = 0 OR stops)::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS segment FROM x JOIN y USING (conv_id, turn))
        SELECT conv_id, turn, last_value(number IGNORE NULLS) OVER w AS number, last_value(year IGNORE NULLS) OVER w AS year, row_number() OVER w::INT AS turns FROM g WINDOW w AS (PARTITION BY conv_id, segment ORDER BY turn)""",
    "learning_signals": f"""WITH {_X}, i AS (SELECT conv_id, turn, CASE WHEN guarded THEN 20 ELSE least(35 + (number IS NOT NULL)::INT * 10 + (question_type <> 'other')::INT * 10 + (n_tokens > 20)::INT * 5, 95) END::INT AS importance,
        [CASE WHEN number IS NOT NULL THEN 'number' END, CASE WHEN question_type <> 'other' THEN 'question' END, CASE WHEN guarded THEN 'guarded' END] AS s FROM x)
        SELECT * FROM (SELECT conv_id, turn, importance, unnest(s) AS signal FROM i) WHERE signal IS NOT NULL""",
}
