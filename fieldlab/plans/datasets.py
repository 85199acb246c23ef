"""Dataset queries: targets, splits, scaling, profiles, drift, quality and calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlab.operators.ranks import medians, value_at, value_places
from fieldlab.sources.shared import with_position
from fieldlab.sources.tables import GAME_LOG_SQL, game_log, table

#: Registered targets: name and SQL of the label (null where its source is null).
TARGETS = {
    "has_hit": "cast(hits > 0 as double)",
    "multi_hit": "cast(hits >= 2 as double)",
    "has_home_run": "cast(home_runs > 0 as double)",
    "total_bases": "cast(hits + doubles + 2 * triples + 3 * home_runs as double)",
    "strikeout_count": "cast(greatest(strikeouts, 0) as double)",
}
_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def target_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return game_log(spark, sf_dir).select("player_id", "game_id", *[F.expr(text).alias(name) for name, text in TARGETS.items()])


def target_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = target_labels(spark, sf_dir).unpivot(["player_id", "game_id"], list(TARGETS), "target", "label")
    return long.groupBy("target").agg(
        F.count("label").alias("labelled"),
        F.count_if(F.col("label") >= 0.5).alias("positive"),
        F.count_if(F.col("label") < 0.5).alias("negative"),
        F.round(F.avg("label"), 6).alias("mean"),
        F.min("label").alias("least"),
        F.max("label").alias("most"),
        ((F.count_if(F.col("label") >= 0.5) >= 25) & (F.count_if(F.col("label") < 0.5) >= 25)).alias("ready"),
    )


def chrono_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 70% of orders in time train, the next 15% validate, the rest test."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    placed = with_position(orders, ["o_orderdate", "o_orderkey"], "place")
    total = orders.agg(F.count(F.lit(1)).alias("total"))
    train, check = F.floor(F.col("total") * 0.70), F.floor(F.col("total") * 0.15)
    part = F.when(F.col("place") < train, "train").when(F.col("place") < train + check, "validation").otherwise("test")
    return placed.join(F.broadcast(total)).select("o_orderkey", "place", part.alias("part"))


def season_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("season"))
    rank = F.dense_rank().over(Window.orderBy(F.desc("season")))
    seasons = orders.select("season").distinct().withColumn("back", rank)  # one row a year
    part = F.when(F.col("back") == 1, "test").when(F.col("back") == 2, "validation").otherwise("train")
    return orders.join(F.broadcast(seasons), "season").select("o_orderkey", "season", part.alias("part"))


def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds of an expanding train block, then 10% validation and 10% test, moved on by 20%: rows of each block."""
    placed = with_position(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], "place")
    total = placed.agg(F.count(F.lit(1)).alias("total"))
    step = F.floor(F.col("total") / 10)
    folds = F.broadcast(total.select(step.alias("step"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("fold")))
    start = F.col("step") * (2 + 2 * F.col("fold"))
    part = F.when(F.col("place") < start, "train").when(F.col("place") < start + F.col("step"), "validation").when(F.col("place") < start + 2 * F.col("step"), "test")
    return placed.join(folds).withColumn("part", part).where("part is not null").groupBy("fold", "part").agg(
        F.count(F.lit(1)).alias("n"), F.min("place").alias("first"), F.max("place").alias("last")
    )


def _stats(df: DataFrame, columns: list[str]) -> DataFrame:
    return F.broadcast(df.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("sd", F.stddev_pop), ("least", F.min), ("most", F.max))]))


def standard_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities and prices less their mean, by their population deviation; one row of statistics is fitted first."""
    lines, used = table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"]
    keyed = lines.join(_stats(lines, used))
    scaled = [F.round((F.col(c) - F.col(f"{c}_mean")) / F.when(F.col(f"{c}_sd") <= 1e-12, 1).otherwise(F.col(f"{c}_sd")), 6).alias(c) for c in used]
    return keyed.select("l_orderkey", "l_linenumber", *scaled)


def min_max_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    span = F.col("c_acctbal_most") - F.col("c_acctbal_least")
    return rows.join(_stats(rows, ["c_acctbal"])).select("c_custkey", F.round((F.col("c_acctbal") - F.col("c_acctbal_least")) / F.when(span <= 1e-12, 1).otherwise(span), 6).alias("scaled"))


def impute_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances below 0 count as missing and take the mean of the others."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"))
    mean = F.broadcast(rows.agg(F.avg("balance").alias("mean")))
    return rows.join(mean).select("c_custkey", F.col("balance").isNull().alias("missing"), F.round(F.coalesce("balance", "mean"), 4).alias("balance"))


def robust_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0.67448975 (x - median) / MAD of balances within a nation; 0 for fewer than 3 rows or no spread."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    sizes = rows.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    away = rows.join(medians(rows, ["c_nationkey"], "c_acctbal").join(sizes, "c_nationkey"), "c_nationkey").withColumn("far", F.abs(F.col("c_acctbal") - F.col("median")))
    mad = medians(away, ["c_nationkey"], "far", "mad")
    z = F.when((F.col("n") < 3) | (F.col("mad") < 1e-12), 0.0).otherwise(0.67448975 * (F.col("c_acctbal") - F.col("median")) / F.col("mad"))
    return away.join(mad, "c_nationkey").select("c_custkey", F.round(z, 4).alias("z"))


def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, mean, deviation, range and median of four columns; medians by places, so no column lies in one task."""
    long = table(spark, sf_dir, "lineitem").select(*_NUMBERS).unpivot([], _NUMBERS, "feature", "value")
    found = long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("value").isNull()).alias("missing"),
        F.round(F.avg("value"), 4).alias("mean"),
        F.round(F.stddev_pop("value"), 4).alias("sd"),
        F.min("value").alias("least"),
        F.max("value").alias("most"),
    )
    middle = medians(long, ["feature"], "value")
    return found.join(middle, "feature", "left").withColumn("median", F.round("median", 4))


def feature_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values, variance, and why a feature would be dropped."""
    long = table(spark, sf_dir, "lineitem").select(*_NUMBERS).unpivot([], _NUMBERS, "feature", "value")
    found = long.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("seen"), F.count_distinct("value").alias("distinct_values"), F.var_pop("value").alias("variance"))
    reason = F.when(F.col("seen") == 0, "all_missing").when(F.col("seen") < F.col("n") * 0.02, "mostly_missing").when(F.col("variance") <= 1e-12, "constant").otherwise("kept")
    return found.select("feature", "distinct_values", F.round(F.sqrt("variance"), 4).alias("deviation"), reason.alias("reason"))


def psi_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population stability of order prices of each year against 1995, over ten bins cut at every tenth place of the sorted
    1995 prices; a price above a cut moves up. 0 with fewer than ten prices to compare with."""
    orders = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("season"), F.col("o_totalprice").alias("price"))
    cuts = [value_at("price", F.floor(k * F.col("total") / 10)) for k in range(1, 10)]
    cuts = F.broadcast(value_places(orders.where("season = 1995"), [], "price").agg(F.array(*cuts).alias("cuts"), F.coalesce(F.max("total"), F.lit(0)).alias("seen")))
    binned = orders.join(cuts).select("season", "seen", F.size(F.filter("cuts", lambda c: F.col("price") > c)).alias("bin"))
    counts = binned.groupBy("season", "seen", "bin").agg(F.count(F.lit(1)).alias("n"))
    grid = counts.select("season", "seen").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(9))))
    share = F.greatest(F.coalesce("n", F.lit(0)) / F.sum("n").over(Window.partitionBy("season")), F.lit(1e-6))
    shares = grid.join(counts.drop("seen"), ["season", "bin"], "left").select("season", "seen", "bin", share.alias("share"))
    base = F.broadcast(shares.where("season = 1995").select("bin", F.col("share").alias("expected")))  # ten rows
    psi = F.sum((F.col("share") - F.col("expected")) * F.log(F.col("share") / F.col("expected")))
    return shares.join(base, "bin").groupBy("season").agg(F.round(F.when(F.max("seen") < 10, 0.0).otherwise(psi), 6).alias("psi"))


def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson correlations of four columns in one pass, one row a pair."""
    pairs = [(a, b) for k, a in enumerate(_NUMBERS) for b in _NUMBERS[k + 1 :]]
    wide = table(spark, sf_dir, "lineitem").agg(*[F.round(F.corr(a, b), 6).alias(f"{a}|{b}") for a, b in pairs])
    long = wide.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "r")
    return long.select(F.split_part("pair", F.lit("|"), F.lit(1)).alias("a"), F.split_part("pair", F.lit("|"), F.lit(2)).alias("b"), "r")


def missing_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.when(F.col("value") >= 5, F.col("value")).alias("value"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("event_type"))
    flags = [F.col(c).isNull().cast("double").alias(f"missing_{c}") for c in ("value", "event_type")]
    return rows.select("event_id", *flags).withColumn("missing_total", F.col("missing_value") + F.col("missing_event_type")).withColumn("missing_share", F.col("missing_total") / 2)


def categorical_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """int(sha256(text)[:16], 16) mod 128 of part types, and a one-hot flag of a known brand."""
    part = table(spark, sf_dir, "part")
    digits = F.conv(F.substring(F.sha2("p_type", 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return part.select("p_partkey", (digits % 128).cast("int").alias("bucket"), (F.col("p_brand") == "Brand#1").cast("int").alias("is_brand_1"))


def training_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = game_log(spark, sf_dir)
    found = log.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("player_id").alias("players"), F.count_distinct("season").alias("seasons"),
        F.min("game_date").alias("first_date"), F.max("game_date").alias("last_date"), F.count_if(F.col("hits").isNull()).alias("unlabelled"),
    )
    checks = [("enough_rows", F.col("n") >= 100), ("enough_players", F.col("players") >= 10), ("enough_seasons", F.col("seasons") >= 3), ("dated", F.col("first_date").isNotNull()), ("labelled", F.col("unlabelled") == 0)]
    return found.withColumns({k: v for k, v in checks}).withColumn("ready", F.expr(" and ".join(k for k, _ in checks)))


def timeline_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a player dated before the one with the next lower game id, and dates with more than one game."""
    by_id, by_date = Window.partitionBy("player_id").orderBy("game_id"), Window.partitionBy("player_id", "game_date")
    rows = game_log(spark, sf_dir).withColumns({"earlier": F.col("game_date") < F.lag("game_date").over(by_id), "tied": F.count(F.lit(1)).over(by_date) > 1})
    return rows.groupBy("player_id").agg(F.count(F.lit(1)).alias("games"), F.count_if("earlier").alias("out_of_order"), F.count_if("tied").alias("tied"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality labels with a score from the text length."""
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return labels.join(docs, "doc_id").select("doc_id", F.col("quality").alias("y"), F.least(F.greatest(F.col("n_chars") / 4000, F.lit(0.01)), F.lit(0.99)).alias("p"))


def reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten bins of the score, empty ones too."""
    found = _scored(spark, sf_dir).groupBy(F.least(F.floor(F.col("p") * 10), F.lit(9)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("p"), F.avg("y").alias("y"))
    bins = spark.range(10).select(F.col("id").cast("int").alias("bin"))
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return bins.join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), zero("p").alias("mean_p"), zero("y").alias("observed"), zero(F.abs(F.col("p") - F.col("y"))).alias("gap"))


def calibration_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected and largest calibration error, Brier score, log loss and mean entropy."""
    rows = _scored(spark, sf_dir)
    bins = rows.groupBy(F.least(F.floor(F.col("p") * 10), F.lit(9)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg("p") - F.avg("y")).alias("gap"))
    p, y = F.col("p"), F.col("y")
    entropy = -(p * F.log2(p) + (1 - p) * F.log2(1 - p))
    proper = rows.agg(F.round(F.avg((p - y) * (p - y)), 6).alias("brier"), F.round(F.avg(-F.log(F.when(y == 1, p).otherwise(1 - p))), 6).alias("log_loss"), F.round(F.avg(entropy), 6).alias("entropy"))
    ece = bins.agg(F.round(F.sum(F.col("n") * F.col("gap")) / F.sum("n"), 6).alias("ece"), F.round(F.max("gap"), 6).alias("mce"))
    return ece.join(proper)


QUERIES = {f.__name__: f for f in (target_labels, target_balance, chrono_split, season_holdout, walk_forward, standard_scale, min_max_scale, impute_mean, robust_zscore, column_profile, feature_quality, psi_by_year, correlation_matrix, missing_indicators, categorical_hash, training_readiness, timeline_quality, reliability, calibration_scores)}

_LOG = f"WITH {GAME_LOG_SQL}"
_LONG = f"u AS (UNPIVOT (SELECT {', '.join(_NUMBERS)} FROM lineitem) ON {', '.join(_NUMBERS)} INTO NAME feature VALUE value)"
_PLACED = "placed AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS place, count(*) OVER () AS total FROM orders)"
_PAIRS = [(a, b) for k, a in enumerate(_NUMBERS) for b in _NUMBERS[k + 1 :]]
_SCORED = "s AS (SELECT l.doc_id, l.quality AS y, least(greatest(n_chars / 4000.0::DOUBLE, 0.01), 0.99) AS p FROM labels l JOIN documents USING (doc_id))"
ORACLE_SQL = {
    "target_labels": f"{_LOG} SELECT player_id, game_id, {', '.join(f'{t} AS {n}' for n, t in TARGETS.items())} FROM log",
    "target_balance": f"""{_LOG}, t AS (SELECT {', '.join(f'{t} AS {n}' for n, t in TARGETS.items())} FROM log), u AS (UNPIVOT t ON {', '.join(TARGETS)} INTO NAME target VALUE label)
        SELECT target, count(label) AS labelled, count(*) FILTER (label >= 0.5) AS positive, count(*) FILTER (label < 0.5) AS negative, round(avg(label), 6) AS mean, min(label) AS least,
        max(label) AS most, count(*) FILTER (label >= 0.5) >= 25 AND count(*) FILTER (label < 0.5) >= 25 AS ready FROM u GROUP BY target""",
    "chrono_split": f"""WITH {_PLACED} SELECT o_orderkey, place, CASE WHEN place < floor(total * 0.70) THEN 'train' WHEN place < floor(total * 0.70) + floor(total * 0.15) THEN 'validation' ELSE 'test' END AS part FROM placed""",
    "season_holdout": """SELECT o_orderkey, season, CASE back WHEN 1 THEN 'test' WHEN 2 THEN 'validation' ELSE 'train' END AS part
        FROM (SELECT o_orderkey, year(o_orderdate)::INT AS season, dense_rank() OVER (ORDER BY year(o_orderdate) DESC) AS back FROM orders)""",
    "walk_forward": f"""WITH {_PLACED}, f AS (SELECT *, total // 10 AS step, (total // 10) * (2 + 2 * fold) AS start FROM placed, (SELECT unnest([0, 1, 2, 3])::INT AS fold)),
        p AS (SELECT *, CASE WHEN place < start THEN 'train' WHEN place < start + step THEN 'validation' WHEN place < start + 2 * step THEN 'test' END AS part FROM f)
        SELECT fold, part, count(*) AS n, min(place) AS first, max(place) AS last FROM p WHERE part IS NOT NULL GROUP BY 1, 2""",
    "standard_scale": """SELECT l_orderkey, l_linenumber, round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6) AS l_quantity,
        round((l_extendedprice - avg(l_extendedprice) OVER ()) / stddev_pop(l_extendedprice) OVER (), 6) AS l_extendedprice FROM lineitem""",
    "min_max_scale": "SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 6) AS scaled FROM customer",
    "impute_mean": """SELECT c_custkey, c_acctbal < 0 AS missing, round(CASE WHEN c_acctbal >= 0 THEN c_acctbal ELSE (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal >= 0) END, 4) AS balance FROM customer""",
    "robust_zscore": """WITH m AS (SELECT c_custkey, c_nationkey, c_acctbal, median(c_acctbal) OVER (PARTITION BY c_nationkey) AS med, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
        d AS (SELECT *, median(abs(c_acctbal - med)) OVER (PARTITION BY c_nationkey) AS mad FROM m)
        SELECT c_custkey, round(CASE WHEN n < 3 OR mad < 1e-12 THEN 0 ELSE 0.67448975::DOUBLE * (c_acctbal - med) / mad END, 4) AS z FROM d""",
    "column_profile": f"""WITH {_LONG} SELECT feature, count(*) AS n, count(*) FILTER (value IS NULL) AS missing, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS sd, min(value) AS least,
        max(value) AS most, round(median(value), 4) AS median FROM u GROUP BY 1""",
    "feature_quality": f"WITH {_LONG} SELECT feature, count(DISTINCT value) AS distinct_values, round(stddev_pop(value), 4) AS deviation, CASE WHEN var_pop(value) <= 1e-12 THEN 'constant' ELSE 'kept' END AS reason FROM u GROUP BY 1",
    "psi_by_year": """WITH o AS (SELECT year(o_orderdate)::INT AS season, o_totalprice AS price FROM orders),
        e AS (SELECT list(price ORDER BY price) AS xs FROM o WHERE season = 1995), c AS (SELECT list_transform(range(1, 10), lambda k: xs[k * len(xs) // 10 + 1]) AS cuts FROM e),
        b AS (SELECT season, len(list_filter(cuts, lambda x: price > x))::INT AS bin FROM o, c), n AS (SELECT season, bin, count(*) AS n FROM b GROUP BY 1, 2),
        g AS (SELECT season, bin, coalesce(n, 0) AS n FROM (SELECT * FROM (SELECT DISTINCT season FROM n), (SELECT unnest(range(10))::INT AS bin)) LEFT JOIN n USING (season, bin)),
        s AS (SELECT season, bin, greatest(n / sum(n) OVER (PARTITION BY season)::DOUBLE, 1e-6) AS share FROM g)
        SELECT a.season, round(sum((a.share - e.share) * ln(a.share / e.share)), 6) AS psi FROM s a JOIN s e ON e.season = 1995 AND e.bin = a.bin GROUP BY 1""",
    "correlation_matrix": " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a, b in _PAIRS),
    "missing_indicators": """SELECT event_id, (value < 5)::INT::DOUBLE AS missing_value, (event_type = 'error')::INT::DOUBLE AS missing_event_type,
        (value < 5)::INT::DOUBLE + (event_type = 'error')::INT AS missing_total, ((value < 5)::INT::DOUBLE + (event_type = 'error')::INT) / 2 AS missing_share FROM events""",
    "categorical_hash": "SELECT p_partkey, (('0x' || substr(sha256(p_type), 1, 16))::UBIGINT % 128)::INT AS bucket, (p_brand = 'Brand#1')::INT AS is_brand_1 FROM part",
    "training_readiness": f"""{_LOG}, f AS (SELECT count(*) AS n, count(DISTINCT player_id) AS players, count(DISTINCT season) AS seasons, min(game_date) AS first_date, max(game_date) AS last_date,
        count(*) FILTER (hits IS NULL) AS unlabelled FROM log), c AS (SELECT *, n >= 100 AS enough_rows, players >= 10 AS enough_players, seasons >= 3 AS enough_seasons, first_date IS NOT NULL AS dated, unlabelled = 0 AS labelled FROM f)
        SELECT *, enough_rows AND enough_players AND enough_seasons AND dated AND labelled AS ready FROM c""",
    "timeline_quality": f"""{_LOG}, w AS (SELECT player_id, game_date < lag(game_date) OVER (PARTITION BY player_id ORDER BY game_id) AS earlier, count(*) OVER (PARTITION BY player_id, game_date) > 1 AS tied FROM log)
        SELECT player_id, count(*) AS games, count(*) FILTER (earlier) AS out_of_order, count(*) FILTER (tied) AS tied FROM w GROUP BY 1""",
    "reliability": f"""WITH {_SCORED}, b AS (SELECT least(floor(p * 10), 9)::INT AS bin, count(*) AS n, avg(p) AS p, avg(y) AS y FROM s GROUP BY 1)
        SELECT bin, coalesce(n, 0) AS n, round(coalesce(p, 0), 6) AS mean_p, round(coalesce(y, 0), 6) AS observed, round(coalesce(abs(p - y), 0), 6) AS gap FROM (SELECT unnest(range(10))::INT AS bin) LEFT JOIN b USING (bin)""",
    "calibration_scores": f"""WITH {_SCORED}, b AS (SELECT count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM s GROUP BY least(floor(p * 10), 9)),
        e AS (SELECT round(sum(n * gap) / sum(n), 6) AS ece, round(max(gap), 6) AS mce FROM b)
        SELECT ece, mce, brier, log_loss, entropy FROM e, (SELECT round(avg((p - y) * (p - y)), 6) AS brier, round(avg(-ln(CASE WHEN y = 1 THEN p ELSE 1 - p END)), 6) AS log_loss,
        round(avg(-(p * log2(p) + (1 - p) * log2(1 - p))), 6) AS entropy FROM s)""",
}
