"""Queries over the fitted preparation, drift by tree and table functions, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlab.functions import tables
from fieldlab.operators import drift
from fieldlab.operators.prepare import Preparer
from fieldlab.plans.relational import _NEW, _snapshot
from fieldlab.plans.training import ORACLE_SQL as TRAINING_SQL
from fieldlab.sources.shared import dealt, stage, with_position
from fieldlab.sources.tables import GAME_LOG_SQL, game_log, table

NUMBERS, LAST_TRAIN_DAY = ["plate_appearances", "home_runs", "rbi"], 180


def prepared_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector of every game as numbers: counts by mean and deviation of the first 180 days of each year, the kind of
    pitcher in a column for each that those days have. Games without home runs count them as missing."""
    log = game_log(spark, sf_dir).withColumn("home_runs", F.when(F.col("home_runs") > 0, F.col("home_runs")))
    rows = stage(log.select("game_id", "game_date", "pitcher_throws", *NUMBERS), "games")
    fitted = Preparer(numbers=NUMBERS, categories=["pitcher_throws"], encode="one_hot").fit(rows.where(F.dayofyear("game_date") <= LAST_TRAIN_DAY))
    out = fitted.transform(rows).withColumn("v", vector_to_array("features"))
    return out.select("game_id", F.size("v").alias("width"), *[(F.round(F.get("v", F.lit(k)), 6) + 0.0).alias(f"v{k}") for k in range(len(NUMBERS) + 2)])


def drift_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that a later state lacks, has anew, or has otherwise, found by trees of digests: only ranges that differ
    are joined."""
    old = table(spark, sf_dir, "customer")
    new = _snapshot(old)
    trees = [stage(drift.digest_tree(x, ["c_custkey"]), "tree") for x in (old, new)]
    return drift.changed_keys(old, new, ["c_custkey"], *trees)


def fold_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folds of `sliding_folds` by a table function in SQL. It takes each row for itself, so rows stay in the ranges they were
    placed in, as many as their count asks for; dealt out by team they were a few uneven tasks."""
    tables.register(spark)
    games = stage(game_log(spark, sf_dir).select("game_id", "game_date"), "games")
    placed = stage(with_position(games, ["game_date", "game_id"], "place", games.count()).select("game_id", "place"), "placed")
    n = placed.count()
    s = n // 10
    placed = dealt(placed, n)
    return spark.sql(f"SELECT game_id, fold, part FROM expand_folds(TABLE(SELECT * FROM {{rows}}), 'place', {n}, {4 * s}, {s}, {s}, {s}, false)", rows=placed)


QUERIES = {f.__name__: f for f in (prepared_matrix, drift_keys, fold_expansion)}
ORACLE_SQL = {
    "prepared_matrix": f"""WITH {GAME_LOG_SQL}, x AS (SELECT game_id, dayofyear(game_date) <= {LAST_TRAIN_DAY} AS early, pitcher_throws, plate_appearances::DOUBLE AS a, CASE WHEN home_runs > 0 THEN home_runs END::DOUBLE AS b, rbi::DOUBLE AS c FROM log),
        m AS (SELECT avg(b) AS fill FROM x WHERE early), f AS (SELECT x.* EXCLUDE b, coalesce(b, fill, 0) AS b FROM x, m),
        s AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, stddev_pop(a) AS sa, stddev_pop(b) AS sb, stddev_pop(c) AS sc FROM f WHERE early),
        k AS (SELECT pitcher_throws AS p, row_number() OVER (ORDER BY count(*) DESC, pitcher_throws) AS k FROM f WHERE early GROUP BY 1), one AS (SELECT max(p) FILTER (k = 1) AS p1, max(p) FILTER (k = 2) AS p2 FROM k)
        SELECT game_id, 5 AS width, round((a - ma) / CASE WHEN sa > 1e-12 THEN sa ELSE 1 END, 6) + 0 AS v0, round((b - mb) / CASE WHEN sb > 1e-12 THEN sb ELSE 1 END, 6) + 0 AS v1, round((c - mc) / CASE WHEN sc > 1e-12 THEN sc ELSE 1 END, 6) + 0 AS v2,
        (pitcher_throws = p1)::INT::DOUBLE AS v3, (pitcher_throws = p2)::INT::DOUBLE AS v4 FROM f, s, one""",
    "drift_keys": f"""WITH {_NEW} SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN n.c_custkey IS NULL THEN 'missing' WHEN o.c_custkey IS NULL THEN 'added' ELSE 'changed' END AS change
        FROM customer o FULL JOIN new n ON n.c_custkey = o.c_custkey WHERE n.c_custkey IS NULL OR o.c_custkey IS NULL OR n.c_name IS DISTINCT FROM o.c_name OR n.c_nationkey IS DISTINCT FROM o.c_nationkey OR n.c_acctbal IS DISTINCT FROM o.c_acctbal OR n.c_mktsegment IS DISTINCT FROM o.c_mktsegment""",
    "fold_expansion": TRAINING_SQL["sliding_folds"],
}
