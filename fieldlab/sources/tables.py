"""Input tables, and the game log that the feature queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlab.sources.shared import dealt


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def game_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each player (customer) and game (order) with counted outcomes of its lines. Tasks grow in number with the
    orders, so that each join and count holds about as many rows in a task at any size."""
    orders, items, customers = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer"))
    n = orders.count()
    orders = orders.select(F.col("o_orderkey").alias("game_id"), "o_custkey", "o_orderdate")
    items = items.select("l_orderkey", "l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax")
    customers = customers.select("c_custkey", "c_nationkey")
    hit = F.col("l_returnflag") == "R"
    count = lambda condition: F.count_if(condition)
    lines = dealt(items, n, "l_orderkey").groupBy(F.col("l_orderkey").alias("game_id")).agg(
        F.count(F.lit(1)).alias("plate_appearances"),
        count(F.col("l_returnflag") != "A").alias("at_bats"),
        count(F.col("l_returnflag") == "A").alias("walks"),
        count(hit).alias("hits"),
        count(hit & F.col("l_quantity").between(26, 38)).alias("doubles"),
        count(hit & F.col("l_quantity").between(39, 41)).alias("triples"),
        count(hit & (F.col("l_quantity") >= 42)).alias("home_runs"),
        count((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F")).alias("strikeouts"),
        count(F.col("l_discount") >= 0.07).alias("rbi"),
        count(F.col("l_tax") >= 0.06).alias("runs"),
    )
    key = F.col("game_id")
    return (
        dealt(dealt(orders, n, "game_id").join(lines, "game_id"), n, "o_custkey")
        .join(dealt(customers, n, "c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_custkey").alias("player_id"),
            "game_id",
            F.col("o_orderdate").alias("game_date"),
            F.year("o_orderdate").alias("season"),
            F.col("c_nationkey").alias("team_id"),
            F.when(key % 2 == 0, "home").otherwise("away").alias("home_away"),
            F.when(key % 3 == 0, "L").otherwise("R").alias("pitcher_throws"),
            F.when(key % 5 < 2, "day").otherwise("night").alias("day_night"),
            *lines.columns[1:],
        )
    )


#: The same view for the SQL that the queries are held against.
GAME_LOG_SQL = """
log AS (
SELECT o.o_custkey AS player_id, o.o_orderkey AS game_id, o.o_orderdate AS game_date, year(o.o_orderdate)::INT AS season,
       c.c_nationkey AS team_id, CASE WHEN o.o_orderkey % 2 = 0 THEN 'home' ELSE 'away' END AS home_away,
       CASE WHEN o.o_orderkey % 3 = 0 THEN 'L' ELSE 'R' END AS pitcher_throws,
       CASE WHEN o.o_orderkey % 5 < 2 THEN 'day' ELSE 'night' END AS day_night,
       count(*) AS plate_appearances, count(*) FILTER (l_returnflag <> 'A') AS at_bats,
       count(*) FILTER (l_returnflag = 'A') AS walks, count(*) FILTER (l_returnflag = 'R') AS hits,
       count(*) FILTER (l_returnflag = 'R' AND l_quantity BETWEEN 26 AND 38) AS doubles,
       count(*) FILTER (l_returnflag = 'R' AND l_quantity BETWEEN 39 AND 41) AS triples,
       count(*) FILTER (l_returnflag = 'R' AND l_quantity >= 42) AS home_runs,
       count(*) FILTER (l_returnflag = 'N' AND l_linestatus = 'F') AS strikeouts,
       count(*) FILTER (l_discount >= 0.07) AS rbi, count(*) FILTER (l_tax >= 0.06) AS runs
FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
GROUP BY o.o_custkey, o.o_orderkey, o.o_orderdate, c.c_nationkey)
"""
