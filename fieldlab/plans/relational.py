"""Merge, audit, search, set and nested-data queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlab.operators.merge import classify, deactivate_absent
from fieldlab.sources.tables import table

AS_OF = "2024-02-01 00:00:00"
_METRICS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest order of each customer, by one aggregate instead of a sort."""
    best = F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(best.alias("x")).select("o_custkey", "x.o_orderkey", "x.o_orderdate", "x.o_totalprice")


def last_n_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.row_number().over(latest).alias("back")).where("back <= 5")


def _snapshot(customers: DataFrame) -> DataFrame:
    """A later state of the customers: some changed, some gone, some new."""
    key = F.col("c_custkey")
    changed = customers.where(key % 11 != 0).withColumn("c_acctbal", F.when(key % 7 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    changed = changed.withColumn("c_mktsegment", F.when(key % 13 == 0, "MOVED").otherwise(F.col("c_mktsegment")))
    return changed.unionByName(customers.where(key % 17 == 0).withColumn("c_custkey", key + 10_000_000))


def merge_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    found = classify(customers, _snapshot(customers), ["c_custkey"])
    return found.select("c_custkey", "action", F.array_join("changed", ",").alias("changed"))


def merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dry run of a merge: rows for each action, nothing written."""
    return merge_changes(spark, sf_dir).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    return deactivate_absent(customers, _snapshot(customers), ["c_custkey"]).select("c_custkey", "is_active")


def unpivot_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each line and metric that is above zero."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *_METRICS).unpivot(["l_orderkey", "l_linenumber"], _METRICS, "metric", "value").where("value > 0")


def flatten_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed fields of JSON text, the payload kept next to them."""
    events = table(spark, sf_dir, "events")
    return events.select("event_id", F.from_json("props", "k int")["k"].alias("k"), F.get_json_object("props", "$.missing").alias("missing"), "props")


def nested_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nested payloads (customer, then orders, then lines) taken apart again."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("splits"))
    nested = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.to_json(F.struct("splits")).alias("payload"))
    parsed = nested.withColumn("p", F.from_json("payload", "splits array<struct<l_linenumber:int,l_quantity:double>>"))
    flat = parsed.select("o_orderkey", F.explode_outer("p.splits").alias("s"))
    return flat.select("o_orderkey", F.coalesce(F.col("s.l_linenumber"), F.lit(-1)).alias("line"), F.col("s.l_quantity").alias("quantity"))


def orphan_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys without a partner, either way, of three references."""
    customers, orders, events = (table(spark, sf_dir, t) for t in ("customer", "orders", "events"))
    checks = [
        ("order_without_customer", orders.select(F.col("o_custkey").alias("key")), customers.select(F.col("c_custkey").alias("key"))),
        ("customer_without_order", customers.select(F.col("c_custkey").alias("key")), orders.select(F.col("o_custkey").alias("key"))),
        ("user_without_customer", events.select(F.col("user_id").alias("key")), customers.select(F.col("c_custkey").alias("key"))),
    ]
    found = [left.join(right, "key", "left_anti").agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("rows"), F.count_distinct("key").alias("keys")) for name, left, right in checks]
    return found[0].unionByName(found[1]).unionByName(found[2])


def duplicate_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that more than one part has, with the parts' keys in order."""
    parts = table(spark, sf_dir, "part")
    return parts.groupBy("p_name").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("p_partkey")).cast("array<string>"), ",").alias("keys")).where("n > 1")


def reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field by field, what differs between customers and their later state on common keys; codes compare in upper case."""
    old = table(spark, sf_dir, "customer")
    new = _snapshot(old).select("c_custkey", F.col("c_acctbal").alias("n_bal"), F.lower("c_mktsegment").alias("n_seg"))
    both = old.join(new, "c_custkey")
    fields = F.array(
        F.struct(F.lit("c_acctbal").alias("field"), F.format_number("c_acctbal", 2).alias("a"), F.format_number("n_bal", 2).alias("b"), (F.col("c_acctbal") == F.col("n_bal")).alias("same")),
        F.struct(F.lit("c_mktsegment").alias("field"), F.col("c_mktsegment").alias("a"), F.col("n_seg").alias("b"), (F.upper("c_mktsegment") == F.upper("n_seg")).alias("same")),
    )
    return both.select("c_custkey", F.explode(F.filter(fields, lambda x: ~x["same"])).alias("x")).select("c_custkey", "x.field", F.col("x.a").alias("before"), F.col("x.b").alias("after"))


def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing and new keys between two states, and an order-free checksum of each."""
    old = table(spark, sf_dir, "customer")
    new = _snapshot(old)
    digest = lambda df, name: df.agg(F.sum(F.conv(F.substring(F.md5(F.concat_ws("|", "c_custkey", "c_name", "c_mktsegment")), 1, 8), 16, 10).cast("long")).alias(name), F.count(F.lit(1)).alias(f"{name}_rows"))
    missing = old.join(new, "c_custkey", "left_anti").agg(F.count(F.lit(1)).alias("missing"), F.min("c_custkey").alias("first_missing"))
    added = new.join(old, "c_custkey", "left_anti").agg(F.count(F.lit(1)).alias("added"), F.min("c_custkey").alias("first_added"))
    return missing.join(added).join(digest(old, "old_sum")).join(digest(new, "new_sum"))


def freshness_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age of the newest row of each table at a fixed time: current to 36 hours, stale to 96, else critical."""
    tables = {"events": "ts", "orders": "o_orderdate", "lineitem": "l_shipdate"}
    found = [table(spark, sf_dir, t).agg(F.lit(t).alias("name"), F.max(c).alias("newest"), F.count(F.lit(1)).alias("n")) for t, c in tables.items()]
    rows = found[0].unionByName(found[1]).unionByName(found[2])
    hours = F.greatest((F.unix_timestamp(F.lit(AS_OF).cast("timestamp")) - F.unix_timestamp(F.col("newest").cast("timestamp"))) / 3600, F.lit(0.0))
    state = F.when(F.col("n") == 0, "empty").when(hours <= 36, "current").when(hours <= 96, "stale").otherwise("critical")
    return rows.select("name", "newest", "n", F.round(hours, 4).alias("hours"), state.alias("state"))


def coverage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each nation: customers, those with orders, share, and the gate at 60%."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    bought = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("covered", F.lit(1))
    found = customers.join(bought, "c_custkey", "left").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("eligible"), F.count("covered").alias("covered"))
    share = F.col("covered") / F.col("eligible")
    return found.withColumn("share", F.round(share, 6)).withColumn("passes", share >= 0.6)


def event_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and mean by type, by user and over all in one pass of grouping sets; `level` tells which a row is of."""
    rows = table(spark, sf_dir, "events")
    found = rows.groupingSets([["event_type"], ["user_id"], []], "event_type", "user_id").agg(
        F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean")
    )
    return found.select("event_type", "user_id", "level", "n", "mean")


def token_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of which every search token is in a field; number, name or type."""
    tokens = F.array(F.lit("red"), F.lit("e"))
    fields = F.array(F.lower("p_name"), F.lower("p_type"), F.lower("p_brand"))
    hit = F.forall(tokens, lambda t: F.exists(fields, lambda f: F.contains(f, t)))
    return table(spark, sf_dir, "part").where(hit).select("p_partkey", "p_name", "p_type")


def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names like 'ring': equal 100, a word 90, start 80, inside 70; the first 20 by score, then name and key."""
    name = F.lower("p_name")
    score = F.when(name == "ring", 100).when(F.array_contains(F.split(name, " "), "ring"), 90).when(name.startswith("ring"), 80).when(name.contains("ring"), 70).otherwise(0)
    found = table(spark, sf_dir, "part").select("p_partkey", "p_name", score.alias("score")).where("score > 0")
    return found.orderBy(F.desc("score"), "p_name", "p_partkey").limit(20)


def overlap_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token overlap of names with 'small red ring': 100 when equal, else shared tokens of the larger set in percent."""
    asked = F.array(*[F.lit(x) for x in ("small", "red", "ring")])
    own = F.array_distinct(F.split(F.lower("p_name"), " "))
    score = F.when(F.lower("p_name") == "small red ring", 100).otherwise(F.floor(F.size(F.array_intersect(own, asked)) / F.greatest(F.size(own), F.lit(3)) * 100)).cast("int")
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "p_partkey").limit(25)


def paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).offset(40).limit(20)


def _nations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return (
        table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation")),
        table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("nation")),
    )


def union_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _nations(spark, sf_dir)
    return a.unionByName(b).distinct()


def set_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _nations(spark, sf_dir)
    return a.subtract(b).withColumn("side", F.lit("left")).unionByName(b.subtract(a).withColumn("side", F.lit("right")))


def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _nations(spark, sf_dir)
    return a.intersect(b)


QUERIES = {f.__name__: f for f in (latest_per_key, last_n_events, merge_changes, merge_counts, soft_delete, unpivot_metrics, flatten_json, nested_blocks, orphan_audit, duplicate_audit, reconcile, drift, freshness_report, coverage_audit, event_breakdown, token_search, ranked_search, overlap_topk, paging, union_dedupe, set_diff, set_intersect)}

_NEW = """new AS (SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 13 = 0 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment
    FROM customer WHERE c_custkey % 11 <> 0 UNION ALL SELECT c_custkey + 10000000, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 17 = 0)"""
_MERGE = f"""WITH {_NEW}, m AS (SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN o.c_custkey IS NULL THEN 'created' WHEN n.c_custkey IS NULL THEN 'absent' END AS edge,
    CASE WHEN o.c_custkey IS NULL OR n.c_custkey IS NULL THEN '' ELSE concat_ws(',', CASE WHEN o.c_acctbal IS DISTINCT FROM n.c_acctbal THEN 'c_acctbal' END, CASE WHEN o.c_mktsegment IS DISTINCT FROM n.c_mktsegment THEN 'c_mktsegment' END) END AS changed
    FROM customer o FULL JOIN new n USING (c_custkey)), r AS (SELECT c_custkey, coalesce(edge, CASE WHEN changed = '' THEN 'unchanged' ELSE 'updated' END) AS action, changed FROM m)"""
_SETS = "a AS (SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000), b AS (SELECT s_nationkey AS nation FROM supplier WHERE s_acctbal > 5000)"
ORACLE_SQL = {
    "latest_per_key": "SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    "last_n_events": "SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC)::INT AS back FROM events QUALIFY back <= 5",
    "merge_changes": f"{_MERGE} SELECT * FROM r",
    "merge_counts": f"{_MERGE} SELECT action, count(*) AS n FROM r GROUP BY 1",
    "soft_delete": "SELECT c_custkey, c_custkey % 11 <> 0 AS is_active FROM customer",
    "unpivot_metrics": f"SELECT * FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, {', '.join(_METRICS)} FROM lineitem) ON {', '.join(_METRICS)} INTO NAME metric VALUE value) WHERE value > 0",
    "flatten_json": "SELECT event_id, json_extract(props, '$.k')::INT AS k, NULL::VARCHAR AS missing, props FROM events",
    "nested_blocks": "SELECT o_orderkey, coalesce(l_linenumber, -1) AS line, l_quantity AS quantity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey",
    "orphan_audit": """SELECT 'order_without_customer' AS "check", count(*) AS rows, count(DISTINCT o_custkey) AS keys FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
        UNION ALL SELECT 'customer_without_order', count(*), count(DISTINCT c_custkey) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
        UNION ALL SELECT 'user_without_customer', count(*), count(DISTINCT user_id) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)""",
    "duplicate_audit": "SELECT p_name, count(*) AS n, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS keys FROM part GROUP BY 1 HAVING count(*) > 1",
    "reconcile": f"""WITH {_NEW}, j AS (SELECT o.c_custkey, o.c_acctbal AS ob, n.c_acctbal AS nb, o.c_mktsegment AS os, n.c_mktsegment AS ns FROM customer o JOIN new n USING (c_custkey))
        SELECT c_custkey, 'c_acctbal' AS field, format('{{:,.2f}}', ob) AS before, format('{{:,.2f}}', nb) AS after FROM j WHERE ob <> nb
        UNION ALL SELECT c_custkey, 'c_mktsegment', os, lower(ns) FROM j WHERE upper(os) <> upper(ns)""",
    "drift": f"""WITH {_NEW}, d AS (SELECT 'old' AS side, c_custkey, c_name, c_mktsegment FROM customer UNION ALL SELECT 'new', c_custkey, c_name, c_mktsegment FROM new),
        h AS (SELECT side, ('0x' || substr(md5(concat_ws('|', c_custkey, c_name, c_mktsegment)), 1, 8))::BIGINT AS x FROM d)
        SELECT (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM new)) AS missing, (SELECT min(c_custkey) FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM new)) AS first_missing,
        (SELECT count(*) FROM new WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)) AS added, (SELECT min(c_custkey) FROM new WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)) AS first_added,
        (sum(x) FILTER (side = 'old'))::BIGINT AS old_sum, count(*) FILTER (side = 'old') AS old_sum_rows, (sum(x) FILTER (side = 'new'))::BIGINT AS new_sum, count(*) FILTER (side = 'new') AS new_sum_rows FROM h""",
    "freshness_report": f"""WITH t AS (SELECT 'events' AS name, max(ts) AS newest, count(*) AS n FROM events UNION ALL SELECT 'orders', max(o_orderdate), count(*) FROM orders UNION ALL SELECT 'lineitem', max(l_shipdate), count(*) FROM lineitem),
        h AS (SELECT *, greatest((epoch(TIMESTAMP '{AS_OF}') - floor(epoch(newest))) / 3600, 0) AS x FROM t)
        SELECT name, newest, n, round(x, 4) AS hours, CASE WHEN n = 0 THEN 'empty' WHEN x <= 36 THEN 'current' WHEN x <= 96 THEN 'stale' ELSE 'critical' END AS state FROM h""",
    "coverage_audit": """SELECT c_nationkey, count(*) AS eligible, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders)) AS covered, round(covered / eligible, 6) AS share, covered / eligible >= 0.6 AS passes FROM customer GROUP BY 1""",
    "event_breakdown": "SELECT event_type, user_id, grouping_id(event_type, user_id)::INT AS level, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY GROUPING SETS ((event_type), (user_id), ())",
    "token_search": """SELECT p_partkey, p_name, p_type FROM part WHERE (contains(lower(p_name), 'red') OR contains(lower(p_type), 'red') OR contains(lower(p_brand), 'red'))
        AND (contains(lower(p_name), 'e') OR contains(lower(p_type), 'e') OR contains(lower(p_brand), 'e'))""",
    "ranked_search": """SELECT p_partkey, p_name, score FROM (SELECT p_partkey, p_name, CASE WHEN lower(p_name) = 'ring' THEN 100 WHEN list_contains(string_split(lower(p_name), ' '), 'ring') THEN 90
        WHEN starts_with(lower(p_name), 'ring') THEN 80 WHEN contains(lower(p_name), 'ring') THEN 70 ELSE 0 END AS score FROM part) WHERE score > 0 ORDER BY score DESC, p_name, p_partkey LIMIT 20""",
    "overlap_topk": """WITH t AS (SELECT p_partkey, p_name, list_distinct(string_split(lower(p_name), ' ')) AS own FROM part),
        s AS (SELECT p_partkey, p_name, (CASE WHEN lower(p_name) = 'small red ring' THEN 100 ELSE floor(len(list_intersect(own, ['small', 'red', 'ring'])) / greatest(len(own), 3) * 100) END)::INT AS score FROM t)
        SELECT * FROM s WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 25""",
    "paging": "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 40",
    "union_dedupe": f"WITH {_SETS} SELECT * FROM a UNION SELECT * FROM b",
    "set_diff": f"WITH {_SETS} SELECT nation, 'left' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT nation, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)",
    "set_intersect": f"WITH {_SETS} SELECT * FROM a INTERSECT SELECT * FROM b",
}
