"""What differs between two snapshots, by a tree of digests over key ranges.

Rows fall into 2 ** depth ranges of their key's hash; a range's digest is order-free (count, and sums of two halves of the
rows' sha256), a parent's is the sum of its children's. Trees of equal depth are compared from the root; only ranges that
differ are read from both snapshots and joined. Keys may be null or repeat (rows of a key count as a bag); all columns that
both have are compared, in the order of their names; nulls are values of their own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _row(columns: Sequence[str]) -> Column:
    """sha256 of a row's values, each with its length, so that no two rows read alike."""
    text = lambda c: F.col(f"`{c}`").cast("string")
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("-")) for c in columns]), 256)


def _range(keys: Sequence[str], depth: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in keys]), F.lit(1 << depth))


def digest_tree(rows: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None, depth: int = 10) -> DataFrame:
    """level (depth for ranges, 0 for the root), node, n, high, low: 2 ** (depth + 1) rows at most, to be kept beside the
    snapshot. One pass and one aggregation; the levels above are sums of one another."""
    part = lambda a: F.conv(F.substring("__sha", a, 14), 16, 10).cast("decimal(38,0)")
    dealt = rows.select(_range(keys, depth).alias("node"), _row(sorted(columns or rows.columns)).alias("__sha"))
    leaves = dealt.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum(part(1)).alias("high"), F.sum(part(15)).alias("low"))
    above = F.explode(F.transform(F.sequence(F.lit(0), F.lit(depth)), lambda k: F.struct(k.alias("level"), F.col("node").alias("leaf"))))
    each = leaves.select("n", "high", "low", above.alias("x")).select("n", "high", "low", F.col("x.level").alias("level"), F.expr(f"x.leaf div cast(pow(2, {depth} - x.level) as bigint)").alias("node"))
    return each.groupBy("level", "node").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")])


def differing_ranges(old: DataFrame, new: DataFrame, depth: int) -> DataFrame:
    """node of the ranges in which two trees differ: from the root, the children of differing nodes only."""
    pack = lambda df, name: df.select("level", "node", F.struct("n", "high", "low").alias(name))
    both = pack(old, "a").join(pack(new, "b"), ["level", "node"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("level", "node")
    open_ = both.where("level = 0").select("node")
    for level in range(1, depth + 1):
        at = both.where(F.col("level") == level).select("node", F.expr("node div 2").alias("parent"))
        open_ = at.join(open_.withColumnRenamed("node", "parent"), "parent", "left_semi").select("node")
    return open_


def changed_keys(old: DataFrame, new: DataFrame, keys: Sequence[str], old_tree: DataFrame, new_tree: DataFrame, depth: int = 10) -> DataFrame:
    """keys, change (missing, added, changed) of the keys whose rows differ, found in the differing ranges alone."""
    columns = sorted(c for c in old.columns if c in new.columns)
    ranges = F.broadcast(differing_ranges(old_tree, new_tree, depth))  # 2 ** depth at most

    def side(df: DataFrame, name: str) -> DataFrame:
        kept = df.withColumn("__node", _range(keys, depth)).join(ranges, F.col("__node") == F.col("node"), "left_semi")
        return kept.groupBy(*keys).agg(F.sort_array(F.collect_list(_row(columns))).alias(name)).select(F.struct(*keys).alias("__key"), name)

    a, b = side(old, "__a").alias("o"), side(new, "__b").alias("n")
    both = a.join(b, F.col("o.__key").eqNullSafe(F.col("n.__key")), "full_outer")
    change = F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "added").otherwise("changed")
    differ = both.where(~F.col("__a").eqNullSafe(F.col("__b")))
    return differ.select(F.coalesce(F.col("o.__key"), F.col("n.__key")).alias("key"), change.alias("change")).select("key.*", "change")
