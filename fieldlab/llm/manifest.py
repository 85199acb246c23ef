"""A Merkle manifest of a dataset: a content-addressed store of nodes, proofs by descent from the root, and their check.

Every row is a leaf, the sha256 of its fields, each as its UTF-8 byte count, a colon and its value, or `-` for null.
Leaves of one group (language) stand in the order of doc_id; while a level has several nodes, every `arity` consecutive
ones become the sha256 of their digests as hex text. What remains is the group's subroot; subroots in the order of their
groups (null first, then by UTF-8 bytes) likewise give the root.

The store holds a record for each node: its digest and those of its children, once for equal content. Requests, rows by
group and rank, descend from the root: the digits of the group's place, then those of the rank, highest first, say which
child to take, and the other children are a segment of the path. Requests that share a prefix of digits share a row
until they part, so that each node on the way is read once, whatever their number, and no digest is a hot key. At the
leaf the segments are reversed: the siblings of each level, from the leaf up.

Rows are dealt out by ranges of (group, doc_id), so a hot group lies in many tasks; a level is a grouping of at most
`arity` nodes; the driver sees counts of groups and heights only. Null doc_ids come first in their group; rows of equal
doc_id are ordered by their leaf, and equal rows are equal leaves beside each other. A group of one row has its leaf as
its subroot; one group's subroot is the root; proofs without siblings are empty. An empty table has no root, no proofs.
Only the named fields are read, so other columns, of whatever names, don't matter; very long texts are hashed in place.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlab.llm.common import shared_dir, stage, table, with_position

ARITY, FIELDS, SMALL_ROWS = 8, ("doc_id", "source", "lang", "n_chars", "text"), 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


def joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def leaves(docs: DataFrame, presented: dict[str, Column] | None = None, fields: Sequence[str] = FIELDS, group: str = "lang") -> DataFrame:
    """doc_id, group, leaf, and the leaf of the row as it is presented later, with the columns in `presented` changed."""
    now = [(presented or {}).get(c, F.col(f"`{c}`")) for c in fields]
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col(f"`{group}`").cast("string").alias("group"),
        leaf([F.col(f"`{c}`") for c in fields]).alias("leaf"),
        leaf(now).alias("presented"),
    )


@dataclass
class Manifest:
    """root (None for no rows); the folder of the store, nodes by tree (`top`, `group`) and height; groups: group, place,
    rows, height, staged; rows: place, run, height, rank, doc_id, presented of each run of leaves, staged; heights of the
    trees, nodes by tree and height."""

    root: str | None
    store: str
    groups: DataFrame
    runs: DataFrame
    heights: dict[str, int]
    nodes: dict[tuple[str, int], int]
    arity: int


def _few(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= SMALL_ROWS else df


def _powers(arity: int) -> list[int]:
    out = [1]
    while out[-1] * arity < 1 << 62:
        out.append(out[-1] * arity)
    return out


def _height(rows: Column, arity: int) -> Column:
    return sum((F.when(rows > p, 1).otherwise(0) for p in _powers(arity)), F.lit(0)).cast("int")


def _runs(nodes: DataFrame, arity: int) -> DataFrame:
    """nodes (tree, at, digest, height) of one level, gathered by run: tree, at, height, digest, children in order."""
    run = nodes.groupBy("tree", F.expr(f"at div {arity}").alias("at"), "height").agg(F.sort_array(F.collect_list(F.struct(F.col("at").alias("k"), "digest"))).alias("held"))
    return run.select("tree", "at", "height", F.transform("held", lambda x: x["digest"]).alias("children")).withColumn("digest", F.sha2(joined(F.col("children")), 256))


def _keep(level: DataFrame, path: str) -> DataFrame:
    """The level's records in the store, one for each digest."""
    level.select("digest", "children").dropDuplicates(["digest"]).write.parquet(path)
    return level


def _climb(level: DataFrame, top: int, store: str, arity: int) -> DataFrame:
    """From the nodes of height 1 (tree, at, height, digest, children), staged, to the nodes of each tree's own height; the
    records of every level go to the store. level has the trees of height 0 too."""
    roots = [level.where(F.col("height") <= 1).select("tree", "digest")]
    _keep(level.where(F.col("height") >= 1), f"{store}/height=1") if top else None
    for k in range(2, top + 1):
        level = stage(_runs(level.where(F.col("height") >= k).select("tree", "at", "digest", "height"), arity), f"level-{k}")
        _keep(level, f"{store}/height={k}")
        roots.append(level.where(F.col("height") == k).select("tree", "digest"))
    out = roots[0]
    for more in roots[1:]:
        out = out.unionByName(more)
    return out


def build(found: DataFrame, arity: int = ARITY) -> Manifest:
    """The manifest of leaves (doc_id, group, leaf, presented)."""
    spark = found.sparkSession
    store = f"{shared_dir(spark).rstrip('/')}/fieldlab-{uuid.uuid4().hex}/nodes"
    placed = stage(with_position(stage(found, "leaves"), [F.col("group").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf")], "pos"), "placed")
    key = F.coalesce(F.concat(F.lit("s"), F.col("group")), F.lit("n"))
    counted = stage(placed.groupBy("group").agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("rows")), "counted")
    groups = stage(with_position(counted, [F.col("start")], "place").withColumn("height", _height(F.col("rows"), arity)), "groups")
    powers = _powers(arity)
    nodes_at = [F.sum(F.when(F.col("height") >= k, F.ceil(F.col("rows") / powers[k]))) for k in range(1, len(powers))]
    seen = groups.agg(F.count(F.lit(1)).alias("n"), F.max("height").alias("height"), *[c.cast("long").alias(f"at{k}") for k, c in enumerate(nodes_at, 1)]).first()
    heights = {"group": seen.height or 0, "top": sum(seen.n > p for p in powers)}
    nodes = {("group", k): seen[f"at{k}"] or 0 for k in range(1, heights["group"] + 1)} | {("top", k): -(-seen.n // powers[k]) for k in range(1, heights["top"] + 1)}
    ranked = placed.withColumn("key", key).join(_few(groups.withColumn("key", key).select("key", "place", "start", "height"), seen.n), "key")
    ranked = ranked.withColumn("rank", F.col("pos") - F.col("start"))
    gathered = ranked.groupBy("place", F.expr(f"rank div {arity}").alias("run"), "height").agg(
        F.sort_array(F.collect_list(F.struct("rank", "doc_id", F.col("leaf").alias("digest"), "presented"))).alias("held")
    )
    children = F.transform("held", lambda x: x["digest"])
    digest = F.when(F.col("height") == 0, F.col("held")[0]["digest"]).otherwise(F.sha2(joined(children), 256))
    runs = stage(gathered.select("place", "run", "height", "held", digest.alias("digest")), "runs")
    first = runs.select(F.col("place").alias("tree"), F.col("run").alias("at"), "height", "digest", F.transform("held", lambda x: x["digest"]).alias("children"))
    subroots = stage(_climb(first, heights["group"], f"{store}/tree=group", arity), "subroots")
    tops = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), "digest", F.lit(heights["top"]).alias("height"))
    if heights["top"]:
        level = stage(_runs(tops, arity), "tops")
        root = _climb(level, heights["top"], f"{store}/tree=top", arity).first()
    else:
        root = tops.first()
    return Manifest(root.digest if root else None, store, groups, runs, heights, nodes, arity)


def _down(frontier: DataFrame, manifest: Manifest, tree: str, k: int) -> DataFrame:
    """Every row of the frontier whose tree is at least k high, replaced by its node's children: the child's digit goes to
    `at`, the children that are not taken become a segment of the path. Other rows stay."""
    spark, arity = frontier.sparkSession, manifest.arity
    records = spark.read.parquet(f"{manifest.store}/tree={tree}/height={k}").select(F.col("digest").alias("node"), "children")
    on = (F.col("digest") == F.col("node")) & (F.col("height") >= k)
    met = frontier.join(_few(records, manifest.nodes[tree, k]), on, "left").drop("node")
    rest = [c for c in frontier.columns if c not in ("digest", "at", "path")]
    each = met.select(*rest, "at", "path", "children", F.posexplode(F.coalesce("children", F.array("digest"))).alias("digit", "digest"))
    taken = F.col("children").isNotNull()
    return each.select(
        *rest, "digest",
        F.when(taken, F.col("at") * arity + F.col("digit")).otherwise(F.col("at")).alias("at"),
        F.when(taken, F.concat("path", F.array(_segment(F.col("children"), F.col("digit"))))).otherwise(F.col("path")).alias("path"),
    )


def _segment(children: Column, digit: Column) -> Column:
    """The children that are not taken: those before and those after."""
    after = F.slice(children, digit + 2, F.greatest(F.size(children) - digit - 1, F.lit(0)))
    return F.struct(joined(F.slice(children, F.lit(1), digit)).alias("left"), joined(after).alias("right"))


def prove(manifest: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """group, rank, doc_id, leaf, presented, subroot, path of the requested leaves (group, rank; default all): the path's
    segments are structs of the siblings' digests left and right, from the leaf up."""
    spark, arity = manifest.runs.sparkSession, manifest.arity
    path = F.array().cast("array<struct<left:string,right:string>>")
    start = [] if manifest.root is None else [(manifest.root, 0, manifest.heights["top"])]
    frontier = spark.createDataFrame(start, "digest string, at long, height int").withColumn("path", path)
    wanted = None
    if requests is not None:
        asked = requests.select("group", F.col("rank").cast("long").alias("rank")).distinct()
        same = F.col("group").eqNullSafe(F.col("g"))
        wanted = stage(asked.join(manifest.groups.select(F.col("group").alias("g"), "place"), same).select("place", "rank"), "requests")
    for k in range(manifest.heights["top"], 0, -1):
        frontier = _down(frontier, manifest, "top", k)
        if wanted is not None:
            digits = wanted.select(F.expr(f"place div {arity ** (k - 1)}L").alias("at")).distinct()
            frontier = frontier.join(digits, "at", "left_semi")
    parts = manifest.groups.select("place", "height", "group")
    frontier = frontier.drop("height").withColumnRenamed("at", "place").join(_few(parts, manifest.groups.count()), "place")
    frontier = frontier.select("place", "group", "height", F.col("digest").alias("subroot"), "digest", F.lit(0).cast("long").alias("at"), "path")
    for k in range(manifest.heights["group"], 1, -1):
        frontier = _down(frontier, manifest, "group", k)
        if wanted is not None:
            powers = F.array(*[F.lit(p).cast("long") for p in _powers(arity)])
            digits = wanted.join(parts.drop("group"), "place").withColumn("powers", powers).select("place", F.expr(f"rank div powers[least(height, {k - 1})]").alias("at")).distinct()
            frontier = frontier.join(digits, ["place", "at"], "left_semi")
    if manifest.heights["group"]:
        records = spark.read.parquet(f"{manifest.store}/tree=group/height=1").select(F.col("digest").alias("node"), "children")
        on = (F.col("digest") == F.col("node")) & (F.col("height") >= 1)
        frontier = frontier.join(_few(records, manifest.nodes["group", 1]), on, "left").drop("node")
    else:
        frontier = frontier.withColumn("children", F.lit(None).cast("array<string>"))
    held = manifest.runs.select("place", F.col("run").alias("at"), F.transform("held", lambda x: x.dropFields("digest")).alias("held"))
    each = frontier.join(held, ["place", "at"]).select("place", "group", "subroot", "digest", "path", "children", F.explode("held").alias("row"))
    digit = (F.col("row.rank") % arity).cast("int")
    segment = F.array(_segment(F.col("children"), digit))
    out = each.select(
        "place", "group", F.col("row.rank").alias("rank"), F.col("row.doc_id").alias("doc_id"),
        F.when(F.col("children").isNull(), F.col("digest")).otherwise(F.get("children", digit)).alias("leaf"),
        F.col("row.presented").alias("presented"), "subroot",
        F.reverse(F.when(F.col("children").isNull(), F.col("path")).otherwise(F.concat("path", segment))).alias("path"),
    )
    out = out if wanted is None else out.join(wanted, ["place", "rank"], "left_semi")
    return out.select("group", "rank", "doc_id", "leaf", "presented", "subroot", "path")


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, start, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of the table `documents`, a proof of every row, and what becomes of rows that are tampered with: those
    whose doc_id has a crc32 that 3 divides (a null doc_id has none) are presented with their text in lower case."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    text = F.when(tampered, lower_ascii(F.col("text"))).otherwise(F.col("text"))
    manifest = build(leaves(docs, {"text": text}))
    root = F.lit(manifest.root).cast("string")
    proofs = prove(manifest).withColumn("folded_root", folded(F.col("presented"), F.col("path")))
    return proofs.select("doc_id", "leaf", "subroot", root.alias("root"), proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified"))


OP12_SQL = """
WITH RECURSIVE crcs AS (
  SELECT doc_id, source, lang, n_chars, text,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
             lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) AS crc
  FROM documents),
fields AS (
  SELECT *, CASE WHEN crc % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS presented,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
  FROM crcs),
leaves AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(presented) || ':' || presented, '-')) AS shown,
         dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS place,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS rank
  FROM fields),
nodes AS (
  SELECT place, 0 AS height, rank AS pos, leaf AS digest, count(*) OVER (PARTITION BY place) AS n FROM leaves
  UNION ALL
  SELECT place, height + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 7) // 8
  FROM nodes WHERE n > 1 GROUP BY place, height, pos // 8, n),
subroots AS (
  SELECT place, height AS top, digest AS subroot FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS height, place AS pos, subroot AS digest, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT height + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 7) // 8
  FROM tops WHERE n > 1 GROUP BY height, pos // 8, n),
tree AS (
  SELECT l.doc_id, n.height, n.pos, n.digest, l.rank // (8 ** n.height)::BIGINT AS own
  FROM leaves l JOIN subroots s ON s.place = l.place
  JOIN nodes n ON n.place = l.place AND n.height < s.top AND n.pos // 8 = l.rank // (8 ** (n.height + 1))::BIGINT
  UNION ALL
  SELECT l.doc_id, s.top + t.height, t.pos, t.digest, l.place // (8 ** t.height)::BIGINT
  FROM leaves l JOIN subroots s ON s.place = l.place
  JOIN tops t ON t.n > 1 AND t.pos // 8 = l.place // (8 ** (t.height + 1))::BIGINT),
segments AS (
  SELECT doc_id, height, coalesce(string_agg(digest, '' ORDER BY pos) FILTER (pos < own), '') AS before,
         coalesce(string_agg(digest, '' ORDER BY pos) FILTER (pos > own), '') AS after
  FROM tree GROUP BY doc_id, height),
fold AS (
  SELECT doc_id, 0 AS height, shown AS node FROM leaves
  UNION ALL
  SELECT f.doc_id, f.height + 1, sha256(s.before || f.node || s.after)
  FROM fold f JOIN segments s ON s.doc_id = f.doc_id AND s.height = f.height),
ends AS (
  SELECT doc_id, arg_max(node, height) AS folded_root FROM fold GROUP BY doc_id),
proofs AS (
  SELECT doc_id, string_agg(before || after, '' ORDER BY height) AS siblings FROM segments GROUP BY doc_id),
whole AS (
  SELECT arg_max(digest, height) AS root FROM tops)
SELECT l.doc_id, l.leaf, s.subroot, w.root, sha256(coalesce(p.siblings, '')) AS proof_sha256, e.folded_root, e.folded_root = w.root AS verified
FROM leaves l JOIN subroots s ON s.place = l.place JOIN ends e ON e.doc_id = l.doc_id LEFT JOIN proofs p ON p.doc_id = l.doc_id, whole w
"""
