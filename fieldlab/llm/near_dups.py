"""Near-duplicate documents by BagMinHash over bags of five-word shingles.

Signatures. A shingle that occurs c times weighs c. Its weight is cut into dyadic levels [0,1) [1,2) [2,4) [4,8) ...;
every level is a Poisson process of the shingle with the level's length as rate, whose points fall on random registers
and random heights, and points above c are thinned out. Bags that share a shingle share the points below the smaller
count, so two registers agree with a chance equal to the weighted Jaccard similarity. All shingles of a batch advance
together, each until its next point lies beyond the largest register of its document.

Candidates. Copies of a text are one node. Nodes with an equal band of registers meet by the band's key; members are
compared with the leaders of their bucket (the first members at an estimated 0.8 or less from all earlier leaders) and
linked to all leaders at an estimate of EDGE or more. As 1 - similarity is a metric, nodes at 0.8 are linked through a
leader. No pairs within a bucket are listed. A bucket over SPLIT members is dealt out by hash and its parts' leaders meet
again, dealt out anew while they are over SPLIT but fewer than half as many as before. Where they are not (many texts that
share a passage but are not alike), the bucket is crowded: its members meet by a later band beside the first one, and so on.
A pair at exactly 0.8 misses all bands with a chance of 3e-6, and has but one band, crowded, with one of 5e-5 at most.

Verification. Links form components, and inside a component the bags themselves decide: nodes of an overlap of 0.8 or
more are in one class, transitively. A component over BLOCK nodes or BLOCK_CHARS characters first meets its hub; nodes that
no unlinked node can reach by the metric are done, what remains is compared where it shares a band, in finer buckets where
one is over BLOCK; only what no further band parts is compared block against block. Only spanning links leave a task.

Words are runs of ASCII letters, digits and other bytes beyond ASCII, in lower case. A text of one to four words has one
shingle of them all; texts without words are duplicates of equal texts only. Null texts are empty. Rows may repeat or
have null doc_ids; class_id is the smallest doc_id of a class, null if it has none. Of several rows that could stay, the
one of the smallest doc_id does (null first). An empty table gives an empty one. `near_duplicates` reads doc_id and text
only; `keep_first` carries all columns of its input in one struct, so no name clashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField

from fieldlab.llm.common import bounded_batches, stage, steps, table, with_text_columns

SHINGLE, BANDS, BAND_ROWS, SEED = 5, 32, 5, 0x9E37
REGISTERS = BANDS * BAND_ROWS
NEAR_NUM, NEAR_DEN = 4, 5  # similarity of 4/5 and more is near
LEADER, EDGE, FAR_EDGE = 0.8, 0.5, 0.3
SPLIT, PART, BLOCK, SMALL_ROWS, HUB_ROUNDS = 4096, 2048, 512, 100_000, 2
BLOCK_CHARS, DEALS = 24_000_000, 256
_U = np.uint64


# --- shingles and signatures


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that scatters them."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_BASE = 0x100000001B3
_powers = np.ones(1, _U)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate((np.ones(1, _U), np.full(2 * n, _BASE, _U))), dtype=_U)
    return _powers


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, text after text, and how many each has."""
    parts = [t.lower().encode() + b" " for t in texts]
    data = np.frombuffer(b"".join(parts), np.uint8)
    inside = _WORD[data]
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=np.int8(0)))
    starts, ends = edge[::2], edge[1::2]  # every text ends outside a word
    if not len(starts):
        return np.empty(0, _U), np.zeros(len(texts), np.int64)
    power = _power_table(int((ends - starts).max()) + 1)
    size = ends - starts
    total = np.concatenate(([0], np.cumsum(size)))
    place = np.arange(total[-1]) - np.repeat(total[:-1], size)
    value = (data[inside].astype(_U) + _U(1)) * power[place]
    word = _mix(np.add.reduceat(value, total[:-1]) + _U(SEED) * size.astype(_U))
    bounds = np.searchsorted(starts, np.cumsum([0, *map(len, parts)]))
    n_words = np.diff(bounds)
    count = np.where(n_words >= SHINGLE, n_words - SHINGLE + 1, np.minimum(n_words, 1))
    owner = np.repeat(np.arange(len(texts)), count)
    offset = np.concatenate(([0], np.cumsum(count)))
    at = bounds[owner] + np.arange(offset[-1]) - offset[owner]
    last = np.minimum(at + SHINGLE, bounds[owner + 1])
    out = np.zeros(len(at), _U)
    for k in range(SHINGLE):
        out = _mix(out * _U(_BASE) + np.where(at + k < last, word[np.minimum(at + k, len(word) - 1)], _U(k)))
    return out, count


def bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """owner, shingle, count of the distinct shingles, ordered by owner and shingle."""
    hashes, each = shingles(texts)
    owner = np.repeat(np.arange(len(texts)), each)
    by = np.lexsort((hashes, owner))
    owner, hashes = owner[by], hashes[by]
    first = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])))) if len(owner) else np.empty(0, int)
    return owner[first], hashes[first], np.diff(np.append(first, len(owner)))


def _unit(x: np.ndarray) -> np.ndarray:
    """(0, 1] from 64 random bits."""
    return ((x >> _U(11)).astype(np.float64) + 1) * 2.0**-53


def bag_signatures(n: int, owner: np.ndarray, shingle: np.ndarray, count: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """A row of 16-bit register codes for each of n bags; an empty bag has zeros."""
    levels = np.where(count == 1, 1, np.ceil(np.log2(np.maximum(count, 2))).astype(np.int64) + 1)
    level = np.arange(levels.sum()) - np.repeat(np.cumsum(levels) - levels, levels)
    owner, shingle, count = (np.repeat(x, levels) for x in (owner, shingle, count))
    start = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    length = np.maximum(start, 1)
    seed = _mix(shingle + level.astype(_U) * _U(0xD1342543DE82EF95))
    room = (count - start) / length  # share of the level below the weight, 1 or more for the whole level
    least = np.full(n * registers, np.inf)
    time = np.zeros(len(seed))
    step = 0
    while len(seed):
        draw = [_mix(seed + _U((3 * step + k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) for k in range(3)]
        time = time - np.log(_unit(draw[0])) / length
        hit = np.flatnonzero((room >= 1) | (_unit(draw[2]) <= room))
        slot = owner[hit] * registers + (draw[1][hit] % _U(registers)).astype(np.int64)
        np.minimum.at(least, slot, time[hit])
        live = time < least.reshape(n, registers).max(axis=1)[owner]
        owner, seed, time, length, room = owner[live], seed[live], time[live], length[live], room[live]
        step += 1
    code = _mix(np.where(np.isinf(least), 0, least * 2.0**32).astype(_U))
    return (np.where(np.isinf(least), 0, code & _U(0xFFFF)).astype("<u2")).reshape(n, registers)


def _signed(texts: list[str]) -> dict:
    signs, sizes = [], []
    for a, b in steps(texts, 600_000):
        owner, shingle, count = bags(texts[a:b])
        found = bag_signatures(b - a, owner, shingle, count)
        n = np.bincount(owner, weights=count, minlength=b - a).astype(np.int64)
        sizes += n.tolist()
        signs += [found[k].tobytes() if n[k] else None for k in range(b - a)]
    return {"signature": signs, "n_shingles": sizes}


def _node(text: str = "text") -> Column:
    """16 bytes that stand for a text: copies have the same."""
    held = F.coalesce(F.col(text), F.lit(""))
    return F.unhex(F.concat(F.lpad(F.hex(F.xxhash64(held)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit("node"), held)), 16, "0")))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, node, n_shingles, signature of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _node().alias("node"), F.col("text"))
    return with_text_columns(rows, [StructField("signature", BinaryType()), StructField("n_shingles", LongType())], _signed, ["doc_id", "node"])


# --- candidates


def _few(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= SMALL_ROWS else df


def _alike(some: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Estimated similarity of every row of some with every row of others."""
    out = np.empty((len(some), len(others)), np.float32)
    for k in range(0, len(others), 64):
        out[:, k : k + 64] = (some[:, None, :] == others[None, k : k + 64, :]).mean(axis=2)
    return out


def _spanning(links: list[tuple[int, int]], root: list[int]) -> list[tuple[int, int]]:
    """The links that join two parts which no earlier link had joined; root is updated."""
    out = []
    for pair in links:
        tops = []
        for k in pair:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            tops.append(k)
        if tops[0] != tops[1]:
            root[max(tops)] = min(tops)
            out.append(pair)
    return out


def leader_links(rows: np.ndarray, edge: float = EDGE) -> tuple[list[tuple[int, int]], list[int]]:
    """Links (leader, row) that connect the rows of a bucket just as all links at an estimate of edge or more would,
    fewer than there are rows; and the leaders."""
    if len(rows) == 2:
        near = float((rows[0] == rows[1]).mean())
        return ([(0, 1)] if near >= edge else []), ([0] if near >= LEADER else [0, 1])
    leaders: list[int] = []
    links: list[tuple[int, int]] = []
    root = list(range(len(rows)))
    for a in range(0, len(rows), 256):
        block = rows[a : a + 256]
        led = np.zeros(len(block), bool)
        if leaders:
            near = _alike(block, rows[leaders])
            led = (near >= LEADER).any(axis=1)
            links += _spanning([(leaders[j], a + i) for i, j in np.argwhere(near >= edge).tolist()], root)
        while not led.all():
            new = int(np.flatnonzero(~led)[0])
            near = (block == block[new]).mean(axis=1)
            led |= near >= LEADER
            led[new] = True
            links += _spanning([(a + new, a + i) for i in np.flatnonzero(near >= edge).tolist() if i != new], root)
            leaders.append(a + new)
    return links, leaders


def _groups(batches, keys: int) -> Iterator[tuple[dict, pa.Table]]:
    """Runs of rows with equal first `keys` columns from sorted batches; a run may span batches."""
    held: list[pa.RecordBatch] = []

    def key_of(batch: pa.RecordBatch, k: int) -> tuple:
        return tuple(batch.column(c)[k].as_py() for c in range(keys))

    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for c in range(keys):
            values = batch.column(c).to_pylist()
            change[1:] |= np.fromiter((x != y for x, y in zip(values[1:], values)), bool, len(values) - 1)
        if held and key_of(held[-1], held[-1].num_rows - 1) != key_of(batch, 0):
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _bucket_links(rows: DataFrame, edge: float) -> DataFrame:
    """kind 0: links a, b of the buckets (key, part) of rows (key, used, node, members, signature); kind 1: leaders `node`
    of the buckets that were dealt out, as rows again."""
    split = SPLIT

    def run(batches):
        out: list[tuple] = []
        for group in _groups(batches, 2):
            nodes = group.column("node").to_pylist()
            signs = np.stack([np.frombuffer(x, "<u2") for x in group.column("signature").to_pylist()])
            links, leaders = leader_links(signs, edge)
            out += [(0, nodes[i], nodes[j], *[None] * 5) for i, j in links]
            members = group.column("members")[0].as_py()
            if members > split:
                key, used = group.column("key")[0].as_py(), group.column("used")[0].as_py()
                out += [(1, None, None, key, used, nodes[i], members, signs[i].tobytes()) for i in leaders]
            if len(out) >= 5000:
                yield _link_batch(out)
                out = []
        if out:
            yield _link_batch(out)

    bounded_batches(rows.sparkSession)
    part = F.when(F.col("members") > SPLIT, F.pmod(F.xxhash64("node", "members"), F.ceil(F.col("members") / PART))).otherwise(0)
    dealt = rows.select("key", part.cast("int").alias("part"), "used", "node", "members", "signature")
    ordered = dealt.repartition("key", "part").sortWithinPartitions("key", "part", "node")
    return ordered.mapInArrow(run, "kind int, a binary, b binary, key long, used int, node binary, members long, signature binary")


def _link_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.binary())
    names = ["kind", "a", "b", "key", "used", "node", "members", "signature"]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)


def _band(k: Column, *more: Column) -> Column:
    """Hash of band k of the signature, and of more columns."""
    width = 2 * BAND_ROWS
    return F.xxhash64(*more, k, F.substring("signature", k * width + 1, F.lit(width)))


def _keyed(rows: DataFrame, *more: str) -> DataFrame:
    """key, used (its band), node of each band of rows (node, signature, more); keys of other values of `more` differ."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: _band(k, *map(F.col, more)))
    return rows.where(F.col("signature").isNotNull()).select("node", *more, F.posexplode(bands).alias("used", "key")).select("key", "used", "node", *more)


def _finer(rows: DataFrame, *more: str) -> DataFrame:
    """Rows (key, used, node, signature, more) keyed by each later band as well. Two nodes that share several bands share
    a finer key of the first of them."""
    later = F.transform(F.sequence(F.col("used") + 1, F.lit(BANDS - 1)), lambda k: F.struct(_band(k, F.col("key")).alias("key"), k.alias("used")))
    held = rows.where(F.col("used") < BANDS - 1).select("node", *more, F.explode(later).alias("x"))
    return held.select("x.key", "x.used", "node", *more)


def candidate_links(nodes: DataFrame) -> DataFrame:
    """a, b: links of nodes (node, signature), staged, that connect all nodes which may be at 0.8 or more."""
    signs = nodes.select("node", "signature")
    rows: DataFrame | None = _keyed(nodes)
    found: list[DataFrame] = []
    while rows is not None:
        shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
        members = rows.join(shared, "key").join(signs, "node")
        met = stage(_bucket_links(members, EDGE), "links")
        crowded: list[DataFrame] = []
        while True:
            found.append(met.where("kind = 0").select("a", "b"))
            leaders = met.where("kind = 1").select("key", "used", "node", F.col("members").alias("before"), "signature")
            if not leaders.take(1):
                break
            counts = leaders.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.first("before").alias("before"))
            dense = (F.col("members") > SPLIT) & (2 * F.col("members") > F.col("before"))
            counts = stage(counts.withColumn("dense", dense).drop("before"), "leaders")
            crowded.append(counts.where("dense").select("key"))
            met = stage(_bucket_links(leaders.join(counts.where("not dense"), "key"), FAR_EDGE), "links")
        keys = [k for k in crowded if k.take(1)]
        if keys:
            some = keys[0]
            for k in keys[1:]:
                some = some.unionByName(k)
            rows = stage(_finer(members.join(some, "key", "left_semi")), "finer")
        else:
            rows = None
    links = found[0]
    for some in found[1:]:
        links = links.unionByName(some)
    return stage(links.distinct(), "candidates")


def _with_whole(rows: DataFrame, key: str, deal_by: str, part: Column, whole: Column, name: str) -> DataFrame:
    """rows with an aggregate of all rows of their key: `whole` of the parts' `part`, both over a column `name`. The rows
    of one key are dealt over DEALS parts by deal_by, so that neither the aggregate nor its way back makes one task of a
    key."""
    dealt = rows.withColumn("deal_", F.pmod(F.xxhash64(deal_by), F.lit(DEALS)).cast("int"))
    parts = dealt.groupBy(key, "deal_").agg(part.alias(name))
    wholes = parts.groupBy(key).agg(whole.alias(name))
    return dealt.join(parts.select(key, "deal_").join(wholes, key), [key, "deal_"]).drop("deal_")


# --- components


def components(links: DataFrame) -> DataFrame:
    """node, root of the nodes of links (a, b), staged: every round joins each node's neighbours to its smallest
    neighbour, larger ones first, then smaller ones, until nothing changes. Neighbours are never gathered in a row."""

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        if not large:
            both = both.where("v < u")
        met = _with_whole(both, "u", "v", F.min("v"), F.min("m"), "m").withColumn("m", F.least("u", "m"))
        out = met.where("v > u") if large else met
        out = out.select(F.col("v").alias("b"), F.col("m").alias("a"))
        if not large:
            low = both.groupBy("u").agg(F.min("v").alias("m"))
            out = out.unionByName(low.select(F.col("u").alias("b"), F.least("u", "m").alias("a")))
        return stage(out.where("a != b").select("a", "b").distinct(), "stars")

    def mark(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = stage(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "stars")
    now, before = mark(edges), None
    while now != before:
        before, edges = now, star(star(edges, True), False)
        now = mark(edges)
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )


# --- verification


class Bags:
    """Distinct shingles of a few texts, end to end, for overlaps of one with many."""

    def __init__(self, texts: list[str]):
        owner, shingle, self.count = bags(texts)
        found, self.place = np.unique(shingle, return_inverse=True)
        self.starts = np.searchsorted(owner, np.arange(len(texts) + 1))
        self.size = np.bincount(owner, weights=self.count, minlength=len(texts)).astype(np.int64)
        self.weight = np.zeros(len(found) + 1, np.int64)

    def overlap(self, one: int, others: np.ndarray) -> np.ndarray:
        """Shared weight of one with each of the others (all of which have shingles)."""
        mine = slice(self.starts[one], self.starts[one + 1])
        self.weight[self.place[mine]] = self.count[mine]
        begin, each = self.starts[others], np.diff(self.starts)[others]
        ends = np.cumsum(each)
        at = np.arange(ends[-1]) + np.repeat(begin - (ends - each), each)
        shared = np.minimum(self.weight[self.place[at]], self.count[at])
        self.weight[self.place[mine]] = 0
        return np.add.reduceat(shared, ends - each)

    def near(self, one: int, others: np.ndarray) -> np.ndarray:
        size, mine = self.size[others], self.size[one]
        able = (NEAR_DEN * np.minimum(size, mine) >= NEAR_NUM * np.maximum(size, mine)) & (size > 0)
        out = np.zeros(len(others), bool)
        if able.any() and mine:
            shared = self.overlap(one, others[able])
            out[able] = NEAR_DEN * shared >= NEAR_NUM * (size[able] + mine - shared)
        return out


def spanning_links(texts: list[str]) -> list[tuple[int, int]]:
    """Links that connect exactly the texts which are near, directly or through others: each text reached is compared
    with all that are not reached yet."""
    held, links = Bags(texts), []
    rest = np.arange(len(texts))
    while len(rest):
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            one = front.pop()
            near = held.near(one, rest)
            links += [(one, int(k)) for k in rest[near]]
            front += rest[near].tolist()
            rest = rest[~near]
    return links


def _verified(units: DataFrame) -> DataFrame:
    """Spanning links of the units (unit, part) of rows with node, text; a repeated node counts once."""

    def run(batches):
        for group in _groups(batches, 2):
            held = dict(zip(group.column("node").to_pylist(), group.column("text").to_pylist()))
            nodes = list(held)
            links = spanning_links(list(held.values()))
            if links:
                sides = [pa.array([nodes[pair[k]] for pair in links], pa.binary()) for k in range(2)]
                yield pa.RecordBatch.from_arrays(sides, names=["a", "b"])

    bounded_batches(units.sparkSession)
    ordered = units.select("unit", "part", "node", "text").repartition("unit", "part").sortWithinPartitions("unit", "part", "node")
    return ordered.mapInArrow(run, "a binary, b binary")


def _hub_links(big: DataFrame, pending: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Compares every node of the large components `big` (root, node, text) with its component's hub, the smallest
    pending node. Gives the links found, and the nodes that may still have links: root, node, text, and whether it is
    unlinked. Nobody but the hub is compared twice."""
    hubs = pending.groupBy("root").agg(F.min("node").alias("hub"))
    n = hubs.count()
    deals = F.ceil(F.col("size") / BLOCK).cast("int")  # a hub's text goes to as many parts as its component has blocks
    texts = big.join(_few(hubs, n), "root").where("node = hub").dropDuplicates(["root"])
    texts = texts.select("root", "hub", F.col("text").alias("hub_text"), F.explode(F.sequence(F.lit(0), deals - 1)).alias("deal"))
    met = big.withColumn("deal", F.pmod(F.xxhash64("node"), deals)).join(texts, ["root", "deal"])

    def run(batches):
        for batch in batches:
            pairs = zip(batch.column("text").to_pylist(), batch.column("hub_text").to_pylist())
            far = []
            for text, hub in pairs:
                both = Bags([text, hub])
                shared = int(both.overlap(1, np.array([0]))[0]) if both.size.all() else 0
                far.append((int(both.size.sum()) - 2 * shared) / max(1, int(both.size.sum()) - shared))
            kept = ["root", "size", "node", "hub", "text"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(far, pa.float64())], names=[*kept, "far"])

    bounded_batches(big.sparkSession)
    limit = 1 - NEAR_NUM / NEAR_DEN
    seen = stage(
        met.select("root", "size", "node", "hub", "text", "hub_text").mapInArrow(
            run, "root binary, size long, node binary, hub binary, text string, far double"
        ),
        "hubs",
    )
    near = F.col("far") <= limit + 1e-12
    links = seen.where(near & (F.col("node") != F.col("hub"))).select(F.col("hub").alias("a"), F.col("node").alias("b"))
    reach = seen.where(~near).groupBy("root").agg(F.min("far").alias("nearest"))
    rest = (
        seen.join(_few(reach, n), "root")
        .where((F.col("node") != F.col("hub")) & (~near | (F.col("far") >= F.col("nearest") - limit - 1e-9)))
        .select("root", "size", "node", "text", (~near).alias("open"))
    )
    return links, rest


def _blocks(rows: DataFrame) -> DataFrame:
    """Units of one or two blocks each of rows (key, node, text, size, chars of the key), so that any two nodes of a key
    meet in one."""
    blocks = _many("size", "chars")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.least(k, F.col("mine")) * F.col("blocks") + F.greatest(k, F.col("mine"))
    )
    held = rows.withColumn("blocks", blocks).withColumn("mine", mine)
    return held.select(F.col("key").alias("unit"), F.explode(pairs).alias("part"), "node", "text")


def _many(size: str, chars: str) -> Column:
    """How many blocks hold so many texts of so many characters."""
    return F.greatest(F.ceil(F.col(size) / BLOCK), F.ceil(F.col(chars) / BLOCK_CHARS), F.lit(1)).cast("int")


def _banded(rest: DataFrame, nodes: DataFrame) -> DataFrame:
    """Units of the nodes that are left of large components (root, node, text, open): those of a component that share a
    band, keyed by further bands where they are more than a block. Buckets without an open node have no link to find."""
    texts = rest.select("root", "node", "text")
    signs = stage(rest.select("root", "node", "open", F.length("text").alias("chars")).join(nodes.select("node", "signature"), "node"), "left")
    rows, units = _keyed(signs, "root"), []
    while True:
        held = rows.join(signs.select("root", "node", "open", "chars", "signature"), ["root", "node"])
        sizes = held.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum("chars").alias("chars"), F.max("open").alias("open"))
        sizes = stage(sizes.where("size > 1 and open").select("key", "size", F.col("chars").alias("all_chars")), "sizes")
        asked = held.join(sizes, "key")
        over = _many("size", "all_chars") > 1
        units.append(asked.where(~over | (F.col("used") == BANDS - 1)))
        big = asked.where(over & (F.col("used") < BANDS - 1))
        if not big.take(1):
            break
        finer = stage(_finer(big, "root"), "finer")
        if finer.count() > BANDS * signs.count():  # no band parts them any more
            units.append(big)
            break
        rows = finer
    found = units[0]
    for some in units[1:]:
        found = found.unionByName(some)
    return _blocks(found.select("key", "root", "node", "size", F.col("all_chars").alias("chars")).join(texts, ["root", "node"]))


def near_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows doc_id, node, n_shingles of every document; classes node, root of the nodes that are near
    another node."""
    signed = stage(signatures(docs), "signatures")
    nodes = stage(signed.groupBy("node").agg(F.first("signature").alias("signature"), F.min("doc_id").alias("doc_id")), "nodes")
    found = stage(components(candidate_links(nodes)), "components")
    n_found = found.count()
    asked = found.join(nodes.select("node", F.col("doc_id").alias("first_id")), "node")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), _node().alias("node"))
    held = stage(
        texts.join(_few(asked, n_found), "node").where(F.col("doc_id").eqNullSafe(F.col("first_id"))).select("root", "node", "text"), "compared"
    )
    sizes = held.groupBy("root").agg(F.count_distinct("node").alias("size"), F.sum(F.length("text")).alias("chars"))
    large = stage(sizes.where(_many("size", "chars") > 1).select("root", "size"), "large")
    n_large = large.count()
    small = held.join(_few(large, n_large), "root", "left_anti") if n_large else held
    links = _verified(small.select(F.col("root").alias("unit"), F.lit(0).alias("part"), "node", "text"))
    if n_large:
        big = held.join(_few(large, n_large), "root").dropDuplicates(["root", "node"])
        pending = big.select("root", "node")
        for _ in range(HUB_ROUNDS):
            some, rest = _hub_links(big, pending)
            links = links.unionByName(some)
            big = stage(rest, "rest")
            pending = big.where("open").select("root", "node")
            if not pending.take(1):
                break
        else:
            links = links.unionByName(_verified(_banded(big, nodes)))
    classes = components(stage(links, "verified"))
    return signed.select("doc_id", "node", "n_shingles"), classes


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, class_size, n_shingles of every row of docs."""
    rows, classes = near_classes(docs)
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    rooted = nodes.join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = stage(rooted, "rooted")
    of_part = F.struct(F.min("first_id").alias("class_id"), F.sum("copies").alias("class_size"))
    of_all = F.struct(F.min("of.class_id").alias("class_id"), F.sum("of.class_size").alias("class_size"))
    named = _with_whole(rooted, "root", "node", of_part, of_all, "of").select("node", "of.class_id", "of.class_size")
    return rows.join(named, "node").select("doc_id", "class_id", "class_size", "n_shingles")


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each class, that with the smallest doc_id (null first), with its own columns."""
    rows, classes = near_classes(docs)
    rooted = rows.join(classes, "node", "left").select("doc_id", "node", F.coalesce("root", "node").alias("root"))
    rooted = stage(rooted, "rooted")
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "node")
    best = _with_whole(rooted.withColumn("order", order), "root", "node", F.min("order"), F.min("best"), "best")
    marked = best.select(
        F.col("doc_id").alias("__doc"),
        F.col("node").alias("__node"),
        (F.col("node") == F.col("best.node")).alias("stays") & F.col("doc_id").eqNullSafe(F.col("best.doc_id")),
    )
    marked = stage(marked.toDF("__doc", "__node", "stays"), "marked")
    gone = stage(marked.where("not stays").select("__doc", "__node").distinct(), "gone")
    again = marked.where("stays").groupBy("__doc", "__node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    on = F.col("__own").eqNullSafe(F.col("__node")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__doc"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    kept = docs.select(row, F.col("doc_id"), _node().alias("__own")).join(_few(gone, gone.count()), on, "left_anti")
    if again.take(1):  # rows that occur more than once stay once
        kept = kept.dropDuplicates(["doc_id", "__own"])
    return kept.select("row.*")


def op10_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates of the table `documents`."""
    return near_duplicates(table(spark, sf_dir, "documents"))
