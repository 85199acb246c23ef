"""Understanding of conversations: batch against a plain loop, stream against batch, and single messages."""

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from fieldlab.operators import dialogue as d
from fieldlab.plans import dialogues
from fieldlab.streaming.dialogue import understand_stream

DATA = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, ts timestamp, text string"
CATALOG = [("ann lee", "player", "Ann Lee"), ("bo ray", "player", "Bo Ray"), ("reds", "team", "Reds"), ("big reds", "team", "Big Reds"), ("blues", "team", "Blues")]
START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame(CATALOG, "alias string, kind string, name string")


def talk(spark, *texts, conv=1, hours=1):
    return spark.createDataFrame([(conv, k, START + dt.timedelta(hours=hours * k), t) for k, t in enumerate(texts)], SCHEMA)


def meaning(spark, catalog, *texts, **more):
    return sorted(d.understand(talk(spark, *texts, **more), catalog).collect(), key=lambda r: r.turn)


def test_what_is_carried_on(spark, catalog):
    rows = meaning(
        spark, catalog, "What is Ann Lee's OPS?", "what about his strikeouts", "and the Reds vs the Blues", "who wins that game", "how likely is he to walk", "start over", "his ops", "Ann Lee ops", "predict that player again", None, "his ops"
    )
    got = [(r.kind, r.player, r.team, r.game, r.statistic, r.asks, r.taken, r.turns) for r in rows]
    assert got[0] == ("pronoun" if False else "none", "Ann Lee", None, None, "ops", "", "", 1)
    assert got[1] == ("pronoun", "Ann Lee", None, None, "strikeouts", "", "player", 2)
    assert got[2] == ("elliptical", None, "Reds", "Reds vs Blues", None, "", "", 3)  # a new team clears the player
    assert got[3] == ("pronoun", None, None, "Reds vs Blues", None, "", "game", 4)
    assert got[4][5] == "player" and got[4][7] == 4  # clarification leaves the memory as it is
    assert got[5][0] == "reset" and got[6] == ("pronoun", None, None, None, "ops", "player", "", 1)
    assert got[7][1] == "Ann Lee" and got[8][5] == "outcome"  # no outcome was said so far
    assert got[9][5] == "message" and got[10] == ("pronoun", "Ann Lee", None, None, "ops", "", "player", 3)


def test_expiry_and_longer_names(spark, catalog):
    rows = meaning(spark, catalog, "Ann Lee ops", "his ops", "the big reds roster", hours=24)
    assert [(r.begun, r.player, r.asks) for r in rows] == [("", "Ann Lee", ""), ("expired", None, "player"), ("expired", None, "")]
    assert rows[2].team == "Big Reds" and rows[2].intent == "roster_lookup"


def test_choices():
    assert d.choose([], [], [], None, None) == ("general", 0.30)
    assert d.choose([("database_status", 11.0, 2)], ["a", "b"], [], None, None)[0] == "database_status"
    assert d.choose([], ["a", "b"], [], None, None)[0] == "compare_players"
    assert d.choose([("general_probability", 4.0, 1)], [], ["t"], None, None)[0] == "team_probability"
    assert d.choose([("stat_request", 5.0, 1)], ["a"], [], "ops", None)[0] == "player_stat_request"
    assert d.names_of([("team", "Reds", 2, 1), ("team", "Big Reds", 1, 2), (None, None, 1, 1)]) == ([], ["Big Reds"])


def loop(rows, ttl=d.DAY):
    """A plain loop over sorted rows of one conversation each, without pieces."""
    out, memory, conv = [], d.Memory(), object()
    for turn, hits in itertools.chain.from_iterable(d.turns_of([rows])):
        if turn["conv_id"] != conv:
            conv, memory = turn["conv_id"], d.Memory()
        memory, meant = d.advance(memory, turn, hits, ttl)
        out.append((turn["conv_id"], turn["turn"], *meant.values(), memory.seen, memory.text()))
    return sorted(out, key=repr)


def odd(spark):
    texts = ["Ann Lee ops", None, "", "!!", "his ops", "Ann Lee ops", "reds " * 3000, "start over", "and the Blues", "that team schedule"]
    rows = [(c, k % 7, None if k % 11 == 5 else START + dt.timedelta(hours=(k % 9) * 7), texts[(k * 3 + c) % len(texts)]) for c in (0, 1, 2) for k in range(30)]
    return spark.createDataFrame([*rows, *rows[:9]], SCHEMA)


def test_batch_equals_a_plain_loop(spark, catalog):
    for messages in (odd(spark), dialogues.dialogue_turns(spark, DATA).unionByName(odd(spark)), odd(spark).limit(0)):
        for size in (100, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            got = sorted((tuple(r) for r in d.understand(messages, catalog).collect()), key=repr)
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
            named = d.with_mentions(d.features(messages), catalog, 2).toPandas()
            want = loop(named.sort_values(["conv_id", *d.SORTED], na_position="first", kind="stable")) if len(named) else []
            assert got == want and len(got) == messages.count()


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def streamed(spark, parts, catalog, tmp_path, memories=None):
    for k, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = understand_stream(source, catalog, delay="100 days", memories=memories)
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))


def test_stream_equals_batch(spark, catalog, tmp_path, rocksdb):
    turns = dialogues.dialogue_turns(spark, DATA)
    names = dialogues.catalogue(spark, DATA)
    whole = d.understand(turns, names)
    want = sorted(map(tuple, whole.collect()))
    early, late = turns.where("turn < 3"), turns.where("turn >= 3")
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    assert streamed(spark, [early, late], names, tmp_path / "a") == want
    held = d.last_memories(d.understand(early, names))
    rest = sorted(map(tuple, whole.where(F.col("turn") >= 3).collect()))
    assert streamed(spark, [late], names, tmp_path / "b", held) == rest
