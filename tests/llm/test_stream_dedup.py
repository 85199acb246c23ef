"""Streaming deduplication against brute force: awkward rows, colliding digests, and a state that goes on."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from fieldlab.llm import stream_dedup

DATA = "/root/testdata/sf0.001"
ROWS = [(None, None), (None, ""), (None, "solo"), (1, ""), (2, "x"), (2, "x"), (2, "x"), (3, "x"), (4, "X"), (5, "é" * 90_000), (6, "é" * 90_000), (7, "é"), (8, "é"), (9, "x ")]


def brute(rows):
    by = {}
    for doc_id, text in rows:
        by.setdefault(text or "", []).append(doc_id)
    known = lambda ids: [i for i in ids if i is not None]
    return sorted(((i, max(known(by[t or ""]), default=None), len(by[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=repr)


def check(got, rows):
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute(rows)
    stays = [r for r in got if r.kept]
    assert len({r.text_sha256 for r in stays}) == len(stays) == len({t or "" for _, t in rows})  # one row of each text
    assert all(r.doc_id == r.keep_id for r in stays)


def written(spark, rows, path, files=3):
    frame = spark.createDataFrame([(i, t, "d", "f", 1, 2) for i, t in rows], "doc_id long, text string, digest string, file string, at long, `rows` long")
    frame.repartition(files).write.mode("append").parquet(str(path))
    return str(path)


def test_rows(spark, tmp_path):
    check(stream_dedup.deduplicate(spark, written(spark, ROWS, tmp_path / "t"), batch_bytes=1).collect(), ROWS)


@pytest.mark.parametrize("width", [0, 1])
def test_colliding_digests_are_parted_by_bytes(spark, tmp_path, width, monkeypatch):
    rows = ROWS + [(100 + k, f"text {k % 40}") for k in range(120)]
    weak = lambda text: F.substring(F.sha2(text, 256), 1, width)
    path = written(spark, rows, tmp_path / "t")
    check(stream_dedup.deduplicate(spark, path, digest=weak).collect(), rows)
    monkeypatch.setattr(stream_dedup, "SMALL_ROWS", 0)
    check(stream_dedup.deduplicate(spark, path, digest=weak).collect(), rows)


def test_empty_table_and_normalised_texts(spark, tmp_path):
    path = written(spark, [], tmp_path / "e", 1)
    assert stream_dedup.deduplicate(spark, path).collect() == []
    path = written(spark, ROWS, tmp_path / "t")
    check(stream_dedup.deduplicate(spark, path, normalise=F.lower).collect(), [(i, t and t.lower()) for i, t in ROWS])


def test_a_state_goes_on(spark, tmp_path):
    state, path = str(tmp_path / "state"), tmp_path / "t"
    stream_dedup.ingest(spark, written(spark, ROWS, path), state)
    later = [(50, "x"), (51, "new"), (52, "solo")]
    check(stream_dedup.deduplicate(spark, written(spark, later, path, 1), state).collect(), ROWS + later)
    check(stream_dedup.deduplicate(spark, str(path), state).collect(), ROWS + later)  # nothing new: nothing counts twice


def test_a_hot_text(spark, tmp_path):
    rows = [(k, "hot" if k % 3 else f"t{k % 500}") for k in range(6000)]
    check(stream_dedup.deduplicate(spark, written(spark, rows, tmp_path / "t", 8)).collect(), rows)


def test_query_equals_sql_and_settings_stay(spark):
    held = {k: spark.conf.get(k, None) for k in stream_dedup.STATE}
    got = sorted(map(tuple, stream_dedup.op11_stream_dedup(spark, DATA).collect()))
    assert held == {k: spark.conf.get(k, None) for k in stream_dedup.STATE}
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    assert got == sorted(duck.sql(stream_dedup.OP11_SQL).fetchall())
