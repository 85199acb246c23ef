"""The pipeline's stages against brute force on the smallest tables."""

from pyspark.sql import functions as F

import corpus_pipeline
from fieldlab.llm import byte_bpe, language, mixing, near_dups, quality

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES][2] == "MinHash near-dedup"
    ranking = quality.fit_ranking(*quality.labelled_features(docs, labels))
    good = {r.doc_id for r in quality.quality_scores(docs, ranking, ["doc_id"]).where("score >= 0.3").collect()}
    step = corpus_pipeline.STAGES[0][1](spark, docs, DATA)
    assert {r.doc_id for r in step.collect()} == good and step.schema == docs.schema
    known = corpus_pipeline.STAGES[1][1](spark, step, DATA)
    profiles = language.learn_profiles(step)
    assert {r.doc_id for r in known.collect()} == {r.doc_id for r in language.identify(step, profiles, ["doc_id"]).where("lang_pred <> 'und'").collect()}
    first = corpus_pipeline.STAGES[2][1](spark, known, DATA)
    classes = near_dups.near_duplicates(known).collect()
    assert sorted(r.doc_id for r in first.collect()) == sorted({r.class_id for r in classes})
    mixed = corpus_pipeline.STAGES[3][1](spark, first, DATA)
    taken = {r.doc_id: (r["size"], r.taken) for r in mixing.mix_sizes(first).collect()}
    want = {k: -(-t // s) for k, (s, t) in taken.items() if t}
    got = {r.doc_id: r.n for r in mixed.groupBy("doc_id").count().withColumnRenamed("count", "n").collect()}
    assert got == want and mixed.columns == docs.columns
    last = corpus_pipeline.STAGES[4][1](spark, mixed, DATA)
    assert last.count() == mixed.count()
    assert sorted(map(tuple, corpus_pipeline.run(spark, DATA).collect())) == sorted(map(tuple, byte_bpe.encoding_digests(mixed, keep=("doc_id", "source")).collect()))


def test_language_stage_rejects(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = ["Привет как дела это русский текст и он нигде не выучен " * 5, "漢字文書の言語識別は難しい問題です" * 9, "שלום עולם זה טקסט בעברית שלא נלמד " * 5, "नमस्ते दुनिया यह हिंदी है " * 5, "xqzjk wvqxz kjqzx zzxqj vkwqz qjxkz " * 9]
    odd = spark.createDataFrame([(-1 - k, t, None, "src1", len(t)) for k, t in enumerate(texts)], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, docs.unionByName(odd), DATA).select("doc_id").collect()}
    assert not [k for k in kept if k < 0]
    clean = {r.doc_id for r in docs.where("length(text) > 200 and lang is not null").collect()}
    assert len(clean - kept) <= 0.01 * len(clean)


def test_language_stage_without_languages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language_id(spark, docs, DATA).count() == docs.count()
    blank = docs.withColumns({"lang": F.lit("en"), "text": F.lit("123")})
    assert corpus_pipeline.language_id(spark, blank, DATA).count() == docs.count()


def test_stages_take_awkward_rows(spark):
    """Nulls in any column, empty texts, repeated rows and copies, each stage by itself; and the empty table."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    text = docs.where("doc_id = 5").first().text
    odd = [(None, None, None, None, None), (None, "", None, "src1", 0), (-1, "", "en", None, 0), (-2, None, "en", "src1", None), (-3, "123 !!", None, "src2", 7)]
    odd += [(-4, text, "en", "src1", len(text))] * 3 + [(-5, text, None, None, None)]
    rows = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    n = rows.count()
    for k, (name, function) in enumerate(corpus_pipeline.STAGES):
        got = function(spark, rows, DATA)
        kept = [r.doc_id for r in got.select("doc_id").collect()]
        assert k == 4 or got.columns == docs.columns, name
        assert function(spark, docs.limit(0), DATA).count() == 0, name
        if k < 2:
            assert len(kept) <= n and kept.count(-4) in (0, 3), name
        if k == 1:
            assert not {-1, -2, -3} & set(kept) and None not in kept  # no letter
        if k == 2:
            assert kept.count(-4) + kept.count(-5) + kept.count(5) == 1 and sum(i in (None, -1, -2) for i in kept) == 1  # one of the copies, one of the empty
        if k == 3:
            assert not {-1, -2, None} & set(kept)  # no words, nothing to mix
        if k == 4:
            assert len(kept) == n
