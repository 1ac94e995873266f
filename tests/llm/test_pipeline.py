"""The corpus pipeline, stage by stage, on the smallest tables."""

import random

import corpus_pipeline
from tessera.llm.scratch import materialize
from test_near_dedup import DOC, brute, corpus

DATA = "/root/testdata/sf0.001"


def test_each_stage_works_on_what_the_last_one_kept(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialize(stage(spark, docs, DATA), name)
        assert after.columns == docs.columns and after.join(docs, "doc_id", "left_anti").isEmpty()
        docs = after
        kept.append(docs.count())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert kept == sorted(kept, reverse=True) and kept[-1] < kept[0]
    assert packed.select("doc_id").distinct().count() == kept[-1]


def test_filtering_stages_keep_what_the_operators_accept(spark):
    from tessera.llm.quality_crf import quality
    from tessera.llm.toxicity import toxicity

    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    for name, judged, good in (("toxicity", toxicity(docs, labels), 0), ("quality_classifier", quality(docs, labels), 1)):
        kept = dict(corpus_pipeline.STAGES)[name](spark, docs.withColumn("_dropped", docs.doc_id), DATA)
        assert kept.columns == [*docs.columns, "_dropped"]
        assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(r[0] for r in judged.where(judged.predicted == good).select("doc_id").collect())


def test_near_dedup_stage_drops_copies_from_80_percent_on(spark):
    docs, rnd = corpus(4), random.Random(5)
    for i in range(60):  # one changed word inside 44 to 60 words: 78 % to 85 % in common
        words = [f"w{rnd.randrange(10**6)}" for _ in range(44 + i % 17)]
        copy = [*words[:20], "changed", *words[21:]]
        docs += [(10_000 + 2 * i, " ".join(words)), (10_001 + 2 * i, " ".join(copy))]
    table = spark.createDataFrame([*docs, (None, docs[-1][1])], DOC)
    table = table.withColumn("_dropped", table.doc_id).withColumn("kept", table.text)
    stage = corpus_pipeline.near_dedup(spark, table, DATA)
    assert stage.columns == table.columns
    rows = [r["doc_id"] for r in stage.collect()]
    assert rows.count(None) == 1
    kept = sorted(d for d in rows if d is not None)
    want = {percent: sorted(r[0] for r in brute(docs, percent) if r[3]) for percent in (80, 85)}
    assert kept == want[80] != want[85]


def test_the_last_stage_gives_tokens(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], DOC)
    packed = corpus_pipeline.packing(spark, docs, DATA).collect()
    assert sorted((r["doc_id"], len(r["ids"]) == r["length"], r["ids"][-1]) for r in packed) == [(1, True, 0), (2, True, 0)]
