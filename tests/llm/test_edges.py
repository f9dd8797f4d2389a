"""Odd and empty tables through every operator and pipeline stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliant.llm import chat, decontam, langid, mixing, pii, quality, secrets, simhash, suffixes, warc


def by_operator(spark, docs):
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog again and again"), (2, None), (3, "short"), (None, "x" * 60)], "item_id long, text string")
    model = langid.train(docs, F.lit(True))
    return {
        "decontam": decontam.contamination(docs, bench), "mix": mixing.mix(docs), "suffixes": suffixes.remove_shared(docs).drop("kept"), "pii": pii.find(docs), "secrets": secrets.scan(docs),
        "quality": quality.assess(docs), "simhash": simhash.near_duplicates(docs), "similar": simhash.similar_documents(docs), "langid": langid.predict(docs, model),
        "warc": warc.lay_out(docs.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), F.col("text").alias("html"))),
    }


def test_odd_rows_keep_their_number(spark, odd_documents):
    n = odd_documents.count()
    for name, df in by_operator(spark, odd_documents).items():
        rows = df.collect()
        if name == "decontam":
            assert sorted((r["doc_id"], r["item_id"], r["distance"]) for r in rows) == [(4, 1, 0), (4, 1, 0)]
        else:
            assert len(rows) == n, name


def test_empty_tables(spark, no_documents):
    for name, df in by_operator(spark, no_documents).items():
        assert df.count() == 0, name


@pytest.mark.parametrize("fixture", ["odd_documents", "no_documents"])
def test_stages(spark, tmp_path, request, fixture):
    docs = request.getfixturevalue(fixture)
    spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog again and again")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns + ["copies"] * (name == corpus_pipeline.STAGES[-1][0])
        out.collect()


def test_stage_names_call_five_operators():
    assert len(corpus_pipeline.STAGES) == 5


@pytest.mark.parametrize("fixture", ["odd_documents", "no_documents"])
def test_odd_conversations(spark, request, fixture):
    docs = request.getfixturevalue(fixture)
    turns = docs.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.col("source").alias("role"), "text", F.col("fp").alias("segments"))
    got = chat.format_conversations(turns).withColumn("back", chat.read_back(F.col("formatted"))).collect()
    want = {}
    for x in turns.collect():
        want.setdefault(x["conv_id"], []).append((x["role"] or "", x["text"] or ""))
    assert {x["conv_id"]: [tuple(t) for t in x["back"]] for x in got} == {c: sorted(own) for c, own in want.items()}
