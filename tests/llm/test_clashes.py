"""Columns of docs whose names the operators use themselves: none crashes, none is lost."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomspark.llm import decontam, jaccard, katz, langid, media, mixing, pii, quality, sufdedup
from loomspark.llm.common import fold

NAMES = ["label", "_id", "_k", "_key", "_text", "text_utf8", "hits", "_score", "score", "pass", "words", "virtual_finish", "text_key", "row", "kept", "rid", "lang_pred", "base", "spans", "times", "more", "leaks", "set_key", "size", "target", "lane"]
DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{DIR}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (9001, "", "en", "x", 0), (9001, "", "en", "x", 0), (9002, "a b " * 3000, None, None, None)], rows.schema)
    return rows.union(odd).select("*", *[F.concat(F.lit(f"{k}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for k, n in enumerate(NAMES)]).cache()


def holds(out, docs):
    """Every clashing column has its values still."""
    for r in out.select("doc_id", *NAMES).collect():
        assert [r[n] for n in NAMES] == [f"{k}:{'-' if r.doc_id is None else r.doc_id}" for k in range(len(NAMES))]
    assert set(docs.columns) <= set(out.columns)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, name):
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, DIR)
    holds(out, docs)
    assert name == "mixing" or out.columns == docs.columns
    assert dict(corpus_pipeline.STAGES)[name](spark, docs.limit(0), DIR).count() == 0


def test_kept_columns(spark, docs):
    labels = spark.read.parquet(f"{DIR}/labels.parquet").filter(fold() != 0)
    holds(quality.score(docs, quality.train(docs, labels), docs.columns), docs)
    holds(langid.predict(docs, langid.train(docs), docs.columns), docs)
    holds(pii.find(docs, docs.columns), docs)
    holds(decontam.find_leaks(docs, spark.read.parquet(f"{DIR}/benchmark.parquet"), name="found"), docs)


@pytest.mark.parametrize("work", [jaccard.similar_components, katz.score, sufdedup.remove_repeats, media.round_trip, mixing.schedule])
def test_rows_stay(docs, work):
    assert work(docs).count() == docs.count()
