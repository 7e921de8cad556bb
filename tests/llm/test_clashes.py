"""Extra columns of any names, nulls in every column and very long texts change nothing and crash nothing."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusflow.llm import chat, licenses, media, mixing, neardup, pieces, quality, secrets, tokencounts

from .data import collected, documents

pytestmark = pytest.mark.skipif(not os.path.exists(pieces.DEFAULT_MODEL), reason="no piece model")

NAMES = (
    "id", "_id", "_doc", "_copies", "copies", "_key", "_size", "_source", "_bucket", "_upto", "_before", "source_rank", "target", "found", "lists", "low", "media", "status", "pieces", "n_pieces", "row_key", "k0", "tokens", "n_tokens",
    "node", "root", "links", "class_id", "keeper", "component", "run", "part", "at", "col", "row", "batch", "rule", "seconds", "order",
)
OPERATORS = {
    "pieces": pieces.sample_pieces, "quality": quality.quality_report, "near": neardup.near_duplicates, "media": lambda d: media.media_features(media.store(d)), "mix": mixing.mix, "secrets": secrets.secret_report,
    "licenses": licenses.license_report, "tokens": tokencounts.token_counts,
}


def clashing(docs):
    return docs.withColumns({n: F.lit("x").cast("binary") if n == "node" else F.lit(7) for n in NAMES if n not in docs.columns})


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_extra_columns_change_nothing(spark, name):
    docs = documents(spark)
    assert collected(OPERATORS[name](clashing(docs))) == collected(OPERATORS[name](docs))


def test_stages_pass_extra_columns(spark):
    docs = clashing(documents(spark))
    plain = documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs, plain = stage(spark, docs, ""), stage(spark, plain, "")
        assert collected(docs.select("doc_id", "text")) == collected(plain.select("doc_id", "text"))
        assert set(NAMES) <= set(docs.columns)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_nulls_in_every_column(spark, name):
    docs = spark.createDataFrame([(None, None, None, None, None)] * 2 + [(1, "a b c", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert OPERATORS[name](docs).count() == 3


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_very_long_texts(spark, name):
    docs = spark.range(3).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, F.repeat(F.lit("some words of prose, again. "), 150_000)).when(F.col("id") == 1, F.repeat(F.lit("unspaced"), 150_000)).otherwise("short").alias("text"), F.lit("s").alias("source"))
    assert OPERATORS[name](docs).count() == 3


def test_clashing_columns_of_conversations(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    extra = rows.withColumns({n: F.lit(7) for n in ("conv", "part", "at", "node", "leaf", "depth", "twin", "content", "chain", "path", "segment")})
    assert collected(chat.formatted_conversations(extra)) == collected(chat.formatted_conversations(rows))
