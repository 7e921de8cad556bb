import collections
import os

import pytest

import corpus_pipeline
from corpusflow.llm import pieces

from .data import documents, empty, rows
from .test_native import brute_mix, brute_spans
from .test_neardup import brute as brute_classes
from .test_neardup import shingles
from .test_quality import brute as brute_quality

pytestmark = pytest.mark.skipif(not os.path.exists(pieces.DEFAULT_MODEL), reason="no piece model")


def test_stages_follow_brute_force(spark):
    docs = documents(spark)
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality_rules"](spark, docs, "")
    expected = [r for r in rows() if brute_quality(r[1])[-1]]
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(expected, key=repr)

    one = stages["ngram_jaccard_join"](spark, kept, "")
    classes = {c for _, c, *_ in brute_classes([(r[0], r[1]) for r in expected if shingles(r[1])])}
    assert sorted((r["doc_id"] for r in one.collect()), key=repr) == sorted(classes, key=repr)

    clean = stages["secret_scan"](spark, one, "")
    assert clean.count() == one.count() and not any(brute_spans(r["text"]) for r in clean.collect())

    mixed = stages["weighted_mix"](spark, clean, "")
    assert clean.columns == mixed.columns == docs.columns
    taken, *_ = brute_mix([tuple(r) for r in clean.collect()])
    assert collections.Counter(r["doc_id"] for r in mixed.collect()) == +collections.Counter({i: t // n for i, n, _, _, t in taken if n})

    last = stages["sentencepiece_sampling"](spark, mixed, "").collect()
    assert len(last) == mixed.count() and all(r["lossless"] for r in last)


def test_empty_table(spark):
    docs = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
