import collections
import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import alignment
from corpusflow.llm.pieces import DEFAULT_MODEL
from corpusflow.llm.tokencounts import DEFAULT_RANKS

from .data import collected, documents, empty, texts

pytestmark = pytest.mark.skipif(not os.path.exists(DEFAULT_MODEL), reason="no vocabularies")
ODD = ["▁ blank", "a▁b", "<|endoftext|> plain </s>", "naïve 漢字🎉🎉 ̀́", "\t\t\n\n  x ", "a" * 300, "the " * 60, "ﬁ ½ ſ", "﻿bom"]


def groups(text, both):
    """Groups of token ids by byte offsets, one byte after the other."""
    if not text:
        return []
    a, b = both.a.encode_ordinary(" " + text), both.b.encode(text)
    a_bytes = [both.a.decode_single_token_bytes(i) for i in a]
    expected = (" " + text).encode()
    if b"".join(a_bytes) != expected or b"".join(both.b_bytes[i] for i in b) != expected:
        return []
    ends = [set(np.cumsum([len(x) for x in a_bytes]).tolist()), set(np.cumsum([len(both.b_bytes[i]) for i in b]).tolist())]
    shared, found, i, j, at_a, at_b = ends[0] & ends[1], [], 0, 0, 0, 0
    for end in sorted(shared):
        xs, ys = [], []
        while at_a < end:
            xs.append(a[i])
            at_a += len(a_bytes[i])
            i += 1
        while at_b < end:
            ys.append(b[j])
            at_b += len(both.b_bytes[b[j]])
            j += 1
        found.append((xs, ys))
    return found


def brute(rows):
    both = alignment.sides(DEFAULT_RANKS, DEFAULT_MODEL)
    each = [(i, groups(t, both)) for i, t in rows]
    docs = collections.Counter(p for _, g in each for p in {(x, y) for xs, ys in g for x in xs for y in ys})
    most = collections.defaultdict(int)
    for (x, _), n in docs.items():
        most[x] = max(most[x], n)
    out = []
    for i, g in each:
        links = [(x, y) for xs, ys in g for x in xs for y in ys]
        said = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in g)
        digest = hashlib.sha256(said.encode()).hexdigest() if g else ""
        out.append((i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links), sum(docs[p] == most[p[0]] for p in links), sum(docs[p] for p in links), digest))
    return sorted(out, key=repr), docs


def rows():
    return [*enumerate([*texts(), *ODD]), (3, texts()[3]), (None, "no id")]


@pytest.mark.parametrize("block", [1 << 22, 800])
def test_equals_brute_force(spark, monkeypatch, block):
    """With one block of pairs, and with several blocks and hash buckets."""
    monkeypatch.setattr(alignment, "BLOCK_PAIRS", block)
    monkeypatch.setattr(alignment, "BUCKET_PAIRS", min(block, alignment.BUCKET_PAIRS) // 4)
    few = rows() if block > 800 else [(i, t) for i, t in rows() if len(t or "") < 300]
    df = spark.createDataFrame(few, "doc_id long, text string").repartition(3)
    assert collected(alignment.aligned_documents(df)) == brute(few)[0]


def test_pairs_equal_brute_force(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string").repartition(5)
    expected = brute(rows())[1]
    got = {(r["a"], r["b"]): (r["docs"], r["best"]) for r in alignment.token_pairs(df).collect()}
    assert {p: n for p, (n, _) in got.items()} == expected
    assert all(best == (n == max(m for (x, _), m in expected.items() if x == p[0])) for p, (n, best) in list(got.items())[:300])


@pytest.mark.parametrize("links", [1 << 21, 1 << 24, 5000])
def test_many_links_of_one_group(monkeypatch, links):
    """A group of many tokens on both sides is linked by its distinct tokens; the figures are those of all its links."""
    monkeypatch.setattr(alignment, "LINKS", links)
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 40, 3000), rng.integers(0, 30, 2500)
    chunk = alignment.Aligned(None, a, b, np.zeros(3000, np.int64), np.zeros(2500, np.int64), np.zeros(1, np.int64), 1000)
    document, pair, links = chunk.pairs()
    expected = {x * 1000 + y: n * m for x, n in collections.Counter(a.tolist()).items() for y, m in collections.Counter(b.tolist()).items()}
    assert dict(zip(pair.tolist(), links.tolist(), strict=True)) == expected and not document.any()


@pytest.mark.parametrize("n", [0, 1, 2, 100, 5000])
def test_hash_is_minimal_and_perfect(spark, monkeypatch, n):
    monkeypatch.setattr(alignment, "BUCKET_PAIRS", 300)
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 32, n))
    hash_ = alignment.perfect_hash(spark.createDataFrame([(int(k),) for k in keys], "pair long"), len(keys))
    assert sorted(hash_.numbers(keys).tolist()) == list(range(len(keys)))
    lookup = alignment.Lookup(hash_, keys[np.argsort(hash_.numbers(keys))], np.ones(len(keys), np.int64), np.ones(len(keys), bool))
    if n:
        strange = np.setdiff1d(np.arange(2000), keys)
        assert not lookup.of(strange)[0].any() and lookup.of(keys)[0].all()


def test_vectors_are_summed_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(alignment, "FAN_IN", 2)
    monkeypatch.setattr(alignment, "SLICE", 16)
    pairs = spark.range(0, 100, 1, 3).select(F.col("id").alias("pair"))
    partials = spark.range(0, 7000, 1, 7).select((F.col("id") * 31 % 100).alias("pair"), F.lit(2).cast("long").alias("docs"))
    _, table = alignment.pair_counts(partials, pairs, 100, 10)
    assert {r["pair"]: r["docs"] for r in table.collect()} == {p: 140 for p in range(100)}


def test_decimals():
    ids = np.array([0, 7, 10, 99, 100, 12345, 9999999])
    said, size = alignment.decimals(ids, np.full(7, ord(",")))
    assert [x.tobytes().rstrip(b"\0").decode() for x in said] == [f"{i}," for i in ids] and size.tolist() == [len(f"{i},") for i in ids]


def test_edge_cases(spark):
    assert alignment.aligned_documents(empty(spark)).count() == 0
    extra = documents(spark).withColumns({c: F.lit(7) for c in ("key", "pair", "row", "n_a", "docs_", "best", "slice")})
    assert collected(alignment.aligned_documents(extra)) == collected(alignment.aligned_documents(documents(spark)))
    long = spark.range(2).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, F.repeat(F.lit("some words of prose, "), 50_000)).otherwise(F.repeat(F.lit("unspaced"), 20_000)).alias("text"))
    assert all(r["n_a"] and r["n_b"] for r in alignment.aligned_documents(long).collect())
