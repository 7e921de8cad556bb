"""Invariants of records, search, policy, stores, ingestion and streams."""

import hashlib
import json
import random
import re
import time

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from corpusflow.functions import text as T
from corpusflow.operators import embed as M
from corpusflow.operators import guard as G
from corpusflow.operators import matching as X
from corpusflow.operators import records as R
from corpusflow.operators import search as S
from corpusflow.plans import health, ingest
from corpusflow.sources.store import Collection, load_arrays, newest_json, write_report
from corpusflow.streaming import stream as ST


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_upsert_replaces_adds_and_is_idempotent(spark):
    base = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (None, "n", 0)], "id int, v string, seq int")
    delta = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "id int, v string, seq int")
    once = R.upsert(base, delta, "id", "seq")
    assert rows(once) == rows(spark.createDataFrame([(1, "a", 0), (None, "n", 0), (2, "y", 2), (3, "z", 1)], base.schema))
    assert rows(R.upsert(once, delta, "id", "seq")) == rows(once)


def test_numbers_are_dense_and_follow_the_order(spark):
    df = spark.range(100).select((F.col("id") * 37 % 101).alias("k")).repartition(3)
    got = {r["k"]: r["new_id"] for r in R.numbered(df, "doc_", "k", 7).collect()}
    assert [got[k] for k in sorted(got)] == [f"doc_{i + 7}" for i in range(100)]


def test_defaults_are_filled(spark):
    docs = spark.createDataFrame([(1, "the cat", None, [1.0]), (2, "the dog", {"a": "b"}, None), (3, None, None, None)], "id int, text string, metadata map<string,string>, embedding array<double>")
    got = {r["id"]: r for r in R.filled(docs, "text", M.dense_vector).collect()}
    assert got[1]["metadata"] == {} and got[1]["embedding"] == [1.0] and got[2]["metadata"] == {"a": "b"} and got[3]["embedding"] is None
    assert got[2]["embedding"] == docs.where("id = 2").select(M.dense_vector(F.col("text"))).first()[0] and len(got[2]["embedding"]) == 384


DOCS = [(1, "the cat the dog"), (2, "The Cat, the DOG!"), (3, ""), (4, None), (5, "zebra"), (6, "the zebra")]


def test_vectors(spark):
    docs = spark.createDataFrame(DOCS, "id int, t string")
    v = M.sparse_vectors(docs, "id", "t")
    norms = {r[0]: r[1] for r in v.groupBy("id").agg(F.sum(F.col("value") * F.col("value"))).collect()}
    assert set(norms) == {1, 2, 5, 6} and all(abs(n - 1) < 1e-12 for n in norms.values())
    assert rows(M.term_frequencies(docs.where("id = 1"), "id", "t")) == [(1, "cat", 1), (1, "dog", 1), (1, "the", 2)]
    d = M.dense_vectors(docs, "id", "t")
    assert [r[1] for r in d.select("id", F.size("embedding")).orderBy("id").collect()] == [384, 384, 384, None, 384, 384]
    plan = M.sparse_vectors(docs, "id", "t")._jdf.queryExecution().toString()
    assert "Exchange" not in plan
    q, c = d.select(F.col("id").alias("query_id"), "embedding"), d.select(F.col("id").alias("doc_id"), "embedding")
    near = S.nearest_dense(q, c, 3, overlapping=True)
    by = {(r["query_id"], r["doc_id"]): r["distance"] for r in near.collect()}
    assert by[(1, 2)] == 0.0 and (5, 1) not in by and 0 < by[(5, 6)] < 1 and not any(3 in k for k in by)


def test_terms_are_those_of_the_token_rule(spark):
    some = ["A-b c9\x0bd", "  İstanbul \u212aelvin é漢x ", "", None, "ſtraße\tTAB\r\n", "word " * 50]
    docs = spark.createDataFrame(list(enumerate(some)), "id int, t string").repartition(2)
    expected = docs.select("id", F.explode(T.plain_tokens(F.col("t"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    assert rows(M.term_frequencies(docs, "id", "t")) == rows(expected)


def test_texts_are_counted_in_bounded_slices(spark):
    """A batch is worked on in slices of bounded bytes and rows, each handed on by itself, with the rows of the whole."""
    texts = pa.array(["a b", "b \u0130", None, ""] * 800 + ["w " * 600_000] + ["c d e " * 4000] * 90)
    parts = list(M.sliced(texts))
    assert pa.concat_arrays(parts).equals(texts) and max(map(len, parts)) <= M.SLICE_ROWS
    assert all(len(p) == 1 or pc.sum(pc.binary_length(p)).as_py() <= M.SLICE_BYTES for p in parts)
    for udf in (M._term_counts(), M._sparse(384), M._dense(384)):
        made = list(udf.func(iter([texts])))
        assert [len(m) for m in made] == [len(p) for p in parts] and max(m.nbytes for m in made) < 8 << 20
    docs = spark.createDataFrame(list(enumerate(texts.to_pylist())), "id int, t string").coalesce(1)
    got = {r["term"]: (r["n"], r["tf"]) for r in M.term_frequencies(docs, "id", "t").groupBy("term").agg(F.count("*").alias("n"), F.sum("tf").alias("tf")).collect()}
    assert got == {"a": (800, 800), "b": (1600, 1600), "i": (800, 800), "w": (1, 600_000), **{t: (90, 360_000) for t in "cde"}}


@pytest.mark.parametrize("broadcast", [True, False])
def test_lexical_overlap_equals_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(S, "BROADCAST_QUERIES", 4096 if broadcast else 0)
    monkeypatch.setattr(S, "QUERY_BLOCK", 2)
    docs = spark.createDataFrame(DOCS, "doc_id int, text string")
    asked = [(1, "the cat sat"), (2, "zebra zebra"), (3, "none"), (4, "the the cat dog"), (5, None)]
    got = S.lexical_overlap(spark.createDataFrame(asked, "query_id int, text string"), docs)
    tokens = lambda t: {w for w in "".join(c if c.isalnum() or c in "%.-" else " " for c in (t or "").lower()).split() if len(w) >= 3}
    expected = [(q, d, round(len(tokens(a) & tokens(b)) / len(tokens(a)), 6)) for q, a in asked for d, b in DOCS if tokens(a) & tokens(b)]
    assert rows(got) == sorted(expected, key=repr)
    best = S.lexical_overlap(spark.createDataFrame(asked, "query_id int, text string"), docs, 2)
    kept = [sorted((x for x in expected if x[0] == q), key=lambda x: (-x[2], x[1]))[:2] for q, _ in asked]
    assert rows(best) == sorted((x for k in kept for x in k), key=repr)


@pytest.mark.parametrize("broadcast", [True, False])
def test_dense_neighbours_equal_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(S, "BROADCAST_QUERIES", 4096 if broadcast else 0)
    monkeypatch.setattr(S, "QUERY_BLOCK", 7)
    monkeypatch.setattr(S, "CORPUS_BLOCK", 13)
    rng = random.Random(1)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(8)] if i else [0.0] * 8) for i in range(60)]
    df = spark.createDataFrame(vectors, "id long, e array<double>")
    got = S.nearest_dense(df.select(F.col("id").alias("query_id"), F.col("e").alias("embedding")), df.select(F.col("id").alias("doc_id"), F.col("e").alias("embedding")), 4)
    norm = lambda v: sum(x * x for x in v) ** 0.5 or 1.0
    expected = []
    for q, a in vectors:
        every = sorted((round(1 - sum(x * y for x, y in zip(a, b, strict=True)) / norm(a) / norm(b), 6) + 0.0, i) for i, b in vectors)[:4]
        expected += [(q, i, d, n + 1) for n, (d, i) in enumerate(every)]
    assert rows(got.select("query_id", "doc_id", "distance", "rank")) == sorted(expected, key=repr)


@pytest.mark.parametrize("overlapping", [True, False])
def test_nearest_are_kept_block_by_block(overlapping):
    """Rows come in blocks in any order, with large groups of copies; ties go to the least id, and what is held stays small."""
    rng = np.random.default_rng(3)
    d = np.maximum(rng.normal(size=(5000, 6)) - 0.5, 0)
    d[rng.integers(0, 5000, 3000)] = d[7]
    d = S._scaled(d)
    q, ids = d[rng.integers(0, 5000, 600)], rng.permutation(5000)
    found = S.Nearest(q, 4, overlapping)
    for at in range(0, 5000, 1000):
        found.add(ids[at : at + 1000], d[at : at + 1000])
        assert sum(len(x) for x, _, _ in found.held) <= 4 * len(q)
    product = q @ d.T
    distance = np.round(1 - product, 6) + 0.0
    if overlapping:
        distance[product <= 0] = np.inf
    x, y = S.first_of(distance, ids, 4)
    got = sorted(zip(*(c.to_pylist() for c in found.rows(np.arange(600))), strict=True))
    assert got == sorted(zip(x.tolist(), ids[y].tolist(), distance[x, y].tolist(), strict=True))


@pytest.mark.parametrize("broadcast", [True, False])
def test_texts_meet_as_their_vectors_do(spark, monkeypatch, broadcast):
    monkeypatch.setattr(S, "BROADCAST_QUERIES", 4096 if broadcast else 0)
    monkeypatch.setattr(S, "CORPUS_BLOCK", 50)
    rng = random.Random(6)
    said = lambda n: " ".join(f"w{rng.randint(0, 40)}" for _ in range(n))
    docs = spark.createDataFrame([(i, said(rng.randint(0, 9)) if i % 11 else None) for i in range(300)], "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame([(i, said(3)) for i in range(20)] + [(50, ""), (51, None)], "query_id long, text string")
    got = S.nearest_texts(asked, docs, 7, overlapping=True)
    vectors = lambda t, key: M.dense_vectors(t, key, "text")
    assert rows(got) == rows(S.nearest_dense(vectors(asked, "query_id"), vectors(docs, "doc_id"), 7, overlapping=True))
    assert S.nearest_texts(asked.limit(0), docs, 7).count() == 0 and S.nearest_texts(asked, docs.limit(0), 7).count() == 0
    # The corpus' vectors stand in no row where the queries are broadcast.
    assert ("ArrowEvalPython" in got._jdf.queryExecution().toString()) != broadcast


def test_shared_tokens_are_counted_in_bounded_parts(spark, monkeypatch):
    """Texts of odd characters have the tokens of the query rule, and counts are made for some rows at a time."""
    some = ["A-b%c 9.5% x", "  İst \u212aelvin é漢xyz abc\x0bdef ", "", "ſtraße\tTAB\r\nthe", "the " * 300, "abc def the elvin kelvin ist tab"] * 40
    asked = spark.createDataFrame(list(enumerate(some[:6])), "query_id long, text string")
    docs = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").repartition(2)
    tokens = lambda t, key: t.select(key, F.explode(F.array_distinct(T.query_tokens(F.col("text")))).alias("token"))
    sizes = tokens(asked, "query_id").groupBy("query_id").agg(F.count("*").alias("n"))
    expected = tokens(asked, "query_id").join(tokens(docs, "doc_id"), "token").groupBy("query_id", "doc_id").agg(F.count("*").alias("c")).join(sizes, "query_id").select("query_id", "doc_id", F.round(F.col("c") / F.col("n"), 6))
    assert rows(S.lexical_overlap(asked, docs)) == rows(expected)
    assert S.lexical_overlap(asked.limit(0), docs).count() == 0
    monkeypatch.setattr(S, "COUNTED", 60)
    monkeypatch.setattr(S, "COMMON", 5)
    postings = S.Postings(np.arange(3), pa.array([["the", "tab"], ["abc", "the"], ["the"]]))
    parts = list(postings.shared(pa.array(some[:6] * 40)))
    assert all(c.size <= 60 for _, c in parts) and [i for i, _ in parts] == list(range(0, 240, 20))
    assert np.concatenate([c for _, c in parts]).tolist() == [[0, 0, 0], [0, 1, 0], [0, 0, 0], [2, 1, 1], [1, 1, 1], [2, 2, 1]] * 40


def test_keep_matching_falls_back(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, None)], "q int, s string")
    assert rows(S.keep_matching(df, "q", F.col("s") == "a")) == [(1, "a"), (2, "c"), (3, None)]


QUESTIONS = [
    ("What is my PAN ABCDE1234F", "personal_info"), ("number 123456789012", "personal_info"), ("Should I invest now?", "advisory"), ("please recommend one", "advisory"), ("returns of the fund", "performance"),
    ("returns and nav", "factual"), ("what is the expense ratio", "factual"), ("compare sip", "performance"), ("", "factual"), ("best performing fund", "factual"),
]


def test_policy(spark):
    df = spark.createDataFrame([(q,) for q, _ in QUESTIONS], "q string")
    assert [r[0] for r in df.select(G.category(F.col("q"))).collect()] == [c for _, c in QUESTIONS]
    assert [r[0] for r in df.select(G.preferred_type(F.col("q"))).collect()][4:7] == ["performance", "metric", "metric"]
    flags = spark.createDataFrame([("should i buy",), ("what is nav",), ("top fund",)], "q string").select(G.is_advisory(F.col("q"))).collect()
    assert [r[0] for r in flags] == [True, False, True]


def test_aliases(spark):
    aliases = spark.createDataFrame([("mid cap", "Mid", 1, False), ("tax saver", "Tax", 2, True)], "alias string, entity string, priority int, free boolean")
    asked = spark.createDataFrame([(1, "acme  MID cap nav"), (2, "mid cap nav"), (3, "the tax saver"), (4, "none")], "query_id int, text string")
    assert rows(G.resolve_entities(asked, aliases, "acme")) == [(1, "Mid"), (3, "Tax")]


def test_substring_joins_equal_brute_force(spark):
    names = ["alpha", "beta fund", "gamma", "steel", "économie", "", "é", "ta", "zz", "Beta"]
    texts = ["the Alpha one", "betas", "beta fund ii", "stainlesssteel", "l'économie", "", None, "x"]
    n, t = spark.createDataFrame([(x,) for x in names], "name string"), spark.createDataFrame([(x,) for x in texts], "t string")
    assert rows(X.missing_by_substring(n, t, "name", "t")) == sorted((x,) for x in names if not any(x.lower() in (y or "").lower() for y in texts if y is not None))
    assert rows(X.containing(n, "name", t, "t")) == sorted(((x, y) for x in names for y in texts if y is not None and x in y), key=repr)


@pytest.mark.parametrize("k", [1, 4, 50])
def test_lexical_search_from_postings(spark, k):
    """The same rows as by all products: with ties, a token in every document, tokens that no document holds, and few hits."""
    rng = random.Random(8)
    words = [f"w{i:03d}" for i in range(60)]
    said = lambda n: " ".join(rng.choice(words[: rng.choice([3, 10, 60])]) for _ in range(n))
    docs = spark.createDataFrame([(i, "all " + said(rng.randint(1, 25)) if i % 9 else None) for i in range(300)], "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame([(i, said(rng.randint(1, 12)) + (" all" if i % 2 else "") + (" unknown words" if i % 3 == 0 else "")) for i in range(40)] + [(90, "none here"), (91, ""), (92, None), (93, "all")], "query_id long, text string")
    index = S.written(S.token_index(docs), "test-index")
    assert rows(S.lexical_top(queries, index, k)) == rows(S.lexical_overlap(queries, docs, k))
    assert S.lexical_top(queries.limit(0), index, k).count() == 0 and S.lexical_top(queries, index.limit(0), k).count() == 0


@pytest.mark.parametrize("kind, overlapping, k", [("clusters", False, 5), ("clusters", True, 40), ("sparse", True, 7), ("same", False, 5)])
def test_indexed_search_equals_all_pairs(spark, kind, overlapping, k):
    """With clusters most blocks are skipped; with equal, null and zero vectors the rows are the same all the same."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 24))
    if kind == "clusters":
        v = centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 24)) * 0.1
    elif kind == "sparse":
        v = np.maximum(rng.normal(size=(900, 24)) - 1.2, 0)
    else:
        v = np.repeat(centres[:2], 450, axis=0)
    data = [(i, x) for i, x in enumerate(v.tolist())] + [(2000, [0.0] * 24), (2001, None), (2002, v[0].tolist())]
    corpus = spark.createDataFrame(data, "doc_id long, embedding array<double>").repartition(3)
    queries = corpus.where("doc_id % 9 = 0 or doc_id > 1999").withColumnRenamed("doc_id", "query_id")
    pivots = S.pivots_of(corpus, 40)
    index = S.vector_index(corpus, pivots, 32).cache()
    assert index.select(F.max(F.size("ids"))).first()[0] < 150 and index.select(F.sum(F.size("ids"))).first()[0] == 902
    seen = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    assert rows(S.nearest_indexed(queries, index, pivots, k, overlapping, seen)) == rows(S.nearest_dense(queries, corpus, k, overlapping))
    assert seen[0].value and (kind != "clusters" or k > 5 or seen[1].value > 0.8 * seen[0].value)
    assert S.nearest_indexed(queries.limit(0), index, pivots, k).count() == 0


@pytest.mark.parametrize("groups", [1, 3])
def test_indexed_search_in_groups_of_queries(spark, monkeypatch, groups):
    monkeypatch.setattr(S, "BROADCAST_QUERIES", -(-30 // groups))
    rng = np.random.default_rng(5)
    corpus = spark.createDataFrame([(i, x) for i, x in enumerate(rng.normal(size=(30, 8)).tolist())], "doc_id long, embedding array<double>")
    pivots = S.pivots_of(corpus, 4)
    queries = corpus.withColumnRenamed("doc_id", "query_id")
    assert rows(S.nearest_indexed(queries, S.vector_index(corpus, pivots), pivots, 3)) == rows(S.nearest_dense(queries, corpus, 3))


@pytest.mark.parametrize("block", [4 << 20, 8])
def test_substring_joins_in_blocks(spark, monkeypatch, block):
    """Names beyond the bound are dealt to blocks; rows, repeated names and all columns stay."""
    monkeypatch.setattr(X, "BLOCK_CHARS", block)
    rng = random.Random(2)
    names = [("".join(rng.choice("abé") for _ in range(rng.randint(0, 4))), i) for i in range(40)] + [(None, 99)]
    texts = [("".join(rng.choice("abé ") for _ in range(rng.randint(0, 30))), i) for i in range(60)] + [(None, 99)]
    n, t = spark.createDataFrame(names, "name string, i int"), spark.createDataFrame(texts, "t string, j int").repartition(3)
    assert rows(X.containing(n, "name", t, "t")) == sorted(((a, i, b, j) for a, i in names for b, j in texts if a is not None and b is not None and a in b), key=repr)
    none = spark.createDataFrame([], "name string, i int")
    assert X.containing(none, "name", t, "t").count() == 0 and rows(X.missing_by_substring(n, t.limit(0), "name", "t")) == rows(n)


def test_substring_join_of_long_texts(spark):
    """Texts of a megabyte are read once, whatever the number of names."""
    names = spark.range(20_000).select(F.concat(F.lit("name "), "id").alias("name"))
    texts = spark.range(4).select(F.concat(F.repeat(F.lit("some words of prose "), 50_000), F.lit("name 77"), "id", F.lit("x")).alias("t"))
    began = time.time()
    assert {r["name"] for r in X.containing(names, "name", texts, "t").select("name").distinct().collect()} == {"name 7", "name 77", *(f"name 77{i}" for i in range(4))}
    assert time.time() - began < 60


@pytest.mark.parametrize("pattern, literal", [("abc", "abc"), (r"\bNAV\b", "nav"), (r"a+bcd?e", "bc"), (r"x|yz", ""), (r"(foo|bar) baz", " baz"), (r"(?i)Exit Load", "exit load"), (r"(ab)+", "ab"), (r"(ab)*c", "c"), (r"[", ""), (r"\d{9}", ""), ("ſteel", "teel")])
def test_required_literal(pattern, literal):
    assert X.required_literal(pattern) == literal


def test_rule_table_equals_branches(spark):
    """5,000 rules as rows give what the same rules give one after the other."""
    rng = random.Random(6)
    syllables = ["ba", "ke", "lo", "mi", "nu", "ra", "si", "to"]
    word = lambda n: "".join(rng.choice(syllables) for _ in range(n))
    shapes = (lambda: word(3), lambda: rf"(?i)\b{word(2)}\b", lambda: rf"{word(2)} +{word(1)}", lambda: rf"({word(2)}|{word(2)})$", lambda: rf"^{word(1)}[a-m]+{word(1)}", lambda: rf"{word(4)}")
    rules = [(f"c{i % 7}", rng.choice(shapes)(), i) for i in range(5000)]
    texts = [(i, " ".join(word(rng.randint(1, 3)) for _ in range(rng.randint(0, 6))).upper() if i % 5 == 0 else " ".join(word(rng.randint(1, 3)) for _ in range(rng.randint(0, 6)))) for i in range(150)] + [(200, None)]
    df = spark.createDataFrame(texts, "query_id int, text string").repartition(2)
    compiled = [(c, re.compile(p)) for c, p, _ in rules]
    expected = sorted(((i, next(c for c, p in compiled if p.search(t))) for i, t in texts if t is not None and any(p.search(t) for _, p in compiled)), key=repr)
    got = X.first_rule(df, "query_id", "text", spark.createDataFrame(rules, "category string, pattern string, priority int"))
    assert rows(got) == expected and 10 < len(expected)
    small = rules[:60]
    branches = df.select("query_id", G.first_match(F.col("text"), tuple((p, c) for c, p, _ in small)).alias("category")).where("category is not null")
    assert rows(X.first_rule(df, "query_id", "text", spark.createDataFrame(small, "category string, pattern string, priority int"))) == rows(branches)


# Stores


def test_versions_roll_back(spark, tmp_path):
    c = Collection(spark, f"file://{tmp_path}/c")
    assert c.current() is None and c.read() is None and not c.has_backup()
    one = spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int")
    assert c.upsert(one, "first", "t1") == 1
    assert c.upsert(spark.createDataFrame([("b", 2), ("c", 2)], "id string, v int"), "second", "t2") == 2
    assert rows(c.read()) == [("a", 1), ("b", 2), ("c", 2)] and c.has_backup()
    assert c.restore("t3") == 3 and rows(c.read()) == [("a", 1), ("b", 1)]
    c.reset("t4")
    assert c.read().count() == 0 and c.manifest().count() == 4
    with pytest.raises(LookupError):
        Collection(spark, f"file://{tmp_path}/none").restore("t")


def folders(c, version=None):
    return {r["bucket"]: r["folder"] for r in c.listing(version or c.current()["version"]).collect() if r["folder"]}


def test_upsert_rewrites_only_its_buckets(spark, tmp_path):
    """Buckets without a key of the delta keep their folder, and the delta's plan reads no file of theirs."""
    c = Collection(spark, f"file://{tmp_path}/c", buckets=32)
    c.upsert(spark.range(2000).select(F.concat(F.lit("k"), "id").alias("id"), F.lit(0).alias("v")), "first", "t1")
    before = folders(c)
    assert len(before) == 32
    delta = spark.createDataFrame([("k7", 1), ("k8", 1), ("new", 1)], "id string, v int")
    c.upsert(delta, "second", "t2")
    after = folders(c)
    touched = {r[0] for r in delta.select(F.pmod(F.xxhash64("id"), F.lit(32)).cast("int")).collect()}
    assert {b for b in after if after[b] != before.get(b)} == touched
    write = {f.split("/")[1] for b, f in after.items() if b in touched}
    assert len(write) == 1 and {p.name for p in (tmp_path / "c/data" / write.pop()).iterdir() if p.is_dir()} == {f"_bucket={b}" for b in touched}
    assert len(list((tmp_path / "c/data").iterdir())) == 2  # what the delta was written to is gone
    assert c.current()["rows"] == c.read().count() == 2001 and c.read().where("v = 1").count() == 3
    c.upsert(delta.limit(0), "nothing", "t3")
    assert folders(c) == after
    ordered = spark.createDataFrame([("k7", 5, 1), ("k7", 6, 2)], "id string, v int, o int")
    c.upsert(ordered, "third", "t4", "o")
    assert [r["v"] for r in c.read().where("id = 'k7'").collect()] == [6]


def test_change_feed(spark, tmp_path):
    c = Collection(spark, f"file://{tmp_path}/c", buckets=8)
    one = c.stage(spark.createDataFrame([(f"k{i}", i, {"a": "x"}) for i in range(50)], "id string, v int, m map<string,string>"))
    c.publish(one, "first", "t1")
    two = c.stage_upsert(spark.createDataFrame([("k3", 3, {"a": "x"}), ("k4", 99, {"a": "x"}), ("k5", 5, {"a": "y"}), ("n", 1, None)], "id string, v int, m map<string,string>"))
    assert rows(c.changes(one, two)) == [("k4", "changed"), ("k5", "changed"), ("n", "added")]
    assert rows(c.changes(two, one)) == [("k4", "changed"), ("k5", "changed"), ("n", "removed")]
    assert c.changes(None, one).where("change = 'added'").count() == 50 and c.changes(two, two).count() == 0
    same = {f.split("/")[1] for f in folders(c, one).values()} & {f.split("/")[1] for f in folders(c, two).values()}
    read = {p.split("/data/")[1].split("/")[0] for p in c.changes(one, two).inputFiles()}
    assert same and read  # folders in both are not read
    assert not {p.split("/c/")[1].rsplit("/", 1)[0] for p in c.changes(one, two).inputFiles()} & (set(folders(c, one).values()) & set(folders(c, two).values()))


def test_retention(spark, tmp_path):
    """What the kept publications reach stays readable; the rest goes, but for what is younger than the grace period."""
    c = Collection(spark, f"file://{tmp_path}/c", buckets=4)
    for i in range(4):
        c.upsert(spark.createDataFrame([(f"k{k}", i) for k in range(30)] if i == 0 else [(f"k{i}", i)], "id string, v int"), f"r{i}", "t")
    staged, now = c.stage_upsert(spark.createDataFrame([("later", 9)], "id string, v int")), time.time()
    expected, old = rows(c.read()), c.manifest().where("number = 3").first()["version"]
    assert c.vacuum(2, 3600, now) == ["manifest/000000002", "manifest/000000001"]  # all folders are young
    assert rows(c.read()) == expected and c.read(staged).count() == 31
    gone = c.vacuum(2, 0, now + 100)
    assert any(p.startswith("versions/") for p in gone) and any(p.startswith("data/") for p in gone) and f"versions/{staged}" in gone
    assert rows(c.read()) == expected and c.read(old).count() == 30
    assert c.restore("t") == 5 and [r["v"] for r in c.read().where("id = 'k3'").collect()] == [0]
    assert c.vacuum(1, 0, now + 100) and c.read().count() == 30 and not c.has_backup()
    with pytest.raises(LookupError):
        c.restore("t")


def test_health_after_an_upsert_equals_a_rescan(spark, tmp_path):
    """Only the folders that an upsert wrote are read for the card, and it is that of a scan of all."""
    made = lambda ids, text: spark.createDataFrame([(f"k{i}", f"{text} {i}" if i % 7 else None, f"u{i % 5}", f"t{i % 4}", "2024-01-02" if i % 2 else None, float(i % 90), 50.0) for i in ids], "id string, content string, url string, chunk_type string, fetched_at string, completeness double, relevance double")
    c = Collection(spark, f"file://{tmp_path}/c", buckets=16)
    c.upsert(made(range(3000), "text"), "first", "t1")
    first = rows(health.health(c))
    before = set(c.files.listed(f"{c.path}/states"))
    c.upsert(made([3, 5, 7000, 7001], "new"), "second", "t2")
    second = rows(health.health(c))
    new = set(c.files.listed(f"{c.path}/states")) - before
    assert len(new) == 1 and spark.read.parquet(*(f"{c.path}/states/{n}" for n in new)).count() <= 4
    by_bucket = c.read().groupBy(F.pmod(F.xxhash64("id"), F.lit(16))).agg(*(x.alias(n) for n, x in health.chunk_state().items()))
    estimates = ("distinct", "duplicates")  # of sketches, which hang a little on the order of the merge
    scanned = health.card(health.merged(by_bucket))
    assert rows(scanned.drop(*estimates)) == rows(health.health(c).drop(*estimates)) and second != first
    assert abs(scanned.first()["distinct"] - health.health(c).first()["distinct"]) < 0.05 * 3002
    r = health.health(c).first()
    assert r["documents"] == 3002 and r["types"] == 4 and abs(r["distinct"] - c.read().select("content").distinct().count()) < 0.05 * 3002
    assert rows(health.health(c).drop(*estimates)) == rows(scanned.drop(*estimates)) and set(c.files.listed(f"{c.path}/states")) == before | new
    assert rows(health.health(c, version=c.manifest().where("number = 1").first()["version"]).drop(*estimates)) == [first[0][:5] + first[0][7:]]
    c.reset("t3")
    assert health.health(c).first()["health"] == "empty"


def test_restored_batches_can_come_again(spark, tmp_path):
    """A batch that a restore took back is not skipped when it is delivered again; one that is still there is."""
    p = pages(spark, 2)
    c = Collection(spark, f"file://{tmp_path}/c")
    p.where("url like '%s0%'").coalesce(1).write.parquet(f"{tmp_path}/in")
    run = lambda check: ST.upsert_stream(spark.readStream.schema(p.schema).parquet(f"{tmp_path}/in"), ingest.transform, c, check).awaitTermination(120)
    run(f"{tmp_path}/check")
    p.where("url like '%s1%'").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run(f"{tmp_path}/check")
    whole = rows(c.read().select("id", "content"))
    assert c.current()["streams"] == {f"{tmp_path}/check": 1}
    c.restore("t")
    assert c.current()["streams"] == {f"{tmp_path}/check": 0} and c.read().count() < len(whole)
    (tmp_path / "check/commits/1").unlink()  # as if the query had failed before the commit
    for crc in (tmp_path / "check/commits").glob(".1.crc"):
        crc.unlink()
    run(f"{tmp_path}/check")
    assert rows(c.read().select("id", "content")) == whole


def test_rebuild_keeps_the_versions_before(spark, tmp_path):
    c = Collection(spark, f"file://{tmp_path}/c")
    c.upsert(spark.createDataFrame([("x", "old")], "id string, content string"), "first", "t1")
    old = spark.createDataFrame([("a", "kept"), ("b", "replaced"), (None, "no key"), ("e", "")], "id string, content string")
    assert c.rebuild(old, spark.createDataFrame([("b", "new"), ("h", "added")], "id string, content string"), "t2") == 2
    assert rows(c.read()) == [("a", "kept"), ("b", "new"), ("h", "added")]
    c.restore("t3")
    assert rows(c.read()) == [("x", "old")]


def test_json_sources_and_reports(spark, tmp_path):
    (tmp_path / "store.json").write_text(json.dumps({"ids": ["a", "b"], "documents": ["x", "y"], "metadatas": [{"k": "1"}, {}], "embeddings": [[0.5], [1.0]]}))
    assert [tuple(r) for r in load_arrays(spark, str(tmp_path / "store.json")).orderBy("id").collect()] == [("a", "x", {"k": "1"}, [0.5]), ("b", "y", {}, [1.0])]
    for n in (1, 2):
        (tmp_path / f"chunks_{n}.json").write_text(json.dumps({"chunks": [{"chunk_id": f"c{n}", "content": "t"}]}))
        time.sleep(1.1)
    assert rows(newest_json(spark, str(tmp_path / "chunks_*.json"), "chunks array<struct<chunk_id:string,content:string>>", "chunks")) == [("c2", "t")]
    write_report(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "report"))
    assert rows(spark.read.json(str(tmp_path / "report"))) == [(1, "x")]


def pages(spark, n, words=60):
    html = [(f"https://s{i}.org/p", f"<html lang='en'><title>Page {i}</title><body><h1>Heading {i}</h1><p>{' '.join(f'word{i}x{k}' for k in range(words))}</p></body></html>") for i in range(n)]
    return spark.createDataFrame([*html, ("https://bad.org/", "<p>404 Not Found</p>")], "url string, html string")


def test_long_pages_are_chunked_whole(spark):
    said = " ".join(f"Sentence {i} has word{i} in it." for i in range(400)) + " " + "x" * 5000 + " end"
    html = f"<html><body><h1>Title</h1><p>{said}</p></body></html>"
    found = ingest.transform(spark.createDataFrame([("u", html)], "url string, html string")).where("chunk_type = 'overview'").orderBy("chunk_id").collect()
    assert [r["chunk_id"] for r in found] == [f"overview_{i:03d}" for i in range(1, len(found) + 1)] and len(found) > 8
    assert all(r["token_count"] <= 500 and r["content"].startswith("Details:\nText: ") and r["vector"] for r in found)
    texts = [r["content"].removeprefix("Details:\nText: ") for r in found]
    whole = ingest.cleaned(spark.createDataFrame([("u", html)], "url string, html string")).first()["text"]
    assert "".join("".join(texts).split()) == "".join(whole.split()) and "word399" in whole
    assert texts[0].endswith("it.")


def test_gate_leaves_the_published_version(spark, tmp_path):
    c = Collection(spark, f"file://{tmp_path}/c")
    loose = {"sources": 3, "success_rate": 50, "document_count": 4}
    assert ingest.run(pages(spark, 4), c, "t1", loose, str(tmp_path / "report"))["success"]
    before = rows(c.read().select("id", "content"))
    failed = ingest.run(pages(spark, 6), c, "t2", loose | {"document_count": 10_000})
    assert not failed["success"] and [x["name"] for x in failed["checks"] if not x["passed"]] == ["document_count"]
    assert rows(c.read().select("id", "content")) == before and c.manifest().count() == 1
    assert {r["url"] for r in c.read().collect()} == {f"https://s{i}.org/p" for i in range(4)}


# Streams


def test_upsert_stream_equals_batch(spark, tmp_path):
    source = f"{tmp_path}/in"
    p = pages(spark, 5)
    p.repartition(3).write.parquet(source)
    c = Collection(spark, f"file://{tmp_path}/c")
    reader = lambda: spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 1).parquet(source)
    for _ in range(2):
        q = ST.upsert_stream(reader(), ingest.transform, c, f"{tmp_path}/check")
        q.awaitTermination(120)
    assert rows(c.read().select("id", "content")) == rows(ingest.transform(p).select("id", "content"))


def test_streams_of_their_own_lose_no_rows(spark, tmp_path):
    """Two streams, and one with a new checkpoint, feed one collection: each starts at batch 0."""
    c = Collection(spark, f"file://{tmp_path}/c")
    p = pages(spark, 4)
    for n, some in enumerate((p.where("url < 'https://s2'"), p.where("url >= 'https://s2'"))):
        some.write.parquet(f"{tmp_path}/in{n}")
        ST.upsert_stream(spark.readStream.schema(p.schema).parquet(f"{tmp_path}/in{n}"), ingest.transform, c, f"{tmp_path}/check{n}").awaitTermination(120)
    assert {r["url"] for r in c.read().collect()} == {f"https://s{i}.org/p" for i in range(4)}
    again = ST.upsert_stream(spark.readStream.schema(p.schema).parquet(f"{tmp_path}/in0"), ingest.transform, c, f"{tmp_path}/new")
    again.awaitTermination(120)
    assert rows(c.read().select("id", "content")) == rows(ingest.transform(p).select("id", "content")) and c.manifest().count() == 3


def test_one_version_of_a_page_is_taken(spark):
    body = lambda t: f"<html><h1>{t} heading</h1><p>{t * 40}</p></html>"
    two = [("u", body("old "), "2024-01-01"), ("u", body("new "), "2024-01-02"), ("v", body("one "), None), ("v", body("two "), None)]
    for order in (two, two[::-1]):
        df = spark.createDataFrame(order, "url string, html string, day string").repartition(2)
        by = {r["url"]: r["html"] for r in ingest.one_version(df, "day").collect()}
        assert "new" in by["u"] and by["v"] == max((h for u, h, _ in two if u == "v"), key=lambda h: hashlib.md5(h.encode()).hexdigest())
    found = ingest.transform(df, "day").where("url = 'u'").first()
    assert found["source_metadata"]["fetched_at"] == "2024-01-02" and found["quality_metadata"]["token_count"] == found["token_count"]


def brute_limits(requests, seconds, most):
    state, out = {}, []
    for client, at in sorted(requests):
        count, start = state.get(client, (0, 0))
        if count == 0 or at - start >= seconds:
            count, start = 0, at
        state[client] = (count + 1, start)
        out.append((client, at, count + 1 <= most))
    return out


def test_limiter_batch_and_stream_equal_brute_force(spark, tmp_path):
    rng = random.Random(4)
    requests = [(c, 1_700_000_000 + t) for c in range(3) for t in sorted(rng.sample(range(400), 60))] + [(9, 1_700_000_000 + i) for i in range(5)]
    df = spark.createDataFrame(requests, "client long, s long").select("client", F.timestamp_seconds("s").alias("at"))
    expected = sorted(brute_limits(requests, 60, 4))
    shown = lambda d: sorted((r[0], r[1], r[2]) for r in d.select("client", F.unix_timestamp("at"), "allowed").collect())
    assert shown(ST.limit_batch(df, 60, 4)) == expected
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = ST.limit_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), 60, 4)
    q = stream.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", f"{tmp_path}/check").start()
    q.processAllAvailable()
    q.stop()
    assert shown(spark.table("limited")) == expected


def test_limits_survive_a_restart_and_drop_late_rows(spark, tmp_path):
    """Files come one by one, the query is stopped and started again between them; then a request from long ago comes."""
    rng = random.Random(9)
    seen = sorted((1_700_000_000 + rng.randint(0, 900), c) for c in range(5) for _ in range(120))
    parts = [seen[i : i + 100] for i in range(0, 600, 100)]
    made = lambda part: spark.createDataFrame([(c, s) for s, c in part], "client long, s long").select("client", F.timestamp_seconds("s").alias("at"))
    folder = f"{tmp_path}/in"
    for part in [*parts, [(1_600_000_000, 1), (1_700_002_000, 1)]]:
        made(part).coalesce(1).write.mode("append").parquet(folder)
        stream = ST.limit_stream(spark.readStream.schema(made(part).schema).parquet(folder), 60, 4)
        stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").outputMode("append").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination(120)
    shown = lambda d: sorted((r[0], r[1], r[2]) for r in d.select("client", F.unix_timestamp("at"), "allowed").collect())
    got = shown(spark.read.parquet(f"{tmp_path}/out"))
    assert got == sorted(shown(ST.limit_batch(made([x for p in parts for x in p]), 60, 4)) + [(1, 1_700_002_000, True)])
    assert 0 < sum(r[2] for r in got) < len(got) - 100


@pytest.mark.parametrize("seed", range(20))
def test_windows_decide_as_requests_do(seed):
    rng = random.Random(seed)
    times = sorted(rng.randint(0, 300) for _ in range(rng.randint(0, 80)))
    count, start = rng.choice([(0, 0), (3, -20), (9, -200)])
    one, n, s = ST.decisions(times, count, start, 60, 4)
    many, m, t = ST.decided(np.array(times, np.int64), count, start, 60, 4)
    assert (one, n, s) == (many.tolist(), m, t)


def test_window_counts_and_duplicates_stream(spark, tmp_path):
    df = spark.createDataFrame([(i % 2, i % 3, 1_700_000_000 + 20 * i) for i in range(12)], "client long, k long, s long").select("client", "k", F.timestamp_seconds("s").alias("at"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    read = lambda: spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    for name, f, columns in (("counts", lambda d: ST.counts_per_window(d, "client", "at"), ("client", "window_start", "requests")), ("dedup", lambda d: ST.deduplicated(d, ["k"], "at"), ("k",))):
        q = f(read()).writeStream.format("memory").queryName(name).outputMode("complete" if name == "counts" else "append").option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
        assert rows(spark.table(name).select(*columns)) == rows(f(df).select(*columns))
