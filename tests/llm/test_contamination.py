import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import contamination as con

from .data import collected, documents, empty, prose

ITEMS = [(1, prose(40, 50)), (2, prose(12, 51)), (2, prose(11, 52)), (3, "only four words here"), (4, None), (5, " ,.; "), (None, prose(15, 53)), (10, "a a a a a a a a a a a a"), (11, prose(40, 50)), (12, "word")]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def docs():
    rng = random.Random(4)
    one, two = prose(40, 50).split(), prose(12, 51)
    found = [" ".join(one[:10]), " ".join(one[:9]), " ".join(one[3:30]).upper(), two + " " + two, prose(100, 60) + " Only, FOUR words -- here! " + prose(30, 61), "a " * 500, None, "", "?!", "É " + prose(15, 53), "x wordy word"]
    for k in range(40):
        parts = [" ".join((prose(30, 70 + k) if rng.random() < 0.5 else rng.choice(ITEMS)[1] or "").split()[rng.randint(0, 3) :]) for _ in range(rng.randint(1, 4))]
        found.append(rng.choice([" ", ", ", "\n"]).join(parts))
    return [*enumerate(found), (2, found[2]), (None, found[0])]


def brute(rows, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add("" if item is None else str(item))
    out = []
    for key, text in rows:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for p in range(len(w) - size + 1):
                if (g := tuple(w[p : p + size])) in windows:
                    hit |= set(range(p, p + size))
                    found |= windows[g]
        spans = [(p, next(e for e in range(p, len(w) + 1) if e not in hit)) for p in sorted(hit) if p - 1 not in hit]
        out.append((key, len(w), spans, sorted(found)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard, block", [(8 << 20, 16 << 20), (300, 60)])
def test_equals_brute_force(spark, monkeypatch, shard, block):
    """In one pass, and with small shards and the benchmark in several blocks."""
    monkeypatch.setattr(con, "BLOCK_CHARS", block)
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = spark.createDataFrame(docs(), "doc_id long, text string").repartition(3)
    scanned = con._scanned
    monkeypatch.setattr(con, "_scanned", lambda *a: scanned(*a))
    monkeypatch.setattr(con, "SHARD_BYTES", shard)
    got = [(r["doc_id"], r["n_words"], [(s["start"], s["end"]) for s in r["hits"]], r["items"]) for r in con.contamination(df, benchmark).collect()]
    assert sorted(got, key=repr) == brute(docs(), ITEMS)


@pytest.mark.parametrize("n, kinds, depth", [(1, 1, 5), (50, 3, 4), (400, 2, 400), (3000, 500, 64), (300, 1, 300)])
def test_suffix_array(n, kinds, depth):
    """The order is that of the suffixes, compared over the depth."""
    rng = np.random.default_rng(n)
    sizes = np.array([n // 3, n - n // 3])
    closed, starts = con.ended(rng.integers(1000, 1000 + kinds, n).astype(np.uint64), sizes)
    order = con.suffix_array(closed, depth)
    shown = closed.tolist()
    assert sorted(order.tolist()) == list(range(len(closed))) and starts[-1] == n + 2
    keys = [shown[p : p + depth] for p in order.tolist()]
    assert all(a <= b for a, b in zip(keys, keys[1:], strict=False))


def test_equal_high_bits_are_told_apart():
    words_ = np.array([5 << 40 | 1, 5 << 40 | 2, 5 << 40 | 1, 5 << 40], np.uint64)
    assert words_[con.sorted_order(words_)].tolist() == sorted(words_.tolist())


def test_longest_matches(spark):
    """For each word of each item, the longest run of the item's words from there on that stands in some document."""
    items, rows = ITEMS[:3] + ITEMS[7:8], docs()
    benchmark = spark.createDataFrame([(f"{i}-{k}", t) for k, (i, t) in enumerate(items)], "item_id string, text string")
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    said, got = {k: words(t) for k, t in rows}, con.longest_matches(df, benchmark).collect()
    assert len(got) == sum(len(words(t)) for _, t in items)
    by = {f"{i}-{k}": words(t) for k, (i, t) in enumerate(items)}
    for r in got:
        w = by[r["item_id"]][r["place"] :]
        best = max((next((n for n in range(len(w), 0, -1) if d[p : p + n] == w[:n]), 0) for d in said.values() for p in range(len(d))), default=0)
        assert r["length"] == best
        if best:
            assert said[r["doc_id"]][r["at"] : r["at"] + best] == w[:best]


def test_affected_documents_go(spark):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    df = spark.createDataFrame(docs(), "doc_id long, text string").withColumns({c: F.lit(7) for c in ("key", "hits", "items", "row", "n_words")})
    kept = con.decontaminated(df, benchmark)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted((k, t) for k, t in docs() if k is not None and not next(b for b in brute([(k, t)], ITEMS))[2])


def test_edge_cases(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert con.contamination(empty(spark), benchmark).count() == 0
    assert not any(r["hits"] or r["items"] for r in con.contamination(documents(spark), none).collect())
    extra = documents(spark).withColumns({c: F.lit(7) for c in ("item_id", "hits", "items", "row")})
    assert collected(con.contamination(extra, benchmark)) == collected(con.contamination(documents(spark), benchmark))
    long = spark.range(2).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, F.repeat(F.lit("a "), 400_000)).otherwise(F.repeat(F.lit("unspaced"), 100_000)).alias("text"))
    assert sorted((r["n_words"], [tuple(s) for s in r["hits"]]) for r in con.contamination(long, benchmark).collect()) == [(1, []), (400_000, [(0, 400_000)])]


def test_spans_of_several_passes(spark):
    df = spark.createDataFrame([([(5, 9), (0, 2), (2, 4), (6, 7), (20, 21)],), ([],)], f"hits {con.HITS}")
    assert [[tuple(s) for s in r[0]] for r in df.select(con.merged(F.col("hits"))).collect()] == [[(0, 4), (5, 9), (20, 21)], []]


def test_words_need_no_latin():
    assert con.hashed_words(pa.array(["Ab É漢 x9", None, ""]))[1].tolist() == [3, 0, 0]
