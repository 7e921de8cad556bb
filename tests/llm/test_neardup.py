import collections
import itertools
import re

import numpy as np
import pytest

from corpusflow.llm import neardup

from .data import collected, documents, edited, empty, prose, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def brute(pairs):
    """(id, class_id, n_links, n_copies) of (id, text) pairs."""
    texts = collections.defaultdict(list)
    for i, t in pairs:
        texts[t].append(i)
    sets = {t: shingles(t) for t in texts}
    worded = [t for t in texts if sets[t]]
    root = {t: t for t in worded}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    links = collections.Counter()
    for a, b in itertools.combinations(worded, 2):
        shared = len(sets[a] & sets[b])
        if 5 * shared >= 4 * (len(sets[a]) + len(sets[b]) - shared):
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    least = collections.defaultdict(list)
    for t in worded:
        least[find(t)] += [i for i in texts[t] if i is not None]
    out = []
    for t, ids in texts.items():
        for i in ids:
            out.append((i, min(least[find(t)], default=None), links[t], len(ids)) if sets[t] else (i, i, 0, 1))
    return sorted(out, key=repr)


def test_equals_brute_force(spark):
    got = collected(neardup.near_duplicates(documents(spark)))
    assert got == brute([(r[0], r[1]) for r in rows()])


def test_group_of_near_copies_in_blocks(spark, monkeypatch):
    base = prose(120, 77)
    pairs = [(i, edited(base, 1 + i % 4, 1000 + i)) for i in range(60)] + [(100 + i, prose(80, 500 + i)) for i in range(20)] + [(200 + i, base) for i in range(15)]
    monkeypatch.setattr(neardup, "BLOCK_NODES", 16)
    got = collected(neardup.near_duplicates(spark.createDataFrame(pairs, "doc_id long, text string")))
    assert got == brute(pairs)


@pytest.mark.parametrize("run_nodes", [2000, 8])
def test_links_are_found_where_pivots_are_unlike(spark, monkeypatch, run_nodes):
    """One passage in two texts that are linked, and in thousands of longer documents that are not."""
    monkeypatch.setattr(neardup, "RUN_NODES", run_nodes)
    rng = np.random.default_rng(8)
    own = lambda n: " " + " ".join(f"w{w:x}" for w in rng.integers(0, 2**40, n).tolist())
    passage = own(104).strip()
    pairs = [(i, passage + own(12)) for i in range(2)] + [(2 + i, passage + own(200)) for i in range(8000)]
    assert brute(pairs[:40])[0] == (0, 0, 1, 1)
    got = collected(neardup.near_duplicates(spark.createDataFrame(pairs, "doc_id long, text string")))
    assert got == sorted([(0, 0, 1, 1), (1, 0, 1, 1)] + [(i, i, 0, 1) for i in range(2, 8002)], key=repr)


def test_chain_of_versions(spark, monkeypatch, n=400, width=1):
    """Each version is linked to its neighbours only. A large chain is verified pair by pair, and finds what blocks find."""
    monkeypatch.setattr(neardup, "BLOCK_NODES", 10)
    rng = np.random.default_rng(12)
    w, pairs, step = [f"w{x:x}" for x in rng.integers(0, 2**40, 20_000).tolist()], [], 10 // width
    for i in range(n):
        pairs.append((i, " ".join(w[i * step : i * step + 104])))
    sets = [shingles(t) for _, t in pairs]
    linked = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    links = [sum(linked(i, j) for j in range(max(0, i - 12), min(n, i + 13)) if j != i) for i in range(n)]
    listed = []
    verified = neardup.verified
    monkeypatch.setattr(neardup, "verified", lambda p, *a: listed.append(p.count()) or verified(p, *a))
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    got = sorted(collected(neardup.near_duplicates(df)))
    assert [(r[0], r[2]) for r in got] == list(enumerate(links))
    assert {r[1] for r in got} == {0} and n - 1 <= listed[0] < 12 * width * n
    monkeypatch.setattr(neardup, "CHAIN_SHARE", 0)
    assert sorted(collected(neardup.near_duplicates(df))) == got


def test_one_of_each_keeps_the_least_id_with_its_columns(spark):
    kept = collected(neardup.one_of_each(documents(spark)))
    classes = {r[0]: r[1] for r in brute([(r[0], r[1]) for r in rows()]) if r[0] is not None}
    assert {r[0] for r in kept if shingles(r[1]) and r[0] is not None} == {c for i, c in classes.items() if shingles(dict((r[0], r[1]) for r in rows())[i])}
    assert set(kept) <= set(rows())
    assert sum(shingles(r[1]) is None for r in kept) == sum(shingles(r[1]) is None for r in rows())


def test_empty(spark):
    assert neardup.near_duplicates(empty(spark)).count() == 0
    assert neardup.one_of_each(empty(spark)).count() == 0


def test_prefixes_are_shortened_to_the_target():
    depth = neardup.prefix_depth()
    assert neardup.recall(0.8, depth) >= neardup.TARGET_RECALL > neardup.recall(0.8, depth + 1)
    assert neardup.prefix_depth(target=0.5) == neardup.DEPTH


def test_sketches_do_not_depend_on_slices(monkeypatch):
    texts = ["", prose(30, 1), prose(4000, 2), "a b", prose(700, 3)]
    data = [t.encode() for t in texts]
    buf, offs = np.frombuffer(b"".join(data), np.uint8), np.cumsum([0] + [len(d) for d in data])
    values, of, _ = neardup.shingles(buf, offs)
    whole = neardup.sketches(values, of, len(texts))
    monkeypatch.setattr(neardup, "SKETCH_AT_ONCE", 100)
    assert (neardup.sketches(values, of, len(texts)) == whole).all() and not whole[0].any() and whole[1].any()
    single = [neardup.shingles(np.frombuffer(d, np.uint8), np.array([0, len(d)]))[0] for d in data]
    assert all((values[of == i] == s).all() for i, s in enumerate(single))


def test_very_long_texts(spark):
    """Texts of some megabytes, with and without blanks, meet their near copies."""
    rng = np.random.default_rng(3)
    w = [f"w{x:x}" for x in rng.integers(0, 2**40, 300_000).tolist()]
    long = " ".join(w)
    edits = " ".join(x if i % 60 else "edited" for i, x in enumerate(w))
    blob = "x" * 3_000_000
    pairs = [(1, long), (2, edits), (3, blob), (4, blob), (5, blob + "y"), (6, " ".join(reversed(w)))]
    got = collected(neardup.near_duplicates(spark.createDataFrame(pairs, "doc_id long, text string")))
    assert got == [(1, 1, 1, 1), (2, 1, 1, 1), (3, 3, 0, 2), (4, 3, 0, 2), (5, 5, 0, 1), (6, 6, 0, 1)]


def test_recall_on_documents_of_shared_passages(spark):
    """Documents made of passages that stand in many others: linked pairs end in one class."""
    rng = np.random.default_rng(4)
    passages = [" ".join(f"p{x:x}" for x in rng.integers(0, 2**40, 30).tolist()) for _ in range(60)]
    own = lambda n: " ".join(f"o{x:x}" for x in rng.integers(0, 2**40, n).tolist())
    pairs, linked = [], 300
    for i in range(linked):
        body = " ".join(rng.choice(passages, 3)) + " " + own(30)
        pairs += [(2 * i, body + " " + own(9)), (2 * i + 1, body + " " + own(9))]
    pairs += [(10_000 + i, " ".join(rng.choice(passages, 2)) + " " + own(100)) for i in range(600)]
    sets = {i: shingles(t) for i, t in pairs}
    links = [(2 * i, 2 * i + 1) for i in range(linked) if 5 * len(sets[2 * i] & sets[2 * i + 1]) >= 4 * len(sets[2 * i] | sets[2 * i + 1])]
    got = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(spark.createDataFrame(pairs, "doc_id long, text string")).collect()}
    assert len(links) > 150 and sum(got[a] == got[b] for a, b in links) >= 0.999 * len(links)
    assert sum(got[10_000 + i] == 10_000 + i for i in range(600)) > 590


def test_overlaps():
    rng = np.random.default_rng(1)
    left, right = ([np.unique(rng.integers(0, 5000, 900).astype(np.uint64)) for _ in range(n)] for n in (7, 5))
    expected = [[len(np.intersect1d(a, b)) for b in right] for a in left]
    assert neardup.overlaps(left, right).tolist() == expected


@pytest.mark.parametrize("text", ["", "a", "a b c d", "a b c d e", "a  b\tc\nd e f g"])
def test_shingle_counts(text):
    values, of, n_words = neardup.shingles(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
    assert len(set(values.tolist())) == len(shingles(text) or ())
    assert n_words.tolist() == [len(text.split())]


def test_sketch_agreement_estimates_similarity():
    a = prose(400, 9)
    b = edited(a, 6, 10)
    buf = (a + b).encode()
    values, of, _ = neardup.shingles(np.frombuffer(buf, np.uint8), np.array([0, len(a.encode()), len(buf)]))
    s = neardup.sketches(values, of, 2)
    x, y = shingles(a), shingles(b)
    assert abs((s[0] == s[1]).mean() - len(x & y) / len(x | y)) < 0.12
