"""Mixing, secret scans and URL filters against brute force; their plans hold no Python."""

import collections
import hashlib
import itertools
import re

import pytest
from pyspark.sql import functions as F

from corpusflow.llm import mixing, secrets, urls

from .data import SCHEMA, collected, documents, empty, prose, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plan(df):
    return df._jdf.queryExecution().toString()


# Mixing


def brute_mix(docs):
    items = [(r[0], r[3], len(WORD.findall(r[1] or "")), hashlib.md5("|".join(("mix-1", "" if r[0] is None else str(r[0]), hashlib.md5((r[1] or "").encode()).hexdigest())).encode()).hexdigest()) for r in docs]
    names = sorted({s for _, s, *_ in items}, key=lambda s: (s is None, s or ""))
    size = collections.Counter()
    for _, s, n, _ in items:
        size[s] += n
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    budget, target, free = 1.5 * sum(size.values()), {}, set(names)
    while free:  # reshare what is above the limits until none is
        left = budget - sum(target.values())
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) >= 2 * size[s]]
        if not over:
            target |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
            break
        for s in over:
            target[s] = 2.0 * size[s]
        free -= set(over)
    entries, upto = [], collections.Counter()
    for n, (i, s, words, key) in sorted(enumerate(items), key=lambda x: (x[1][3], x[1][0] is not None, x[1][0] or 0)):
        upto[s] += words
        for again in (0, 1):
            finish = (again * size[s] + upto[s]) / target[s] if target[s] else 0.0
            entries.append((finish, names.index(s), again, key, n, words))
    taken, total = collections.Counter(), 0
    for *_, n, words in sorted(entries):
        if total + words > budget:
            break
        total += words
        taken[n] += words
    return [(i, words, size[s], target[s], taken[n]) for n, (i, s, words, _) in enumerate(items)], target, size


def close(a, b):
    return len(a) == len(b) and all(x[:3] == y[:3] and abs(x[3] - y[3]) < 1e-6 and x[4] == y[4] for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("bucket", [3, 2000])
def test_mix_equals_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
    got = sorted((tuple(r) for r in mixing.mix(documents(spark)).drop("copies").collect()), key=repr)
    expected, target, size = brute_mix(rows())
    assert close(got, sorted(expected, key=repr))
    assert all(r[4] <= 2 * r[1] for r in got)
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6


def test_mix_meets_targets(spark):
    docs = [(i, prose(30 + i % 50, i), "en", f"s{i % 5 if i % 3 else 0}", 0, 0, "", 0, "", "") for i in range(400)]
    got = mixing.mix(spark.createDataFrame(docs, SCHEMA)).collect()
    by = collections.Counter()
    for r, d in zip(sorted(got, key=lambda r: r["doc_id"]), docs, strict=True):
        by[d[3]] += r["taken"]
    for r, d in zip(sorted(got, key=lambda r: r["doc_id"]), docs, strict=True):
        assert abs(by[d[3]] - r["target"]) <= 160, d[3]


def test_mixed_documents_hold_each_copy(spark):
    docs = documents(spark)
    copies = collections.Counter()
    for r in mixing.mix(docs).collect():
        copies[r["doc_id"]] += r["copies"]
    held = mixing.mixed_documents(docs)
    assert held.columns == docs.columns
    assert collections.Counter(r["doc_id"] for r in held.collect()) == +copies


def test_mix_is_native_and_takes_empty_tables(spark):
    df = mixing.mix(empty(spark))
    assert df.count() == 0
    assert "Python" not in plan(mixing.mix(documents(spark))) and "Arrow" not in plan(df)


# Secrets

PATTERNS = {
    "assign": re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile("AKIA[A-Z0-9]+"),
    "hex": re.compile("[0-9a-f]+"),
}
SECRET_TEXTS = [
    "", None, "token = abcdefgh", "TOKEN:'abc'", "secret=token:abcdefgh", "token==abcdef password: \"hunter22\"", "api_key=12345 apikey: 123456", "AKIA" + "A" * 15, "AKIA" + "B" * 16, "AKIAAKIA" + "C" * 12,
    "0123456789abcdef01234567", "x" + "a" * 23 + "g" + "b" * 24, "é漢🎉 token=" + "deadbeef" * 4 + " é AKIA" + "Z" * 30, "ToKeN = zzzzzz" * 3, "tokenſecret=abcdefg paſſword=abcdefg", "ghp_" + "a1B2" * 9, "eyJhbGciOiJI.eyJzdWIiOi.abcdefghij",
    "-----BEGIN RSA PRIVATE KEY-----", ("word " * 3000) + "passwd='s3cr3t/+='", "secret" * 200,
]


def brute_spans(text):
    found = []
    for number, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in pattern.finditer(text or ""):
            if (kind == "assign" and len(m[2]) >= 6) or (kind == "access" and len(m[0]) >= 20) or (kind == "hex" and len(m[0]) >= 24):
                found.append((m.start(), number, m.end(), kind))
    return sorted(found)


def secret_rows():
    return [(i, t, "en", "s", 0, 0, "", 0, "", "") for i, t in enumerate(SECRET_TEXTS)] + [(3, "token = abcdefgh", "en", "s", 0, 0, "", 0, "", "")] * 2 + rows()


def test_secrets_equal_brute_force(spark):
    docs = spark.createDataFrame(secret_rows(), SCHEMA)
    expected = []
    for r in secret_rows():
        s = brute_spans(r[1])
        n = collections.Counter(x[3] for x in s)
        expected.append((r[0], n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in s).encode()).hexdigest()))
    report = secrets.secret_report(docs)
    assert sorted((tuple(r)[:5] for r in report.collect()), key=repr) == sorted(expected, key=repr)
    assert "Python" not in plan(report) and "Arrow" not in plan(report)


def test_added_kinds(spark):
    docs = spark.createDataFrame([(1, "ghp_" + "a1B2" * 9), (2, "x eyJhbGciOiJI.eyJzdWIiOi.abcdefghij"), (3, "-----BEGIN RSA PRIVATE KEY-----")], "doc_id long, text string")
    assert {r["doc_id"]: r["spans"] for r in secrets.secret_report(docs).collect()} == {1: "github:0:40", 2: "jwt:2:36", 3: "pem:0:31"}


def test_index_loses_no_match(spark):
    """Each text that a rule matches is a candidate by its trigrams."""
    for rule in secrets.RULES:
        query = secrets.trigram_query(rule.pattern)
        for text in SECRET_TEXTS:
            if text and re.search(rule.pattern, text, re.ASCII):
                assert all(any(all(t in text.lower() for t in s) for s in clause) for clause in query), (rule.kind, text)
    assert secrets.trigram_query(r"[0-9a-f]{24,}") == []
    assert secrets.trigram_query("abc(de|fg)?h[ij]k+") and secrets.trigram_query("a.c") == []


def test_inverted_index_equals_brute_force(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(SECRET_TEXTS)], "doc_id long, text string")
    wanted = secrets.wanted_trigrams(secrets.RULES)
    expected = sorted((t, i) for i, text in enumerate(SECRET_TEXTS) for t in wanted if t in (text or "").lower())
    assert sorted(map(tuple, secrets.inverted(docs).collect())) == expected
    lists = collections.defaultdict(set)
    for t, i in expected:
        lists[t].add(i)
    for rule in secrets.RULES[:2]:  # the documents that the posting lists give are those that the rows' own flags give
        query = secrets.trigram_query(rule.pattern)
        by_lists = set.intersection(*(set.union(*(set.intersection(*(lists[t] for t in s)) for s in clause)) for clause in query))
        low = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("low")).select("doc_id", secrets.posted(F.col("low"), wanted).alias("p"))
        assert {r["doc_id"] for r in low.where(secrets.candidate(F.col("p"), wanted, rule)).collect()} == by_lists


def test_redaction(spark):
    docs = spark.createDataFrame(secret_rows(), SCHEMA)
    got = secrets.redact(docs).collect()
    assert len(got) == len(secret_rows()) and secrets.redact(docs).columns == docs.columns
    for r in got:
        assert not brute_spans(r["text"])
    by = {r["doc_id"]: r for r in got if r["source"] == "s" and r["key"] == ""}
    assert by[12]["text"] == "é漢🎉 [SECRET] é [SECRET]" and by[12]["n_chars"] == len(by[12]["text"])
    assert by[1]["text"] is None and by[11]["text"] == "x" + "a" * 23 + "g[SECRET]"
    assert secrets.secret_report(empty(spark)).count() == 0


# URL filters

PAGES = [
    ("https://a.b.example.com/x/y", 50), ("http://user:p@A.B.example.com:80/x", 150), ("https://example.com", 250), ("https://example.com", 250), ("ftp://other.org/", 90_000), (None, 10), ("not a url", 10),
    ("http://1.2.3.4/x", 30), ("https://old.net/", 2_000_000_000), ("https://old.net/", 400), ("https://old.net/", 1_000_000_001),
    ("https://a.b.example.com./q?r#s", None), ("https://b.example.com/x", 199), ("https://b.example.com/x", 200), ("https://one/", 100_000),
]
ENTRIES = [("example.com", "spam", "add", 100), ("example.com", "spam", "remove", 200), ("b.example.com", "ads", "add", 0), ("a.b.example.com/x", "malware", "add", 40), ("other.org", "ads", "add", 10), ("other.org", "ads", "add", 20), ("one", "spam", "add", 5), ("one", "spam", "remove", 5),
    ("3.4", "ads", "add", 0), ("old.net", "spam", "add", 500), ("old.net", "ads", "add", 100), ("old.net", "ads", "remove", 1_000_000_000)]


def brute_lists(url, at):
    m = re.match(r"[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", url or "", re.I)
    if not m or at is None:
        return ""
    host = m[1].lower().rstrip(".")
    labels = host.split(".")
    keys = {host} if re.fullmatch(r"[0-9]+(\.[0-9]+){3}", host) else {host, *(".".join(labels[i:]) for i in range(1, len(labels) - 1))}
    if seg := re.match(r"[^/]*//[^/?#]*/([^/?#]+)", url):
        keys.add(f"{host}/{seg[1]}")
    found = set()
    for key, name in {(k, n) for k, n, *_ in ENTRIES}:
        past = [(t, a) for k, n, a, t in ENTRIES if (k, n) == (key, name) and t <= at]
        if key in keys and past and max(past)[1] == "add":
            found.add(name)
    return ",".join(sorted(found))


@pytest.mark.parametrize("bucket_s", [7, 3600])
def test_any_interval_is_found_in_its_buckets(spark, bucket_s):
    """Intervals of all lengths, from one second to years, against captures at and around their ends."""
    rng = __import__("random").Random(5)
    spans = [(f"s{i}.org", a, a + rng.choice([1, bucket_s, 40 * bucket_s, rng.randrange(1, 10**8)])) for i in range(60) for a in [rng.randrange(-(10**8), 10**9)]]
    entries = [(k, "ads", a, t) for k, x, y in spans for a, t in (("add", x), ("remove", y))]
    times = [(k, t) for k, x, y in spans for t in {x - 1, x, y - 1, y, (x + y) // 2, x + bucket_s, y - bucket_s, rng.randrange(x, y)}]
    captures = spark.createDataFrame([(f"http://{k}/", t) for k, t in times], "url string, fetched_s long")
    got = urls.url_verdicts(captures, spark.createDataFrame(entries, "key string, list string, action string, at long"), bucket_s=bucket_s)
    within = {k: (x, y) for k, x, y in spans}
    for r in got.collect():
        x, y = within[r["host"]]
        assert r["n_listings"] == int(x <= r["fetched_s"] < y), (r, x, y)


def test_cover_is_exact_and_short(spark):
    rows = [(a, a + n) for a in (-70, -1, 0, 3, 511, 4095) for n in (1, 2, 7, 8, 9, 64, 100, 5000, 300_000)]
    df = spark.createDataFrame(rows, "a long, b long").select("a", "b", urls.cover(F.col("a"), F.col("b"), 5).alias("n"))
    for r in df.collect():
        held = [i for x in r["n"] for i in range(x["node"] << (3 * x["level"]), (x["node"] + 1) << (3 * x["level"]))]
        assert sorted(held) == list(range(r["a"], r["b"])) and len(r["n"]) <= 2 * 7 * 4 + 300_000 // 4096 + 1


def test_clashing_and_undated_columns(spark):
    captures = spark.createDataFrame([("http://a.org/", 5, "h", "l", 9, "b", 1, 2)], "url string, fetched_s long, host string, lists string, n_listings int, blocked string, visit int, u int")
    entries = spark.createDataFrame([("a.org", "ads", "add", 1), ("a.org", "ads", "remove", None), ("a.org", None, "add", 1), (None, "ads", "add", 1)], "key string, list string, action string, at long")
    (r,) = urls.url_verdicts(captures, entries).collect()
    assert r.asDict() == {"url": "http://a.org/", "fetched_s": 5, "visit": 1, "u": 2, "host": "a.org", "lists": "ads", "n_listings": 1, "blocked": True}


def test_urls_equal_brute_force(spark):
    captures = spark.createDataFrame([(i, u, t, "x", "y") for i, (u, t) in enumerate(PAGES)], "page_id long, url string, fetched_s long, list string, key string")
    entries = spark.createDataFrame(ENTRIES, "key string, list string, action string, at long")
    got = urls.url_verdicts(captures, entries)
    assert {r["page_id"]: r["lists"] for r in got.collect()} == {i: brute_lists(u, t) for i, (u, t) in enumerate(PAGES)}
    assert got.count() == len(PAGES) and got.columns[:5] == captures.columns
    assert "Python" not in plan(got) and "Arrow" not in plan(got)
    none = urls.url_verdicts(captures, entries.limit(0))
    assert {r["blocked"] for r in none.collect()} == {False}
    assert urls.url_verdicts(captures.limit(0), entries).count() == 0
    assert collected(none.select("page_id")) == [(i,) for i in sorted(range(len(PAGES)), key=lambda i: repr((i,)))]


def test_many_matches_in_a_long_text(spark):
    """Work follows the text and its matches; pieces that cross the blocks, lie in one, or touch are put together right."""
    long = " ".join(("é🎉" * (i % 700) if i % 50 == 0 else "") + f"{i * 2654435761 % 2**32:024x}" + ("token=abcdef" if i % 9 == 0 else "") for i in range(3000))
    rows = [(1, long), (2, "a" * 24), (3, "x" + "b" * 5000 + " password: 0123456789abcdef0123456789abcdef." + "y" * 1023), (4, "AKIA" + "A" * 16 + "0" * 24)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r for r in secrets.redact(docs).collect()}
    report = {r["doc_id"]: r["spans"] for r in secrets.secret_report(docs).collect()}
    for i, t in rows:
        out, at = [], 0
        for a, b in [tuple(map(int, s.split(":")[1:])) for s in report[i].split(",")]:
            if a >= at:
                out.append(t[at:a] + "[SECRET]")
            at = max(at, b)
        assert got[i]["text"] == "".join(out) + t[at:] and got[i]["n_chars"] == len(got[i]["text"])
    assert report[1].count("hex") == 3000


def test_running_totals(spark):
    df = spark.createDataFrame([([3, 1, 4, 1, 5],), ([7],), ([],), (list(range(100)),)], "x array<int>")
    got = df.select("x", secrets.running(F.col("x"), lambda a, b: a + b).alias("sum"), secrets.running(F.col("x"), F.greatest).alias("most")).collect()
    for r in got:
        assert r["sum"] == list(itertools.accumulate(r["x"])) and r["most"] == list(itertools.accumulate(r["x"], max))
