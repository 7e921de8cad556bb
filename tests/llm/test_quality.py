import collections
import re

import numpy as np
import pyarrow as pa
import pytest

from corpusflow.llm import quality
from corpusflow.llm import textarrays as ta

from .data import collected, documents, empty, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    three = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if three[x] > 1 for k in range(3)}
    seen, dup, worded = set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            worded += 1
            dup += line in seen
            seen.add(line)
    n, chars = len(w), sum(map(len, w))
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    failed = n < 50 or 100 * len(covered) > 50 * n
    alphabetic = sum(bool(re.search("[A-Za-zÀ-῿　-\U0010ffff]", x)) for x in w)
    capitals, letters = len(re.findall("[A-Z]", text)), len(re.findall("[A-Za-z]", text))
    bad = 10 * symbols > n or 100 * dup > 35 * worded or 2 * chars < 5 * n or chars > 12 * n or 2 * capitals > letters or 100 * alphabetic < 80 * n
    return n, chars, symbols, dup, len(covered), failed, not failed and not bad


def test_report_equals_brute_force(spark):
    expected = sorted(((r[0], *brute(r[1])) for r in rows()), key=repr)
    assert collected(quality.quality_report(documents(spark))) == expected


def test_order_of_rules_does_not_change_the_verdict(spark):
    docs = documents(spark)
    a = collected(quality.quality_report(docs))
    b = collected(quality.quality_report(docs, rules=tuple(reversed(quality.RULES)), sample_rows=0))
    assert a == b


def test_estimates_put_worth_first(spark):
    found = quality.estimate(documents(spark))
    assert [e.worth for e in found] == sorted((e.worth for e in found), reverse=True)
    assert {e.rule for e in found} == set(quality.RULES)
    assert all(e.seconds > 0 and 0 <= e.rejected <= 1 for e in found)


def test_filter_passes_whole_rows(spark):
    kept = collected(quality.quality_filter(documents(spark)))
    assert kept == sorted((r for r in rows() if brute(r[1])[-1]), key=repr)


def test_a_rejected_text_costs_no_count():
    """A rule sees only what the rules before it have kept, and what it counts is counted then."""
    texts = ["few words"] * 5 + [rows()[0][1]]
    seen = []

    def spy(t):
        seen.append(len(t))
        return quality.too_many_repeated_lines(t)

    buf, offs = ta.buffers(pa.array(texts))
    t = quality.Texts(buf, offs)
    kept = quality.cascade(t, (quality.too_few_words, spy), np.ones(6, bool))
    assert kept.tolist() == [False] * 5 + [True] and seen == [1] and "lines" not in t._known


@pytest.mark.parametrize("text", ["words of prose and more\n" * 40_000, "x" * 3_000_000, ("ab " * 70_000 + "\n") * 3, "é" * 600_000 + " " + "y " * 60 + "é" * 600_000], ids=range(4))
def test_slices_of_a_very_long_text_change_nothing(monkeypatch, text):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    t = quality.Texts(*ta.buffers(pa.array([text])))
    got = tuple(int(t[n][0]) for n in names)
    assert got == brute(text)[:5]


def test_empty(spark):
    assert quality.quality_report(empty(spark)).count() == 0
    assert quality.quality_filter(empty(spark)).count() == 0
