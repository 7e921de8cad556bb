"""Quality rules as a short-circuit cascade.

Each rule's cost and rejection share are measured by the executors on a bounded sample of whole texts; the rules then run
in the order of rejections per second, and a rule sees only the texts that every rule before it has kept. What a rule
counts is counted when it first asks, so ``quality_filter`` spends nothing on the costly counts of rejected texts. A text
is kept if it passes the base rules and all others, so the order changes the time and never the verdict.

Defined cases: a null text has no words and fails the base rule; an empty table gives an empty table; repeated rows give
repeated results; a very long text is counted whole, slice by slice, with some bytes of work a byte; columns other than
the id and the text are not read (``quality_filter`` passes them through).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta

#: Expected rows of the sample that cost and selectivity are measured on. Only the order of the rules depends on it.
SAMPLE_ROWS = 1000

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
_UPPER, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LETTER[ord("A") : ord("Z") + 1] = True
_LETTER[ord("a") : ord("z") + 1] = True
#: A word is alphabetic if it has an ASCII letter or a code point from U+00C0 on outside U+2000-U+2FFF.
_ALPHA = _LETTER.copy()
_ALPHA[0xC3:] = True
_ALPHA[0xE2] = False


class Texts:
    """Some texts of a batch. Counts and words are computed when they are first asked for."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, known: dict | None = None):
        self.buf, self.offs, self._known = buf, offs, known or {}

    def __len__(self) -> int:
        return len(self.offs) - 1

    def __getitem__(self, name: str):
        if name not in self._known:
            self._known[name] = COMPUTED[name](self)
        return self._known[name]

    def take(self, keep: np.ndarray) -> Texts:
        rows = np.flatnonzero(keep)
        if len(rows) == len(keep):
            return self
        lengths = np.diff(self.offs)[rows]
        offs = np.concatenate(([0], np.cumsum(lengths)))
        parts = [self.buf[a:b] for a, b in zip(self.offs[rows], self.offs[rows + 1], strict=True)]
        return Texts(np.concatenate(parts) if parts else self.buf[:0], offs, {k: v[rows] for k, v in self._known.items() if k in COUNTS})


def _words(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return ta.words(t.buf, t.offs)


def _lines(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those that equal an earlier one, of each text."""
    word_starts = t["words"][0]
    a, b, of = ta.lines(t.buf, t.offs)
    worded = np.searchsorted(word_starts, b) > np.searchsorted(word_starts, a)
    a, b, of = a[worded], b[worded], of[worded]
    _, first = np.unique(ta.hashes(t.buf, a, b) ^ ta.mix(of.astype(np.uint64) + np.uint64(1)), return_index=True)
    n = np.bincount(of, minlength=len(t))
    return n, n - np.bincount(of[first], minlength=len(t))


def _repeat_words(t: Texts) -> np.ndarray:
    """Words in three-word windows that the text holds twice or more."""
    starts, ends, of = t["words"]
    h = ta.hashes(t.buf, starts, ends)
    three = np.flatnonzero(of[2:] == of[:-2]) if len(of) > 2 else np.zeros(0, np.int64)
    key = h[three] + ta.mix(h[three + 1] + np.uint64(3)) * np.uint64(5)
    key += ta.mix(h[three + 2] + np.uint64(7)) * np.uint64(11)
    again = three[ta.repeated(ta.mix(key) ^ ta.mix(of[three].astype(np.uint64) + np.uint64(1)))]
    covered = np.zeros(len(of), bool)
    for k in range(3):
        covered[again + k] = True
    return np.bincount(of[covered], minlength=len(t))


COMPUTED: dict[str, Callable[[Texts], object]] = {
    "words": _words,
    "lines": _lines,
    "n_words": lambda t: np.bincount(t["words"][2], minlength=len(t)),
    "word_chars": lambda t: ta.per_text(~ta.SPACE[t.buf] & ((t.buf & 0xC0) != 0x80), t.offs),
    "n_symbols": lambda t: ta.per_text(SYMBOL[t.buf], t.offs),
    "n_lines": lambda t: t["lines"][0],
    "n_dup_lines": lambda t: t["lines"][1],
    "n_repeat_words": _repeat_words,
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def too_few_words(t: Texts) -> np.ndarray:
    """Base rule: fewer than 50 words."""
    return t["n_words"] < 50


def too_repetitive(t: Texts) -> np.ndarray:
    """Base rule: more than half of the words stand in repeated windows of three."""
    return 100 * t["n_repeat_words"] > 50 * t["n_words"]


def too_many_symbols(t: Texts) -> np.ndarray:
    """More than one symbol character for ten words."""
    return 10 * t["n_symbols"] > t["n_words"]


def too_many_repeated_lines(t: Texts) -> np.ndarray:
    """More than 35 % of the lines are copies of an earlier line."""
    return 100 * t["n_dup_lines"] > 35 * t["n_lines"]


def odd_word_length(t: Texts) -> np.ndarray:
    """Words of fewer than 2.5 or more than 12 characters on average."""
    chars, n = t["word_chars"], t["n_words"]
    return (2 * chars < 5 * n) | (chars > 12 * n)


def shouting(t: Texts) -> np.ndarray:
    """More than half of the ASCII letters are capitals."""
    return 2 * ta.per_text(_UPPER[t.buf], t.offs) > ta.per_text(_LETTER[t.buf], t.offs)


def few_alphabetic_words(t: Texts) -> np.ndarray:
    """Fewer than 80 % of the words hold a letter."""
    starts, ends, of = t["words"]
    letters = np.flatnonzero(_ALPHA[t.buf])
    alphabetic = np.bincount(of[np.searchsorted(letters, ends) > np.searchsorted(letters, starts)], minlength=len(t))
    return 100 * alphabetic < 80 * t["n_words"]


BASE_RULES: tuple[Callable[[Texts], np.ndarray], ...] = (too_few_words, too_repetitive)
RULES: tuple[Callable[[Texts], np.ndarray], ...] = (too_many_symbols, too_many_repeated_lines, odd_word_length, shouting, few_alphabetic_words)


@dataclass
class RuleEstimate:
    rule: Callable[[Texts], np.ndarray]
    seconds: float
    rejected: float

    @property
    def worth(self) -> float:
        return self.rejected / max(self.seconds, 1e-9)


def estimate(docs: DataFrame, text_col: str = "text", rules=RULES, sample_rows: int = SAMPLE_ROWS) -> list[RuleEstimate]:
    """Cost and rejection share of each rule on about ``sample_rows`` texts, best first. Seven numbers or so come to the driver."""
    total = docs.count()
    sample = docs.select(docs[text_col].alias("text")).sample(min(1.0, sample_rows / max(total, 1)), seed=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, rejected, seen = [0.0] * len(rules), [0] * len(rules), 0
        for batch in batches:
            for part in ta.chunks(batch, "text"):
                buf, offs = ta.buffers(part.column("text"))
                seen += len(offs) - 1
                for i, rule in enumerate(rules):
                    began = time.perf_counter()
                    rejected[i] += int(rule(Texts(buf, offs)).sum())
                    spent[i] += time.perf_counter() - began
        columns = [pa.array(range(len(rules)), pa.int32()), pa.array(spent), pa.array(rejected, pa.int64()), pa.array([seen] * len(rules), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["rule", "seconds", "rejected", "seen"])

    measured = sample.mapInArrow(run, "rule int, seconds double, rejected long, seen long").groupBy("rule").agg(F.sum("seconds"), F.sum("rejected"), F.sum("seen"))
    by = {r[0]: r for r in measured.collect()}
    found = [RuleEstimate(rule, by[i][1], by[i][2] / max(by[i][3], 1)) if i in by else RuleEstimate(rule, 1.0, 0.0) for i, rule in enumerate(rules)]
    return sorted(found, key=lambda e: -e.worth)


def cascade(t: Texts, rules, alive: np.ndarray) -> np.ndarray:
    """Which texts pass all rules, of those that are alive; each rule sees what the ones before have kept."""
    kept, rows = np.zeros(len(t), bool), np.flatnonzero(alive)
    t = t.take(alive)
    for rule in rules:
        if not len(rows):
            break
        good = ~rule(t)
        rows, t = rows[good], t.take(good)
    kept[rows] = True
    return kept


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row a document: id, counts, base_failed, kept."""
    order = [e.rule for e in estimate(docs, text_col, rules, sample_rows)]
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.chunks(batch, "text"):
                t = Texts(*ta.buffers(part.column("text")))
                counts = [pa.array(t[c], pa.int64()) for c in shown]
                failed = too_few_words(t) | too_repetitive(t)
                kept = cascade(t, order, ~failed)
                yield pa.RecordBatch.from_arrays([part.column("id"), *counts, pa.array(failed), pa.array(kept)], [id_col, *shown, "base_failed", "kept"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{c} long" for c in shown) + ", base_failed boolean, kept boolean")


def quality_filter(docs: DataFrame, text_col: str = "text", rules=RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The kept documents with all their columns. The base rules take part in the cascade."""
    order = [e.rule for e in estimate(docs, text_col, (*BASE_RULES, *rules), sample_rows)]
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(at)], ["text"])
            kept = []
            for part in ta.chunks(texts, "text"):
                t = Texts(*ta.buffers(part.column("text")))
                kept.append(cascade(t, order, np.ones(len(t), bool)))
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(run, docs.schema)


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT n, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT n, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d)),
c AS (SELECT n, count(*) AS n_words, sum(length(word)) AS word_chars, count(*) FILTER (regexp_matches(word, '[A-Za-z\x{C0}-\x{1FFF}\x{3000}-\x{10FFFF}]')) AS n_alpha FROM w GROUP BY n),
k AS (SELECT n, i, concat_ws(' ', word, lead(word) OVER x, lead(word, 2) OVER x) AS three, lead(word, 2) OVER x IS NOT NULL AS whole FROM w WINDOW x AS (PARTITION BY n ORDER BY i)),
r AS (SELECT n, count(DISTINCT i + j) AS n_repeat FROM (SELECT n, i, count(*) OVER (PARTITION BY n, three) AS times FROM k WHERE whole), (VALUES (0), (1), (2)) v(j) WHERE times > 1 GROUP BY n),
l AS (SELECT n, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM (SELECT n, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY n),
a AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
             coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(n_alpha, 0) AS n_alpha,
             len(regexp_extract_all(t, '[A-Z]')) AS n_upper, len(regexp_extract_all(t, '[A-Za-z]')) AS n_letters
      FROM d LEFT JOIN c USING (n) LEFT JOIN r USING (n) LEFT JOIN l USING (n))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 35 * n_lines OR 2 * word_chars < 5 * n_words
            OR word_chars > 12 * n_words OR 2 * n_upper > n_letters OR 100 * n_alpha < 80 * n_words) AS kept
FROM a
"""
