"""Benchmark decontamination through suffix arrays of the training texts.

Texts are word sequences: A-Z lower-cased, words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. A task cuts its documents into
shards of about SHARD_BYTES and sorts the word suffixes of each shard into a suffix array, by prefix doubling on 64-bit
word hashes. Every test suffix is then searched in it: the range of array slots that share its first d words is narrowed
word by word with binary searches, until it is empty. The depth reached is the length of the longest verbatim match, the
slots of the last range are its places. Training texts are neither shuffled nor copied; the test side goes to the tasks.

A window is WINDOW consecutive words of an item, or all words of a shorter one. A document word is hit if it stands inside
any occurrence of a window. ``contamination`` gives hits and items, ``longest_matches`` the longest match of each test
suffix and where it is, ``decontaminated`` the documents that are not affected.

The test side is counted before it is sent. Up to BLOCK_CHARS characters it is one block; beyond, items are dealt to blocks by
hash, every block makes its own pass, and the hits of a document are merged over the blocks.

Defined cases: a null or empty text has no words and no hits; an item without words has no window; items of one id are one
item, a null id is written as an empty string; repeated rows give repeated results; an empty benchmark hits nothing, an
empty table gives an empty table; a very long text is a shard of its own, with some hundred bytes of work a word; other
columns are not read (``decontaminated`` passes them through, whatever their names).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .scratch import written

WINDOW = 10
SHARD_BYTES = 8 << 20
#: Characters of benchmark texts that one pass sends to the tasks.
BLOCK_CHARS = 16 << 20

BREAKS = np.zeros(256, bool)
BREAKS[:0x80] = True
BREAKS[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of all texts, and how many words each text has."""
    buf, offs = ta.buffers(column)
    buf = LOWER[buf]
    starts, ends, of = ta.words(buf, offs, BREAKS)
    return ta.hashes(buf, starts, ends), np.bincount(of, minlength=len(column))


def ended(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after the other, each closed by a word of its own that occurs nowhere else; and where each starts."""
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))
    closed = np.empty(starts[-1], np.uint64)
    last = np.zeros(len(closed), bool)
    last[starts[1:] - 1] = True
    closed[~last], closed[last] = words, np.arange(len(sizes), dtype=np.uint64)
    return closed, starts


def sorted_order(words: np.ndarray) -> np.ndarray:
    """Positions by word hash. The high bits of a hash and the position are sorted as one number, which is fastest."""
    n, bits = len(words), max(1, int(len(words) - 1).bit_length())
    low = np.uint64((1 << bits) - 1)
    packed = np.sort((words & ~low) | np.arange(n, dtype=np.uint64))
    order = (packed & low).astype(np.int64)
    found, high = words[order], packed & ~low
    if ((high[1:] == high[:-1]) & (found[1:] != found[:-1])).any():  # two hashes of equal high bits
        return np.argsort(words, kind="stable")
    return order


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of the word sequences that start there, compared over ``depth`` words.

    The sequences come from ``ended``: two that agree in h words hold no closing word there, so position + h exists."""
    n = len(words)
    if n < 2:
        return np.arange(n)
    order = sorted_order(words)
    found = words[order]
    new = np.concatenate(([True], found[1:] != found[:-1]))
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # by slot: the first slot of its group of equals
    rank = np.empty(n, np.int64)
    rank[order] = group
    slots, h = np.flatnonzero(~(new & np.append(new[1:], True))), 1
    while h < depth and len(slots):
        at = order[slots]
        key = group[slots] << 32 | rank[at + h]
        by = np.argsort(key)
        at, key = at[by], key[by]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        order[slots] = at
        group[slots] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        rank[at] = group[slots]
        slots = slots[~(new & np.append(new[1:], True))]
        h *= 2
    return order


def search(words: np.ndarray, order: np.ndarray, tests: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each test suffix, ``lengths`` words from ``starts`` on: the words of it that some place matches, and the slots of these places."""
    first = words[order]
    low, high = (np.searchsorted(first, tests[starts], side) for side in ("left", "right"))
    matched = (high > low).astype(np.int64)
    live, depth = np.flatnonzero((high > low) & (lengths > 1)), 1
    while len(live):
        wanted = tests[starts[live] + depth]
        ends = []
        for right in (False, True):
            a, b = low[live], high[live]
            open_ = np.flatnonzero(a < b)
            while len(open_):
                middle = (a[open_] + b[open_]) >> 1
                there = words[order[middle] + depth]
                after = there <= wanted[open_] if right else there < wanted[open_]
                a[open_] = np.where(after, middle + 1, a[open_])
                b[open_] = np.where(after, b[open_], middle)
                open_ = open_[a[open_] < b[open_]]
            ends.append(a)
        some = ends[1] > ends[0]
        live = live[some]
        low[live], high[live] = ends[0][some], ends[1][some]
        depth += 1
        matched[live] = depth
        live = live[lengths[live] > depth]
    return matched, low, high


@dataclass
class Tests:
    """One block of the benchmark: words of all items, and its different windows with the items of each."""

    names: np.ndarray  # item ids as strings, sorted
    words: np.ndarray
    item: np.ndarray  # of each word: the number of its name
    place: np.ndarray  # of each word: its number in the item
    left: np.ndarray  # of each word: words from it to its item's end
    starts: np.ndarray  # of each window
    lengths: np.ndarray
    item_offsets: np.ndarray  # of each window: its part of ``items``
    items: np.ndarray


def tests_of(names: list[str], texts: pa.Array) -> Tests:
    words, sizes = hashed_words(texts)
    known, number = np.unique(np.array(names, dtype=object), return_inverse=True)
    opens = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(words)) - opens[text]
    left = sizes[text] - place
    begins = np.flatnonzero((left >= WINDOW) | (place == 0))
    lengths = np.minimum(left[begins], WINDOW)
    # Equal windows are one: they are compared as rows of hashes, 0 behind the end of a short one.
    rows = np.zeros((len(begins), WINDOW), np.uint64)
    for d in range(WINDOW):
        inside = lengths > d
        rows[inside, d] = words[begins[inside] + d]
    _, first, of = np.unique(rows, axis=0, return_index=True, return_inverse=True) if len(begins) else (None, *[np.zeros(0, np.int64)] * 2)
    pairs = np.unique(np.stack([of.ravel(), number[text[begins]]]), axis=1)
    offsets = np.searchsorted(pairs[0], np.arange(len(first) + 1))
    return Tests(known, words, number[text], place, left, begins[first], lengths[first], offsets, pairs[1])


def blocks_of(benchmark: DataFrame, item_col: str, text_col: str) -> list[Tests]:
    """The benchmark in blocks of about BLOCK_CHARS characters; the driver takes one at a time."""
    slim = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chars = slim.agg(F.sum(F.length("text"))).head()[0] or 0
    n = math.ceil(chars / BLOCK_CHARS)
    found = []
    for k in range(n):
        table = (slim if n == 1 else slim.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)).toArrow()
        found.append(tests_of(table.column("item").to_pylist(), table.column("text")))
    return found


HITS = "array<struct<start:int,end:int>>"


def spans(mask: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start and end within the text of each run of True; texts start at ``starts`` and a run ends before the next."""
    edges = np.diff(np.concatenate(([False], mask, [False])).astype(np.int8))
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    of = np.searchsorted(starts, begin, "right") - 1
    return of, begin - starts[of], end - starts[of]


def hits_in(closed: np.ndarray, starts: np.ndarray, tests: Tests) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flags of the words that are hit, and the different pairs (text number, item number)."""
    order = suffix_array(closed, WINDOW)
    matched, low, high = search(closed, order, tests.words, tests.starts, tests.lengths)
    full = np.flatnonzero(matched == tests.lengths)
    counts = (high - low)[full]
    window = np.repeat(full, counts)
    at = order[np.repeat(low[full] - (np.cumsum(counts) - counts), counts) + np.arange(len(window))]
    change = np.bincount(at, minlength=len(closed) + 1) - np.bincount(at + tests.lengths[window], minlength=len(closed) + 1)
    pairs = np.unique((np.searchsorted(starts, at, "right") - 1) << 32 | window)
    text, window = pairs >> 32, pairs & 0xFFFFFFFF
    each = tests.item_offsets[window + 1] - tests.item_offsets[window]
    item = tests.items[np.repeat(tests.item_offsets[window] - (np.cumsum(each) - each), each) + np.arange(each.sum())]
    listed = np.unique(np.repeat(text, each) << 32 | item)
    return np.cumsum(change[:-1]) > 0, listed >> 32, listed & 0xFFFFFFFF


def _lists(values: pa.Array, of: np.ndarray, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32()), values)


def _scanned(rows: DataFrame, tests: Tests) -> DataFrame:
    """(key, n_words, hits, items) of (key, text) for one block of the benchmark."""
    sent = rows.sparkSession.sparkContext.broadcast(tests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        for batch in batches:
            for part in ta.chunks(batch, "text", SHARD_BYTES):
                words, sizes = hashed_words(part.column("text"))
                closed, starts = ended(words, sizes)
                hit, text, item = hits_in(closed, starts, block)
                of, a, b = spans(hit, starts)
                pairs = pa.StructArray.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["start", "end"])
                items = pa.array(block.names[item].tolist(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(sizes, pa.int64()), _lists(pairs, of, part.num_rows), _lists(items, text, part.num_rows)], ["key", "n_words", "hits", "items"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, n_words long, hits {HITS}, items array<string>")


def merged(hits: Column) -> Column:
    """Spans of several passes, overlapping and adjacent ones as one; each is opened where no earlier one reaches."""
    ordered = F.array_sort(hits)
    step = lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["start"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end")))),
    ).otherwise(F.concat(acc, F.array(s)))
    return F.aggregate(ordered, F.array().cast(HITS), step)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row a document: id, n_words, hits (runs of hit words: start, end exclusive), items (sorted strings)."""
    return _contamination(docs.select(docs[id_col].alias("key"), docs[text_col].alias("text")), blocks_of(benchmark, item_col, item_text_col)).withColumnRenamed("key", id_col)


def _contamination(rows: DataFrame, blocks: list[Tests]) -> DataFrame:
    if len(blocks) < 2:
        return _scanned(rows, blocks[0] if blocks else tests_of([], pa.array([], pa.string())))
    # Several passes meet by a number of the row, which has to be the same in each.
    numbered = written(rows.select(F.monotonically_increasing_id().alias("row"), "key", "text"), "decontaminated")
    found = None
    for block in blocks:
        one = _scanned(numbered.select(F.struct("row", F.col("key").alias("id")).alias("key"), "text"), block)
        found = one if found is None else found.union(one)
    by_row = found.select(F.col("key.row").alias("row"), F.col("key.id").alias("id"), "n_words", "hits", "items").groupBy("row")
    whole = by_row.agg(F.first("id").alias("key"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("items")).alias("items"))
    return whole.select("key", "n_words", merged(F.col("hits")).alias("hits"), F.array_sort(F.array_distinct("items")).alias("items"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents without a hit, with all their columns."""
    rows = docs.select(F.struct("*").alias("key"), docs[text_col].alias("text"))
    clean = _contamination(rows, blocks_of(benchmark, item_col, item_text_col)).where(F.size("hits") == 0)
    return clean.select("key.*")


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each word of each item: item, place (number of the word), length of the longest verbatim match of the item's
    words from there on, and its location (id of a document, least word number in it); null location where length is 0.

    A task keeps the best match of each test suffix over its shards; tasks meet in one aggregation."""
    rows = docs.select(docs[id_col].alias("key"), docs[text_col].alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    found = rows.sparkSession.createDataFrame([], f"item string, place int, length int, key {kind}, at int")
    for block in blocks_of(benchmark, item_col, item_text_col):
        found = found.union(_longest(rows, block, kind))
    best = F.max(F.struct("length", F.struct((-F.col("at")).alias("before"), F.col("key").alias("key")).alias("where")))
    one = found.groupBy("item", "place").agg(best.alias("best"))
    there = F.col("best.length") > 0
    return one.select(F.col("item").alias(item_col), "place", F.col("best.length").alias("length"), F.when(there, F.col("best.where.key")).alias(id_col), F.when(there, -F.col("best.where.before")).alias("at"))


def _longest(rows: DataFrame, tests: Tests, kind: str) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(tests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        n = len(block.words)
        length, at, depth = np.zeros(n, np.int64), np.zeros(n, np.int64), int(block.left.max(initial=1))
        keys = [None] * n
        for batch in batches:
            for part in ta.chunks(batch, "text", SHARD_BYTES):
                words, sizes = hashed_words(part.column("text"))
                closed, starts = ended(words, sizes)
                order = suffix_array(closed, depth)
                matched, low, high = search(closed, order, block.words, np.arange(n), block.left)
                better = np.flatnonzero(matched > length)
                places = order[low[better]]
                of = np.searchsorted(starts, places, "right") - 1
                length[better], at[better] = matched[better], places - starts[of]
                for i, key in zip(better.tolist(), part.column("key").take(pa.array(of)).to_pylist(), strict=True):
                    keys[i] = key
        columns = [pa.array(block.names[block.item].tolist(), pa.string()), *(pa.array(x, pa.int32()) for x in (block.place, length))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(keys, pa_kind), pa.array(at, pa.int32())], ["item", "place", "length", "key", "at"])

    from pyspark.sql.pandas.types import to_arrow_type

    pa_kind = to_arrow_type(rows.schema["key"].dataType)
    return rows.mapInArrow(run, f"item string, place int, length int, key {kind}, at int")


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and hits."""
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"), "hits"
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
i AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS k, unnest(list_transform(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1), lambda j: array_to_string(w[j:j + {WINDOW - 1}], ' '))) AS g FROM b WHERE len(w) > 0),
p AS (SELECT n, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM i)),
o AS (SELECT n, p, k, g FROM (SELECT n, p, k, array_to_string(w[p:p + k - 1], ' ') AS g FROM p) SEMI JOIN i USING (g, k)),
h AS (SELECT DISTINCT n, unnest(range(p, p + k)) AS p FROM o),
r AS (SELECT n, p, p - row_number() OVER (PARTITION BY n ORDER BY p) AS run FROM h),
s AS (SELECT n, min(p) - 1 AS a, max(p) AS z FROM r GROUP BY n, run),
hits AS (SELECT n, sum(z - a)::BIGINT AS n_hit, list({{'start': a::INT, 'end': z::INT}} ORDER BY a) AS hits FROM s GROUP BY n),
items AS (SELECT n, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT n, item FROM o JOIN i USING (g, k)) GROUP BY n)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(hits, []) AS hits
FROM d LEFT JOIN hits USING (n) LEFT JOIN items USING (n)
"""
